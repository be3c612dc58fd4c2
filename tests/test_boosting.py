import numpy as np
import pytest

from tidemill.operators import boosting


def rings(n=400, seed=5):
    """Two classes that only cuts in both columns tell apart, with some labels turned; a third column is noise."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (r.random(n) < 0.05)).astype(float)
    return x, y


def auc(y, s):
    above = s[y == 1][:, None] - s[y == 0][None, :]
    return float((above > 0).mean() + (above == 0).mean() / 2)


def brute_cut(x, g, h, ridge, least):
    """The largest gain over every threshold of every column."""
    best = -np.inf
    for f in range(x.shape[1]):
        for t in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= t
            hl, hh = h[low].sum(), h[~low].sum()
            if hl >= least and hh >= least:
                best = max(best, (g[low].sum() ** 2 / (hl + ridge) + g[~low].sum() ** 2 / (hh + ridge) - g.sum() ** 2 / (h.sum() + ridge)) / 2)
    return best


def test_first_cut_and_leaves_by_brute_force():
    x, y = rings(60)
    base, feature, cut, gain, value = next(boosting.fit(x, y, np.ones(60), 1, 0, share=1.0))
    p = np.full(60, 1 / (1 + np.exp(-base)))
    assert p[0] == pytest.approx(y.mean())
    assert gain[0] == pytest.approx(brute_cut(x, p - y, p * (1 - p), 1.0, 1.0))
    low = x[:, feature[0]] <= cut[0]
    for child, rows in ((1, low), (2, ~low)):
        if feature[child] >= 0:
            assert gain[child] == pytest.approx(brute_cut(x[rows], (p - y)[rows], (p * (1 - p))[rows], 1.0, 1.0))
    node = np.zeros(60, int)
    for _ in range(boosting.DEPTH):
        node = np.array([2 * n + 1 + int(row[feature[n]] > cut[n]) for n, row in zip(node, x, strict=True)])
    for leaf in set(node):
        at = node == leaf
        assert value[leaf - 15] == pytest.approx(-0.08 * (p - y)[at].sum() / ((p * (1 - p))[at].sum() + 1))
    forest = [(base, np.array(feature), np.array(cut), np.array(value))]
    assert boosting.margins(x, forest) == pytest.approx(base + np.array([value[n - 15] for n in node]))


def test_more_rounds_beat_twenty_out_of_fold(spark):
    x, y = rings()
    rows = spark.createDataFrame([(f"r{i}", *map(float, v), float(t), i % 5) for i, (v, t) in enumerate(zip(x, y, strict=True))], "k string, a double, b double, c double, label double, fold int")
    found = {}
    for rounds in (20, 200):
        trees = boosting.forests(rows, ["a", "b", "c"], "k", 5, rounds=rounds, fold_rounds=rounds)
        assert {(r["model"], r["count"]) for r in trees.groupBy("model").count().collect()} == {(m, rounds) for m in range(-1, 5)}
        out = boosting.scored(rows, ["a", "b", "c"], "k", trees).toPandas()
        found[rounds] = auc(out["label"].to_numpy(), out["margin_out"].to_numpy())
    assert found[200] > found[20] and found[200] > 0.9
    shares = boosting.importance(trees, ["a", "b", "c"])
    assert sum(shares.values()) == pytest.approx(1) and shares["c"] < min(shares["a"], shares["b"])


def test_sample_is_bounded_weighted_and_independent_of_partitions(spark):
    x, y = rings(600)
    y[:] = x[:, 0] > 1.0
    rows = spark.createDataFrame([(f"r{i}", float(v[0]), float(v[1]), float(t), i % 2) for i, (v, t) in enumerate(zip(x, y, strict=True))], "k string, a double, b double, label double, fold int")
    one = boosting.forests(rows.repartition(1), ["a", "b"], "k", 2, rounds=5, fold_rounds=5, most=100)
    two = boosting.forests(rows.repartition(7), ["a", "b"], "k", 2, rounds=5, fold_rounds=5, most=100)
    assert one.orderBy("model", "tree").collect() == two.orderBy("model", "tree").collect()
    bots = float(y.sum())
    assert one.where("model = -1").first().base == pytest.approx(np.log(bots / (600 - bots)))
    out = boosting.scored(rows, ["a", "b"], "k", one).toPandas()
    assert len(out) == 600 and auc(out["label"].to_numpy(), out["margin"].to_numpy()) > 0.95


def test_one_class_gives_no_trees(spark):
    rows = spark.createDataFrame([("r1", 1.0, 0.0, 0), ("r2", 2.0, 0.0, 1)], "k string, a double, label double, fold int")
    trees = boosting.forests(rows, ["a"], "k", 2)
    assert trees.isEmpty() and [r.margin for r in boosting.scored(rows, ["a"], "k", trees).collect()] == [0.0, 0.0]


def frame(spark, n, folds=5, seed=7):
    x, y = rings(n, seed)
    x[:, 2] = np.round(x[:, 2])  # few values
    return spark.createDataFrame([(f"r{i}", *map(float, v), float(t), i % folds) for i, (v, t) in enumerate(zip(x, y, strict=True))], "k string, a double, b double, c double, label double, fold int")


def test_every_row_is_fitted_on(spark):
    """Of more than 50,000 rows those of the smallest hashes were fitted on."""
    rows = frame(spark, 60_000, 2).cache()
    whole, told = (boosting.forests(rows, ["a", "b", "c"], "k", 2, rounds=2, fold_rounds=1, **more) for more in ({}, {"most": 60_000}))
    assert whole.count() == 4 and sorted(whole.collect()) == sorted(told.collect())


def test_blocks_grow_the_same_trees(spark, monkeypatch):
    """A task a model, and sums of all tasks level by level, also where the held margins are worked out anew."""
    rows, columns = frame(spark, 900), ["a", "b", "c"]
    want = sorted(boosting.forests(rows, columns, "k", 5, rounds=12, fold_rounds=10).collect())
    assert len(want) == 62
    monkeypatch.setattr(boosting, "EVERY", 3)
    assert sorted(boosting.forests(rows.repartition(5), columns, "k", 5, rounds=12, fold_rounds=10, cells=0).collect()) == want
    one = rows.where("label = 0 or fold = 1")  # the model without fold 1 has one class
    trees = boosting.forests(one, columns, "k", 5, rounds=2, fold_rounds=2, cells=0)
    assert {r.model for r in trees.collect()} == {-1, 0, 2, 3, 4} and sorted(trees.collect()) == sorted(boosting.forests(one, columns, "k", 5, rounds=2, fold_rounds=2).collect())


def test_cuts_are_the_quantiles_of_all_rows(spark):
    r = np.random.default_rng(3)
    for n in (1, 2, 5, 64, 65, 700):
        x = np.stack([r.normal(size=n), r.integers(0, 4, n).astype(float), np.zeros(n)], 1)
        rows = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double")
        for got, want in zip(boosting.quantiles(rows, ["a", "b", "c"]), boosting._quantiles(x, 64), strict=True):
            assert got.tolist() == want.tolist()
