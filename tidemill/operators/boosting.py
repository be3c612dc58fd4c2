"""Gradient-boosted trees with regularised gain (M16), fitted and scored on every row.

Columns are cut at quantiles of all rows. Gradients and hessians are whole numbers of a small unit and every row's draw
is a hash of its key, so trees rest on the rows alone and not on how they are dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.iterative import CELLS
from tidemill.sources.storage import keep

#: Levels of a tree; its 2**DEPTH - 1 inner nodes lie in one array, node i before 2i + 1 and 2i + 2.
DEPTH = 4
INNER = 2**DEPTH - 1
#: Trees after which the rows' margins are worked out anew and held.
EVERY = 8
FOREST = "model int, tree int, base double, feature array<int>, cut array<double>, gain array<double>, value array<double>"


def _quantiles(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """The cuts of each column."""
    return [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for column in x.T]


def quantiles(rows: DataFrame, columns: list[str], bins: int = 64) -> list[np.ndarray]:
    """The same of a table's columns (without nulls), exactly: equal values are counted, and a range partition sums its own after those before it."""
    n = rows.count()
    values = rows.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("f", "x")).groupBy("f", "x").agg(F.count("*").alias("c"))
    dealt = keep(values.repartitionByRange("f", "x").withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("f", "part").agg(F.sum("c").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("f").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    upto = F.sum("c").over(Window.partitionBy("f", "part").orderBy("x"))
    at = dealt.join(F.broadcast(sizes.select("f", "part", before.alias("before"))), ["f", "part"]).withColumn("upto", F.col("before") + upto)
    below = lambda k: F.least(F.ceil(k * bins / max(n - 1, 1)) - 1, F.lit(bins - 1))  # noqa: E731  (cuts whose rank is less than k)
    found = at.where(below(F.col("upto")) > F.greatest(below(F.col("upto") - F.col("c")), F.lit(0))).select("f", "x").collect()  # at most bins a column
    return [np.array(sorted(r.x for r in found if r.f == i)) for i in range(len(columns))]


def _codes(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """(column, row): each value's bin. A value in bin b is above cuts[b - 1] and at most cuts[b]."""
    return np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)]).astype(np.uint8)


def _best_cuts(g: np.ndarray, h: np.ndarray, allowed: np.ndarray, ridge: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of histograms (node, feature, bin) of gradients and hessians: each node's feature, bin and gain."""
    low_g, low_h = np.cumsum(g, 2), np.cumsum(h, 2)
    all_g, all_h = low_g[:, :, -1:], low_h[:, :, -1:]
    high_g, high_h = all_g - low_g, all_h - low_h
    gain = low_g**2 / (low_h + ridge) + high_g**2 / (high_h + ridge) - all_g**2 / (all_h + ridge)
    gain = np.where((low_h >= least) & (high_h >= least) & allowed[None, :, None], gain / 2, -np.inf).reshape(len(g), -1)
    at = gain.argmax(1)
    return at // g.shape[2], at % g.shape[2], gain[np.arange(len(g)), at]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Hashes of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _at(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int, node: int = 0) -> np.ndarray:
    """The place of each row among the nodes so many levels under a node; cut holds bins."""
    if not levels:
        return np.uint8(0)
    low, high = (_at(codes, feature, cut, levels - 1, 2 * node + i) for i in (1, 2))
    return low if feature[node] < 0 else np.where(codes[feature[node]] > np.uint8(cut[node]), high + np.uint8(2 ** (levels - 1)), low)


def _added(margin: np.ndarray, codes: np.ndarray, trees: list[dict]) -> np.ndarray:
    """Margins after some more trees, added one after the other."""
    for t in trees:
        margin = margin + t["value"][_at(codes, t["feature"], t["bin"], DEPTH)]
    return margin


def _sums(codes: np.ndarray, y: np.ndarray, weight: np.ndarray, keys: np.ndarray, margin: np.ndarray, growing: dict, level: int, share: float, unit: float, bins: int) -> np.ndarray:
    """(2, node, column, bin): gradients and hessians of the rows that a tree draws, in the nodes of a level, as whole numbers of the unit."""
    drawn = np.flatnonzero((_mixed(keys ^ growing["salt"]) >> np.uint64(11)) < np.uint64(share * 2**53))
    codes, y, weight, p = codes[:, drawn], y[drawn], weight[drawn], 1 / (1 + np.exp(-margin[drawn]))
    first = np.asarray(_at(codes, growing["feature"], growing["bin"], level), np.int64) * bins
    nodes, g, h = 2**level, np.rint(weight * (p - y) / unit), np.rint(weight * p * (1 - p) / unit)
    out = np.empty((2, nodes, len(codes), bins))
    for f, code in enumerate(codes):
        cell = first + code
        for i, v in enumerate((g, h)):
            out[i, :, f] = np.bincount(cell, v, nodes * bins).reshape(nodes, bins)
    return out


def _unit(weight: float) -> float:
    """The unit of gradients: a power of two, so small that sums over rows of so much weight are still exact."""
    return 2.0 ** max(-40, int(np.ceil(np.log2(max(weight, 1.0)))) - 52)


def _grown(sums: Callable, models: dict[int, tuple[float, int, int]], cuts: list[np.ndarray], unit: float, rate: float, share: float, ridge: float, least: float) -> Iterator[dict]:
    """The trees of some models, all of a round before those of the next.

    models: by number, the base, the seed and the number of rounds. sums(level, growing, done) gives for each model in
    growing what _sums does, over all its rows; done are its trees so far. Every round draws `share` of the rows and of
    the columns. A node splits where the gain in the second-order loss with an L2 penalty of `ridge` is largest, if both
    sides keep a hessian of `least`; unsplit nodes send all rows low.
    """
    width, randoms, done = len(cuts), {m: np.random.default_rng(seed) for m, (_, seed, _) in models.items()}, {m: [] for m in models}
    for turn in range(max((rounds for *_, rounds in models.values()), default=0)):
        growing, allowed = {}, {}
        for m, (base, seed, rounds) in models.items():
            if turn < rounds:
                allowed[m] = np.zeros(width, bool)
                allowed[m][randoms[m].choice(width, max(1, round(share * width)), replace=False)] = True
                salt = _mixed(np.array([((seed << 32) + turn + 1) % 2**64], np.uint64))[0]
                growing[m] = {"model": m, "tree": turn, "base": base, "salt": salt, "feature": np.full(INNER, -1), "bin": np.zeros(INNER, int), "cut": np.full(INNER, np.inf), "gain": np.zeros(INNER), "value": np.zeros(INNER + 1)}
        for level in range(DEPTH):
            first = 2**level - 1
            for m, (g, h) in sums(level, growing, done).items():
                g, h, tree = g * unit, h * unit, growing[m]
                f, b, won = _best_cuts(g, h, allowed[m], ridge, least)
                split = won > 1e-9
                for i in np.flatnonzero(split):
                    tree["feature"][first + i], tree["bin"][first + i], tree["cut"][first + i], tree["gain"][first + i] = f[i], b[i], cuts[f[i]][b[i]], won[i]
                if level == DEPTH - 1:
                    for i in range(len(g)):
                        low = np.array([v[i, f[i], : b[i] + 1].sum() if split[i] else v[i, 0].sum() for v in (g, h)])
                        high = np.array([v[i, 0].sum() for v in (g, h)]) - low
                        tree["value"][2 * i : 2 * i + 2] = [-rate * a / (c + ridge) for a, c in (low, high)]
        for m, tree in growing.items():
            done[m].append(tree)
            yield tree


def _row(tree: dict) -> tuple:
    return tree["base"], *(tree[c].tolist() for c in ("feature", "cut", "gain", "value"))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int, seed: int, rate: float = 0.08, share: float = 0.9, ridge: float = 1.0, least: float = 1.0, bins: int = 64, keys: np.ndarray | None = None, cuts: list[np.ndarray] | None = None, unit: float | None = None, base: float | None = None) -> Iterator[tuple]:
    """The trees of logistic boosting of rows that are at hand, as (base, feature, cut, gain, value); see _grown."""
    cuts = _quantiles(x, bins) if cuts is None else cuts
    keys = _mixed(np.arange(1, len(x) + 1, dtype=np.uint64)) if keys is None else keys
    unit = _unit(weight.sum()) if unit is None else unit
    base = float(np.log(weight[y == 1].sum() / weight[y == 0].sum())) if base is None else base
    codes, margin, known = _codes(x, cuts), np.full(len(x), base), 0

    def sums(level, growing, done):
        nonlocal margin, known
        margin, known = _added(margin, codes, done[0][known:]), len(done[0])
        return {0: _sums(codes, y, weight, keys, margin, growing[0], level, share, unit, bins)}

    for tree in _grown(sums, {0: (base, seed, rounds)}, cuts, unit, rate, share, ridge, least):
        yield _row(tree)


def _below(x: np.ndarray, node: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The child of each row's node."""
    return 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])


def margins(x: np.ndarray, forest: list) -> np.ndarray:
    """Log odds of rows by one model's trees, in order (base, feature, cut, value)."""
    out = np.full(len(x), forest[0][0] if forest else 0.0)
    for _, feature, cut, value in forest:
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = _below(x, node, feature, cut)
        out += value[node - len(feature)]
    return out


def forests(rows: DataFrame, columns: list[str], key: str, folds: int, rounds: int = 300, fold_rounds: int = 200, seed: int = 42, most: int | None = None, cells: int = CELLS, bins: int = 64) -> DataFrame:
    """FOREST: trees of a model of all folds (model -1) and of one without each fold (model = the fold left out).

    rows has `key`, columns, label (0.0 or 1.0) and fold. All rows are fitted on. Tables of up to `cells` values go a
    task a model; of larger ones every task sums the gradients of its own rows for all models, level by level, and only
    these sums go to the driver. Both give the same trees. With `most`, so many rows at most are fitted on: of either
    class up to half of them by hash of the key (more of one where the other has fewer), weighted so that classes count
    as in all rows. Models without both classes have no trees.
    """
    spark = rows.sparkSession
    rows = rows.select(key, "label", "fold", *columns)
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return spark.createDataFrame([], FOREST)
    taken = {c: n if most is None else min(n, max(most // 2, most - sum(m for d, m in sizes.items() if d != c))) for c, n in sizes.items()}
    if taken != sizes:
        parts = [rows.where(F.col("label") == c).orderBy(F.xxhash64(F.lit(seed), key), key).limit(n) for c, n in taken.items()]
        rows = parts[0].unionByName(parts[1])
    rows = keep(rows.withColumn("key", F.xxhash64(F.lit(seed), key)))
    weights, n = {c: sizes[c] / m for c, m in taken.items()}, sum(taken.values())
    cuts, unit = quantiles(rows, columns, bins), _unit(sum(sizes.values()))
    counts = {(r["label"], r["fold"]): r["count"] for r in rows.groupBy("label", "fold").count().collect()}
    models = {}
    for m in range(-1, folds):
        zeros, ones = (weights[c] * sum(k for (d, f), k in counts.items() if d == c and f != m) for c in (0.0, 1.0))
        if ones and zeros:
            models[m] = float(np.log(ones / zeros)), seed + m, rounds if m < 0 else fold_rounds
    if n * len(columns) > cells:
        grown = [(t["model"], t["tree"], *_row(t)) for t in _grown_by_blocks(rows, columns, models, weights, cuts, unit, n, bins)]
        return keep(spark.createDataFrame(grown, FOREST))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        model, y = int(part["model"].iloc[0]), part["label"].to_numpy(float)
        base, own_seed, turns = models.get(model, (0.0, 0, 0))
        grown = fit(part[columns].to_numpy(float), y, np.where(y == 1, weights[1.0], weights[0.0]), turns, own_seed, bins=bins, keys=part["key"].to_numpy().view(np.uint64), cuts=cuts, unit=unit, base=base)
        return pd.DataFrame([(model, i, *tree) for i, tree in enumerate(grown)], columns=["model", "tree", "base", "feature", "cut", "gain", "value"])

    each = rows.withColumn("model", F.explode(F.array(*[F.lit(i) for i in range(-1, folds)]))).where("model <> fold")
    return keep(each.groupBy("model").applyInPandas(grow, FOREST))


BLOCK = "n long, codes binary, y binary, fold binary, keys binary"


def _blocks(rows: DataFrame, columns: list[str], cuts: list[np.ndarray], n: int) -> DataFrame:
    """BLOCK: rows as arrays of some thousands, with the bins of their columns."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            arrays = _codes(p[columns].to_numpy(float), cuts), p["label"].to_numpy(np.uint8), p["fold"].to_numpy(np.int32), p["key"].to_numpy(np.int64)
            yield pd.DataFrame([(len(p), *(a.tobytes() for a in arrays))], columns=["n", "codes", "y", "fold", "keys"])

    parts = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + n // 20_000)
    return keep(rows.repartition(parts, "key").mapInPandas(packed, BLOCK))


def _grown_by_blocks(rows: DataFrame, columns: list[str], models: dict, weights: dict, cuts: list[np.ndarray], unit: float, n: int, bins: int, rate: float = 0.08, share: float = 0.9, ridge: float = 1.0, least: float = 1.0) -> Iterator[dict]:
    """The trees of all models over blocks of rows, a job a level. The margins of all rows are held by their tasks and
    come from the blocks and the trees alone, so a lost executor costs one step; a job adds the few trees since."""
    blocks, width, held, known = _blocks(rows, columns, cuts, n), len(columns), None, 0

    def margins_by(trees: dict) -> DataFrame:
        def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                margin = []
                for size, b in zip(p["n"], p["codes"], strict=True):
                    codes = np.frombuffer(b, np.uint8).reshape(width, size)
                    margin.append(np.stack([_added(np.full(size, models[m][0]), codes, t) for m, t in trees.items()]).tobytes())
                yield p.assign(margin=margin)

        return blocks.mapInPandas(added, f"{BLOCK}, margin binary").persist()

    def sums(level, growing, done):
        nonlocal held, known
        turn = len(done[next(iter(growing))])
        if held is None or turn - known >= EVERY:
            old, known = held, turn
            held = margins_by({m: done[m] for m in growing}), list(growing)
            if old:
                old[0].unpersist()
        at, recent = held[1], {m: done[m][known:] for m in growing}

        def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(growing), 2, 2**level, width, bins))
            for p in batches:
                for size, b, y, fold, key, margin in zip(*(p[c] for c in ("n", "codes", "y", "fold", "keys", "margin")), strict=True):
                    codes, y, fold, key = np.frombuffer(b, np.uint8).reshape(width, size), np.frombuffer(y, np.uint8), np.frombuffer(fold, np.int32), np.frombuffer(key, np.uint64)
                    margin, weight = np.frombuffer(margin).reshape(-1, size), np.where(y == 1, weights[1.0], weights[0.0])
                    for i, (m, tree) in enumerate(growing.items()):
                        own = np.flatnonzero(fold != m)
                        mine = codes[:, own]
                        total[i] += _sums(mine, y[own], weight[own], key[own], _added(margin[at.index(m)][own], mine, recent[m]), tree, level, share, unit, bins)
            yield pd.DataFrame({"x": [total.tobytes()]})

        found = held[0].mapInPandas(summed, "x binary").toArrow()["x"].to_pylist()  # a row a task
        total = sum(np.frombuffer(x).reshape(len(growing), 2, 2**level, width, bins) for x in found)
        return dict(zip(growing, total, strict=True))

    yield from _grown(sums, models, cuts, unit, rate, share, ridge, least)
    if held:
        held[0].unpersist()


def scored(rows: DataFrame, columns: list[str], key: str, trees: DataFrame) -> DataFrame:
    """(key, label, fold, margin, margin_out): every row's log odds by the model of all folds, and by the one that was
    fitted without its fold. The trees, some 50 numbers each, are broadcast."""
    held: dict[int, list] = {}
    for t in trees.orderBy("model", "tree").collect():  # rounds + folds * fold_rounds rows
        held.setdefault(t.model, []).append((t.base, np.array(t.feature), np.array(t.cut), np.array(t.value)))
    sent = rows.sparkSession.sparkContext.broadcast(held)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            x, fold, out = p[columns].to_numpy(float), p["fold"].to_numpy(), np.zeros(len(p))
            for f in np.unique(fold):
                out[fold == f] = margins(x[fold == f], sent.value.get(int(f), []))
            yield p[[key, "label", "fold"]].assign(margin=margins(x, sent.value.get(-1, [])), margin_out=out)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(key, "label", "fold").schema)
    return rows.select(key, "label", "fold", *columns).mapInPandas(score, f"{kinds}, margin double, margin_out double")


def importance(trees: DataFrame, columns: list[str]) -> dict[str, float]:
    """Each feature's mean gain a split in the model of all folds, as shares of their sum."""
    splits = trees.where("model = -1").select(F.explode(F.arrays_zip("feature", "gain")).alias("s")).where("s.feature >= 0")
    mean = {columns[r["feature"]]: r["gain"] for r in splits.groupBy("s.feature").agg(F.avg("s.gain").alias("gain")).collect()}
    total = sum(mean.values()) or 1.0
    return {c: mean.get(c, 0.0) / total for c in columns}
