import math
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import ml


def actors(spark, groups, each=30, seed=1):
    """Actors in well separated groups; the group shows in the login's first letter."""
    r = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = np.array([20.0 + 400 * g, 5 + 9 * g, 4 + 30 * g, 1 + g, 1 + g, 0.2 * g, 0.6 - 0.2 * g, 0.1, 0.2 * g, 0.1])
        for i in range(each):
            x = np.abs(centre + r.normal(0, [3, 0.5, 1, 0.1, 0.1, 0.02, 0.02, 0.02, 0.02, 0.02]))
            rows.append((f"{'abcdef'[g]}{i:02}", *map(float, x), float(g == groups - 1 and i % 2)))
    names = [c for c in ml.ACTOR_FEATURES if c != "is_bot"]
    return spark.createDataFrame(rows, ["actor_login", *names, "is_bot"]).withColumn("metric_date", F.lit("2024-01-01").cast("date"))


def test_repo_clusters_find_separated_groups(spark):
    r = np.random.default_rng(2)
    rows = [(f"{g}{i}", i, 0.5, 0.5, *map(float, np.array(c) + r.normal(0, 0.01, 5))) for g, c in zip("abcd", [(0, 0, 0, 0, 0), (1, 0, 0, 1, 0), (0, 1, 1, 0, 0), (1, 1, 0, 0, 1)], strict=True) for i in range(20)]
    health = spark.createDataFrame(rows, ["repo_name", "rank_no", "rank_score", "health_score", "dev_norm", "community_norm", "attention_norm", "diversity_norm", "bot_ratio"]).withColumn("metric_date", F.lit("2024-01-01").cast("date"))
    got = ml.repo_clusters(health).collect()
    by = {}
    for x in got:
        by.setdefault(x.repo_name[0], set()).add(x.cluster_id)
    assert all(len(s) == 1 for s in by.values()) and len(set.union(*by.values())) == 4
    x = np.array([row[4:] for row in rows])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    parts = np.linalg.svd(z, full_matrices=False)[2][:2]
    own = {row[0]: p for row, p in zip(rows, z @ parts.T, strict=True)}
    for i, c in enumerate(("pca_x", "pca_y")):
        mine, theirs = np.array([[g[c], own[g.repo_name][i]] for g in got]).T
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-4 or abs(np.corrcoef(mine, theirs)[0, 1]) > 0.9999


def test_cluster_profile_by_hand(spark):
    clusters = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0), ("d", 0), ("e", 1)], "repo_name string, cluster_id int").withColumn("metric_date", F.lit("2024-01-01").cast("date"))
    columns = ["repo_name", "rank_score", *(f"{p}_norm" for p in ("hotness", "momentum", "engagement", "stability", "bot_ratio"))]
    ranks = spark.createDataFrame([("a", 0.9, 0.8, 0.1, 0.2, 0.8, 0.0), ("b", 0.9, 0.8, 0.1, 0.2, 0.8, 0.0), ("c", 0.1, 0.8, 0.2, 0.2, 0.8, 0.0), ("e", 0.2, 0.1, 0.7, 0.0, 0.0, 0.0)], columns)
    got = {r.cluster_id: r for r in ml.cluster_profile(clusters, ranks).collect()}
    assert (got[0].cluster_label, got[0].members, got[0].share_of_repos, got[0].avg_hotness, got[0].avg_rank_score, got[0].sample_repos) == ("core_hotspot", 4, 0.8, 0.6, 0.475, "a;b;c")
    assert (got[1].cluster_label, got[1].avg_momentum, got[1].sample_repos) == ("rising_star", 0.7, "e")


def test_personas_are_the_groups_and_centroids_their_means(spark):
    features = actors(spark, 2)
    got = ml.actor_persona(features, k=2).collect()
    by = {}
    for r in got:
        by.setdefault(r.actor_login[0], set()).add((r.persona_id, r.persona_label))
    assert len(got) == 60 and all(len(s) == 1 for s in by.values()) and len(set.union(*by.values())) == 2
    heads = {r.persona_id: r for r in ml.persona_centroids(features, k=2).collect()}
    for (p, label), in (tuple(s) for s in by.values()):
        own = [r for r in got if r.persona_id == p]
        assert heads[p].members == len(own) == 30 and heads[p].share == 0.5 and heads[p].persona_label == label
        assert heads[p].active_days_avg == pytest.approx(np.mean([r.active_days for r in own]), abs=1e-5)
        assert heads[p].event_count_avg == pytest.approx(np.mean([math.log1p(r.event_count) for r in own]), abs=1e-5)


def test_criterion_of_mixtures(spark):
    """The formula by hand, the likelihood in numpy for what one fit holds, and one choice: the least."""
    got = ml.persona_bic(actors(spark, 3, each=60), ks=range(2, 5)).collect()
    d = len(ml.ACTOR_FEATURES)
    for r in got:
        assert r.n_params == (r.k - 1) + r.k * d + r.k * d * (d + 1) // 2 and r.n_samples == 180
        assert r.bic == pytest.approx(-2 * r.log_likelihood + r.n_params * math.log(180), abs=1e-3)
    assert [r.k for r in got if r.is_selected] == [min(got, key=lambda r: (r.bic, r.k)).k]
    assert got[1].log_likelihood > got[0].log_likelihood  # three groups are there
    assert ml.persona_bic(actors(spark, 1, each=2)).collect() == []


def test_transitions_by_counting(spark):
    whole = actors(spark, 2)
    late = whole.withColumn("n", F.substring("actor_login", 2, 2).cast("int"))
    early = late.where("n < 20").drop("n")  # ten of each group come late
    swapped = late.where("n >= 10 and n < 15 or n >= 20").withColumn("actor_login", F.when(F.col("n") < 15, F.translate("actor_login", "ab", "ba")).otherwise(F.col("actor_login"))).drop("n")
    names = {r.actor_login[0]: r.persona_label for r in ml.actor_persona(whole, k=2).collect()}
    got = {(r.persona_early, r.persona_late): (r.actors, r.row_total, r.transition_prob, r.is_stable) for r in ml.persona_transition(whole, early, swapped, k=2).collect()}
    a, b = names["a"], names["b"]
    assert got[a, b] == (5, 20, 0.25, 0) and got[b, a] == (5, 20, 0.25, 0)
    assert got[a, "absent"] == got[b, "absent"] == (15, 20, 0.75, 0)
    assert got["absent", a] == got["absent", b] == (10, 20, 0.5, 0) and (a, a) not in got


def test_rules_against_counted_baskets(spark):
    r = np.random.default_rng(4)
    baskets = [set(r.choice(list("abcdefgh"), r.integers(1, 5), replace=False)) | ({"x", "y"} if i % 3 == 0 else set()) for i in range(120)]
    baskets.append({f"only{i}" for i in range(40)})  # more than 30: left out
    rows = [(f"u{i}", x) for i, own in enumerate(baskets) for x in own]
    got = {(x.antecedent, x.consequent): (x.support, x.confidence, x.lift, x.is_frontier) for x in ml.association_rules(spark.createDataFrame(rows + rows[:9], "actor_login string, repo_name string")).collect()}
    used = [b for b in baskets if 2 <= len(b) <= 30]
    n, count = len(used), Counter(frozenset(c) for b in used for size in range(1, len(b) + 1) for c in combinations(sorted(b), size))
    least, want = min(0.02, max(0.002, 6 / n)), {}
    for items, c in count.items():
        if len(items) > 1 and c / n >= least:
            for y in items:
                rest = items - {y}
                if c / count[rest] >= 0.3:
                    want[" & ".join(sorted(rest)), y] = tuple(round(v, 6) for v in (c / n, c / count[rest], c / count[rest] / (count[frozenset([y])] / n)))
    best = sorted(want, key=lambda k: (-want[k][2], -want[k][1], k))[:500]
    assert {k: v[:3] for k, v in got.items()} == {k: want[k] for k in best}
    beats = lambda p, q: all(a >= b for a, b in zip(p, q, strict=True)) and p != q
    assert {k for k, v in got.items() if v[3]} == {k for k in best if not any(beats(want[m], want[k]) for m in best)}
    assert got["x", "y"][1] == 1.0
    assert ml.association_rules(spark.createDataFrame([], "actor_login string, repo_name string")).isEmpty()


def test_churn_of_separable_actors(spark):
    rows = [(f"u{i}", float(20 if i % 2 else 1), None if i % 7 == 0 else (-0.5 if i % 2 else 0.4), 2.0, 1.0, int(i % 2)) for i in range(80)]
    df = spark.createDataFrame(rows, "actor_login string, days_since_last double, decay_slope double, log_events double, log_active_days double, churned int")
    got = ml.churn_risk(df).collect()
    assert all((r.churn_prob > 0.6) == (r.days_since_last == 20) and r.risk_tier == ("risk" if r.days_since_last == 20 else "healthy") for r in got) and len(got) == 80
    assert {r.risk_tier for r in ml.churn_risk(df.limit(49)).collect()} == {r.risk_tier for r in ml.churn_risk(df.where("churned = 1")).collect()} == {"unknown"}


def test_neighbours_by_brute_force_cosine(spark):
    r = np.random.default_rng(6)
    rows = sorted({(f"u{g}{i}", f"{g}{j}") for g in "pq" for i in range(15) for j in r.choice(8, 4, replace=False)})
    counts = spark.createDataFrame([(u, x, 1 + k % 3) for k, (u, x) in enumerate(rows)], "actor_login string, repo_name string, n int")
    factors, near = ml.als_neighbours(counts, rank=4, top=3)
    v = {x.repo_name: np.array(x.factor_values, float) for x in factors.collect()}
    assert len(v) == 16 and all(len(x) == 4 for x in v.values())
    cosine = lambda a, b: float(v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b]))
    users = {a: {u for u, x in rows if x == a} for a in v}
    got = near.collect()
    for a in v:
        own = sorted((x for x in got if x.src_repo == a), key=lambda x: x.rank_no)
        best = sorted((round(-cosine(a, b), 5), b) for b in v if b != a)[:3]
        assert [x.rank_no for x in own] == [1, 2, 3] and [round(-x.cosine, 5) for x in own] == pytest.approx([c for c, _ in best], abs=2e-5)
        assert all(x.is_jaccard_miss == int(len(users[a] & users[x.dst_repo]) < 2) for x in own)


def test_mixture_is_fitted_on_every_actor(spark, monkeypatch):
    """Of more than 40,000 actors those of the smallest hashes were fitted on."""
    fitted = []

    class Seen(ml.GaussianMixture):
        def fit(self, rows, params=None):
            fitted.append(rows.count())
            return super().fit(rows, params)

    monkeypatch.setattr(ml, "GaussianMixture", Seen)
    features = actors(spark, 2, each=20_100)
    heads = ml.persona_centroids(features, k=2).collect()
    assert fitted == [40_200] and sum(r.members for r in heads) == 40_200


def test_criterion_is_over_every_actor(spark):
    """Of more than 5,000 actors those of the smallest hashes were counted."""
    assert {r.n_samples for r in ml.persona_bic(actors(spark, 3, each=1_800), ks=range(2, 4)).collect()} == {5_400}


def test_every_actor_has_a_score_and_a_place(spark):
    """Of more than 5,000 actors those of the highest scores were listed."""
    features = actors(spark, 3, each=1_800)
    personas = features.select("actor_login", F.substring("actor_login", 1, 1).alias("persona_label"))
    got = ml.bot_scores(features, personas).collect()
    by_rank = sorted(got, key=lambda r: r.rank_no)
    assert len({r.actor_login for r in got}) == 5_400 and [r.rank_no for r in by_rank] == list(range(1, 5_401))
    assert by_rank == sorted(got, key=lambda r: (-r.combined_score, r.actor_login))


def test_isolation_does_not_rest_on_partitions(spark):
    rows = spark.createDataFrame([(f"u{i}", float(i % 10), float(100 * (i == 7))) for i in range(200)], "actor_login string, a double, b double")
    one, two = (sorted(ml.isolation_scores(rows.repartition(n), ["a", "b"], trees=20, most=256).collect()) for n in (1, 5))
    assert one == two and len(one) == 200 and max(one, key=lambda r: r.iforest_score).actor_login == "u7"
    assert ml.isolation_scores(rows.limit(0), ["a", "b"]).isEmpty()
