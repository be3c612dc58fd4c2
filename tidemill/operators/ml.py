"""Models (M01, M02, M08-M10, M12, M15-M19) with Spark ML."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.fpm import FPGrowth
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators import boosting
from tidemill.operators.iterative import numbered, placed
from tidemill.sources.storage import keep

ACTOR_FEATURES = ["event_count", "active_days", "unique_repos", "hour_entropy", "repo_entropy", "push_share", "pr_share", "issues_share", "watch_share", "fork_share", "is_bot"]


def _scaled(columns: list[str]) -> list:
    return [VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True), PCA(k=2, inputCol="features", outputCol="pca")]


def _pca(df: DataFrame) -> DataFrame:
    at = vector_to_array("pca")
    return df.withColumn("pca_x", F.round(at[0], 6)).withColumn("pca_y", F.round(at[1], 6))


def repo_clusters(health: DataFrame, k: int = 4, seed: int = 42) -> DataFrame:
    """Standardised norms of the latest day, two principal components, k-means."""
    columns = ["dev_norm", "community_norm", "attention_norm", "diversity_norm", "bot_ratio"]
    rows = keep(health.fillna(0.0, columns))
    model = Pipeline(stages=[*_scaled(columns), KMeans(k=k, seed=seed, predictionCol="cluster_id")]).fit(rows)
    return _pca(model.transform(rows)).select("metric_date", "repo_name", "rank_no", "rank_score", "health_score", "cluster_id", "pca_x", "pca_y")


#: Rules of cluster labels, first match wins (fixed values).
CLUSTER_LABELS = [("bot_driven", "avg_bot_ratio >= 0.6 and avg_hotness < 0.6"), ("core_hotspot", "avg_hotness >= 0.6 and avg_stability >= 0.5"), ("rising_star", "avg_momentum >= 0.6 and avg_hotness < 0.6"), ("steady_longtail", "avg_stability >= 0.5 and avg_hotness < 0.4"), ("collab_hub", "avg_engagement >= 0.6")]


def cluster_profile(clusters: DataFrame, ranks: DataFrame) -> DataFrame:
    """Means of each cluster's ranked repositories, a label by rule, and the three best ranked names.

    ranks has repo_name, rank_score and the norms hotness, momentum, engagement, stability and bot_ratio; repositories
    without a rank count as members with norms of 0.
    """
    parts = ["hotness", "momentum", "engagement", "stability", "bot_ratio"]
    rows = clusters.select("metric_date", "repo_name", "cluster_id").join(ranks, "repo_name", "left").fillna(0.0, [*(f"{p}_norm" for p in parts), "rank_score"])
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("rank_score"), "repo_name"))
    rows = rows.withColumn("place", place)
    best = F.sort_array(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "repo_name"))))
    out = rows.groupBy("metric_date", "cluster_id").agg(F.count("*").alias("members"), *[F.round(F.avg(f"{p}_norm"), 6).alias(f"avg_{p}") for p in parts], F.round(F.avg("rank_score"), 6).alias("avg_rank_score"), F.array_join(F.transform(best, lambda x: x["repo_name"]), ";").alias("sample_repos"))
    total = out.agg(F.sum("members").alias("total"))
    label = F.coalesce(*[F.when(F.expr(rule), name) for name, rule in CLUSTER_LABELS], F.lit("niche"))
    return out.join(F.broadcast(total)).select("metric_date", "cluster_id", label.alias("cluster_label"), "members", F.round(F.col("members") / F.col("total"), 6).alias("share_of_repos"), *[f"avg_{p}" for p in parts], "avg_rank_score", "sample_repos")


#: Weights of the archetypes on standardised centroids (fixed values).
ARCHETYPES = {
    "maintainer": {"event_count": 2.0, "unique_repos": 1.0, "push_share": 1.0, "pr_share": 1.5, "active_days": 1.0},
    "reviewer": {"pr_share": 2.0, "issues_share": 1.0, "push_share": -0.5, "hour_entropy": 0.5, "event_count": 0.5},
    "watcher": {"watch_share": 2.0, "fork_share": 1.0, "push_share": -1.0, "pr_share": -0.5, "event_count": -0.5},
    "night_bot": {"is_bot": 2.0, "hour_entropy": -1.5, "push_share": 1.0, "repo_entropy": -0.5},
    "newbie": {"event_count": -1.0, "unique_repos": -1.0, "push_share": 0.5, "repo_entropy": -1.0},
    "casual": {"event_count": -0.5, "repo_entropy": -0.5, "watch_share": 0.5, "active_days": -0.5},
}
#: Short names in descriptors.
SHORT = {"event_count": "events", "active_days": "days", "unique_repos": "repos", "hour_entropy": "hours", "repo_entropy": "spread", "push_share": "push", "pr_share": "pr", "issues_share": "issues", "watch_share": "watch", "fork_share": "fork", "is_bot": "bot"}


def _logged(features: DataFrame) -> DataFrame:
    return features.withColumn("event_count", F.log1p("event_count")).withColumn("unique_repos", F.log1p("unique_repos"))


#: Actors of a partition that a fit reads.
DEAL = 20_000


def _dealt(features: DataFrame, *salt: int) -> DataFrame:
    """All actors, dealt and sorted by a hash: the rows alone say what partition they are in, so a fit draws the same starts again."""
    key = F.xxhash64(*map(F.lit, salt), "actor_login")
    return keep(_logged(features).repartition(1 + features.count() // DEAL, key).sortWithinPartitions(key))


def _mixture(features: DataFrame, k: int, seed: int):
    """Scaler, components and a Gaussian mixture over actor features, fitted on all actors."""
    return Pipeline(stages=[*_scaled(ACTOR_FEATURES), GaussianMixture(k=k, seed=seed, predictionCol="persona_id", probabilityCol="persona_probability")]).fit(_dealt(features))


def persona_names(centroids: list[dict]) -> dict[int, str]:
    """Labels of a few centroids: the archetype of the largest cosine with their z-scores across centroids, and up to two
    features over 0.3 in size, 'heavy' from 1.2. Archetypes that come again get the cluster's number, in its order."""
    z = {}
    for f in ACTOR_FEATURES:
        x = [c[f] for c in centroids]
        mean = sum(x) / len(x)
        std = (sum((v - mean) ** 2 for v in x) / max(1, len(x) - 1)) ** 0.5
        for c in centroids:
            z.setdefault(c["persona_id"], {})[f] = (c[f] - mean) / std if std > 1e-9 else 0.0
    names, seen = {}, set()
    for i in sorted(z):
        own = sum(v * v for v in z[i].values()) ** 0.5
        fit = {a: sum(w.get(f, 0.0) * v for f, v in z[i].items()) / (own * sum(v * v for v in w.values()) ** 0.5) if own > 1e-9 else 0.0 for a, w in ARCHETYPES.items()}
        kind = max(fit, key=fit.get) if max(fit.values()) > 0 else "casual"
        top = sorted((f for f in ACTOR_FEATURES if abs(z[i][f]) > 0.3), key=lambda f: (-abs(z[i][f]), f))[:2]
        said = "_".join(f"{SHORT[f]}{'+' if z[i][f] > 0 else '-'}{'heavy' if abs(z[i][f]) >= 1.2 else 'leaning'}" for f in top) or "balanced"
        names[i] = f"{kind}__{said}" + (f"_c{i}" if kind in seen else "")
        seen.add(kind)
    return names


def _centroids(labelled: DataFrame, *more: str) -> DataFrame:
    return labelled.groupBy("persona_id", *more).agg(F.count("*").alias("members"), *[F.avg(f).alias(f) for f in ACTOR_FEATURES])


def _named(df: DataFrame, names: dict[int, str]) -> DataFrame:
    label = F.coalesce(*[F.when(F.col("persona_id") == i, n) for i, n in names.items()], F.lit("unlabeled"))
    return df.withColumn("persona_label", label)


def actor_persona(features: DataFrame, k: int = 6, seed: int = 42) -> DataFrame:
    """The mixture's cluster and its label for every actor, with its own figures and two principal components."""
    model = _mixture(features, k, seed)
    own = [c for c in features.columns if c != "metric_date"]
    rows = model.transform(_logged(features.withColumn("own", F.struct(*own))))
    names = persona_names([r.asDict() for r in _centroids(rows).collect()])  # k rows
    return _pca(_named(rows, names)).select("metric_date", "persona_id", "persona_label", *[F.col("own")[c].alias(c) for c in own], "pca_x", "pca_y")


def persona_centroids(features: DataFrame, k: int = 6, seed: int = 42) -> DataFrame:
    """Members, share and mean features of each cluster, with its label."""
    return centroids_of(actor_persona(features, k, seed))


def centroids_of(personas: DataFrame) -> DataFrame:
    """M10 of actors that have their personas (M08), so that both are of one fit."""
    at = _centroids(_logged(personas), "persona_label")
    total = at.agg(F.sum("members").alias("total"))
    return at.join(F.broadcast(total)).select("persona_id", "persona_label", "members", F.round(F.col("members") / F.col("total"), 6).alias("share"), *[F.round(f, 6).alias(f"{f}_avg") for f in ACTOR_FEATURES])


def persona_bic(features: DataFrame, ks: range = range(3, 9), seed: int = 42) -> DataFrame:
    """The Bayesian information criterion of mixtures of several sizes over all actors; the least is marked."""
    dealt = _dealt(features, 99)
    rows = Pipeline(stages=_scaled(ACTOR_FEATURES)[:2]).fit(dealt).transform(dealt).select("features")
    n, d, found = rows.count(), len(ACTOR_FEATURES), []
    for k in ks:  # six fits
        if n <= k:
            continue
        likelihood = GaussianMixture(k=k, seed=seed, maxIter=50, tol=0.01).fit(rows).summary.logLikelihood
        size = k * (d + d * (d + 1) // 2) + k - 1
        found.append((k, round(likelihood, 6), round(-2 * likelihood + size * math.log(n), 6), size, n))
    best = min((r[2], r[0]) for r in found)[1] if found else None
    return features.sparkSession.createDataFrame([(*r, int(r[0] == best)) for r in found], "k int, log_likelihood double, bic double, n_params int, n_samples long, is_selected int")


def persona_transition(whole: DataFrame, early: DataFrame, late: DataFrame, k: int = 6, seed: int = 42) -> DataFrame:
    """How personas of the whole time's model move from the early to the late half; 'absent' stands for no persona there."""
    model = _mixture(whole, k, seed)
    names = persona_names([r.asDict() for r in _centroids(model.transform(_logged(whole))).collect()])
    at = lambda half, name: _named(model.transform(_logged(half)), names).select("actor_login", F.col("persona_label").alias(name))
    both = at(early, "persona_early").join(at(late, "persona_late"), "actor_login", "full").fillna("absent", ["persona_early", "persona_late"])
    moves = both.groupBy("persona_early", "persona_late").agg(F.count("*").alias("actors"))
    total = F.sum("actors").over(Window.partitionBy("persona_early"))
    return moves.select("persona_early", "persona_late", "actors", total.alias("row_total"), F.round(F.col("actors") / total, 6).alias("transition_prob"), (F.col("persona_early") == F.col("persona_late")).cast("int").alias("is_stable"))


#: Features of the bot classifier; what tells bots by name is left out.
BOT_FEATURES = ["log_event_count", "active_days", "unique_repos", "hour_entropy", "repo_entropy", "push_share", "pr_share", "issues_share", "watch_share", "fork_share"]


def isolation_scores(rows: DataFrame, columns: list[str], trees: int = 200, most: int = 256, seed: int = 42) -> DataFrame:
    """(actor_login, iforest_score): how soon random cuts isolate a row, between 0 and 1 (higher: sooner).

    By the method each tree is grown of `most` rows, drawn for it from all rows; the driver grows them from these
    trees * most rows at most and broadcasts them. Every row is scored in tasks.
    """
    rows = keep(rows.select("actor_login", *columns))
    random, n = np.random.default_rng(seed), rows.count()
    drawn = [random.choice(n, min(most, n), replace=False) for _ in range(trees)] if n else []
    ids = np.unique(np.concatenate(drawn)) if n else np.empty(0, int)
    wanted = rows.sparkSession.createDataFrame([(int(i),) for i in ids], "id long")
    named = numbered(rows.select(F.col("actor_login").alias("node"))).join(F.broadcast(wanted), "id").withColumnRenamed("node", "actor_login")
    sample = rows.join(F.broadcast(named), "actor_login").select("id", *columns).toPandas().sort_values("id")[columns].to_numpy(float)
    deepest = max(1, math.ceil(math.log2(max(2, min(most, n)))))

    def expected(n: int) -> float:
        return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grow(x: np.ndarray, depth: int):
        spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else []
        if depth >= deepest or not len(spread):
            return depth + expected(len(x))
        f = int(random.choice(spread))
        at = random.uniform(x[:, f].min(), x[:, f].max())
        low = x[:, f] <= at
        return f, at, grow(x[low], depth + 1), grow(x[~low], depth + 1)

    forest = [grow(sample[np.searchsorted(ids, own)], 0) for own in drawn]
    held = rows.sparkSession.sparkContext.broadcast(forest)
    scale = expected(min(most, n)) or 1.0

    def score(batches):
        for p in batches:
            x, depth = p[columns].to_numpy(float), np.zeros(len(p))

            def walk(node, at):
                if not isinstance(node, tuple):
                    depth[at] += node
                elif len(at):
                    f, cut, a, b = node
                    low = x[at, f] <= cut
                    walk(a, at[low])
                    walk(b, at[~low])

            for tree in held.value:
                walk(tree, np.arange(len(p)))
            yield p[["actor_login"]].assign(iforest_score=np.round(2 ** (-depth / (max(1, len(held.value)) * scale)), 6))

    return rows.mapInPandas(score, "actor_login string, iforest_score double")


def _bot_rows(features: DataFrame, personas: DataFrame, folds: int, seed: int) -> tuple[DataFrame, list[str], list[str], dict[float, int]]:
    """Rows with features, label and fold; the feature columns, their shown names, and the sizes of the classes."""
    rows = features.join(personas.select("actor_login", "persona_label"), "actor_login", "left").fillna("unlabeled", ["persona_label"])
    rows = keep(rows.withColumn("log_event_count", F.log1p(F.col("event_count").cast("double"))).fillna(0.0, BOT_FEATURES))
    labels = sorted(r[0] for r in rows.select("persona_label").distinct().collect())  # at most one a cluster
    for i, name in enumerate(labels):
        rows = rows.withColumn(f"persona_{i}", (F.col("persona_label") == name).cast("double"))
    columns = [*BOT_FEATURES, *(f"persona_{i}" for i in range(len(labels)))]
    rows = rows.withColumn("label", F.col("is_bot").cast("double"))
    fold = F.row_number().over(Window.partitionBy("label", F.pmod(F.xxhash64("actor_login"), F.lit(64))).orderBy(F.xxhash64(F.lit(seed), "actor_login")))
    rows = rows.withColumn("fold", F.pmod(fold + F.pmod(F.xxhash64("actor_login"), F.lit(64)), F.lit(folds)).cast("int"))
    return rows, columns, [*BOT_FEATURES, *(f"persona_{n}" for n in labels)], {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}


def _bot_trees(rows: DataFrame, columns: list[str], sizes: dict[float, int], folds: int, seed: int, trees: DataFrame | None = None) -> DataFrame | None:
    """The boosted trees, unless given, 300 of the model of all rows and 200 of each fold's; None without two rows of both classes a fold."""
    if len(sizes) < 2 or min(sizes.values()) < 2 * folds:
        return None
    return boosting.forests(rows, columns, "actor_login", folds, seed=seed) if trees is None else trees


def bot_trees(features: DataFrame, personas: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """The trees that the three tables of M16 read; none without two rows of both classes a fold."""
    rows, columns, _, sizes = _bot_rows(features, personas, folds, seed)
    trees = _bot_trees(rows, columns, sizes, folds, seed)
    return features.sparkSession.createDataFrame([], boosting.FOREST) if trees is None else trees


def bot_scores(features: DataFrame, personas: DataFrame, folds: int = 5, seed: int = 42, trees: DataFrame | None = None) -> DataFrame:
    """All actors by the risk of being a bot: 0.7 of a probability by boosted trees and 0.3 of an isolation forest's
    score scaled to 0..1. Without two rows of both classes for each fold there are no trees and the probability is 0."""
    rows, columns, _, sizes = _bot_rows(features, personas, folds, seed)
    trees, forest = _bot_trees(rows, columns, sizes, folds, seed, trees), keep(isolation_scores(rows, columns))
    if trees is None:
        probs = rows.select("actor_login", F.lit(0.0).alias("prob"))
    else:
        probs = boosting.scored(rows, columns, "actor_login", trees).select("actor_login", F.round(1 / (1 + F.exp(-F.col("margin"))), 6).alias("prob"))
    ends = forest.agg(F.min("iforest_score").alias("low"), F.max("iforest_score").alias("high"))
    forest = forest.join(F.broadcast(ends)).select("actor_login", F.round(F.when(F.col("high") > F.col("low"), (F.col("iforest_score") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0), 6).alias("iforest_score"))
    out = rows.select("actor_login", "is_bot", "persona_label").join(probs, "actor_login").join(forest, "actor_login")
    out = out.select("actor_login", F.col("prob").alias("gbt_prob_bot"), "iforest_score", F.round(0.7 * F.col("prob") + 0.3 * F.col("iforest_score"), 6).alias("combined_score"), F.col("is_bot").cast("int").alias("is_bot_truth"), "persona_label")
    return placed(out, "rank_no", F.desc("combined_score"), F.asc("actor_login")).withColumn("rank_no", (F.col("rank_no") + 1).cast("int"))


def bot_importance(features: DataFrame, personas: DataFrame, folds: int = 5, seed: int = 42, trees: DataFrame | None = None) -> DataFrame:
    """The 25 features of the largest mean gain a split, as shares of their sum."""
    rows, columns, shown, sizes = _bot_rows(features, personas, folds, seed)
    trees, found = _bot_trees(rows, columns, sizes, folds, seed, trees), []
    if trees is not None:
        weights = boosting.importance(trees, columns)
        found = sorted(((name, weights[c]) for name, c in zip(shown, columns, strict=True)), key=lambda x: (-x[1], x[0]))[:25]
    return features.sparkSession.createDataFrame([(f, round(x, 6), i + 1) for i, (f, x) in enumerate(found)], "feature string, importance double, rank_no int")


def bot_measures(features: DataFrame, personas: DataFrame, folds: int = 5, seed: int = 42, trees: DataFrame | None = None) -> DataFrame:
    """Numbers of rows and bots, and means over the folds of ROC-AUC and average precision; every row is scored by
    the model that was fitted without its fold."""
    rows, columns, _, sizes = _bot_rows(features, personas, folds, seed)
    trees, meta = _bot_trees(rows, columns, sizes, folds, seed, trees), [("rows", float(sum(sizes.values()))), ("bots", float(sizes.get(1.0, 0)))]
    if trees is not None:
        tried = keep(boosting.scored(rows, columns, "actor_login", trees))
        for name, metric in {"cv_roc_auc": "areaUnderROC", "cv_average_precision": "areaUnderPR"}.items():
            found = [BinaryClassificationEvaluator(metricName=metric, rawPredictionCol="margin_out").evaluate(tried.where(F.col("fold") == i)) for i in range(folds)]
            meta.append((name, round(sum(found) / folds, 6)))
    return features.sparkSession.createDataFrame(meta, "metric string, value double")


ARCHETYPE_FEATURES = ["watch_share", "pr_push_ratio", "bot_ratio", "active_days", "contributor_count", "events_per_active_day"]


def repo_archetypes(rules: DataFrame, k: int = 6, seed: int = 42, least: int = 20) -> DataFrame:
    """The archetype by rule beside a mixture's cluster and its probability, with two principal components.

    rules: repo_name, archetype_rule, rank_score, total_events and the features, one row a repository of the scope.
    The mixture has a cluster for every ten repositories, k at most and 2 at least; with fewer than `least` rows
    there is none, and cluster, probability and components are null.
    """
    n = rules.count()
    kept = ["repo_name", "archetype_rule", "rank_score", "total_events", *ARCHETYPE_FEATURES]
    if n < least:
        return rules.select(*kept, F.lit(None).cast("int").alias("archetype_gmm_id"), *[F.lit(None).cast("double").alias(c) for c in ("archetype_confidence", "pca_x", "pca_y")])
    rows = rules.select(*kept).fillna(0.0, [*ARCHETYPE_FEATURES, "rank_score"])
    mixture = GaussianMixture(k=min(k, max(2, n // 10)), seed=seed, predictionCol="archetype_gmm_id", probabilityCol="gmm_probability")
    out = Pipeline(stages=[*_scaled(ARCHETYPE_FEATURES), mixture]).fit(rows).transform(rows)
    return _pca(out.withColumn("archetype_confidence", F.round(F.array_max(vector_to_array("gmm_probability")), 6))).select(*kept, "archetype_gmm_id", "archetype_confidence", "pca_x", "pca_y")


def archetype_centroids(archetypes: DataFrame, samples: int = 3) -> DataFrame:
    """Members and means of each rule and cluster, the share of the cluster that the rule covers, and the best ranked names."""
    keys = ["archetype_rule", "archetype_gmm_id"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("rank_score"), "repo_name"))
    best = F.sort_array(F.collect_list(F.when(F.col("place") <= samples, F.struct("place", "repo_name"))))
    means = [F.round(F.avg(c), 6).alias(f"avg_{c}") for c in ("watch_share", "pr_push_ratio", "bot_ratio", "active_days", "rank_score")]
    out = archetypes.withColumn("place", place).groupBy(*keys).agg(F.count("*").alias("members"), *means, F.array_join(F.transform(best, lambda x: x["repo_name"]), " | ").alias("sample_repos"))
    return out.withColumn("rule_gmm_overlap", F.round(F.col("members") / F.sum("members").over(Window.partitionBy("archetype_gmm_id")), 6))


def association_rules(baskets: DataFrame, least_confidence: float = 0.3) -> DataFrame:
    """FP-growth over (actor_login, repo_name); single consequents; the top 500 rules and their Pareto frontier."""
    items = baskets.groupBy("actor_login").agg(F.array_sort(F.collect_set("repo_name")).alias("items")).where("size(items) between 2 and 30")
    items = keep(items)
    n = max(items.count(), 1)
    model = FPGrowth(itemsCol="items", minSupport=min(0.02, max(0.002, 6 / n)), minConfidence=least_confidence).fit(items)
    rules = model.associationRules.where("size(consequent) = 1").select(F.array_join(F.array_sort("antecedent"), " & ").alias("antecedent"), F.col("consequent")[0].alias("consequent"), F.size("antecedent").alias("antecedent_size"), *[F.round(c, 6).alias(c) for c in ("support", "confidence", "lift")])
    top = keep(rules.orderBy(F.desc("lift"), F.desc("confidence"), "antecedent", "consequent").limit(500))
    a, b = top.alias("a"), top.select("support", "confidence", "lift").distinct().alias("b")  # at most 500 rows
    better = " and ".join(f"b.{c} >= a.{c}" for c in ("support", "confidence", "lift")) + " and (" + " or ".join(f"b.{c} > a.{c}" for c in ("support", "confidence", "lift")) + ")"
    beaten = a.join(F.broadcast(b), F.expr(better), "left_semi").select("antecedent", "consequent", F.lit(0).alias("beaten"))
    return top.join(beaten, ["antecedent", "consequent"], "left").withColumn("is_frontier", F.when(F.col("beaten").isNull(), 1).otherwise(0)).drop("beaten")


def churn_risk(features: DataFrame) -> DataFrame:
    """Logistic regression of churn on standardised features (actors without a slope have 0); fewer than 50 rows
    or one class give no model."""
    features = features.fillna(0.0, ["decay_slope"])
    columns = ["days_since_last", "decay_slope", "log_events", "log_active_days"]
    classes = features.groupBy("churned").count().collect()  # two rows at most
    if len(classes) < 2 or sum(r["count"] for r in classes) < 50:
        return features.select("actor_login", "days_since_last", "decay_slope", F.lit(0.0).alias("churn_prob"), F.lit("unknown").alias("risk_tier"))
    model = Pipeline(stages=[*_scaled(columns)[:2], LogisticRegression(labelCol="churned", regParam=1e-3)]).fit(features)
    p = F.round(vector_to_array("probability")[1], 6)
    return model.transform(features).select("actor_login", "days_since_last", "decay_slope", p.alias("churn_prob"), F.when(p <= 0.3, "healthy").when(p <= 0.6, "watch").otherwise("risk").alias("risk_tier"))


def als_factors(counts: DataFrame, rank: int = 12, seed: int = 42) -> DataFrame:
    """Implicit ALS factors of scoped repositories; counts (written, as it is read many times) has actor_login, repo_name, n."""
    index = StringIndexer(inputCols=["actor_login", "repo_name"], outputCols=["user", "item"]).fit(counts)
    rows = index.transform(counts)
    model = ALS(rank=rank, maxIter=10, regParam=0.1, alpha=1.0, implicitPrefs=True, seed=seed, userCol="user", itemCol="item", ratingCol="n").fit(rows)
    names = rows.select("repo_name", F.col("item").cast("int").alias("id")).distinct()
    return model.itemFactors.join(names, "id").select("repo_name", F.lit(rank).alias("rank_dim"), F.col("features").alias("factor_values"))


def als_neighbours(counts: DataFrame, rank: int = 12, top: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The factors, and each repository's nearest by cosine."""
    counts = keep(counts)
    factors = keep(als_factors(counts, rank, seed))
    return factors, nearest(factors, counts, top)


def nearest(factors: DataFrame, counts: DataFrame, top: int = 5) -> DataFrame:
    """Each repository's nearest by cosine of factors, and whether shared actors would miss it."""
    pos = factors.select("repo_name", F.posexplode("factor_values").alias("k", "x"), F.sqrt(F.aggregate(F.transform("factor_values", lambda v: v.cast("double") * v), F.lit(0.0), lambda s, v: s + v)).alias("norm"))
    a, b = pos.select("k", F.col("repo_name").alias("src_repo"), (F.col("x") / F.col("norm")).alias("p")), pos.select("k", F.col("repo_name").alias("dst_repo"), (F.col("x") / F.col("norm")).alias("q"))
    near = a.join(b, "k").where("src_repo <> dst_repo").groupBy("src_repo", "dst_repo").agg(F.round(F.sum(F.col("p") * F.col("q")), 6).alias("cosine"))
    near = near.withColumn("rank_no", F.row_number().over(Window.partitionBy("src_repo").orderBy(F.desc("cosine"), "dst_repo"))).where(F.col("rank_no") <= top)
    pairs = counts.select("actor_login", "repo_name").distinct()
    shared = pairs.join(pairs.withColumnRenamed("repo_name", "other"), "actor_login").where("repo_name <> other").groupBy(F.col("repo_name").alias("src_repo"), F.col("other").alias("dst_repo")).agg(F.count("*").alias("shared"))
    near = near.join(shared, ["src_repo", "dst_repo"], "left").withColumn("is_jaccard_miss", (F.coalesce("shared", F.lit(0)) < 2).cast("int")).drop("shared")
    return near
