"""All registered queries of the analytics operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.operators import bootstrap, community, daily, ecosystem, features, graphs, influence, iterative, people, ranking, realtime_sql, sketches
from tidemill.plans import model_reads, serving, views
from tidemill.plans.catalog import DUCK, Catalog, Written
from tidemill.sources import adapters
from tidemill.sources.storage import exists, keep, kept_path
from tidemill.streaming import realtime

CATALOG = Catalog()
for module in (adapters, daily, ranking, ecosystem, features, people, graphs, realtime_sql, serving, views):
    module.register(CATALOG)


def _frame(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return CATALOG.frame(spark, sf_dir, name)


_STORED: dict[tuple, str] = {}


def stored(plan: Callable) -> Callable:
    """A plan whose table is written once for each input in an application; all reads over it read that table."""

    @wraps(plan)
    def read(spark, sf_dir):
        where = tuple(sorted(sf_dir.paths.items())) if isinstance(sf_dir, Written) else sf_dir
        key = (spark.sparkContext.applicationId, plan.__name__, where)
        if key not in _STORED or not exists(spark, _STORED[key]):
            path = kept_path(spark)
            plan(spark, sf_dir).write.parquet(path)
            _STORED[key] = path
        return spark.read.parquet(_STORED[key])

    return read


def _similar(spark, sf_dir):
    return iterative.both_ways(_frame("g03_repo_similarity_edges", spark, sf_dir), "src_repo", "dst_repo", "jaccard")


def _collab(spark, sf_dir):
    return iterative.both_ways(_frame("g06_actor_collab_edge", spark, sf_dir), "actor_a", "actor_b", "weight")


@stored
def g04_repo_community(spark, sf_dir):
    """Communities of the scope's repositories, those without similar ones included."""
    labels = community.label_propagation(_similar(spark, sf_dir))
    nodes = _frame("g02_scope_network", spark, sf_dir).select(F.col("repo_name").alias("node"))
    return iterative.communities(labels, nodes).withColumnRenamed("node", "repo_name")


def _labels(spark, sf_dir):
    return g04_repo_community(spark, sf_dir).select("repo_name", "community_id")


def g05_repo_community_profile(spark, sf_dir):
    kinds = {"watch": "WatchEvent", "fork": "ForkEvent", "issues": "IssuesEvent", "pr": "PullRequestEvent"}
    events = _frame("ev_graph", spark, sf_dir).select("repo_name", F.col("event_type").alias("kind"))
    labels = _labels(spark, sf_dir)
    return iterative.community_profile(labels, events.join(F.broadcast(labels.select("repo_name")), "repo_name"), kinds=kinds)  # at most the scope's names


@stored
def g09_repo_layer_community(spark, sf_dir):
    """Label propagation of all layers in one run: a node is a repository within a layer."""
    at = _frame("g09_repo_layer_edge", spark, sf_dir)
    edges = at.select(*[F.concat_ws("|", "layer", x).alias(x) for x in ("src_repo", "dst_repo")], "jaccard")
    labels = community.label_propagation(iterative.both_ways(edges, "src_repo", "dst_repo", "jaccard"), rounds=10)
    part = lambda c, i: F.split_part(F.col(c), F.lit("|"), F.lit(i))
    return labels.select(part("node", 1).alias("layer"), part("node", 2).alias("repo_name"), part("community_id", 2).alias("community_id"))


def g15_modularity(spark, sf_dir):
    edges = _similar(spark, sf_dir)
    return iterative.modularity(edges, _labels(spark, sf_dir).withColumnRenamed("repo_name", "node"))


def g15_bridge_score(spark, sf_dir):
    edges = _similar(spark, sf_dir)
    return iterative.bridges(edges, _labels(spark, sf_dir).withColumnRenamed("repo_name", "node")).withColumnRenamed("node", "repo_name")


def g07_actor_pagerank(spark, sf_dir):
    return iterative.pagerank(_collab(spark, sf_dir)).withColumnRenamed("node", "actor_login")


@stored
def g07_actor_graph_metrics(spark, sf_dir):
    """PageRank, betweenness, weighted degree and Louvain communities."""
    edges = keep(_collab(spark, sf_dir))
    return iterative.pagerank(edges).join(iterative.betweenness(edges), "node").join(community.louvain(edges), "node").withColumnRenamed("node", "actor_login")


@stored
def g08_actor_coreness(spark, sf_dir):
    edges = iterative.both_ways(_frame("actor_corepo_edge", spark, sf_dir), "actor_a", "actor_b", "shared_repos")
    known = _frame("m07_actor_features", spark, sf_dir).select("actor_login", "is_bot")
    return iterative.cohorts(iterative.coreness(edges)).withColumnRenamed("node", "actor_login").join(known, "actor_login", "left").fillna(0, ["is_bot"])


def g08_repo_coreness(spark, sf_dir):
    edges = iterative.both_ways(_frame("repo_jaccard_edge", spark, sf_dir), "src_repo", "dst_repo", "jaccard")
    return iterative.cohorts(iterative.coreness(edges)).withColumnRenamed("node", "repo_name")


@stored
def g11_repo_community_weekly(spark, sf_dir):
    """Communities of each of the last four weeks in one run: a node is a repository within a week."""
    at = _frame("week_pair", spark, sf_dir).where("jaccard >= 0.05").select(*[F.concat_ws("|", "week_idx", x).alias(x) for x in ("a", "b")], F.round("jaccard", 6).alias("jaccard"))
    labels = community.label_propagation(iterative.both_ways(at, "a", "b", "jaccard"))
    nodes = _frame("week_repo", spark, sf_dir).select(F.concat_ws("|", "week_idx", "repo_name").alias("node")).distinct()
    part = lambda c, i: F.split_part(F.col(c), F.lit("|"), F.lit(i))
    return iterative.communities(labels, nodes).select(part("node", 1).cast("int").alias("week_idx"), part("node", 2).alias("repo_name"), part("community_id", 2).alias("community_id"), "community_size")


@stored
def g12_community_lineage(spark, sf_dir):
    return iterative.lineage(g11_repo_community_weekly(spark, sf_dir))


def _cascades(spark, sf_dir, most: int = 1500):
    edges = _frame("g06_actor_collab_edge", spark, sf_dir)
    ends = edges.select(F.explode(F.array("actor_a", "actor_b")).alias("node"), "weight").groupBy("node").agg(F.sum("weight").alias("w")).orderBy(F.desc("w"), "node").limit(most).select("node")
    both = iterative.both_ways(edges, "actor_a", "actor_b", "weight").join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")
    both = keep(both)
    return influence.influence(both, iterative.pagerank(both).join(iterative.coreness(both).select("node", "coreness"), "node"))


@stored
def g14_actor_ic_reach(spark, sf_dir):
    return _cascades(spark, sf_dir)[0]


@stored
def g14_seed_greedy(spark, sf_dir):
    return _cascades(spark, sf_dir)[1]


@stored
def g14_seed_reverse(spark, sf_dir):
    """Seeds of the whole collaboration graph, whatever its size."""
    return influence.seeds_of_any_graph(_collab(spark, sf_dir))


def v17_coreness_summary(spark, sf_dir):
    """Actors and bots by coreness, and whether half of all actors have as much at most."""
    cores = g08_actor_coreness(spark, sf_dir).groupBy("coreness").agg(F.count("*").alias("actors"), F.sum("is_bot").cast("long").alias("bots"))
    up = Window.orderBy("coreness").rowsBetween(Window.unboundedPreceding, 0)  # one row a value of coreness
    total = F.sum("actors").over(Window.partitionBy(F.lit(1)))
    return cores.withColumn("actors_up_to", F.sum("actors").over(up)).withColumn("share_up_to", F.round(F.col("actors_up_to") / total, 6)).withColumn("is_median", (F.col("actors_up_to") * 2 >= total) & ((F.col("actors_up_to") - F.col("actors")) * 2 < total)).withColumn("bot_share", F.round(F.col("bots") / F.col("actors"), 6))


def v19_lineage_counts(spark, sf_dir):
    at = g12_community_lineage(spark, sf_dir).groupBy("week_idx")
    kinds = ("birth", "continue", "merge_or_split", "reform", "death")
    out = at.agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in kinds])
    alive = sum((F.col(k) for k in kinds[1:4]), F.col("birth"))
    return out.select("week_idx", *kinds, alive.alias("communities"), F.round((F.col("continue") + F.col("merge_or_split")) / F.greatest(alive, F.lit(1)), 6).alias("survival_share"))


def v20_influence_lift(spark, sf_dir):
    reach = g14_actor_ic_reach(spark, sf_dir)
    last = reach.groupBy().pivot("strategy", ["greedy", "degree", "pagerank", "coreness", "random"]).agg(F.max_by("expected_reach", "k"))
    return last.select("*", *[F.round(F.col("greedy") / F.greatest(F.col(s), F.lit(1e-9)) - 1, 6).alias(f"lift_over_{s}") for s in ("degree", "random")])


def v22_community_flows(spark, sf_dir):
    """Repositories that go from one community of at least two to another from week to week."""
    at = keep(g11_repo_community_weekly(spark, sf_dir).where("community_size >= 2"))
    later = at.select((F.col("week_idx") - 1).alias("week_idx"), "repo_name", F.col("community_id").alias("to_community"))
    return at.join(later, ["week_idx", "repo_name"]).groupBy("week_idx", F.col("community_id").alias("from_community"), "to_community").agg(F.count("*").alias("repos"))


@stored
def m01_repo_clusters(spark, sf_dir):
    from tidemill.operators import ml

    return ml.repo_clusters(_frame("b23_repo_health_latest", spark, sf_dir))


@stored
def _features(spark, sf_dir):
    return _frame("m07_actor_features", spark, sf_dir)


@stored
def m08_actor_persona(spark, sf_dir):
    from tidemill.operators import ml

    return ml.actor_persona(_features(spark, sf_dir))


def m02_repo_cluster_profile(spark, sf_dir):
    from tidemill.operators import ml

    return ml.cluster_profile(m01_repo_clusters(spark, sf_dir), _frame("rank_all", spark, sf_dir).drop("metric_date"))


@stored
def m09_actor_persona_bic(spark, sf_dir):
    from tidemill.operators import ml

    return ml.persona_bic(_features(spark, sf_dir))


@stored
def m10_actor_persona_centroid(spark, sf_dir):
    from tidemill.operators import ml

    return ml.centroids_of(m08_actor_persona(spark, sf_dir))


@stored
def m12_actor_persona_transition(spark, sf_dir):
    from tidemill.operators import ml

    return ml.persona_transition(*(keep(_frame(t, spark, sf_dir)) for t in ("actor_feat", "actor_feat_early", "actor_feat_late")))


def _actors(spark, sf_dir):
    return _features(spark, sf_dir), m08_actor_persona(spark, sf_dir)


@stored
def _bot_trees(spark, sf_dir):
    from tidemill.operators import ml

    return ml.bot_trees(*_actors(spark, sf_dir))


@stored
def m16_actor_bot_supervised(spark, sf_dir):
    from tidemill.operators import ml

    return ml.bot_scores(*_actors(spark, sf_dir), trees=_bot_trees(spark, sf_dir))


@stored
def m16_bot_feature_importance(spark, sf_dir):
    from tidemill.operators import ml

    return ml.bot_importance(*_actors(spark, sf_dir), trees=_bot_trees(spark, sf_dir))


@stored
def m16_bot_classifier_meta(spark, sf_dir):
    from tidemill.operators import ml

    return ml.bot_measures(*_actors(spark, sf_dir), trees=_bot_trees(spark, sf_dir))


@stored
def m15_repo_association_rules(spark, sf_dir):
    from tidemill.operators import ml

    return ml.association_rules(_frame("actor_repo", spark, sf_dir))


@stored
def m17_actor_churn_risk(spark, sf_dir):
    from tidemill.operators import ml

    return ml.churn_risk(_frame("m17_churn_features", spark, sf_dir))


@stored
def m18_repo_als_neighbor(spark, sf_dir):
    from tidemill.operators import ml

    return ml.nearest(m18_repo_embedding(spark, sf_dir), _scope_counts(spark, sf_dir))


@stored
def _scope_counts(spark, sf_dir):
    scope = _frame("g02_scope_network", spark, sf_dir).select("repo_name")
    return _frame("ev_graph", spark, sf_dir).join(F.broadcast(scope), "repo_name").groupBy("actor_login", "repo_name").agg(F.count("*").alias("n"))


@stored
def m18_repo_embedding(spark, sf_dir):
    from tidemill.operators import ml

    return ml.als_factors(_scope_counts(spark, sf_dir))


@stored
def m19_repo_archetype(spark, sf_dir):
    """Archetypes of the scope's repositories by rule and by mixture."""
    from tidemill.operators import ml

    names = {"archetype": "archetype_rule", "contributors": "contributor_count", "events_per_day": "events_per_active_day"}
    scope = _frame("g01_scope_ranked", spark, sf_dir).select("repo_name", F.coalesce("rank_score", F.lit(0.0)).alias("rank_score"))  # at most the scope's names
    events = _frame("ev", spark, sf_dir).groupBy("repo_name").agg(F.count("*").alias("total_events"))
    rules = _frame("m19_repo_archetype_rule", spark, sf_dir).withColumnsRenamed(names)
    return ml.repo_archetypes(keep(rules.join(events, "repo_name").join(F.broadcast(scope), "repo_name")))


def m19_repo_archetype_centroid(spark, sf_dir):
    from tidemill.operators import ml

    return ml.archetype_centroids(keep(m19_repo_archetype(spark, sf_dir)))


def m05_attribution_interval(spark, sf_dir):
    """The 95 % interval of each Cohen's d of m05_hot_vs_cold_attribution."""
    rows = keep(_frame("dna", spark, sf_dir).where("cohort_group <> 'mid'").select(F.col("repo_name").alias("key"), F.col("cohort_group").alias("side"), F.col("bot_ratio").alias("bots"), *features.FEATURES))
    scope = F.array(F.lit("all"), F.when(F.col("bots") < 0.3, "humans_only").otherwise("bots_only"))
    return bootstrap.intervals(rows.withColumn("cohort_scope", F.explode(scope)), features.FEATURES, "hot", "cold")


def m20_attribution_interval(spark, sf_dir):
    """The 95 % interval of each Cohen's d of m20_dynamic_attribution."""
    sides = _frame("m20_side", spark, sf_dir).withColumnsRenamed({"repo_name": "key"})
    rows = _frame("dna", spark, sf_dir).select(F.col("repo_name").alias("key"), *features.FEATURES).join(F.broadcast(sides), "key")  # at most 30 names a side
    return bootstrap.intervals(keep(rows.withColumn("cohort_scope", F.lit("all"))), features.FEATURES, "riser", "faller").drop("cohort_scope")


def b08_payload_sketch_day(spark, sf_dir):
    return sketches.payload_day(_frame("ev", spark, sf_dir))


def b08_payload_sketch_week(spark, sf_dir):
    return sketches.payload_week(_frame("ev", spark, sf_dir))


def m04_payload_sketch(spark, sf_dir):
    return sketches.payload_repo(_frame("ev", spark, sf_dir))


def m04_score_cohort_sketch(spark, sf_dir):
    return sketches.cohorts_by_sketch(_frame("dna_base", spark, sf_dir).where("total_events >= 3"), "repo_name", "rank_score", 0.1, 0.9)


def _sketch_sql() -> dict[str, str]:
    """Exact percentiles: what sketches give for groups of up to their size."""
    at = lambda q, x="payload_size": f"CAST(percentile_disc({q}) WITHIN GROUP (ORDER BY {x}) AS DOUBLE)"
    ev = f"WITH ev AS ({CATALOG.statement('ev', DUCK)}), p AS (SELECT * FROM ev WHERE event_type = 'PushEvent' AND payload_size IS NOT NULL)"
    both = f"count(*) AS n, {at(0.5)} AS p50_payload_size, {at(0.95)} AS p95_payload_size"
    return {
        "b08_payload_sketch_day": f"{ev} SELECT metric_date, repo_name, {both} FROM p GROUP BY ALL",
        "b08_payload_sketch_week": f"{ev} SELECT CAST(date_trunc('week', metric_date) AS DATE) AS week, org_or_owner, {both} FROM p GROUP BY ALL",
        "m04_payload_sketch": f"{ev} SELECT repo_name, count(*) AS n, {at(0.95)} AS payload_p95 FROM p GROUP BY ALL",
        "m04_score_cohort_sketch": f"WITH d AS (SELECT repo_name, rank_score FROM ({CATALOG.statement('dna_base', DUCK)}) WHERE total_events >= 3 AND rank_score IS NOT NULL), e AS (SELECT percentile_disc(0.1) WITHIN GROUP (ORDER BY rank_score) AS low, percentile_disc(0.9) WITHIN GROUP (ORDER BY rank_score) AS high FROM d) SELECT repo_name, rank_score, CASE WHEN rank_score >= high THEN 'high' WHEN rank_score <= low THEN 'low' ELSE 'mid' END AS cohort FROM d, e",
    }


WINDOW, LATE = "1 minute", "5 seconds"
#: Streams and the batch SQL that says what they hold in the end.
STREAMED = {"s01_realtime_event_metrics": "rt_event_metrics", "s02_realtime_repo_scores": "rt_repo_scores", "s03_realtime_anomaly_alerts": "rt_anomaly_alerts", "s03_realtime_anomaly_alerts_day": "rt_anomaly_alerts_day"}


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def s01_realtime_event_metrics(spark, sf_dir):
    stream = realtime.event_metrics(realtime.read_events(spark, f"{sf_dir}/events.parquet"), WINDOW, LATE)
    return _plain(realtime.drain(stream, ["window_start", "event_type", "repo_name", "actor_category"]))


def s02_realtime_repo_scores(spark, sf_dir):
    stream = realtime.repo_scores(realtime.read_events(spark, f"{sf_dir}/events.parquet"), WINDOW, LATE)
    return _plain(realtime.drain(stream, ["window_start", "repo_name"]).drop("events"))


def s03_realtime_anomaly_alerts(spark, sf_dir):
    return _plain(realtime.all_alerts(spark, f"{sf_dir}/events.parquet", WINDOW, LATE))


def s03_realtime_anomaly_alerts_day(spark, sf_dir):
    """The same by day, where sparse events give alerts too."""
    return _plain(realtime.all_alerts(spark, f"{sf_dir}/events.parquet", "1 day", LATE))


PLANS = {f.__name__: f for f in (g04_repo_community, g05_repo_community_profile, g09_repo_layer_community, g15_bridge_score, g15_modularity, g07_actor_pagerank, g07_actor_graph_metrics, g08_actor_coreness, g08_repo_coreness, g11_repo_community_weekly, g12_community_lineage, g14_actor_ic_reach, g14_seed_greedy, g14_seed_reverse, v17_coreness_summary, v19_lineage_counts, v20_influence_lift, v22_community_flows, m01_repo_clusters, m02_repo_cluster_profile, m08_actor_persona, m09_actor_persona_bic, m10_actor_persona_centroid, m12_actor_persona_transition, m16_actor_bot_supervised, m16_bot_feature_importance, m16_bot_classifier_meta, m18_repo_embedding, m19_repo_archetype, m19_repo_archetype_centroid, m05_attribution_interval, m20_attribution_interval, m15_repo_association_rules, m17_actor_churn_risk, m18_repo_als_neighbor, s01_realtime_event_metrics, s02_realtime_repo_scores, s03_realtime_anomaly_alerts, s03_realtime_anomaly_alerts_day, b08_payload_sketch_day, b08_payload_sketch_week, m04_payload_sketch, m04_score_cohort_sketch)}
PLANS |= model_reads.queries(dict(PLANS), lambda name, spark, sf_dir: _frame(name, spark, sf_dir))


def queries() -> dict:
    return {n: partial(_frame, n) for n, t in CATALOG.tables.items() if not t.internal} | PLANS


def oracle_sql() -> dict:
    return {n: CATALOG.statement(n, DUCK) for n, t in CATALOG.tables.items() if not t.internal} | {n: CATALOG.statement(t, DUCK) for n, t in STREAMED.items()} | _sketch_sql()
