"""Serving queries over the tables of models and iterative graphs, which are frames and not SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Plan = Callable[[SparkSession, str], DataFrame]

#: (query, plan, order, limit or none): the rows that a page shows; a minus sign before a column sorts it downwards.
READS = [
    ("actor_persona_sample", "m08_actor_persona", "-event_count actor_login", 2000),
    ("actor_persona_centroids", "m10_actor_persona_centroid", "-members persona_id", None),
    ("actor_persona_bic", "m09_actor_persona_bic", "k", None),
    ("actor_persona_transition", "m12_actor_persona_transition", "persona_early -transition_prob persona_late", None),
    ("repo_association_rules", "m15_repo_association_rules", "-lift -confidence antecedent consequent", 40),
    ("repo_community_profile", "g05_repo_community_profile", "-size -total_events community_id", 20),
    ("repo_clusters_latest", "m01_repo_clusters", "-health_score rank_no repo_name", 120),
    ("repo_cluster_profile_latest", "m02_repo_cluster_profile", "-avg_rank_score cluster_id", None),
    ("actor_graph_metrics", "g07_actor_graph_metrics", "-pagerank actor_login", 400),
    ("actor_churn_risk", "m17_actor_churn_risk", "-churn_prob actor_login", 400),
    ("actor_bot_supervised", "m16_actor_bot_supervised", "rank_no", 80),
    ("bot_feature_importance", "m16_bot_feature_importance", "rank_no", None),
    ("bot_classifier_meta", "m16_bot_classifier_meta", "metric", None),
    ("repo_als_neighbors", "m18_repo_als_neighbor", "src_repo rank_no", 600),
    ("actor_coreness", "g08_actor_coreness", "-coreness -degree actor_login", 200),
    ("repo_coreness", "g08_repo_coreness", "-coreness -degree repo_name", 400),
    ("repo_archetype_mixture", "m19_repo_archetype", "archetype_rule -rank_score repo_name", 400),
    ("repo_archetype_centroids", "m19_repo_archetype_centroid", "-members archetype_rule archetype_gmm_id", None),
    ("repo_community_weekly", "g11_repo_community_weekly", "week_idx community_id repo_name", 2000),
    ("community_lineage", "g12_community_lineage", "week_idx community_id event_type", 500),
    ("actor_ic_reach", "g14_actor_ic_reach", "strategy k", None),
    ("seed_greedy", "g14_seed_greedy", "seed_rank", 20),
]


def ordered(df: DataFrame, order: str, limit: int | None) -> DataFrame:
    out = df.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order.split()])
    return out if limit is None else out.limit(max(limit, 1))


def of_repo(df: DataFrame, repo: str | None, column: str = "repo_name") -> DataFrame:
    """Rows of one repository; the last by name unless told otherwise."""
    name = df.agg(F.max(column).alias("asked")) if repo is None else None
    return df.where(F.col(column) == repo) if name is None else df.join(F.broadcast(name), F.col(column) == F.col("asked"), "left_semi")


def communities_top(members: DataFrame, ranks: DataFrame, limit: int = 8) -> DataFrame:
    """Members of the largest communities of two or more, with their rank score (0 without one); ties go to the higher mean score."""
    at = members.where("community_size >= 2").join(ranks.select("repo_name", "rank_score"), "repo_name", "left").fillna(0.0, ["rank_score"])
    top = at.groupBy("community_id").agg(F.max("community_size").alias("n"), F.avg("rank_score").alias("score")).orderBy(F.desc("n"), F.desc(F.round("score", 9)), "community_id").limit(max(limit, 1))
    return ordered(at.join(F.broadcast(top.select("community_id")), "community_id", "left_semi"), "-community_size -rank_score repo_name", None)


def rules_of(rules: DataFrame, repo: str | None = None, limit: int = 20) -> DataFrame:
    """Rules that name a repository before or after; the last consequent by name unless told otherwise."""
    asked = rules.agg(F.max("consequent").alias("asked")) if repo is None else rules.sparkSession.range(1).select(F.lit(repo).alias("asked"))
    hit = F.col("antecedent").contains(F.col("asked")) | (F.col("consequent") == F.col("asked"))
    return ordered(rules.join(F.broadcast(asked)).where(hit).drop("asked"), "-lift -confidence antecedent consequent", limit)


#: Sections of a repository's document: (name, table, column of the repository or None for whole tables, order, rows or None for all).
DOCUMENT = [
    ("cluster", "m01_repo_clusters", "repo_name", "repo_name", 1),
    ("cluster_profile", "m02_repo_cluster_profile", None, "cluster_id", None),
    ("dna", "m04_repo_dna", "repo_name", "repo_name", 1),
    ("cohort_averages", "q_cohort_averages", None, "cohort_group", None),
    ("watcher_profile", "m14_repo_watcher_profile", "repo_name", "repo_name", 1),
    ("watcher_lifts", "m13_repo_watcher_persona_lift", "repo_name", "-lift persona_label", None),
    ("community", "g04_repo_community", "repo_name", "repo_name", 1),
    ("similar", "g03_repo_similarity_edges", "src_repo", "-jaccard dst_repo", 10),
    ("rules", "m15_repo_association_rules", None, "-lift -confidence antecedent consequent", 10),
    ("top_actors", "b33_repo_top_actors_latest", "repo_name", "actor_rank", 10),
]


def repo_document(tables: dict[str, DataFrame], repo: str | None = None) -> DataFrame:
    """(repo_name, section, place, body): all reads about one repository as JSON rows, place counting a section's rows.

    The repository is the last of the fingerprints by name unless told otherwise. Of the cluster profiles only its own
    cluster's stays, of the rules those that name it; averages of cohorts are there for every repository. A section
    without rows is left out; without any repository there are no rows.
    """
    dna = tables["m04_repo_dna"]
    asked = dna.agg(F.max("repo_name").alias("asked")) if repo is None else dna.sparkSession.range(1).select(F.lit(repo).alias("asked"))
    asked, found = F.broadcast(asked.where("asked is not null")), []
    for section, table, column, order, limit in DOCUMENT:
        rows = tables[table]
        at = F.struct(*rows.columns).alias("body")
        if section == "cluster_profile":
            own = tables["m01_repo_clusters"].join(asked, F.col("repo_name") == F.col("asked")).select("asked", F.col("cluster_id").alias("own")).limit(1)
            mine = rows.join(F.broadcast(own), F.col("cluster_id") == F.col("own"))
        elif section == "rules":
            named = F.array_contains(F.split("antecedent", " & "), F.col("asked")) | (F.col("consequent") == F.col("asked"))
            mine = rows.join(asked, named)
        else:
            mine = rows.join(asked, F.col(column) == F.col("asked")) if column else rows.join(asked)
        mine = ordered(mine.select("asked", *rows.columns), order, limit).select("asked", at)
        keys = [F.desc(f"body.{c[1:]}") if c.startswith("-") else F.asc(f"body.{c}") for c in order.split()]
        place = F.row_number().over(Window.partitionBy("asked").orderBy(*keys))
        found.append(mine.select(F.col("asked").alias("repo_name"), F.lit(section).alias("section"), place.alias("place"), F.to_json("body").alias("body")))
    return reduce(DataFrame.unionByName, found)


def embedding_summary(factors: DataFrame, near: DataFrame) -> DataFrame:
    """One row: repositories and their factors, the mean cosine of neighbours and the share that shared actors would miss."""
    own = factors.agg(F.count("*").alias("repos"), F.max("rank_dim").alias("rank_dim"))
    return own.join(F.broadcast(near.where("rank_no <= 5").agg(F.round(F.avg("cosine"), 6).alias("avg_cosine"), F.round(F.avg("is_jaccard_miss"), 6).alias("miss_share"))))


def layer_communities(labels: DataFrame, limit: int | None = 3000) -> DataFrame:
    sizes = labels.groupBy("layer", "community_id").agg(F.count("*").alias("community_size"))
    return ordered(labels.join(sizes, ["layer", "community_id"]), "layer -community_size repo_name", limit)


def layer_matrix(labels: DataFrame) -> DataFrame:
    """Communities of two or more in each layer, and the largest."""
    sizes = labels.groupBy("layer", "community_id").agg(F.count("*").alias("n"))
    return sizes.groupBy("layer").agg(F.count_if(F.col("n") >= 2).alias("communities"), F.max("n").alias("largest"))


def histogram(cores: DataFrame) -> DataFrame:
    return cores.groupBy("coreness").agg(F.count("*").alias("actors"), F.sum("is_bot").cast("long").alias("bots")).orderBy("coreness")


def model_summary(bic: DataFrame, centroids: DataFrame, clusters: DataFrame) -> DataFrame:
    """How many personas and repository clusters there are, and the size that the criterion picks."""
    picked = bic.where("is_selected = 1").agg(F.max("k").alias("bic_pick"), F.max("bic").alias("bic"))
    counts = centroids.agg(F.count("*").alias("personas"), F.max("members").alias("largest_persona"))
    return counts.join(F.broadcast(clusters.agg(F.countDistinct("cluster_id").alias("repo_clusters")))).join(F.broadcast(picked))


def actor_rankings(metrics: DataFrame, limit: int = 10) -> DataFrame:
    """The first actors by PageRank and by betweenness."""
    parts = [ordered(metrics.select(F.lit(c).alias("ranking"), "actor_login", "community_id", F.col(c).alias("value")), "-value actor_login", limit) for c in ("pagerank", "betweenness")]
    return parts[0].unionByName(parts[1])


def queries(plans: dict[str, Plan], frame: Callable[[str, SparkSession, str], DataFrame]) -> dict[str, Plan]:
    found: dict[str, Plan] = {}
    for name, plan, order, limit in READS:
        found[f"q_{name}"] = lambda spark, sf_dir, p=plan, o=order, n=limit: ordered(plans[p](spark, sf_dir), o, n)
    at = lambda plan: lambda *where: plans[plan](*where)
    found["q_repo_communities_top"] = lambda *w: communities_top(at("g04_repo_community")(*w), frame("rank_all", *w))
    found["q_repo_community_by_repo"] = lambda *w: of_repo(at("g04_repo_community")(*w), None)
    found["q_repo_cluster_by_repo"] = lambda *w: of_repo(at("m01_repo_clusters")(*w), None)
    found["q_repo_association_rules_by_repo"] = lambda *w: rules_of(at("m15_repo_association_rules")(*w))
    whole = lambda name, *w: plans[name](*w) if name in plans else frame(name, *w)
    found["q_repo_document"] = lambda *w: repo_document({t: whole(t, *w) for _, t, *_ in DOCUMENT})
    found["q_repo_embedding_summary"] = lambda *w: embedding_summary(at("m18_repo_embedding")(*w), at("m18_repo_als_neighbor")(*w))
    found["q_repo_layer_communities"] = lambda *w: layer_communities(at("g09_repo_layer_community")(*w))
    found["q_actor_coreness_histogram"] = lambda *w: histogram(at("g08_actor_coreness")(*w))
    found["v12_model_summary"] = lambda *w: model_summary(at("m09_actor_persona_bic")(*w), at("m10_actor_persona_centroid")(*w), at("m01_repo_clusters")(*w))
    found["v15_actor_rankings"] = lambda *w: actor_rankings(at("g07_actor_graph_metrics")(*w))
    found["v16_churn_tiers"] = lambda *w: at("m17_actor_churn_risk")(*w).groupBy("risk_tier").agg(F.count("*").alias("actors"))
    found["v21_layer_communities"] = lambda *w: layer_matrix(at("g09_repo_layer_community")(*w))
    return found
