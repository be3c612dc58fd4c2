"""Curation of raw nested JSON events into flat, partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RAW = "id string, type string, created_at string, actor struct<login: string>, repo struct<id: bigint, name: string>, org struct<login: string>, payload struct<action: string, size: bigint>, public boolean"
#: Words in a repository's name that tell its language, in order (fixed values).
LANGUAGES = [("Scala", ["spark", "scala"]), ("Python", ["python", "pandas"]), ("JavaScript", ["react", "js"]), ("Java", ["java", "spring"]), ("Go", ["golang", "go"])]
FLAGS = {"is_push_event": "PushEvent", "is_watch_event": "WatchEvent", "is_fork_event": "ForkEvent", "is_issue_event": "IssuesEvent", "is_pr_event": "PullRequestEvent"}


def read_raw(spark: SparkSession, paths: list[str]) -> DataFrame:
    """JSON lines (plain or .gz) under the declared schema; files that vanish meanwhile are skipped."""
    return spark.read.schema(RAW).option("ignoreMissingFiles", "true").json(paths).select("*", F.col("_metadata.file_name").alias("source_file"))


def language(name: Column) -> Column:
    out = F
    for label, words in LANGUAGES:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.lower(name).contains(w)
        out = out.when(hit, label)
    return out.otherwise("unknown")


def curate(raw: DataFrame) -> DataFrame:
    """Flat events: those without id, type or a readable created_at go, one of each id stays, nulls get defaults."""
    ts = F.try_to_timestamp("created_at", F.lit("yyyy-MM-dd'T'HH:mm:ssX"))
    rows = raw.withColumn("event_timestamp", ts).where("id is not null and type is not null and event_timestamp is not null").dropDuplicates(["id"])
    day = F.to_date("event_timestamp")
    actor = F.coalesce("actor.login", F.lit("unknown"))
    name = F.coalesce("repo.name", F.lit("unknown/unknown"))
    return rows.select(
        F.col("id").alias("event_id"),
        F.col("type").alias("event_type"),
        "created_at",
        "event_timestamp",
        day.alias("event_date"),
        F.hour("event_timestamp").alias("event_hour"),
        F.minute("event_timestamp").alias("event_minute"),
        F.year("event_timestamp").alias("event_year"),
        F.lpad(F.month("event_timestamp").cast("string"), 2, "0").alias("event_month"),
        F.lpad(F.dayofmonth("event_timestamp").cast("string"), 2, "0").alias("event_day"),
        actor.alias("actor_login"),
        F.when(F.lower(actor).contains("bot"), "bot").otherwise("human").alias("actor_category"),
        F.coalesce("repo.id", F.lit(0)).cast("long").alias("repo_id"),
        name.alias("repo_name"),
        F.coalesce("org.login", F.lit("unknown")).alias("org_login"),
        F.coalesce("public", F.lit(True)).alias("public"),
        F.coalesce("payload.action", F.lit("unknown")).alias("payload_action"),
        F.coalesce("payload.size", F.lit(0)).cast("long").alias("payload_size"),
        language(name).alias("language_guess"),
        "source_file",
        F.current_date().alias("ingest_date"),
        *[(F.col("type") == t).alias(c) for c, t in FLAGS.items()],
    )


def write_curated(raw: DataFrame, path: str) -> dict[str, int]:
    """Write partitions by date and hour and return the counts of the cleaning report, in one pass over the source.

    Only partitions that have rows now are replaced, so that a day run again leaves the others as they are.
    """
    seen, kept = Observation(), Observation()
    out = curate(raw.observe(seen, F.count(F.lit(1)).alias("n"))).observe(kept, F.count(F.lit(1)).alias("n"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date", "event_hour").parquet(path)
    return {"raw": seen.get["n"], "curated": kept.get["n"], "dropped": seen.get["n"] - kept.get["n"]}
