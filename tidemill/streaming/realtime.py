"""Realtime tables (S01-S03) with Structured Streaming.

Events delivered twice count once. Each micro-batch writes the windows it updated to a folder of its own number, so
a batch run again replaces its own output; readers take each key's row of the last batch. Alerts need whole windows,
so their stream appends: a window's alerts come once, when the watermark has passed its end.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.exprs import HOTNESS
from tidemill.operators.realtime_sql import REALTIME as COUNTS
from tidemill.sources.storage import shared_dir


def read_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of activity events from Parquet files; event time is a timestamp, as watermarks need."""
    schema = spark.read.parquet(path).schema
    path = f"{path[:-1]}[{path[-1]}]"  # as a pattern: the source takes a single file no other way
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    names = {"view": "WatchEvent", "signup": "ForkEvent", "error": "IssuesEvent", "purchase": "PullRequestEvent", "click": "PushEvent"}
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in names.items()], F.col("event_type"))
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return reader.parquet(path).select(F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("event_type"), F.concat(F.lit("org"), (k % 10).cast("string"), F.lit("/repo"), k.cast("string")).alias("repo_name"), F.when(F.col("user_id") % 10 == 0, "bot").otherwise("human").alias("actor_category"))


def read_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The same from JSON messages of a broker."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return parse_messages(raw)


def parse_messages(raw: DataFrame) -> DataFrame:
    """Events of JSON messages; those that are no JSON or have no readable time go."""
    schema = "event_id string, event_type string, created_at timestamp, repo_name string, actor_category string"
    event = raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e")).where("e.created_at is not null")
    return event.select("e.event_id", F.col("e.created_at").alias("ts"), "e.event_type", "e.repo_name", "e.actor_category")


def messages(events: DataFrame) -> DataFrame:
    """Events as JSON messages; the repository is the key, so that its events share a partition and stay in order."""
    own = ["event_id"] if "event_id" in events.columns else []
    value = F.to_json(F.struct(*own, "event_type", F.col("ts").alias("created_at"), "repo_name", "actor_category"))
    return events.select(F.col("repo_name").alias("key"), value.alias("value"))


def send(events: DataFrame, servers: str, topic: str, state: str, every: str = "2 seconds"):
    """Write a stream of events to a broker, a micro-batch at each interval; starts and returns the query.

    Over read_events with files_per_trigger this replays stored events at a pace of files an interval.
    """
    sink = messages(events).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    return sink.option("checkpointLocation", state).trigger(processingTime=every).start()


#: The category of marks: events that only move event time.
MARK = "mark"


def once(events: DataFrame, late: str) -> DataFrame:
    """Events with a watermark, those of an id that came before left out; events without an id all stay.

    The state holds an id until the watermark has passed its event's time by `late` again. A copy that comes later
    still is itself behind the watermark, as it has the same event time, and goes as any late event does.
    """
    named = events.withWatermark("ts", late).withColumn("_id", F.coalesce("event_id", F.expr("uuid()")))
    return named.dropDuplicatesWithinWatermark(["_id"]).drop("_id")


def event_metrics(events: DataFrame, window: str, late: str) -> DataFrame:
    """Events by window, type, repository and category."""
    g = once(events, late).groupBy(F.window("ts", window).alias("w"), "event_type", "repo_name", "actor_category").agg(F.count("*").alias("event_count"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "repo_name", "actor_category", "event_count")


def repo_scores(events: DataFrame, window: str, late: str) -> DataFrame:
    """Weighted hotness by window and repository; unknown types weigh 1."""
    weight = F.coalesce(*[F.when(F.col("event_type") == t, F.lit(w)) for t, w in HOTNESS.items()], F.lit(1.0))
    each = [F.sum(F.when(F.col("event_type") == t, 1).otherwise(0)).alias(c) for t, c in COUNTS.items()]
    g = once(events, late).groupBy(F.window("ts", window).alias("w"), "repo_name").agg(F.count("*").alias("events"), F.sum(weight).alias("hotness_score"), *each)
    return g.select(F.col("w.start").alias("window_start"), "repo_name", "events", "hotness_score", *COUNTS.values())


def drain(stream: DataFrame, keys: list[str], root: str | None = None) -> DataFrame:
    """Run a stream over all that is there now, and return each key's last row.

    Over the folder of a run before, it goes on where that one ended.
    """
    root = root or f"{shared_dir(stream.sparkSession).rstrip('/')}/tidemill-stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    q = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    spark = stream.sparkSession
    rows = spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out/batch=*")
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r"))
    return last.select(*keys, "r.*")


def alerts_of(rows: DataFrame) -> DataFrame:
    """The alerts among a window's counts beside its baseline: twice (medium) or four times (high) as many."""
    rows = rows.withColumn("ratio", F.col("events") / F.greatest(F.col("baseline_events"), F.lit(1.0))).where("ratio >= 2")
    level = F.when(F.col("ratio") >= 4, "high").otherwise("medium")
    return rows.select("window_start", "repo_name", F.col("events").alias("current_events"), F.round("baseline_events", 6).alias("baseline_events"), F.round("ratio", 6).alias("anomaly_ratio"), level.alias("alert_level"))


def anomaly_alerts(events: DataFrame, window: str, late: str, salts: int = 16) -> DataFrame:
    """S03 as one stream in append mode: counts by window and repository, the window's mean of these, and their join.

    The counts of a window go on when the watermark has passed its end; a second aggregate over window_time sums them
    up, and counts and mean meet in a join by window. Every state is bounded by the watermark. A window's counts are
    dealt over `salts` parts for the join, so that its repositories don't meet in one task.
    """
    counts = once(events, late).where(F.col("actor_category") != MARK).groupBy(F.window("ts", window).alias("w"), "repo_name").agg(F.count("*").alias("events"))
    counts = counts.select(F.window_time("w").alias("at"), F.col("w.start").alias("window_start"), "repo_name", "events")
    base = counts.groupBy(F.window("at", window).alias("v")).agg((F.sum("events") / F.count("*")).alias("baseline_events"))
    base = base.select(F.window_time("v").alias("b_at"), "baseline_events", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("b_salt"))
    counts = counts.withColumn("salt", F.pmod(F.xxhash64("repo_name"), F.lit(salts)).cast("int"))
    return alerts_of(counts.join(base, (F.col("at") == F.col("b_at")) & (F.col("salt") == F.col("b_salt"))))


class Alerts:
    """A run of the alert stream: files of events in, files of alerts out, its state and output under one folder.

    Windows close as later events come. A source that falls silent leaves its last windows open, so a mark of its own
    can be sent to move event time on. A new run over the same folder goes on where the
    one before ended.
    """

    def __init__(self, spark: SparkSession, path: str, window: str, late: str, root: str | None = None, files_per_trigger: int | None = None):
        self.spark, self.window, self.late = spark, window, late
        self.root = root or f"{shared_dir(spark).rstrip('/')}/tidemill-stream-{uuid.uuid4().hex}"
        self.marks = f"{self.root}/marks"
        events = read_events(spark, path, files_per_trigger)
        self.schema = events.schema
        spark.createDataFrame([], self.schema).write.mode("append").parquet(self.marks)
        self.events = events.unionByName(spark.readStream.schema(self.schema).parquet(self.marks))

    def start(self):
        """Start over what is there now and return the query."""
        stream = anomaly_alerts(self.events, self.window, self.late)
        sink = stream.writeStream.outputMode("append").format("parquet").option("path", f"{self.root}/alerts").option("checkpointLocation", f"{self.root}/state")
        return sink.trigger(availableNow=True).start()

    def mark(self, at) -> None:
        """Send a mark of this event time."""
        self.spark.createDataFrame([(None, at, MARK, None, MARK)], self.schema).write.mode("append").parquet(self.marks)

    def found(self) -> DataFrame:
        """The alerts so far; the sink's log makes each count once."""
        schema = "window_start timestamp, repo_name string, current_events long, baseline_events double, anomaly_ratio double, alert_level string"
        return self.spark.read.schema(schema).parquet(f"{self.root}/alerts")


def all_alerts(spark: SparkSession, path: str, window: str, late: str) -> DataFrame:
    """The alerts of all events there are: the stream runs over them, and again over a mark that closes the last windows."""
    run = Alerts(spark, path, window, late)
    run.start().awaitTermination()
    last = spark.read.parquet(path).agg(F.max(F.col("ts").cast("timestamp")) + F.expr("interval 1 day")).first()[0]
    if last is not None:
        run.mark(last)
        run.start().awaitTermination()
    return run.found()
