"""Helpers shared by the training-data operators: shared storage, size-checked broadcasts, components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that may be broadcast; beyond it the join is shuffled.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return base or os.path.join(tempfile.gettempdir(), "tidemill-shared")


def stash(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidemill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(small: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only behind a measured bound of bytes; past it Spark shuffles the join."""
    size = F.lit(32 + 16 * len(small.columns))
    for name, kind in small.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0))
    return F.broadcast(small) if (small.agg(F.sum(size.cast("long"))).first()[0] or 0) <= limit else small


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and leave every other letter as it is; texts of ASCII alone go the shorter way."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(_translated(c))


def _translated(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges by alternating large-star and small-star rounds.

    Returns (node, component) for every node of an edge; component is the smallest node reachable.
    Self-loops, repeated edges and null ends are ignored; no edges give an empty frame. Each round is
    two aggregates and two joins (both splittable under skew) and is written to the shared folder.
    """
    kind = edges.schema[a].dataType
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = stash(e.distinct())
    before = None
    while True:  # the rounds grow with the logarithm of the longest path
        sym = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stash(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftrightunsigned(F.xxhash64("u", "v"), 20))).first())
        if now == before:
            break
        before = now
    star = e.select(F.col("u").cast(kind).alias("node"), F.col("v").cast(kind).alias("component"))
    return star.unionByName(star.select(F.col("component").alias("node"), "component").distinct())
