import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import community, influence, iterative


def dense(spark, n, seed=3):
    r = random.Random(seed)
    pairs = [(f"n{a:03}", f"n{b:03}", float(r.choice([1, 1, 2, 3]))) for a in range(n) for b in range(a) if r.random() < 0.7]
    return iterative.both_ways(spark.createDataFrame(pairs, "a string, b string, w double"), "a", "b", "w")


def test_betweenness_makes_no_row_for_a_link_and_source(spark, monkeypatch):
    """The joins made sources times links rows (500 times 1.7 million at sf0.1); both ways agree, also in small blocks."""
    e = dense(spark, 40)
    sources = e.select(F.col("src").alias("node")).distinct()
    want = {r.node: r.part for r in iterative.dependencies(e, sources, most_nodes=0).collect()}
    monkeypatch.setattr(iterative, "CELLS", 300)  # blocks of seven sources
    monkeypatch.setattr(iterative, "distances", None)
    assert {r.node: r.part for r in iterative.dependencies(e, sources).collect()} == pytest.approx(want)
    assert iterative.dependencies(e.limit(0), sources.limit(0)).isEmpty()


def test_louvain_by_rows_equals_joins(spark, monkeypatch):
    e = dense(spark, 9)
    want = sorted(map(tuple, community.louvain(e, most_nodes=0).collect()))
    monkeypatch.setattr(community, "_moves", None)
    assert sorted(map(tuple, community.louvain(e).collect())) == want


def test_propagation_by_rows_equals_joins(spark, monkeypatch):
    """A colour's move was some jobs with shuffles; now it is one without."""
    e = dense(spark, 14)
    want = sorted(map(tuple, community.label_propagation(e, most_nodes=0).collect()))
    monkeypatch.setattr(community, "_propagate_by_joins", None)
    assert sorted(map(tuple, community.label_propagation(e).collect())) == want


def test_reverse_sets_by_rows_equal_joins(spark, monkeypatch):
    """Every set tried every link into what it holds, a row each; both ways agree, also in small blocks and with long names."""
    at = lambda c: F.when(F.col(c) < "n010", F.concat(F.lit("ä" * 40), c)).otherwise(F.col(c)).alias(c)
    e = dense(spark, 40).select(at("src"), at("dst"), (F.col("w") * 4).alias("w"))
    want = sorted(map(tuple, influence.reverse_sets(e, 50, most_nodes=0).collect()))
    assert len(want) > 300
    monkeypatch.setattr(influence, "_reverse_sets_by_joins", None)
    monkeypatch.setattr(influence, "CELLS", 100)  # blocks of twenty sets
    monkeypatch.setattr(influence, "PAIRS", 64)
    assert sorted(map(tuple, influence.reverse_sets(e, 50).collect())) == want


def test_draws_equal_the_hash_of_columns(spark):
    words = ["", "a", "user1", "user1234-bot", "é" * 7, "x" * 31, "y" * 32, "z" * 33 + "ü", "w" * 77]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(words)], "i long, x string").select("x", F.xxhash64(F.lit(42), "i").alias("seed"), F.xxhash64(F.lit(42), "i", "x").alias("want")).collect()
    for r in rows:
        got = influence.hashed(np.array([r.seed], np.int64).view(np.uint64), np.frombuffer(r.x.encode(), np.uint8)[None], np.array([0]))
        assert got.view(np.int64)[0] == r.want
