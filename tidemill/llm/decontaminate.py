"""Benchmark decontamination: a prefix-filtered containment join of item-sized windows, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import ascii_lower, maybe_broadcast, stash

#: Runs of ASCII characters that are neither letters nor digits separate words (after lower-casing).
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), "")


def benchmark_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """Distinct (item_id, words, size, window): the runs of `width` words; of shorter items all words as one."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).where("item_id is not null and size(w) > 0")
    items = items.select("item_id", "w", F.least(F.size("w"), F.lit(width)).alias("size"))
    at = items.select("item_id", "size", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))).alias("i"))
    cut = at.select("item_id", F.slice("w", F.col("i") + 1, F.col("size")).alias("words"), "size")
    return cut.withColumn("window", F.array_join("words", " ")).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs.

    A window's shingles (pairs of adjacent words, or its single word) are ordered by the count of their rarer
    word in the whole corpus, rarest first. Containment of the whole window needs every token, so its prefix
    is the first one; documents' shingles meet the prefixes, places that leave no room for the window go (length and positional
    bounds), and what is left is compared word by word with the text at that place. A document word inside
    any occurrence is hit. Null and wordless texts have no hits; wordless items and items without an id have
    no windows; rows with the same id and text share their result and each gives a row; ids may be null;
    other columns are ignored. Window tables are broadcast up to a measured bound, else joined by shuffle.
    """
    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("w"))
    windows = stash(benchmark_windows(benchmark, width))
    # Words and shingles meet as 64-bit hashes: two that share one only add candidates, which are verified.
    vocabulary = windows.select(F.explode("words").alias("word")).select(F.xxhash64("word").alias("key")).distinct()
    counts = rows.select(F.explode("w").alias("word")).select(F.xxhash64("word").alias("key")).join(maybe_broadcast(vocabulary), "key").groupBy("key").agg(F.count("*").alias("df"))
    tokens = windows.select("window", "size", F.posexplode("words").alias("offset", "word")).distinct().withColumn("key", F.xxhash64("word")).join(counts, "key")
    # A window of which a word is in no document occurs nowhere.
    first = tokens.groupBy("window", "size").agg(F.min(F.struct("df", "word", "offset")).alias("first"), F.countDistinct("offset").alias("found"))
    first = first.where("found = size").withColumn("offset", F.greatest(F.lit(0), F.least(F.col("first.offset"), F.col("size") - 2)))
    first = first.withColumn("next", F.slice(F.split("window", " "), F.col("offset") + 1, 2))
    first = first.withColumn("token", F.when(F.size("next") == 2, F.xxhash64(F.get("next", 0), F.get("next", 1))).otherwise(F.xxhash64(F.get("next", 0))))
    prefix = stash(first.select("window", "size", "token", "offset"))

    pairs = F.arrays_zip(F.col("w").alias("x"), F.slice("w", 2, F.size("w")).alias("y"))  # the last word has no next one
    placed = rows.select("doc_id", "text_hash", F.size("w").alias("n"), F.posexplode(pairs).alias("pos", "pair")).select("doc_id", "text_hash", "n", "pos", F.xxhash64("pair.x", "pair.y").alias("token"))
    if not prefix.where("size = 1").isEmpty():
        placed = placed.unionByName(rows.select("doc_id", "text_hash", F.size("w").alias("n"), F.posexplode("w").alias("pos", "token")).withColumn("token", F.xxhash64("token")))
    near = placed.join(maybe_broadcast(prefix), "token").withColumn("start", F.col("pos") - F.col("offset")).where("start >= 0 and start + size <= n")
    near = near.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "size", "window")).alias("near"))
    near = stash(near)
    same = ["doc_id", "text_hash"]
    keyed = near.select(*[F.col(c).alias(f"k_{c}") for c in same], "near")
    on = F.col("doc_id").eqNullSafe(F.col("k_doc_id")) & (F.col("text_hash") == F.col("k_text_hash"))
    full = rows.join(maybe_broadcast(keyed), on).select(*same, "w", "near") if not near.isEmpty() else None
    out = rows.select(*same, F.size("w").cast("long").alias("n_words"))
    nothing = {"n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit(""), 256)}
    if full is not None:
        full = full.withColumn("hits", F.filter("near", lambda c: F.array_join(F.slice("w", c["start"] + 1, c["size"]), " ") == c["window"])).where("size(hits) > 0")
        covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda c: F.sequence(c["start"], c["start"] + c["size"] - 1)))))
        hits = stash(full.select(*same, covered.cast("long").alias("n_hit"), F.array_distinct(F.transform("hits", lambda c: c["window"])).alias("windows")).dropDuplicates(same))
        by_window = windows.groupBy("window").agg(F.collect_set("item_id").alias("items"))
        named = hits.select(*same, "n_hit", F.explode("windows").alias("window")).join(maybe_broadcast(by_window), "window")
        named = named.groupBy(*same, "n_hit").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        named = named.select(*[F.col(c).alias(f"k_{c}") for c in same], "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
        named = stash(named)
        out = out.join(maybe_broadcast(named), on, "left")
        nothing = {k: F.coalesce(F.col(k), v) for k, v in nothing.items()}
    out = out.select("doc_id", "n_words", *[v.alias(k) for k, v in nothing.items()])
    return out.withColumn("contaminated", F.col("n_hit") > 0)
