"""Exact dedup by content-defined chunk recipes, in SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import ascii_lower, maybe_broadcast, stash

#: A unit ends with a run of ASCII sentence or line ends, or after so many characters without one (a class with other characters takes ten times as long).
UNIT = r"[^\n.!?]{0,256}+[\n.!?]{1,256}+|[^\n.!?]{1,256}+"
#: A chunk ends after a unit of whose hash so many low bits are zero (one unit in 32), at the latest after MOST characters.
CUT_BITS = 5
MOST = 16384
#: Stands between chunks before they are split; texts that hold it themselves are one chunk.
MARK = "\uffff"


def with_chunks(rows: DataFrame) -> DataFrame:
    """rows with `chunks`: text cut where its content says; the chunks joined are the text, an empty text has none.

    Whether a unit ends a chunk rests on that unit alone, so an insertion moves the cuts around it and no others.
    Read the chunks by explode_outer: the filter that explode adds would work a text out again for each chunk.
    """
    ends = lambda x: F.xxhash64(x).bitwiseAND(F.lit((1 << CUT_BITS) - 1)) == 0
    marked = F.transform(F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)), lambda x: F.when(ends(x), F.concat(x, F.lit(MARK))).otherwise(x))
    cut = F.array_remove(F.split(F.array_join(marked, ""), MARK), "")
    cut = F.flatten(F.transform(cut, lambda c: F.when(F.length(c) <= MOST, F.array(c)).otherwise(F.regexp_extract_all(c, F.lit(f"(?s).{{1,{MOST}}}"), F.lit(0)))))
    return rows.withColumn("chunks", F.when(F.col("text").contains(MARK), F.array("text")).otherwise(cut))


def exact_dedup(docs: DataFrame, fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with
    the largest doc_id stays (null ids are smallest; of rows with the same id and text, one of them).

    A text's recipe is the ordered list of its chunks' fingerprints. Recipes are grouped first, so a text
    without a partner never moves. The chunks of the others are deduplicated within each task and then across
    tasks, which verifies the fingerprints: where different chunks share one, their number among these chunks
    becomes part of the identifier, and rows are equal when their ordered lists of verified identifiers are.
    A group of any size is one row of the aggregate, to which its rows are joined. Repeated rows give a row
    each, other columns are ignored, an empty table gives no rows.
    """
    rows = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("text"))
    cut = with_chunks(rows).select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.xxhash64("text").alias("pointer"), F.transform("chunks", lambda c: fingerprint(c)).alias("recipe"))
    recipes = stash(cut.withColumn("row", F.monotonically_increasing_id()))
    by_text = stash(recipes.groupBy("recipe", "pointer").agg(F.count("*").alias("n")))
    shared = by_text.groupBy("recipe").agg(F.sum("n").alias("n")).where("n > 1").select("recipe")
    pointers = stash(by_text.join(shared, "recipe", "left_semi").select("pointer").distinct())
    copies = rows.withColumn("pointer", F.xxhash64("text")).join(maybe_broadcast(pointers), "pointer", "left_semi")
    chunks = with_chunks(copies).select(F.explode_outer("chunks").alias("chunk")).where("chunk is not null").select(fingerprint(F.col("chunk")).alias("print"), "chunk").distinct()
    unclear = stash(chunks.groupBy("print").count().where("count > 1").select("print"))
    ids = recipes.select("row", "doc_id", "text_sha256", "recipe", F.array().cast("array<int>").alias("variants"))
    if not unclear.isEmpty():
        ids = _told_apart(rows, recipes, chunks, unclear, fingerprint, ids)
    same = ["recipe", "variants"]
    groups = ids.groupBy(*same).agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("top")).where("n > 1")
    out = ids.join(maybe_broadcast(stash(groups)), same, "left")
    alone = F.col("n").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("top.row") == F.col("row"))).alias("kept"),
        "text_sha256",
    )


def _told_apart(rows: DataFrame, recipes: DataFrame, chunks: DataFrame, unclear: DataFrame, fingerprint: Callable[[Column], Column], ids: DataFrame) -> DataFrame:
    """ids in which each row with an unclear fingerprint carries its chunks' variants: their places among the chunks of that fingerprint."""
    order = Window.partitionBy("print").orderBy("chunk")
    variants = stash(chunks.join(maybe_broadcast(unclear), "print", "left_semi").withColumn("variant", F.row_number().over(order)))
    touched = stash(recipes.select("row", "pointer", F.explode("recipe").alias("print")).join(maybe_broadcast(unclear), "print", "left_semi").select("row", "pointer").distinct())
    texts = rows.withColumn("pointer", F.xxhash64("text")).join(maybe_broadcast(touched.select("pointer").distinct()), "pointer", "left_semi")
    texts = stash(texts.withColumn("row", -1 - F.monotonically_increasing_id()))
    pieces = stash(with_chunks(texts).select("row", F.posexplode_outer("chunks").alias("pos", "chunk")).where("chunk is not null").withColumn("print", fingerprint(F.col("chunk"))))
    named = pieces.join(maybe_broadcast(variants), ["print", "chunk"], "left")
    listed = F.array_sort(F.collect_list(F.struct("pos", "print", F.coalesce("variant", F.lit(1)).alias("variant"))))
    named = named.groupBy("row").agg(listed.alias("ids"), F.count("variant").alias("hits")).where("hits > 0")
    told = named.join(texts, "row").select("row", "doc_id", F.sha2("text", 256).alias("text_sha256"), F.col("ids.print").alias("recipe"), F.col("ids.variant").alias("variants"))
    return ids.join(maybe_broadcast(touched.select("row")), "row", "left_anti").unionByName(stash(told))
