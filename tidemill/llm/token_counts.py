"""Token counts kept by deltas: signed changes update additive totals, each batch committed once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import maybe_broadcast, stash

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_chars"]


def word_count(text: Column) -> Column:
    """Runs without ASCII white space."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    return F.when(F.length(trimmed) == 0, 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def letter_count(text: Column) -> Column:
    """ASCII letters, ASCII digits and every character outside ASCII are tokens of their own."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "")).cast("long")


#: Tokenizers by version.
TOKENIZERS = {"words-1": word_count, "letters-1": letter_count}


def counted(docs: DataFrame, tokenizers: dict | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens, n_chars, extra): each row of docs under each tokenizer version."""
    each = F.array(*[F.struct(F.lit(k).alias("tokenizer"), f(F.col("text")).alias("n_tokens")) for k, f in (tokenizers or TOKENIZERS).items()])
    rows = docs.select("doc_id", "source", "lang", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), *extra, F.explode(each).alias("t"))
    return rows.select("doc_id", "source", "lang", "t.tokenizer", "t.n_tokens", "n_chars", *extra)


def bpe_counted(docs: DataFrame, tokenizer: str, version: str) -> DataFrame:
    """Like counted(), under a tokenizer's vocabulary file."""
    from tidemill.llm.packing import WordCache, tokenizer_path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(tokenizer if "/" in tokenizer else tokenizer_path(tokenizer))
        for x in batches:
            n = [len(cache.encode(t or "")) // 4 for t in x.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(x.column(c) for c in ("doc_id", "source", "lang", "n_chars")), pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "n_chars", "n_tokens"])

    rows = docs.select("doc_id", "source", "lang", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "text")
    out = rows.mapInArrow(run, "doc_id long, source string, lang string, n_chars long, n_tokens long")
    return out.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), "n_tokens", "n_chars")


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums of changes by KEYS.

    changes: op ('insert', 'delete' or 'revise'), KEYS, n_tokens, n_chars, and for revisions old_n_tokens and
    old_n_chars (absent or null: 0). Other ops raise an error. Null keys are a group of their own; null
    counts are 0. The aggregate combines on the map side, so a hot source is no hot task.
    """
    old = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in changes.columns else F.lit(0)
    new = lambda c: F.coalesce(F.col(c), F.lit(0))
    op = F.col("op")
    sign = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce(op, F.lit("null")))).cast("int"))
    change = lambda c: F.when(op == "revise", new(c) - old(f"old_{c}")).otherwise(sign * new(c))
    rows = changes.select(*KEYS, sign.alias("n_docs"), change("n_tokens").alias("n_tokens"), change("n_chars").alias("n_chars"))
    return rows.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS])


class Rollup:
    """Totals as committed batches of deltas under a shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, batch: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/batch={batch}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch once: False if it is there already; a half-written one is written anew."""
        fs, mark = self._path(batch)
        if fs.exists(mark):
            return False
        deltas(changes).write.mode("overwrite").parquet(f"{self.root}/batch={batch}")
        return True

    def committed(self) -> list[str]:
        """Folders of the batches that are marked as whole."""
        fs, _ = self._path("")
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/batch=*/_SUCCESS")
        return sorted(f"{s.getPath().getParent()}" for s in fs.globStatus(root) or [])

    def totals(self) -> DataFrame:
        """KEYS and SUMS of all committed batches; groups without documents and tokens are left out.

        Batches that are half-written or failed don't count; without any there are no rows.
        """
        kinds = ", ".join(f"{c} {'string' if c in KEYS else 'long'}" for c in [*KEYS, *SUMS])
        paths = self.committed()
        rows = self.spark.read.schema(kinds).parquet(*paths) if paths else self.spark.createDataFrame([], kinds)
        out = rows.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS])
        return out.where(" or ".join(f"{c} <> 0" for c in SUMS))


def counted_copies(docs: DataFrame) -> DataFrame:
    """counted() of the rows that repeat the text of a smaller id of the same source and lang (by SHA-256)."""
    keyed = docs.select("doc_id", "source", "lang", "text", F.sha2("text", 256).alias("digest"))
    first = keyed.where("digest is not null").groupBy("source", "lang", "digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stash(first.select(F.col("source").alias("k_source"), F.col("lang").alias("k_lang"), F.col("digest").alias("k_digest"), "first"))
    same = F.col("source").eqNullSafe(F.col("k_source")) & F.col("lang").eqNullSafe(F.col("k_lang")) & (F.col("digest") == F.col("k_digest"))
    rows = counted(keyed, extra=("digest",)).join(maybe_broadcast(first), same)
    return rows.where("doc_id > first").select("doc_id", *KEYS, "n_tokens", "n_chars")


def token_counts(docs: DataFrame, root: str) -> DataFrame:
    """Totals after four commits: all rows inserted with a first estimate of their tokens, the same batch delivered
    again, every count revised to the tokenizer version's own, and later copies deleted.

    The estimate is a token for every four characters. A row is one document whatever its id, so repeated rows count
    each, unless they repeat the text, source and language of a smaller id; null ids are never copies. Null texts
    have no tokens. Null sources and languages are groups of their own. Other columns are ignored; an empty table
    gives no rows. A run again under the same root finds its batches committed and changes nothing.
    """
    rollup = Rollup(docs.sparkSession, root)
    estimated = counted(docs, {k: lambda text: F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4) for k in TOKENIZERS}).withColumn("op", F.lit("insert"))
    rollup.commit("0-insert", estimated)
    rollup.commit("0-insert", estimated)
    exact = counted(docs).withColumn("old_n_tokens", F.ceil(F.col("n_chars") / 4)).withColumn("old_n_chars", F.col("n_chars"))
    rollup.commit("1-exact", exact.withColumn("op", F.lit("revise")))
    rollup.commit("2-copies", counted_copies(docs).withColumn("op", F.lit("delete")))
    return rollup.totals()
