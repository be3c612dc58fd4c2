"""Language ID: each document as a mixture of languages, by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hash buckets of character trigrams: the model's size is languages * BUCKETS whatever the corpus.
BUCKETS = 1 << 15
#: Most languages that a model may have; more raise an error.
MOST_LANGUAGES = 256
#: Trigrams overlap, so three of them count as one observation in the penalty.
OBSERVATION = 3
_LONG = 1 << 20
_OTHER = re.compile(r"[\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and counts of the letter trigrams of a whole text; None if it has no letter."""
    if not text:
        return None
    found, total = False, None
    for at in range(0, len(text), _LONG):
        low = _OTHER.sub(" ", text[max(0, at - 2) : at + _LONG].lower())
        found = found or any(map(str.isalpha, low))
        a = np.frombuffer(f" {low} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        h = (a[:-2] * np.uint64(0x9E3779B97F4A7C15) + a[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) + a[2:]
        h = (h * np.uint64(0x94D049BB133111EB)) >> np.uint64(49)
        if len(text) <= _LONG:
            if not found:
                return None
            u, n = np.unique(h.astype(np.int64), return_counts=True)
            return u, n.astype(float)
        c = np.bincount(h.astype(np.int64), minlength=BUCKETS)
        total = c if total is None else total + c
    u = np.flatnonzero(total)
    return (u, total[u].astype(float)) if found else None


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for x in batches:
        for lang, text in zip(x.column("lang").to_pylist(), x.column("text").to_pylist(), strict=True):
            if (g := grams(text)) is not None:
                t = totals.get(lang)
                if t is None:
                    t = totals[lang] = np.zeros(BUCKETS)
                t[g[0]] += g[1]
    for lang, t in totals.items():
        u = np.flatnonzero(t)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u.astype(np.int32)), pa.array(t[u].astype(np.int64))], names=["lang", "bucket", "n"])


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram probabilities (buckets x languages), counted over every labelled document."""
    counts = docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(_count, "lang string, bucket int, n long")
    summed = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list("bucket").alias("u"), F.collect_list("n").alias("n"))
    rows = sorted(summed.limit(MOST_LANGUAGES + 1).collect(), key=lambda r: r.lang)
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    table = np.full((BUCKETS, len(rows)), 0.5)
    for i, r in enumerate(rows):
        table[r.u, i] += r.n
    return [r.lang for r in rows], table / table.sum(0)


def mixture(p: np.ndarray, n: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Proportions of the languages (columns of p) and the log-likelihood, by expectation-maximisation."""
    if p.shape[1] == 1:
        return np.ones(1), float(n @ np.log(p[:, 0]))
    share, total = np.full(p.shape[1], 1 / p.shape[1]), n.sum()
    for _ in range(rounds):
        new = share * ((n / (p @ share)) @ p) / total
        done = np.abs(new - share).max() < 1e-3
        share = new
        if done:
            break
    return share, float(n @ np.log(p @ share))


def infer(p: np.ndarray, n: np.ndarray) -> dict[int, float]:
    """The language set of the highest penalised likelihood, with proportions."""
    share, _ = mixture(p, n, 8 if p.shape[1] > 1 else 1)
    order = np.argsort(-share, kind="stable")
    penalty = 0.5 * np.log(max(2.0, n.sum() / OBSERVATION)) * OBSERVATION
    best, chosen = -np.inf, {}
    for size in range(1, len(order) + 1):
        own = order[:size]
        part, fit = mixture(p[:, own], n)
        if (value := fit - penalty * (size - 1)) <= best:
            break
        best, chosen = value, dict(zip(own.tolist(), part.tolist(), strict=True))
        if share[own].sum() > 0.995:
            break
    return chosen


def detect(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """All columns of docs and held_out, lang_pred, score, n_languages (columns of these names are replaced).

    The model learns from `labelled` (docs by default): rows with text, a lang and an id whose crc32 mod 3
    is not 1. A prediction sees the text alone. lang_pred is the language of the largest proportion in the
    set chosen by penalised likelihood, score its proportion; ties go to the language first by name. Null
    texts and texts without a letter are `und` with score 0, as is everything if nothing could be learned.
    Null ids are never held out and teach nothing. Repeated rows each give a row.
    """
    source = docs if labelled is None else labelled
    langs, p = train(source.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    model = docs.sparkSession.sparkContext.broadcast((langs, p))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, p = model.value
        for x in batches:
            out = []
            for text in x.column("text").to_pylist():
                g = grams(text) if langs else None
                if g is None:
                    out.append(("und", 0.0, 0))
                    continue
                found = infer(p[g[0]], g[1])
                k = max(sorted(found), key=found.get)
                out.append((langs[k], min(1.0, max(0.0, found[k])), len(found)))
            pred, score, size = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(size, pa.int32())], names=[*x.schema.names, "lang_pred", "score", "n_languages"])

    rows = docs.drop("held_out", "lang_pred", "score", "n_languages").withColumn("held_out", held_out(F.col("doc_id")))
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_languages", T.IntegerType())])
    return rows.mapInArrow(predict, schema)


def language_id(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_languages for every row of docs; see detect()."""
    found = detect(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), docs if labelled is None else labelled)
    return found.select("doc_id", "held_out", "lang_pred", "score", "n_languages")
