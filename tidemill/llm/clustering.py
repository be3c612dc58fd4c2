"""Centroid clustering in integers: dictionaries of distinct subvectors, whose partial distances are summed by code."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import BROADCAST_BYTES, stash

#: Widths of a dimension block, widest first; the widest whose dictionaries are small enough is taken.
WIDTHS = (16, 8, 4, 2, 1)
#: A width is worth its dictionaries if they hold at most this share of the (vector, block) pairs; width 1 always may.
SHARE = 0.25
#: Scaled components lie within this bound, so that a squared distance of 64 of them fits in 63 bits.
LARGEST = 1 << 27


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _lists(values: np.ndarray) -> pa.Array:
    """A matrix as lists of its rows."""
    n, width = values.shape
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, pa.array(values.reshape(-1)))


class Keys:
    """Lossless keys of subvectors: the places of a block's values among their dimensions' values, as one number in mixed radix."""

    def __init__(self, values: list[np.ndarray], width: int):
        self.values, self.width, self.blocks = values, width, len(values) // width
        self.size = np.array([len(own) for own in values])

    def fit(self) -> bool:
        """Whether every block's keys fit in 62 bits."""
        return all(sum(float(np.log2(x)) for x in own) < 62 for own in self.size.reshape(self.blocks, -1))

    def of(self, vectors: np.ndarray) -> np.ndarray:
        places = np.stack([np.searchsorted(own, vectors[:, i]) for i, own in enumerate(self.values)], axis=1).astype(np.int64)
        out = places[:, :: self.width]
        for i in range(1, self.width):
            out = out * self.size[i :: self.width] + places[:, i :: self.width]
        return out

    def back(self, block: int, keys: np.ndarray) -> np.ndarray:
        """The subvectors of a block's keys."""
        out = np.empty((len(keys), self.width), np.int64)
        for i in reversed(range(self.width)):
            at = block * self.width + i
            keys, place = np.divmod(keys, self.size[at])
            out[:, i] = self.values[at][place]
        return out


def scaled(vectors: DataFrame, scale: int, dims: int) -> DataFrame:
    """(vec_id, v) of the vectors with exactly `dims` components, none null or non-finite; v is floor(scale * x) as long."""
    x = F.col("embedding")
    whole = vectors.select("vec_id", F.transform(x, lambda c: c.cast("double")).alias("embedding")).where(F.size("embedding") == dims)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    far = F.raise_error(F.lit(f"a scaled component is beyond {LARGEST}: squared distances don't fit"))
    number = lambda c: F.when(F.abs(F.lit(float(scale)) * c) <= LARGEST, F.floor(F.lit(float(scale)) * c)).otherwise(far.cast("long"))
    return whole.where(~bad).select("vec_id", F.transform(x, number).alias("v"))


def _distinct(ints: DataFrame, dims: int, blocks: int, find, most: float) -> list[np.ndarray] | None:
    """The sorted distinct numbers of each block, or None if there are more than `most`; find turns vectors into a column of numbers a block."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find(_matrix(batch.column(0), dims))
            for b in range(blocks):
                own = np.unique(found[:, b])
                yield pa.record_batch([pa.array(np.full(len(own), b, np.int32)), pa.array(own)], names=["block", "key"])

    every = ints.select("v").mapInArrow(listed, "block int, key long")
    if every.agg(F.approx_count_distinct(F.struct("block", "key"), 0.02)).first()[0] > 1.1 * most:
        return None
    every = stash(every.distinct())
    if every.count() > most:
        return None
    rows = every.orderBy("block", "key").toPandas()
    return [rows.key.to_numpy()[rows.block.to_numpy() == b] for b in range(blocks)]


def choose(ints: DataFrame, dims: int, k: int, limit: int) -> tuple[Keys, list[np.ndarray]] | None:
    """The widest keys with small dictionaries, and these (sorted keys of each block); None where even those of single dimensions are beyond `limit` bytes with k distances each."""
    entries = lambda width: limit // (8 * (width + 1 + k))
    values = _distinct(ints, dims, dims, lambda v: v, entries(1))
    if values is None:
        return None
    n = ints.count()
    for width in WIDTHS:
        keys = Keys(values, width) if dims % width == 0 else None
        if keys and keys.fit() and width > 1:
            known = _distinct(ints, dims, keys.blocks, keys.of, min(entries(width), n * keys.blocks * SHARE))
            if known is not None:
                return keys, known
    return Keys(values, 1), [np.arange(len(own)) for own in values]


class Broadcast:
    """Assignment where the dictionaries are within the bound of bytes: each task looks up its vectors' codes."""

    def __init__(self, ints: DataFrame, keys: Keys, known: list[np.ndarray], dims: int):
        self.spark, self.keys, self.dims, self.known = ints.sparkSession, keys, dims, known
        self.subvectors = [keys.back(b, own) for b, own in enumerate(known)]
        sent = self.spark.sparkContext.broadcast(known)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = keys.of(_matrix(batch.column(1), dims))
                codes = np.stack([np.searchsorted(own, found[:, b]) for b, own in enumerate(sent.value)], axis=1).astype(np.int32)
                yield pa.record_batch([batch.column(0), _lists(codes)], names=["vec_id", "codes"])

        self.codes = stash(ints.mapInArrow(encode, f"vec_id {ints.schema['vec_id'].dataType.simpleString()}, codes array<int>"))

    def _nearest(self, centroids: np.ndarray):
        """A function from a batch's codes to clusters and distances; each distinct subvector's distances are worked out here, once."""
        width, blocks = self.keys.width, self.keys.blocks
        partial = [((own[:, None, :] - centroids[None, :, b * width : (b + 1) * width]) ** 2).sum(axis=2) for b, own in enumerate(self.subvectors)]
        sent = self.spark.sparkContext.broadcast(partial)

        def nearest(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            total = np.zeros((len(codes), len(centroids)), np.int64)
            for b, own in enumerate(sent.value):
                total += own[codes[:, b]]
            cluster = total.argmin(axis=1)  # the first of equal ones
            return cluster, total[np.arange(len(total)), cluster]

        nearest.blocks, nearest.sent = blocks, sent
        return nearest

    def sums(self, centroids: np.ndarray) -> list[tuple[int, int, list[int]]]:
        """(cluster, count, sums of components): tasks add up the subvectors of their vectors, Spark adds up the tasks."""
        nearest, k = self._nearest(centroids), len(centroids)
        sub, dims, width = self.spark.sparkContext.broadcast(self.subvectors), self.dims, self.keys.width

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
            for batch in batches:
                codes = _matrix(batch.column(0), nearest.blocks)
                cluster, _ = nearest(codes)
                count += np.bincount(cluster, minlength=k)
                for b, own in enumerate(sub.value):
                    np.add.at(total[:, b * width : (b + 1) * width], cluster, own[codes[:, b]])
            yield pa.record_batch([pa.array(np.arange(k, dtype=np.int32)), pa.array(count), _lists(total)], names=["cluster", "n", "s"])

        parts = self.codes.select("codes").mapInArrow(add, "cluster int, n long, s array<long>").where("n > 0")
        found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", i).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]).collect()
        nearest.sent.unpersist()
        sub.unpersist()
        return [(r.cluster, r.n, [int(r[f"s{i}"]) for i in range(dims)]) for r in found]

    def assigned(self, centroids: np.ndarray) -> DataFrame:
        """(vec_id, cluster, distance) of every vector."""
        nearest = self._nearest(centroids)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cluster, distance = nearest(_matrix(batch.column(1), nearest.blocks))
                yield pa.record_batch([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

        return self.codes.mapInArrow(assign, f"vec_id {self.codes.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


class Joined:
    """Assignment where the dictionaries are larger: codes are rows that meet their partial distances in a join."""

    def __init__(self, ints: DataFrame, dims: int, width: int):
        self.dims, self.width = dims, width
        self.rows = stash(ints.withColumn("row", F.monotonically_increasing_id()))
        cut = F.transform(F.sequence(F.lit(0), F.lit(dims // width - 1)), lambda b: F.slice("v", b * width + 1, F.lit(width)))
        self.codes = stash(self.rows.select("row", F.posexplode(cut).alias("block", "sub")))
        self.dictionary = stash(self.codes.select("block", "sub").distinct())

    def assigned(self, centroids: np.ndarray, keep: str = "vec_id") -> DataFrame:
        """(vec_id, cluster, distance) of every vector: dictionary by centroid, codes by dictionary, sums by vector."""
        k, width = len(centroids), self.width
        table = F.array(*[F.array(*[F.array(*[F.lit(int(x)).cast("long") for x in c[b * width : (b + 1) * width]]) for c in centroids]) for b in range(self.dims // width)])
        own = lambda c: F.aggregate(F.zip_with("sub", c, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda a, x: a + x)
        partial = self.dictionary.select("block", "sub", F.transform(F.get(table, F.col("block")), own).alias("d"))
        total = self.codes.join(partial, ["block", "sub"]).groupBy("row").agg(*[F.sum(F.get("d", i)).alias(f"d{i}") for i in range(k)])
        best = F.array_min(F.array(*[F.struct(F.col(f"d{i}").alias("distance"), F.lit(i).alias("cluster")) for i in range(k)]))
        return self.rows.join(total.select("row", best.alias("best")), "row").select(keep, F.col("best.cluster").alias("cluster"), F.col("best.distance").alias("distance"))

    def sums(self, centroids: np.ndarray) -> list[tuple[int, int, list[int]]]:
        found = self.assigned(centroids, "v").groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("v", i).cast("decimal(38,0)")).alias(f"s{i}") for i in range(self.dims)]).collect()
        return [(r.cluster, r.n, [int(r[f"s{i}"]) for i in range(self.dims)]) for r in found]


def centroid_clustering(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64, salt: int = 3, limit: int = BROADCAST_BYTES) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every kept vector.

    Kept are vectors of exactly `dims` components, none null or non-finite, scaled to integers; all arithmetic
    is exact (a scaled component beyond 2^27 raises an error, as distances would not fit in 63 bits).
    Centroids start as the k kept vectors with the smallest SHA-256 of `salt:vec_id` (null ids last; of equal
    ids, the smaller vector first; with fewer kept vectors there are fewer centroids). Each round assigns every
    vector to the nearest centroid (ties: the smaller number) and moves non-empty centroids to the floor of
    their mean; then all vectors are assigned once more.

    Blocks of dimensions are encoded losslessly as codes into their distinct subvectors; a round works out the
    distances of each distinct subvector once and sums them by code. The block's width is the widest of WIDTHS whose
    dictionaries are small against the vectors and within `limit` bytes, which are broadcast; beyond it codes and
    dictionaries meet in a join. Results don't depend on the width. Repeated rows each count and give a row,
    other columns are ignored, no kept vectors give no rows.
    """
    ints = stash(scaled(vectors, scale, dims))
    first = ints.withColumn("h", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)).orderBy(F.col("h").asc_nulls_last(), "v").limit(k)
    centroids = np.array([r.v for r in first.collect()], np.int64).reshape(-1, dims)
    if not len(centroids):
        none = ints.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return none.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    chosen = choose(ints, dims, len(centroids), limit)
    held = Broadcast(ints, *chosen, dims) if chosen else Joined(ints, dims, max(w for w in WIDTHS if dims % w == 0))
    for _ in range(rounds):
        for cluster, n, total in held.sums(centroids):
            centroids[cluster] = [x // n for x in total]
    out = stash(held.assigned(centroids))
    inertia = {r.cluster: r.s for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    about = [(i, inertia[i], sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist()) if i in inertia]
    each = out.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row for each centroid
    return out.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
