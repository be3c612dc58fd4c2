"""Best-fit packing by a configuration linear program over the length histogram.

Documents become token pieces of at most `capacity`. Their length histogram (at most `capacity` rows, so its
size is bounded whatever the input) goes to the driver, where multiplicative weights solve the configuration
LP: from the configurations of best fit on, lengths that are covered too little gain weight, and a knapsack
dynamic program over the capacity prices the best configurations with them, until the duality gap is under
one sequence. The fractional solution is rounded down to whole
configurations; the few pieces left are packed best fit, longest first, on the histogram. The plan (the
number of sequences of each configuration) is applied to the pieces by their rank within their length.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import stash

SALTS = 64
ROUNDS = 160
STEP = 0.5
#: Configurations of at least such a share of the best one's value are taken in a round.
WORTH = 0.9
_CACHE_WORDS = 300_000
#: Texts of a batch that are Python strings at once.
_TEXTS = 256
_LONG = 1 << 20
#: The splitting rule that _PART follows, as it stands in the tokenizer's file.
_RULE = json.dumps(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")[1:-1]


#: Text of these characters alone is cut by _PART as the tokenizer file's rule cuts it; other text goes to the tokenizer whole.
_PLAIN = "\t\n\r -~À-ÖØ-öø-ÿ"
_OTHER = re.compile(f"[^{_PLAIN}]")
_PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


class WordCache(dict):
    """Token ids of a tokenizer's parts as little-endian bytes; missing ones are asked from its model."""

    def __init__(self, path: str):
        super().__init__()
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        state = json.loads(self.tokenizer.to_str())
        self.known_rule = _RULE in json.dumps(state["pre_tokenizer"]) and [n.get("type") for n in (state["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]

    def __missing__(self, part: str) -> bytes:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        seen = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(seen)]
        out = self[part] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def encode(self, text: str) -> bytes:
        out = []
        for at in _chunks(text):
            if self.known_rule and "<|" not in at and not _OTHER.search(at):
                out.append(b"".join(map(self.__getitem__, _PART.findall(at.lower()))))
            else:
                out.append(np.array(self.tokenizer.encode(at, add_special_tokens=False).ids, "<u4").tobytes())
        return b"".join(out)


def _chunks(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > _LONG:
        cut = max(text.rfind(s, at, at + _LONG) for s in " \n\t\r\x0b\x0c")
        if cut <= at:
            m = re.compile(r"[ \t\n\x0b\x0c\r]").search(text, at + _LONG)
            if not m:
                break
            cut = m.start()
        yield text[at:cut]
        at = cut
    yield text[at:]


_caches: dict[str, WordCache] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _cut(name: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path(name) if "/" not in name else name
        cache = _caches.get(path) or _caches.setdefault(path, WordCache(path))
        end = np.array([end_id], "<u4").tobytes()
        for x in batches:
            rows: list[tuple] = []
            for some in (x.slice(i, _TEXTS) for i in range(0, x.num_rows, _TEXTS)):
                for d, t in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True):
                    ids = cache.encode(t or "") + end
                    for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        rows.append((d, i, at // 4, len(piece) // 4, zlib.crc32(piece)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=names)

    return run


def pieces_of(docs: DataFrame, capacity: int = 4096, tokenizer: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_cut(tokenizer, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _table(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the highest value of each room, and the last length taken (or -1)."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    ends = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if ends[c]:
            gains = best[c - lengths[: ends[c]]] + values[: ends[c]]
            k = int(gains.argmax())
            if gains[k] > best[c]:
                best[c], taken[c] = gains[k], k
    return best, taken


def _trace(lengths: np.ndarray, taken: np.ndarray, c: int) -> Counter:
    out: Counter = Counter()
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            out[int(taken[c])] += 1
            c -= int(lengths[taken[c]])
    return out


def price(lengths: np.ndarray, values: np.ndarray, capacity: int) -> Counter:
    """The configuration of the highest value."""
    return _trace(lengths, _table(lengths, values, capacity)[1], capacity)


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[Counter, float]], float, float]:
    """Configurations (of indexes of lengths) with their fractional numbers, the sum of these, and a lower bound.

    Multiplicative weights start from the configurations of best fit, so every length is covered at any time.
    A round prices once; from its table come the best configurations that hold each of the least covered
    lengths, none of which may raise a length's cover by more than a share of the least cover, which falls
    from STEP. The weights of each round, and their mean, bound the program from below. Rounds end when sum
    and bound are less than one sequence apart; else the gap is what the rounds leave.
    """
    index = {int(k): i for i, k in enumerate(lengths)}
    used: dict[tuple, float] = {}
    for pattern, n in best_fit({int(k): int(n) for k, n in zip(lengths, counts, strict=True)}, capacity):
        key = tuple(sorted(Counter(index[k] for k in pattern).items()))
        used[key] = used.get(key, 0) + n
    cover, bound = np.ones(len(lengths)), float(lengths @ counts) / capacity
    best, value = dict(used), sum(used.values())
    for small in range(1, capacity // 2 + 1):  # weights that no configuration can sum to more than 1 of
        bound = max(bound, float(np.where(lengths > capacity - small, 1, np.where(lengths < small, 0, lengths / capacity)) @ counts))
    mean = np.zeros(len(lengths))
    for t in range(rounds):
        if value - bound < 1:
            break
        pace = STEP / (1 + t / 8)  # of the least cover, so that early configurations fade
        step_up = pace * cover.min()
        values = np.exp(-(cover - cover.min()) / step_up) / counts
        values = values / values.max() + 1e-9 * lengths / capacity  # ties go to fuller configurations
        table, taken = _table(lengths, values, capacity)
        mean = mean * t / (t + 2) + values / table[capacity] * 2 / (t + 2)  # later weights count for more
        bound = max(bound, float(values @ counts) / table[capacity])
        if t % 8 == 7:
            bound = max(bound, float(mean @ counts) / _table(lengths, mean, capacity)[0][capacity])
        grown = np.zeros(len(lengths))
        worth = values + table[capacity - lengths]  # of the best configuration with each length
        for first in np.lexsort((-worth, cover)):
            if cover[first] > cover.min() + step_up or worth[first] < WORTH * table[capacity]:
                continue
            config = _trace(lengths, taken, capacity - int(lengths[first])) + Counter([int(first)])
            step = min((step_up - grown[i]) * counts[i] / n for i, n in config.items())
            if step <= 1e-9:
                continue
            key = tuple(sorted(config.items()))
            used[key] = used.get(key, 0) + step
            for i, n in config.items():
                cover[i] += n * step / counts[i]
                grown[i] += n * step / counts[i]
        low = cover.min()
        if sum(used.values()) / low < value:
            best, value = {k: x / low for k, x in used.items()}, sum(used.values()) / low
    return [(Counter(dict(k)), x) for k, x in best.items()], value, bound


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best fit, longest first, over equal bins at once: (lengths in order, number of such sequences)."""
    room: dict[int, list[tuple[list[int], int]]] = {}
    out = []
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            fits = [f for f in room if f >= length]
            free = min(fits) if fits else capacity
            if fits:
                pattern, bins = room[free].pop()
                if not room[free]:
                    del room[free]
            else:
                pattern, bins = [], n
            each = free // length
            if n >= each:
                take = min(bins, n // each)
            else:
                take, each = 1, n
            n -= take * each
            rest = free - each * length
            if fits and bins > take:
                room.setdefault(free, []).append((pattern, bins - take))
            if rest:
                room.setdefault(rest, []).append((pattern + [length] * each, take))
            else:
                out.append((pattern + [length] * each, take))
    return out + [x for group in room.values() for x in group]


def plan(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, number of such sequences); every piece is placed once."""
    whole = [([capacity], histogram[capacity])] if histogram.get(capacity) else []
    histogram = {k: n for k, n in histogram.items() if k != capacity}
    if not histogram:
        return whole
    greedy = best_fit(histogram, capacity)
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[k] for k in lengths], float)
    left, rounded = dict(histogram), []
    fullness = lambda x: -sum(int(lengths[i]) * n for i, n in x[0].items())
    for config, x in sorted(solve(lengths, counts, capacity, rounds)[0], key=fullness):
        times = min([int(x + 1e-6), *(left[int(lengths[i])] // n for i, n in config.items())])
        if times:
            rounded.append(([int(lengths[i]) for i, n in sorted(config.items(), reverse=True) for _ in range(n)], times))
            for i, n in config.items():
                left[int(lengths[i])] -= n * times
    rounded += best_fit({k: n for k, n in left.items() if n}, capacity)
    size = lambda p: sum(n for _, n in p)
    return whole + (rounded if size(rounded) <= size(greedy) else greedy)


def slots(packing: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, by rank: where a run of ranks begins, its first sequence, and the offset in the sequence."""
    out: dict[int, list] = {}
    used: Counter = Counter()
    base = 0
    for pattern, times in packing:
        at = 0
        for length in pattern:
            out.setdefault(length, []).append((used[length], base, at))
            used[length] += times
            at += length
        base += times
    return {k: tuple(np.array(c) for c in zip(*v, strict=True)) for k, v in out.items()}


def best_fit_packing(docs: DataFrame, capacity: int = 4096, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of a document.

    A document is its tokenizer ids and end_id; null and empty texts are end_id alone. Only documents over
    the capacity are cut, into pieces of it; the last may be shorter. Repeated rows are packed once for each;
    ids may be null; other columns are ignored; an empty table gives no rows. Within a sequence pieces lie
    without gaps. Equal pieces of equal documents may swap places between runs, nothing else may.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = stash(pieces_of(rows, capacity, tokenizer, end_id).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.when(F.col("length") == capacity, SALTS * SALTS).otherwise(SALTS)).cast("int")))
    sizes = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    by_length = Window.partitionBy("length").orderBy("salt")
    before = stash(sizes.select("length", "salt", "n", (F.sum("n").over(by_length) - F.col("n")).alias("before")))
    histogram = {r.length: r.n for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = docs.sparkSession.sparkContext.broadcast(slots(plan(histogram, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            length, rank = (x.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                starts, bases, offsets = places.value[int(length[own[0]])]
                at = np.searchsorted(starts, rank[own], "right") - 1
                seq[own], offset[own] = bases[at] + rank[own] - starts[at], offsets[at]
            yield pa.RecordBatch.from_arrays([*(x.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(F.broadcast(before.select("length", "salt", "before")), ["length", "salt"])  # at most (capacity + SALTS) * SALTS rows
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own") - 1).cast("long").alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
