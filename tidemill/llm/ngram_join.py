"""N-gram Jaccard join by a partition of the token universe and the pigeonhole principle.

Every document is the set of its distinct k-word shingles, held as 64-bit hashes. Sizes fall into bands
whose ends differ by the similarity at most, so partners lie in the same or the next band. A band's pairs
differ in at most H shingles. The shingle universe is hashed into segments worth more than H units: an
``exact`` segment is one unit, which a difference can spoil; a ``deletion`` segment, of which every
one-deletion neighbour is indexed too, is two. A band's exact and deletion segments are chosen by the cost of index
rows against chance collisions, and half as many exact ones again are laid out to spare.

Which units a set probes is allocated by counted posting lists: signatures that no other set holds cost
nothing, and of the others a set takes its rarest until H + 1 units are filled, those of deletion segments
first. All sets take them in one order, so a qualifying pair, which shares all units but H, shares one that
both took. A set with H + 1 units of its own has no partner. Empty and frequent segments are skipped so.

Every bucket of what was taken first gives a star to its most central member; then, where these links left
members in different components, small buckets give their other pairs, and in larger ones the sets outside the
bucket's main component meet the rest, block by block. Of the pairs that a parity sketch of the difference can't
rule out, each component gives its closest few, and more in further rounds until nothing was held back.
Candidates are verified on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import components, maybe_broadcast, stash

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_PIECE = 1 << 20
#: Bits of a set's parity sketch.
BITS = 1024
#: Posting lists are counted up to so many sets; longer ones rank alike.
MANY = 1 << 16
#: Buckets of up to so many documents give all their pairs at once.
SMALL_BUCKET = 8
#: Sets outside a large bucket's main component that meet all others in one block.
BLOCK = 2048
#: Pairs that a component gives in a block in the first round, and how this grows from round to round.
CLOSEST, MORE = 4, 8


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = _PIECE
    while size < n:
        size *= 2
    if size not in _powers:
        if size > _PIECE:
            _powers.pop(max(_powers), None) if len(_powers) > 1 else None
        inverse = pow(int(_BASE), -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers[size] = tuple(np.cumprod(np.concatenate(([_U(1)], np.full(size, _U(b), np.uint64))), dtype=np.uint64) for b in (int(_BASE), inverse))
    return _powers[size]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of UTF-8 bytes (A-Z lower-cased, cut at ASCII white space), and their starts."""
    b = _LOWER[np.frombuffer(data, np.uint8)]
    w = np.zeros(len(b) + 2, np.int8)
    w[1:-1] = ~_SPACE[b]
    d = np.diff(w)
    starts, ends = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
    up, down = _power(len(b))
    c = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[: len(b)], out=c[1:])
    return mix((c[ends] - c[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(0xA24BAED4963EE407)), starts


def _pieces(data: bytes) -> Iterator[bytes]:
    """Cut long texts at white space so that memory stays bounded by the piece and not by the text."""
    at = 0
    while len(data) - at > _PIECE:
        cut = max(data.rfind(s, at, at + _PIECE) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= at:
            after = [x for x in (data.find(s, at + 1) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if x > 0]
            if not after:
                break
            cut = min(after)
        yield data[at:cut]
        at = cut
    yield data[at:]


def _sets(words: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; of the whole sequence if it is shorter; empty without words."""
    if not len(words):
        return words
    n = min(k, len(words))
    s = np.full(len(words) - n + 1, _U((seed * 0x51ED270B + n) % (1 << 64)), np.uint64)
    for i in range(n):
        s = mix(s * _U(0x9FB21C651E98DF25) + words[i : len(words) - n + 1 + i])
    return np.unique(s)


def text_sets(texts: list[str | None], k: int, seed: int = 0) -> Iterator[np.ndarray]:
    """The shingle set of each text; texts are hashed many at a time."""
    empty = np.zeros(0, np.uint64)
    pending: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        if not pending:
            return
        offsets = np.cumsum([0, *(len(x) + 1 for x in pending)])
        h, starts = word_hashes(b" ".join(pending))
        cuts = np.searchsorted(starts, offsets)
        for i in range(len(pending)):
            yield _sets(h[cuts[i] : cuts[i + 1]], k, seed)

    for t in texts:
        data = t.encode("utf-8", "surrogatepass") if t else b""
        if size + len(data) > _PIECE:
            yield from flush()
            pending, size = [], 0
        if len(data) > _PIECE:
            yield _sets(np.concatenate([empty, *(word_hashes(p)[0] for p in _pieces(data))]), k, seed)
        else:
            pending.append(data)
            size += len(data) + 1
    yield from flush()


def _node(s: np.ndarray) -> tuple[int, int]:
    """128-bit digest of a set as two signed longs."""
    a = mix(np.array([s.sum(dtype=np.uint64) + _U(len(s))]))
    b = mix(np.array([mix(s ^ _BASE).sum(dtype=np.uint64)]))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def _sketch(s: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of items fall into bin i; two sketches differ in no more bits than sets in items."""
    odd = np.bincount((s >> _U(54)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _fine(s: np.ndarray) -> bytes | None:
    """A histogram of about 8 to 16 items a bin; None where the plain one is as fine."""
    bits = min(20, (len(s) // 16).bit_length())
    if bits <= 6:
        return None
    return np.minimum(np.bincount((s >> _U(64 - bits)).astype(np.int64), minlength=1 << bits), 65535).astype("<u2").tobytes()


def _overlap(p: bytes, q: bytes) -> int | None:
    """The most that two fine histograms' sets can share, by the coarser one's bins; None if a bin is full."""
    x, y = sorted((np.frombuffer(h, "<u2") for h in (p, q)), key=len)
    if (x == 65535).any() or (y == 65535).any():
        return None
    return int(np.minimum(x, y.reshape(len(x), -1).sum(1, dtype=np.int64)).sum(dtype=np.int64))


def bands(longest: int, num: int, den: int) -> list[tuple[int, int]]:
    """Size bands (low, high): partners of a set lie in its own band or in a neighbouring one."""
    out, low = [], 1
    while low <= longest:
        high = low * den // num
        out.append((low, high))
        low = high + 1
    return out


def allocate(low: int, high: int, rows: int, num: int, den: int) -> tuple[int, int]:
    """(exact, deletion) segments of a band at the least expected cost; (0, 0) if no two sets can differ."""
    budget = 2 * high * (den - num) // (den + num)
    if not budget:
        return 0, 0
    share = math.sqrt(low * high) / (budget + 1)  # shingles of a document in one share of the universe

    def cost(deletion: int) -> float:
        exact = budget + 1 - 2 * deletion
        index = exact + deletion * (1 + 2 * share)
        chance = exact * math.exp(-2 * share) + deletion * (1 + 4 * share) * math.exp(-4 * share)
        return rows * index + 0.05 * rows * rows * chance

    best = min(range((budget + 1) // 2 + 1), key=cost)
    return budget + 1 - 2 * best, best


def spare(units: int) -> int:
    """Exact segments laid out beyond the units that a set must probe."""
    return (units + 1) // 2


def _signatures(s: np.ndarray, band: int, exact: int, deletion: int, units: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set under a band's scheme, and tags of (band, kind, number of signatures that may be skipped).

    Kind 0 are whole segments, empty ones only as far as the others are fewer than must be probed. Kind 1 are
    deletion segments with all their one-deletion neighbours, of which none may be skipped.
    """
    h = mix(s ^ _U(0xC2B2AE3D27D4EB4F))
    q = ((h >> _U(32)) * _U(exact + 2 * deletion) >> _U(32)).astype(np.int64)
    seg = np.where(q < exact, q, exact + (q - exact) // 2)
    total, held = np.zeros(exact + deletion, np.uint64), np.bincount(seg, minlength=exact + deletion)
    np.add.at(total, seg, h)
    salt = mix(np.arange(exact + deletion, dtype=np.uint64) + _U(band << 32))
    own = mix(total ^ salt)
    must = units - deletion
    whole = own[held > 0]
    if len(whole) < must:
        whole = np.concatenate((whole, np.sort(own[held == 0])[: must - len(whole)]))
    tags = np.full(len(whole), (band << 33) + len(whole) - must, np.int64)
    if not deletion:
        return whole, tags
    i, apart = seg >= exact, mix(salt)
    near = np.concatenate((mix(total[exact:] ^ apart[exact:]), mix((total[seg[i]] - h[i]) ^ apart[seg[i]])))
    return np.concatenate((whole, near)), np.concatenate((tags, np.full(len(near), (band << 33) + (1 << 32), np.int64)))


def _describe(k: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = [(len(s), *_node(s), _sketch(s), _fine(s)) if len(s) else (0, 0, 0, None, None) for s in text_sets(x.column("text").to_pylist(), k, seed)]
            n, d1, d2, sketch, fine = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sketch, pa.binary()), pa.array(fine, pa.binary())], names=["doc_id", "n", "node", "check", "sketch", "fine"])

    return run


def _index(k: int, seed: int, plan: list[tuple[int, int, int, int, int]]):
    """plan: (low, high, exact, deletion, units to probe) of each band."""
    lows = np.array([p[0] for p in plan] or [1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within the task give their signatures once

        def out(held):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=["sig", "node", "tag"])

        for x in batches:
            held, size = [], 0
            for s in text_sets(x.column("text").to_pylist(), k, seed):
                if not len(s) or (node := _node(s)[0]) in seen:
                    continue
                seen.add(node)
                own = int(np.searchsorted(lows, len(s), "right")) - 1
                for b in (own, own + 1):
                    if b < len(plan) and plan[b][4]:
                        sig, tag = _signatures(s, b, *plan[b][2:])
                        held.append((sig.view(np.int64), np.full(len(sig), node, np.int64), tag))
                        size += len(sig)
                if size > 200_000:
                    yield out(held)
                    held, size = [], 0
            if held:
                yield out(held)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, node, tag) in order: those of signatures that several nodes hold, once each, with the number of nodes up to MANY."""
    empty = np.zeros(0, np.int64)
    held, hot = (empty, empty, empty), None  # the last signature, which may go on; one that is over MANY already

    def rows(sig, node, tag, size):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (sig, node, tag, size)], names=["sig", "node", "tag", "size"])

    def handle(sig, node, tag):
        first = np.ones(len(sig), bool)
        first[1:] = sig[1:] != sig[:-1]
        sizes = np.diff(np.append(np.flatnonzero(first), len(sig)))
        size = np.minimum(np.repeat(sizes, sizes), MANY)
        live = size > 1
        return rows(sig[live], node[live], tag[live], size[live])

    last = None  # row before this batch
    for x in batches:
        sig, node, tag = (x.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(sig):
            continue
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        fresh[0] = last != (int(sig[0]), int(node[0]))
        last = (int(sig[-1]), int(node[-1]))
        sig, node, tag = sig[fresh], node[fresh], tag[fresh]
        if hot is not None:
            n = int((sig == hot).sum())
            if n:
                yield rows(sig[:n], node[:n], tag[:n], np.full(n, MANY))
            sig, node, tag = sig[n:], node[n:], tag[n:]
            if not len(sig):
                continue
            hot = None
        sig, node, tag = (np.concatenate(c) for c in zip(held, (sig, node, tag), strict=True))
        if not len(sig):
            continue
        cut = int(np.argmax(sig == sig[-1]))  # equal signatures stand together
        yield handle(sig[:cut], node[:cut], tag[:cut])
        held = sig[cut:], node[cut:], tag[cut:]
        if len(sig) - cut > MANY:
            yield rows(*held, np.full(len(sig) - cut, MANY))
            hot, held = int(sig[-1]), (empty, empty, empty)
    if len(held[0]):
        yield handle(*held)


def _pair_batch(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.unique(np.stack((a, b), 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return p[:, 0], p[:, 1]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, node) in order of sig, once each: kind 0 pairs of a bucket's first node and another, kind 2 the other
    pairs of buckets up to SMALL_BUCKET, kind 1 (sig, node) of larger buckets."""
    sig0, node0 = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of the last bucket, which may go on
    hot: tuple[int, int] | None = None  # the last bucket and its first node, if it is large already

    def handle(sig, node):
        first = np.ones(len(sig), bool)
        first[1:] = sig[1:] != sig[:-1]
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(sig)))
        size, hub = np.repeat(sizes, sizes), np.repeat(node[starts], sizes)
        live = size > 1
        sig, node, size, hub = sig[live], node[live], size[live], hub[live]
        few, star = size <= SMALL_BUCKET, node != hub
        yield _pair_batch(0, *_unique_pairs(hub[star], node[star]))
        s, n, z = sig[few], node[few], hub[few]
        for d in range(1, SMALL_BUCKET):
            same = (s[d:] == s[:-d]) & (n[:-d] != z[:-d])
            if same.any():
                x, y = n[:-d][same], n[d:][same]
                yield _pair_batch(2, *_unique_pairs(np.minimum(x, y), np.maximum(x, y)))
        if not few.all():
            yield _pair_batch(1, sig[~few], node[~few])

    for x in batches:
        sig, node = (x.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if hot is not None and len(sig):
            n = int((sig == hot[0]).sum())
            if n:
                yield _pair_batch(0, np.full(n, hot[1]), node[:n])
                yield _pair_batch(1, np.full(n, hot[0]), node[:n])
            sig, node = sig[n:], node[n:]
            if not len(sig):
                continue
            hot = None
        sig, node = np.concatenate((sig0, sig)), np.concatenate((node0, node))
        if not len(sig):
            continue
        cut = int(np.argmax(sig == sig[-1]))
        if len(sig) - cut > SMALL_BUCKET:
            yield from handle(sig, node)
            hot, sig0, node0 = (int(sig[-1]), int(node[cut])), sig[:0], node[:0]
        else:
            if cut:
                yield from handle(sig[:cut], node[:cut])
            sig0, node0 = sig[cut:], node[cut:]
    if len(sig0):
        yield from handle(sig0, node0)


def _possible(na, nb, sa, sb, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """False where sizes or sketches rule a link out: sets differ in as many items at least as their sketches in bits.
    With it, how far pairs seem to be apart."""
    differ = np.bitwise_count(sa ^ sb).sum(-1, dtype=np.int64)
    twice = np.minimum(na + nb - differ, 2 * np.minimum(na, nb))  # the overlap at most
    return den * twice >= num * (2 * (na + nb) - twice), 1 - twice / (na + nb)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _sieve(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                c = {n: x.column(n) for n in x.schema.names}
                keep = _possible(*(c[n].to_numpy(zero_copy_only=False) for n in ("na", "nb")), *(_matrix(c[n]) for n in ("sa", "sb")), num, den)[0]
                yield x.select(["a", "b"]).filter(pa.array(keep))

    return run


def _fine_sieve(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            for na, nb, p, q in zip(*(x.column(c).to_pylist() for c in ("na", "nb", "fa", "fb")), strict=True):
                top = _overlap(p, q) if p and q else None
                keep.append(top is None or den * top >= num * (na + nb - top))
            yield x.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _closest(held: list, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (component, distance, a, b, whether some were held back) the closest of each component."""
    comp, far, a, b, cut = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.lexsort((b, a, far, comp))
    comp, far, a, b, cut = (c[order] for c in (comp, far, a, b, cut))
    if most is None:
        return comp, far, a, b, cut
    first = np.ones(len(comp), bool)
    first[1:] = comp[1:] != comp[:-1]
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(comp)))
    keep = np.arange(len(comp)) - np.repeat(starts, sizes) < most
    cut = cut | np.repeat(sizes > most, sizes)
    return comp[keep], far[keep], a[keep], b[keep], cut[keep]


def _cross(num: int, den: int, most: int | None):
    """Rows (sig, block, side, comp, own, node, n, sketch) in order of (sig, block, side): pairs of a row of side 0 and one
    of side 1 that lie in different components and may link, of each component of side 0 the closest; cut tells that
    others were held back. own is the block of a row that has one (else -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left, held, size = None, [], [], 0

        def pairs(at: pa.RecordBatch, block: int):
            lc, ln, lz, ls = (np.concatenate(c) for c in zip(*left, strict=True))
            rc, own, rn, rz = (at.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5, 6))
            rs = _matrix(at.column(7))
            step = max(1, (1 << 16) // len(ln))
            for i in range(0, len(rn), step):
                r = slice(i, i + step)
                apart = (lc[:, None] != rc[None, r]) & ((own[None, r] != block) | (rn[None, r] > ln[:, None]))
                x, y = np.nonzero(apart)
                keep, far = _possible(lz[x], rz[r][y], ls[x], rs[r][y], num, den)
                x, y = x[keep], y[keep]
                yield lc[x], far[keep], ln[x], rn[r][y], np.zeros(len(x), bool)

        def flush():
            _, _, a, b, cut = _closest(held, most)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (np.minimum(a, b), np.maximum(a, b), cut)], names=["a", "b", "cut"])

        for x in batches:
            sig, block, side = (x.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            first = np.ones(len(sig), bool)
            first[1:] = (sig[1:] != sig[:-1]) | (block[1:] != block[:-1]) | (side[1:] != side[:-1])
            starts = np.flatnonzero(first)
            for low, high in zip(starts, [*starts[1:], len(sig)], strict=True):
                if key != (sig[low], block[low]):
                    if held:
                        yield flush()
                    key, left, held, size = (sig[low], block[low]), [], [], 0
                at = x.slice(low, high - low)
                if side[low] == 0:
                    left.append((*(at.column(i).to_numpy(zero_copy_only=False) for i in (3, 5, 6)), _matrix(at.column(7))))
                elif left:
                    for found in pairs(at, int(block[low])):
                        held.append(found)
                        size += len(found[0])
                        if size > 1 << 20:
                            if most is None:
                                yield flush()
                                held, size = [], 0
                            else:
                                held = [_closest(held, most)]
                                size = len(held[0][0])
        if held:
            yield flush()

    return run


def _fetch(k: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            want = x.column("want").to_pylist()
            rows = [(w, s.tobytes(), (s >> _U(48)).astype("<u2").tobytes()) for w, s in zip(want, text_sets(x.column("text").to_pylist(), k, seed), strict=True) if len(s) and _node(s)[0] == w]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], names=["node", "items", "short"])

    return run


def _numbered(short: bytes) -> np.ndarray:
    """16-bit items in order, the second and later ones of a value told apart by their number."""
    s = np.frombuffer(short, "<u2").astype(np.int64)
    return s + ((np.arange(len(s)) - np.searchsorted(s, s)) << 16)


def _narrow(num: int, den: int):
    """Drops pairs whose overlap, at most that of their items' first 16 bits, is too small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            for p, q in zip(x.column("short_a").to_pylist(), x.column("short_b").to_pylist(), strict=True):
                s, t = _numbered(p), _numbered(q)
                top = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(den * top >= num * (len(s) + len(t) - top))
            yield x.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            for p, q in zip(x.column("items_a").to_pylist(), x.column("items_b").to_pylist(), strict=True):
                s, t = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                at = np.searchsorted(t, s)
                both = int((t[np.minimum(at, len(t) - 1)] == s).sum())
                keep.append(den * both >= num * (len(s) + len(t) - both))
            yield x.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def ngram_jaccard_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text", count_links: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, n_links.

    Two documents link when den * |A and B| >= num * |A or B| over sets of distinct k-word shingles
    (words cut at ASCII white space, A-Z lower-cased). A text of fewer words is one shingle; null, empty and
    blank texts have empty sets and link with nothing, so their component is their own id. component_id is
    the smallest doc_id reachable by links. n_links counts the links of the row's set to other sets,
    for which every candidate pair is verified, so its cost grows with the number of links; with count_links
    False the column is left out, and pairs that other links connect already are not verified. Rows of
    equal sets, repeated rows and null ids included, share a component; a null id is never a component's
    smallest unless it is alone. Other columns are ignored. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    for seed in range(4):
        known = stash(rows.mapInArrow(_describe(k, seed), "doc_id long, n long, node long, check long, sketch binary, fine binary"))
        nodes = known.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("check").alias("c0"), F.max("check").alias("c1"), F.min("sketch").alias("sketch"), F.min("fine").alias("fine"))
        nodes = stash(nodes)
        if nodes.where("c0 <> c1").isEmpty():
            break
    else:
        raise RuntimeError("set digests collide under every seed")
    spark = docs.sparkSession
    longest = nodes.agg(F.max("n")).first()[0] or 0
    size_bands = bands(longest, num, den)
    counts = dict(nodes.groupBy("n").count().select(F.expr(_band_sql(size_bands)).alias("band"), "count").groupBy("band").agg(F.sum("count")).collect()) if size_bands else {}
    plan = []
    for i, (low, high) in enumerate(size_bands):
        exact, deletion = allocate(low, high, counts.get(i, 0) + counts.get(i - 1, 0), num, den)
        units = exact + 2 * deletion
        plan.append((low, high, exact + spare(units), deletion, units))

    sigs = rows.mapInArrow(_index(k, seed, plan), "sig long, node long, tag long")
    held = sigs.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(_shared, "sig long, node long, tag long, size long")
    scheme = Window.partitionBy("node", "tag")
    taken = held.withColumn("skip", F.col("tag").bitwiseAND(F.lit((1 << 32) - 1))).withColumn("live", F.count("*").over(scheme)).where("live > skip")
    taken = taken.withColumn("place", F.row_number().over(scheme.orderBy("size", "sig"))).where("place <= live - skip")
    taken = taken.select("sig", "node", (F.col("skip") - F.col("live")).alias("rank"))  # the more of a set is shared, the more central it is
    met = stash(taken.repartition("sig").sortWithinPartitions("sig", "rank", "node").select("sig", "node").mapInArrow(_meet, "kind byte, a long, b long"))
    brief = nodes.select("node", "n", "sketch")

    def verified(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "rep"), "node").select(F.col("node").alias("want"), "rep")
        ends = stash(ends)
        sets = rows.join(maybe_broadcast(ends), F.col("doc_id").eqNullSafe(F.col("rep"))).select("want", "text").mapInArrow(_fetch(k, seed), "node long, items binary, short binary")
        sets = stash(sets.dropDuplicates(["node"]))

        def checked(pairs: DataFrame, what: str, check) -> DataFrame:
            side = lambda end: sets.select(F.col("node").alias(end), F.col(what).alias(f"{what}_{end}"))
            both = pairs.join(side("a"), "a").join(side("b"), "b")
            return stash(both.select("a", "b", f"{what}_a", f"{what}_b").mapInArrow(check(num, den), "a long, b long"))

        # A quarter of the bytes rules most pairs out before whole sets travel.
        return checked(checked(pairs, "short", _narrow), "items", _verify)

    def sieved(pairs: DataFrame) -> DataFrame:
        coarse = stash(pairs.join(brief.toDF("a", "na", "sa"), "a").join(brief.toDF("b", "nb", "sb"), "b").mapInArrow(_sieve(num, den), "a long, b long"))
        fine = nodes.select("node", "n", "fine")  # of large sets the difference overfills the sketch
        return stash(coarse.join(fine.toDF("a", "na", "fa"), "a").join(fine.toDF("b", "nb", "fb"), "b").mapInArrow(_fine_sieve(num, den), "a long, b long"))

    # Sets travel with the pairs they verify, so each node first has one pair only, with its smallest partner.
    star = sieved(met.where("kind = 0").select("a", "b").distinct())
    links = verified(star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    labels = stash(components(links))
    label = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))

    # What these left in different components: the other pairs of stars and small buckets, and large buckets by blocks.
    others = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = met.where("kind = 2").select("a", "b").unionByName(others).distinct().join(label("a"), "a", "left").join(label("b"), "b", "left")
    rest = rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    hot = stash(met.where("kind = 1").select(F.col("a").alias("sig"), F.col("b").alias("node")).distinct())

    def across(hot: DataFrame, most: int | None) -> DataFrame:
        """Pairs of different comp within buckets: the sets outside a bucket's largest comp, in blocks, meet all others."""
        sizes = hot.groupBy("sig", "comp").agg(F.count("*").alias("g")).groupBy("sig").agg(F.sum("g").alias("all"), F.max(F.struct("g", "comp")).alias("top"))
        mixed = sizes.where("all > top.g").select("sig", F.col("top.comp").alias("main"), F.ceil((F.col("all") - F.col("top.g")) / BLOCK).cast("int").alias("blocks"))
        own = F.when(F.col("comp") != F.col("main"), F.pmod(F.xxhash64("node"), F.col("blocks"))).otherwise(-1).cast("int")
        at = hot.join(mixed, "sig").join(brief, "node").withColumn("own", own)
        right = F.transform(F.sequence(F.lit(0), F.when(F.col("own") < 0, F.col("blocks") - 1).otherwise(F.col("own"))), lambda i: F.struct(i.alias("block"), F.lit(1).alias("side")))
        left = F.array(F.struct(F.col("own").alias("block"), F.lit(0).alias("side")))
        dealt = at.withColumn("to", F.explode(F.when(F.col("own") < 0, right).otherwise(F.concat(left, right))))
        dealt = dealt.select("sig", "to.block", "to.side", "comp", "own", "node", "n", "sketch")
        return dealt.repartition("sig", "block").sortWithinPartitions("sig", "block", "side").mapInArrow(_cross(num, den, most), "a long, b long, cut boolean")

    most = CLOSEST
    while True:
        here = hot.join(labels, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("comp"))
        close = stash(across(here, most))
        rest = sieved(rest.unionByName(close.select("a", "b")).distinct())
        more = verified(rest) if not rest.isEmpty() else rest
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = stash(components(links))
        if close.where("cut").isEmpty():
            break
        rest, most = rest.limit(0), most * MORE

    if count_links:  # each set as a component of its own, so that no pair is left out
        inside = across(hot.select("sig", "node", F.col("node").alias("comp")), None).select("a", "b")
        every = met.where("kind <> 1").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(inside).distinct()
        links = verified(sieved(every))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    reach = nodes.select("node", "rep").join(labels, "node")
    low = reach.groupBy("component").agg(F.min("rep").alias("low"))
    final = reach.join(low, "component").select("node", "low")
    final = nodes.select("node", "rep").join(final, "node", "left").join(degree, "node", "left").select("node", F.coalesce("low", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = known.join(final, "node", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n") > 0, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"))
    return out if count_links else out.drop("n_links")


def _band_sql(size_bands: list[tuple[int, int]]) -> str:
    return "case " + " ".join(f"when n <= {high} then {i}" for i, (_, high) in enumerate(size_bands)) + f" else {len(size_bands)} end"
