"""Influence by independent cascades over live-edge samples (G14): greedy seeds and what other orders reach.

An edge carries influence with probability min(p_max, 1 - (1 - p0)^weight), each direction on its own. Which edges
live in a sample follows from a hash, so runs agree.

Two ways to seeds: over a bounded graph, what each node reaches in each sample (a string of bits) and greedy choice with
a queue of bounds; over a graph of any size, reverse-reachable sets, of which the seeds are to hit as many as they can.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.iterative import CELLS, neighbours, numbered, pulled
from tidemill.sources.storage import keep

STEPS = (1, 2, 3, 5, 7, 10, 15, 20)
#: States of a node in a reverse-reachable set.
OPEN, KNOWN, FRONT = 0, 1, 2
#: Links and sets whose draws are looked at together.
PAIRS = 1 << 16
#: Constants of the 64-bit hash xxHash, as in F.xxhash64.
PRIMES = tuple(np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def probability(weight, p0: float = 0.02, p_max: float = 0.2):
    return F.least(F.lit(p_max), 1 - F.pow(F.lit(1 - p0), weight))


def closure(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Boolean matrix: what each of n nodes reaches, itself included, by squaring."""
    reach = np.eye(n, dtype=bool)
    reach[src, dst] = True
    while True:
        new = (reach.astype(np.float32) @ reach.astype(np.float32)) > 0
        if (new == reach).all():
            return new
        reach = new


def reached(edges: DataFrame, ids: DataFrame, n: int, samples: int = 200, seed: int = 42) -> DataFrame:
    """(sample, node, bits): the nodes that each of n nodes reaches in each sample. edges: src, dst, w both ways; ids: node, id."""
    at = edges.join(ids.toDF("src", "a"), "src").join(ids.toDF("dst", "b"), "dst").select("a", "b", probability(F.col("w")).alias("p"))
    draws = at.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "sample", "a", "b"), 11) / float(1 << 53)
    live = draws.where(uniform < F.col("p")).select("sample", "a", "b")
    every = edges.sparkSession.range(samples).select(F.col("id").cast("int").alias("sample"), F.lit(0).alias("a"), F.lit(0).alias("b"))  # samples without a live edge

    def spread(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.packbits(closure(n, rows["a"].to_numpy(), rows["b"].to_numpy()), axis=1)
        return pd.DataFrame({"sample": int(rows["sample"].iloc[0]), "node": np.arange(n), "bits": [b.tobytes() for b in bits]})

    return keep(live.unionByName(every.select("sample", F.col("a").cast("int"), F.col("b").cast("int"))).groupBy("sample").applyInPandas(spread, "sample int, node int, bits binary"))


def greedy(reach: DataFrame, candidates: list[int], samples: int, most: int = 20, batch: int = 32) -> tuple[list[tuple[int, float]], int]:
    """(node, mean gain) of each seed in turn, the lower number first on ties; and how many gains were worked out.

    What a node adds only falls as seeds are taken, so its last known gain bounds it. A queue holds these bounds; the
    nodes of the highest ones are evaluated anew, `batch` at a time in one job, until the first of the queue is known
    for the seeds taken so far. What is covered goes from round to round.
    """
    spark, found, covered = reach.sparkSession, [], {}

    def gains(nodes: list[int] | None) -> list[tuple[int, int]]:
        held = spark.sparkContext.broadcast(covered)

        def new(batches):
            for p in batches:
                more = [int.from_bytes(b, "big") & ~held.value.get(s, 0) for s, b in zip(p["sample"], p["bits"], strict=True)]
                yield p[["node"]].assign(gain=[x.bit_count() for x in more])

        rows = reach if nodes is None else reach.where(F.col("node").isin(nodes))
        return [(r.node, r.gain) for r in rows.mapInPandas(new, "node int, gain long").groupBy("node").agg(F.sum("gain").alias("gain")).collect()]

    allowed = set(candidates)
    queue = [(-g, n, 0) for n, g in gains(None) if n in allowed]
    heapq.heapify(queue)
    evaluated = len(queue)
    while queue and len(found) < most:
        stale = []
        while queue and queue[0][2] != len(found) and len(stale) < batch:
            stale.append(heapq.heappop(queue)[1])
        if stale:
            evaluated += len(stale)
            for n, g in gains(stale):
                heapq.heappush(queue, (-g, n, len(found)))
            continue
        gain, node, _ = heapq.heappop(queue)
        found.append((node, -gain / samples))
        for r in reach.where(F.col("node") == node).collect():  # one row a sample
            covered[r["sample"]] = covered.get(r["sample"], 0) | int.from_bytes(bytes(r["bits"]), "big")
    return found, evaluated


def hashed(seeds: np.ndarray, texts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """F.xxhash64 of texts[at[i]], from the hash seeds[i] of the columns before it. texts: (number, bytes of each), uint8."""
    a, b, c, d, e = PRIMES
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    size = texts.shape[1]
    words = np.ascontiguousarray(texts[:, : size // 8 * 8]).view("<u8")
    first = size // 32 * 4
    if first:
        lanes = [seeds + b + a, seeds + b, seeds, seeds - a]
        for i in range(first):
            lanes[i % 4] = turn(lanes[i % 4] + (words[:, i] * b)[at], 31) * a
        h = sum((turn(x, k) for x, k in zip(lanes[1:], (7, 12, 18), strict=True)), turn(lanes[0], 1))
        for x in lanes:
            h = (h ^ (turn(x * b, 31) * a)) * a + d
    else:
        h = seeds + e
    h = h + np.uint64(size)
    for i in range(first, size // 8):
        h = turn(h ^ (turn(words[:, i] * b, 31) * a)[at], 27) * a + d
    done = size // 8 * 8
    if size & 4:
        h = turn(h ^ (np.ascontiguousarray(texts[:, done : done + 4]).view("<u4")[:, 0].astype(np.uint64) * a)[at], 23) * b + c
        done += 4
    for i in range(done, size):
        h = turn(h ^ (texts[:, i].astype(np.uint64) * e)[at], 11) * a
    h = (h ^ (h >> np.uint64(33))) * b
    h = (h ^ (h >> np.uint64(29))) * c
    return h ^ (h >> np.uint64(32))


def _joins(i, near, p, names, ends, seeds, state):
    """Of a block of sets, those that node i joins: it has a live link to a node that was found last.

    A set is done with at the first such link, so most links of a dense graph are never drawn. names: all names'
    bytes, ends: where each begins and ends, seeds: the sets' hashes, state: (node, set).
    """
    sizes, joined = np.diff(ends)[near], np.zeros(len(seeds), bool)
    own = hashed(seeds, names[None, ends[i] : ends[i + 1]], np.zeros(len(seeds), np.int64))
    left = np.flatnonzero(state[i] == OPEN)
    for size in np.unique(sizes):
        ids, chance, at = near[sizes == size], p[sizes == size], 0
        while at < len(ids) and len(left):
            part = slice(at, at + max(1, PAIRS // len(left)))
            link, k = np.nonzero(state[np.ix_(ids[part], left)] == FRONT)
            h = hashed(own[left[k]], names[ends[ids[part]][:, None] + np.arange(size)], link)
            hit = np.unique(k[(h >> np.uint64(11)) / float(1 << 53) < chance[part][link]])
            joined[left[hit]] = True
            left, at = np.delete(left, hit), part.stop
    return joined


def _reverse_sets_by_rows(near: DataFrame, n: int, sets: int, seed: int) -> DataFrame:
    spark = near.sparkSession
    texts = near.select("id", "node").toArrow().sort_by("id")["node"].to_pylist()
    names = [x.encode() for x in texts]
    ends, names = np.cumsum([0, *map(len, names)]), np.frombuffer(b"".join(names), np.uint8)
    own = F.xxhash64(F.lit(seed), "id")
    drawn = spark.range(sets).select("id", own.alias("own"), F.pmod(own, F.lit(n)).alias("root")).orderBy("id").toArrow()
    seeds, roots = drawn["own"].to_numpy().view(np.uint64), drawn["root"].to_numpy()
    every, width = [], max(1, 8 * CELLS // n)
    for first in range(0, sets, width):
        root = roots[first : first + width]
        state = np.full((n, len(root)), OPEN, np.uint8)
        state[root, np.arange(len(root))] = FRONT
        while (state == FRONT).any():
            ids, joined = pulled(near, _joins, "bool", names, ends, seeds[first : first + width], state)
            state[state == FRONT] = KNOWN
            state[ids] += FRONT * joined.astype(np.uint8)
        held = spark.sparkContext.broadcast(state)

        def rows(batches, held=held, first=first):
            for p in batches:
                for i, node in zip(p["id"], p["node"], strict=True):
                    yield pd.DataFrame({"set": first + np.flatnonzero(held.value[i]), "node": node})

        every.append(keep(near.select("id", "node").mapInPandas(rows, "set long, node string")))
        held.destroy()
    return reduce(DataFrame.unionByName, every)


def reverse_sets(edges: DataFrame, sets: int, seed: int = 42, most_nodes: int = 100_000) -> DataFrame:
    """(set, node): the nodes that would reach a node drawn by hash, over the edges that live in the set's sample.

    edges: src, dst, w both ways. The graph stays dealt by node, a row with a node's neighbours; who is in a block of
    sets, 8 * CELLS flags at most, goes to the tasks, and a node draws its links into each set until one lives.
    Graphs of more than most_nodes nodes go by joins: each round joins the nodes found last with the edges into
    them and drops what is known.
    """
    edges = keep(edges.select("src", "dst", probability(F.col("w")).alias("w")))
    if 0 < edges.select("src").distinct().count() <= most_nodes:
        return _reverse_sets_by_rows(*neighbours(edges), sets, seed)
    return _reverse_sets_by_joins(edges.withColumnRenamed("w", "p"), sets, seed)


def _reverse_sets_by_joins(edges: DataFrame, sets: int, seed: int) -> DataFrame:
    nodes = edges.select(F.col("src").alias("node")).distinct()
    # The roots: for each set a node by its number, so every node is as likely as any other.
    ranked = keep(numbered(nodes))
    n = ranked.count()
    sample = edges.sparkSession.range(sets).select(F.col("id").alias("set"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(n, 1))).alias("id"))
    front = keep(sample.join(ranked, "id").select("set", "node"))
    every = front
    while not front.isEmpty():
        uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "set", "src", "dst"), 11) / float(1 << 53)
        into = front.join(edges, F.col("node") == F.col("dst")).where(uniform < F.col("p")).select("set", F.col("src").alias("node")).distinct()
        front = keep(into.join(every, ["set", "node"], "left_anti"))
        every = every.unionByName(front)
    return keep(every)


def cover(found: DataFrame, nodes: int, sets: int, most: int = 20) -> list[tuple[str, float, float]]:
    """(node, gain, reach) of each seed in turn: the node in most sets that no seed hits yet, the first by name on ties.

    The share of the sets hit, times the number of nodes, estimates what the seeds reach.
    """
    out, hit, left = [], 0, found
    for _ in range(most):
        top = left.groupBy("node").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").first()
        if top is None:
            break
        hit += top.n
        out.append((top.node, top.n * nodes / sets, hit * nodes / sets))
        left = keep(left.join(left.where(F.col("node") == top.node).select("set"), "set", "left_anti"))
    return out


def seeds_of_any_graph(edges: DataFrame, sets: int = 2000, most: int = 20) -> DataFrame:
    """(seed_rank, actor_login, marginal_gain, cumulative_reach) by reverse-reachable sets; `sets` of them are drawn."""
    edges = keep(edges)
    n = edges.select("src").distinct().count()
    found = cover(reverse_sets(edges, sets), n, sets, most) if n else []
    rows = [(i + 1, node, round(gain, 6), round(reach, 6)) for i, (node, gain, reach) in enumerate(found)]
    return edges.sparkSession.createDataFrame(rows, "seed_rank int, actor_login string, marginal_gain double, cumulative_reach double")


def reach_of(reach: DataFrame, orders: dict[str, list[int]], samples: int, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """(strategy, k, expected_reach, reach_stddev): nodes reached by the first k seeds of each order."""
    spark = reach.sparkSession
    seeds = spark.createDataFrame([(s, i + 1, n) for s, order in orders.items() for i, n in enumerate(order)], "strategy string, place int, node int")

    def union(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        seen, out = 0, []
        for place, bits in zip(rows["place"], rows["bits"], strict=True):
            seen |= int.from_bytes(bits, "big")
            if place in steps:
                out.append((rows["strategy"].iloc[0], int(place), seen.bit_count()))
        return pd.DataFrame(out, columns=["strategy", "k", "n"])

    each = reach.join(F.broadcast(seeds), "node").groupBy("strategy", "sample").applyInPandas(union, "strategy string, k int, n long")
    return each.groupBy("strategy", "k").agg(F.round(F.avg("n"), 6).alias("expected_reach"), F.round(F.stddev_pop("n"), 6).alias("reach_stddev"), F.count("*").alias("sim_runs"))


def influence(edges: DataFrame, ranks: DataFrame, samples: int = 200, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """(actor_ic_reach, seed_greedy). edges both ways; ranks: node, degree, pagerank, coreness of every node of an edge."""
    spark = edges.sparkSession
    rows = ranks.orderBy("node").collect()  # the graph's nodes, bounded by the caller
    if not rows:
        return spark.createDataFrame([], "strategy string, k int, seeds string, expected_reach double, reach_stddev double, sim_runs long"), spark.createDataFrame([], "seed_rank int, actor_login string, marginal_gain double, cumulative_reach double, degree double, pagerank double")
    ids = spark.createDataFrame([(r.node, i) for i, r in enumerate(rows)], "node string, id int")
    reach = reached(edges, ids, len(rows), samples)
    found, _ = greedy(reach, list(range(len(rows))), samples, most)
    by = lambda key: sorted(range(len(rows)), key=lambda i: (-float(rows[i][key]), i))[:most]
    order = np.random.default_rng(42).permutation(len(rows))[:most].tolist()
    orders = {"greedy": [s for s, _ in found], "degree": by("degree"), "pagerank": by("pagerank"), "coreness": by("coreness"), "random": order}
    names = spark.createDataFrame([(s, k, ";".join(rows[i].node for i in o[:k])) for s, o in orders.items() for k in STEPS], "strategy string, k int, seeds string")
    total, seeds = 0.0, []
    for i, (node, gain) in enumerate(found):
        total += gain
        seeds.append((i + 1, rows[node].node, round(gain, 6), round(total, 6), float(rows[node].degree), float(rows[node].pagerank)))
    return reach_of(reach, orders, samples).join(names, ["strategy", "k"]), spark.createDataFrame(seeds, "seed_rank int, actor_login string, marginal_gain double, cumulative_reach double, degree double, pagerank double")
