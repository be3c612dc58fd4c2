"""Iterative graph operators: coreness (G08), PageRank and betweenness (G07), and what follows from communities.

Every round is a DataFrame plan written to the shared folder, so lineage stays short and lost executors cost
one round. Edges are (src, dst, w) in both directions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.sources.storage import keep

#: Values of a state of all nodes that go to the tasks at once (20 MB).
CELLS = 2_500_000


def both_ways(edges: DataFrame, a: str, b: str, w: str) -> DataFrame:
    e = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("src"), F.col(b).alias("dst"), F.col(w).cast("double").alias("w"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.max("w").alias("w"))


def coreness(edges: DataFrame) -> DataFrame:
    """(node, coreness, degree): the h-index of neighbours' values, from the degree, until it is stable."""
    edges = keep(edges.select("src", "dst"))
    core = keep(edges.groupBy("src").agg(F.count("*").alias("core")).select(F.col("src").alias("node"), "core"))
    degree = core.select("node", F.col("core").alias("degree"))
    at = Window.partitionBy("src").orderBy(F.desc("core"))
    while True:  # values only fall, so this ends
        ranked = edges.join(core.select(F.col("node").alias("dst"), "core"), "dst").withColumn("k", F.row_number().over(at))
        new = keep(ranked.groupBy("src").agg(F.max(F.least("core", "k")).alias("core")).select(F.col("src").alias("node"), "core"))
        same = new.join(core.select("node", F.col("core").alias("old")), "node").where("core <> old").isEmpty()
        core = new
        if same:
            break
    return core.join(degree, "node").select("node", F.col("core").cast("long").alias("coreness"), "degree")


def pagerank(edges: DataFrame, alpha: float = 0.85, tolerance: float = 1e-6, max_rounds: int = 100) -> DataFrame:
    """(node, pagerank, degree): weights normalised by source, stop at an L1 change under nodes * tolerance.

    The change falls by alpha at least in every round; max_rounds bounds rounds for an alpha close to 1, and a run
    that ends so without being stable raises an error.
    """
    total = edges.groupBy("src").agg(F.sum("w").alias("total"))
    step = keep(edges.join(total, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")))
    nodes = keep(total.select(F.col("src").alias("node"), F.col("total").alias("degree")))
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("pagerank"), "degree")
    rank = nodes.select("node", F.lit(1.0 / n).alias("rank"))
    for _ in range(max_rounds):
        flow = step.join(rank, step.src == rank.node).groupBy("dst").agg(F.sum(F.col("p") * F.col("rank")).alias("flow"))
        new = keep(nodes.join(flow, nodes.node == flow.dst, "left").select("node", (F.lit((1 - alpha) / n) + alpha * F.coalesce("flow", F.lit(0.0))).alias("rank")))
        moved = new.join(rank.select("node", F.col("rank").alias("old")), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        rank = new
        if moved < n * tolerance:
            break
    else:
        raise RuntimeError(f"ranks still move after {max_rounds} rounds")
    return rank.join(nodes, "node").select("node", F.round("rank", 8).alias("pagerank"), "degree")


def communities(labels: DataFrame, nodes: DataFrame, members: int = 5) -> DataFrame:
    """(node, community_id, community_size, sample_members) of all nodes; those without an edge are alone."""
    at = keep(nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("community_id", "node").alias("community_id")))
    place = F.row_number().over(Window.partitionBy("community_id").orderBy("node"))
    names = F.sort_array(F.collect_list(F.when(F.col("place") <= members, F.col("node"))))
    sizes = at.withColumn("place", place).groupBy("community_id").agg(F.count("*").alias("community_size"), F.array_join(names, ";").alias("sample_members"))
    return at.join(sizes, "community_id").select("node", "community_id", "community_size", "sample_members")


def cohorts(cores: DataFrame) -> DataFrame:
    """core from the upper quartile of coreness (and above 0), middle from the lower one, else periphery."""
    q = cores.agg(F.percentile("coreness", 0.75).alias("high"), F.percentile("coreness", 0.25).alias("low"))
    k = F.col("coreness")
    return cores.join(F.broadcast(q)).withColumn("cohort_group", F.when((k >= F.col("high")) & (k > 0), "core").when(k >= F.col("low"), "middle").otherwise("periphery")).drop("high", "low")


def distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, far): the length of the shortest way from each source, by weights (rounded to 9 digits, so that equal lengths compare equal).

    Each round extends only the ways that got shorter in the one before, and ends when none does.
    """
    edges = keep(edges.select("src", "dst", "w"))
    front = keep(sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("far")))
    best = front
    while not front.isEmpty():
        step = front.join(edges, F.col("node") == F.col("src")).groupBy("source", "dst").agg(F.min(F.round(F.col("far") + F.col("w"), 9)).alias("at"))
        both = keep(best.join(step.withColumnRenamed("dst", "node"), ["source", "node"], "full").select("source", "node", "at", F.least("far", "at").alias("now"), (F.col("at").isNotNull() & (F.col("far").isNull() | (F.col("at") < F.col("far")))).alias("shorter")))
        best, front = both.select("source", "node", F.col("now").alias("far")), both.where("shorter").select("source", "node", F.col("at").alias("far"))
    return best


def _spread(start: DataFrame, ways: DataFrame, a: str, b: str, factor) -> DataFrame:
    """(source, node, x): start and all that it sends along ways from a to b, hop by hop, each hop times the factor. Ways have no circles, so this ends."""
    front = keep(start)
    parts = front
    while True:
        front = keep(front.withColumnRenamed("node", a).join(ways, ["source", a]).groupBy("source", F.col(b).alias("node")).agg(F.sum(F.col("x") * factor).alias("x")))
        if front.isEmpty():
            return keep(parts.groupBy("source", "node").agg(F.sum("x").alias("x")))
        parts = parts.unionByName(front)


def placed(rows: DataFrame, name: str, *order) -> DataFrame:
    """rows with their places 0, 1, ... by an order without ties: a range partition counts its own, after those before it."""
    at = keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    parts = at.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("size"), F.min("at").alias("low"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    shift = parts.select("part", (before - F.col("low")).alias("shift"))
    return at.join(F.broadcast(shift), F.shiftright("at", 33) == F.col("part")).select(*rows.columns, (F.col("at") + F.col("shift")).alias(name))


def numbered(nodes: DataFrame) -> DataFrame:
    """(node, id) with ids 0, 1, ... by the order of names."""
    return placed(nodes.select("node"), "id", "node")


def neighbours(edges: DataFrame) -> tuple[DataFrame, int]:
    """(id, node, near, w), a row a node with its neighbours' ids and weights, and the number of nodes; ids follow the order of names."""
    edges = keep(edges.select("src", "dst", F.col("w").cast("double").alias("w")))
    ids = keep(numbered(edges.select(F.col("src").alias("node")).distinct()))
    at = edges.join(ids.toDF("dst", "b"), "dst").groupBy("src").agg(F.sort_array(F.collect_list(F.struct("b", "w"))).alias("e"))
    rows = at.join(ids.toDF("src", "id"), "src").select("id", F.col("src").alias("node"), F.col("e.b").alias("near"), F.col("e.w").alias("w"))
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keep(rows.repartition(min(parts, 1 + edges.count() // 10_000), "id")), ids.count()


def pulled(near: DataFrame, combine, kind: str, *state) -> tuple[np.ndarray, np.ndarray]:
    """(ids, values): combine(id, neighbours, weights, *state) of each row, an array of the kind, in the task that holds the row."""
    held = near.sparkSession.sparkContext.broadcast(state)

    def rows(batches):
        for p in batches:
            yield pd.DataFrame({"id": p["id"], "x": [combine(i, b, w, *held.value).tobytes() for i, b, w in zip(p["id"], p["near"], p["w"], strict=True)]})

    out = near.select("id", "near", "w").mapInPandas(rows, "id long, x binary").toArrow()
    held.destroy()
    values = [np.frombuffer(x, kind) for x in out["x"].to_pylist()]
    return out["id"].to_numpy(), np.array(values) if values else np.empty((0, 1), kind)


def _pull(near: DataFrame, combine, *state: np.ndarray) -> np.ndarray:
    ids, values = pulled(near, combine, state[0].dtype.str, *state)
    out = np.empty_like(state[0])
    out[ids] = values
    return out


def _slices(size: int, width: int) -> list[slice]:
    """Parts of a neighbour list whose rows of the state are looked at together."""
    step = max(1, CELLS // 16 // width)
    return [slice(i, i + step) for i in range(0, size, step)]


def _nearer(i, b, w, far):
    best = far[i].copy()
    for s in _slices(len(b), far.shape[1]):
        np.minimum(best, (far[b[s]] + w[s, None]).min(0), out=best)
    return best


def _forward(i, b, w, front, far):
    """What reaches a node from those before it on shortest ways."""
    return sum(((far[b[s]] + w[s, None] == far[i]) * front[b[s]]).sum(0) for s in _slices(len(b), far.shape[1]))


def _backward(i, b, w, front, far):
    """What comes back to a node from those after it on shortest ways."""
    return sum(((far[i] + w[s, None] == far[b[s]]) * front[b[s]]).sum(0) for s in _slices(len(b), far.shape[1]))


def _parts(near: DataFrame, n: int, starts: np.ndarray) -> np.ndarray:
    """The parts of all nodes by a block of sources; lengths are whole numbers of 1e-9."""
    own = (starts, np.arange(len(starts)))
    far = np.full((n, len(starts)), np.int64(1) << 60)
    far[own] = 0
    while ((new := _pull(near, _nearer, far)) != far).any():
        far = new
    front = np.zeros(far.shape)
    front[own] = 1.0
    ways = front.copy()
    while front.any():
        front = _pull(near, _forward, front, far)
        ways += front
    known, each = far < np.int64(1) << 59, np.maximum(ways, 1.0)
    front = known.astype(float)
    passed = np.zeros(far.shape)  # less the ways that end there
    while front.any():
        front = _pull(near, _backward, front / each, far) * ways
        passed += front
    passed[own] = 0.0
    return passed.sum(1)


def dependencies(edges: DataFrame, sources: DataFrame, most_nodes: int = CELLS) -> DataFrame:
    """(node, part): the shares of the shortest ways from the sources that pass through a node, summed.

    Brandes' sums, hop by hop: ways are counted forwards along the steps of shortest ways, and shares go backwards.
    The graph stays dealt by node, a row with a node's neighbours; what a block of sources knows of all nodes, CELLS
    values at most, goes to the tasks, where each node pulls from its neighbours. So a hop makes a row a node and not
    one a link and source. Graphs of more than most_nodes nodes go by joins.
    """
    near, n = neighbours(edges)
    if n > most_nodes:
        return dependencies_by_joins(edges, sources)
    near = near.withColumn("w", F.transform("w", lambda x: F.round(x * 1e9).cast("long")))
    starts = np.array(sorted(r.id for r in near.join(F.broadcast(sources.select("node").distinct()), "node").select("id").collect()), "i8")  # the sources, bounded by the caller
    width, part = max(1, CELLS // max(n, 1)), np.zeros(n)
    for at in range(0, len(starts), width):
        part += _parts(near, n, starts[at : at + width])
    held = edges.sparkSession.sparkContext.broadcast(part)

    def named(batches):
        for p in batches:
            yield p[["node"]].assign(part=held.value[p["id"]])

    return near.select("id", "node").mapInPandas(named, f"node {near.schema['node'].dataType.simpleString()}, part double")


def dependencies_by_joins(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """The same as joins by source and node, for graphs of any size. A hop's rows are at most sources times nodes, and
    no graph is held in one place.
    """
    far = keep(distances(edges, sources))
    steps = edges.select("src", "dst", "w").join(far.select("source", F.col("node").alias("src"), F.col("far").alias("a")), "src").join(far.select("source", F.col("node").alias("dst"), F.col("far").alias("b")), ["source", "dst"])
    steps = keep(steps.where(F.round(F.col("a") + F.col("w"), 9) == F.col("b")).select("source", "src", "dst"))
    ways = _spread(far.where("source = node").select("source", "node", F.lit(1.0).alias("x")), steps, "src", "dst", F.lit(1.0))
    share = steps.join(ways.select("source", F.col("node").alias("src"), F.col("x").alias("to")), ["source", "src"]).join(ways.select("source", F.col("node").alias("dst"), F.col("x").alias("all")), ["source", "dst"])
    share = keep(share.select("source", "src", "dst", (F.col("to") / F.col("all")).alias("share")))
    passed = _spread(ways.select("source", "node", F.lit(1.0).alias("x")), share, "dst", "src", F.col("share"))
    return passed.where("source <> node").groupBy("node").agg(F.sum(F.col("x") - 1.0).alias("part"))  # less the ways that end there


def betweenness(edges: DataFrame, most: int = 500, seed: int = 42) -> DataFrame:
    """(node, betweenness): shares of shortest paths through a node, with weights as distances, from sampled sources.

    Sources are min(most, half of the nodes) by hash, and sums are scaled to all nodes.
    """
    edges = keep(edges)
    nodes = keep(edges.select(F.col("src").alias("node")).distinct())
    n = nodes.count()
    if n < 3:
        return nodes.withColumn("betweenness", F.lit(0.0))
    k = max(1, min(most, n // 2))
    parts = dependencies(edges, nodes.orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(k))
    scale = n / k / ((n - 1) * (n - 2))
    return nodes.join(parts, "node", "left").select("node", F.round(F.coalesce(F.col("part") * scale, F.lit(0.0)), 8).alias("betweenness"))


def lineage(weekly: DataFrame, members: int = 5) -> DataFrame:
    """What became of communities from week to week, by the Jaccard similarity of their members.

    weekly: week_idx, community_id, repo_name. The most similar community of the week before (the first by id on
    ties) makes a community a birth (none), continue (0.6), merge_or_split (0.2) or else reform; one of the week
    before that nothing resembles by 0.2 is a death in the week after. The first week holds births only.
    """
    at = keep(weekly.select("week_idx", "community_id", "repo_name"))
    size = at.groupBy("week_idx", "community_id").agg(F.count("*").alias("members_count"), F.array_join(F.slice(F.sort_array(F.collect_list("repo_name")), 1, members), ";").alias("sample_members"))
    before = at.select((F.col("week_idx") + 1).alias("week_idx"), F.col("community_id").alias("prev_community_id"), "repo_name")
    both = at.join(before, ["week_idx", "repo_name"]).groupBy("week_idx", "community_id", "prev_community_id").agg(F.count("*").alias("n"))
    was = size.select((F.col("week_idx") + 1).alias("week_idx"), F.col("community_id").alias("prev_community_id"), F.col("members_count").alias("m"), F.col("sample_members").alias("was"))
    pairs = both.join(size, ["week_idx", "community_id"]).join(was, ["week_idx", "prev_community_id"]).withColumn("overlap", F.round(F.col("n") / (F.col("members_count") + F.col("m") - F.col("n")), 6))
    best = pairs.groupBy("week_idx", "community_id").agg(F.min(F.struct((-F.col("overlap")).alias("o"), "prev_community_id")).alias("best"))
    kind = F.when(F.col("best").isNull(), "birth").when(F.col("best.o") <= -0.6, "continue").when(F.col("best.o") <= -0.2, "merge_or_split").otherwise("reform")
    lives = size.join(best, ["week_idx", "community_id"], "left").select("week_idx", "community_id", "best.prev_community_id", kind.alias("event_type"), "members_count", F.coalesce(-F.col("best.o"), F.lit(0.0)).alias("overlap_jaccard"), "sample_members")
    last = at.agg(F.max("week_idx").alias("last"))
    gone = was.join(F.broadcast(last)).where("week_idx <= last").join(pairs.where("overlap >= 0.2").select("week_idx", "prev_community_id").distinct(), ["week_idx", "prev_community_id"], "left_anti")
    deaths = gone.select("week_idx", F.col("prev_community_id").alias("community_id"), "prev_community_id", F.lit("death").alias("event_type"), F.col("m").alias("members_count"), F.lit(0.0).alias("overlap_jaccard"), F.col("was").alias("sample_members"))
    return lives.unionByName(deaths)


def community_profile(labels: DataFrame, events: DataFrame, members: int = 3, kinds: dict[str, str] | None = None) -> DataFrame:
    """Communities of two members or more: size, events, their shares, and the names of the busiest members.

    labels: (repo_name, community_id); events: (repo_name, kind), one row an event. Repositories without events
    count as members with none.
    """
    kinds = kinds or {"watch": "AF", "fork": "AO", "issues": "RF", "pr": "RO"}
    per = events.groupBy("repo_name").agg(F.count("*").alias("n"), *[F.count_if(F.col("kind") == v).alias(k) for k, v in kinds.items()])
    at = labels.join(per, "repo_name", "left").na.fill(0, ["n", *kinds])
    order = Window.partitionBy("community_id").orderBy(F.desc("n"), "repo_name")
    at = at.withColumn("place", F.row_number().over(order))
    top = F.sort_array(F.collect_list(F.when(F.col("place") <= members, F.struct("place", "repo_name"))))
    total = F.greatest(F.sum("n"), F.lit(1))
    other = F.sum(F.col("n") - sum(F.col(k) for k in kinds))
    out = at.groupBy("community_id").agg(F.count("*").alias("size"), F.sum("n").alias("total_events"), *[F.round(F.sum(k) / total, 6).alias(f"{k}_share") for k in kinds], F.round(other / total, 6).alias("push_share"), F.round((F.sum("pr") + other) / total, 6).alias("pr_push_ratio"), F.array_join(F.transform(top, lambda x: x["repo_name"]), ";").alias("top_members"))
    return out.where("size >= 2")


def _labelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    named = lambda end: labels.select(F.col("node").alias(end), F.col("community_id").alias(f"c_{end}"))
    return edges.join(named("src"), "src").join(named("dst"), "dst")


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: modularity of the labels over the listed edges (0 without edges), and the number of communities."""
    at = _labelled(edges, labels)
    per = at.groupBy(F.col("c_src").alias("community_id")).agg(F.sum("w").alias("degree"), F.sum(F.when(F.col("c_src") == F.col("c_dst"), F.col("w")).otherwise(0.0)).alias("inside"))
    total = per.agg(F.sum("degree").alias("total"))
    q = F.sum(F.col("inside") / F.col("total") - F.pow(F.col("degree") / F.col("total"), 2))
    return per.join(F.broadcast(total)).agg(F.round(F.coalesce(q, F.lit(0.0)), 6).alias("modularity"), F.count("*").alias("communities"))


def bridges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, foreign_communities, bridge_score): the share of a node's weight that leaves its community, for
    nodes with neighbours in two foreign communities or more."""
    cross = F.col("c_src") != F.col("c_dst")
    out = _labelled(edges, labels).groupBy(F.col("src").alias("node")).agg(F.countDistinct(F.when(cross, F.col("c_dst"))).alias("foreign_communities"), F.round(F.sum(F.when(cross, F.col("w")).otherwise(0.0)) / F.sum("w"), 6).alias("bridge_score"))
    return out.where("foreign_communities >= 2")
