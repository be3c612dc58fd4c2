"""Communities of weighted graphs: label propagation in the order of a graph colouring (G04, G09, G11) and Louvain's method.

Both move a set of nodes at a time by a DataFrame plan that is written to the shared folder, so lineage stays short
and lost executors cost one step. Edges are (src, dst, w) in both directions; sums are rounded to 9 digits before
they are compared, so results rest on the graph alone and not on how it is partitioned.
"""

from __future__ import annotations

from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemill.operators.iterative import CELLS, neighbours, pulled
from tidemill.sources.storage import keep, kept_path


def colours(edges: DataFrame, seed: int = 42) -> DataFrame:
    """(node, colour): no two neighbours share a colour.

    Nodes are ranked by degree, then by hash. In a round each node without a colour proposes one that no coloured
    neighbour has: the smallest if no neighbour before it is without one, else one of the first few, as many as
    such neighbours and one more, chosen by hash. A proposal stands unless a neighbour before it made the same. The
    first node of all always succeeds, so this ends; nodes of a clique succeed by half in a round, not one by one.
    """
    links = edges.where("src <> dst").select("src", "dst").distinct()
    degree = links.groupBy("src").agg(F.count("*").alias("d"))
    rank = lambda n: F.struct((-F.col("d")).alias("d"), F.xxhash64(F.lit(seed), n).alias("h"), F.col(n).alias("n"))
    ranks = degree.select(F.col("src").alias("node"), rank("src").alias("rank"))
    # For every pair of neighbours, whether dst comes before src.
    pairs = links.join(ranks.select(F.col("node").alias("src"), F.col("rank").alias("r")), "src").join(ranks.select(F.col("node").alias("dst"), F.col("rank").alias("s")), "dst")
    pairs = keep(pairs.select("src", "dst", (F.col("s") < F.col("r")).alias("before")))
    state = keep(ranks.select("node", F.lit(None).cast("int").alias("colour")))
    for turn in count():
        seen = pairs.join(state.select(F.col("node").alias("dst"), "colour"), "dst").groupBy("src").agg(F.collect_set("colour").alias("used"), F.count_if(F.col("before") & F.col("colour").isNull()).alias("ahead"))
        free = F.array_except(F.sequence(F.lit(0), (F.size("used") + F.col("ahead")).cast("int")), F.col("used"))
        pick = F.get(free, F.pmod(F.xxhash64(F.lit(seed + turn), "node"), F.col("ahead") + 1).cast("int"))
        proposed = keep(state.where("colour is null").join(seen, F.col("node") == F.col("src")).select("node", pick.alias("pick")))
        if proposed.isEmpty():
            return state
        rival = pairs.where("before").join(proposed.toDF("dst", "theirs"), "dst").join(proposed.toDF("src", "mine"), "src").where("mine = theirs").select(F.col("src").alias("node")).distinct()
        stands = proposed.join(rival, "node", "left_anti")
        state = keep(state.join(stands, "node", "left").select("node", F.coalesce("colour", "pick").alias("colour")))


def _vote(i, b, w, label):
    """The label of the largest summed weight among the neighbours, the smallest on ties."""
    at, place = np.unique(label[b], return_inverse=True)
    return np.array([at[np.round(np.bincount(place, w), 9).argmax()]])


def _labelled(near: DataFrame, label: np.ndarray) -> DataFrame:
    """(node, label): the names of labels given by id."""
    held = near.sparkSession.sparkContext.broadcast(label)

    def named(batches):
        for p in batches:
            yield p[["node"]].assign(at=held.value[p["id"]])

    at = near.select("id", "node").mapInPandas(named, "node string, at long")
    return keep(at.join(near.select(F.col("id").alias("at"), F.col("node").alias("label")), "at").select("node", "label"))


def label_propagation(edges: DataFrame, rounds: int = 8, most_nodes: int = CELLS) -> DataFrame:
    """(node, community_id): a node takes the label of the largest summed weight among its neighbours, the smallest on ties.

    A round goes through the colours of the graph, so neighbours never move at once and each sees what those
    before it took; it stops after `rounds`, or when a round changes nothing. The graph stays dealt by node and labels
    go to the tasks, so a colour moves in one job without a shuffle; graphs of more than most_nodes nodes go by joins.
    """
    edges = keep(edges.where("src <> dst"))
    tint = keep(colours(edges))
    order = [r.colour for r in tint.groupBy("colour").count().orderBy("colour").collect()]  # at most the largest degree and one more
    if not order:
        return tint.select("node", F.col("node").alias("community_id"))
    near, n = neighbours(edges)
    if n > most_nodes:
        return _propagate_by_joins(edges, tint, order, rounds)
    near, label = keep(near.join(tint, "node")), np.arange(n)
    for _ in range(rounds):
        moved = False
        for colour in order:
            ids, to = pulled(near.where(F.col("colour") == colour), _vote, "i8", label)
            moved |= bool((label[ids] != to[:, 0]).any())
            label[ids] = to[:, 0]
        if not moved:
            break
    return _labelled(near, label).withColumnRenamed("label", "community_id")


def _propagate_by_joins(edges: DataFrame, tint: DataFrame, order: list[int], rounds: int) -> DataFrame:
    """The same by joins, for graphs of any size. Edges are stored by the colour of their source, so a step reads its own part."""
    path = kept_path(edges.sparkSession)
    edges.where("src <> dst").join(tint.withColumnRenamed("node", "src"), "src").select("src", "dst", F.col("w").cast("double").alias("w"), "colour").write.partitionBy("colour").parquet(path)
    parts = edges.sparkSession.read.parquet(path)
    labels = tint.select("node", F.col("node").alias("label"))
    for _ in range(rounds):
        moved = 0
        for colour in order:
            votes = parts.where(F.col("colour") == colour).join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.round(F.sum("w"), 9).alias("w"))
            best = votes.groupBy("src").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("best"))
            new = labels.join(best, F.col("node") == F.col("src"), "left").select("node", F.coalesce("best.label", "label").alias("label"), F.col("label").alias("old"))
            seen = Observation()
            labels = keep(new.observe(seen, F.count_if(F.col("label") != F.col("old")).alias("moved"))).select("node", "label")
            moved += seen.get["moved"]
        if not moved:
            break
    return labels.withColumnRenamed("label", "community_id")


def _quality(edges: DataFrame, labels: DataFrame) -> float:
    """Modularity of labels (node, label); self-loops of contracted communities count as inside."""
    at = edges.join(labels.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst")
    per = at.groupBy("a").agg(F.sum("w").alias("degree"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inside"))
    total = per.agg(F.sum("degree").alias("total"))
    found = per.join(F.broadcast(total)).agg(F.sum(F.col("inside") / F.col("total") - F.pow(F.col("degree") / F.col("total"), 2))).first()[0]
    return float(found or 0.0)


def _moves(edges: DataFrame, labels: DataFrame, total: float, turn: Column) -> DataFrame:
    """labels after the nodes of a turn have each gone where modularity gains most.

    labels: node, k (its weight), label. A community gains the node's links into it, less what the weights of both
    let expect. Nodes stay on equal gains; the smallest label wins ties. Of two nodes that are alone, only the one
    of the larger label joins the other, so they can't swap places.
    """
    sizes = labels.groupBy("label").agg(F.sum("k").alias("tot"), F.count("*").alias("members"))
    own = labels.where(turn)
    links = edges.where("src <> dst").join(own.select(F.col("node").alias("src")), "src").join(labels.select(F.col("node").alias("dst"), "label"), "dst").select("src", "label", "w")
    links = links.unionByName(own.select(F.col("node").alias("src"), "label", F.lit(0.0).alias("w"))).groupBy("src", "label").agg(F.sum("w").alias("into"))
    at = links.join(sizes, "label").join(own.select(F.col("node").alias("src"), "k", F.col("label").alias("now")), "src")
    stays = F.col("label") == F.col("now")
    gain = F.round(F.col("into") - F.col("k") * (F.col("tot") - F.when(stays, F.col("k")).otherwise(0.0)) / total, 9)
    alone = F.max(F.when(stays, F.col("members"))).alias("own_members")
    offers = at.groupBy("src").agg(F.min(F.struct((-gain).alias("loss"), (~stays).alias("moves"), "label", "members")).alias("best"), alone, F.max(F.when(stays, gain)).alias("stay"), F.max("now").alias("now"))
    swap = (F.col("own_members") == 1) & (F.col("best.members") == 1) & (F.col("best.label") > F.col("now"))
    taken = offers.where((-F.col("best.loss") > F.col("stay")) & ~swap).select(F.col("src").alias("node"), F.col("best.label").alias("to"))
    return labels.join(taken, "node", "left").select("node", "k", F.coalesce("to", "label").alias("label"))


def _settle(edges: DataFrame, total: float, classes: int, tolerance: float) -> tuple[DataFrame, float, bool]:
    """Local moves until modularity rises by no more than the tolerance: labels, modularity, and whether it rose at all.

    In a pass the nodes move class by class; classes are drawn anew by hash in each pass. A pass that does not raise
    modularity is undone, as nodes of a class that move at once may spoil each other's gains.
    """
    labels = keep(edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")).withColumn("label", F.col("node")))
    start = best = _quality(edges, labels)
    for turn in count():
        new = labels
        for c in range(classes):
            new = keep(_moves(edges, new, total, F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(classes)) == c))
        q = _quality(edges, new)
        if q <= best + tolerance:
            return labels, best, best > start + tolerance
        labels, best = new, q


def _offer(i, b, w, now, k, tot, members, total):
    """Where a node goes, as in _moves, or its own label."""
    others = b != i
    at, place = np.unique(np.append(now[b[others]], now[i]), return_inverse=True)
    into = np.bincount(place, np.append(w[others], 0.0))
    stays = at == now[i]
    gain = np.round(into - k[i] * (tot[at] - np.where(stays, k[i], 0.0)) / total, 9)
    best = int(gain.argmax())  # the smallest label of those that gain most
    swap = members[now[i]] == 1 and members[at[best]] == 1 and at[best] > now[i]
    return np.array([at[best] if gain[best] > gain[stays][0] and not swap else now[i]])


def _settle_by_rows(near: DataFrame, n: int, total: float, classes: int, tolerance: float) -> tuple[DataFrame, float, bool]:
    """The same as _settle over rows of neighbours: the labels of all nodes go to the tasks, and a class moves in one job without a shuffle."""
    k, label = np.zeros(n), np.arange(n)
    ids, sums = pulled(near, lambda i, b, w: np.array([w.sum()]), "f8")
    k[ids] = sums[:, 0]

    def quality(at: np.ndarray) -> float:
        _, inside = pulled(near, lambda i, b, w, of: np.array([w[of[b] == of[i]].sum()]), "f8", at)
        return float(inside.sum() / total - np.square(np.bincount(at, k, n) / total).sum())

    start = best = quality(label)
    for turn in count():
        new = label.copy()
        for c in range(classes):
            own = near.where(F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(classes)) == c)
            ids, to = pulled(own, _offer, "i8", new, k, np.bincount(new, k, n), np.bincount(new, minlength=n), total)
            new[ids] = to[:, 0]
        q = quality(new)
        if q <= best + tolerance:
            break
        label, best = new, q
    return _labelled(near, label), best, best > start + tolerance


def louvain(edges: DataFrame, classes: int = 4, tolerance: float = 1e-6, most_nodes: int = CELLS) -> DataFrame:
    """(node, community_id): communities of high modularity by Louvain's method; named after their smallest node.

    Nodes move to where modularity gains most until it settles; then communities become nodes, their links
    summed (those within as loops), and the same goes on with these, until no level raises modularity. Modularity
    never falls from level to level. Graphs shrink with each level. Those of more than most_nodes nodes settle by joins.
    """
    edges = keep(edges.where("src <> dst").select("src", "dst", F.col("w").cast("double").alias("w")))
    total = edges.agg(F.sum("w")).first()[0]
    member = keep(edges.select(F.col("src").alias("node")).distinct().withColumn("at", F.col("node")))
    rises = total is not None
    while rises:
        near, n = neighbours(edges)
        labels, _, rises = _settle_by_rows(near, n, total, classes, tolerance) if n <= most_nodes else _settle(edges, total, classes, tolerance)
        if rises:
            member = keep(member.join(labels.select(F.col("node").alias("at"), "label"), "at").select("node", F.col("label").alias("at")))
            names = labels.select("node", "label")
            edges = edges.join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst")
            edges = keep(edges.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
    names = member.groupBy("at").agg(F.min("node").alias("community_id"))
    return member.join(names, "at").select("node", "community_id")
