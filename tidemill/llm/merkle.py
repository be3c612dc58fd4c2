"""A Merkle manifest of a dataset: leaves by row, a tree for each source, a tree over the sources; by slot pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import maybe_broadcast, stash

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that one exchange serves: a block of fanout ** HEIGHT neighbouring nodes lies in one task.
HEIGHT = 6


def digest(*parts: Column) -> Column:
    """SHA-256 in lowercase hex of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """'-' for null, else the count of UTF-8 bytes, a colon and the value."""
    value = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_of(columns: dict[str, Column]) -> Column:
    return digest(*[field(columns[f]) for f in FIELDS])


def numbered(rows: DataFrame, group: str, order: list) -> DataFrame:
    """rows with pos (0, 1, ... in each group, in this order) and n, the group's size.

    Range-partitioned by group and order, so that a group of any size is dealt over tasks; equal rows are told
    apart by where they were read. A task numbers its own run of a group, to which the sizes of earlier runs
    are added.
    """
    told = rows.withColumn("_read", F.monotonically_increasing_id())
    dealt = told.repartitionByRange(group, *order, "_read").sortWithinPartitions(group, *order, "_read").drop("_read")
    placed = stash(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_run", F.shiftright("_at", 33))
    runs = placed.groupBy(group, "_run").agg(F.min("_at").alias("_low"), F.count("*").alias("_size"))
    own = Window.partitionBy(group)
    before = F.sum("_size").over(own.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    runs = stash(runs.select(group, "_run", (F.coalesce(before, F.lit(0)) - F.col("_low")).alias("_shift"), F.sum("_size").over(own).alias("n")))
    return placed.join(maybe_broadcast(runs), [group, "_run"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_run", "_shift")


class Tree:
    """Trees of one fanout over nodes (group, pos, n, h): one tree for each group.

    While a group has more than one node, every `fanout` consecutive nodes (the last run may have fewer) become
    the digest of their concatenated hashes.
    """

    def __init__(self, fanout: int = 3, height: int = HEIGHT):
        self.fanout, self.height, self.block = fanout, height, fanout**height

    def _slots(self, pos: str, h: str) -> list[Column]:
        """Conditional aggregates of a parent's children, each for the column of its slot."""
        return [F.max(F.when(F.col(pos) % self.fanout == i, F.col(h))) for i in range(self.fanout)]

    def up(self, nodes: DataFrame) -> DataFrame:
        """The nodes `height` levels above: (group, pos, n, h). Each level is a pivot of a third of the rows before; all in one task for a block."""
        cur = nodes.select("group", "n", F.expr(f"pos div {self.block}").alias("block"), "pos", "h").repartition("group", "block")
        for k in range(self.height):
            names = [f"c{i}" for i in range(self.fanout)]
            slots = [c.alias(a) for c, a in zip(self._slots("pos", "h"), names, strict=True)]
            cur = cur.groupBy("group", "n", "block", F.expr(f"pos div {self.fanout}").alias("up")).agg(*slots)
            cur = cur.select("group", "n", "block", F.col("up").alias("pos"), F.when(F.col("n") > self.fanout**k, F.sha2(F.concat_ws("", *names), 256)).otherwise(F.col("c0")).alias("h"))
        return cur.select("group", "pos", F.expr(f"(n + {self.block - 1}) div {self.block}").alias("n"), "h")

    def within(self, nodes: DataFrame) -> DataFrame:
        """nodes with block and steps: for each level inside the block, what is left and right of the node's ancestor among its siblings."""
        cur = nodes.withColumn("block", F.expr(f"pos div {self.block}")).withColumn("_h", F.col("h")).repartition("group", "block")
        names = [f"_c{i}" for i in range(self.fanout)]
        for k in range(self.height):
            size, more = self.fanout**k, F.col("n") > self.fanout**k
            cur = cur.withColumn("_at", F.expr(f"pos div {size}")).withColumn("_up", F.expr(f"pos div {size * self.fanout}"))
            over = Window.partitionBy("group", "block", "_up")
            cur = cur.select("*", *[c.over(over).alias(a) for c, a in zip(self._slots("_at", "_h"), names, strict=True)])
            slot = F.col("_at") % self.fanout
            left = F.concat_ws("", *[F.when(slot > i, F.col(a)) for i, a in enumerate(names)])
            right = F.concat_ws("", *[F.when(slot < i, F.col(a)) for i, a in enumerate(names)])
            cur = cur.withColumn(f"_s{k}", F.when(more, F.struct(left.alias("left"), right.alias("right"))))
            cur = cur.withColumn("_h", F.when(more, F.sha2(F.concat_ws("", *names), 256)).otherwise(F.col("_h"))).drop("_at", "_up", *names)
        steps = F.filter(F.array(*[f"_s{k}" for k in range(self.height)]), lambda s: s.isNotNull())
        return cur.select(*nodes.columns, "block", steps.alias("steps"))

    def climb(self, nodes: DataFrame) -> list[DataFrame]:
        """nodes and, every `height` levels, the nodes above, up to one node a group."""
        found = [nodes]
        while (found[-1].agg(F.max("n")).first()[0] or 1) > 1:
            found.append(stash(self.up(found[-1])))
        return found

    def descend(self, levels: list[DataFrame], above: DataFrame) -> DataFrame:
        """The first level's rows with `path` (the steps up to the root, then those of above) and above's other columns.

        above has group, path and more, one row for the group's root. Only the blocks' paths meet their nodes, so
        a path is made in the task that hashes it.
        """
        above = above.withColumn("pos", F.lit(0).cast("long"))
        for i, nodes in reversed(list(enumerate(levels[:-1]))):
            upper = above.withColumnRenamed("pos", "block").withColumnRenamed("path", "_above")
            more = [c for c in upper.columns if c not in ("group", "block", "_above")]
            own = nodes if i == 0 else nodes.select("group", "pos", "n", "h")
            joined = self.within(own).join(maybe_broadcast(upper), ["group", "block"]).withColumn("path", F.concat("steps", "_above"))
            above = joined.select(*[c for c in own.columns if i == 0 or c in ("group", "pos")], "path", *more)
            above = above if i == 0 else stash(above)
        return above if len(levels) > 1 else levels[0].join(maybe_broadcast(above.drop("pos")), "group")


def merkle_manifest(docs: DataFrame, fanout: int = 3, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of docs.

    A leaf is the digest of the row's fields. Leaves of a source ascend by doc_id (null first, then by leaf;
    equal rows have equal leaves and any order); sources ascend bytewise, null first. proof_sha256 is the
    digest of the siblings on the way to the root. Tampering deletes the line feeds of texts whose doc_id has
    an even CRC-32 (of its decimal form; null ids are not tampered with); folded_root folds the leaf of what
    is then there with the original siblings. Extra columns are ignored; an empty table gives no rows; a
    lone row is its own root, with an empty proof.
    """
    tree = Tree(fanout, height)
    columns = {f: F.col(f) for f in FIELDS}
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").contains("\n")
    rows = docs.select(
        "doc_id",
        F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source"))).alias("group"),
        leaf_of(columns).alias("h"),
        F.when(tampered, leaf_of(columns | {"text": F.translate("text", "\n", "")})).alias("now"),
    )
    # Stashed first, as dealing by range reads its input twice.
    levels = tree.climb(stash(numbered(stash(rows), "group", ["doc_id", "h"])))
    subroots = levels[-1].select(F.col("group").alias("of"), F.lit("").alias("group"), F.col("h"))
    tops = tree.climb(stash(numbered(subroots, "group", ["of"])))
    root = tops[-1].first()
    root = F.lit(root.h if root else None).cast("string")
    none = F.array().cast("array<struct<left:string,right:string>>")
    start = docs.sparkSession.range(1).select(F.lit("").alias("group"), none.alias("path"))
    sources = stash(tree.descend(tops, start).select(F.col("of").alias("group"), "path", F.col("h").alias("subroot")))
    out = tree.descend(levels, sources)
    folded = F.aggregate("path", F.coalesce("now", "h"), lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    out = out.select("doc_id", F.col("h").alias("leaf"), "subroot", root.alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
