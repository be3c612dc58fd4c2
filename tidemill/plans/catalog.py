"""Metric tables as declarative SQL: each names its inputs, and a dialect spells the few words engines differ in."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemill.sources.storage import exists, kept_path

#: From so many computations an input is written once instead; CHEAP ones are projections or a join of base tables, of which each reader takes few columns.
MANY = 3
CHEAP = ("ev", "ev_net", "ev_graph")

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@dataclass(frozen=True)
class Dialect:
    spark: bool

    @property
    def string(self) -> str:
        return "STRING" if self.spark else "VARCHAR"

    def days(self, later: str, earlier: str) -> str:
        return f"CAST(datediff({later}, {earlier}) AS BIGINT)" if self.spark else f"CAST(date_diff('day', {earlier}, {later}) AS BIGINT)"

    def plus_days(self, day: str, n: str) -> str:
        return f"date_add({day}, CAST({n} AS INT))" if self.spark else f"CAST({day} + CAST({n} AS INTEGER) AS DATE)"

    def weekday(self, ts: str) -> str:
        """1 = Sunday to 7 = Saturday."""
        return f"CAST(dayofweek({ts}) AS BIGINT)" if self.spark else f"CAST(dayofweek({ts}) + 1 AS BIGINT)"

    def minute(self, ts: str) -> str:
        return f"CAST(date_trunc('MINUTE', {ts}) AS TIMESTAMP_NTZ)" if self.spark else f"date_trunc('minute', {ts})"

    def last_value(self, x: str, over: str) -> str:
        return f"last_value({x}) IGNORE NULLS OVER ({over})" if self.spark else f"last_value({x} IGNORE NULLS) OVER ({over})"

    def join_sorted(self, x: str, sep: str) -> str:
        """The distinct values of a group, sorted and joined."""
        return f"array_join(array_sort(collect_set({x})), '{sep}')" if self.spark else f"array_to_string(list_sort(list_distinct(list({x}))), '{sep}')"

    def unpivot(self, names: list[str]) -> str:
        """Columns to rows (feature_name, x), in a select list."""
        if self.spark:
            return "inline(array(" + ", ".join(f"named_struct('feature_name', '{n}', 'x', CAST({n} AS DOUBLE))" for n in names) + "))"
        return f"unnest([{', '.join(repr(n) for n in names)}]) AS feature_name, unnest([{', '.join(f'CAST({n} AS DOUBLE)' for n in names)}]) AS x"


SPARK, DUCK = Dialect(True), Dialect(False)


@dataclass(frozen=True)
class Table:
    """A metric table: name, the tables it reads, and its SQL in a dialect. Internal ones aren't registered."""

    name: str
    reads: tuple[str, ...]
    sql: Callable[[Dialect], str]
    internal: bool = False


@dataclass(frozen=True)
class Written:
    """Tables that are written already, as paths by name. It stands in for a folder of base tables."""

    paths: dict[str, str]


class Catalog:
    def __init__(self) -> None:
        self.tables: dict[str, Table] = {}
        self.kept: dict[tuple, tuple] = {}  # inputs written in an application, by folder and name: path and schema

    def add(self, name: str, reads: str, sql: Callable[[Dialect], str] | str, internal: bool = False) -> None:
        text = (lambda d, s=sql: s) if isinstance(sql, str) else sql
        self.tables[name] = Table(name, tuple(reads.split()), text, internal)

    def order(self, name: str, known: tuple[str, ...] = ()) -> list[str]:
        """The table's inputs, each before those that read it, and the table."""
        out: list[str] = []

        def visit(n: str) -> None:
            if n in self.tables and n not in out and n not in known:
                for r in self.tables[n].reads:
                    visit(r)
                out.append(n)

        visit(name)
        return out

    def statement(self, name: str, dialect: Dialect, known: tuple[str, ...] = ()) -> str:
        """One statement with a CTE for each input; `known` are views that hold their rows already."""
        names = self.order(name, known)
        ctes = ",\n".join(f"{n} AS (\n{self.tables[n].sql(dialect).strip()}\n)" for n in names)
        return f"WITH {ctes}\nSELECT * FROM {name}"

    def bases(self, name: str, known: tuple[str, ...] = ()) -> set[str]:
        return {r for n in self.order(name, known) for r in self.tables[n].reads if r in BASE}

    def uses(self, name: str) -> dict[str, int]:
        """How many times each input would be computed if every reference were written out in place."""
        order = self.order(name)
        count = dict.fromkeys(order, 0) | {name: 1}
        for n in reversed(order):
            text = self.tables[n].sql(SPARK)
            for r in self.tables[n].reads:
                if r in count:
                    count[r] += count[n] * len(re.findall(rf"(?:FROM|JOIN|CROSS JOIN)\s+{r}\b", text))
        return count

    def write(self, spark: SparkSession, names: list[str], given: dict[str, DataFrame]) -> Written:
        """The named tables over given inputs (by name: tables of this catalog or base tables), in a session of its own.

        Every table named, and every input that two tables or more read, is computed once and written to the
        shared folder; all others are read from there.
        """
        session = spark.newSession()
        for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
            session.conf.set(key, spark.conf.get(key))
        paths = {}
        for n, df in given.items():
            paths[n] = kept_path(spark)
            df.write.parquet(paths[n])
            session.read.schema(df.schema).parquet(paths[n]).createOrReplaceTempView(n)
        known = list(given)
        order: list[str] = []
        for name in names:
            order += [n for n in self.order(name, tuple(known)) if n not in order]
        readers = Counter(r for n in order for r in set(self.tables[n].reads))
        for n in order:
            if n in names or readers[n] > 1:
                paths[n] = kept_path(spark)
                session.sql(self.statement(n, SPARK, tuple(known))).write.parquet(paths[n])
                session.read.parquet(paths[n]).createOrReplaceTempView(n)
                known.append(n)
        return Written(paths)

    def frame(self, spark: SparkSession, sf_dir: str | Written, name: str) -> DataFrame:
        """The table over the Parquet files of a folder, or over written tables, in a session of its own, so that folders don't mix.

        Spark writes CTEs out in place. Inputs that would be computed MANY times or more are written to the
        shared folder once and read from there, each from the ones before it, also by later frames over the same folder.
        """
        session = spark.newSession()
        for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
            session.conf.set(key, spark.conf.get(key))
        written = sf_dir.paths if isinstance(sf_dir, Written) else {}
        if name in written:
            return session.read.parquet(written[name])
        where = (spark.sparkContext.applicationId, tuple(sorted(written.items())) if written else str(sf_dir))
        order = self.order(name)
        kept = {n: self.kept[*where, n] for n in order if n not in written and (*where, n) in self.kept and exists(spark, self.kept[*where, n][0])}
        known = [n for n in order if n in written or n in kept]
        for n in known:
            (session.read.schema(kept[n][1]).parquet(kept[n][0]) if n in kept else session.read.parquet(written[n])).createOrReplaceTempView(n)
        if name in kept:
            return session.table(name)
        for base in self.bases(name, tuple(known)):
            session.read.parquet(f"{sf_dir}/{base}.parquet").createOrReplaceTempView(base)
        for n in self.order(name, tuple(known))[:-1]:
            if n not in CHEAP and self.uses(name)[n] >= MANY:
                df, path = session.sql(self.statement(n, SPARK, tuple(known))), kept_path(spark)
                df.write.parquet(path)
                self.kept[*where, n] = path, df.schema
                session.read.schema(df.schema).parquet(path).createOrReplaceTempView(n)
                known.append(n)
        return session.sql(self.statement(name, SPARK, tuple(known)))
