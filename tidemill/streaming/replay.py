"""Replay of stored events as a stream, at their own pace or faster.

Events are staged once by slices of event time; a table of the slices says when each is due. The stream's offset is the
number of the last slice sent, so a restart over the same checkpoint goes on with the next one, and batches come in
the order of event time. Gaps between slices last a `speedup`-th of what they did, and LONGEST_GAP seconds at most.
"""

from __future__ import annotations

import json
import time
from bisect import bisect_right

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Seconds that a gap between slices lasts at most.
LONGEST_GAP = 2.0


def stage(events: DataFrame, path: str, slice_seconds: int = 1, time_column: str = "ts") -> None:
    """Write events (with a timestamp column) by slices of event time, in order within a slice; those without a time go.

    `path`/events holds a folder of Parquet for each slice, `path`/slices the numbers of slices with their times.
    """
    at = F.floor(F.unix_micros(F.col(time_column).cast("timestamp")) / (slice_seconds * 1_000_000))
    known = events.where(F.col(time_column).isNotNull()).withColumn("_at", at)
    times = known.select("_at").distinct()
    order = Window.orderBy("_at")  # one row for each slice that has events: bounded by the time they span
    times = times.select("_at", (F.row_number().over(order) - 1).alias("slice"))
    times.select("slice", (F.col("_at") * slice_seconds).alias("second")).coalesce(1).write.parquet(f"{path}/slices")
    numbers = events.sparkSession.read.parquet(f"{path}/slices").select("slice", (F.col("second") / slice_seconds).cast("long").alias("_at"))
    known = known.join(F.broadcast(numbers), "_at").drop("_at")
    known.repartition("slice").sortWithinPartitions("slice", time_column).write.partitionBy("slice").parquet(f"{path}/events")


def due(seconds: list[int], speedup: float) -> list[float]:
    """When each slice is due, in seconds after the first."""
    out, at = [], 0.0
    for i, s in enumerate(seconds):
        at += min((s - seconds[i - 1]) / max(speedup, 1.0), LONGEST_GAP) if i else 0.0
        out.append(at)
    return out


class _Slice(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)


class _Reader(DataSourceStreamReader):
    """Offsets are {"next": slice}: the first slice that has not been sent."""

    def __init__(self, schema: StructType, options: dict):
        self.path, self.state = options["path"].rstrip("/"), options["state"].rstrip("/")
        self.most = int(options.get("slicespertrigger", 1000))
        self.arrow = to_arrow_schema(schema)
        fs, at = _where(f"{self.path}/slices")
        rows = pq.read_table(at, filesystem=fs).sort_by("slice")
        self.due = due(rows["second"].to_pylist(), float(options.get("speedup", 1.0)))
        self.began, self.base = None, 0

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        # Planned offsets are noted beside the checkpoint, as this call doesn't say where the stream stands.
        planned = self._planned()
        if self.began is None:
            self.began, self.base = time.time(), planned
        from_start = self.due[self.base] if self.base < len(self.due) else 0.0
        ready = bisect_right(self.due, from_start + time.time() - self.began)
        return {"next": max(planned, min(ready, planned + self.most))}

    def _planned(self) -> int:
        fs, at = _where(f"{self.state}/next")
        if fs.get_file_info(at).type == pafs.FileType.NotFound:
            return 0
        with fs.open_input_stream(at) as f:
            return json.loads(f.read())["next"]

    def partitions(self, start: dict, end: dict):
        if end["next"] > self._planned():
            fs, at = _where(self.state)
            fs.create_dir(at, recursive=True)
            with fs.open_output_stream(f"{at}/next.draft") as f:
                f.write(json.dumps(end).encode())
            fs.move(f"{at}/next.draft", f"{at}/next")
        return [_Slice(i) for i in range(start["next"], end["next"])]

    def read(self, partition):
        fs, at = _where(f"{self.path}/events/slice={partition.value}")
        for info in fs.get_file_info(pafs.FileSelector(at)):
            if info.path.endswith(".parquet"):
                with fs.open_input_file(info.path) as f:
                    for batch in pq.ParquetFile(f, coerce_int96_timestamp_unit="us").iter_batches(columns=self.arrow.names):
                        yield from pa.Table.from_batches([batch]).select(self.arrow.names).cast(self.arrow).to_batches()


def _where(path: str):
    """File system and path of a local path or a URI."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class Replay(DataSource):
    """options: path (staged events), state (a folder of this stream's own), speedup, slicesPerTrigger."""

    @classmethod
    def name(cls) -> str:
        return "replay"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(schema, {k.lower(): v for k, v in self.options.items()})


def replay(spark: SparkSession, path: str, state: str, speedup: float = 1.0, slices_per_trigger: int = 1000) -> DataFrame:
    """The staged events as a stream; `state` belongs to one query, as its checkpoint does."""
    spark.dataSource.register(Replay)
    schema = spark.read.parquet(f"{path}/events").drop("slice").schema
    return spark.readStream.format("replay").schema(schema).option("path", path).option("state", state).option("speedup", speedup).option("slicesPerTrigger", slices_per_trigger).load()
