"""Metric tables in versions: a load is seen whole or not at all, and exports and checks read one version.

A load writes its tables to a folder of its own, then a manifest of all tables of the version, and publishes it by
renaming that manifest to the next number. Renaming fails where the number is taken, so of two loads at once one takes
the next number, on the manifest that the other left. Readers open the highest number; a load that fails has none.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Groups of tables that are loaded together, by what their names begin with.
GROUPS = {"daily": ("b",), "people": ("p", "g06", "g07", "g13", "m08", "m09", "m10", "m12", "m16", "m17"), "network": ("g",), "models": ("m",), "all": ("b", "g", "m", "p")}
#: Sections of a snapshot: name, table, order, default number of rows (a section has 1 to 500).
SECTIONS = [("realtime_event_metrics", "rt_event_metrics", "window_start DESC, event_count DESC, event_type, repo_name", 120), ("realtime_repo_scores", "rt_repo_scores", "hotness_score DESC, repo_name", 30), ("realtime_anomaly_alerts", "rt_anomaly_alerts", "window_start DESC, anomaly_ratio DESC, repo_name", 30)]
#: Sections that show the latest window only.
LATEST_WINDOW = {"realtime_repo_scores"}


def of_group(names: Iterable[str], group: str) -> list[str]:
    """The names of a group's tables."""
    return [n for n in names if n.startswith(GROUPS[group])]


class Warehouse:
    """Versions of tables under a folder that all executors see."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        found = self.fs.globStatus(self.path(f"{self.root}/manifest/[0-9]*.json")) or []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in found)

    def manifest(self, version: int | None = None) -> dict:
        """A version's tables, the latest by default: for each its path, rows, columns and the version that wrote it."""
        known = self.versions()
        if not known:
            return {"version": 0, "tables": {}}
        version = known[-1] if version is None else version
        text = self.spark.read.text(f"{self.root}/manifest/{version}.json", wholetext=True).first()[0]
        return json.loads(text) | {"version": version}

    def read(self, name: str, version: int | None = None) -> DataFrame:
        entry = self.manifest(version)["tables"].get(name)
        if entry is None:
            raise KeyError(f"no table {name} in version {version or 'latest'}")
        return self.spark.read.parquet(f"{self.root}/{entry['path']}")

    def _put(self, path: str, text: str) -> None:
        out = self.fs.create(self.path(path), False)
        out.write(bytearray(text.encode()))
        out.close()

    def load(self, tables: dict[str, Callable[[], DataFrame] | DataFrame | str], skip_missing: bool = False) -> dict:
        """Load tables (frames, functions that give them, or Parquet folders) and publish them beside those loaded before.

        A folder that isn't there ends the load, or is left out with skip_missing. Returns the version with the
        names loaded and skipped.
        """
        folder = f"data/{uuid.uuid4().hex}"
        fresh, skipped = {}, []
        for name, source in tables.items():
            if isinstance(source, str):
                if not self.fs.exists(self.path(source)):
                    if not skip_missing:
                        raise FileNotFoundError(source)
                    skipped.append(name)
                    continue
                df = self.spark.read.parquet(source)
            else:
                df = source if isinstance(source, DataFrame) else source()
            path = f"{folder}/{name}"
            df.write.parquet(f"{self.root}/{path}")
            held = self.spark.read.schema(df.schema).parquet(f"{self.root}/{path}")
            fresh[name] = {"path": path, "rows": held.count(), "columns": dict(df.dtypes)}
        self.fs.mkdirs(self.path(f"{self.root}/manifest"))
        while True:
            before = self.manifest()
            version = before["version"] + 1
            body = {"loaded_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "tables": before["tables"] | {n: e | {"version": version} for n, e in fresh.items()}}
            draft = f"{self.root}/manifest/.draft-{uuid.uuid4().hex}"
            self._put(draft, json.dumps(body, sort_keys=True, ensure_ascii=False))
            if self._publish(draft, f"{self.root}/manifest/{version}.json"):
                return {"version": version, "loaded": sorted(fresh), "skipped": sorted(skipped)}
            self.fs.delete(self.path(draft), False)

    def _publish(self, draft: str, path: str) -> bool:
        """Rename unless the name is taken; the file system decides between two that try at once."""
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(path).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.fs.makeQualified(self.path(draft)), self.fs.makeQualified(self.path(path)), options)
        except Exception:
            if self.fs.exists(self.path(path)):
                return False
            raise
        return True

    def expire(self, keep: int = 3) -> int:
        """Delete the manifests before the last `keep` and the tables that none of these names; returns the tables deleted."""
        known = self.versions()
        held = {e["path"] for v in known[-keep:] for e in self.manifest(v)["tables"].values()}
        gone = {e["path"] for v in known[:-keep] for e in self.manifest(v)["tables"].values()} - held
        for v in known[:-keep]:
            self.fs.delete(self.path(f"{self.root}/manifest/{v}.json"), False)
        return sum(self.fs.delete(self.path(f"{self.root}/{p}"), True) for p in gone)

    def verify(self, top: int = 5, version: int | None = None) -> DataFrame:
        """A row for each table: rows by the manifest and as read, whether they agree and the columns are there, and its first `top` rows as JSON."""
        found = []
        for name, entry in sorted(self.manifest(version)["tables"].items()):
            df = self.spark.read.parquet(f"{self.root}/{entry['path']}")
            rows, order = df.count(), [c for c, t in df.dtypes if not t.startswith(("map", "variant"))]
            first = [r[0] for r in df.orderBy(*order).limit(top).select(F.to_json(F.struct(*df.columns))).collect()]
            found.append((name, entry["version"], entry["rows"], rows, rows == entry["rows"] and dict(df.dtypes) == entry["columns"], first))
        return self.spark.createDataFrame(found, "name string, version int, expected_rows long, rows long, agrees boolean, first array<string>")

    def snapshot(self, limits: dict[str, int] | None = None, version: int | None = None) -> dict:
        """The sections of one version as lists of rows, times as text; a section whose table isn't loaded is empty."""
        known = self.manifest(version)
        out = {"generated_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "version": known["version"]}
        for section, name, order, rows in SECTIONS:
            out[section] = []
            if name in known["tables"]:
                df = self.read(name, known["version"])
                if section in LATEST_WINDOW:
                    df = df.join(F.broadcast(df.agg(F.max("window_start").alias("window_start"))), "window_start")  # one row
                most = max(1, min((limits or {}).get(section, rows), 500))
                shown = df.orderBy(*[F.expr(c.removesuffix(" DESC")).desc() if c.endswith(" DESC") else F.col(c) for c in order.split(", ")]).limit(most)
                out[section] = [json.loads(r[0]) for r in shown.select(F.to_json(F.struct(*df.columns))).collect()]
        return out

    def export(self, path: str, every: float | None = None, times: int = 1, limits: dict[str, int] | None = None) -> int:
        """Write the latest snapshot as one JSON document, again each `every` seconds; returns how many were written.

        A reader finds the document before or the new one, each whole.
        """
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(path).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        for i in range(times):
            draft = f"{path}.draft-{uuid.uuid4().hex}"
            self._put(draft, json.dumps(self.snapshot(limits), ensure_ascii=False, indent=2))
            context.rename(self.fs.makeQualified(self.path(draft)), self.fs.makeQualified(self.path(path)), options)
            if every is not None and i + 1 < times:
                time.sleep(every)
        return times
