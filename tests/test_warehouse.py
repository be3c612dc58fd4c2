import json
import threading

import pytest
from pyspark.sql import functions as F

from tidemill.sources.warehouse import Warehouse, of_group


def test_versions_are_whole(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    assert w.versions() == [] and w.manifest()["tables"] == {}
    assert w.load({"b01": spark.range(3), "p01": lambda: spark.range(4)}) == {"version": 1, "loaded": ["b01", "p01"], "skipped": []}
    assert w.load({"b01": spark.range(5).withColumn("x", F.lit("é"))})["version"] == 2
    assert (w.read("b01").count(), w.read("b01", 1).count(), w.read("p01").count()) == (5, 3, 4)
    assert {n: e["version"] for n, e in w.manifest()["tables"].items()} == {"b01": 2, "p01": 1}
    with pytest.raises(KeyError):
        w.read("other")


def test_a_load_that_fails_leaves_the_version_before(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    w.load({"b01": spark.range(3)})

    def broken():
        raise RuntimeError("no such input")

    with pytest.raises(RuntimeError):
        w.load({"b01": spark.range(9), "b02": broken})
    with pytest.raises(Exception, match="divide|zero"):
        w.load({"b01": spark.range(9).select((F.lit(1) / F.col("id")).alias("x"))})
    assert w.versions() == [1] and w.read("b01").count() == 3
    spark.range(2).write.parquet(str(tmp_path / "in" / "b02"))
    folders = {n: str(tmp_path / "in" / n) for n in ("b02", "b03")}
    with pytest.raises(FileNotFoundError):
        w.load(folders)
    assert w.load(folders, skip_missing=True) == {"version": 2, "loaded": ["b02"], "skipped": ["b03"]}


def test_two_loads_at_once_both_stay(spark, tmp_path):
    w, got = Warehouse(spark, str(tmp_path / "w")), []
    gate, real = threading.Barrier(3), Warehouse.manifest

    def manifest(self, version=None):
        found = real(self, version)
        if not getattr(self, "met", False):
            self.met = True
            gate.wait(60)  # all have read the same version before any publishes
        return found

    def run(i):
        mine = Warehouse(spark, str(tmp_path / "w"))
        mine.manifest = manifest.__get__(mine)
        got.append(mine.load({f"b{i:02}": spark.range(i + 1)})["version"])

    threads = [threading.Thread(target=run, args=(i,)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == [1, 2, 3] and sorted(w.manifest()["tables"]) == ["b00", "b01", "b02"]
    assert not list((tmp_path / "w" / "manifest").glob(".draft*[!c]"))


def test_expire_keeps_what_is_named(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    w.load({"a": spark.range(1), "p": spark.range(7)})
    for i in range(4):
        w.load({"a": spark.range(i)})
    assert w.expire(keep=2) == 3 and w.versions() == [4, 5]
    assert w.read("p").count() == 7 and w.read("a", 4).count() == 2 and w.expire(keep=2) == 0


def test_verify_and_snapshot(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    at = F.to_timestamp(F.concat(F.lit("2024-01-01 00:0"), (F.col("id") % 3).cast("string"), F.lit(":00")))
    scores = spark.range(40).select(at.alias("window_start"), F.concat(F.lit("r"), "id").alias("repo_name"), F.col("id").cast("double").alias("hotness_score"))
    w.load({"rt_repo_scores": scores, "rt_anomaly_alerts": spark.createDataFrame([], "window_start timestamp, repo_name string, anomaly_ratio double")})
    rows = {r.name: r for r in w.verify(top=2).collect()}
    assert rows["rt_repo_scores"].agrees and rows["rt_repo_scores"].rows == 40 and len(rows["rt_repo_scores"]["first"]) == 2 and rows["rt_anomaly_alerts"].agrees
    out = str(tmp_path / "out.json")
    assert w.export(out, every=0.01, times=2, limits={"realtime_repo_scores": 4}) == 2
    got = json.load(open(out))
    assert got["version"] == 1 and got["realtime_event_metrics"] == got["realtime_anomaly_alerts"] == []
    assert [r["repo_name"] for r in got["realtime_repo_scores"]] == ["r38", "r35", "r32", "r29"]
    path = w.manifest()["tables"]["rt_repo_scores"]["path"]
    spark.range(1).write.mode("overwrite").parquet(f"{tmp_path}/w/{path}")
    assert not {r.name: r for r in w.verify().collect()}["rt_repo_scores"].agrees


def test_groups():
    names = ["b01_x", "g06_y", "m08_z", "p01_w", "q_v"]
    assert of_group(names, "daily") == ["b01_x"] and of_group(names, "people") == ["g06_y", "m08_z", "p01_w"] and of_group(names, "all") == names[:4]
