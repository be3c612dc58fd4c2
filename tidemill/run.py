"""Command line: raw JSON events to curated Parquet, and curated events to metric tables.

    python -m tidemill.run curate RAW... --out DIR
    python -m tidemill.run tables CURATED --out DIR [--only NAME...] [--models] [--json DIR]
    python -m tidemill.run load TABLES --root DIR [--group NAME] [--skip-missing]
    python -m tidemill.run verify --root DIR [--top N]
    python -m tidemill.run export --root DIR --out FILE [--every SECONDS] [--times N]
    python -m tidemill.run sweep [--hours N]
"""

from __future__ import annotations

import argparse
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from tidemill.sources import adapters, curate, storage, warehouse


def table_names() -> list[str]:
    """Metric tables that follow from activity events alone."""
    from tidemill.plans.registry import CATALOG

    def own(name: str) -> bool:
        return all(r in ("ev", "ev_graph") or (r in CATALOG.tables and own(r)) for r in CATALOG.tables[name].reads)

    return [n for n, t in CATALOG.tables.items() if not t.internal and n[0] in "bmgp" and own(n)]


def model_names() -> list[str]:
    """Tables of models and iterative graphs, and the reads over them; streams aren't among them."""
    from tidemill.plans.registry import PLANS, STREAMED

    return [n for n in PLANS if n not in STREAMED]


def tables(spark: SparkSession, curated: DataFrame, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Tables over curated events, all SQL tables by default; what several SQL tables read is computed once.

    Models and iterative graphs read the SQL tables named with them, and compute others that they need.
    """
    from tidemill.plans.registry import CATALOG, PLANS

    names = names or table_names()
    ev = adapters.activity(curated)
    graph = ev.where("actor_login <> 'unknown' and repo_name <> 'unknown/unknown'").select("event_id", "metric_date", "actor_login", "repo_name", "event_type")
    done = CATALOG.write(spark, [n for n in names if n not in PLANS], {"ev": ev, "ev_graph": graph})
    return {n: PLANS[n](spark, done) if n in PLANS else spark.read.parquet(done.paths[n]) for n in names}


def write_tables(found: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Each table as Parquet in a folder of its name; returns their numbers of rows."""
    rows = {}
    for name, df in found.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        rows[name] = df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}").count()
    return rows


def write_json(found: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines, for readers without Parquet."""
    for name, df in found.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A small report as one line of JSON, with the time at which it was made."""
    line = json.dumps(report | {"generated_at": datetime.now(timezone.utc).isoformat()}, sort_keys=True, default=str)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tidemill")
    sub = p.add_subparsers(dest="what", required=True)
    c = sub.add_parser("curate", help="raw JSON lines to curated Parquet and a cleaning report")
    c.add_argument("raw", nargs="+")
    t = sub.add_parser("tables", help="curated events to metric tables")
    t.add_argument("curated")
    t.add_argument("--only", nargs="*")
    t.add_argument("--models", action="store_true", help="also tables of models and iterative graphs")
    t.add_argument("--json")
    s = sub.add_parser("sweep", help="delete intermediate tables of the shared folder")
    s.add_argument("--hours", type=float, default=48, help="only those this old; more than any running job")
    for x in (c, t):
        x.add_argument("--out", required=True)
    wl = sub.add_parser("load", help="Parquet tables of a folder as a new version of a warehouse")
    wl.add_argument("tables")
    wl.add_argument("--group", choices=sorted(warehouse.GROUPS), default="all")
    wl.add_argument("--skip-missing", action="store_true")
    wv = sub.add_parser("verify", help="rows and first rows of the latest version's tables")
    wv.add_argument("--top", type=int, default=5)
    we = sub.add_parser("export", help="the latest version's sections as one JSON document")
    we.add_argument("--out", required=True)
    we.add_argument("--every", type=float)
    we.add_argument("--times", type=int, default=1)
    for x in (wl, wv, we):
        x.add_argument("--root", required=True)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tidemill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.what == "sweep":
        print(storage.sweep(spark, a.hours))
        return
    if a.what in ("load", "verify", "export"):
        w = warehouse.Warehouse(spark, a.root)
        if a.what == "load":
            names = warehouse.of_group(table_names() + model_names(), a.group)
            print(json.dumps(w.load({n: f"{a.tables.rstrip('/')}/{n}" for n in names}, a.skip_missing)))
        elif a.what == "verify":
            w.verify(a.top).show(1000, False)
        else:
            w.export(a.out, a.every, a.times)
        return
    if a.what == "curate":
        write_report(spark, curate.write_curated(curate.read_raw(spark, a.raw), a.out), f"{a.out.rstrip('/')}-report")
        return
    found = tables(spark, spark.read.parquet(a.curated), a.only or table_names() + (model_names() if a.models else []))
    write_report(spark, write_tables(found, a.out), f"{a.out.rstrip('/')}/_report")
    if a.json:
        write_json(found, a.json)


if __name__ == "__main__":
    main()
