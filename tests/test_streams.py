import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill.plans import registry
from tidemill.streaming import realtime as rt

SF = "/root/testdata/sf0.001"
SHAPE = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def write(spark, rows, path):
    """Events (id, minute, second, repository) as one file of a table of raw events."""
    start = datetime(2024, 1, 1)
    at = [(i, start + timedelta(minutes=m, seconds=s), 1, "view", 1.0, f'{{"k": {k}}}') for i, m, s, k in rows]
    spark.createDataFrame(at, SHAPE).coalesce(1).write.mode("append").parquet(path)


def batch_alerts(rows):
    """By definition: each id once, counts by minute and repository against the minute's mean."""
    counts = {}
    for _, m, _, k in {r[0]: r for r in rows if r[0] is not None}.values():
        counts[m, k] = counts.get((m, k), 0) + 1
    out = set()
    for (m, k), n in counts.items():
        own = [x for (at, _), x in counts.items() if at == m]
        ratio = n / max(sum(own) / len(own), 1.0)
        if ratio >= 2:
            out.add((m, f"org{k % 10}/repo{k}", n, round(ratio, 6), "high" if ratio >= 4 else "medium"))
    return out


def alerts(df):
    return sorted((r.window_start.minute, r.repo_name, r.current_events, r.anomaly_ratio, r.alert_level) for r in df.collect())


def events():
    """Five minutes, each with one busy repository (in the last one very busy) among eight quiet ones."""
    rows = []
    for m in range(5):
        rows += [(1000 * m + i, m, i, 10 + i) for i in range(8)] + [(1000 * m + 100 + i, m, 10 + i, 3) for i in range(4 if m < 4 else 40)]
    return rows


def test_alerts_come_while_the_stream_runs(spark, tmp_path):
    rows, path = events(), str(tmp_path / "events.parquet")
    write(spark, [r for r in rows if r[1] < 3], path)
    run = rt.Alerts(spark, path, "1 minute", "5 seconds", root=str(tmp_path / "run"))
    run.start().awaitTermination()
    early = alerts(run.found())
    assert {a[0] for a in early} == {0, 1}  # minute 2 may still get events
    write(spark, [r for r in rows if r[1] >= 3] + rows[:20] + [r for r in rows if r[1] == 3], path)  # old and new ones twice
    run.start().awaitTermination()
    assert {a[0] for a in alerts(run.found())} == {0, 1, 2, 3}
    run.mark(datetime(2024, 1, 2))
    run.start().awaitTermination()
    want = batch_alerts(rows)
    assert len(want) == 5 and {a[4] for a in want} == {"medium", "high"}
    assert alerts(run.found()) == sorted(want)
    run.start().awaitTermination()  # nothing new: nothing comes twice
    assert alerts(run.found()) == sorted(want)


def test_all_alerts_equal_the_batch(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    got = rt.all_alerts(spark, f"{SF}/events.parquet", "1 day", "5 seconds").collect()
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    counts = events.groupBy(F.date_trunc("day", "ts").cast("timestamp").alias("window_start"), F.concat(F.lit("org"), k % 10, F.lit("/repo"), k).alias("repo_name")).agg(F.count("*").alias("events"))
    base = counts.groupBy("window_start").agg(F.avg("events").alias("baseline_events"))
    want = rt.alerts_of(counts.join(base, "window_start")).collect()
    assert want and sorted(map(str, got)) == sorted(map(str, want))


def test_a_message_delivered_twice_counts_once(spark, tmp_path):
    """Within a file, across micro-batches and across a restart; events without an id all count."""
    rows, path, state = [(1, 0, 1, 3), (1, 0, 1, 3), (2, 0, 2, 3), (None, 0, 3, 3), (None, 0, 3, 3)], str(tmp_path / "events.parquet"), str(tmp_path / "run")
    totals = []
    for more in (rows, [(2, 0, 2, 3), (3, 0, 4, 3)], [(1, 0, 1, 3), (3, 0, 4, 3), (4, 1, 0, 5)]):
        write(spark, more, path)
        for metrics, keys in ((rt.event_metrics, ["window_start", "event_type", "repo_name", "actor_category"]), (rt.repo_scores, ["window_start", "repo_name"])):
            out = rt.drain(metrics(rt.read_events(spark, path), "1 minute", "30 seconds"), keys, f"{state}-{metrics.__name__}")
            column = "event_count" if metrics is rt.event_metrics else "events"
            totals.append({r.repo_name: r[column] for r in out.collect()})
    assert totals == [{"org3/repo3": 4}] * 2 + [{"org3/repo3": 5}] * 2 + [{"org3/repo3": 5, "org5/repo5": 1}] * 2


def test_streams_of_no_events(spark, tmp_path):
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame([], SHAPE).write.parquet(path)
    assert rt.all_alerts(spark, path, "1 minute", "5 seconds").isEmpty()


@pytest.mark.parametrize("name", ["s03_realtime_anomaly_alerts"])
def test_registered_alerts(spark, name):
    assert registry.queries()[name](spark, SF).where("anomaly_ratio < 2").isEmpty()


def replay_events(spark, n=12):
    start = datetime(2024, 1, 1)
    at = [(i, start + timedelta(seconds=10 * (i // 2), milliseconds=400 * (i % 2)), f"o/r{i % 3}") for i in range(n)]
    return spark.createDataFrame([*at, (99, None, "o/none")], "event_id long, ts timestamp, repo_name string").repartition(3)


def test_gaps_of_a_replay():
    from tidemill.streaming.replay import due

    assert due([5, 6, 16, 1000], 10) == [0.0, 0.1, 1.1, 3.1] and due([], 1) == [] and due([3, 5], 0.1) == [0.0, 2.0]


def test_replay_keeps_the_order_and_resumes(spark, tmp_path):
    """Batches go up in event time; a stream stopped halfway goes on with the next slice, and none comes twice."""
    from tidemill.streaming import replay

    path, seen = str(tmp_path / "staged"), []
    replay.stage(replay_events(spark), path)

    def run(until, speedup):
        stream = replay.replay(spark, path, str(tmp_path / "state"), speedup=speedup, slices_per_trigger=1)

        def take(batch, number):
            rows = [(r.ts, r.event_id) for r in batch.collect()]
            if rows:
                seen.append(rows)

        q = stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "check")).start()
        began = time.time()
        while len(seen) < until and time.time() - began < 60 and q.isActive:
            time.sleep(0.05)
        q.stop()
        return time.time() - began

    run(3, 1000.0)
    half = sum(map(len, seen))
    assert 6 <= half < 12
    run(6, 1000.0)
    flat = [x for rows in seen for x in rows]
    assert flat == sorted(flat) and [i for _, i in flat] == list(range(12))


def test_replay_waits_for_the_gaps(spark, tmp_path):
    """Five gaps of ten seconds at ten times the pace last five seconds."""
    from tidemill.streaming import replay

    path, seen = str(tmp_path / "staged"), []
    replay.stage(replay_events(spark), path)
    q = replay.replay(spark, path, str(tmp_path / "state"), speedup=10.0).writeStream.foreachBatch(lambda b, n: seen.extend((time.time(), r.event_id) for r in b.collect())).option("checkpointLocation", str(tmp_path / "check")).start()
    began = time.time()
    while len(seen) < 12 and time.time() - began < 60:
        time.sleep(0.05)
    q.stop()
    assert sorted(i for _, i in seen) == list(range(12)) and seen[-1][0] - seen[0][0] > 3.5
