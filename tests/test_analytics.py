import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemill.operators import community, iterative
from tidemill.plans import registry
from tidemill.plans.catalog import BASE, DUCK
from tidemill.sources import curate

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in BASE:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def same(df, rel):
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    rows = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    own = rel.columns
    assert rows == sorted(str(tuple(r[own.index(c)] for c in cols)) for r in rel.fetchall())


@pytest.mark.parametrize("name", ["b01_daily_metrics", "b10_repo_day_features", "b14_repo_rank_daily", "b15_user_segment_latest", "b27_concentration_day", "b28_ecosystem_changepoints", "b35_repo_event_mix_shift_day", "p02_actor_retention_curve", "g03_repo_similarity_edges", "g10_repo_metapath_sim", "q_top_repos_week"])
def test_equals_sql(spark, duck, name):
    same(registry.queries()[name](spark, SF), duck.sql(registry.CATALOG.statement(name, DUCK)))


@pytest.mark.parametrize("name", sorted(n for n, t in registry.CATALOG.tables.items() if n.startswith(("v", "m19")) and not t.internal))
def test_views_equal_sql(spark, duck, name):
    same(registry.queries()[name](spark, SF), duck.sql(registry.CATALOG.statement(name, DUCK)))


def test_streams_equal_batch(spark, duck):
    got = registry.s01_realtime_event_metrics(spark, SF)
    assert got.agg(F.sum("event_count")).first()[0] == duck.sql("select count(*) from events").fetchall()[0][0]
    assert got.groupBy("window_start", "event_type", "repo_name", "actor_category").count().where("count > 1").isEmpty()
    scores = registry.s02_realtime_repo_scores(spark, SF)
    assert scores.agg(F.sum(sum(F.col(c) for c in ("watch_events", "fork_events", "issue_events", "pull_request_events", "push_events")))).first()[0] == 1000
    assert registry.s03_realtime_anomaly_alerts(spark, SF).where("anomaly_ratio < 2").isEmpty()


def edges(spark, pairs):
    return iterative.both_ways(spark.createDataFrame([(a, b, float(w)) for a, b, w in pairs], "a string, b string, w double"), "a", "b", "w")


def test_label_propagation_two_triangles(spark):
    e = edges(spark, [("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("d", "e", 1), ("e", "f", 1), ("d", "f", 1), ("c", "d", 0.1)])
    got = {r.node: r.community_id for r in community.label_propagation(e).collect()}
    assert got["a"] == got["b"] == got["c"] != got["d"] == got["e"] == got["f"]


def test_modularity_and_bridges(spark):
    e = edges(spark, [("a", "b", 1), ("c", "d", 1), ("b", "x", 1), ("c", "x", 1), ("x", "y", 2)])
    labels = spark.createDataFrame([(n, k) for n, k in zip("abcdxy", "112233", strict=True)], "node string, community_id string")
    q = iterative.modularity(e, labels).first()
    assert q.communities == 3 and abs(q.modularity - (8 / 12 - (3 / 12) ** 2 * 2 - (6 / 12) ** 2)) < 1e-6
    assert [(r.node, r.foreign_communities, r.bridge_score) for r in iterative.bridges(e, labels).collect()] == [("x", 2, 0.5)]


def test_community_profile(spark):
    labels = spark.createDataFrame([("r", "1"), ("s", "1"), ("t", "2")], "repo_name string, community_id string")
    events = spark.createDataFrame([("r", "AF"), ("s", "RO"), ("s", "NO"), ("t", "AF")], "repo_name string, kind string")
    (got,) = iterative.community_profile(labels, events).collect()
    assert (got["size"], got.total_events, got.watch_share, got.pr_push_ratio, got.top_members) == (2, 3, 0.333333, 0.666667, "s;r")


def test_coreness_clique_and_pendant(spark):
    e = edges(spark, [(x, y, 1) for x in "abcd" for y in "abcd" if x < y] + [("d", "p", 1)])
    assert {r.node: r.coreness for r in iterative.coreness(e).collect()} == {"a": 3, "b": 3, "c": 3, "d": 3, "p": 1}


def test_pagerank_sums_to_one(spark):
    e = edges(spark, [("a", "b", 1), ("b", "c", 2), ("c", "d", 1)])
    got = iterative.pagerank(e).collect()
    assert abs(sum(r.pagerank for r in got) - 1) < 1e-5 and max(got, key=lambda r: r.pagerank).node in "bc"


def test_curate(spark, tmp_path):
    rows = [
        {"id": "1", "type": "PushEvent", "created_at": "2024-01-02T03:04:05Z", "actor": {"login": "some-Bot"}, "repo": {"id": 7, "name": "a/golang-x"}, "payload": {"size": 3}, "public": True, "more": 1},
        {"id": "1", "type": "PushEvent", "created_at": "2024-01-02T03:04:05Z"},
        {"id": "2", "type": None, "created_at": "2024-01-02T03:04:05Z"},
        {"id": "3", "type": "WatchEvent", "created_at": "soon"},
        {"id": "4", "type": "WatchEvent", "created_at": "2024-01-02T23:04:05Z"},
    ]
    (tmp_path / "x.json").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    report = curate.write_curated(curate.read_raw(spark, [str(tmp_path / "x.json")]), str(tmp_path / "out"))
    assert report["curated"] == 2 and report["dropped"] == report["raw"] - 2
    got = {r.event_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {"1", "4"} and got["4"].repo_name == "unknown/unknown" and got["4"].event_hour == 23 and got["4"].is_watch_event and got["4"].event_month == "01"


def test_entry_module_works_without_the_subpackage():
    import __spark_entry__ as e

    assert "b14_repo_rank_daily" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def activity(spark, rows):
    """Events (day, hour, actor, repo, type) as the activity table."""
    at = [(str(i), f"2024-01-{d:02d} {h:02d}:{i % 60:02d}:00", a, r, t) for i, (d, h, a, r, t) in enumerate(rows)]
    raw = spark.createDataFrame(at, "event_id string, at string, actor_login string, repo_name string, event_type string")
    ts = F.to_timestamp("at")
    return raw.select("event_id", ts.alias("event_timestamp"), F.to_date(ts).alias("event_date"), F.hour(ts).alias("event_hour"), "event_type", "actor_login", F.when(F.col("actor_login").contains("bot"), "bot").otherwise("human").alias("actor_category"), "repo_name", F.lit(None).cast("string").alias("org_login"), F.lit("unknown").alias("language_guess"), F.lit(None).cast("string").alias("payload_action"), F.lit(None).cast("long").alias("payload_size"))


def test_tables_by_hand(spark):
    """Expectations worked out on paper: concentration, mix shift, similarity, cohorts, summaries."""
    from tidemill import run

    push = [(1, 3, "a", "o/r1", "PushEvent")] * 6 + [(1, 4, "b", "o/r2", "PushEvent")] * 3 + [(1, 5, "c", "o/r3", "PushEvent")]
    rows = push + [(2, 3, "a", "o/r1", "WatchEvent"), (2, 3, "b", "o/r1", "WatchEvent"), (3, 1, "c", "o/r1", "ForkEvent"), (3, 1, "bot-d", "p/r2", "ForkEvent")]
    got = run.tables(spark, activity(spark, rows), ["b01_daily_metrics", "b05_summary", "b27_concentration_day", "b35_repo_event_mix_shift_day", "b29_actor_cohort_day", "p02_actor_retention_curve", "b06_org_daily_metrics"])
    day = {str(r.metric_date): r for r in got["b27_concentration_day"].collect()}
    one = day["2024-01-01"]
    assert (one.total_events, one.repo_count) == (10, 3) and abs(one.top1_share - 0.6) < 1e-9 and abs(one.hhi - 0.46) < 1e-9 and abs(one.gini - 1 / 3) < 1e-6
    shift = [r for r in got["b35_repo_event_mix_shift_day"].collect() if r.repo_name == "o/r1" and str(r.metric_date) == "2024-01-02"]
    assert [(round(r.js_divergence, 6), round(r.l1_distance, 6)) for r in shift] == [(1.0, 2.0)]
    assert got["b01_daily_metrics"].agg(F.sum("event_count")).first()[0] == len(rows)
    assert {r.org_or_owner for r in got["b06_org_daily_metrics"].collect()} == {"o", "p"}
    first = {(str(r.cohort_week), r.days_since_first): (r.retained_count, r.cohort_size) for r in got["p02_actor_retention_curve"].collect()}
    assert first["2023-12-26", 0] == (3, 3) and first["2023-12-26", 1] == (2, 3)


def test_similarity_by_hand(spark):
    """{a,b,c} and {b,c,d} share two of four actors."""
    from tidemill import run

    rows = [(1, 1, x, "o/r1", "PushEvent") for x in "abc"] + [(1, 2, x, "o/r2", "PushEvent") for x in "bcd"] + [(1, 2, x, "o/r3", "PushEvent") for x in "xyz"]
    got = run.tables(spark, activity(spark, rows), ["g03_repo_similarity_edges", "g06_actor_collab_edge"])
    assert sorted((r.src_repo, r.dst_repo, r.shared_actors, r.jaccard) for r in got["g03_repo_similarity_edges"].collect()) == [("o/r1", "o/r2", 2, 0.5), ("o/r2", "o/r1", 2, 0.5)]
    edges = {(r.actor_a, r.actor_b): (r.shared_repos, r.co_days, r.weight) for r in got["g06_actor_collab_edge"].collect()}
    assert edges["b", "c"] == (2, 1, 2.0) and edges["a", "b"] == (1, 1, 1.0) and ("a", "d") not in edges


def test_alerts_by_hand(spark):
    """One minute of seven events of one repository and one of each of three others: a baseline of 2.5."""
    from tidemill import run

    ev = activity(spark, [(1, 1, "a", "o/hot", "PushEvent")] * 7 + [(1, 1, "b", f"o/r{i}", "WatchEvent") for i in range(3)])
    ev = ev.withColumn("event_timestamp", F.to_timestamp(F.lit("2024-01-01 01:00:30")))
    got = run.tables(spark, ev, ["rt_anomaly_alerts"])["rt_anomaly_alerts"].collect()
    assert [(r.repo_name, r.current_events, r.baseline_events, r.anomaly_ratio, r.alert_level) for r in got] == [("o/hot", 7, 2.5, 2.8, "medium")]


def test_dashboard_reads_by_hand(spark):
    """Sums by window over types, cohort means at the latest day, ratios to two digits, rings of three."""
    from tidemill import run

    minute = [(1, 1, "a", "o/hot", "PushEvent")] * 7 + [(1, 1, "b", f"o/r{i}", "WatchEvent") for i in range(3)] + [(2, 1, "b", "o/r1", "ForkEvent")]
    ring = [(3, 5, x, "o/p", "WatchEvent") for x in "uvw"] + [(4, 6, x, "o/q", "WatchEvent") for x in "uvwx"] + [(5, 7, x, "o/z", "WatchEvent") for x in "uv"]
    ev = activity(spark, minute + ring)
    ev = ev.withColumn("event_timestamp", F.date_trunc("hour", "event_timestamp"))
    got = run.tables(spark, ev, ["q_event_trend", "q_alerts_day", "q_repo_dna_cohort_stats", "m04_repo_dna", "g13_actor_ring", "p04_repo_bus_factor"])
    assert [(r.window_start.day, r.total_events) for r in got["q_event_trend"].collect()] == [(1, 10), (2, 1), (3, 3), (4, 4), (5, 2)]
    assert [(r.repo_name, r.anomaly_ratio, r.alert_level) for r in got["q_alerts_day"].collect()] == [("o/hot", 2.8, "medium")]
    dna = got["m04_repo_dna"].collect()
    for r in got["q_repo_dna_cohort_stats"].collect():
        own = [x for x in dna if x.cohort_group == r.cohort_group]
        assert r.repos == len(own) and abs(r.fork_share - sum(x.fork_share for x in own) / len(own)) < 1e-6 and abs(r.avg_events - sum(x.total_events for x in own) / len(own)) < 1e-6
    assert [(r.members, r.actor_count, r.repos_shared, r.co_bursts) for r in got["g13_actor_ring"].collect()] == [("u,v,w", 3, 2, 1)]
    assert {r.repo_name for r in got["p04_repo_bus_factor"].collect()} == {"o/p", "o/q"}


def test_graphs_of_curated_events(spark):
    """Five actors share a repository, so they are a clique; unknown ones join the plain counts but no network."""
    from tidemill import run

    names = ["o/r1", "o/r2", "o/r3"]
    rows = [(1 + i, 1, a, r, "PushEvent") for a in "abcd" for i, r in enumerate(names)] + [(1, 2, "e", "o/r1", "PushEvent")]
    rows += [(1, 3, "unknown", r, "WatchEvent") for r in names] + [(1, 4, a, "unknown/unknown", "WatchEvent") for a in "abcd"]
    got = run.tables(spark, activity(spark, rows), ["b05_summary", "g02_scope_network", "g03_repo_similarity_edges", "g04_repo_community", "g08_actor_coreness", "q_repo_community_by_repo"])
    assert {(r.actor_login, r.coreness) for r in got["g08_actor_coreness"].collect()} == {(a, 4) for a in "abcde"}
    assert {(r.repo_name, r.actors) for r in got["g02_scope_network"].collect()} == {("o/r1", 5), ("o/r2", 4), ("o/r3", 4)}
    assert {(r.src_repo, r.dst_repo): r.jaccard for r in got["g03_repo_similarity_edges"].collect()}["o/r2", "o/r3"] == 1.0
    assert {r.repo_name for r in got["g04_repo_community"].collect()} == set(names)
    assert [r.repo_name for r in got["q_repo_community_by_repo"].collect()] == ["o/r3"]
    assert len(run.model_names()) > 60 and not set(run.model_names()) & set(run.table_names())


def test_messages_of_a_broker(spark):
    """Events come back from their messages; what is no event goes."""
    from tidemill.streaming import realtime

    events = spark.createDataFrame([("2024-01-01 01:00:30", "PushEvent", "o/r", "human"), ("2024-01-01 02:00:00", "WatchEvent", "o/r", None)], "ts string, event_type string, repo_name string, actor_category string").withColumn("ts", F.to_timestamp("ts"))
    sent = realtime.messages(events)
    assert {r.key for r in sent.collect()} == {"o/r"}
    bad = spark.createDataFrame([("k", "no json"), ("k", '{"event_type": "PushEvent"}'), ("k", None)], "key string, value string")
    got = realtime.parse_messages(sent.unionByName(bad))
    assert sorted(map(str, got.select(*events.columns).collect())) == sorted(map(str, events.collect())) and got.where("event_id is not null").isEmpty()
    named = events.withColumn("event_id", F.lit("7"))
    assert {r.event_id for r in realtime.parse_messages(realtime.messages(named)).collect()} == {"7"}


def test_sweep_deletes_old_tables_only(spark, tmp_path, monkeypatch):
    import os

    from tidemill.sources import storage

    monkeypatch.setattr(storage, "shared_dir", lambda spark: str(tmp_path))
    assert storage.sweep(spark) == 0
    old, new = storage.keep(spark.range(3)), storage.keep(spark.range(4))
    (tmp_path / "other").mkdir()
    first = [p for p in tmp_path.glob("tidemill-*") if spark.read.parquet(str(p)).count() == 3][0]
    for p in (first, tmp_path / "other"):
        os.utime(p, (1, 1))
    assert storage.sweep(spark) == 1 and not first.exists() and (tmp_path / "other").exists()
    assert new.count() == 4 and old.columns == ["id"]


def test_raw_events_to_tables(spark, tmp_path):
    from tidemill import run

    kinds = ["PushEvent", "WatchEvent", "ForkEvent", "IssuesEvent", "PullRequestEvent"]
    rows = [{"id": str(i), "type": kinds[i % 5], "created_at": f"2024-01-{1 + i % 9:02d}T0{i % 7}:00:00Z", "actor": {"login": f"u{i % 11}"}, "repo": {"id": i % 6, "name": f"o{i % 2}/r{i % 6}"}, "payload": {"size": i}} for i in range(300)]
    (tmp_path / "x.json").write_text("\n".join(map(json.dumps, rows)))
    curate.write_curated(curate.read_raw(spark, [str(tmp_path / "x.json")]), str(tmp_path / "curated"))
    names = ["b01_daily_metrics", "b05_summary", "b10_repo_day_features", "b14_repo_rank_daily", "b16_repo_rank_score_day", "b17_repo_rank_delta_explain_day", "b26_repo_rank_explain_latest", "b32_repo_contributor_concentration_day", "m04_repo_dna", "p01_actor_burst_stability"]
    found = run.tables(spark, spark.read.parquet(str(tmp_path / "curated")), names)
    counts = run.write_tables(found, str(tmp_path / "out"))
    assert set(counts) == set(names) and counts["b14_repo_rank_daily"] == 6 and counts["m04_repo_dna"] == 6
    run.write_json({"b05_summary": found["b05_summary"]}, str(tmp_path / "json"))
    run.write_report(spark, counts, str(tmp_path / "report"))
    assert "generated_at" in spark.read.json(str(tmp_path / "report")).columns
    # One day again replaces that day and leaves the others.
    (tmp_path / "y.json").write_text(json.dumps(rows[0]))
    before = spark.read.parquet(str(tmp_path / "curated")).count()
    curate.write_curated(curate.read_raw(spark, [str(tmp_path / "y.json")]), str(tmp_path / "curated"))
    spark.catalog.clearCache()
    hour = sum(r["created_at"] == rows[0]["created_at"] for r in rows)
    assert spark.read.parquet(str(tmp_path / "curated")).count() == before - hour + 1
    assert len(run.table_names()) > 50


def test_lineage_by_hand(spark):
    weekly = [(0, "x", r) for r in "abc"] + [(0, "y", r) for r in "pq"] + [(1, "z", r) for r in "abcd"] + [(1, "w", r) for r in "mn"]
    got = {(r.week_idx, r.community_id): (r.event_type, r.prev_community_id, r.overlap_jaccard) for r in iterative.lineage(spark.createDataFrame(weekly, "week_idx int, community_id string, repo_name string")).collect()}
    assert got == {(0, "x"): ("birth", None, 0.0), (0, "y"): ("birth", None, 0.0), (1, "z"): ("continue", "x", 0.75), (1, "w"): ("birth", None, 0.0), (1, "y"): ("death", "y", 0.0)}


def test_betweenness_equals_brute_force(spark):
    """A path of five nodes and a triangle: every node is a source, shortest paths are counted one by one."""
    from itertools import permutations

    pairs = [("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("d", "e", 1), ("c", "x", 1), ("d", "x", 2)]
    got = {r.node: r.betweenness for r in iterative.betweenness(edges(spark, pairs).withColumn("k", F.lit(1)), most=10**6).collect()}
    assert set(got) == set("abcdex") and got["a"] == got["e"] == 0
    far = {(u, v): w for u, v, w in pairs} | {(v, u): w for u, v, w in pairs}

    def walks(s, t):
        out, todo = [], [([s], 0)]
        while todo:
            p, d = todo.pop()
            if p[-1] == t:
                out.append((d, p))
                continue
            todo += [(p + [v], d + w) for (u, v), w in far.items() if u == p[-1] and v not in p]
        low = min(d for d, _ in out)
        return [p for d, p in out if d == low]

    share = dict.fromkeys("abcdex", 0.0)
    for s, t in permutations("abcdex", 2):
        found = walks(s, t)
        for p in found:
            for v in p[1:-1]:
                share[v] += 1 / len(found)
    every = iterative.dependencies(edges(spark, pairs), spark.createDataFrame([(x,) for x in "abcdex"], "node string"))
    assert {r.node: round(r.part, 9) for r in every.collect()} == {x: round(v, 9) for x, v in share.items()}
    sampled = iterative.betweenness(edges(spark, pairs))
    assert sampled.count() == 6
    import tidemill.operators.iterative as it

    whole = {r.node: r.betweenness for r in it.betweenness(edges(spark, pairs + [(f"{c}2", f"{d}2", 1) for c, d in ("ab", "bc", "cd", "de", "cx")] + [("d2", "x2", 2)]), most=12).collect()}
    assert set(whole) >= set("abcdex") and whole["c"] >= whole["b"] >= whole["a"] == 0 and share["c"] > share["b"] > share["a"] == 0


def test_dependencies_of_a_random_graph(spark):
    """Many ways of equal length, weights of one digit after the point, two parts: against Brandes' algorithm by hand."""
    import heapq
    import random

    r = random.Random(8)
    pairs = [(f"n{a:02}", f"n{b:02}", r.choice([0.1, 0.2, 0.3])) for a in range(25) for b in range(a) if r.random() < 0.15] + [("x", "y", 1), ("y", "z", 1)]
    near = {}
    for a, b, w in pairs:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    total = dict.fromkeys(near, 0.0)
    for s in near:
        far, queue = {}, [(0.0, s)]
        while queue:
            d, v = heapq.heappop(queue)
            if v not in far:
                far[v] = d
                for u, w in near[v]:
                    heapq.heappush(queue, (round(d + w, 9), u))
        order, ways, share = sorted(far, key=far.get), {s: 1}, dict.fromkeys(far, 0.0)
        before = {v: [u for u, w in near[v] if round(far[u] + w, 9) == far[v]] for v in order}
        for v in order[1:]:
            ways[v] = sum(ways[u] for u in before[v])
        for v in reversed(order[1:]):
            for u in before[v]:
                share[u] += ways[u] / ways[v] * (1 + share[v])
            total[v] += share[v]
    e = edges(spark, pairs)
    got = {x.node: x.part for x in iterative.dependencies(e, e.select(F.col("src").alias("node")).distinct()).collect()}
    assert got == pytest.approx(total, abs=1e-9)


def test_influence_on_a_star(spark):
    """With certain edges a hub reaches all; the greedy seed is the hub, and reach counts the seeds."""
    import numpy as np

    from tidemill.operators import influence as inf

    n = 6
    reach = inf.closure(n, np.array([0, 0, 1, 4]), np.array([1, 2, 3, 5]))
    assert reach.sum(1).tolist() == [4, 2, 1, 1, 2, 1]
    e = edges(spark, [("hub", f"n{i}", 10_000) for i in range(5)] + [("p", "q", 10_000)])
    ids = spark.createDataFrame([(x, i) for i, x in enumerate(["hub", "n0", "n1", "n2", "n3", "n4", "p", "q"])], "node string, id int")
    found = inf.reached(e, ids, 8, samples=400)
    mean = found.where("node = 0").agg(F.avg(F.bit_count(F.conv(F.hex("bits"), 16, 10).cast("long")))).first()[0]
    assert abs(mean - 2) < 0.25  # itself, and each of five neighbours with probability 0.2
    ((first, gain), *_), _ = inf.greedy(found, list(range(8)), 400, 2)
    assert first == 0 and abs(gain - mean) < 1e-6


def plain_greedy(rows, samples, most):
    """Every gain anew for every seed."""
    reach, covered, out = {}, {}, []
    for r in rows:
        reach.setdefault(r.node, {})[r.sample] = int.from_bytes(bytes(r.bits), "big")
    for _ in range(most):
        gains = {n: sum((x & ~covered.get(s, 0)).bit_count() for s, x in own.items()) for n, own in reach.items() if n not in [m for m, _ in out]}
        best = min(gains, key=lambda n: (-gains[n], n))
        out.append((best, gains[best] / samples))
        for s, x in reach[best].items():
            covered[s] = covered.get(s, 0) | x
    return out


def test_queue_of_bounds_equals_plain_greedy(spark):
    import random

    from tidemill.operators import influence as inf

    r = random.Random(1)
    e = edges(spark, [(f"n{a:02}", f"n{b:02}", r.randint(1, 30)) for a in range(60) for b in range(a) if r.random() < 0.05])
    names = sorted(x.src for x in e.select("src").distinct().collect())
    found = inf.reached(e, spark.createDataFrame([(x, i) for i, x in enumerate(names)], "node string, id int"), len(names), samples=40)
    got, evaluated = inf.greedy(found, list(range(len(names))), 40, 8, batch=4)
    assert got == plain_greedy(found.collect(), 40, 8)
    assert evaluated < 3 * len(names) < 8 * len(names)


def test_reverse_sets_find_the_hubs(spark):
    """Two stars of 30 and 10 leaves, links that live with 0.2: the hubs are the seeds, and the estimate is near."""
    from tidemill.operators import influence as inf

    e = edges(spark, [("hub", f"n{i:02}", 10_000) for i in range(30)] + [("mid", f"m{i}", 10_000) for i in range(10)])
    first, second, *_ = inf.seeds_of_any_graph(e, sets=4000, most=3).collect()
    assert (first.actor_login, second.actor_login) == ("hub", "mid")
    assert abs(first.marginal_gain - 7) < 0.7 and abs(second.cumulative_reach - 10) < 1
    sets = inf.reverse_sets(e, 300)
    assert sets.groupBy("set", "node").count().where("count > 1").isEmpty() and sets.select("set").distinct().count() == 300
    assert sorted(map(str, sets.collect())) == sorted(map(str, inf.reverse_sets(e.repartition(3), 300).collect()))
    assert inf.seeds_of_any_graph(e.limit(0)).isEmpty()


def test_persona_names():
    from tidemill.operators import ml

    base = dict.fromkeys(ml.ACTOR_FEATURES, 0.0)
    at = [base | {"persona_id": 0, "watch_share": 1.0, "fork_share": 0.5}, base | {"persona_id": 1, "is_bot": 1.0}, base | {"persona_id": 2, "pr_share": 1.0}, base | {"persona_id": 3, "pr_share": 1.0}]
    names = ml.persona_names(at)
    assert names[0].startswith("watcher__") and names[1].startswith("night_bot__bot+heavy") and names[3].endswith("_c3") and names[2].split("__")[0] == names[3].split("__")[0]


def test_bot_models(spark):
    import random

    from tidemill.operators import ml

    r = random.Random(3)
    rows = [(f"u{i}", int(i % 5 == 0), *[r.random() + (3.0 if i % 5 == 0 and k < 2 else 0.0) for k in range(len(ml.BOT_FEATURES))]) for i in range(120)]
    features = spark.createDataFrame(rows, ["actor_login", "is_bot", "event_count", *ml.BOT_FEATURES[1:]])
    personas = features.select("actor_login", F.lit("p").alias("persona_label"))
    scores = ml.bot_scores(features, personas).orderBy("rank_no").limit(24).collect()
    assert all(x.is_bot_truth == 1 for x in scores)
    meta = {x.metric: x.value for x in ml.bot_measures(features, personas).collect()}
    assert meta["bots"] == 24 and meta["cv_roc_auc"] > 0.95
    assert ml.bot_importance(features, personas).first().feature in ml.BOT_FEATURES[:2]
    assert ml.bot_scores(features.where("is_bot = 0"), personas).where("gbt_prob_bot > 0").isEmpty()


def test_bootstrap_intervals(spark):
    """Against resampling by hand in numpy: ends agree within what resampling varies by, and d lies inside."""
    import numpy as np

    from tidemill.operators import bootstrap

    r = np.random.default_rng(5)
    a, b = r.normal(1.0, 1.0, 80), r.normal(0.0, 1.0, 60)
    rows = [(f"a{i}", "hot", "all", float(x), 1.0) for i, x in enumerate(a)] + [(f"b{i}", "cold", "all", float(x), 1.0) for i, x in enumerate(b)]
    rows += [("c", "hot", "few", 1.0, None), ("d", "cold", "few", 2.0, None), ("e", "mid", "all", 99.0, 99.0)]
    df = spark.createDataFrame(rows, "key string, side string, cohort_scope string, x double, same double")
    got = {(x.cohort_scope, x.feature_name): (x.ci_low, x.ci_high) for x in bootstrap.intervals(df, ["x", "same"], "hot", "cold").collect()}
    assert set(got) == {("all", "x"), ("all", "same")} and got["all", "same"] == (0.0, 0.0)

    def d(p, q):
        pooled = (((len(p) - 1) * p.var(ddof=1) + (len(q) - 1) * q.var(ddof=1)) / (len(p) + len(q) - 2)) ** 0.5
        return (p.mean() - q.mean()) / pooled

    many = np.sort([d(r.choice(a, len(a)), r.choice(b, len(b))) for _ in range(4000)])
    low, high = got["all", "x"]
    assert low < d(a, b) < high and abs(low - many[100]) < 0.15 and abs(high - many[3899]) < 0.15
    assert got == {(x.cohort_scope, x.feature_name): (x.ci_low, x.ci_high) for x in bootstrap.intervals(df.repartition(5), ["x", "same"], "hot", "cold").collect()}
    assert bootstrap.intervals(df.limit(0), ["x"], "hot", "cold").isEmpty()


def test_repo_archetypes(spark):
    from tidemill.operators import ml

    rows = [(f"r{i}", "misc" if i % 2 else "steady_core", float(i), 10 + i, *[float(10 * (i % 2)) + (i * k % 7) / 7 for k in range(1, 7)]) for i in range(40)]
    rules = spark.createDataFrame(rows, ["repo_name", "archetype_rule", "rank_score", "total_events", *ml.ARCHETYPE_FEATURES])
    got = ml.repo_archetypes(rules, k=2)
    assert got.count() == 40 and got.where("archetype_confidence not between 0.5 and 1").isEmpty()
    assert got.groupBy("archetype_gmm_id").agg(F.countDistinct("archetype_rule").alias("n")).where("n > 1").isEmpty()
    heads = {r.archetype_rule: r for r in ml.archetype_centroids(got).collect()}
    assert heads["misc"].members == 20 and heads["misc"].rule_gmm_overlap == 1.0 and heads["misc"].sample_repos == "r39 | r37 | r35"
    assert ml.repo_archetypes(rules.limit(5)).where("archetype_gmm_id is not null").isEmpty()


def test_model_reads(spark):
    from tidemill.plans import model_reads as m

    members = spark.createDataFrame([("a", "a", 2), ("b", "a", 2), ("c", "c", 1), ("d", "d", 2), ("e", "d", 2)], "repo_name string, community_id string, community_size long")
    ranks = spark.createDataFrame([("b", 0.9), ("d", 0.2), ("e", 0.1)], "repo_name string, rank_score double")
    assert [r.repo_name for r in m.communities_top(members, ranks, 1).collect()] == ["b", "a"]
    assert [r.repo_name for r in m.communities_top(members, ranks).collect()] == ["b", "d", "e", "a"]
    assert [r.repo_name for r in m.of_repo(members, "c").collect()] == ["c"] and [r.repo_name for r in m.of_repo(members, None).collect()] == ["e"]
    rules = spark.createDataFrame([("a & b", "c", 2.0, 0.5), ("c", "a", 3.0, 0.5), ("x", "b", 1.0, 0.5)], "antecedent string, consequent string, lift double, confidence double")
    assert [r.lift for r in m.rules_of(rules, "c").collect()] == [3.0, 2.0] and [r.lift for r in m.rules_of(rules).collect()] == [3.0, 2.0]
    layers = spark.createDataFrame([("watch", "a", "a"), ("watch", "b", "a"), ("fork", "a", "a")], "layer string, repo_name string, community_id string")
    assert {r.layer: (r.communities, r.largest) for r in m.layer_matrix(layers).collect()} == {"watch": (1, 2), "fork": (0, 1)}
    assert [r.community_size for r in m.layer_communities(layers).collect()] == [1, 2, 2]
