"""Daily group-bys and top lists."""

from __future__ import annotations

from tidemill.functions.exprs import COUNTS, DECAY, HOTNESS, big, count_when, dbl, hotness, minmax, r, row_no, share, type_counts
from tidemill.plans.catalog import Catalog

N = "count(*) AS event_count"
ACTORS, REPOS = "count(DISTINCT actor_login) AS unique_actors", "count(DISTINCT repo_name) AS unique_repos"
LATEST = "(SELECT max(metric_date) FROM ev)"


def register(c: Catalog, top_n: int = 10, rank_limit: int = 30) -> None:
    def grouped(name, keys, measures, where="", reads="ev"):
        c.add(name, reads, f"SELECT {keys}, {', '.join(measures)} FROM {reads} {where} GROUP BY {keys}")

    grouped("b01_daily_metrics", "metric_date, repo_name, event_type, language_guess, actor_category", [N, ACTORS, f"{r('avg(hour_of_day)')} AS avg_hour"])
    grouped("b02_activity_patterns", "metric_date, hour_of_day, day_of_week, actor_category", [N, REPOS])
    grouped("b03_language_day_trend", "metric_date, language_guess", [N, REPOS, ACTORS])
    grouped("b04_event_type_day", "metric_date, event_type", [N, ACTORS, REPOS])
    c.add("b05_summary", "ev", "SELECT count(*) AS total_events, count(DISTINCT metric_date) AS total_days, count(DISTINCT repo_name) AS total_repos, count(DISTINCT actor_login) AS total_actors FROM ev")
    grouped("b06_org_daily_metrics", "metric_date, org_or_owner, event_type", [N, ACTORS, REPOS])
    grouped("b07_event_action_day", "metric_date, event_type, payload_action", [N, ACTORS, REPOS])
    p95 = "percentile_disc(0.95) WITHIN GROUP (ORDER BY payload_size)"
    grouped("b08_repo_payload_size_day", "metric_date, repo_name", ["count(*) AS push_events", f"{big('sum(payload_size)')} AS sum_payload_size", f"{r('avg(payload_size)')} AS avg_payload_size", f"{dbl(p95)} AS p95_payload_size"], "WHERE event_type = 'PushEvent'")
    c.add("b09_payload_bucket_day", "ev", f"""
SELECT metric_date, size_bucket, count(*) AS event_count, {r('avg(payload_size)')} AS avg_payload_size
FROM (SELECT metric_date, payload_size, CASE WHEN payload_size <= 0 THEN '0' WHEN payload_size <= 2 THEN '1-2' WHEN payload_size <= 5 THEN '3-5' WHEN payload_size <= 10 THEN '6-10' ELSE '11+' END AS size_bucket FROM ev WHERE event_type = 'PushEvent') b
GROUP BY metric_date, size_bucket""")
    c.add("feat", "ev", lambda d: f"""
SELECT f.*, {hotness()} AS hotness_raw, {d.days('m.latest', 'f.metric_date')} AS days_ago, exp({dbl(-DECAY)} * {d.days('m.latest', 'f.metric_date')}) AS decay_factor,
  {hotness()} * exp({dbl(-DECAY)} * {d.days('m.latest', 'f.metric_date')}) AS hotness_decayed, m.latest AS latest_date, m.total_days
FROM (SELECT metric_date, repo_name, count(*) AS total_events, count(DISTINCT actor_login) AS unique_actors, {count_when("actor_category = 'human'")} AS human_events, {count_when("actor_category = 'bot'")} AS bot_events, {type_counts()} FROM ev GROUP BY metric_date, repo_name) f
CROSS JOIN (SELECT max(metric_date) AS latest, count(DISTINCT metric_date) AS total_days FROM ev) m""", internal=True)
    c.add("b10_repo_day_features", "feat", f"SELECT metric_date, repo_name, total_events, unique_actors, human_events, bot_events, {', '.join(COUNTS.values())}, {r('hotness_raw')} AS hotness_raw, days_ago, {r('decay_factor')} AS decay_factor, {r('hotness_decayed')} AS hotness_decayed FROM feat")
    for name, key, other in (("users", "actor_login", REPOS), ("repos", "repo_name", ACTORS)):
        c.add(f"b11_top_{name}_day", "ev", f"""
SELECT * FROM (SELECT metric_date, {key}, event_count, {other.split()[-1]}, {row_no('metric_date', f'event_count DESC, {key}')} AS rank
  FROM (SELECT metric_date, {key}, {N}, {other} FROM ev GROUP BY metric_date, {key}) g) t WHERE rank <= {top_n}""")
    # The best are taken first, so that only they are numbered in one task.
    c.add("b12_org_rank_latest", "ev", f"""
WITH g AS (SELECT metric_date, org_or_owner, {N}, {REPOS}, {type_counts()} FROM ev WHERE metric_date = {LATEST} GROUP BY metric_date, org_or_owner),
h AS (SELECT g.*, {r(hotness())} AS hotness_score FROM g),
t AS (SELECT * FROM h ORDER BY hotness_score DESC, event_count DESC, org_or_owner LIMIT {rank_limit})
SELECT metric_date, org_or_owner, {row_no('', 'hotness_score DESC, event_count DESC, org_or_owner')} AS rank_no, hotness_score, event_count, unique_repos, {', '.join(COUNTS.values())} FROM t""")
    # Ranks over all actors: how many come before by (count, login), from an ordered aggregate by count.
    c.add("b15_user_segment_latest", "ev", f"""
WITH a AS (SELECT actor_login, max(metric_date) AS metric_date, {N}, count(DISTINCT metric_date) AS active_days, {REPOS} FROM ev GROUP BY actor_login),
h AS (SELECT event_count, count(*) AS same FROM a GROUP BY event_count),
b AS (SELECT event_count, {big('sum(same) OVER (ORDER BY event_count DESC) - same')} AS before, {big('sum(same) OVER ()')} AS total FROM h),
n AS (SELECT a.*, b.total, b.before + row_number() OVER (PARTITION BY a.event_count ORDER BY a.actor_login) AS place FROM a JOIN b ON a.event_count = b.event_count),
s AS (SELECT n.*, CASE WHEN {dbl('place')} / total <= 0.01 THEN 'heavy' WHEN {dbl('place')} / total <= 0.10 THEN 'medium' WHEN {dbl('place')} / total <= 0.40 THEN 'light' ELSE 'ghost' END AS segment FROM n),
t AS (SELECT actor_login, event_type AS favorite_event_type FROM (SELECT actor_login, event_type, row_number() OVER (PARTITION BY actor_login ORDER BY count(*) DESC, event_type) AS k FROM ev GROUP BY actor_login, event_type) x WHERE k = 1),
p AS (SELECT actor_login, repo_name AS favorite_repo FROM (SELECT actor_login, repo_name, row_number() OVER (PARTITION BY actor_login ORDER BY count(*) DESC, repo_name) AS k FROM ev GROUP BY actor_login, repo_name) x WHERE k = 1)
SELECT metric_date, actor_login, segment, event_count, active_days, unique_repos, favorite_event_type, favorite_repo
FROM (SELECT s.*, t.favorite_event_type, p.favorite_repo, row_number() OVER (PARTITION BY segment ORDER BY s.event_count DESC, s.actor_login) AS k FROM s LEFT JOIN t ON s.actor_login = t.actor_login LEFT JOIN p ON s.actor_login = p.actor_login) z WHERE k <= 200""")
    c.add("b20_developer_rhythm_heatmap", "ev", f"""
WITH g AS (SELECT day_of_week, hour_of_day, actor_category, {N}, {ACTORS}, {REPOS} FROM ev GROUP BY day_of_week, hour_of_day, actor_category),
m AS (SELECT min(event_count) AS lo, max(event_count) AS hi FROM g),
t AS (SELECT max(metric_date) AS metric_date, count(DISTINCT metric_date) AS days FROM ev)
SELECT t.metric_date, day_of_week, hour_of_day, actor_category, event_count, unique_actors, unique_repos, {r(f"{dbl('event_count')} / days")} AS avg_daily_events, {r(minmax('event_count', 'lo', 'hi'))} AS intensity_score,
  row_number() OVER (PARTITION BY actor_category, day_of_week ORDER BY event_count DESC, hour_of_day) = 1 AS peak_flag
FROM g CROSS JOIN m CROSS JOIN t""")
    c.add("b22_event_complexity_day", "ev rank_all", f"""
WITH g AS (SELECT metric_date, repo_name, event_type, {N} FROM ev GROUP BY metric_date, repo_name, event_type),
p AS (SELECT g.*, {big('sum(event_count) OVER (PARTITION BY metric_date, repo_name)')} AS total_events FROM g),
e AS (SELECT metric_date, repo_name, max(total_events) AS total_events, count(*) AS active_event_types, sum(-{share('event_count', 'total_events')} * log2({share('event_count', 'total_events')})) AS h FROM p GROUP BY metric_date, repo_name)
SELECT e.metric_date, e.repo_name, k.rank_no, total_events, active_event_types, {r('h')} AS event_entropy, {r(f"CASE WHEN active_event_types <= 1 THEN {dbl('0')} ELSE h / log2({dbl('active_event_types')}) END")} AS normalized_entropy
FROM e LEFT JOIN rank_all k ON e.repo_name = k.repo_name""")
    c.add("b21_repo_hotness_components", "feat rank_all", f"""
SELECT f.metric_date, f.repo_name, k.rank_no, {', '.join(COUNTS.values())}, {r('hotness_raw')} AS hotness_raw,
  {', '.join(f"{r(f'{col} * {dbl(HOTNESS[t])} / greatest(hotness_raw, {dbl(1)})')} AS {col.replace('_events', '_contribution')}" for t, col in COUNTS.items())}
FROM (SELECT feat.*, row_number() OVER (PARTITION BY repo_name ORDER BY metric_date DESC) AS n FROM feat) f LEFT JOIN rank_all k ON f.repo_name = k.repo_name WHERE n = 1""")
