"""People-level tables (P01-P04) and the features of churn risk."""

from __future__ import annotations

from tidemill.functions.exprs import big, dbl, r, row_no
from tidemill.plans.catalog import Catalog

LATEST = "(SELECT max(metric_date) FROM ev)"


def register(c: Catalog) -> None:
    half = lambda x: f"CASE WHEN max({x}) OVER () = min({x}) OVER () THEN {dbl('0.5')} ELSE ({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ()) END"
    c.add("p01_actor_burst_stability", "ev persona", f"""
WITH g AS (SELECT actor_login, metric_date, count(*) AS n FROM ev GROUP BY actor_login, metric_date),
a AS (SELECT actor_login, {big('sum(n)')} AS total_events, {dbl('max(n)')} / avg(n) AS burst, CASE WHEN count(*) = 1 THEN {dbl('0')} ELSE {dbl('1')} / (1 + stddev_samp(n) / avg(n)) END AS stability FROM g GROUP BY actor_login ORDER BY total_events DESC, actor_login LIMIT 3000),
m AS (SELECT a.*, {half('burst')} AS burst_index, {half('stability')} AS stability_index FROM a)
SELECT {LATEST} AS metric_date, m.actor_login, {r('burst_index')} AS burst_index, {r('stability_index')} AS stability_index, CASE WHEN burst_index >= 0.5 THEN CASE WHEN stability_index >= 0.5 THEN 'rising_core' ELSE 'short_spike' END WHEN stability_index >= 0.5 THEN 'steady_core' ELSE 'long_tail' END AS quadrant,
  {r('(burst_index + stability_index) / 2')} AS rank_score, total_events, coalesce(p.persona_label, '') AS persona_label FROM m LEFT JOIN persona p ON m.actor_login = p.actor_login""")
    c.add("p02_actor_retention_curve", "ev", lambda d: f"""
WITH a AS (SELECT DISTINCT actor_login, metric_date FROM ev), f AS (SELECT a.*, min(metric_date) OVER (PARTITION BY actor_login) AS first_date FROM a),
w AS (SELECT f.*, {d.plus_days('first_date', f"-(({d.weekday('first_date')} + 4) % 7)")} AS cohort_week, {d.days('metric_date', 'first_date')} AS day FROM f),
k AS (SELECT 0 AS days_since_first UNION ALL SELECT 1 UNION ALL SELECT 3 UNION ALL SELECT 7 UNION ALL SELECT 14 UNION ALL SELECT 21 UNION ALL SELECT 28),
z AS (SELECT cohort_week, count(DISTINCT actor_login) AS cohort_size FROM w GROUP BY cohort_week), h AS (SELECT cohort_week, day, count(DISTINCT actor_login) AS retained FROM w GROUP BY cohort_week, day)
SELECT {LATEST} AS metric_date, z.cohort_week, CAST(k.days_since_first AS BIGINT) AS days_since_first, coalesce(h.retained, 0) AS retained_count, cohort_size, {r(f"{dbl('coalesce(h.retained, 0)')} / cohort_size")} AS retention_rate FROM z CROSS JOIN k LEFT JOIN h ON h.cohort_week = z.cohort_week AND h.day = k.days_since_first""")
    c.add("p03_actor_hotness", "ev b14_repo_rank_daily persona", f"""
WITH a AS (SELECT actor_login, count(*) AS event_count, count(DISTINCT repo_name) AS unique_repos FROM ev GROUP BY actor_login),
s AS (SELECT e.actor_login, CAST(sum(CAST(k.rank_score AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS score FROM (SELECT DISTINCT actor_login, repo_name FROM ev) e JOIN b14_repo_rank_daily k ON e.repo_name = k.repo_name GROUP BY e.actor_login),
h AS (SELECT a.*, s.score AS avg_repo_rank_score, {r(f"ln({dbl('1')} + event_count) * ln({dbl('1')} + unique_repos) * (s.score + 0.001)")} AS hotness_score FROM a LEFT JOIN s ON a.actor_login = s.actor_login),
n AS (SELECT h.*, {row_no('', 'hotness_score DESC NULLS LAST, actor_login')} AS rank_no FROM (SELECT * FROM h ORDER BY hotness_score DESC NULLS LAST, actor_login LIMIT 500) h)
SELECT {LATEST} AS metric_date, n.actor_login, n.event_count, n.unique_repos, avg_repo_rank_score, hotness_score, rank_no, coalesce(p.persona_label, '') AS persona_label FROM n LEFT JOIN persona p ON n.actor_login = p.actor_login""")
    c.add("p04_repo_bus_factor", "ev b14_repo_rank_daily", f"""
WITH g AS (SELECT repo_name, actor_login, count(*) AS n FROM ev GROUP BY repo_name, actor_login),
s AS (SELECT g.*, {dbl('n')} / sum(n) OVER (PARTITION BY repo_name) AS s, count(*) OVER (PARTITION BY repo_name) AS contributor_count, row_number() OVER (PARTITION BY repo_name ORDER BY n DESC, actor_login) AS k FROM g)
SELECT {LATEST} AS metric_date, s.repo_name, actor_login AS top_actor, {r('s')} AS top_actor_share, contributor_count, CASE WHEN s >= 0.8 THEN 'bus-1' WHEN s >= 0.5 THEN 'thin' ELSE 'healthy' END AS bus_factor, k.rank_score AS repo_rank_score
FROM s LEFT JOIN b14_repo_rank_daily k ON s.repo_name = k.repo_name WHERE s.k = 1 AND contributor_count >= 3""")
    c.add("m17_churn_features", "ev", lambda d: f"""
WITH a AS (SELECT actor_login, metric_date, count(*) AS events, row_number() OVER (PARTITION BY actor_login ORDER BY metric_date) AS n FROM ev GROUP BY actor_login, metric_date), m AS (SELECT max(metric_date) AS last FROM ev),
t AS (SELECT actor_login, count(*) AS active_days, {big('sum(events)')} AS events, CASE WHEN count(*) >= 2 THEN {r(f"regr_slope({dbl('events')}, {dbl('n')})")} + {dbl('0')} END AS decay_slope, max(metric_date) AS last_seen, {d.days('max(m.last)', 'max(metric_date)')} AS days_since_last, max(CASE WHEN metric_date >= {d.plus_days('m.last', '-7')} THEN 1 ELSE 0 END) AS seen FROM a CROSS JOIN m GROUP BY actor_login)
SELECT actor_login, days_since_last, active_days, {r(f"ln({dbl('1')} + active_days)")} AS log_active_days, {r(f"ln({dbl('1')} + events)")} AS log_events, decay_slope, 1 - seen AS churned FROM t ORDER BY active_days DESC, actor_login LIMIT 5000""")
