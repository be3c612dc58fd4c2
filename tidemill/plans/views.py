"""Dashboard figures over the metric tables: trends, deltas, verdicts and roll-ups, one declarative query each."""

from __future__ import annotations

from tidemill.functions.exprs import big, count_when, dbl, r, share
from tidemill.plans.catalog import Catalog

#: Bounds of a share shift's magnitude, in percentage points (fixed values).
MAGNITUDES = {"none": 0.5, "slight": 1.5, "clear": 3.0, "strong": 8.0}
PARTS = ["hotness_part", "momentum_part", "engagement_part", "stability_part"]


def change(new: str, old: str) -> str:
    return f"CASE WHEN {old} = 0 THEN {dbl('0')} ELSE {dbl(f'({new}) - ({old})')} / {old} END"


def register(c: Catalog) -> None:
    c.add("day_total", "ev", lambda d: f"SELECT metric_date, count(*) AS total_events, {d.days('metric_date', '(SELECT min(metric_date) FROM ev)')} AS n FROM ev GROUP BY metric_date", internal=True)
    # Days without events count as zero: the divisor is the number of days, not of rows.
    c.add("v01_trend_ma7_gini", "day_total b27_concentration_day", f"SELECT t.metric_date, t.total_events, {r(f'{dbl("sum(t.total_events) OVER (ORDER BY t.n RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)")} / least(t.n + 1, 7)')} AS ma7, k.gini FROM day_total t LEFT JOIN b27_concentration_day k ON t.metric_date = k.metric_date")
    mean = lambda x, half: f"avg(CASE WHEN half = {half} THEN {x} END)"
    c.add("v02_half_month_deltas", "b27_concentration_day", f"""
WITH k AS (SELECT b.*, row_number() OVER (ORDER BY metric_date DESC) AS n FROM b27_concentration_day b), h AS (SELECT k.*, CASE WHEN n <= 15 THEN 1 ELSE 2 END AS half FROM k WHERE n <= 30),
a AS (SELECT {big("sum(CASE WHEN half = 1 THEN total_events ELSE 0 END)")} AS last_events, {big("sum(CASE WHEN half = 2 THEN total_events ELSE 0 END)")} AS earlier_events, {', '.join(f'{mean(x, i)} AS {x}_{i}' for x in ('total_events', 'top5_share', 'gini', 'entropy', 'repo_count') for i in (1, 2))} FROM h)
SELECT last_events, earlier_events, {r(f"100 * ({change('total_events_1', 'total_events_2')})")} AS events_pct, {r('100 * (top5_share_1 - top5_share_2)')} AS top5_pp, {r('gini_1 - gini_2')} AS gini_delta, {r('entropy_1 - entropy_2')} AS entropy_delta, {r(f"100 * ({change('repo_count_1', 'repo_count_2')})")} AS repos_pct FROM a""")
    c.add("v03_type_and_language_totals", "ev", f"""
WITH t AS (SELECT 'event_type' AS kind, event_type AS name, count(*) AS event_count FROM ev GROUP BY event_type UNION ALL SELECT 'language', language_guess, count(*) FROM ev GROUP BY language_guess),
k AS (SELECT t.*, {dbl('event_count')} / sum(event_count) OVER (PARTITION BY kind) AS s, row_number() OVER (PARTITION BY kind ORDER BY event_count DESC, name) AS n, sum(CASE WHEN name = 'unknown' THEN event_count ELSE 0 END) OVER (PARTITION BY kind) AS u, sum(event_count) OVER (PARTITION BY kind) AS total FROM t)
SELECT kind, name, event_count, {r('s')} AS share, {r(f'{dbl("u")} / total')} AS unknown_share, {big('n')} AS place FROM k WHERE n <= 8""")
    c.add("v05_weekly_seasonality", "day_total", lambda d: f"""
WITH k AS (SELECT t.*, ({d.weekday('metric_date')} + 5) % 7 AS weekday, row_number() OVER (ORDER BY metric_date DESC) AS n_back FROM day_total t)
SELECT weekday, {r(f'avg({dbl("total_events")})')} AS mean_events, min(total_events) AS min_events, max(total_events) AS max_events, count(*) AS days FROM k WHERE n_back <= 30 GROUP BY weekday""")
    words = "CASE " + " ".join(f"WHEN pp < {v} THEN '{n}'" for n, v in MAGNITUDES.items()) + " ELSE 'extreme' END"
    c.add("v06_event_shift_days", "b30_event_type_share_shift_day", lambda d: f"""
WITH k AS (SELECT b.*, {r('100 * abs(share_shift)')} AS pp, row_number() OVER (PARTITION BY metric_date ORDER BY {r('abs(share_shift)')} DESC, event_type) AS n FROM b30_event_type_share_shift_day b),
m AS (SELECT k.*, row_number() OVER (ORDER BY pp DESC, metric_date) AS place FROM k WHERE n = 1)
SELECT metric_date, event_type, pp AS max_shift_pp, {words} AS magnitude, place = 1 AS most_informative, {big(f"floor({d.days('metric_date', '(SELECT min(metric_date) FROM b30_event_type_share_shift_day)')} / 7)")} AS week_no FROM m""")
    c.add("v07_cohort_stack", "b29_actor_cohort_day", f"SELECT metric_date, {', '.join(big(f"sum(CASE WHEN cohort = '{x}' THEN actors ELSE 0 END)") + f' AS {x}_actors' for x in ('new', 'reactivated'))} FROM b29_actor_cohort_day GROUP BY metric_date")
    drivers = {p.removesuffix("_part"): f"coalesce(delta_{p}, 0)" for p in PARTS} | {"bot_penalty": "-coalesce(delta_bot_penalty, 0)"}
    top = f"greatest({', '.join(f'abs({x})' for x in drivers.values())})"
    c.add("v09_dominant_driver", "b17_repo_rank_delta_explain_day", f"SELECT metric_date, repo_name, delta_rank_score, CASE {' '.join(f"WHEN abs({x}) = {top} THEN '{n}'" for n, x in drivers.items())} END AS driver, CASE {' '.join(f'WHEN abs({x}) = {top} THEN {x}' for x in drivers.values())} END AS driver_delta FROM b17_repo_rank_delta_explain_day")
    c.add("v10_top_reasons", "m05_hot_vs_cold_attribution", """
SELECT cohort_scope, direction, feature_name, cohen_d FROM (SELECT m.*, row_number() OVER (PARTITION BY cohort_scope, direction ORDER BY abs(cohen_d) DESC, feature_name) AS n FROM m05_hot_vs_cold_attribution m WHERE direction <> 'equal') x WHERE n = 1""")
    c.add("v11_attribution_robustness", "m05_hot_vs_cold_attribution", f"""
SELECT count(*) AS features, {count_when('a.cohen_d * h.cohen_d < 0')} AS sign_flips, {count_when('abs(a.cohen_d) >= 0.8')} AS large_all, {count_when('abs(h.cohen_d) >= 0.8')} AS large_humans FROM m05_hot_vs_cold_attribution a JOIN m05_hot_vs_cold_attribution h ON a.feature_name = h.feature_name WHERE a.cohort_scope = 'all' AND h.cohort_scope = 'humans_only'""")
    c.add("v12_best_bot_persona", "m11_actor_persona_bot_validation", "SELECT persona_label, precision, recall, f1 FROM m11_actor_persona_bot_validation ORDER BY f1 DESC, persona_label LIMIT 1")
    c.add("v13_persona_shares", "persona", f"""
WITH g AS (SELECT persona_label, count(*) AS actors, avg({dbl('is_bot')}) AS bot FROM persona GROUP BY persona_label), k AS (SELECT g.*, bot >= 0.05 OR persona_label LIKE '%bot%' AS bot_leaning, sum(actors) OVER () AS total FROM g)
SELECT persona_label, actors, {r(f'{dbl("actors")} / total')} AS share, bot_leaning, {r(f'{dbl("sum(CASE WHEN bot_leaning THEN actors ELSE 0 END) OVER ()")} / total')} AS bot_leaning_share FROM k""")
    c.add("v14_cohort_shares", "b29_actor_cohort_day", lambda d: f"""
SELECT cohort, {big('sum(actors)')} AS actors, {r(f'{dbl("sum(actors)")} / sum(sum(actors)) OVER ()')} AS share FROM b29_actor_cohort_day WHERE metric_date >= {d.plus_days('(SELECT max(metric_date) FROM b29_actor_cohort_day)', '-29')} GROUP BY cohort""")
    c.add("v15_collab_density", "g06_actor_collab_edge", f"""
WITH n AS (SELECT actor_a AS actor_login FROM g06_actor_collab_edge UNION SELECT actor_b FROM g06_actor_collab_edge), e AS (SELECT count(*) AS edges FROM g06_actor_collab_edge), k AS (SELECT count(*) AS nodes FROM n)
SELECT nodes, edges, {r(share('edges', 'nodes'))} AS edges_per_node FROM e CROSS JOIN k""")
    rate = lambda n: f"max(CASE WHEN days_since_first = {n} THEN retention_rate END)"
    c.add("v16_retention_by_week", "p02_actor_retention_curve", f"SELECT cohort_week, max(cohort_size) AS cohort_size, {', '.join(f'{rate(n)} AS day_{n}' for n in (0, 1, 3, 7, 14, 21, 28))}, {r(f'avg({rate(7)}) OVER ()')} AS mean_day_7 FROM p02_actor_retention_curve GROUP BY cohort_week")
    c.add("v04_forecast_verdict", "b18_repo_trend_forecast", f"""
WITH k AS (SELECT b.*, row_number() OVER (PARTITION BY repo_name ORDER BY metric_date DESC) AS n, max(total_events) OVER (PARTITION BY repo_name) AS peak, lag(ma7) OVER (PARTITION BY repo_name ORDER BY metric_date) AS ma7_before FROM b18_repo_trend_forecast b),
v AS (SELECT k.*, {change('forecast_next_day', 'ma7')} AS rise FROM k WHERE n = 1)
SELECT repo_name, metric_date, peak AS peak_events, ma7, {r('ma7 - ma7_before')} AS ma7_delta, forecast_next_day, CASE WHEN rise > 0.1 THEN 'accelerating' WHEN rise < -0.1 THEN 'decaying' ELSE 'flat' END AS verdict FROM v""")
    c.add("v08_rank_path_pivot", "q_top_repo_rank_paths", f"""
WITH p AS (SELECT q.*, dense_rank() OVER (ORDER BY repo_name) AS lane FROM q_top_repo_rank_paths q)
SELECT metric_date, {', '.join(f'max(CASE WHEN lane = {i} THEN repo_name END) AS repo_{i}, max(CASE WHEN lane = {i} THEN rank_no END) AS rank_{i}' for i in range(1, 9))} FROM p GROUP BY metric_date""")
    c.add("v18_archetype_rollup", "m19_repo_archetype_rule", f"""
SELECT archetype, count(*) AS members, {r(f'{dbl("count(*)")} / sum(count(*)) OVER ()')} AS share, {', '.join(f'{r(f"avg({dbl(x)})")} AS {x}' for x in ('bot_ratio', 'watch_share', 'pr_push_ratio', 'events_per_day', 'active_days', 'contributors'))} FROM m19_repo_archetype_rule GROUP BY archetype""")
    c.add("v21_layer_matrix", "g09_repo_layer_edge", f"""
WITH n AS (SELECT layer, src_repo AS repo FROM g09_repo_layer_edge UNION SELECT layer, dst_repo FROM g09_repo_layer_edge), k AS (SELECT layer, count(*) AS repos FROM n GROUP BY layer)
SELECT e.layer, count(*) AS edges, max(k.repos) AS repos, {r('avg(jaccard)')} AS avg_jaccard, max(jaccard) AS max_jaccard FROM g09_repo_layer_edge e JOIN k ON e.layer = k.layer GROUP BY e.layer""")
    # Labels and bounds of the rules are fixed values.
    c.add("m19_repo_archetype_rule", "ev", f"""
WITH a AS (SELECT repo_name, count(*) AS total_events, count(DISTINCT metric_date) AS active_days, count(DISTINCT actor_login) AS contributors, {share(count_when("event_type = 'WatchEvent'"), 'count(*)')} AS watch_share, {share(count_when("actor_category = 'bot'"), 'count(*)')} AS bot_ratio,
  {dbl(count_when("event_type = 'PullRequestEvent'"))} / greatest({count_when("event_type = 'PushEvent'")}, 1) AS pr_push_ratio FROM ev GROUP BY repo_name)
SELECT repo_name, {r('bot_ratio')} AS bot_ratio, {r('watch_share')} AS watch_share, {r('pr_push_ratio')} AS pr_push_ratio, {r(f'{dbl("total_events")} / active_days')} AS events_per_day, active_days, contributors,
  CASE WHEN bot_ratio > 0.5 THEN 'bot_heavy_infra' WHEN watch_share > 0.6 AND pr_push_ratio < 0.1 THEN 'star_hungry_showcase' WHEN pr_push_ratio > 2 THEN 'pr_heavy_collab' WHEN {dbl('total_events')} / active_days > 400 AND active_days <= 5 THEN 'burst_factory'
    WHEN watch_share > 0.3 AND contributors > 20 THEN 'community_driven' WHEN active_days >= 4 AND pr_push_ratio BETWEEN 0.2 AND 3 AND contributors >= 5 THEN 'steady_core' ELSE 'misc' END AS archetype FROM a""")
