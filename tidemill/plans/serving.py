"""Serving queries: parameterised reads over the metric tables, at their latest day or over last days."""

from __future__ import annotations

from tidemill.functions.exprs import big, dbl
from tidemill.operators.features import FEATURES
from tidemill.operators.realtime_sql import REALTIME
from tidemill.plans.catalog import Catalog

#: (query, table, filter, order, limit): rows of the table's latest day.
LATEST = [
    ("top_users_latest", "b11_top_users_day", "", "rank, actor_login", 10),
    ("top_repos_latest", "b11_top_repos_day", "", "rank, repo_name", 10),
    ("advanced_repo_rankings", "b14_repo_rank_daily", "", "rank_no, repo_name", 12),
    ("repo_rank_explain_latest", "b26_repo_rank_explain_latest", "", "rank_no, repo_name", 20),
    ("repo_rank_delta_explain_latest", "b17_repo_rank_delta_explain_day", "", "abs(delta_rank_score) DESC, repo_name", 20),
    ("repo_contributor_concentration_latest", "b32_repo_contributor_concentration_day", "", "top1_actor_share DESC, active_actors, repo_name", 12),
    ("offline_insights_latest", "b31_offline_insights_latest", "", "insight_type", 8),
    ("developer_rhythm_heatmap", "b20_developer_rhythm_heatmap", "actor_category = 'human'", "day_of_week, hour_of_day", 168),
    ("hotness_components_latest", "b21_repo_hotness_components", "", "rank_no, hotness_raw DESC, repo_name", 10),
    ("org_rank_latest", "b12_org_rank_latest", "", "rank_no", 12),
    ("event_actions_latest", "b07_event_action_day", "event_type = 'PullRequestEvent'", "event_count DESC, payload_action", 12),
    ("repo_health_latest", "b23_repo_health_latest", "", "health_score DESC, rank_no, repo_name", 12),
    ("offline_anomaly_alerts_latest", "b24_offline_anomaly_alerts", "", "z_score DESC, current_events DESC, repo_name", 20),
    ("offline_decline_warnings_latest", "b25_offline_decline_warnings", "", "slope7, pct_change7, repo_name", 20),
    ("repo_dna_outliers", "m06_repo_dna_outliers", "", "z_distance DESC, repo_name", 20),
    ("repo_dna_top_hot", "m04_repo_dna", "cohort_group = 'hot'", "rank_score DESC, repo_name", 30),
    ("actor_persona_bot_validation", "m11_actor_persona_bot_validation", "", "f1 DESC, persona_label", 1000),
    ("all_hot_watcher_persona_lift", "m13_repo_watcher_persona_lift", "repo_name = '__ALL_HOT__'", "lift DESC, persona_label", 1000),
    ("repo_watcher_profile_latest", "m14_repo_watcher_profile", "", "rank_no, repo_name", 30),
    ("actor_burst_stability", "p01_actor_burst_stability", "", "total_events DESC, actor_login", 400),
    ("actor_retention_curves", "p02_actor_retention_curve", "", "cohort_week, days_since_first", 10000),
    ("actor_hotness", "p03_actor_hotness", "", "rank_no", 50),
    ("repo_bus_factor", "p04_repo_bus_factor", "bus_factor IN ('bus-1', 'thin')", "top_actor_share DESC, repo_name", 100),
    ("top_users_latest_with_bot", "b11_top_users_day", "", "rank, actor_login", 10),
    ("hot_vs_cold_attribution", "m05_hot_vs_cold_attribution", "", "cohort_scope, abs(cohen_d) DESC, feature_name", 40),
]
#: (query, table, order, limit): rows of tables that have no day.
WHOLE = [
    ("repo_similarity_edges", "g03_repo_similarity_edges", "jaccard DESC, shared_actors DESC, src_repo, dst_repo", 400),
    ("actor_collab_edges", "g06_actor_collab_edge", "weight DESC, actor_a, actor_b", 400),
    ("repo_layer_edges", "g09_repo_layer_edge", "layer, jaccard DESC, src_repo, dst_repo", 1500),
    ("repo_metapath_sim", "g10_repo_metapath_sim", "path_type, src_repo, rank_no", 1200),
    ("actor_rings", "g13_actor_ring", "actor_count DESC, repos_shared DESC, members", 30),
    ("repo_archetype", "m19_repo_archetype_rule", "archetype, events_per_day DESC, repo_name", 400),
    ("dynamic_attribution_30d", "m20_dynamic_attribution", "abs(cohen_d) DESC, feature_name", 15),
    ("authenticity_inputs", "m21_authenticity", "composite DESC, repo_name", 150),
]
#: (query, table, column of the repository, order, limit): rows of one repository, at the table's latest day if it has one.
BY_REPO = [
    ("repo_hotness_components_by_repo", "b21_repo_hotness_components", "repo_name", "rank_no, hotness_raw DESC", 7),
    ("repo_top_actors_latest_by_repo", "b33_repo_top_actors_latest", "repo_name", "actor_rank", 10),
    ("repo_dna_by_repo", "m04_repo_dna", "repo_name", "repo_name", 1),
    ("repo_watcher_persona_lift_by_repo", "m13_repo_watcher_persona_lift", "repo_name", "lift DESC, persona_label", 1000),
    ("repo_watcher_profile_by_repo", "m14_repo_watcher_profile", "repo_name", "repo_name", 1),
    ("repo_similarity_edges_by_repo", "g03_repo_similarity_edges", "src_repo", "jaccard DESC, dst_repo", 10),
    ("repo_archetype_by_repo", "m19_repo_archetype_rule", "repo_name", "repo_name", 1),
    ("repo_metapath_sim_by_repo", "g10_repo_metapath_sim", "src_repo", "path_type, rank_no", 15),
]
DATED = ("b", "m0", "m11", "m13", "m14", "p")


def some_repo(table: str, column: str = "repo_name") -> str:
    """The repository that a query by repository asks for unless told otherwise: the table's last by name."""
    return f"(SELECT max({column}) FROM {table}{f' WHERE metric_date = (SELECT max(metric_date) FROM {table})' if table.startswith(DATED) else ''})"


def by_repo(table: str, column: str, order: str, limit: int, repo: str | None = None) -> str:
    """Rows of one repository; repo is its name, or else the default's."""
    name = "'" + repo.replace("'", "''") + "'" if repo is not None else some_repo(table, column)
    day = f" AND metric_date = (SELECT max(metric_date) FROM {table})" if table.startswith(DATED) else ""
    return f"SELECT * FROM {table} WHERE {column} = {name}{day} ORDER BY {order} LIMIT {max(limit, 1)}"

#: (query, table, filter, order, days): rows of the last days up to the table's latest.
LAST_DAYS = [
    ("concentration_day", "b27_concentration_day", "", 30),
    ("actor_cohort_day", "b29_actor_cohort_day", "", 30),
    ("event_type_share_shift_day", "b30_event_type_share_shift_day", "", 30),
    ("repo_contributor_concentration_by_repo", "b32_repo_contributor_concentration_day", f"repo_name = {some_repo('b32_repo_contributor_concentration_day')}", 14),
    ("repo_event_type_share_by_repo", "b34_repo_event_type_share_day", f"repo_name = {some_repo('b34_repo_event_type_share_day')}", 14),
    ("repo_event_mix_shift_by_repo", "b35_repo_event_mix_shift_day", f"repo_name = {some_repo('b35_repo_event_mix_shift_day')}", 14),
    ("repo_rank_history_by_repo", "b16_repo_rank_score_day", f"repo_name = {some_repo('b16_repo_rank_score_day')}", 30),
    ("ecosystem_changepoints", "b28_ecosystem_changepoints", "", 30),
]
#: (query, table, keys, measures, days or none, order, limit): sums over a table.
SUMS = [
    ("daily_trend", "b01_daily_metrics", "metric_date", "CAST(sum(event_count) AS BIGINT) AS total_events", None, "metric_date", 90),
    ("actor_mix", "b01_daily_metrics", "actor_category", "CAST(sum(event_count) AS BIGINT) AS total_events", None, "total_events DESC, actor_category", 100),
    ("activity_pattern", "b02_activity_patterns", "hour_of_day, actor_category", "CAST(sum(event_count) AS BIGINT) AS total_events", None, "hour_of_day, actor_category", 1000),
    ("language_day_trend", "b03_language_day_trend", "metric_date, language_guess", "CAST(sum(event_count) AS BIGINT) AS total_events", None, "metric_date DESC, total_events DESC, language_guess", 36),
    ("top_repos_week", "b11_top_repos_day", "repo_name", "CAST(sum(event_count) AS BIGINT) AS event_count", 7, "event_count DESC, repo_name", 10),
    ("top_repos_month", "b11_top_repos_day", "repo_name", "CAST(sum(event_count) AS BIGINT) AS event_count", 30, "event_count DESC, repo_name", 10),
    ("top_users_week", "b11_top_users_day", "actor_login", "CAST(sum(event_count) AS BIGINT) AS event_count", 7, "event_count DESC, actor_login", 10),
    ("top_users_month", "b11_top_users_day", "actor_login", "CAST(sum(event_count) AS BIGINT) AS event_count", 30, "event_count DESC, actor_login", 10),
    ("event_type_breakdown", "b04_event_type_day", "metric_date, event_type", "CAST(sum(event_count) AS BIGINT) AS total_events", 30, "metric_date, total_events DESC, event_type", 64),
    ("user_segments", "b15_user_segment_latest", "segment", "count(DISTINCT actor_login) AS users, CAST(sum(event_count) AS BIGINT) AS events", 1, "users DESC, segment", 10),
    ("payload_buckets_latest", "b09_payload_bucket_day", "size_bucket", "CAST(sum(event_count) AS BIGINT) AS event_count", 1, "size_bucket", 10),
    ("event_trend", "rt_event_metrics", "window_start", "CAST(sum(event_count) AS BIGINT) AS total_events", None, "window_start", 240),
]


def register(c: Catalog) -> None:
    for name, table, where, order, limit in LATEST:
        c.add(f"q_{name}", table, f"SELECT * FROM {table} WHERE metric_date = (SELECT max(metric_date) FROM {table}){f' AND {where}' if where else ''} ORDER BY {order} LIMIT {max(limit, 1)}")
    for name, table, where, days in LAST_DAYS:
        c.add(f"q_{name}", table, lambda d, t=table, w=where, n=days: f"SELECT * FROM {t} WHERE metric_date >= {d.plus_days(f'(SELECT max(metric_date) FROM {t})', str(1 - n))}{f' AND {w}' if w else ''}")
    for name, table, keys, measures, days, order, limit in SUMS:
        c.add(f"q_{name}", table, lambda d, t=table, k=keys, m=measures, n=days, o=order, z=limit: f"SELECT {k}, {m} FROM {t}{f' WHERE metric_date >= {d.plus_days(f"(SELECT max(metric_date) FROM {t})", str(1 - n))}' if n else ''} GROUP BY {k} ORDER BY {o} LIMIT {z}")
    for name, table, order, limit in WHOLE:
        c.add(f"q_{name}", table, f"SELECT * FROM {table} ORDER BY {order} LIMIT {limit}")
    for name, table, column, order, limit in BY_REPO:
        c.add(f"q_{name}", table, by_repo(table, column, order, limit))
    stats = ("watch_share", "fork_share", "issues_share", "pr_share", "push_share", "bot_ratio", "night_ratio", "top1_actor_share", "event_entropy")
    c.add("q_repo_dna_cohort_stats", "m04_repo_dna", f"SELECT cohort_group, count(*) AS repos, round(avg(total_events), 6) AS avg_events, {', '.join(f'round(avg({x}), 6) AS {x}' for x in stats)} FROM m04_repo_dna WHERE metric_date = (SELECT max(metric_date) FROM m04_repo_dna) GROUP BY cohort_group")
    hundred, half = dbl("100"), dbl("0.5")  # engines round doubles differently
    for name, table in (("alerts", "rt_anomaly_alerts"), ("alerts_day", "rt_anomaly_alerts_day")):
        c.add(f"q_{name}", table, f"SELECT window_start, repo_name, current_events, baseline_events, floor(anomaly_ratio * {hundred} + {half}) / {hundred} AS anomaly_ratio, alert_level FROM {table} ORDER BY window_start DESC, {table}.anomaly_ratio DESC, repo_name LIMIT 12")
    c.add("q_hot_repos", "rt_repo_scores", f"SELECT repo_name, max(hotness_score) AS hotness_score, {', '.join(f'{big(f"sum({x})")} AS {x}' for x in REALTIME.values())} FROM rt_repo_scores GROUP BY repo_name ORDER BY hotness_score DESC, repo_name LIMIT 10")
    c.add("q_summary_metrics", "b01_daily_metrics rt_event_metrics rt_repo_scores rt_anomaly_alerts", "SELECT (SELECT count(*) FROM b01_daily_metrics) AS daily_rows, (SELECT count(*) FROM rt_event_metrics) AS realtime_rows, (SELECT count(DISTINCT repo_name) FROM rt_repo_scores) AS repos, (SELECT count(*) FROM rt_anomaly_alerts) AS alerts")
    forecast = "(SELECT repo_name FROM b18_repo_trend_forecast GROUP BY repo_name ORDER BY count(*) DESC, max(metric_date) DESC, repo_name LIMIT 1)"
    c.add("q_repo_trend_forecast", "b18_repo_trend_forecast", f"SELECT * FROM (SELECT * FROM b18_repo_trend_forecast WHERE repo_name = {forecast} ORDER BY metric_date DESC LIMIT 30) t ORDER BY metric_date")
    c.add("q_repo_trend_forecast_by_repo", "b18_repo_trend_forecast", f"SELECT * FROM b18_repo_trend_forecast WHERE repo_name = {some_repo('b18_repo_trend_forecast')} ORDER BY metric_date DESC LIMIT 30")
    c.add("q_cohort_averages", "m04_repo_dna", f"SELECT cohort_group, count(*) AS repos, {', '.join(f'round(avg({x}), 6) AS {x}' for x in FEATURES)} FROM m04_repo_dna WHERE metric_date = (SELECT max(metric_date) FROM m04_repo_dna) GROUP BY cohort_group")
    c.add("q_repo_dna_top", "m04_repo_dna", "SELECT * FROM (SELECT m.*, row_number() OVER (PARTITION BY cohort_group ORDER BY rank_score DESC, repo_name) AS place FROM m04_repo_dna m WHERE cohort_group IN ('hot', 'cold')) x WHERE place <= 6")
    c.add("q_repo_summary", "m04_repo_dna b14_repo_rank_daily m14_repo_watcher_profile m19_repo_archetype_rule p04_repo_bus_factor", f"""
SELECT d.repo_name, d.cohort_group, d.total_events, d.rank_score, k.rank_no, w.watchers, w.dominant_persona, a.archetype, p.bus_factor, p.top_actor FROM m04_repo_dna d LEFT JOIN b14_repo_rank_daily k ON d.repo_name = k.repo_name
  LEFT JOIN m14_repo_watcher_profile w ON d.repo_name = w.repo_name LEFT JOIN m19_repo_archetype_rule a ON d.repo_name = a.repo_name LEFT JOIN p04_repo_bus_factor p ON d.repo_name = p.repo_name WHERE d.repo_name = {some_repo('m04_repo_dna')}""")
    c.add("q_actor_summary", "persona ev", """
WITH a AS (SELECT actor_login, persona_label, is_bot, event_count, active_days, unique_repos FROM persona WHERE actor_login = (SELECT max(actor_login) FROM persona)),
r AS (SELECT e.actor_login, repo_name, count(*) AS events, row_number() OVER (ORDER BY count(*) DESC, repo_name) AS place FROM ev e JOIN a ON e.actor_login = a.actor_login GROUP BY e.actor_login, repo_name)
SELECT a.*, r.repo_name, r.events, round(CAST(r.events AS DOUBLE) / a.event_count, 6) AS share, r.place FROM a JOIN r ON a.actor_login = r.actor_login WHERE place <= 8""")
    c.add("q_burst_stability_snapshot", "b19_repo_burst_stability", "SELECT metric_date, repo_name, rank_no, rank_score, burst_index, stability_index, short_term_pressure, events_7d_sum, events_28d_avg, quadrant FROM (SELECT b.*, row_number() OVER (PARTITION BY quadrant ORDER BY rank_score DESC, repo_name) AS k FROM b19_repo_burst_stability b WHERE rank_score > 0) x WHERE k <= 15 ORDER BY rank_score DESC, repo_name LIMIT 60")
    c.add("q_top_repo_rank_paths", "b16_repo_rank_score_day", "WITH p AS (SELECT repo_name, round(count(*) * avg(rank_score), 6) AS persistence FROM b16_repo_rank_score_day GROUP BY repo_name HAVING count(*) >= 2 ORDER BY persistence DESC, repo_name LIMIT 8) SELECT r.metric_date, r.repo_name, r.rank_no, r.rank_score FROM b16_repo_rank_score_day r JOIN p ON r.repo_name = p.repo_name")
