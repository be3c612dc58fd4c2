"""Repository ranking, trends, health and warnings."""

from __future__ import annotations

from tidemill.functions.exprs import big, dbl, minmax, r, row_no, share
from tidemill.plans.catalog import Catalog

#: Weights of the ranking score and of the health score (fixed values).
RANK = {"hotness": 0.45, "momentum": 0.25, "engagement": 0.20, "stability": 0.10, "bot_ratio": -0.10}
HEALTH = {"dev": 0.35, "community": 0.25, "attention": 0.20, "diversity": 0.20, "bot": -0.10}
PARTS = {"hotness_part": "hotness", "momentum_part": "momentum", "engagement_part": "engagement", "stability_part": "stability", "bot_penalty": "bot_ratio"}


def score(weights: dict[str, float]) -> str:
    return r(" + ".join(f"{n}_norm * {dbl(w)}" for n, w in weights.items()))


def register(c: Catalog, rank_limit: int = 30, trend_top: int = 8) -> None:
    week = "PARTITION BY repo_name ORDER BY metric_date"
    c.add("trend", "feat", f"""
SELECT w.*, CASE WHEN lag6 IS NULL THEN {dbl('0')} ELSE {dbl('total_events - lag6')} / 6 END AS slope7, CASE WHEN lag6 IS NULL OR lag6 <= 0 THEN {dbl('0')} ELSE {dbl('total_events - lag6')} / lag6 END AS pct_change7,
  CASE WHEN ma7 <= 0 THEN {dbl('0')} ELSE (ma3 - ma7) / ma7 END AS momentum
FROM (SELECT feat.*, avg(total_events) OVER ({week} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS ma3, avg(total_events) OVER ({week} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ma7,
  lag(total_events, 6) OVER ({week}) AS lag6, row_number() OVER ({week}) AS active_so_far, row_number() OVER (PARTITION BY repo_name ORDER BY metric_date DESC) AS from_last FROM feat) w""", internal=True)
    label = "CASE WHEN momentum >= 0.2 THEN 'surging' WHEN momentum >= 0.05 THEN 'warming' WHEN momentum <= -0.2 THEN 'cooling_fast' WHEN momentum <= -0.05 THEN 'cooling' ELSE 'stable' END"
    forecast = f"greatest({dbl('0')}, ma7 * (1 + momentum))"
    c.add("b13_repo_trend_features", "trend", f"SELECT metric_date, repo_name, total_events, {r('ma3')} AS ma3, {r('ma7')} AS ma7, {r('slope7')} AS slope7, {r('momentum')} AS momentum, {r(forecast)} AS forecast_next_day, {label} AS trend_label FROM trend")
    norms = lambda cols: ", ".join(f"{minmax(x, f'lo_{n}', f'hi_{n}')} AS {n}_norm" for n, x in cols.items())
    ends = lambda cols: ", ".join(f"min({x}) AS lo_{n}, max({x}) AS hi_{n}" for n, x in cols.items())
    whole = {"hotness": "hotness_decayed_total", "momentum": "momentum_latest", "engagement": "avg_daily_unique_actors", "stability": "stability_index", "bot_ratio": "bot_ratio"}
    # Rounding to 12 digits before norms and ties keeps them apart from the order in which sums were added.
    c.add("rank_all", "trend", f"""
WITH a AS (SELECT repo_name, max(metric_date) AS metric_date, {r('sum(hotness_raw)', 9)} AS hotness_raw_total, {r('sum(hotness_decayed)', 9)} AS hotness_decayed_total, avg(unique_actors) AS avg_daily_unique_actors,
    {share('sum(bot_events)', 'sum(bot_events) + sum(human_events)')} AS bot_ratio, {dbl('count(*)')} / max(total_days) AS stability_index, max(CASE WHEN from_last = 1 THEN momentum END) AS momentum_latest, max(CASE WHEN from_last = 1 THEN {label} END) AS trend_label
  FROM trend GROUP BY repo_name),
m AS (SELECT {ends(whole)} FROM a), n AS (SELECT a.*, {norms(whole)} FROM a CROSS JOIN m), s AS (SELECT n.*, {score(RANK)} AS rank_score FROM n)
SELECT s.*, {row_no('metric_date', 'rank_score DESC, hotness_decayed_total DESC, repo_name')} AS rank_no FROM s""", internal=True)
    shown = f"metric_date, repo_name, rank_no, rank_score, {r('hotness_raw_total')} AS hotness_raw_total, {r('hotness_decayed_total')} AS hotness_decayed_total, {r('momentum_latest')} AS momentum_latest, {r('avg_daily_unique_actors')} AS avg_daily_unique_actors, {r('stability_index')} AS stability_index, {r('bot_ratio')} AS bot_ratio, trend_label"
    c.add("b14_repo_rank_daily", "rank_all", f"SELECT {shown} FROM rank_all WHERE rank_no <= {rank_limit}")
    daily = {"hotness": "hotness_decayed", "momentum": "momentum", "engagement": "unique_actors", "stability": "stability_day", "bot_ratio": "bot_ratio_day"}
    c.add("score_day", "trend", f"""
WITH b AS (SELECT metric_date, repo_name, {r('hotness_decayed', 9)} AS hotness_decayed, momentum, unique_actors, {dbl('active_so_far')} / total_days AS stability_day, {share('bot_events', 'bot_events + human_events')} AS bot_ratio_day FROM trend),
m AS (SELECT metric_date, {ends(daily)} FROM b GROUP BY metric_date), n AS (SELECT b.*, {norms(daily)} FROM b JOIN m ON b.metric_date = m.metric_date), s AS (SELECT n.*, {score(RANK)} AS rank_score FROM n)
SELECT * FROM (SELECT s.*, {row_no('metric_date', 'rank_score DESC, hotness_decayed DESC, repo_name')} AS rank_no FROM s) t WHERE rank_no <= {rank_limit}""", internal=True)
    parts = ", ".join(f"{r(f'{n}_norm * {dbl(abs(RANK[n]))}')} AS {p}" for p, n in PARTS.items())
    rounded = ", ".join(f"{r(f'{n}_norm')} AS {n}_norm" for n in RANK)
    c.add("b16_repo_rank_score_day", "score_day", f"SELECT metric_date, repo_name, rank_no, rank_score, {parts}, {rounded} FROM score_day")
    lag = lambda x: f"lag({x}, 1) OVER (PARTITION BY repo_name ORDER BY metric_date)"
    c.add("b17_repo_rank_delta_explain_day", "b16_repo_rank_score_day", f"""
SELECT * FROM (SELECT metric_date, repo_name, rank_no, rank_score, {lag('rank_no')} - rank_no AS delta_rank_no, {', '.join(f"{r(f'{x} - {lag(x)}')} AS delta_{x}" for x in ('rank_score', *PARTS))}
  FROM b16_repo_rank_score_day) t WHERE delta_rank_no IS NOT NULL""")
    c.add("b18_repo_trend_forecast", "b14_repo_rank_daily trend", f"""
WITH k AS (SELECT repo_name, rank_no FROM b14_repo_rank_daily ORDER BY rank_no, rank_score DESC, repo_name LIMIT {trend_top})
SELECT t.metric_date, t.repo_name, k.rank_no, total_events, {r('hotness_raw')} AS hotness_raw, {r('hotness_decayed')} AS hotness_decayed, {r('ma3')} AS ma3, {r('ma7')} AS ma7, {r('momentum')} AS momentum, {r('slope7')} AS slope7, {r(forecast)} AS forecast_next_day, {label} AS trend_label
FROM trend t JOIN k ON t.repo_name = k.repo_name""")
    c.add("b19_repo_burst_stability", "feat rank_all", f"""
WITH a AS (SELECT repo_name, max(latest_date) AS metric_date, {big('sum(CASE WHEN days_ago <= 6 THEN total_events ELSE 0 END)')} AS events_7d_sum, max(CASE WHEN days_ago <= 6 THEN total_events ELSE 0 END) AS max7,
    {big('sum(CASE WHEN days_ago <= 27 THEN total_events ELSE 0 END)')} AS sum28, {big('sum(CASE WHEN days_ago <= 27 AND total_events > 0 THEN 1 ELSE 0 END)')} AS active28 FROM feat GROUP BY repo_name),
b AS (SELECT a.*, {dbl('sum28')} / 28 AS events_28d_avg, {dbl('max7')} / greatest({dbl('sum28')} / 28, {dbl('1')}) AS burst_index, {dbl('active28')} / 28 AS stability_index, {share('events_7d_sum', 'sum28')} AS short_term_pressure FROM a)
SELECT b.metric_date, b.repo_name, k.rank_no, k.rank_score, {r('burst_index')} AS burst_index, {r('b.stability_index')} AS stability_index, {r('short_term_pressure')} AS short_term_pressure, events_7d_sum, {r('events_28d_avg')} AS events_28d_avg,
  CASE WHEN burst_index >= 2 THEN CASE WHEN b.stability_index >= 0.6 THEN 'rising_core' ELSE 'short_spike' END WHEN b.stability_index >= 0.6 THEN 'steady_core' ELSE 'long_tail' END AS quadrant
FROM b LEFT JOIN rank_all k ON b.repo_name = k.repo_name""")
    health = {"dev": "push_events", "community": "issues_events + pull_request_events", "attention": "watch_events + fork_events", "diversity": "unique_actors", "bot": "day_bot_ratio"}
    c.add("b23_repo_health_latest", "feat rank_all", f"""
WITH l AS (SELECT feat.*, {share('bot_events', 'bot_events + human_events')} AS day_bot_ratio FROM feat WHERE metric_date = latest_date),
m AS (SELECT {ends(health)} FROM l), n AS (SELECT l.*, {norms(health)} FROM l CROSS JOIN m)
SELECT n.metric_date, n.repo_name, k.rank_no, k.rank_score, {score(HEALTH)} AS health_score, total_events, unique_actors, push_events, watch_events, fork_events, issues_events, pull_request_events,
  {r('day_bot_ratio')} AS bot_ratio, {', '.join(f"{r(f'{x}_norm')} AS {x}_norm" for x in ('dev', 'community', 'attention', 'diversity'))} FROM n LEFT JOIN rank_all k ON n.repo_name = k.repo_name""")
    c.add("b24_offline_anomaly_alerts", "feat rank_all", f"""
WITH s AS (SELECT repo_name, avg(total_events) AS mean, stddev_samp(total_events) AS std FROM feat GROUP BY repo_name),
z AS (SELECT f.metric_date, f.repo_name, f.total_events, mean, std, {r(f"CASE WHEN std <= 0 THEN {dbl('0')} ELSE (total_events - mean) / std END", 9)} AS z FROM feat f JOIN s ON f.repo_name = s.repo_name WHERE f.metric_date = f.latest_date)
SELECT z.metric_date, z.repo_name, k.rank_no, k.rank_score, total_events AS current_events, {r('mean')} AS baseline_mean, {r('std')} AS baseline_std, {r('z')} AS z_score, CASE WHEN z >= 3 THEN 'high' ELSE 'medium' END AS alert_level
FROM z LEFT JOIN rank_all k ON z.repo_name = k.repo_name WHERE z >= 2 ORDER BY z DESC, current_events DESC, z.repo_name LIMIT 80""")
    c.add("b25_offline_decline_warnings", "trend rank_all", f"""
SELECT t.metric_date, t.repo_name, k.rank_no, k.rank_score, {r('slope7')} AS slope7, {r('pct_change7')} AS pct_change7, CASE WHEN pct_change7 <= -0.6 THEN 'high' WHEN pct_change7 <= -0.3 THEN 'medium' ELSE 'low' END AS warning_level
FROM trend t LEFT JOIN rank_all k ON t.repo_name = k.repo_name WHERE t.metric_date = latest_date AND slope7 <= -1 ORDER BY t.slope7, t.pct_change7, t.repo_name LIMIT 80""")
    c.add("b26_repo_rank_explain_latest", "rank_all ev", f"SELECT metric_date, repo_name, rank_no, rank_score, {parts}, {rounded} FROM rank_all WHERE metric_date = (SELECT max(metric_date) FROM ev) AND rank_no <= {rank_limit}")
