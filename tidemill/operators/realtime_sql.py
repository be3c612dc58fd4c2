"""The realtime tables (S01-S03) as batch SQL over events: what the streams hold once all windows are closed."""

from __future__ import annotations

from tidemill.functions.exprs import COUNTS, HOTNESS, big, dbl, r
from tidemill.plans.catalog import Catalog

#: Columns of the realtime counts; the one of issues differs from the daily tables (fixed values).
REALTIME = COUNTS | {"IssuesEvent": "issue_events"}


def register(c: Catalog) -> None:
    weight = "CASE " + " ".join(f"WHEN event_type = '{t}' THEN {dbl(w)}" for t, w in HOTNESS.items()) + f" ELSE {dbl('1')} END"
    counts = ", ".join(f"{big(f"sum(CASE WHEN event_type = '{t}' THEN 1 ELSE 0 END)")} AS {n}" for t, n in REALTIME.items())
    c.add("rt_event_metrics", "ev", lambda d: f"SELECT {d.minute('event_ts')} AS window_start, event_type, repo_name, actor_category, count(*) AS event_count FROM ev GROUP BY {d.minute('event_ts')}, event_type, repo_name, actor_category", internal=True)
    for name, window in (("", lambda d: d.minute("event_ts")), ("_day", lambda d: "CAST(metric_date AS TIMESTAMP)")):
        c.add(f"rt_scores{name}", "ev", lambda d, w=window: f"SELECT {w(d)} AS window_start, repo_name, count(*) AS events, sum({weight}) AS hotness_score, {counts} FROM ev GROUP BY {w(d)}, repo_name", internal=True)
        c.add(f"rt_anomaly_alerts{name}", f"rt_scores{name}", f"""
WITH b AS (SELECT window_start, {dbl('sum(events)')} / count(*) AS base FROM rt_scores{name} GROUP BY window_start),
x AS (SELECT s.window_start, s.repo_name, s.events, b.base, {dbl('s.events')} / greatest(b.base, {dbl('1')}) AS ratio FROM rt_scores{name} s JOIN b ON s.window_start = b.window_start)
SELECT window_start, repo_name, events AS current_events, {r('base')} AS baseline_events, {r('ratio')} AS anomaly_ratio, CASE WHEN ratio >= 4 THEN 'high' ELSE 'medium' END AS alert_level FROM x WHERE ratio >= 2""", internal=True)
    c.add("rt_repo_scores", "rt_scores", f"SELECT window_start, repo_name, hotness_score, {', '.join(REALTIME.values())} FROM rt_scores", internal=True)
