"""Concentration, change points, cohorts, shifts and repository deep dives."""

from __future__ import annotations

from tidemill.functions.exprs import big, dbl, r, row_no, share
from tidemill.plans.catalog import Catalog

N = "count(*) AS event_count"


def entropy(p: str, times: str = "1") -> str:
    return f"sum(CASE WHEN {p} > 0 THEN -{times} * {p} * log2({p}) ELSE {dbl('0')} END)"


def register(c: Catalog) -> None:
    lag7 = lambda x: f"lag({x}, 7) OVER (ORDER BY metric_date)"
    # Repositories of equal counts share a row, so a day's windows hold its distinct counts only; those over days are as small as the calendar.
    c.add("b27_concentration_day", "feat", f"""
WITH v AS (SELECT metric_date, total_events, count(*) AS same FROM feat GROUP BY metric_date, total_events),
w AS (SELECT v.*, {dbl('total_events')} / sum(total_events * same) OVER (PARTITION BY metric_date) AS s, {big('sum(same) OVER (PARTITION BY metric_date ORDER BY total_events) - same')} AS below, {big('sum(same) OVER (PARTITION BY metric_date ORDER BY total_events DESC) - same')} AS above FROM v),
a AS (SELECT metric_date, {big('sum(total_events * same)')} AS total_events, {big('sum(same)')} AS repo_count, max(s) AS top1, sum(s * greatest(0, least(same, 5 - above))) AS top5, sum(same * s * s) AS hhi, {entropy('s', 'same')} AS h, 2 * sum(s * same * (below + ({dbl('same')} + 1) / 2)) / sum(same) - ({dbl('sum(same)')} + 1) / sum(same) AS gini FROM w GROUP BY metric_date),
n AS (SELECT a.*, CASE WHEN repo_count <= 1 THEN {dbl('0')} ELSE h / log2({dbl('repo_count')}) END AS nh FROM a)
SELECT metric_date, total_events, repo_count, {r('top1')} AS top1_share, {r('top5')} AS top5_share, {r('hhi')} AS hhi, {r('h')} AS entropy, {r('nh')} AS normalized_entropy, {r('gini')} AS gini,
  {r(f"coalesce({dbl(f'total_events - {lag7("total_events")}')} / {lag7('total_events')}, 0)")} AS events_delta_7d, {r(f"coalesce({dbl(f'repo_count - {lag7("repo_count")}')} / {lag7('repo_count')}, 0)")} AS repo_count_delta_7d,
  {', '.join(f"{r(f'coalesce({x} - {lag7(x)}, 0)')} AS {n}_delta_7d" for x, n in (('top5', 'top5_share'), ('gini', 'gini'), ('h', 'entropy')))} FROM n""")
    c.add("b28_ecosystem_changepoints", "b27_concentration_day b04_event_type_day", lambda d: f"""
WITH m AS (SELECT avg(total_events) AS mean, stddev_samp(total_events) AS std, count(*) AS n FROM b27_concentration_day),
z AS (SELECT metric_date, ({dbl('total_events')} - mean) / CASE WHEN coalesce(std, 0) = 0 THEN 1 ELSE std END AS z FROM b27_concentration_day CROSS JOIN m WHERE n >= 4),
u AS (SELECT z.*, {r('sum(z) OVER (ORDER BY metric_date)', 9)} AS cusum FROM z),
s AS (SELECT u.*, CASE WHEN cusum > 0 THEN 1 WHEN cusum < 0 THEN -1 ELSE 0 END AS sign FROM u),
p AS (SELECT s.*, {d.last_value('nullif(sign, 0)', 'ORDER BY metric_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING')} AS before FROM s),
t AS (SELECT metric_date, event_type FROM (SELECT metric_date, event_type, row_number() OVER (PARTITION BY metric_date ORDER BY event_count DESC, event_type) AS k FROM b04_event_type_day) x WHERE k = 1)
SELECT p.metric_date, CASE WHEN z >= 0 THEN 'burst' ELSE 'drop' END AS kind, {r('cusum')} AS cusum, {r('z')} AS z_score, t.event_type AS contribution_top_type
FROM p JOIN t ON p.metric_date = t.metric_date WHERE abs(z) >= 2 OR (abs(cusum) >= 3 AND before IS NOT NULL AND sign <> before)""")
    c.add("b29_actor_cohort_day", "ev", lambda d: f"""
WITH a AS (SELECT metric_date, actor_login, {N}, count(DISTINCT repo_name) AS repos FROM ev GROUP BY metric_date, actor_login),
w AS (SELECT a.*, min(metric_date) OVER (PARTITION BY actor_login) AS first_date, lag(metric_date) OVER (PARTITION BY actor_login ORDER BY metric_date) AS prev FROM a),
g AS (SELECT w.*, {d.days('metric_date', 'prev')} AS gap, {d.days('first_date', 'm.start')} AS since FROM w CROSS JOIN (SELECT min(metric_date) AS start FROM ev) m),
k AS (SELECT g.*, CASE WHEN metric_date = first_date AND since >= 3 THEN 'new' WHEN metric_date = first_date THEN 'existing' WHEN gap >= 3 THEN 'reactivated' ELSE 'returning' END AS cohort FROM g)
SELECT metric_date, cohort, count(*) AS actors, {big('sum(event_count)')} AS events, {r('avg(repos)')} AS avg_unique_repos, {r("avg(CASE WHEN cohort = 'reactivated' THEN gap END)")} AS avg_reactivation_gap_days FROM k GROUP BY metric_date, cohort""")
    c.add("b30_event_type_share_shift_day", "b04_event_type_day", f"""
WITH s AS (SELECT metric_date, event_type, event_count, {dbl('event_count')} / sum(event_count) OVER (PARTITION BY metric_date) AS s FROM b04_event_type_day)
SELECT metric_date, event_type, event_count, {r('s')} AS share, {r('s - coalesce(lag(s) OVER (PARTITION BY event_type ORDER BY metric_date), 0)')} AS share_shift FROM s""")
    text = lambda d, x, k: f"CAST(CAST(round({x}, {k}) AS DECIMAL(18,{k})) AS {d.string})"
    c.add("b31_offline_insights_latest", "b27_concentration_day b29_actor_cohort_day b30_event_type_share_shift_day ev", lambda d: f"""
WITH l AS (SELECT max(metric_date) AS metric_date FROM ev),
f AS (SELECT l.metric_date, top5_share, hhi, normalized_entropy FROM b27_concentration_day b JOIN l ON b.metric_date = l.metric_date),
k AS (SELECT max(l.metric_date) AS metric_date, coalesce(sum(CASE WHEN cohort = 'new' THEN actors ELSE 0 END) / {dbl('sum(actors)')}, 0) AS fresh, coalesce(sum(CASE WHEN cohort = 'reactivated' THEN actors ELSE 0 END) / {dbl('sum(actors)')}, 0) AS back FROM l LEFT JOIN b29_actor_cohort_day b ON b.metric_date = l.metric_date),
s AS (SELECT metric_date, event_type, share, share_shift FROM (SELECT b.*, row_number() OVER (ORDER BY abs(share_shift) DESC, event_count DESC, event_type) AS n FROM b30_event_type_share_shift_day b JOIN l ON b.metric_date = l.metric_date) x WHERE n = 1)
SELECT metric_date, 'concentration' AS insight_type, concat('Concentration: the top five hold ', {text(d, 'top5_share', 3)}, ' of events, HHI ', {text(d, 'hhi', 3)}, ', normalised entropy ', {text(d, 'normalized_entropy', 3)}, '.') AS insight_text,
  concat('{{"top5_share":', {text(d, 'top5_share', 6)}, ',"hhi":', {text(d, 'hhi', 6)}, ',"normalized_entropy":', {text(d, 'normalized_entropy', 6)}, '}}') AS evidence_json FROM f
UNION ALL SELECT metric_date, 'cohort', concat('Actors: ', {text(d, 'fresh', 3)}, ' new, ', {text(d, 'back', 3)}, ' reactivated.'), concat('{{"new_ratio":', {text(d, 'fresh', 6)}, ',"reactivated_ratio":', {text(d, 'back', 6)}, '}}') FROM k
UNION ALL SELECT metric_date, 'event_shift', concat('Event mix: ', event_type, ' moved by ', {text(d, 'share_shift', 3)}, ' against the day before.'), concat('{{"event_type":"', event_type, '","share":', {text(d, 'share', 6)}, ',"share_shift":', {text(d, 'share_shift', 6)}, '}}') FROM s""")

    c.add("top_scope", "score_day ev", "SELECT repo_name FROM score_day WHERE metric_date = (SELECT max(metric_date) FROM ev)", internal=True)
    c.add("repo_actor_day", "ev top_scope", f"SELECT ev.metric_date, ev.repo_name, actor_login, max(actor_category) AS actor_category, {N} FROM ev JOIN top_scope t ON ev.repo_name = t.repo_name GROUP BY ev.metric_date, ev.repo_name, actor_login", internal=True)
    c.add("b32_repo_contributor_concentration_day", "repo_actor_day score_day", f"""
WITH s AS (SELECT repo_actor_day.*, {dbl('event_count')} / sum(event_count) OVER (PARTITION BY metric_date, repo_name) AS s, row_number() OVER (PARTITION BY metric_date, repo_name ORDER BY event_count DESC, actor_login) AS k FROM repo_actor_day),
a AS (SELECT metric_date, repo_name, {big('sum(event_count)')} AS total_events, count(*) AS active_actors, {r('max(s)')} AS top1_actor_share, {r('sum(CASE WHEN k <= 5 THEN s ELSE 0 END)')} AS top5_actor_share, {r('sum(s * s)')} AS actor_hhi FROM s GROUP BY metric_date, repo_name)
SELECT a.metric_date, a.repo_name, k.rank_no, k.rank_score, total_events, active_actors, top1_actor_share, top5_actor_share, actor_hhi FROM a LEFT JOIN score_day k ON a.metric_date = k.metric_date AND a.repo_name = k.repo_name""")
    c.add("b33_repo_top_actors_latest", "repo_actor_day score_day ev", f"""
SELECT a.metric_date, a.repo_name, k.rank_no, k.rank_score, actor_rank, actor_login, actor_category, event_count AS actor_events, {r('s')} AS share
FROM (SELECT repo_actor_day.*, {dbl('event_count')} / sum(event_count) OVER (PARTITION BY repo_name) AS s, {row_no('repo_name', 'event_count DESC, actor_login')} AS actor_rank FROM repo_actor_day WHERE metric_date = (SELECT max(metric_date) FROM ev)) a
LEFT JOIN score_day k ON a.metric_date = k.metric_date AND a.repo_name = k.repo_name WHERE actor_rank <= 10""")
    c.add("event_share", "ev top_scope", f"""
WITH g AS (SELECT ev.metric_date, ev.repo_name, CASE WHEN event_type IN ('WatchEvent', 'ForkEvent', 'IssuesEvent', 'PullRequestEvent', 'PushEvent') THEN event_type ELSE 'Other' END AS event_type FROM ev JOIN top_scope t ON ev.repo_name = t.repo_name),
n AS (SELECT metric_date, repo_name, event_type, {N} FROM g GROUP BY metric_date, repo_name, event_type), t AS (SELECT metric_date, repo_name, {big('sum(event_count)')} AS total_events FROM n GROUP BY metric_date, repo_name),
k AS (SELECT 'WatchEvent' AS event_type UNION ALL SELECT 'ForkEvent' UNION ALL SELECT 'IssuesEvent' UNION ALL SELECT 'PullRequestEvent' UNION ALL SELECT 'PushEvent' UNION ALL SELECT 'Other')
SELECT t.metric_date, t.repo_name, k.event_type, coalesce(n.event_count, 0) AS event_count, t.total_events, {share('coalesce(n.event_count, 0)', 't.total_events')} AS s
FROM t CROSS JOIN k LEFT JOIN n ON n.metric_date = t.metric_date AND n.repo_name = t.repo_name AND n.event_type = k.event_type""", internal=True)
    c.add("b34_repo_event_type_share_day", "event_share score_day", f"SELECT s.metric_date, s.repo_name, k.rank_no, k.rank_score, event_type, event_count, total_events, {r('s')} AS share FROM event_share s LEFT JOIN score_day k ON s.metric_date = k.metric_date AND s.repo_name = k.repo_name")
    kl = lambda p, m: f"CASE WHEN {p} <= 0 OR {m} <= 0 THEN {dbl('0')} ELSE {p} * log2({p} / {m}) END"
    c.add("b35_repo_event_mix_shift_day", "event_share score_day", f"""
WITH q AS (SELECT metric_date, repo_name, event_type, s AS p, lag(s) OVER (PARTITION BY repo_name, event_type ORDER BY metric_date) AS q FROM event_share),
m AS (SELECT q.*, (p + q) / 2 AS m, {r('abs(p - q)', 9)} AS moved FROM q WHERE q IS NOT NULL),
a AS (SELECT metric_date, repo_name, {r(f"sum(({kl('p', 'm')} + {kl('q', 'm')}) / 2)")} AS js_divergence, {r('sum(abs(p - q))')} AS l1_distance, {r('sum(abs(p - q))')} AS total_abs_shift FROM m GROUP BY metric_date, repo_name),
t AS (SELECT metric_date, repo_name, event_type, moved, p - q AS signed FROM (SELECT m.*, row_number() OVER (PARTITION BY metric_date, repo_name ORDER BY moved DESC, event_type) AS n FROM m) x WHERE n = 1)
SELECT a.metric_date, a.repo_name, k.rank_no, k.rank_score, js_divergence, l1_distance, total_abs_shift, t.event_type AS top_shift_event_type, {r('t.moved')} AS top_shift_abs, {r('t.signed')} AS top_shift_signed
FROM a JOIN t ON a.metric_date = t.metric_date AND a.repo_name = t.repo_name LEFT JOIN score_day k ON a.metric_date = k.metric_date AND a.repo_name = k.repo_name""")
