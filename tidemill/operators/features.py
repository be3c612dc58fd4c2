"""Repository and actor features, cohorts of hot repositories, attribution and watcher tables."""

from __future__ import annotations

from tidemill.functions.exprs import big, count_when, dbl, minmax, r, share
from tidemill.operators.ecosystem import entropy
from tidemill.plans.catalog import Catalog

N = "count(*) AS n"
TYPES = {"watch": "WatchEvent", "fork": "ForkEvent", "issues": "IssuesEvent", "pr": "PullRequestEvent", "push": "PushEvent"}
FEATURES = ["watch_share", "fork_share", "issues_share", "pr_share", "push_share", "bot_ratio", "night_ratio", "weekend_ratio", "pr_push_ratio", "active_days_ratio", "actors_per_event", "event_entropy", "top1_actor_share", "log_total_events", "log_payload_p95"]
LATEST = "(SELECT max(metric_date) FROM ev)"
FIRST = "DATE '1970-01-01'"


def shares(total: str) -> str:
    return ", ".join(f"{share(count_when(f'event_type = {t!r}'), total)} AS {n}_share" for n, t in TYPES.items())


def unpivot(d, source: str, keep: str, where: str = "") -> str:
    return f"SELECT {keep}, {d.unpivot(FEATURES)} FROM {source} {where}"


def register(c: Catalog) -> None:
    p95 = "percentile_disc(0.95) WITHIN GROUP (ORDER BY CASE WHEN event_type = 'PushEvent' THEN payload_size END)"
    c.add("dna_base", "ev rank_all", f"""
WITH a AS (SELECT repo_name, count(*) AS total_events, {shares('count(*)')}, {share(count_when("actor_category = 'bot'"), 'count(*)')} AS bot_ratio, {share(count_when('hour_of_day < 6'), 'count(*)')} AS night_ratio, {share(count_when('day_of_week IN (1, 7)'), 'count(*)')} AS weekend_ratio,
    {dbl(count_when("event_type = 'PullRequestEvent'"))} / greatest({count_when("event_type IN ('PullRequestEvent', 'PushEvent')")}, 1) AS pr_push_ratio, {dbl('count(DISTINCT metric_date)')} AS days, {dbl('count(DISTINCT actor_login)')} / count(*) AS actors_per_event, ln({dbl('1')} + count(*)) AS log_total_events, ln({dbl('1')} + coalesce({p95}, 0)) AS log_payload_p95 FROM ev GROUP BY repo_name),
t AS (SELECT repo_name, {entropy('s')} AS event_entropy FROM (SELECT repo_name, event_type, {dbl('count(*)')} / sum(count(*)) OVER (PARTITION BY repo_name) AS s FROM ev GROUP BY repo_name, event_type) x GROUP BY repo_name),
o AS (SELECT repo_name, max(s) AS top1_actor_share FROM (SELECT repo_name, actor_login, {dbl('count(*)')} / sum(count(*)) OVER (PARTITION BY repo_name) AS s FROM ev GROUP BY repo_name, actor_login) x GROUP BY repo_name),
m AS (SELECT max(metric_date) AS metric_date, count(DISTINCT metric_date) AS days FROM ev)
SELECT m.metric_date, a.*, a.days / m.days AS active_days_ratio, t.event_entropy, o.top1_actor_share, k.rank_score
FROM a CROSS JOIN m JOIN t ON a.repo_name = t.repo_name JOIN o ON a.repo_name = o.repo_name LEFT JOIN rank_all k ON a.repo_name = k.repo_name""", internal=True)
    c.add("dna", "dna_base", """
WITH q AS (SELECT percentile_disc(0.9) WITHIN GROUP (ORDER BY rank_score) AS hot, percentile_disc(0.1) WITHIN GROUP (ORDER BY rank_score) AS cold FROM dna_base WHERE total_events >= 3)
SELECT b.*, CASE WHEN total_events >= 3 AND rank_score >= CASE WHEN q.hot <= q.cold THEN q.cold + 1e-9 ELSE q.hot END THEN 'hot' WHEN total_events >= 3 AND rank_score <= q.cold THEN 'cold' ELSE 'mid' END AS cohort_group FROM dna_base b CROSS JOIN q""", internal=True)
    c.add("m04_repo_dna", "dna", f"SELECT metric_date, repo_name, cohort_group, {', '.join(f'{r(f)} AS {f}' for f in FEATURES)}, rank_score, total_events FROM dna")
    c.add("m05_hot_vs_cold_attribution", "dna", lambda d: f"""
WITH x AS ({unpivot(d, 'dna', 'metric_date, cohort_group, bot_ratio AS b', "WHERE cohort_group <> 'mid'")}),
s AS (SELECT 'all' AS cohort_scope, x.* FROM x UNION ALL SELECT 'humans_only', x.* FROM x WHERE b < 0.3 UNION ALL SELECT 'bots_only', x.* FROM x WHERE b >= 0.3),
a AS (SELECT metric_date, cohort_scope, feature_name, {', '.join(f"avg(CASE WHEN cohort_group = '{g}' THEN x END) AS mean_{g}, var_samp(CASE WHEN cohort_group = '{g}' THEN x END) AS v_{g}, {count_when(f"cohort_group = '{g}'")} AS n_{g}" for g in ('hot', 'cold'))} FROM s GROUP BY metric_date, cohort_scope, feature_name),
d AS (SELECT a.*, sqrt(((n_hot - 1) * v_hot + (n_cold - 1) * v_cold) / (n_hot + n_cold - 2)) AS pooled, sqrt(v_hot / n_hot + v_cold / n_cold) AS welch FROM a WHERE n_hot >= 2 AND n_cold >= 2)
SELECT metric_date, cohort_scope, feature_name, {r('mean_hot')} AS mean_hot, {r('mean_cold')} AS mean_cold, {r('mean_hot - mean_cold')} AS mean_diff, {r(f"CASE WHEN pooled > 1e-12 THEN (mean_hot - mean_cold) / pooled ELSE {dbl('0')} END")} AS cohen_d,
  {r(f"CASE WHEN welch > 1e-12 THEN (mean_hot - mean_cold) / welch ELSE {dbl('0')} END")} AS t_stat, n_hot, n_cold, CASE WHEN {r('mean_hot - mean_cold', 9)} > 0 THEN 'hot_higher' WHEN {r('mean_hot - mean_cold', 9)} < 0 THEN 'cold_higher' ELSE 'equal' END AS direction FROM d""")
    c.add("m06_repo_dna_outliers", "dna", lambda d: f"""
WITH x AS ({unpivot(d, 'dna', 'metric_date, repo_name', "WHERE cohort_group = 'hot'")}), m AS (SELECT feature_name, avg(x) AS mean, greatest(coalesce(stddev_samp(x), 0), 1e-9) AS std, count(*) AS n FROM x GROUP BY feature_name),
z AS (SELECT x.repo_name, x.feature_name, {r('(x.x - m.mean) / m.std')} AS z FROM x JOIN m ON x.feature_name = m.feature_name WHERE n >= 3),
k AS (SELECT z.*, row_number() OVER (PARTITION BY repo_name ORDER BY abs(z) DESC, feature_name) AS k FROM z),
s AS (SELECT repo_name, {r('sqrt(sum(z * z))')} AS z_distance, {', '.join(f"max(CASE WHEN k = {i} THEN concat(feature_name, CASE WHEN z >= 0 THEN '+' ELSE '-' END) END) AS f{i}" for i in (1, 2, 3))} FROM k GROUP BY repo_name)
SELECT dna.metric_date, s.repo_name, z_distance, concat(f1, ';', f2, ';', f3) AS off_features, {', '.join(f'{r(f)} AS {f}' for f in ('watch_share', 'pr_push_ratio', 'bot_ratio', 'active_days_ratio', 'log_total_events'))}
FROM s JOIN dna ON s.repo_name = dna.repo_name ORDER BY z_distance DESC, s.repo_name LIMIT 30""")
    def actors(ev: str) -> str:
        return f"""
WITH a AS (SELECT actor_login, max(CASE WHEN actor_category = 'bot' THEN 1 ELSE 0 END) AS is_bot, count(*) AS event_count, count(DISTINCT metric_date) AS active_days, count(DISTINCT repo_name) AS unique_repos, {share(count_when('hour_of_day < 6'), 'count(*)')} AS night_ratio, {share(count_when('day_of_week IN (1, 7)'), 'count(*)')} AS weekend_ratio, {shares('count(*)')} FROM {ev} GROUP BY actor_login HAVING count(*) >= 2),
h AS (SELECT actor_login, {entropy('s')} AS hour_entropy FROM (SELECT actor_login, hour_of_day, {dbl('count(*)')} / sum(count(*)) OVER (PARTITION BY actor_login) AS s FROM {ev} GROUP BY actor_login, hour_of_day) x GROUP BY actor_login),
p AS (SELECT actor_login, {entropy('s')} AS repo_entropy FROM (SELECT actor_login, repo_name, {dbl('count(*)')} / sum(count(*)) OVER (PARTITION BY actor_login) AS s FROM {ev} GROUP BY actor_login, repo_name) x GROUP BY actor_login)
SELECT a.*, hour_entropy, repo_entropy, {LATEST} AS metric_date FROM a JOIN h ON a.actor_login = h.actor_login JOIN p ON a.actor_login = p.actor_login"""

    c.add("actor_feat", "ev", actors("ev"), internal=True)
    # The halves before and from the median day of all events.
    for half, sign in (("early", "<"), ("late", ">=")):
        c.add(f"ev_{half}", "ev", lambda d, sign=sign: f"SELECT ev.* FROM ev CROSS JOIN (SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY {d.days('metric_date', FIRST)}) AS middle FROM ev) m WHERE {d.days('metric_date', FIRST)} {sign} middle", internal=True)
        c.add(f"actor_feat_{half}", f"ev ev_{half}", actors(f"ev_{half}"), internal=True)
    numbers = ["night_ratio", "weekend_ratio", "push_share", "pr_share", "issues_share", "watch_share", "fork_share", "hour_entropy", "repo_entropy"]
    c.add("m07_actor_features", "actor_feat", f"SELECT metric_date, actor_login, is_bot, event_count, active_days, unique_repos, {', '.join(f'{r(x)} AS {x}' for x in numbers)} FROM actor_feat")
    # A rule in place of a clustering, so that what follows from labels can be held against SQL.
    c.add("persona", "actor_feat", """SELECT actor_feat.*, CASE WHEN is_bot = 1 AND hour_entropy < 3.5 THEN 'night_bot' WHEN watch_share + fork_share >= 0.5 THEN 'watcher' WHEN pr_share >= 0.25 THEN 'reviewer' WHEN push_share >= 0.25 THEN 'maintainer' WHEN event_count < 20 THEN 'newbie' ELSE 'casual' END AS persona_label FROM actor_feat""", internal=True)
    c.add("m11_actor_persona_bot_validation", "persona", f"""
WITH t AS (SELECT {big('sum(is_bot)')} AS bots, count(*) AS n, max(metric_date) AS metric_date FROM persona), g AS (SELECT persona_label, {big('sum(is_bot)')} AS tp, {big('count(*) - sum(is_bot)')} AS fp FROM persona GROUP BY persona_label),
f AS (SELECT t.metric_date, persona_label, tp, fp, bots - tp AS fn, {share('tp', 'tp + fp')} AS p, {share('tp', 'bots')} AS q, bots, n - bots AS humans FROM g CROSS JOIN t)
SELECT metric_date, persona_label, tp AS true_bots, fp AS false_bots, fn AS missed_bots, {r('p')} AS precision, {r('q')} AS recall, {r(f"CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE {dbl('0')} END")} AS f1, bots AS total_bots, humans AS total_humans FROM f""")
    c.add("watchers", "ev dna persona", "SELECT DISTINCT ev.repo_name, ev.actor_login, coalesce(p.persona_label, 'unlabeled') AS persona_label FROM ev JOIN (SELECT repo_name FROM dna WHERE cohort_group = 'hot') h ON ev.repo_name = h.repo_name LEFT JOIN persona p ON ev.actor_login = p.actor_login", internal=True)
    c.add("lift", "watchers persona", f"""
WITH w AS (SELECT repo_name, actor_login, persona_label FROM watchers UNION ALL SELECT DISTINCT '__ALL_HOT__', actor_login, persona_label FROM watchers),
g AS (SELECT persona_label, {dbl('count(*)')} / sum(count(*)) OVER () AS s FROM persona GROUP BY persona_label),
k AS (SELECT repo_name, persona_label, count(*) AS watchers, {dbl('count(*)')} / sum(count(*)) OVER (PARTITION BY repo_name) AS own FROM w GROUP BY repo_name, persona_label)
SELECT k.*, coalesce(g.s, 0) AS world, own / greatest(g.s, 1e-9) AS lift FROM k LEFT JOIN g ON k.persona_label = g.persona_label""", internal=True)
    c.add("m13_repo_watcher_persona_lift", "lift ev", f"SELECT {LATEST} AS metric_date, repo_name, persona_label, watchers, {r('own')} AS share_in_watchers, {r('world')} AS share_in_global, {r('lift')} AS lift FROM lift")
    c.add("m14_repo_watcher_profile", "watchers persona lift rank_all ev", f"""
WITH a AS (SELECT w.repo_name, count(*) AS watchers, avg(night_ratio) AS night, avg(pr_share / greatest(push_share + pr_share, 1e-6)) AS pr, avg({dbl('unique_repos')}) AS repos, avg({dbl('is_bot')}) AS bot FROM watchers w LEFT JOIN persona p ON w.actor_login = p.actor_login GROUP BY w.repo_name),
d AS (SELECT * FROM (SELECT lift.*, row_number() OVER (PARTITION BY repo_name ORDER BY watchers DESC, persona_label) AS n FROM lift) x WHERE n = 1)
SELECT {LATEST} AS metric_date, a.repo_name, coalesce(k.rank_no, 999999) AS rank_no, coalesce(k.rank_score, 0) AS rank_score, a.watchers, {r('coalesce(night, 0)')} AS avg_night_ratio, {r('coalesce(pr, 0)')} AS avg_pr_push_ratio, {r('coalesce(repos, 0)')} AS avg_unique_repos, {r('coalesce(bot, 0)')} AS bot_ratio,
  d.persona_label AS dominant_persona, {r('d.own')} AS dominant_share, {r('d.lift')} AS dominant_lift FROM a JOIN d ON a.repo_name = d.repo_name LEFT JOIN rank_all k ON a.repo_name = k.repo_name""")
    c.add("m20_side", "score_day", f"""
WITH q AS (SELECT repo_name, {dbl('rank_score')} AS y, {dbl('row_number() OVER (PARTITION BY repo_name ORDER BY metric_date)')} AS x FROM score_day),
s AS (SELECT repo_name, {r('regr_slope(y, x)', 9)} AS slope FROM q GROUP BY repo_name HAVING count(*) >= 5),
o AS (SELECT s.*, row_number() OVER (ORDER BY slope DESC, repo_name) AS up, row_number() OVER (ORDER BY slope, repo_name) AS down, count(*) OVER () AS n FROM s)
SELECT repo_name, CASE WHEN slope > 0 THEN 'riser' ELSE 'faller' END AS side FROM o WHERE n >= 20 AND ((slope > 0 AND up <= 30) OR (slope < 0 AND down <= 30))""", internal=True)
    c.add("m20_dynamic_attribution", "m20_side dna", lambda d: f"""
WITH x AS ({unpivot(d, 'dna', 'repo_name')}),
a AS (SELECT feature_name, {', '.join(f"avg(CASE WHEN side = '{g}' THEN x END) AS m_{g}, var_samp(CASE WHEN side = '{g}' THEN x END) AS v_{g}, {count_when(f"side = '{g}'")} AS n_{g}" for g in ('riser', 'faller'))} FROM x JOIN m20_side g ON x.repo_name = g.repo_name GROUP BY feature_name),
d AS (SELECT a.*, sqrt(((n_riser - 1) * v_riser + (n_faller - 1) * v_faller) / (n_riser + n_faller - 2)) AS pooled, sqrt(v_riser / n_riser + v_faller / n_faller) AS welch FROM a WHERE n_riser >= 2 AND n_faller >= 2)
SELECT feature_name, n_riser, n_faller, {r('m_riser')} AS mean_riser, {r('m_faller')} AS mean_faller, {r(f"CASE WHEN pooled > 1e-12 THEN (m_riser - m_faller) / pooled ELSE {dbl('0')} END")} AS cohen_d, {r(f"CASE WHEN welch > 1e-12 THEN (m_riser - m_faller) / welch ELSE {dbl('0')} END")} AS t_stat FROM d""")
    signals = {"bot": "1 - dominant_share", "anomaly": "z_score", "outlier": "z_distance", "watcher_bot": "bot_ratio"}
    c.add("m21_authenticity", "m14_repo_watcher_profile b24_offline_anomaly_alerts m06_repo_dna_outliers", f"""
WITH b AS (SELECT repo_name FROM m14_repo_watcher_profile UNION SELECT repo_name FROM b24_offline_anomaly_alerts UNION SELECT repo_name FROM m06_repo_dna_outliers),
s AS (SELECT b.repo_name, coalesce(1 - w.dominant_share, 0) AS bot, coalesce(a.z_score, 0) AS anomaly, coalesce(o.z_distance, 0) AS outlier, coalesce(w.bot_ratio, 0) AS watcher_bot FROM b LEFT JOIN m14_repo_watcher_profile w ON b.repo_name = w.repo_name LEFT JOIN b24_offline_anomaly_alerts a ON b.repo_name = a.repo_name LEFT JOIN m06_repo_dna_outliers o ON b.repo_name = o.repo_name),
m AS (SELECT {', '.join(f'min({k}) AS lo_{k}, max({k}) AS hi_{k}' for k in signals)} FROM s),
n AS (SELECT s.repo_name, {', '.join(f"{r(minmax(f's.{k}', f'lo_{k}', f'hi_{k}'))} AS {k}" for k in signals)} FROM s CROSS JOIN m)
SELECT n.*, {r(f"({' + '.join(signals)}) / 4")} AS composite, CASE {' '.join(f"WHEN {k} = greatest({', '.join(signals)}) THEN '{k}'" for k in signals)} END AS driver FROM n""")
