"""Graph tables that are joins and aggregates (G01-G03, G06, G09 edges, G10, G13, G15); ev_graph holds the sparse graph.

Network tables read ev_net, which has no unknown actors and repositories.
"""

from __future__ import annotations

from tidemill.functions.exprs import big, dbl, r, row_no
from tidemill.plans.catalog import Catalog

#: Event types of each layer (fixed values).
LAYERS = {"watch": ["WatchEvent"], "fork": ["ForkEvent"], "pr": ["PullRequestEvent", "PullRequestReviewEvent", "PullRequestReviewCommentEvent"], "push": ["PushEvent"], "issue": ["IssuesEvent", "IssueCommentEvent"]}


def pairs(source: str, keys: str = "", least: int = 2) -> str:
    """Unordered pairs of repositories with shared actors and Jaccard similarity; hub actors cost their degree squared."""
    k = f"{keys}, " if keys else ""
    on = f" AND x.{keys} = y.{keys}" if keys else ""
    return f"""SELECT {f'p.{keys}, ' if keys else ''}a, b, shared, {dbl('shared')} / (n.n + m.n - shared) AS jaccard FROM
  (SELECT {f'x.{keys}, ' if keys else ''}x.repo_name AS a, y.repo_name AS b, count(*) AS shared FROM {source} x JOIN {source} y ON x.actor_login = y.actor_login AND x.repo_name < y.repo_name{on} GROUP BY {f'x.{keys}, ' if keys else ''}x.repo_name, y.repo_name HAVING count(*) >= {least}) p
  JOIN (SELECT {k}repo_name, count(*) AS n FROM {source} GROUP BY {k}repo_name) n ON n.repo_name = p.a{f' AND n.{keys} = p.{keys}' if keys else ''}
  JOIN (SELECT {k}repo_name, count(*) AS n FROM {source} GROUP BY {k}repo_name) m ON m.repo_name = p.b{f' AND m.{keys} = p.{keys}' if keys else ''}"""


def both(source: str, keep: str) -> str:
    return f"SELECT a AS src, b AS dst, {keep} FROM {source} UNION ALL SELECT b AS src, a AS dst, {keep} FROM {source}"


#: Actors of a ring, at least.
RING = 3


def register(c: Catalog, scope: int = 200) -> None:
    c.add("g01_scope_ranked", "ev rank_all", f"SELECT a.repo_name, actors, k.rank_score FROM (SELECT repo_name, count(DISTINCT actor_login) AS actors FROM ev GROUP BY repo_name) a LEFT JOIN rank_all k ON a.repo_name = k.repo_name WHERE actors >= 3 ORDER BY k.rank_score DESC NULLS LAST, actors DESC, a.repo_name LIMIT {scope}")
    c.add("g02_scope_network", "ev_graph", f"SELECT repo_name, actors, events, {r(f'actors * sqrt({dbl("events")})')} AS score FROM (SELECT repo_name, count(DISTINCT actor_login) AS actors, count(*) AS events FROM ev_graph GROUP BY repo_name) a WHERE actors >= 3 ORDER BY score DESC, repo_name LIMIT {scope}")
    c.add("actor_repo", "ev_graph g02_scope_network", "SELECT DISTINCT e.actor_login, e.repo_name FROM ev_graph e JOIN g02_scope_network s ON e.repo_name = s.repo_name", internal=True)
    c.add("repo_jaccard_edge", "repo_pair", f"SELECT a AS src_repo, b AS dst_repo, {r('jaccard')} AS jaccard FROM repo_pair WHERE jaccard >= 0.05", internal=True)
    c.add("actor_corepo_edge", "ev_net", """
WITH k AS (SELECT actor_login FROM ev_net GROUP BY actor_login ORDER BY count(*) DESC, actor_login LIMIT 3000), d AS (SELECT DISTINCT ev_net.actor_login, repo_name FROM ev_net JOIN k ON ev_net.actor_login = k.actor_login),
n AS (SELECT d.* FROM d JOIN (SELECT repo_name FROM d GROUP BY repo_name HAVING count(*) BETWEEN 2 AND 300) r ON d.repo_name = r.repo_name)
SELECT x.actor_login AS actor_a, y.actor_login AS actor_b, count(*) AS shared_repos FROM n x JOIN n y ON x.repo_name = y.repo_name AND x.actor_login < y.actor_login GROUP BY x.actor_login, y.actor_login""", internal=True)
    c.add("week_repo", "ev_net", lambda d: f"""
WITH w AS (SELECT DISTINCT CAST(floor({d.days('(SELECT max(metric_date) FROM ev_net)', 'metric_date')} / 7) AS BIGINT) AS back, actor_login, repo_name FROM ev_net), l AS (SELECT * FROM w WHERE back < 4),
k AS (SELECT 3 - back AS week_idx, repo_name FROM l GROUP BY back, repo_name HAVING count(*) >= 2)
SELECT k.week_idx, l.actor_login, l.repo_name FROM l JOIN k ON 3 - l.back = k.week_idx AND l.repo_name = k.repo_name""", internal=True)
    c.add("week_pair", "week_repo", pairs("week_repo", "week_idx"), internal=True)
    c.add("repo_pair", "actor_repo", pairs("actor_repo"), internal=True)
    c.add("g03_repo_similarity_edges", "repo_pair", f"""
SELECT src AS src_repo, dst AS dst_repo, shared AS shared_actors, {r('jaccard')} AS jaccard FROM (SELECT x.*, row_number() OVER (PARTITION BY src ORDER BY jaccard DESC, shared DESC, dst) AS k FROM ({both('repo_pair', 'shared, jaccard')}) x WHERE jaccard >= 0.05) t WHERE k <= 10""")
    c.add("g06_actor_collab_edge", "ev", f"""
WITH k AS (SELECT actor_login FROM ev GROUP BY actor_login ORDER BY count(*) DESC, actor_login LIMIT 5000), d AS (SELECT DISTINCT ev.actor_login, repo_name, metric_date FROM ev JOIN k ON ev.actor_login = k.actor_login)
SELECT x.actor_login AS actor_a, y.actor_login AS actor_b, count(DISTINCT x.repo_name) AS shared_repos, count(DISTINCT x.metric_date) AS co_days, {dbl('count(*)')} AS weight FROM d x JOIN d y ON x.repo_name = y.repo_name AND x.metric_date = y.metric_date AND x.actor_login < y.actor_login GROUP BY x.actor_login, y.actor_login""")
    layer = "CASE " + " ".join(f"WHEN event_type IN ({', '.join(map(repr, t))}) THEN '{n}'" for n, t in LAYERS.items()) + " END"
    c.add("layer_repo", "ev_graph g02_scope_network", f"""
SELECT layer, actor_login, repo_name FROM (SELECT d.*, count(*) OVER (PARTITION BY layer, repo_name) AS n FROM (SELECT DISTINCT {layer} AS layer, actor_login, e.repo_name FROM ev_graph e JOIN g02_scope_network s ON e.repo_name = s.repo_name) d WHERE layer IS NOT NULL) x WHERE n >= 2""", internal=True)
    c.add("layer_pair", "layer_repo", pairs("layer_repo", "layer", 1), internal=True)
    c.add("g09_repo_layer_edge", "layer_pair", f"SELECT layer, a AS src_repo, b AS dst_repo, {r('jaccard')} AS jaccard, shared AS shared_actors FROM layer_pair WHERE jaccard >= 0.05")
    first = lambda key, x: f"SELECT repo_name, {x} FROM (SELECT repo_name, {x}, row_number() OVER (PARTITION BY repo_name ORDER BY count(*) DESC, {x}) AS k FROM {key} GROUP BY repo_name, {x}) q WHERE k = 1"
    c.add("g10_repo_metapath_sim", "ev_net", f"""
WITH d AS (SELECT DISTINCT actor_login, repo_name FROM ev_net), r0 AS ({pairs('d', least=1)}), j AS (SELECT 'RAR' AS path_type, x.* FROM ({both('r0', 'jaccard AS sim, shared')}) x WHERE sim >= 0.05),
l AS (SELECT m.*, row_number() OVER (PARTITION BY language_guess ORDER BY repo_name) AS n FROM ({first('ev_net', 'language_guess')}) m WHERE language_guess <> 'unknown'),
lk AS (SELECT l.*, count(*) OVER (PARTITION BY language_guess) AS g FROM l WHERE n <= 50), o AS (SELECT m.*, count(*) OVER (PARTITION BY org_or_owner) AS g FROM ({first('ev_net', 'org_or_owner')}) m WHERE org_or_owner <> 'unknown'),
u AS (SELECT path_type, src, dst, sim, shared FROM j UNION ALL SELECT 'RLR', x.repo_name, y.repo_name, {dbl('1')}, x.g FROM lk x JOIN lk y ON x.language_guess = y.language_guess AND x.repo_name <> y.repo_name
  UNION ALL SELECT 'ROR', x.repo_name, y.repo_name, {dbl('1')}, x.g FROM o x JOIN o y ON x.org_or_owner = y.org_or_owner AND x.repo_name <> y.repo_name),
k AS (SELECT u.*, {row_no('path_type, src', 'sim DESC, shared DESC, dst')} AS rank_no FROM u)
SELECT path_type, src AS src_repo, dst AS dst_repo, {r('sim')} AS sim, shared AS shared_actors, rank_no FROM k WHERE rank_no <= 5""")
    c.add("g13_actor_ring", "ev", lambda d: f"""
WITH w AS (SELECT DISTINCT metric_date, hour_of_day, repo_name, actor_login FROM ev WHERE event_type = 'WatchEvent'),
h AS (SELECT w.* FROM w JOIN (SELECT metric_date, hour_of_day, repo_name FROM w GROUP BY metric_date, hour_of_day, repo_name HAVING count(*) >= {RING}) g ON w.metric_date = g.metric_date AND w.hour_of_day = g.hour_of_day AND w.repo_name = g.repo_name),
p AS (SELECT x.metric_date AS d1, x.hour_of_day AS h1, x.repo_name AS r1, y.metric_date AS d2, y.hour_of_day AS h2, y.repo_name AS r2, {d.join_sorted('x.actor_login', ',')} AS members, count(*) AS n
  FROM h x JOIN h y ON x.actor_login = y.actor_login AND x.repo_name < y.repo_name GROUP BY x.metric_date, x.hour_of_day, x.repo_name, y.metric_date, y.hour_of_day, y.repo_name HAVING count(*) >= {RING}),
u AS (SELECT members, n, r1 AS repo_name FROM p UNION SELECT members, n, r2 FROM p), k AS (SELECT members, count(*) AS bursts FROM p GROUP BY members)
SELECT u.members, max(u.n) AS actor_count, count(DISTINCT repo_name) AS repos_shared, max(bursts) AS co_bursts FROM u JOIN k ON u.members = k.members GROUP BY u.members HAVING count(DISTINCT repo_name) >= 2 ORDER BY actor_count DESC, repos_shared DESC, co_bursts DESC, u.members LIMIT 50""")
