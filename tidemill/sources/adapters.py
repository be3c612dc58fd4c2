"""Views that give the test tables the shape of activity events."""

from __future__ import annotations

from tidemill.plans.catalog import Catalog


def register(c: Catalog) -> None:
    c.add("ev", "events", lambda d: f"""
SELECT CAST(event_id AS BIGINT) AS event_id, ts AS event_ts, CAST(ts AS DATE) AS metric_date, CAST(hour(ts) AS BIGINT) AS hour_of_day, {d.weekday('ts')} AS day_of_week,
  CASE event_type WHEN 'view' THEN 'WatchEvent' WHEN 'signup' THEN 'ForkEvent' WHEN 'error' THEN 'IssuesEvent' WHEN 'purchase' THEN 'PullRequestEvent' WHEN 'click' THEN 'PushEvent' ELSE event_type END AS event_type,
  CASE WHEN user_id % 10 = 0 THEN concat('user', CAST(user_id AS {d.string}), '-bot') ELSE concat('user', CAST(user_id AS {d.string})) END AS actor_login,
  CASE WHEN user_id % 10 = 0 THEN 'bot' ELSE 'human' END AS actor_category,
  concat('org', CAST(k % 10 AS {d.string}), '/repo', CAST(k AS {d.string})) AS repo_name, concat('org', CAST(k % 10 AS {d.string})) AS org_or_owner,
  CASE k % 6 WHEN 0 THEN 'Scala' WHEN 1 THEN 'Python' WHEN 2 THEN 'JavaScript' WHEN 3 THEN 'Java' WHEN 4 THEN 'Go' ELSE 'unknown' END AS language_guess,
  CASE WHEN value < 10 THEN 'opened' WHEN value < 30 THEN 'closed' ELSE 'unknown' END AS payload_action, CAST(floor(value) AS BIGINT) AS payload_size
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) b""", internal=True)
    c.add("ev_net", "ev", "SELECT * FROM ev WHERE actor_login <> 'unknown' AND repo_name <> 'unknown/unknown'", internal=True)
    c.add("ev_graph", "lineitem orders", lambda d: f"""
SELECT l.l_orderkey AS event_id, CAST(o.o_orderdate AS DATE) AS metric_date, concat('cust', CAST(o.o_custkey AS {d.string})) AS actor_login, concat('part', CAST(l.l_partkey AS {d.string})) AS repo_name,
  CASE concat(l.l_returnflag, l.l_linestatus) WHEN 'AF' THEN 'WatchEvent' WHEN 'AO' THEN 'ForkEvent' WHEN 'RF' THEN 'IssuesEvent' WHEN 'RO' THEN 'PullRequestEvent' ELSE 'PushEvent' END AS event_type
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""", internal=True)


def activity(curated):
    """The rows of ``ev`` from curated events: days, hours and weekdays as numbers, and the organisation or else the owner.

    Events without an organisation belong to the part of the repository's name before the slash. Nulls of text
    columns become 'unknown' and null sizes 0, as in curation.
    """
    from pyspark.sql import functions as F

    text = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    owner = F.when(text("org_login").isin("", "unknown"), F.split_part(text("repo_name"), F.lit("/"), F.lit(1))).otherwise(F.col("org_login"))
    return curated.select(
        "event_id",
        F.col("event_timestamp").alias("event_ts"),
        F.col("event_date").alias("metric_date"),
        F.col("event_hour").cast("long").alias("hour_of_day"),
        F.dayofweek("event_date").cast("long").alias("day_of_week"),
        *[text(c).alias(c) for c in ("event_type", "actor_login", "actor_category", "repo_name")],
        owner.alias("org_or_owner"),
        *[text(c).alias(c) for c in ("language_guess", "payload_action")],
        F.coalesce("payload_size", F.lit(0)).cast("long").alias("payload_size"),
    )
