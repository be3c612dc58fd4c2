"""SQL fragments shared by the metric tables."""

from __future__ import annotations

#: Weights of an event type in a repository's hotness (fixed values).
HOTNESS = {"WatchEvent": 1.0, "ForkEvent": 3.0, "IssuesEvent": 2.0, "PullRequestEvent": 2.5, "PushEvent": 1.5}
#: Column of each event type's count (fixed values).
COUNTS = {"WatchEvent": "watch_events", "ForkEvent": "fork_events", "IssuesEvent": "issues_events", "PullRequestEvent": "pull_request_events", "PushEvent": "push_events"}
#: Decay of hotness per day (fixed value).
DECAY = 0.2


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits})"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def count_when(condition: str) -> str:
    return big(f"sum(CASE WHEN {condition} THEN 1 ELSE 0 END)")


def type_counts() -> str:
    return ", ".join(f"{count_when(f'event_type = {t!r}')} AS {c}" for t, c in COUNTS.items())


def hotness() -> str:
    return "(" + " + ".join(f"{COUNTS[t]} * CAST({w} AS DOUBLE)" for t, w in HOTNESS.items()) + ")"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def minmax(x: str, low: str, high: str) -> str:
    """(x - min) / (max - min), 0 when constant."""
    return f"CASE WHEN {high} = {low} THEN {dbl('0')} ELSE ({dbl(x)} - {low}) / ({dbl(high)} - {low}) END"


def share(part: str, whole: str) -> str:
    return f"({dbl(part)} / greatest({dbl(whole)}, {dbl('1')}))"


def row_no(partition: str, order: str) -> str:
    return big(f"row_number() OVER ({f'PARTITION BY {partition} ' if partition else ''}ORDER BY {order})")
