"""SQL of the queries that pass a key's rows in order through one state: a recursive table with a row for each step."""

from __future__ import annotations

#: Each event with its place among its user's.
_EVENTS = "WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events)"
_NEXT = "k JOIN e ON e.user_id = k.user_id AND e.nth = k.nth + 1"
_COUNTED = "SELECT user_id, count_if(ok)::BIGINT AS allowed, count_if(NOT ok)::BIGINT AS denied FROM k GROUP BY user_id"

#: Length in seconds and limit of each window that denies; the month's only counts.
_LIMITS = ((60, 1), (3600, 1), (86400, 2))


def _quota() -> str:
    first = ", ".join(f"t + {w} AS end{w}, 1 AS n{w}" for w, _ in _LIMITS)
    rolled = ", ".join(f"CASE WHEN e.t >= end{w} THEN e.t + {w} ELSE end{w} END AS end{w}, CASE WHEN e.t >= end{w} THEN 0 ELSE n{w} END AS n{w}" for w, _ in _LIMITS)
    within = " AND ".join(f"n{w} < {limit}" for w, limit in _LIMITS)
    then = ", ".join(f"end{w}, n{w} + ({within})::INT" for w, _ in _LIMITS)
    return f"""{_EVENTS}, k AS (
        SELECT user_id, nth, {first}, true AS ok FROM e WHERE nth = 1
        UNION ALL
        SELECT user_id, nth, {then}, {within} FROM (SELECT e.user_id, e.nth, {rolled} FROM {_NEXT})
    ) {_COUNTED}"""


ORACLES = {
    "metric_quota_anchored": _quota(),
    "metric_token_bucket": f"""{_EVENTS}, k AS (
        SELECT user_id, nth, t + 60::DOUBLE / (1::DOUBLE / 360) AS due, true AS ok FROM e WHERE nth = 1
        UNION ALL
        SELECT user_id, nth, greatest(due, t) + CASE WHEN ok THEN 60::DOUBLE / (1::DOUBLE / 360) ELSE 0 END, ok
        FROM (SELECT e.*, due, due - e.t <= 60::DOUBLE / (1::DOUBLE / 360) + 1e-9 AS ok FROM {_NEXT})
    ) {_COUNTED}""",
    "metric_permits": f"""{_EVENTS}, k AS (
        SELECT user_id, nth, [t + event_id % 96 * 3600 + 1] AS held, true AS ok FROM e WHERE nth = 1
        UNION ALL
        SELECT user_id, nth, CASE WHEN len(held) < 2 THEN list_append(held, t + event_id % 96 * 3600 + 1) ELSE held END, len(held) < 2
        FROM (SELECT e.*, list_filter(held, lambda x: x > e.t) AS held FROM {_NEXT})
    ) {_COUNTED}""",
    "cache_lru": f"""{_EVENTS}, k AS (
        SELECT user_id, nth, [{{'name': event_type || ':' || event_id % 5, 'since': t}}] AS kept, false AS hit FROM e WHERE nth = 1
        UNION ALL
        SELECT user_id, nth, CASE WHEN hit THEN list_append(rest, own) WHEN len(rest) >= 4 THEN list_append(rest[2:], {{'name': name, 'since': t}}) ELSE list_append(rest, {{'name': name, 'since': t}}) END, hit
        FROM (SELECT *, own IS NOT NULL AND coalesce(t - own.since < 5 * 86400, false) AS hit FROM (
            SELECT e.*, event_type || ':' || e.event_id % 5 AS name, list_filter(kept, lambda x: x.name <> event_type || ':' || e.event_id % 5) AS rest, list_filter(kept, lambda x: x.name = event_type || ':' || e.event_id % 5)[1] AS own FROM {_NEXT}))
    ) SELECT user_id, count_if(hit)::BIGINT AS hits, count_if(NOT hit)::BIGINT AS misses FROM k GROUP BY user_id""",
}
