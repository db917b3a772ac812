"""Registered queries that replay ``events`` as a stream with rows out of order; the SQL is that of the rule on the sorted table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from evidentia.plans import fixtures as fx
from evidentia.plans import oracle as o
from evidentia.plans.queries import P, query
from evidentia.streaming import limits, ordered
from evidentia.streaming.replay import replayed

EV = "ev AS (SELECT user_id::varchar AS k, event_id, epoch_us(ts) / 1e6 AS t, event_type <> 'error' AS live, event_type = 'purchase' AS redeem, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"
CHAT = replace(P, chat_interval_seconds=3600, messages_per_session=60)
SESSIONS = replace(P, session_ttl_minutes=24 * 60)
LIMITED = replace(P, attempts_per_window=3, attempt_window_seconds=21600)


def _events(spark, sf_dir, key: str, id_: str, *more):
    at = F.col("ts").cast("timestamp")
    return fx.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias(key), F.col("event_id").alias(id_), at.alias("at"), at.cast("double").alias("ts"), *more)


@query(o.q("RECURSE AS (SELECT 1), " + EV + """,
cg AS (SELECT k, 0::bigint AS n, NULL::bigint AS event_id, 0 AS c, NULL::double AS last, NULL::varchar AS outcome FROM (SELECT DISTINCT k FROM ev)
  UNION ALL SELECT k, n, event_id, CASE WHEN outcome = 'OK' THEN c + 2 ELSE c END, CASE WHEN outcome = 'OK' THEN t ELSE last END, outcome FROM (SELECT ev.k, ev.n, ev.event_id, ev.t, cg.c, cg.last,
    CASE WHEN NOT ev.live THEN 'NOT_AVAILABLE' WHEN cg.c >= 60 THEN 'FULL' WHEN cg.last + 3600 > ev.t THEN 'TOO_FAST' ELSE 'OK' END AS outcome FROM cg JOIN ev ON ev.k = cg.k AND ev.n = cg.n + 1))""", "SELECT k AS session_id, event_id AS message_id, outcome FROM cg WHERE n > 0"))  # fmt: skip
def chat_gates_stream(spark, sf_dir):
    e = _events(spark, sf_dir, "session_id", "message_id", (F.col("event_type") != "error").alias("live"))
    return replayed(e, lambda s: ordered.in_event_order(s, "session_id", ("ts", "message_id"), "1 day", ordered.chat_rule(CHAT)))


@query(o.q("RECURSE AS (SELECT 1), " + EV + """,
oc AS (SELECT k, 0::bigint AS n, NULL::bigint AS event_id, 0::bigint AS held, true AS ok FROM (SELECT DISTINCT k FROM ev)
  UNION ALL SELECT oc.k, ev.n, ev.event_id, CASE WHEN redeem THEN greatest(0, held - 1) WHEN held < 2 THEN held + 1 ELSE held END, redeem OR held < 2 FROM oc JOIN ev ON ev.k = oc.k AND ev.n = oc.n + 1)""", "SELECT k AS owner, event_id, ok AS allowed FROM oc WHERE n > 0"))  # fmt: skip
def outstanding_codes_stream(spark, sf_dir):
    e = _events(spark, sf_dir, "owner", "event_id", F.when(F.col("event_type") == "purchase", "REDEEM").otherwise("ISSUE").alias("kind"))
    return replayed(e, lambda s: ordered.in_event_order(s, "owner", ("ts", "event_id"), "1 day", ordered.outstanding_rule(2)))


SESSION_SQL = o.q("RECURSE AS (SELECT 1), " + EV + """,
fs AS (SELECT k, n, t, t AS started FROM ev WHERE n = 1 UNION ALL SELECT ev.k, ev.n, ev.t, CASE WHEN started + 86400 <= ev.t THEN ev.t ELSE started END FROM fs JOIN ev ON ev.k = fs.k AND ev.n = fs.n + 1)""", "SELECT k AS owner, round(started, 3) AS started, round(started + 86400, 3) AS ended, count(*) AS uses FROM fs GROUP BY k, started")  # fmt: skip


def _rounded(sessions):
    return sessions.withColumns({c: F.round(c, 3) for c in ("started", "ended")})


@query(SESSION_SQL)
def fixed_sessions(spark, sf_dir):
    return _rounded(ordered.fixed_sessions(_events(spark, sf_dir, "owner", "event_id"), SESSIONS))


@query(SESSION_SQL)
def fixed_sessions_stream(spark, sf_dir):
    e = _events(spark, sf_dir, "owner", "event_id")
    return _rounded(replayed(e, lambda s: ordered.in_event_order(s, "owner", ("ts", "event_id"), "1 day", ordered.session_rule(SESSIONS))))


@query(o.q("RECURSE AS (SELECT 1), " + EV + """,
rl AS (SELECT k, 0::bigint AS n, NULL::bigint AS event_id, NULL::double AS t, 0 AS c, NULL::double AS s, 0::double AS l, NULL::boolean AS ok FROM (SELECT DISTINCT k FROM ev)
  UNION ALL SELECT k, n, event_id, t, CASE WHEN held THEN c WHEN full_ THEN c0 ELSE c0 + 1 END, CASE WHEN held THEN s ELSE s0 END, CASE WHEN held THEN l WHEN full_ THEN t + 900 ELSE 0 END, NOT held AND NOT full_ FROM
  (SELECT *, NOT held AND c0 >= 3 AS full_ FROM (SELECT ev.k, ev.n, ev.event_id, ev.t, rl.c, rl.s, rl.l, rl.s IS NOT NULL AND rl.l > ev.t AS held, CASE WHEN rl.s IS NULL OR rl.s <= ev.t - 21600 THEN 0 ELSE rl.c END AS c0, CASE WHEN rl.s IS NULL OR rl.s <= ev.t - 21600 THEN ev.t ELSE rl.s END AS s0 FROM rl JOIN ev ON ev.k = rl.k AND ev.n = rl.n + 1)))""", "SELECT k AS bucket_key, event_id AS attempt_id, round(t, 3) AS ts, ok AS allowed FROM rl WHERE n > 0"))  # fmt: skip
def rate_limiter_stream(spark, sf_dir):
    e = _events(spark, sf_dir, "bucket_key", "attempt_id")
    out = replayed(e, lambda s: ordered.in_event_order(s, "bucket_key", ("ts", "attempt_id"), "1 day", ordered.attempt_rule(LIMITED)))
    return out.withColumn("ts", F.round("ts", 3))
