"""Ordered events: limits, sessions, gates and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import ranking
from ..session import table
from ..streaming import gates
from .registry import registry

query, QUERIES, ORACLE_SQL = registry()

_ORDER = ["ts", "event_id"]


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def event_once(spark, d):
    return ranking.once(table(spark, d, "events"), ["user_id", "event_type", "props"], _ORDER).select("event_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 8")
def event_budget(spark, d):
    return ranking.within_budget(table(spark, d, "events"), ["event_type", "user_id"], _ORDER, 8).select("event_id")


@query("SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type")
def return_change(spark, d):
    return ranking.on_change(table(spark, d, "events"), ["user_id"], _ORDER, "event_type").select("event_id")


_SESSION_SQL = """m AS (SELECT *, CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 0 END AS mark FROM events),
    p AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS now FROM m),
    s AS (SELECT *, sum(CASE WHEN mark = 1 AND coalesce(before, 0) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM p)"""


@query(f"WITH {_SESSION_SQL} SELECT event_id, CASE WHEN coalesce(now, 0) = 1 OR (mark = 0 AND before = 1) THEN CAST(n AS BIGINT) END AS session_id FROM s")
def session_intervals(spark, d):
    return gates.sessions(table(spark, d, "events"), ["user_id"], _ORDER, F.col("event_type") == "signup", F.col("event_type") == "error").select("event_id", "session_id")


_NAMES = {"signup": "READY", "error": "END", "view": "ACTIVITY", "click": "NAVIGATION", "purchase": "CONSUME"}


def _gate_events(spark, d):
    kind = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in _NAMES.items()])
    millis = (F.unix_micros(F.col("ts").cast("timestamp")) / 100_000_000).cast("long")  # a hundred seconds count as a millisecond
    return table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), millis.alias("ts_ms"), kind.alias("event"), F.lit(True).alias("enabled"), F.lit(True).alias("eligible"), F.lit(None).cast("int").alias("session"), F.lit(True).alias("live_enabled"))


_GATE_SQL = """g AS (SELECT user_id, event_id AS seq, epoch_us(ts) // 100000000 AS ts_ms, event_type AS e, CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 0 END AS mark FROM events),
    h AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING), 0) AS now FROM g),
    i AS (SELECT *, sum(CASE WHEN mark = 0 OR (mark = 1 AND before = 0) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS sid FROM h),
    j AS (SELECT *, coalesce(sum(CASE WHEN e = 'view' THEN 1 ELSE 0 END) OVER w, 0) > 0 AS active, min(CASE WHEN e = 'view' THEN ts_ms END) OVER w AS first_at, min(ts_ms) OVER (PARTITION BY user_id, sid) AS ready_at FROM i WINDOW w AS (PARTITION BY user_id, sid ORDER BY ts_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    k AS (SELECT *, coalesce(sum(CASE WHEN e IN ('view', 'click') AND active THEN 1 ELSE 0 END) OVER w, 0) > 0 AS gone FROM j WINDOW w AS (PARTITION BY user_id, sid ORDER BY ts_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT *, CASE WHEN e <> 'purchase' THEN NULL WHEN now = 0 THEN 'NO_SESSION' WHEN NOT active THEN 'NO_ACTIVITY' WHEN ts_ms - first_at < 2800 THEN 'WAIT' WHEN ts_ms - ready_at > 12000 THEN 'STALE' WHEN gone THEN 'NAVIGATION_OBSERVED' ELSE 'NO_ELIGIBLE_MEDIA' END AS raw FROM k),
    n AS (SELECT *, coalesce(sum(CASE WHEN raw IN ('STALE', 'NAVIGATION_OBSERVED', 'NO_ELIGIBLE_MEDIA') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, sid ORDER BY ts_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS spent FROM l)"""


@query(f"WITH {_GATE_SQL} SELECT user_id, seq, ts_ms, CAST(sid AS INT) AS session, CASE WHEN spent AND raw NOT IN ('NO_SESSION', 'NO_ACTIVITY') THEN 'ALREADY_ATTEMPTED' ELSE raw END AS decision FROM n WHERE raw IS NOT NULL")
def session_gate(spark, d):
    return gates.gate_batch(_gate_events(spark, d), "user_id").drop("timed")


@query(f"""WITH {_GATE_SQL[: _GATE_SQL.index('k AS (SELECT *, coalesce')].rstrip().rstrip(',')}, a AS (SELECT user_id, seq, ts_ms + 2800 AS ts_ms, sid FROM (SELECT *, row_number() OVER (PARTITION BY user_id, sid ORDER BY ts_ms, seq) AS n FROM j WHERE e = 'view' AND now = 1 AND NOT active)
        WHERE n = 1),
    b AS (SELECT user_id, seq, ts_ms, e, false AS timed, mark, NULL AS wanted FROM g UNION ALL SELECT user_id, seq, ts_ms, 'purchase', true, NULL, sid FROM a),
    h2 AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts_ms, timed, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts_ms, timed, seq ROWS UNBOUNDED PRECEDING), 0) AS now FROM b),
    i2 AS (SELECT *, sum(CASE WHEN mark = 0 OR (mark = 1 AND before = 0) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts_ms, timed, seq ROWS UNBOUNDED PRECEDING) AS sid FROM h2),
    j2 AS (SELECT *, coalesce(sum(CASE WHEN e = 'view' THEN 1 ELSE 0 END) OVER w, 0) > 0 AS active, min(CASE WHEN e = 'view' THEN ts_ms END) OVER w AS first_at, min(ts_ms) OVER (PARTITION BY user_id, sid) AS ready_at FROM i2 WINDOW w AS (PARTITION BY user_id, sid ORDER BY ts_ms, timed, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    k2 AS (SELECT *, coalesce(sum(CASE WHEN e IN ('view', 'click') AND active THEN 1 ELSE 0 END) OVER w, 0) > 0 AS gone FROM j2 WINDOW w AS (PARTITION BY user_id, sid ORDER BY ts_ms, timed, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l2 AS (SELECT *, CASE WHEN e <> 'purchase' THEN NULL WHEN now = 0 THEN 'NO_SESSION' WHEN wanted <> sid THEN 'SESSION_CHANGED' WHEN NOT active THEN 'NO_ACTIVITY' WHEN ts_ms - first_at < 2800 THEN 'WAIT' WHEN ts_ms - ready_at > 12000 THEN 'STALE' WHEN gone THEN 'NAVIGATION_OBSERVED' ELSE 'NO_ELIGIBLE_MEDIA' END AS raw FROM k2),
    n2 AS (SELECT *, coalesce(sum(CASE WHEN raw IN ('STALE', 'NAVIGATION_OBSERVED', 'NO_ELIGIBLE_MEDIA') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, sid ORDER BY ts_ms, timed, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS spent FROM l2)
    SELECT user_id, seq, ts_ms, CAST(sid AS INT) AS session, timed, CASE WHEN spent AND raw NOT IN ('NO_SESSION', 'SESSION_CHANGED', 'NO_ACTIVITY') THEN 'ALREADY_ATTEMPTED' ELSE raw END AS decision FROM n2 WHERE raw IS NOT NULL""")
def timed_gate(spark, d):
    """Sessions that also attempt by themselves once their first activity has settled."""
    return gates.gate_batch(gates.timed_attempts(_gate_events(spark, d), "user_id"), "user_id")


@query("""WITH t AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'click' THEN value ELSE NULL END AS token FROM events),
    p AS (SELECT *, last_value(token IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM t),
    f AS (SELECT *, CASE WHEN token IS NULL THEN NULL WHEN token = before THEN 'NO_CHANGE' WHEN CAST(event_id % 30 AS INT) * 1000 > 12000 THEN 'EXPIRED' ELSE 'FIT' END AS fit FROM p),
    n AS (SELECT *, sum(CASE WHEN fit = 'FIT' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM f)
    SELECT event_id, CASE WHEN fit = 'FIT' THEN CASE WHEN k = 1 THEN 'ACCEPTED' ELSE 'ALREADY_ATTEMPTED' END ELSE fit END AS decision FROM n""")
def request_ttl(spark, d):
    """A click's value alone makes its token, so that an equal one is a repeat whatever its age; the time at which it is read makes the age."""
    body = F.concat(F.lit(f"v1|{10**9}|"), F.lpad(F.hex(F.xxhash64("value")), 36, "0"))
    token = F.when((F.col("event_type") == "click") & F.col("value").isNotNull(), body)
    df = table(spark, d, "events").withColumns({"token": token, "now": F.lit(10**9) + (F.col("event_id") % 30) * 1000})
    return gates.request_decisions(df, ["user_id"], _ORDER, "now", "token", F.lit(True), F.lit(True)).select("event_id", "decision")


@query("SELECT e.event_id FROM events e JOIN (SELECT user_id, max(CAST(ts AS DATE)) AS day FROM events GROUP BY user_id) m ON m.user_id = e.user_id AND m.day = CAST(e.ts AS DATE)")
def latest_requests(spark, d):
    events = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return gates.latest_requests(events, events, ["user_id"], "day").select("event_id")


@query("""WITH t AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'click' THEN 'A' WHEN 'purchase' THEN 'C' END AS route, event_id % 20 AS age FROM events),
    f AS (SELECT *, CASE WHEN route IS NULL THEN NULL WHEN route = 'C' THEN 'INVALID' WHEN age > 12 OR age > event_id % 11 THEN 'EXPIRED' ELSE 'FIT' END AS fit FROM t),
    n AS (SELECT *, sum(CASE WHEN fit = 'FIT' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM f)
    SELECT event_id, CASE WHEN fit = 'FIT' THEN CASE WHEN k = 1 THEN 'ACCEPTED' ELSE 'ALREADY_ATTEMPTED' END ELSE fit END AS decision FROM n""")
def build_scoped_requests(spark, d):
    """Requests with a route; one made before its session began is as good as expired."""
    route = rules.first_match([(F.col("event_type") == "click", "|A"), (F.col("event_type") == "purchase", "|C")])
    millis = F.lit(10**9) - (F.col("event_id") % 20) * 1000
    token = F.concat(F.lit("v1|"), millis.cast("string"), F.lit("|"), F.lpad(F.hex("event_id"), 36, "0"), route)
    df = table(spark, d, "events").withColumns({"token": token, "now": F.lit(10**9), "begun": F.lit(10**9) - (F.col("event_id") % 11) * 1000})
    return gates.request_decisions(df, ["user_id"], _ORDER, "now", "token", F.lit(True), F.lit(True), ("A", "B"), "begun").select("event_id", "decision")
