"""Event-time windows in batch and as streams, and the as-of state kept online."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import asof as S
from ..streaming import sessions as N
from .registry import EVENTS, over, query, table

_HOURLY = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM events GROUP BY ALL"


def _hourly(ev):
    g = ev.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "cents")


def _stream(spark, d):
    return S.read_events(spark, f"{d}/events.parquet")


@query("tumbling_counts", _HOURLY)
def tumbling_counts(spark, d):
    return _hourly(table(spark, d, "events"))


@query("tumbling_stream", _HOURLY)
def tumbling_stream(spark, d):
    """The same as a stream in complete mode: every window, the last ones included."""
    return S.drained(_hourly(_stream(spark, d)), "tumbling", "complete")


@query("sliding_counts", "SELECT strftime(date_trunc('hour', ts) - to_hours(b), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS b) GROUP BY ALL")
def sliding_counts(spark, d):
    g = table(spark, d, "events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("session_windows", """WITH a AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 21600000000, true) THEN 1 ELSE 0 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  c AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM a) SELECT user_id, min(us) AS first_us, count(*) AS n FROM c GROUP BY user_id, run""")
def session_windows(spark, d):
    ev = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = ev.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.unix_micros("w.start").alias("first_us"), "n")


@query("stateful_asof_stream", over(EVENTS, "SELECT user_id, event_id, n, s FROM ev"))
def stateful_asof_stream(spark, d):
    """Every event with its user's count and sum before it, from state that a stream keeps; the second half arrives after a restart."""
    ev = table(spark, d, "events")
    half = ev.agg(F.expr("(min(event_id) + max(event_id)) div 2")).first()[0] or 0

    def make(path):
        rows = S.read_events(spark, path).withColumn("y", (F.col("event_type") == "purchase").cast("long"))
        return S.online_state(rows, "user_id", "event_id", "y")

    return S.resumed(make, [ev.filter(F.col("event_id") <= half), ev.filter(F.col("event_id") > half)], "asof")


_GAP = 6 * 3600 * 10**6
_DELAY = 3600 * 10**6  # of the watermark


@query("session_state_stream", over(EVENTS, """, a AS (SELECT *, epoch_us(ts) AS us FROM ev), b AS (SELECT *, CASE WHEN coalesce(us - lag(us) OVER w > 21600000000, true) THEN 1 ELSE 0 END AS st FROM a WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  c AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM b), g AS (SELECT user_id, session, min(event_id) AS first_event, count(*) AS n, sum(y)::BIGINT AS y, max(us) - min(us) AS micros FROM c GROUP BY ALL)
  SELECT *, coalesce(sum(n) OVER p, 0)::BIGINT AS n_before, coalesce(sum(y) OVER p, 0)::BIGINT AS y_before, CASE WHEN count(*) OVER l = 5 THEN sum(n) OVER l END::BIGINT AS n_last, CASE WHEN count(*) OVER l = 5 THEN sum(y) OVER l END::BIGINT AS y_last FROM g
  WINDOW p AS (PARTITION BY user_id ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), l AS (PARTITION BY user_id ORDER BY session ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"""))
def session_state_stream(spark, d):
    """Every session with what its user did before it and in the five sessions before, from composite state over three restarts.

    The log arrives in four turns that may split sessions; a last turn of one row without a user moves the watermark past all sessions.
    """
    ev = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    least, most = ev.agg(F.min("event_id"), F.max("event_id")).first()
    at = [least + (most - least) * k // 4 for k in (1, 2, 3)] if most is not None else [0, 0, 0]
    turn = F.when(F.col("event_id") <= at[0], 0).when(F.col("event_id") <= at[1], 1).when(F.col("event_id") <= at[2], 2).otherwise(3)
    end = F.timestamp_micros(F.unix_micros(F.max("ts").cast("timestamp")) + 2 * (_GAP + _DELAY)).cast("timestamp_ntz")
    last = ev.agg(F.lit(-1).cast("long").alias("event_id"), end.cast(dict(ev.dtypes)["ts"]).alias("ts"), F.lit(-1).cast(dict(ev.dtypes)["user_id"]).alias("user_id"), F.lit("end").alias("event_type"))

    def make(path):
        rows = S.read_events(spark, path).withColumn("y", (F.col("event_type") == "purchase").cast("long"))
        return N.closed_sessions(rows, "user_id", "event_id", "y", "ts", _GAP, 365 * 24 * 3600 * 10**6)

    with N.rocksdb(spark):
        out = S.resumed(make, [*(ev.filter(turn == k) for k in range(4)), last], "sessions")
    return out.filter("key >= 0").withColumnRenamed("key", "user_id")


@query("dedup_stream", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def dedup_stream(spark, d):
    """Each event arrives twice and stays once."""
    twice = _stream(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return S.drained(S.once(twice, ["event_id"]).select("event_id", "event_type"), "dedup").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("batch_rates_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def batch_rates_stream(spark, d):
    """A batch aggregation of each micro-batch, added up afterwards."""
    parts = S.each_batch(_stream(spark, d), lambda rows: rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("c")), "rates")
    return parts.groupBy("event_type").agg(F.sum("c").alias("n"))
