"""Ordered analytics over users' events and suppliers' seasons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import cut_left, cut_right, rate
from ..operators import aggregate as A
from ..operators import asof
from .registry import EVENTS, ITEMS, events, items, over, query

_SEASONS = ", g AS (SELECT supplier, season, sum(y)::BIGINT AS total, count(*) AS n FROM items GROUP BY ALL)"


@query("prefix_exclusive", over(ITEMS, _SEASONS + """ SELECT supplier, season, total, n,
  coalesce(sum(total) OVER w, 0)::BIGINT AS total_before, coalesce(sum(n) OVER w, 0)::BIGINT AS n_before FROM g
  WINDOW w AS (PARTITION BY supplier ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""))
def prefix_exclusive(spark, d):
    return asof.prefix(A.grouped(items(spark, d), ["supplier", "season"]), ["supplier"], ["season"], ["total", "n"])


@query("prefix_inclusive", over(ITEMS, _SEASONS + """ SELECT supplier, season, total, n,
  sum(total) OVER w::BIGINT AS total_through, sum(n) OVER w::BIGINT AS n_through FROM g WINDOW w AS (PARTITION BY supplier ORDER BY season ROWS UNBOUNDED PRECEDING)"""))
def prefix_inclusive(spark, d):
    return asof.prefix(A.grouped(items(spark, d), ["supplier", "season"]), ["supplier"], ["season"], ["total", "n"], exclusive=False, tag="through")


@query("sessionize", over(EVENTS, """
  , a AS (SELECT *, epoch_us(ts) AS us FROM ev),
  b AS (SELECT *, CASE WHEN coalesce(us - lag(us) OVER w > 21600000000, true) THEN 1 ELSE 0 END AS st FROM a WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  c AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM b)
  SELECT user_id, session, count(*) AS n, min(event_id) AS first_event, max(us) - min(us) AS micros FROM c GROUP BY ALL"""))
def sessionize(spark, d):
    """Sessions end with a gap of six hours."""
    ev = events(spark, d).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    s = asof.gap_sessions(ev, ["user_id"], F.col("us"), ["event_id"], 6 * 3600 * 10**6)
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), (F.max("us") - F.min("us")).alias("micros"))


_RUNS = """
  , b AS (SELECT *, CASE WHEN lag(event_id) OVER w IS NULL OR lag(event_type) OVER w IS DISTINCT FROM event_type OR lag(season) OVER w IS DISTINCT FROM season THEN 1 ELSE 0 END AS st FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  c AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM b)"""


def _runs(spark, d):
    return asof.sessionize(events(spark, d), ["user_id"], ["event_id"], [F.col("event_type"), F.col("season")], "run")


@query("change_runs", over(EVENTS, _RUNS + " SELECT user_id, run, min(event_type) AS event_type, count(*) AS n FROM c GROUP BY ALL"))
def change_runs(spark, d):
    return _runs(spark, d).groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"))


@query("segment_index", over(EVENTS, _RUNS + " SELECT event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) - 1 AS place, count(*) OVER (PARTITION BY user_id, run) AS size FROM c"))
def segment_index(spark, d):
    w = Window.partitionBy("user_id", "run")
    return _runs(spark, d).select("event_id", (F.row_number().over(w.orderBy("event_id")) - 1).cast("long").alias("place"), F.count(F.lit(1)).over(w).alias("size"))


@query("visit_number", over(EVENTS, _RUNS + """, v AS (SELECT user_id, run, min(event_type) AS event_type, min(event_id) AS e FROM c GROUP BY ALL),
  k AS (SELECT user_id, run, row_number() OVER (PARTITION BY user_id, event_type ORDER BY e) AS visit FROM v)
  SELECT event_id, visit FROM c JOIN k USING (user_id, run)"""))
def visit_number(spark, d):
    """How many runs of this type the user has had: counted on runs, then joined back to the events."""
    r = _runs(spark, d)
    v = r.groupBy("user_id", "run").agg(F.min("event_type").alias("type"), F.min("event_id").alias("e"))
    v = v.select("user_id", "run", F.row_number().over(Window.partitionBy("user_id", "type").orderBy("e")).cast("long").alias("visit"))
    return r.join(v, ["user_id", "run"]).select("event_id", "visit")


@query("trailing_k_sessions", over(ITEMS, _SEASONS + " SELECT supplier, season, " + ", ".join(
    f"CASE WHEN count(total) OVER w{k} = {k} THEN sum(total) OVER w{k} END::BIGINT AS total_last{k}, CASE WHEN count(n) OVER w{k} = {k} THEN sum(n) OVER w{k} END::BIGINT AS n_last{k}" for k in (1, 3, 5))
    + " FROM g WINDOW " + ", ".join(f"w{k} AS (PARTITION BY supplier ORDER BY season ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in (1, 3, 5))))
def trailing_k_sessions(spark, d):
    out = A.grouped(items(spark, d), ["supplier", "season"])
    for k in (1, 3, 5):
        out = asof.trailing(out, ["supplier"], ["season"], ["total", "n"], k)
    return out.drop("total", "n")


@query("window_certification", over(ITEMS, _SEASONS + """, x AS (SELECT supplier, season, lag(season, 3) OVER w AS s3, min(n) OVER f AS least, count(*) OVER f AS members FROM g
  WINDOW w AS (PARTITION BY supplier ORDER BY season), f AS (PARTITION BY supplier ORDER BY season ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
  SELECT supplier, season, members = 4 AND season - s3 = 3 AND least >= 5 AS certified FROM x"""))
def window_certification(spark, d):
    """Whether four seasons in a row are there without a hole, each with five rows at least."""
    w = Window.partitionBy("supplier").orderBy("season")
    f = w.rowsBetween(-3, 0)
    whole = (F.count(F.lit(1)).over(f) == 4) & (F.col("season") - F.lag("season", 3).over(w) == 3) & (F.min("n").over(f) >= 5)
    return A.grouped(items(spark, d), ["supplier", "season"]).select("supplier", "season", whole.alias("certified"))


@query("last_k_state", over(EVENTS, """
  , t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM ev) WHERE r <= 20)
  SELECT user_id, count(*) AS n, sum(y)::BIGINT AS total, (sum(y) + 30.0::DOUBLE * 0.2::DOUBLE) / (count(*) + 30.0::DOUBLE) AS state FROM t GROUP BY user_id"""))
def last_k_state(spark, d):
    from ..functions.expr import eb

    last = events(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))).filter("r <= 20")
    return A.grouped(last, ["user_id"]).select("user_id", "n", "total", eb("total", "n", 0.2, 30).alias("state"))


@query("decay_state", over(EVENTS, """
  , l AS (SELECT user_id, max(event_id) AS last_id, arg_max(s + y, event_id) AS state FROM ev WHERE season < 4 GROUP BY user_id)
  SELECT event_id, round(coalesce(state * exp(-(event_id - last_id) / 500.0::DOUBLE), 0), 6) AS decayed FROM ev LEFT JOIN l USING (user_id) WHERE season >= 4"""))
def decay_state(spark, d):
    ev = events(spark, d).withColumn("through", F.col("s") + F.col("y"))
    past = asof.last_state(ev.filter("season < 4"), ["user_id"], "event_id", ["through"]).withColumnsRenamed({"event_id": "last_id"})
    faded = F.col("through") * F.exp(-(F.col("event_id") - F.col("last_id")) / 500.0)
    return ev.filter("season >= 4").drop("through").join(past, "user_id", "left").select("event_id", F.round(F.coalesce(faded, F.lit(0.0)), 6).alias("decayed"))


@query("avg_rank", over(ITEMS, ", g AS (SELECT season, supplier, count(*) AS n FROM items GROUP BY ALL) SELECT season, supplier, n, rank() OVER (PARTITION BY season ORDER BY n) + (count(*) OVER (PARTITION BY season, n) - 1) / 2 AS rank FROM g"))
def avg_rank(spark, d):
    g = items(spark, d).groupBy("season", "supplier").agg(F.count(F.lit(1)).alias("n"))
    return asof.average_rank(g, ["season"], "n")


@query("qcut_curve", over(EVENTS, """
  , e AS (SELECT quantile_cont(value, 0.2) AS a, quantile_cont(value, 0.4) AS b, quantile_cont(value, 0.6) AS c, quantile_cont(value, 0.8) AS f FROM ev)
  SELECT CAST(value > a AS INT) + CAST(value > b AS INT) + CAST(value > c AS INT) + CAST(value > f AS INT) AS bin, count(*) AS n, avg(y) AS rate FROM ev, e GROUP BY 1"""))
def qcut_curve(spark, d):
    """Purchase rate by quintile of value; bins are right-closed and edges that coincide merge."""
    ev = events(spark, d)
    edges = ev.agg(*[F.percentile("value", F.lit(q)).alias(f"e{i}") for i, q in enumerate((0.2, 0.4, 0.6, 0.8))])
    bin_of = sum(((F.col("value") > F.col(f"e{i}")).cast("int") for i in range(4)), F.lit(0)).alias("bin")
    return ev.crossJoin(F.broadcast(edges)).groupBy(bin_of).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"))  # edges is one row


@query("cut_bins", over(EVENTS, """SELECT CAST(value > 10 AS INT) + CAST(value > 20 AS INT) + CAST(value > 40 AS INT) AS closed_right,
  CAST(value >= 10 AS INT) + CAST(value >= 20 AS INT) + CAST(value >= 40 AS INT) AS closed_left, count(*) AS n, sum(y)::BIGINT AS total FROM ev GROUP BY 1, 2"""))
def cut_bins(spark, d):
    edges = [10, 20, 40]
    return events(spark, d).groupBy(cut_right("value", edges).alias("closed_right"), cut_left("value", edges).alias("closed_left")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"))


_GRID = """
  , b AS (SELECT user_id, season, arg_max(n + 1, event_id) AS cum_n, arg_max(s + y, event_id) AS cum_s FROM ev GROUP BY ALL),
  grid AS (SELECT user_id, season FROM (SELECT DISTINCT user_id FROM ev), (SELECT CAST(unnest(range(0, 7)) AS INT) AS season)),
  snap AS (SELECT user_id, season, last_value(cum_n IGNORE NULLS) OVER w AS cum_n, last_value(cum_s IGNORE NULLS) OVER w AS cum_s
    FROM grid LEFT JOIN b USING (user_id, season) WINDOW w AS (PARTITION BY user_id ORDER BY season ROWS UNBOUNDED PRECEDING))"""


def snapshots(spark, d):
    ev = events(spark, d).select("user_id", "season", "event_id", (F.col("n") + 1).alias("cum_n"), (F.col("s") + F.col("y")).alias("cum_s"))
    ends = asof.last_state(ev, ["user_id", "season"], "event_id", ["cum_n", "cum_s"]).drop("event_id")
    return asof.snapshot_grid(ends, ["user_id"], "season", ["cum_n", "cum_s"], 0, 6)


@query("snapshot_ffill_grid", over(EVENTS, _GRID + " SELECT user_id, season, cum_n, cum_s FROM snap"))
def snapshot_ffill_grid(spark, d):
    return snapshots(spark, d)


@query("asof_grid_profile", over(EVENTS, _GRID + """ SELECT user_id, season, coalesce(lag(cum_n) OVER w, 0) AS n_before, CASE WHEN lag(cum_n) OVER w >= 20 THEN lag(cum_s) OVER w / lag(cum_n) OVER w END AS rate_before,
  coalesce(lag(cum_n) OVER w, 0) - coalesce(lag(cum_n, 2) OVER w, 0) AS last_season_n FROM snap WINDOW w AS (PARTITION BY user_id ORDER BY season)"""))
def asof_grid_profile(spark, d):
    """State strictly before every season, also of users without an event in it; rates need 20 events."""
    w = Window.partitionBy("user_id").orderBy("season")
    n, s = F.lag("cum_n").over(w), F.lag("cum_s").over(w)
    last = F.coalesce(n, F.lit(0)) - F.coalesce(F.lag("cum_n", 2).over(w), F.lit(0))
    return snapshots(spark, d).select("user_id", "season", F.coalesce(n, F.lit(0)).alias("n_before"), F.when(n >= 20, rate(s, n)).alias("rate_before"), last.alias("last_season_n"))


@query("first_seen_flag", over(EVENTS, "SELECT event_id, min(season) OVER (PARTITION BY user_id) AS first_season, season = min(season) OVER (PARTITION BY user_id) AS rookie FROM ev"))
def first_seen_flag(spark, d):
    first = F.min("season").over(Window.partitionBy("user_id"))
    return events(spark, d).select("event_id", first.alias("first_season"), (F.col("season") == first).alias("rookie"))


@query("next_transition", over(EVENTS, """
  , t AS (SELECT event_type, CASE WHEN lead(season) OVER w IS NULL THEN 'end' WHEN lead(season) OVER w <> season THEN 'new_season' WHEN lead(event_type) OVER w = event_type THEN 'repeat' WHEN lead(y) OVER w = 1 THEN 'buy' ELSE 'other' END AS next FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
  SELECT event_type, next, count(*) AS n FROM t GROUP BY ALL"""))
def next_transition(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    season = F.lead("season").over(w)
    step = F.when(season.isNull(), "end").when(season != F.col("season"), "new_season").when(F.lead("event_type").over(w) == F.col("event_type"), "repeat").when(F.lead("y").over(w) == 1, "buy").otherwise("other")
    return events(spark, d).select("event_type", step.alias("next")).groupBy("event_type", "next").agg(F.count(F.lit(1)).alias("n"))


@query("parity_fold", over(EVENTS, _RUNS + " SELECT event_id, CAST((run - 1) % 2 AS INT) AS fold FROM c"))
def parity_fold(spark, d):
    return _runs(spark, d).select("event_id", ((F.col("run") - 1) % 2).cast("int").alias("fold"))


@query("topk_per_group", over(ITEMS, "SELECT supplier, part, cents FROM (SELECT supplier, part, cents, row_number() OVER (PARTITION BY supplier ORDER BY cents DESC, part, ord, cnt, qty, pct, season, month, y) AS r FROM items) WHERE r <= 3"))
def topk_per_group(spark, d):
    w = Window.partitionBy("supplier").orderBy(F.desc("cents"), "part", "ord", "cnt", "qty", "pct", "season", "month", "y")
    return items(spark, d).withColumn("r", F.row_number().over(w)).filter("r <= 3").select("supplier", "part", "cents")


@query("topk_global", over(ITEMS, "SELECT supplier, sum(cents)::BIGINT AS cents FROM items GROUP BY supplier ORDER BY cents DESC, supplier LIMIT 10"))
def topk_global(spark, d):
    return items(spark, d).groupBy("supplier").agg(F.sum("cents").alias("cents")).orderBy(F.desc("cents"), "supplier").limit(10)
