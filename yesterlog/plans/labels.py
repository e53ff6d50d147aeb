"""Targets recovered from cumulative counters, decoded denominators, and derived classes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import season_weight
from ..operators import asof
from .features import _FORM, form
from .registry import EVENTS, ITEMS, events, items, over, query

#: Counters as a log would show them: rates rounded to six places.
_SEEN = ", c AS (SELECT event_id, user_id, n, y, k, CASE WHEN n > 0 THEN round(s / n, 6) END AS shown FROM ev)"


def _seen(spark, d):
    return events(spark, d).select("event_id", "user_id", "n", "y", "k", F.round(F.try_divide("s", "n"), 6).alias("shown"))


@query("recover_labels", over(EVENTS, _SEEN + """, t AS (SELECT *, CAST(round_even(coalesce(shown, 0) * n, 0) AS BIGINT) AS total FROM c), l AS (SELECT *, lead(n) OVER w - n AS dn, lead(total) OVER w - total AS dt FROM t WINDOW w AS (PARTITION BY user_id ORDER BY n))
  SELECT event_id, y, CASE WHEN dn = 1 AND dt IN (0, 1) THEN CAST(dt AS INT) END AS label FROM l"""))
def recover_labels(spark, d):
    """Outcomes from the differences of consecutive exact counts behind rounded rates."""
    t = _seen(spark, d).withColumn("total", F.rint(F.coalesce("shown", F.lit(0.0)) * F.col("n")).cast("long"))
    return asof.recover_labels(t, ["user_id"], "n", "total").select("event_id", "y", "label")


@query("recovery_agreement", over(EVENTS, _SEEN + """, t AS (SELECT *, CAST(round_even(coalesce(shown, 0) * n, 0) AS BIGINT) AS total FROM c), l AS (SELECT *, lead(n) OVER w - n AS dn, lead(total) OVER w - total AS dt FROM t WINDOW w AS (PARTITION BY user_id ORDER BY n))
  SELECT count(*) AS n, count(*) FILTER (dn = 1 AND dt IN (0, 1)) AS recovered, count(*) FILTER (dn = 1 AND dt IN (0, 1) AND dt = y) AS right_ FROM l"""))
def recovery_agreement(spark, d):
    got = F.col("label").isNotNull()
    return recover_labels(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(got, 1)).alias("recovered"), F.count(F.when(F.col("label") == F.col("y"), 1)).alias("right_"))


@query("recovery_after_gap", over(EVENTS, _SEEN + """, t AS (SELECT *, CAST(round_even(coalesce(shown, 0) * n, 0) AS BIGINT) AS total FROM c WHERE event_id % 7 <> 0), l AS (SELECT *, lead(n) OVER w - n AS dn, lead(total) OVER w - total AS dt FROM t WINDOW w AS (PARTITION BY user_id ORDER BY n))
  SELECT user_id, count(*) AS n, count(*) FILTER (dn = 1 AND dt IN (0, 1)) AS recovered FROM l GROUP BY user_id"""))
def recovery_after_gap(spark, d):
    """Where rows are missing, nothing is recovered across the gap."""
    t = _seen(spark, d).filter("event_id % 7 <> 0").withColumn("total", F.rint(F.coalesce("shown", F.lit(0.0)) * F.col("n")).cast("long"))
    return asof.recover_labels(t, ["user_id"], "n", "total").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("recovered"))


_FIVE = "CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 WHEN 'error' THEN 4 ELSE -1 END"


@query("five_class_target", over(EVENTS, f"SELECT event_id, {_FIVE} AS target, CASE WHEN y = 1 THEN 0 WHEN event_type IN ('click', 'view') THEN 1 ELSE 2 END AS three, least({_FIVE}, 3) AS four, CASE WHEN {_FIVE} >= 0 THEN {_FIVE} + CAST(cents > 5000 AND {_FIVE} IN (0, 1) AS INT) * 5 ELSE -1 END AS seven FROM ev"))
def five_class_target(spark, d):
    """Five classes, and their three-, four- and seven-class variants; -1 is unknown."""
    t = F.col("event_type")
    five = F.when(t == "purchase", 0).when(t == "click", 1).when(t == "view", 2).when(t == "signup", 3).when(t == "error", 4).otherwise(-1)
    c = F.col("target")
    seven = F.when(c >= 0, c + ((F.col("cents") > 5000) & c.isin(0, 1)).cast("int") * 5).otherwise(-1)
    three = F.when(F.col("y") == 1, 0).when(t.isin("click", "view"), 1).otherwise(2)
    return events(spark, d).withColumn("target", five).select("event_id", "target", three.alias("three"), F.least(c, F.lit(3)).alias("four"), seven.alias("seven"))


_N, _TOL = 40, 0.0006


def decode(rates, most: int, tolerance: float):
    """For distinct values of `shown`: every denominator up to `most` by which it is a rounded ratio of integers, with that count."""
    options = rates.withColumn("den", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("count_", F.rint(F.col("shown") * F.col("den")).cast("long"))
    return options.filter(F.abs(F.col("count_") / F.col("den") - F.col("shown")) <= tolerance)


_DECODE = ", r AS (SELECT user_id, n, s, round(s / n, 3) AS shown FROM ev WHERE n BETWEEN 1 AND 40), v AS (SELECT DISTINCT shown FROM r), o AS (SELECT shown, den, CAST(round_even(shown * den, 0) AS BIGINT) AS count_ FROM v, (SELECT CAST(unnest(range(1, 41)) AS INT) AS den) WHERE abs(CAST(round_even(shown * den, 0) AS BIGINT) / den - shown) <= 0.0006::DOUBLE)"


def _rates(spark, d):
    return events(spark, d).filter(F.col("n").between(1, _N)).select("user_id", "n", "s", F.round(F.try_divide("s", "n"), 3).alias("shown"))


@query("denominator_decode", over(EVENTS, _DECODE + " SELECT shown, count(*) AS options, min(den) AS smallest, max(den) AS largest, arg_min(count_, den) AS count_ FROM o GROUP BY shown"))
def denominator_decode(spark, d):
    """Hidden denominators of rounded rates; only distinct rates are multiplied by candidates."""
    o = decode(_rates(spark, d).select("shown").distinct(), _N, _TOL)
    return o.groupBy("shown").agg(F.count(F.lit(1)).alias("options"), F.min("den").alias("smallest"), F.max("den").alias("largest"), F.min_by("count_", "den").alias("count_"))


@query("decoder_rules", over(EVENTS, _DECODE + """, f AS (SELECT shown, n, count(*) AS times FROM r GROUP BY shown, n), q AS (SELECT o.shown, o.den, coalesce(f.times, 0) AS times FROM o LEFT JOIN f ON f.shown = o.shown AND f.n = o.den),
  b AS (SELECT shown, min(den) AS smallest, max(den) AS largest, arg_max(den, times * 1000 - den) AS frequent FROM q GROUP BY shown)
  SELECT rule, count(*) AS n, sum(CAST(guess = n AS INT))::BIGINT AS right_ FROM (SELECT r.n, unnest(['smallest', 'largest', 'frequent']) AS rule, unnest([smallest, largest, frequent]) AS guess FROM r JOIN b USING (shown)) GROUP BY rule"""))
def decoder_rules(spark, d):
    """How often each rule that chooses among possible denominators finds the true one."""
    r = _rates(spark, d)
    f = r.groupBy("shown", F.col("n").cast("int").alias("den")).agg(F.count(F.lit(1)).alias("times"))
    q = decode(r.select("shown").distinct(), _N, _TOL).join(f, ["shown", "den"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    b = q.groupBy("shown").agg(F.min("den").alias("smallest"), F.max("den").alias("largest"), F.max_by("den", F.col("times") * 1000 - F.col("den")).alias("frequent"))
    rules = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("guess")) for k in ("smallest", "largest", "frequent")]))
    g = r.join(b, "shown").select("n", rules.alias("g"))
    return g.groupBy("g.rule").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("g.guess") == F.col("n")).cast("int")).alias("right_"))


@query("workload_features", over(_FORM, """
  , w AS (SELECT event_id, n, r1, r3, r5, CAST(round_even(r3 * 3, 0) AS BIGINT) AS c3, CAST(round_even(r5 * 5, 0) AS BIGINT) AS c5 FROM fm)
  SELECT event_id, c3, c5, c5 - c3 AS earlier, CASE WHEN c5 > 0 THEN c3 / c5 END AS late_share, CAST(r1 IS NOT NULL AS INT) + CAST(r3 IS NOT NULL AS INT) + CAST(r5 IS NOT NULL AS INT) AS known FROM w"""))
def workload_features(spark, d):
    """Counts behind the trailing rates and what they say of the windows' parts."""
    w = form(spark, d).withColumn("c3", F.rint(F.col("r3") * 3).cast("long")).withColumn("c5", F.rint(F.col("r5") * 5).cast("long"))
    known = sum((F.col(f"r{j}").isNotNull().cast("int") for j in (1, 3, 5)), F.lit(0))
    return w.select("event_id", "c3", "c5", (F.col("c5") - F.col("c3")).alias("earlier"), F.when(F.col("c5") > 0, F.col("c3") / F.col("c5")).alias("late_share"), known.alias("known"))


@query("count_groups", over(_FORM, "SELECT event_id, CASE WHEN balls < strikes THEN 2 WHEN balls = strikes THEN 1 ELSE 0 END AS count_group, CASE WHEN base >= 2 AND outs = 2 THEN 2 WHEN base > 0 THEN 1 ELSE 0 END AS pressure, 3 * (season - 1) + outs + CAST(bit_count(base) AS INT) + CAST(n AS INT) AS workload FROM fm"))
def count_groups(spark, d):
    c = F.col
    group = F.when(c("balls") < c("strikes"), 2).when(c("balls") == c("strikes"), 1).otherwise(0)
    pressure = F.when((c("base") >= 2) & (c("outs") == 2), 2).when(c("base") > 0, 1).otherwise(0)
    return form(spark, d).select("event_id", group.alias("count_group"), pressure.alias("pressure"), (3 * (c("season") - 1) + c("outs") + F.bit_count("base") + c("n").cast("int")).alias("workload"))


@query("season_weights", over(ITEMS, "SELECT season, count(*) AS n, round(pow(0.55::DOUBLE, 2001 - season), 9) AS weight, round(sum(y) * pow(0.9::DOUBLE, 2001 - season), 6) AS weighted FROM items GROUP BY season"))
def season_weights(spark, d):
    age = 2001 - F.col("season")
    return items(spark, d).groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("t")).select("season", "n", F.round(season_weight(age, 0.55), 9).alias("weight"), F.round(F.col("t") * season_weight(age, 0.9), 6).alias("weighted"))


@query("integer_denominator_audit", over(EVENTS, _SEEN + """, x AS (SELECT name, abs(shown * den - round_even(shown * den, 0)) <= 0.001::DOUBLE AS whole FROM (SELECT shown, unnest(['n', 'next', 'k']) AS name, unnest([n, n + 1, k + 1]) AS den FROM c WHERE n > 0)) SELECT name, count(*) AS n, avg(CAST(whole AS INT)) AS share FROM x GROUP BY name"""))
def integer_denominator_audit(spark, d):
    """By which denominator the shown rates are whole counts."""
    dens = {"n": F.col("n"), "next": F.col("n") + 1, "k": (F.col("k") + 1).cast("long")}
    x = _seen(spark, d).filter("n > 0").select("shown", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), c.alias("den")) for k, c in dens.items()])).alias("o"))
    v = F.col("shown") * F.col("o.den")
    return x.groupBy("o.name").agg(F.count(F.lit(1)).alias("n"), F.avg((F.abs(v - F.rint(v)) <= 0.001).cast("int")).alias("share"))


@query("sum_to_one_audit", over(EVENTS, ", g AS (SELECT user_id, season, avg(y) AS a, avg(CAST(event_type IN ('click', 'view') AS INT)) AS b, avg(CAST(event_type IN ('signup', 'error') AS INT)) AS c FROM ev GROUP BY ALL) SELECT season, count(*) AS n, count(*) FILTER (abs(a + b + c - 1) > 1e-9) AS off FROM g GROUP BY season"))
def sum_to_one_audit(spark, d):
    share = lambda *t: F.avg(F.col("event_type").isin(*t).cast("int"))
    g = events(spark, d).groupBy("user_id", "season").agg((F.avg("y") + share("click", "view") + share("signup", "error")).alias("total"))
    return g.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.abs(F.col("total") - 1) > 1e-9, 1)).alias("off"))


@query("state_boundary_audit", over(EVENTS, """, e AS (SELECT user_id, season, max(n) + 1 AS n_end FROM ev GROUP BY ALL), b AS (SELECT user_id, season, min(n) AS n_first FROM ev GROUP BY ALL)
  SELECT b.season, count(*) AS users, avg(CAST(n_first = n_end AS INT)) AS equal FROM b JOIN e ON b.user_id = e.user_id AND b.season = e.season + 1 GROUP BY b.season"""))
def state_boundary_audit(spark, d):
    """Whether a season's first counter is the end of the season before."""
    g = events(spark, d).groupBy("user_id", "season").agg(F.min("n").alias("n_first"), (F.max("n") + 1).alias("n_end"))
    before = g.select("user_id", (F.col("season") + 1).alias("season"), F.col("n_end").alias("end_before"))
    return g.join(before, ["user_id", "season"]).groupBy("season").agg(F.count(F.lit(1)).alias("users"), F.avg((F.col("n_first") == F.col("end_before")).cast("int")).alias("equal"))


@query("teacher_folds", over(EVENTS, """, b AS (SELECT *, CASE WHEN lag(event_id) OVER w IS NULL OR lag(season) OVER w IS DISTINCT FROM season THEN 1 ELSE 0 END AS st FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  c AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM b), f AS (SELECT user_id, run % 2 AS fold, sum(y)::BIGINT AS t, count(*) AS m FROM c GROUP BY ALL)
  SELECT c.event_id, (coalesce(f.t, 0) + 20 * 0.2::DOUBLE) / (coalesce(f.m, 0) + 20) AS teacher FROM c LEFT JOIN f ON f.user_id = c.user_id AND f.fold = 1 - c.run % 2"""))
def teacher_folds(spark, d):
    """A row's teacher rate comes from the segments of the other parity, never from its own."""
    c = asof.sessionize(events(spark, d), ["user_id"], ["event_id"], [F.col("season")], "run").withColumn("fold", F.col("run") % 2)
    f = c.groupBy("user_id", (1 - F.col("fold")).alias("fold")).agg(F.sum("y").alias("t"), F.count(F.lit(1)).alias("m"))
    return c.join(f, ["user_id", "fold"], "left").select("event_id", ((F.coalesce("t", F.lit(0)) + 20 * F.lit(0.2)) / (F.coalesce("m", F.lit(0)) + 20)).alias("teacher"))


@query("first_order_codes", over(EVENTS, ", f AS (SELECT event_type, min(event_id) AS first FROM ev WHERE season < 1 GROUP BY event_type), c AS (SELECT event_type, CAST(row_number() OVER (ORDER BY first) - 1 AS INT) AS code FROM f) SELECT event_id, coalesce(code, -1) AS code FROM ev LEFT JOIN c USING (event_type)"))
def first_order_codes(spark, d):
    """Codes in the order of first appearance in training rows; unknown values are -1. The distinct values are few."""
    ev = events(spark, d)
    f = ev.filter("season < 1").groupBy("event_type").agg(F.min("event_id").alias("first"))
    codes = f.select("event_type", (F.row_number().over(Window.orderBy("first")) - 1).cast("int").alias("code"))
    return ev.join(codes, "event_type", "left").select("event_id", F.coalesce("code", F.lit(-1)).alias("code"))
