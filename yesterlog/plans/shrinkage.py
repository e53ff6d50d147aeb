"""Empirical-Bayes rates, as-of differences, season-to-date states, hierarchies and residual tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import clip, eb, rate
from ..operators import aggregate as A
from ..operators import asof
from ..operators import shrink as S
from ..operators.lookup import attach
from .registry import EVENTS, ITEMS, events, items, over, query

D = "::DOUBLE"


@query("eb_smooth", over(EVENTS, "SELECT event_id, (s + 200.0::DOUBLE * 0.2::DOUBLE) / (n + 200.0::DOUBLE) AS smooth FROM ev"))
def eb_smooth(spark, d):
    return events(spark, d).select("event_id", eb("s", "n", 0.2, 200).alias("smooth"))


_COND = """
  , g AS (SELECT supplier, hand, season, sum(y)::BIGINT AS t, count(*) AS n FROM items GROUP BY ALL),
  c AS (SELECT supplier, hand, season, coalesce(sum(t) OVER w, 0)::BIGINT AS ct, coalesce(sum(n) OVER w, 0)::BIGINT AS cn FROM g WINDOW w AS (PARTITION BY supplier, hand ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  h AS (SELECT supplier, season, sum(t)::BIGINT AS t, sum(n)::BIGINT AS n FROM g GROUP BY ALL),
  o AS (SELECT supplier, season, coalesce(sum(t) OVER w, 0)::BIGINT AS ot, coalesce(sum(n) OVER w, 0)::BIGINT AS n_over FROM h WINDOW w AS (PARTITION BY supplier ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("cond_delta_asof", over(ITEMS, _COND + """
  , q AS (SELECT supplier, hand, season, cn, ct, (ot + 0.25::DOUBLE * 0 + 100.0::DOUBLE * 0.25::DOUBLE) / (n_over + 100.0::DOUBLE) AS p FROM c JOIN o USING (supplier, season))
  SELECT supplier, hand, season, CASE WHEN cn > 0 THEN (ct + 60.0::DOUBLE * p) / (cn + 60.0::DOUBLE) - p END AS delta FROM q"""))
def cond_delta_asof(spark, d):
    """The strict-past conditional rate, shrunk to the supplier's strict-past rate, minus that rate; NULL without a past."""
    own, cell = A.levels(items(spark, d), [["supplier", "season"], ["supplier", "hand", "season"]])
    own = asof.prefix(own, ["supplier"], ["season"], ["total", "n"]).select("supplier", "season", eb("total_before", "n_before", 0.25, 100).alias("p"))
    cell = asof.prefix(cell, ["supplier", "hand"], ["season"], ["total", "n"]).join(own, ["supplier", "season"])
    return cell.select("supplier", "hand", "season", F.when(F.col("n_before") > 0, eb("total_before", "n_before", F.col("p"), 60) - F.col("p")).alias("delta"))


@query("pair_history", over(ITEMS, _COND.replace("hand", "cnt") + """
  SELECT supplier, cnt, season, (ct + 40.0::DOUBLE * ((ot + 100.0::DOUBLE * 0.25::DOUBLE) / (n_over + 100.0::DOUBLE))) / (cn + 40.0::DOUBLE) AS pair_rate, round(ln(1 + cn), 6) AS log_n FROM c JOIN o USING (supplier, season)"""))
def pair_history(spark, d):
    own, cell = A.levels(items(spark, d), [["supplier", "season"], ["supplier", "cnt", "season"]])
    own = asof.prefix(own, ["supplier"], ["season"], ["total", "n"]).select("supplier", "season", eb("total_before", "n_before", 0.25, 100).alias("p"))
    cell = asof.prefix(cell, ["supplier", "cnt"], ["season"], ["total", "n"]).join(own, ["supplier", "season"])
    return cell.select("supplier", "cnt", "season", eb("total_before", "n_before", F.col("p"), 40).alias("pair_rate"), F.round(F.log1p("n_before"), 6).alias("log_n"))


@query("season_constants", over(EVENTS, "SELECT user_id, max(n) + 1 AS n_end, arg_max(s + y, n) AS s_end, arg_max(rate, n) * (max(n) + 1) AS s_approx FROM ev WHERE season < 3 GROUP BY user_id"))
def season_constants(spark, d):
    """State at the end of the history: the exact count, and rate * (n + 1), the approximation for other counters."""
    ev = events(spark, d).filter("season < 3").withColumn("through", F.col("s") + F.col("y"))
    return ev.groupBy("user_id").agg((F.max("n") + 1).alias("n_end"), F.max_by("through", "n").alias("s_end"), (F.max_by("rate", "n") * (F.max("n") + 1)).alias("s_approx"))


_CS = """
  , k AS (SELECT user_id, season + 1 AS season, max(n + 1) AS n_end, max(s + y) AS s_end FROM ev GROUP BY ALL),
  a AS (SELECT ev.*, coalesce(k.n_end, 0) AS n_end, coalesce(k.s_end, 0) AS s_end FROM ev ASOF LEFT JOIN k ON ev.user_id = k.user_id AND ev.season >= k.season),
  z AS (SELECT event_id, greatest(n - n_end, 0) AS cs_n, greatest(rint_(coalesce(rate * n, 0)) - s_end, 0) AS cs_s, CASE WHEN n_end > 0 THEN s_end / n_end END AS prior, rate FROM a)""".replace("rint_(", "round_even(").replace("n, 0)) - s_end", "n, 0), 0) - s_end")


def _season_to_date(spark, d):
    ev = events(spark, d)
    ends = ev.groupBy("user_id", "season").agg(F.max(F.col("n") + 1).alias("n_end"), F.max(F.col("s") + F.col("y")).alias("s_end"))
    a = asof.asof_join(ev, ends, ["user_id"], "season", ["n_end", "s_end"]).na.fill(0, ["n_end", "s_end"])
    return a.select("event_id", F.greatest(F.col("n") - F.col("n_end"), F.lit(0)).alias("cs_n"), F.greatest(F.rint(F.coalesce(F.col("rate") * F.col("n"), F.lit(0.0))) - F.col("s_end"), F.lit(0.0)).alias("cs_s"), rate("s_end", "n_end").alias("prior"), "rate")


@query("season_to_date", over(EVENTS, _CS + """
  SELECT event_id, cs_n, CASE WHEN cs_n >= 5 THEN (cs_s + 50.0::DOUBLE * coalesce(prior, 0.2::DOUBLE)) / (cs_n + 50.0::DOUBLE) END AS cs_rate,
    CASE WHEN cs_n >= 5 THEN (cs_s + 50.0::DOUBLE * coalesce(prior, 0.2::DOUBLE)) / (cs_n + 50.0::DOUBLE) - coalesce(prior, 0.2::DOUBLE) END AS cs_delta FROM z"""))
def season_to_date(spark, d):
    """What happened since the season began, from cumulative counters alone: differences to the state at the last season's end."""
    prior = F.coalesce("prior", F.lit(0.2))
    cs = eb("cs_s", "cs_n", prior, 50)
    return _season_to_date(spark, d).select("event_id", "cs_n", F.when(F.col("cs_n") >= 5, cs).alias("cs_rate"), F.when(F.col("cs_n") >= 5, cs - prior).alias("cs_delta"))


_LADDER = (10, 30, 100, 300)


@query("shrink_ladder", over(EVENTS, _CS + " SELECT event_id, " + ", ".join(f"(cs_s + {k}.0::DOUBLE * coalesce(prior, 0.2::DOUBLE)) / (cs_n + {k}.0::DOUBLE) AS s{k}" for k in _LADDER) + " FROM z"))
def shrink_ladder(spark, d):
    return _season_to_date(spark, d).select("event_id", *[eb("cs_s", "cs_n", F.coalesce("prior", F.lit(0.2)), k).alias(f"s{k}") for k in _LADDER])


@query("exact_state_audit", over(EVENTS, _CS + " SELECT count(*) AS n, count(*) FILTER (cs_s > cs_n) AS invalid, count(*) FILTER (cs_s < 0) AS negative, max(cs_s)::DOUBLE AS most FROM z"))
def exact_state_audit(spark, d):
    """Numerators since the cut-off that no denominator allows."""
    return _season_to_date(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("cs_s") > F.col("cs_n"), 1)).alias("invalid"), F.count(F.when(F.col("cs_s") < 0, 1)).alias("negative"), F.max("cs_s").alias("most"))


_KINDS = ("click", "view", "purchase")


@query("multirate", over(EVENTS, " SELECT user_id, count(*) AS n, " + ", ".join(
    f"(count(*) FILTER (event_type = '{t}') + 200.0::DOUBLE * 0.2::DOUBLE) / (count(*) + 200.0::DOUBLE) AS {t}_prior, (count(*) FILTER (event_type = '{t}' AND season >= 3) + 30.0::DOUBLE * 0.2::DOUBLE) / (count(*) FILTER (season >= 3) + 30.0::DOUBLE) AS {t}_season" for t in _KINDS) + " FROM ev GROUP BY user_id"))
def multirate(spark, d):
    now = F.col("season") >= 3
    of = lambda t, c=None: F.count(F.when((F.col("event_type") == t) & (c if c is not None else F.lit(True)), 1))
    agg = [x for t in _KINDS for x in (eb(of(t), F.count(F.lit(1)), 0.2, 200).alias(f"{t}_prior"), eb(of(t, now), F.count(F.when(now, 1)), 0.2, 30).alias(f"{t}_season"))]
    return events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), *agg)


@query("snapshot_season_rate", over(EVENTS, """, e AS (SELECT user_id, season, count(*) AS n, sum(y)::BIGINT AS t FROM ev GROUP BY ALL)
  SELECT user_id, season, (t + 30.0::DOUBLE * 0.2::DOUBLE) / (n + 30.0::DOUBLE) AS season_rate, t / n AS raw, (t + 10.0::DOUBLE * 0.2::DOUBLE) / (n + 10.0::DOUBLE) AS s10, (t + 50.0::DOUBLE * 0.2::DOUBLE) / (n + 50.0::DOUBLE) AS s50, (t + 200.0::DOUBLE * 0.2::DOUBLE) / (n + 200.0::DOUBLE) AS s200 FROM e"""))
def snapshot_season_rate(spark, d):
    e = A.grouped(events(spark, d), ["user_id", "season"])
    return e.select("user_id", "season", eb("total", "n", 0.2, 30).alias("season_rate"), rate("total", "n").alias("raw"), *[eb("total", "n", 0.2, k).alias(f"s{k}") for k in (10, 50, 200)])


_MIX = "CAST(cents > 5000000 AS INT)"


@query("mix_table_asof", over(ITEMS, f"""
  , g AS (SELECT supplier, kind, season, sum({_MIX})::BIGINT AS t, count(*) AS n FROM items GROUP BY ALL)
  SELECT supplier, kind, season, (coalesce(sum(t) OVER w, 0) + 50.0::DOUBLE * 0.5::DOUBLE) / (coalesce(sum(n) OVER w, 0) + 50.0::DOUBLE) AS mix FROM g WINDOW w AS (PARTITION BY supplier, kind ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""))
def mix_table_asof(spark, d):
    """Share of large items by supplier and kind in strictly earlier seasons."""
    it = items(spark, d).withColumn("y", (F.col("cents") > 5000000).cast("int"))
    g = asof.prefix(A.grouped(it, ["supplier", "kind", "season"]), ["supplier", "kind"], ["season"], ["total", "n"])
    return g.select("supplier", "kind", "season", eb("total_before", "n_before", 0.5, 50).alias("mix"))


@query("mix_table_career", over(ITEMS, f"""
  , c AS (SELECT supplier, kind, sum({_MIX})::BIGINT AS t, count(*) AS n FROM items GROUP BY ALL), o AS (SELECT supplier, sum(t)::BIGINT AS ot, sum(n)::BIGINT AS n_over FROM c GROUP BY supplier)
  SELECT supplier, kind, (t + 50.0::DOUBLE * ((ot + 50.0::DOUBLE * 0.5::DOUBLE) / (n_over + 50.0::DOUBLE))) / (n + 50.0::DOUBLE) AS mix FROM c JOIN o USING (supplier)"""))
def mix_table_career(spark, d):
    it = items(spark, d).withColumn("y", (F.col("cents") > 5000000).cast("int"))
    own, cell = S.hierarchy(it, [["supplier"], ["supplier", "kind"]], [50, 50], 0.5)
    return cell.select("supplier", "kind", F.col("p").alias("mix"))


_HIER = """
  , f AS (SELECT kind, supplier, hand, cnt, sum(y)::BIGINT AS t, count(*) AS n FROM items WHERE season < 2000 GROUP BY ALL),
  l0 AS (SELECT kind, (sum(t) + 1200.0::DOUBLE * 0.53::DOUBLE) / (sum(n) + 1200.0::DOUBLE) AS p FROM f GROUP BY kind),
  l1 AS (SELECT kind, supplier, (sum(t) + 220.0::DOUBLE * l0.p) / (sum(n) + 220.0::DOUBLE) AS p FROM f JOIN l0 USING (kind) GROUP BY kind, supplier, l0.p),
  l2 AS (SELECT kind, supplier, hand, (sum(t) + 110.0::DOUBLE * l1.p) / (sum(n) + 110.0::DOUBLE) AS p FROM f JOIN l1 USING (kind, supplier) GROUP BY kind, supplier, hand, l1.p),
  l3 AS (SELECT kind, supplier, hand, cnt, (t + 220.0::DOUBLE * l2.p) / (n + 220.0::DOUBLE) AS p FROM f JOIN l2 USING (kind, supplier, hand))"""


@query("hierarchy_residual", over(ITEMS, _HIER + """
  , r AS (SELECT i.season, i.supplier, coalesce(l0.p - 0.53::DOUBLE, 0) + coalesce(l1.p - l0.p, 0) + coalesce(l2.p - l1.p, 0) + coalesce(l3.p - l2.p, 0) AS effect FROM items i
    LEFT JOIN l0 USING (kind) LEFT JOIN l1 USING (kind, supplier) LEFT JOIN l2 USING (kind, supplier, hand) LEFT JOIN l3 USING (kind, supplier, hand, cnt) WHERE season >= 2000)
  SELECT season, supplier, count(*) AS n, round(avg(effect), 9) AS effect FROM r GROUP BY ALL"""))
def hierarchy_residual(spark, d):
    """Four levels, each shrunk to the one above; rows of later seasons get the sum of the levels' lifts."""
    it = items(spark, d)
    tables = S.hierarchy(it.filter("season < 2000"), [["kind"], ["kind", "supplier"], ["kind", "supplier", "hand"], ["kind", "supplier", "hand", "cnt"]], [1200, 220, 110, 220], 0.53)
    rows = S.apply_hierarchy(it.filter("season >= 2000"), tables)
    return rows.groupBy("season", "supplier").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("effect"), 9).alias("effect"))


@query("source_season_effect", over(ITEMS, """
  , g AS (SELECT supplier, season, sum(y - 0.25::DOUBLE) AS t, count(*) AS n FROM items WHERE season IN (1996, 1997, 1998, 1999) GROUP BY ALL)
  SELECT supplier, round(sum(t / (n + 200.0::DOUBLE)) / 4, 9) AS effect FROM g GROUP BY supplier"""))
def source_season_effect(spark, d):
    """Mean of the effects of four source seasons; a season without the supplier counts as 0."""
    it = items(spark, d).filter(F.col("season").between(1996, 1999)).withColumn("e", F.col("y") - F.lit(0.25))
    return S.residual_eb(it, ["supplier", "season"], "e", 200).groupBy("supplier").agg(F.round(F.sum("correction") / 4, 9).alias("effect"))


@query("residual_eb", over(ITEMS, ", h AS (SELECT supplier, cnt, sum(y * 4 - 1)::BIGINT AS t, count(*) AS n FROM items WHERE season < 2000 GROUP BY ALL) SELECT supplier, cnt, n, t / (n + 500.0::DOUBLE) AS correction FROM h"))
def residual_eb(spark, d):
    it = items(spark, d).filter("season < 2000").withColumn("e", F.col("y") * 4 - 1)
    return S.residual_eb(it, ["supplier", "cnt"], "e", 500)


_TENSOR = ((["supplier", "hand"], 0.25, 500), (["supplier", "cnt", "hand"], 0.75, 1000), (["hand", "cnt", "month"], 0.05, 500))


@query("tensor_effect", over(ITEMS, ", h AS (SELECT *, y * 4 - 1 AS e FROM items WHERE season < 2000)" + "".join(
    f", t{i} AS (SELECT {', '.join(k)}, {w}::DOUBLE * (sum(e)::BIGINT / (count(*) + {a}.0::DOUBLE)) AS v FROM h GROUP BY ALL)" for i, (k, w, a) in enumerate(_TENSOR)) + """
  SELECT season, supplier, kind, round(avg(CASE WHEN kind = 'O' THEN coalesce(t0.v, 0) + coalesce(t1.v, 0) + coalesce(t2.v, 0) ELSE 0 END), 9) AS effect FROM items
  LEFT JOIN t0 USING (supplier, hand) LEFT JOIN t1 USING (supplier, cnt, hand) LEFT JOIN t2 USING (hand, cnt, month) WHERE season >= 2000 GROUP BY ALL"""))  # fmt: skip
def tensor_effect(spark, d):
    """Weighted sum of three residual tables, for rows of kind O only."""
    it = items(spark, d)
    history, rows = it.filter("season < 2000").withColumn("e", F.col("y") * 4 - 1), it.filter("season >= 2000")
    for i, (keys, weight, alpha) in enumerate(_TENSOR):
        t = S.residual_eb(history, keys, "e", alpha, f"v{i}").drop("n").withColumn(f"v{i}", F.lit(weight) * F.col(f"v{i}"))
        rows = attach(rows, t, keys, {f"v{i}": 0.0}).drop("seen")
    effect = F.when(F.col("kind") == "O", F.col("v0") + F.col("v1") + F.col("v2")).otherwise(F.lit(0.0))
    return rows.groupBy("season", "supplier", "kind").agg(F.round(F.avg(effect), 9).alias("effect"))


@query("reliability_gate", over(ITEMS, """
  , g AS (SELECT supplier, sum(CASE WHEN y = 1 THEN 3 ELSE -1 END)::BIGINT AS gain, count(*) AS n FROM items WHERE season < 1998 AND supplier % 10 <> 0 GROUP BY supplier), s AS (SELECT DISTINCT supplier FROM items)
  SELECT supplier, CASE WHEN n IS NULL THEN 0.5::DOUBLE WHEN gain / (n + 300.0::DOUBLE) > 0 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS gate FROM s LEFT JOIN g USING (supplier)"""))
def reliability_gate(spark, d):
    it = items(spark, d)
    g = it.filter("season < 1998 and supplier % 10 <> 0").groupBy("supplier").agg(F.sum(F.when(F.col("y") == 1, 3).otherwise(-1)).alias("gain"), F.count(F.lit(1)).alias("n"))
    return it.select("supplier").distinct().join(g, "supplier", "left").select("supplier", S.reliability_gate(F.col("gain"), F.col("n"), 300).alias("gate"))


@query("centered_maps", over(ITEMS, """
  , r AS (SELECT *, y - avg(y) OVER (PARTITION BY kind, season) AS e FROM items WHERE season < 2000), a AS (SELECT supplier, hand, sum(e) AS t, count(*) AS n FROM r GROUP BY ALL)
  SELECT supplier, hand, n, round(t / (n + 800.0::DOUBLE), 9) AS correction FROM a"""))
def centered_maps(spark, d):
    """Residuals centred within kind and season, then shrunk by supplier and hand."""
    r = A.centred(items(spark, d).filter("season < 2000"), ["kind", "season"], "y", "e")
    out = S.residual_eb(r, ["supplier", "hand"], "e", 800)
    return out.withColumn("correction", F.round("correction", 9))


@query("venue_hierarchy", over("""o AS (SELECT CASE WHEN c_nationkey = s_nationkey THEN 'home' ELSE 'away' END AS venue, n_regionkey, CAST(l_returnflag = 'R' AS INT) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
  v AS (SELECT venue, (sum(y) + 300.0::DOUBLE * 0.25::DOUBLE) / (count(*) + 300.0::DOUBLE) AS p FROM o GROUP BY venue)""", """
  SELECT venue, n_regionkey, count(*) AS n, (sum(y) + 150.0::DOUBLE * v.p) / (count(*) + 150.0::DOUBLE) AS p FROM o JOIN v USING (venue) GROUP BY venue, n_regionkey, v.p"""))
def venue_hierarchy(spark, d):
    """Same nation or not, derived by joins, then region: two levels."""
    from .registry import table

    li, o, c, s, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier", "nation"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
    rows = j.select(F.when(F.col("c_nationkey") == F.col("s_nationkey"), "home").otherwise("away").alias("venue"), "n_regionkey", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return S.hierarchy(rows, [["venue"], ["venue", "n_regionkey"]], [300, 150], 0.25)[1].select("venue", "n_regionkey", "n", "p")


@query("split_priors", over(ITEMS, """
  , c AS (SELECT supplier, hand, sum(y)::BIGINT AS t, count(*) AS n FROM items GROUP BY ALL), e AS (SELECT supplier, sum(t)::BIGINT AS st, sum(n)::BIGINT AS sn FROM c GROUP BY supplier)
  SELECT supplier, hand, n, (t / n - st / sn) * (n / (n + 120.0::DOUBLE)) AS split FROM c JOIN e USING (supplier)"""))
def split_priors(spark, d):
    return S.split_priors(items(spark, d), ["supplier"], ["hand"], 120)


_LOO = [["season", "kind", "hand", "cnt"], ["season", "kind", "hand"], ["season", "kind"]]


@query("loo_context_expectation", over(ITEMS, "".join(f", l{i} AS (SELECT {', '.join(k)}, sum(y)::BIGINT AS t, count(*) AS n FROM items GROUP BY ALL)" for i, k in enumerate(_LOO)) + """
  , x AS (SELECT supplier, """ + ", ".join(f"(l{i}.t - y + 400.0::DOUBLE * 0.25::DOUBLE) / (greatest(l{i}.n - 1, 0) + 400.0::DOUBLE) AS e{i}, greatest(l{i}.n - 1, 0) / (greatest(l{i}.n - 1, 0) + 400.0::DOUBLE) AS r{i}" for i in range(3)) + """
    FROM items JOIN l0 USING (season, kind, hand, cnt) JOIN l1 USING (season, kind, hand) JOIN l2 USING (season, kind))
  SELECT supplier, count(*) AS n, round(avg((e0 * (0.25::DOUBLE + r0) + e1 * (0.25::DOUBLE + r1) + e2 * (0.25::DOUBLE + r2)) / (0.25::DOUBLE + r0 + 0.25::DOUBLE + r1 + 0.25::DOUBLE + r2)), 9) AS expected FROM x GROUP BY supplier"""))
def loo_context_expectation(spark, d):
    """Each row's expected outcome from other rows in its context, at three levels, weighted by their reliability."""
    rows = items(spark, d)
    base = rows
    for i, keys in enumerate(_LOO):
        t = base.groupBy(*keys).agg(F.sum("y").alias(f"t{i}"), F.count(F.lit(1)).alias(f"n{i}"))
        others = F.greatest(F.col(f"n{i}") - 1, F.lit(0))
        rows = rows.join(t, keys).withColumn(f"e{i}", eb(F.col(f"t{i}") - F.col("y"), others, 0.25, 400)).withColumn(f"w{i}", F.lit(0.25) + others / (others + F.lit(400.0)))
    mean = sum(F.col(f"e{i}") * F.col(f"w{i}") for i in range(3)) / sum(F.col(f"w{i}") for i in range(3))
    return rows.groupBy("supplier").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(mean), 9).alias("expected"))


@query("condition_profiles", over(ITEMS, """
  , s AS (SELECT supplier, season, sum(y - 0.25::DOUBLE) AS t, count(*) AS n, sum(CASE WHEN pct >= 7 THEN y - 0.25::DOUBLE ELSE 0 END) AS ct, count(*) FILTER (pct >= 7) AS cn FROM items GROUP BY ALL),
  a AS (SELECT supplier, sum(t) AS t, sum(n)::BIGINT AS n, sum(ct) AS ct, sum(cn)::BIGINT AS cn, abs(avg(CASE WHEN cn > 0 THEN sign(ct) END)) AS stability FROM s GROUP BY supplier)
  SELECT supplier, cn, round((ct + 100.0::DOUBLE * (t / (n + 100.0::DOUBLE))) / (cn + 100.0::DOUBLE) - t / (n + 100.0::DOUBLE), 9) AS effect, cn / (cn + 100.0::DOUBLE) AS reliability, stability FROM a"""))
def condition_profiles(spark, d):
    """A supplier's shrunk effect under a condition, its reliability, and how stable its sign is over seasons."""
    e, held = F.col("y") - F.lit(0.25), F.col("pct") >= 7
    s = items(spark, d).groupBy("supplier", "season").agg(F.sum(e).alias("t"), F.count(F.lit(1)).alias("n"), F.sum(F.when(held, e).otherwise(0)).alias("ct"), F.count(F.when(held, 1)).alias("cn"))
    a = s.groupBy("supplier").agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.sum("ct").alias("ct"), F.sum("cn").alias("cn"), F.abs(F.avg(F.when(F.col("cn") > 0, F.signum("ct")))).alias("stability"))
    whole = F.col("t") / (F.col("n") + F.lit(100.0))
    return a.select("supplier", "cn", F.round(eb("ct", "cn", whole, 100) - whole, 9).alias("effect"), (F.col("cn") / (F.col("cn") + F.lit(100.0))).alias("reliability"), "stability")


@query("cascade_profile", over(ITEMS, _HIER + """ SELECT kind, supplier, hand, cnt, greatest(-0.1::DOUBLE, least(0.1::DOUBLE, (l3.p - l2.p) + (l2.p - l1.p))) AS offset_ FROM l3 JOIN l2 USING (kind, supplier, hand) JOIN l1 USING (kind, supplier)"""))
def cascade_profile(spark, d):
    """Clipped sum of the two finest steps of the cascade."""
    t = S.hierarchy(items(spark, d).filter("season < 2000"), [["kind"], ["kind", "supplier"], ["kind", "supplier", "hand"], ["kind", "supplier", "hand", "cnt"]], [1200, 220, 110, 220], 0.53)
    fine = t[3].select("kind", "supplier", "hand", "cnt", F.col("p").alias("p3")).join(t[2].select("kind", "supplier", "hand", F.col("p").alias("p2")), ["kind", "supplier", "hand"]).join(t[1].select("kind", "supplier", F.col("p").alias("p1")), ["kind", "supplier"])
    return fine.select("kind", "supplier", "hand", "cnt", clip((F.col("p3") - F.col("p2")) + (F.col("p2") - F.col("p1")), -0.1, 0.1).alias("offset_"))


@query("dynamic_strength", over(EVENTS, """
  , v AS (SELECT *, greatest(50.0::DOUBLE, least(180.0::DOUBLE, 55 + 220 * abs(coalesce(rate, 0.2::DOUBLE) - 0.2::DOUBLE) + 40 / (1 + ln(1 + n)))) AS strength FROM ev)
  SELECT event_id, round((s + strength * 0.2::DOUBLE) / (n + strength), 9) AS smooth FROM v"""))
def dynamic_strength(spark, d):
    """The strength of the prior grows with how far the rate is out and falls with the counter."""
    k = clip(F.lit(55) + 220 * F.abs(F.coalesce("rate", F.lit(0.2)) - F.lit(0.2)) + 40 / (1 + F.log1p("n")), 50, 180)
    return events(spark, d).withColumn("k", k).select("event_id", F.round((F.col("s") + F.col("k") * F.lit(0.2)) / (F.col("n") + F.col("k")), 9).alias("smooth"))


@query("dynamic_hier_base", over(EVENTS, """
  , p AS (SELECT event_id, 0.2::DOUBLE * 0.7::DOUBLE + 0.2::DOUBLE * 0.3::DOUBLE AS prior, n, s, 60.0::DOUBLE * (1 + 2 * abs(coalesce(rate, 0.2::DOUBLE) - 0.2::DOUBLE)) AS k FROM ev), q AS (SELECT event_id, (s + k * prior) / (n + k) AS post, n + k AS m FROM p)
  SELECT event_id, post, sqrt(post * (1 - post) / (m + 1)) AS posterior_sd FROM q"""))
def dynamic_hier_base(spark, d):
    """Posterior mean and standard deviation of a beta posterior whose strength follows volatility."""
    k = F.lit(60.0) * (1 + 2 * F.abs(F.coalesce("rate", F.lit(0.2)) - F.lit(0.2)))
    p = events(spark, d).withColumn("k", k).withColumn("prior", F.lit(0.2) * F.lit(0.7) + F.lit(0.2) * F.lit(0.3))
    p = p.select("event_id", ((F.col("s") + F.col("k") * F.col("prior")) / (F.col("n") + F.col("k"))).alias("post"), (F.col("n") + F.col("k")).alias("m"))
    return p.select("event_id", "post", F.sqrt(F.col("post") * (1 - F.col("post")) / (F.col("m") + 1)).alias("posterior_sd"))


_BLEND = ((10, 0.35), (30, 0.25), (50, 0.15), (100, 0.15), (300, 0.10))


@query("beta_blend", over(EVENTS, " SELECT event_id, " + " + ".join(f"{w}::DOUBLE * ((s + {k}.0::DOUBLE * 0.2::DOUBLE) / (n + {k}.0::DOUBLE))" for k, w in _BLEND) + " AS blend FROM ev"))
def beta_blend(spark, d):
    return events(spark, d).select("event_id", reduce(lambda a, b: a + b, [F.lit(w) * eb("s", "n", 0.2, k) for k, w in _BLEND]).alias("blend"))


@query("strict_prev_prior", over(ITEMS, """
  , g AS (SELECT kind, season, sum(y)::BIGINT AS t, count(*) AS n FROM items WHERE NOT (kind = 'F' AND season = 1998) GROUP BY ALL), a AS (SELECT DISTINCT season FROM items), k AS (SELECT DISTINCT kind FROM items),
  w AS (SELECT a.season, sum(t)::BIGINT / sum(n)::BIGINT AS p FROM a JOIN g ON g.season < a.season GROUP BY a.season)
  SELECT k.kind, a.season, coalesce(CASE WHEN g.n > 0 THEN g.t / g.n END, w.p) AS prior FROM a CROSS JOIN k LEFT JOIN g ON g.kind = k.kind AND g.season = a.season - 1 LEFT JOIN w ON w.season = a.season"""))
def strict_prev_prior(spark, d):
    """The rate of the previous season by kind, or of everything before if there is none."""
    it = items(spark, d)
    g = A.grouped(it.filter("not (kind = 'F' and season = 1998)"), ["kind", "season"])
    grid = it.select("season").distinct().crossJoin(it.select("kind").distinct())  # a few seasons and kinds
    league = g.groupBy("season").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    league = it.select("season").distinct().join(league, "season", "left").na.fill(0).withColumn("all", F.lit(0))
    before = asof.prefix(league, ["all"], ["season"], ["total", "n"]).select("season", rate("total_before", "n_before").alias("before"))
    last = g.select("kind", (F.col("season") + 1).alias("season"), rate("total", "n").alias("last"))
    return grid.join(last, ["kind", "season"], "left").join(before, "season").select("kind", "season", F.coalesce("last", "before").alias("prior"))


_CLASSES = ["click", "error", "purchase", "signup", "view"]


@query("class_posterior", over(EVENTS, ", a AS (SELECT " + ", ".join(f"count(*) FILTER (event_type = '{t}') / count(*) AS a_{t}" for t in _CLASSES) + " FROM ev) SELECT user_id, season, count(*) AS n, " + ", ".join(
    f"(count(*) FILTER (event_type = '{t}') + 200.0::DOUBLE * a_{t}) / (count(*) + 200.0::DOUBLE) AS p_{t}" for t in _CLASSES) + " FROM ev, a GROUP BY user_id, season, " + ", ".join(f"a_{t}" for t in _CLASSES)))
def class_posterior(spark, d):
    return S.class_posterior(events(spark, d), ["user_id", "season"], "event_type", _CLASSES, 200)


@query("binned_group_effect", over(EVENTS, """
  , b AS (SELECT event_id, season, y, coalesce(CAST(floor(rate / 0.05) AS INT), -1) AS bin FROM ev), t AS (SELECT bin, sum(5 * y - 1)::BIGINT AS e, count(*) AS n FROM b WHERE season < 3 GROUP BY bin)
  SELECT event_id, bin, coalesce(e / (n + 100.0::DOUBLE), 0) AS effect FROM b LEFT JOIN t USING (bin) WHERE season >= 3"""))
def binned_group_effect(spark, d):
    """Effect by bins of 0.05 of the as-of rate; no history is bin -1."""
    b = events(spark, d).select("event_id", "season", (F.col("y") * 5 - 1).alias("e"), F.coalesce(F.floor(F.col("rate") / 0.05).cast("int"), F.lit(-1)).alias("bin"))
    t = S.residual_eb(b.filter("season < 3"), ["bin"], "e", 100, "effect").drop("n")
    return attach(b.filter("season >= 3"), t, ["bin"], {"effect": 0.0}).select("event_id", "bin", "effect")


@query("runner_differential", over(ITEMS, """
  , r AS (SELECT *, y * 4 - 1 AS e FROM items WHERE season < 2000), p AS (SELECT supplier, sum(e)::BIGINT / (count(*) + 300.0::DOUBLE) AS v FROM r GROUP BY supplier)
  SELECT supplier, cnt, (sum(e)::BIGINT + 150.0::DOUBLE * p.v) / (count(*) + 150.0::DOUBLE) - p.v AS effect FROM r JOIN p USING (supplier) GROUP BY supplier, cnt, p.v"""))
def runner_differential(spark, d):
    """The child's shrunk residual minus the parent's; the parent itself is not added."""
    r = items(spark, d).filter("season < 2000").withColumn("e", F.col("y") * 4 - 1)
    child = r.groupBy("supplier", "cnt").agg(F.sum("e").alias("total"), F.count(F.lit(1)).alias("n"))
    parent = child.groupBy("supplier").agg(F.sum("total").alias("t"), F.sum("n").alias("m")).select("supplier", (F.col("t") / (F.col("m") + F.lit(300.0))).alias("v"))
    return child.join(parent, "supplier").select("supplier", "cnt", (eb("total", "n", F.col("v"), 150) - F.col("v")).alias("effect"))


@query("semantic_delta", over(EVENTS, ", u AS (SELECT user_id, count(*) AS un, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS u_{t}" for t in _CLASSES) + " FROM ev WHERE season < 3 GROUP BY user_id), c AS (SELECT user_id, k % 4 AS ctx, count(*) AS cn, " + ", ".join(
    f"count(*) FILTER (event_type = '{t}') AS c_{t}" for t in _CLASSES) + " FROM ev WHERE season < 3 GROUP BY ALL) SELECT e.event_id, " + ", ".join(
    f"coalesce((c_{t} + 80.0::DOUBLE * (u_{t} / un)) / (cn + 80.0::DOUBLE) - u_{t} / un, 0) AS d_{t}" for t in _CLASSES) + " FROM ev e LEFT JOIN u USING (user_id) LEFT JOIN c ON c.user_id = e.user_id AND c.ctx = e.k % 4 WHERE season >= 3"))
def semantic_delta(spark, d):
    """Class posterior of user and context minus that of the user; unseen contexts are 0 exactly."""
    ev = events(spark, d).withColumn("ctx", F.col("k") % 4)
    past = ev.filter("season < 3")
    count = lambda p: [F.count(F.when(F.col("event_type") == t, 1)).alias(f"{p}_{t}") for t in _CLASSES]
    u = past.groupBy("user_id").agg(F.count(F.lit(1)).alias("un"), *count("u"))
    c = past.groupBy("user_id", "ctx").agg(F.count(F.lit(1)).alias("cn"), *count("c")).join(u, "user_id")
    delta = c.select("user_id", "ctx", *[(eb(f"c_{t}", "cn", F.col(f"u_{t}") / F.col("un"), 80) - F.col(f"u_{t}") / F.col("un")).alias(f"d_{t}") for t in _CLASSES])
    return attach(ev.filter("season >= 3"), delta, ["user_id", "ctx"], {f"d_{t}": 0.0 for t in _CLASSES}).select("event_id", *[f"d_{t}" for t in _CLASSES])


@query("selection_outcome_mixture", over(ITEMS, """
  , s AS (SELECT supplier, hand, cnt, count(*) AS n FROM items GROUP BY ALL), st AS (SELECT supplier, hand, sum(n)::BIGINT AS m FROM s GROUP BY ALL), o AS (SELECT supplier, cnt, (sum(y) + 50.0::DOUBLE * 0.25::DOUBLE) / (count(*) + 50.0::DOUBLE) AS p FROM items GROUP BY ALL)
  SELECT supplier, hand, round(sum(n / m * p), 9) AS expected FROM s JOIN st USING (supplier, hand) JOIN o USING (supplier, cnt) GROUP BY ALL"""))
def selection_outcome_mixture(spark, d):
    """Sum over types of P(type | supplier, hand) and the supplier's shrunk outcome of the type."""
    it = items(spark, d)
    s = it.groupBy("supplier", "hand", "cnt").agg(F.count(F.lit(1)).alias("n")).withColumn("m", F.sum("n").over(Window.partitionBy("supplier", "hand")))
    o = A.grouped(it, ["supplier", "cnt"]).select("supplier", "cnt", eb("total", "n", 0.25, 50).alias("p"))
    return s.join(o, ["supplier", "cnt"]).groupBy("supplier", "hand").agg(F.round(F.sum(F.col("n") / F.col("m") * F.col("p")), 9).alias("expected"))
