"""Keyed joins: lookups with defaults and coverage, one-to-one, semi and anti, as-of by season, codes, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import eb, rate
from ..operators import aggregate as A
from ..operators import asof
from ..operators import lookup as L
from ..operators.ranked import running
from .registry import EVENTS, ITEMS, events, items, over, query, table


@query("lookup_default_coverage", over(ITEMS, """
  , t AS (SELECT supplier, kind, sum(y)::BIGINT AS total, count(*) AS n FROM items WHERE season < 1999 GROUP BY ALL HAVING count(*) >= 40)
  SELECT i.season, count(*) AS n, avg(CAST(t.n IS NOT NULL AS INT)) AS coverage, sum(coalesce(t.total, 0))::BIGINT AS looked_up FROM items i LEFT JOIN t USING (supplier, kind) WHERE season >= 1999 GROUP BY i.season"""))
def lookup_default_coverage(spark, d):
    it = items(spark, d)
    frozen = A.grouped(it.filter("season < 1999"), ["supplier", "kind"]).filter("n >= 40").drop("n")
    out = L.attach(it.filter("season >= 1999"), frozen, ["supplier", "kind"], {"total": 0}, check=True)
    return out.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.avg("seen").alias("coverage"), F.sum("total").alias("looked_up"))


@query("map_lookup_fallback", over(EVENTS, "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE -1 END AS code FROM ev"))
def map_lookup_fallback(spark, d):
    codes = F.create_map(*[F.lit(x) for kv in {"click": 1, "view": 2, "purchase": 3}.items() for x in kv])
    return events(spark, d).select("event_id", F.coalesce(F.try_element_at(codes, F.col("event_type")), F.lit(-1)).alias("code"))


@query("key_cardinality", "SELECT 'orders' AS name, count(*) FILTER (c > 1) AS repeated, count(*) AS keys FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderkey) UNION ALL SELECT 'lineitem', count(*) FILTER (c > 1), count(*) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def key_cardinality(spark, d):
    def of(name, keys):
        c = table(spark, d, name).groupBy(*keys).count()
        return c.agg(F.lit(name).alias("name"), F.count(F.when(F.col("count") > 1, 1)).alias("repeated"), F.count(F.lit(1)).alias("keys"))

    return of("orders", ["o_orderkey"]).unionByName(of("lineitem", ["l_orderkey", "l_linenumber"]))


@query("inner_join_rates", """SELECT n_name, c_mktsegment, count(*) AS orders, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def inner_join_rates(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


@query("one_to_one_key_join", """
  WITH a AS (SELECT o_custkey AS k, CAST(month(o_orderdate) AS INT) AS m, o_orderkey AS left_id FROM orders WHERE o_orderstatus = 'F'),
  b AS (SELECT o_custkey AS k, CAST(month(o_orderdate) AS INT) AS m, o_orderkey AS right_id FROM orders WHERE o_orderstatus = 'O')
  SELECT k, m, left_id, right_id FROM (SELECT *, count(*) OVER (PARTITION BY k, m) AS c FROM a) a JOIN (SELECT *, count(*) OVER (PARTITION BY k, m) AS e FROM b) b USING (k, m) WHERE c = 1 AND e = 1""")
def one_to_one_key_join(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", F.col("o_custkey").alias("k"), F.month("o_orderdate").alias("m"), "o_orderkey")
    a, b = (o.filter(F.col("o_orderstatus") == s).select("k", "m", F.col("o_orderkey").alias(n)) for s, n in (("F", "left_id"), ("O", "right_id")))
    return L.one_to_one(a, b, ["k", "m"])


@query("semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_join(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("anti_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def anti_join(spark, d):
    o = table(spark, d, "orders").filter(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


_PAST = """
  , g AS (SELECT supplier, season, sum(y)::BIGINT AS total, count(*) AS n FROM items GROUP BY ALL),
  p AS (SELECT supplier, season, coalesce(sum(total) OVER w, 0)::BIGINT AS t, coalesce(sum(n) OVER w, 0)::BIGINT AS m FROM g WINDOW w AS (PARTITION BY supplier ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  lg AS (SELECT season, sum(total)::BIGINT AS total, sum(n)::BIGINT AS n FROM g GROUP BY season),
  lp AS (SELECT season, coalesce(sum(total) OVER w, 0)::BIGINT AS lt, coalesce(sum(n) OVER w, 0)::BIGINT AS ln FROM lg WINDOW w AS (ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def past_rates(spark, d):
    """supplier, season, shrunk: the supplier's rate in earlier seasons shrunk to the league's, NULL in the first season."""
    g = A.grouped(items(spark, d), ["supplier", "season"])
    own = asof.prefix(g, ["supplier"], ["season"], ["total", "n"])
    league = g.groupBy("season").agg(F.sum("total").alias("lt"), F.sum("n").alias("ln"))
    # one row a season: the window needs one task, but has no more rows than there are seasons
    league = asof.prefix(league.withColumn("all", F.lit(0)), ["all"], ["season"], ["lt", "ln"]).select("season", rate("lt_before", "ln_before").alias("prior"))
    return own.join(F.broadcast(league), "season").select("supplier", "season", F.col("n_before").alias("past_n"), eb("total_before", "n_before", F.col("prior"), 200).alias("shrunk"))


@query("asof_season_join", over(ITEMS, _PAST + """
  SELECT supplier, season, m AS past_n, (t + 200.0::DOUBLE * (CASE WHEN ln > 0 THEN lt / ln END)) / (m + 200.0::DOUBLE) AS shrunk FROM p JOIN lp USING (season)"""))
def asof_season_join(spark, d):
    return past_rates(spark, d)


@query("strict_past_flagship", over(ITEMS, _PAST + """
  , sc AS (SELECT season, y, (t + 200.0::DOUBLE * (CASE WHEN ln > 0 THEN lt / ln END)) / (m + 200.0::DOUBLE) AS q FROM items JOIN p USING (supplier, season) JOIN lp USING (season))
  SELECT season, count(q) AS n, round(avg((q - y) * (q - y)), 9) AS brier, round(100000 * (1 - avg((q - y) * (q - y)) / (avg(y) * (1 - avg(y)))), 3) AS skill FROM sc WHERE q IS NOT NULL GROUP BY season"""))
def strict_past_flagship(spark, d):
    """Supplier rates of earlier seasons, shrunk to the league's, scored in the season itself."""
    from ..operators.score import brier, skill

    scored = items(spark, d).select("supplier", "season", "y").join(past_rates(spark, d), ["supplier", "season"]).filter("shrunk is not null")
    return scored.groupBy("season").agg(F.count("shrunk").alias("n"), F.round(brier("shrunk", "y"), 9).alias("brier"), F.round(skill("shrunk", "y"), 3).alias("skill"))


@query("asof_range_join", """
  WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'O'), p AS (SELECT o_custkey, o_orderdate, CAST(round(max(o_totalprice) * 100) AS BIGINT) AS cents FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
  SELECT o.o_orderkey, p.cents FROM o ASOF LEFT JOIN p ON o.o_custkey = p.o_custkey AND o.o_orderdate > p.o_orderdate""")
def asof_range_join(spark, d):
    """For each open order the customer's latest finished order strictly before it."""
    o = table(spark, d, "orders")
    left = o.filter("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_orderdate")
    right = o.filter("o_orderstatus = 'F'").groupBy("o_custkey", "o_orderdate").agg(F.round(F.max("o_totalprice") * 100).cast("long").alias("cents"))
    return asof.asof_join(left, right, ["o_custkey"], "o_orderdate", ["cents"]).select("o_orderkey", "cents")


@query("snapshot_replay", over(EVENTS, """, e AS (SELECT user_id, season, max(n + 1) AS cum_n, max(s + y) AS cum_s FROM ev GROUP BY ALL)
  SELECT ev.event_id, coalesce(e.cum_n, 0) AS n_start, coalesce(e.cum_s, 0) AS s_start, ev.n - coalesce(e.cum_n, 0) AS n_since FROM ev ASOF LEFT JOIN e ON ev.user_id = e.user_id AND ev.season > e.season"""))
def snapshot_replay(spark, d):
    """Each event with the user's state at the end of the latest earlier season in which there was one."""
    ev = events(spark, d)
    ends = ev.groupBy("user_id", "season").agg(F.max(F.col("n") + 1).alias("cum_n"), F.max(F.col("s") + F.col("y")).alias("cum_s"))
    out = asof.asof_join(ev.select("event_id", "user_id", "season", "n"), ends, ["user_id"], "season", ["cum_n", "cum_s"])
    start = F.coalesce("cum_n", F.lit(0))
    return out.select("event_id", start.alias("n_start"), F.coalesce("cum_s", F.lit(0)).alias("s_start"), (F.col("n") - start).alias("n_since"))


@query("cell_vs_entity_join", over(ITEMS, """
  , c AS (SELECT supplier, cnt, sum(y)::BIGINT AS total, count(*) AS n FROM items GROUP BY ALL), e AS (SELECT supplier, sum(total)::BIGINT AS st, sum(n)::BIGINT AS sn FROM c GROUP BY supplier)
  SELECT supplier, cnt, n, total / n - st / sn AS split FROM c JOIN e USING (supplier)"""))
def cell_vs_entity_join(spark, d):
    own, cell = A.levels(items(spark, d), [["supplier"], ["supplier", "cnt"]])
    own = own.select("supplier", rate("total", "n").alias("own"))
    return cell.join(own, "supplier").select("supplier", "cnt", "n", (rate("total", "n") - F.col("own")).alias("split"))


@query("order_preserving_attach", "SELECT o_orderkey, c_mktsegment, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders JOIN customer ON o_custkey = c_custkey")
def order_preserving_attach(spark, d):
    """Order is carried as a column: the attached rows keep the place they had among all orders, numbered by key ranges."""
    o = running(table(spark, d, "orders").select("o_orderkey", "o_custkey"), [], ["o_orderkey"], {"place": F.lit(1)})
    c = table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_mktsegment", "place")


@query("align_outputs", over(EVENTS, "SELECT a.event_id, 0.4::DOUBLE * (a.n + 1) + 0.6::DOUBLE * (b.s + 2) AS combined FROM ev a JOIN ev b USING (event_id)"))
def align_outputs(spark, d):
    """Two components' outputs joined by id, after both are found to have the same ids."""
    ev = events(spark, d)
    a, b = ev.select("event_id", (F.col("n") + 1).alias("a")), ev.select("event_id", (F.col("s") + 2).alias("b"))
    L.assert_same_ids(a, b, "event_id")
    return a.join(b, "event_id").select("event_id", (F.lit(0.4) * F.col("a") + F.lit(0.6) * F.col("b")).alias("combined"))


@query("vocabulary_normalise", "SELECT p_partkey, lower(left(p_type, 1)) AS initial, CASE WHEN p_brand LIKE 'Brand#%' THEN TRY_CAST(replace(p_brand, 'Brand#', '') AS INT) END AS brand_no, try_cast(p_size AS VARCHAR) AS size_text FROM part")
def vocabulary_normalise(spark, d):
    number = F.when(F.col("p_brand").like("Brand#%"), F.replace("p_brand", F.lit("Brand#"), F.lit("")).try_cast("int"))
    return table(spark, d, "part").select("p_partkey", F.lower(F.substring("p_type", 1, 1)).alias("initial"), number.alias("brand_no"), F.col("p_size").cast("string").alias("size_text"))


@query("factorize_codes", "WITH v AS (SELECT p_brand, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INT) AS code FROM (SELECT DISTINCT p_brand FROM part WHERE p_partkey % 2 = 0)) SELECT p_partkey, coalesce(code, -1) AS code FROM part LEFT JOIN v USING (p_brand)")
def factorize_codes(spark, d):
    """Codes learned from even parts, applied to all; unknown is -1."""
    part = table(spark, d, "part")
    return part.join(L.dictionary(part.filter("p_partkey % 2 = 0"), "p_brand"), "p_brand", "left").select("p_partkey", F.coalesce("code", F.lit(-1)).alias("code"))


@query("first_appearance_codes", over(EVENTS, """, f AS (SELECT event_type, min(event_id) AS e FROM ev WHERE season < 2 GROUP BY event_type), c AS (SELECT event_type, CAST(row_number() OVER (ORDER BY e) - 1 AS INT) AS code FROM f)
  SELECT event_id, coalesce(code, -1) AS code FROM ev LEFT JOIN c USING (event_type)"""))
def first_appearance_codes(spark, d):
    ev = events(spark, d)
    seen = ev.filter("season < 2").groupBy("event_type").agg(F.min("event_id").alias("e"))
    codes = seen.select("event_type", (F.row_number().over(Window.orderBy("e")) - 1).cast("int").alias("code"))
    return ev.join(codes, "event_type", "left").select("event_id", F.coalesce("code", F.lit(-1)).alias("code"))


@query("union_concat", over(ITEMS, "SELECT supplier, count(*) AS n FROM (SELECT supplier FROM items WHERE season = 1999 UNION ALL SELECT supplier FROM items WHERE season >= 1999) GROUP BY supplier"))
def union_concat(spark, d):
    it = items(spark, d).select("supplier", "season")
    return it.filter("season = 1999").unionByName(it.filter("season >= 1999")).groupBy("supplier").agg(F.count(F.lit(1)).alias("n"))


@query("key_intersection", over(ITEMS, "SELECT part FROM items WHERE season = 1996 INTERSECT SELECT part FROM items WHERE season = 2000"))
def key_intersection(spark, d):
    it = items(spark, d)
    return it.filter("season = 1996").select("part").intersect(it.filter("season = 2000").select("part"))


@query("key_difference", over(ITEMS, "SELECT part FROM items WHERE season = 1996 EXCEPT SELECT part FROM items WHERE season = 2000"))
def key_difference(spark, d):
    it = items(spark, d)
    return it.filter("season = 1996").select("part").subtract(it.filter("season = 2000").select("part"))


@query("full_grid_delta", over(ITEMS, """, g AS (SELECT supplier, hand, sum(y)::BIGINT AS t, count(*) AS n FROM items WHERE part < 200 GROUP BY ALL), e AS (SELECT DISTINCT supplier FROM items), grid AS (SELECT supplier, hand FROM e, (VALUES (0), (1)) v(hand))
  SELECT supplier, hand, coalesce(t, 0)::BIGINT AS total, coalesce(n, 0)::BIGINT AS n, coalesce((t - 0.3::DOUBLE * n) / (n + 50.0::DOUBLE), 0) AS delta FROM grid LEFT JOIN g USING (supplier, hand)"""))
def full_grid_delta(spark, d):
    """Every supplier with both hands; cells without rows have delta 0 exactly."""
    it = items(spark, d)
    grid = it.select("supplier").distinct().withColumn("hand", F.explode(F.array(F.lit(0), F.lit(1))))
    g = A.grouped(it.filter("part < 200"), ["supplier", "hand"])
    delta = (F.col("total") - F.lit(0.3) * F.col("n")) / (F.col("n") + F.lit(50.0))
    return grid.join(g, ["supplier", "hand"], "left").select("supplier", "hand", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(delta, F.lit(0.0)).alias("delta"))
