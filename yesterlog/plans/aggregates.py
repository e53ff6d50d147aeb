"""Group aggregates: rates, profiles, quantiles, pivots, moments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import rate
from ..operators import aggregate as A
from ..operators.ranked import running
from .registry import EVENTS, ITEMS, events, items, over, query, table


@query("grouped_rates", over(ITEMS, "SELECT supplier, season, sum(y)::BIGINT AS total, count(*) AS n, sum(y) / count(*) AS rate FROM items GROUP BY ALL"))
def grouped_rates(spark, d):
    return A.rates(items(spark, d), ["supplier", "season"])


@query("breakdown_having", over(ITEMS, "SELECT part, sum(y)::BIGINT AS total, count(*) AS n, sum(y) / count(*) AS rate FROM items GROUP BY part HAVING count(*) >= 30"))
def breakdown_having(spark, d):
    return A.rates(items(spark, d), ["part"], least=30)


@query("nkey_rates", over(ITEMS, "SELECT season, month, kind, hand, sum(y)::BIGINT AS total, count(*) AS n, sum(y) / count(*) AS rate FROM items GROUP BY ALL"))
def nkey_rates(spark, d):
    return A.rates(items(spark, d), ["season", "month", "kind", "hand"])


@query("hierarchy_levels", over(ITEMS, """
  , f AS (SELECT kind, supplier, hand, sum(y)::BIGINT AS total, count(*) AS n FROM items GROUP BY ALL)
  SELECT 'kind' AS level, kind, NULL::BIGINT AS supplier, NULL::INT AS hand, sum(total)::BIGINT AS total, sum(n)::BIGINT AS n FROM f GROUP BY kind
  UNION ALL SELECT 'supplier', kind, supplier, NULL, sum(total)::BIGINT, sum(n)::BIGINT FROM f GROUP BY kind, supplier
  UNION ALL SELECT 'hand', kind, supplier, hand, total, n FROM f"""))
def hierarchy_levels(spark, d):
    names, out = ["kind", "supplier", "hand"], None
    for name, t in zip(names, A.levels(items(spark, d), [["kind"], ["kind", "supplier"], ["kind", "supplier", "hand"]]), strict=True):
        t = t.select(F.lit(name).alias("level"), "kind", *[F.col(c) if c in t.columns else F.lit(None).cast("long" if c == "supplier" else "int").alias(c) for c in ("supplier", "hand")], "total", "n")
        out = t if out is None else out.unionByName(t)
    return out


@query("column_profile", """
  WITH s AS (SELECT 'value' AS column, value AS x FROM events UNION ALL SELECT 'user_id', user_id FROM events UNION ALL SELECT 'k', CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM events)
  SELECT "column", avg(CAST(x IS NULL AS INT)) AS missing, count(DISTINCT x) AS "distinct", min(x) AS least, max(x) AS most, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, quantile_cont(x, 0.5) AS median FROM s GROUP BY 1""")
def column_profile(spark, d):
    return A.profile(events(spark, d).select("value", "user_id", "k"), ["value", "user_id", "k"])


@query("count_distinct_keys", over(ITEMS, "SELECT season, count(DISTINCT supplier) AS suppliers, count(DISTINCT part) AS parts FROM items GROUP BY season"))
def count_distinct_keys(spark, d):
    return items(spark, d).groupBy("season").agg(F.count_distinct("supplier").alias("suppliers"), F.count_distinct("part").alias("parts"))


@query("value_counts_norm", "SELECT event_type, count(*) AS n, count(*) / (SELECT count(*) FROM events) AS share FROM events GROUP BY event_type")
def value_counts_norm(spark, d):
    return A.value_counts(table(spark, d, "events"), "event_type")


@query("quantiles", "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.9), 6) AS q90 FROM events GROUP BY event_type")
def quantiles(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(*[F.round(F.percentile("value", F.lit(q)), 6).alias(f"q{round(q * 100)}") for q in (0.25, 0.5, 0.9)])


@query("histogram_fixed", "SELECT CAST(least(29, floor(value / 10)) AS INT) AS bin, count(*) AS n FROM events WHERE value >= 0 AND value <= 300 GROUP BY 1")
def histogram_fixed(spark, d):
    """30 bins over [0, 300]; the last one is closed on the right too."""
    inside = table(spark, d, "events").filter(F.col("value").between(0, 300))
    return inside.groupBy(F.least(F.lit(29), F.floor(F.col("value") / 10)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("lorenz_share", over(ITEMS, """
  , g AS (SELECT supplier, count(*) AS n FROM items GROUP BY supplier)
  SELECT supplier, n, row_number() OVER w AS place, sum(n) OVER w / (SELECT count(*) FROM items) AS cumulative FROM g WINDOW w AS (ORDER BY n DESC, supplier ROWS UNBOUNDED PRECEDING)"""))
def lorenz_share(spark, d):
    """Cumulative share of rows by supplier, largest first; suppliers are ranked by ranges of their size."""
    g = items(spark, d).groupBy("supplier").agg(F.count(F.lit(1)).alias("n"))
    ranked = running(g.withColumn("down", -F.col("n")), [], ["down", "supplier"], {"place": F.lit(1), "before": "n"})
    total = g.agg(F.sum("n").alias("total"))
    return ranked.crossJoin(F.broadcast(total)).select("supplier", "n", (F.col("place") + 1).cast("int").alias("place"), ((F.col("before") + F.col("n")) / F.col("total")).alias("cumulative"))


@query("group_mode", over(ITEMS, """
  , v AS (SELECT supplier, kind, cnt, count(*) AS votes FROM items GROUP BY ALL)
  SELECT supplier, kind, cnt, votes, of_all FROM (SELECT *, sum(votes) OVER (PARTITION BY supplier, kind)::BIGINT AS of_all, row_number() OVER (PARTITION BY supplier, kind ORDER BY votes DESC, cnt) AS k FROM v) WHERE k = 1"""))
def group_mode(spark, d):
    return A.mode_by(items(spark, d), ["supplier", "kind"], "cnt")


@query("first_last_row", over(EVENTS, "SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type, arg_max(value, event_id) AS last_value FROM ev GROUP BY user_id"))
def first_last_row(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"), F.max_by("event_type", "event_id").alias("last_type"), F.max_by("value", "event_id").alias("last_value"))


@query("zero_share_by_group", over(ITEMS, "SELECT supplier, avg(CAST(pct = 0 AS INT)) AS zero_share FROM items GROUP BY supplier"))
def zero_share_by_group(spark, d):
    return items(spark, d).groupBy("supplier").agg(F.avg((F.col("pct") == 0).cast("int")).alias("zero_share"))


@query("moment_cov", over(ITEMS, """
  , m AS (SELECT supplier, count(*) AS n, sum(qty)::BIGINT AS sx, sum(pct)::BIGINT AS sy, sum(qty * qty)::BIGINT AS sxx, sum(pct * pct)::BIGINT AS syy, sum(qty * pct)::BIGINT AS sxy FROM items GROUP BY supplier),
  c AS (SELECT supplier, n, (sxx - sx * sx / n) / (n - 1) AS vx, (syy - sy * sy / n) / (n - 1) AS vy, (sxy - sx * sy / n) / (n - 1) AS cxy FROM m WHERE n > 1)
  SELECT supplier, n, round(vx, 6) AS vx, round(vy, 6) AS vy, round(cxy, 6) AS cxy, round(vx * vy - cxy * cxy, 4) AS det,
    round((vx + vy) / 2 + sqrt((vx - vy) * (vx - vy) / 4 + cxy * cxy), 6) AS eigen1, round((vx + vy) / 2 - sqrt((vx - vy) * (vx - vy) / 4 + cxy * cxy), 6) AS eigen2 FROM c"""))
def moment_cov(spark, d):
    """2 x 2 covariance of quantity and discount by supplier, from sums alone."""
    m = items(spark, d).groupBy("supplier").agg(*A.moments(F.col("qty"), F.col("pct").cast("long"))).filter("n > 1")
    cov = lambda s, a, b: (F.col(s) - F.col(a) * F.col(b) / F.col("n")) / (F.col("n") - 1)
    c = m.select("supplier", "n", cov("sxx", "sx", "sx").alias("vx"), cov("syy", "sy", "sy").alias("vy"), cov("sxy", "sx", "sy").alias("cxy"))
    mid, half = F.expr("(vx + vy) / 2"), F.sqrt(F.expr("(vx - vy) * (vx - vy) / 4 + cxy * cxy"))
    return c.select("supplier", "n", *[F.round(x, 6).alias(x) for x in ("vx", "vy", "cxy")], F.round(F.expr("vx * vy - cxy * cxy"), 4).alias("det"), F.round(mid + half, 6).alias("eigen1"), F.round(mid - half, 6).alias("eigen2"))


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("class_count_pivot", "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS n_{t}" for t in _TYPES) + " FROM events GROUP BY user_id")
def class_count_pivot(spark, d):
    return A.class_counts(table(spark, d, "events"), ["user_id"], "event_type", _TYPES)


@query("pivot_rate_by_season", over(ITEMS, """SELECT supplier, avg(y) FILTER (season = 1999) AS rate_1999, avg(y) FILTER (season = 2000) AS rate_2000,
  avg(y) FILTER (season = 2000) - avg(y) FILTER (season = 1999) AS change FROM items GROUP BY supplier"""))
def pivot_rate_by_season(spark, d):
    p = items(spark, d).groupBy("supplier").pivot("season", [1999, 2000]).agg(F.avg("y"))
    return p.select("supplier", F.col("1999").alias("rate_1999"), F.col("2000").alias("rate_2000"), (F.col("2000") - F.col("1999")).alias("change"))


@query("crosstab_norm", over(ITEMS, "SELECT season, count(*) FILTER (kind = 'F') / count(*) AS share_f, count(*) FILTER (kind = 'O') / count(*) AS share_o FROM items GROUP BY season"))
def crosstab_norm(spark, d):
    c = A.class_counts(items(spark, d), ["season"], "kind", ["F", "O"])
    total = F.col("n_F") + F.col("n_O")
    return c.select("season", rate("n_F", total).alias("share_f"), rate("n_O", total).alias("share_o"))


@query("joint_profile", over(ITEMS, "SELECT kind, hand, cnt, count(*) AS n, avg(y) AS rate, avg(CAST(pct > 5 AS INT)) AS high_discount FROM items GROUP BY ALL"))
def joint_profile(spark, d):
    return items(spark, d).groupBy("kind", "hand", "cnt").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"), F.avg((F.col("pct") > 5).cast("int")).alias("high_discount"))


@query("weighted_mean", over(ITEMS, "SELECT season, sum(qty * pct)::BIGINT / sum(qty)::BIGINT AS weighted_discount, sum(y * qty)::BIGINT / sum(qty)::BIGINT AS weighted_rate FROM items GROUP BY season"))
def weighted_mean(spark, d):
    total = F.sum("qty")
    return items(spark, d).groupBy("season").agg(rate(F.sum(F.col("qty") * F.col("pct")), total).alias("weighted_discount"), rate(F.sum(F.col("y") * F.col("qty")), total).alias("weighted_rate"))


@query("dense_keyed_sums", over(ITEMS, "SELECT (season - 1995) * 24 + (month - 1) * 2 + hand AS cell, sum(y)::BIGINT AS total, count(*) AS n, sum(cents)::BIGINT AS cents FROM items GROUP BY 1"))
def dense_keyed_sums(spark, d):
    cell = ((F.col("season") - 1995) * 24 + (F.col("month") - 1) * 2 + F.col("hand")).alias("cell")
    return items(spark, d).groupBy(cell).agg(F.sum("y").alias("total"), F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@query("group_centered_residual", over(EVENTS, """
  , c AS (SELECT event_id, user_id, season, y - avg(y) OVER (PARTITION BY season) AS residual FROM ev)
  SELECT user_id, count(*) AS n, round(sum(residual), 6) AS residual FROM c GROUP BY user_id"""))
def group_centered_residual(spark, d):
    return A.centred(events(spark, d), ["season"], "y", "residual").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("residual"), 6).alias("residual"))


@query("vote_purity", over(ITEMS, """
  , v AS (SELECT part, supplier, count(*) AS votes FROM items GROUP BY ALL)
  SELECT part, supplier, votes, of_all, votes / of_all AS purity FROM (SELECT *, sum(votes) OVER (PARTITION BY part)::BIGINT AS of_all, row_number() OVER (PARTITION BY part ORDER BY votes DESC, supplier) AS k FROM v) WHERE k = 1"""))
def vote_purity(spark, d):
    return A.mode_by(items(spark, d), ["part"], "supplier").withColumn("purity", rate("votes", "of_all"))


@query("between_group_variance", over(ITEMS, """
  , g AS (SELECT season, supplier, avg(y) AS r, count(*) AS n FROM items GROUP BY ALL)
  SELECT season, count(*) AS groups, round(var_samp(r), 9) AS observed, round(avg(r * (1 - r) / n), 9) AS binomial, round(var_samp(r) - avg(r * (1 - r) / n), 9) AS true_variance FROM g GROUP BY season"""))
def between_group_variance(spark, d):
    g = items(spark, d).groupBy("season", "supplier").agg(F.avg("y").alias("r"), F.count(F.lit(1)).alias("n"))
    observed, binomial = F.var_samp("r"), F.avg(F.col("r") * (1 - F.col("r")) / F.col("n"))
    return g.groupBy("season").agg(F.count(F.lit(1)).alias("groups"), F.round(observed, 9).alias("observed"), F.round(binomial, 9).alias("binomial"), F.round(observed - binomial, 9).alias("true_variance"))


@query("cell_sse_gate", over(ITEMS, """
  , r AS (SELECT *, y - avg(y) OVER (PARTITION BY season) AS e FROM items),
  c AS (SELECT season, supplier, count(*) AS n, sum(e) AS se, sum(e * e) AS see FROM r GROUP BY ALL)
  SELECT season, round(sum(se * se / n), 6) AS explained, round((count(*) - 1) * (sum(see) / sum(n)), 6) AS null_expectation, count(*) AS cells FROM c GROUP BY season"""))
def cell_sse_gate(spark, d):
    """Squared residual that supplier cells explain, and what as many random cells would."""
    r = A.centred(items(spark, d), ["season"], "y", "e")
    c = r.groupBy("season", "supplier").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("se"), F.sum(F.col("e") * F.col("e")).alias("see"))
    null = (F.count(F.lit(1)) - 1) * (F.sum("see") / F.sum("n"))
    return c.groupBy("season").agg(F.round(F.sum(F.col("se") * F.col("se") / F.col("n")), 6).alias("explained"), F.round(null, 6).alias("null_expectation"), F.count(F.lit(1)).alias("cells"))


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("rollup_rates", over(ITEMS, "SELECT kind, season, sum(y)::BIGINT AS total, count(*) AS n FROM items GROUP BY ROLLUP (kind, season)"))
def rollup_rates(spark, d):
    return items(spark, d).rollup("kind", "season").agg(F.sum("y").alias("total"), F.count(F.lit(1)).alias("n"))


@query("grouping_sets_rates", over(ITEMS, "SELECT kind, hand, cnt, sum(y)::BIGINT AS total, count(*) AS n FROM items GROUP BY GROUPING SETS ((kind, hand), (cnt), ())"))
def grouping_sets_rates(spark, d):
    sets = [[F.col("kind"), F.col("hand")], [F.col("cnt")], []]
    return items(spark, d).groupingSets(sets, "kind", "hand", "cnt").agg(F.sum("y").alias("total"), F.count(F.lit(1)).alias("n"))


@query("approx_distinct")
def approx_distinct(spark, d):
    return items(spark, d).groupBy("season").agg(F.approx_count_distinct("part", 0.02).alias("parts"))
