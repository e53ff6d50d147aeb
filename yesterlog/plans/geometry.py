"""What is known of blends beyond their weights: where unknown moments can lie, how far solutions hold, samples and draws that must be full."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import blend as B
from ..operators import model as M
from ..operators import score as K
from ..sources.io import keep
from .registry import items, over, query
from .scoring import _DRAWS, _PRED, predictions

#: The blend is half p and half q. A is a covariance with the outcome, B a variance, S a score; all are scaled to 100000 / var(y).
_KNOWN = {
    "a1": "covar_pop(p, y)", "b11": "var_pop(p)", "s2": "2 * covar_pop(q, y) - var_pop(q) - (avg(q) - 2e-1) * (avg(q) - 2e-1)",
    "sb": "covar_pop(p + q, y) - var_pop(p + q) / 4 - (avg(q) - 2e-1) * (avg(q) - 2e-1) / 4",
}
_REGION = {"m2": "2 * a - b - s2", "b12": "2 * a1 + a - b11 / 2 + s2 / 2 - 2 * sb"}
_INSIDE = "m2 >= 0 AND b12 * b12 <= b11 * b AND a * a <= b * 100000 AND b11 + 2 * b12 + b > 0"
_GAIN = "((a1 + a) / 2 - (b11 + 2 * b12 + b) / 4) * ((a1 + a) / 2 - (b11 + 2 * b12 + b) / 4) / ((b11 + 2 * b12 + b) / 4) + m2 / 4"


def _scaled() -> dict[str, str]:
    return {n: f"round(100000 * ({c}) / (avg(y) * (1 - avg(y))), 3)" for n, c in _KNOWN.items()}


@query("feasible_region", over(_PRED, ", kn AS (SELECT " + ", ".join(f"{c} AS {n}" for n, c in _scaled().items()) + f""" FROM pr), g AS (SELECT *, (i * 20)::DOUBLE AS a, (j * 20)::DOUBLE AS b FROM kn, (SELECT unnest(range(-100, 300)) AS i), (SELECT unnest(range(1, 400)) AS j)),
  r AS (SELECT *, {", ".join(f"{c} AS {n}" for n, c in _REGION.items())} FROM g) SELECT a, count(*) AS cells, min(b) AS low, max(b) AS high, round(min({_GAIN}), 4) AS least_gain, round(max({_GAIN}), 4) AS most_gain FROM r WHERE {_INSIDE} GROUP BY a"""))
def feasible_region(spark, d):
    """The second prediction's moments that fit its score, the blend's score and the inequalities of moments, as a scan of a grid of cells; one row of scores is known."""
    known = predictions(spark, d).agg(*[F.expr(c).alias(n) for n, c in _scaled().items()]).first()
    grid = spark.range(-100, 300).select((F.col("id") * 20).cast("double").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(399))).alias("j")).select("a", (F.col("j") * 20).cast("double").alias("b"), *[F.lit(known[n]).alias(n) for n in _KNOWN])
    cells = grid.withColumns({n: F.expr(c) for n, c in _REGION.items()}).filter(_INSIDE).withColumn("gain", F.expr(_GAIN))
    return cells.groupBy("a").agg(F.count(F.lit(1)).alias("cells"), F.min("b").alias("low"), F.max("b").alias("high"), F.round(F.min("gain"), 4).alias("least_gain"), F.round(F.max("gain"), 4).alias("most_gain"))


_GEOMETRY = "a1 double, a2 double, b12 double, b22 double, rate double, bias double, best_score double, feasible boolean, solved boolean"
#: Scores that are asked for: weight of the calibrated first prediction, weight of the second, shift.
_ASKED = {"first": (1, 0, 0), "second": (0, 1, 0), "half": (0.5, 0.5, 0), "below": (0, 1, -0.1), "above": (0, 1, 0.1), "low": (0.4, 0.4, 0), "high": (0.6, 0.7, 0.02), "mixed": (0.9, 0.3, -0.05)}


@query("exact_geometry", over(_PRED, """, m AS (SELECT avg(y) AS rate, 100000 / (avg(y) * (1 - avg(y))) AS scale, covar_pop(p, y) AS py, var_pop(p) AS pp, covar_pop(q, y) AS qy, covar_pop(p, q) AS pq, var_pop(q) AS qq, avg(q) AS mq FROM pr)
  SELECT round(scale * py * py / pp, 3) AS a1, round(scale * qy, 3) AS a2, round(scale * py / pp * pq, 3) AS b12, round(scale * qq, 3) AS b22, round(rate, 6) AS rate, round(mq - rate, 6) AS bias,
    round(scale * (py * py * qq - 2 * py * qy * pq + qy * qy * pp) / (pp * qq - pq * pq), 3) AS best_score, true AS feasible, true AS solved FROM m"""))
def exact_geometry(spark, d):
    """The moments of two predictions solved from eight scores of their blends, equal to those computed from the outcomes; one aggregation makes all scores."""
    pr = predictions(spark, d)
    m = pr.agg(F.avg("y").alias("r"), F.avg("p").alias("mp"), (F.covar_pop("p", "y") / F.nullif(F.var_pop("p"), F.lit(0.0))).alias("slope")).first()
    if m.slope is None or not 0 < m.r < 1:
        return spark.createDataFrame([], _GEOMETRY)
    calibrated = F.lit(m.r) + F.lit(m.slope) * (F.col("p") - F.lit(m.mp))
    # as the gain over the base rate of all rows, which keeps digits
    square = lambda x: (x - F.col("y")) * (x - F.col("y"))
    gain = lambda u, v, c: 100000 * F.avg(square(F.lit(m.r)) - square(u * calibrated + v * F.col("q") + c)) / F.lit(m.r * (1 - m.r))
    s = pr.agg(*[gain(*map(F.lit, map(float, w))).alias(n) for n, w in _ASKED.items()]).first()
    out = B.exact_geometry(s["first"], s.second, s.half, s.below, s.above, 0.1, [(*_ASKED[n], s[n]) for n in ("low", "high", "mixed")])
    if out is None:
        return spark.createDataFrame([], _GEOMETRY)
    digits = {"rate": 6, "bias": 6}
    row = [round(out[n], digits.get(n, 3)) for n in ("a1", "a2", "b12", "b22", "rate", "bias", "best_score")]
    return spark.createDataFrame([(*row, out["feasible"], out["residual"] < 1e-9)], _GEOMETRY)


@query("span_stress")
def span_stress(spark, d):
    """Weights of three directions on the whole, in the box, without one of them, and from every three tenths of the rows; each is scored on the whole.

    The rows are summed once into a Gram matrix for each of ten hashed parts; a subset's matrix is the sum of its parts'.
    """
    names = ["a", "b", "c"]
    rows = predictions(spark, d).select((B.hash_order(F.col("event_id")) % 10).alias("part"), (F.col("p") - F.lit(0.2)).alias("a"), (F.col("q") - F.lit(0.2)).alias("b"), (F.col("seg") * F.lit(0.01)).alias("c"), (F.col("y") - F.lit(0.2)).alias("t"))
    parts = B.grams(rows, "part", names, "t")
    return spark.createDataFrame(B.stress(parts, names), "how string, without string, a double, b double, c double, score double")


@query("stratified_exact", over(_PRED, """, s AS (SELECT event_id, season, y, (event_id + 1) * 48271 % 2147483647 AS h, row_number() OVER (PARTITION BY season, y ORDER BY (event_id + 1) * 48271 % 2147483647, event_id) AS j FROM pr),
  g AS (SELECT season, count(DISTINCT y) AS strata FROM pr GROUP BY season), o AS (SELECT s.*, row_number() OVER (PARTITION BY season ORDER BY CAST(j > 400 // strata AS INT), h, event_id) AS place FROM s JOIN g USING (season))
  SELECT event_id, season, y FROM o WHERE place <= 400"""))
def stratified_exact(spark, d):
    """Exactly 400 events of each season (all, if there are fewer): an equal share of each outcome in the order of a hash, filled up in that order.

    No stratum can give more than 400, so Spark keeps 400 a partition before the shuffle and the second window sees as many a stratum.
    """
    pr = predictions(spark, d).select("event_id", "season", "y", B.hash_order(F.col("event_id")).alias("h"))
    first = pr.withColumn("j", F.row_number().over(Window.partitionBy("season", "y").orderBy("h", "event_id"))).filter("j <= 400")
    strata = first.filter("j = 1").groupBy("season").agg(F.count(F.lit(1)).alias("strata"))
    w = Window.partitionBy("season").orderBy(F.expr("j > 400 div strata"), "h", "event_id")
    return first.join(strata, "season").withColumn("place", F.row_number().over(w)).filter("place <= 400").select("event_id", "season", "y")


@query("bootstrap_valid_share", over(_PRED, f""", c AS (SELECT user_id, sum(CAST(round(((p - y) * (p - y) - (q - y) * (q - y)) * 1000000000) AS BIGINT))::BIGINT AS g, count(*) AS n, sum(y)::BIGINT AS t FROM pr GROUP BY user_id),
  u AS (SELECT *, {B.HASH_SQL.format(k="user_id", d="draw")} AS u FROM c, (SELECT unnest(range({_DRAWS})) AS draw)), w AS (SELECT *, {B.POISSON_SQL.format(u="u")} AS w FROM u),
  b AS (SELECT draw, sum(g * w)::DOUBLE AS g, sum(n * w)::DOUBLE AS n, sum(t * w)::DOUBLE AS t FROM w GROUP BY draw), v AS (SELECT CASE WHEN t > 0 AND t < n THEN g / (t * (1 - t / n)) / 10000 END AS gain FROM b)
  SELECT count(*) AS draws, count(gain) AS valid, count(gain) >= greatest(100, 0.95::DOUBLE * count(*)) AS accepted, round(quantile_cont(gain, 0.025), 3) AS low, round(median(gain), 3) AS mid, round(quantile_cont(gain, 0.975), 3) AS high FROM v"""))
def bootstrap_valid_share(spark, d):
    """Skill gains of draws of users; a draw whose outcomes are all alike has no skill and is rejected, and too many of them reject the whole."""
    c = predictions(spark, d).groupBy("user_id").agg(F.sum(F.round(K.gain_parts("p", "q", "y") * 10**9).cast("long")).alias("g"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("t"))
    w = c.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(_DRAWS - 1)))).withColumn("w", B.poisson_draw(F.col("user_id"), F.col("draw")))
    b = w.groupBy("draw").agg(*[F.sum(F.col(x) * F.col("w")).cast("double").alias(x) for x in ("g", "n", "t")])
    v = b.select(F.when((F.col("t") > 0) & (F.col("t") < F.col("n")), F.col("g") / (F.col("t") * (1 - F.col("t") / F.col("n"))) / 10000).alias("gain"))
    at = lambda x: F.round(F.percentile("gain", F.lit(x)), 3)
    return v.agg(F.count(F.lit(1)).alias("draws"), F.count("gain").alias("valid"), (F.count("gain") >= F.greatest(F.lit(100.0), F.lit(0.95) * F.count(F.lit(1)))).alias("accepted"), at(0.025).alias("low"), at(0.5).alias("mid"), at(0.975).alias("high"))


@query("low_rank_mean")
def low_rank_mean(spark, d):
    """The mean of four sources' low-rank effects, looked up for each line item; a source that doesn't know the supplier adds 0."""
    rows = items(spark, d).withColumn("cell", (F.col("month") - 1) * 2 + F.col("hand"))
    cells = rows.groupBy("supplier", (F.col("cnt") % 4).alias("source"), "cell").agg(F.sum(F.col("y") * 2 - 1).alias("t"), F.count(F.lit(1)).alias("n"))
    names = [f"c{j}" for j in range(24)]
    wide = keep(cells.groupBy("supplier", "source").agg(*[F.coalesce(F.max(F.when(F.col("cell") == j, F.col("t") / (F.col("n") + F.lit(200.0)))), F.lit(0.0)).alias(n) for j, n in enumerate(names)]), "low-rank-sources")
    effects = M.low_rank_by(wide, "source", "supplier", names, 4)
    total = effects.groupBy("supplier").agg(F.array(*[F.sum(n) / 4 for n in names]).alias("effects"))
    return rows.join(total, "supplier", "left").select("ord", "cnt", F.round(F.coalesce(F.get("effects", F.col("cell")), F.lit(0.0)), 9).alias("effect"))
