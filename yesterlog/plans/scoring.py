"""Scores of two as-of predictions of purchase, p (strength 200) and q (strength 20), and of their blends."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import clip, eb, rate
from ..operators import blend as B
from ..operators import score as K
from .registry import EVENTS, events, over, query

_PRED = EVENTS + """, pr AS (SELECT event_id, user_id, event_type, season, k, n, y, k % 2 AS seg, (s + 200.0::DOUBLE * 0.2::DOUBLE) / (n + 200.0::DOUBLE) AS p, (s + 20.0::DOUBLE * 0.2::DOUBLE) / (n + 20.0::DOUBLE) AS q FROM ev)"""


def predictions(spark, d):
    return events(spark, d).select("event_id", "user_id", "event_type", "season", "k", "n", "y", (F.col("k") % 2).alias("seg"), eb("s", "n", 0.2, 200).alias("p"), eb("s", "n", 0.2, 20).alias("q"))


def _skill(p, y="y"):
    return f"round(100000 * (1 - avg(({p} - {y}) * ({p} - {y})) / (avg({y}) * (1 - avg({y})))), 3)"


@query("brier_skill", over(_PRED, f"SELECT season, count(*) AS n, round(avg((p - y) * (p - y)), 9) AS brier, {_skill('p')} AS skill, round(greatest(0, 100000 * (1 - avg((p - y) * (p - y)) / (avg(y) * (1 - avg(y))))), 3) AS clamped FROM pr GROUP BY season"))
def brier_skill(spark, d):
    s = K.skill("p", "y")
    return predictions(spark, d).groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.round(K.brier("p", "y"), 9).alias("brier"), F.round(s, 3).alias("skill"), F.round(F.greatest(F.lit(0.0), s), 3).alias("clamped"))


@query("score_decomposition", over(_PRED, f"""SELECT season, {_skill('p')} AS total, round(100000 * (avg(p) - avg(y)) * (avg(p) - avg(y)) / (avg(y) * (1 - avg(y))), 3) AS penalty,
  round(100000 * (1 - avg((p - y) * (p - y)) / (avg(y) * (1 - avg(y)))) + 100000 * (avg(p) - avg(y)) * (avg(p) - avg(y)) / (avg(y) * (1 - avg(y))), 3) AS discrimination FROM pr GROUP BY season"""))
def score_decomposition(spark, d):
    return predictions(spark, d).groupBy("season").agg(*[F.round(c, 3).alias(n) for n, c in zip(("total", "discrimination", "penalty"), K.decomposition("p", "y"), strict=True)])


@query("shape_gain", over(_PRED, ", m AS (SELECT avg(p) AS mp, avg(q) AS mq FROM pr) SELECT round(1000000 * avg((p - y) * (p - y) - (q - mq + mp - y) * (q - mq + mp - y)), 4) AS gain FROM pr, m"))
def shape_gain(spark, d):
    """What q gains over p once its mean is moved to p's; the means are one row."""
    pr = predictions(spark, d)
    means = pr.agg(F.avg("p").alias("mp"), F.avg("q").alias("mq"))
    moved = pr.crossJoin(F.broadcast(means)).withColumn("r", F.col("q") - F.col("mq") + F.col("mp"))
    return moved.agg(F.round(1000000 * F.avg(K.gain_parts("p", "r", "y")), 4).alias("gain"))


@query("domain_contribution", over(_PRED, ", t AS (SELECT count(*) AS n_all, avg(y) * (1 - avg(y)) AS v FROM pr) SELECT event_type, count(*) AS n, round(100000 * sum((p - y) * (p - y) - (q - y) * (q - y)) / max(n_all) / max(v), 4) AS contribution FROM pr, t GROUP BY event_type"))
def domain_contribution(spark, d):
    """Parts of the gain of q over p by event type; they sum to the whole gain."""
    pr = predictions(spark, d)
    total = pr.agg(F.count(F.lit(1)).alias("n_all"), (F.avg("y") * (1 - F.avg("y"))).alias("v"))
    g = pr.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(K.gain_parts("p", "q", "y")).alias("g"))
    return g.crossJoin(F.broadcast(total)).select("event_type", "n", F.round(100000 * F.col("g") / F.col("n_all") / F.col("v"), 4).alias("contribution"))


@query("error_map", over(_PRED, "SELECT k, count(*) AS n, round(avg(p) - avg(y), 9) AS bias, round(count(*) * (avg(p) - avg(y)) * (avg(p) - avg(y)), 6) AS oracle_gain FROM pr GROUP BY k"))
def error_map(spark, d):
    """Bias of each segment and the squared error that its removal would save."""
    off = F.avg("p") - F.avg("y")
    return predictions(spark, d).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(off, 9).alias("bias"), F.round(F.count(F.lit(1)) * off * off, 6).alias("oracle_gain"))


@query("binary_logloss", over(_PRED, "SELECT season, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS logloss FROM pr GROUP BY season"))
def binary_logloss(spark, d):
    return predictions(spark, d).groupBy("season").agg(F.round(-F.avg(F.col("y") * F.log("p") + (1 - F.col("y")) * F.log1p(-F.col("p"))), 6).alias("logloss"))


@query("multiclass_scores", over(EVENTS, """
  , c AS (SELECT season, event_type, count(*) AS n FROM ev WHERE season < 4 GROUP BY ALL), f AS (SELECT event_type, sum(n)::BIGINT / (SELECT sum(n)::BIGINT FROM c) AS p FROM c GROUP BY event_type), b AS (SELECT sum(p * p) AS sq FROM f)
  SELECT ev.season, count(*) AS n, round(-avg(ln(p)), 6) AS logloss, round(avg(1 - 2 * p + sq), 6) AS brier FROM ev JOIN f USING (event_type), b WHERE ev.season >= 4 GROUP BY ev.season"""))
def multiclass_scores(spark, d):
    """Log loss and Brier score of frozen class shares; the shares are as many rows as there are classes."""
    ev = events(spark, d)
    shares = ev.filter("season < 4").groupBy("event_type").agg(F.count(F.lit(1)).alias("c"))
    total = shares.agg(F.sum("c").alias("t"))
    shares = shares.crossJoin(F.broadcast(total)).select("event_type", (F.col("c") / F.col("t")).alias("p"))
    square = shares.agg(F.sum(F.col("p") * F.col("p")).alias("sq"))
    scored = ev.filter("season >= 4").join(shares, "event_type").crossJoin(F.broadcast(square))
    return scored.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.round(-F.avg(F.log("p")), 6).alias("logloss"), F.round(F.avg(1 - 2 * F.col("p") + F.col("sq")), 6).alias("brier"))


@query("auc", over(_PRED, """, g AS (SELECT season, p, count(*) AS n, sum(y)::BIGINT AS ones FROM pr GROUP BY season, p), r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY season ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
  SELECT season, (sum((2 * below + n + 1) * ones)::DOUBLE - sum(ones)::DOUBLE * (sum(ones) + 1)) / (2.0::DOUBLE * sum(ones) * (sum(n) - sum(ones))) AS auc, sum(n)::BIGINT AS n FROM r GROUP BY season"""))
def auc(spark, d):
    return K.auc(predictions(spark, d), "p", "y", ["season"])


@query("mean_probability_matrix", over(_PRED, "SELECT event_type, round(avg(p), 9) AS mean_p, round(avg(q), 9) AS mean_q, round(avg(p) / (SELECT avg(p) FROM pr), 9) AS lift FROM pr GROUP BY event_type"))
def mean_probability_matrix(spark, d):
    pr = predictions(spark, d)
    base = pr.agg(F.avg("p").alias("all_p"))
    g = pr.groupBy("event_type").agg(F.avg("p").alias("mp"), F.avg("q").alias("mq"))
    return g.crossJoin(F.broadcast(base)).select("event_type", F.round("mp", 9).alias("mean_p"), F.round("mq", 9).alias("mean_q"), F.round(F.col("mp") / F.col("all_p"), 9).alias("lift"))


_EDGES = ", e AS (SELECT " + ", ".join(f"quantile_cont(p, {j / 5}) AS e{j}" for j in range(1, 5)) + " FROM pr), b AS (SELECT pr.*, " + " + ".join(f"CAST(p > e{j} AS INT)" for j in range(1, 5)) + " AS bin FROM pr, e)"


def _binned(spark, d):
    """Five quantile bins, closed on the right; the edges are one row."""
    pr = predictions(spark, d)
    edges = pr.agg(*[F.percentile("p", F.lit(j / 5)).alias(f"e{j}") for j in range(1, 5)])
    number = sum(((F.col("p") > F.col(f"e{j}")).cast("int") for j in range(1, 5)), F.lit(0))
    return pr.crossJoin(F.broadcast(edges)).withColumn("bin", number)


@query("reliability_table", over(_PRED, _EDGES + " SELECT bin, count(*) AS n, round(avg(p), 9) AS mean_p, avg(y) AS mean_y, round(avg((p - y) * (p - y)) - avg((avg_y - y) * (avg_y - y)), 9) AS gain FROM (SELECT *, avg(y) OVER (PARTITION BY bin) AS avg_y FROM b) GROUP BY bin"))
def reliability_table(spark, d):
    """Bins with what replacing their predictions by their own mean would gain."""
    own = F.avg("y") - F.avg("y") * F.avg("y")  # squared error around the bin's mean, as y is 0 or 1
    return _binned(spark, d).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 9).alias("mean_p"), F.avg("y").alias("mean_y"), F.round(K.brier("p", "y") - own, 9).alias("gain"))


@query("calibration_error", over(_PRED, _EDGES + ", g AS (SELECT bin, count(*) AS n, abs(avg(p) - avg(y)) AS off FROM b GROUP BY bin) SELECT round(sum(n * off) / sum(n)::BIGINT, 9) AS ece FROM g"))
def calibration_error(spark, d):
    g = _binned(spark, d).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("p") - F.avg("y")).alias("off"))
    return g.agg(F.round(F.sum(F.col("n") * F.col("off")) / F.sum("n"), 9).alias("ece"))


@query("coldstart_table", over(_PRED, """SELECT least(3, CAST(n >= 1 AS INT) + CAST(n >= 10 AS INT) + CAST(n >= 30 AS INT)) AS band, count(*) AS rows_, avg(y) AS rate, round(avg((p - y) * (p - y)), 9) AS brier, round(sum((p - y) * (p - y)), 6) AS perfect_gain FROM pr GROUP BY band"""))
def coldstart_table(spark, d):
    band = sum(((F.col("n") >= e).cast("int") for e in (1, 10, 30)), F.lit(0))
    return predictions(spark, d).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("rows_"), F.avg("y").alias("rate"), F.round(K.brier("p", "y"), 9).alias("brier"), F.round(F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))), 6).alias("perfect_gain"))


_GRID = [i / 10 for i in range(11)]


@query("shrink_to_mean", over(_PRED, """, m AS (SELECT avg(q) AS mq, avg(y) AS my, avg(q * q) - avg(q) * avg(q) AS v, avg(q * y) - avg(q) * avg(y) AS c FROM pr) SELECT round(c / v, 6) AS best, round(mq, 9) AS mean FROM m"""))
def shrink_to_mean(spark, d):
    """The factor by which q's distance from its mean fits best, in closed form instead of a grid."""
    v, c = F.avg(F.col("q") * F.col("q")) - F.avg("q") * F.avg("q"), F.avg(F.col("q") * F.col("y")) - F.avg("q") * F.avg("y")
    return predictions(spark, d).agg(F.round(F.try_divide(c, v), 6).alias("best"), F.round(F.avg("q"), 9).alias("mean"))


@query("affine_calibrate", over(_PRED, "SELECT event_id, greatest(0.05::DOUBLE, least(0.6::DOUBLE, 0.2::DOUBLE + 1.2::DOUBLE * (p - 0.2::DOUBLE) - 0.001::DOUBLE)) AS p FROM pr"))
def affine_calibrate(spark, d):
    return predictions(spark, d).select("event_id", clip(F.lit(0.2) + F.lit(1.2) * (F.col("p") - F.lit(0.2)) - F.lit(0.001), 0.05, 0.6).alias("p"))


@query("convex_blend", over(_PRED, "SELECT event_id, 0.6::DOUBLE * p + 0.4::DOUBLE * q AS blend FROM pr"))
def convex_blend(spark, d):
    return predictions(spark, d).select("event_id", (F.lit(0.6) * F.col("p") + F.lit(0.4) * F.col("q")).alias("blend"))


@query("pair_geometry", over(_PRED, """, g AS (SELECT season, avg((p - y) * (p - y)) AS bp, avg((q - y) * (q - y)) AS bq, avg((q - p) * (q - p)) AS kk, avg(y) * (1 - avg(y)) AS v FROM pr GROUP BY season)
  SELECT season, round(100000 * (bp - bq) / v, 3) AS d, round(100000 * kk / v, 3) AS diversity, round(0.5::DOUBLE + (bp - bq) / (2 * kk), 6) AS weight FROM g"""))
def pair_geometry(spark, d):
    """Difference and diversity of two predictions, and the weight of the second at which their blend is best."""
    bp, bq = K.brier("p", "y"), K.brier("q", "y")
    k, v = F.avg((F.col("q") - F.col("p")) * (F.col("q") - F.col("p"))), F.avg("y") * (1 - F.avg("y"))
    return predictions(spark, d).groupBy("season").agg(F.round(100000 * (bp - bq) / v, 3).alias("d"), F.round(100000 * k / v, 3).alias("diversity"), F.round(F.lit(0.5) + F.try_divide(bp - bq, 2 * k), 6).alias("weight"))


@query("blend_identity", over(_PRED, """, g AS (SELECT avg((p - y) * (p - y)) AS bp, avg((q - y) * (q - y)) AS bq, avg((q - p) * (q - p)) AS kk, avg((0.7::DOUBLE * p + 0.3::DOUBLE * q - y) * (0.7::DOUBLE * p + 0.3::DOUBLE * q - y)) AS bm FROM pr)
  SELECT round(bp - bm, 9) AS gain, round(0.3::DOUBLE * (bp - bq) + kk * 0.3::DOUBLE * 0.7::DOUBLE, 9) AS predicted FROM g"""))
def blend_identity(spark, d):
    """The measured gain of a blend and what the identity w d + K w (1 - w) says."""
    pr = predictions(spark, d).withColumn("m", F.lit(0.7) * F.col("p") + F.lit(0.3) * F.col("q"))
    g = pr.agg(K.brier("p", "y").alias("bp"), K.brier("q", "y").alias("bq"), K.brier("m", "y").alias("bm"), F.avg((F.col("q") - F.col("p")) * (F.col("q") - F.col("p"))).alias("kk"))
    return g.select(F.round(F.col("bp") - F.col("bm"), 9).alias("gain"), F.round(F.lit(0.3) * (F.col("bp") - F.col("bq")) + F.col("kk") * F.lit(0.3) * F.lit(0.7), 9).alias("predicted"))


@query("analytic_weight", over(_PRED, "SELECT event_type, count(*) AS n, round(sum((q - p) * (q - p)), 6) AS k, round(sum((y - p) * (q - p)), 6) AS a, round(sum((y - p) * (q - p)) / sum((q - p) * (q - p)), 6) AS weight FROM pr GROUP BY event_type"))
def analytic_weight(spark, d):
    n, k, a, w = K.blend_geometry("p", "q", "y")
    return predictions(spark, d).groupBy("event_type").agg(n, F.round(k, 6).alias("k"), F.round(a, 6).alias("a"), F.round(w, 6).alias("weight"))


@query("masked_routing", over(_PRED, "SELECT round(sum((y - p) * (q - p)) FILTER (n < 20) / sum((q - p) * (q - p)) FILTER (n < 20), 6) AS weight, count(*) FILTER (n < 20) AS rows_, round(sum((q - p) * (q - p)) FILTER (n < 20), 6) AS k FROM pr"))
def masked_routing(spark, d):
    """The best weight of q where only cold rows may change."""
    cold, step = F.col("n") < 20, F.col("q") - F.col("p")
    a, k = F.sum(F.when(cold, (F.col("y") - F.col("p")) * step)), F.sum(F.when(cold, step * step))
    return predictions(spark, d).agg(F.round(F.try_divide(a, k), 6).alias("weight"), F.count(F.when(cold, 1)).alias("rows_"), F.round(k, 6).alias("k"))


@query("feasible_interval", over(_PRED, "SELECT max(CASE WHEN q - p > 1e-9 THEN -p / (q - p) WHEN q - p < -1e-9 THEN (1 - p) / (q - p) END) AS low, min(CASE WHEN q - p > 1e-9 THEN (1 - p) / (q - p) WHEN q - p < -1e-9 THEN -p / (q - p) END) AS high FROM pr"))
def feasible_interval(spark, d):
    """The weights of q for which no blended probability leaves [0, 1]."""
    step, p = F.col("q") - F.col("p"), F.col("p")
    low = F.when(step > 1e-9, -p / step).when(step < -1e-9, (1 - p) / step)
    high = F.when(step > 1e-9, (1 - p) / step).when(step < -1e-9, -p / step)
    return predictions(spark, d).agg(F.max(low).alias("low"), F.min(high).alias("high"))


@query("pooled_signed_weight", over(_PRED, "SELECT round(sum((y - p) * (q - p)) / sum((q - p) * (q - p)), 6) AS pooled, round(sum((y - p) * (q - p)) FILTER (seg = 1) / sum((q - p) * (q - p)) FILTER (seg = 1), 6) AS masked FROM pr WHERE season BETWEEN 1 AND 4"))
def pooled_signed_weight(spark, d):
    step = F.col("q") - F.col("p")
    a, k, one = (F.col("y") - F.col("p")) * step, step * step, F.col("seg") == 1
    ratio = lambda x, y: F.round(F.try_divide(F.sum(x), F.sum(y)), 6)
    return predictions(spark, d).filter(F.col("season").between(1, 4)).agg(ratio(a, k).alias("pooled"), ratio(F.when(one, a), F.when(one, k)).alias("masked"))


@query("affine_oracle", over(_PRED, """, g AS (SELECT season, avg(p) AS mp, avg(y) AS my, avg(p * p) - avg(p) * avg(p) AS vp, avg(y) - avg(y) * avg(y) AS vy, avg(p * y) - avg(p) * avg(y) AS c FROM pr GROUP BY season)
  SELECT season, round(c / vp, 4) AS slope, round(100000 * c * c / (vp * vy), 3) AS score FROM g"""))
def affine_oracle(spark, d):
    """Slope of the best affine correction and the score that it reaches."""
    vp, vy, c = F.avg(F.col("p") * F.col("p")) - F.avg("p") * F.avg("p"), F.avg("y") - F.avg("y") * F.avg("y"), F.avg(F.col("p") * F.col("y")) - F.avg("p") * F.avg("y")
    return predictions(spark, d).groupBy("season").agg(F.round(F.try_divide(c, vp), 4).alias("slope"), F.round(100000 * F.try_divide(c * c, vp * vy), 3).alias("score"))


@query("direction_novelty", over(_PRED, """, x AS (SELECT q - p AS a, p - 0.2::DOUBLE AS b FROM pr), g AS (SELECT sum(a * b) AS ab, sum(a * a) AS aa, sum(b * b) AS bb, stddev_pop(a) AS sd FROM x)
  SELECT round(ab / sqrt(aa * bb), 6) AS cosine, round(sqrt(1 - ab * ab / (aa * bb)), 6) AS orthogonal, round(sd, 9) AS sd FROM g"""))
def direction_novelty(spark, d):
    x = predictions(spark, d).select((F.col("q") - F.col("p")).alias("a"), (F.col("p") - F.lit(0.2)).alias("b"))
    g = x.agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"), F.stddev_pop("a").alias("sd"))
    cosine = F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))
    return g.select(F.round(cosine, 6).alias("cosine"), F.round(F.sqrt(1 - F.col("ab") * F.col("ab") / (F.col("aa") * F.col("bb"))), 6).alias("orthogonal"), F.round("sd", 9).alias("sd"))


@query("direction_library", over(_PRED, ", m AS (SELECT avg(q - p) AS mean, stddev_pop(q - p) AS sd FROM pr) SELECT event_id, q - p AS step, CASE WHEN seg = 1 THEN q - p ELSE 0 END AS masked, round((q - p - mean) / sd, 6) AS shape, round((q - p - mean) / sd * (seg * 2 - 1), 6) AS shape_seg FROM pr, m"))
def direction_library(spark, d):
    """Directions from p: plain, masked, standardised by frozen moments (one row) and crossed with a segment."""
    pr = predictions(spark, d).withColumn("step", F.col("q") - F.col("p"))
    m = pr.agg(F.avg("step").alias("mean"), F.stddev_pop("step").alias("sd"))
    shape = (F.col("step") - F.col("mean")) / F.col("sd")
    return pr.crossJoin(F.broadcast(m)).select("event_id", "step", F.when(F.col("seg") == 1, F.col("step")).otherwise(F.lit(0.0)).alias("masked"), F.round(shape, 6).alias("shape"), F.round(shape * (F.col("seg") * 2 - 1), 6).alias("shape_seg"))


@query("gamma_curve", over(_PRED, f", g AS (SELECT unnest({_GRID})::DOUBLE AS gamma), s AS (SELECT gamma, season, 100000 * (avg((p - y) * (p - y)) - avg((p + gamma * (q - p) - y) * (p + gamma * (q - p) - y))) / (avg(y) * (1 - avg(y))) AS gain FROM pr, g GROUP BY gamma, season) SELECT gamma, round(min(gain), 3) AS least, round(avg(gain), 3) AS mean FROM s GROUP BY gamma"))
def gamma_curve(spark, d):
    """Gain for each weight of a grid. The grid multiplies no rows: a season's gain is a quadratic of three sums."""
    n, k, a, _ = K.blend_geometry("p", "q", "y")
    v = F.avg("y") * (1 - F.avg("y"))
    sums = predictions(spark, d).groupBy("season").agg(n, k, a, v.alias("v")).withColumn("gamma", F.explode(F.array(*[F.lit(g) for g in _GRID])))
    gain = 100000 * (2 * F.col("gamma") * F.col("a") - F.col("gamma") * F.col("gamma") * F.col("k")) / F.col("n") / F.col("v")
    return sums.groupBy("gamma").agg(F.round(F.min(gain), 3).alias("least"), F.round(F.avg(gain), 3).alias("mean"))


@query("backtest_paired", over(_PRED, """, f AS (SELECT season, event_id % 4 AS fold, 100000 * avg((p - y) * (p - y) - (q - y) * (q - y)) / (avg(y) * (1 - avg(y))) AS gain FROM pr WHERE season >= 1 GROUP BY ALL)
  SELECT count(*) AS folds, round(avg(gain), 3) AS mean, round(median(gain), 3) AS median, round(min(gain), 3) AS least, round(stddev_samp(gain), 3) AS sd, round(avg(gain) / (stddev_samp(gain) / sqrt(count(*))), 4) AS t, min(gain) > -50 AND avg(gain) > 0 AS accepted FROM f"""))
def backtest_paired(spark, d):
    """Gains of q over p, fold by fold, with a paired t and an acceptance rule."""
    gain = 100000 * F.avg(K.gain_parts("p", "q", "y")) / (F.avg("y") * (1 - F.avg("y")))
    f = predictions(spark, d).filter("season >= 1").groupBy("season", (F.col("event_id") % 4).alias("fold")).agg(gain.alias("gain"))
    n, mean, sd = F.count(F.lit(1)), F.avg("gain"), F.stddev_samp("gain")
    return f.agg(n.alias("folds"), F.round(mean, 3).alias("mean"), F.round(F.percentile("gain", F.lit(0.5)), 3).alias("median"), F.round(F.min("gain"), 3).alias("least"), F.round(sd, 3).alias("sd"), F.round(mean / (sd / F.sqrt(n)), 4).alias("t"), ((F.min("gain") > -50) & (mean > 0)).alias("accepted"))


@query("seed_scaling", over(_PRED, f", a AS (SELECT season, 100000 * (1 - avg((p - y) * (p - y)) / (avg(y) * (1 - avg(y)))) AS sp, 100000 * (1 - avg((q - y) * (q - y)) / (avg(y) * (1 - avg(y)))) AS sq, 100000 * avg((q - p) * (q - p)) / (avg(y) * (1 - avg(y))) AS kk FROM pr GROUP BY season) SELECT season, round((sp + sq) / 2 + kk * (2 - 1) / (2 * 2), 3) AS two, round((sp + sq) / 2 + kk * (8 - 1) / (2 * 8), 3) AS eight, round(kk * (8 - 1) / (2 * 8), 3) AS eight_gain FROM a"))
def seed_scaling(spark, d):
    """What n equally good and equally different members would score: mean + K (n - 1) / (2 n)."""
    v = F.avg("y") * (1 - F.avg("y"))
    k = 100000 * F.avg((F.col("q") - F.col("p")) * (F.col("q") - F.col("p"))) / v
    a = predictions(spark, d).groupBy("season").agg(((K.skill("p", "y") + K.skill("q", "y")) / 2).alias("mean"), k.alias("k"))
    of = lambda n: F.col("k") * (n - 1) / (2 * n)
    return a.select("season", F.round(F.col("mean") + of(2), 3).alias("two"), F.round(F.col("mean") + of(8), 3).alias("eight"), F.round(of(8), 3).alias("eight_gain"))


@query("drift_bias", over(_PRED, """, g AS (SELECT season, sum(p) AS sp, sum(y)::BIGINT AS sy, count(*) AS n FROM pr GROUP BY season)
  SELECT season, round(sp / n - sy / n, 9) AS bias, round(sum(sp - sy) OVER w / sum(n) OVER w, 9) AS expected FROM g WINDOW w AS (ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""))
def drift_bias(spark, d):
    """Each season's bias and the correction that the seasons before it suggest. One row for each season is windowed."""
    g = predictions(spark, d).groupBy("season").agg(F.sum("p").alias("sp"), F.sum("y").alias("sy"), F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    return g.select("season", F.round(F.col("sp") / F.col("n") - F.col("sy") / F.col("n"), 9).alias("bias"), F.round(F.sum(F.col("sp") - F.col("sy")).over(w) / F.sum("n").over(w), 9).alias("expected"))


@query("noise_floor", over(_PRED, ", a AS (SELECT event_id % 8 AS seed, avg((p - y) * (p - y)) AS b FROM pr GROUP BY seed) SELECT round(avg(b), 9) AS mean, round(stddev_samp(b), 9) AS sd, round(2 * stddev_samp(b), 9) AS least_gain FROM a"))
def noise_floor(spark, d):
    a = predictions(spark, d).groupBy((F.col("event_id") % 8).alias("seed")).agg(K.brier("p", "y").alias("b"))
    return a.agg(F.round(F.avg("b"), 9).alias("mean"), F.round(F.stddev_samp("b"), 9).alias("sd"), F.round(2 * F.stddev_samp("b"), 9).alias("least_gain"))


@query("subset_scores", over(_PRED, f"SELECT count(*) FILTER (season < 3) AS early_n, round(avg((p - y) * (p - y)) FILTER (season < 3), 9) AS early, round(avg((p - y) * (p - y)) FILTER (season >= 3), 9) AS late, round(avg((p - y) * (p - y)) FILTER (seg = 0), 9) AS even, round(avg((p - y) * (p - y)) FILTER (seg = 1), 9) AS odd FROM pr"))
def subset_scores(spark, d):
    e = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    part = lambda c: F.round(F.avg(F.when(c, e)), 9)
    early, even = F.col("season") < 3, F.col("seg") == 0
    return predictions(spark, d).agg(F.count(F.when(early, 1)).alias("early_n"), part(early).alias("early"), part(~early).alias("late"), part(even).alias("even"), part(~even).alias("odd"))


@query("segment_experts", over(_PRED, ", t AS (SELECT avg(y) * (1 - avg(y)) AS v FROM pr) SELECT seg, round(100000 * (1 - avg((p - y) * (p - y)) / (avg(y) * (1 - avg(y)))), 3) AS own, round(100000 * (1 - avg((p - y) * (p - y)) / max(v)), 3) AS by_all FROM pr, t GROUP BY seg"))
def segment_experts(spark, d):
    """Scores of segments against their own rate and against the rate of all."""
    pr = predictions(spark, d)
    total = pr.agg((F.avg("y") * (1 - F.avg("y"))).alias("v"))
    return pr.crossJoin(F.broadcast(total)).groupBy("seg").agg(F.round(K.skill("p", "y"), 3).alias("own"), F.round(100000 * (1 - K.brier("p", "y") / F.max("v")), 3).alias("by_all"))


_DRAWS = 5000


@query("cluster_bootstrap", over(_PRED, f""", c AS (SELECT user_id, sum(CAST(round(((p - y) * (p - y) - (q - y) * (q - y)) * 1000000000) AS BIGINT))::BIGINT AS g, count(*) AS n FROM pr GROUP BY user_id),
  u AS (SELECT draw, g, n, {B.HASH_SQL.format(k="user_id", d="draw")} AS u FROM c, (SELECT unnest(range({_DRAWS})) AS draw)), w AS (SELECT draw, g, n, {B.POISSON_SQL.format(u="u")} AS w FROM u), b AS (SELECT draw, sum(g * w)::DOUBLE / sum(n * w)::DOUBLE AS gain, sum(n * w) > 0 AS valid FROM w GROUP BY draw)
  SELECT count(*) AS draws, round(quantile_cont(gain, 0.025), 3) AS low, round(median(gain), 3) AS mid, round(quantile_cont(gain, 0.975), 3) AS high, avg(CAST(gain > 0 AS INT)) AS positive FROM b WHERE valid"""))
def cluster_bootstrap(spark, d):
    """Draws of users with Poisson weights. Users are summed first; draws without any row are left out."""
    c = predictions(spark, d).groupBy("user_id").agg(F.sum(F.round(K.gain_parts("p", "q", "y") * 10**9).cast("long")).alias("g"), F.count(F.lit(1)).alias("n"))
    w = c.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(_DRAWS - 1)))).withColumn("w", B.poisson_draw(F.col("user_id"), F.col("draw")))
    b = w.groupBy("draw").agg(F.try_divide(F.sum(F.col("g") * F.col("w")).cast("double"), F.sum(F.col("n") * F.col("w")).cast("double")).alias("gain")).filter("gain is not null")
    at = lambda x: F.round(F.percentile("gain", F.lit(x)), 3)
    return b.agg(F.count(F.lit(1)).alias("draws"), at(0.025).alias("low"), at(0.5).alias("mid"), at(0.975).alias("high"), F.avg((F.col("gain") > 0).cast("int")).alias("positive"))


@query("stratified_sample_hash", over(_PRED, "SELECT event_id, season, y FROM (SELECT *, row_number() OVER (PARTITION BY season, y ORDER BY (event_id + 1) * 48271 % 2147483647, event_id) AS j FROM pr) WHERE j <= 20"))
def stratified_sample_hash(spark, d):
    """Twenty events of each season and outcome, in the order of a hash."""
    w = Window.partitionBy("season", "y").orderBy(B.hash_order(F.col("event_id")), "event_id")
    return predictions(spark, d).withColumn("j", F.row_number().over(w)).filter("j <= 20").select("event_id", "season", "y")


@query("simplex_weight_grid", "SELECT a, b, 10 - a - b AS c FROM (SELECT unnest(range(11)) AS a), (SELECT unnest(range(11)) AS b) WHERE a + b <= 10")
def simplex_weight_grid(spark, d):
    """All ways to share ten units among three members."""
    a = spark.range(11).select(F.col("id").alias("a"))
    return a.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), 10 - F.col("a")))).select("a", "b", (10 - F.col("a") - F.col("b")).alias("c"))


_W = {"p": 0.5, "q": -0.3}


@query("linear_apply", over(_PRED, ", m AS (SELECT avg(p) AS mp, stddev_pop(p) AS dp, avg(q) AS mq, stddev_pop(q) AS dq FROM pr WHERE season < 4) SELECT event_id, round(0.1::DOUBLE * (0.5::DOUBLE * coalesce((p - mp) / dp, 0) - 0.3::DOUBLE * coalesce((q - mq) / dq, 0)), 6) AS correction FROM pr, m WHERE season >= 4"))
def linear_apply(spark, d):
    """A saved linear correction: standardise by frozen moments, nulls to 0, weigh, scale."""
    pr = predictions(spark, d)
    m = pr.filter("season < 4").agg(*[f(c).alias(f"{n}{c}") for c in _W for n, f in (("m", F.avg), ("d", F.stddev_pop))])
    total = sum((F.lit(w) * F.coalesce((F.col(c) - F.col(f"m{c}")) / F.col(f"d{c}"), F.lit(0.0)) for c, w in _W.items()), F.lit(0.0))
    return pr.filter("season >= 4").crossJoin(F.broadcast(m)).select("event_id", F.round(F.lit(0.1) * total, 6).alias("correction"))


@query("gate_pass", over(_PRED, """, g AS (SELECT season, 100000 * avg((p - y) * (p - y) - (q - y) * (q - y)) / (avg(y) * (1 - avg(y))) AS gain FROM pr GROUP BY season)
  SELECT CASE WHEN avg(gain) >= 8 AND min(gain) > 0 THEN 'PASS' ELSE 'FAIL' END AS verdict, count(*) FILTER (gain > 0) AS seasons_up FROM g"""))
def gate_pass(spark, d):
    gain = 100000 * F.avg(K.gain_parts("p", "q", "y")) / (F.avg("y") * (1 - F.avg("y")))
    g = predictions(spark, d).groupBy("season").agg(gain.alias("gain"))
    return g.agg(F.when((F.avg("gain") >= 8) & (F.min("gain") > 0), "PASS").otherwise("FAIL").alias("verdict"), F.count(F.when(F.col("gain") > 0, 1)).alias("seasons_up"))


@query("redundancy_r2", over(_PRED, ", g AS (SELECT avg(p * q) - avg(p) * avg(q) AS c, avg(p * p) - avg(p) * avg(p) AS vp, avg(q * q) - avg(q) * avg(q) AS vq FROM pr) SELECT round(c * c / (vp * vq), 5) AS r2, CASE WHEN c * c / (vp * vq) > 0.999 THEN 'redundant' WHEN c * c / (vp * vq) > 0.9 THEN 'close' ELSE 'own' END AS verdict FROM g"))
def redundancy_r2(spark, d):
    """How well one prediction is a linear function of the other."""
    c, vp, vq = F.avg(F.col("p") * F.col("q")) - F.avg("p") * F.avg("q"), F.avg(F.col("p") * F.col("p")) - F.avg("p") * F.avg("p"), F.avg(F.col("q") * F.col("q")) - F.avg("q") * F.avg("q")
    g = predictions(spark, d).agg(F.try_divide(c * c, vp * vq).alias("r"))
    return g.select(F.round("r", 5).alias("r2"), F.when(F.col("r") > 0.999, "redundant").when(F.col("r") > 0.9, "close").otherwise("own").alias("verdict"))


@query("pearson", over(_PRED, "SELECT season, round(corr(p, q), 6) AS r FROM pr WHERE season > 0 GROUP BY season"))
def pearson(spark, d):
    return predictions(spark, d).filter("season > 0").groupBy("season").agg(F.round(F.corr("p", "q"), 6).alias("r"))


@query("cosine_similarity", """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, round(avg(x), 9) AS x FROM e GROUP BY label, i)
  SELECT a.label AS a, b.label AS b, round(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 5) AS cosine FROM m a JOIN m b ON a.i = b.i AND a.label < b.label GROUP BY a.label, b.label""")
def cosine_similarity(spark, d):
    """Cosines between the mean vectors of the labels, joined by component: rows are labels times components, never vectors times vectors."""
    from .registry import table

    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    m = e.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("x"))
    a, b = m.select(F.col("label").alias("a"), "i", F.col("x").alias("xa")), m.select(F.col("label").alias("b"), "i", F.col("x").alias("xb"))
    s = lambda x, y: F.sum(F.col(x) * F.col(y))
    return a.join(b, "i").filter("a < b").groupBy("a", "b").agg(F.round(s("xa", "xb") / (F.sqrt(s("xa", "xa")) * F.sqrt(s("xb", "xb"))), 5).alias("cosine"))


@query("quadratic_vertex", over(_PRED, """, w AS (SELECT unnest([0.0::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE]) AS w), z AS (SELECT w, 100000 * (1 - avg((p + w * (q - p) - y) * (p + w * (q - p) - y)) / (avg(y) * (1 - avg(y)))) AS score FROM pr, w GROUP BY w),
  t AS (SELECT max(score) FILTER (w = 0) AS low, max(score) FILTER (w = 0.5) AS mid, max(score) FILTER (w = 1) AS high FROM z), c AS (SELECT low, 4 * mid - 3 * low - high AS b, 2 * (low - 2 * mid + high) AS a FROM t)
  SELECT round(-b / (2 * a), 6) AS weight, round(low - b * b / (4 * a), 4) AS score FROM c"""))
def quadratic_vertex(spark, d):
    """The best weight of q from three probes of the score alone: the parabola through them is exact."""
    pr = predictions(spark, d)
    probes = pr.agg(*[K.skill(F.col("p") + F.lit(w) * (F.col("q") - F.col("p")), "y").alias(f"w{i}") for i, w in enumerate((0.0, 0.5, 1.0))]).first()
    at, score = B.vertex((0.0, 0.5, 1.0), tuple(probes))
    return spark.createDataFrame([(round(at, 6), round(score, 4))], "weight double, score double")


@query("gram_solve")
def gram_solve(spark, d):
    """Weights of three directions by ridge, by truncated eigenvectors and on the simplex, from one Gram aggregation."""
    pr = predictions(spark, d).select((F.col("p") - F.lit(0.2)).alias("a"), (F.col("q") - F.lit(0.2)).alias("b"), (F.col("seg") * F.lit(0.01)).alias("c"), (F.col("y") - F.lit(0.2)).alias("t"))
    m, b, n = B.gram(pr, ["a", "b", "c"], "t")
    rows = [(how, *map(float, w)) for how, w in (("ridge", B.ridge(m, b, 0.01, 3.0)), ("truncated", B.truncated(m, b)), ("simplex", B.on_simplex(m / n, b / n)))]
    return spark.createDataFrame(rows, "how string, a double, b double, c double")


@query("gram_ridge_effect", over(_PRED, """, x AS (SELECT event_id, p - 0.2::DOUBLE AS a, y - p AS t FROM pr), g AS (SELECT sum(a * a) AS aa, sum(a * t) AS xt FROM x) SELECT event_id, round(greatest(-3.0::DOUBLE, least(3.0::DOUBLE, xt / (1.01::DOUBLE * aa))), 4) * a + 0.0::DOUBLE AS effect FROM x, g"""))
def gram_ridge_effect(spark, d):
    """One ridge coefficient, bounded to 3, applied to every row."""
    x = predictions(spark, d).select("event_id", (F.col("p") - F.lit(0.2)).alias("a"), (F.col("y") - F.col("p")).alias("t"))
    m, b, _ = B.gram(x, ["a"], "t")
    w = round(float(B.ridge(m, b, 0.01, 3.0)[0]), 4)
    return x.select("event_id", (F.lit(w) * F.col("a") + F.lit(0.0)).alias("effect"))


@query("rate_against_total", over(_PRED, "SELECT user_id, sum(y)::BIGINT AS total, count(*) AS n, sum(y)::BIGINT / count(*) AS rate, sum(y)::BIGINT / count(*) > 0.2::DOUBLE AS above FROM pr GROUP BY user_id"))
def rate_against_total(spark, d):
    g = predictions(spark, d).groupBy("user_id").agg(F.sum("y").alias("total"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("rate", rate("total", "n")).withColumn("above", F.col("rate") > 0.2)
