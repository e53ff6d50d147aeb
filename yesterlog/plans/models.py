"""Model layers over event features, and the contracts that hold their outputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.expr import eb, logit
from ..operators import contract as C
from ..operators import factors
from ..operators import model as M
from ..operators.component import Registry
from ..sources.io import bucketed, buckets, keep
from .features import _FORM, form
from .registry import EVENTS, ITEMS, events, items, over, query, table

_FEATURES = ["n", "smooth", "r1", "r3", "r5", "balls", "strikes", "outs", "hand", "k"]


def _split(spark, d):
    """Feature rows of seasons 0-3 to learn from and of later ones to score, written once as every learner scans them often."""
    rows = keep(M.assemble(form(spark, d).select("event_id", "season", "event_type", "y", "s", *_FEATURES), _FEATURES), "model-rows")
    return rows.filter("season < 4"), rows.filter("season >= 4")


@query("model_boosted_trees")
def model_boosted_trees(spark, d):
    """Gradient-boosted trees, averaged over two seeds."""
    from pyspark.ml.classification import GBTClassifier

    train, rows = _split(spark, d)
    return M.averaged([GBTClassifier(labelCol="y", maxIter=5, maxDepth=3, seed=s, subsamplingRate=0.8) for s in (1, 2)], train, rows, ["event_id", "y"])


@query("model_random_forest")
def model_random_forest(spark, d):
    from pyspark.ml.classification import RandomForestClassifier

    train, rows = _split(spark, d)
    return M.averaged([RandomForestClassifier(labelCol="y", numTrees=10, maxDepth=4, seed=1)], train, rows, ["event_id", "y"])


@query("model_five_class")
def model_five_class(spark, d):
    """A multinomial model of the five event types; probabilities sum to one."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    train, rows = _split(spark, d)
    codes = F.create_map(*[F.lit(x) for i, t in enumerate(("click", "error", "purchase", "signup", "view")) for x in (t, float(i))])
    model = LogisticRegression(labelCol="c", maxIter=15, regParam=0.01, family="multinomial").fit(train.withColumn("c", F.try_element_at(codes, F.col("event_type"))))
    return model.transform(rows).select("event_id", *[vector_to_array("probability")[i].alias(f"p{i}") for i in range(5)])


@query("model_perceptron")
def model_perceptron(spark, d):
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    train, rows = _split(spark, d)
    return M.averaged([MultilayerPerceptronClassifier(labelCol="y", layers=[len(_FEATURES), 6, 2], maxIter=15, seed=1)], train, rows, ["event_id", "y"])


@query("model_residual_family")
def model_residual_family(spark, d):
    """Boosted trees, a forest and a line learn what the smoothed rate leaves; each is bounded, then their mean counts."""
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    families = {"boosted": GBTRegressor(maxIter=4, maxDepth=3, seed=1), "forest": RandomForestRegressor(numTrees=10, maxDepth=4, seed=1), "line": LinearRegression(regParam=0.01)}
    train, rows = _split(spark, d)
    return M.residual_family(families, train, rows, "y", "smooth", ["event_id", "y"])


@query("model_residual_trees")
def model_residual_trees(spark, d):
    """Weighted regression trees of y - smooth, bounded and added back; later seasons weigh more."""
    from pyspark.ml.regression import GBTRegressor

    train, rows = _split(spark, d)
    train = train.withColumn("e", F.col("y") - F.col("smooth")).withColumn("w", F.pow(F.lit(0.9), 3 - F.col("season")))
    model = GBTRegressor(labelCol="e", weightCol="w", maxIter=4, maxDepth=3, seed=1).fit(train)
    return model.transform(rows).select("event_id", M.add_residual(F.col("smooth"), F.col("prediction"), 0.05, 0.5).alias("p"))


@query("calibrate_platt")
def calibrate_platt(spark, d):
    """A logistic fit of the outcome on the logit of a prediction."""
    from pyspark.ml.classification import LogisticRegression

    rows = events(spark, d).select("event_id", "season", "y", logit(eb("s", "n", 0.2, 50)).alias("z"))
    rows = M.assemble(rows, ["z"])
    return M.averaged([LogisticRegression(labelCol="y", maxIter=20)], rows.filter("season < 4"), rows.filter("season >= 4"), ["event_id"])


@query("calibrate_isotonic")
def calibrate_isotonic(spark, d):
    from pyspark.ml.regression import IsotonicRegression

    rows = M.assemble(events(spark, d).select("event_id", "season", "y", eb("s", "n", 0.2, 50).alias("p0")), ["p0"])
    model = IsotonicRegression(labelCol="y").fit(rows.filter("season < 4"))
    return model.transform(rows.filter("season >= 4")).select("event_id", "p0", F.col("prediction").alias("p"))


_TREES = [
    {"feature": "r3", "threshold": 0.4, "missing": "right", "left": {"feature": "n", "threshold": 20, "left": {"value": 0.01}, "right": {"value": -0.02}}, "right": {"feature": "balls", "threshold": 1, "left": {"value": 0.03}, "right": {"value": 0.05}}},
    {"feature": "smooth", "threshold": 0.2, "left": {"value": -0.01}, "right": {"feature": "outs", "threshold": 0, "left": {"value": 0.0}, "right": {"value": 0.02}}},
]


@query("tree_expression", over(_FORM, """SELECT event_id, 0.2::DOUBLE + 0.5::DOUBLE * CASE WHEN r3 IS NULL OR r3 > 0.4::DOUBLE THEN CASE WHEN balls <= 1 THEN 0.03::DOUBLE ELSE 0.05::DOUBLE END WHEN n <= 20 THEN 0.01::DOUBLE ELSE -0.02::DOUBLE END
  + 0.5::DOUBLE * CASE WHEN smooth <= 0.2::DOUBLE THEN -0.01::DOUBLE WHEN outs <= 0 THEN 0.0::DOUBLE ELSE 0.02::DOUBLE END AS p FROM fm"""))
def tree_expression(spark, d):
    """Saved trees compiled to column expressions, so that scoring stays in generated code."""
    return form(spark, d).select("event_id", M.forest_column(_TREES, 0.5, 0.2).alias("p"))


@query("batch_predictor", over(_FORM, "SELECT event_id, round(1 / (1 + exp(-(smooth * 2 + coalesce(r3, 0.2::DOUBLE) - 1.5::DOUBLE))), 6) AS p FROM fm"))
def batch_predictor(spark, d):
    """A numpy model over Arrow batches."""
    import numpy as np

    predict = lambda x: 1 / (1 + np.exp(-(x[:, 0] * 2 + np.where(np.isnan(x[:, 1]), 0.2, x[:, 1]) - 1.5)))
    return M.scored_by(form(spark, d), "event_id", ["smooth", "r3"], predict).withColumn("p", F.round("p", 6))


@query("linear_stack", over(EVENTS, ", m AS (SELECT event_id, event_type, (s + 200.0::DOUBLE * 0.2::DOUBLE) / (n + 200.0::DOUBLE) AS a, (s + 20.0::DOUBLE * 0.2::DOUBLE) / (n + 20.0::DOUBLE) AS b FROM ev) SELECT event_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.01::DOUBLE + 0.7::DOUBLE * a + 0.25::DOUBLE * b)), 9) AS p FROM m"))
def linear_stack(spark, d):
    m = events(spark, d).select("event_id", eb("s", "n", 0.2, 200).alias("a"), eb("s", "n", 0.2, 20).alias("b"))
    return m.select("event_id", F.round(M.stack(0.01, {"a": 0.7, "b": 0.25}), 9).alias("p"))


@query("channel_corrections", over(_FORM, "SELECT event_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, smooth + 0.5::DOUBLE * (coalesce(r3, smooth) - smooth) * 0.1::DOUBLE + 0.3::DOUBLE * CASE WHEN balls = 3 THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END)), 9) AS p FROM fm"))
def channel_corrections(spark, d):
    """Weighted corrections of several channels on one anchor."""
    from ..functions.expr import clip

    s = F.col("smooth")
    channels = [(0.5, (F.coalesce("r3", "smooth") - s) * F.lit(0.1)), (0.3, F.when(F.col("balls") == 3, F.lit(0.01)).otherwise(F.lit(0.0)))]
    return form(spark, d).select("event_id", F.round(clip(reduce(lambda a, c: a + F.lit(c[0]) * c[1], channels, s), 0, 1), 9).alias("p"))


@query("low_rank_effect")
def low_rank_effect(spark, d):
    """Supplier by month-and-hand residuals, shrunk, centred and projected on four directions."""
    rows = items(spark, d).withColumn("cell", (F.col("month") - 1) * 2 + F.col("hand"))
    cells = rows.groupBy("supplier", "cell").agg(F.sum(F.col("y") * 2 - 1).alias("t"), F.count(F.lit(1)).alias("n"))
    value = F.col("t") / (F.col("n") + F.lit(200.0))
    wide = cells.groupBy("supplier").agg(*[F.coalesce(F.max(F.when(F.col("cell") == j, value)), F.lit(0.0)).alias(f"c{j}") for j in range(24)])
    return M.low_rank(wide, "supplier", [f"c{j}" for j in range(24)], 4)


def _rates(spark, d, value, name):
    """The mean v and the number w of each supplier and part, in buckets of the part, and how many buckets."""
    rows = items(spark, d)
    n = buckets(rows.count())
    pairs = rows.repartition(n, "part").groupBy("supplier", "part").agg(F.avg(value).alias("v"), F.count(F.lit(1)).cast("double").alias("w"))
    return bucketed(pairs, "part", name, n), n


@query("pair_factors")
def pair_factors(spark, d):
    """Factors of supplier-part residuals, without the biases of both sides, by twelve rounds of weighted alternating least squares on the aggregated pairs."""
    pairs, n = _rates(spark, d, F.col("y") - F.lit(0.5), "als-means")
    rest = bucketed(M.without_bias(pairs, "supplier", "part", "v", "w", 200.0), "part", "als-pairs", n)
    left, _ = M.weighted_als(rest, "supplier", "part", "v", "w", 12, 0.5, keep)
    return left


@query("pair_factors_ranked")
def pair_factors_ranked(spark, d):
    """Supplier-part rates by factors of rank 4 and biases of both sides, six rounds; each aggregated pair with its prediction."""
    pairs, _ = _rates(spark, d, F.col("y"), "factor-rates")
    return factors.predicted(pairs, "supplier", "part", factors.fit(pairs, "supplier", "part", "v", "w", 4, 6, 5.0))


@query("component_run", over(EVENTS, "SELECT event_id, (s + 200.0::DOUBLE * 0.2::DOUBLE) / (n + 200.0::DOUBLE) AS steady, (s + 20.0::DOUBLE * 0.2::DOUBLE) / (n + 20.0::DOUBLE) AS quick, n >= 20 AS known FROM ev"))
def component_run(spark, d):
    """Two registered components with guards, aligned with the ids of the log in one plan."""
    share = lambda c: {"share": F.col(c).between(0, 1)}
    parts = Registry("event_id")
    parts.register("steady", ("state",), {"steady": "double"}, share("steady"))(lambda t: t.select("event_id", eb("s", "n", 0.2, 200).alias("steady")))
    parts.register("quick", ("state",), {"quick": "double", "known": "boolean"}, share("quick"))(lambda t: t.select("event_id", eb("s", "n", 0.2, 20).alias("quick"), (F.col("n") >= 20).alias("known")))
    ev = events(spark, d)
    return parts.run(table(spark, d, "events").select("event_id"), {"state": ev})


@query("output_contract", over(EVENTS, "SELECT count(*) AS n, 0::BIGINT AS repeated, 0::BIGINT AS missing, 0::BIGINT AS extra, 0::BIGINT AS outside FROM ev"))
def output_contract(spark, d):
    ev = events(spark, d)
    return C.output_contract(ev.select("event_id", eb("s", "n", 0.2, 200).alias("p")), ev.select("event_id"), "event_id", "p")


@query("contract_violations", over(EVENTS, "SELECT count(*) AS n, count(*) FILTER (NOT (s <= n)) AS counter, count(*) FILTER (NOT coalesce(rate BETWEEN 0 AND 1, false)) AS rate_range, count(*) FILTER (NOT (season BETWEEN 0 AND 5)) AS season, count(*) FILTER (abs(coalesce(rate, 0) * n - s) > 1e-6) AS exact FROM ev"))
def contract_violations(spark, d):
    """Broken rules of the as-of state: counters, ranges, exactness. A rate is unknown where the counter is 0."""
    c = F.col
    return C.violations(events(spark, d), {"counter": c("s") <= c("n"), "rate_range": c("rate").between(0, 1), "season": c("season").between(0, 5), "exact": F.abs(F.coalesce("rate", F.lit(0.0)) * c("n") - c("s")) <= 1e-6})


@query("temporal_guard", over(ITEMS, "SELECT target, max(season) AS last_history, max(season) < target AS strict FROM (SELECT season, unnest([1998, 2000]) AS target FROM items) WHERE season < target GROUP BY target"))
def temporal_guard(spark, d):
    """The latest history behind each target season."""
    t = items(spark, d).groupBy("season").count().withColumn("target", F.explode(F.array(F.lit(1998), F.lit(2000)))).filter("season < target")
    return t.groupBy("target").agg(F.max("season").alias("last_history")).withColumn("strict", F.col("last_history") < F.col("target"))


@query("leakage_guard")
def leakage_guard(spark, d):
    """Feature names that contain an id, a season or the target."""
    found = C.leaking([*form(spark, d).columns], ["id", "season", "y"])
    return spark.createDataFrame([(c,) for c in found], "name string")


@query("row_independence", "SELECT unnest(['dealt_anew', 'split', 'repeated', 'alone']) AS name, 0::BIGINT AS only_one_side, 0.0::DOUBLE AS largest")
def row_independence(spark, d):
    """Scoring against frozen tables gives each row the same value in any company."""
    ev = keep(events(spark, d).select("event_id", "user_id", "n", "s", "season"), "independence-rows")
    frozen = keep(ev.filter("season < 3").groupBy("user_id").agg((F.sum("s") / F.sum("n")).alias("prior")), "independence-frozen")
    score = lambda rows: rows.join(frozen, "user_id", "left").select("event_id", eb("s", "n", F.coalesce("prior", F.lit(0.2)), 50).alias("p"))
    return C.row_independence(ev.filter("season >= 3"), score, "event_id", "p")


@query("implementation_diff", over(EVENTS, "SELECT 0::BIGINT AS only_one_side, 0.0::DOUBLE AS largest"))
def implementation_diff(spark, d):
    """Two forms of one formula, joined in full."""
    ev = events(spark, d)
    a, b = ev.select("event_id", eb("s", "n", 0.2, 50).alias("p")), ev.select("event_id", ((F.col("s") + F.lit(10.0)) / (F.col("n") + F.lit(50.0))).alias("p"))
    return C.largest_difference(a, b, "event_id", "p")


@query("simplex_check", over(EVENTS, "SELECT count(DISTINCT user_id) AS n, 0::BIGINT AS sums, 0::BIGINT AS signs FROM ev"))
def simplex_check(spark, d):
    types = ["click", "error", "purchase", "signup", "view"]
    p = events(spark, d).groupBy("user_id").agg(*[F.avg((F.col("event_type") == t).cast("double")).alias(t) for t in types])
    total = reduce(lambda a, b: a + b, [F.col(t) for t in types])
    return C.violations(p, {"sums": F.abs(total - 1) < 1e-9, "signs": F.least(*types) >= 0})


@query("schema_redundancy", over(ITEMS, "SELECT count(*) AS groups, count(*) FILTER (v > 1) AS broken FROM (SELECT cnt, count(DISTINCT hand) AS v FROM items GROUP BY cnt)"))
def schema_redundancy(spark, d):
    """Whether one column is a function of another."""
    g = items(spark, d).groupBy("cnt").agg(F.count_distinct("hand").alias("v"))
    return g.agg(F.count(F.lit(1)).alias("groups"), F.count(F.when(F.col("v") > 1, 1)).alias("broken"))
