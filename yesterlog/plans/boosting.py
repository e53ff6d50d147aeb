"""Boosted five-class models (category codes from earlier rows, histograms, training, continuation), additive models and distilled students."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..operators import additive as AD
from ..operators import boost as B
from ..operators import distill as D
from ..sources.io import keep, scratch
from .features import _FORM, form
from .registry import EVENTS, events, over, query

TYPES = ["click", "error", "purchase", "signup", "view"]
_NUMERIC = ["n", "smooth", "r1", "r3", "r5", "balls", "strikes", "outs", "hand", "k"]
_STRENGTH = 20.0


def code():
    return F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")) - 1


@query("ordered_target_rates", over(EVENTS, "SELECT event_id, " + ", ".join(
    f"round((coalesce(sum(CAST(event_type = '{t}' AS INT)) OVER w, 0) + 4.0::DOUBLE) / (row_number() OVER (PARTITION BY k ORDER BY event_id) - 1 + 20.0::DOUBLE), 9) AS {t}_rate" for t in TYPES) + " FROM ev WINDOW w AS (PARTITION BY k ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
def ordered_target_rates(spark, d):
    """A category's class rates from strictly earlier rows, by ranges, so that one category may hold any share of the rows."""
    rows = events(spark, d).select("event_id", "k", *[(F.col("event_type") == t).cast("int").alias(t) for t in TYPES])
    return B.ordered_rates(rows, "k", ["event_id"], TYPES, _STRENGTH, 0.2).select("event_id", *[F.round(f"{t}_rate", 9).alias(f"{t}_rate") for t in TYPES])


def rows_of(spark, d):
    rows = form(spark, d).select("event_id", "season", code().alias("code"), *_NUMERIC, *[(F.col("event_type") == t).cast("int").alias(t) for t in TYPES])
    return keep(B.ordered_rates(rows, "k", ["event_id"], TYPES, _STRENGTH, 0.2).drop(*TYPES), "boost-features")


_FEATURES = [*_NUMERIC, *[f"{t}_rate" for t in TYPES]]


@query("boosted_five_class")
def boosted_five_class(spark, d):
    """Softmax boosting of the five event types, learned from seasons 0-3 and scored on later ones."""
    rows = rows_of(spark, d)
    model = B.fit(rows.filter("season < 4"), "code", _FEATURES, len(TYPES), rounds=8)
    return B.predict(rows.filter("season >= 4"), "event_id", model).select("event_id", *[F.col("p")[i].alias(f"p{i}") for i in range(len(TYPES))])


@query("boosted_continued")
def boosted_continued(spark, d):
    """An ensemble of seasons 0-2, saved as a table, is resumed on season 3 with its trees frozen and scores later seasons."""
    rows = rows_of(spark, d)
    path = scratch(spark, "boost-model")
    B.to_table(spark, B.fit(rows.filter("season < 3"), "code", _FEATURES, len(TYPES), rounds=4)).write.parquet(path)
    model = B.fit(rows.filter("season = 3"), "code", _FEATURES, len(TYPES), rounds=3, start=B.from_table(spark.read.parquet(path)))
    return B.predict(rows.filter("season >= 4"), "event_id", model).select("event_id", *[F.col("p")[i].alias(f"p{i}") for i in range(len(TYPES))])


#: Fixed edges and a fixed first split of the histogram query.
_EDGES = {"n": [5, 10, 20, 40, 80], "smooth": [0.18, 0.19, 0.2, 0.21, 0.22], "r3": [0.0, 0.34, 0.67]}
_BIN = {f: f"CASE WHEN {f} IS NULL THEN 0 ELSE 1 + " + " + ".join(f"CAST({f} > {e}::DOUBLE AS INT)" for e in edges) + " END" for f, edges in _EDGES.items()}


@query("boost_level_sums", over(_FORM, ", t AS (SELECT *, CAST(n > 20 AS INT) AS node FROM fm WHERE season < 4), c AS (SELECT unnest([0, 1, 2, 3, 4]) AS class, unnest(['click', 'error', 'purchase', 'signup', 'view']) AS type), p AS (SELECT class, type, (count(t.event_id) + 1)::DOUBLE / (SELECT count(*) + 5 FROM t) AS p FROM c LEFT JOIN t ON t.event_type = type GROUP BY ALL), b AS ("
  + " UNION ALL ".join(f"SELECT event_type, node, {k} AS feature, {_BIN[f]} AS bin FROM t" for k, f in enumerate(_EDGES))
  + ") SELECT class, node, feature, bin, sum(CAST(floor((p - CAST(event_type = type AS INT)) * 1048576 + 0.5) AS BIGINT))::BIGINT AS g, sum(CAST(floor(p * (1 - p) * 1048576 + 0.5) AS BIGINT))::BIGINT AS h, count(*) AS n FROM b, p GROUP BY ALL"))
def boost_level_sums(spark, d):
    """The second level's gradient and hessian sums of the first round, after a split of all classes at n = 20."""
    rows = form(spark, d).filter("season < 4").select(code().alias("code"), *_EDGES)
    rows = keep(rows, "boost-level")
    seen = {r[0]: r[1] for r in rows.groupBy("code").count().collect()}
    counts = [seen.get(k, 0) + 1 for k in range(len(TYPES))]
    start = B.Ensemble(tuple(_EDGES), tuple(map(tuple, _EDGES.values())), tuple(math.log(c / sum(counts)) for c in counts))
    feature, cut = np.zeros((len(TYPES), 1), dtype=np.int64), np.full((len(TYPES), 1), 1 + _EDGES["n"].index(20))
    return B.level_sums(B.prepared(rows, "code", start), len(_EDGES), len(TYPES), feature, cut, 1)


_TEACH = _FORM + """, st AS (SELECT event_id, user_id % 5 AS fold, n / 100.0::DOUBLE AS x1, hand::DOUBLE AS x2, 0.7::DOUBLE * smooth + 0.3::DOUBLE * y AS label FROM fm)"""


def taught(spark, d):
    """Rows with the blended label of truth and teacher (the user's shrunk rate before the event) and a fold for each user."""
    rows = form(spark, d).select("event_id", "user_id", (F.col("user_id") % 5).cast("int").alias("fold"), (F.col("n") / 100).alias("x1"), F.col("hand").cast("double").alias("x2"), *_NUMERIC, "y")
    return keep(rows.withColumn("label", D.blended(F.col("y"), F.col("smooth"), 0.7)), "taught")


@query("student_step", over(_TEACH, """, m AS (SELECT unnest(range(5)) AS model), v AS (SELECT model, count(*) AS n, avg(x1) AS a1, avg(x2) AS a2, avg((label - 0.5) * 4) AS az, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(x1, (label - 0.5) * 4) AS s1z, covar_pop(x2, (label - 0.5) * 4) AS s2z FROM m JOIN st ON fold <> model GROUP BY model),
  b AS (SELECT *, (s22 * s1z - s12 * s2z) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2z - s12 * s1z) / (s11 * s22 - s12 * s12) AS b2 FROM v) SELECT model::INT AS model, n, round(az - b1 * a1 - b2 * a2, 6) AS b0, round(b1, 6) AS b1, round(b2, 6) AS b2 FROM b"""))
def student_step(spark, d):
    """Each fold's coefficients after one reweighted step from zero, from Gram sums."""
    rows = taught(spark, d)
    zero = np.zeros((5, 3))
    betas = D.step(rows, "label", "fold", ["x1", "x2"], zero)
    sizes = D.step_sums(rows, "label", "fold", ["x1", "x2"], zero).select("model", "n")
    by_model = F.array(*[F.array(*[F.lit(float(v)) for v in b]) for b in betas])
    return sizes.select("model", "n", *[F.round(by_model[F.col("model")][i], 6).alias(f"b{i}") for i in range(3)])


@query("student_scores")
def student_scores(spark, d):
    """Every event scored by the student that hasn't seen its user; learned from blended labels."""
    rows = taught(spark, d).drop("x1", "x2")
    betas = D.fit(rows, "label", "fold", _NUMERIC, 5)
    return D.scored(rows, "event_id", "fold", _NUMERIC, betas)


@query("student_folds", over(_TEACH, "SELECT fold::INT AS fold, count(DISTINCT user_id) AS segments, count(*) AS n, 0::BIGINT AS shared FROM st JOIN fm USING (event_id) GROUP BY fold"))
def student_folds(spark, d):
    """The folds' segments and rows, and how many of their segments another fold has too."""
    by_user = taught(spark, d).groupBy("user_id").agg(F.collect_set("fold").alias("folds"), F.count(F.lit(1)).alias("n"))
    each = by_user.select(F.explode("folds").alias("fold"), "n", (F.size("folds") > 1).cast("long").alias("more"))
    return each.groupBy("fold").agg(F.count(F.lit(1)).alias("segments"), F.sum("n").alias("n"), F.sum("more").alias("shared"))


_ADDED = ["n", "smooth", "r3"]


@query("additive_first_cycle", over(_FORM, ", t AS (SELECT * FROM fm WHERE season < 4), p AS (SELECT (sum(y) + 1)::DOUBLE / (count(*) + 2) AS p FROM t), b AS ("
  + " UNION ALL ".join(f"SELECT {k} AS term, {_BIN[f]} AS cell, y FROM t" for k, f in enumerate(_ADDED))
  + ") SELECT term, cell, sum(CAST(floor((p - y) * 1048576 + 0.5) AS BIGINT))::BIGINT AS g, sum(CAST(floor(p * (1 - p) * 1048576 + 0.5) AS BIGINT))::BIGINT AS h, count(*) AS n FROM b, p GROUP BY ALL"))
def additive_first_cycle(spark, d):
    """The sums by bin that the additive model's first shapes are made from."""
    rows = keep(form(spark, d).filter("season < 4").select("y", *_ADDED), "additive-first")
    s, n = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    edges = tuple(tuple(_EDGES[f]) for f in _ADDED)
    shapes = AD.Shapes(_ADDED, edges, math.log((s + 1) / (n - s + 1)))
    state = B.prepared(rows, "y", B.Ensemble(tuple(_ADDED), edges, (0.0, 0.0)))
    return AD.term_sums(state, shapes, [(k,) for k in range(len(_ADDED))])


@query("additive_model")
def additive_model(spark, d):
    """An additive model with pairs, learned from seasons 0-3; later seasons are scored by lookups in its shape tables."""
    rows = rows_of(spark, d).join(events(spark, d).select("event_id", "y"), "event_id")
    shapes = AD.fit(rows.filter("season < 4"), "y", ["n", "smooth", "r3", "r5", "balls", "k"], cycles=2)
    return AD.scored(rows.filter("season >= 4"), "event_id", shapes)
