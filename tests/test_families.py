"""Families of regressors on residuals, against their parts."""

import random

import pytest
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import functions as F

from tests.conftest import SMALL
from yesterlog import catalog
from yesterlog.operators import model


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    data = []
    for i in range(400):
        x, z = rng.random(), rng.random()
        data.append((i, x, z, 0.3 + 0.4 * (x > 0.5) + 0.2 * z, None if i == 7 else 0.5))
    return model.assemble(spark.createDataFrame(data, "id int, x double, z double, y double, base double"), ["x", "z"])


def test_family_is_the_mean_of_bounded_members(rows):
    families = {"tree": DecisionTreeRegressor(maxDepth=2, seed=1), "line": LinearRegression()}
    out = {r.id: r for r in model.residual_family(families, rows, rows, "y", "base", ["id", "y"]).collect()}
    alone = LinearRegression(labelCol="e").fit(rows.withColumn("e", F.col("y") - F.col("base")).filter("e is not null")).transform(rows)
    for r in alone.collect():
        got = out[r.id]
        if r.base is None:
            assert got.tree is None and got.line is None and got.p is None
            continue
        assert abs(got.line - min(max(r.base + r.prediction, 1e-6), 1 - 1e-6)) < 1e-9
        assert abs(got.p - (got.tree + got.line) / 2) < 1e-12
    loss = lambda f: sum((f(r) - r.y) ** 2 for r in out.values() if r.p is not None)
    assert loss(lambda r: r.p) < 0.3 * loss(lambda r: 0.5)


def test_members_stay_off_the_ends(rows):
    far = rows.withColumn("y", F.col("y") * 10)
    out = model.residual_family({"line": LinearRegression()}, far, rows, "y", "base", ["id"]).filter("p is not null")
    assert out.agg(F.max("line")).first()[0] == 1 - 1e-6


def test_query_bounds_and_mean(spark):
    out = catalog.queries()["model_residual_family"](spark, SMALL)
    bad = out.filter((F.abs(F.col("p") - (F.col("boosted") + F.col("forest") + F.col("line")) / 3) > 1e-12) | ~F.col("p").between(1e-6, 1 - 1e-6))
    assert out.count() > 0 and bad.count() == 0
