"""Edge cases of the composable operators: nulls, ties, gaps, unseen keys, degenerate scores, repeated keys, stored tables."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from yesterlog.functions import expr as X
from yesterlog.operators import aggregate as A
from yesterlog.operators import asof, blend, contract, lookup, match, model
from yesterlog.operators import score as K
from yesterlog.operators import shrink as S
from yesterlog.sources import io


def values(df):
    return [tuple(r) for r in df.collect()]


def test_clip_and_rates_keep_null(spark):
    df = spark.createDataFrame([(None, 0), (2.0, 4), (-1.0, 1)], "x double, n int")
    assert values(df.select(X.clip("x", 0, 1), X.rate("x", "n"))) == [(None, None), (1.0, 0.5), (0.0, -1.0)]


def test_row_statistics(spark):
    df = spark.createDataFrame([(None, None, 1.0), (1.0, 2.0, None), (None, None, None)], "a double, b double, c double")
    got = values(df.select(X.row_mean("a", "b", "c"), F.round(X.row_std("a", "b", "c"), 6)))
    assert got == [(1.0, None), (1.5, 0.707107), (None, None)]


def test_bins_at_their_edges(spark):
    df = spark.createDataFrame([(10.0,), (10.5,), (None,)], "x double")
    assert values(df.select(X.cut_right("x", [10, 20]), X.cut_left("x", [10, 20]))) == [(0, 1), (1, 1), (None, None)]


def test_two_date_formats(spark):
    df = spark.createDataFrame([("2024-01-31",), ("01/31/2024",), ("x",)], "d string")
    assert [str(r[0]) for r in df.select(X.either_date("d")).collect()] == ["2024-01-31", "2024-01-31", "None"]


def test_mode_takes_the_smaller_of_equals(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, v string")
    assert sorted(values(A.mode_by(df, ["k"], "v").select("k", "v", "votes", "of_all"))) == [(1, "a", 1, 2), (2, "c", 1, 1)]


def test_sessions_treat_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "a"), (1, 4, None)], "u int, t int, g string")
    assert sorted(values(asof.sessionize(df, ["u"], ["t"], [F.col("g")]).select("t", "session"))) == [(1, 1), (2, 1), (3, 2), (4, 3)]


def test_labels_are_not_recovered_across_gaps(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 3, 2), (1, 4, 4)], "u int, n int, s int")
    assert sorted(values(asof.recover_labels(df, ["u"], "n", "s").select("n", "label")), key=str) == [(0, 1), (1, None), (3, None), (4, None)]


def test_trailing_needs_every_row(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 2, None), (1, 3, 1), (1, 4, 1), (1, 5, 1)], "u int, t int, y int")
    assert sorted(values(asof.trailing(df, ["u"], ["t"], ["y"], 2).select("t", "y_last2")), key=str) == [(1, None), (2, None), (3, None), (4, None), (5, 2)]


def test_asof_join_is_strict(spark):
    left = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "x"), (1, 2, "w")], "k int, t int, v string")
    assert sorted(values(asof.asof_join(left, right, ["k"], "t", ["v"]).select("k", "t", "v")), key=str) == [(1, 5, "w"), (1, 6, "x"), (2, 5, None)]


def test_average_ranks(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 1.0), (1, 3.0)], "k int, v double")
    assert sorted(r.rank for r in asof.average_rank(df, ["k"], "v").collect()) == [1.0, 2.5, 2.5]


def test_lookup_defaults_and_repeated_keys(spark):
    left = spark.createDataFrame([(1,), (9,)], "k int")
    table = spark.createDataFrame([(1, 0.5)], "k int, v double")
    assert sorted(values(lookup.attach(left, table, ["k"], {"v": 0.0}, check=True).select("k", "v", "seen"))) == [(1, 0.5, 1), (9, 0.0, 0)]
    with pytest.raises(lookup.NotUnique):
        lookup.attach(left, table.unionByName(table), ["k"], {"v": 0.0}, check=True)


def test_hierarchy_is_a_sum_of_steps(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 0), ("b", 2, 1)], "g string, e int, y int")
    tables = S.hierarchy(df, [["g"], ["g", "e"]], [10, 5], 0.5)
    p = {r.e: r.p for r in tables[1].collect()}
    got = {r.e: r.effect for r in S.apply_hierarchy(df.select("g", "e").distinct(), tables).collect()}
    assert all(abs(got[e] - (p[e] - 0.5)) < 1e-12 for e in p)
    assert values(S.apply_hierarchy(spark.createDataFrame([("z", 7)], "g string, e int"), tables).select("effect")) == [(0.0,)]


def test_degenerate_scores(spark):
    df = spark.createDataFrame([(0.0, 1), (1.0, 1)], "p double, y int")
    assert values(df.agg(K.skill("p", "y"))) == [(None,)]
    assert values(K.auc(df.withColumn("k", F.lit(0)), "p", "y", ["k"]).select("auc")) == [(None,)]
    both = spark.createDataFrame([(0, 0.3, 0), (0, 0.3, 1), (0, 0.9, 1)], "k int, p double, y int")
    assert values(K.auc(both, "p", "y", ["k"]).select("auc")) == [(0.75,)]


def test_blend_solves():
    m, w = np.array([[2.0, 0.5], [0.5, 1.0]]), np.array([0.3, 0.7])
    assert np.allclose(blend.on_simplex(m, m @ w), w, atol=1e-4)
    assert np.allclose(blend.truncated(m, m @ w), w) and np.allclose(blend.ridge(m, m @ w, 0.0), w)
    assert np.allclose(blend.vertex((0, 1, 2), (0, 3, 4)), (2.0, 4.0))


def test_box_weights_are_the_best_of_the_box():
    for seed in range(20):
        g = np.random.default_rng(seed)
        x = g.normal(size=(30, 2))
        m, b = x.T @ x / 30, g.normal(size=2) * 2
        w = blend.in_box(m, b)
        grid = np.linspace(-1, 1, 201)
        loss = lambda u: u @ m @ u / 2 - b @ u
        assert np.abs(w).max() <= 1 and loss(w) <= min(loss(np.array([u, v])) for u in grid for v in grid) + 1e-12


def test_stress_scores_each_solution_on_the_whole(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(200, 2))
    t = x @ [0.5, -2.0] + g.normal(size=200) / 10
    df = spark.createDataFrame([(i % 5, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, t, strict=True))], "part int, a double, b double, t double")
    parts = blend.grams(df, "part", ["a", "b"], "t")
    m, b, n = blend.gram(df, ["a", "b"], "t")
    assert np.allclose(sum(p[0] for p in parts), m) and np.allclose(sum(p[1] for p in parts), b) and sum(p[2] for p in parts) == n == 200
    got = blend.stress(parts, ["a", "b"], 3)
    best = np.linalg.solve(m, b)
    score = lambda w: 100000 * (2 * b @ w - w @ m @ w) / n
    assert np.allclose(got[0][2:], [*best, score(best)], atol=1e-5) and got[1][3] == -1 and abs(got[2][3] - b[1] / m[1, 1]) < 1e-6 and got[2][2] == 0
    scores = [score(np.linalg.solve(sum(parts[i][0] for i in c) * n / sum(parts[i][2] for i in c), b)) for c in combinations(range(5), 3)]
    assert np.allclose([r[-1] for r in got[-3:]], np.percentile(scores, [5, 50, 95]), atol=1e-4)


def test_full_distance(spark):
    pairs = spark.createDataFrame([(1, 10, 0.25), (1, 20, 0.5), (2, 10, 0.0)], "a long, b long, distance double")
    left = spark.createDataFrame([(1, 0, 0.5, "x"), (1, 1, None, "x"), (2, 0, 1.0, "y"), (2, 1, 1.0, "y")], "a long, season int, mix double, team string")
    right = spark.createDataFrame([(10, 0, 0.1, "x"), (10, 1, 0.2, "x"), (20, 1, 0.3, "z")], "b long, season int, mix double, team string")
    got = match.full_distance(pairs, left, right, "a", "b", "season", ["mix"], "team")
    assert sorted(values(got)) == [(1, 10, 0.9, 0), (1, 20, 1.7, 1)]  # 2 and 10 differ in two seasons


def test_biases_are_removed(spark):
    rows = [(a, b, 1.0 + a + 10.0 * b, 2.0) for a in range(3) for b in range(4)]
    got = model.without_bias(spark.createDataFrame(rows, "a int, b int, v double, w double"), "a", "b", "v", "w", 0.0)
    assert all(abs(r.v) < 1e-9 for r in got.collect()) and got.count() == 12


def test_gram_counts_null_as_zero(spark):
    m, b, n = blend.gram(spark.createDataFrame([(1.0, None, 2.0), (2.0, 1.0, 1.0)], "a double, b double, t double"), ["a", "b"], "t")
    assert m.tolist() == [[5.0, 2.0], [2.0, 1.0]] and b.tolist() == [4.0, 1.0] and n == 2


def test_contracts(spark):
    out = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, None), (4, 1.5)], "id int, p double")
    assert values(contract.output_contract(out, spark.createDataFrame([(1,), (2,), (3,)], "id int"), "id", "p")) == [(4, 1, 1, 1, 2)]
    with pytest.raises(contract.Broken):
        contract.require(out, contract.probability_rules("p"))
    assert contract.leaking(["user_id", "smooth", "hidden"], ["id"]) == ["user_id"]


def test_row_dependence_is_found(spark):
    rows = spark.range(20).select("id", (F.col("id") % 3).alias("x"))
    dependent = lambda df: df.crossJoin(F.broadcast(df.agg(F.avg("x").alias("m")))).select("id", (F.col("x") - F.col("m")).alias("p"))
    got = {r.name: r.largest for r in contract.row_independence(rows, dependent, "id", "p").collect()}
    assert got["alone"] > 0 and got["dealt_anew"] < 1e-12


def test_peeling_is_one_to_one(spark):
    pairs = spark.createDataFrame([(1, 10, 0.1), (1, 11, 0.3), (2, 10, 0.2), (2, 11, 0.25), (3, 10, 0.9)], "a int, b int, distance double")
    got = match.peel(pairs, "a", "b", [(0.5, 0.0), (1.0, 0.0)], io.keep)
    assert sorted(values(got.select("a", "b", "round"))) == [(1, 10, 0), (2, 11, 1)]


def test_peeling_leaves_no_free_pair(spark):
    rows = [(a, b, round(((a * 7 + b * 13) % 29) / 29, 9)) for a in range(12) for b in range(12) if (a * 5 + b) % 4]
    got = match.peel(spark.createDataFrame(rows, "a int, b int, distance double"), "a", "b", [(0.3, 0.02), (1.0, 0.0)], io.keep).collect()
    used_a, used_b = {r.a for r in got}, {r.b for r in got}
    assert len(used_a) == len(used_b) == len(got)
    assert all(a in used_a or b in used_b for a, b, _ in rows)
    # a plain version of the rounds
    left, wanted, k = rows, set(), 0
    while True:
        most, margin = [(0.3, 0.02), (1.0, 0.0)][min(k, 1)]
        of_a, of_b = {}, {}
        for a, b, d in left:
            of_a.setdefault(a, []).append((d, b))
            of_b.setdefault(b, []).append((d, a))
        near = {a: sorted(v) for a, v in of_a.items()}
        lock = {(a, v[0][1]) for a, v in near.items() if min(of_b[v[0][1]])[1] == a and v[0][0] <= most and round((v[1][0] if len(v) > 1 else 1) - v[0][0], 9) >= margin}
        wanted |= {(a, b, k) for a, b in lock}
        left = [r for r in left if r[0] not in {a for a, _ in lock} and r[1] not in {b for _, b in lock}]
        k += 1
        if k >= 2 and (not lock or not left):
            break
    assert {(r.a, r.b, r.round) for r in got} == wanted


def test_trees_route_missing_values(spark):
    tree = {"feature": "x", "threshold": 1, "missing": "right", "left": {"value": -1}, "right": {"value": 1}}
    assert values(spark.createDataFrame([(1.0,), (2.0,), (None,)], "x double").select(model.tree_column(tree))) == [(-1.0,), (1.0,), (1.0,)]


def test_csv_with_a_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,x\n1,0.5\n2,\n".encode())
    assert sorted(values(io.read_csv(spark, str(tmp_path / "a.csv"), "id long, x double")), key=str) == [(1, 0.5), (2, None)]


def test_bundles_are_verified(spark):
    path = io.scratch(spark, "bundle")
    io.save_bundle(spark, path, {"t": spark.range(3)}, {"k": 1})
    tables, meta = io.load_bundle(spark, path)
    assert tables["t"].count() == 3 and meta == {"k": 1}
    spark.range(4).write.mode("overwrite").parquet(f"{path}/t")
    with pytest.raises(ValueError):
        io.load_bundle(spark, path)


def test_cache_follows_its_source(spark):
    path, make = io.scratch(spark, "cache"), lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    assert [io.cached(spark, path, spark.range(n), make)[1] for n in (5, 5, 6)] == [False, True, False]


def test_results_are_locked(spark):
    path = io.scratch(spark, "lock")
    assert io.write_once(spark, path, {"a": 1}) == io.write_once(spark, path, {"a": 1})
    with pytest.raises(ValueError):
        io.write_once(spark, path, {"a": 2})
