"""Boosting, optimal assignment, composite stream state and distillation against plain versions."""

import random
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from yesterlog.operators import assign, boost


def best_assignment(pairs):
    """Most pairs, then least distance, of one block by trying all."""
    left = sorted({a for a, _ in pairs})

    @cache
    def best(k, taken):
        if k == len(left):
            return 0, 0.0
        found = [best(k + 1, taken)]
        for (a, b), d in pairs.items():
            if a == left[k] and b not in taken:
                n, s = best(k + 1, taken | {b})
                found.append((n + 1, s - d))
        return max(found)

    n, s = best(0, frozenset())
    return n, -s


@pytest.mark.parametrize("part", [2048, 5])
def test_assignment_is_optimal(spark, part):
    rng, rows, want = random.Random(8), [], {}
    for block in range(2 if part == 5 else 12):
        na, nb = rng.randint(1, 8), rng.randint(1, 8)
        pairs = {(block * 100 + a, block * 100 + b): rng.choice([0.0, 0.25, round(rng.random(), 3)]) for a in range(na) for b in range(nb) if rng.random() < rng.choice([0.3, 0.9])}
        if pairs:
            want[block] = best_assignment(pairs)
            rows += [(block, a, b, d) for (a, b), d in pairs.items()]
    rows += [(rows[0][0], rows[0][1], rows[0][2], 9.0), (None, 1, 1, 0.0), (0, None, 1, 0.0), (0, 1, 1, None)]
    table = spark.createDataFrame(rows, "k long, x long, y long, d double").repartition(3)
    got = assign.assignment(table, "x", "y", "d", "k", 1e-6, part).collect()
    assert max(r.gap for r in got) < 1e-4
    for block, (n, s) in want.items():
        mine = [r for r in got if r.block == block]
        assert len(mine) == len({r.a for r in mine}) == len({r.b for r in mine}) == n
        assert abs(sum(r.distance for r in mine) - s) < 1e-4
    assert assign.assignment(table.limit(0), "x", "y", "d", "k").count() == 0


@pytest.fixture(scope="module")
def classed(spark):
    """Three classes by a rule that no linear model has; a feature is missing now and then."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 3))
    c = np.where(abs(x[:, 0]) > 0.3 + abs(x[:, 1]), 0, np.where(x[:, 2] > 0, 1, 2))
    c = np.where(rng.random(3000) < 0.1, rng.integers(0, 3, 3000), c)
    rows = [(i, int(c[i]), *[None if rng.random() < 0.02 else float(v) for v in x[i]]) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, c int, a double, b double, z double").repartition(4).cache()


def log_loss(rows, p):
    return rows.join(p, "id").agg(F.avg(-F.log(F.col("p")[F.col("c")]))).first()[0]


def test_boosting_learns_and_is_resumed(spark, classed):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    from yesterlog.operators.model import assemble

    train, rest = classed.filter("id % 3 > 0"), classed.filter("id % 3 = 0")
    f = ["a", "b", "z"]
    model = boost.fit(train, "c", f, 3, rounds=6, depth=3, rate=0.6)
    boosted = log_loss(rest, boost.predict(rest, "id", model))
    linear = LogisticRegression(labelCol="c", family="multinomial").fit(assemble(train, f)).transform(assemble(rest, f)).select("id", vector_to_array("probability").alias("p"))
    assert boosted < log_loss(rest, linear) - 0.1
    saved = boost.from_table(boost.to_table(spark, model))
    values = lambda e: {r.id: r.p for r in boost.predict(rest, "id", e).collect()}
    assert values(saved) == values(boost.fit(train, "c", f, 3, rounds=0, start=saved)) == values(model)
    half = boost.fit(train.repartition(7), "c", f, 3, rounds=3, depth=3, rate=0.6, start=boost.fit(train, "c", f, 3, rounds=3, depth=3, rate=0.6))
    assert values(half) == values(model)  # resumed on the same rows it is the same ensemble, however rows are dealt
    frozen = boost.fit(rest, "c", f, 3, rounds=2, least_gain=0.0, start=saved)
    assert frozen.edges == saved.edges and all((x.value == y.value).all() for x, y in zip(frozen.rounds, saved.rounds, strict=False)) and len(frozen.rounds) == len(saved.rounds) + 2


def test_boosting_without_anything_to_learn(spark):
    rows = spark.createDataFrame([(i, i % 2, None, 1.0) for i in range(80)], "id long, c int, a double, b double")
    model = boost.fit(rows, "c", ["a", "b"], 2, rounds=3)
    assert not model.rounds and {tuple(np.round(r.p, 12)) for r in boost.predict(rows, "id", model).collect()} == {(0.5, 0.5)}
    with pytest.raises(Exception, match="label"):
        boost.fit(rows.withColumn("c", F.lit(None).cast("int")), "c", ["a", "b"], 2, rounds=1)


def test_ordered_rates_see_earlier_rows_only(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["x", "x", "y", None]), rng.randint(0, 1)) for i in range(200)]
    got = {r.id: r.t_rate for r in boost.ordered_rates(spark.createDataFrame(rows, "id long, k string, t int").repartition(5), "k", ["id"], ["t"], 4.0, 0.5).collect()}
    for i, k, _ in rows:
        before = [t for j, q, t in rows if j < i and q == k]
        assert abs(got[i] - (sum(before) + 2) / (len(before) + 4)) < 1e-12


def test_student_equals_newton(spark):
    """Coefficients of every fold's model equal those of a plain reweighted fit on the other folds; no segment is on both sides."""
    from yesterlog.operators import distill

    rng = np.random.default_rng(5)
    n = 600
    x, seg = rng.normal(size=(n, 2)), rng.integers(0, 40, n)
    y = 1 / (1 + np.exp(-(0.5 + x @ [1.0, -2.0]))) * 0.9 + 0.1 * rng.random(n)
    rows = [(i, None if i == 7 else int(seg[i]), None if i == 9 else float(y[i]), None if i == 11 else float(x[i, 0]), float(x[i, 1])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, seg int, y double, a double, b double").repartition(4).withColumn("fold", distill.fold_of(F.col("seg"), 3))
    assert df.groupBy("seg").agg(F.count_distinct("fold").alias("k")).filter("k > 1").count() == 0
    betas = distill.fit(df, "y", "fold", ["a", "b"], 3, steps=4, ridge=0.5)
    fold = {r.id: r.fold for r in df.collect()}
    x[11, 0] = 0
    full = np.column_stack([np.ones(n), x])
    for k in range(3):
        use = np.array([fold[i] is not None and fold[i] != k and i != 9 for i in range(n)])
        beta = np.zeros(3)
        for _ in range(4):
            eta = full[use] @ beta
            p = 1 / (1 + np.exp(-eta))
            w = p * (1 - p)
            beta = np.linalg.solve((full[use] * w[:, None]).T @ full[use] + np.diag([0, 0.5, 0.5]), (full[use] * w[:, None]).T @ (eta + (y[use] - p) / w))
        assert np.allclose(beta, betas[k], atol=1e-8)
    got = {r.id: r.p for r in distill.scored(df, "id", "fold", ["a", "b"], betas).collect()}
    assert len(got) == n and abs(got[0] - 1 / (1 + np.exp(-(full[0] @ betas[fold[0]])))) < 1e-9


def test_additive_shapes(spark):
    """Shapes follow the truth, a pair is found where two features work together only, and scores are lookups."""
    from yesterlog.operators import additive

    rng = np.random.default_rng(6)
    n = 4000
    x = rng.normal(size=(n, 4))
    p = 1 / (1 + np.exp(-(1.5 * np.sign(x[:, 0]) + 2.0 * np.sign(x[:, 1] * x[:, 2]))))
    rows = [(i, int(rng.random() < p[i]), *[None if i % 97 == 0 and k == 3 else float(v) for k, v in enumerate(x[i])]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double, c double, e double").repartition(3)
    f = ["a", "b", "c", "e"]
    shapes = additive.fit(df, "y", f, cycles=3, pairs=1)
    assert [t for t in shapes.terms if len(t) == 2] == [(1, 2)]
    got = {r.id: r.p for r in additive.scored(df, "id", shapes).collect()}
    loss = lambda q: -np.mean([np.log(q[r[0]] if r[1] else 1 - q[r[0]]) for r in rows])
    single = {r.id: r.p for r in additive.scored(df, "id", additive.fit(df, "y", f, cycles=3, pairs=0)).collect()}
    assert loss(got) < loss(single) - 0.1 < np.log(2) - 0.1
    table = {(r.term, r.cell): r["shape"] for r in additive.to_table(spark, shapes).collect()}
    for i, _, *values in rows[:60]:
        at = [0 if v is None else 1 + int(np.searchsorted(shapes.edges[k], v)) for k, v in enumerate(values)]
        pair = int(shapes.coarse(1)[at[1]]) * 9 + int(shapes.coarse(2)[at[2]])
        logit = table["", 0] + sum(table.get((f[k], c), 0.0) for k, c in enumerate(at)) + table.get(("b*c", pair), 0.0)
        assert abs(1 / (1 + np.exp(-logit)) - got[i]) < 1e-9


def plain_sessions(rows, gap, expiry):
    out, state = [], {}
    for event, key, us, y in sorted(rows):
        s = state.get(key)
        if s and us - s["last"] > gap:
            out.append((key, *s["close"]()))
            if us - s["last"] > expiry:
                s = None
        if s is None or us - s["last"] > gap:
            done = s["done"] if s else []
            s = state[key] = {"done": done, "since": us, "first": event, "n": 0, "y": 0}

            def close(s=s):
                ring = s["done"][-5:]
                before = [sum(x[k] for x in s["done"]) for k in (0, 1)]
                last = [sum(x[k] for x in ring) if len(ring) == 5 else None for k in (0, 1)]
                row = (len(s["done"]) + 1, s["first"], s["n"], s["y"], s["last"] - s["since"], *before, *last)
                s["done"] = [*s["done"], (s["n"], s["y"])]
                return row

            s["close"] = close
        s["last"], s["n"], s["y"] = us, s["n"] + 1, s["y"] + y
    return sorted(out + [(k, *s["close"]()) for k, s in state.items()], key=str)


def test_composite_state_over_restarts(spark):
    """Sessions that batches split, a ring that fills, and a key whose state expires, held against a plain version."""
    from yesterlog.streaming import asof, sessions

    rng, us, rows = random.Random(9), 10**15, []
    for event in range(400):
        us += rng.choice([1, 1, 1, 3, 20]) * 60 * 10**6
        rows.append((event, rng.choice([1, 2, 3] if event % 200 < 120 else [1, 2]), us, rng.randint(0, 1)))
    gap, expiry = 30 * 60 * 10**6, 300 * 60 * 10**6
    end = (400, -1, us + 2 * expiry, 0)
    df = spark.createDataFrame([*rows, end], "event_id long, user long, us long, y int").withColumn("ts", F.timestamp_micros("us").cast("timestamp_ntz"))

    def make(path):
        stream = asof.read_events(spark, path, "1 minute")
        return sessions.closed_sessions(stream, "user", "event_id", "y", "ts", gap, expiry)

    turns = [df.filter((F.col("event_id") >= a) & (F.col("event_id") < b)) for a, b in ((0, 97), (97, 98), (98, 260), (260, 400), (400, 401))]
    with sessions.rocksdb(spark):
        got = asof.resumed(make, turns, "session-test").filter("key > 0").collect()
    assert sorted(map(tuple, got), key=str) == plain_sessions(rows, gap, expiry)
    assert any(r.n_last is not None for r in got) and any(r.session == 1 and r.first_event > 150 for r in got)


def test_factors_equal_numpy(spark):
    """Rank 3 with biases against plain normal equations; the penalised loss never rises."""
    from yesterlog.operators import factors

    rng = np.random.default_rng(4)
    pairs = [(i, j, float(v), float(w)) for i in range(12) for j in range(9) if rng.random() < 0.7 for v, w in [(rng.normal(), rng.integers(1, 5))]]
    df = spark.createDataFrame([*pairs, (None, 1, 0.5, 1.0), (1, 1, None, 1.0), (1, 1, 0.5, 0.0)], "x long, y long, v double, w double").repartition(3)
    clean = df.na.drop().filter("w > 0")
    losses = []
    for rounds in (1, 2, 4):
        got = factors.fit(df, "x", "y", "v", "w", 3, rounds, 0.5)
        losses.append(factors.penalised_loss(clean, "x", "y", "v", "w", got, 0.5))
    assert losses == sorted(losses, reverse=True)
    right = {r.y: np.array([r.bias, *r.factors]) for r in factors._start(clean, "y", 3).collect()}
    total = sum(w for *_, w in pairs)
    mean = sum(v * w for *_, v, w in pairs) / total

    def solve(side, k):
        out = {}
        for key in {p[k] for p in pairs}:
            mine = [p for p in pairs if p[k] == key]
            x = np.array([[1.0, *side[p[1 - k]][1:]] for p in mine])
            t = np.array([p[2] - mean - side[p[1 - k]][0] for p in mine])
            w = np.array([p[3] for p in mine])
            out[key] = np.linalg.solve((x * w[:, None]).T @ x + 0.5 * np.eye(4), (x * w[:, None]).T @ t)
        return out

    for _ in range(4):
        left = solve(right, 0)
        right = solve(left, 1)
    for r in got.left.collect():
        assert np.allclose([r.bias, *r.factors], left[r.x], atol=1e-8)
    for r in got.right.collect():
        assert np.allclose([r.bias, *r.factors], right[r.y], atol=1e-8)


def test_components_are_refused_by_name(spark):
    from yesterlog.operators.component import Registry

    ids = spark.range(20)
    r = Registry("id")
    r.register("good", ("ids",), {"p": "double"}, {"share": F.col("p").between(0, 1)})(lambda t: t.select("id", (F.col("id") / 20).alias("p")))
    r.register("few", ("ids",), {"q": "bigint"})(lambda t: t.filter("id > 3").select("id", F.col("id").alias("q")))
    r.register("many", ("ids",), {"m": "bigint"})(lambda t: t.union(t.filter("id = 5")).select("id", F.col("id").alias("m")))
    r.register("more", ("ids",), {"x": "bigint"})(lambda t: spark.range(21).select("id", F.col("id").alias("x")))
    r.register("high", ("ids",), {"h": "double"}, {"any": F.lit(True), "share": F.col("h") <= 1})(lambda t: t.select("id", (F.col("id") / 10).alias("h")))
    r.register("other", ("ids",), {"o": "double"})(lambda t: t.select("id", F.col("id").alias("o")))
    assert sorted(map(tuple, r.run(ids, {"ids": ids}, ["good"]).collect())) == [(i, i / 20) for i in range(20)]
    for name, text in {"few": "component few lacks id 0", "many": "component many repeats id 5", "more": "component more has an extra id 20", "high": "component high breaks guard share"}.items():
        with pytest.raises(Exception, match=text.rsplit(" ", 1)[0] if name == "few" else text):
            r.run(ids, {"ids": ids}, ["good", name]).collect()
    with pytest.raises(ValueError, match="component other"):
        r.run(ids, {"ids": ids}, ["other"])
    with pytest.raises(ValueError, match="not given"):
        r.run(ids, {}, ["good"])
    with pytest.raises(ValueError, match="taken"):
        r.register("again", ("ids",), {"p": "double"})
        r.register("again", ("ids",), {"p": "double"})(lambda t: t)


def test_low_rank_equals_numpy(spark):
    from yesterlog.operators import model

    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(40, 5)), 3)
    rows = [(i, "odd" if i % 2 else None, *map(float, x[i])) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, part string, a double, b double, c double, d double, e double").repartition(3)
    names = list("abcde")

    def plain(m, rank):
        u, s, v = np.linalg.svd(m, full_matrices=False)
        return (u[:, :rank] * s[:rank]) @ v[:rank]

    got = {r.id: tuple(r)[1:] for r in model.low_rank(df, "id", names, 2).collect()}
    assert np.allclose([got[i] for i in range(40)], plain(x, 2))
    got = {r.id: tuple(r)[1:] for r in model.low_rank_by(df, "part", "id", names, 2).collect()}
    for k in (0, 1):
        assert np.allclose([got[i] for i in range(k, 40, 2)], plain(x[k::2], 2))
