"""Larger tables: pairs in tiles, candidates by classes, factors from bucketed pairs, sessions from one state a key."""

import random

import numpy as np
import pytest

from yesterlog.operators import factors, match, tiles
from yesterlog.sources import io
from yesterlog.streaming import sessions


def values(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def shares(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(40) * 2 + k % 2, rng.randrange(3), rng.choice("vwx")) for k in range(1600)]
    rows += [(None, 1, "v"), (None, 0, "w"), (8, None, "v"), (9, 1, None), (200, 7, "v"), (201, 8, "v")]
    df = spark.createDataFrame(rows, "u int, season int, kind string").selectExpr("u", "u div 2 % 3 as block", "season", "kind")
    return df.filter("u % 2 = 0 or u is null").withColumnRenamed("u", "a"), df.filter("u % 2 = 1 or u is null").withColumnRenamed("u", "b")


@pytest.fixture(scope="module")
def sides(shares):
    return [match.fingerprint(t, k, ["block", "season", "kind"]) for t, k in zip(shares, "ab", strict=True)]


@pytest.fixture(scope="module")
def packed(sides):
    return [tiles.packed(t, k, ["block"], ["season", "kind"]) for t, k in zip(sides, "ab", strict=True)]


@pytest.mark.parametrize("tile", [3, 4096])
def test_tiles_equal_the_join(sides, packed, tile):
    joined = match.half_l1(*sides, "a", "b", ["block", "season", "kind"])
    assert values(tiles.distances(*packed, "a", "b", tile)) == values(joined)
    want = values(match.nearest(joined, "a", "b"))
    for k in (2, 9):
        assert values(match.nearest(tiles.nearest_few(*packed, "a", "b", k, tile), "a", "b")) == want


@pytest.mark.parametrize("tile", [3, 4096])
def test_full_distances_in_tiles_equal_the_join(spark, shares, sides, packed, tile):
    profiles = [t.groupBy(k, "season").agg({"kind": "max"}).selectExpr(k, "season", f"case when {k} % 5 <> 1 then hash({k}, season) % 7 / 10 end as m", f"case when season = 0 then {k} div 2 % 2 else 0 end as team") for t, k in zip(shares, "ab", strict=True)]
    want = match.full_distance(match.half_l1(*sides, "a", "b", ["block", "season", "kind"]), *profiles, "a", "b", "season", ["m"], "team")
    left, right = (tiles.with_profile(t, p, k, "season", ["m"], "team") for t, p, k in zip(packed, profiles, "ab", strict=True))
    got = tiles.full_distances(left, right, "a", "b", 1, tile)
    assert values(got) == values(want) and {r.mismatches for r in got.collect()} == {0, 1}


def test_pairs_are_made_in_tasks(spark):
    """No join or shuffle of the matching queries has a row for each pair."""
    from yesterlog import catalog

    for name in ("all_pairs_blocked_distance", "full_match_distance", "nearest_margin", "agreement_guard"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "least(" not in plan


def test_rounding_is_sparks(spark):
    x = [1 / 1024, 3 / 2048, 0.1234567895, 1e-10, 0.0, 1.0, 0.9999999995, 5e-10, *np.random.default_rng(1).random(500).tolist()]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").selectExpr("round(x, 9)").collect()]
    assert tiles.rounded(np.array(x), 9).tolist() == want


def test_votes_by_classes_equal_the_join(spark, shares):
    left, right = shares
    met = left.select("a", "block", "season").distinct().join(right.select("b", "block", "season").distinct(), ["block", "season"])
    rows = {}
    for r in met.groupBy("a", "b").count().collect():
        rows.setdefault(r.a, []).append((-r["count"], r.b))
    want = [(a, min(v)[1], -min(v)[0], -sum(n for n, _ in v)) for a, v in rows.items()]
    got = match.most_votes(left, right, "a", "b", ["block"], "season")
    assert values(got) == sorted(want)
    assert "size(array_intersect" in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_batch_reads_and_writes_a_keys_state_once():
    """However many sessions close in it."""
    import pandas as pd

    calls = []

    class State:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    class Handle:
        state = State()

        def getValueState(self, name, schema):
            return self.state

        def registerTimer(self, at):
            calls.append("register")

        def deleteTimer(self, at):
            calls.append("delete")

    s = sessions.Sessions(10, 10**6)
    s.init(Handle())
    for turn in range(2):
        f = pd.DataFrame({"event": range(50), "us": [turn * 5000 + 100 * i for i in range(50)], "y": [1] * 50})
        out = pd.concat(s.handleInputRows((3,), iter([f]), None))
        assert len(out) == 49 + turn and out["n_before"].tolist() == list(range(50 * turn - turn, 99 * turn + 49 * (1 - turn)))
    assert calls == ["get", "register", "update", "get", "delete", "register", "update"]


def test_bucketed_pairs_stay_where_they_are(spark):
    rng = random.Random(2)
    pairs = spark.createDataFrame([(rng.randrange(20), rng.randrange(99), rng.random(), 1.0) for _ in range(900)], "x int, y int, _v double, _w double")
    known = io.bucketed(pairs.repartition(3, "y"), "y", "test-pairs", 3)
    for key, other in (("x", "y"), ("y", "x")):
        plan = factors._solve(known, key, other, io.keep(factors._start(known, other, 2), "test-side"), 0.5, 2, 1.0)._jdf.queryExecution().executedPlan().toString()
        shuffles = [s for s in plan.splitlines() if "Exchange hashpartitioning" in s]
        assert len(shuffles) == (key == "x")  # of sums in each bucket; none where pairs are grouped by their bucket's key
    assert io.buckets(0) == 1 and io.buckets(10**6) == 4 and io.buckets(36 * 10**6) == 32 and io.buckets(10**9) == 125


@pytest.mark.parametrize("few", [2, 64])
def test_peeling_from_lists_equals_peeling_pairs(sides, packed, few):
    steps = [(0.5, 0.05), (1.0, 0.0)]
    joined = io.keep(match.half_l1(*sides, "a", "b", ["block", "season", "kind"]), "test-pairs")
    want = values(match.peel(joined, "a", "b", steps, io.keep))
    assert values(tiles.peel(*packed, "a", "b", steps, few, 8)) == want and len(want) > 20


def test_near_copies_hold_few_rows_at_once(spark, monkeypatch):
    """Batches to Python are small while the stage runs, and as before afterwards."""
    from yesterlog.llm import near_copies

    seen, name, cut = [], "spark.sql.execution.arrow.maxRecordsPerBatch", near_copies.cut
    monkeypatch.setattr(near_copies, "cut", lambda df, n: seen.append(int(spark.conf.get(name))) or cut(df, n))
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(i, f"one two three four five {i % 2}") for i in range(4)], "doc_id long, text string")
    assert {r.root for r in near_copies.near_copies(docs).collect()} and set(seen) == {near_copies.BATCH} and spark.conf.get(name) == before
