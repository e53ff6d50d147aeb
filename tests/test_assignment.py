"""Assignment between classes of equal entities, against the same between the entities."""

import numpy as np

from yesterlog.operators import assign
from yesterlog.operators import tiles as T
from yesterlog.plans import matching


def test_classes_count_as_their_members(spark):
    rng = np.random.default_rng(7)
    left, right, pairs, whole = [], [], [], []
    for block in range(6):
        sizes = [rng.integers(1, 4, rng.integers(1, 5)).tolist() for _ in range(2)]
        ids = [[[1000 * block + 10 * k + i for i in range(n)] for k, n in enumerate(s)] for s in sizes]
        left += [(i, c[0]) for c in ids[0] for i in c]
        right += [(i, c[0]) for c in ids[1] for i in c]
        for x in ids[0]:
            for y in ids[1]:
                if rng.random() < 0.7:
                    d = float(rng.choice([0.0, 0.25, 0.5, round(rng.random(), 3)]))
                    pairs.append((block, x[0], y[0], d))
                    whole += [(block, i, j, d) for i in x for j in y]
    table = lambda rows: spark.createDataFrame(rows, "k long, x long, y long, d double")
    members = [spark.createDataFrame(m, "id long, of long") for m in (left, right)]
    known = {(r[1], r[2]): r[3] for r in whole}
    totals = []
    for got in (assign.assignment(table(whole), "x", "y", "d", "k"), assign.assignment(table(pairs), "x", "y", "d", "k", left=members[0], right=members[1])):
        got = got.collect()
        assert all(r.gap < 1e-9 and known[r.a, r.b] == r.distance for r in got)
        assert len({r.a for r in got}) == len({r.b for r in got}) == len(got)
        totals.append((len(got), round(sum(r.distance for r in got), 9)))
    assert totals[0] == totals[1]


def test_copies_of_users_are_classes(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    n = 40
    copies = spark.range(n).selectExpr("id AS copy").crossJoin(events.withColumnRenamed("user_id", "u")).selectExpr("event_id + copy * 1000000 AS event_id", "ts", "u + copy * 8000 AS user_id", "event_type", "value", "props")
    copies.write.parquet(f"{tmp_path}/events.parquet")
    of, _ = T.classes(matching.packed(spark, str(tmp_path))[0], "a")
    one, _ = T.classes(matching.packed(spark, "/root/testdata/sf0.001")[0], "a")
    assert of.count() == one.count()
    total = lambda d: matching.optimal_assignment(spark, d).selectExpr("count(*)", "count(DISTINCT a)", "count(DISTINCT b)", "round(sum(distance), 5)", "max(gap) < 1e-6").first()
    few, many = total("/root/testdata/sf0.001"), total(str(tmp_path))
    assert many[0] == many[1] == many[2] == n * few[0] and abs(many[3] - n * few[3]) < 1e-3 and few[4] and many[4]
