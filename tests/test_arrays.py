"""Array files as a source and sink, and moments solved from scores, against numpy."""

import json

import numpy as np
import pytest
from pyarrow import fs

from yesterlog.operators import blend
from yesterlog.sources import arrays


@pytest.fixture(scope="module")
def read(spark):
    arrays.register(spark)
    return lambda path, rows=7, **options: spark.read.format("arrays").option("rowsPerPartition", rows).options(**options).load(str(path))


def numbers(n=40):
    rng = np.random.default_rng(3)
    return {"id": np.arange(n), "small": rng.integers(-9, 9, n).astype(np.int8), "wide": rng.normal(size=(n, 3)).astype(np.float32), "word": np.array([f"wö{i}" for i in range(n)]), "even": np.arange(n) % 2 == 0, "big": np.arange(n, dtype=">u8") + 2**63}


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_archives(read, tmp_path, save):
    t = numbers()
    save(tmp_path / "t.npz", **t)
    got = sorted(read(tmp_path / "t.npz").collect())
    assert [r.row for r in got] == list(range(40))
    for name, a in t.items():
        assert [r[name] for r in got] == a.tolist(), name
    pruned = read(tmp_path / "t.npz", members="word, id")
    assert pruned.columns == ["row", "word", "id"] and pruned.rdd.getNumPartitions() == 6


def test_plain_arrays_and_folders(read, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(10.0))
    np.save(tmp_path / "b.npy", np.arange(10.0, 12.0))
    assert sorted(map(tuple, read(tmp_path).collect())) == [(i, float(i)) for i in range(12)]
    assert read(tmp_path / "b.npy").count() == 2


def test_empty_and_refused(read, spark, tmp_path):
    np.save(tmp_path / "none.npy", np.empty(0))
    assert read(tmp_path / "none.npy").count() == 0
    (tmp_path / "empty").mkdir()
    np.savez(tmp_path / "ragged.npz", a=np.arange(3), b=np.arange(4))
    np.save(tmp_path / "object.npy", np.array([{}, 1], dtype=object))
    for path in ("empty", "ragged.npz", "object.npy"):
        with pytest.raises(Exception):
            read(tmp_path / path).count()
    for bad in ("cast(null as int) as a", "array_repeat(1, cast(id as int)) as a"):
        with pytest.raises(Exception):
            spark.range(3).selectExpr(bad).coalesce(1).write.format("arrays").mode("append").save(str(tmp_path / "bad"))


def test_written_and_read(read, spark, tmp_path):
    df = spark.range(100).selectExpr("id", "id * 0.5D as half", "cast(id as string) as word", "array(id, id + 1) as pair").repartition(3)
    path = tmp_path / "out"
    df.write.format("arrays").mode("append").save(str(path))
    assert sorted(map(tuple, read(path).drop("row").collect())) == sorted(map(tuple, df.collect()))
    # a file of a lost task is not listed, so it is not read
    np.savez(path / "part-000009-lost.npz", id=np.arange(5))
    assert read(path).count() == 100
    df.write.format("arrays").mode("append").save(str(path))
    assert read(path).count() == 200
    df.write.format("arrays").mode("overwrite").save(str(path))
    assert read(path).count() == 100
    spark.range(0).write.format("arrays").mode("overwrite").save(str(path))
    assert json.loads((path / arrays.MANIFEST).read_text()) == {"files": []}


def test_pruned_read_touches_its_range_only(tmp_path, monkeypatch):
    n = 100_000
    np.savez(tmp_path / "t.npz", a=np.arange(n), b=np.arange(n) * 2.0)
    seen = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def __getattr__(self, name):
            return getattr(self.f, name)

        def read(self, k=None):
            data = self.f.read(k if k is None or k >= 0 else None)
            seen.append(len(data))
            return data

        def read_at(self, k, at):
            seen.append(k)
            return self.f.read_at(k, at)

    class Store:
        local = fs.LocalFileSystem()
        open_input_file = lambda self, p: Counted(self.local.open_input_file(p))

    path = str(tmp_path / "t.npz")
    monkeypatch.setattr(arrays, "opened", lambda uri: (Store(), uri))
    batch = list(arrays.ArrayReader(path, ["b"], 1000).read(arrays.Range(path, 0, 5000, 6000)))
    assert batch[0].column("b").to_pylist() == [2.0 * i for i in range(5000, 6000)]
    assert sum(seen) < 8 * 1000 + 70_000 < 8 * n


def test_moments_from_scores():
    rng = np.random.default_rng(5)
    for rate in (0.1, 0.45, 0.7):
        y = (rng.random(4000) < rate).astype(float)
        p, q = y * 0.1 + rng.random(4000) * 0.5, y * 0.2 + rng.random(4000) * 0.6
        r = y.mean()
        p = r + np.cov(p, y, bias=True)[0, 1] / p.var() * (p - p.mean())
        score = lambda u, v, c: 100000 * (1 - ((u * p + v * q + c - y) ** 2).mean() / (r * (1 - r)))  # noqa: E731, B023
        probes = [(u, v, c, score(u, v, c)) for u, v, c in ((0.4, 0.4, 0.0), (0.6, 0.7, 0.02), (0.9, 0.3, -0.05))]
        got = blend.exact_geometry(score(1, 0, 0), score(0, 1, 0), score(0.5, 0.5, 0), score(0, 1, -0.1), score(0, 1, 0.1), 0.1, probes)
        scale = 100000 / (r * (1 - r))
        cov = scale * np.cov(np.stack([p, q, y]), bias=True)
        want = {"a1": cov[0, 2], "a2": cov[1, 2], "b12": cov[0, 1], "b22": cov[1, 1], "rate": r, "bias": q.mean() - r, "best_score": cov[:2, 2] @ np.linalg.solve(cov[:2, :2], cov[:2, 2])}
        assert got["feasible"] and got["residual"] < 1e-9
        assert all(abs(got[k] - x) < 1e-5 * max(1, abs(x)) for k, x in want.items()), (got, want)


def test_moments_that_no_predictions_have():
    # a third prediction's scores do not belong to these two: no solution, or one that is called infeasible
    out = blend.exact_geometry(1000.0, 900.0, 2000.0, -3000.0, -3100.0, 0.1, [(0.4, 0.4, 0.0, -500.0), (0.6, 0.7, 0.02, 9000.0), (0.9, 0.3, -0.05, 100.0)])
    assert out is None or not out["feasible"]
    assert blend.exact_geometry(1.0, 1.0, 1.0, 2.0, 2.0, 0.1, []) is None
