"""Every query of the catalogue against its SQL in DuckDB, and the entry point with and without the corpus operators."""

import decimal
import math
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from tests.conftest import ROOT, SMALL
from yesterlog import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        assert not math.isnan(v)
        return float(f"{float(v):.9g}") + 0.0
    return v


def rows_of(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    cur = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    df = catalog.queries()[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.select(*names).collect()) == rows_of(cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_without_corpus_operators(tmp_path):
    shutil.copytree(f"{ROOT}/yesterlog", tmp_path / "yesterlog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
