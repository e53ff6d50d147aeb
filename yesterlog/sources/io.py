"""Sources and sinks: CSV, Parquet, JSON artifacts, table stores with manifests, fingerprinted caches, load generation.

Everything is read and written by Spark, so any store that Spark reaches will do; paths need no local disk.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_own: str | None = None


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, which all executors share; only in local mode without that setting, in a folder of this process."""
    global _own
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if _own is None:
            _own = tempfile.mkdtemp(prefix="yesterlog-")
            atexit.register(shutil.rmtree, _own, True)
        root = _own
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df and reads it back, so that later steps neither recompute it nor depend on one executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def buckets(rows: int) -> int:
    """Buckets for a table of so many rows: 32 for most, fewer for a small one, more so that none has over eight million."""
    return max(1, min(-(-rows // 250_000), max(32, -(-rows // 8_000_000))))


def bucketed(df: DataFrame, key: str, name: str, n: int) -> DataFrame:
    """Writes df, whose rows lie by repartition(n, key), as n buckets; joins and groups by key over it need no shuffle of its rows."""
    path = scratch(df.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


#: Rows of a side of a join that is sent to all executors.
SENT = 1_000_000


def sent_if_small(side: DataFrame) -> DataFrame:
    """A written table for a join, sent to all executors if it has at most SENT rows, so that the other side stays where it is."""
    return F.broadcast(side) if side.count() <= SENT else side


def forget(df: DataFrame) -> None:
    """Deletes a table that `keep` wrote, once no later step reads it."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_csv(spark: SparkSession, path: str, schema: StructType | str, floats: bool = False) -> DataFrame:
    """A CSV with a header that may start with a byte order mark; floats stores doubles as 32-bit floats."""
    # the header is checked by place, not by name, since a mark would be part of the first name
    df = spark.read.schema(schema).csv(path, header=True, enforceSchema=True, encoding="UTF-8")
    return df.select(*[F.col(c).cast("float").alias(c) if floats and t == "double" else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, order: str | None = None) -> None:
    """One header for each part; with `order`, parts hold ascending ranges of it, so that no single task sorts all rows."""
    (df.repartitionByRange(order).sortWithinPartitions(order) if order else df).write.mode("overwrite").csv(path, header=True)


def prefix_seasons(df: DataFrame, season: str, last: int) -> DataFrame:
    """Rows up to a season; a filter that reaches Parquet statistics or partition folders."""
    return df.filter(F.col(season) <= last)


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """Rows, and a hash that depends on neither their order nor their partitions."""
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return int(row[0]), str(row[1])


def write_json(spark: SparkSession, path: str, value) -> None:
    spark.createDataFrame([(json.dumps(value, sort_keys=True, default=float),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str):
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect() if r.value))


def save_bundle(spark: SparkSession, path: str, tables: dict[str, DataFrame], meta: dict) -> None:
    """A folder of Parquet tables with a manifest of their schemas, sizes and fingerprints; no pickles."""
    manifest = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        rows, mark = fingerprint(spark.read.parquet(f"{path}/{name}"))
        manifest[name] = {"schema": df.schema.jsonValue(), "rows": rows, "fingerprint": mark}
    write_json(spark, f"{path}/manifest", {"meta": meta, "tables": manifest})


def load_bundle(spark: SparkSession, path: str, verify: bool = True) -> tuple[dict[str, DataFrame], dict]:
    manifest = read_json(spark, f"{path}/manifest")
    tables = {}
    for name, m in manifest["tables"].items():
        df = spark.read.schema(StructType.fromJson(m["schema"])).parquet(f"{path}/{name}")
        if verify and fingerprint(df) != (m["rows"], m["fingerprint"]):
            raise ValueError(f"table {name} of {path} is not what its manifest says")
        tables[name] = df
    return tables, manifest["meta"]


def cached(spark: SparkSession, path: str, source: DataFrame, make: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, bool]:
    """make(source), read from `path` if it was made from the same rows and schema there before. Returns the table and whether it was reused."""
    own = [source.schema.json(), *fingerprint(source)]
    try:
        known = read_json(spark, f"{path}/mark")
    except Exception as e:  # no cache yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    if known != own:
        make(source).write.mode("overwrite").parquet(f"{path}/rows")
        write_json(spark, f"{path}/mark", own)
    return spark.read.parquet(f"{path}/rows"), known == own


def write_once(spark: SparkSession, path: str, value: dict) -> dict:
    """Stores a result; a later run must bring the same one."""
    try:
        known = read_json(spark, path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        write_json(spark, path, value)
        return value
    if known != json.loads(json.dumps(value, default=float)):
        raise ValueError(f"{path} was locked with another result")
    return known


def generate_load(seed_rows: DataFrame, key: str, rows: int, guarded: list[str], seed: int = 42) -> DataFrame:
    """`rows` rows made of the seed rows in turn, with new ids; guarded columns stay together, numeric others are drawn from their range.

    Draws are a hash of the new id and the column's place, so they depend neither on partitions nor on the engine. The seed is
    numbered by ranges of its key; only a table of two figures for each column is sent to all tasks.
    """
    from ..operators.blend import PRIME, hash_draw
    from ..operators.ranked import running

    spark = seed_rows.sparkSession
    free = [c for c, t in seed_rows.dtypes if c not in (key, *guarded) and t in ("int", "bigint", "double")]
    ranges = seed_rows.agg(F.count(F.lit(1)).alias("_n"), *[f(c).alias(f"_{n}_{c}") for c in free for n, f in (("low", F.min), ("high", F.max))])
    n = ranges.first()._n
    numbered = running(seed_rows, [], [key], {"_i": F.lit(1)}).drop(key)
    out = spark.range(rows).withColumn("_i", F.col("id") % n).join(numbered, "_i").crossJoin(F.broadcast(ranges))
    types = dict(seed_rows.dtypes)
    drawn = {c: (F.col(f"_low_{c}") + hash_draw(F.col("id"), F.lit(seed + i)) / PRIME * (F.col(f"_high_{c}") - F.col(f"_low_{c}"))).cast(types[c]) for i, c in enumerate(free)}
    return out.select(F.col("id").alias(key), *[drawn.get(c, F.col(c)).alias(c) for c in seed_rows.columns if c != key])
