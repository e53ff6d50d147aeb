"""Helpers shared by the corpus operators: shared-folder tables, hashing tables and Arrow row access."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (only in local mode without that setting) a folder of this process."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="yesterlog-")
        atexit.register(shutil.rmtree, _own_dir, True)
    return _own_dir


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/yesterlog-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back, so later steps neither recompute it nor depend on one executor."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def rows_a_batch(spark: SparkSession, most: int):
    """No more rows than this go to a Python worker at once, in the jobs run inside."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, min(most, int(before)) if int(before) > 0 else most)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def first_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """groups: doc_id, h (xxhash64 of the text), root. The row of docs with the least doc_id (null last) of each root, once if it is repeated."""
    # a row is carried as one struct, so that no name of its columns can clash
    key = {"none": F.col("doc_id").isNull(), "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "h": F.xxhash64(F.coalesce("text", F.lit("")))}
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("h").alias("h"))).alias("k")
    first = groups.groupBy("root").agg(least).select("k.*")
    rows = docs.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in key.items()])
    return rows.join(first, list(key), "left_semi").dropDuplicates(list(key)).select("row.*")


#: What operators keep in a worker process from task to task, cleared by `release`.
KEPT: list[dict] = []


def kept(cache: dict) -> dict:
    """Marks a module's cache as one that `release` may clear."""
    KEPT.append(cache)
    return cache


def release(*own: dict) -> None:
    """Gives back what other operators have left in this worker, which Spark reuses: all caches but `own`, freed Arrow and C memory."""
    others = [cache for cache in KEPT if cache and not any(cache is x for x in own)]
    if others:
        for cache in others:
            cache.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # no glibc
            pass


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def byte_table(seed: int) -> np.ndarray:
    """256 random odd 64-bit numbers, the same in every process."""
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def batches(rows: list[tuple], names: list[str], types: list[pa.DataType], size: int = 8192):
    """Record batches of rows, in order."""
    for i in range(0, len(rows), size):
        cols = zip(*rows[i : i + size], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
