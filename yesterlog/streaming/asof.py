"""Streams over the event log: windows with watermarks, deduplication and the as-of state kept online."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..sources.io import scratch


def read_events(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """A stream of Parquet events. Event time is cast, since watermarks need a TIMESTAMP (session time zone UTC)."""
    schema = spark.read.parquet(path).schema
    # as a pattern the path may be one file as well as a folder
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is available and reads what it wrote; restartable from its checkpoint folder."""
    spark = stream.sparkSession
    out, schema = scratch(spark, f"{name}-out"), stream.schema
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(spark, f"{name}-state")).trigger(availableNow=True)
    if mode == "complete":
        # each batch holds the whole result, so the last one replaces the others
        run = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out)).start()
    else:
        run = writer.format("parquet").option("path", out).start()
    run.awaitTermination()
    if run.exception():
        raise RuntimeError(str(run.exception()))
    return spark.read.schema(schema).parquet(out)


def resumed(make: Callable[[str], DataFrame], turns: list[DataFrame], name: str) -> DataFrame:
    """Appends each turn of a log to a folder and runs the stream make(folder) over what is new, from the checkpoint of the run before.

    State goes from turn to turn by the checkpoint, as it does when a job is stopped and started again.
    """
    spark = turns[0].sparkSession
    source, out, state = scratch(spark, f"{name}-source"), scratch(spark, f"{name}-out"), scratch(spark, f"{name}-state")
    for rows in turns:
        rows.write.mode("append").parquet(source)
        stream = make(source)
        run = stream.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).format("parquet").option("path", out).start()
        run.awaitTermination()
        if run.exception():
            raise RuntimeError(str(run.exception()))
    return spark.read.schema(stream.schema).parquet(out)


def online_state(stream: DataFrame, key: str, order: str, y: str) -> DataFrame:
    """key, order, n, s: for each event the number of the key's events before it and the sum of their y.

    A batch's events of a key are taken in `order`, and batches must arrive in it; state is emitted before it is updated, so that
    it never holds the event itself. The state of a key is two numbers. A key's events of one batch are held at once, so a source
    with very active keys needs small batches (maxFilesPerTrigger).
    """

    def run(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, s = state.get if state.exists else (0, 0)
        f = pd.concat(list(frames)).sort_values(order)
        before = f[y].cumsum() - f[y] + s
        state.update((n + len(f), s + int(f[y].sum())))
        yield pd.DataFrame({key: f[key], order: f[order], "n": range(n, n + len(f)), "s": before})

    return stream.select(key, order, y).groupBy(key).applyInPandasWithState(run, f"{key} long, {order} long, n long, s long", "n long, s long", "append", GroupStateTimeout.NoTimeout)


def once(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Drops repeats that arrive within the watermark; older keys leave the state."""
    return stream.dropDuplicatesWithinWatermark(keys)


def each_batch(stream: DataFrame, f: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Applies a batch function to every micro-batch and appends its rows."""
    spark = stream.sparkSession
    out = scratch(spark, f"{name}-out")
    run = stream.writeStream.option("checkpointLocation", scratch(spark, f"{name}-state")).trigger(availableNow=True).foreachBatch(lambda rows, k: f(rows).write.mode("overwrite").parquet(f"{out}/batch={k}")).start()
    run.awaitTermination()
    return spark.read.parquet(out)
