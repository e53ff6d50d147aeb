"""Harmonic packing of documents into sequences of `capacity` tokens.

A piece of length l is in class k = capacity // l, that is, its length lies in (capacity/(k+1), capacity/k], and each bin of the
class takes exactly k pieces of one length. Cutting is free, so documents are cut at the class bounds that are powers of two:
full sequences, then halves, quarters, ... down to `least_cut`; the rest, shorter than that, is a piece of its own. The cut pieces
fill their bins without padding, and a bin of short pieces wastes less than one of them.

Workers fill bins independently: each task numbers its pieces of a length as it makes them, one count for each (task, length)
gives the tasks' first numbers, and number // k is the bin. Only the last, partial bin of each length is left; these are fewer
than sum(capacity / l) pieces over all lengths l in use, whatever the input, and are packed together, longest first.

Defined results: null or empty texts have only the end id; rows with equal doc_id are separate documents with equal values of
`start`; an empty table gives no pieces. Lengths of sequences are below `capacity` only in bins of short pieces and in the last
few; the last may end at a power of two, which needs no padding.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, cut, load, release, rows_a_batch
from .tokens import _encoders, encoder, vocabulary

CAPACITY, LEAST_CUT, END_ID = 2048, 64, 1
#: Documents that wait in a Python worker at once.
BATCH = 1000
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, number long"


def cut_lengths(n: int, capacity: int = CAPACITY, least_cut: int = LEAST_CUT) -> list[int]:
    """Lengths of the pieces of a document of n tokens, in order."""
    out, piece = [], capacity
    while n:
        while piece > n and piece >= least_cut:
            piece //= 2
        out.append(n if piece < least_cut else piece)
        n -= out[-1]
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, least_cut: int = LEAST_CUT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece: its document and place there, its checksum (and ids), and its number among the task's pieces of that length."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "number"] + ["ids"] * with_ids
    types = [pa.int64()] * 5 + [pa.int32(), pa.int64()] + [pa.binary()] * with_ids

    def run(frames: Iterator[pa.RecordBatch]):
        release(_encoders)
        enc, end, made, task = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes(), Counter(), TaskContext.get().partitionId()
        for frame in frames:
            out = []
            for doc, ids in zip(frame.column(0).to_pylist(), enc.encode_column(frame.column(1), end), strict=True):
                n, start = len(ids) // 4, 0
                for length in cut_lengths(n, capacity, least_cut):
                    own = ids[4 * start : 4 * (start + length)]
                    out.append((doc, start, length, zlib.crc32(own), n, task, made[length], own)[: len(names)])
                    made[length] += 1
                    start += length
            yield from batches(out, names, types)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECE + ", ids binary" * with_ids)


def _first_fit(capacity: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "number"], ascending=[False, True], ignore_index=True)
        used, at, offset = np.zeros(len(frame), dtype=np.int64), [], []
        for n in frame["length"]:
            k = int(np.argmax(used + n <= capacity))
            at.append(k)
            offset.append(int(used[k]))
            used[k] += n
        return pd.DataFrame({"length": frame["length"], "number": frame["number"], "bin": at, "offset": offset})

    return run


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Gives each piece of `pieces` (written once, as task and number must not change) its sequence_id and offset."""
    counts = made.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("length")
    bases = counts.select(F.col("task").alias("of_task"), F.col("length").alias("of_length"), F.coalesce(F.sum("n").over(w.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("n").over(w).alias("total"))
    per_bin = F.expr(f"{capacity} div length")
    dealt = made.join(bases, (F.col("task") == F.col("of_task")) & (F.col("length") == F.col("of_length"))).withColumn("number", F.col("number") + F.col("base")).withColumn("k", per_bin)
    dealt = dealt.withColumn("full", F.col("number") < F.expr("total div k * k")).drop("of_task", "of_length", "base", "total", "task")
    stride = 2 * capacity
    full = dealt.filter("full").withColumn("sequence_id", F.expr(f"number div k * {stride} + length")).withColumn("offset", F.expr("number % k * length"))
    rest = dealt.filter("not full")
    fitted = rest.select("length", "number", F.lit(0).alias("all")).groupBy("all").applyInPandas(_first_fit(capacity), "length long, number long, bin long, offset long")
    rest = rest.join(fitted, ["length", "number"]).withColumn("sequence_id", F.expr(f"bin * {stride}")).drop("bin")
    return full.unionByName(rest).drop("full", "k", "number")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (, ids), sequence_id, offset for every piece of every document."""
    # texts and ids wait in batches on both sides of the pipe to Python
    with rows_a_batch(docs.sparkSession, BATCH):
        made = cut(pieces(docs, tokenizer, capacity, with_ids=with_ids), "packing-pieces")
    return pack(made, capacity)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
