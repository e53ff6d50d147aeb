"""Token-id files of patched frame-of-reference blocks.

Documents are dealt to shards by ranges of doc_id and encoded in ascending order (null ids first). A shard's file is a sequence
of segments, each a run of whole documents; a segment's ids are cut into blocks of 128. A block stores its minimum, the other
ids' distances from it in the width that `PERCENTILE` of them fit, and the high bits of the rest in an exception list. The
segment's index has the byte start and the first exception of every block. Segments are rows of a Parquet table in a folder
that all executors share, since only Spark's writers reach every store.

Segment: magic "YLP1", ids (u64), blocks (u32), exceptions (u32); per block: minimum (u32), byte start (u32), first exception
(u32), width (u8); per exception: place in the block (u8), high bits (u32); packed bits. All little-endian.

Defined results: null or empty texts have only the end id; documents with equal doc_id keep separate entries, ordered by text;
an empty table gives an empty file and an empty result. A document is never cut, so a segment is as long as its longest one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import load, table_path
from .tokens import encoder, vocabulary

BLOCK, PERCENTILE, SEGMENT_IDS, END_ID = 128, 90, 1 << 17, 1
_HEAD = np.dtype([("magic", "S4"), ("ids", "<u8"), ("blocks", "<u4"), ("exceptions", "<u4")])
_INDEX = np.dtype([("minimum", "<u4"), ("start", "<u4"), ("exception", "<u4"), ("width", "u1")])
_EXCEPTION = np.dtype([("place", "u1"), ("high", "<u4")])


def pack(ids: np.ndarray) -> bytes:
    """A segment of ids (unsigned 32-bit)."""
    n = -(-len(ids) // BLOCK)
    full = np.empty(n * BLOCK, dtype=np.uint32)
    full[: len(ids)] = ids
    if n:
        full[len(ids) :] = ids[-1]
    blocks = full.reshape(n, BLOCK)
    low = blocks.min(axis=1, initial=0xFFFFFFFF)
    apart = blocks - low[:, None]
    at = np.partition(apart, BLOCK * PERCENTILE // 100, axis=1)[:, BLOCK * PERCENTILE // 100] if n else np.empty(0, np.uint32)
    width = np.ceil(np.log2(at.astype(np.float64) + 1)).astype(np.uint8)
    over = apart >> np.minimum(width, 31)[:, None].astype(np.uint32)
    over[width == 32] = 0
    row, place = np.nonzero(over)
    index = np.zeros(n, dtype=_INDEX)
    starts = np.concatenate([[0], np.cumsum(width.astype(np.int64) * BLOCK // 8)])
    index["minimum"], index["width"], index["start"] = low, width, starts[:-1]
    index["exception"] = np.searchsorted(row, np.arange(n))
    exceptions = np.zeros(len(row), dtype=_EXCEPTION)
    exceptions["place"], exceptions["high"] = place, over[row, place]
    body = np.zeros(int(starts[-1]), dtype=np.uint8)
    for w in np.unique(width):
        if w:
            mine = np.flatnonzero(width == w)
            unit = 2 if w <= 16 else 4  # bytes; higher bits are exceptions
            bits = np.unpackbits(apart[mine].astype(f"<u{unit}").view(np.uint8), bitorder="little").reshape(len(mine), BLOCK, 8 * unit)[:, :, :w]
            packed = np.packbits(bits.reshape(len(mine), -1), axis=1, bitorder="little")
            body[starts[mine][:, None] + np.arange(packed.shape[1])] = packed
    head = np.array([(b"YLP1", len(ids), n, len(row))], dtype=_HEAD)
    return b"".join(x.tobytes() for x in (head, index, exceptions, body))


def unpack(data: bytes) -> np.ndarray:
    head = np.frombuffer(data, _HEAD, 1)[0]
    if head["magic"] != b"YLP1":
        raise ValueError("not a segment of token ids")
    n, at = int(head["blocks"]), _HEAD.itemsize
    index = np.frombuffer(data, _INDEX, n, at)
    at += index.nbytes
    exceptions = np.frombuffer(data, _EXCEPTION, int(head["exceptions"]), at)
    body = np.frombuffer(data, np.uint8, offset=at + exceptions.nbytes)
    out = np.zeros((n, BLOCK), dtype=np.uint32)
    width, start = index["width"], index["start"].astype(np.int64)
    for w in np.unique(width):
        if w:
            mine = np.flatnonzero(width == w)
            bits = np.unpackbits(body[start[mine][:, None] + np.arange(int(w) * BLOCK // 8)], axis=1, bitorder="little").reshape(len(mine), BLOCK, int(w))
            unit = 2 if w <= 16 else 4
            whole = np.zeros((len(mine), BLOCK, 8 * unit), dtype=np.uint8)
            whole[:, :, :w] = bits
            out[mine] = np.packbits(whole.reshape(-1), bitorder="little").view(f"<u{unit}").reshape(len(mine), BLOCK)
    if len(exceptions):
        row = np.searchsorted(index["exception"], np.arange(len(exceptions)), "right") - 1
        out[row, exceptions["place"]] |= exceptions["high"].astype(np.uint32) << width[row].astype(np.uint32)
    return (out + index["minimum"][:, None]).reshape(-1)[: int(head["ids"])]


_SEGMENTS = "shard int, segment int, shard_start long, n_ids long, doc_ids array<bigint>, lengths array<bigint>, data binary"


def _write(path: str, end_id: int):
    def run(frames: Iterator[pa.RecordBatch]):
        enc, end = encoder(path), np.array([end_id], dtype="<u4").tobytes()
        shard, segment, before, docs, parts, size = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def row():
            ids = np.frombuffer(b"".join(parts), dtype="<u4")
            values = ([shard], [segment], [before], [len(ids)], [docs], [[len(p) // 4 for p in parts]], [pack(ids)])
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=["shard", "segment", "shard_start", "n_ids", "doc_ids", "lengths", "data"])

        for frame in frames:
            for doc, ids in zip(frame.column(0).to_pylist(), enc.encode_column(frame.column(1), end), strict=True):
                docs.append(doc)
                parts.append(ids)
                size += len(ids) // 4
                if size >= SEGMENT_IDS:
                    yield row()
                    segment, before, docs, parts, size = segment + 1, before + size, [], [], 0
        if docs:
            yield row()

    return run


def write_token_file(docs: DataFrame, tokenizer: str, to: str, end_id: int = END_ID) -> None:
    """Encodes docs (doc_id, text) in ascending doc_id order into the folder `to`. tokenizer: a vocabulary file's path."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_write(tokenizer, end_id), _SEGMENTS).write.option("compression", "none").parquet(to)


def read_documents(spark, path: str, of_ids=None, kind: str = "ids binary") -> DataFrame:
    """doc_id, start (ids before it in the file) and the ids (binary, little-endian u32) of every document of a token file.

    of_ids, a function of the ids' bytes, may give other values, of type `kind`, in their place."""
    segments = spark.read.schema(_SEGMENTS).parquet(path)

    def run(frames: Iterator[pa.RecordBatch]):
        for f in frames:
            for shard, start, docs, lengths, data in zip(*(f.column(k).to_pylist() for k in range(5)), strict=True):
                ids = unpack(data).astype("<u4")
                ends = np.cumsum(lengths)
                values = [ids[e - n : e].tobytes() for e, n in zip(ends, lengths, strict=True)]
                values = pa.array(values, pa.binary()) if of_ids is None else pa.array([of_ids(v) for v in values])
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(start + ends - lengths, pa.int64()), values], names=["shard", "doc_id", "start", kind.split()[0]])

    docs = segments.select("shard", "shard_start", "doc_ids", "lengths", "data").mapInArrow(run, f"shard int, doc_id long, start long, {kind}")
    # a row for each shard: as many as the file has parts, so it can be sent to all tasks
    before = segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(F.col("shard").alias("part"), F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return docs.join(F.broadcast(before), F.col("shard") == F.col("part")).select("doc_id", (F.col("start") + F.col("before")).alias("start"), kind.split()[0])


def _check(ids: bytes) -> dict:
    return {"ids_crc32": zlib.crc32(ids), "n_tokens": len(ids) // 4}  # in the order in which Arrow keeps inferred fields


def op8_token_file(spark, sf_dir: str) -> DataFrame:
    path = table_path(spark, "token-file")
    write_token_file(load(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), path)
    return read_documents(spark, path, _check, "checks struct<ids_crc32:long,n_tokens:long>").select("doc_id", "start", "checks.n_tokens", "checks.ids_crc32")
