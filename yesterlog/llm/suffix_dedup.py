"""Removal of repeated byte strings by bucket-pointer refinement of a sampled suffix array.

A byte is removed if it lies in a `length`-byte window that also starts earlier (smaller doc_id, or the same document and an
earlier start). A suffix matters to the depth of one window. Sorting every suffix would shuffle a row for each byte, so runs of
neighbouring suffixes are sorted together: each window has an anchor, its leftmost q-gram with the least bucket identifier, and
the windows whose anchor lies SPANS[0] * k to SPANS[0] * (k + 1) - 1 bytes behind their start are one run. All windows of a run
share a core of bytes, and equal windows have equal anchors and cores at equal places, so no repeat is missed.

* Buckets: every q-gram has an identifier. Pairs of identifiers, of an offset and of the one q bytes later, give those of strings
  of 2q bytes; pairs of these, 2q bytes apart, those of 4q bytes, and so on, each level made from the updated one (`Buckets`).
  A string of any other length is the pair of the largest level at its start and at its end.
* Refinement: runs are sorted by the identifier of their core, the bucket, then by that of all bytes they cover, then by document
  and place. Of equal runs the first stays and the others' windows are repeats. A run that is alone in its bucket is finished.
* Recursion: of what is left, runs are cut to SPANS[1] windows, whose cores are longer, and sorted into refined buckets; then to
  single windows, whose core is all of them, and of these the first stays. A bucket is crowded only where most of a window is
  common to many documents, and it is read in sorted order, of which a task keeps one row.

Repeats inside a batch are settled before the first shuffle, so copies hardly load it. Each document's repeated runs are then
joined to its text.

Defined results: null text is empty; texts shorter than `length` lose nothing; a null doc_id comes after all others, null rows of
one text count as one document and those of different texts as different ones, in the order of a hash; rows that repeat a doc_id
must repeat its text and do not count as earlier than each other; doc_ids lie below 2^62; an empty table gives an empty result.
Other columns are ignored. Identifiers have 64 bits, and runs are equal if those of core and of all bytes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, byte_table, cut, load, text_bytes

LENGTH, GRAM = 100, 24
#: Windows of a run at most, by level of the recursion.
SPANS = (40, 10, 1)
_BLOCK = 1 << 19  # bytes handled at once; places in a block take 20 bits
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = np.uint64((1 << 20) - 1)


def _power(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * np.uint64(0x94D049BB133111EB) + (b ^ b >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93))


class Hasher:
    """Identifiers of q-grams, by powers of _BASE modulo 2^64, over blocks of at most `size` bytes."""

    def __init__(self, size: int, seed: int = 7):
        self.bytes, self.power, self.inverse = byte_table(seed), _power(_BASE, size + 1), _power(_INVERSE, size + 1)

    def grams(self, data: np.ndarray, q: int) -> np.ndarray:
        if len(data) < q:
            return np.empty(0, dtype=np.uint64)
        prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.bytes[data] * self.power[: len(data)], out=prefix[1:])
        return _mix((prefix[q:] - prefix[:-q]) * self.inverse[: len(data) - q + 1])


class Buckets:
    """Bucket identifiers at all offsets of a block; level k, made from level k - 1, stands for q * 2^k bytes."""

    def __init__(self, hasher: Hasher, data: np.ndarray, q: int):
        self.q, self.levels = q, [hasher.grams(data, q)]

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Identifiers of the strings [start, stop), each of at least q bytes."""
        out = np.zeros(len(start), dtype=np.uint64)
        size = stop - start
        depth = np.log2(size / self.q + 1e-9).astype(np.int64)
        for k in range(int(depth.max(initial=0)) + 1):
            if k == len(self.levels):
                later = self.q << k - 1
                self.levels.append(_pair(self.levels[-1][:-later], self.levels[-1][later:]))
            mine = np.flatnonzero(depth == k)
            if len(mine):
                out[mine] = _pair(self.levels[k][start[mine]], self.levels[k][stop[mine] - (self.q << k)])
        return out + size.astype(np.uint64)


def _identified(buckets: Buckets, first: np.ndarray, count: np.ndarray, offset: np.ndarray, span: int, most: int, length: int):
    """The core's and the whole run's identifiers; offset: of the anchor behind the first window's start, `most` at most."""
    near = offset // span * span  # the class's least offset
    anchor = first + offset
    core = buckets.of(anchor - near, anchor - np.minimum(near + span - 1, most) + length)
    return core.astype(np.int64), buckets.of(first, first + count + length - 1).astype(np.int64)


def anchors(hasher: Hasher, data: np.ndarray, ends: np.ndarray, length: int, gram: int, span: int = SPANS[0]):
    """Runs of windows in pieces that end at `ends`: first window, number of windows, offset of the anchor, bucket, refined bucket."""
    n, w = len(data), length - gram + 1
    if n < length:
        return [np.empty(0, dtype=np.int64)] * 5
    buckets = Buckets(hasher, data, gram)
    value = buckets.levels[0]
    least, reach = (value & ~_PLACE) | np.arange(len(value)).astype(np.uint64), 1
    while reach * 2 <= w:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < w:
        least = np.minimum(least[: reach - w], least[w - reach :])
    anchor = (least & _PLACE).astype(np.int64)
    cut_at = np.zeros(n + 1, dtype=bool)
    cut_at[ends] = True
    piece = np.cumsum(cut_at[:-1])  # the piece of each byte
    inside = piece[: len(anchor)] == piece[length - 1 :]
    part = (anchor - np.arange(len(anchor))) // span
    new = np.ones(len(anchor), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    stop = np.flatnonzero(np.concatenate([new | ~inside, [True]]))
    count = stop[np.searchsorted(stop, first, "right")] - first
    offset = anchor[first] - first
    return [first, count, offset, *_identified(buckets, first, count, offset, span, w - 1, length)]


_ROW = "bucket long, refined long, doc long, start long, count int, kind int"
_NAMES = ["bucket", "refined", "doc", "start", "count", "kind"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
#: kind: that a run is known to repeat an earlier one, or else the offset of its anchor
_REPEAT = -1


def _record(columns: list[np.ndarray], names=_NAMES, types=_TYPES) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _runs(length: int, gram: int):
    def run(frames: Iterator[pa.RecordBatch]):
        hasher = Hasher(_BLOCK + length)
        for f in frames:
            found: list[list[np.ndarray]] = []
            pieces, size = [], 0

            def flush():
                data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
                ends = np.cumsum([len(p[2]) for p in pieces])
                first, count, anchor, bucket, refined = anchors(hasher, data, ends, length, gram)
                if len(first):
                    k = np.searchsorted(ends, first, "right")
                    offset = np.array([p[1] for p in pieces]) - np.concatenate([[0], ends[:-1]])
                    found.append([bucket, refined, np.array([p[0] for p in pieces])[k], first + offset[k], count, anchor])

            for doc, text in zip(f.column(0).to_pylist(), text_bytes(f.column(1)), strict=True):
                for i in range(0, len(text) - length + 1, _BLOCK):
                    piece = text[i : i + _BLOCK + length - 1] if len(text) > _BLOCK else text
                    if size + len(piece) > _BLOCK and pieces:
                        flush()
                        pieces, size = [], 0
                    pieces.append((doc, i, piece))
                    size += len(piece)
            if pieces:
                flush()
            if found:
                columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                yield from _settle(columns)

    return run


def _settle(columns: list[np.ndarray]):
    """Rows of a batch, with those that repeat an earlier one of the batch marked."""
    bucket, refined, doc, start, count, kind = columns
    key = bucket * np.int64(31) + refined
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    group = np.concatenate([[0], np.cumsum(~same)])
    shared = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
    if len(shared):
        rows, groups = order[shared], group[shared]
        inner = np.lexsort((start[rows], doc[rows], refined[rows], bucket[rows], groups))
        rows = rows[inner]
        again = np.zeros(len(rows), dtype=bool)
        again[1:] = (bucket[rows][1:] == bucket[rows][:-1]) & (refined[rows][1:] == refined[rows][:-1])
        head = rows[np.maximum.accumulate(np.where(again, 0, np.arange(len(rows))))]
        kind[rows[again & ((doc[rows] != doc[head]) | (start[rows] != start[head]))]] = _REPEAT
    again = kind == _REPEAT
    # repeats that follow one another in a document become one row; they are compared with nothing, so they are dealt by their place
    joined = again[1:] & again[:-1] & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1] + count[:-1])
    head = np.flatnonzero(np.concatenate([[True], ~joined]))
    count = np.add.reduceat(count, head)
    bucket, refined, doc, start, kind, again = (x[head] for x in (bucket, refined, doc, start, kind, again))
    spread = ((doc + (start >> 16)).astype(np.uint64) * np.uint64(_BASE)).astype(np.int64)
    bucket = np.where(again, spread, bucket)
    for i in range(0, len(doc), 1 << 16):
        p = slice(i, i + (1 << 16))
        yield _record([x[p] for x in (bucket, refined, doc, start, count, kind)])


def _refine(with_bytes: bool = False):
    """Rows sorted by (bucket, refined, doc, start) in; repeats, and the first rows of buckets with several refined buckets, out."""
    names, types = _NAMES + ["bytes"] * with_bytes, _TYPES + [pa.binary()] * with_bytes

    def run(frames: Iterator[pa.RecordBatch]):
        head = None  # (bucket, refined, doc, start) of the current refined bucket's first row
        waiting = None  # that row, if it is not yet known whether its bucket has a later refined bucket
        shared = False  # whether its bucket has an earlier refined bucket
        for f in frames:
            rows = [f.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))]
            done = rows[5] == _REPEAT
            out = [[x[done] for x in rows]]
            rows = [x[~done] for x in rows]
            b, r, d, s = rows[:4]
            if len(b):
                pb, pr = (np.concatenate([[x], y[:-1]]) for x, y in zip(head[:2] if head else (0, 0), (b, r), strict=True))
                new = (b != pb) | (r != pr)
                if head is None:
                    new[0] = True
                index = np.maximum.accumulate(np.where(new, np.arange(len(b)), -1))
                hd = np.where(index >= 0, d[index], head[2] if head else 0)
                hs = np.where(index >= 0, s[index], head[3] if head else 0)
                repeat = ~new & ((d != hd) | (s != hs))
                again = [x[repeat] for x in rows]
                again[5] = np.full(len(again[0]), _REPEAT)
                if with_bytes:
                    again[6] = np.full(len(again[0]), None)
                out.append(again)
                first = [x[new] for x in rows]
                if waiting is not None:
                    first = [np.concatenate([x, y]) for x, y in zip(waiting, first, strict=True)]
                if len(first[0]):
                    equal = first[0][1:] == first[0][:-1]
                    several = np.concatenate([[shared], equal]) | np.concatenate([equal, [False]])
                    ready = (np.arange(len(several)) < len(several) - 1) & several
                    out.append([x[ready] for x in first])
                    waiting, shared = [x[-1:] for x in first], bool(several[-1])
                head = (b[-1], r[-1], hd[-1], hs[-1])
            yield _record([np.concatenate(x) for x in zip(*out, strict=True)], names, types)
        if waiting is not None and shared:
            yield _record(waiting, names, types)

    return run


def _cut(parts: list[tuple[int, int, int, bytes]], hashers: tuple[Hasher, Hasher], length: int, gram: int, span: int):
    """Runs (document, start, anchor's offset, covered bytes) cut to runs of at most `span` windows, as record batches with their bytes."""
    doc, start, offset = (np.array([p[k] for p in parts], dtype=np.int64) for k in range(3))
    size = np.array([len(p[3]) for p in parts], dtype=np.int64)
    text = b"".join(p[3] for p in parts)
    data, begin, windows = np.frombuffer(text, np.uint8), np.cumsum(size) - size, size - length + 1
    row = np.repeat(np.arange(len(parts)), windows)
    at = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    part = (offset[row] - at) // span
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(row)))
    row, at = row[first], at[first]
    own, behind = begin[row] + at, offset[row] - at
    bucket, refined = _identified(Buckets(hashers[0], data, gram), own, count, behind, span, length - gram, length)
    if span == 1:  # core and run are the same bytes, so the second identifier is made from other q-grams' identifiers
        refined = Buckets(hashers[1], data, gram).of(own, own + length).astype(np.int64)
        yield _record([bucket, refined, doc[row], start[row] + at, count, behind])
        return
    covered = [text[a : a + n] for a, n in zip(own.tolist(), (count + length - 1).tolist(), strict=True)]
    yield _record([bucket, refined, doc[row], start[row] + at, count, behind, covered], _NAMES + ["bytes"], _TYPES + [pa.binary()])


def _in_parts(rows: Iterator[tuple[int, int, int, bytes]], length: int, gram: int, span: int):
    hashers, parts, size = (Hasher(2 * _BLOCK), Hasher(2 * _BLOCK, 8)), [], 0
    for r in rows:
        parts.append(r)
        size += len(r[3])
        if size > _BLOCK:
            yield from _cut(parts, hashers, length, gram, span)
            parts, size = [], 0
    if parts:
        yield from _cut(parts, hashers, length, gram, span)


def _from_texts(length: int, gram: int):
    """doc, text, runs (start, count, kind) in; runs of at most SPANS[1] windows with the bytes they cover out."""

    def run(frames: Iterator[pa.RecordBatch]):
        def rows():
            for f in frames:
                for doc, text, runs in zip(f.column(0).to_pylist(), text_bytes(f.column(1)), f.column(2).to_pylist(), strict=True):
                    for x in runs:
                        yield doc, x["start"], x["kind"], text[x["start"] : x["start"] + x["count"] + length - 1]

        yield from _in_parts(rows(), length, gram, SPANS[1])

    return run


def _from_runs(length: int, gram: int):
    """doc, start, kind, bytes in; single windows out."""

    def run(frames: Iterator[pa.RecordBatch]):
        yield from _in_parts((r for f in frames for r in zip(*(f.column(k).to_pylist() for k in range(4)), strict=True)), length, gram, SPANS[2])

    return run


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket", "refined", "doc", "start")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, doc (its place in the order of documents), text."""
    after_all = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), after_all).alias("doc"), "text")


def repeated_runs(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """texts: doc, text. Returns doc, start, count: runs of windows of each document that start earlier too."""
    with_bytes = _ROW + ", bytes binary"
    first = cut(_sorted(texts.select("doc", "text").mapInArrow(_runs(length, gram), _ROW)).mapInArrow(_refine(), _ROW), "suffix-runs")
    of_doc = first.filter(F.col("kind") != _REPEAT).groupBy(F.col("doc").alias("of")).agg(F.collect_list(F.struct("start", "count", "kind")).alias("runs"))
    shorter = texts.join(of_doc, F.col("doc") == F.col("of")).select("doc", "text", "runs").mapInArrow(_from_texts(length, gram), with_bytes)
    second = cut(_sorted(shorter).mapInArrow(_refine(True), with_bytes), "suffix-refined")
    windows = second.filter(F.col("kind") != _REPEAT).select("doc", "start", "kind", "bytes").mapInArrow(_from_runs(length, gram), _ROW)
    last = _sorted(windows).mapInArrow(_refine(), _ROW)
    found = [x.filter(F.col("kind") == _REPEAT).select("doc", "start", "count") for x in (first, second, last)]
    return found[0].unionByName(found[1]).unionByName(found[2])


def removed_spans(runs: list[tuple[int, int]], length: int) -> list[list[int]]:
    """Maximal byte ranges that the windows of the runs cover."""
    out: list[list[int]] = []
    for start, count in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + count + length - 1)
        else:
            out.append([start, start + count + length - 1])
    return out


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes) for every row of docs."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text

    def run(frames: Iterator[pa.RecordBatch]):
        for f in frames:
            rows = []
            for doc, text, runs in zip(f.column(0).to_pylist(), text_bytes(f.column(1)), f.column(2).to_pylist(), strict=True):
                spans = removed_spans([(x["start"], x["count"]) for x in runs or ()], length)
                at, parts = 0, []
                for a, b in spans:
                    parts.append(text[at:a])
                    at = b
                kept = b"".join([*parts, text[at:]])
                rows.append((doc, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept)[: len(names)])
            yield from batches(rows, names, types)

    texts = _keyed(docs)
    runs = repeated_runs(texts, length, gram).groupBy(F.col("doc").alias("of")).agg(F.collect_list(F.struct("start", "count")).alias("runs"))
    texts = texts.join(runs, F.col("doc") == F.col("of"), "left").select("doc_id", "text", "runs")
    return texts.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicate(load(spark, sf_dir, "documents"))
