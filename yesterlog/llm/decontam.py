"""Benchmark decontamination by training suffix arrays.

Each partition of the training documents is a shard. In a shard every document word becomes its number in the benchmark's
vocabulary (0: not in it); all suffixes that can match at all, those whose first words are in the vocabulary, are sorted into
a suffix array whose keys are the first `window` words. Every test suffix is binary-searched, from both sides, in each shard's
array: the interval between holds all places where its window occurs verbatim, and the words of these places are what is removed.
The array of the places found is then sorted to full depth, together with the test suffixes, by doubling ranks (`Suffixes`):
a test suffix's neighbours give its longest verbatim match, however long, and the interval of equally long ones its least place;
a place's neighbours give the longest match that starts there, by which `longest` and `longest_matches` are found.

The benchmark is sent to the tasks in blocks of at most `block_bytes`; tasks number the blocks of a larger benchmark and write
them to the shared folder. The driver makes a block's windows once, as arrays, and broadcasts them; worker processes read them once.
It takes a pass for each block, for which the driver reads that block alone; each pass is written, and the passes are merged by a
key that every document row got once.

Words: A-Z lower-cased, runs of [0-9a-z] and of all characters from U+0080. A window is `window` consecutive words of an item;
an item with fewer words, but at least one, is one window. A document word inside any occurrence is hit.
Defined results: null or empty texts have no words and are never hit; null items are ignored; items that occur twice under one
id count once; repeated documents get a row each, null ids too. An empty benchmark leaves every document clean. Of equally long
matches the place with the least doc_id (null last), then the least word, counts; of an id's several texts the best match counts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, load, release, table_path, text_bytes

WINDOW = 10
BLOCK_BYTES = 16 << 20
#: Vocabulary numbers gathered before a suffix array is built, which bounds a task's memory.
SHARD_WORDS = 2_000_000
#: The columns of contaminated_spans.
_SPANS = "doc_id n_words spans items longest at"
_SPANS_TYPE = "doc_id long, n_words long, spans array<array<bigint>>, items array<string>, longest long, at long"
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


class Windows:
    """The test suffixes of a block of items as arrays: windows in ascending order as keys for binary search, their lengths and items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window = window
        split = [words(text) for _, text in items]
        coded = pa.array([w for ws in split for w in ws], pa.binary()).dictionary_encode()
        self.vocabulary = coded.dictionary  # a word's number is its place here, from 1
        count = np.array([len(ws) for ws in split], dtype=np.int64)
        del split
        # items follow each other with `window` zeros between, so that a shorter item's key ends in zeros
        begin = np.cumsum(count + window) - (count + window)
        ids = np.zeros(int((count + window).sum()), dtype=">u4")
        ids[np.arange(int(count.sum())) + np.repeat(begin - (np.cumsum(count) - count), count)] = coded.indices.to_numpy(zero_copy_only=False) + 1
        suffixes = np.where(count > 0, np.maximum(1, count - window + 1), 0)
        ends = np.cumsum(suffixes)
        #: Every test suffix: its item and first word, the number of its window, and whether the next one is the same item's.
        self.names, of_name = np.unique(np.array([i for i, _ in items], dtype=object), return_inverse=True) if items else (np.empty(0, dtype=object), np.empty(0, dtype=np.int64))
        which = np.repeat(np.arange(len(items), dtype=np.int32), suffixes)
        self.item = of_name[which].astype(np.int32)
        self.first = (np.arange(len(which)) - np.repeat(ends - suffixes, suffixes)).astype(np.int32)
        self.follows = np.ones(len(which), dtype=bool)
        self.follows[ends[suffixes > 0] - 1] = False
        keys = np.lib.stride_tricks.sliding_window_view(ids, window)[begin[which] + self.first] if len(which) else np.zeros((0, window), dtype=">u4")
        self.low, one, number = np.unique(np.ascontiguousarray(keys).reshape(-1).view(f"S{4 * window}"), return_index=True, return_inverse=True)
        self.number = number.astype(np.int32)
        self.lengths = np.minimum(count[which[one]], window).astype(np.int32)
        self.least = int(self.lengths.min()) if len(self.low) else 0
        #: Windows of shorter items, and the last key that begins with each.
        self.short = np.flatnonzero(self.lengths < window)
        high = keys[one[self.short]]
        high[np.arange(window) >= self.lengths[self.short, None]] = 0xFFFFFFFF
        self.high = np.ascontiguousarray(high).reshape(-1).view(f"S{4 * window}")
        pairs = np.unique(self.number.astype(np.int64) * max(1, len(self.names)) + self.item)
        self.items_of = np.searchsorted(pairs // max(1, len(self.names)), np.arange(len(self.low) + 1)).astype(np.int32)
        self.items = (pairs % max(1, len(self.names))).astype(np.int32)

    def __len__(self) -> int:
        return len(self.low)

    def numbers(self, found: list[bytes]) -> np.ndarray:
        """The number of each word, 0 for words outside of the vocabulary."""
        coded = pa.array(found, pa.binary()).dictionary_encode()
        known = pc.fill_null(pc.index_in(coded.dictionary, self.vocabulary), -1).to_numpy(zero_copy_only=False)
        return (known + 1).astype(np.uint32)[coded.indices.to_numpy(zero_copy_only=False)]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the suffix array `keys` for each window."""
        low, high = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.low, "right")
        high[self.short] = np.searchsorted(keys, self.high, "right")
        return low, high


def suffix_array(ids: np.ndarray, window: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the suffixes whose first `least` words are in the vocabulary, in the order of their first `window` words, and those keys."""
    padded = np.concatenate([ids, np.zeros(window, dtype=ids.dtype)])
    known = np.concatenate([[0], np.cumsum(padded == 0)])
    starts = np.flatnonzero(known[least : least + len(ids)] == known[: len(ids)])
    keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, window)[starts].astype(">u4")).reshape(-1).view(f"S{4 * window}")[: len(starts)]
    order = np.argsort(keys, kind="stable")
    return starts[order], keys[order]


def _shards(index: Broadcast, found_in):
    """A mapInArrow function that numbers words and calls found_in(test, rows, starts, keys, bounds) for each shard.

    The block's windows are made once, by the driver, and each worker process reads them once: their size is bounded by the block's.
    """

    def run(frames: Iterator[pa.RecordBatch]):
        release()
        test, rows, found, size = index.value, [], [], 0
        window = test.window

        def flush():
            count = np.array([n for _, n in rows], dtype=np.int64)
            bounds = np.append(0, np.cumsum(count + window))
            ids = np.zeros(bounds[-1], dtype=np.uint32)  # gaps, so that no suffix runs into the next document
            ids[np.arange(int(count.sum())) + np.repeat(bounds[:-1] - (np.cumsum(count) - count), count)] = test.numbers(found)
            starts, keys = suffix_array(ids, window, test.least) if len(test) else (np.empty(0, np.int64), np.empty(0, "S1"))
            return found_in(test, rows, starts, keys, bounds)

        for frame in frames:
            for doc, text in zip(frame.column(0).to_pylist(), text_bytes(frame.column(1)), strict=True):
                w = words(text)
                found.extend(w)
                rows.append((doc, len(w)))
                size += len(w) + window
                if size >= SHARD_WORDS:
                    yield from flush()
                    rows, found, size = [], [], 0
        if rows:
            yield from flush()

    return run


class Suffixes:
    """Suffixes of sequences of numbers, sorted to full depth by doubling: ranks[k] tells the first 2^k numbers apart."""

    def __init__(self, numbers: np.ndarray, follows: np.ndarray):
        n = len(numbers)  # also the suffix without numbers
        at = np.arange(n)
        jump = np.append(np.where(follows, at + 1, n), n)
        self.ranks, self.jumps = [np.append(np.unique(numbers, return_inverse=True)[1] + 1, 0)], [jump]
        while (self.jumps[-1][:n] < n).any():
            r, j = self.ranks[-1], self.jumps[-1]
            self.ranks.append(np.unique(r * (r.max() + 1) + r[j], return_inverse=True)[1])
            self.jumps.append(j[j])
        ends = np.flatnonzero(~follows)
        self.length = np.append(ends[np.searchsorted(ends, at)] - at + 1, 0)
        self.order = np.argsort(self.ranks[-1][:n], kind="stable")

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers the suffixes a and b begin with alike."""
        out = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            same = self.ranks[k][a] == self.ranks[k][b]
            out += np.where(same, np.minimum(1 << k, self.length[a]), 0)
            a, b = np.where(same, self.jumps[k][a], a), np.where(same, self.jumps[k][b], b)
        return out

    def longest(self, of: np.ndarray, among: np.ndarray) -> np.ndarray:
        """For each suffix in the mask `of` the longest beginning that it shares with one of `among`."""
        kind, n = among[self.order], len(self.order)
        at = np.arange(n)
        before = np.maximum.accumulate(np.where(kind, at, -1))
        after = np.minimum.accumulate(np.where(kind, at, n)[::-1])[::-1]
        mine = np.flatnonzero(of[self.order])
        best = np.zeros(len(mine), dtype=np.int64)
        for near, there in ((before[mine], before[mine] >= 0), (after[mine], after[mine] < n)):
            best[there] = np.maximum(best[there], self.common(self.order[mine[there]], self.order[near[there]]))
        out = np.zeros(n, dtype=np.int64)
        out[self.order[mine]] = best
        return out[of]

    def least(self, of: np.ndarray, length: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For each suffix in the mask `of` the least weight of all suffixes that begin with its first `length` numbers."""
        n = len(self.order)
        place = np.empty(n, dtype=np.int64)
        place[self.order] = np.arange(n)
        links = [self.common(self.order[:-1], self.order[1:])]  # with the next one in order
        tops = [weight[self.order]]
        while 1 << len(tops) < n:
            half = 1 << len(tops) - 1
            tops.append(np.minimum(tops[-1], np.append(tops[-1][half:], np.full(half, weight.max()))))
            links.append(np.minimum(links[-1], np.append(links[-1][half:], np.zeros(min(half, len(links[-1])), dtype=np.int64))[: len(links[-1])]))
        low = high = place[np.flatnonzero(of)]
        out = tops[0][low]
        for k in range(len(tops) - 1, -1, -1):
            step = 1 << k
            to = np.minimum(high, n - 1 - step)
            go = (high + step < n) & (links[k][np.clip(to, 0, n - 2)] >= length)
            out = np.where(go, np.minimum(out, tops[k][np.clip(high + 1, 0, n - 1)]), out)
            high = np.where(go, high + step, high)
            back = np.maximum(low - step, 0)
            go = (low >= step) & (links[k][np.clip(back, 0, n - 2)] >= length)
            out = np.where(go, np.minimum(out, tops[k][back]), out)
            low = np.where(go, low - step, low)
        return out


class Hits:
    """All places of a shard where a window occurs, and their joint order with the test suffixes."""

    def __init__(self, test: Windows, starts, keys, bounds):
        lo, hi = test.find(keys) if len(starts) else (np.zeros(len(test), dtype=np.int64),) * 2
        count = np.maximum(hi - lo, 0)
        self.window = np.repeat(np.arange(len(count)), count)
        self.place = starts[np.arange(len(self.window)) + np.repeat(lo - (np.cumsum(count) - count), count)]
        order = np.lexsort((self.window, self.place))
        self.window, self.place = self.window[order], self.place[order]
        self.doc = np.searchsorted(bounds, self.place, "right") - 1
        self.words = test.lengths[self.window]
        self.full = np.flatnonzero(self.words == test.window)  # one for each place; shorter items' windows are never continued
        self.test = np.flatnonzero(test.lengths[test.number] == test.window) if len(self.full) else np.empty(0, dtype=np.int64)
        if len(self.full):
            p = self.place[self.full]
            numbers = np.concatenate([self.window[self.full], test.number[self.test]])
            self.suffixes = Suffixes(numbers, np.concatenate([np.append(p[1:] == p[:-1] + 1, False), test.follows[self.test]]))
            self.training = np.arange(len(numbers)) < len(p)

    def longest(self) -> np.ndarray:
        """Words of the longest verbatim match that starts at each place."""
        out = self.words.copy()
        if len(self.full):
            out[self.full] += self.suffixes.longest(self.training, ~self.training) - 1
        return out


def _spans(test: Windows, rows, starts, keys, bounds):
    """Merged hit spans, items and the longest match of each document of a shard."""
    hits = Hits(test, starts, keys, bounds)
    stop = hits.place + hits.words
    reach = np.maximum.accumulate(stop)
    new = np.append(True, hits.place[1:] > reach[:-1])[: len(stop)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(stop))[: len(first)] - 1
    spans: dict[int, list] = {}
    for d, a, b in zip(hits.doc[first].tolist(), (hits.place[first] - bounds[hits.doc[first]]).tolist(), (reach[last] - bounds[hits.doc[first]]).tolist(), strict=True):
        spans.setdefault(d, []).append([a, b])
    longest, at = np.zeros(len(rows), dtype=np.int64), {}
    match = hits.longest()
    np.maximum.at(longest, hits.doc, match)
    best = np.flatnonzero(match == longest[hits.doc])[::-1]  # places ascend, so the first one of a document is set last
    at.update(zip(hits.doc[best].tolist(), (hits.place[best] - bounds[hits.doc[best]]).tolist(), strict=True))
    # documents and items in pairs: a window's items are dealt to all documents where it occurs
    pair = np.unique(hits.doc * max(1, len(test)) + hits.window)
    doc, k = pair // max(1, len(test)), pair % max(1, len(test))
    n = (test.items_of[k + 1] - test.items_of[k]).astype(np.int64)
    of = test.items[np.arange(int(n.sum())) + np.repeat(test.items_of[k] - (np.cumsum(n) - n), n)]
    items: dict[int, list] = {}
    for d, i in np.unique(np.stack([np.repeat(doc, n), of.astype(np.int64)]), axis=1).T.tolist():
        items.setdefault(d, []).append(test.names[i])
    out = [(doc, n, spans.get(d, []), items.get(d, []), int(longest[d]), at.get(d)) for d, (doc, n) in enumerate(rows)]
    yield from batches(out, _SPANS.split(), [pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string()), pa.int64(), pa.int64()])


def merge(spans: list) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _numbered(items: DataFrame, parts: int, block_bytes: int) -> DataFrame:
    """Items with the number of their block; each task numbers its own."""

    def run(frames: Iterator[pa.RecordBatch]):
        block, size = TaskContext.get().partitionId() << 32, 0
        for f in frames:
            numbers = []
            for text in text_bytes(f.column(1)):
                if size and size + len(text) > block_bytes:
                    block, size = block + 1, 0
                size += len(text)
                numbers.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), f.column(0), f.column(1)], names=["block", "item", "text"])

    return items.repartition(parts).mapInArrow(run, "block long, item string, text string")


def _blocks(benchmark: DataFrame, block_bytes: int) -> tuple[int, Iterator[list[tuple[str, bytes]]]]:
    """The number of blocks of at most block_bytes (a longer item is a block of its own), and their items, read block by block."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text")).filter("item is not null and text is not null").distinct()
    read = lambda block: [(r.item, r.text.encode()) for r in block.select("item", "text").collect()]
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= block_bytes:
        return 1, iter([read(items)])
    # parts are filled to nine tenths, so that few tasks begin a second block
    written = cut(_numbered(items, -(-size * 10 // (block_bytes * 9)), block_bytes), "decontam-blocks")
    numbers = sorted(r.block for r in written.select("block").distinct().collect())
    return len(numbers), (read(written.filter(F.col("block") == k)) for k in numbers)


def _only_hits(test: Windows, rows, starts, keys, bounds):
    for f in _spans(test, rows, starts, keys, bounds):
        yield f.filter(pc.greater(pc.list_value_length(f.column(2)), 0))


def _pass(texts: DataFrame, block: list[tuple[str, bytes]], window: int, found_in, schema: str) -> tuple[DataFrame, Broadcast]:
    """texts through found_in with one block of the benchmark, and the broadcast of its windows."""
    index = texts.sparkSession.sparkContext.broadcast(Windows(block, window))
    return texts.mapInArrow(_shards(index, found_in), schema), index


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (word ranges [start, stop) that benchmark windows cover, merged), items (ids whose windows occur), longest (words of the longest verbatim match, 0 without one) and at (its first word, the least of equally long ones, null without one), for every row of docs."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n, blocks = _blocks(benchmark, block_bytes)
    if n == 1:
        return _pass(texts, next(blocks), window, _spans, _SPANS_TYPE)[0]
    # rows get a key that is written once; the first pass keeps every row, the others those that are hit
    rows = cut(texts.withColumn("row", F.monotonically_increasing_id()), "decontam-rows")
    folder = table_path(docs.sparkSession, "decontam-passes")
    for k, block in enumerate(blocks):
        found, index = _pass(rows.select("row", "text"), block, window, _only_hits if k else _spans, _SPANS_TYPE)
        found.withColumnRenamed("doc_id", "row").write.parquet(f"{folder}/pass={k}")
        index.destroy()
    every = docs.sparkSession.read.schema(_SPANS_TYPE.replace("doc_id", "row")).parquet(folder)
    at = F.min_by("at", F.struct(-F.col("longest"), F.col("at"))).alias("at")
    every = every.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"), at)
    every = rows.select("row", "doc_id").join(every, "row").select(*_SPANS.split())

    def together(frames):
        for f in frames:
            yield pa.RecordBatch.from_arrays([*f.columns[:2], pa.array([merge(x) for x in f.column(2).to_pylist()], pa.list_(pa.list_(pa.int64()))), *f.columns[3:]], names=_SPANS.split())

    return every.mapInArrow(together, _SPANS_TYPE)


def _suffix_matches(test: Windows, rows, starts, keys, bounds):
    """The longest match of each test suffix in a shard, and its least place."""
    hits = Hits(test, starts, keys, bounds)
    word = hits.place - bounds[hits.doc]
    ids = np.array([(doc is None, doc or 0) for doc, _ in rows], dtype=np.int64).reshape(-1, 2)[hits.doc]
    order = np.lexsort((word, ids[:, 1], ids[:, 0]))
    weight = np.empty(len(order), dtype=np.int64)
    weight[order] = np.arange(len(order))
    out = []
    add = lambda suffix, n, h: out.append((test.names[test.item[suffix]], int(test.first[suffix]), n, rows[hits.doc[h]][0], int(word[h])))
    if len(hits.full):
        none = len(order)
        length = hits.suffixes.longest(~hits.training, hits.training)
        least = hits.suffixes.least(~hits.training, length, np.append(weight[hits.full], np.full(len(hits.test), none)))
        for suffix, n, w in zip(hits.test[length > 0].tolist(), length[length > 0].tolist(), least[length > 0].tolist(), strict=True):
            add(suffix, n + test.window - 1, order[w])
    best: dict[int, int] = {}
    for h in np.flatnonzero(hits.words < test.window).tolist():
        k = int(hits.window[h])
        if k not in best or weight[h] < weight[best[k]]:
            best[k] = h
    for suffix in np.flatnonzero(test.lengths[test.number] < test.window).tolist() if best else ():
        if (k := int(test.number[suffix])) in best:
            add(suffix, int(test.lengths[k]), best[k])
    yield from batches(out, ["item_id", "start", "length", "doc_id", "at"], [pa.string(), *[pa.int64()] * 4])


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each test suffix whose window occurs in the documents: item_id, start (word), length (words of the longest verbatim match), doc_id and at (word) of its least place."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema, (n, blocks) = "item_id string, start long, length long, doc_id long, at long", _blocks(benchmark, block_bytes)
    if n == 1:
        out = _pass(texts, next(blocks), window, _suffix_matches, schema)[0]
    else:
        folder = table_path(docs.sparkSession, "decontam-matches")
        for k, block in enumerate(blocks):
            found, index = _pass(texts, block, window, _suffix_matches, schema)
            found.write.parquet(f"{folder}/pass={k}")
            index.destroy()
        out = docs.sparkSession.read.schema(schema).parquet(folder)
    best = F.min_by(F.struct("length", "doc_id", "at"), F.struct(-F.col("length"), F.col("doc_id").isNull(), "doc_id", "at")).alias("m")
    return out.groupBy("item_id", "start").agg(best).select("item_id", "start", "m.length", "m.doc_id", "m.at")


_REPORT_TYPE = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_at long"


def _report(frames):
    for f in frames:
        spans, items = f.column(2).to_pylist(), f.column(3).to_pylist()
        n_hit = [sum(b - a for a, b in s) for s in spans]
        yield pa.RecordBatch.from_arrays(
            [f.column(0), f.column(1), pa.array(n_hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array([hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items]), pa.array([n > 0 for n in n_hit]), f.column(4), f.column(5)],
            names=[c.split()[0] for c in _REPORT_TYPE.split(", ")],
        )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    return contaminated_spans(docs, benchmark, window).mapInArrow(_report, _REPORT_TYPE)


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that share no verbatim match of a window or a whole shorter item with the benchmark, with all their columns. Texts are judged by their hash, whatever the doc_id."""
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    hit = contaminated_spans(docs.select(own.alias("doc_id"), "text"), benchmark, window).filter("longest > 0").select(F.col("doc_id").alias("h")).distinct()
    # a row is carried as one struct, so that no name of its columns can clash
    return docs.select(F.struct("*").alias("row"), own.alias("h")).join(hit, "h", "left_anti").select("row.*")


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
t AS (SELECT id AS item_id, k, i AS j, len(ws[i:i+9]) AS n, array_to_string(ws[i:i+9], ' ') AS win
      FROM (SELECT id, k, ws, unnest(range(1, greatest(2, len(ws) - 8))) AS i FROM (SELECT *, row_number() OVER () AS k FROM w WHERE kind = 'b' AND len(ws) > 0))),
ns AS (SELECT DISTINCT n FROM t),
d AS (SELECT id AS doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE kind = 'd'),
hit AS (SELECT doc_id, i, d.n, item_id, k, j FROM (SELECT doc_id, i, n, array_to_string(ws[i:i+n-1], ' ') AS win FROM d, ns WHERE i + n - 1 <= len(ws)) d JOIN t USING (n, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id),
run AS (SELECT doc_id, max(m) AS longest_match, arg_min(p0, -m * 1000000000 + p0) AS longest_at FROM (SELECT doc_id, count(*) + n - 1 AS m, min(i) - 1 AS p0 FROM (SELECT doc_id, n, k, i, i - j AS diag, i - row_number() OVER (PARTITION BY doc_id, k, n, i - j ORDER BY i) AS island FROM hit) GROUP BY doc_id, n, k, diag, island) GROUP BY doc_id)
SELECT w.id AS doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest_match, 0) AS longest_match, longest_at
FROM w LEFT JOIN run ON run.doc_id = w.id LEFT JOIN pos ON pos.doc_id = w.id LEFT JOIN it ON it.doc_id = w.id WHERE kind = 'd'
"""
