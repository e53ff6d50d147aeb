"""Detection of periodic runs of words by an enhanced suffix array and the branching-tandem test.

A run is a maximal stretch of words that repeats with its smallest period q at least twice. Its last 2q words are a square whose two
halves are followed by different words, a branching tandem repeat, and each such square is the right end of one run.

* Array: suffixes are sorted by doubling ranks; only groups that are still tied are sorted again. The ranks of every doubling step
  stay, so that common prefixes of any two suffixes are found by bisection (`Array`).
* Branching-tandem test: the LCP value between two neighbours splits its LCP interval of that depth into two sides. For each suffix i
  of the smaller side the inverse suffix array tells whether i + depth or i - depth lies in the other side. That is a square with
  halves of `depth` words. Intervals are pairs of bounds found by bisection over minima; no tree is built, and smaller sides add up
  to n log n suffixes at most.
* Rotation: a square is moved to the left as long as the word before it equals the word one period later, by bisection over the
  ranks. Squares that end up as the same stretch are merged, and the smallest period stays.

A run of at least `least` words holds only words of (least // 2)-grams that occur twice in its document, so other words are left out
of the array first, in one pass of hashing. Documents are handled in batches of BATCH words, words being numbered within their
document; a longer document is a batch of its own and takes some 200 bytes for each word that is not left out.

Defined results: words are separated by space and \\x09-\\x0D and compared byte by byte; null, empty and blank texts have no words and
no run; repeated rows and null doc_ids get a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, load, text_bytes

#: Words of a run at least.
LEAST = 12
BATCH = 1 << 19
_SLAB = 1 << 21  # suffixes tested at once
_EMPTY = np.empty(0, dtype=np.int64)


class Array:
    """Suffix array, LCP array and the ranks of all doubling steps of a sequence of numbers; `order` is the array, `ranks[-1]` its inverse."""

    def __init__(self, numbers: np.ndarray):
        n = len(numbers)
        values, at, count = np.unique(numbers, return_inverse=True, return_counts=True)
        rank = (np.cumsum(count) - count)[at]  # suffixes before the group
        self.ranks = [np.append(rank, -1).astype(np.int32)]
        open_, step = np.flatnonzero(count[at] > 1), 1
        while len(open_):
            later = np.where(open_ + step < n, rank[np.minimum(open_ + step, n - 1)], -1)
            order = np.lexsort((later, rank[open_]))
            open_, later = open_[order], later[order]
            first = rank[open_]
            place = np.arange(len(open_))
            group = np.append(True, first[1:] != first[:-1])
            new = group | np.append(True, later[1:] != later[:-1])
            begin = np.maximum.accumulate(np.where(new, place, 0))
            rank[open_] = first + begin - np.maximum.accumulate(np.where(group, place, 0))
            self.ranks.append(np.append(rank, -1).astype(np.int32))
            open_ = open_[~new | ~np.append(new[1:], True)]
            step *= 2
        self.order = np.empty(n, dtype=np.int64)
        self.order[rank] = np.arange(n)
        self.common = np.zeros(n, dtype=np.int64)  # with the suffix before it in order
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            same = (self.ranks[k][a] == self.ranks[k][b]).astype(np.int64) << k
            self.common[1:] += same
            a, b = np.minimum(a + same, n), np.minimum(b + same, n)

    def splits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place k in order whose suffix has words in common with the one before: k, and the bounds lo, hi of the interval
        that its LCP value splits into lo..k-1 and k..hi. Of equal values the later one has the earlier one's sides to its left."""
        n, least = len(self.order), [self.common]
        while 1 << len(least) < n:
            half = 1 << len(least) - 1
            least.append(np.minimum(least[-1][:-half], least[-1][half:]))
        k = np.flatnonzero(self.common > 0)
        depth, lo, hi = self.common[k], k - 1, k.copy()
        for j in range(len(least) - 1, -1, -1):
            step = 1 << j
            at = lo - step + 1  # the values at..lo are at least the depth
            go = (at >= 0) & (least[j][np.clip(at, 0, len(least[j]) - 1)] >= depth)
            lo = np.where(go, lo - step, lo)
            at = hi + 1
            go = (at + step <= n) & (least[j][np.clip(at, 0, len(least[j]) - 1)] > depth)
            hi = np.where(go, hi + step, hi)
        return k, lo, hi

    def squares(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and half lengths of all squares whose halves are followed by different numbers."""
        k, lo, hi = self.splits()
        depth, inverse, n = self.common[k], self.ranks[-1][:-1], len(self.order)
        left = k - lo <= hi - k + 1
        first, size = np.where(left, lo, k), np.where(left, k - lo, hi - k + 1)
        other = np.where(left, k, lo), np.where(left, hi, k - 1)
        found, total = [], np.cumsum(size)
        cuts = [0, *np.searchsorted(total, np.arange(_SLAB, total[-1] if len(total) else 0, _SLAB)).tolist(), len(k)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            split = np.repeat(np.arange(a, b), size[a:b])
            i = self.order[first[split] + np.arange(len(split)) - np.repeat(total[a:b] - size[a:b] - (total[a - 1] if a else 0), size[a:b])]
            for start, to in ((i, i + depth[split]), (i - depth[split], i - depth[split])):
                place = inverse[np.clip(to, 0, n - 1)]
                hit = (to >= 0) & (to < n) & (place >= other[0][split]) & (place <= other[1][split])
                found.append((start[hit], depth[split][hit]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (_EMPTY, _EMPTY)

    def rotated(self, start: np.ndarray, period: np.ndarray) -> np.ndarray:
        """The starts of the periodic stretches that the squares end."""
        for k in range(len(self.ranks) - 1, -1, -1):
            to = start - (1 << k)
            inside = np.maximum(to, 0)
            start = np.where((to >= 0) & (self.ranks[k][inside] == self.ranks[k][inside + period]), to, start)
        return start


def _repeated(ids: np.ndarray, doc: np.ndarray, gram: int) -> np.ndarray:
    """Mask of the words that lie in a gram which occurs twice in its document."""
    mask = np.zeros(len(ids) + 1, dtype=np.int64)
    if len(ids) >= gram:
        word = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        word ^= word >> np.uint64(31)
        h = np.zeros(len(ids) - gram + 1, dtype=np.uint64)
        for k in range(gram):
            h = h * np.uint64(0xBF58476D1CE4E5B9) + word[k : k + len(h)]
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        again = np.flatnonzero(np.append(same, False) | np.append(False, same))
        np.add.at(mask, order[again], 1)
        np.add.at(mask, order[again] + gram, -1)
    return np.cumsum(mask)[:-1] > 0


def find_runs(ids: np.ndarray, doc: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """ids: word numbers, document after document; doc: each word's document, ascending. Returns start (in ids), length, period of all
    runs, by start, then period."""
    kept = np.flatnonzero(_repeated(ids, doc, max(1, least // 2)))
    if not len(kept):
        return _EMPTY, _EMPTY, _EMPTY
    last = np.append((kept[1:] != kept[:-1] + 1) | (doc[kept[1:]] != doc[kept[:-1]]), True)
    # after each stretch comes a number of its own, so that nothing runs on into the next one
    at = np.arange(len(kept)) + np.cumsum(last) - last
    place = np.full(len(kept) + int(last.sum()), -1, dtype=np.int64)
    place[at] = kept
    numbers = np.empty(len(place), dtype=np.int64)
    numbers[at] = doc[kept] * (int(ids.max()) + 1) + ids[kept]
    gaps = np.flatnonzero(place < 0)
    numbers[gaps] = -1 - np.arange(len(gaps))
    array = Array(numbers)
    square, period = array.squares()
    start = array.rotated(square, period)
    length = square + 2 * period - start
    long = length >= least
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(start)]
    start, length, period = place[start[new]], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _report(rows: list[tuple[int, list[bytes]]], least: int):
    """doc_id, runs, collapsed of each row (doc_id, words)."""
    numbers: dict[bytes, int] = {}
    size = np.array([len(w) for _, w in rows])
    ids = np.fromiter((numbers.setdefault(x, len(numbers)) for _, w in rows for x in w), dtype=np.int64, count=int(size.sum()))
    begin = np.cumsum(size) - size
    start, length, period = find_runs(ids, np.repeat(np.arange(len(rows)), size), least)
    drop = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(drop, start + period, 1)
    np.add.at(drop, start + length, -1)
    keep = np.cumsum(drop)[:-1] == 0
    of = np.searchsorted(begin, start, "right") - 1  # of documents that begin at one place only the last has words
    bounds = np.searchsorted(of, np.arange(len(rows) + 1))
    out = []
    for k, (doc, words) in enumerate(rows):
        a, b = bounds[k], bounds[k + 1]
        runs = [{"start": s, "length": n, "period": p} for s, n, p in zip((start[a:b] - begin[k]).tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True)]
        kept = compress(words, keep[begin[k] : begin[k] + size[k]].tolist()) if runs else words
        out.append((doc, runs, b" ".join(kept)))
    yield from batches(out, ["doc_id", "runs", "collapsed"], [pa.int64(), _RUN, pa.string()], 1024)


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, runs (start, length, period in words, by start, then period), collapsed (the words that no
    run contains after its first period, joined by one space), for every row of docs."""

    def run(frames: Iterator[pa.RecordBatch]):
        rows, size = [], 0
        for f in frames:
            for doc, text in zip(f.column(0).to_pylist(), text_bytes(f.column(1)), strict=True):
                words = text.split()  # bytes.split() separates at space and \x09-\x0d
                if rows and size + len(words) > BATCH:
                    yield from _report(rows, least)
                    rows, size = [], 0
                rows.append((doc, words))
                size += len(words)
        if rows:
            yield from _report(rows, least)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, "doc_id long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def _made_periodic(frames: Iterator[pa.RecordBatch]):
    """The contract's edit: of every tenth document by hash the words from some place on repeat a few words."""
    for f in frames:
        texts = text_bytes(f.column(1))
        for k, doc in enumerate(f.column(0).to_pylist()):
            h = crc32(str(doc).encode()) if doc is not None else 1
            if h % 10 == 0 and (w := texts[k].split()):
                g = h // 10
                a = g % len(w)
                p = 1 + (len(w) - a) // (3 + g % 8)
                texts[k] = b" ".join(w[:a] + [w[a + i % p] for i in range(len(w) - a)])
        yield pa.RecordBatch.from_arrays([f.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from those of periodic_runs."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    runs = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("short"), r["start"].alias("start"), r["period"].alias("period")))
    top = F.array_min(order)
    length = -top["short"]
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), length.alias("length"), top["period"].alias("period"), ((1000 * length - (1000 * length) % top["period"]) / top["period"]).cast("long").alias("exponent_milli"),
        F.sha2(runs, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return digest(periodic_runs(docs.mapInArrow(_made_periodic, "doc_id long, text string")))
