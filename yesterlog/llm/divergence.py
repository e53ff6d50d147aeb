"""Divergence of sources within a language from term counts, by count-level bitmaps.

Terms are runs of letters and of all characters from U+0080, A-Z lower-cased; a language keeps those in at least `floor` of its
documents. A group (language, source) with N kept terms gives one with `count` occurrences the share
p = 1 + floor(10^9 * (count + 2) / (N + 2 V)), V being the number of kept terms, and two groups differ at a term by
floor((p - q)^2 / (p + q)). All arithmetic is exact.

* Bitmaps: kept terms are numbered by falling frequency, CHUNK numbers to a chunk, so that the many rare terms share few counts.
  For each group and chunk there is one bitset of term numbers for every count that occurs (`bitmaps`).
* Pairs: a pair's joint cells (count here, count there) are the popcounts of the AND of two bitsets; the zero count's bitset is the
  complement of the others. A cell's difference is computed once and multiplied by its popcount.
* Spread: the sources of a language are dealt into blocks of about BLOCK; a task holds two blocks of one chunk, whatever the number
  of sources or terms, and pairs are summed over the chunks. A source that holds a third of all rows is counted where its
  documents are and then has as many bitsets as others.

Defined results: null text, language or source is ''; rows that repeat a doc_id count as documents each; a group without terms, and a
language without kept terms, still has its pairs (of value 0 if V is 0); an empty table gives an empty result; other columns are
ignored. Counts are exact below 2^63.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranked import running
from .common import batches, cut, load, text_bytes

FLOOR, TOP = 10, 10
CHUNK, BLOCK = 512, 16
#: Words that a task holds before it passes on their counts.
HELD = 2_000_000
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_SCALE = 1_000_000_000
_SLICE = 1 << 21  # words of bitsets that are ANDed at once


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it); each group has a row without term too."""

    def counted(rows: list[tuple[str, str, list[bytes]]]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(t, len(numbers)) for *_, ts in rows for t in ts), dtype=np.int64)
        group_of: dict[tuple[str, str], int] = {}
        group = np.array([group_of.setdefault(r[:2], len(group_of)) for r in rows])
        size = len(numbers) + 1
        in_doc, n = np.unique(np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows]) * size + ids, return_counts=True)
        cell, at = np.unique(group[in_doc // size] * size + in_doc % size, return_inverse=True)
        n, docs = np.bincount(at, weights=n, minlength=len(cell)).astype(np.int64), np.bincount(at, minlength=len(cell))
        # the rows without term
        cell, n, docs = np.append(cell, np.arange(len(group_of)) * size + size - 1), np.append(n, np.zeros(len(group_of), dtype=np.int64)), np.append(docs, np.zeros(len(group_of), dtype=np.int64))
        named = [pa.array([g[k] for g in group_of], pa.string()).take(pa.array(cell // size)) for k in range(2)]
        terms = pa.array([*numbers, None], pa.string()).take(pa.array(cell % size))
        return pa.RecordBatch.from_arrays([*named, terms, pa.array(n), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def run(frames: Iterator[pa.RecordBatch]):
        rows, size = [], 0
        for f in frames:
            for lang, source, text in zip(f.column(0).to_pylist(), f.column(1).to_pylist(), text_bytes(f.column(2)), strict=True):
                rows.append((lang, source, _TERM.findall(text.lower())))
                size += len(rows[-1][2])
                if size > HELD:
                    yield counted(rows)
                    rows, size = [], 0
        if rows:
            yield counted(rows)

    texts = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    parts = texts.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * kept)), exact."""
    top = F.lit(_SCALE).cast("decimal(10,0)") * (count.cast("decimal(19,0)") + F.lit(2).cast("decimal(1,0)"))
    return F.call_function("div", top, total.cast("decimal(19,0)") + (2 * kept).cast("decimal(19,0)")) + 1


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def bitmaps(terms: DataFrame, size: int = CHUNK) -> DataFrame:
    """terms: lang, source, id, n. Returns lang, source, chunk, counts, bits: for each count the bitset of the chunk's ids that have it."""

    def run(frames: Iterator[pa.RecordBatch]):
        for f in frames:
            out = []
            for lang, source, chunk, cells in zip(*(f.column(i).to_pylist() for i in range(4)), strict=True):
                n = np.array([c["n"] for c in cells], dtype=np.int64)
                counts, level = np.unique(n, return_inverse=True)
                bits = np.zeros((len(counts), size), dtype=np.uint8)
                bits[level, [c["slot"] for c in cells]] = 1
                out.append((lang, source, chunk, counts.tolist(), np.packbits(bits, axis=1, bitorder="little").tobytes()))
            yield from batches(out, ["lang", "source", "chunk", "counts", "bits"], [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.binary()])

    cells = terms.groupBy("lang", "source", F.floor(F.col("id") / size).alias("chunk")).agg(F.collect_list(F.struct("n", (F.col("id") % size).alias("slot"))).alias("cells"))
    return cells.mapInArrow(run, "lang string, source string, chunk long, counts array<bigint>, bits binary")


class _Block:
    """The groups of one block in a chunk: bitsets of all their counts, the zero count first, and the shares of these."""

    def __init__(self, rows: list[dict], kept: int, chunk: int, size: int):
        full = np.zeros(size, dtype=np.uint8)
        full[: max(0, min(size, kept - chunk * size))] = 1
        full = np.packbits(full, bitorder="little").view(np.uint64)
        sets, shares, self.sources, begins = [], [], [], []
        for r in rows:
            own = np.frombuffer(r["bits"] or b"", dtype=np.uint64).reshape(-1, size // 64)
            begins.append(sum(map(len, sets)))
            self.sources.append(r["source"])
            sets.append(np.concatenate([(full & ~np.bitwise_or.reduce(own, axis=0))[None], own]))
            shares += [1 + _SCALE * (c + 2) // max(1, r["total"] + 2 * kept) for c in (0, *(r["counts"] or ()))]
        self.sets, self.shares, self.begins = np.concatenate(sets), np.array(shares, dtype=np.int64), np.array(begins)

    def against(self, other: _Block) -> np.ndarray:
        """The summed differences of all groups here and there."""
        cells = np.zeros((len(self.sets), len(other.begins)), dtype=np.int64)
        step = max(1, _SLICE // (len(other.sets) * self.sets.shape[1]))
        for i in range(0, len(self.sets), step):
            joint = np.bitwise_count(self.sets[i : i + step, None] & other.sets[None]).sum(axis=2, dtype=np.int64)
            p, q = self.shares[i : i + step, None], other.shares[None]
            cells[i : i + step] = np.add.reduceat(joint * ((p - q) ** 2 // (p + q)), other.begins, axis=1)
        return np.add.reduceat(cells, self.begins, axis=0)


def _pair_sums(groups: DataFrame, maps: DataFrame, size: int, block: int) -> DataFrame:
    """groups: lang, source, total, kept. Returns lang, a, b, value for each two sources of a language, once."""
    sizes = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    grid = groups.join(sizes, "lang").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("kept") - 1, F.lit(0)) / size))))
    grid = grid.withColumn("own", F.pmod(F.xxhash64("source"), "blocks")).join(maps, ["lang", "source", "chunk"], "left")
    grid = grid.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    key = ["lang", "chunk", "i", "j"]
    grid = grid.select("lang", "chunk", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "source", "total", "kept", "counts", "bits")

    def run(frames: Iterator[pa.RecordBatch]):
        def sums(rows):
            first = rows[0]
            sides = [_Block(r, first["kept"], first["chunk"], size) for k in dict.fromkeys((first["i"], first["j"])) if (r := [x for x in rows if x["own"] == k])]
            if first["i"] == first["j"] or len(sides) == 2:
                values = sides[0].against(sides[-1])
                for a, x in enumerate(sides[0].sources):
                    for b, y in enumerate(sides[-1].sources):
                        if len(sides) == 2 or a < b:
                            yield first["lang"], min(x, y), max(x, y), int(values[a, b])

        out, waiting, at = [], [], None
        for f in frames:
            for r in f.to_pylist():
                if at != (now := tuple(r[k] for k in key)) and waiting:
                    out += sums(waiting)
                    waiting = []
                    if len(out) > 8192:
                        yield from batches(out, ["lang", "a", "b", "value"], [pa.string()] * 3 + [pa.int64()])
                        out = []
                at = now
                waiting.append(r)
        if waiting:
            out += sums(waiting)
        yield from batches(out, ["lang", "a", "b", "value"], [pa.string()] * 3 + [pa.int64()])

    dealt = grid.repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, floor: int = FLOOR, top: int = TOP, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """docs: text, lang, source. Returns lang, source, part, item, value, rank: part `pair` holds the summed difference of each other
    source of the language, part `term` the `top` terms that are commoner in the source than in the language and differ most.

    chunk: terms of a bitset, a multiple of 64; block: sources of a block."""
    counts = cut(term_counts(docs), "divergence-terms")
    kept = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= floor)
    kept = running(kept, ["lang"], [F.col("docs").desc(), "term"], {"id": F.lit(1)}).drop("docs")
    terms = cut(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "divergence-kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("of_lang").alias("all"))
    totals = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = cut(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "kept", "all")]), "divergence-groups")

    sums = cut(_pair_sums(groups.select("lang", "source", "total", "kept"), bitmaps(terms, chunk), chunk, block), "divergence-pairs")
    pairs = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    both = terms.filter("n > 0").join(groups, ["lang", "source"])
    both = both.withColumn("p", share(F.col("n"), F.col("total"), F.col("kept"))).withColumn("q", share(F.col("of_lang"), F.col("all"), F.col("kept"))).filter("p > q")
    best = both.select("lang", "source", F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value")).withColumn("rank", rank).filter(F.col("rank") <= top)
    columns = lambda part: ["lang", "source", F.lit(part).alias("part"), "item", "value", "rank"]
    return pairs.withColumn("rank", rank).select(*columns("pair")).unionByName(best.select(*columns("term")))


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(load(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS MATERIALIZED (SELECT k, lang, source, unnest(ts) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM kept GROUP BY lang),
cnt AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (SELECT lang, source, coalesce(v, 0) AS v, coalesce(langs.total, 0) AS of_lang, coalesce(s.total, 0)::BIGINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN langs USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM cnt GROUP BY ALL) s USING (lang, source)),
cell AS MATERIALIZED (SELECT g.lang, g.source, kept.term, coalesce(cnt.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(cnt.n, 0) + 2)) // (g.total + 2 * g.v))::BIGINT AS p, (1 + (1000000000::HUGEINT * (kept.n + 2)) // (g.of_lang + 2 * g.v))::BIGINT AS q
  FROM g JOIN kept USING (lang) LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source AND cnt.term = kept.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM cell WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every) WHERE part = 'pair' OR rank <= 10
"""
