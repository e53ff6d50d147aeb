"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: each bit is set if it is set in over half of the XXH64 hashes (seed 42) of the document's word shingles.

Covering tables for radius r: bit position i gets a vector m(i) of r+1 bits; for every non-zero vector v of r+1 bits, table v
keeps the positions with <m(i), v> = 1 (mod 2). Any r differing positions span less than the r+1 dimensions, so some v is
orthogonal to all of them, and in table v the two fingerprints agree: every pair within the radius meets in some table, with
certainty. Only distinct fingerprints enter the tables. Buckets of more than `hot` fingerprints go through a second set of
tables, over other vectors, inside the bucket. A bucket that stays crowded is dealt by hash into parts of about `hot` members,
and each two parts are compared in a task of their own, so no row and no task holds more than about 2 x `hot` members and each
pair still meets. A task emits a spanning forest of its links, never its pairs.

Defined results: A-Z are lower-cased, words are separated by space and \\x09-\\x0D; fewer words than a shingle make one shingle
of the whole sequence; null or empty texts have no words and fingerprint zero, linked like any other. Exact repeats have
distance zero. An empty table gives an empty result. Rows that repeat a doc_id get the same values if their texts agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, first_of_each, load, text_bytes
from .components import connected

SHINGLE, RADIUS, SEED, HOT = 3, 3, 42, 4096
_CHUNK = 1 << 16


def _shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    # bytes.split() separates at space and \x09-\x0d, which are its only ASCII white space
    w = text.lower().split()
    if not w:
        return np.empty(0, dtype=np.uint64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)) if len(w) >= shingle else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, SEED) for g in grams), dtype=np.uint64, count=max(1, len(w) - shingle + 1))


def distinct_shingles(text: bytes, shingle: int) -> np.ndarray:
    """The distinct XXH64 hashes of a text's word shingles, in order."""
    return np.unique(_shingle_hashes(text, shingle))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    h = _shingle_hashes(text, shingle)
    if not len(h):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), _CHUNK):
        ones += np.unpackbits(h[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(frames: Iterator[pa.RecordBatch]):
        for f in frames:
            fps = pa.array([fingerprint(t, shingle) for t in text_bytes(f.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([f.column(0), fps], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _masks(radius: int, vector: list[int]) -> tuple[int, ...]:
    return tuple(sum(1 << i for i in range(64) if (vector[i] & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1)))


@lru_cache
def masks(radius: int = RADIUS, level: int = 0) -> tuple[int, ...]:
    """The covering masks; `level` chooses how vectors are dealt to the bit positions.

    There are more vectors than positions from a radius of 6; then they are dealt in the step by which the sparsest mask keeps most bits."""
    n = 2 ** (radius + 1) - 1
    if n <= 64:
        return _masks(radius, [(i if level == 0 else i * 4 + i // 16) % n + 1 for i in range(64)])
    dealt = [_masks(radius, [i * step % n + 1 for i in range(64)]) for step in range(2, n - 1)]
    return sorted(dealt, key=lambda found: -min(m.bit_count() for m in found))[level]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _tables(fp: Column, radius: int, level: int) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(k).alias("t"), fp.bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks(radius, level))]))


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that join all fingerprints linked within the bucket: links to a growing set of roots, in blocks."""
    root = np.arange(len(fps))
    out = []
    for i in range(1, len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= radius)
        if len(near):
            for r in np.unique(root[near]):
                j = int(near[root[near] == r][0])
                out.append((int(fps[i]), int(fps[j])))
                root[: i][root[:i] == r] = i
            root[i] = i
    return out


def _links(radius: int):
    def run(frames: Iterator[pa.RecordBatch]):
        for f in frames:
            out = []
            for members in f.column(0):
                fps = np.asarray(members.values)
                if len(fps) == 2:
                    if int(fps[0] ^ fps[1]) & 0xFFFFFFFFFFFFFFFF and int(np.bitwise_count(fps[:1].view(np.uint64) ^ fps[1:].view(np.uint64))[0]) <= radius:
                        out.append((int(fps[0]), int(fps[1])))
                else:
                    out += [(_signed(a), _signed(b)) for a, b in forest(np.sort(fps).view(np.uint64), radius)]
            yield from batches(out, ["a", "b"], [pa.int64(), pa.int64()])

    return run


def links(fps: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """fps: distinct fp. Returns edges a, b among them whose components are those of the graph of all pairs within the radius."""
    bucket = ["t", "key", "t2", "key2"]
    dealt = fps.select("fp", _tables(F.col("fp"), radius, 0).alias("x")).select("fp", "x.t", "x.key")
    sizes = dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = cut(dealt.join(sizes, ["t", "key"]), "simhash-buckets")
    cool = met.filter(F.col("n") <= hot).groupBy("t", "key").agg(F.collect_set("fp").alias("fps")).select("fps")
    again = met.filter(F.col("n") > hot).select("fp", "t", "key", _tables(F.col("fp"), radius, 1).alias("y")).select("fp", "t", "key", F.col("y.t").alias("t2"), F.col("y.key").alias("key2"))
    again = cut(again, "simhash-crowded")
    parts = again.groupBy(*bucket).agg(F.ceil(F.count(F.lit(1)) / hot).alias("parts"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    own = F.pmod(F.xxhash64("fp"), "parts")
    # a member of part i meets part j in the pair (lesser, greater); with one part that is the bucket itself
    paired = again.join(parts, bucket).select("fp", *bucket, own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    warm = paired.groupBy(*bucket, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")
    return cool.unionByName(warm).mapInArrow(_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links reach, for every row of docs."""
    marked = cut(fingerprints(docs, shingle), "simhash-fp")
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    roots = connected(links(classes.select("fp"), radius))
    in_groups = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = in_groups.groupBy("root").agg(F.min("first").alias("component_id"))
    named = in_groups.join(least, "root").select(F.col("fp").alias("class_fp"), "component_id")
    return marked.join(named, F.col("fp") == F.col("class_fp")).select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, **how) -> DataFrame:
    """One row of each group, with all its columns: of the smallest doc_id, a null only where there is no other."""
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    groups = near_duplicates(docs.select(own.alias("doc_id"), "text"), **how).select(F.col("doc_id").alias("h"), F.col("component_id").alias("root")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("h")).join(groups, "h")
    return first_of_each(docs, rows)


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(load(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
