"""Near-duplicates by min-max hashing: documents whose sets of word shingles have a Jaccard similarity of at least 0.8.

* Signatures: a set's shingle hashes go through PERMUTATIONS permutations, and of each both the least and the greatest value are
  kept, so half as many evaluations give as many values. Both agree between two sets with the probability of their similarity,
  and since one shingle can't spoil both, the share of equal values has a lower variance than that of as many minima.
* Bands: BAND successive values (16 bits each) are one band's key. A pair at the similarity shares no band with a probability of
  (1 - 0.8^4)^32, 5 in 10^8. Only distinct sets enter the bands, and only keys with two sets or more leave the first shuffle.
* First partners: sets that share a key are candidates. Each set is first held against HEADS others, those with most keys in common,
  from a chain of heads in its buckets that gives no set more than FAN followers a bucket and step. So a group of thousands of
  copies costs HEADS comparisons a set, and nearly all of its sets are one group from then on, also where a pair of them is as often
  below the similarity as not; with one comparison half of them were left, and met each other in parts.
* All others: in buckets that still have several groups all pairs of different groups meet, each in the first band it shares. They
  are candidates if they share at least SKETCH of the values (a pair at the similarity has fewer with a probability of about 1 in
  10^8). A bucket's sets outside its largest group are dealt into parts of PART sets, those of that group too, and each two parts of
  which one is outside it meet in a task; the largest group isn't compared within itself. A task that would make more than FOLLOWED
  pairs for each of its sets gets the full sets instead, decides there and emits a spanning forest of its links.
* Decision: exact, on the full sets of 64-bit shingle hashes. Groups are the connected components of the links found.

Defined results: A-Z are lower-cased, words are separated by space and \\x09-\\x0D; a text with fewer words than a shingle has one
shingle, all its words; null, empty and blank texts have none and are linked with nothing. component_id is the least doc_id of the
group; a null doc_id counts only where there is no other, and two null rows are no copies of one another unless their texts link
them. Rows that repeat a doc_id get a row each. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, cut, load, release, text_bytes
from .components import connected
from .simhash import distinct_shingles

SHINGLE, SIMILARITY = 4, 80  # words, per cent
PERMUTATIONS, BAND, SKETCH = 64, 4, 72
FAN, HEADS, PART, FOLLOWED = 64, 4, 512, 4
_CHUNK = 2048
_RANDOM = np.random.default_rng(12)
_XOR = _RANDOM.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64)
_ODD = _RANDOM.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """16 bits of the least and of the greatest value of each permutation, in turn."""
    low, high = np.full(PERMUTATIONS, 2**64 - 1, dtype=np.uint64), np.zeros(PERMUTATIONS, dtype=np.uint64)
    for i in range(0, len(hashes), _CHUNK):
        v = (hashes[i : i + _CHUNK, None] ^ _XOR) * _ODD
        low, high = np.minimum(low, v.min(axis=0)), np.maximum(high, v.max(axis=0))
    both = np.stack([low, high], axis=1).reshape(-1)
    both ^= both >> np.uint64(29)
    return (both * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.uint16)


def _marked(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, t (hash of the text), n (size of the set), h (its hash) and keys (its bands) for every row."""

    def run(frames: Iterator[pa.RecordBatch]):
        release()
        for f in frames:
            sets = [distinct_shingles(t, shingle) for t in text_bytes(f.column(2))]
            n = np.array([len(s) for s in sets], dtype=np.int64)
            h = [xxhash.xxh64_intdigest(s.tobytes()) for s in sets]
            keys = np.concatenate([signature(s) for s in sets if len(s)] or [np.empty(0, np.uint16)]).view(np.int64)
            ends = np.concatenate([[0], np.cumsum((n > 0) * (2 * PERMUTATIONS // BAND))]).astype(np.int32)
            columns = [f.column(0), f.column(1), pa.array(n), pa.array(np.array(h, dtype=np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t", "n", "h", "keys"])

    return _texts(docs).mapInArrow(run, "doc_id long, t long, n long, h long, keys array<bigint>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text")


def _buckets(classes: DataFrame) -> DataFrame:
    """key, band, h, head for every set that shares the key with another: head is the set before it in the bucket's chain, null for the first."""

    def run(frames: Iterator[pa.RecordBatch]):
        release()
        names = ["key", "h", "band", "head"]
        waiting, number_of, heads = None, 0, [0, 0, 0]  # the last row, its number, and the heads of its steps by FAN^0, FAN, FAN^2...
        for f in frames:
            key, h, band = (f.column(i).to_numpy() for i in range(3))
            if waiting is not None:
                key, h, band = (np.concatenate([x, y]) for x, y in zip(waiting, (key, h, band), strict=True))
            equal, at = key[1:] == key[:-1], np.arange(len(key))
            first = np.maximum.accumulate(np.where(np.append(True, ~equal), at, 0))
            number = at - first + np.where(first == 0, number_of, 0)
            reach = [number % FAN, number % FAN**2, number]  # how far back the heads of each step lie
            level = np.where(reach[0] > 0, 0, np.where(reach[1] > 0, 1, 2))
            back = at - np.choose(level, reach)
            head = np.where(back >= 0, h[np.maximum(back, 0)], np.choose(level, heads))
            shared = np.append(number[:-1] > 0, False) | np.append(equal, False)
            none = number == 0
            yield pa.RecordBatch.from_arrays([pa.array(key[shared]), pa.array(h[shared]), pa.array(band[shared]), pa.array(head[shared], mask=none[shared])], names=names)
            last = [at[-1] - int(r[-1]) for r in reach]
            heads = [int(h[x]) if x >= 0 else old for x, old in zip(last, heads, strict=True)]
            waiting, number_of, before = (key[-1:], h[-1:], band[-1:]), int(number[-1]), head[-1:]
        if waiting is not None and number_of:
            yield pa.RecordBatch.from_arrays([*map(pa.array, waiting), pa.array(before)], names=names)

    keyed = classes.select(F.posexplode("keys").alias("band", "value"), "h").select(F.xxhash64("band", "value").alias("key"), "h", "band")
    return keyed.repartition("key").sortWithinPartitions("key", "h").mapInArrow(run, "key long, h long, band int, head long")


def _ordered(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _first_partners(met: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: each set with the HEADS heads that it shares most keys with, if their signatures are near enough."""
    votes = met.filter("head is not null").groupBy("h", "head").agg(F.count(F.lit(1)).alias("votes"))
    most = votes.withColumn("rank", F.row_number().over(Window.partitionBy("h").orderBy(F.desc("votes"), F.desc("head")))).filter(F.col("rank") <= HEADS)
    pairs = most.select(*_ordered("h", "head")).distinct()

    def near(frames: Iterator[pa.RecordBatch]):
        release()
        for f in frames:
            x, y = (f.column(i).flatten().to_numpy().view(np.uint16).reshape(-1, 2 * PERMUTATIONS) for i in (2, 3))
            keep = (x == y).sum(axis=1) >= SKETCH
            yield pa.RecordBatch.from_arrays([pa.array(f.column(i).to_numpy()[keep]) for i in range(2)], names=["a", "b"])

    both = pairs.join(classes.select(F.col("h").alias("a"), F.col("keys").alias("x")), "a").join(classes.select(F.col("h").alias("b"), F.col("keys").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(near, "a long, b long")


def _groups(frames: Iterator[pa.RecordBatch], keys: int):
    """Consecutive rows of equal first columns, as lists of columns: numpy, signatures for `keys`, lists of bytes for binary ones."""

    def plain(x):
        if pa.types.is_list(x.type):
            return x.flatten().to_numpy().view(np.uint16).reshape(-1, 2 * PERMUTATIONS)
        return np.array(x.to_pylist(), dtype=object) if pa.types.is_binary(x.type) else x.to_numpy()

    parts: list[list[np.ndarray]] = []
    for f in frames:
        rows = [plain(x) for x in f.columns]
        new = np.zeros(len(rows[0]), dtype=bool)
        for x in rows[:keys]:
            new[1:] |= x[1:] != x[:-1]
        if parts and any(p[-1] != x[0] for p, x in zip(parts[-1][:keys], rows[:keys], strict=True)):
            yield [np.concatenate(x) for x in zip(*parts, strict=True)]
            parts = []
        begins = [0, *np.flatnonzero(new).tolist(), len(new)]
        for a, b in zip(begins[:-1], begins[1:], strict=True):
            if a and parts:
                yield [np.concatenate(x) for x in zip(*parts, strict=True)]
                parts = []
            parts.append([x[a:b] for x in rows])
    if parts:
        yield [np.concatenate(x) for x in zip(*parts, strict=True)]


_TASK = ["key", "i", "j"]


def _dealt(met: DataFrame, groups: DataFrame, part: int) -> DataFrame:
    """The sets of buckets with several groups, for each two parts that meet: key, i, j, band, own, h, root."""
    rows = met.join(groups, F.col("h") == F.col("node"), "left").select("key", "band", "h", F.coalesce("root", "h").alias("root"))
    roots = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.max("n").alias("inside"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("roots"))
    roots = roots.filter("roots > 1").select("key", "top", F.ceil((F.col("all") - F.col("inside")) / part).alias("outer"), F.ceil(F.col("inside") / part).alias("inner"))
    own = F.when(F.col("root") == F.col("top"), F.col("outer") + F.pmod(F.xxhash64("h"), "inner")).otherwise(F.pmod(F.xxhash64("h"), "outer"))
    rows = rows.join(roots, "key").withColumn("own", own)
    # a part of the largest group meets the parts outside it; these meet all parts
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("own") >= F.col("outer"), F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1)
    rows = rows.select("key", "band", "h", "root", "own", F.explode(others).alias("other"))
    return rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "band", "own", "h", "root")


def _brought(dealt: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """Each task's rows with these columns of their sets, in the task's place."""
    rows = dealt.join(sets.select("h", *columns), "h").select(*dealt.columns, *columns)
    return rows.repartition(*_TASK).sortWithinPartitions(*_TASK)


def _near(group: list[np.ndarray], similarity: int):
    """Yields x, ys: rows of a task's sets and the later ones of other groups near them by size and signature. A pair that shares
    several bands is met in the first of them only."""
    _, i, j, band, own, _, root, n, sign = group[:9]
    x, y = np.flatnonzero(own == i[0]), np.flatnonzero(own == j[0])
    bands = sign.view(np.int64)
    for k, a in enumerate(x):
        b = y[k + 1 :] if i[0] == j[0] else y
        b = b[(root[b] != root[a]) & (np.minimum(n[a], n[b]) * 100 >= similarity * np.maximum(n[a], n[b]))]
        b = b[(bands[b, : band[0]] != bands[a, : band[0]]).all(axis=1)]
        b = b[(sign[b] == sign[a]).sum(axis=1) >= SKETCH]
        if len(b):
            yield a, b


def _between(dealt: DataFrame, classes: DataFrame, similarity: int, followed: int) -> DataFrame:
    """Pairs a, b of near sets; or key, i, j of a task that would make more than `followed` pairs for each of its sets."""

    def run(frames: Iterator[pa.RecordBatch]):
        release()
        for group in _groups(frames, 3):
            h, out, pairs = group[5], [], 0
            for a, b in _near(group, similarity):
                out.append(np.stack([np.full(len(b), h[a]), h[b]]))
                pairs += len(b)
                if pairs > followed * len(h):
                    break
            if pairs > followed * len(h):
                columns = [pa.nulls(1, pa.int64())] * 2 + [pa.array(x[:1]) for x in group[:3]]
            elif pairs:
                a, b = np.concatenate(out, axis=1)
                columns = [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))] + [pa.nulls(pairs, pa.int64())] * 3
            else:
                continue
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", *_TASK])

    return _brought(dealt, classes, "n", "keys").mapInArrow(run, "a long, b long, key long, i long, j long")


def _crowded(dealt: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """a, b: links that join all groups of a task that have one; sets: h, n, keys, full. Nothing but such a forest leaves the task."""

    def run(frames: Iterator[pa.RecordBatch]):
        release()
        for group in _groups(frames, 3):
            h, root, sets, out = group[5], group[6].copy(), [np.frombuffer(x, dtype=np.uint64) for x in group[9]], []
            for a, near in _near(group, similarity):
                near = near[root[near] != root[a]]
                if not len(near):
                    continue
                size = np.array([len(sets[b]) for b in near])
                every = np.concatenate([sets[b] for b in near])
                at = np.searchsorted(sets[a], every)
                same = sets[a][np.minimum(at, len(sets[a]) - 1)] == every
                common = np.add.reduceat(same.astype(np.int64), np.cumsum(size) - size)
                for b in near[100 * common >= similarity * (len(sets[a]) + size - common)]:
                    if root[a] != root[b]:
                        out.append((int(h[a]), int(h[b])))
                        root[root == root[b]] = root[a]
            yield from batches(out, ["a", "b"], [pa.int64(), pa.int64()])

    return _brought(dealt, sets, "n", "keys", "full").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """h, own: the full sets, as sorted 64-bit hashes, of the wanted h."""

    def sets(frames: Iterator[pa.RecordBatch]):
        release()
        for f in frames:
            found = [distinct_shingles(t, shingle).tobytes() for t in text_bytes(f.column(0))]
            h = np.array([xxhash.xxh64_intdigest(s) for s in found], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(found, pa.binary())], names=["h", "own"])

    texts = classes.join(wanted, "h", "left_semi").select("t")
    own = _texts(docs).join(texts, "t", "left_semi").select("t", "text").dropDuplicates(["t"]).select("text").mapInArrow(sets, "h long, own binary")
    return cut(own.dropDuplicates(["h"]), "minmax-sets")


def _linked(docs: DataFrame, classes: DataFrame, pairs: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """The pairs a, b whose full sets have the similarity."""

    def decide(frames: Iterator[pa.RecordBatch]):
        release()
        for f in frames:
            out = []
            for a, b, x, y in zip(*(f.column(i).to_pylist() for i in range(4)), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= similarity * (len(x) + len(y) - common):
                    out.append((a, b))
            yield from batches(out, ["a", "b"], [pa.int64(), pa.int64()])

    wanted = pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h"))).distinct()
    own = _sets(docs, classes, wanted, shingle)
    both = pairs.join(own.select(F.col("h").alias("a"), F.col("own").alias("x")), "a").join(own.select(F.col("h").alias("b"), F.col("own").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(decide, "a long, b long")


def linked_sets(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, part: int = PART, followed: int = FOLLOWED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables `_marked` (of all rows) and classes (of distinct sets with a shingle), and node, root for every set that is linked with another."""
    marked = cut(_marked(docs, shingle), "minmax-marked")
    some = marked.filter("n > 0")
    classes = cut(some.groupBy("h", "n").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.min_by("t", "t").alias("t"), F.any_value("keys").alias("keys")), "minmax-classes")
    met = cut(_buckets(classes), "minmax-buckets")
    edges = cut(_linked(docs, classes, cut(_first_partners(met, classes), "minmax-pairs"), shingle, similarity), "minmax-links")
    dealt = cut(_dealt(met, connected(edges), part), "minmax-dealt")
    near = cut(_between(dealt, classes, similarity, followed), "minmax-near")
    edges = edges.unionByName(cut(_linked(docs, classes, near.filter("a is not null").select("a", "b"), shingle, similarity), "minmax-links"))
    crowded = near.filter("key is not null").select(*_TASK)
    if not crowded.isEmpty():
        dealt = cut(dealt.join(crowded, _TASK, "left_semi").select(*dealt.columns), "minmax-crowded")
        own = _sets(docs, classes, dealt.select("h").distinct(), shingle).withColumnRenamed("own", "full")
        edges = edges.unionByName(cut(_crowded(dealt, classes.select("h", "n", "keys").join(own, "h"), similarity), "minmax-links"))
    groups = connected(edges)
    return marked, classes, groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY, part: int = PART, followed: int = FOLLOWED) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs; similarity is in per cent."""
    marked, classes, groups = linked_sets(docs, shingle, similarity, part, followed)
    of = classes.join(groups, F.col("h") == F.col("node"), "left").select("h", "least", "copies", F.coalesce("root", "h").alias("root"), F.col("root").isNotNull().alias("linked"))
    least = of.filter("linked").groupBy("root").agg(F.min("least").alias("first"))
    # sets that are alone keep their rows' own ids
    named = of.filter("linked or copies > 1").join(least, "root", "left").select(F.col("h").alias("of"), F.coalesce("first", "least").alias("component"), F.lit(True).alias("known"))
    out = marked.select("doc_id", "n", F.when(F.col("n") > 0, F.col("h")).alias("h")).join(named, F.col("h") == F.col("of"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("known"), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def op12_minmax(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(load(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLE = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i+3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
step AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM w UNION SELECT reach.doc_id, step.b FROM reach JOIN step ON step.a = reach.r)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""
