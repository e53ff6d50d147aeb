"""Operators 11 to 13 against plain versions on small tables with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from yesterlog.llm import divergence, minmax, periodic

EMPTY = "doc_id long, text string, lang string, source string"


def brute_runs(w, least=12):
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, 2 * q):
                best.setdefault((s, i + q - s), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in best.items())


def collapsed(w, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in drop)


def periodic_texts(rng):
    out = [None, "", " \t\n", "a", "a " * 11, "a " * 12, "ab c " * 6, "x " * 400, "A a " * 9]
    for _ in range(60):
        k, w = rng.choice([1, 2, 3, 60]), []
        for _ in range(rng.randint(0, 5)):
            unit = [f"w{rng.randrange(k)}" for _ in range(rng.randint(1, 15))]
            w += unit * rng.randint(1, 6) + unit[: rng.randint(0, len(unit))] + [f"z{rng.randrange(900)}" for _ in range(rng.randint(0, 3))]
        out.append("\n".join(w))
    return out


def test_op13_runs(spark):
    texts = periodic_texts(random.Random(2))
    rows = [(i, t) for i, t in enumerate(texts)] + [(8, texts[8]), (None, texts[7]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("runs", "start", "h")}).repartition(3)
    got = Counter((r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic.periodic_runs(docs).collect())
    want = Counter()
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", t or "")
        found = brute_runs(w)
        want[i, tuple(found), collapsed(w, found)] += 1
    assert got == want and sum(len(k[1]) for k in want) > 60
    assert periodic.periodic_runs(spark.createDataFrame([], EMPTY)).count() == 0


def test_op13_batches(spark, monkeypatch):
    """The same runs however documents are batched, and in many slabs."""
    import numpy as np

    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 2, 3000), np.tile(rng.integers(0, 9, 40), 30), np.zeros(500, dtype=np.int64)])
    doc = np.repeat([0, 1], [3500, len(ids) - 3500])
    whole = list(zip(*periodic.find_runs(ids, doc), strict=True))
    monkeypatch.setattr(periodic, "_SLAB", 97)
    assert list(zip(*periodic.find_runs(ids, doc), strict=True)) == whole
    parts = [(s, *r) for k, s in ((0, 0), (1, 3500)) for r in brute_runs(ids[doc == k].tolist())]
    assert [(int(s), int(n), int(p)) for s, n, p in whole] == [(s + a, n, p) for s, a, n, p in parts]


def test_op13_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r for r in periodic.op13_periodic_runs(spark, SMALL).collect()}
    assert set(got) == set(docs)
    hit = 0
    for i, t in docs.items():
        w, h = re.findall(r"[^\x20\x09-\x0d]+", t or ""), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[a + (j - a) % p] if j >= a else x for j, x in enumerate(w)]
        if len(w) > 3000:  # too long for the plain version
            continue
        runs = brute_runs(w)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(top or (None,) * 3))
        assert r.exponent_milli == (1000 * top[1] // top[2] if top else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
        hit += bool(runs)
    assert hit > 5


def brute_components(rows, n=4, percent=80):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = i if least[root(k)] is None else min(i, least[root(k)])
    return Counter((i, len(sets[k]), least[root(k)] if sets[k] else i) for k, (i, _) in enumerate(rows))


def near_texts(rng):
    words = [f"w{i}" for i in range(400)]
    texts = [None, None, "", " ", "one", "ONE", "one two", "a b c d", "a b c d e", "A b C d e"]
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(10, 200))
        texts.append(" ".join(base))
        for edits in (1, 1, 2, 3, 5):
            copy = list(base)
            for at in rng.sample(range(len(copy)), edits):
                copy[at] = rng.choice(words)
            texts.append(" ".join(copy))
    crowd = rng.choices(words, k=120)
    for _ in range(150):  # most pairs are just below the similarity
        copy = list(crowd)
        for at in rng.sample(range(len(copy)), rng.randint(1, 6)):
            copy[at] = rng.choice(words)
        texts.append(" ".join(copy))
    texts.append(" ".join(rng.choices(words, k=4000)))
    return texts + [texts[-1] + " end", texts[20], texts[20]]


@pytest.mark.parametrize(("part", "followed"), [(512, 4), (16, 0)])
def test_op12_components(spark, part, followed):
    texts = near_texts(random.Random(4))
    rows = list(enumerate(texts)) + [(3, texts[30]), (None, texts[40]), (None, "nobody else says this here"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "h", "keys", "key", "least", "node")}).repartition(4)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in minmax.near_duplicates(docs, part=part, followed=followed).collect())
    assert got == brute_components(rows)
    assert minmax.near_duplicates(spark.createDataFrame([], EMPTY)).count() == 0


def test_op12_signature_is_unbiased():
    """The share of equal values is the similarity, and varies less than that of as many minima would."""
    import numpy as np

    rng, shares = np.random.default_rng(5), []
    for _ in range(400):
        h = rng.integers(0, 2**64, 5, dtype=np.uint64)
        shares.append((minmax.signature(h) == minmax.signature(h[1:])).mean())
    assert abs(np.mean(shares) - 0.8) < 0.01
    assert np.var(shares) < 0.8 * 0.2 / (2 * minmax.PERMUTATIONS)


def brute_divergence(rows, floor, top=10):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        docs = Counter(t for r in mine for t in set(r[2]))
        kept = {t for t, n in docs.items() if n >= floor}
        counts = {s: Counter(t for r in mine if r[1] == s for t in r[2] if t in kept) for s in {r[1] for r in mine}}
        whole = sum(counts.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in counts.items():
            pairs = sorted((-sum(f(p(c, t), p(d, t)) for t in kept), o.encode()) for o, d in counts.items() if o != s)
            terms = sorted((-f(p(c, t), p(whole, t)), t.encode()) for t in kept if c[t] and p(c, t) > p(whole, t))[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("chunk", "block"), [(512, 16), (64, 2)])
def test_op11_divergence(spark, chunk, block):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in "abcdeXYéß字" for b in "abcdefghijklmnop"]
    rows = [(None, None, None), ("", "", ""), ("1 2 3", "en", "only digits"), ("rare", "xx", "a"), (None, "xx", "b"), ("A a;b", "yy", "alone")]
    for _ in range(300):
        source = f"s{min(rng.randrange(9), rng.randrange(9))}"
        rows.append((rng.choice([" ", "\n", "-", "7"]).join(min(rng.choices(words, k=3)) for _ in range(rng.randint(0, 40))), rng.choice(["en", "fr", None]), rng.choice([source, source, None])))
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit("1") for c in ("term", "n", "docs", "kept", "chunk")}).repartition(5)
    got = sorted(map(tuple, divergence.divergence(docs, 5, chunk=chunk, block=block).collect()))
    assert got == brute_divergence(rows, 5)
    assert divergence.divergence(spark.createDataFrame([], EMPTY)).count() == 0


HELPERS = ["__none", "__id", "__h", "__of_id", "__of_h", "__marks", "none", "id", "h", "row", "of_id", "of_h", "marks", "k", "root", "fp", "sketch", "hit", "start", "stop", "kind", "part", "score", "p", "words", "spans"]


@pytest.mark.parametrize("upper", [False, True])
def test_stages_keep_columns_of_any_name(spark, upper):
    """Every stage that returns documents leaves the values of columns named like its helpers alone; rows may be null or repeated."""
    import corpus_pipeline

    names = [n.upper() if upper else n for n in HELPERS]
    texts = ["write to someone@example.com or call +1 555 010 9999 today", "a quiet walk by the river in the long evening of may", "a quiet walk by the river in the long evening of may", "", None]
    rows = [(i if i < 4 else None, t, *[i * 100 + k for k in range(len(names))]) for i, t in enumerate(texts)]
    rows.append(rows[0])
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[F.col(n).cast("long") for n in names])
    kept = {r[0]: r[2:] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        found = out.collect()
        assert found and all(tuple(r)[2:] == kept[r.doc_id] for r in found), name
        if name == "personal_data":
            assert len(found) == len(rows) and any("[EMAIL]" in (r.text or "") for r in found)
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_near_copies_recall(spark):
    """Against all pairs of 10,000 documents whose 5-word shingles have a similarity of 0.8 or more: at least 46 of 48 are joined, and nothing else is."""
    from itertools import combinations

    from yesterlog.llm import near_copies

    docs = spark.read.parquet(SMALL.replace("sf0.001", "sf0.1") + "/documents.parquet").select("doc_id", "text").repartition(8)
    texts = sorted({(r.text or "") for r in docs.collect()})
    sets = [near_copies.shingles(t.encode()) for t in texts]
    places, common = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for g in s.tolist():
            places[g].append(i)
    for found in places.values():
        if len(found) > 1:
            common.update(combinations(found, 2))
    pairs = [p for p, n in common.items() if 10 * n >= 8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        parent[root(a)] = root(b)
    number = {t: i for i, t in enumerate(texts)}
    of = {r.doc_id: r.root for r in near_copies.near_copies(docs).collect()}
    got = {number[r.text or ""]: of[r.doc_id] for r in docs.collect()}
    assert len(pairs) == 48 and sum(got[a] == got[b] for a, b in pairs) >= 46
    members = defaultdict(set)
    for i, g in got.items():
        members[g].add(root(i))
    assert all(len(m) == 1 for m in members.values())
