"""What a review found missing: each test fails on the code before it."""

import pickle
import random
import time
from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SMALL
from yesterlog.llm import decontam, near_copies, pii, simhash


def shingle_set(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_groups(texts, similarity=0.8):
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if not union or len(sets[a] & sets[b]) * 10 >= round(similarity * 10) * union:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


def test_pipeline_removes_near_copies(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    texts = [None, "", " ", "one", "ONE", "a b c d e", "a b c d f"]
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(30, 300))
        texts.append(" ".join(base))
        for edits in (1, 1, 2, 3, 5, 8):
            copy = list(base)
            for at in rng.sample(range(len(copy)), edits):
                copy[at] = rng.choice(words)
            texts.append(" ".join(copy))
    crowd = rng.choices(words, k=120)
    for _ in range(150):
        copy = list(crowd)
        for at in rng.sample(range(len(copy)), rng.randint(1, 5)):
            copy[at] = rng.choice(words)
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = brute_groups(texts)
    got = {r.doc_id: r.root for r in near_copies.near_copies(docs).collect()}
    members = defaultdict(set)
    for i, root in got.items():
        members[root].add(i)
    expected = defaultdict(set)
    for i, root in enumerate(want):
        expected[root].add(i)
    # no false link, and nearly every true one: tables guarantee pairs by their distance, not by their similarity
    assert all(len({want[i] for i in group}) == 1 for group in members.values())
    linked = lambda groups: {(i, j) for g in groups.values() for i in g for j in g if i < j}
    assert len(linked(members)) >= 0.95 * len(linked(expected))
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()}
    assert kept == {min(g) for g in members.values()}
    crowded = {r.doc_id: r.root for r in near_copies.near_copies(docs, hot=2).collect()}
    assert len(set(crowded.values())) <= 1.05 * len(members)
    assert near_copies.one_of_each_group(docs.limit(0)).count() == 0


def test_near_copies_keep_one_row_of_null_and_repeated_ids(spark):
    text = "one two three four five six seven"
    rows = [(None, text), (None, text), (5, text), (5, text), (5, "something else"), (None, "only here"), (None, "only here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1))
    out = near_copies.one_of_each_group(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, [(5, text), (5, "something else"), (None, "only here")]))


def test_op4_same_rows_for_any_number_of_blocks(spark):
    rows = [(1, "alpha beta gamma delta"), (1, "x alpha beta"), (1, "x alpha beta"), (None, "gamma delta"), (None, "clean words here now"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = [(1, "alpha beta"), (2, "gamma delta"), (2, "beta gamma"), (3, "not found at all"), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    every = lambda size: sorted(map(repr, decontam.contaminated_spans(docs, bench, 2, size).collect()))
    assert len(every(1 << 24)) == len(rows)
    assert every(12) == every(1 << 24)
    matches = lambda size: sorted(map(repr, decontam.longest_matches(docs, bench, 2, size).collect()))
    assert matches(12) == matches(1 << 24) and matches(12)
    kept = decontam.clean_documents(docs, bench, 2)
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, docs.filter("doc_id = 2 or text like 'clean%'").collect()))


def brute_longest(texts, items, window):
    out = {}
    for item, text in items:
        b = (text or "").lower().split()
        for j in range(max(1, len(b) - window + 1) if b else 0):
            for doc, t in texts:
                w = (t or "").lower().split()
                for i in range(len(w)):
                    n = 0
                    while i + n < len(w) and j + n < len(b) and w[i + n] == b[j + n]:
                        n += 1
                    if n >= min(window, len(b)):
                        new = (-n, doc is None, doc or 0, i)
                        out[str(item), j] = min(out.get((str(item), j), new), new)
    return {k: (-n, None if none else doc, i) for k, (n, none, doc, i) in out.items()}


def test_longest_matches_have_no_cap(spark):
    rng = random.Random(8)
    words = ["a", "b", "c"]
    long = rng.choices(words, k=400)
    texts = [(5, " ".join(long[20:380])), (1, " ".join(long[100:300])), (None, " ".join(long)), (7, "z z z"), (7, "q"), (None, None), (2, "")]
    texts += [(k, " ".join(rng.choices(words, k=30))) for k in range(10, 30)]
    items = [(1, " ".join(long[50:250])), (2, " ".join(["x", *long[:90]])), (3, "q"), (3, "z z"), (4, None), (5, " ".join(rng.choices(words, k=40))), (6, "z z")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 24, 300):
        got = {(r.item_id, r.start): (r.length, r.doc_id, r["at"]) for r in decontam.longest_matches(docs, bench, 4, size).collect()}
        assert got == brute_longest(texts, items, 4)
        found = decontam.contaminated_spans(docs, bench, 4, size).filter("doc_id = 1").first()
        best = [(-n, at) for n, _, at in brute_longest(texts[1:2], items, 4).values()]
        assert (-found.longest, found["at"]) == min(best)


def test_op4_windows_are_small_and_made_fast():
    rng = random.Random(4)
    items = [(str(k), " ".join(f"{rng.getrandbits(28):x}" for _ in range(500)).encode()) for k in range(1200)]
    start = time.process_time()
    test = decontam.Windows(items, 10)
    data = pickle.dumps(test)
    made = time.process_time() - start
    assert len(test) == 1200 * 491 and len(data) < 100 * len(test) and made < 10
    start = time.process_time()
    back = pickle.loads(data)
    assert time.process_time() - start < 2 and back.numbers([b"absent", *decontam.words(items[3][1])[:2]]).tolist() == [0, *test.numbers(decontam.words(items[3][1])[:2])]


def test_op4_blocks_keep_their_bound(spark):
    bench = spark.createDataFrame([(i, "word " * (i % 7 + 1)) for i in range(40)], "item_id long, text string")
    n, blocks = decontam._blocks(bench, 60)
    blocks = list(blocks)
    assert n == len(blocks) > 1 and all(sum(len(t) for _, t in b) <= 60 for b in blocks)
    assert sorted(int(i) for b in blocks for i, _ in b) == list(range(40))


def test_op7_discoveries_make_patterns(spark):
    """Seeds make "mail" a pattern, its discoveries make "contact" one, and those of "contact" are found and masked after any word."""
    texts = [f"mail user{i}@site.org" for i in range(40)] + [f"mail agent{i}x" for i in range(5)]
    texts += [f"contact agent{i}x" for i in range(5)] + ["contact spy900z", "seen spy900z", "spy900z", "seen other77q"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    spans = pii.find_spans(docs)
    text = {r.doc_id: r.text for r in pii.masked(docs, spans).collect()}
    assert [text[i] for i in range(40, 54)] == ["mail [EMAIL]"] * 5 + ["contact [EMAIL]"] * 6 + ["seen [EMAIL]", "[EMAIL]", "seen other77q"]
    assert spans.filter("base").count() == 40


def test_pipeline_stages_decide_by_row(spark):
    text = "one two three four five six seven"
    rows = [(None, text), (None, text), (5, text), (5, text), (5, "something else"), (None, "only here"), (None, "only here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1))
    out = simhash.one_of_each_group(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, [(5, text), (5, "something else"), (None, "only here")]))
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert sorted(str((r.doc_id, r.text)) for r in decontam.clean_documents(docs, bench).collect()) == sorted(map(str, [(5, "something else"), (None, "only here"), (None, "only here")]))
