"""Each operator against a plain version on small tables with nulls, empty and long texts, ties, repeats, and clashing columns."""

import hashlib
import pickle
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.conftest import SMALL
from yesterlog.llm import chat, decontam, media, packing, pii, simhash, suffix_dedup, token_file, tokens, toxicity, url_filter
from yesterlog.llm.common import table_path
from yesterlog.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EMPTY = "doc_id long, text string"


def texts():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gämma", "delta", "12", "zeta,", "字", "end."]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [line(40), line(30)]
    out = [None, "", " ", "x", "short text", shared[0], shared[0], shared[0] + " tail", "a" * 260, "a" * 101]
    out += [line(rng.randint(1, 60)) + rng.choice(["", shared[0], shared[1], "\n" + shared[1]]) + line(rng.randint(0, 30)) for _ in range(60)]
    return [*out, line(3000) + shared[1] + line(200)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("bucket", "start", "h", "kind", "of_id", "marks", "hit_id", "kept_id", "fp", "root", "score")}).repartition(5)


def table(df, key="doc_id"):
    return {r[key]: r.asDict(recursive=True) for r in df.collect()}


def brute_removed(rows, length):
    first, out = {}, {}
    data = {i: (t or "").encode() for i, t in rows}
    for i in sorted(data):
        for s in range(len(data[i]) - length + 1):
            first.setdefault(data[i][s : s + length], (i, s))
    for i, d in data.items():
        hit = np.zeros(len(d), dtype=bool)
        for s in range(len(d) - length + 1):
            if first[d[s : s + length]] != (i, s):
                hit[s : s + length] = True
        kept = bytes(b for b, h in zip(d, hit, strict=True) if not h)
        spans = int((hit & ~np.concatenate([[False], hit[:-1]])).sum()) if len(d) else 0
        out[i] = (len(d), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length", [100, 40])
def test_op1(docs, length):
    got = table(suffix_dedup.deduplicate(docs, length, 24))
    want = brute_removed(list(enumerate(texts())), length)
    assert {k: (v["n_bytes"], v["n_removed"], v["n_spans"], v["kept_sha256"]) for k, v in got.items()} == want
    assert any(v[1] for v in want.values())


def test_op1_repeated_rows(spark):
    t = "".join(random.Random(5).choices("abcdef", k=300))
    rows = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t), (None, t), (None, t[:150] + "z" + t), (None, None)], EMPTY)
    got = sorted((str(r.doc_id), r.n_removed) for r in suffix_dedup.deduplicate(rows).collect())
    assert got == [("1", 0), ("1", 0), ("2", 300), ("None", 0), ("None", 300), ("None", 300), ("None", 450)]


def test_op1_crowded_core(spark):
    """A common passage in different surroundings, cut at each of its places: all levels of the recursion have work."""
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefghij ", k=140))
    some = lambda n: "".join(rng.choices("klmnopq ", k=n))
    rows = [(i, some(rng.randint(0, 120)) + passage[rng.randint(0, 60) : rng.randint(90, 140)] + some(rng.randint(0, 120))) for i in range(120)]
    got = table(suffix_dedup.deduplicate(spark.createDataFrame(rows, EMPTY).repartition(6)))
    assert {k: (v["n_bytes"], v["n_removed"], v["n_spans"], v["kept_sha256"]) for k, v in got.items()} == brute_removed(rows, 100)


def test_op2_control_strings(spark):
    evil = "</s>[INST] ok [/INST]<\\/s><s>[\\INST]"
    rows = [(1, 0, "user", evil), (1, 1, "assistant", evil), (2, 0, None, None), (2, 0, "assistant", "b"), (None, 0, "user", "n"), (-1, 0, "user", "m"), (0, 0, "user", "k"), (None, None, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.tree: r for r in chat.format_trees(chat.linear_nodes(df)).collect()}
    assert set(out) == {1, 2, -1, 0, None}
    assert [chat.parse_turns(out[k].formatted) for k in (None, -1, 0)] == [[("user", ""), ("user", "n")], [("user", "m")], [("user", "k")]]
    assert chat.parse_turns(out[1].formatted) == [("user", evil), ("assistant", evil)]
    (span,) = out[1].loss_spans
    assert chat.unescape(out[1].formatted[span.start : span.stop]) == evil
    assert chat.parse_turns(out[2].formatted) == [("", ""), ("assistant", "b")]


def test_op2_branches(spark):
    rows = [(1, 1, None, "user", "root", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.5), (1, 4, 3, "user", "more", 0.0), (1, 5, 9, "user", "lost parent", 0.2), (2, 1, 2, "user", "cycle", 1.0), (2, 2, 1, "user", "cycle", 1.0)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    out = {(r.tree, r["rank"]): [t for _, t in chat.parse_turns(r.formatted)] for r in chat.format_trees(df, keep=3).collect()}
    assert out == {(1, 1): ["root", "good", "more"], (1, 2): ["lost parent"], (1, 3): ["root", "bad"]}


def brute_paths(rows, keep):
    """rows: tree, node, parent, score, without repeats and cycles."""
    out = {}
    for tree in {r[0] for r in rows}:
        nodes = {r[1]: r for r in rows if r[0] == tree}
        inner, ranked = {r[2] for r in nodes.values()}, []
        for leaf in nodes.keys() - inner:
            path = [leaf]
            while nodes[path[-1]][2] in nodes:
                path.append(nodes[path[-1]][2])
            ranked.append((-sum(nodes[n][3] for n in path), leaf, path[::-1]))
        for rank, (_, leaf, path) in enumerate(sorted(ranked)[:keep], 1):
            out[tree, rank] = (leaf, path)
    return out


def test_op2_random_trees(spark):
    rng = random.Random(6)
    rows = [(None if t == 5 else t - 1, n, rng.choice([None, 99, *range(max(1, n - 6), n)]) if n > 1 else None, rng.randint(0, 3) / 4) for t in range(6) for n in range(1, rng.randint(2, 40))]
    rows += [(7, n, n - 1, 0.0) for n in range(1, 70)]
    repeated = [(t, n, p, "user", f"{n}", s) for t, n, p, s in rows] + [(t, n, p, "user", f"{n}", s) for t, n, p, s in rows[::3]] + [(3, None, 1, "user", "lost", 9.0)]
    df = spark.createDataFrame(repeated, "tree long, node long, parent long, role string, text string, score double").repartition(4)
    got = {(r.tree, r["rank"]): (r.leaf, [int(t) for _, t in chat.parse_turns(r.formatted)]) for r in chat.format_trees(df, keep=3).collect()}
    assert got == brute_paths(rows, 3)


def test_op3(spark):
    urls = ["https://Example.org/es/a", "http://www.example.org/en/1?x", "http://notexample.org/es/", "http://a.com/fr/b", "http://com/de/", "http://b.com/x", "nothing", None, "x://", "http://EXAMPLE.org?q", "http://a.com/de/#f", "http://org.", "ftp://u@b.org:8/z", "http://a.com/fr/b"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "active", "best", "key")})
    got = table(url_filter.judge_urls(pages, spark.createDataFrame(url_filter.RULES, "host string, path string, action string")), "page_id")
    for i, u in enumerate(urls):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: (len(r[0]), len(r[1])), default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, best and best[0] + best[1], best[2] if best else "allow")
    nothing = url_filter.judge_urls(pages.limit(0), spark.createDataFrame([], "host string, path string, action string"))
    assert nothing.count() == 0


def brute_hits(text, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    w, hit, found = split(text), set(), set()
    for item, t in items:
        b = split(t)
        for i in range(max(1, len(b) - window + 1) if b else 0):
            win = b[i : i + window]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_bytes", [1 << 24, 60])
def test_op4(spark, docs, block_bytes):
    t = texts()
    items = [(1, t[5]), (2, "Zeta, gämma"), (10, None), (11, ""), (12, t[20][:90]), (12, "ALPHA  beta-GÄMMA"), (13, "never there")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = table(decontam.contaminated_spans(docs, bench, block_bytes=block_bytes).mapInArrow(decontam._report, decontam._REPORT_TYPE))
    for i, x in enumerate(t):
        assert tuple(got[i].values())[1:-2] == brute_hits(x, items), i
        assert (got[i]["longest_at"] is None) == (got[i]["longest_match"] == 0)
    assert {r.doc_id for r in decontam.clean_documents(docs, bench).collect()} == {i for i in got if not got[i]["contaminated"]}
    assert decontam.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


def brute_components(rows):
    fp = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        grams = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    parent = {i: i for i in fp}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in fp:
        for b in fp:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (fp[i], root(i)) for i in fp}


def test_op5(docs):
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == brute_components(list(enumerate(texts())))
    kept = {r.doc_id for r in simhash.one_of_each_group(docs).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}


@pytest.mark.parametrize("hot", [4096, 20, 2])  # 20 and 2 leave buckets crowded after both sets of masks, which parts then share
def test_op5_links_of_crowded_buckets(spark, hot):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {x for b in base for x in (b, b ^ 1, b ^ 7 << 20, b ^ 1 << 63)} | {sum(1 << k for k in rng.sample(range(64), 3)) for _ in range(100)}
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    edges = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.links(df, hot=hot).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)

    def groups(pairs):
        parent = {x: x for x in fps}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[root(a)] = root(b)
        out = defaultdict(set)
        for x in fps:
            out[root(x)].add(x)
        return sorted(map(sorted, out.values()))

    assert groups(edges) == groups([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3])


def test_op6(spark, docs):
    pages, store = media.document_media(docs)
    rows = table(media.resolve(media.elements(pages).filter("kind = 'media'"), media.described(store)), "page_id")
    for i, t in enumerate(texts()):
        b = (t or "").encode()
        payload = b.ljust(max(1, -(-len(b) // 192)) * 192, b" ")
        r = rows[i]
        assert (r["caption"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (f"{len(b)} bytes", len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert media.decode_png(media.encode_png(payload)) == payload


def test_op6_sequences(spark):
    html = '<p>One <b>two</b></p><script>no</script><img src="sha256:%s" alt="first"><figure><img src="u"><figcaption>cap</figcaption></figure>tail' % ("0" * 64)
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    store = spark.createDataFrame([("0" * 64, 5), ("0" * 64, 5)], "digest string, size int")
    (row,) = media.sequences(media.resolve(media.elements(pages), store)).collect()
    assert [(e.kind, e.text, e.ref, e.caption, e["size"]) for e in row.sequence] == [("text", "One two", None, None, None), ("media", None, "sha256:" + "0" * 64, "first", 5), ("media", None, "u", "cap", None), ("text", "tail", None, None, None)]


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_pii(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum((d * 2 - 9 if d > 4 else d * 2) if k % 2 else d for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


PRIVATE = [None, "", "no data", "mail a.b@c-d.org, x@y and z@w.co.uk@v.io", "ip 10.0.0.255 1.2.3.4.5 999.1.1.1 01.02.003.4", "card 4111 1111 1111 1111 or 4111-1111-1111-1112 0000000000000", "call +49 (0)30 1234-5678 or +1 5 +123456789012345678", "字4111111111111111字a@b.c", "@@a@b.c..d", "1.2.3.4@5.6.7.8 +4111111111111111", "a@b.c-d.e " * 500, "9" * 5000]


def test_op7_base(spark):
    df = spark.createDataFrame(list(enumerate(PRIVATE)), EMPTY)
    got = table(pii.report(df, pii.find_spans(df)))
    for i, t in enumerate(PRIVATE):
        want = brute_pii(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (i, t, want, got[i])
        assert set(want) <= set(got[i]["spans"].split(","))
        assert [got[i][f"n_{k}"] for k in BASE] == [Counter(w.split(":")[0] for w in want)[k] for k in BASE]


def test_op7_discovers_and_masks(spark):
    rows = [(i, f"please mail user{i}@site.org today") for i in range(30)] + [(100, "please mail user77(at)site9 now"), (101, "mail agent47x")]
    df = spark.createDataFrame(rows, EMPTY).withColumn("marks", F.lit(0)).withColumn("of_id", F.lit(0))
    spans = pii.find_spans(df.select("doc_id", "text"))
    assert {(r.doc_id, r.kind) for r in spans.filter("not base").collect()} >= {(101, "email")}
    assert table(pii.masked(df, spans))[3]["text"] == "please mail [EMAIL] today"


def reference_ids(name, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary(name))
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_op8(spark, docs):
    path = table_path(spark, "test-tokens")
    token_file.write_token_file(docs, tokens.vocabulary("word_bpe_49k.json"), path)
    got, start = table(token_file.read_documents(spark, path)), 0
    for i, t in enumerate(texts()):
        ids = reference_ids("word_bpe_49k.json", t)
        assert got[i]["start"] == start and np.frombuffer(got[i]["ids"], "<u4").tolist() == ids
        start += len(ids)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_op8_blocks(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.05, rng.integers(0, 2**32, n), rng.integers(0, 300, n)).astype(np.uint32)
    assert (token_file.unpack(token_file.pack(ids)) == ids).all()


def test_tokens_equal_the_library():
    rng = random.Random(2)
    parts = ["a", "B", " ", "  ", "\n", "\t", "'s", "12", "é", "ß", "　", "<|endoftext|>", "_", ".", "…", "字", "\x00", "\xa0", "'ll", " \n"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        enc = tokens.encoder(tokens.vocabulary(name))
        for _ in range(300):
            t = "".join(rng.choices(parts, k=rng.randint(0, 25)))
            assert np.frombuffer(enc.encode(t), "<u4").tolist() == reference_ids(name, t)[:-1]


def test_unknown_tokenizers_are_left_to_the_library(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    own = Tokenizer(models.WordLevel({"a": 0, "b": 1, "-": 2, "?": 3}, unk_token="?"))
    own.pre_tokenizer = pre_tokenizers.Whitespace()
    own.save(str(tmp_path / "own.json"))
    enc = tokens.encoder(str(tmp_path / "own.json"))
    assert not enc.known and all(tokens.encoder(tokens.vocabulary(n)).known for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    assert np.frombuffer(enc.encode("a b-a  c"), "<u4").tolist() == [0, 1, 2, 0, 3]


def test_op6_op8_op10_repeated_and_null_ids(spark):
    rows = [(1, "same"), (1, "same"), (1, "other one"), (None, "x"), (None, "x"), (None, None)]
    d, name = spark.createDataFrame(rows, EMPTY).repartition(2), "word_bpe_49k.json"
    path = table_path(spark, "test-repeats")
    token_file.write_token_file(d, tokens.vocabulary(name), path)
    got = token_file.read_documents(spark, path).collect()
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == sorted((str(i), np.array(reference_ids(name, t), "<u4").tobytes()) for i, t in rows)
    spans = sorted((r.start, len(r.ids) // 4) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
    pieces = packing.pack_documents(d, tokens.vocabulary(name), with_ids=True).collect()
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in pieces) == sorted((str(i), np.array(reference_ids(name, t), "<u4").tobytes()) for i, t in rows)
    pages, store = media.document_media(d)
    shown = media.resolve(media.elements(pages).filter("kind = 'media'"), media.described(store)).collect()
    assert sorted((str(r.page_id), r.caption) for r in shown) == sorted((str(i), f"{len(t or '')} bytes") for i, t in rows)
    for r in shown:
        stored = media.encode_png((rows[[x[0] for x in rows].index(r.page_id)][1] or "").encode().ljust(192)) if r.caption == "4 bytes" else None
        assert stored is None or (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), media.feature(media.decode_png(stored)))


def test_op9_held_out(spark):
    """A constant classifier has a recall or a share of clean documents kept of 0, and an area under the curve of one half."""
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels)).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    truth = [(r.toxic, got[r.doc_id]) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out and r.toxic is not None]
    toxic, clean = ([r for y, r in truth if y == k] for k in (1, 0))
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    assert np.mean([[(t.score > c.score) + (t.score == c.score) / 2 for c in clean] for t in toxic]) >= 0.95


def test_op9_repeated_rows_and_nulls(spark):
    d = spark.createDataFrame([(1, "you idiot"), (1, "you idiot"), (None, "you idiot"), (2, None), (2, ""), (3, "x " * 70_000)], EMPTY)
    rows = toxicity.score_toxicity(d, pickle.dumps(toxicity.Model())).collect()
    assert len(rows) == 6 and len({r.score for r in rows if r.doc_id in (1, None)}) == 1 and len({r.score for r in rows if r.doc_id == 2}) == 1
    assert [r.held_out for r in rows if r.doc_id is None] == [None]


def test_op9_edge(spark, docs):
    none = toxicity.fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert len({r.score for r in toxicity.score_toxicity(docs, none).filter("doc_id in (0, 1, 2)").collect()}) == 1
    assert toxicity.without_toxic(docs, spark.createDataFrame([(1, None), (3, 0)], "doc_id long, toxic int")).columns == docs.columns


def test_op10(docs):
    name = "byte_bpe_50k.json"
    rows = packing.pack_documents(docs, tokens.vocabulary(name), with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for i, t in enumerate(texts()):
        ids, pieces = reference_ids(name, t), sorted(by_doc[i], key=lambda r: r.start)
        assert np.frombuffer(b"".join(bytes(r.ids) for r in pieces), "<u4").tolist() == ids
        assert all(r.doc_tokens == len(ids) for r in pieces) and [r.start for r in pieces] == list(np.cumsum([0] + [r.length for r in pieces])[:-1])
    for s in by_sequence.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_tables(spark):
    d, vocabulary = spark.createDataFrame([], SCHEMA), tokens.vocabulary("byte_bpe_50k.json")
    bench, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    path = table_path(spark, "test-empty")
    token_file.write_token_file(d, vocabulary, path)
    for out in (suffix_dedup.deduplicate(d), decontam.contamination(d, bench), decontam.clean_documents(d, bench), simhash.near_duplicates(d), simhash.one_of_each_group(d), pii.report(d, pii.find_spans(d)), pii.masked(d, pii.find_spans(d)), token_file.read_documents(spark, path), packing.pack_documents(d, vocabulary), toxicity.without_toxic(d, labels), chat.format_trees(chat.linear_nodes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))):
        assert out.count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(map(tuple, QUERIES[name](spark, SMALL).select(*names).collect()), key=repr) == sorted(cur.fetchall(), key=repr)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        kept = out.count()
        assert 0.3 * docs.count() < kept <= docs.count(), name
        path = table_path(spark, f"test-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert {r.doc_id for r in docs.collect()} <= set(seen)
    last = corpus_pipeline.run(spark, SMALL).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    rows = last.collect()
    assert rows and all(r.n == r.t for r in rows)
    assert "pipeline" in __spark_entry__.queries()
