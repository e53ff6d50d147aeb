"""Contextual extraction against a plain version of its scoring, and its precision and recall on planted identifiers."""

import math
import random
import re
from collections import defaultdict

from yesterlog.llm import pii

from .test_operators import BASE, EMPTY, PRIVATE, brute_pii

TOKEN = r"[A-Za-z@._%+/()-]*[0-9][A-Za-z0-9@._%+/()-]*"


def luhn(digits):
    return sum((d * 2 - 9 if d > 4 else d * 2) if k % 2 else d for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def kinds_of(s):
    digits = re.sub("[^0-9]", "", s)
    out = ["email"]
    if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", s) and all(int(p) <= 255 for p in s.split(".")):
        out.append("ip")
    if re.fullmatch(r"[0-9]([ -]?[0-9])+", s) and 12 <= len(digits) <= 19 and luhn(digits):
        out.append("card")
    return out + ["phone"] * (9 <= len(digits) <= 15)


def shape(s):
    s = re.sub("[A-Z]+", "A", re.sub("[a-z]+", "a", s))
    return re.sub("[0-9]", "#", re.sub("(?<![0-9])[0-9]{1,3}(?![0-9])", "n", s))


def last_word(gap):
    m = re.search(r"(\S{1,24})\s*$", gap[-pii.CONTEXT_CHARS :].lower())
    return m[1] if m else ""


def first_word(gap):
    m = re.match(r"\s*(\S{1,24})", gap[: pii.CONTEXT_CHARS].lower())
    return m[1] if m else ""


def beside(text, spans):
    """Each span with the words beside it, looked for up to the neighbouring span."""
    for k, (a, b) in enumerate(spans):
        yield a, b, last_word(text[spans[k - 1][1] if k else 0 : a]), first_word(text[b : spans[k + 1][0] if k + 1 < len(spans) else len(text)])


def occurrences(text):
    base, out = [], []
    valid = set(brute_pii(text))
    for kind, pattern in BASE.items():
        spans = [m.span() for m in re.finditer(pattern, text)]
        for a, b, before, after in beside(text, spans):
            if f"{kind}:{a}:{b}" in valid:
                base.append((a, b))
                out.append((kind, a, b, before, after))
    runs = [m.span() for m in re.finditer(rf"(?<![A-Za-z0-9@._%+/()-]){TOKEN}(?: {TOKEN})*", text)]
    for a, b, before, after in beside(text, runs):
        tokens = text[a:b].split(" ")
        at = a
        for i, token in enumerate(tokens):
            for k in range(1, pii.GRAM + 1):
                if i + k <= len(tokens):
                    s = re.sub("[^A-Za-z0-9)]+$", "", " ".join(tokens[i : i + k]))
                    if pii.CANDIDATE_LENGTH <= len(s) <= pii.CANDIDATE_MOST and not any(x < at + len(s) and at < y for x, y in base):
                        out.append((None, at, at + len(s), tokens[i - 1].lower() if i else before, tokens[i + k].lower() if i + k < len(tokens) else after))
            at += len(token) + 1
    return out


def brute_discovered(texts, rounds=pii.ROUNDS):
    """The discovered (document, kind, start, stop)."""
    every = [(d, *o) for d, t in enumerate(texts) for o in occurrences(t or "")]
    seeds, edges, known = defaultdict(set), defaultdict(set), defaultdict(set)
    for d, kind, a, b, before, after in every:
        if kind:
            known[texts[d][a:b].lower()].add(kind)
    for d, kind, a, b, before, after in every:
        s = texts[d][a:b]
        marks = [m + w for m, w in (("b:", before), ("a:", after), ("s:", shape(s))) if w]
        for p in marks:
            if kind:
                seeds[p, kind].add(s.lower())
            elif s.lower() not in known:
                for k in kinds_of(s):
                    edges[p, k].add(s.lower())
    size = {pk: sum(len(seeds[pk[0], k]) for k in BASE if (pk[0], k) in seeds) + len(edges.get(pk, ())) for pk in set(seeds) | set(edges)}
    confidence = {pk: len(v) / size[pk] for pk, v in seeds.items() if len(v) >= pii.MIN_SEEDS}
    score, best = {}, {}
    for _ in range(rounds):
        miss = defaultdict(list)
        for pk, instances in edges.items():
            if pk in confidence:
                for s in instances:
                    miss[s, pk[1]].append(confidence[pk])
        score = {sk: round(1 - math.exp(sum(math.log(1 - min(c, 0.999)) for c in cs)), 6) for sk, cs in miss.items()}
        best = {sk: max(cs) for sk, cs in miss.items()}
        confidence = {}
        for pk in size:
            mine = [s for s in edges.get(pk, ()) if (s, pk[1]) in score and not pk[0].startswith("s:")]
            n = len(seeds.get(pk, ()))
            if n + sum(best[s, pk[1]] >= pii.ACCEPT for s in mine) >= pii.MIN_SEEDS:
                confidence[pk] = min(1.0, (n + sum(score[s, pk[1]] for s in mine)) / size[pk])
    final = defaultdict(list)
    for (s, k), v in score.items():
        if v >= pii.ACCEPT and any(s in edges[pk] for pk in confidence if pk[1] == k and confidence[pk] >= pii.ACCEPT and pk in edges):
            final[s].append((v, k))
    for s, kinds in known.items():
        final[s] += [(2.0, k) for k in kinds]
    out = set()
    for d in range(len(texts)):
        found = sorted({(a, b) for e, kind, a, b, *_ in every if e == d and not kind and texts[d][a:b].lower() in final}, key=lambda x: (x[0], -x[1]))
        reach = -1
        for a, b in found:
            if reach < b:
                out.add((d, max(final[texts[d][a:b].lower()])[1], a, b))
            reach = max(reach, b)
    return out


def planted(rng):
    """Texts and the (document, kind, start, stop) of identifiers that no base pattern gives; decoys look alike."""
    words = ["the", "of", "lorem", "ipsum", "dolor", "amet", "so", "und", "der"]
    fill = lambda n: " ".join(rng.choices(words, k=n))

    def card(ok=True):
        while True:
            s = "".join(rng.choices("0123456789", k=16))
            if luhn(s) == ok:
                return s

    phone = lambda: f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
    texts, truth = [], set()

    def add(*parts):
        text = ""
        for p in parts:
            if isinstance(p, tuple):
                truth.add((len(texts), p[0], len(text), len(text) + len(p[1])))
                p = p[1]
            text += p
        texts.append(text)

    for i in range(120):
        add(fill(5) + " ", phone(), " " + fill(3) + " ", card(), " " + fill(2))
        add(fill(4) + f" write to person{i}@example.org " + fill(2))
        add(fill(6) + f" version {i}.{i + 1} of " + card(False) + " and item" + str(i) + "x " + fill(3))
    for i in range(12):
        add(fill(3) + " ", ("card", card()), " ", ("card", card()), " " + fill(2))
        add(fill(3) + " ", ("phone", phone()), f" 10.0.{i}.7 ", fill(2))
        add(fill(3) + " write to ", ("email", f"someone{i}(at)example"), " " + fill(2))
    return texts, truth


def discovered(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), EMPTY).repartition(3)
    return {(r.doc_id, r.kind, r.start, r.stop) for r in pii.find_spans(docs).filter("not base").collect()}


def test_planted_identifiers(spark):
    texts, truth = planted(random.Random(4))
    got = discovered(spark, texts)
    assert got == brute_discovered(texts)
    assert len(got & truth) >= 0.95 * len(truth) and len(got & truth) >= 0.95 * len(got)


def test_documents_and_odd_texts(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("text").collect()]
    texts += PRIVATE + ["1 " * 500, "(1) 2) 3. 4 5", "4111 1111 1111 1111 5", "a1b2c a1b2c"]
    got = discovered(spark, texts)
    assert got == brute_discovered(texts)
    assert got
