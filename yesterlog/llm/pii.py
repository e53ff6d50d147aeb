"""Personal data: base patterns and bootstrapped contextual extraction, in DataFrame functions only.

Base spans (email, ip, card, phone) are seeds. Candidates are the sequences of one to GRAM tokens with a digit each that overlap
no base span: identifiers of other forms, and those that a base match swallowed together with its neighbour and then lost.
A lexical pattern is the word before an instance, the word after it, or its shape (letters and digits replaced by classes). The words
are looked for in the CONTEXT_CHARS characters on either side; of a word before the last 24 characters count, of one after the first
24, so a pattern's length is bounded while no instance is left out. An
instance of a kind must pass the kind's own check, so a number that fails Luhn is never a card.

The bipartite graph of patterns and instances is scored in ROUNDS rounds, for each kind: a pattern's confidence is the mean score
of the distinct instances it stands at (seeds of its kind 1, of other kinds 0), an instance's score the noisy-or of its patterns.
A word is a pattern of a kind once it stands at MIN_SEEDS distinct instances of it, seeds or discovered ones (at which a pattern
of at least ACCEPT stands), so each round's discoveries make patterns for the next; a shape is one through seeds alone. Candidates
of at least ACCEPT, at which such a pattern stands somewhere, and those equal to a seed, become spans of the kind wherever they
occur, except inside a longer span that was also discovered.

Positions are code points: the text is split at the matches, and a window sums the lengths of what comes before each. The
expressions never back-track over a run, so long runs cost linear time, and texts without a digit or "@" are left at the scan.

Defined results: null text is empty and has no spans; rows that repeat a doc_id and text have the same values; rows with one
doc_id and different texts are kept apart by a hash of the text; an empty table gives an empty result. An instance that two kinds
accept is of the one with the better score, then the later name. Candidates have CANDIDATE_LENGTH to CANDIDATE_MOST characters.
Base spans may overlap if their kinds differ; a discovered span never overlaps a base one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, load

KINDS = ["email", "ip", "card", "phone"]
#: Possessive and anchored forms of the base patterns, with the same leftmost matches.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?=[0-9][\x20-]?[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "run": r"(?<![A-Za-z0-9@._%+/()-])(?=[A-Za-z@._%+/()-]*+[0-9])[A-Za-z0-9@._%+/()-]++(?: (?=[A-Za-z@._%+/()-]*+[0-9])[A-Za-z0-9@._%+/()-]++)*+",
}
CANDIDATE_LENGTH, CANDIDATE_MOST, GRAM, CONTEXT_CHARS, MIN_SEEDS, ACCEPT, ROUNDS = 5, 254, 3, 40, 5, 0.8, 3


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn check."""
    n = F.length(digits)
    places = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(places, F.lit(0), lambda total, d: total + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def is_valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    count = F.length(digits)
    part = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
    small = lambda p: F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255
    ip = F.forall(F.split(match, r"\."), lambda p: part(p) & small(p))
    return F.when(kind == "ip", ip).when(kind == "card", F.when(count.between(12, 19), luhn(digits)).otherwise(False)).when(kind == "phone", count.between(9, 15)).otherwise(True)


def kinds_of(candidate: Column) -> Column:
    """The kinds whose own check a candidate passes: any string may be an address, the others need their digits."""
    digits = F.length(F.regexp_replace(candidate, "[^0-9]", ""))
    quad, number = candidate.rlike(r"^[0-9]++(?:\.[0-9]++){3}$"), candidate.rlike(r"^[0-9](?:[\x20-]?[0-9])++$")
    fits = {"email": F.lit(True), "ip": quad, "card": number & digits.between(12, 19), "phone": digits.between(9, 15)}
    return F.filter(F.array(*[F.when(fits[k] & is_valid(F.lit(k), candidate), F.lit(k)) for k in KINDS]), lambda k: k.isNotNull())


def shape(match: Column) -> Column:
    """Runs of letters become a or A, runs of up to three digits n, each digit of a longer run #."""
    for pattern, by in (("[a-z]+", "a"), ("[A-Z]+", "A"), ("(?<![0-9])[0-9]{1,3}(?![0-9])", "n"), ("[0-9]", "#")):
        match = F.regexp_replace(match, pattern, by)
    return match


def _matches(docs: DataFrame) -> DataFrame:
    """doc_id, h, kind, match, before, after (the words beside it), start, stop for each match of each pattern."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64("text"))
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.split("text", p, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("matches")) for k, p in PATTERNS.items()])
    each = own.select("doc_id", "h", F.explode(found).alias("f")).filter(F.size("f.matches") > 0)
    n = F.size("f.matches")
    each = each.select("doc_id", "h", "f.kind", F.posexplode(F.arrays_zip(F.slice("f.gaps", 1, n).alias("gap"), F.slice("f.gaps", 2, n).alias("next"), F.col("f.matches").alias("match"))).alias("at", "m"))
    before = F.regexp_extract(F.lower(F.substring("m.gap", -CONTEXT_CHARS, CONTEXT_CHARS)), r"([^\s]{1,24})\s*$", 1)
    after = F.regexp_extract(F.lower(F.substring("m.next", 1, CONTEXT_CHARS)), r"^\s*([^\s]{1,24})", 1)
    each = each.select("doc_id", "h", "kind", "at", F.char_length("m.gap").alias("gap"), before.alias("before"), after.alias("after"), "m.match").distinct()
    w = Window.partitionBy("doc_id", "h", "kind").orderBy("at")
    stop = F.sum(F.col("gap") + F.char_length("match")).over(w).cast("long")
    return each.withColumn("stop", stop).select("doc_id", "h", "kind", "match", "before", "after", (F.col("stop") - F.char_length("match")).alias("start"), "stop")


def _candidates(runs: DataFrame) -> DataFrame:
    """The sequences of 1 to GRAM tokens of each run, with the columns of `_matches`."""
    tokens = runs.select("doc_id", "h", "before", "after", F.col("start").alias("run"), F.posexplode(F.split("match", " ")).alias("i", "token"))
    w = Window.partitionBy("doc_id", "h", "run").orderBy("i")
    place = F.col("run") + F.coalesce(F.sum(F.char_length("token") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tokens = tokens.select("doc_id", "h", place.alias("start"), F.coalesce(F.lag(F.lower("token")).over(w), F.col("before")).alias("before"), "after", *[F.lead("token", k).over(w).alias(f"t{k}") for k in range(GRAM + 1)])
    grams = []
    for k in range(1, GRAM + 1):
        text = reduce(lambda a, b: F.concat(a, F.lit(" "), b), [F.col(f"t{i}") for i in range(k)])
        grams.append(F.struct(F.regexp_replace(text, "[^A-Za-z0-9)]++$", "").alias("match"), F.coalesce(F.lower(f"t{k}"), F.col("after")).alias("after")))
    each = tokens.select("doc_id", "h", "start", "before", F.explode(F.array(*grams)).alias("g")).filter(F.char_length("g.match").between(CANDIDATE_LENGTH, CANDIDATE_MOST))
    return each.select("doc_id", "h", F.lit("candidate").alias("kind"), "g.match", "before", "g.after", "start", (F.col("start") + F.char_length("g.match")).alias("stop"))


def find_spans(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, h (hash of the text), kind, start, stop, base (whether a base pattern's)."""
    every = cut(_matches(docs).filter(is_valid(F.col("kind"), F.col("match"))), "pii-matches")
    every = every.filter("kind <> 'run'").unionByName(_candidates(every.filter("kind = 'run'")))
    base = F.col("kind") != "candidate"
    near = Window.partitionBy("doc_id", "h").orderBy("start")
    earlier = F.max(F.when(base, F.col("stop"))).over(near.rangeBetween(Window.unboundedPreceding, 0))
    later = F.min(F.when(base, F.col("start"))).over(near.rangeBetween(0, Window.unboundedFollowing))
    overlaps = ~base & (F.coalesce(earlier > F.col("start"), F.lit(False)) | F.coalesce(later < F.col("stop"), F.lit(False)))
    kept = every.withColumn("overlaps", overlaps).filter("not overlaps")
    patterns = F.filter(F.array(*[F.when(F.col(c) != "", F.concat(F.lit(mark), F.col(c))) for mark, c in (("b:", "before"), ("a:", "after"), ("s:", "shape"))]), lambda p: p.isNotNull())
    as_kinds = F.when(base, F.array("kind")).otherwise(kinds_of(F.col("match")))
    seen = cut(kept.withColumn("shape", shape(F.col("match"))).select("doc_id", "h", base.alias("base"), as_kinds.alias("kinds"), "start", "stop", patterns.alias("patterns"), F.lower("match").alias("instance")), "pii-spans")
    edges = seen.select("base", "instance", F.explode("kinds").alias("kind"), "patterns").select("base", "instance", "kind", F.explode("patterns").alias("pattern")).distinct()
    accepted = _bootstrap(edges, rounds)
    found = seen.filter("not base").join(accepted, "instance").select("doc_id", "h", "kind", "start", "stop")
    reach = F.max("stop").over(Window.partitionBy("doc_id", "h").orderBy("start", F.col("stop").desc()).rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("inside", F.coalesce(reach >= F.col("stop"), F.lit(False))).filter("not inside").select("doc_id", "h", "kind", "start", "stop", F.lit(False).alias("base"))
    return seen.filter("base").select("doc_id", "h", F.get("kinds", F.lit(0)).alias("kind"), "start", "stop", "base").unionByName(found)


def _bootstrap(edges: DataFrame, rounds: int) -> DataFrame:
    """edges: base, instance, kind, pattern, distinct. Returns the instance, kind of accepted candidates."""
    edges = cut(edges, "pii-graph")
    known = edges.filter("base").select("instance", "kind").distinct()
    candidates = cut(edges.filter("not base").select("pattern", "instance", "kind").join(known.select("instance").distinct(), "instance", "left_anti"), "pii-candidates")
    seeds = cut(edges.filter("base").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds")), "pii-seeds")
    open_ = candidates.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("open"))
    all_seeds = seeds.groupBy("pattern").agg(F.sum("seeds").alias("all_seeds"))
    # what a pattern stands at, for each kind: the seeds of every kind, and the candidates that pass the kind's check
    size = seeds.select("pattern", "kind").unionByName(open_.select("pattern", "kind")).distinct().join(all_seeds, "pattern", "left").join(open_, ["pattern", "kind"], "left")
    size = cut(size.select("pattern", "kind", (F.coalesce("all_seeds", F.lit(0)) + F.coalesce("open", F.lit(0))).alias("size")), "pii-sizes")
    patterns = cut(seeds.filter(F.col("seeds") >= MIN_SEEDS).join(size, ["pattern", "kind"]).select("pattern", "kind", (F.col("seeds") / F.col("size")).alias("confidence")), "pii-patterns0")
    words = candidates.filter(~F.startswith("pattern", F.lit("s:")))
    for k in range(1, rounds + 1):
        miss = F.sum(F.log(1 - F.least("confidence", F.lit(0.999))))  # rounded, since sums of doubles depend on their order
        scores = cut(candidates.join(patterns, ["pattern", "kind"]).groupBy("instance", "kind").agg(F.round(1 - F.exp(miss), 6).alias("score"), F.max("confidence").alias("best")), f"pii-scores{k}")
        gained = words.join(scores, ["instance", "kind"]).groupBy("pattern", "kind").agg(F.sum(F.col("score").cast("decimal(20,6)")).cast("double").alias("gained"), F.count(F.when(F.col("best") >= ACCEPT, 1)).alias("discovered"))
        both = seeds.join(gained, ["pattern", "kind"], "full").na.fill(0, ["seeds", "gained", "discovered"]).filter(F.col("seeds") + F.col("discovered") >= MIN_SEEDS)
        confidence = F.least(F.lit(1.0), (F.col("seeds") + F.col("gained")) / F.col("size"))
        patterns = cut(both.join(size, ["pattern", "kind"]).select("pattern", "kind", confidence.alias("confidence")), f"pii-patterns{k}")
    sure = candidates.join(patterns.filter(F.col("confidence") >= ACCEPT), ["pattern", "kind"], "left_semi").select("instance", "kind").distinct()
    good = scores.filter(F.col("score") >= ACCEPT).join(sure, ["instance", "kind"], "left_semi")
    both = good.select("instance", "kind", "score").unionByName(known.withColumn("score", F.lit(2.0)))
    return both.groupBy("instance").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))


def report(docs: DataFrame, spans: DataFrame) -> DataFrame:
    order = reduce(lambda w, k: w.when(F.col("kind") == k[1], k[0]), enumerate(KINDS), F.when(F.lit(False), -1))
    entry = F.struct("start", order.alias("rank"), F.concat_ws(":", "kind", "start", "stop").alias("span"))
    joined = lambda c: F.array_join(F.transform(F.sort_array(c), lambda x: x["span"]), ",")
    counts = [F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS]
    by_doc = spans.groupBy(F.col("doc_id").alias("of_id"), F.col("h").alias("of_h")).agg(*counts, joined(F.collect_list(F.when(F.col("base"), entry))).alias("base"), joined(F.collect_list(entry)).alias("spans"))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    out = rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("h") == F.col("of_h")), "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in KINDS], F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def masked(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets, overlapping spans by the first one's; n_chars follows if there is one."""
    near = Window.partitionBy("doc_id", "h").orderBy("start", "stop", "kind")
    reach = F.max("stop").over(near.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(near))
    islands = islands.groupBy("doc_id", "h", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by("kind", F.struct("start", "stop", "kind")).alias("kind"))
    lists = islands.groupBy(F.col("doc_id").alias("of_id"), F.col("h").alias("of_h")).agg(F.sort_array(F.collect_list(F.struct("start", "stop", "kind"))).alias("marks"))
    # a row is carried as one struct, so that no name of its columns can clash
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    both = rows.join(lists, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("h") == F.col("of_h")), "left")
    whole = F.col("row")["text"]
    cut_at = lambda i: F.when(i > 0, F.get("marks", i - 1)["stop"]).otherwise(F.lit(0))
    parts = F.transform("marks", lambda m, i: F.concat(F.substring(whole, (cut_at(i) + 1).cast("int"), (m["start"] - cut_at(i)).cast("int")), F.lit("["), F.upper(m["kind"]), F.lit("]")))
    tail = F.substring(whole, (F.element_at("marks", -1)["stop"] + 1).cast("int"), F.char_length(whole))
    marked = F.col("marks").isNotNull()
    row = F.col("row").withField("text", F.when(marked, F.concat(F.array_join(parts, ""), tail)).otherwise(whole))
    if "n_chars" in docs.columns:
        both = both.withColumn("row", row)
        row = F.col("row").withField("n_chars", F.when(marked, F.char_length(F.col("row")["text"]).cast("long")).otherwise(F.col("row")["n_chars"]))
    return both.select(row.alias("row")).select("row.*")


def op7_pii(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return report(docs, find_spans(docs))
