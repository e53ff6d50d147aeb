"""Toxicity: a convolutional text classifier with hashed word embeddings, filters of several widths and max pooling, in numpy.

A word's embedding is the sum of the rows of its own hash and of the hashes of its first PREFIXES letters. Filters of widths
1, 2 and 3 slide over the whole text, each keeps its maximum, and a linear layer gives the logit. Since everything before the
maximum is linear, the filters are multiplied into the embedding table once, and scoring a text is gathers, sums and maxima.

A maximum sees one window only, but one suspicious word is weak evidence and several are strong. So the buckets are dealt to
CHANNELS by the word's first letters, and training starts from filters that each look at one channel: the sum of their maxima
grows with the number of different suspicious words. Gradient descent then moves embeddings, filters and all else.

Training runs in one Spark task on at most SAMPLE labelled rows (a third toxic, the rest not, chosen by a hash of doc_id), however
large the input; a fifth of them calibrate: for each language a threshold on the logit, moved to score 0.5. The language is
guessed from the text's own function words; no column other than the text enters a score.

Defined results: null or empty texts have no words and get the score of an empty pool; rows repeat with their repeats; labels
that are null are not learned from; without any labelled row of one class every score is the same. Empty tables give empty
results. Ties at the threshold are toxic (score 0.5).
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, load, release

SAMPLE, BUCKETS, DIM, FILTERS, WIDTHS, PREFIXES, CHANNELS = 9000, 1 << 15, 12, 12, (1, 2, 3), (3, 4, 5), 8
BITS, VOTE_AT, SMOOTH = 15, 60, 0.5
EPOCHS, BATCH, RATE, STEPS = 3, 32, 0.03, 250
CHUNK_WORDS = 1 << 15
#: Common function words of each language, for guessing a text's language.
FUNCTION_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "was", "for"],
    "de": ["der", "die", "und", "das", "nicht", "ein", "ist", "mit", "von", "zu"],
    "fr": ["le", "la", "et", "les", "des", "une", "est", "dans", "pas", "qui"],
    "es": ["el", "que", "los", "y", "en", "las", "por", "con", "se", "una"],
}
LANGUAGES = ["other", *FUNCTION_WORDS]
_WORD = re.compile(r"[^\W_]+")
_VOTES = {w: k for k, lang in enumerate(LANGUAGES[1:], 1) for w in FUNCTION_WORDS[lang]}
_known: dict[str, int] = kept({})


def _number(word: str) -> int:
    """The three buckets, of one channel, and the language vote in one integer."""
    channel = crc32(word[: PREFIXES[0]].encode()) % CHANNELS
    out = _VOTES.get(word, 0) << VOTE_AT
    for k, part in enumerate((b"=" + word.encode(), *(b"%d^" % n + word[:n].encode() for n in PREFIXES))):
        out |= (crc32(part) % (BUCKETS // CHANNELS) * CHANNELS + channel) << BITS * k
    return out


def buckets(x: np.ndarray) -> list[np.ndarray]:
    return [x >> BITS * k & BUCKETS - 1 for k in range(1 + len(PREFIXES))]


def numbers(text: str) -> np.ndarray:
    words = _WORD.findall(text.lower())
    if len(_known) > 300_000:
        _known.clear()
    get, out = _known.get, []
    for w in words:
        n = get(w)
        if n is None:
            n = _known[w] = _number(w)
        out.append(n)
    return np.array(out, dtype=np.int64)


def language(x: np.ndarray) -> int:
    votes = np.bincount(x >> VOTE_AT, minlength=len(LANGUAGES))[1:]
    return int(votes.argmax()) + 1 if votes.any() else 0


class Model:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.embedding = (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)
        self.filters = [(rng.standard_normal((w, DIM, FILTERS)) * 0.2).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
        self.out = (rng.standard_normal(len(WIDTHS) * FILTERS) * 0.1).astype(np.float32)
        self.offset = np.float32(0)
        self.thresholds = np.zeros(len(LANGUAGES), dtype=np.float32)

    def table(self, buckets=slice(None)) -> np.ndarray:
        """What a bucket gives to each place of each filter: buckets x (sum of widths * FILTERS)."""
        return self.embedding[buckets] @ np.concatenate([f[j] for f in self.filters for j in range(len(f))], axis=1)

    def pool(self, x: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's maximum over the text and the word where that window starts (-1 without words)."""
        most, where = np.zeros(len(self.bias), dtype=np.float32), np.full(len(self.bias), -1)
        wide = max(WIDTHS)
        for i in range(0, len(x), CHUNK_WORDS):
            part = x[i : i + CHUNK_WORDS + wide - 1]
            rows = sum(table[b] for b in buckets(part))
            rows = np.concatenate([rows, np.zeros((wide - 1, rows.shape[1]), dtype=np.float32)])
            n, at = min(len(part), CHUNK_WORDS), 0
            for k, w in enumerate(WIDTHS):
                total = rows[:n, at : at + FILTERS].copy()
                for j in range(1, w):
                    total += rows[j : j + n, at + j * FILTERS : at + (j + 1) * FILTERS]
                at += w * FILTERS
                top = total.argmax(axis=0)
                value, own = total[top, np.arange(FILTERS)], slice(k * FILTERS, (k + 1) * FILTERS)
                better = (value > most[own]) | (where[own] < 0)
                most[own] = np.where(better, value, most[own])
                where[own] = np.where(better, top + i, where[own])
        return most, where

    def logit(self, x: np.ndarray, table: np.ndarray) -> float:
        pooled, _ = self.pool(x, table)
        return float(np.maximum(pooled + self.bias, 0) @ self.out + self.offset)

    def score(self, x: np.ndarray, table: np.ndarray) -> float:
        z = self.logit(x, table) - float(self.thresholds[language(x)])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(texts: list[np.ndarray], labels: np.ndarray, seed: int = 0) -> Model:
    """Stochastic gradient descent with per-parameter step sizes on the log loss; gradients reach only the windows that won their pool."""
    model, rng = Model(seed), np.random.default_rng(seed)
    if not texts or labels.min() == labels.max():
        return model
    held = np.arange(len(texts)) % 5 == 0
    fit = np.flatnonzero(~held)
    seen = np.full((2, BUCKETS), SMOOTH)
    for i in fit:
        seen[labels[i], np.unique(np.concatenate(buckets(texts[i])))] += 1
    odds = np.log(seen[1] / (labels[fit] == 1).sum()) - np.log(seen[0] / (labels[fit] == 0).sum())
    # start from how much likelier a bucket is in toxic texts, each channel in a dimension and a filter of its own
    model.embedding[:, :CHANNELS] = 0
    model.embedding[np.arange(BUCKETS), np.arange(BUCKETS) % CHANNELS] = np.maximum(odds, 0) / 3
    model.filters[0][0][:CHANNELS, :CHANNELS] = np.eye(CHANNELS)
    model.out[:CHANNELS] = 1
    model.bias[:CHANNELS] = -1
    model.offset = np.float32(-2)
    squares = {k: np.full_like(v, 1e-6) for k, v in (("e", model.embedding), ("b", model.bias), ("o", model.out))} | {f"f{k}": np.full_like(f, 1e-6) for k, f in enumerate(model.filters)}
    offset_square = 1e-6

    def step(name, value, at, grad):
        squares[name][at] += grad**2
        value[at] -= RATE * grad / np.sqrt(squares[name][at])

    n_parts = 1 + len(PREFIXES)
    for _ in range(max(EPOCHS, min(4 * EPOCHS, STEPS * BATCH // max(1, len(fit))))):
        order = rng.permutation(fit)
        for i in range(0, len(order), BATCH):
            batch = order[i : i + BATCH]
            # only the rows of the table that the batch needs
            used, compact = np.unique(np.concatenate([part for d in batch for part in buckets(texts[d])]), return_inverse=True)
            table, at = model.table(used), 0
            gf, gb, go, g0 = [np.zeros_like(f) for f in model.filters], np.zeros_like(model.bias), np.zeros_like(model.out), 0.0
            ge, n = np.zeros((len(used), DIM), dtype=np.float32), len(batch)
            for d in batch:
                length = len(texts[d])
                parts = compact[at : at + n_parts * length].reshape(n_parts, length)
                at += n_parts * length
                pooled, where = model.pool(sum(p << BITS * k for k, p in enumerate(parts)), table)
                active = np.maximum(pooled + model.bias, 0)
                err = 1 / (1 + np.exp(-np.clip(active @ model.out + model.offset, -30, 30))) - labels[d]
                go += err * active
                g0 += err
                back = np.where(active > 0, err * model.out, 0).astype(np.float32)
                gb += back
                for k, w in enumerate(WIDTHS):
                    own = slice(k * FILTERS, (k + 1) * FILTERS)
                    for j in range(w):
                        f = np.flatnonzero((back[own] != 0) & (where[own] >= 0) & (where[own] + j < length))
                        rows, g = parts[:, where[own][f] + j], back[own][f][:, None]
                        gf[k][j][:, f] += (g * model.embedding[used[rows]].sum(axis=0)).T
                        g = g * model.filters[k][j][:, f].T
                        for row in rows:
                            np.add.at(ge, row, g)
            for k, g in enumerate(gf):
                step(f"f{k}", model.filters[k], ..., g / n)
            step("b", model.bias, ..., gb / n)
            step("o", model.out, ..., go / n)
            offset_square += (g0 / n) ** 2
            model.offset = np.float32(model.offset - RATE * (g0 / n) / np.sqrt(offset_square))
            moved = np.flatnonzero(ge.any(axis=1))
            step("e", model.embedding, used[moved], ge[moved] / n)
    _calibrate(model, [texts[i] for i in np.flatnonzero(held)], labels[held])
    return model


def _calibrate(model: Model, texts: list[np.ndarray], labels: np.ndarray, missed: float = 2.0) -> None:
    """For each language the logit, between two neighbouring ones, with the least weighted error; a miss counts `missed` times a false alarm.

    Of equally good thresholds the middle of the widest gap counts. Languages with under 20 texts take the threshold of all.
    """
    table = model.table()
    z, langs = np.array([model.logit(x, table) for x in texts]), np.array([language(x) for x in texts])

    def best(z, y):
        order = np.argsort(z)
        z, y = z[order], y[order]
        cuts = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
        gaps = np.concatenate([[0], z[1:] - z[:-1], [0]])
        errors = np.concatenate([[0], missed * np.cumsum(y == 1)]) + np.concatenate([np.cumsum((y == 0)[::-1])[::-1], [0]])
        return cuts[np.lexsort((-gaps, errors))[0]]

    if len(z) and labels.min() != labels.max():
        model.thresholds[:] = best(z, labels)
        for k in range(len(LANGUAGES)):
            mine = langs == k
            if mine.sum() >= 20 and labels[mine].min() != labels[mine].max():
                model.thresholds[k] = best(z[mine], labels[mine])


def held_out(doc_id) -> F.Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> bytes:
    """The trained model, pickled. docs: doc_id, text; labels: doc_id, toxic. Rows whose crc32(doc_id as text) mod 5 is 0 are not learned from."""
    known = labels.filter(F.col("toxic").isin(0, 1) & ~F.coalesce(held_out(F.col("doc_id")), F.lit(True))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((0, sample * 2 // 3), (1, sample // 3))]
    chosen = picked[0].unionByName(picked[1])

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release(_known)
        for f in frames:
            yield pd.DataFrame({"doc_id": f.doc_id, "toxic": f.toxic, "x": [numbers(t or "") for t in f.text]})

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        release()
        frame = frame.sort_values("doc_id")
        frame = frame.iloc[np.random.default_rng(0).permutation(len(frame))]
        return pd.DataFrame({"model": [pickle.dumps(train(list(frame.x), frame.toxic.to_numpy()))]})

    # at most `sample` rows on either side of the broadcast and in the one group
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInPandas(number, "doc_id long, toxic int, x array<bigint>")
    made = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(learn, "model binary").collect()
    return bytes(made[0].model) if made else pickle.dumps(Model())


def score_toxicity(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""

    def run(frames: Iterator[pa.RecordBatch]):
        release(_known)
        m = pickle.loads(model)
        table = m.table()
        for f in frames:
            scores = [m.score(numbers(t.as_py() or ""), table) for t in f.column(1)]
            yield pa.RecordBatch.from_arrays([f.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs scored under 0.5, with all their columns."""
    model, names = fit_toxicity(docs, labels), docs.columns

    def run(frames: Iterator[pa.RecordBatch]):
        release(_known)
        m = pickle.loads(model)
        table, at = m.table(), names.index("text")
        for f in frames:
            yield f.filter(pa.array([m.score(numbers(t.as_py() or ""), table) < 0.5 for t in f.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, load(spark, sf_dir, "labels")))
