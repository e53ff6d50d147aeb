"""Pieces that are one word are learnt without a second cache, and words take their ids from pieces that are known."""

import random

import pytest

from yesterlog.llm import tokens

BOTH = pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])


@BOTH
def test_a_word_is_given_to_the_model_once(name):
    enc, asked = tokens.Encoder(tokens.vocabulary(name)), []
    model = enc.tokenize
    enc.tokenize = lambda w: asked.append(w) or model(w)
    enc.encode("x abelian gnomes")
    assert len(enc.words) <= 1  # the first piece, which has no space before it
    before = len(asked)
    enc.encode("x abelian, gnomes;")
    assert all(not w.strip("Ġ").isalpha() for w in asked[before:])


@BOTH
@pytest.mark.parametrize("size", [tokens.CACHE_PIECES, 40])
def test_ids_are_those_of_the_library(name, size, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", size)
    rng, enc = random.Random(3), tokens.Encoder(tokens.vocabulary(name))
    signs = ["", "", "", ",", ".", "'s", "'", "''s", "!'s", "ing", "9", "42a", "é", "Ñu", "ß", "ÀÉ", "漢", "\t", " ", "\n", "\nfoo", "\n\n", "x" * 60]
    words = ["foo", "Foo", "bar", "don't", "naïve", "a", "I", "s", "'s", "x1"]
    for _ in range(40):
        texts = [rng.choice(["", " ", "\n"]) + rng.choice([" ", " ", "\n"]).join(rng.choice(words) + rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(20)]
        want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [tokens.array("I", ids).tolist() for ids in enc.encode_batch(texts)] == want
