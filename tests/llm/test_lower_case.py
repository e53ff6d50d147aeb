"""The word vocabulary is of lower case: texts are lowered before they are cut, so that pieces apart only in case are learnt once."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from yesterlog.llm import token_file, tokens


def test_pieces_apart_in_case_are_learnt_once():
    enc = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json"))
    one, other = enc.encode("so the Water, éTé"), enc.encode("so The wATEr, ÉTÉ")
    assert one == other and set(enc.pieces) == {"so", "the", "water,", "été"}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_odd_texts_equal_the_library(name):
    path = tokens.vocabulary(name)
    enc, plain = tokens.Encoder(path), Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    rng = random.Random(4)
    signs = [*"aB cD  \n\n\0ÀßµÿÞ×÷1 23'sS.!", "ΟΔΟΣ", "İ", "ẞ", "K", "é", "\xa0", "\x85", "\x1c", "\t", "\r\n", "x" * 60, "</s>", "Word ", "The ", "\nÉté", "ſ", "日本"]
    texts = ["", " ", "\n", "\0", "A\0B c", "Ab\n\0Cd", "ΑΣ ΑΣ a"] + ["".join(rng.choices(signs, k=rng.randrange(1, 30))) for _ in range(3000)]
    for _ in range(2):  # the second time from the cache
        for i in range(0, len(texts), 50):
            part = texts[i : i + 50]
            assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_batch(part)] == [plain.encode(t, add_special_tokens=False).ids for t in part]


def test_segments_of_any_width_are_read_back():
    rng = np.random.default_rng(0)
    for bits in range(33):
        ids = rng.integers(0, 1 << bits, 1000, dtype=np.uint64).astype(np.uint32)
        ids[::50] = rng.integers(0, 1 << 32, 20, dtype=np.uint64)  # exceptions
        assert token_file.unpack(token_file.pack(ids)).tolist() == ids.tolist()
