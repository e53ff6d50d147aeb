"""Token ids of whole texts by the tokenizers library, with a cache of the pieces between spaces.

Both vocabularies' pre-tokenizers always end a token before a space that stands between two characters which are not white
space, and before and after a newline there; so such a piece has the same ids in any text, and the library needs to encode each
distinct piece once. Strings of special tokens in a text are ordinary text (encode_special_tokens, as the vocabularies' own
description has it), so that no document can forge a control token. Any other tokenizer file is encoded by the library as a whole.
A new piece of plain letters, digits and ASCII signs is cut into words here and given to the library's
model; any other goes through the library's whole encoder. Texts where white space meets white space are cut by a regular
expression at the safe places alone. A cache that
holds CACHE_PIECES drops all but its oldest entries, which bounds a worker's memory.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa

from .common import kept

CACHE_PIECES = 640_000
#: A full cache keeps this part of its entries, those that came first: frequent pieces come early.
KEPT_PART = 0.6
GROUP = 64
LONGEST_KEPT = 48
_SAFE = re.compile(r"(?<=\S)(?= \S)")
#: Divides pieces in a list of ids; ids are under 2^24, so their bytes never hold it.
_END = b"\xff\xff\xff\xff"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[\n ]?[!-~{_LETTER}]+").fullmatch
_STRANGE = re.compile(rf"[^\n\x00!-~{_LETTER}]").search
_encoders: dict[str, Encoder] = kept({})
_PROBE = "Ab1 2c 34's  x\n y'll..!? é"
#: The words of the probe under the two pre-tokenizers that are rebuilt here.
_PROBED = [
    ["ab", "1", "2", "c", "3", "4", "'s", "x", "y", "'ll", "..!?", "Ã©"],
    ["Ab", "1", "Ġ2", "c", "Ġ34", "'s", "Ġ", "Ġx", "Ċ", "Ġy", "'ll", "..!?", "ĠÃ©"],
]


def _byte_characters() -> dict[int, str]:
    """The byte-level alphabet: bytes that print stand for themselves, the others for characters from U+0100 on, in order."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(0x100 + i) for i, b in enumerate(others)}


_BYTES = _byte_characters()
#: Divides words in a text of many.
_BYTES_BUT_ZERO = {b: c for b, c in _BYTES.items() if b}


def _lower_latin(text: str) -> str:
    """A text of U+0000 to U+00FF in lower case, where Python and the library agree sign by sign; any other as it is."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def _missing(found: list) -> list[int]:
    """The places of None."""
    out, at = [], -1
    try:
        while True:
            at = found.index(None, at + 1)
            out.append(at)
    except ValueError:
        return out


def shrink(cache: dict) -> None:
    if len(cache) >= CACHE_PIECES:
        oldest = list(islice(cache.items(), int(CACHE_PIECES * KEPT_PART)))
        cache.clear()
        cache.update(oldest)


class _Made(dict):
    """A dictionary that makes and keeps the values it lacks."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= LONGEST_KEPT:
            shrink(self)
            self[key] = value
        return value


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if array("I").itemsize != 4 or sys.byteorder != "little":
            raise RuntimeError("ids are written as this machine's unsigned ints, which must be 32-bit and little-endian")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known = self._is_known()
        self.tokenize = self.tokenizer.model.tokenize
        self.lower = self.tokenizer.normalizer is not None  # the word vocabulary: lower case, white space dropped, digits one by one
        space, digits = ("", "[0-9]") if self.lower else (" ?", " ?[0-9]+")
        self.cutter = re.compile(rf"\x00|'s|'t|'re|'ve|'m|'ll|'d|{space}[{_LETTER}]+|{digits}|{space}[^\s\x000-9{_LETTER}]+" + ("" if self.lower else r"|\s")).findall
        self.words = _Made(lambda w: _END if w == "\0" else self._words([w])[0])
        self.whole = _Made(self._whole)  # by the exact string
        self.pieces: dict[str, bytes] = {}  # by the piece; a space stands before it unless it starts with a newline

    def _is_known(self) -> bool:
        """Whether the file's pre-tokenizer is one of the two whose cuts are rebuilt here."""
        pre = self.tokenizer.pre_tokenizer
        if pre is None:
            return False
        own = self.tokenizer.normalizer.normalize_str(_PROBE) if self.tokenizer.normalizer else _PROBE
        return [w for w, _ in pre.pre_tokenize_str(own)] in _PROBED

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words of plain pieces, which have no control character but a newline."""
        joined = "\0".join(words)
        if not joined.isascii():
            joined = joined.encode().decode("latin-1").translate(_BYTES_BUT_ZERO)
        elif not self.lower:  # signs, letters and digits stand for themselves
            joined = joined.replace(" ", _BYTES[32]).replace("\n", _BYTES[10])
        out = []
        for ids in map(self.tokenize, joined.split("\0")):
            out.append(array("I", [t.id for t in ids]).tobytes() if len(ids) != 1 else ids[0].id.to_bytes(4, "little"))
        return out

    def _whole(self, text: str) -> bytes:
        if _PLAIN(text):
            return b"".join(map(self.words.__getitem__, self.cutter(text.lower() if self.lower else text)))
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _plain(self, pieces: list[str], space: str) -> None:
        """Encodes plain pieces in one go: their words stand in one list, divided by a mark that no ids contain."""
        alone = [p for p in pieces if p.isalpha()]  # one word each, which need not be kept twice
        if alone:
            words = [space + p for p in alone] if space else alone
            self.pieces.update(zip(alone, self._words([w.lower() for w in words] if self.lower else words), strict=True))
            pieces = [p for p in pieces if not p.isalpha()]
        if pieces:
            joined = space + f"\0{space}".join(pieces)
            words = self.cutter(joined.lower() if self.lower else joined)
            shrink(self.words)
            known = self.words
            new = [w for w in set(words) if w not in known and w != "\0" and len(w) <= LONGEST_KEPT]  # longer ones are left to the look-up
            # a word may be known as a piece of its own
            ids = list(map(self.pieces.get, new if self.lower else [w[1:] if w[0] == " " else None for w in new]))
            known.update(zip(new, ids, strict=True))
            new = [w for w, x in zip(new, ids, strict=True) if x is None]
            if new:
                known.update(zip(new, self._words(new), strict=True))
            ids = b"".join(map(self.words.__getitem__, words)).split(_END)
            self.pieces.update(zip(pieces, ids, strict=True))

    def _learn(self, new: set[str]) -> None:
        """Adds ids of new pieces, except of those that don't make safe cuts: white space meets white space there."""
        new = new - {"", "\n"}
        spaced, after_newline = [p for p in new if p[0] != "\n"], [p for p in new if p[0] == "\n"]
        joined = "\0".join(new)
        # all plain, as most often: no sign but a plain one, and no newline or zero within a piece
        if not _STRANGE(joined) and joined.count("\n") == len(after_newline) and joined.count("\0") < max(1, len(new)):
            new = ()
        else:
            spaced, after_newline = [], []
        for p in new:
            if _PLAIN(p):
                (after_newline if p[0] == "\n" else spaced).append(p)
            elif not p[-1].isspace() and not (p[1] if p[0] == "\n" else p[0]).isspace():
                self.pieces[p] = self._whole(p if p[0] == "\n" else " " + p)
        self._plain(spaced, "" if self.lower else " ")
        self._plain(after_newline, "")

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if not self.known:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        shrink(self.pieces)
        if self.lower:  # fewer different pieces
            texts = list(map(_lower_latin, texts))
        cuts = [t.replace("\n", " \n").split(" ") for t in texts]
        # one look-up for each piece; only those that miss are looked up again once they are learnt
        found = [list(map(self.pieces.get, c)) for c in cuts]
        missing = [_missing(f) for f in found]
        self._learn({c[i] for c, m in zip(cuts, missing, strict=True) for i in m})
        out = []
        for text, c, f, m in zip(texts, cuts, found, missing, strict=True):
            for i in m:
                f[i] = self.pieces.get(c[i])
            first, f[0] = c[0], b""
            if len(c) > 1 and (not first or first[-1].isspace() or m and None in f):
                out.append(b"".join(map(self.whole.__getitem__, _SAFE.split(text))))
            else:
                f[0] = self.whole[first] if first else b""
                out.append(b"".join(f))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def encode_column(self, column: pa.Array, end: bytes = b"") -> Iterator[bytes]:
        """The ids of each text of an Arrow column, null as empty, each with `end` behind it."""
        for i in range(0, len(column), GROUP):
            for ids in self.encode_batch([t or "" for t in column.slice(i, GROUP).to_pylist()]):
                yield ids + end


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
