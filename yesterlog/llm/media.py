"""Media columns: interleaved sequences of text and media references, with payloads resolved by digest.

HTML is parsed into ordered elements: text, or a media reference with its caption (figcaption or alt). Elements are rows with
their position, so joining payloads by digest moves no position or caption; `sequences` folds them into one array per page.
Payloads are 8-bit grey images 192 samples wide, stored as PNG (filter 0, one IDAT chunk), which is lossless.

Defined results: null html has no elements; a reference whose digest is not in the store keeps null payload columns; repeated
references each resolve; a digest stored more than once counts once; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, load, text_bytes

WIDTH, LEVEL = 192, 2
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_SILENT = {"script", "style", "template", "noscript"}
_BREAKS = {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "figure", "article", "section", "nav", "ul", "ol", "table"}
_SPACE = re.compile(r"\s+")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, width: int = WIDTH) -> bytes:
    """An 8-bit grey PNG of rows of `width` samples."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), dtype=np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> bytes:
    """The samples of a PNG that `encode_png` wrote."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, width, parts = 8, 0, []
    while at < len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk of the PNG is damaged")
        if kind == b"IHDR":
            width = struct.unpack(">I", body[:4])[0]
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean and spread of the samples, entropy of their histogram, and a 64-bit average hash of an 8 x 8 reduction."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    entropy = -float((share[share > 0] * np.log2(share[share > 0])).sum())
    image = x.reshape(-1, WIDTH).astype(np.float64)
    edges = np.linspace(0, len(image), 9).astype(int)
    rows = np.stack([image[a : max(b, a + 1)].mean(axis=0) if a < len(image) else image[-1] for a, b in zip(edges, edges[1:], strict=False)])
    cells = rows.reshape(8, 8, WIDTH // 8).mean(axis=2)
    bits = np.packbits((cells > cells.mean()).reshape(-1)).tobytes().hex()
    return f"mean={x.mean():.6f};std={x.std():.6f};entropy={entropy:.6f};ahash={bits}"


class _Elements(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.text, self.caption, self.silent = [], None, 0

    def flush(self):
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        self.text = []
        if text:
            self.out.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        elif tag in ("img", "audio", "video", "source"):
            a = dict(attrs)
            if a.get("src"):
                self.flush()
                self.out.append({"kind": "media", "text": None, "ref": a["src"], "caption": a.get("alt") or None})
        elif tag == "figcaption":
            self.caption = []
        elif tag in _BREAKS:
            self.flush()

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            text, self.caption = _SPACE.sub(" ", "".join(self.caption)).strip(), None
            if self.out and self.out[-1]["kind"] == "media":
                self.out[-1]["caption"] = text or self.out[-1]["caption"]
            elif text:
                self.out.append({"kind": "text", "text": text, "ref": None, "caption": None})
        elif tag in _BREAKS:
            self.flush()

    def handle_data(self, data):
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def parse_html(html: str) -> list[dict]:
    p = _Elements()
    p.feed(html)
    p.close()
    p.flush()
    return p.out


def elements(pages: DataFrame, id_column: str = "page_id") -> DataFrame:
    """pages: id, html. Returns page_id, at, kind (text or media), text, ref, caption: a row for each element, in order of at."""

    def run(frames: Iterator[pa.RecordBatch]):
        names, types = ["page_id", "at", "kind", "text", "ref", "caption"], [pa.int64(), pa.int32(), *[pa.string()] * 4]
        for f in frames:
            rows = [(i, k, e["kind"], e["text"], e["ref"], e["caption"]) for i, html in zip(f.column(0).to_pylist(), f.column(1).to_pylist(), strict=True) for k, e in enumerate(parse_html(html or ""))]
            yield from batches(rows, names, types)

    return pages.select(F.col(id_column).cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, at int, kind string, text string, ref string, caption string")


def resolve(rows: DataFrame, store: DataFrame) -> DataFrame:
    """Adds to each element the columns that the store keeps for its digest ("sha256:..." references). store: digest, ..."""
    digest = F.regexp_extract("ref", "^sha256:([0-9a-f]{64})$", 1)
    once = store.dropDuplicates(["digest"])
    return rows.withColumn("wanted", F.when(digest != "", digest)).join(once, F.col("wanted") == F.col("digest"), "left").drop("wanted")


def sequences(resolved: DataFrame) -> DataFrame:
    """page_id, sequence: the elements of each page as an array of structs in order."""
    rest = [c for c in resolved.columns if c not in ("page_id", "at")]
    return resolved.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("at", *rest))).alias("sequence"))


def document_media(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages (page_id, n_bytes, html) that show each document's text as an image, and the store (digest, media) of these images.

    Both are columns of one table, written once; a digest is stored once by each task.
    """

    def run(frames: Iterator[pa.RecordBatch]):
        stored: set[str] = set()
        for f in frames:
            rows = []
            for doc, text in zip(f.column(0).to_pylist(), text_bytes(f.column(1)), strict=True):
                payload = text.ljust(max(1, -(-len(text) // WIDTH)) * WIDTH, b" ")
                digest = hashlib.sha256(payload).hexdigest()
                html = f'<article><p>Document</p><figure><img src="sha256:{digest}" alt="text as image"><figcaption>{len(text)} bytes</figcaption></figure></article>'
                rows.append((doc, len(text), html, digest, None if digest in stored else encode_png(payload)))
                stored.add(digest)
                if len(rows) == 256:
                    yield from batches(rows, names, types)
                    rows = []
            yield from batches(rows, names, types)

    names, types = ["page_id", "n_bytes", "html", "digest", "media"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    table = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "page_id long, n_bytes long, html string, digest string, media binary"), "media")
    return table.select("page_id", "n_bytes", "html"), table.filter("media is not null").select("digest", "media")


def described(store: DataFrame) -> DataFrame:
    """The stored media read back: digest and the figures of the payload and of the stored form."""

    def run(frames: Iterator[pa.RecordBatch]):
        names, types = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"], [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for f in frames:
            rows = []
            for digest, media in zip(f.column(0).to_pylist(), f.column(1), strict=True):
                media = media.as_py()
                p = decode_png(media)
                rows.append((digest, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(p)))
            yield from batches(rows, names, types)

    return store.mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_media(spark, sf_dir: str) -> DataFrame:
    pages, store = document_media(load(spark, sf_dir, "documents"))
    shown = resolve(elements(pages).filter("kind = 'media'"), described(store))
    n_bytes = F.regexp_extract("caption", "^([0-9]+) bytes$", 1).cast("long").alias("n_bytes")
    return shown.select(F.col("page_id").alias("doc_id"), n_bytes, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
