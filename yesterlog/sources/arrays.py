"""Array files as a Spark source and sink: `.npy` files, `.npz` archives, and folders of either.

    arrays.register(spark)
    spark.read.format("arrays").option("members", "id,rate").load("s3://tables/effects")
    df.write.format("arrays").save("s3://tables/effects")

The driver reads headers only. A file is split into ranges of `rowsPerPartition` rows (default 1,000,000); a task seeks to its range in
plain members and reads nothing else of the file, and a compressed member is unpacked up to the range's end. `members` names what is
read; other members are never touched. Files are reached through Arrow's file systems, so a path may be local, hdfs://, s3:// or gs://.

Defined results: each row has `row`, its number over all files in order of their names, and a column for each member (`value` for a
`.npy` file): scalars of 1-d arrays, lists of 2-d ones. Members of an archive must have equally many rows. Texts and bytes lose trailing
zeros, as numpy stores them. A folder without array files is refused unless a manifest lists none. Pickled arrays are refused.
A written folder holds a file for each task and a manifest of those that count, so files of lost or repeated tasks are never read.
Null numbers, lists of different lengths and nested types are refused when written, since the format can't hold them.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

MANIFEST = "manifest.json"
ROWS = 1_000_000
#: Rows of one Arrow batch.
BATCH = 65_536


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system that holds a path, and the path there."""
    return fs.FileSystem.from_uri(uri)


@dataclass
class Member:
    """An array in a file: where its values begin (None: in a compressed member, after `head` bytes), its type and shape."""

    name: str
    start: int | None
    head: int
    dtype: np.dtype
    shape: tuple[int, ...]

    @property
    def width(self) -> int:
        return self.dtype.itemsize * (self.shape[1] if len(self.shape) == 2 else 1)

    @property
    def type(self) -> pa.DataType:
        one = {"U": pa.string(), "S": pa.binary()}.get(self.dtype.kind) or pa.from_numpy_dtype(self.dtype.newbyteorder("="))
        # Spark has no unsigned numbers and no halves
        one = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0), pa.float16(): pa.float32()}.get(one, one)
        return pa.list_(one) if len(self.shape) == 2 else one

    def column(self, data: bytes) -> pa.Array:
        values = np.frombuffer(data, dtype=self.dtype)
        if self.dtype.kind in "US":
            flat = pa.array(values.tolist(), pa.string() if self.dtype.kind == "U" else pa.binary())
        elif self.dtype == np.uint64:
            flat = pa.array(values.tolist(), pa.uint64()).cast(pa.decimal128(20, 0))
        else:
            flat = pa.array(values.astype(self.dtype.newbyteorder("=")))
        if len(self.shape) == 1:
            return flat.cast(self.type)
        n = self.shape[1]
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, n) if n else np.zeros(len(data) + 1), pa.int32()), flat.cast(self.type.value_type))


def _header(f, name: str, start: int, compressed: bool) -> Member:
    begin = f.tell()
    version = npy.read_magic(f)
    shape, by_column, dtype = npy.read_array_header_1_0(f) if version == (1, 0) else npy.read_array_header_2_0(f)
    if dtype.hasobject or dtype.kind not in "biufUS" or dtype.itemsize == 0:
        raise ValueError(f"array {name} has type {dtype}, which is no plain value")
    if len(shape) not in (1, 2) or (by_column and len(shape) == 2) or (len(shape) == 2 and shape[1] == 0):
        raise ValueError(f"array {name} of shape {shape} has no rows to split by")
    head = f.tell() - begin
    return Member(name, None if compressed else start + head, head, dtype, shape)


def members(store: fs.FileSystem, path: str) -> list[Member]:
    """The arrays of a file, from its headers."""
    with store.open_input_file(path) as f:
        if path.endswith(".npy"):
            return [_header(f, "value", 0, False)]
        out = []
        with zipfile.ZipFile(f) as archive:
            for info in archive.infolist():
                f.seek(info.header_offset + 26)
                names = struct.unpack("<HH", f.read(4))  # lengths of the local name and extra field
                with archive.open(info) as inside:
                    out.append(_header(inside, info.filename.removesuffix(".npy"), info.header_offset + 30 + sum(names), info.compress_type != zipfile.ZIP_STORED))
        if len({m.shape[0] for m in out}) > 1:
            raise ValueError(f"members of {path} have different numbers of rows")
        return out


def _files(store: fs.FileSystem, path: str) -> list[str]:
    if store.get_file_info(path).type == fs.FileType.File:
        return [path]
    found = {i.base_name: i.path for i in store.get_file_info(fs.FileSelector(path)) if i.type == fs.FileType.File}
    if MANIFEST in found:
        with store.open_input_stream(found[MANIFEST]) as f:
            return [found[n] for n in json.loads(f.read())["files"]]
    files = [p for n, p in sorted(found.items()) if n.endswith((".npy", ".npz"))]
    if not files:
        raise ValueError(f"no array files in {path}")
    return files


@dataclass
class Range(InputPartition):
    path: str
    first: int
    start: int
    stop: int


class ArrayReader(DataSourceReader):
    def __init__(self, uri: str, names: list[str], rows: int):
        self.uri, self.names, self.rows = uri, names, rows

    def partitions(self) -> list[Range]:
        store, path = opened(self.uri)
        out, first = [], 0
        for p in _files(store, path):
            n = members(store, p)[0].shape[0]
            out += [Range(p, first, i, min(n, i + self.rows)) for i in range(0, n, self.rows)]
            first += n
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.start == part.stop:
            return
        store, _ = opened(self.uri)
        found = {m.name: m for m in members(store, part.path)}
        with store.open_input_file(part.path) as f:
            streams = {n: self._stream(store, part, found[n]) for n in self.names if found[n].start is None}
            for i in range(part.start, part.stop, BATCH):
                k = min(BATCH, part.stop - i)
                columns = [pa.array(np.arange(part.first + i, part.first + i + k))]
                for n in self.names:
                    m = found[n]
                    columns.append(m.column(streams[n].read(k * m.width) if n in streams else f.read_at(k * m.width, m.start + i * m.width)))
                yield pa.RecordBatch.from_arrays(columns, names=["row", *self.names])

    @staticmethod
    def _stream(store: fs.FileSystem, part: Range, m: Member):
        stream = zipfile.ZipFile(store.open_input_file(part.path)).open(f"{m.name}.npy")
        left = m.head + part.start * m.width
        while left:
            left -= len(stream.read(min(left, 1 << 20)))
        return stream


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


def _array(name: str, column: pa.ChunkedArray) -> np.ndarray:
    if column.null_count:
        raise ValueError(f"column {name} has nulls, which arrays can't hold")
    kind = column.type
    if pa.types.is_list(kind):
        flat = [c.flatten() for c in column.chunks]
        widths = {n for c in column.chunks for n in np.unique(np.diff(c.offsets.to_numpy()))}
        if len(widths) > 1:
            raise ValueError(f"lists of column {name} have different lengths")
        return _array(name, pa.chunked_array(flat, kind.value_type)).reshape(len(column), -1)
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return np.array(column.to_pylist(), dtype=str)
    if pa.types.is_binary(kind):
        return np.array(column.to_pylist(), dtype=bytes)
    if not (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind)):
        raise ValueError(f"column {name} is {kind}, which arrays can't hold")
    return column.to_numpy()


class ArrayWriter(DataSourceArrowWriter):
    """A task holds the rows of its own partition, which it writes as one archive of plain members."""

    def __init__(self, uri: str, overwrite: bool):
        self.uri, self.overwrite = uri, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        table = [b for b in iterator if b.num_rows]
        if not table:
            return Written(None, 0)
        table = pa.Table.from_batches(table)
        store, path = opened(self.uri)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.npz"
        data = io.BytesIO()
        np.savez(data, **{c: _array(c, table.column(c)) for c in table.column_names if c != "row"})
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{name}") as f:
            f.write(data.getbuffer())
        return Written(name, table.num_rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = opened(self.uri)
        store.create_dir(path, recursive=True)
        there = f"{path}/{MANIFEST}"
        if not self.overwrite and store.get_file_info(there).type == fs.FileType.File:
            with store.open_input_stream(there) as f:
                before = json.loads(f.read())["files"]
        else:
            before = []
        files = before + sorted(m.name for m in messages if m and m.name)
        with store.open_output_stream(there) as f:
            f.write(json.dumps({"files": files}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, path = opened(self.uri)
        for m in messages:
            if m and m.name:
                store.delete_file(f"{path}/{m.name}")


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrays"

    def _uri(self) -> str:
        path = self.options["path"]
        return path if "://" in path or path.startswith("/") else path.replace("file:", "", 1)

    def schema(self) -> StructType:
        store, path = opened(self._uri())
        files = _files(store, path)
        found = members(store, files[0]) if files else []
        asked = self.options.get("members")
        names = [n.strip() for n in asked.split(",")] if asked else [m.name for m in found]
        types = {m.name: m.type for m in found}
        if files and (missing := [n for n in names if n not in types]):
            raise ValueError(f"no members {missing} in {files[0]}")
        return from_arrow_schema(pa.schema([("row", pa.int64()), *[(n, types[n]) for n in names if n in types]]))

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(self._uri(), [n for n in schema.names if n != "row"], int(self.options.get("rowsperpartition", self.options.get("rowsPerPartition", ROWS))))

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self._uri(), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArraySource)
