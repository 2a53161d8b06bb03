"""Binary archives, arrays and sound files read by byte ranges.

Tasks open files through Arrow's file systems by their address, and read the bytes that they need: neighbouring records of
a file come in one read. Files that tasks write have names of their own for each attempt, and a table that is written once
lists them, so what a lost or repeated task has left is never read.
"""

from __future__ import annotations

import hashlib
import math
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import folder as scratch

#: Bytes that are read at once, unless one record is longer.
BLOCK = 1 << 20

_SIZES = {b"FM ": ("<f4", 2), b"DM ": ("<f8", 2), b"FV ": ("<f4", 1), b"DV ": ("<f8", 1)}
_MATRIX = "key string, rows int, cols int, data array<double>, error string"


class Window:
    """A file seen through one block that moves on: ``self(at, n)`` gives n bytes, fewer at the end. ``bytes_read`` counts what was asked of the file."""

    def __init__(self, path: str, block: int = BLOCK):
        files, name = fs.FileSystem.from_uri(path)
        self.file, self.block, self.start, self.held, self.bytes_read = files.open_input_file(name), block, 0, b"", 0
        self.size = self.file.size()

    def __call__(self, at: int, n: int) -> bytes:
        if at < self.start or at + n > self.start + len(self.held):
            self.start = at
            self.held = self.file.read_at(max(0, min(max(n, self.block), self.size - at)), at) if at < self.size else b""
            self.bytes_read += len(self.held)
        return self.held[at - self.start : at - self.start + n]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def _listed(made: DataFrame, name: str) -> DataFrame:
    """What tasks say that they have written, kept so that no task does it again."""
    path = scratch(made.sparkSession, name)
    made.write.parquet(path)
    return made.sparkSession.read.schema(made.schema).parquet(path)


def _create(folder: str, name: str):
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    return files.open_output_stream(f"{root}/{name}"), f"{folder.rstrip('/')}/{name}"


# Archives of matrices.


def record(values: np.ndarray) -> bytes:
    """A binary archive's record of a vector or matrix of floats or doubles."""
    code = ("D" if values.dtype == np.float64 else "F") + ("M " if values.ndim == 2 else "V ")
    sizes = b"".join(b"\4" + struct.pack("<i", n) for n in values.shape)
    return b"\0B" + code.encode() + sizes + values.astype(values.dtype.newbyteorder("<")).tobytes()


def parsed_record(read, at: int) -> tuple[int, int, np.ndarray]:
    """Rows (1 for a vector), columns and values of the record at ``at``; ``read(at, n)`` gives bytes."""
    head = read(at, 15)
    if head[:2] != b"\0B" or head[2:5] not in _SIZES:
        raise ValueError(f"no binary matrix of floats: {head[:5]!r}")
    kind, dims = _SIZES[head[2:5]]
    shape = [struct.unpack_from("<i", head, 6 + 5 * d)[0] for d in range(dims)] if len(head) >= 5 + 5 * dims else [-1]
    count = math.prod(shape)
    body = read(at + 5 + 5 * dims, count * int(kind[2])) if min(shape) >= 0 else b""
    if min(shape) < 0 or len(body) < count * int(kind[2]):
        raise ValueError("the record is cut off")
    rows, cols = shape if dims == 2 else (1, shape[0])
    return rows, cols, np.frombuffer(body, kind).astype(np.float64)


def write_archives(df: DataFrame, key: str, data: str, folder: str) -> DataFrame:
    """Writes the arrays (vectors) or arrays of arrays (matrices) of floats in ``data`` to binary archives; returns the index ``key, path, offset``."""
    double = "double" in df.schema[data].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    out, name = _create(folder, f"part-{uuid.uuid4().hex}.ark")
                head = f"{k} ".encode()
                body = record(np.array(v, np.float64 if double else np.float32))
                out.write(head + body)
                rows.append((k, name, at + len(head)))
                at += len(head) + len(body)
            yield pa.RecordBatch.from_pylist([dict(zip(("key", "path", "offset"), r, strict=True)) for r in rows], schema=pa.schema([("key", pa.string()), ("path", pa.string()), ("offset", pa.int64())]))
        if out is not None:
            out.close()

    return _listed(df.select(F.col(key).cast("string").alias("key"), data).mapInArrow(run, "key string, path string, offset long"), "archive-index")


def index_lines(index: DataFrame) -> DataFrame:
    """The index as text lines, ``key path:offset``."""
    return index.select(F.concat("key", F.lit(" "), "path", F.lit(":"), "offset").alias("value"))


def index_of(spark: SparkSession, path: str) -> DataFrame:
    """``key, path, offset`` of index lines; without an offset a file begins with its record. Blank lines are skipped."""
    parts = F.regexp_extract("value", r"^\s*(\S+)\s+(.*?)(?::(\d+))?\s*$", 0) != ""
    got = lambda i: F.regexp_extract("value", r"^\s*(\S+)\s+(.*?)(?::(\d+))?\s*$", i)
    return spark.read.text(path).where(parts).select(got(1).alias("key"), got(2).alias("path"), F.coalesce(got(3).try_cast("long"), F.lit(0)).alias("offset"))


def read_archives(index: DataFrame, block: int = BLOCK) -> DataFrame:
    """``key, rows, cols, data, error`` of the records of an index: tasks take ranges of it in the order of files and offsets.

    Vectors have one row; ``data`` is row by row. A record of another kind, or cut off, or of a missing file, has an
    ``error`` and no data.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, window = None, None
        for batch in batches:
            out = []
            for k, path, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = {"key": k, "rows": None, "cols": None, "data": None, "error": None}
                try:
                    if path != name:
                        name, window = None, Window(path, block)
                        name = path
                    row["rows"], row["cols"], row["data"] = parsed_record(window, at)
                except (ValueError, OSError) as e:
                    row["error"] = str(e)[:200]
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.string()), ("rows", pa.int32()), ("cols", pa.int32()), ("data", pa.list_(pa.float64())), ("error", pa.string())]))

    return index.select("key", "path", "offset").repartitionByRange("path", "offset").sortWithinPartitions("path", "offset").mapInArrow(run, _MATRIX)


# Sound files.


def wav_header(read) -> tuple[int, int, int, int, int]:
    """Rate, channels, bytes a sample, and where the samples begin and how many bytes they have, from the chunks of a RIFF file."""
    if read(0, 4) != b"RIFF" or read(8, 4) != b"WAVE":
        raise ValueError("no RIFF WAVE file")
    at, form = 12, None
    while len(head := read(at, 8)) == 8:
        kind, size = head[:4], struct.unpack("<I", head[4:])[0]
        if kind == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack("<HHIIHH", read(at + 8, 16))
            form = rate, channels, bits // 8
        elif kind == b"data" and form:
            return *form, at + 8, size
        at += 8 + size + size % 2
    raise ValueError("no samples")


def wav_file(samples: bytes, rate: int, channels: int = 1, width: int = 2) -> bytes:
    head = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * width, channels * width, 8 * width)
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(samples)) + samples


def write_wavs(df: DataFrame, name: str, samples: str, rate: int, folder: str) -> DataFrame:
    """Writes a file of 16-bit samples (an array column) a row; returns ``name, path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, paths = batch.column(0).to_pylist(), []
            for n, v in zip(names, batch.column(1).to_pylist(), strict=True):
                out, path = _create(folder, f"{n}-{uuid.uuid4().hex[:8]}.wav")
                with out:
                    out.write(wav_file(np.array(v, "<i2").tobytes(), rate))
                paths.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(paths, pa.string())], ["name", "path"])

    return _listed(df.select(F.col(name).cast("string").alias("name"), samples).mapInArrow(run, "name string, path string"), "wav-list")


def wav_parts(files: DataFrame, path: str, start: Column, end: Column, keep: str | None = None) -> DataFrame:
    """``files`` with ``rate, channels, frames, duration, part_frames, bytes_read, part_sha256, part_path``, and ``part``: the bytes of the samples from ``start`` to ``end`` (seconds).

    Only the header and the samples asked for are read: frames from ``floor(start * rate)`` up to ``ceil(end * rate)``, so
    none begins at ``end`` or later. ``keep``: a folder for the parts as sound files, byte for byte; they are written
    once. A file that can't be read has null fields. Columns of ``files`` with these names give way.
    """
    made = "rate int, channels int, frames long, duration double, part_frames long, bytes_read long, part binary, part_sha256 string, part_path string"
    schema = pa.schema([("rate", pa.int32()), ("channels", pa.int32()), ("frames", pa.int64()), ("duration", pa.float64()), ("part_frames", pa.int64()), ("bytes_read", pa.int64()), ("part", pa.binary()), ("part_sha256", pa.string()), ("part_path", pa.string())])

    names = [c for c in files.columns if c not in schema.names]

    def one(p: str, a: float, b: float) -> dict:
        row = dict.fromkeys(schema.names)
        try:
            with Window(p, 4096) as read:
                rate, channels, width, at, size = wav_header(read)
                frame = channels * width
                size = min(size, read.size - at)
                frames = size // frame
                first, last = max(0, math.floor(a * rate)), min(frames, math.ceil(b * rate))
                head = read.bytes_read
                body = read.file.read_at(max(0, last - first) * frame, at + first * frame) if last > first else b""
                row |= {"rate": rate, "channels": channels, "frames": frames, "duration": frames / rate, "part_frames": len(body) // frame, "bytes_read": head + len(body), "part": body, "part_sha256": hashlib.sha256(body).hexdigest()}
            if keep is not None:
                out, row["part_path"] = _create(keep, f"{uuid.uuid4().hex}.wav")
                with out:
                    out.write(wav_file(body, rate, channels, width))
        except (ValueError, OSError, struct.error):
            row = dict.fromkeys(schema.names)
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(names)
        for batch in batches:
            for at in range(0, len(batch), 64):  # parts of a few files at once
                some = batch.slice(at, 64)
                asked = zip(*(some.column(n + k).to_pylist() for k in range(3)), strict=True)
                parts = pa.RecordBatch.from_pylist([one(p, a, b) for p, a, b in asked], schema=schema)
                yield pa.RecordBatch.from_arrays([*some.columns[:n], *parts.columns], [*names, *schema.names])

    kinds = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in names)
    out = files.select(*names, F.col(path).alias("_p"), start.cast("double").alias("_a"), end.cast("double").alias("_b")).mapInArrow(run, f"{kinds}, {made}")
    return _listed(out, "wav-parts") if keep is not None else out
