"""Arrays on disk as a data source: ``spark.dataSource.register(Npy)``, then format ``npy``.

A folder of ``.npy`` files with one first axis is read in slabs of rows by offset. Writing is all or nothing: tasks write
files under names of their own, the commit lists them in ``_parts.json``, and an abort deletes them.
"""

from __future__ import annotations

import ast
import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Rows of a slab and of a written file.
SLAB_ROWS = 1 << 16
LIST = "_parts.json"


@dataclass
class Slab(InputPartition):
    """Rows of a file: where they begin in bytes and in the whole array."""

    path: str
    at: int
    rows: int
    first: int
    shape: tuple[int, ...]
    kind: str

    def __init__(self, path: str, at: int, rows: int, first: int, shape: tuple[int, ...], kind: str):
        super().__init__(first)
        self.path, self.at, self.rows, self.first, self.shape, self.kind = path, at, rows, first, shape, kind


@dataclass
class Written(WriterCommitMessage):
    """Files of a task, with their rows."""

    parts: list[tuple[str, int]]


def header(read) -> tuple[str, tuple[int, ...], int]:
    """Kind, shape and the place of the data; ``read(at, n)`` gives bytes."""
    head = read(0, 12)
    if head[:6] != b"\x93NUMPY":
        raise ValueError("no array file")
    wide = head[6] > 1
    size, begin = (int.from_bytes(head[8:12], "little"), 12) if wide else (int.from_bytes(head[8:10], "little"), 10)
    found = ast.literal_eval(read(begin, size).decode("latin1").strip())
    if found["fortran_order"] and len(found["shape"]) > 1:
        raise ValueError("columns come first in this array; slabs of rows don't lie together")
    return found["descr"], tuple(found["shape"]), begin + size


def _root(path: str):
    return fs.FileSystem.from_uri(path)


class NpyReader(DataSourceReader):
    """Slabs of ``rows`` rows; the driver reads headers only."""

    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def _files(self) -> list[str]:
        files, root = _root(self.path)
        info = files.get_file_info(root)
        if info.type == fs.FileType.File:
            return [root]
        if files.get_file_info(f"{root}/{LIST}").type == fs.FileType.File:
            with files.open_input_file(f"{root}/{LIST}") as f:
                return [f"{root}/{name}" for name, _ in json.loads(f.read())]
        return sorted(x.path for x in files.get_file_info(fs.FileSelector(root)) if x.path.endswith(".npy"))

    def partitions(self) -> list[Slab]:
        files, _ = _root(self.path)
        out, first = [], 0
        for path in self._files():
            with files.open_input_file(path) as f:
                kind, shape, at = header(lambda a, n: f.read_at(n, a))  # noqa: B023
            row = math.prod(shape[1:]) * np.dtype(kind).itemsize
            n = shape[0] if shape else 0
            for start in range(0, n, self.rows):
                out.append(Slab(path, at + start * row, min(self.rows, n - start), first + start, shape[1:], kind))
            first += n
        return out or [Slab("", 0, 0, 0, (), "<f8")]

    def read(self, slab: Slab) -> Iterator[pa.RecordBatch]:
        if not slab.rows:
            return
        files, _ = _root(self.path)
        width = math.prod(slab.shape)
        with files.open_input_file(slab.path) as f:
            body = f.read_at(slab.rows * width * np.dtype(slab.kind).itemsize, slab.at)
        values = np.frombuffer(body, slab.kind).astype(np.float64)
        offsets = pa.array(np.arange(slab.rows + 1) * width, pa.int32())
        rows = pa.array(slab.first + np.arange(slab.rows), pa.int64())
        yield pa.RecordBatch.from_arrays([rows, pa.ListArray.from_arrays(offsets, pa.array(values))], ["row", "data"])


class NpyWriter(DataSourceArrowWriter):
    """Rows of equally long ``data``; the order of rows is that of the tasks."""

    def __init__(self, path: str, rows: int, kind: str, overwrite: bool):
        self.path, self.rows, self.kind, self.overwrite = path, rows, kind, overwrite

    def _put(self, values: np.ndarray) -> tuple[str, int]:
        files, root = _root(self.path)
        files.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.npy"
        with files.open_output_stream(f"{root}/{name}") as out:
            np.lib.format.write_array_header_1_0(out, {"descr": np.dtype(self.kind).str, "fortran_order": False, "shape": values.shape})
            out.write(values.tobytes())
        return name, len(values)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        parts, held, n = [], [], 0
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("data"))
            if not len(column):
                continue
            held.append(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(self.kind))
            n += len(column)
            if n >= self.rows:
                parts.append(self._put(np.concatenate(held)))
                held, n = [], 0
        if n:
            parts.append(self._put(np.concatenate(held)))
        return Written(parts)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _root(self.path)
        files.create_dir(root, recursive=True)
        before = []
        if not self.overwrite and files.get_file_info(f"{root}/{LIST}").type == fs.FileType.File:
            with files.open_input_file(f"{root}/{LIST}") as f:
                before = json.loads(f.read())
        listed = before + [p for m in messages if m for p in m.parts]
        temp = f"{root}/{LIST}.{uuid.uuid4().hex}"
        with files.open_output_stream(temp) as out:
            out.write(json.dumps(listed).encode())
        files.move(temp, f"{root}/{LIST}")

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _root(self.path)
        for m in messages:
            for name, _ in m.parts if m else []:
                files.delete_file(f"{root}/{name}")


class Npy(DataSource):
    """Options: ``path``; ``rows`` of a slab or file; ``kind`` of the numbers written (``<f4``)."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "row long, data array<double>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("rows", SLAB_ROWS)))

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options["path"], int(self.options.get("rows", SLAB_ROWS)), self.options.get("kind", "<f4"), overwrite)
