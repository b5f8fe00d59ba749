"""NIfTI-1 images as a Spark data source: spark.read.format("nifti1").load(path), after register(spark).

A row is an image, or with the option `slices` so many slices of its last axis. Only what the declared schema asks for is read: any of
SCHEMA's columns, in any order. Without data a file costs its first 348 bytes, compressed or not.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from ..session import ship
from .nifti import Header, header

SCHEMA = "path string, size long, shape array<int>, spacing array<double>, affine array<double>, dtype string, first int, data array<float>, error string"
_KINDS = {
    "path": pa.string(), "size": pa.int64(), "shape": pa.list_(pa.int32()), "spacing": pa.list_(pa.float64()), "affine": pa.list_(pa.float64()),
    "dtype": pa.string(), "first": pa.int32(), "data": pa.list_(pa.float32()), "error": pa.string(),
}


@dataclass
class Piece(InputPartition):
    """Of each file (path, size, i, n): the i-th of n equal shares of its slices."""

    files: list[tuple[str, int, int, int]]


class Reader(DataSourceReader):
    def __init__(self, names: list[str], options: dict[str, str]):
        if "path" not in options:
            raise ValueError("load() needs a path")
        self.names, self.path = names, options["path"]
        self.slices, self.bytes = int(options.get("slices", 0)), int(options.get("bytes", 128 << 20))
        if self.slices < 0 or self.bytes < 1:
            raise ValueError("slices must be 0 or more, bytes 1 or more")
        self.tests: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality, membership, beginnings and ends of the path: files left out are never opened."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.tests.append(("is", (f.value,)))
            elif isinstance(f, In) and f.attribute == ("path",):
                self.tests.append(("is", tuple(f.value)))
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.tests.append(("begins", (f.value,)))
            elif isinstance(f, StringEndsWith) and f.attribute == ("path",):
                self.tests.append(("ends", (f.value,)))
            elif not (isinstance(f, IsNotNull) and f.attribute == ("path",)):  # a path is never null
                yield f

    def _kept(self, path: str) -> bool:
        how = {"is": lambda v: path == v, "begins": path.startswith, "ends": path.endswith}
        return all(any(how[kind](v) for v in values if v is not None) for kind, values in self.tests)

    def partitions(self) -> list[Piece]:
        """Small files together up to about `bytes`; a large uncompressed one whose slices are asked for in several pieces."""
        system, root = _system(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        begin = self.path[: len(self.path) - len(self.path.split("://", 1)[-1])]
        out, held, total = [], [], 0
        for f in sorted(found, key=lambda f: f.path):
            path = begin + f.path
            hidden = any(part[:1] in "._" for part in f.path[len(root) :].split("/") if part)
            if f.type != fs.FileType.File or hidden or not f.path.endswith((".nii", ".nii.gz")) or not self._kept(path):
                continue
            n = max(1, -(-f.size // self.bytes)) if "data" in self.names and self.slices and not f.path.endswith(".gz") else 1
            if n > 1:
                out += [Piece([(path, f.size, i, n)]) for i in range(n)]
                continue
            # A header is far from the size of its file.
            cost = f.size if "data" in self.names else 4096
            if held and total + cost > self.bytes:
                out.append(Piece(held))
                held, total = [], 0
            held.append((path, f.size, 0, 1))
            total += cost
        # Spark makes one of its own, without files, of no pieces.
        return [*out, Piece(held)] if held or not out else out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in self._found(piece):
            held.append(row)
            size += 1024 + (0 if row["data"] is None else 4 * len(row["data"]))
            if size >= 4 << 20:
                yield self._batch(held)
                held, size = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], _KINDS[c]) for c in self.names], self.names)

    def _found(self, piece: Piece) -> Iterator[dict]:
        for path, size, i, n in piece.files:
            row = dict.fromkeys(_KINDS) | {"path": path, "size": size}
            try:
                for more in self._rows(path, i, n):
                    yield row | more
            except (ValueError, OSError, EOFError, struct.error) as e:  # a bad file becomes a row that says so
                if i == 0:
                    yield row | {"error": str(e)}

    def _rows(self, path: str, i: int, n: int) -> Iterator[dict]:
        system, at = _system(path)
        with system.open_input_file(at) as raw:
            packed = raw.read(2) == b"\x1f\x8b"
            raw.seek(0)
            told = gzip.GzipFile(fileobj=raw) if packed else raw
            h = header(told.read(348))
            known = {"shape": [*h.shape], "spacing": [*h.spacing], "affine": [float(a) for a in h.affine.ravel()], "dtype": np.dtype(h.kind).name}
            if len(h.shape) > 3 and "data" in self.names:
                raise ValueError(f"{len(h.shape)} axes, not 3")
            last = h.shape[-1]
            step = self.slices or last
            # The blocks of `step` slices that begin in this share; every block begins in one.
            for first in range(-(-(last * i // n) // step) * step, last * (i + 1) // n, step):
                data = _slices(told, h, first, min(step, last - first)) if "data" in self.names else None
                yield known | {"first": first, "data": data}


class Nifti1(DataSource):
    """Options: path; slices, slices a row (0: all of an image); bytes, of files or of pieces of one, about, a task (128 MB)."""

    @classmethod
    def name(cls) -> str:
        return "nifti1"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        unknown = sorted(set(schema.fieldNames()) - set(_KINDS))
        if unknown:
            raise ValueError(f"no columns {unknown} in an image")
        return Reader(schema.fieldNames(), dict(self.options))


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _slices(told, h: Header, first: int, count: int) -> np.ndarray:
    """The scaled values of some slices of the last axis, x fastest."""
    kind = np.dtype(h.order + h.kind)
    size = int(np.prod(h.shape[:-1])) * kind.itemsize
    told.seek(h.offset + first * size)
    raw = told.read(count * size)
    if len(raw) < count * size:
        raise ValueError("the data ends early")
    data = np.frombuffer(raw, kind).astype(np.float32)
    return data * np.float32(h.slope) + np.float32(h.inter) if h.slope != 0 and not np.isnan(h.slope) and (h.slope, h.inter) != (1.0, 0.0) else data


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets filters reach it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Nifti1)
