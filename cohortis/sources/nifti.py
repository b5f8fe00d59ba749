"""NIfTI-1 volumes as rows, after the published header: a pure numpy codec, fed by Spark's binaryFile reader."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..schemas import VOLUMES

#: NIfTI-1 datatype codes.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


@dataclass(frozen=True)
class Header:
    """What a file's first 348 bytes say; both forms are 4 x 4, None where their code is 0."""

    order: str
    shape: tuple[int, ...]
    spacing: tuple[float, ...]
    kind: str
    offset: int
    slope: float
    inter: float
    qform_code: int
    sform_code: int
    qform: np.ndarray | None
    sform: np.ndarray | None

    @property
    def affine(self) -> np.ndarray:
        """The sform, else the qform, else the spacing alone."""
        own = self.sform if self.sform is not None else self.qform
        return np.diag([*self.spacing[:3], 1.0]) if own is None else own


def _opened(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def header(raw: bytes) -> Header:
    """Raises ValueError where it isn't a NIfTI-1 header or the data type isn't one of TYPES."""
    if len(raw) < 348 or raw[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("not a NIfTI-1 file")
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    at = lambda form, place: struct.unpack_from(order + form, raw, place)
    dim, pixdim, code = at("8h", 40), at("8f", 76), at("h", 70)[0]
    if code not in TYPES:
        raise ValueError(f"datatype {code}")
    offset, slope, inter = at("3f", 108)
    qcode, scode = at("2h", 252)
    qform = _rotated(at("3f", 256), pixdim[1:4], -1.0 if pixdim[0] < 0 else 1.0, at("3f", 268)) if qcode > 0 else None
    sform = np.array([*at("12f", 280), 0, 0, 0, 1], dtype=float).reshape(4, 4) if scode > 0 else None
    # Trailing axes of one element say nothing; three axes are always given.
    sizes = [max(1, d) for d in dim[1 : 1 + max(3, dim[0])]]
    while len(sizes) > 3 and sizes[-1] == 1:
        sizes.pop()
    return Header(order, tuple(sizes), tuple(float(p) for p in pixdim[1:4]), TYPES[code], int(offset), slope, inter, qcode, scode, qform, sform)


def _rotated(bcd, spacing, side: float, origin) -> np.ndarray:
    """The affine of a unit quaternion (b, c, d; a >= 0 follows), spacings, the third axis's side and an origin."""
    b, c, d = (float(x) for x in bcd)
    a = max(0.0, 1 - b * b - c * c - d * d) ** 0.5
    turn = np.array([[a, -d, c], [d, a, -b], [-c, b, a]])  # a times the identity, plus the cross product by (b, c, d)
    u = np.array([b, c, d])
    out = np.eye(4)
    out[:3, :3] = (np.outer(u, u) + turn @ turn) * (np.asarray(spacing, dtype=float) * [1, 1, side])
    out[:3, 3] = origin
    return out


def _quaternion(affine: np.ndarray) -> tuple[float, tuple[float, float, float]]:
    """The side of the third axis and (b, c, d) of the rotation closest to an affine's."""
    left, _, right = np.linalg.svd(affine[:3, :3] / np.linalg.norm(affine[:3, :3], axis=0))
    turn = left @ right
    side = -1.0 if np.linalg.det(turn) < 0 else 1.0
    turn = turn * [1, 1, side]
    # The quaternion is the eigenvector of the greatest eigenvalue of a symmetric matrix: stable for half turns too.
    skew = np.array([turn[2, 1] - turn[1, 2], turn[0, 2] - turn[2, 0], turn[1, 0] - turn[0, 1]])
    m = np.zeros((4, 4))
    m[0, 0], m[0, 1:], m[1:, 0] = np.trace(turn), skew, skew
    m[1:, 1:] = turn + turn.T - np.trace(turn) * np.eye(3)
    q = np.linalg.eigh(m)[1][:, -1]
    b, c, d = (q if q[0] >= 0 else -q)[1:]
    return side, (float(b), float(c), float(d))


def axis_codes(affine: np.ndarray) -> str:
    """For each axis of the array the side of the body that it runs to: of R or L, A or P, S or I. Largest shares are dealt first."""
    share = np.asarray(affine, dtype=float)[:3, :3]
    norm = np.linalg.norm(share, axis=0)
    share = share / np.where(norm > 0, norm, 1)
    out, left = ["?"] * 3, np.abs(share)
    for _ in range(3):
        world, axis = np.unravel_index(np.argmax(left), (3, 3))
        out[axis] = "RAS"[world] if share[world, axis] > 0 else "LPI"[world]
        left[world, :], left[:, axis] = -1, -1
    return "".join(out)


def described(content: bytes, statistics: bool = False, atol: float = 1e-3) -> dict:
    """shape, voxel_mm (4 places), axcodes, dtype, both codes, and whether the forms agree (None unless both are given); with
    statistics also the least, 1st, 50th and 99th percentile and greatest of the finite values (None without any)."""
    raw = _opened(content)
    h = header(raw)
    agree = bool(np.allclose(h.qform, h.sform, atol=atol)) if h.qform is not None and h.sform is not None else None
    out = {"shape": list(h.shape), "voxel_mm": [round(p, 4) for p in h.spacing], "axcodes": axis_codes(h.affine), "dtype": np.dtype(h.kind).name, "qform_code": h.qform_code, "sform_code": h.sform_code, "forms_agree": agree}
    if statistics:
        values = _values(raw, h)
        values = values[np.isfinite(values)].astype(float)
        found = [values.min(), *np.percentile(values, [1, 50, 99]), values.max()] if len(values) else [None] * 5
        out |= {k: None if v is None else float(v) for k, v in zip(("least", "p1", "p50", "p99", "greatest"), found, strict=True)}
    return out


DESCRIPTION = "shape array<int>, voxel_mm array<double>, axcodes string, dtype string, qform_code int, sform_code int, forms_agree boolean"
STATISTICS = "least double, p1 double, p50 double, p99 double, greatest double"


def _values(raw: bytes, h: Header) -> np.ndarray:
    """The scaled data, x fastest."""
    data = np.frombuffer(raw, dtype=np.dtype(h.order + h.kind), count=int(np.prod(h.shape)), offset=h.offset).astype(np.float32)
    if h.slope != 0 and not np.isnan(h.slope) and (h.slope, h.inter) != (1.0, 0.0):
        data = data * np.float32(h.slope) + np.float32(h.inter)
    return data


def decode(content: bytes) -> dict:
    """shape, spacing, affine (16, by rows) and data (x fastest, scaled, float32). Raises ValueError on anything else, images of
    more than three axes among it."""
    raw = _opened(content)
    h = header(raw)
    if len(h.shape) > 3:
        raise ValueError(f"{len(h.shape)} axes, not 3")
    return {"shape": [*h.shape], "spacing": [*h.spacing], "affine": [float(a) for a in h.affine.ravel()], "data": _values(raw, h)}


def encode(data: np.ndarray, shape, affine, dtype: str = "f4", codes: tuple[int, int] = (1, 1)) -> bytes:
    """A NIfTI-1 file with the affine in both forms; codes: the qform's and the sform's, 1 for 0. Booleans as uint8."""
    shape = [int(s) for s in shape]
    if len(data) != int(np.prod(shape)):
        raise ValueError("the data doesn't fit the shape")
    kind = "u1" if dtype == "bool" else dtype
    code = next(k for k, v in TYPES.items() if v == kind)
    a = np.asarray(affine, dtype=float).reshape(4, 4)
    side, turn = _quaternion(a)
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *shape, 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, code, np.dtype(kind).itemsize * 8)
    struct.pack_into("<8f", head, 76, side, *np.linalg.norm(a[:3, :3], axis=0), 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    struct.pack_into("<2h", head, 252, *(c or 1 for c in codes))
    struct.pack_into("<6f", head, 256, *turn, *a[:3, 3])
    struct.pack_into("<12f", head, 280, *a[:3].ravel())
    head[344:348] = b"n+1\0"
    return bytes(head) + np.asarray(data).astype("<" + kind).tobytes()


def encode_like(data: np.ndarray, like: bytes, dtype: str = "f4") -> bytes:
    """A file of data on the grid of another one, whose affine and codes it keeps. Raises where the shapes differ."""
    h = header(_opened(like))
    if len(data) != int(np.prod(h.shape[:3])):
        raise ValueError(f"the data doesn't fit the shape {h.shape[:3]}")
    return encode(data, h.shape[:3], h.affine, dtype, (h.qform_code, h.sform_code))


def describe_files(spark: SparkSession, path: str, statistics: bool = False) -> DataFrame:
    """path, the fields of described(), and error where a file isn't one. Only a file's own row depends on it."""
    fields = f"{DESCRIPTION}, {STATISTICS}" if statistics else DESCRIPTION
    names = [f.split()[0] for f in fields.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for path, content in zip(pdf.path, pdf.content, strict=True):
                row = {"path": path, **dict.fromkeys(names), "error": None}
                try:
                    row |= described(bytes(content), statistics)
                except (ValueError, OSError, struct.error) as e:
                    row["error"] = str(e)
                out.append(row)
            yield pd.DataFrame(out, columns=["path", *names, "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"path string, {fields}, error string")


def read_volumes(spark: SparkSession, path: str, pattern: str = r"(sub-[^_/]+)_(?:space-([^_/]+)_)?.*?([A-Za-z0-9]+)\.nii(?:\.gz)?$") -> DataFrame:
    """VOLUMES of files, with subject, space and modality from their names, and error where a file can't be decoded."""
    import re

    name = re.compile(pattern)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for path, content in zip(pdf.path, pdf.content, strict=True):
                m = name.search(path)
                row = {"subject": m[1] if m else None, "modality": m[3] if m else None, "space": m[2] if m else None, "shape": None, "spacing": None, "affine": None, "data": None, "error": None}
                try:
                    row |= decode(bytes(content))
                except (ValueError, OSError, struct.error) as e:  # a bad file becomes a row that says so
                    row["error"] = str(e)
                out.append(row)
            yield pd.DataFrame(out)

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.mapInPandas(run, f"{VOLUMES}, error string")
