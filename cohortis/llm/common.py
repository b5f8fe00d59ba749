"""What several corpus operators share: shared folder, code shipping, written tables, byte-level words, components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session

#: Above this many rows a table is joined by shuffle instead of being broadcast.
BROADCAST_ROWS = 500_000
#: Bytes of an Arrow batch that goes to a Python worker. Counted in rows alone, a batch of long texts can be of any size.
BATCH_BYTES = 4 << 20
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> None:
    """What every operator with Python stages begins with: the package on the workers, and batches of bounded size (where
    the session leaves Spark's default)."""
    session.ship(spark)
    if spark.conf.get(_BATCH_KEY, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own if driver and
    executors are one process (tests); on a cluster, whose machines would each write to a disk of their own, it raises."""
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if told is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        told = getattr(sc, "_cohortis_dir", None)
        if told is None:
            told = f"file://{tempfile.mkdtemp(prefix='cohortis-shared-')}"
            sc._cohortis_dir = told
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(told)
    return told.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cohortis/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there and a lost executor costs nothing that was done."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_file(spark: SparkSession, parts: list, name: str) -> str:
    """Give every executor a file of the parts, one after another; the name to pass to opened_file(). The driver serves it from the session's own
    temporary folder, which goes when the session ends."""
    name = f"{name}-{uuid.uuid4().hex}"
    path = os.path.join(tempfile.mkdtemp(prefix="cohortis-", dir=spark.sparkContext._temp_dir), name)
    with open(path, "wb") as out:
        out.writelines(parts)
    spark.sparkContext.addFile(path)
    return name


def opened_file(name: str) -> str:
    return SparkFiles.get(name)


def about(df: DataFrame, key: str, most: int) -> DataFrame:
    """All rows, or where there are more than `most`, about so many: those whose key's hash falls into their share. Keys are
    to differ. The same rows at every run; no sort, and nothing on the driver but a count."""
    n = df.count()
    return df if n <= most else df.where(F.pmod(F.xxhash64(key), F.lit(n)) < most)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- words of many texts at once ------------------------------------------------------------------------------------

#: Odd, so it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = {}


def tidy(thorough: bool = True) -> None:
    """Hand free memory back to the system. A worker stays for later tasks, most of which need less than it has had.

    thorough: at the end of a task; else only what takes no longer than a millisecond or so, between batches.
    """
    import ctypes
    import gc

    import pyarrow as pa

    if thorough:
        _POWERS.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_table(extra: str = "") -> np.ndarray:
    """Byte -> byte: 0-9, a-z and bytes over 0x7F stay, A-Z become a-z, all others become 0 (between words)."""
    table = np.zeros(256, dtype=np.uint8)
    for b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
        table[b] = b
    for b in range(0x41, 0x5B):
        table[b] = b + 32
    for ch in extra:
        table[ord(ch)] = ord(ch)
    return table


class Words:
    """The words of a list of byte strings, found and hashed by whole-array operations.

    data: all texts folded by the table, with a 0 after each; start, end: of each word in data; doc: its text's index;
    code: its 64-bit hash.
    """

    def __init__(self, texts: list[bytes], table: np.ndarray):
        self.n = len(texts)
        data = table[np.frombuffer(b"\0".join([*texts, b""]), dtype=np.uint8)]
        ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=self.n) + 1)
        inside = np.zeros(len(data) + 2, dtype=np.int8)
        inside[1:-1] = data != 0
        change = np.flatnonzero(np.diff(inside))
        self.data, self.start, self.end = data, change[::2], change[1::2]
        self.doc = np.searchsorted(ends, self.start, side="right")
        self.first = np.searchsorted(self.doc, np.arange(self.n + 1))  # words of text i: first[i] .. first[i+1]
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=total[1:])
        code = (total[self.end] - total[self.start]) * powers(_INVERSE, len(data) + 1)[self.start]
        self.code = mixed(code + (self.end - self.start).astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word of every window of so many words of one text, and the window's hash."""
        n = len(self.code)
        if n < size:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        h = np.zeros(n - size + 1, dtype=np.uint64)
        for i in range(size):
            h = h * np.uint64(_BASE) + self.code[i : n - size + 1 + i]
        at = np.flatnonzero(self.doc[: n - size + 1] == self.doc[size - 1 :])
        return at, mixed(h[at])


#: Bytes of a piece of a long text.
PIECE = 1 << 20


def pieces(text: bytes, table: np.ndarray, overlap: int, most: int = PIECE) -> Iterator[tuple[int, int, int]]:
    """(begin, end, shared) of the pieces of a text, about `most` bytes each, cut between words by the table. A piece begins
    with the last `overlap` (at least 1) words of the one before, shared of them; the first shares none. A piece of too few
    words is made larger."""
    begin = shared = 0
    while True:
        size = most
        while begin + size < len(text):
            inside = table[np.frombuffer(text, dtype=np.uint8, count=size, offset=begin)] != 0
            gaps = np.flatnonzero(~inside)
            starts = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)) > 0)
            if len(gaps) and (whole := int(np.searchsorted(starts, gaps[-1]))) > 2 * overlap:
                break
            size *= 2
        else:
            yield begin, len(text), shared
            return
        yield begin, begin + int(gaps[-1]), shared
        begin, shared = begin + int(starts[whole - overlap]), overlap


def packed(arrays: list[np.ndarray]) -> list:
    """Arrays as the parts of one flat buffer that unpacked() maps: for each its type and length, then all of them, on
    8-byte places."""
    head = np.array([[ord(a.dtype.kind), a.dtype.itemsize, len(a)] for a in arrays], dtype="<i8")
    out = [np.array([len(arrays)], dtype="<i8").tobytes(), head.tobytes()]
    for a in arrays:
        out += [np.ascontiguousarray(a).view(np.uint8).data, b"\0" * (-a.nbytes % 8)]
    return out


def unpacked(data) -> list[np.ndarray]:
    n = int(np.frombuffer(data, dtype="<i8", count=1)[0])
    place, out = 8 + 24 * n, []
    for kind, size, count in np.frombuffer(data, dtype="<i8", count=3 * n, offset=8).reshape(n, 3).tolist():
        out.append(np.frombuffer(data, dtype=f"{chr(kind)}{size}", count=count, offset=place))
        place += -(-count * size // 8) * 8
    return out


def slices(texts: list[bytes], most: int = 1 << 20):
    """Runs (from, to) of texts of about so many bytes together, one text at least."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def text_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null: empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


# -- connected components -------------------------------------------------------------------------------------------


def connected_components(edges: DataFrame, left: str, right: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge of two different nodes: component is the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. 2014 until the edges stay as they are. Only
    DataFrame operations; a hub's neighbours are met by its minimum in an ordinary join, whose large partitions
    adaptive execution splits, and minima are aggregated before they are shuffled. Nulls and loops are no edges.
    """
    shared_dir(edges.sparkSession)
    u, v = F.col(left), F.col(right)
    now = edges.where(u != v).select(F.greatest(u, v).alias("hi"), F.least(u, v).alias("lo")).distinct().checkpoint()

    def sign(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(hi, lo))")).first())

    before = sign(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi != lo").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        met = large.join(low, "hi")
        small = met.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi != lo").union(low.select("hi", F.col("m").alias("lo"))).distinct()
        now = small.checkpoint()
        after = sign(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())
