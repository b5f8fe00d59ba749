"""Token ids in binary shards: independent zstandard frames, a document index, and a trailing seek table.

A shard follows the published zstandard seekable format, so any zstandard reader can decompress it as one stream:

    frame ... frame    each holds the ids of some consecutive documents, little-endian, 2 bytes wide for up to 65,536
                       ids and else 4; a document never spans frames; each frame has zstandard's own content checksum
    index              a skippable frame (0x184D2A50): width (1 byte), count (8 bytes), then for each document
                       has_id u1, doc_id i8, frame u4, begin u8 (in ids from the frame's start), n_tokens u8
    seek table         the skippable frame 0x184D2A5E: for each frame, the index too, compressed size, decompressed size
                       and the low 32 bits of XXH64 over the decompressed bytes; then frame count, flags, 0x8F92EAB1

A reader takes the last 9 bytes, the seek table, the index, and then only the frames that hold the documents asked
for. A task writes shards of bounded size, each under a name of its own; the manifest, a Parquet table, names the shards
of the attempts that succeeded and their least and greatest ids, so a repeated or lost task leaves at most files that no
manifest names, and a reader opens only shards that can hold what it wants.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .pieces import encoder

SEEK_MAGIC, INDEX_MAGIC, SEEKABLE = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
INDEX = np.dtype([("has_id", "u1"), ("doc_id", "<i8"), ("frame", "<u4"), ("begin", "<u8"), ("n_tokens", "<u8")])
#: A frame is closed once it holds so many bytes of ids.
FRAME_BYTES = 128 << 10
#: A shard is closed once it has so many bytes or documents.
SHARD_BYTES, SHARD_DOCS = 256 << 20, 1 << 20
#: shard: the task's number << 24 and the shard's number in the task, so shards are in the order of ids.
MANIFEST = "shard long, path string, n_docs long, n_tokens long, width int, n_bytes long, least_id long, greatest_id long, null_ids long"


def _opened(path: str):
    """The file system of a URI or an absolute path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class ShardWriter:
    """Writes one shard to a binary stream, front to back."""

    def __init__(self, stream, width: int, level: int = 3):
        import zstandard

        self.stream, self.width = stream, width
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple] = []
        self.indexed: list[np.ndarray] = []  # what the list held, packed every 65,536 documents
        self.held: list[bytes] = []
        self.size = self.n_tokens = self.n_bytes = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.width
        self.index.append((doc_id is not None, doc_id or 0, len(self.frames), self.size // self.width, n))
        if len(self.index) == 1 << 16:
            self.pack()
        self.held.append(ids)
        self.size += len(ids)
        self.n_tokens += n
        if self.size >= FRAME_BYTES:
            self.close_frame()

    def pack(self) -> None:
        self.indexed.append(np.array(self.index, dtype=INDEX))
        self.index = []

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.n_bytes += len(data)

    def close_frame(self) -> None:
        import xxhash

        if self.held:
            raw = b"".join(self.held)
            packed = self.zstd.compress(raw)
            self.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.held, self.size = [], 0

    def close(self) -> None:
        import xxhash

        self.close_frame()
        self.pack()
        self.documents = np.concatenate(self.indexed)
        body = struct.pack("<BQ", self.width, len(self.documents)) + self.documents.tobytes()
        self.write(struct.pack("<II", INDEX_MAGIC, len(body)) + body)
        entries = [*self.frames, (len(body) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        table = np.array(entries, dtype="<u4").tobytes() + struct.pack("<IBI", len(entries), 0x80, SEEKABLE)
        self.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class ShardReader:
    """Reads a shard by position: its tail first, then only the frames that are needed. Damage raises ValueError."""

    def __init__(self, file):
        import zstandard

        self.file, size = file, file.size()
        self.zstd = zstandard.ZstdDecompressor()
        n, flags, magic = struct.unpack("<IBI", self.at(size - 9, 9))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the shard")
        table = self.at(size - 9 - 12 * n, 12 * n)
        self.frames = np.frombuffer(table, dtype="<u4").reshape(n, 3)
        self.places = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        if self.places[-1] + 8 + 12 * n + 9 != size:
            raise ValueError("the seek table doesn't fit the shard's size")
        body = self.at(int(self.places[-2]), int(self.frames[-1, 0]))
        magic, _, self.width, count = struct.unpack("<IIBQ", body[:17])
        if magic != INDEX_MAGIC:
            raise ValueError("no document index before the seek table")
        self.index = np.frombuffer(body, dtype=INDEX, count=count, offset=17)

    def at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        data = self.file.read(size)
        if len(data) != size:
            raise ValueError("the shard ends early")
        return data

    def frame(self, k: int) -> bytes:
        """Frame k decompressed, once its size and checksum are found right."""
        import xxhash

        raw = self.zstd.decompress(self.at(int(self.places[k]), int(self.frames[k, 0])))
        if len(raw) != self.frames[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self, wanted: set | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, place of its first id in the shard, ids as bytes) in order; wanted: only these, and their frames."""
        begin = np.concatenate([[0], np.cumsum(self.index["n_tokens"], dtype=np.int64)])
        held, raw = -1, b""
        for i, (has, doc, frame, first, n) in enumerate(self.index.tolist()):
            doc = doc if has else None
            if wanted is None or doc in wanted:
                if n and frame != held:
                    held, raw = frame, self.frame(frame)
                yield doc, int(begin[i]), raw[first * self.width : (first + n) * self.width] if n else b""


def write_token_shards(docs: DataFrame, tokenizer_path: str, out: str | None = None, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Encode every whole text and write shards in ascending id order; returns the manifest (MANIFEST), read back.

    The ids of a text are those of the tokenizers library with add_special_tokens=False, and end_id after them unless
    None. A null text counts as empty; rows of one id keep together, ordered by a hash of the text; a null id comes first.
    Other columns are ignored. An empty table gives an empty manifest. out is a folder URI that executors can write to;
    default: a new one in the shared folder. One range shuffle by id, then by the text's hash and the part of the input a
    row comes from, so that an id, or a row, that is repeated any number of times is dealt to several tasks. A task streams
    its rows into shards and closes one at shard_bytes or shard_docs.
    """
    spark = docs.sparkSession
    common.ship(spark)
    out = out or common.fresh_path(spark, "tokens")
    told = spark.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())  # a vocabulary, a few MB

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(told.value)
        tail = b"" if end_id is None else known.packed([end_id])
        part, system, top = TaskContext.get().partitionId(), None, None
        path = writer = stream = None
        done: list[dict] = []

        def close() -> None:
            writer.close()
            stream.close()
            own = writer.documents["doc_id"][writer.documents["has_id"] == 1]
            done.append({"shard": part << 24 | len(done), "path": f"{out}/{path}", "n_docs": len(writer.documents), "n_tokens": writer.n_tokens, "width": writer.width, "n_bytes": writer.n_bytes, "least_id": int(own.min()) if len(own) else None, "greatest_id": int(own.max()) if len(own) else None, "null_ids": len(writer.documents) - len(own)})

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    if system is None:
                        system, top = _opened(out)
                        system.create_dir(top, recursive=True)
                    path = f"shard-{part:06d}-{len(done):06d}-{uuid.uuid4().hex}.zst"
                    stream = system.open_output_stream(f"{top}/{path}", compression=None)
                    writer, n = ShardWriter(stream, known.type.itemsize), 0
                writer.add(doc, known.encode(text.as_py() or "") + tail)
                n += 1
                if n >= shard_docs or writer.n_bytes >= shard_bytes:
                    close()
                    writer = None
        if writer is not None:
            close()
        if done:
            kinds = {"path": pa.string(), "width": pa.int32()}
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([(c, kinds.get(c, pa.int64())) for c in done[0]]))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"), F.spark_partition_id().alias("part"))
    dealt = rows.repartitionByRange("doc_id", "hash", "part").sortWithinPartitions("doc_id", "hash").select("doc_id", "text")
    return common.written(dealt.mapInArrow(shard, MANIFEST), "manifest")


def read_token_shards(spark: SparkSession, manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary: little-endian unsigned 32-bit), in shard order.

    One task reads one shard, frame by frame, and checks every frame it opens. wanted: only these documents (None: those
    without an id); shards that can't hold one are not opened, and other frames not read. Works on any manifest of
    write_token_shards, an empty one too.
    """
    common.ship(spark)
    ids = sorted({x for x in wanted or [] if x is not None})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                system, path = _opened(row["path"])
                with system.open_input_file(path) as file:
                    reader = ShardReader(file)
                    kind, held, size = np.dtype(f"<u{reader.width}"), [], 0
                    for doc, place, ids in reader.documents(None if wanted is None else {*wanted}):
                        wide = np.frombuffer(ids, dtype=kind).astype("<u4").tobytes()
                        held.append({"doc_id": doc, "start": row["start"] + place, "n_tokens": len(wide) // 4, "ids": wide})
                        size += len(wide)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)

    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    n = max(1, manifest.count())
    # The manifest has a row for each shard, so this window is as small as a list of files.
    placed = manifest.select("shard", "path", F.coalesce(before, F.lit(0)).alias("start"), "least_id", "greatest_id", "null_ids")
    if wanted is not None:
        within = F.exists(F.array(*map(F.lit, ids)).cast("array<long>"), lambda x: x.between(F.col("least_id"), F.col("greatest_id")))
        placed = placed.where((F.lit(None in wanted) & (F.col("null_ids") > 0)) | F.coalesce(within, F.lit(False)))
    placed = placed.repartitionByRange(min(n, 20_000), "shard")
    return placed.select("path", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
