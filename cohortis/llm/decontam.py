"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, scanned over the training texts.

Words are maximal runs of 0-9, a-z and non-ASCII bytes after A-Z are lower-cased. A window is `size` consecutive words
of an item; an item of fewer words, but not none, is one window. Training texts are scanned window by window with
rolling hashes, very long ones in overlapping pieces; a hit counts only once its words are found equal. The set is one
file of sorted arrays, some 40 bytes a window, that all workers of a machine map. Benchmarks beyond the bound are
joined by shuffle instead, with the same result.
"""

from __future__ import annotations

import hashlib
import mmap
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from . import common

SIZE = 10
#: Above so many UTF-8 bytes of benchmark text, nothing of it is collected or broadcast.
BROADCAST_BYTES = 64 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("item_ids", ArrayType(LongType())), StructField("spans", ArrayType(ArrayType(IntegerType())))])


class WindowSet:
    """Every window of the benchmark in flat arrays, which workers map from one file.

    text: the items' words, one space between. For each number of words (longest first) the different windows by
    ascending hash: hash, begin and end in text, and where their items' numbers begin in `owner`; bits: which low hash
    bits occur. ids, has_id: of each item.
    """

    def __init__(self, data):
        self.text, self.ids, self.has_id, sizes, *rest = common.unpacked(data)
        self.by_size = {int(k): rest[6 * i : 6 * i + 6] for i, k in enumerate(sizes)}
        self.longest = max(self.by_size, default=1)

    @classmethod
    def packed(cls, ids: list, texts: list[bytes], size: int = SIZE) -> list:
        """The parts of the flat buffer, for texts under 2 GB. Memory is some 60 bytes for each window beside the texts."""
        table, text, length = common.word_table(), [], 0
        found: dict[int, list[list[np.ndarray]]] = {}
        for first, last in common.slices(texts):
            words = common.Words(texts[first:last], table)
            # The words with one space between any two, and where each lies then.
            kept = words.data != 0
            kept[words.end] = True
            flat = np.where(words.data == 0, np.uint8(32), words.data)[kept]
            long = words.end - words.start
            begin = length + np.cumsum(long + 1) - long - 1
            text.append(flat)
            length += len(flat)
            few = np.minimum(np.diff(words.first), size)
            for k in np.unique(few[few > 0]).tolist():
                at, code = words.windows(k)
                own = few[words.doc[at]] == k
                at, code = at[own], code[own]
                second = np.zeros(len(at), dtype=np.uint64)  # another hash, so that windows of one code stay apart
                for i in range(k):
                    second = common.mixed(second + words.code[at + i])
                last_word = at + k - 1
                parts = [code, second, begin[at], begin[last_word] + long[last_word], first + words.doc[at]]
                found.setdefault(k, []).append([x.astype(np.int32) if i > 1 else x for i, x in enumerate(parts)])
        sizes, arrays = sorted(found, reverse=True), []
        for k in sizes:
            columns = [*zip(*found.pop(k), strict=True)]
            code, second = np.concatenate(columns[0]), np.concatenate(columns[1])
            columns[:2] = [(), ()]
            order = np.lexsort((second, code)).astype(np.int32)  # stable: items stay ascending
            code = code[order]
            fresh = np.ones(len(code), dtype=bool)
            fresh[1:] = code[1:] != code[:-1]
            fresh[1:] |= np.diff(second[order]) != 0
            del second
            owners = np.concatenate([np.flatnonzero(fresh), [len(code)]]).astype(np.int32)
            bits = np.zeros(min(1 << 26, max(1 << 20, 1 << (4 * len(code) - 1).bit_length())), dtype=np.uint8)
            bits[(code & np.uint64(len(bits) - 1)).astype(np.int32)] = 1
            placed = []
            for i in (2, 3, 4):
                column = np.concatenate(columns[i])
                columns[i] = ()
                placed.append(column[order] if i == 4 else column[order[fresh]])
            arrays += [bits, code[fresh], *placed[:2], owners, placed[2]]
            del code, order, placed
        return common.packed([np.concatenate(text) if text else np.zeros(0, dtype=np.uint8), np.array([x or 0 for x in ids], dtype=np.int64), np.array([x is not None for x in ids], dtype=np.uint8), np.array(sizes, dtype=np.int64), *arrays])

    def scan(self, words: common.Words) -> tuple[np.ndarray, list[set]]:
        """Which words are hit, and the numbers of each text's items."""
        hit, items = np.zeros(len(words.start) + 1, dtype=np.int64), [set() for _ in range(words.n)]
        for size, (bits, codes, begins, ends, owners, owner) in self.by_size.items():
            at, code = words.windows(size)
            maybe = np.flatnonzero(bits[(code & np.uint64(len(bits) - 1)).astype(np.int64)])
            left, right = np.searchsorted(codes, code[maybe]), np.searchsorted(codes, code[maybe], side="right")
            for i in np.flatnonzero(left < right).tolist():
                first = int(at[maybe[i]])
                text = b" ".join(words.word(j) for j in range(first, first + size))
                for j in range(left[i], right[i]):
                    if self.text[begins[j] : ends[j]].tobytes() == text:
                        hit[first] += 1
                        hit[first + size] -= 1
                        items[words.doc[first]].update(owner[owners[j] : owners[j + 1]].tolist())
                        break
        return np.cumsum(hit[:-1]) > 0, items

    def named(self, items: set) -> list:
        """The items' different ids, ascending; None last where one has no id."""
        return [*sorted({int(self.ids[i]) for i in items if self.has_id[i]}), *([None] if any(not self.has_id[i] for i in items) else [])]


_SETS: dict[str, WindowSet] = {}


def window_set(name: str) -> WindowSet:
    """The set in a file that local_file() sent, mapped once for each worker."""
    if name not in _SETS:
        _SETS.clear()
        with open(common.opened_file(name), "rb") as file:
            _SETS[name] = WindowSet(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))
    return _SETS[name]


def _sent(items: DataFrame, size: int) -> str:
    """The file with the windows of rows (item_id, text), under the bound."""
    got = items.select("item_id", "text").toArrow().combine_chunks()
    texts = [t for chunk in got.column(1).chunks for t in common.text_bytes(chunk)]
    return common.local_file(items.sparkSession, WindowSet.packed(got.column(0).to_pylist(), texts, size), "windows")


def _runs(at: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[list[int]]:
    """Begin and end of each run of words that follow one another. at: the words' numbers, ascending."""
    if not len(at):
        return []
    edge = np.flatnonzero(np.diff(at) != 1)
    first, last = np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(at) - 1]])
    return np.stack([start[first], end[last]], axis=1).tolist()


def _scan_long(known: WindowSet, table: np.ndarray, text: bytes, most: int):
    """As _scan_batches for one text, in pieces that overlap by a window less one word: memory is that of a piece."""
    n, items, parts = 0, set(), [np.zeros((0, 3), dtype=np.int64)]
    for a, b, shared in common.pieces(text, table, max(1, known.longest - 1), most):
        words = common.Words([text[a:b]], table)
        hit, own = known.scan(words)
        at = np.flatnonzero(hit)
        parts.append(np.stack([at + n - shared, words.start[at] + a, words.end[at] + a], axis=1))
        n += len(words.start) - shared
        items |= own[0]
    every = np.unique(np.concatenate(parts), axis=0)
    return n, len(every), known.named(items), _runs(*every.T)


def _scan_batches(known: WindowSet, table: np.ndarray, texts: list[bytes], most: int = 1 << 20):
    """(n_words, n_hit, items, spans) of each text; spans: begin and end of each run of hit words, in UTF-8 bytes."""
    for begin, end in common.slices(texts, most):
        if len(texts[begin]) > most:
            yield _scan_long(known, table, texts[begin], most)
            begin += 1
            if begin == end:
                continue
        words = common.Words(texts[begin:end], table)
        hit, items = known.scan(words)
        total = np.concatenate([[0], np.cumsum(hit)])
        offset = 0
        for i in range(words.n):
            a, b = words.first[i], words.first[i + 1]
            n_hit = int(total[b] - total[a])
            at = a + np.flatnonzero(hit[a:b]) if n_hit else np.zeros(0, dtype=np.int64)
            yield int(b - a), n_hit, known.named(items[i]), _runs(at, words.start[at] - offset, words.end[at] - offset)
            offset += len(texts[begin + i]) + 1


def benchmark_bytes(benchmark: DataFrame, text_col: str = "text") -> int:
    return benchmark.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]


def scan(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, broadcast_bytes: int = BROADCAST_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted), spans (begin and end of each run of hit words, in UTF-8 bytes).

    A null text has no words; repeated rows are each judged; an empty benchmark hits nothing; items without an id hit like
    any other and are one null, the last, among item_ids; other columns are ignored. No shuffle of documents while the
    benchmark is under broadcast_bytes.
    """
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    if benchmark_bytes(items) > broadcast_bytes:
        return _scan_by_join(rows.withColumn("row", F.monotonically_increasing_id()), items, size).drop("row")
    name = _sent(items, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = common.word_table()
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32()))]
        for batch in batches:
            got = [*zip(*_scan_batches(window_set(name), table, common.text_bytes(batch.column(1))), strict=True)] or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(got, kinds, strict=True))], SCHEMA.names)
        common.tidy()

    return rows.mapInArrow(run, SCHEMA)


def _scan_by_join(rows: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """scan() without a broadcast, and with the column row: windows of both sides meet by their words. For benchmarks of any size.

    rows: row, doc_id, text. Each row has a number of its own, so repeated ids stay apart. The windows of one length are
    joined by their words; a very common window is a skewed join, which adaptive execution splits.
    """
    words = lambda c: F.regexp_extract_all(common.ascii_lower(F.coalesce(c, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))
    cut = items.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0").withColumn("k", F.least(F.size("w"), F.lit(size)))
    wanted = cut.select("item_id", "k", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1), lambda i: F.concat_ws(" ", F.slice("w", i, F.col("k"))))).alias("window")).distinct()
    sizes = sorted(r.k for r in wanted.select("k").distinct().collect())  # size lengths at most
    docs = common.written(rows.select("row", "doc_id", "text", words(F.col("text")).alias("w")), "words")
    cut_in = lambda k: F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.concat_ws(" ", F.slice("w", i, F.lit(k))))
    hits = None
    for k in sizes:
        windows = docs.where(F.size("w") >= k).select("row", F.posexplode(cut_in(k)).alias("at", "window"))
        got = windows.join(wanted.where(F.col("k") == k), "window").select("row", "at", "k", "item_id")
        hits = got if hits is None else hits.union(got)
    base = docs.select("row", "doc_id", F.size("w").cast("long").alias("n_words"))
    none = F.array().cast("array<array<int>>")
    if hits is None:
        return base.select("row", "doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<long>").alias("item_ids"), none.alias("spans"))
    hits = common.written(hits, "hits")
    at = hits.select("row", F.explode(F.sequence("at", F.col("at") + F.col("k") - 1)).alias("at")).distinct().groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("at"))
    placed = at.join(docs.select("row", "text"), "row").select("row", F.size("at").cast("long").alias("n_hit"), _spans_udf()(F.col("text"), F.col("at")).alias("spans"))
    ids = F.sort_array(F.collect_list("item_id"))  # without nulls
    named = hits.select("row", "item_id").distinct().groupBy("row").agg(F.when(F.bool_or(F.col("item_id").isNull()), F.concat(ids, F.array(F.lit(None).cast("long")))).otherwise(ids).alias("item_ids"))
    return base.join(placed, "row", "left").join(named, "row", "left").select("row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("spans", none).alias("spans"))


def _spans_udf():
    """An Arrow function of a text and the sorted numbers of its hit words: begin and end of each run of them, in UTF-8 bytes."""

    def spans(texts: pa.Array, at: pa.Array) -> pa.Array:
        table, out = common.word_table(), []
        for text, hit in zip(common.text_bytes(texts), at.to_pylist(), strict=True):
            hit, n, parts = np.array(hit), 0, []
            for a, b, shared in common.pieces(text, table, 1):
                words = common.Words([text[a:b]], table)
                own = hit[np.searchsorted(hit, n) : np.searchsorted(hit, n - shared + len(words.start))]
                parts.append(np.stack([own, words.start[own - n + shared] + a, words.end[own - n + shared] + a], axis=1))
                n += len(words.start) - shared
            out.append(_runs(*np.concatenate(parts).T))
        common.tidy(thorough=False)
        return pa.array(out, pa.list_(pa.list_(pa.int32())))

    return F.arrow_udf(spans, "array<array<int>>")


def item_digest(ids: list) -> str:
    """SHA-256 of the ids, sorted as strings and joined by commas."""
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


@dataclass(frozen=True)
class Cleaner:
    """Judges texts in place, so that a pipeline keeps its rows without a shuffle. Made by cleaner()."""

    name: str

    def hit_share(self):
        """An Arrow function of a text: the share of its words that are hit (0 where there are none)."""
        name = self.name

        def share(texts: pa.Array) -> pa.Array:
            out = pa.array([h / n if n else 0.0 for n, h, _, _ in _scan_batches(window_set(name), common.word_table(), common.text_bytes(texts))], pa.float64())
            common.tidy(thorough=False)
            return out

        return F.arrow_udf(share, "double")

    def without_spans(self):
        """An Arrow function of a text: the text without its hit spans (a null text stays null)."""
        name = self.name

        def cleaned(texts: pa.Array) -> pa.Array:
            return _cut(texts, [spans for _, _, _, spans in _scan_batches(window_set(name), common.word_table(), common.text_bytes(texts))])

        return F.arrow_udf(cleaned, "string")


def _cut(texts: pa.Array, spans: list) -> pa.Array:
    """The texts without their spans; null stays null."""
    out = []
    for text, is_text, own in zip(common.text_bytes(texts), texts.is_valid().to_pylist(), spans, strict=True):
        parts, at = [], 0
        for begin, end in own or []:
            parts.append(text[at:begin])
            at = end
        out.append(b"".join([*parts, text[at:]]) if is_text else None)
    return pa.array(out, pa.binary()).cast(pa.string())


def cleaner(benchmark: DataFrame, size: int = SIZE, broadcast_bytes: int = BROADCAST_BYTES) -> Cleaner | None:
    """A Cleaner for a benchmark under the bound, else None: then by a join."""
    spark = benchmark.sparkSession
    common.ship(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    if benchmark_bytes(items) > broadcast_bytes:
        return None
    return Cleaner(_sent(items, size))


def _numbered(docs: DataFrame, benchmark: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """docs, written with a number for each row, and what a join finds in them by that number."""
    common.ship(docs.sparkSession)
    rows = common.written(docs.withColumn("__cohortis_row", F.monotonically_increasing_id()), "rows")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    found = _scan_by_join(rows.select(F.col("__cohortis_row").alias("row"), F.lit(None).cast("long").alias("doc_id"), "text"), items, size)
    return rows, found.where("n_hit > 0").select(F.col("row").alias("__cohortis_row"), (F.col("n_hit") / F.col("n_words")).alias("__cohortis_share"), F.col("spans").alias("__cohortis_spans"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, most_share: float = 0.0, size: int = SIZE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs without those of which more than most_share of the words are hit; columns stay. Null texts are kept."""
    if (judge := cleaner(benchmark, size, broadcast_bytes)) is not None:
        return docs.where(judge.hit_share()(F.col("text")) <= most_share)
    rows, found = _numbered(docs, benchmark, size)
    return rows.join(found.where(F.col("__cohortis_share") > most_share), "__cohortis_row", "left_anti").select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with the hit spans cut out of the texts."""
    if (judge := cleaner(benchmark, size, broadcast_bytes)) is not None:
        return docs.withColumn("text", judge.without_spans()(F.col("text")))
    rows, found = _numbered(docs, benchmark, size)
    cut = F.arrow_udf(lambda texts, spans: _cut(texts, spans.to_pylist()), "string")
    return rows.join(found, "__cohortis_row", "left").withColumn("text", F.when(F.col("__cohortis_spans").isNull(), F.col("text")).otherwise(cut(F.col("text"), F.col("__cohortis_spans")))).select(*docs.columns)
