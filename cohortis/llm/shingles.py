"""Near copies by exact Jaccard similarity of five-word shingles, retrieved by Golay keys of SimHashes and by MinHash bands.

Words stand between ASCII white space (or NUL) after A-Z are lower-cased; shingles are five words, and a text of fewer
is one shingle. Texts with the same set of shingles are one node, so copies, however many, cost one row.

Nodes whose SimHashes over these shingles differ in 4 bits or fewer are retrieved by the near keys of simhash.py. Four
bits of 64 are too few for a similarity of 0.8 (about ten differ there), and segments of so many errors have no near key
in common, so a node also has BANDS keys of ROWS minima each: two at the least similarity of 0.8 share one with a
probability of 1 - (1 - 0.8**5)**32 = 0.999997. What is retrieved is decided by the sets themselves, never by a key.

Pairs of a group that shares a key are not listed. Each group is compared with one of its members, and what that and
the SimHashes link becomes components. A group that still has several is dealt out in cells, each a block of rows
outside its largest component beside another block; a cell compares them in one task, as bits of the shingles they
share, and only a spanning forest of its links leaves it. So the components are those of all pairs that share a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE, LEAST, BANDS, ROWS = 5, 0.8, 32, 5
#: Rows, and shingles of them, that a block of a cell has, about. A cell has two blocks, and a row is never cut.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1 << 17
_FACTORS = np.random.default_rng(42).integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(b" \t\n\r\x0b\x0c")] = 0
    return table


def sets_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) of every different shingle of every text, in the order of both; a text without words has none."""
    words = common.Words(texts, _table())
    at, code = words.windows(SHINGLE)
    doc = words.doc[at]
    few = [i for i, n in enumerate(np.diff(words.first).tolist()) if 0 < n < SHINGLE]
    if few:
        own = []
        for i in few:
            h = np.zeros(1, dtype=np.uint64)
            for c in words.code[words.first[i] : words.first[i + 1]]:
                h = h * np.uint64(0x9E3779B97F4A7C15) + c
            own.append(common.mixed(h))
        doc, code = np.concatenate([doc, few]), np.concatenate([code, *own])
    order = np.lexsort((code, doc))
    doc, code = doc[order], code[order]
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (np.diff(doc) != 0) | (code[1:] != code[:-1])
    return doc[fresh], code[fresh]


def codes_of(text: bytes, most: int = common.PIECE) -> np.ndarray:
    """The different shingles of one text, in order. A long text is read in pieces that share four words."""
    if len(text) <= most:
        return sets_of([text])[1]
    found = []
    for begin, end, _ in common.pieces(text, _table(), SHINGLE - 1, most):
        found.append(np.unique(common.Words([text[begin:end]], _table()).windows(SHINGLE)[1]))
    codes = np.concatenate(found)
    del found
    if not len(codes):  # a few words, of which one at least is very long
        return sets_of([text])[1]
    codes.sort()
    fresh = np.ones(len(codes), dtype=bool)
    np.not_equal(codes[1:], codes[:-1], out=fresh[1:])
    return codes[fresh]


def _majorities(code: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """SimHashes of n sets: a bit is 1 if set in over half of the set's codes. owner: of each code its set."""
    out, bits = np.zeros(n, dtype=np.uint64), np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int32)
    total = np.bincount(owner, minlength=n)
    for byte in range(8):
        value = (code >> np.uint64(8 * byte) & np.uint64(255)).astype(np.int64)
        for begin in range(0, n, 4096):  # counts of 4,096 sets at a time
            own = slice(*np.searchsorted(owner, [begin, begin + 4096]))
            part = min(4096, n - begin)
            counts = np.bincount((owner[own] - begin) << 8 | value[own], minlength=part << 8).reshape(part, 256) @ bits
            high = np.packbits(2 * counts > total[begin : begin + part, None], axis=1, bitorder="little")[:, 0]
            out[begin : begin + part] |= high.astype(np.uint64) << np.uint64(8 * byte)
    return out


def sketches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the digest of its set, the set's size, its SimHash, and its keys (texts x BANDS). All 0 without words."""
    doc, code = sets_of(texts)
    size = np.bincount(doc, minlength=len(texts))
    node, keys = np.zeros(len(texts), dtype=np.uint64), np.zeros((len(texts), BANDS), dtype=np.uint64)
    prints = _majorities(code, doc, len(texts))
    some = np.flatnonzero(size)
    if len(some):
        begin = np.concatenate([[0], np.cumsum(size[some])[:-1]])
        node[some] = common.mixed(np.add.reduceat(common.mixed(code + np.uint64(0x632BE59BD9B4E019)), begin) + size[some].astype(np.uint64))
        short = (code >> np.uint64(32)).astype(np.uint32)
        for band in range(BANDS):
            h = np.full(len(some), band + 1, dtype=np.uint64)
            for factor in _FACTORS[band * ROWS : (band + 1) * ROWS]:
                h = common.mixed(h * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(short * factor, begin))
            keys[some, band] = h
    return node, size, prints, keys


def sketch_of_long(text: bytes, most: int = common.PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """sketches() of one text. Digest, bits and minima are added up over runs of the codes of its pieces."""
    codes, run = codes_of(text, most), max(1, most >> 3)
    n, total = len(codes), np.zeros(1, dtype=np.uint64)
    counts, least = np.zeros(64, dtype=np.int64), np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for begin in range(0, n, run):
        part = codes[begin : begin + run]
        total += common.mixed(part + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64, keepdims=True)
        counts += np.array([int(((part >> np.uint64(i)) & np.uint64(1)).sum()) for i in range(64)], dtype=np.int64)
        short = (part >> np.uint64(32)).astype(np.uint32)
        least = np.minimum(least, np.array([(short * f).min() for f in _FACTORS], dtype=np.uint32))
    prints = np.array([sum(1 << i for i in range(64) if 2 * counts[i] > n)], dtype=np.uint64)
    keys = np.zeros((1, BANDS), dtype=np.uint64)
    for band in range(BANDS if n else 0):
        h = np.full(1, band + 1, dtype=np.uint64)
        for minimum in least[band * ROWS : (band + 1) * ROWS]:
            h = common.mixed(h * np.uint64(0x9E3779B97F4A7C15) + minimum.astype(np.uint64))
        keys[0, band] = h[0]
    node = common.mixed(total + np.uint64(n)) if n else total
    return node, np.array([n]), prints, keys


def similarities(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """The Jaccard similarity of each pair of texts; 1 for two without words. A pair with a long text is compared by itself, from
    sets that are made piece by piece."""
    out = np.ones(len(left))
    long = [i for i, (a, b) in enumerate(zip(left, right, strict=True)) if max(len(a), len(b)) > common.PIECE]
    if long:
        short = [i for i in range(len(left)) if i not in set(long)]
        out[short] = similarities([left[i] for i in short], [right[i] for i in short])
        for i in long:
            a, b = codes_of(left[i]), codes_of(right[i])
            both = len(np.intersect1d(a, b, assume_unique=True))
            out[i] = both / max(1, len(a) + len(b) - both)
        return out
    for begin, end in common.slices([a + b for a, b in zip(left, right, strict=True)]):
        n = end - begin
        doc, code = sets_of([*left[begin:end], *right[begin:end]])
        pair = doc % n
        order = np.lexsort((code, pair))
        pair, code = pair[order], code[order]
        both = np.bincount(pair[1:][(np.diff(pair) == 0) & (code[1:] == code[:-1])], minlength=n)
        total = np.bincount(pair, minlength=n) - both
        out[begin:end] = np.where(total, both / np.maximum(total, 1), 1.0)
    return out


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node, size, print, keys of every row, written."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.text_bytes(batch.column(2))
            for begin, end in common.slices(texts):
                long = end - begin == 1 and len(texts[begin]) > common.PIECE
                node, size, prints, keys = sketch_of_long(texts[begin]) if long else sketches(texts[begin:end])
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(begin, end - begin) for i in (0, 1)), pa.array(node.view(np.int64)), pa.array(size.astype(np.int64)), pa.array(prints.view(np.int64)), lists], ["doc_id", "text_hash", "node", "size", "print", "keys"])
        common.tidy()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return common.written(rows.mapInArrow(run, "doc_id long, text_hash long, node long, size long, print long, keys array<long>"), "sketches")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose texts are so similar. texts: node, text."""

    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        out = pa.array(similarities(common.text_bytes(left), common.text_bytes(right)), pa.float64())
        common.tidy(thorough=False)
        return out

    met = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return met.where(F.arrow_udf(similar, "double")(F.col("text_a"), F.col("text_b")) >= least).select("a", "b")


def spanning_links(sets: list[np.ndarray], part: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs (i, j) of sets at a Jaccard similarity of `least` or more that, with the parts given, connect whatever all such
    pairs do. sets: the different codes of each, none of them empty."""
    size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    label = np.unique(part, return_inverse=True)[1]
    if not label.any():
        return []
    row = np.repeat(np.arange(len(sets)), size)
    _, code, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[code]  # a code of one set alone is in no intersection
    row, place = row[place >= 0], place[place >= 0]
    bits = np.zeros((len(sets), -(-int((counts > 1).sum()) // 64)), dtype=np.uint64)
    np.bitwise_or.at(bits, (row, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    # Members of one component, the largest, never begin: a missing link has an end outside it.
    favourite, links = int(np.argmax(np.bincount(label))), []
    for i in range(len(sets)):
        if label[i] == favourite:
            continue
        others = np.flatnonzero((label != label[i]) & (np.minimum(size, size[i]) / np.maximum(size, size[i]) >= least))
        both = np.bitwise_count(bits[others] & bits[i]).sum(axis=1, dtype=np.int64)
        near = others[both / (size[others] + size[i] - both) >= least]
        for other, first in zip(*np.unique(label[near], return_index=True), strict=True):
            links.append((i, int(near[first])))
            mine = favourite if other == favourite else label[i]
            label[(label == label[i]) | (label == other)] = mine
    return links


def _cells(mixed: DataFrame) -> DataFrame:
    """Rows (key, node, part) of groups of several components -> (key, i, j, node, part): each row in all cells it belongs to.

    mixed: key, node, size, part. Block i of the rows outside a group's largest component meets each block of those
    inside (j >= 0), and each other block of those outside (j < 0). Rows are dealt to blocks by a hash.
    """
    sizes = mixed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    tops = sizes.groupBy("key").agg(F.max(F.struct("n", "part", "s")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > top.n")
    blocks = lambda n, s: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(s / BLOCK_SHINGLES), F.lit(1).cast("long"))
    tops = tops.select("key", F.col("top.part").alias("top"), blocks(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("out"), blocks(F.col("top.n"), F.col("top.s")).alias("in"))
    met = mixed.join(tops, "key")
    inside = F.col("part") == F.col("top")
    met = met.withColumn("own", F.pmod(F.xxhash64("key", "node"), F.when(inside, F.col("in")).otherwise(F.col("out"))))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    cell = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    as_top = F.transform(upto("out"), lambda i: cell(i, F.col("own")))
    beside = F.transform(F.filter(upto("out"), lambda j: j != F.col("own")), lambda j: cell(F.least("own", j), -F.greatest("own", j)))
    as_other = F.concat(F.transform(upto("in"), lambda j: cell(F.col("own"), j)), beside)
    return met.select("key", "node", "part", F.explode(F.when(inside, as_top).otherwise(as_other)).alias("cell")).select("key", "cell.i", "cell.j", "node", "part")


def _linked_in_cells(cells: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that each cell's comparisons find. cells: key, i, j, node, part, codes (the set as binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            node, part = (np.concatenate([h.column(i).to_numpy() for h in held]) for i in (3, 4))
            sets = [np.frombuffer(x, dtype=np.uint64) for h in held for x in h.column(5).to_pylist()]
            pairs = node[np.array(spanning_links(sets, part, least), dtype=np.int64).reshape(-1, 2)]
            return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["a", "b"])

        for batch in batches:
            name = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((np.diff(name, axis=0) != 0).any(axis=1)) + 1).tolist(), len(name)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and tuple(name[a]) != now:
                    yield done()
                    held = []
                now = tuple(name[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield done()
        del held
        common.tidy()

    rows = cells.select("key", "i", "j", "node", "part", "codes").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(run, "a long, b long").distinct()


def _sets(texts: DataFrame) -> DataFrame:
    """node, codes of rows (node, text): the different shingles, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = common.text_bytes(batch.column(1))
            for begin, end in common.slices(raw):
                if end - begin == 1 and len(raw[begin]) > common.PIECE:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, 1), pa.array([codes_of(raw[begin]).tobytes()], pa.binary())], ["node", "codes"])
                    continue
                doc, code = sets_of(raw[begin:end])
                cuts = np.searchsorted(doc, np.arange(end - begin + 1))
                codes = pa.array([code[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), codes], ["node", "codes"])
        common.tidy()

    return texts.select("node", "text").mapInArrow(run, "node long, codes binary")


def components(docs: DataFrame, rows: DataFrame, near: Callable[[DataFrame], DataFrame], least: float = LEAST) -> DataFrame:
    """node, component of the nodes that links at `least` or more join; nodes without links are left out.

    rows: sketched(docs). near: links (a, b) between the nodes of rows (node, print), each print once.
    """
    each = rows.where("size > 0").groupBy("node").agg(F.min(F.struct("text_hash", "size", "print", "keys")).alias("s")).select("node", "s.*")
    each = common.written(each, "nodes")
    prints = common.written(each.groupBy("print").agg(F.min("node").alias("node")), "prints")
    alike = lambda x, y: F.least(x, y) / F.greatest(x, y) >= least  # noqa: E731 - no pair is more similar than its sizes are
    close = each.select("print", F.col("node").alias("b")).join(prints, "print").where("b <> node").select(F.col("node").alias("a"), "b")
    close = common.written(close.union(near(prints)), "close")
    keyed = each.select("node", "size", F.explode("keys").alias("key"))
    groups = keyed.groupBy("key").agg(F.min(F.struct("node", "size")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first")
    bands = common.written(keyed.join(groups, "key"), "bands")
    # The texts of nodes that something is retrieved for.
    wanted = bands.select("node").union(close.select("a")).union(close.select("b")).distinct().join(each.select("node", "text_hash"), "node")
    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(wanted, "text_hash").dropDuplicates(["node"]).select("node", "text")
    texts = common.written(texts, "texts")
    firsts = bands.where((F.col("node") != F.col("first.node")) & alike(F.col("size"), F.col("first.size"))).select(F.col("first.node").alias("a"), F.col("node").alias("b"))
    pairs = close.union(firsts).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = common.written(_verified(pairs, texts, least), "links")
    named = bands.select("key", "node", "size").join(common.connected_components(links, "a", "b"), "node", "left")
    named = named.select("key", "node", "size", F.coalesce("component", "node").alias("part"))
    several = named.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    mixed = common.written(named.join(several, "key"), "mixed")
    sets = common.written(_sets(texts.join(mixed.select("node").distinct(), "node", "left_semi")), "sets")
    more = common.written(_linked_in_cells(_cells(mixed).join(sets, "node"), least), "more-links")
    return common.connected_components(links.union(more), "a", "b")
