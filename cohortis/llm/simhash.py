"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint's 64 bits are three segments, A and B of 23 bits and C of 18. The binary Golay code of length 23 is
perfect: every 23-bit word is within 3 bits of exactly one of 4,096 codewords. A segment's *near keys* are the
codewords decoded from it and from each word one bit away, 1 or 6 in all; segments 2 bits apart or less have a near
key in common, as they share a word within one bit of both. Fingerprints link at 4 bits apart or less. Pigeonhole
over the three segments' errors a + b + c <= 4 leaves these cases, each a table of keys:

    a <= 2 and b <= 2         near keys of A and of B
    a >= 3, so b + c <= 1     C itself with near keys of B, or B itself with near keys of C
    b >= 3, so a + c <= 1     C itself with near keys of A, or A itself with near keys of C

so every link shares a key in some table. Rows are grouped by key, pairs in a group are verified by their bits, and
only a spanning forest of the links leaves a group: the number of links never grows with the square of a group. Groups
over BLOCK rows are dealt out as pairs of blocks, all of them, so no group, however large, is one task's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, shingles

SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: Rows of a group before it is dealt out in pairs of blocks.
BLOCK = 8192
#: Most keys that may be told to every task as large; with more, blocks are doubled.
MOST_LARGE = 1_000_000
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, which generates the Golay code


# -- fingerprints ----------------------------------------------------------------------------------------------------

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BITS = None


def _words_table() -> np.ndarray:
    """Byte -> nonzero, but for the white space between words."""
    table = np.ones(256, dtype=np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = 0
    return table


def _set_bits(words: list[bytes]) -> np.ndarray:
    """For each bit the number of shingles of the words whose hash has it set."""
    import xxhash

    global _BITS
    digest, n = xxhash.xxh64_digest, len(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1)
    joined = b" ".join(words)
    begins = [0, *ends[: n - SHINGLE].tolist()]
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(begins, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)])
    if _BITS is None:
        _BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
    each = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8)
    counts = np.empty(64, dtype=np.int64)
    for i in range(8):
        counts[8 * i : 8 * i + 8] = np.bincount(each[:, i], minlength=256) @ _BITS
    return counts


def fingerprint(text: bytes, most: int = common.PIECE) -> int:
    """SimHash of a text in UTF-8: A-Z lower-cased, words between ASCII white space, XXH64 (seed 42) of each run of four
    words, repeats included; fewer words: the whole sequence; none: 0. A bit is 1 if set in over half the hashes. Longer
    texts are read in pieces of about `most` bytes that share three words, and their counts added."""
    import xxhash

    counts, total = np.zeros(64, dtype=np.int64), 0
    for begin, end, _ in common.pieces(text, _words_table(), SHINGLE - 1, most) if len(text) > most else [(0, len(text), 0)]:
        words = text[begin:end].translate(_LOWER).split()
        if len(words) < SHINGLE:
            if not begin:
                return int.from_bytes(xxhash.xxh64_digest(b" ".join(words), SEED), "big") if words else 0
            continue  # only what the piece before has had
        counts += _set_bits(words)
        total += len(words) - SHINGLE + 1
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_udf():
    """An Arrow function of a text: its fingerprint as a long. A null text counts as empty."""

    def of(texts: pa.Array) -> pa.Array:
        out = pa.array([signed(fingerprint(x)) for x in common.text_bytes(texts)], pa.int64())
        common.tidy(thorough=False)
        return out

    return F.arrow_udf(of, "long")


# -- keys ------------------------------------------------------------------------------------------------------------


class Golay:
    """Decoding of 23-bit words to the 12 data bits of the nearest codeword."""

    def __init__(self):
        self.low, self.high = self.syndromes(np.arange(1 << 12)), self.syndromes(np.arange(1 << 11) << 12)
        leaders = np.zeros(1 << 11, dtype=np.int64)
        bits = 1 << np.arange(23)
        for i in range(23):
            leaders[self.syndrome(np.array([bits[i]]))] = bits[i]
            for j in range(i):
                leaders[self.syndrome(np.array([bits[i] | bits[j]]))] = bits[i] | bits[j]
                for k in range(j):
                    leaders[self.syndrome(np.array([bits[i] | bits[j] | bits[k]]))] = bits[i] | bits[j] | bits[k]
        self.leaders = leaders

    @staticmethod
    def syndromes(words: np.ndarray) -> np.ndarray:
        """Remainders of the words, as polynomials over two elements, by the generator."""
        rest = words.astype(np.int64)
        for bit in range(22, 10, -1):
            rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
        return rest

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.low[words & 0xFFF] ^ self.high[words >> 12]

    def decode(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.leaders[self.syndrome(words)]) >> 11

    def near(self, words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The different codewords decoded from each word and from those one of its low bits away: (n, 6), and which count."""
        flips = np.concatenate([[0], 1 << np.arange(bits)])
        found = np.sort(self.decode(words[:, None] ^ flips[None, :]), axis=1)
        fresh = np.ones(found.shape, dtype=bool)
        fresh[:, 1:] = found[:, 1:] != found[:, :-1]
        place = np.cumsum(fresh, axis=1) - 1
        out, ok = np.zeros((len(words), 6), dtype=np.int64), np.zeros((len(words), 6), dtype=bool)
        row, col = np.nonzero(fresh)
        out[row, place[row, col]] = found[row, col]
        ok[row, place[row, col]] = True
        return out, ok


_GOLAY = None


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of every fingerprint (uint64). A key is its table's number and the table's bits."""
    global _GOLAY
    if _GOLAY is None:
        _GOLAY = Golay()
    x = prints.astype(np.uint64)
    a, b, c = ((x >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in ((41, 23), (18, 23), (0, 18)))
    (ka, oa), (kb, ob), (kc, oc) = _GOLAY.near(a, 23), _GOLAY.near(b, 23), _GOLAY.near(c, 18)
    rows, keys = [], []

    def add(table: int, key: np.ndarray, ok: np.ndarray) -> None:
        at = np.nonzero(ok)
        rows.append(at[0])
        keys.append(key[at] | table << 48)

    add(0, ka[:, :, None] << 12 | kb[:, None, :], oa[:, :, None] & ob[:, None, :])
    add(1, c[:, None] << 12 | kb, ob)
    add(2, b[:, None] << 12 | kc, oc)
    add(3, c[:, None] << 12 | ka, oa)
    add(4, a[:, None] << 12 | kc, oc)
    return np.concatenate(rows), np.concatenate(keys)


# -- links -----------------------------------------------------------------------------------------------------------


class Forest:
    """Union by smallest root over the nodes of one batch."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _near_pairs(group: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group (its number ascends) at MOST_BITS or fewer, for small groups: all pairs, by distance in
    the order, as whole-array steps."""
    left, right, at, shift = [], [], np.arange(len(x)), 1
    while len(at):
        at = at[at + shift < len(x)]
        at = at[group[at] == group[at + shift]]
        ok = at[np.bitwise_count(x[at] ^ x[at + shift]) <= MOST_BITS]
        left.append(ok)
        right.append(ok + shift)
        shift += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (at, at)


def _spanning(x: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links in one large group. Members of its largest component never begin a comparison, for a
    missing link always has an end outside it."""
    n = len(x)
    label, edges, done = np.arange(n), [], np.zeros(n, dtype=bool)
    sizes = np.ones(n, dtype=np.int64)

    def meet(i: int) -> None:
        done[i] = True
        for other in np.unique(label[np.bitwise_count(x ^ x[i]) <= MOST_BITS]).tolist():
            mine = label[i]
            if other != mine:
                near = np.flatnonzero((label == other) & (np.bitwise_count(x ^ x[i]) <= MOST_BITS))[0]
                edges.append((i, int(near)))
                label[label == other] = mine
                sizes[mine] += sizes[other]
                sizes[other] = 0

    while True:
        largest = int(np.argmax(sizes))
        left = np.flatnonzero(~done & (label != largest))
        if not len(left):
            return edges
        # A few at a time: what they join may make most of the rest needless.
        for i in left[: max(1, min(16, len(left)))].tolist():
            if not done[i] and label[i] != int(np.argmax(sizes)):
                meet(i)


def links_of(key: np.ndarray, sub: np.ndarray, x: np.ndarray, node: np.ndarray, small: int = 96) -> list[tuple[int, int]]:
    """A spanning forest of the links in each group of equal (key, sub); rows come in the order of both. Pairs of nodes."""
    edge = np.flatnonzero((np.diff(key) != 0) | (np.diff(sub) != 0)) + 1
    begin = np.concatenate([[0], edge])
    size = np.diff(np.concatenate([begin, [len(key)]]))
    group = np.repeat(np.arange(len(begin)), size)
    some = np.flatnonzero((size[group] > 1) & (size[group] <= small))
    left, right = _near_pairs(group[some], x[some])
    pairs = np.stack([node[some[left]], node[some[right]]], axis=1)
    more = []
    for g in np.flatnonzero(size > small).tolist():
        a, b = begin[g], begin[g] + size[g]
        more += [(int(node[a + i]), int(node[a + j])) for i, j in _spanning(x[a:b])]
    if more:
        pairs = np.concatenate([pairs, np.array(more, dtype=np.int64)])
    pairs.sort(axis=1)
    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
    names, place = np.unique(pairs, return_inverse=True)
    place = place.reshape(pairs.shape)
    forest = Forest(len(names))
    return [(int(names[a]), int(names[b])) for a, b in place.tolist() if forest.join(a, b)]


def fingerprint_links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect every two fingerprints at MOST_BITS or fewer.

    prints: node long, print long, each fingerprint once. Returns node pairs that span the same components as all
    links do. Null prints or nodes have no links.
    """
    spark = prints.sparkSession
    common.ship(spark)
    prints = prints.where("node is not null and print is not null").select("node", "print")

    def keyed(large):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    node, x = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                    row, key = keys_of(x.view(np.uint64))
                    if large is None:
                        yield pa.RecordBatch.from_arrays([pa.array(key)], ["key"])
                        continue
                    keys, blocks = large.value
                    sub = np.zeros(len(row), dtype=np.int64)
                    if len(keys):
                        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                        n = np.where(keys[place] == key, blocks[place], 1)
                        own = (common.mixed(x.view(np.uint64))[row] % n.astype(np.uint64)).astype(np.int64)
                        many = np.repeat(np.arange(len(row)), n)
                        other = np.arange(len(many)) - np.repeat(np.cumsum(n) - n, n)
                        one, two = np.minimum(own[many], other), np.maximum(own[many], other)
                        row, key, sub = row[many], key[many], one << 31 | two
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(sub), pa.array(x[row]), pa.array(node[row])], ["key", "sub", "print", "node"])
            common.tidy()

        return run

    counts = prints.mapInArrow(keyed(None), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    large = counts.where(F.col("n") > block).limit(MOST_LARGE + 1).collect()  # rows / block at most
    while len(large) > MOST_LARGE:
        block *= 2
        large = counts.where(F.col("n") > block).limit(MOST_LARGE + 1).collect()
    large.sort(key=lambda r: r.key)
    told = spark.sparkContext.broadcast((np.array([r.key for r in large], dtype=np.int64), np.array([-(-2 * r.n // block) for r in large], dtype=np.int64)))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * 4

        def out(rows: list[np.ndarray]) -> pa.RecordBatch:
            found = np.array(links_of(rows[0], rows[1], rows[2].view(np.uint64), rows[3]), dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        for batch in batches:
            held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
            if len(held[0]) < 200_000:
                continue
            last = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0))
            if len(last):  # the last group may go on in the next batch
                yield out([h[: last[-1] + 1] for h in held])
                held = [h[last[-1] + 1 :] for h in held]
        if len(held[0]):
            yield out(held)
        del held
        common.tidy()

    rows = prints.mapInArrow(keyed(told), "key long, sub long, print long, node long")
    return rows.repartition("key", "sub").sortWithinPartitions("key", "sub", "print").mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, print (long), component_id of every row: the smallest id among the texts that links lead to, itself included.

    Fingerprints are made once and written; each different one is linked once, so copies, however many, cost one row.
    A null or empty text has fingerprint 0, which links like any other; rows of one id are each returned; rows with a
    null id get a component, but never name one (null if no other row is in it); an empty table gives an empty result.
    """
    common.ship(docs.sparkSession)
    made = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = common.written(made.select("doc_id", fingerprint_udf()(F.col("text")).alias("print")), "prints")
    return prints.join(components_of_prints(prints), "print", "left").select("doc_id", "print", "component_id")


def components_of_prints(prints: DataFrame) -> DataFrame:
    """print, component_id for rows of (doc_id, print)."""
    each = prints.groupBy("print").agg(F.min("doc_id").alias("node"))
    named = common.written(each.where("node is not null").select("node", "print"), "each-print")
    edges = fingerprint_links(named)
    parts = common.connected_components(edges, "a", "b")
    return named.join(parts, "node", "left").select("print", F.coalesce("component", "node").alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of near copies: that with the smallest (doc_id, nulls last, text
    hash). Columns stay.

    Near copies are texts at a Jaccard similarity of 0.8 or more on five-word shingles (shingles.py), and what chains of
    them join. Links of SimHashes over these shingles retrieve the closest, MinHash bands the others; the texts decide.
    Rows equal in both count as one. Texts link, not ids, so rows without an id are copies, and join others, as any other
    row. Texts without words are copies of one another; an empty table stays empty.
    """
    rows = shingles.sketched(docs)
    parts = shingles.components(docs, rows, fingerprint_links)
    named = rows.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    kept = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("__cohortis_id"), F.col("k.text_hash").alias("__cohortis_text"))
    repeats = rows.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    one = docs.withColumns({"__cohortis_text": F.xxhash64("text"), "__cohortis_id": F.col("doc_id").cast("long")})
    same = (one["__cohortis_text"] == kept["__cohortis_text"]) & one["__cohortis_id"].eqNullSafe(kept["__cohortis_id"])
    one = one.join(kept, same, "left_semi")
    if repeats:
        one = one.dropDuplicates(["__cohortis_id", "__cohortis_text"])
    # Names of its own: a self-join that kept the attributes of docs could not be compared with docs again.
    return one.select(*[F.col(f"`{c}`").alias(c) for c in docs.columns])
