"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

A group (all rows of one text) goes to one shard whole. A *partial partition* is a tuple of as many sums as there are
shards. Differencing takes the two with the largest spread (largest sum less smallest) and combines them oppositely
ordered, the largest sum of one with the smallest of the other, until one is left.

Groups, not rows, are differenced: parts of about GROUPS_A_PART groups in parallel tasks, each leaving one partial
partition; those tuples are again dealt to parts and differenced in tasks, round by round, until so few are left that
the driver ends it. Tuples carry sums only; the way back from the last tuple to each group is kept as permutations.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 16
#: Groups, or tuples of an earlier round, that one task differences: some 20 MB of sums and permutations.
GROUPS_A_PART = 60_000
#: Tuples that the driver differences in the end, at most.
MOST_TUPLES = 2_048


def differenced(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Difference partial partitions (n, k). Returns the last one's sums, and at (i, j) the slot in it of slot j of
    tuple i. Equal spreads are taken in the order of arrival."""
    n, k = sums.shape
    total = np.concatenate([sums, np.zeros((max(0, n - 1), k), dtype=sums.dtype)])
    heap = [(int(-s), i) for i, s in enumerate(sums.max(axis=1) - sums.min(axis=1))]
    heapq.heapify(heap)
    children = np.zeros((max(0, n - 1), 2), dtype=np.int64)
    ways = np.zeros((max(0, n - 1), 2, k), dtype=np.int16)  # slot of the child -> slot of the parent
    for at in range(n - 1):
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        up, down = np.argsort(total[a], kind="stable"), np.argsort(total[b], kind="stable")[::-1]
        met = total[a][up] + total[b][down]
        total[n + at] = met
        children[at] = a, b
        place = np.arange(k, dtype=np.int16)
        ways[at, 0, up] = place
        ways[at, 1, down] = place
        heapq.heappush(heap, (int(met.min() - met.max()), n + at))
    slots = np.zeros((len(total), k), dtype=np.int16)
    slots[-1] = np.arange(k)
    for at in range(n - 2, -1, -1):
        for side in (0, 1):
            slots[children[at, side]] = slots[n + at][ways[at, side]]
    return total[-1], slots[:n]


def _round(tuples: DataFrame, n: int, size: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """Difference n rows (part, sums) in parts of about `size`, a task each. Returns (part, up, way) and the new (part, sums):
    way leads a part's slots to those of the tuple `up`, which it has gone into."""
    dealt = tuples.withColumn("up", F.pmod(F.xxhash64(F.lit(n), "part"), F.lit(-(-n // size))))

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        sums, slots = differenced(np.array(rows.column("sums").to_pylist(), dtype=np.int64).reshape(rows.num_rows, shards))
        lists = pa.array([sums.tolist()] + [None] * (rows.num_rows - 1), pa.list_(pa.int64()))
        return pa.table({"part": rows.column("part"), "up": rows.column("up"), "way": pa.array(slots.tolist(), pa.list_(pa.int32())), "sums": lists})

    made = common.written(dealt.select("part", "up", "sums").groupBy("up").applyInArrow(one, "part long, up long, way array<int>, sums array<long>"), "round")
    return made.select("part", "up", "way"), made.where("sums is not null").select(F.col("up").alias("part"), "sums")


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", groups_a_part: int = GROUPS_A_PART, most_tuples: int = MOST_TUPLES) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in each shard), grown_shard (null).

    size is the text's UTF-8 bytes (null: none) plus 1; groups are rows of equal text, a null text apart from an empty
    one. Rows of one id are each placed; other columns are ignored; an empty table gives an empty result. A group
    larger than a shard's even share still stays whole: then no partition is more even than that group allows.

    Texts are read once, for digests; only (id, digest, size, crc) is shuffled afterwards. The join of rows to their
    group's shard can be skewed and is split by adaptive execution. Slots are numbered within buckets of ids, plus the
    rows of the buckets before, so no shard is ever gathered in one task; rows without an id are dealt to buckets by where
    they are read from. The driver gets at most most_tuples tuples.
    """
    spark = docs.sparkSession
    common.ship(spark)
    text = F.col(text_col)
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    # The digest that tells texts apart; null differs from every text.
    digest = F.when(text.isNull(), F.lit("null")).otherwise(F.sha2(raw, 256))
    rows = common.written(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), digest.alias("digest")), "rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    n_groups = groups.count()
    parts = max(1, -(-n_groups // groups_a_part))
    spread = groups.select("digest", "bytes", F.pmod(F.xxhash64("digest"), F.lit(parts)).alias("part"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by part; each part is differenced on its own."""
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            size = table.column("bytes").to_numpy()
            start = np.zeros((len(size), shards), dtype=np.int64)
            start[:, 0] = size
            sums, slots = differenced(start)
            n = len(size)
            return pa.RecordBatch.from_arrays([table.column("digest").combine_chunks(), table.column("part").combine_chunks(), pa.array(slots[:, 0].astype(np.int32)), pa.array([sums.tolist()] + [None] * (n - 1), pa.list_(pa.int64()))], ["digest", "part", "local", "sums"])

        for batch in batches:
            part = batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and held[0].column(2)[0].as_py() != part[a]:
                    yield done()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield done()

    # A part is a task's unit of work, and its size is bounded by the number of parts.
    placed = common.written(spread.repartition("part").sortWithinPartitions("part", F.desc("bytes"), "digest").mapInArrow(local, "digest string, part long, local int, sums array<long>"), "placed")
    left = placed.where("sums is not null").select("part", "sums")
    dealt, n = placed.select("digest", "part", F.col("local").alias("slot")), left.count()
    while n > most_tuples:
        ways, left = _round(left, n, min(groups_a_part, max(2, most_tuples)), shards)
        dealt = dealt.join(ways, "part").select("digest", F.col("up").alias("part"), F.get("way", F.col("slot")).alias("slot"))
        n = left.count()
    tuples = left.orderBy("part").collect()
    if not tuples:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    _, slots = differenced(np.array([r.sums for r in tuples], dtype=np.int64))
    ways = spark.createDataFrame([(r.part, [int(x) for x in way]) for r, way in zip(tuples, slots, strict=True)], "part long, way array<int>")
    dealt = dealt.join(ways, "part").select("digest", F.get("way", F.col("slot")).alias("shard"))
    shuffles = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest", F.when(F.col("doc_id").isNull(), F.spark_partition_id())), F.lit(4 * shuffles)))
    given = common.written(salted.join(dealt, "digest"), "given")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    begins = given.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("begin"))
    own = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "digest")) - 1
    numbered = given.withColumn("own", own).join(begins, ["bucket", "shard"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("begin") + F.col("own")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
