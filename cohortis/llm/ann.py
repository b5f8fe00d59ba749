"""Approximate nearest neighbours (largest inner product) by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on the driver from at most SAMPLE vectors and broadcast (its size is bounded by the sample); every
row is then assigned to a leaf. A query walks the tree through a priority queue, nearest bin first, and visits as many
leaves as a calibration on the sample found to reach the wanted recall: visits are widened until it does. Where vectors
have little structure, that is most leaves, and no fewer are taken to look faster.

Scores are inner products in double precision of the original vectors, summed in one fixed order, so equal vectors
score equally wherever they lie. Leaves over BLOCK rows, and leaves that over BLOCK queries visit, are dealt out in
blocks; no task holds more than one block of rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Vectors that the tree is fitted and calibrated on, at most (those with the smallest hashes of their ids).
SAMPLE = 16_384
#: Rows of a leaf that the tree aims at, and rows (or queries) of a leaf that one group takes.
LEAF_ROWS, BLOCK = 1024, 4096
BRANCH, MOST_LEAVES = 8, 2048
#: Calibrated on the sample, where neighbours are farther away than in the whole table, so recall there is higher.
RECALL, CALIBRATION_QUERIES = 0.97, 256


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Label of each row; labels are compact, and one only where rows can't be told apart."""
    centres = x[rng.choice(len(x), k, replace=False)]
    label = np.zeros(len(x), dtype=np.int64)
    for _ in range(rounds):
        label = np.argmin((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, label, x)
        n = np.bincount(label, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return np.unique(label, return_inverse=True)[1]


class Tree:
    """Nodes in order of making: centre, spread (of a coordinate about it), children; leaves are numbered from 0."""

    def __init__(self, x: np.ndarray, leaf_rows: int, branch: int = BRANCH, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.n_leaves = 0
        centres, spreads = [], []

        def add(rows: np.ndarray) -> int:
            at = len(self.children)
            centre = x[rows].mean(axis=0)
            centres.append(centre)
            spreads.append(np.sqrt(((x[rows] - centre) ** 2).mean()))
            self.children.append([])
            self.leaf.append(-1)
            if len(rows) > leaf_rows and self.n_leaves + branch <= MOST_LEAVES:
                label = _kmeans(x[rows], min(branch, max(2, len(rows) // leaf_rows)), rng)
                if label.max() > 0:
                    self.children[at] = [add(rows[label == i]) for i in range(label.max() + 1)]
            if not self.children[at]:
                self.leaf[at] = self.n_leaves
                self.n_leaves += 1
            return at

        add(np.arange(len(x)))
        self.centres, self.spreads = np.array(centres), np.array(spreads)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child's, from the root down."""
        out, todo = np.zeros(len(x), dtype=np.int64), [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if not self.children[at]:
                out[rows] = self.leaf[at]
                continue
            c = self.centres[self.children[at]]
            near = np.argmin((c**2).sum(axis=1)[None, :] - 2 * x[rows] @ c.T, axis=1)
            todo += [(child, rows[near == i]) for i, child in enumerate(self.children[at]) if (near == i).any()]
        return out

    def visits(self, q: np.ndarray, most: int) -> list[list[int]]:
        """The first leaves of each query, best bin first. A bin's promise: the inner product with its centre and three
        spreads more along the query."""
        promise = q @ self.centres.T + 3 * np.linalg.norm(q, axis=1)[:, None] * self.spreads[None, :]
        out = []
        for row in promise:
            heap, found = [(-row[0], 0)], []
            while heap and len(found) < most:
                _, at = heapq.heappop(heap)
                if self.children[at]:
                    for child in self.children[at]:
                        heapq.heappush(heap, (-row[child], child))
                else:
                    found.append(self.leaf[at])
            out.append(found)
        return out


def calibrated(tree: Tree, x: np.ndarray, k: int, recall: float, rng: np.random.Generator) -> int:
    """The fewest leaf visits with which queries from the sample find at least `recall` of their k nearest in it."""
    if tree.n_leaves == 1 or len(x) <= 1:
        return tree.n_leaves
    leaf, chosen = tree.assign(x), rng.choice(len(x), min(CALIBRATION_QUERIES, len(x)), replace=False)
    scores = x[chosen] @ x.T
    scores[np.arange(len(chosen)), chosen] = -np.inf
    k = min(k, len(x) - 1)
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    place = np.zeros((len(chosen), tree.n_leaves), dtype=np.int64)
    for i, order in enumerate(tree.visits(x[chosen], tree.n_leaves)):
        place[i, order] = np.arange(tree.n_leaves)
    needed = np.take_along_axis(place, leaf[near], axis=1)
    visits = 1
    while visits < tree.n_leaves and (needed < visits).mean() < recall:
        visits += 1
    return visits


def _vectors(column: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors): those of dim finite components that aren't all zero, in double precision."""
    import pyarrow.compute as pc

    ok = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False))
    x = column.take(pa.array(ok)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return ok[good], x[good]


def _listed(x: np.ndarray) -> pa.ListArray:
    n, dim = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(x.reshape(-1)))


def _best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """For each query its k best rows but its own: (ids, scores), best first, ties to smaller ids."""
    rough = q @ x.T
    rough[own[:, None] == ids[None, :]] = -np.inf
    take = min(k, x.shape[0])
    least = -np.partition(-rough, take - 1, axis=1)[:, take - 1]
    slack = 1e-9 * (np.linalg.norm(q, axis=1) * np.sqrt((x**2).sum(axis=1).max()) + 1e-300)
    for i in range(len(q)):
        some = np.flatnonzero((rough[i] >= least[i] - slack[i]) & (rough[i] > -np.inf))
        score = (x[some] * q[i]).sum(axis=1)
        order = np.lexsort((ids[some], -score))[:k]
        yield ids[some][order], score[order]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k nearest rows that the calibrated search finds.

    queries has the columns of vectors; a query never finds rows of its own id. Vectors that are null, zero, hold null
    or non-finite components, or differ from the commonest length (ties: the longer) take no part, on either side; nor
    do rows with a null id. With fewer than k rows to find, all of them are returned; an empty table gives an empty result. Rows that
    repeat an id are each searched, and each repeated query is answered by itself. Other columns are ignored.
    """
    spark = vectors.sparkSession
    common.ship(spark)
    shape = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and exists(v, x -> x <> 0) and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    base, asked = shape(vectors), shape(queries)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    if not lengths:
        return empty
    dim, n_rows = lengths[0]["n"], lengths[0]["count"]
    chosen = base.where(F.size("v") == dim)
    if n_rows > sample:  # about `sample` of the rows, the same ones at every run
        chosen = chosen.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_rows)) < sample)
    fetched = chosen.select("vec_id", "v").limit(2 * sample).toArrow().sort_by("vec_id").column("v").combine_chunks()
    x = _vectors(fetched, dim)[1] if len(fetched) else np.zeros((0, dim))
    if not len(x):
        return empty
    rng = np.random.default_rng(42)
    tree = Tree(x, max(2, int(leaf_rows * len(x) / max(n_rows, len(x)))))
    visits = calibrated(tree, x, k, recall, rng)
    told = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, v = _vectors(batch.column(1), dim)
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(told.value.assign(v)), batch.column(0).take(pa.array(rows)), _listed(v)], ["leaf", "vec_id", "v"])

    step = max(1, common.BATCH_BYTES // (8 * dim))  # a query comes along to each leaf, so many at once

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, v = _vectors(part.column(2), dim)
                if len(rows):
                    order = told.value.visits(v, visits)
                    many = np.repeat(np.arange(len(rows)), [len(o) for o in order])
                    leaves = np.concatenate(order).astype(np.int64)
                    for a in range(0, len(many), step):
                        some = many[a : a + step]
                        who = pa.array(rows[some])
                        yield pa.RecordBatch.from_arrays([pa.array(leaves[a : a + step]), part.column(0).take(who), part.column(1).take(who), _listed(v[some])], ["leaf", "row", "query_id", "v"])

    placed = common.written(base.mapInArrow(place, "leaf long, vec_id long, v array<double>"), "leaves")
    walked = common.written(asked.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v").mapInArrow(walk, "leaf long, row long, query_id long, v array<double>"), "visits")
    # One row for each leaf, of which there are MOST_LEAVES at most.
    rows_in = {r.leaf: r["count"] for r in placed.groupBy("leaf").count().collect()}
    asked_in = {r.leaf: r["count"] for r in walked.groupBy("leaf").count().collect()}
    blocks = lambda counts: F.coalesce(F.get(F.array(*[F.lit(-(-counts.get(i, 1) // BLOCK)) for i in range(tree.n_leaves)]), F.col("leaf").cast("int")), F.lit(1))
    pick = lambda c, counts: F.pmod(F.xxhash64(c), blocks(counts)).cast("long")
    every = lambda counts: F.explode(F.sequence(F.lit(0).cast("long"), (blocks(counts) - 1).cast("long")))
    left = placed.select("leaf", pick("vec_id", rows_in).alias("b"), every(asked_in).alias("a"), F.lit(None).cast("long").alias("row"), F.col("vec_id").alias("id"), "v")
    right = walked.select("leaf", every(rows_in).alias("b"), pick("row", asked_in).alias("a"), "row", F.col("query_id").alias("id"), "v")
    cells = left.union(right).withColumn("cell", F.xxhash64("leaf", "b", "a"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by cell (leaf, b, a), base rows before the queries that look at them."""
        now, ids, base_x = None, [], []
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            is_query = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            tag = np.concatenate([key, is_query[:, None]], axis=1)
            cuts = [0, *(np.flatnonzero((np.diff(tag, axis=0) != 0).any(axis=1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                x = part.column(5).flatten().to_numpy().reshape(-1, dim)
                if not is_query[a]:
                    if tuple(key[a]) != now:
                        now, ids, base_x = tuple(key[a]), [], []
                    ids.append(part.column(4).to_numpy())
                    base_x.append(x)
                elif tuple(key[a]) == now:
                    ids, base_x = [np.concatenate(ids)], [np.concatenate(base_x)]
                    for at in range(0, len(x), 256):
                        found = [*_best(x[at : at + 256], base_x[0], ids[0], part.column(4).to_numpy()[at : at + 256], k)]
                        yield pa.RecordBatch.from_arrays([part.column(3).slice(at, 256), part.column(4).slice(at, 256), pa.array([[{"less": -s, "vec_id": i} for i, s in zip(f[0].tolist(), f[1].tolist(), strict=True)] for f in found], pa.list_(pa.struct([("less", pa.float64()), ("vec_id", pa.int64())])))], ["row", "query_id", "found"])

    found = cells.repartition("cell").sortWithinPartitions("leaf", "b", "a", F.col("row").asc_nulls_first()).drop("cell").mapInArrow(search, "row long, query_id long, found array<struct<less double, vec_id long>>")
    best = found.groupBy("row").agg(F.first("query_id").alias("query_id"), F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.less")).alias("score"))
