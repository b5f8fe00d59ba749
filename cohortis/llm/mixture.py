"""Mixing sources to target weights: every document a whole number of times, and once more by a seeded Bernoulli draw.

Words are aggregated per source; the mix has as many words as all sources together, shared by weight. No source is
repeated more than `times` times: what a share has above that goes to the others by weight, until none is above. A source's
rate is its target over its size; a document is emitted floor(rate) times, and once more with the fraction as probability.

A draw is a hash of the document's id, seeded by a number of its source's own: of SEEDS numbers the one whose draws bring the
source's words nearest to its target. Independent draws alone leave a source of fifty documents some 15 % off, the nearest of
32 less than 1 % off. Nothing but ids, sizes and hashes is read for that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

TIMES, SEEDS = 3, 32
#: Words stand between ASCII white space.
_SPACE = " \t\n\x0b\x0c\r"
_ROW = 33  # bits of monotonically_increasing_id that count within a partition


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and \\x09-\\x0D; 0 for a null. One string no longer than the text, no list."""
    marked = F.regexp_replace(text, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")
    return F.coalesce(F.length(F.translate(marked, _SPACE, "")), F.lit(0)).cast("long")


def _key(source: str = "source") -> Column:
    """A source as a join key that is never null: hot sources then are split like any other key."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def _drawn(doc_id: Column, text: Column) -> list[Column]:
    """Two numbers under 2**32 of a document, the second odd. A document without an id is drawn by its text."""
    name = F.concat(F.lit("11:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), text), F.lit("")))
    digest = F.sha2(name, 256)
    first, second = (F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))
    return [first.alias("h"), second.bitwiseOR(F.lit(1)).alias("step")]


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, h, step of every row: the one pass over texts."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), *_drawn(F.col(id_col), text))


def cycled(sources: DataFrame, weights: Sequence[int]) -> DataFrame:
    """sources (one row each) with `weight`: sources by code point, null last, weigh as listed, over and over. Numbered within
    the ranges of a sort, plus the rows of the ranges before, so that no task has all sources."""
    ordered = sources.orderBy(F.col("source").isNull(), "source").withColumn("_at", F.monotonically_increasing_id())
    ordered = common.written(ordered, "mix-order")
    part = F.shiftright("_at", _ROW)
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    begins = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("begin"))
    met = ordered.withColumn("part", part).join(F.broadcast(begins), "part")
    place = F.col("begin") + F.col("_at").bitwiseAND((1 << _ROW) - 1)
    return met.select(*sources.columns, F.get(F.array(*[F.lit(int(w)).cast("long") for w in weights]), F.pmod(place, F.lit(len(weights))).cast("int")).alias("weight"))


def shared_out(sources: DataFrame, times: int = TIMES) -> DataFrame:
    """sources (source_size, weight long, 0 or more) with `target`: all sizes shared by weight, none above `times` its size.

    Rounds of one aggregate each: what the sources at their limit leave, over the weights of the others, is the words a
    unit of weight gets; more sources may be at their limit then. Sums are of whole numbers, so any order gives the same targets.
    """
    limit = F.col("source_size") * times
    whole = sources.agg(F.sum("source_size").alias("r"), F.sum("weight").alias("w")).first()
    rest, weight = int(whole.r or 0), int(whole.w or 0)
    wide = lambda c: c.cast("decimal(38,0)")
    while weight:
        full = wide(limit) * wide(F.lit(weight)) < wide(F.col("weight")) * wide(F.lit(rest))
        now = sources.agg(F.sum(F.when(full, limit)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        left = int(whole.r) - int(now.full or 0), int(now.w or 0)
        if left == (rest, weight):
            return sources.withColumn("target", F.when(full, limit.cast("double")).otherwise(F.lit(float(rest)) * F.col("weight") / F.lit(float(weight))))
        rest, weight = left
    return sources.withColumn("target", F.when(F.col("weight") > 0, limit.cast("double")).otherwise(0.0))


def _copies(rate: Column, seed: Column) -> Column:
    """How often a row (h, step) is taken at a rate."""
    draw = F.pmod(F.col("h") + seed * F.col("step"), F.lit(1 << 32))
    return F.floor(rate) + (draw < (rate - F.floor(rate)) * float(1 << 32)).cast("long")


def rates(rows: DataFrame, weights: Sequence[int] | DataFrame, times: int = TIMES, seeds: int = SEEDS) -> DataFrame:
    """source, source_size, weight, target, rate, seed: one row a source of sized() rows.

    weights: to be dealt out by cycled(), or a table (source, weight long); a source that it lacks weighs nothing.
    """
    spark = rows.sparkSession
    each = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    if isinstance(weights, DataFrame):
        told = weights.select(_key().alias("_key"), F.col("weight").cast("long").alias("weight")).dropDuplicates(["_key"])
        each = each.withColumn("_key", _key()).join(told, "_key", "left").select("source", "source_size", F.greatest(F.coalesce("weight", F.lit(0)), F.lit(0)).cast("long").alias("weight"))
        each = common.written(each, "mix-weights")
    else:
        each = common.written(cycled(each, weights), "mix-weights")
    aimed = shared_out(each, times).withColumn("rate", F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)))
    aimed = common.written(aimed, "mix-targets")
    drawn = rows.withColumn("_key", _key()).join(aimed.select(_key().alias("_key"), "rate", "target"), "_key")
    # A row a document and seed goes no further than the map side's sums.
    tried = drawn.select("_key", "target", "rate", "size", "h", "step", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
    sums = tried.groupBy("_key", "seed").agg(F.sum(_copies(F.col("rate"), F.col("seed").cast("long")) * F.col("size")).alias("words"), F.first("target").alias("target"))
    best = sums.groupBy("_key").agg(F.min(F.struct(F.abs(F.col("words") - F.col("target")), "seed")).alias("b")).select("_key", F.col("b.seed").cast("long").alias("seed"))
    made = aimed.withColumn("_key", _key()).join(best, "_key").drop("_key")
    return spark.createDataFrame([], made.schema) if each.isEmpty() else common.written(made, "mix-rates")


def copies(docs: DataFrame, weights: Sequence[int] | DataFrame = (5, 2, 1), times: int = TIMES, seeds: int = SEEDS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every row.

    A null or empty text has size 0 and is taken at its source's rate as any other; null sources are one source, apart from an
    empty one; a source of no words has a target and a rate of 0. Rows that repeat an id are drawn alike, rows without an id by
    their text; very long texts are counted whole; other columns are ignored; an empty table gives an empty result. The same
    table gives the same rows, however it is partitioned.
    """
    rows = common.written(sized(docs), "mix-sizes")
    told = rates(rows, weights, times, seeds)
    met = rows.withColumn("_key", _key()).join(told.select(_key().alias("_key"), "source_size", "target", "rate", "seed"), "_key")
    return met.select("doc_id", "source", "size", "source_size", "target", _copies(F.col("rate"), F.col("seed")).alias("copies"))


def emitted(docs: DataFrame, weights: Sequence[int] | DataFrame = (5, 2, 1), times: int = TIMES, seeds: int = SEEDS, copy_col: str = "copy") -> DataFrame:
    """The mix itself: rows of docs as often as they are taken, with their columns and `copy`, from 1. Texts are read twice,
    and not shuffled where the table of sources is small enough to be broadcast."""
    told = rates(common.written(sized(docs), "mix-sizes"), weights, times, seeds)
    mine = {"__mix_key": _key(), **dict(zip(("h", "step"), _drawn(F.col("doc_id"), F.col("text")), strict=True))}
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    met = docs.select(kept, *[c.alias(n) for n, c in mine.items()]).join(told.select(_key().alias("__mix_key"), "rate", "seed"), "__mix_key")
    taken = met.withColumn("__copies", _copies(F.col("rate"), F.col("seed"))).where("__copies > 0")
    return taken.select("__row.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias(copy_col))
