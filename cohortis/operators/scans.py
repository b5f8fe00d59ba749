"""Row numbers, running sums and running maxima of groups of any size.

A window without an end puts a whole group into one task. Here rows are dealt to ranges of the order of (group, order) once,
so that a large group spans many ranges and a range is what a task can hold. Then three steps, none of which sees a group whole:
totals of each (group, range), their running sums or maxima over the ranges of a group, and the same inside each range.

The sorted rows are written to the shared folder: where a range ends is decided once, and all steps see the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: A row's place in the order of all rows: its range in the upper bits, its place there in the lower ones.
AT, _RANGE, _BITS = "__scan_at", "__scan_range", 33


def placed(df: DataFrame, group: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """df sorted by group and order, and written, with AT. Rows equal in both are in any order, which then stays."""
    keys = [*map(F.col, group), *[F.col(o) if isinstance(o, str) else o for o in order]]
    sorted_ = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(sorted_.withColumn(AT, F.monotonically_increasing_id()), "scan")


def _ranged(rows: DataFrame) -> DataFrame:
    return rows.withColumn(_RANGE, F.shiftright(AT, _BITS))


def beside(rows: DataFrame, told: DataFrame, keys: Sequence[str], *names: str) -> DataFrame:
    """rows with columns of told, which has one row for each value of the keys; nulls are values."""
    told = told.select(*[F.col(k).alias(f"__told_{i}") for i, k in enumerate(keys)], *names)
    if not keys:
        return rows.crossJoin(told)  # one row
    same = [rows[k].eqNullSafe(told[f"__told_{i}"]) for i, k in enumerate(keys)]
    return rows.join(told, same, "left").drop(*[f"__told_{i}" for i in range(len(keys))])


def _before(group: Sequence[str]):
    """Window over the ranges of a group before a range: no more rows than there are ranges."""
    return Window.partitionBy(*group).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)


def row_numbers(rows: DataFrame, group: Sequence[str], out: str) -> DataFrame:
    """placed() rows with their number in the group, from 1."""
    some = _ranged(rows)
    totals = some.groupBy(*group, _RANGE).agg(F.count(F.lit(1)).alias("__n"), F.min(AT).alias("__first"))
    begins = totals.select(*group, _RANGE, (F.coalesce(F.sum("__n").over(_before(group)), F.lit(0)) + 1 - F.col("__first")).alias("__shift"))
    return beside(some, begins, [*group, _RANGE], "__shift").withColumn(out, F.col(AT) + F.col("__shift")).drop("__shift", _RANGE)


def sums_before(rows: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    """placed() rows with the sum of a column over the rows of the group before each."""
    some = _ranged(rows)
    totals = some.groupBy(*group, _RANGE).agg(F.sum(value).alias("__n"))
    begins = totals.select(*group, _RANGE, F.coalesce(F.sum("__n").over(_before(group)), F.lit(0)).alias("__sum"))
    own = Window.partitionBy(*group, _RANGE).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
    met = beside(some.withColumn("__own", F.coalesce(F.sum(value).over(own), F.lit(0))), begins, [*group, _RANGE], "__sum")
    return met.withColumn(out, F.col("__own") + F.col("__sum")).drop("__own", "__sum", _RANGE)


def running_max(rows: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    """placed() rows with the largest value of the group so far, the row's own included; nulls are skipped."""
    some = _ranged(rows)
    totals = some.groupBy(*group, _RANGE).agg(F.max(value).alias("__n"))
    begins = totals.select(*group, _RANGE, F.max("__n").over(_before(group)).alias("__max"))
    own = Window.partitionBy(*group, _RANGE).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    met = beside(some.withColumn("__own", F.max(value).over(own)), begins, [*group, _RANGE], "__max")
    return met.withColumn(out, F.greatest("__own", "__max")).drop("__own", "__max", _RANGE)


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], out: str) -> DataFrame:
    """df with the number of each row in its group, from 1."""
    return row_numbers(placed(df, group, order), group, out).drop(AT)


def ranked(df: DataFrame, group: Sequence[str], value: str, rank: Column, out: str, descending: bool = False) -> DataFrame:
    """df with a rank of the value in its group, null for a null. rank: of `__before`, the rows with a smaller (descending: a
    larger) value, and `__n`, those with the same. Equal values are counted before anything is sorted."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("__n"))
    before = sums_before(placed(counts, group, [F.desc(value) if descending else F.asc(value)]), group, "__n", "__before")
    return beside(df, before.withColumn(out, rank), [*group, value], out)
