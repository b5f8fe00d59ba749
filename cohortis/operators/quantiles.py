"""Exact quantiles of groups that are too large for one task's memory.

Spark's exact median keeps a count of every different value of a group in one task. Here a sketch brackets the wanted
rank first; the second pass only counts what lies below the bracket and gathers the few different values inside it. The
result is the same number, interpolated linearly between neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, out: str = "quantile", accuracy: int = 10_000) -> DataFrame:
    """keys and the q-quantile of a numeric column (nulls skipped; NaN counts as the largest). Groups without values: null.

    Two scans of df and shuffles of partial aggregates only: the bracket holds a share of about 4 / accuracy of a group, and
    equal values are counted together before they are moved.
    """
    return exact_quantiles(df, keys, {out: value}, q, accuracy)


def exact_quantiles(df: DataFrame, keys: Sequence[str], values: dict[str, str], q: float, accuracy: int = 10_000, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """exact_quantile() of several columns (name of the quantile: column) in the same two scans. keep: what holds the brackets
    between the scans, such as session.written; a small table's size is known then, and Spark can plan by it."""
    keys, columns = [*keys], [F.col(v).cast("double") for v in values.values()]
    low, high = max(0.0, q - 2 / accuracy), min(1.0, q + 2 / accuracy)

    def bracket(v: Column) -> Column:
        # At the ends the bracket is open, so no sketch error can leave out an extreme.
        b = F.percentile_approx(v, [low, high], accuracy)
        return F.struct(F.count(v).alias("n"), (F.min(v) if low == 0 else F.get(b, F.lit(0))).alias("lo"), (F.max(v) if high == 1 else F.get(b, F.lit(1))).alias("hi"))

    bounds = keep(df.groupBy(*keys).agg(F.array(*map(bracket, columns)).alias("_b")))
    rows = df.select(*keys, F.array(*columns).alias("_vs"))
    beside = rows.join(bounds, keys) if keys else rows.crossJoin(F.broadcast(bounds))
    each = [F.struct(F.lit(i).alias("_m"), F.get("_vs", F.lit(i)).alias("_v"), F.get("_b", F.lit(i)).alias("_b")) for i in range(len(columns))]
    met = beside.select(*keys, F.inline(F.array(*each))).where("_v is not null").select(*keys, "_m", "_v", F.col("_b.n").alias("_n"), F.col("_b.lo").alias("_lo"), F.col("_b.hi").alias("_hi"))
    # What lies below the bracket becomes one row a group, with its largest value; above it, one with its smallest: a rank
    # between two neighbours can end just outside.
    side = F.when(F.col("_v") < F.col("_lo"), -1).when(F.col("_v") > F.col("_hi"), 1).otherwise(0)
    inside = F.when(side == 0, F.col("_v"))
    at = F.when(F.col("_side") < 0, F.max("_v")).otherwise(F.min("_v"))
    counted = met.groupBy(*keys, "_m", side.alias("_side"), inside.alias("_in")).agg(at.alias("_at"), F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    w = Window.partitionBy(*keys, "_m").orderBy("_side", "_at")
    upto = counted.withColumn("_to", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rank = (F.col("_n") - 1) * q  # from 0
    lower = F.min(F.when(F.col("_to") > F.floor(rank), F.col("_at")))
    upper = F.min(F.when(F.col("_to") > F.ceil(rank), F.col("_at")))
    found = upto.groupBy(*keys, "_m").agg(lower.alias("_a"), upper.alias("_z"), F.first("_n").alias("_n"))
    exact = F.col("_a") + ((F.col("_n") - 1) * q - F.floor((F.col("_n") - 1) * q)) * (F.coalesce("_z", "_a") - F.col("_a"))
    done = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_m") == i, exact)).alias(name) for i, name in enumerate(values)])
    return bounds.select(*keys).join(done, keys, "left") if keys else done
