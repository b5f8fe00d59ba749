"""Relational operators: summaries, joins, windows, ranks, reshaping, incremental maintenance."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import scans
from .quantiles import exact_quantile, exact_quantiles

# -- summaries -------------------------------------------------------------------------------------------------------


def summarize(df: DataFrame, metrics: Sequence[str], scanner: str = "scanner", seen: str = "seen_in_training", keys: Sequence[str] = ()) -> DataFrame:
    """Row count and means by (keys and) everything, scanner, and seen: one pass with grouping sets.

    group is `all`, `scanner=...` or `seen=True/False`; means skip nulls, n counts rows.
    """
    sets = [[*keys], [*keys, scanner], [*keys, seen]]
    label = F.when((F.grouping(scanner) == 1) & (F.grouping(seen) == 1), F.lit("all")).when(F.grouping(scanner) == 0, F.concat(F.lit("scanner="), F.col(scanner))).otherwise(F.concat(F.lit("seen="), F.initcap(F.col(seen).cast("string"))))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (*keys, scanner, seen)]).agg(label.alias("group"), F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in metrics]).select(*keys, "group", "n", *metrics)


def pair_summary(df: DataFrame, metrics: Sequence[str], rater: str, reference: str, scanner: str, shared: str) -> DataFrame:
    """By pair "rater vs reference": all, each scanner, and the shared subset where there is one."""
    pair = df.withColumn("pair", F.concat_ws(" vs ", rater, reference))
    label = F.when(F.grouping(scanner) == 1, F.lit("all")).otherwise(F.concat(F.lit("scanner="), F.col(scanner)))
    aggregates = [F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in metrics]]
    whole = pair.groupingSets([[F.col("pair")], [F.col("pair"), F.col(scanner)]], F.col("pair"), F.col(scanner)).agg(label.alias("group"), *aggregates).select("pair", "group", "n", *metrics)
    part = pair.where(F.col(shared)).groupBy("pair").agg(F.lit("shared").alias("group"), *aggregates).select("pair", "group", "n", *metrics)
    return whole.unionByName(part)


def medians(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Exact medians, nulls skipped."""
    return df.groupBy(*keys).agg(*[F.median(v).alias(v) for v in values])


def missing_counts(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """n, n_missing and mean of a long table, by keys: an undefined metric is left out of itself only."""
    return long.groupBy(*keys).agg(F.count(value).alias("n"), F.count_if(F.col(value).isNull()).alias("n_missing"), F.avg(value).alias("mean"))


def dispersion(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Population deviation (over folds) beside the sample's (of differences)."""
    return df.groupBy(*keys).agg(F.stddev_pop(value).alias("sd_population"), F.stddev_samp(value).alias("sd_sample"))


# -- joins -----------------------------------------------------------------------------------------------------------


def lookup(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left many-to-one lookup; a miss gives nulls. Spark broadcasts the dimension while it is under its threshold."""
    return fact.join(dim, key, "left")


def rater_pairs(table: DataFrame, keys: Sequence[str], source: str, reference: str, value: str) -> DataFrame:
    """keys, rater's name, rater, ref: every other source beside the reference source."""
    other = table.where(F.col(source) != reference).select(*keys, F.col(source).alias("rater_name"), F.col(value).alias("rater"))
    return other.join(table.where(F.col(source) == reference).select(*keys, F.col(value).alias("ref")), [*keys])


def positive_pairs(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n usable on a log scale and n_excluded, counted instead of silently dropped."""
    ok = F.coalesce((F.col("rater") > 0) & (F.col("ref") > 0), F.lit(False))
    return pairs.groupBy(*keys).agg(F.count_if(ok).alias("n"), F.count_if(~ok).alias("n_excluded"))


def member_pairs(members: DataFrame, family: str, member: str) -> DataFrame:
    """Ordered pairs a < b within each family: an equi-join on the family."""
    one = members.select(family, F.col(member).alias("a"))
    return one.join(members.select(family, F.col(member).alias("b")), family).where("a < b")


def model_pairs(table: DataFrame, pairs: DataFrame, keys: Sequence[str], model: str, value: str) -> DataFrame:
    """(family, a, b), keys, and the two models' values where both have one. A duplicate key's values are averaged."""
    once = table.groupBy(*keys, model).agg(F.avg(value).alias("v")).where("v is not null")
    a = once.select(*keys, F.col(model).alias("a"), F.col("v").alias("va"))
    b = once.select(*keys, F.col(model).alias("b"), F.col("v").alias("vb"))
    return a.join(b, [*keys]).where("a <> b").join(pairs, ["a", "b"])


def complete(files: DataFrame, subject: str, kind: str, path: str, required: Sequence[str]) -> DataFrame:
    """subject and its kind -> path map, for subjects that have every required kind. Of several paths of a kind the first in
    order counts; rows without a kind or a path don't."""
    once = files.where(F.col(kind).isNotNull() & F.col(path).isNotNull()).groupBy(subject, kind).agg(F.min(path).alias(path))
    have = once.groupBy(subject).agg(F.map_from_entries(F.collect_list(F.struct(kind, path))).alias("files"))
    return have.where(F.size(F.array_except(F.array(*map(F.lit, required)), F.map_keys("files"))) == 0)


def availability(expected: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """expected with `available`: whether existing has the key."""
    return expected.join(existing.select(*keys).distinct().withColumn("_there", F.lit(True)), [*keys], "left").withColumn("available", F.coalesce("_there", F.lit(False))).drop("_there")


def drop_from_baseline(df: DataFrame, keys: Sequence[str], kind: str, baseline: str, value: str) -> DataFrame:
    """value less the baseline row's of the same keys (null without one; the least of several)."""
    base = df.where(F.col(kind) == baseline).groupBy(*keys).agg(F.min(value).alias("_base"))
    return df.join(base, [*keys], "left").withColumn("drop", F.col(value) - F.col("_base")).drop("_base")


# -- windows ---------------------------------------------------------------------------------------------------------


def robust_z(df: DataFrame, group: Sequence[str], value: str, least: int = 1, out: str = "z", large_groups: bool = False) -> DataFrame:
    """(x - median) / (1.4826 MAD) in each group; 0 where the MAD is 0 or x is missing; null in groups of under `least` rows.

    Two grouped medians joined back, not window functions, so a large group is not one task's to sort with all columns.
    large_groups: for groups with more different values than a task can hold; the same result by quantiles.exact_quantile.
    """
    centre = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), *([] if large_groups else [F.median(value).alias("_med")]))
    if large_groups:
        centre = centre.join(exact_quantile(df, group, value, 0.5, "_med"), [*group])
    met = df.join(centre, [*group])
    off = F.abs(F.col(value) - F.col("_med"))
    spread = exact_quantile(met.withColumn("_off", off), group, "_off", 0.5, "_mad") if large_groups else met.groupBy(*group).agg(F.median(off).alias("_mad"))
    z = F.coalesce(F.try_divide(F.col(value) - F.col("_med"), 1.4826 * F.col("_mad")), F.lit(0.0))
    return met.join(spread, [*group]).withColumn(out, F.when(F.col("_n") >= least, z)).drop("_med", "_mad", "_n")


def robust_limits(df: DataFrame, group: Sequence[str], values: Sequence[str]) -> DataFrame:
    """group, n, and med_ and mad_ of each value: what robust_z() of many columns needs, for groups of any size. df is scanned
    once for n and four times for all values together; only partial aggregates are shuffled. Tables of a row a group are written."""
    keep = lambda made: written(made, "limits")
    med = keep(df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).join(exact_quantiles(df, group, {f"med_{v}": v for v in values}, 0.5, keep=keep), [*group]))
    off = df.select(*group, *values).join(med, [*group]).select(*group, *[F.abs(F.col(v) - F.col(f"med_{v}")).alias(v) for v in values])
    return keep(med.join(exact_quantiles(off, group, {f"mad_{v}": v for v in values}, 0.5, keep=keep), [*group]))


def holm(df: DataFrame, family: Sequence[str], p: str, order: Sequence[str], out: str = "p_holm") -> DataFrame:
    """Holm's adjusted p within each family: (m - k + 1) p by rank, running maximum, at most 1. Null p stay null. Families may
    be of any size: ranks and maxima come from scans over ranges, m from an aggregate."""
    placed = scans.placed(df, family, [F.asc_nulls_last(p), *order])  # df is read once: its p may have cost much
    rows = scans.row_numbers(placed, family, "_at")
    m = placed.groupBy(*family).agg(F.count(p).alias("_m")) if family else placed.agg(F.count(p).alias("_m"))
    met = scans.beside(rows, m, family, "_m").withColumn("_step", (F.col("_m") - F.col("_at") + 1) * F.col(p))
    top = scans.running_max(met, family, "_step", "_top")
    return top.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), "_top"))).drop("_step", "_at", "_m", "_top", scans.AT)


def first_n(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first n of each group. Spark's window group limit keeps n a group before the shuffle."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_at") <= n).drop("_at")


def block_folds(df: DataFrame, stratum: str, order: Sequence[str], k: int, hashed: Column) -> DataFrame:
    """Deal each stratum, in order, in blocks of k; a block's rows get different folds by the rank of a hash."""
    at = scans.numbered(df, [stratum], order, "_row").withColumn("_block", F.floor((F.col("_row") - 1) / k))
    # A window over k rows.
    return at.withColumn("fold", F.row_number().over(Window.partitionBy(stratum, "_block").orderBy(hashed, *order)) - 1).drop("_block", "_row")


def round_robin(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """With turn, from 1 in each group: in the order of (turn, group) come the first of each group, then the second, ..."""
    return scans.numbered(df, [group], order, "turn")


def first_family(models: DataFrame, families: DataFrame, default: str = "other") -> DataFrame:
    """model, family: the first listed family that has it, else the default."""
    best = families.groupBy("model").agg(F.min_by("family", "position").alias("_family"))
    return models.join(best, "model", "left").select("model", F.coalesce("_family", F.lit(default)).alias("family"))


# -- ranks and limits ------------------------------------------------------------------------------------------------


def min_ranks(df: DataFrame, value: str, higher_is_better: bool, out: str = "rank", group: Sequence[str] = ()) -> DataFrame:
    """Competition ranks: ties share the smallest; rows without a value share the one after all others."""
    ranks = scans.ranked(df, group, value, F.col("__before") + 1, "_rank", descending=higher_is_better)
    have = df.groupBy(*group).agg((F.count(value) + 1).alias("_last")) if group else df.agg((F.count(value) + 1).alias("_last"))
    return scans.beside(ranks, have, group, "_last").withColumn(out, F.coalesce("_rank", "_last").cast("int")).drop("_rank", "_last")


def mid_ranks(df: DataFrame, value: str, group: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Average ranks of ties, within groups of any size; null for a null."""
    return scans.ranked(df, group, value, F.col("__before") + (F.col("__n") + 1) / 2.0, out)


def scores(df: DataFrame, metrics: dict[str, bool], group: Sequence[str] = (), out: str = "score") -> DataFrame:
    """Mean of min-max scaled metrics, 0 best; those where higher is better are turned round. Extremes are aggregated and
    joined back, so no group is sorted."""
    bounds = df.groupBy(*group).agg(*[f(m).alias(f"_{n}_{m}") for m in metrics for n, f in (("lo", F.min), ("hi", F.max))])
    met = df.crossJoin(F.broadcast(bounds)) if not group else df.join(bounds, [*group])
    parts = []
    for m, higher in metrics.items():
        lo, hi = F.col(f"_lo_{m}"), F.col(f"_hi_{m}")
        scaled = F.try_divide(F.col(m) - lo, hi - lo)
        parts.append(1 - scaled if higher else scaled)
    total = parts[0]
    for x in parts[1:]:
        total = total + x
    return met.withColumn(out, total / len(parts)).drop(*[f"_{n}_{m}" for m in metrics for n in ("lo", "hi")])


def inserted(board: DataFrame, ours: DataFrame, metrics: dict[str, bool], team: str = "team") -> DataFrame:
    """For each of ours, inserted alone into the board: position, of (teams), score. All models at once, by model.

    A position is counted, not sorted for: it is one more than the teams that come before by score (those without one last), then
    name. The figures are written first: averages made twice can differ in their last bits, and a team would come before itself.
    """
    mine = ours.select(F.col(team).alias("model"), F.col(team), *metrics)
    everyone = board.select(team, *metrics).crossJoin(mine.select("model")).select("model", team, *metrics).unionByName(mine.select("model", team, *metrics))
    scored = scores(written(everyone, "inserted"), metrics, ["model"])
    own = scored.where(F.col(team) == F.col("model")).groupBy("model").agg(F.min("score").alias("_score"))
    s, mark = F.col("score"), F.col("_score")
    level = s.eqNullSafe(mark)
    ahead = (s < mark) | (s.isNotNull() & mark.isNull()) | (level & (F.col(team) < F.col("model")))
    met = scored.join(own, "model")
    return met.groupBy("model").agg((F.count_if(F.coalesce(ahead, F.lit(False))) + 1).alias("position"), F.count(F.lit(1)).alias("teams"), F.first("_score").alias("score"))


def best_cell(grid: DataFrame, score: str, order: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """The cell with the highest score, the first in grid order on ties: a single aggregate, no sort."""
    cell = F.struct(*order)
    least = F.max_by(cell, F.struct(F.col(score), *[(-F.col(c)).alias(f"_{c}") for c in order]))
    return grid.groupBy(*group).agg(least.alias("cell"), F.max(score).alias(score)).select(*group, *[F.col(f"cell.{c}").alias(c) for c in order], score)


def top_n(df: DataFrame, group: Sequence[str], value: str, name: str, n: int = 3) -> DataFrame:
    """The n largest (value, name) of each group as one array, largest first; ties by name."""
    pairs = F.slice(F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("less"), F.col(name).alias("name")))), 1, n)
    return df.where(F.col(value).isNotNull()).groupBy(*group).agg(pairs.alias("top"))


def worst(df: DataFrame, group: Sequence[str], value: str, name: str, position: Column) -> DataFrame:
    """Largest value and its name (the first by position on ties; null when nothing is there)."""
    return df.groupBy(*group).agg(F.max(value).alias("max_value"), F.max_by(F.when(F.col(value).isNotNull(), F.col(name)), F.struct(F.col(value), (-position).alias("p"))).alias("worst"))


# -- reshaping -------------------------------------------------------------------------------------------------------


def wide(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str], value: str) -> DataFrame:
    """Pivot with stated values (no extra job); duplicate keys are averaged."""
    return df.groupBy(*keys).pivot(column, list(values)).agg(F.avg(value))


def long(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([*keys], [*metrics], name, value)


def crosstab(df: DataFrame, rows: str, column: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(rows).pivot(column, list(values)).count().na.fill(0)


def grid(spark, **axes: Sequence[float]) -> DataFrame:
    """The product of stated axes: a parameter table, as large as the axes say."""
    out = spark.range(1).select()
    for name, values in axes.items():
        out = out.select("*", F.explode(F.array(*[F.lit(float(v)) for v in values])).alias(name))
    return out


def grid_in(spans: DataFrame, digits: int = 3, **axes: tuple[Column, Column, float]) -> DataFrame:
    """Each row of spans with every point of its own grid. An axis: its first value, its last, and the step, as in steps()."""
    out = spans
    for name, (low, high, step) in axes.items():
        whole = F.floor((high - low + 1e-9) / step).cast("int")
        out = out.withColumn("_i", F.explode(F.when(whole >= 0, F.sequence(F.lit(0), whole)))).withColumn(f"_{name}", F.round(low + F.col("_i") * step, digits)).drop("_i")
    return out.withColumns({name: F.col(f"_{name}") for name in axes}).drop(*[f"_{name}" for name in axes])


def steps(start: float, stop: float, step: float, digits: int = 3) -> list[float]:
    """An axis of a grid: start, start + step, ... as far as stop, which counts where a rounding error parts it from a step."""
    if step <= 0:
        raise ValueError("a step is positive")
    whole = math.floor((stop - start + 1e-9) / step)
    return [round(start + i * step, digits) for i in range(whole + 1)]


# -- sets and incremental maintenance --------------------------------------------------------------------------------


def stacked(*tables: DataFrame) -> DataFrame:
    """UNION ALL by name; columns that one lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows, and the old ones whose key no new row has. Write to another path than old's."""
    return stacked(old.join(new.select(*keys).distinct(), [*keys], "left_anti"), new)


def todo(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return wanted.join(done.select(*keys).distinct(), [*keys], "left_anti")


def flagged(df: DataFrame, members: DataFrame, key: str, out: str) -> DataFrame:
    """df with whether its key is among the members."""
    return df.join(members.select(key).distinct().withColumn("_in", F.lit(True)), key, "left").withColumn(out, F.col("_in").isNotNull()).drop("_in")
