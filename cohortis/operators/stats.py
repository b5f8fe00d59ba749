"""Agreement and inference: closed forms, rank tests and the test of normality as DataFrame aggregates, resampling by parts.

Tests send Python only a cell's sums; resampling, one part of a cell at a time (resample.py). So a cell (a model, group and
metric, a pair of models, ...) may be of any size.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.columns import on_scale, with_normal_quantiles
from . import resample, scans
from .tabular import holm, mid_ranks


def _number(x: float) -> float | None:
    return None if x is None or np.isnan(x) else float(x)


# -- closed forms ----------------------------------------------------------------------------------------------------


def spearman(df: DataFrame, x: str, y: str, group: Sequence[str] = ()) -> DataFrame:
    """Pearson's correlation of mid-ranks, within groups; rows with a null are left out."""
    some = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = mid_ranks(mid_ranks(some, x, group, "_rx"), y, group, "_ry")
    return ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("rho"))


def kruskal_h(df: DataFrame, group: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, k, H (tie-corrected) and, for an even number of degrees, p in closed form; null where there is no spread."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value, group).agg(F.count(F.lit(1)).alias("_c"))
    # Ranks by ranges of the values, as in _rank_totals(); a value's rows lie in one range.
    ranged = counts.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id())
    c, t = F.col("_c"), F.col("_t")
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_range").orderBy(value))  # rows with the same value included
    ranked = ranged.withColumns({"_upto": upto, "_t": F.sum("_c").over(Window.partitionBy(*keys, "_range", value))})
    each = ranked.groupBy(*keys, "_range", group).agg(F.sum("_c").alias("_m"), F.sum(c * (F.col("_upto") - t + (t + 1) / 2.0)).alias("_w"), F.sum(c * (t.cast("double") ** 2 - 1)).alias("_ties"))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(*keys).orderBy("_range").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = each.withColumn("_before", before).groupBy(*keys, group).agg(F.sum("_m").alias("_m"), F.sum(F.col("_w") + F.col("_m") * F.col("_before")).alias("_s"), F.sum("_ties").alias("_ties"))
    met = sums.groupBy(*keys).agg(F.sum("_m").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("_s") ** 2 / F.col("_m")).alias("_q"), F.sum("_ties").alias("_ties"))
    n = F.col("n").cast("double")
    h = F.try_divide(12 / (n * (n + 1)) * F.col("_q") - 3 * (n + 1), 1 - F.try_divide(F.col("_ties"), n**3 - n))
    out = met.withColumn("h", F.when(F.col("k") >= 2, h))
    half = F.col("h") / 2
    # Degrees k - 1 even: exp(-h/2) times the exponential series up to (k - 3) / 2.
    series = F.aggregate(F.sequence(F.lit(0), F.greatest(F.floor((F.col("k") - 3) / 2), F.lit(0)).cast("int")), F.lit(0.0), lambda a, j: a + F.pow(half, j) / F.factorial(j))
    return out.withColumn("p", F.when(F.col("k") % 2 == 1, F.exp(-half) * series)).drop("_q", "_ties")


def _icc(n: Column, d: Column, va: Column, vb: Column, c: Column) -> Column:
    """ICC(A,1) of two ratings from their number, difference of means, (population) variances and covariance."""
    msr, msc, mse = F.try_divide(n * (va + vb + 2 * c), 2 * (n - 1)), n * d * d / 2, F.try_divide(n * (va + vb - 2 * c), 2 * (n - 1))
    return F.try_divide(msr - mse, msr + mse + 2 * (msc - mse) / n)


def icc_a1(pairs: DataFrame, keys: Sequence[str] = (), x: str = "rater", y: str = "ref") -> DataFrame:
    """ICC(A,1) of two ratings a subject, from sums alone: one aggregation."""
    a, b = F.col(x), F.col(y)
    sums = pairs.where(a.isNotNull() & b.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"), F.covar_pop(a, b).alias("c"))
    return sums.select(*keys, "n", _icc(F.col("n").cast("double"), F.col("ma") - F.col("mb"), F.col("va"), F.col("vb"), F.col("c")).alias("icc"))


def bland_altman(pairs: DataFrame, keys: Sequence[str] = (), x: str = "rater", y: str = "ref") -> DataFrame:
    """Bias, sample deviation, empirical 2.5 and 97.5 percentiles, normal limits, and (population) skew of the differences."""
    d = F.col(x) - F.col(y)
    out = pairs.withColumn("_d", d).where("_d is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("bias"), F.stddev_samp("_d").alias("sd"), F.percentile("_d", [0.025, 0.975]).alias("_q"), F.skewness("_d").alias("skew"))
    return out.select(*keys, "n", "bias", "sd", F.get("_q", F.lit(0)).alias("p2_5"), F.get("_q", F.lit(1)).alias("p97_5"), (F.col("bias") - 1.96 * F.col("sd")).alias("loa_low"), (F.col("bias") + 1.96 * F.col("sd")).alias("loa_high"), "skew")


def eta_squared(df: DataFrame, group: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Share of the variance between groups: from group sums, in two small aggregations; null without variance."""
    g = df.where(F.col(value).isNotNull()).groupBy(*keys, group).agg(F.count(F.lit(1)).alias("m"), F.avg(value).alias("mean"), F.var_pop(value).alias("v"))
    sums = g.groupBy(*keys).agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("mean")).alias("s"), F.sum(F.col("m") * F.col("mean") ** 2).alias("q"), F.sum(F.col("m") * F.col("v")).alias("within"))
    between = F.col("q") - F.col("s") ** 2 / F.col("n")
    return sums.select(*keys, "n", F.try_divide(between, between + F.col("within")).alias("eta2"))


def moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Population skewness and excess kurtosis."""
    return df.groupBy(*keys).agg(F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurtosis"))


# -- tests by exact or normal nulls ----------------------------------------------------------------------------------


def _of_sums(tail, *columns: str):
    """A column: tail(numbers) of each row, null for NaN or where a number is missing. One row a cell, so few."""

    def run(*parts: pd.Series) -> pd.Series:
        rows = zip(*(p.tolist() for p in parts), strict=True)
        return pd.Series([None if any(v is None or v != v for v in r) else _number(tail(*r)) for r in rows], dtype="object").astype(float)

    return F.pandas_udf(run, "double")(*[F.col(c).cast("double") for c in columns])


def _rank_totals(counts: DataFrame, keys: Sequence[str], value: str, also: dict[str, Column]) -> DataFrame:
    """keys, rank_sum (mid-ranks of the `_k` rows of each value), ties (the sum of t cubed less t), distinct, and more sums. counts: a row for each
    different value of a cell, of which `_t` rows are ranked and `_k` of them summed.

    Values are dealt to ranges of their order and summed there; what a range adds to the next is a number. Nothing is joined to rows.
    """
    ranged = counts.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id())
    own = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    t, k = F.col("_t"), F.col("_k")
    rank = F.coalesce(F.sum("_t").over(own), F.lit(0)) + (t + 1) / 2.0
    each = ranged.withColumn("_rank", rank).groupBy(*keys, "_range").agg(
        F.sum("_t").alias("_t"), F.sum("_k").alias("_k"), F.sum(k * F.col("_rank")).alias("_w"), F.sum(t.cast("double") ** 3 - t).alias("_ties"), F.count_if(t > 0).alias("_distinct"), *[c.alias(n) for n, c in also.items()],
    )
    before = F.coalesce(F.sum("_t").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.withColumn("_before", before)


def signed_rank_sums(df: DataFrame, keys: Sequence[str], difference: str) -> DataFrame:
    """keys, n (differences), n_signed (those that aren't zero), w_plus, ties, distinct. All in the JVM, from one reading of df. Where every
    difference is about zero, none counts as signed."""
    d = F.col(difference).cast("double")
    all_ = df.select(*keys, F.when(~F.isnan(d), d).alias("_d")).withColumn("_a", F.abs("_d"))
    counts = all_.groupBy(*keys, "_a").agg(F.count("_d").alias("_all"), F.count_if(F.col("_d") != 0).alias("_t"), F.count_if(F.col("_d") > 0).alias("_k"))
    each = _rank_totals(counts, keys, "_a", {"_all": F.sum("_all"), "_top": F.max("_a")})
    sums = each.groupBy(*keys).agg(F.sum("_all").alias("n"), F.max("_top").alias("_top"), F.sum("_t").alias("_m"), F.sum(F.col("_w") + F.col("_k") * F.col("_before")).alias("_w"), F.sum("_ties").alias("ties"), F.sum("_distinct").alias("distinct"))
    some = F.coalesce(F.col("_top") > 1e-8, F.lit(False))
    return sums.select(*keys, "n", F.when(some, F.col("_m")).otherwise(F.lit(0).cast("long")).alias("n_signed"), F.when(some, F.col("_w")).otherwise(0.0).alias("w_plus"), "ties", "distinct")


def wilcoxon(df: DataFrame, keys: Sequence[str], difference: str) -> DataFrame:
    """keys, n, p of the signed-rank test: ranks and sums by aggregates, only the tail of a few numbers in Python."""
    sums = signed_rank_sums(df, keys, difference)
    tail = lambda n, m, w, ties, distinct: K.wilcoxon_p(int(n), int(m), w, ties, int(distinct))
    return sums.select(*keys, "n", _of_sums(tail, "n", "n_signed", "w_plus", "ties", "distinct").alias("p"))


def rank_sums(df: DataFrame, keys: Sequence[str], value: str, side: str) -> DataFrame:
    """keys, n_true, n_false, rank_sum (of the true side), ties, distinct. side: a boolean column; rows without one count for
    neither."""
    v = F.col(value).cast("double")
    every = df.select(*keys, F.when(~F.isnan(v), v).alias("_v"), F.col(side).alias("_side"))
    ranked = F.col("_v").isNotNull() & F.col("_side").isNotNull()
    counts = every.groupBy(*keys, "_v").agg(F.count_if(ranked).alias("_t"), F.count_if(ranked & F.col("_side")).alias("_k"))
    each = _rank_totals(counts, keys, "_v", {})
    return each.groupBy(*keys).agg(F.sum("_k").alias("n_true"), (F.sum("_t") - F.sum("_k")).alias("n_false"), F.sum(F.col("_w") + F.col("_k") * F.col("_before")).alias("rank_sum"), F.sum("_ties").alias("ties"), F.sum("_distinct").alias("distinct"))


def mann_whitney(df: DataFrame, keys: Sequence[str], value: str, side: str) -> DataFrame:
    """keys, n_true, n_false, p of the U-test, from rank_sums(). side: a boolean column that tells the two samples apart."""
    sums = rank_sums(df, keys, value, side)
    tail = lambda n, m, r, ties, distinct: K.mann_whitney_p(int(n), int(m), r, ties, int(distinct))
    return sums.select(*keys, "n_true", "n_false", _of_sums(tail, "n_true", "n_false", "rank_sum", "ties", "distinct").alias("p"))


def kruskal(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """H and p for any number of groups: H by aggregates, the tail of two numbers in Python."""
    h = kruskal_h(df.withColumn("_v", F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))), group, "_v", keys)
    return h.select(*keys, "h", _of_sums(lambda x, k: K.chi2_tail(x, int(k) - 1), "h", "k").alias("p"))


def shapiro_sums(ranked: DataFrame, keys: Sequence[str], value: str, row: str, sizes: DataFrame) -> DataFrame:
    """keys, n, w of Shapiro and Wilk's test, from rows numbered by value in their cell. sizes: keys, n.

    W is the square of a weighted sum of the ordered values over their sum of squares. Weights are normal scores of the ranks but for
    the two outermost on each side, which depend on n alone; so one aggregate has all that W needs.
    """
    x, i, n = F.col(value), F.col(row), F.col("n")
    score = F.col("_score")
    outer = F.when(n > 5, 2).otherwise(1)
    at = lambda k: F.max(F.when(i == k, x))
    scored = with_normal_quantiles(scans.beside(ranked, sizes, keys, "n"), _score=(i - 0.375) / (n + 0.25))
    sums = scored.groupBy(*keys).agg(
        F.first("n").alias("n"), F.sum(score * score).alias("_total"), F.sum(F.when((i > outer) & (i <= n - outer), score * x)).alias("_inner"), (F.var_pop(x) * F.count(x)).alias("_ss"),
        at(1).alias("_x1"), at(2).alias("_x2"), at(n - 1).alias("_y2"), at(n).alias("_y1"),
    )
    n, total = F.col("n").cast("double"), F.col("_total")
    sums = with_normal_quantiles(sums, _last=(n - 0.375) / (n + 0.25), _next=F.greatest(n - 1.375, F.lit(0.5)) / (n + 0.25))
    u, last, next_ = 1 / F.sqrt(n), F.col("_last"), F.col("_next")
    poly = lambda c: sum((F.lit(k) * F.pow(u, F.lit(float(p))) for p, k in enumerate(c) if k), F.lit(0.0))
    sums = sums.withColumns({"_a1": last / F.sqrt(total) + poly(K.SHAPIRO_LAST), "_a2": next_ / F.sqrt(total) + poly(K.SHAPIRO_NEXT)})
    a1, a2 = F.col("_a1"), F.col("_a2")
    many, few = (total - 2 * last**2 - 2 * next_**2) / (1 - 2 * a1**2 - 2 * a2**2), (total - 2 * last**2) / (1 - 2 * a1**2)
    ends = F.col("_y1") - F.col("_x1")
    inner = F.coalesce("_inner", F.lit(0.0))
    weighed = F.when(n == 3, F.sqrt(F.lit(0.5)) * ends).when(n > 5, inner / F.sqrt(many) + a1 * ends + a2 * (F.col("_y2") - F.col("_x2"))).otherwise(inner / F.sqrt(few) + a1 * ends)
    w = F.when((n >= 3) & (ends > 0), F.least(F.lit(1.0), F.try_divide(weighed * weighed, F.col("_ss"))))
    return sums.select(*keys, "n", w.alias("w"))


def shapiro(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, n, w, p of the test of normality; null under three values or without spread. Only w and n reach Python."""
    v = F.col(value).cast("double")
    every = df.select(*keys, F.when(~F.isnan(v), v).alias("_v"))
    sizes = every.groupBy(*keys).agg(F.count("_v").alias("n"))
    ranked = scans.numbered(every.where("_v is not null"), keys, ["_v"], "_row")
    w = shapiro_sums(ranked, keys, "_v", "_row", sizes)
    met = scans.beside(sizes, w, keys, "w")
    return met.select(*keys, "n", "w", _of_sums(lambda n, w: K.shapiro_p(int(n), w), "n", "w").alias("p"))


# -- resampling ------------------------------------------------------------------------------------------------------


SCALES = ("log", "log1p", "raw")


def _clean(c: Column) -> Column:
    """A number, null for NaN."""
    return F.when(~F.isnan(c.cast("double")), c.cast("double"))


def bootstrap_ci(df: DataFrame, keys: Sequence[str], value: str, stratum: str, order: str, n_boot: int = 2000, seed: int = 42, together: Sequence[str] = (), groups: Column | None = None, group: str = "group") -> DataFrame:
    """n, n_missing, mean and a percentile interval of the mean, resampled within strata. Draws are seeded by cell and part, so
    results don't depend on partitioning.

    together: keys whose cells may share draws (resample.stratum_sums). groups: an array of labels; a row counts in the cells of each of
    them, under the key `group`. Where labels go by the stratum, as is checked, a stratum is drawn once for all its groups.
    """
    keys = [*keys]
    some = df.select(*[k for k in keys if groups is None or k != group], _clean(F.col(value)).alias("v"), F.col(stratum).alias("s"), F.col(order).alias("o"), *([] if groups is None else [groups.alias("_groups")]))
    some = resample.written(some, "bootstrap")  # read by sums and draws
    count = lambda d, by: d.groupBy(*by).agg(F.count("v").alias("n"), F.count_if(F.col("v").isNull()).alias("n_missing"), F.sum("v").alias("_sum"))
    told = None
    if groups is not None:
        name = F.coalesce(F.col("s").cast("string"), F.lit("\x00"))
        told = resample.written(some.select(name.alias("_s"), "_groups").distinct(), "groups")  # a row a stratum, if all is well
        if told.groupBy("_s").count().where("count > 1").limit(1).count():
            some, told = some.withColumn(group, F.explode("_groups")).drop("_groups"), None
    if told is None:
        sums = count(some, keys)
        drawn = resample.means(some.where("v is not null"), keys, "v", "s", "o", n_boot, seed, together=together)
    else:
        base = [k for k in keys if k != group]
        labels = told.select("_s", F.explode("_groups").alias(group))
        each = count(some.withColumn("_s", name), [*base, "_s"]).join(labels, "_s")
        sums = each.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "n_missing", "_sum")])
        by_stratum = resample.stratum_sums(some.where("v is not null"), base, "v", "s", "o", n_boot, seed, together=together)
        drawn = by_stratum.join(labels, "_s").groupBy(*keys, "_draw").agg((F.sum("_v") / F.sum("_n")).alias("_mean"))
    sums = sums.withColumn("mean", F.try_divide("_sum", "n")).drop("_sum")
    found = resample.intervals(drawn, keys, ci="_mean").withColumnsRenamed({"ci_from": "low", "ci_to": "high"})
    return scans.beside(sums, found, keys, "low", "high")


def paired_table(pairs: DataFrame, stratum: str, subject: str, n_boot: int = 2000, seed: int = 42) -> DataFrame:
    """From (family, a, b, metric, va, vb): n, means, mean difference with interval, signed-rank p, and Holm within family."""
    keys = ["family", "a", "b", "metric"]
    every = pairs.select(*keys, F.col(stratum).alias("s"), F.col(subject).alias("o"), _clean(F.col("va")).alias("va"), _clean(F.col("vb")).alias("vb")).withColumn("d", F.col("va") - F.col("vb"))
    every = resample.written(every, "pairs")  # read by sums, ranks, and draws
    both = F.col("d").isNotNull()
    mean = lambda c: F.avg(F.when(both, F.col(c)))
    sums = every.groupBy(*keys).agg(F.count("d").alias("n"), mean("va").alias("mean_a"), mean("vb").alias("mean_b"), F.avg("d").alias("mean_diff"))
    found = resample.intervals(resample.means(every.where(both), keys, "d", "s", "o", n_boot, seed, together=["metric"]), keys, ci="_mean").withColumnsRenamed({"ci_from": "low", "ci_to": "high"})
    met = scans.beside(scans.beside(sums, found, keys, "low", "high"), wilcoxon(every, keys, "d"), keys, "p")
    return holm(met, ["family"], "p", ["a", "b", "metric"])


def unpaired_table(long: DataFrame, keys: Sequence[str], side: str, stratum: str, subject: str, family: Sequence[str], n_boot: int = 2000, seed: int = 42, together: Sequence[str] = ()) -> DataFrame:
    """Unseen less seen (side: whether seen) of (keys, value): means, difference with interval, U-test p, Holm in the family.
    Cells with an empty side are left out; the sides are drawn apart. together: keys whose cells may share draws."""
    keys = [*keys]
    some = long.select(*keys, F.col(side).alias("_side"), F.col(stratum).alias("s"), F.col(subject).alias("o"), _clean(F.col("value")).alias("v")).where("v is not null and _side is not null")
    some = resample.written(some, "sides")  # read by sums, ranks, and draws
    seen, unseen = F.when(F.col("_side"), F.col("v")), F.when(~F.col("_side"), F.col("v"))
    sums = some.groupBy(*keys).agg(F.count(seen).alias("n_seen"), F.count(unseen).alias("n_unseen"), F.avg(seen).alias("mean_seen"), F.avg(unseen).alias("mean_unseen")).where("n_seen > 0 and n_unseen > 0")
    sums = sums.withColumn("diff", F.col("mean_unseen") - F.col("mean_seen"))
    drawn = resample.means(some, [*keys, "_side"], "v", "s", "o", n_boot, seed, together=together)
    apart = drawn.groupBy(*keys, "_draw").agg((F.max(F.when(~F.col("_side"), F.col("_mean"))) - F.max(F.when(F.col("_side"), F.col("_mean")))).alias("_diff"))
    found = resample.intervals(apart, keys, ci="_diff").withColumnsRenamed({"ci_from": "low", "ci_to": "high"})
    met = scans.beside(scans.beside(sums, found, keys, "low", "high"), mann_whitney(some, keys, "v", "_side"), keys, "p")
    return holm(met, family, "p", keys)


def _scaled(c: Column, kind: str | Column) -> Column:
    """A number on a scale, which may be a column's."""
    if isinstance(kind, str):
        return _clean(on_scale(c, kind))
    out = F.when(kind == SCALES[0], on_scale(c, SCALES[0]))
    for k in SCALES[1:]:
        out = out.when(kind == k, on_scale(c, k))
    return _clean(out)


def agreement(pairs: DataFrame, keys: Sequence[str], kind: str | Column, stratum: str, subject: str, n_boot: int = 2000, seed: int = 42, least: int = 3, part: int = resample.PART) -> DataFrame:
    """ICC and limits of agreement of (rater, ref) on a scale (one of SCALES, or a column that says which, one for a cell), with bootstrap
    intervals, the number left out of the scale, and bias back on the ratio scale for log. Fewer than `least` subjects: counts only.

    Rows are numbered by difference in their cell once. Of each resample, the ICC comes from sums over the parts, and a limit is the
    value at two ranks (interpolated, as a percentile is), which the one part that holds them finds.
    """
    keys = [*keys]
    q = (0.025, 0.975)
    x, y = _scaled(F.col("rater"), kind), _scaled(F.col("ref"), kind)
    every = pairs.select(*keys, F.coalesce(F.col(stratum).cast("string"), F.lit("\x00")).alias("_s"), F.col(subject).alias("_o"), x.alias("x"), y.alias("y"), (F.col("rater") - F.col("ref")).alias("raw"), (F.lit(kind) == "log").alias("_log"))
    every = every.withColumns({"d": F.col("x") - F.col("y"), "_cell": resample.cell_name(keys)})
    every = resample.written(every, "agreement")  # read by sums, order, and draws
    ok = F.col("d").isNotNull()
    of = lambda f, c: f(F.when(ok, F.col(c)))
    sums = every.groupBy("_cell", *keys).agg(F.count("d").alias("n"), F.count_if(~ok).alias("n_excluded"), of(F.avg, "x").alias("mx"), of(F.avg, "y").alias("my"), of(F.var_pop, "x").alias("vx"), of(F.var_pop, "y").alias("vy"), F.covar_pop(F.when(ok, F.col("x")), F.when(ok, F.col("y"))).alias("c"), F.avg("d").alias("bias"), F.stddev_samp("d").alias("sd"), of(F.avg, "raw").alias("raw_diff"), F.first("_log").alias("_log"))
    sums = resample.written(sums, "agreement-sums")  # a row a cell
    enough = resample.few(sums.where(F.col("n") >= least).select("_cell", "n", ((F.col("mx") + F.col("my")) / 2).alias("_mid")))
    rows = scans.placed(every.where(ok).select("_cell", "_s", "_o", "x", "y", "d"), ["_cell"], ["d", "_s", "_o", "x"])
    rows = scans.row_numbers(rows, ["_cell"], "_row").drop(scans.AT).join(enough, "_cell")
    rows = resample.written(rows, "agreement-rows")  # read by draws, limits, and the test of normality
    # Sums of values about the cell's middle, so that squares keep their digits.
    u, v = F.col("x") - F.col("_mid"), F.col("y") - F.col("_mid")
    dealt = rows.withColumns({"_part": F.floor((F.col("_row") - 1) / part), "_levels": resample.levels(F.ceil(F.col("n") / part)), "u": u, "v": v, "uu": u * u, "vv": v * v, "uv": u * v})
    walks = resample.written(resample.paths(dealt), "paths")
    by_part = resample.written(resample.draws(dealt, ["_o", "d"], ["u", "v", "uu", "vv", "uv"], n_boot, seed, by_part=True, walks=walks), "agreement-draws")
    whole = by_part.groupBy("_cell", "_draw").agg(*[F.sum(c).alias(c) for c in ("_n", "u", "v", "uu", "vv", "uv")])
    m = {c: F.col(c) / F.col("_n") for c in ("u", "v", "uu", "vv", "uv")}
    icc = _icc(F.col("_n").cast("double"), m["u"] - m["v"], m["uu"] - m["u"] ** 2, m["vv"] - m["v"] ** 2, m["uv"] - m["u"] * m["v"])
    # A percentile lies between two ranks, the same of every resample of a cell.
    place = [(F.col("n") - 1) * p for p in q]
    ends = F.array(*[F.struct(F.lit(i).alias("limit"), f(at).cast("long").alias("_rank"), (at - F.floor(at)).alias("_share"), F.lit(high).alias("high")) for i, at in enumerate(place) for high, f in ((False, F.floor), (True, F.ceil))])
    wanted = enough.select("_cell", F.explode(ends).alias("e")).select("_cell", "e.*")
    between = lambda value: F.max(F.when(~F.col("high"), F.col(value) * (1 - F.col("_share")))) + F.max(F.when(F.col("high"), F.col(value) * F.col("_share")))
    found = resample.order_statistics(dealt, ["_o", "d"], "d", by_part, wanted.select("_cell", "_rank").distinct(), n_boot, seed, walks)
    limits = found.join(wanted, ["_cell", "_rank"]).groupBy("_cell", "_draw", "limit").agg(between("d").alias("at"))
    limits = limits.groupBy("_cell", "_draw").agg(*[F.max(F.when(F.col("limit") == i, F.col("at"))).alias(f"loa_{w}") for i, w in enumerate(("low", "high"))])
    spread = scans.beside(resample.intervals(whole.withColumn("icc", icc), ["_cell"], icc="icc"), resample.intervals(limits, ["_cell"], loa_low="loa_low", loa_high="loa_high"), ["_cell"], *[f"loa_{w}_{e}" for w in ("low", "high") for e in ("from", "to")])
    own = rows.withColumn("_rank", F.col("_row") - 1).join(wanted, ["_cell", "_rank"]).groupBy("_cell", "limit").agg(between("d").alias("at"))
    own = own.groupBy("_cell").agg(*[F.max(F.when(F.col("limit") == i, F.col("at"))).alias(f"loa_{w}") for i, w in enumerate(("low", "high"))])
    w = shapiro_sums(rows.select("_cell", "d", "_row"), ["_cell"], "d", "_row", enough.select("_cell", "n")).select("_cell", "w")
    met = sums.join(spread, "_cell", "left").join(own, "_cell", "left").join(w, "_cell", "left")
    some = lambda c: F.when(F.col("n") >= least, c)
    p = _of_sums(lambda n, w: K.shapiro_p(int(n), w), "n", "w")
    whole_icc = _icc(F.col("n").cast("double"), F.col("mx") - F.col("my"), F.col("vx"), F.col("vy"), F.col("c"))
    ratio = F.when(F.col("_log"), F.exp("bias"))
    return met.select(
        *keys, "n", "n_excluded", some(whole_icc).alias("icc"), "icc_from", "icc_to", some(F.col("bias")).alias("bias"), some(F.col("sd")).alias("sd"),
        "loa_low", "loa_low_from", "loa_low_to", "loa_high", "loa_high_from", "loa_high_to", p.alias("shapiro_p"), some(F.col("raw_diff")).alias("raw_diff"), some(ratio).alias("ratio"),
    )


def biases(pairs: DataFrame, keys: Sequence[str], scanner: str, subject: str, kind: str | Column, n_boot: int = 2000, seed: int = 42, least: int = 3, together: Sequence[str] = ()) -> DataFrame:
    """Mean difference on the scale in each scanner with at least `least` subjects, its interval, and the signed-rank p. together: keys
    whose cells may share draws."""
    keys = [*keys, scanner]
    some = pairs.select(*keys, F.col(subject).alias("o"), (_scaled(F.col("rater"), kind) - _scaled(F.col("ref"), kind)).alias("d")).where("d is not null")
    some = resample.written(some, "biases")  # read by sums, ranks, and draws
    sums = some.groupBy(*keys).agg(F.count("d").alias("n"), F.avg("d").alias("bias")).where(F.col("n") >= least)
    found = resample.intervals(resample.means(some, keys, "d", None, "o", n_boot, seed, together=together), keys, ci="_mean").withColumnsRenamed({"ci_from": "low", "ci_to": "high"})
    return scans.beside(scans.beside(sums, found, keys, "low", "high"), wilcoxon(some, keys, "d"), keys, "p")


def bias_by_scanner(pairs: DataFrame, keys: Sequence[str], scanner: str, subject: str, kind: str, n_boot: int = 2000, seed: int = 42, least: int = 3) -> DataFrame:
    """biases() with Holm over all rows."""
    return holm(biases(pairs, keys, scanner, subject, kind, n_boot, seed, least), [], "p", [*keys, scanner])


def agreement_run(table: DataFrame, kinds: dict[str, str], reference: str, sources: Sequence[str] | None = None, only_in: dict[str, Sequence[str]] | None = None, subject: str = "participant_id", source: str = "source", scanner: str = "scanner", split: str = "split", n_boot: int = 2000, seed: int = 42, least: int = 3, tables: Sequence[str] = ("overall", "by_scanner")) -> tuple[DataFrame | None, DataFrame | None]:
    """(overall, by scanner; None for one that isn't among the tables asked for) for every biomarker, split and source beside the reference source.

    kinds: biomarker column -> its scale. sources: those that count (all). only_in: split -> the only sources that count there.
    overall: split, rater_name, biomarker, what agreement() says, and Kruskal and Wallis's test of the differences between scanners, adjusted by Holm
    over all of overall's tests. By scanner: biases(), adjusted by Holm over all rows of all biomarkers and sources.
    """
    named = ["split", "rater_name", "biomarker"]
    long = table.select(F.col(subject).alias("subject"), F.col(scanner).alias("scanner"), F.col(split).alias("split"), F.col(source).alias("source"), *kinds)
    long = long.unpivot(["subject", "scanner", "split", "source"], [*kinds], "biomarker", "value")
    ref = long.where(F.col("source") == reference).select("subject", "split", "biomarker", F.col("value").alias("ref"))
    pairs = long.where(F.col("source") != reference).select("subject", "scanner", "split", "biomarker", F.col("source").alias("rater_name"), F.col("value").alias("rater")).join(ref, ["subject", "split", "biomarker"])
    if sources is not None:
        pairs = pairs.where(F.col("rater_name").isin(*sources))
    for part, own in (only_in or {}).items():
        pairs = pairs.where((F.col("split") != part) | F.col("rater_name").isin(*own))
    pairs = resample.written(pairs, "agreement-pairs")
    # One run over all biomarkers: each row knows its scale.
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("biomarker"))
    overall = by_scanner = None
    if "overall" in tables:
        # Differences that only a rounding error parts are ties.
        d = pairs.select(*named, "scanner", F.round(_scaled(F.col("rater"), kind) - _scaled(F.col("ref"), kind), 12).alias("d"))
        tested = holm(kruskal(d, named, "scanner", "d"), [], "p", named).withColumnsRenamed({"h": "h_site", "p": "p_site", "p_holm": "p_site_holm"})
        overall = scans.beside(agreement(pairs, named, kind, "scanner", "subject", n_boot, seed, least), tested, named, "h_site", "p_site", "p_site_holm")
    if "by_scanner" in tables:
        by_scanner = holm(biases(pairs, named, "scanner", "subject", kind, n_boot, seed, least, together=["biomarker"]), [], "p", [*named, "scanner"])
    return overall, by_scanner
