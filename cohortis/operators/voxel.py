"""Volumes: measures over a long voxel table, and kernels over array columns, one volume at a time.

Sums and percentiles of many volumes are grouped aggregates of (subject, x, y, z, value). Operators that need a voxel's
surroundings (components, distances, surfaces) run as a numpy kernel on each row's array: narrow, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K


def voxels(volumes: DataFrame, keys: Sequence[str], data: str, shape: tuple[int, int, int]) -> DataFrame:
    """keys, i, x, y, z, v for every element of an array column, x fastest."""
    nx, ny, _ = shape
    long = volumes.select(*keys, F.posexplode(data).alias("i", "v"))
    return long.select(*keys, "i", (F.col("i") % nx).alias("x"), (F.floor(F.col("i") / nx) % ny).cast("int").alias("y"), F.floor(F.col("i") / (nx * ny)).cast("int").alias("z"), F.col("v").cast("double").alias("v"))


def kernel(volumes: DataFrame, keys: Sequence[str], arrays: Sequence[str], shape: tuple[int, int, int], measure: Callable[..., list[dict]], schema: str) -> DataFrame:
    """measure(arrays as 3-D, x first) -> rows, for each volume; rows in which an array is null or of another size are left out."""
    keys, arrays, size = [*keys], [*arrays], int(np.prod(shape))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for row in pdf.itertuples(index=False):
                data = row[len(keys) :]
                if any(a is None or len(a) != size for a in data):
                    continue
                cubes = [np.asarray(a, dtype=float).reshape(shape, order="F") for a in data]
                out += [[*row[: len(keys)], *[r.get(n) for n in names]] for r in measure(*cubes)]
            yield pd.DataFrame(out, columns=[*keys, *names]).astype({c: object for c in names})

    kinds = dict(volumes.dtypes)
    return volumes.select(*keys, *arrays).mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), schema]))


# -- overlap ---------------------------------------------------------------------------------------------------------


def overlap(pairs: DataFrame, keys: Sequence[str], truth: Column, pred: Column) -> DataFrame:
    """Dice and AVD (%) from boolean columns of a voxel table; null where the denominator is 0."""
    counted = pairs.groupBy(*keys).agg(F.count_if(truth).alias("t"), F.count_if(pred).alias("p"), F.count_if(truth & pred).alias("tp"))
    return counted.select(*keys, "t", "p", "tp", F.try_divide(2.0 * F.col("tp"), F.col("t") + F.col("p")).alias("dice"), F.try_divide(100.0 * F.abs(F.col("t") - F.col("p")), F.col("t")).alias("avd_pct"))


def evaluate(cases: DataFrame, keys: Sequence[str], reference: str, prediction: str, shape, spacing) -> DataFrame:
    """All challenge metrics of each case: Dice, HD95, AVD, lesion recall, lesion F1, volumes."""
    return kernel(cases, keys, [reference, prediction], shape, lambda r, p: [K.evaluate_case(r, p, spacing)], "dice double, hd95_mm double, avd_pct double, lesion_recall double, lesion_f1 double, true_ml double, pred_ml double")


# -- components and distances ----------------------------------------------------------------------------------------


def component_sizes(volumes: DataFrame, keys: Sequence[str], data: str, shape, over: float, connectivity: int = 26) -> DataFrame:
    """keys, component (1 + its smallest index), size in voxels, for the mask data > over."""

    def measure(x: np.ndarray) -> list[dict]:
        label = K.components((x > over).transpose(2, 1, 0), connectivity)  # numbered with x fastest
        names, counts = np.unique(label[label > 0], return_counts=True)
        return [{"component": int(n), "size": int(c)} for n, c in zip(names, counts, strict=True)]

    return kernel(volumes, keys, [data], shape, measure, "component long, size long")


def lesions(sizes: DataFrame, subjects: DataFrame, keys: Sequence[str], voxel_mm3: float, least_mm3: float) -> DataFrame:
    """Number, number of at least least_mm3, median size, largest (0 if none) and its share (null if none)."""
    mm3 = F.col("size") * voxel_mm3
    each = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(mm3 >= least_mm3).alias("n_large"), F.median(mm3).alias("median_mm3"), F.max(mm3).alias("top"), F.sum(mm3).alias("total"))
    met = subjects.select(*keys).join(each, [*keys], "left")
    zero = F.lit(0).cast("long")
    return met.select(*keys, F.coalesce("n", zero).alias("n_lesions"), F.coalesce("n_large", zero).alias("n_large"), "median_mm3", (F.coalesce("top", F.lit(0.0)) / 1000).alias("largest_ml"), F.try_divide("top", "total").alias("largest_share"))


def distances(volumes: DataFrame, keys: Sequence[str], data: str, shape, spacing, of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """keys, i, d: each voxel's distance in mm to the mask of(data); null where that is empty."""

    def measure(x: np.ndarray) -> list[dict]:
        d = K.distance(of(x), spacing).ravel(order="F")
        return [{"i": i, "d": float(v) if np.isfinite(v) else None} for i, v in enumerate(d)]

    return kernel(volumes, keys, [data], shape, measure, "i int, d double")


def morphology(volumes: DataFrame, keys: Sequence[str], data: str, shape, over: float, connectivity: int = 6, times: int = 1) -> DataFrame:
    """Voxels of the mask, of its erosion (outside counts as background) and of its dilation."""
    measure = lambda x: [{"n_mask": int((x > over).sum()), "n_eroded": int(K.erode(x > over, connectivity, times).sum()), "n_dilated": int(K.dilate(x > over, connectivity, times).sum())}]
    return kernel(volumes, keys, [data], shape, measure, "n_mask long, n_eroded long, n_dilated long")


def bounding_box(long: DataFrame, keys: Sequence[str], mask: Column) -> DataFrame:
    return long.where(mask).groupBy(*keys).agg(*[f(a).cast("long").alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))])


# -- quality measures ------------------------------------------------------------------------------------------------


def region_stats(long: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """n, median and population deviation of whole-rounded values, MAD / 0.6745 of the raw values about that median; null under 2."""
    v = F.col(value)
    first = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.median(F.rint(v)).alias("med"), F.stddev_pop(F.rint(v)).alias("sd"))
    mad = long.join(first.select(*keys, "med"), [*keys]).groupBy(*keys).agg((F.median(F.abs(v - F.col("med"))) / 0.6745).alias("mad"))
    met = first.join(mad, [*keys])
    enough = F.col("n") >= 2
    return met.select(*keys, "n", *[F.when(enough, F.col(c)).alias(c) for c in ("med", "sd", "mad")])


def snr(med: Column, sd: Column, n: Column) -> Column:
    return F.try_divide(med, sd * F.sqrt(F.try_divide(n.cast("double"), n - 1)))


def snr_dietrich(med: Column, mad: Column, sd: Column) -> Column:
    return F.when(mad > 1, F.try_divide(0.6551364 * med, mad)).when(sd > 1e-3, F.try_divide(0.6551364 * med, sd))


def cnr_cjv(med_a: Column, sd_a: Column, mad_a: Column, med_b: Column, sd_b: Column, mad_b: Column, sd_air: Column) -> tuple[Column, Column]:
    gap = F.abs(med_a - med_b)
    return F.try_divide(gap, F.sqrt(sd_a**2 + sd_b**2 + sd_air**2)), F.try_divide(mad_a + mad_b, gap)


def efc(long: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Entropy focus criterion over non-zero voxels, normalised; null under 2."""
    v = F.abs(F.col(value))
    some = long.where(F.col(value) != 0)
    first = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.sum(v * v)).alias("b"))
    met = some.join(first, [*keys]).groupBy(*keys).agg(F.first("n").alias("n"), F.sum(v / F.col("b") * F.ln(v / F.col("b"))).alias("s"))
    n = F.col("n").cast("double")
    return met.select(*keys, F.when(F.col("n") >= 2, F.col("s") / (n / F.sqrt(n) * F.ln(1 / F.sqrt(n)))).alias("efc"))


def fber(long: DataFrame, keys: Sequence[str], head: Column, value: str = "v") -> DataFrame:
    """Median energy of the head over that of the air; null where the air has next to none."""
    e = F.col(value) * F.col(value)
    met = long.groupBy(*keys).agg(F.median(F.when(head, e)).alias("h"), F.median(F.when(~head, e)).alias("a"))
    return met.select(*keys, F.when(F.col("a") >= 1e-3, F.try_divide("h", "a")).alias("fber"))


def inu_range(long: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    met = long.groupBy(*keys).agg(F.percentile(value, [0.05, 0.95]).alias("q"))
    return met.select(*keys, F.abs(F.get("q", F.lit(1)) - F.get("q", F.lit(0))).alias("inu_range"))


def fwhm(long: DataFrame, keys: Sequence[str], spacing: Sequence[float], mask: Column) -> DataFrame:
    """Smoothness from the variance of neighbour differences inside the mask: mean over axes where the ratio lies in (0, 1);
    the coarse axis is left out where the largest spacing is over 1.5 times the smallest. Neighbours meet in an equi-join."""
    inside = long.where(mask)
    var = inside.groupBy(*keys).agg(F.var_pop("v").alias("var"))
    out = None
    coarse = max(spacing) > 1.5 * min(spacing)
    for axis, mm in zip("xyz", spacing, strict=True):
        if coarse and mm == max(spacing):
            continue
        other = inside.select(*keys, *[(F.col(a) - 1).alias(a) if a == axis else F.col(a) for a in "xyz"], F.col("v").alias("w"))
        d = inside.join(other, [*keys, "x", "y", "z"]).groupBy(*keys).agg(F.var_pop(F.col("w") - F.col("v")).alias("dv")).withColumn("mm", F.lit(float(mm)))
        out = d if out is None else out.unionByName(d)
    ratio = 1 - F.try_divide(F.col("dv"), 2 * F.col("var"))
    met = out.join(var, [*keys]).withColumn("r", ratio).where("r > 0 and r < 1")
    return met.groupBy(*keys).agg(F.avg(F.sqrt(-2 * F.ln(F.lit(2.0)) / F.ln("r")) * F.col("mm")).alias("fwhm"))


# -- intensities -----------------------------------------------------------------------------------------------------


def zscored(long: DataFrame, keys: Sequence[str], brain: Column) -> DataFrame:
    """long with z: (v - median) / (1.4826 MAD) of the brain's voxels; null without spread."""
    own = long.where(brain)
    centre = own.groupBy(*keys).agg(F.median("v").alias("_m"))
    spread = own.join(centre, [*keys]).groupBy(*keys).agg(F.first("_m").alias("_m"), F.median(F.abs(F.col("v") - F.col("_m"))).alias("_d"))
    return long.join(spread, [*keys], "left").withColumn("z", F.try_divide(F.col("v") - F.col("_m"), 1.4826 * F.col("_d"))).drop("_m", "_d")


def landmarks(long: DataFrame, keys: Sequence[str], percentiles: Sequence[float]) -> DataFrame:
    """keys, pos, landmark: percentiles with the first as 0 and the last as 100."""
    q = long.groupBy(*keys).agg(F.percentile("v", [p / 100 for p in percentiles]).alias("q"))
    low, high = F.get("q", F.lit(0)), F.get("q", F.lit(len(percentiles) - 1))
    return q.select(*keys, F.posexplode(F.transform("q", lambda x: F.try_divide(100 * (x - low), high - low))).alias("pos", "landmark"))


def standard(marks: DataFrame) -> DataFrame:
    """pos, standard: the landmarks averaged over the images that a normalisation is fitted on."""
    return marks.groupBy("pos").agg(F.avg("landmark").alias("standard"))


def intensity(volumes: DataFrame, keys: Sequence[str], data: str, shape, method: str, scale: np.ndarray | None = None, percentiles: Sequence[float] = (), brain: Callable[[np.ndarray], np.ndarray] = lambda x: np.ones(x.shape, dtype=bool), least: int = 100) -> DataFrame:
    """keys, i, v: each volume normalised by zscore, whitestripe, histmatch (scale: the standard) or none (scale: the constant);
    least: voxels that white stripe needs; error says why a volume couldn't be."""

    def measure(x: np.ndarray) -> list[dict]:
        own = brain(x)
        try:
            if method == "zscore":
                y = K.zscore(x, own)
            elif method == "whitestripe":
                y = K.whitestripe(x, own, least=least)
            elif method == "histmatch":
                y = K.histmatch(x, np.percentile(x[own], percentiles), scale)
            else:
                y = x / scale
        except ValueError as e:
            return [{"i": None, "v": None, "error": str(e)}]
        return [{"i": i, "v": float(v), "error": None} for i, v in enumerate(y.ravel(order="F"))]

    return kernel(volumes, keys, [data], shape, measure, "i int, v double, error string")


# -- segmentation ----------------------------------------------------------------------------------------------------


def grid_counts(cases: DataFrame, keys: Sequence[str], score: str, reference: str, shape, spacing, brain: Callable[[np.ndarray], np.ndarray], thresholds, depths, sizes) -> DataFrame:
    """keys, t, e, m, tp, pred, n_true for every cell of the grid."""

    def measure(s: np.ndarray, r: np.ndarray) -> list[dict]:
        depth = K.distance(~brain(s), spacing)
        rows = K.grid_counts(s, depth, r, thresholds, depths, sizes, float(np.prod(spacing)))
        return [dict(zip(("t", "e", "m", "tp", "pred", "n_true"), row, strict=True)) for row in rows]

    return kernel(cases, keys, [score, reference], shape, measure, "t double, e double, m double, tp long, pred long, n_true long")


def tuned(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Macro Dice of each cell (and key): the mean of the subjects' 2 tp / max(pred + n_true, 1)."""
    dice = 2 * F.col("tp") / F.greatest(F.col("pred") + F.col("n_true"), F.lit(1))
    return counts.groupBy(*keys, "t", "e", "m").agg(F.avg(dice).alias("dice"), F.count(F.lit(1)).alias("n"))


def edge_flags(best: DataFrame, grid: dict[str, Sequence[float]]) -> DataFrame:
    """Whether the best cell lies on an end of each axis."""
    return best.withColumns({f"{a}_on_edge": F.col(a).isin(float(v[0]), float(v[-1])) for a, v in grid.items()})


def frequency_map(long: DataFrame, groups: Sequence[str], mask: Column) -> DataFrame:
    """Mean of the mask at each voxel, by group and over all groups (null)."""
    sets = [[*groups, "x", "y", "z"], ["x", "y", "z"]]
    return long.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (*groups, "x", "y", "z")]).agg(F.avg(mask.cast("double")).alias("freq"))


def cohort_maps(long: DataFrame, mask: Column, source: str = "source", split: str = "split", site: str = "site", pooled: str = "O1") -> DataFrame:
    """Mean of the mask at each voxel and its subjects, by source, split and site; `all` for a site stands for all of them, and `all`
    for a split too, of the pooled source alone (others have no training of their own). One aggregation, and one shuffle."""
    xyz = ["x", "y", "z"]
    sets = [[source, split, site, *xyz], [source, split, *xyz], [source, site, *xyz], [source, *xyz]]
    made = long.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (source, split, site, *xyz)]).agg(F.avg(mask.cast("double")).alias("freq"), F.count(F.lit(1)).alias("n"), F.grouping(split).alias("_split"), F.grouping(site).alias("_site"))
    named = {c: F.when(F.col(g) == 1, "all").otherwise(F.col(c).cast("string")) for c, g in ((split, "_split"), (site, "_site"))}
    return made.where((F.col("_split") == 0) | (F.col(source) == pooled)).withColumns(named).drop("_split", "_site")


def map_agreement(maps: DataFrame, group: str, reference, value: str = "freq") -> DataFrame:
    """r of each group's map with the reference group's over the same voxels, and both means."""
    ref = maps.where(F.col(group) == reference).select("x", "y", "z", F.col(value).alias("_ref"))
    return maps.where((F.col(group) != reference) & F.col(group).isNotNull()).join(ref, ["x", "y", "z"]).groupBy(group).agg(F.corr(value, "_ref").alias("r"), F.avg(value).alias("mean"), F.avg("_ref").alias("mean_ref"))
