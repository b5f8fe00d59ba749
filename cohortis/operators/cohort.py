"""Compositions over a cohort: quality measures of an image, outlier classes and their validation, biomarker tables,
feature rows, scanner effects, the threshold model applied."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.columns import from_scale, geometry, on_scale, qc_class, same_grid, valid_labels, voxel_volume
from ..session import written
from . import ml, stats
from . import tabular as R
from .voxel import kernel

# -- image quality ---------------------------------------------------------------------------------------------------

MEASURES = "snr_wm double, snrd_wm double, cnr double, cjv double, efc double, fber double, inu_range double, fwhm double, n_wm long, n_air long"


def air(image: np.ndarray, head: np.ndarray, margin: int = 3) -> np.ndarray:
    """What is farther than `margin` steps from the head; exact zeros, which defacing leaves, are no air."""
    return (image != 0) & ~K.dilate(head, 6, margin)


def image_quality(raw: np.ndarray, field: np.ndarray, white: np.ndarray, grey: np.ndarray, brain: np.ndarray, head: np.ndarray, spacing) -> dict:
    """All of MEASURES from a raw image, its bias field and its masks; None where one is undefined.

    The corrected image is scaled so that the white matter's median is 1000. Smoothness is the raw image's, uniformity the
    field's.
    """
    image = np.where(field > 0, raw / np.where(field > 0, field, 1), 0.0)
    level = float(np.median(image[white])) if white.any() else 0.0
    if level:
        image = image * (1000 / level)
    around = air(raw, head)

    def region(mask: np.ndarray) -> tuple[float, float, float, int]:
        """Median and deviation of whole-rounded values, spread of the raw ones about that median, number."""
        values = image[mask]
        if len(values) < 2 or not level:
            return np.nan, np.nan, np.nan, len(values)
        whole = np.rint(values)
        middle = float(np.median(whole))
        return middle, float(whole.std()), float(np.median(np.abs(values - middle))) / 0.6745, len(values)

    with np.errstate(divide="ignore", invalid="ignore"):
        (wm, wm_sd, wm_mad, n), (gm, gm_sd, gm_mad, _), (_, air_sd, air_mad, n_air) = region(white), region(grey), region(around)
        gap, some = np.float64(abs(wm - gm)), np.abs(image[image != 0])
        norm = np.sqrt((some**2).sum())
        most = np.sqrt(len(some)) * np.log(1 / np.sqrt(max(len(some), 1)))
        foreground, background = (float(np.median(image[m] ** 2)) if m.any() else 0.0 for m in (head, around))
        out = {
            "snr_wm": wm / (np.float64(wm_sd) * np.sqrt(n / max(n - 1, 1))),
            "snrd_wm": 0.6551364 * wm / (air_mad if air_mad > 1 else air_sd if air_sd > 1e-3 else np.nan),
            "cnr": gap / np.sqrt(wm_sd**2 + gm_sd**2 + air_sd**2),
            "cjv": (wm_mad + gm_mad) / gap,
            "efc": float((some / norm * np.log(some / norm)).sum() / most) if len(some) >= 2 else np.nan,
            "fber": foreground / background if background >= 1e-3 else np.nan,
            "inu_range": float(np.ptp(np.percentile(field[brain], [5, 95]))) if brain.any() else np.nan,
            "fwhm": smoothness(raw, brain, spacing),
        }
    return {k: float(v) if np.isfinite(v) else None for k, v in out.items()} | {"n_wm": int(white.sum()), "n_air": int(around.sum())}


def smoothness(image: np.ndarray, mask: np.ndarray, spacing) -> float:
    """In-plane full width at half maximum, in mm, from the variance of differences between neighbours inside the mask."""
    spread, found = float(image[mask].var()) if mask.any() else 0.0, []
    fine = [a for a in range(3) if max(spacing) <= 1.5 * min(spacing) or a != int(np.argmax(spacing))]
    for axis in fine if spread > 0 else []:
        inside, steps = np.moveaxis(mask, axis, 0), np.diff(np.moveaxis(image, axis, 0), axis=0)
        steps = steps[inside[1:] & inside[:-1]]
        share = steps.var() / (2 * spread) if len(steps) else 0.0
        if 0 < share < 1:
            found.append(spacing[axis] * np.sqrt(-2 * np.log(2) / np.log(1 - share)))
    return float(np.mean(found)) if found else np.nan


def quality_measures(volumes: DataFrame, keys: Sequence[str], arrays: Sequence[str], shape, spacing) -> DataFrame:
    """keys and MEASURES of each image. arrays: raw, field, white, grey, brain, head (masks over 0.5)."""

    def measure(raw, field, *masks) -> list[dict]:
        return [image_quality(raw, field, *(m > 0.5 for m in masks), spacing)]

    return kernel(volumes, keys, arrays, shape, measure, MEASURES)


# -- outliers --------------------------------------------------------------------------------------------------------


def classified(badness: DataFrame, key: str, position: Column, check: float = 3.0, exclude: float = 5.0, contamination: float = 0.05, trees: int = 500, seed: int = 42) -> DataFrame:
    """key, max_z, worst_metric, iforest_score, iforest_outlier, qc_class from (key, name, z): larger z is worse, null where a
    group is too small. The forest sees assessed subjects only, z under 0 and missing ones as 0."""
    top = R.worst(badness, [key], "z", "name", position).withColumnsRenamed({"max_value": "max_z", "worst": "worst_metric"})
    names = sorted(r.name for r in badness.select("name").distinct().collect())  # judged measures, a stated list
    wide = R.wide(badness.join(top.where("max_z is not null").select(key), key, "left_semi"), [key], "name", names, "z")
    wide = written(wide, "badness")  # a row for each subject, read again for the fit, the cut and the scores
    forest = ml.isolation_forest(wide.withColumnsRenamed({n: f"z_{i}" for i, n in enumerate(names)}), key, [f"z_{i}" for i in range(len(names))], trees, contamination, seed)
    met = top.join(forest.select(key, "iforest_score", "iforest_outlier"), key, "left").withColumn("iforest_outlier", F.coalesce("iforest_outlier", F.lit(False)))
    return met.withColumn("qc_class", qc_class(F.col("max_z"), F.col("iforest_outlier"), F.col("max_z").isNotNull(), check, exclude))


def validated(flags: DataFrame, evaluation: DataFrame, key: str, score: str, value: str) -> DataFrame:
    """One row: n_test, n_flagged, medians of value for usable and flagged subjects, the rank test's p between them, and the rank
    correlation of score and value. flags: key, qc_class, score; evaluation: key, value."""
    met = flags.join(evaluation.select(key, value), key)
    flagged = F.col("qc_class").isin("check", "exclude")
    usable = F.col("qc_class") == "usable"
    one = met.agg(F.count(F.lit(1)).alias("n_test"), F.count_if(flagged).alias("n_flagged"), F.median(F.when(usable, F.col(value))).alias("median_usable"), F.median(F.when(flagged, F.col(value))).alias("median_flagged"))
    some = met.where(usable | flagged).select(F.lit(1).alias("_one"), F.col(value).alias("_v"), flagged.alias("_side"))
    test = stats.mann_whitney(some, ["_one"], "_v", "_side").select("p")
    rho = stats.spearman(met, score, value).select("rho")
    # Three tables of one row, or none.
    return one.withColumn("_k", F.lit(1)).join(test.withColumn("_k", F.lit(1)), "_k", "left").join(rho.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")


# -- tables of effects -----------------------------------------------------------------------------------------------


def scanner_effects(long: DataFrame, families: DataFrame, model: str = "model", scanner: str = "scanner") -> DataFrame:
    """family, model, metric, n, k, h, p, p_holm: whether a metric depends on the scanner, Holm within a model's first family.
    long: model, scanner, metric, value."""
    h = stats.kruskal_h(long, scanner, "value", [model, "metric"])
    named = h.join(R.first_family(h.select(model).distinct(), families), model)
    return R.holm(named, ["family"], "p", [model, "metric"])


def paired_with(table: DataFrame, model: str, raters: Sequence[str], metrics: dict[str, bool], key: str = "participant", rater: str = "model") -> DataFrame:
    """rater, metric, n, means, mean difference and the number of subjects on which the model is better, over shared subjects.
    metrics: name -> whether higher is better."""
    long = R.long(table, [key, rater], [*metrics])
    ours = long.where(F.col(rater) == model).select(key, "metric", F.col("value").alias("v"))
    met = long.where(F.col(rater).isin(*raters)).join(ours, [key, "metric"]).where("v is not null and value is not null")
    gain = (F.col("v") - F.col("value")) * F.when(F.col("metric").isin(*[m for m, higher in metrics.items() if higher]), 1).otherwise(-1)
    return met.groupBy(F.col(rater).alias("rater"), "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean_model"), F.avg("value").alias("mean_rater"), F.avg(F.col("v") - F.col("value")).alias("mean_diff"), F.count_if(gain > 0).alias("n_better"))


def shared_cases(table: DataFrame, model: str, raters: Sequence[str], reference: str, value: str, kind: str, key: str = "participant", source: str = "model") -> DataFrame:
    """rater, n, bias, ratio_min, ratio_max, icc on the subjects that the model has: with so few, the range of the ratios stands
    for limits of agreement. kind: log, log1p or raw."""
    pairs = R.rater_pairs(table.join(table.where(F.col(source) == model).select(key).distinct(), key, "left_semi"), [key], source, reference, value).where(F.col("rater_name").isin(model, *raters))
    some = pairs.withColumns({"x": on_scale(F.col("rater"), kind), "y": on_scale(F.col("ref"), kind)}).where("x is not null and y is not null")
    d = F.col("x") - F.col("y")
    spread = some.groupBy("rater_name").agg(F.avg(d).alias("bias"), from_scale(F.min(d), kind).alias("ratio_min"), from_scale(F.max(d), kind).alias("ratio_max"))
    return stats.icc_a1(some, ["rater_name"], "x", "y").join(spread, "rater_name").withColumnRenamed("rater_name", "rater")


def biology(features: DataFrame, key: str, names: Sequence[str], site: str, covariate: str) -> DataFrame:
    """feature, eta2_before, eta2_after, rho_before, rho_after: how much of each feature is the site's, and how it goes with the
    covariate, before and after ComBat that keeps the covariate."""
    both = None
    for when, table in (("before", features), ("after", ml.combat(features, key, names, site, [covariate]).join(features.select(key, covariate), key))):
        # Written: what follows reads it several times, and its plan names each feature in each of them.
        long = written(R.long(table, [key, site, covariate], names, "feature"), "biology")
        eta = stats.eta_squared(long, site, "value", ["feature"]).select("feature", F.col("eta2").alias(f"eta2_{when}"))
        rho = stats.spearman(long, "value", covariate, ["feature"]).select("feature", F.col("rho").alias(f"rho_{when}"))
        met = eta.join(rho, "feature")
        both = met if both is None else both.join(met, "feature")
    return both


# -- biomarkers ------------------------------------------------------------------------------------------------------


def biomarker_table(long: DataFrame, keys: Sequence[str], sources: dict[str, Column], other: Column, brain: Column, inside: Column, voxel_ml: float) -> DataFrame:
    """keys, source, wmh_ml, wmh_pct_brain, icv_ml, wmh_pct_icv: a row for each mask, all of them from one aggregation of a voxel
    table. other: pathology that counts for none; inside: of the skull, for the intracranial volume."""
    counted = long.groupBy(*keys).agg(F.count_if(brain).alias("_brain"), F.count_if(inside).alias("_icv"), *[F.count_if(mask & ~other).alias(f"_{i}") for i, mask in enumerate(sources.values())])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("source"), F.col(f"_{i}").alias("n")) for i, name in enumerate(sources)]))
    met = counted.select(*keys, "_brain", "_icv", each.alias("s"))
    return met.select(*keys, "s.source", (F.col("s.n") * voxel_ml).alias("wmh_ml"), F.try_divide(100.0 * F.col("s.n"), "_brain").alias("wmh_pct_brain"), (F.col("_icv") * voxel_ml).alias("icv_ml"), F.try_divide(100.0 * F.col("s.n"), "_icv").alias("wmh_pct_icv"))


def inventory(images: DataFrame, key: str, image: str, raters: dict[str, str], defacing: str, allowed: Sequence[float] = (0, 1, 2)) -> DataFrame:
    """A row for each subject that has the image: its geometry as text, whether all forms agree, for each rater whether the labels are
    valid and on the image's grid and their volumes in ml, and what was defaced.

    images: key, kind, shape, spacing, affine, axcodes, dtype, forms_agree, data; one of a kind (of several the least by geometry).
    raters: kind -> prefix of its columns; a subject without the kind has nulls, one with invalid labels no volume. Arrays are
    measured where they lie; only figures are brought together, and the image's values only for subjects that have the mask
    `defacing`: the share of values between 0 and 1, the share removed (0), and whether the image is 0 there.
    """
    lesion = lambda n: F.size(F.filter("data", lambda v: F.rint(v) == n))
    fits = valid_labels(F.col("data").cast("array<double>"), list(allowed))
    row = images.select(
        key, "kind", "shape", "spacing", "affine", "axcodes", "dtype", "forms_agree", F.when(F.col("kind").isin(*raters), fits).alias("valid"),
        F.when(F.col("kind").isin(*raters), lesion(1)).alias("ones"), F.when(F.col("kind").isin(*raters), lesion(2)).alias("twos"),
    )
    own = F.struct("shape", "spacing", "affine", "axcodes", "dtype", "valid", "ones", "twos")
    kinds = {image: "_image", defacing: "_mask", **{k: f"_{p}" for k, p in raters.items()}}
    met = row.groupBy(key).agg(*[F.min(F.when(F.col("kind") == k, own)).alias(c) for k, c in kinds.items()], F.coalesce(F.bool_and(F.when(F.col("kind") == image, F.col("forms_agree"))), F.lit(True)).alias("forms_agree")).where("_image is not null")
    ml = voxel_volume(F.col("_image.spacing")) / 1000
    on_grid = lambda c: same_grid(F.col(f"{c}.shape"), F.col(f"{c}.affine"), F.col("_image.shape"), F.col("_image.affine"))
    volume = lambda p, n: F.when(F.col(f"_{p}.valid"), F.round(F.col(f"_{p}.{n}") * ml, 2))
    judged = [x for p in raters.values() for x in (F.col(f"_{p}.valid").alias(f"{p}_valid"), on_grid(f"_{p}").alias(f"{p}_same_grid"), volume(p, "ones").alias(f"{p}_wmh_ml"), volume(p, "twos").alias(f"{p}_other_ml"))]
    figures = met.select(key, geometry(F.col("_image.shape"), "%d").alias("shape"), geometry(F.col("_image.spacing")).alias("voxel_mm"), F.col("_image.axcodes").alias("axcodes"), F.col("_image.dtype").alias("dtype"), "forms_agree", *judged, F.col("_mask").isNotNull().alias("defaced"), on_grid("_mask").alias("mask_same_grid"))

    masks = images.where(F.col("kind") == defacing).select(key, F.col("data").alias("_m"))
    both = masks.join(images.where(F.col("kind") == image).select(key, F.col("data").alias("_v")), key)
    share = lambda test: F.try_divide(F.size(F.filter("_m", test)), F.size("_m"))
    kept = F.forall(F.zip_with("_m", "_v", lambda m, v: (m != 0) | (v == 0)), lambda ok: F.coalesce(ok, F.lit(False)))
    removed = both.groupBy(key).agg(F.min(F.struct(F.round(share(lambda m: (m > 0) & (m < 1)), 4).alias("partial"), F.round(share(lambda m: m == 0), 3).alias("removed"), kept.alias("zero"))).alias("_d"))
    return figures.join(removed, key, "left").select(*figures.columns, F.col("_d.partial").alias("mask_partial_fraction"), F.col("_d.removed").alias("defaced_fraction"), F.col("_d.zero").alias("zero_where_defaced"))


def covariates(subjects: DataFrame, biomarkers: DataFrame, reference: str, key: str) -> DataFrame:
    """subjects with log_wmh (log1p of the reference source's volume) and icv; nulls where there is none."""
    return R.lookup(subjects, biomarkers.where(F.col("source") == reference).select(key, F.log1p("wmh_ml").alias("log_wmh"), F.col("icv_ml").alias("icv")), key)


def largest_difference(biomarkers: DataFrame, evaluation: DataFrame, keys: Sequence[str], ours: str, theirs: str) -> DataFrame:
    """source and the largest absolute difference between two tables' volumes of the same rows."""
    met = biomarkers.join(evaluation.select(*keys, F.col(theirs).alias("_theirs")), [*keys])
    return met.groupBy("source").agg(F.max(F.abs(F.col(ours) - F.col("_theirs"))).alias("max_difference"))


# -- features and the threshold model --------------------------------------------------------------------------------


def constant(long: DataFrame, keys: Sequence[str], brain: Column, training: Column) -> DataFrame:
    """One row, constant: the median of the training images' medians inside the brain. Other images don't count."""
    return long.where(training & brain).groupBy(*keys).agg(F.median("v").alias("m")).agg(F.median("m").alias("constant"))


def tissue_features(long: DataFrame, keys: Sequence[str], white: Column, grey: Column) -> DataFrame:
    """Percentiles, spread, skewness and excess kurtosis of white matter, the grey matter's median, and their distance."""
    v = F.when(white, F.col("v"))
    q = long.groupBy(*keys).agg(F.percentile(v, [0.05, 0.25, 0.5, 0.75, 0.95]).alias("q"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurtosis"), F.median(F.when(grey, F.col("v"))).alias("grey"))
    p = [F.get("q", F.lit(i)) for i in range(5)]
    return q.select(*keys, *[x.alias(n) for x, n in zip(p, ("p5", "p25", "p50", "p75", "p95"), strict=True)], (p[3] - p[1]).alias("iqr"), "skew", "kurtosis", F.col("grey").alias("cortex_p50"), (F.col("grey") - p[2]).alias("gm_minus_wm"))


def by_modality(features: DataFrame, keys: Sequence[str], modality: str, values: Sequence[str]) -> DataFrame:
    """One row for the keys with every feature of every modality as <modality>_<feature>."""
    names = [c for c in features.columns if c not in (*keys, modality)]
    each = [F.max(F.when(F.col(modality) == m, F.col(n))).alias(f"{m}_{n}") for m in values for n in names]
    return features.groupBy(*keys).agg(*each)


def applied_threshold(cases: DataFrame, keys: Sequence[str], score: str, shape, spacing, brain, t: float, e: float, m: float) -> DataFrame:
    """keys, n, ml: the mask of the tuned parameters, score > t at a depth over e mm, components of at least m mm3."""
    mm3 = float(np.prod(spacing))

    def measure(s: np.ndarray) -> list[dict]:
        mask = K.remove_small((s > t) & (K.distance(~brain(s), spacing) > e), m, mm3)
        return [{"n": int(mask.sum()), "ml": mask.sum() * mm3 / 1000}]

    return kernel(cases, keys, [score], shape, measure, "n long, ml double")


def central_slices(long: DataFrame, keys: Sequence[str], shape, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """keys, plane, i, shade: the middle slice across each axis, in 0 to 1 between two percentiles of the image (0 where they meet)."""
    window = long.groupBy(*keys).agg(F.percentile("v", [low, high]).alias("q"))
    planes = F.filter(F.array(*[F.when(F.col(a) == n // 2, F.lit(a)) for a, n in zip("xyz", shape, strict=True)]), lambda a: a.isNotNull())
    met = long.select(*keys, "i", "v", F.explode(planes).alias("plane")).join(window, [*keys])
    lo, hi = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    return met.select(*keys, "plane", "i", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col("v") - lo, hi - lo))), F.lit(0.0)).alias("shade"))
