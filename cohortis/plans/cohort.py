"""Queries of the compositions over a cohort."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import cohort as H
from ..operators import tabular as R
from ..operators import voxel as V
from .base import EV_SQL, METRICS, evaluation, query, table
from .inference import FEATURES, features
from .relational import BAD_SQL, badness
from .volumes import GRID, PAIR, SHAPE, SPACING, VOX, cubes, voxels

#: Of a cube: raw is its values and 2, the field 1 and a tenth of the next slice's size, masks are slices and signs.
RAW, FIELD = "v + 2", "1 + abs(v) / 10"
_REGION = "median(round_even(c, 0)) AS med, stddev_pop(round_even(c, 0)) AS sd, count(*) AS n"


@query("quality_measures", "vec_id:l snr_wm:d snrd_wm:d cnr:d cjv:d efc:d fber:d inu_range:d fwhm:d n_wm:l n_air:l", f"""
WITH {VOX}, b AS (SELECT *, ({RAW}) / ({FIELD}) AS c0, {RAW} AS raw, {FIELD} AS field FROM vox), lv AS (SELECT vec_id, median(c0) AS lv FROM b WHERE z < 1 GROUP BY 1),
c AS (SELECT b.*, c0 * 1000 / lv AS c, CASE WHEN z < 1 THEN 'w' WHEN z < 2 THEN 'g' END AS r, y + z > 3 AND raw <> 0 AS air FROM b JOIN lv USING (vec_id)),
s AS (SELECT vec_id, r, {_REGION} FROM c WHERE r IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT vec_id, 'a', {_REGION} FROM c WHERE air GROUP BY 1),
u AS (SELECT vec_id, r, c FROM c WHERE r IS NOT NULL UNION ALL SELECT vec_id, 'a', c FROM c WHERE air),
d AS (SELECT u.vec_id, u.r, median(abs(c - med)) / 0.6745 AS mad FROM u JOIN s ON s.vec_id = u.vec_id AND s.r = u.r GROUP BY 1, 2),
j AS (SELECT s.*, mad FROM s JOIN d ON s.vec_id = d.vec_id AND s.r = d.r),
nb AS (SELECT vec_id, count(*) AS n, sqrt(sum(c * c)) AS b FROM c WHERE c <> 0 GROUP BY 1),
ef AS (SELECT c.vec_id, sum(abs(c) / b * ln(abs(c) / b)) / any_value(sqrt(n) * ln(1 / sqrt(n))) AS efc FROM c JOIN nb USING (vec_id) WHERE c <> 0 GROUP BY 1),
fb AS (SELECT vec_id, median(c * c) FILTER (WHERE y = 0 AND z = 0) / median(c * c) FILTER (WHERE air) AS fber, quantile_cont(field, CAST(0.95 AS DOUBLE)) FILTER (WHERE v > -0.2) - quantile_cont(field, CAST(0.05 AS DOUBLE)) FILTER (WHERE v > -0.2) AS inu FROM c GROUP BY 1),
m AS (SELECT * FROM vox WHERE v > -0.2), sp AS (SELECT vec_id, var_pop(v) AS s FROM m GROUP BY 1),
df AS (SELECT a.vec_id, var_pop(b.v - a.v) AS d FROM m a JOIN m b ON b.vec_id = a.vec_id AND b.x = a.x + 1 AND b.y = a.y AND b.z = a.z GROUP BY 1
  UNION ALL SELECT a.vec_id, var_pop(b.v - a.v) FROM m a JOIN m b ON b.vec_id = a.vec_id AND b.x = a.x AND b.y = a.y + 1 AND b.z = a.z GROUP BY 1),
fw AS (SELECT vec_id, avg(sqrt(-2 * ln(2) / ln(1 - d / (2 * s)))) AS fwhm FROM df JOIN sp USING (vec_id) WHERE d > 0 AND d < 2 * s GROUP BY 1)
SELECT w.vec_id, w.med / (w.sd * sqrt(w.n / (w.n - 1.0))) AS snr_wm, 0.6551364 * w.med / CASE WHEN a.mad > 1 THEN a.mad WHEN a.sd > 0.001 THEN a.sd END AS snrd_wm,
  abs(w.med - g.med) / sqrt(w.sd ** 2 + g.sd ** 2 + a.sd ** 2) AS cnr, (w.mad + g.mad) / nullif(abs(w.med - g.med), 0) AS cjv, efc, fber, inu AS inu_range, fwhm, w.n AS n_wm, a.n AS n_air
FROM j w JOIN j g ON g.vec_id = w.vec_id AND g.r = 'g' JOIN j a ON a.vec_id = w.vec_id AND a.r = 'a' JOIN ef ON ef.vec_id = w.vec_id JOIN fb ON fb.vec_id = w.vec_id LEFT JOIN fw ON fw.vec_id = w.vec_id WHERE w.r = 'w'""")
def quality_measures(spark, sf):
    """Head: the edge of the first slice, so that what is over three steps away is air."""
    at = lambda f: F.transform("v", lambda v, i: f(v, i).cast("double"))
    z, y = (lambda i: F.floor(i / 16)), (lambda i: F.floor(i / 4) % 4)
    c = cubes(spark, sf).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    made = c.select("vec_id", at(lambda v, i: v + 2).alias("raw"), at(lambda v, i: 1 + F.abs(v) / 10).alias("field"), at(lambda v, i: z(i) < 1).alias("white"), at(lambda v, i: z(i) == 1).alias("grey"), at(lambda v, i: v > -0.2).alias("brain"), at(lambda v, i: (y(i) == 0) & (z(i) == 0)).alias("head"))
    return H.quality_measures(made, ["vec_id"], ["raw", "field", "white", "grey", "brain", "head"], SHAPE, SPACING)


@query("qc_flags", "subject:l max_z:d worst_metric iforest_score:d iforest_outlier qc_class")
def qc_flags(spark, sf):
    """The largest z, the worst measure, the forest and the class of each subject in one table."""
    b = badness(spark, sf).withColumns({"z": F.round("z", 9), "name": F.concat_ws("_", "modality", "metric")})
    return H.classified(b, "subject", F.col("pos") * 1000 + F.ascii("modality"))


@query("qc_validation", "n_test:l n_flagged:l median_usable:d median_flagged:d rho:d", f"""
WITH {BAD_SQL}, w AS (SELECT subject, max(round(z, 9)) AS score FROM bad GROUP BY 1),
m AS (SELECT CASE WHEN score IS NULL THEN 'not_assessed' WHEN score >= 5 THEN 'exclude' WHEN score >= 3 THEN 'check' ELSE 'usable' END AS c, score, s_acctbal AS v FROM w JOIN supplier ON s_suppkey = subject),
k AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS a, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS b FROM m WHERE score IS NOT NULL AND v IS NOT NULL)
SELECT count(*) AS n_test, count(*) FILTER (WHERE c IN ('check', 'exclude')) AS n_flagged, median(v) FILTER (WHERE c = 'usable') AS median_usable,
  median(v) FILTER (WHERE c IN ('check', 'exclude')) AS median_flagged, (SELECT corr(a, b) FROM k) AS rho FROM m""")
def qc_validation(spark, sf):
    w = badness(spark, sf).groupBy("subject").agg(F.max(F.round("z", 9)).alias("score"))
    flags = w.withColumn("qc_class", C.qc_class(F.col("score"), F.lit(False), F.col("score").isNotNull()))
    return H.validated(flags, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("subject"), F.col("s_acctbal").cast("double").alias("v")), "subject", "score", "v")


@query("scanner_effects", "family model metric n:l k:l h:d p:d p_holm:d", f"""
WITH {EV_SQL}, u AS (UNPIVOT (SELECT model, scanner, m_max, m_min, m_n FROM ev) ON m_max, m_min, m_n INTO NAME metric VALUE value),
r AS (SELECT model, metric, scanner, value, rank() OVER (PARTITION BY model, metric ORDER BY value) + (count(*) OVER (PARTITION BY model, metric, value) - 1) / 2.0 AS r FROM u),
t AS (SELECT model, metric, sum(CAST(c AS DOUBLE) ** 3 - c) AS ties FROM (SELECT model, metric, count(*) AS c FROM r GROUP BY model, metric, value) GROUP BY 1, 2),
s AS (SELECT model, metric, sum(m) AS n, count(*) AS k, sum(s * s / m) AS q FROM (SELECT model, metric, scanner, sum(r) AS s, count(*) AS m FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2),
h AS (SELECT model, metric, n, k, (12 / (CAST(n AS DOUBLE) * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (CAST(n AS DOUBLE) ** 3 - n)) AS h FROM s JOIN t USING (model, metric)),
p AS (SELECT *, CASE WHEN k = 5 THEN exp(-h / 2) * (1 + h / 2) WHEN k = 3 THEN exp(-h / 2) END AS p, CASE WHEN model IN ('F', 'O') THEN 'main' ELSE 'other' END AS family FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY family, p IS NULL ORDER BY p, model, metric) AS i, count(p) OVER (PARTITION BY family, p IS NULL) AS m FROM p)
SELECT family, model, metric, n, k, h, p, CASE WHEN p IS NOT NULL THEN least(1, max((m - i + 1) * p) OVER (PARTITION BY family, p IS NULL ORDER BY i)) END AS p_holm FROM o""")
def scanner_effects(spark, sf):
    fam = spark.createDataFrame([("main", "F", 0), ("main", "O", 1), ("second", "O", 2)], "family string, model string, position int")
    return H.scanner_effects(R.long(evaluation(spark, sf), ["model", "scanner"], ["m_max", "m_min", "m_n"]), fam)


_BETTER = "CASE " + " ".join(f"WHEN metric = '{m}' THEN {'a.value > b.value' if up else 'a.value < b.value'}" for m, up in METRICS.items()) + " END"


@query("paired_with_model", "rater metric n:l mean_model:d mean_rater:d mean_diff:d n_better:l", f"""
WITH {EV_SQL}, u AS (UNPIVOT (SELECT participant, model, {', '.join(METRICS)} FROM ev) ON {', '.join(METRICS)} INTO NAME metric VALUE value)
SELECT b.model AS rater, metric, count(*) AS n, avg(a.value) AS mean_model, avg(b.value) AS mean_rater, avg(a.value - b.value) AS mean_diff, count(*) FILTER (WHERE {_BETTER}) AS n_better
FROM u a JOIN u b USING (participant, metric) WHERE a.model = 'F' AND b.model IN ('O', 'P') GROUP BY 1, 2""")
def paired_with_model(spark, sf):
    return H.paired_with(evaluation(spark, sf), "F", ["O", "P"], METRICS)


@query("shared_cases", "rater n:l icc:d bias:d ratio_min:d ratio_max:d", f"""
WITH {EV_SQL}, p AS (SELECT a.model AS rater, a.participant, ln(a.m_avg) AS x, ln(b.m_avg) AS y FROM ev a JOIN ev b ON a.participant = b.participant AND a.model IN ('O', 'P') AND b.model = 'F'
  WHERE a.participant IN (SELECT participant FROM ev WHERE model = 'P')),
m AS (SELECT rater, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c, avg(x - y) AS bias, exp(min(x - y)) AS ratio_min, exp(max(x - y)) AS ratio_max FROM p GROUP BY 1),
s AS (SELECT *, n * (vx + vy + 2 * c) / (2 * (n - 1)) AS msr, n * (mx - my) ** 2 / 2 AS msc, n * (vx + vy - 2 * c) / (2 * (n - 1)) AS mse FROM m)
SELECT rater, n, (msr - mse) / (msr + mse + 2 * (msc - mse) / n) AS icc, bias, ratio_min, ratio_max FROM s""")
def shared_cases(spark, sf):
    return H.shared_cases(evaluation(spark, sf), "P", ["O"], "F", "m_avg", "log")


def pairs_long(spark, sf):
    """vec_id, i, t (own value), p (the next cube's)."""
    own = voxels(spark, sf).select("vec_id", "i", F.col("v").alias("t"))
    return own.join(own.select((F.col("vec_id") - 1).alias("vec_id"), "i", F.col("t").alias("p")), ["vec_id", "i"])


BIO_SQL = f"""{PAIR}, n AS (SELECT vec_id, count(*) FILTER (WHERE t > 0.1 AND t >= -0.2) AS a, count(*) FILTER (WHERE p > 0.1 AND t >= -0.2) AS b, count(*) FILTER (WHERE t > -0.25) AS brain, count(*) FILTER (WHERE t > -0.5) AS icv FROM pr GROUP BY 1),
bio AS (SELECT vec_id, 'O1' AS source, a AS n, brain, icv FROM n UNION ALL SELECT vec_id, 'M1', b, brain, icv FROM n)"""


@query("biomarker_table", "vec_id:l source wmh_ml:d wmh_pct_brain:d icv_ml:d wmh_pct_icv:d", f"""
WITH {BIO_SQL} SELECT vec_id, source, n * 0.003 AS wmh_ml, 100.0 * n / nullif(brain, 0) AS wmh_pct_brain, icv * 0.003 AS icv_ml, 100.0 * n / nullif(icv, 0) AS wmh_pct_icv FROM bio""")
def biomarker_table(spark, sf):
    t, p = F.col("t"), F.col("p")
    return H.biomarker_table(pairs_long(spark, sf), ["vec_id"], {"O1": t > 0.1, "M1": p > 0.1}, t < -0.2, t > -0.25, t > -0.5, 0.003)


@query("covariates", "vec_id:l log_wmh:d icv:d", f"""
WITH {BIO_SQL} SELECT e.vec_id, ln(1 + n * 0.003) AS log_wmh, icv * 0.003 AS icv FROM embeddings e LEFT JOIN bio ON bio.vec_id = e.vec_id AND source = 'O1'""")
def covariates(spark, sf):
    return H.covariates(table(spark, sf, "embeddings").select("vec_id"), biomarker_table(spark, sf), "O1", "vec_id")


@query("volume_cross_check", "source max_difference:d", f"""
WITH {BIO_SQL}, e AS (SELECT vec_id, 'O1' AS source, count(*) FILTER (WHERE t > 0.1) * 0.003 AS ml FROM pr GROUP BY 1 UNION ALL SELECT vec_id, 'M1', count(*) FILTER (WHERE p > 0.1) * 0.003 FROM pr GROUP BY 1)
SELECT source, max(abs(n * 0.003 - ml)) AS max_difference FROM bio JOIN e USING (vec_id, source) GROUP BY 1""")
def volume_cross_check(spark, sf):
    """Against volumes that still count other pathology."""
    n = pairs_long(spark, sf).groupBy("vec_id").agg(F.count_if(F.col("t") > 0.1).alias("O1"), F.count_if(F.col("p") > 0.1).alias("M1"))
    theirs = R.long(n, ["vec_id"], ["O1", "M1"], "source", "n").select("vec_id", "source", (F.col("n") * 0.003).alias("ml"))
    return H.largest_difference(biomarker_table(spark, sf), theirs, ["vec_id", "source"], "wmh_ml", "ml")


_FEATURES = ["p5", "p25", "p50", "p75", "p95", "iqr", "skew", "kurtosis", "cortex_p50", "gm_minus_wm"]
_LONG = ", ".join(f"max({f}) FILTER (WHERE modality = '{m}') AS {m}_{f}" for m in ("FLAIR", "T1w") for f in _FEATURES)


@query("feature_rows", "label:l scale " + " ".join(f"{m}_{f}:d" for m in ("FLAIR", "T1w") for f in _FEATURES), f"""
WITH {VOX}, x AS (SELECT label, CASE WHEN z < 2 THEN 'FLAIR' ELSE 'T1w' END AS modality, vec_id, z % 2 AS tissue, v + 2 AS v FROM vox),
k AS (SELECT modality, median(m) AS k FROM (SELECT modality, vec_id, median(v) AS m FROM x WHERE vec_id % 3 = 0 GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT label, modality, median(v) AS med FROM x GROUP BY 1, 2), d AS (SELECT x.label, x.modality, any_value(med) AS med, median(abs(v - med)) AS mad FROM x JOIN c ON c.label = x.label AND c.modality = x.modality GROUP BY 1, 2),
y AS (SELECT 'none' AS scale, label, x.modality, tissue, v / k AS v FROM x JOIN k ON k.modality = x.modality UNION ALL SELECT 'zscore', x.label, x.modality, tissue, (v - med) / (1.4826 * mad) FROM x JOIN d ON d.label = x.label AND d.modality = x.modality),
m AS (SELECT scale, label, modality, avg(v) AS m, stddev_pop(v) AS s FROM y WHERE tissue = 0 GROUP BY 1, 2, 3),
f AS (SELECT scale, label, modality, quantile_cont(v, CAST(0.05 AS DOUBLE)) FILTER (WHERE tissue = 0) AS p5, quantile_cont(v, CAST(0.25 AS DOUBLE)) FILTER (WHERE tissue = 0) AS p25, median(v) FILTER (WHERE tissue = 0) AS p50,
  quantile_cont(v, CAST(0.75 AS DOUBLE)) FILTER (WHERE tissue = 0) AS p75, quantile_cont(v, CAST(0.95 AS DOUBLE)) FILTER (WHERE tissue = 0) AS p95, avg((v - m) ** 3) FILTER (WHERE tissue = 0) / any_value(s) ** 3 AS skew,
  avg((v - m) ** 4) FILTER (WHERE tissue = 0) / any_value(s) ** 4 - 3 AS kurtosis, median(v) FILTER (WHERE tissue = 1) AS cortex_p50 FROM y JOIN m USING (scale, label, modality) GROUP BY 1, 2, 3),
g AS (SELECT *, p75 - p25 AS iqr, cortex_p50 - p50 AS gm_minus_wm FROM f)
SELECT label, scale, {_LONG} FROM g GROUP BY 1, 2""")
def feature_rows(spark, sf):
    """A subject is a label; a modality two slices, of which one is white matter and one grey; training are ids divisible by 3."""
    x = voxels(spark, sf).select("label", "vec_id", F.when(F.col("z") < 2, "FLAIR").otherwise("T1w").alias("modality"), (F.col("z") % 2).alias("tissue"), (F.col("v") + 2).alias("v"))
    scaled = None
    for modality in ("FLAIR", "T1w"):
        own = x.where(F.col("modality") == modality)
        fitted = H.constant(own, ["vec_id"], F.lit(True), F.col("vec_id") % 3 == 0)
        none = own.crossJoin(F.broadcast(fitted)).withColumns({"v": F.col("v") / F.col("constant"), "scale": F.lit("none")}).drop("constant")  # one row
        z = V.zscored(own, ["label"], F.lit(True)).withColumns({"v": F.col("z"), "scale": F.lit("zscore")}).drop("z")
        both = none.unionByName(z)
        scaled = both if scaled is None else scaled.unionByName(both)
    f = H.tissue_features(scaled, ["label", "scale", "modality"], F.col("tissue") == 0, F.col("tissue") == 1)
    return H.by_modality(f, ["label", "scale"], "modality", ["FLAIR", "T1w"])


@query("biology_table", "feature eta2_before:d eta2_after:d rho_before:d rho_after:d")
def biology_table(spark, sf):
    """The first seven components, and a covariate made of the eighth."""
    f = features(spark, sf, FEATURES[:8]).withColumn("covariate", F.log1p(F.abs("f7")))
    return H.biology(f, "vec_id", FEATURES[:7], "site", "covariate")


@query("mean_abs_rho", "n:l mean_eta2:d mean_abs_rho:d", """
WITH u AS (SELECT label, i, CAST(embedding[i + 1] AS DOUBLE) AS v, ln(1 + abs(CAST(embedding[8] AS DOUBLE))) AS c FROM embeddings, range(7) r(i) WHERE embedding IS NOT NULL),
g AS (SELECT i, avg(v) AS g FROM u GROUP BY 1), s AS (SELECT i, label, avg(v) AS m FROM u GROUP BY 1, 2),
e AS (SELECT u.i, sum((m - g) ** 2) / sum((v - g) ** 2) AS eta2 FROM u JOIN g ON g.i = u.i JOIN s ON s.i = u.i AND s.label = u.label GROUP BY 1),
k AS (SELECT i, rank() OVER (PARTITION BY i ORDER BY v) + (count(*) OVER (PARTITION BY i, v) - 1) / 2.0 AS a, rank() OVER (PARTITION BY i ORDER BY c) + (count(*) OVER (PARTITION BY i, c) - 1) / 2.0 AS b FROM u),
r AS (SELECT i, corr(a, b) AS rho FROM k GROUP BY 1)
SELECT count(*) AS n, avg(eta2) AS mean_eta2, avg(abs(rho)) AS mean_abs_rho FROM e JOIN r USING (i)""")
def mean_abs_rho(spark, sf):
    return biology_table(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.avg("eta2_before").alias("mean_eta2"), F.avg(F.abs("rho_before")).alias("mean_abs_rho"))


@query("apply_threshold", "vec_id:l n:l ml:d", f"""
WITH RECURSIVE {GRID}, k AS (SELECT vec_id, count(*) AS n FROM kept WHERE t = 0 AND e = 1 AND m = 9 GROUP BY 1)
SELECT a.vec_id, coalesce(n, 0) AS n, coalesce(n, 0) * 0.003 AS ml FROM (SELECT DISTINCT vec_id FROM pr) a LEFT JOIN k ON k.vec_id = a.vec_id""")
def apply_threshold(spark, sf):
    a = cubes(spark, sf)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").cast("array<double>").alias("score"))
    return H.applied_threshold(a.select("vec_id").join(b, "vec_id"), ["vec_id"], "score", SHAPE, SPACING, lambda x: x > -0.25, 0.0, 1.0, 9.0)


@query("prepared_voxels", "vec_id:l i:l z:d depth:d", f"""
WITH {VOX}, b AS (SELECT * FROM vox WHERE v > -0.1), m AS (SELECT vec_id, median(v) AS m FROM b GROUP BY 1), d AS (SELECT b.vec_id, median(abs(v - m)) AS d FROM b JOIN m USING (vec_id) GROUP BY 1),
x AS (SELECT vec_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM b GROUP BY 1), o AS (SELECT * FROM vox WHERE v <= -0.1),
e AS (SELECT a.vec_id, a.i, min(sqrt((a.x - o.x) ** 2 + (a.y - o.y) ** 2 + 9 * (a.z - o.z) ** 2)) AS depth FROM vox a LEFT JOIN o ON o.vec_id = a.vec_id GROUP BY 1, 2)
SELECT a.vec_id, a.i, (a.v - m) / nullif(1.4826 * d, 0) AS z, depth FROM vox a JOIN m USING (vec_id) JOIN d USING (vec_id) JOIN x USING (vec_id) JOIN e ON e.vec_id = a.vec_id AND e.i = a.i
WHERE a.x BETWEEN x0 AND x1 AND a.y BETWEEN y0 AND y1 AND a.z BETWEEN z0 AND z1""")
def prepared_voxels(spark, sf):
    """Normalised values and depth, made on the whole grid and then cut to the brain's box."""
    v = voxels(spark, sf)
    z = V.zscored(v.withColumnRenamed("z", "slice"), ["vec_id"], F.col("v") > -0.1)
    depth = V.distances(cubes(spark, sf), ["vec_id"], "embedding", SHAPE, SPACING, lambda x: x <= -0.1)
    box = V.bounding_box(v, ["vec_id"], F.col("v") > -0.1)
    met = z.join(depth, ["vec_id", "i"]).join(box, "vec_id")
    inside = F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y")) & F.col("slice").between(F.col("min_z"), F.col("max_z"))
    return met.where(inside).select("vec_id", "i", "z", F.col("d").alias("depth"))


@query("central_slices", "vec_id:l plane i:l shade:d", f"""
WITH {VOX}, w AS (SELECT vec_id, quantile_cont(v, CAST(0.01 AS DOUBLE)) AS lo, quantile_cont(v, CAST(0.99 AS DOUBLE)) AS hi FROM vox GROUP BY 1),
p AS (SELECT *, 'x' AS plane FROM vox WHERE x = 2 UNION ALL SELECT *, 'y' FROM vox WHERE y = 2 UNION ALL SELECT *, 'z' FROM vox WHERE z = 2)
SELECT vec_id, plane, i, coalesce(greatest(0, least(1, (v - lo) / nullif(hi - lo, 0))), 0) AS shade FROM p JOIN w USING (vec_id)""")
def central_slices(spark, sf):
    return H.central_slices(voxels(spark, sf), ["vec_id"], SHAPE)


#: Subject vec_id // 4: its image, two raters' labels and its mask are four cubes; every fifth subject's second rater is on another grid.
_KINDS = {0: "image", 1: "one", 2: "two", 3: "mask"}


@query("inventory", "subject:l shape voxel_mm axcodes dtype forms_agree a_valid a_same_grid a_wmh_ml:d a_other_ml:d b_valid b_same_grid b_wmh_ml:d defaced mask_same_grid mask_partial_fraction:d defaced_fraction:d zero_where_defaced", f"""
WITH {VOX}, s AS (SELECT vec_id // 4 AS subject, vec_id % 4 AS kind, i, v, CASE WHEN v > 0.1 THEN 1 WHEN v < -0.1 THEN 2 ELSE 0 END AS l FROM vox),
img AS (SELECT DISTINCT subject FROM s WHERE kind = 0),
c AS (SELECT subject, kind, bool_and(kind = 1 OR v < 0.3) AS valid, round(count(*) FILTER (WHERE l = 1) * 0.003, 2) AS ones, round(count(*) FILTER (WHERE l = 2) * 0.003, 2) AS twos FROM s WHERE kind IN (1, 2) GROUP BY 1, 2),
d AS (SELECT m.subject, round(avg(CASE WHEN m.l = 0 THEN 1.0 ELSE 0.0 END), 4) AS partial, round(avg(CASE WHEN m.l = 2 THEN 1.0 ELSE 0.0 END), 3) AS removed, bool_and(m.l <> 2 OR im.v = 0) AS zero
  FROM s m JOIN s im ON im.subject = m.subject AND im.i = m.i AND im.kind = 0 WHERE m.kind = 3 GROUP BY 1)
SELECT img.subject, '4x4x4' AS shape, '1.00x1.00x3.00' AS voxel_mm, 'RAS' AS axcodes, 'float32' AS dtype, true AS forms_agree,
  a.valid AS a_valid, CASE WHEN a.subject IS NOT NULL THEN true END AS a_same_grid, CASE WHEN a.valid THEN a.ones END AS a_wmh_ml, CASE WHEN a.valid THEN a.twos END AS a_other_ml,
  b.valid AS b_valid, CASE WHEN b.subject IS NOT NULL THEN img.subject % 5 <> 0 END AS b_same_grid, CASE WHEN b.valid THEN b.ones END AS b_wmh_ml,
  d.subject IS NOT NULL AS defaced, CASE WHEN d.subject IS NOT NULL THEN true END AS mask_same_grid, d.partial AS mask_partial_fraction, d.removed AS defaced_fraction, d.zero AS zero_where_defaced
FROM img LEFT JOIN c a ON a.subject = img.subject AND a.kind = 1 LEFT JOIN c b ON b.subject = img.subject AND b.kind = 2 LEFT JOIN d ON d.subject = img.subject""")
def inventory(spark, sf):
    c = cubes(spark, sf).select((F.floor(F.col("vec_id") / 4)).cast("long").alias("subject"), (F.col("vec_id") % 4).alias("k"), F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair]), F.col("k").cast("int"))
    label = lambda v: F.when(v > 0.1, 1.0).when(v < -0.1, 2.0).otherwise(0.0)
    # The second rater's labels are not whole where the cube is high, the mask is 1, partly 1, or 0.
    data = F.when(F.col("k") == 0, F.col("v")).when(F.col("k") == 1, F.transform("v", label)).when(F.col("k") == 2, F.transform("v", lambda v: F.when(v >= 0.3, 0.5).otherwise(label(v)))).otherwise(F.transform("v", lambda v: F.when(v > 0.1, 1.0).when(v < -0.1, 0.0).otherwise(0.5)))
    off = (F.col("k") == 2) & (F.col("subject") % 5 == 0)
    affine = F.array(*[F.when(off, F.lit(1.0)).otherwise(F.lit(0.0)) if i == 3 else F.lit(float(x)) for i, x in enumerate((1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 3, 0, 0, 0, 0, 1))])
    images = c.select("subject", kind.alias("kind"), F.array(*map(F.lit, SHAPE)).alias("shape"), F.array(*map(F.lit, SPACING)).alias("spacing"), affine.alias("affine"), F.lit("RAS").alias("axcodes"), F.lit("float32").alias("dtype"), F.lit(True).alias("forms_agree"), data.alias("data"))
    return H.inventory(images, "subject", "image", {"one": "a", "two": "b"}, "mask")
