"""Queries of the studies: comparison tasks, degradation grids, mask and field checks, training logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.columns import named, subject_id
from ..operators import studies as S
from ..operators import tabular as R
from .base import EV_SQL, QUALITY_SQL, SITES_SQL, evaluation, quality, query, sites, table
from .relational import BAD_SQL, badness
from .volumes import SHAPE, VOX, cubes, voxels


@query("comparison_tasks", "participant:l rater reference shared", f"""
WITH {SITES_SQL}, p(rater, reference, held) AS (VALUES ('O3', 'O1', false), ('O4', 'O1', false), ('O4', 'O3', false), ('M1', 'O1', true))
SELECT participant, rater, reference, seen AS shared FROM sites, p WHERE seen OR NOT held""")
def comparison_tasks(spark, sf):
    s = sites(spark, sf)
    return S.comparison_tasks(s.select("participant"), [("O3", "O1", False), ("O4", "O1", False), ("O4", "O3", False), ("M1", "O1", True)], s.where("seen"), "participant")


@query("sources_by_split", "participant:l split source", f"""
WITH {SITES_SQL} SELECT participant, CASE WHEN seen THEN 'training' ELSE 'test' END AS split, unnest(CASE WHEN seen THEN ['O1', 'O3', 'O4'] ELSE ['O1', 'M1'] END) AS source FROM sites""")
def sources_by_split(spark, sf):
    s = sites(spark, sf).select("participant", F.when(F.col("seen"), "training").otherwise("test").alias("split"))
    return S.sources_by_split(s, {"training": ["O1", "O3", "O4"]}, ["O1", "M1"], "participant")


@query("degradation_grid", "participant:l artifact level:d", f"""
WITH {SITES_SQL}, c AS (SELECT participant FROM (SELECT *, row_number() OVER (PARTITION BY scanner ORDER BY participant) AS n FROM sites WHERE c_acctbal > 0 AND NOT seen) WHERE n <= 3),
g(artifact, level) AS (VALUES ('none', 0.0), ('noise', 0.1), ('noise', 0.2), ('bias', 0.5)) SELECT participant, artifact, level FROM c, g""")
def degradation_grid(spark, sf):
    s = sites(spark, sf).select("participant", "scanner", F.when(F.col("c_acctbal") > 0, "usable").otherwise("check").alias("qc_class"), F.when(F.col("seen"), "training").otherwise("test").alias("split"))
    return S.degradations(S.chosen_subjects(s, s, 3, "participant"), {"noise": [0.1, 0.2], "bias": [0.5]})


@query("detection_rates", "artifact level:d n:l rate:d", f"""
WITH {QUALITY_SQL}, u AS (UNPIVOT (SELECT subject, scanner, modality, snr, cjv FROM q) ON snr, cjv INTO NAME metric VALUE value), clean AS (SELECT * FROM u WHERE modality = 'N'),
m AS (SELECT scanner, metric, median(value) AS med FROM clean GROUP BY 1, 2), d AS (SELECT c.scanner, c.metric, median(abs(value - med)) AS mad FROM clean c JOIN m ON m.scanner = c.scanner AND m.metric = c.metric GROUP BY 1, 2),
w AS (SELECT u.subject, u.modality, max(coalesce((value - med) / nullif(1.4826 * mad, 0), 0)) AS z FROM u LEFT JOIN m ON m.scanner = u.scanner AND m.metric = u.metric LEFT JOIN d ON d.scanner = u.scanner AND d.metric = u.metric WHERE modality <> 'N' GROUP BY 1, 2)
SELECT modality AS artifact, 1.0 AS level, count(*) AS n, avg(CASE WHEN z >= 1 THEN 1.0 ELSE 0.0 END) AS rate FROM w GROUP BY 1""")
def detection_rates(spark, sf):
    u = R.long(quality(spark, sf), ["subject", "scanner", "modality"], ["snr", "cjv"])
    degraded = u.where("modality <> 'N'").select(F.col("subject").alias("participant_id"), "scanner", F.col("modality").alias("artifact"), F.lit(1.0).alias("level"), "metric", "value")
    return S.detection_rates(degraded, u.where("modality = 'N'"), 1.0)


@query("robustness_by_level", "artifact level:d mean:d drop:d", f"""
WITH {EV_SQL} SELECT CASE model WHEN 'F' THEN 'none' ELSE model END AS artifact, CASE model WHEN 'F' THEN 0.0 ELSE 1.0 END AS level, avg(e.m_avg) AS mean, avg(e.m_avg - b.m_avg) AS drop
FROM ev e LEFT JOIN (SELECT participant AS bp, m_avg FROM ev WHERE model = 'F') b ON b.bp = e.participant GROUP BY 1, 2""")
def robustness_by_level(spark, sf):
    ev = evaluation(spark, sf).select(F.col("participant").alias("participant_id"), F.when(F.col("model") == "F", "none").otherwise(F.col("model")).alias("artifact"), F.when(F.col("model") == "F", 0.0).otherwise(1.0).alias("level"), F.col("m_avg").alias("dice"))
    return S.robustness(ev)


@query("field_checks", "vec_id:l mask_fraction:d field_p5:d field_p95:d", f"""
WITH {VOX} SELECT vec_id, avg(CASE WHEN v > -0.2 THEN 1.0 ELSE 0.0 END) AS mask_fraction,
  quantile_cont(v + 2, CAST(0.05 AS DOUBLE)) FILTER (WHERE v > -0.2) / quantile_cont(v + 2, CAST(0.5 AS DOUBLE)) FILTER (WHERE v > -0.2) AS field_p5,
  quantile_cont(v + 2, CAST(0.95 AS DOUBLE)) FILTER (WHERE v > -0.2) / quantile_cont(v + 2, CAST(0.5 AS DOUBLE)) FILTER (WHERE v > -0.2) AS field_p95 FROM vox GROUP BY 1""")
def field_checks(spark, sf):
    return S.field_checks(voxels(spark, sf).withColumn("f", F.col("v") + 2), ["vec_id"], F.col("v") > -0.2, "f")


@query("mask_checks", "vec_id:l ml:d n_components:l largest_share:d inside_head:d", f"""
WITH RECURSIVE {VOX}, m AS (SELECT * FROM vox WHERE v > 0.1),
reach AS (SELECT vec_id, i AS a, i AS b FROM m UNION SELECT r.vec_id, r.a, n.i FROM reach r JOIN m p ON p.vec_id = r.vec_id AND p.i = r.b JOIN m n ON n.vec_id = p.vec_id AND abs(n.x - p.x) + abs(n.y - p.y) + abs(n.z - p.z) = 1),
c AS (SELECT vec_id, b, min(a) AS comp FROM reach GROUP BY 1, 2), s AS (SELECT vec_id, comp, count(*) AS n FROM c GROUP BY 1, 2), g AS (SELECT vec_id, count(*) AS k, max(n) AS top, sum(n) AS total FROM s GROUP BY 1)
SELECT k.vec_id, coalesce(total, 0) * 0.003 AS ml, coalesce(k, 0) AS n_components, coalesce(CAST(top AS DOUBLE) / total, 0) AS largest_share, CASE WHEN total > 0 THEN 1.0 ELSE 0.0 END AS inside_head
FROM (SELECT DISTINCT vec_id FROM vox) k LEFT JOIN g ON g.vec_id = k.vec_id""")
def mask_checks(spark, sf):
    over = lambda t: F.transform("embedding", lambda v: (v.cast("double") > t).cast("double"))
    return S.mask_checks(cubes(spark, sf).select("vec_id", over(0.1).alias("mask"), over(-0.1).alias("head")), ["vec_id"], "mask", "head", SHAPE, 3.0)


@query("external_outcome", "subject:l status", """SELECT doc_id AS subject, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'done' ELSE 'missing' END AS status FROM documents""")
def external_outcome(spark, sf):
    found = table(spark, sf, "labels").select(F.col("doc_id").alias("subject"), F.lit("m").alias("model"), F.col("quality").alias("mask"))
    return S.outcome("segmentation", found, table(spark, sf, "documents").select(F.col("doc_id").alias("subject")))


@query("robustness_cases", "participant:l artifact level_index:l level:d case", f"""
WITH {SITES_SQL}, g(artifact, level_index, level) AS (VALUES ('none', 0, 0.0), ('noise', 1, 0.1), ('noise', 2, 0.2), ('bias', 1, 0.5))
SELECT participant, artifact, level_index, level, CASE WHEN level_index > 0 THEN participant || '_' || artifact || level_index END AS case FROM sites, g WHERE NOT seen""")
def robustness_cases(spark, sf):
    return S.robustness_cases(sites(spark, sf).where("not seen"), {"noise": [0.0, 0.1, 0.2], "bias": [0.0, 0.5]}, "participant")


@query("detected_by_class", "artifact level:d n:l n_detected:l rate:d", f"""
WITH {BAD_SQL}, w AS (SELECT subject, modality, max(z) AS m FROM bad GROUP BY 1, 2), c AS (SELECT modality, CASE WHEN m IS NULL THEN 'not_assessed' WHEN m >= 5 THEN 'exclude' WHEN m >= 3 THEN 'check' ELSE 'usable' END AS qc_class FROM w)
SELECT modality AS artifact, 1.0 AS level, count(*) AS n, count(*) FILTER (WHERE qc_class IN ('check', 'exclude')) AS n_detected,
  avg(CASE WHEN qc_class IN ('check', 'exclude') THEN 1.0 ELSE 0.0 END) AS rate FROM c GROUP BY 1""")
def detected_by_class(spark, sf):
    """Classes come from the measures' own z, by subject and modality."""
    w = badness(spark, sf).groupBy("subject", "modality").agg(F.max("z").alias("m"))
    return S.detected_by_class(w.select(F.col("modality").alias("artifact"), F.lit(1.0).alias("level"), C.qc_class(F.col("m"), F.lit(False), F.col("m").isNotNull()).alias("qc_class")))


@query("threshold_axis", "modality t:d", f"""
WITH {QUALITY_SQL}, b AS (SELECT modality, floor(min(snr)) AS lo, ceil(max(snr)) AS hi FROM q GROUP BY 1)
SELECT modality, round(lo + i * 0.1, 3) AS t FROM b, range(1000) r(i) WHERE lo + i * 0.1 <= hi + 1e-9""")
def threshold_axis(spark, sf):
    """The thresholds that a modality's own measures span."""
    spans = quality(spark, sf).groupBy("modality").agg(F.floor(F.min("snr")).alias("lo"), F.ceil(F.max("snr")).alias("hi"))
    return R.grid_in(spans, t=(F.col("lo"), F.col("hi"), 0.1))


@query("file_plan", "from_path to_path", """
SELECT 'sub-' || printf('%03d', o_custkey) || '/' || o_orderstatus AS from_path,
  'anat/' || o_custkey || '_' || CASE o_orderstatus WHEN 'F' THEN 'FLAIR.nii.gz' WHEN 'O' THEN 'T1w.nii.gz' ELSE 'mask.nii.gz' END AS to_path
FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)""")
def file_plan(spark, sf):
    """A subject's files by kind, placed by each kind's own template."""
    files = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("kind")).distinct()
    place = lambda template: named(template, id=F.col("id"))
    where = F.when(F.col("kind") == "F", place("anat/{id}_FLAIR.nii.gz")).when(F.col("kind") == "O", place("anat/{id}_T1w.nii.gz")).otherwise(place("anat/{id}_mask.nii.gz"))
    return files.select(named("{subject}/{kind}", subject=subject_id(F.col("id")), kind=F.col("kind")).alias("from_path"), where.alias("to_path"))
