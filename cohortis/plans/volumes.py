"""Queries of the volume operators, on embeddings read as cubes of 4 x 4 x 4 voxels (x fastest), 1 x 1 x 3 mm."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import transforms as X
from ..operators import voxel as V
from ..schemas import LANDMARKS
from .base import query, table

SHAPE, SPACING = (4, 4, 4), (1.0, 1.0, 3.0)
VOX = """vox AS (SELECT vec_id, label, CAST(i AS BIGINT) AS i, i % 4 AS x, (i // 4) % 4 AS y, i // 16 AS z, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) r(i) WHERE len(embedding) = 64)"""
#: Case vec_id: truth is its own cube, the prediction the next one's.
PAIR = f"""{VOX}, pr AS (SELECT a.vec_id, a.i, a.x, a.y, a.z, a.v AS t, b.v AS p, a.v > 0.1 AS mt, b.v > 0.1 AND a.v >= -0.2 AS mp FROM vox a JOIN vox b ON b.vec_id = a.vec_id + 1 AND a.i = b.i)"""


def reach(source: str, mask: str, name: str) -> str:
    """comp_name: vec_id, i, component of the mask's 26-connected components."""
    return f"""m_{name} AS (SELECT vec_id, i, x, y, z FROM {source} WHERE {mask}),
reach_{name} AS (SELECT vec_id, i AS a, i AS b FROM m_{name} UNION SELECT r.vec_id, r.a, n.i FROM reach_{name} r JOIN m_{name} p ON p.vec_id = r.vec_id AND p.i = r.b
  JOIN m_{name} n ON n.vec_id = p.vec_id AND abs(n.x - p.x) <= 1 AND abs(n.y - p.y) <= 1 AND abs(n.z - p.z) <= 1),
comp_{name} AS (SELECT vec_id, b AS i, min(a) + 1 AS component FROM reach_{name} GROUP BY 1, 2)"""


def cubes(spark, sf):
    return table(spark, sf, "embeddings").where(F.size("embedding") == 64).select("vec_id", "label", "embedding")


def voxels(spark, sf):
    return V.voxels(cubes(spark, sf), ["vec_id", "label"], "embedding", SHAPE)


def cases(spark, sf):
    """vec_id, ref (0, 1 lesion, 2 ignored) and pred (the next cube's)."""
    a = cubes(spark, sf)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    ref = F.transform("embedding", lambda v: F.when(v.cast("double") > 0.1, 1.0).when(v.cast("double") < -0.2, 2.0).otherwise(0.0))
    return a.join(b, "vec_id").select("vec_id", ref.alias("ref"), F.transform("other", lambda v: (v.cast("double") > 0.1).cast("double")).alias("pred"))


@query("dice_avd", "vec_id:l t:l p:l tp:l dice:d avd_pct:d", f"""
WITH {PAIR}, c AS (SELECT vec_id, count(*) FILTER (WHERE mt) AS t, count(*) FILTER (WHERE mp) AS p, count(*) FILTER (WHERE mt AND mp) AS tp FROM pr GROUP BY 1)
SELECT vec_id, t, p, tp, 2.0 * tp / nullif(t + p, 0) AS dice, 100.0 * abs(t - p) / nullif(t, 0) AS avd_pct FROM c""")
def dice_avd(spark, sf):
    long = cases(spark, sf).select("vec_id", F.explode(F.arrays_zip("ref", "pred")).alias("c")).select("vec_id", F.col("c.ref").alias("r"), F.col("c.pred").alias("p"))
    return V.overlap(long, ["vec_id"], C.truth_mask(F.col("r")), C.prediction_mask(F.col("p"), F.col("r"), integer=False))


@query("masked_counts", "vec_id:l n_kept:l n_ignored:l", f"""
WITH {PAIR} SELECT vec_id, count(*) FILTER (WHERE p > 0.1 AND t >= -0.2) AS n_kept, count(*) FILTER (WHERE t < -0.2) AS n_ignored FROM pr GROUP BY 1""")
def masked_counts(spark, sf):
    """Array masks without exploding: other pathology removed, ignored labels carried over."""
    c = cases(spark, sf)
    kept = C.without_label(F.transform("pred", lambda p: p == 1.0), F.col("ref"))
    carried = C.with_ignored(F.col("pred"), F.col("ref"))
    return c.select("vec_id", F.size(F.filter(kept, lambda m: m)).alias("n_kept"), F.size(F.filter(carried, lambda v: v == 2.0)).alias("n_ignored"))


@query("component_sizes", "vec_id:l component:l size:l", f"""
WITH RECURSIVE {VOX}, {reach('vox', 'v > 0.1', 'a')} SELECT vec_id, component, count(*) AS size FROM comp_a GROUP BY 1, 2""")
def component_sizes(spark, sf):
    return V.component_sizes(cubes(spark, sf).withColumn("embedding", F.transform("embedding", lambda v: v.cast("double"))), ["vec_id"], "embedding", SHAPE, 0.1)


@query("remove_small", "vec_id:l kept:l", f"""
WITH RECURSIVE {VOX}, {reach('vox', 'v > 0.1', 'a')}, s AS (SELECT vec_id, component, count(*) AS size FROM comp_a GROUP BY 1, 2)
SELECT vec_id, sum(size) AS kept FROM s WHERE size * 3 >= 9 GROUP BY 1""")
def remove_small(spark, sf):
    return component_sizes(spark, sf).where(F.col("size") * 3 >= 9).groupBy("vec_id").agg(F.sum("size").alias("kept"))


@query("lesion_biomarkers", "vec_id:l n_lesions:l n_large:l median_mm3:d largest_ml:d largest_share:d", f"""
WITH RECURSIVE {VOX}, {reach('vox', 'v > 0.1', 'a')}, s AS (SELECT vec_id, component, count(*) * 3.0 AS mm3 FROM comp_a GROUP BY 1, 2),
g AS (SELECT vec_id, count(*) AS n, count(*) FILTER (WHERE mm3 >= 9) AS big, median(mm3) AS med, max(mm3) AS top, sum(mm3) AS total FROM s GROUP BY 1)
SELECT e.vec_id, coalesce(n, 0) AS n_lesions, coalesce(big, 0) AS n_large, med AS median_mm3, coalesce(top, 0) / 1000 AS largest_ml, top / total AS largest_share
FROM (SELECT vec_id FROM embeddings WHERE len(embedding) = 64) e LEFT JOIN g ON g.vec_id = e.vec_id""")
def lesion_biomarkers(spark, sf):
    return V.lesions(component_sizes(spark, sf), cubes(spark, sf), ["vec_id"], 3.0, 9.0)


@query("lesion_recall_f1", "vec_id:l recall:d f1:d", f"""
WITH RECURSIVE {PAIR}, {reach('pr', 'mt', 't')}, {reach('pr', 'mp', 'p')},
a AS (SELECT c.vec_id, count(DISTINCT component) AS n, count(DISTINCT component) FILTER (WHERE mp) AS hit FROM comp_t c JOIN pr ON pr.vec_id = c.vec_id AND pr.i = c.i GROUP BY 1),
b AS (SELECT c.vec_id, count(DISTINCT component) AS n, count(DISTINCT component) FILTER (WHERE mt) AS hit FROM comp_p c JOIN pr ON pr.vec_id = c.vec_id AND pr.i = c.i GROUP BY 1),
r AS (SELECT k.vec_id, CASE WHEN a.n IS NULL THEN 1.0 ELSE CAST(a.hit AS DOUBLE) / a.n END AS r, CASE WHEN b.n IS NULL THEN 1.0 ELSE CAST(b.hit AS DOUBLE) / b.n END AS p
  FROM (SELECT DISTINCT vec_id FROM pr) k LEFT JOIN a ON a.vec_id = k.vec_id LEFT JOIN b ON b.vec_id = k.vec_id)
SELECT vec_id, r AS recall, CASE WHEN r + p = 0 THEN 0 ELSE 2 * r * p / (r + p) END AS f1 FROM r""")
def lesion_recall_f1(spark, sf):
    return V.evaluate(cases(spark, sf), ["vec_id"], "ref", "pred", SHAPE, SPACING).select("vec_id", F.col("lesion_recall").alias("recall"), F.col("lesion_f1").alias("f1"))


@query("hd95", "vec_id:l hd95_mm:d", f"""
WITH {PAIR},
bt AS (SELECT * FROM pr m WHERE mt AND (SELECT count(*) FROM pr n WHERE n.vec_id = m.vec_id AND n.mt AND n.z = m.z AND abs(n.x - m.x) + abs(n.y - m.y) = 1) < 4),
bp AS (SELECT * FROM pr m WHERE mp AND (SELECT count(*) FROM pr n WHERE n.vec_id = m.vec_id AND n.mp AND n.z = m.z AND abs(n.x - m.x) + abs(n.y - m.y) = 1) < 4),
d1 AS (SELECT a.vec_id, a.i, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + 9 * (a.z - b.z) ** 2)) AS d FROM bt a JOIN bp b ON a.vec_id = b.vec_id GROUP BY 1, 2),
d2 AS (SELECT a.vec_id, a.i, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + 9 * (a.z - b.z) ** 2)) AS d FROM bp a JOIN bt b ON a.vec_id = b.vec_id GROUP BY 1, 2)
SELECT k.vec_id, greatest(q1, q2) AS hd95_mm FROM (SELECT DISTINCT vec_id FROM pr) k
LEFT JOIN (SELECT vec_id, quantile_cont(d, CAST(0.95 AS DOUBLE)) AS q1 FROM d1 GROUP BY 1) x ON x.vec_id = k.vec_id LEFT JOIN (SELECT vec_id, quantile_cont(d, CAST(0.95 AS DOUBLE)) AS q2 FROM d2 GROUP BY 1) y ON y.vec_id = k.vec_id""")
def hd95(spark, sf):
    return V.evaluate(cases(spark, sf), ["vec_id"], "ref", "pred", SHAPE, SPACING).select("vec_id", "hd95_mm")


@query("distance_to_set", "vec_id:l i:l d:d", f"""
WITH {VOX}, s AS (SELECT * FROM vox WHERE v < -0.2)
SELECT a.vec_id, a.i, min(sqrt((a.x - s.x) ** 2 + (a.y - s.y) ** 2 + 9 * (a.z - s.z) ** 2)) AS d FROM vox a LEFT JOIN s ON s.vec_id = a.vec_id GROUP BY 1, 2""")
def distance_to_set(spark, sf):
    return V.distances(cubes(spark, sf), ["vec_id"], "embedding", SHAPE, SPACING, lambda x: x < -0.2)


@query("location_split", "vec_id:l near_ml:d deep_ml:d near_share:d", f"""
WITH {VOX}, s AS (SELECT * FROM vox WHERE v < -0.2),
d AS (SELECT a.vec_id, a.i, min(sqrt((a.x - s.x) ** 2 + (a.y - s.y) ** 2 + 9 * (a.z - s.z) ** 2)) AS d FROM vox a JOIN s ON s.vec_id = a.vec_id WHERE a.v > 0.1 GROUP BY 1, 2)
SELECT vec_id, count(*) FILTER (WHERE d <= 2) * 0.003 AS near_ml, count(*) FILTER (WHERE d > 2) * 0.003 AS deep_ml, CAST(count(*) FILTER (WHERE d <= 2) AS DOUBLE) / count(*) AS near_share FROM d GROUP BY 1""")
def location_split(spark, sf):
    """Lesion volume within 2 mm of a set (inclusive) and beyond."""
    lesion = voxels(spark, sf).where("v > 0.1").select("vec_id", "i")
    d = lesion.join(distance_to_set(spark, sf), ["vec_id", "i"]).where("d is not null")
    near = F.count_if(F.col("d") <= 2)
    return d.groupBy("vec_id").agg((near * 0.003).alias("near_ml"), (F.count_if(F.col("d") > 2) * 0.003).alias("deep_ml"), (near / F.count(F.lit(1))).alias("near_share"))


@query("erode_dilate", "vec_id:l n_mask:l n_eroded:l n_dilated:l", f"""
WITH {VOX}, m AS (SELECT * FROM vox WHERE v > -0.1),
n AS (SELECT a.vec_id, a.i, count(b.i) AS k, bool_or(a.v > -0.1) AS own FROM vox a LEFT JOIN m b ON a.vec_id = b.vec_id AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1 GROUP BY 1, 2)
SELECT vec_id, count(*) FILTER (WHERE own) AS n_mask, count(*) FILTER (WHERE own AND k = 6) AS n_eroded, count(*) FILTER (WHERE own OR k > 0) AS n_dilated FROM n GROUP BY 1""")
def erode_dilate(spark, sf):
    return V.morphology(cubes(spark, sf), ["vec_id"], "embedding", SHAPE, -0.1)


@query("bounding_box", "vec_id:l min_x:l max_x:l min_y:l max_y:l min_z:l max_z:l", f"""
WITH {VOX} SELECT vec_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM vox WHERE v > 0.1 GROUP BY 1""")
def bounding_box(spark, sf):
    return V.bounding_box(voxels(spark, sf), ["vec_id"], F.col("v") > 0.1)


@query("volume_biomarkers", "vec_id:l n:l ml:d pct:d", f"""
WITH {VOX} SELECT vec_id, count(*) FILTER (WHERE v > 0.1) AS n, count(*) FILTER (WHERE v > 0.1) * 0.003 AS ml, 100.0 * count(*) FILTER (WHERE v > 0.1) / nullif(count(*) FILTER (WHERE v > -0.1), 0) AS pct FROM vox GROUP BY 1""")
def volume_biomarkers(spark, sf):
    n, brain = F.count_if(F.col("v") > 0.1), F.count_if(F.col("v") > -0.1)
    return voxels(spark, sf).groupBy("vec_id").agg(n.alias("n"), (n * 0.003).alias("ml"), F.try_divide(100.0 * n, brain).alias("pct"))


@query("label_validation", "vec_id:l valid", """
SELECT vec_id, len(list_filter(embedding, lambda v: abs(CAST(v AS DOUBLE) * 5 - round_even(CAST(v AS DOUBLE) * 5, 0)) > 0.45 OR abs(round_even(CAST(v AS DOUBLE) * 5, 0)) > 1)) = 0 AS valid FROM embeddings""")
def label_validation(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", C.valid_labels(F.transform("embedding", lambda v: v.cast("double") * 5), [-1, 0, 1], 0.45).alias("valid"))


@query("label_findings", "vec_id:l n_not_finite:l n_fractional:l least_fractional:d unknown problem", """
WITH v AS (SELECT vec_id, CAST(embedding[i] AS DOUBLE) * 5 AS v FROM embeddings, range(1, 65) r(i) WHERE len(embedding) = 64),
w AS (SELECT *, v IS NOT NULL AND NOT isnan(v) AND abs(v) < CAST('inf' AS DOUBLE) AS fin FROM v),
o AS (SELECT vec_id, count(*) FILTER (WHERE NOT fin) AS n_not_finite, count(*) FILTER (WHERE fin AND abs(v - round_even(v, 0)) > 0.45) AS n_fractional, min(v) FILTER (WHERE fin AND abs(v - round_even(v, 0)) > 0.45) AS least_fractional FROM w GROUP BY 1),
u AS (SELECT vec_id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FILTER (WHERE place <= 10) AS unknown FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY k) AS place FROM (SELECT DISTINCT vec_id, CAST(round_even(v, 0) AS BIGINT) AS k FROM w WHERE fin AND abs(v - round_even(v, 0)) <= 0.45) WHERE k NOT IN (-1, 0, 1)) GROUP BY 1)
SELECT vec_id, n_not_finite, n_fractional, least_fractional, coalesce(unknown, '') AS unknown,
  CASE WHEN n_not_finite > 0 THEN 'not finite' WHEN n_fractional > 0 THEN 'fractional labels' WHEN unknown IS NOT NULL THEN 'unknown labels' END AS problem FROM o LEFT JOIN u USING (vec_id)""")
def label_findings(spark, sf):
    found = cubes(spark, sf).select("vec_id", C.offending_values(F.transform("embedding", lambda v: v.cast("double") * 5), [-1, 0, 1], 0.45).alias("f"))
    unknown = F.array_join(F.transform("f.unknown", lambda v: v.cast("long").cast("string")), ",")
    return found.select("vec_id", "f.n_not_finite", "f.n_fractional", F.get("f.fractional", F.lit(0)).alias("least_fractional"), unknown.alias("unknown"), C.case_problem(F.lit(True), F.col("f")).alias("problem"))


@query("describe_volumes", "vec_id:l low:d p1:d mid:d p99:d high:d", f"""
WITH {VOX} SELECT vec_id, min(v) AS low, quantile_cont(v, CAST(0.01 AS DOUBLE)) AS p1, quantile_cont(v, CAST(0.5 AS DOUBLE)) AS mid, quantile_cont(v, CAST(0.99 AS DOUBLE)) AS p99, max(v) AS high FROM vox GROUP BY 1""")
def describe_volumes(spark, sf):
    q = voxels(spark, sf).groupBy("vec_id").agg(F.min("v").alias("low"), F.percentile("v", [0.01, 0.5, 0.99]).alias("q"), F.max("v").alias("high"))
    return q.select("vec_id", "low", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p1", "mid", "p99"))], "high")


@query("same_grid", "vec_id:l same", """
SELECT a.vec_id, len(list_filter(list_zip(a.embedding, b.embedding), lambda p: NOT abs(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) <= 0.5 + 0.00001 * abs(CAST(p[2] AS DOUBLE)))) = 0 AS same FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def same_grid(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("a"))
    met = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    shape = F.array(*map(F.lit, SHAPE))
    return met.select("vec_id", C.same_grid(shape, F.col("a"), shape, F.col("b"), 0.5).alias("same"))


def _angles(first: int) -> list:
    """Six parameters of a cube from its own values: angles in radians, shifts in mm."""
    v = lambda i: F.get("embedding", F.lit(first + i)).cast("double")
    return [v(0), v(1), v(2), v(3) * 10, v(4) * 10, v(5) * 10]


def _turn_sql(name: str, at: int) -> str:
    """The rows of the transform with six parameters from the element `at` on, about (2, 2, 6)."""
    v = lambda i: f"CAST(embedding[{at + i}] AS DOUBLE)"
    return f"""{name}p AS (SELECT vec_id, cos({v(0)}) AS cx, sin({v(0)}) AS sx, cos({v(1)}) AS cy, sin({v(1)}) AS sy, cos({v(2)}) AS cz, sin({v(2)}) AS sz, 10 * {v(3)} AS tx, 10 * {v(4)} AS ty, 10 * {v(5)} AS tz FROM embeddings WHERE len(embedding) = 64),
{name}r AS (SELECT vec_id, cz * cy - sz * sx * sy AS a, -sz * cx AS b, cz * sy + sz * sx * cy AS c, sz * cy + cz * sx * sy AS d, cz * cx AS e, sz * sy - cz * sx * cy AS f, -cx * sy AS g, sx AS h, cx * cy AS i, tx, ty, tz FROM {name}p),
{name} AS (SELECT vec_id, a, b, c, d, e, f, g, h, i, 2 + tx - (a * 2 + b * 2 + c * 6) AS u, 2 + ty - (d * 2 + e * 2 + f * 6) AS v, 6 + tz - (g * 2 + h * 2 + i * 6) AS w FROM {name}r)"""


@query("transform_compare", "vec_id:l n:l disp_mean_mm:d disp_max_mm:d rot_diff_deg:d", f"""
WITH {VOX}, {_turn_sql("p", 1)}, {_turn_sql("q", 7)},
d AS (SELECT x.vec_id, sqrt(((p.a - q.a) * x + (p.b - q.b) * y + (p.c - q.c) * 3 * z + p.u - q.u) ** 2 + ((p.d - q.d) * x + (p.e - q.e) * y + (p.f - q.f) * 3 * z + p.v - q.v) ** 2
  + ((p.g - q.g) * x + (p.h - q.h) * y + (p.i - q.i) * 3 * z + p.w - q.w) ** 2) AS far FROM vox x JOIN p ON p.vec_id = x.vec_id JOIN q ON q.vec_id = x.vec_id WHERE x.v > 0),
s AS (SELECT vec_id, count(*) AS n, avg(far) AS m, max(far) AS x FROM d GROUP BY 1)
SELECT p.vec_id, coalesce(n, 0) AS n, round(m, 3) AS disp_mean_mm, round(x, 3) AS disp_max_mm,
  round(degrees(acos(greatest(-1, least(1, (p.a * q.a + p.b * q.b + p.c * q.c + p.d * q.d + p.e * q.e + p.f * q.f + p.g * q.g + p.h * q.h + p.i * q.i - 1) / 2)))), 3) AS rot_diff_deg
FROM p JOIN q ON q.vec_id = p.vec_id LEFT JOIN s ON s.vec_id = p.vec_id""")
def transform_compare(spark, sf):
    """Two registrations of each cube: one as parameters, one by way of its parameter text; compared over the voxels above 0, in mm."""
    c, centre = cubes(spark, sf), [F.lit(2.0), F.lit(2.0), F.lit(6.0)]
    ours, theirs = _angles(0), _angles(6)
    text = F.concat(F.lit("(TransformParameters "), F.concat_ws(" ", *[x.cast("string") for x in theirs]), F.lit(")\n(CenterOfRotationPoint 2.0 2.0 6.0)"))
    pairs = c.select("vec_id", X.rigid(ours[:3], ours[3:], centre).alias("ours"), X.rigid_of_parameters(text).alias("theirs"))
    points = voxels(spark, sf).where("v > 0").select("vec_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (F.col("z") * 3.0).alias("z"))
    return X.compared(pairs, ["vec_id"], "ours", "theirs", points)


@query("resampled_volume", "vec_id:l inside:l total:d greatest:d mask_ml:d nearest_total:d", f"""
WITH {VOX}, g AS (SELECT c.vec_id, t, tx * 0.75 AS px, ty * 0.75 + 0.1 * c.label AS py, tz * 0.5 AS pz FROM (SELECT DISTINCT vec_id, label FROM vox) c, (SELECT i AS t, i % 5 AS tx, (i // 5) % 5 AS ty, i // 25 AS tz FROM range(175) r(i)) s),
f AS (SELECT *, px >= -1e-9 AND px <= 3 + 1e-9 AND py >= -1e-9 AND py <= 3 + 1e-9 AND pz >= -1e-9 AND pz <= 3 + 1e-9 AS ok,
  least(greatest(floor(px + 1e-9), 0), 2) AS lx, least(greatest(floor(py + 1e-9), 0), 2) AS ly, least(greatest(floor(pz + 1e-9), 0), 2) AS lz FROM g),
e AS (SELECT f.vec_id, t, v, (CASE WHEN v > 0.1 THEN 1.0 ELSE 0.0 END) AS m, (CASE WHEN x = lx THEN 1 - least(greatest(px - lx, 0), 1) ELSE least(greatest(px - lx, 0), 1) END) * (CASE WHEN y = ly THEN 1 - least(greatest(py - ly, 0), 1) ELSE least(greatest(py - ly, 0), 1) END)
  * (CASE WHEN z = lz THEN 1 - least(greatest(pz - lz, 0), 1) ELSE least(greatest(pz - lz, 0), 1) END) AS w
  FROM f JOIN vox ON vox.vec_id = f.vec_id AND x >= lx AND x <= lx + 1 AND y >= ly AND y <= ly + 1 AND z >= lz AND z <= lz + 1 WHERE ok),
r AS (SELECT vec_id, t, sum(w * v) AS v, sum(w * m) AS m FROM e GROUP BY 1, 2),
k AS (SELECT f.vec_id, sum(v) AS total FROM f JOIN vox ON vox.vec_id = f.vec_id AND x = floor(px + 0.5) AND y = floor(py + 0.5) AND z = floor(pz + 0.5) GROUP BY 1),
a AS (SELECT vec_id, count(*) AS inside, sum(v) AS total, max(v) AS top, sum(m) * 0.75 * 0.75 * 1.5 / 1000 AS ml FROM r GROUP BY 1), n AS (SELECT vec_id, count(*) AS n FROM g GROUP BY 1)
SELECT a.vec_id, inside, a.total, CASE WHEN inside < n THEN greatest(top, 0) ELSE top END AS greatest, ml AS mask_ml, k.total AS nearest_total FROM a JOIN k ON k.vec_id = a.vec_id JOIN n ON n.vec_id = a.vec_id""")
def resampled_volume(spark, sf):
    """Each cube on a finer grid (0.75 x 0.75 x 1.5 mm, 5 x 5 x 7), shifted along y by a tenth of a millimetre a label.

    A mask's volume often ends in a 5 at the seventh place: it is freed of the sum's rounding error before it is rounded to six.
    """
    to, eye = (5, 5, 7), lambda a, b, c, y: F.array(*[x if not isinstance(x, float) else F.lit(x) for x in (a, 0.0, 0.0, 0.0, 0.0, b, 0.0, y, 0.0, 0.0, c, 0.0)])
    v = F.col("embedding").cast("array<double>")
    places = X.index_map(eye(1.0, 1.0, 3.0, 0.0), eye(0.75, 0.75, 1.5, F.col("label") / 10))
    mask = F.transform(v, lambda x: (x > 0.1).cast("double"))
    made = cubes(spark, sf).select("vec_id", X.resampled(v, SHAPE, places, to).alias("r"), X.resampled(mask, SHAPE, places, to).alias("m"), X.resampled(v, SHAPE, places, to, nearest=True).alias("k"), X.resampled(F.array_repeat(F.lit(1.0), 64), SHAPE, places, to).alias("in"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return made.select("vec_id", F.size(F.filter("in", lambda x: x > 0.5)).alias("inside"), total("r").alias("total"), F.array_max("r").alias("greatest"), F.round(X.fraction_volume(F.col("m"), 0.75 * 0.75 * 1.5), 12).alias("mask_ml"), total("k").alias("nearest_total"))


@query("zscore_volume", "vec_id:l i:l z:d", f"""
WITH {VOX}, b AS (SELECT * FROM vox WHERE v > -0.2), m AS (SELECT vec_id, median(v) AS m FROM b GROUP BY 1), d AS (SELECT b.vec_id, median(abs(v - m)) AS d FROM b JOIN m USING (vec_id) GROUP BY 1)
SELECT vec_id, i, (v - m) / nullif(1.4826 * d, 0) AS z FROM vox LEFT JOIN m USING (vec_id) LEFT JOIN d USING (vec_id)""")
def zscore_volume(spark, sf):
    return V.zscored(voxels(spark, sf), ["vec_id"], F.col("v") > -0.2)


_Q = ", ".join(f"quantile_cont(v, CAST({p / 100} AS DOUBLE))" for p in LANDMARKS)
MARKS = f"""{VOX}, q AS (SELECT vec_id, [{_Q}] AS q FROM vox GROUP BY 1), k AS (SELECT vec_id, unnest(range(0, {len(LANDMARKS)})) AS pos, q FROM q),
l AS (SELECT vec_id, pos, 100 * (q[pos + 1] - q[1]) / nullif(q[{len(LANDMARKS)}] - q[1], 0) AS landmark FROM k)"""


@query("landmarks", "vec_id:l pos:l landmark:d", f"WITH {MARKS} SELECT vec_id, pos, landmark FROM l")
def landmarks(spark, sf):
    return V.landmarks(voxels(spark, sf), ["vec_id"], LANDMARKS)


@query("histogram_standard", "pos:l standard:d", f"WITH {MARKS} SELECT pos, avg(landmark) AS standard FROM l GROUP BY 1")
def histogram_standard(spark, sf):
    return V.standard(landmarks(spark, sf))


@query("region_stats", "vec_id:l n:l med:d sd:d mad:d snr:d dietrich:d", f"""
WITH {VOX}, s AS (SELECT vec_id, v * 1000 AS v FROM vox WHERE z < 2), a AS (SELECT vec_id, count(*) AS n, median(round_even(v, 0)) AS med, stddev_pop(round_even(v, 0)) AS sd FROM s GROUP BY 1),
m AS (SELECT vec_id, median(abs(v - med)) / 0.6745 AS mad FROM s JOIN a USING (vec_id) GROUP BY 1)
SELECT vec_id, n, med, sd, mad, med / nullif(sd * sqrt(n / (n - 1.0)), 0) AS snr, CASE WHEN mad > 1 THEN 0.6551364 * med / mad WHEN sd > 0.001 THEN 0.6551364 * med / sd END AS dietrich FROM a JOIN m USING (vec_id)""")
def region_stats(spark, sf):
    s = V.region_stats(voxels(spark, sf).where("z < 2").withColumn("v", F.col("v") * 1000), ["vec_id"])
    return s.withColumns({"snr": V.snr(F.col("med"), F.col("sd"), F.col("n")), "dietrich": V.snr_dietrich(F.col("med"), F.col("mad"), F.col("sd"))})


@query("snr_cnr_cjv", "vec_id:l cnr:d cjv:d", f"""
WITH {VOX}, s AS (SELECT vec_id, CASE WHEN z < 1 THEN 'w' WHEN z < 2 THEN 'g' WHEN z < 3 THEN 'a' END AS r, v * 1000 AS v FROM vox),
a AS (SELECT vec_id, r, median(round_even(v, 0)) AS med, stddev_pop(round_even(v, 0)) AS sd FROM s WHERE r IS NOT NULL GROUP BY 1, 2),
m AS (SELECT s.vec_id, s.r, median(abs(v - med)) / 0.6745 AS mad FROM s JOIN a ON a.vec_id = s.vec_id AND a.r = s.r GROUP BY 1, 2),
j AS (SELECT a.vec_id, a.r, med, sd, mad FROM a JOIN m ON a.vec_id = m.vec_id AND a.r = m.r)
SELECT w.vec_id, abs(w.med - g.med) / nullif(sqrt(w.sd ** 2 + g.sd ** 2 + air.sd ** 2), 0) AS cnr, (w.mad + g.mad) / nullif(abs(w.med - g.med), 0) AS cjv
FROM j w JOIN j g ON g.vec_id = w.vec_id AND g.r = 'g' JOIN j air ON air.vec_id = w.vec_id AND air.r = 'a' WHERE w.r = 'w'""")
def snr_cnr_cjv(spark, sf):
    long = voxels(spark, sf).where("z < 3").withColumns({"v": F.col("v") * 1000, "r": F.when(F.col("z") < 1, "w").when(F.col("z") < 2, "g").otherwise("a")})
    s = V.region_stats(long, ["vec_id", "r"])
    part = lambda r: s.where(F.col("r") == r).select("vec_id", *[F.col(c).alias(f"{c}_{r}") for c in ("med", "sd", "mad")])
    met = part("w").join(part("g"), "vec_id").join(part("a"), "vec_id")
    cnr, cjv = V.cnr_cjv(F.col("med_w"), F.col("sd_w"), F.col("mad_w"), F.col("med_g"), F.col("sd_g"), F.col("mad_g"), F.col("sd_a"))
    return met.select("vec_id", cnr.alias("cnr"), cjv.alias("cjv"))


@query("efc", "vec_id:l efc:d", f"""
WITH {VOX}, b AS (SELECT vec_id, count(*) AS n, sqrt(sum(v * v)) AS b FROM vox WHERE v <> 0 GROUP BY 1)
SELECT vec_id, sum(abs(v) / b * ln(abs(v) / b)) / (any_value(n) / sqrt(any_value(n)) * ln(1 / sqrt(any_value(n)))) AS efc FROM vox JOIN b USING (vec_id) WHERE v <> 0 GROUP BY 1""")
def efc(spark, sf):
    return V.efc(voxels(spark, sf), ["vec_id"])


@query("fber", "vec_id:l fber:d", f"""
WITH {VOX} SELECT vec_id, CASE WHEN median(v * v) FILTER (WHERE z >= 2) >= 0.001 THEN median(v * v) FILTER (WHERE z < 2) / median(v * v) FILTER (WHERE z >= 2) END AS fber FROM vox GROUP BY 1""")
def fber(spark, sf):
    return V.fber(voxels(spark, sf), ["vec_id"], F.col("z") < 2)


@query("inu_range", "vec_id:l inu_range:d", f"""
WITH {VOX} SELECT vec_id, abs(quantile_cont(v, CAST(0.95 AS DOUBLE)) - quantile_cont(v, CAST(0.05 AS DOUBLE))) AS inu_range FROM vox GROUP BY 1""")
def inu_range(spark, sf):
    return V.inu_range(voxels(spark, sf), ["vec_id"])


@query("fwhm", "vec_id:l fwhm:d", f"""
WITH {VOX}, m AS (SELECT * FROM vox WHERE v > -0.2), s AS (SELECT vec_id, var_pop(v) AS s FROM m GROUP BY 1),
d AS (SELECT a.vec_id, 'x' AS axis, var_pop(b.v - a.v) AS d FROM m a JOIN m b ON b.vec_id = a.vec_id AND b.x = a.x + 1 AND b.y = a.y AND b.z = a.z GROUP BY 1
  UNION ALL SELECT a.vec_id, 'y', var_pop(b.v - a.v) FROM m a JOIN m b ON b.vec_id = a.vec_id AND b.x = a.x AND b.y = a.y + 1 AND b.z = a.z GROUP BY 1),
r AS (SELECT vec_id, 1 - d / nullif(2 * s, 0) AS r FROM d JOIN s USING (vec_id))
SELECT vec_id, avg(sqrt(-2 * ln(2) / ln(r))) AS fwhm FROM r WHERE r > 0 AND r < 1 GROUP BY 1""")
def fwhm(spark, sf):
    """The 3 mm axis is too coarse and left out."""
    return V.fwhm(voxels(spark, sf), ["vec_id"], SPACING, F.col("v") > -0.2)


@query("tissue_features", "label:l p5:d p95:d iqr:d skew:d contrast:d", f"""
WITH {VOX}, m AS (SELECT label, avg(v) AS m, stddev_pop(v) AS s FROM vox GROUP BY 1)
SELECT label, quantile_cont(v, CAST(0.05 AS DOUBLE)) AS p5, quantile_cont(v, CAST(0.95 AS DOUBLE)) AS p95, quantile_cont(v, CAST(0.75 AS DOUBLE)) - quantile_cont(v, CAST(0.25 AS DOUBLE)) AS iqr,
  avg((v - m) ** 3) / any_value(s) ** 3 AS skew, median(v) FILTER (WHERE z < 2) - median(v) FILTER (WHERE z >= 2) AS contrast FROM vox JOIN m USING (label) GROUP BY 1""")
def tissue_features(spark, sf):
    q = voxels(spark, sf).groupBy("label").agg(F.percentile("v", [0.05, 0.25, 0.75, 0.95]).alias("q"), F.skewness("v").alias("skew"), (F.median(F.when(F.col("z") < 2, F.col("v"))) - F.median(F.when(F.col("z") >= 2, F.col("v")))).alias("contrast"))
    g = lambda i: F.get("q", F.lit(i))
    return q.select("label", g(0).alias("p5"), g(3).alias("p95"), (g(2) - g(1)).alias("iqr"), "skew", "contrast")


@query("frequency_map", "label:l i:l freq:d", f"""
WITH {VOX} SELECT label, x + 4 * y + 16 * z AS i, avg(CASE WHEN v > 0.1 THEN 1.0 ELSE 0.0 END) AS freq FROM vox GROUP BY GROUPING SETS ((label, x, y, z), (x, y, z))""")
def frequency_map(spark, sf):
    maps = V.frequency_map(voxels(spark, sf), ["label"], F.col("v") > 0.1)
    return maps.withColumn("i", F.col("x") + 4 * F.col("y") + 16 * F.col("z"))


#: A cube's mean sign is its split; the sources are two cuts of the same cube.
@query("cohort_maps", "source split site i:l freq:d n:l", f"""
WITH {VOX}, c AS (SELECT vec_id, CASE WHEN sum(v) > 0 THEN 'training' ELSE 'test' END AS split FROM vox GROUP BY 1),
s AS (SELECT split, CAST(label AS VARCHAR) AS site, i, source, v > cut AS m FROM vox JOIN c USING (vec_id), (VALUES ('O1', 0.1), ('O2', 0.2)) t(source, cut)),
g AS (SELECT source, split, site, i, avg(CASE WHEN m THEN 1.0 ELSE 0.0 END) AS freq, count(*) AS n, grouping(split) AS gp, grouping(site) AS gs FROM s
  GROUP BY GROUPING SETS ((source, split, site, i), (source, split, i), (source, site, i), (source, i)))
SELECT source, CASE WHEN gp = 1 THEN 'all' ELSE split END AS split, CASE WHEN gs = 1 THEN 'all' ELSE site END AS site, i, freq, n FROM g WHERE gp = 0 OR source = 'O1'""")
def cohort_maps(spark, sf):
    total = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double"))
    some = cubes(spark, sf).select("vec_id", F.col("label").cast("string").alias("site"), F.when(total > 0, "training").otherwise("test").alias("split"), "embedding")
    long = V.voxels(some, ["vec_id", "site", "split"], "embedding", SHAPE)
    cuts = F.explode(F.array(*[F.struct(F.lit(s).alias("source"), (F.col("v") > cut).alias("m")) for s, cut in (("O1", 0.1), ("O2", 0.2))]))
    maps = V.cohort_maps(long.withColumn("c", cuts).select("*", "c.*"), F.col("m"))
    return maps.withColumn("i", F.col("x") + 4 * F.col("y") + 16 * F.col("z"))


@query("map_agreement", "label:l r:d mean:d mean_ref:d", f"""
WITH {VOX}, f AS (SELECT label, i, avg(CASE WHEN v > 0.1 THEN 1.0 ELSE 0.0 END) AS f FROM vox GROUP BY 1, 2)
SELECT a.label, corr(a.f, b.f) AS r, avg(a.f) AS mean, avg(b.f) AS mean_ref FROM f a JOIN f b ON a.i = b.i AND b.label = 0 WHERE a.label <> 0 GROUP BY 1""")
def map_agreement(spark, sf):
    return V.map_agreement(V.frequency_map(voxels(spark, sf), ["label"], F.col("v") > 0.1), "label", 0)


GRID_T, GRID_E, GRID_M = (0.0, 0.1), (0.0, 1.0), (0.0, 9.0)


def counts(spark, sf):
    """Grid counts with score = the next cube and reference = (0, 1, 2) of the own one; brain: score over -0.25."""
    a = cubes(spark, sf)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.transform("embedding", lambda v: v.cast("double")).alias("score"))
    return V.grid_counts(cases(spark, sf).select("vec_id", "ref").join(b, "vec_id"), ["vec_id"], "score", "ref", SHAPE, SPACING, lambda x: x > -0.25, GRID_T, GRID_E, GRID_M)


GRID = f"""{PAIR}, o AS (SELECT * FROM pr WHERE p <= -0.25),
dep AS (SELECT a.vec_id, a.i, a.x, a.y, a.z, a.p, a.mt, a.t < -0.2 AS ign, coalesce(min(sqrt((a.x - o.x) ** 2 + (a.y - o.y) ** 2 + 9 * (a.z - o.z) ** 2)), 1e9) AS depth FROM pr a LEFT JOIN o ON o.vec_id = a.vec_id GROUP BY ALL),
te(t, e) AS (VALUES (0.0, 0.0), (0.0, 1.0), (0.1, 0.0), (0.1, 1.0)),
gm AS (SELECT vec_id * 4 + CAST(t * 20 AS BIGINT) + CAST(e AS BIGINT) AS vec_id, i, x, y, z FROM dep, te WHERE p > t AND depth > e),
{reach('gm', 'true', 'g')}, siz AS (SELECT vec_id, component, count(*) * 3.0 AS mm3 FROM comp_g GROUP BY 1, 2), ms(m) AS (VALUES (0.0), (9.0)),
kept AS (SELECT c.vec_id // 4 AS vec_id, (c.vec_id % 4) // 2 / 10.0 AS t, c.vec_id % 2 AS e, m, c.i FROM comp_g c JOIN siz s ON s.vec_id = c.vec_id AND s.component = c.component, ms WHERE mm3 >= m),
cnt AS (SELECT k.vec_id, k.t, k.e, k.m, count(*) FILTER (WHERE mt) AS tp, count(*) FILTER (WHERE NOT ign) AS pred FROM kept k JOIN dep d ON d.vec_id = k.vec_id AND d.i = k.i GROUP BY 1, 2, 3, 4),
al AS (SELECT n.vec_id, te.t, te.e, ms.m, n.n_true FROM (SELECT vec_id, count(*) FILTER (WHERE mt) AS n_true FROM dep GROUP BY 1) n, te, ms),
g AS (SELECT al.vec_id, al.t, al.e, al.m, coalesce(tp, 0) AS tp, coalesce(pred, 0) AS pred, n_true FROM al LEFT JOIN cnt c ON c.vec_id = al.vec_id AND c.t = al.t AND c.e = al.e AND c.m = al.m)"""


@query("grid_counts", "vec_id:l t:d e:d m:d tp:l pred:l n_true:l", f"WITH RECURSIVE {GRID} SELECT * FROM g")
def grid_counts(spark, sf):
    return counts(spark, sf)


@query("tune_best", "t:d e:d m:d dice:d", f"""
WITH RECURSIVE {GRID}, d AS (SELECT t, e, m, round(avg(2.0 * tp / greatest(pred + n_true, 1)), 9) AS dice FROM g GROUP BY 1, 2, 3) SELECT t, e, m, dice FROM d ORDER BY dice DESC, t, e, m LIMIT 1""")
def tune_best(spark, sf):
    from ..operators.tabular import best_cell

    return best_cell(V.tuned(counts(spark, sf)).withColumn("dice", F.round("dice", 9)), "dice", ["t", "e", "m"])


@query("intensity_histmatch", "vec_id:l i:l v:d", f"""
WITH {MARKS}, s AS (SELECT pos, avg(landmark) AS s FROM l GROUP BY 1),
seg AS (SELECT q.vec_id, a.pos AS j, q.q[a.pos + 1] AS x0, q.q[a.pos + 2] AS x1, a.s AS y0, b.s AS y1 FROM q, s a JOIN s b ON b.pos = a.pos + 1)
SELECT vox.vec_id, i, y0 + (v - x0) * (y1 - y0) / (x1 - x0) AS v FROM vox JOIN seg ON seg.vec_id = vox.vec_id AND (v >= x0 OR j = 0) AND (v < x1 OR j = {len(LANDMARKS) - 2})""")
def intensity_histmatch(spark, sf):
    """Histogram matching of every cube to the standard that all of them average to."""
    marks = V.standard(V.landmarks(voxels(spark, sf), ["vec_id"], LANDMARKS)).orderBy("pos").collect()  # eleven rows
    return V.intensity(cubes(spark, sf), ["vec_id"], "embedding", SHAPE, "histmatch", np.array([r.standard for r in marks]), LANDMARKS)


@query("whitestripe", "vec_id:l i:l v:d error")
def whitestripe(spark, sf):
    """White stripe of every cube; one that is flat would become a row with the error."""
    return V.intensity(cubes(spark, sf), ["vec_id"], "embedding", SHAPE, "whitestripe", least=4)
