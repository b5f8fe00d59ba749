"""Queries of the statistics and model operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import kernels as K
from ..operators import ml, stats
from ..operators import tabular as R
from .base import EV_SQL, METRICS, evaluation, query, table

M = [*METRICS]


@query("spearman_site", "scanner n:l rho:d", f"""
WITH {EV_SQL}, r AS (SELECT scanner, rank() OVER (PARTITION BY scanner ORDER BY m_avg) + (count(*) OVER (PARTITION BY scanner, m_avg) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY scanner ORDER BY m_n) + (count(*) OVER (PARTITION BY scanner, m_n) - 1) / 2.0 AS ry FROM ev)
SELECT scanner, count(*) AS n, corr(rx, ry) AS rho FROM r GROUP BY 1""")
def spearman_site(spark, sf):
    return stats.spearman(evaluation(spark, sf), "m_avg", "m_n", ["scanner"])


@query("pearson_site", "scanner r:d", f"WITH {EV_SQL} SELECT scanner, corr(m_avg, m_max) AS r FROM ev GROUP BY 1")
def pearson_site(spark, sf):
    return evaluation(spark, sf).groupBy("scanner").agg(F.corr("m_avg", "m_max").alias("r"))


@query("kruskal_sites", "model n:l k:l h:d p:d", f"""
WITH {EV_SQL}, r AS (SELECT model, scanner, m_n, rank() OVER (PARTITION BY model ORDER BY m_n) + (count(*) OVER (PARTITION BY model, m_n) - 1) / 2.0 AS r FROM ev),
t AS (SELECT model, sum(CAST(c AS DOUBLE) ** 3 - c) AS ties FROM (SELECT model, count(*) AS c FROM r GROUP BY model, m_n) GROUP BY 1),
s AS (SELECT model, sum(m) AS n, count(*) AS k, sum(s * s / m) AS q FROM (SELECT model, scanner, sum(r) AS s, count(*) AS m FROM r GROUP BY 1, 2) GROUP BY 1),
h AS (SELECT model, n, k, (12 / (CAST(n AS DOUBLE) * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (CAST(n AS DOUBLE) ** 3 - n)) AS h FROM s JOIN t USING (model))
SELECT model, n, k, h, CASE WHEN k = 5 THEN exp(-h / 2) * (1 + h / 2) WHEN k = 3 THEN exp(-h / 2) END AS p FROM h""")
def kruskal_sites(spark, sf):
    return stats.kruskal_h(evaluation(spark, sf), "scanner", "m_n", ["model"])


def rater_pairs(spark, sf):
    pairs = R.rater_pairs(evaluation(spark, sf), ["participant", "scanner", "seen"], "model", "F", "m_avg")
    return pairs.withColumns({"x": C.on_scale(F.col("rater"), "log"), "y": C.on_scale(F.col("ref"), "log")})


PAIRS_SQL = f"""WITH {EV_SQL}, p AS (SELECT a.model AS rater_name, a.participant, a.scanner, ln(a.m_avg) AS x, ln(b.m_avg) AS y FROM ev a JOIN ev b ON a.participant = b.participant AND a.model <> 'F' AND b.model = 'F')"""


@query("bland_altman", "rater_name n:l bias:d sd:d p2_5:d p97_5:d loa_low:d loa_high:d skew:d", f"""
{PAIRS_SQL}, d AS (SELECT rater_name, x - y AS d FROM p), m AS (SELECT rater_name, avg(d) AS m, stddev_pop(d) AS s FROM d GROUP BY 1)
SELECT rater_name, count(*) AS n, avg(d) AS bias, stddev_samp(d) AS sd, quantile_cont(d, CAST(0.025 AS DOUBLE)) AS p2_5, quantile_cont(d, CAST(0.975 AS DOUBLE)) AS p97_5,
  avg(d) - 1.96 * stddev_samp(d) AS loa_low, avg(d) + 1.96 * stddev_samp(d) AS loa_high, avg((d - m) ** 3) / any_value(s) ** 3 AS skew FROM d JOIN m USING (rater_name) GROUP BY 1""")
def bland_altman(spark, sf):
    return stats.bland_altman(rater_pairs(spark, sf), ["rater_name"], "x", "y")


@query("icc_a1", "rater_name n:l icc:d", f"""
{PAIRS_SQL}, u AS (SELECT rater_name, participant, 'x' AS c, x AS v FROM p UNION ALL SELECT rater_name, participant, 'y', y FROM p),
g AS (SELECT rater_name, avg(v) AS g, count(*) / 2 AS n FROM u GROUP BY 1),
rm AS (SELECT rater_name, participant, avg(v) AS r FROM u GROUP BY 1, 2), cm AS (SELECT rater_name, c, avg(v) AS m FROM u GROUP BY 1, 2),
a AS (SELECT rater_name, sum(2 * (r - g) ** 2) / (any_value(n) - 1) AS msr FROM rm JOIN g USING (rater_name) GROUP BY 1),
b AS (SELECT rater_name, sum(n * (m - g) ** 2) AS msc FROM cm JOIN g USING (rater_name) GROUP BY 1),
e AS (SELECT rater_name, sum((v - r - m + g) ** 2) / (any_value(n) - 1) AS mse FROM u JOIN g USING (rater_name) JOIN rm USING (rater_name, participant) JOIN cm USING (rater_name, c) GROUP BY 1)
SELECT rater_name, CAST(n AS BIGINT) AS n, (msr - mse) / (msr + mse + 2 * (msc - mse) / n) AS icc FROM a JOIN b USING (rater_name) JOIN e USING (rater_name) JOIN g USING (rater_name)""")
def icc(spark, sf):
    return stats.icc_a1(rater_pairs(spark, sf), ["rater_name"], "x", "y")


@query("eta_squared", "model n:l eta2:d", f"""
WITH {EV_SQL}, g AS (SELECT model, avg(m_avg) AS g FROM ev GROUP BY 1), s AS (SELECT model, scanner, avg(m_avg) AS m FROM ev GROUP BY 1, 2)
SELECT model, count(*) AS n, sum((m - g) ** 2) / sum((m_avg - g) ** 2) AS eta2 FROM ev JOIN g USING (model) JOIN s USING (model, scanner) GROUP BY 1""")
def eta_squared(spark, sf):
    return stats.eta_squared(evaluation(spark, sf), "scanner", "m_avg", ["model"])


@query("moments", "label:l skew:d kurtosis:d", """
WITH v AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), m AS (SELECT label, avg(v) AS m, stddev_pop(v) AS s FROM v GROUP BY 1)
SELECT label, avg((v - m) ** 3) / any_value(s) ** 3 AS skew, avg((v - m) ** 4) / any_value(s) ** 4 - 3 AS kurtosis FROM v JOIN m USING (label) GROUP BY 1""")
def moments(spark, sf):
    return stats.moments(table(spark, sf, "embeddings").select("label", F.explode(F.col("embedding").cast("array<double>")).alias("v")), ["label"], "v")


@query("seen_unseen", "model metric n_seen:l n_unseen:l diff:d", f"""
WITH {EV_SQL}, u AS (UNPIVOT (SELECT model, seen, m_avg, m_max FROM ev) ON m_avg, m_max INTO NAME metric VALUE value)
SELECT model, metric, count(*) FILTER (WHERE seen) AS n_seen, count(*) FILTER (WHERE NOT seen) AS n_unseen, avg(value) FILTER (WHERE NOT seen) - avg(value) FILTER (WHERE seen) AS diff FROM u GROUP BY 1, 2""")
def seen_unseen(spark, sf):
    u = R.long(evaluation(spark, sf), ["model", "seen"], ["m_avg", "m_max"])
    return u.groupBy("model", "metric").agg(F.count_if("seen").alias("n_seen"), F.count_if(~F.col("seen")).alias("n_unseen"), (F.avg(F.when(~F.col("seen"), F.col("value"))) - F.avg(F.when(F.col("seen"), F.col("value")))).alias("diff"))


def differences(spark, sf):
    """(a, b, participant, scanner, seen, metric, va, vb) for every two models and every metric."""
    fam = spark.createDataFrame([("main", "F"), ("main", "O"), ("main", "P")], "family string, model string")
    long = R.long(evaluation(spark, sf), ["participant", "scanner", "seen", "model"], M)
    return R.model_pairs(long, R.member_pairs(fam, "family", "model"), ["participant", "scanner", "seen", "metric"], "model", "value")


@query("did_gain", "a b n_seen:l n_unseen:l gain:d", f"""
WITH {EV_SQL}, d AS (SELECT x.model AS a, y.model AS b, x.seen, x.m_avg - y.m_avg AS d FROM ev x JOIN ev y ON x.participant = y.participant AND x.model < y.model)
SELECT a, b, count(*) FILTER (WHERE seen) AS n_seen, count(*) FILTER (WHERE NOT seen) AS n_unseen, avg(d) FILTER (WHERE NOT seen) - avg(d) FILTER (WHERE seen) AS gain FROM d GROUP BY 1, 2""")
def did_gain(spark, sf):
    d = differences(spark, sf).where("metric = 'm_avg'").withColumn("d", F.col("va") - F.col("vb"))
    return d.groupBy("a", "b").agg(F.count_if("seen").alias("n_seen"), F.count_if(~F.col("seen")).alias("n_unseen"), (F.avg(F.when(~F.col("seen"), F.col("d"))) - F.avg(F.when(F.col("seen"), F.col("d")))).alias("gain"))


@query("wins_with_reference", "a b n:l wins:l", f"""
WITH {EV_SQL} SELECT x.model AS a, y.model AS b, count(*) AS n, count(*) FILTER (WHERE x.m_min < y.m_min) AS wins FROM ev x JOIN ev y ON x.participant = y.participant AND x.model < y.model AND x.seen GROUP BY 1, 2""")
def wins_with_reference(spark, sf):
    """Direction-aware wins on the shared subset: lower is better here."""
    fam = spark.createDataFrame([("main", "F"), ("main", "O"), ("main", "P")], "family string, model string")
    pairs = R.model_pairs(evaluation(spark, sf).where("seen"), R.member_pairs(fam, "family", "model"), ["participant"], "model", "m_min")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("va") < F.col("vb")).alias("wins"))


_RANKED = "rank() OVER (PARTITION BY {k} ORDER BY {v}) + (count(*) OVER (PARTITION BY {k}, {v}) - 1) / 2.0"
_TIES = "SELECT {k}, sum(CAST(c AS DOUBLE) ** 3 - c) AS ties, count(*) AS distinct_values FROM (SELECT {k}, count(*) AS c FROM r GROUP BY {k}, {v}) GROUP BY {k}"


@query("signed_rank_sums", "a b n:l n_signed:l w_plus:d ties:d distinct:l", f"""
WITH {EV_SQL}, d AS (SELECT x.model AS a, y.model AS b, x.m_n - y.m_n AS d FROM ev x JOIN ev y ON x.participant = y.participant AND x.model < y.model),
r AS (SELECT a, b, d, abs(d) AS s, {_RANKED.format(k='a, b', v='abs(d)')} AS r FROM d WHERE d <> 0), t AS ({_TIES.format(k='a, b', v='s')}),
w AS (SELECT a, b, count(*) AS m, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w FROM r GROUP BY 1, 2)
SELECT n.a, n.b, n.n, coalesce(m, 0) AS n_signed, coalesce(w, 0) AS w_plus, coalesce(ties, 0) AS ties, coalesce(distinct_values, 0) AS "distinct"
FROM (SELECT a, b, count(*) AS n FROM d GROUP BY 1, 2) n LEFT JOIN w ON w.a = n.a AND w.b = n.b LEFT JOIN t ON t.a = n.a AND t.b = n.b""")
def signed_rank_sums(spark, sf):
    """Numbers of orders differ by whole numbers, so there are ties and zeros."""
    fam = spark.createDataFrame([("main", "F"), ("main", "O"), ("main", "P")], "family string, model string")
    pairs = R.model_pairs(evaluation(spark, sf), R.member_pairs(fam, "family", "model"), ["participant"], "model", "m_n")
    return stats.signed_rank_sums(pairs.withColumn("d", F.col("va") - F.col("vb")), ["a", "b"], "d")


@query("rank_sums", "model n_true:l n_false:l rank_sum:d ties:d distinct:l", f"""
WITH {EV_SQL}, r AS (SELECT model, seen, m_n, {_RANKED.format(k='model', v='m_n')} AS r FROM ev), t AS ({_TIES.format(k='model', v='m_n')})
SELECT model, count(*) FILTER (WHERE seen) AS n_true, count(*) FILTER (WHERE NOT seen) AS n_false, coalesce(sum(r) FILTER (WHERE seen), 0) AS rank_sum, any_value(ties) AS ties, any_value(distinct_values) AS "distinct"
FROM r JOIN t USING (model) GROUP BY 1""")
def rank_sums(spark, sf):
    return stats.rank_sums(evaluation(spark, sf), ["model"], "m_n", "seen")


# -- exact nulls, resampling and models: SQL has no words for them ------------------------------------------------------


@query("wilcoxon_pairs", "family a b metric n:l p:d p_holm:d")
def wilcoxon_pairs(spark, sf):
    d = differences(spark, sf).withColumn("d", F.col("va") - F.col("vb"))
    return R.holm(stats.wilcoxon(d, ["family", "a", "b", "metric"], "d"), ["family"], "p", ["a", "b", "metric"])


@query("mannwhitney_seen", "model n_true:l n_false:l p:d")
def mannwhitney_seen(spark, sf):
    return stats.mann_whitney(evaluation(spark, sf), ["model"], "m_avg", "seen")


@query("kruskal_test", "model h:d p:d")
def kruskal_test(spark, sf):
    return stats.kruskal(evaluation(spark, sf), ["model"], "scanner", "m_n")


_SCORE = C.normal_quantile_sql("((i - 0.375e0) / (n + 0.25e0))")
_LAST, _NEXT = C.normal_quantile_sql("((n - 0.375e0) / (n + 0.25e0))"), C.normal_quantile_sql("((n - 1.375e0) / (n + 0.25e0))")
_POLY = lambda c: " + ".join(f"{k!r} * power(1 / sqrt(n), {i})" for i, k in enumerate(c) if k)


@query("shapiro_w", "scanner model n:l w:d", f"""
WITH {EV_SQL}, o AS (SELECT scanner, model, m_avg AS x, row_number() OVER (PARTITION BY scanner, model ORDER BY m_avg) AS i, CAST(count(*) OVER (PARTITION BY scanner, model) AS DOUBLE) AS n FROM ev),
m AS (SELECT *, {_SCORE} AS m FROM o), t AS (SELECT scanner, model, sum(m * m) AS total, sum((x - a) ** 2) AS ss FROM m JOIN (SELECT scanner, model, avg(x) AS a FROM o GROUP BY 1, 2) USING (scanner, model) GROUP BY 1, 2),
e AS (SELECT *, ({_LAST}) / sqrt(total) + {_POLY(K.SHAPIRO_LAST)} AS a1, ({_NEXT}) / sqrt(total) + {_POLY(K.SHAPIRO_NEXT)} AS a2 FROM m JOIN t USING (scanner, model)),
w AS (SELECT *, CASE WHEN i = n THEN a1 WHEN i = 1 THEN -a1 WHEN i = n - 1 THEN a2 WHEN i = 2 THEN -a2 ELSE m / sqrt((total - 2 * ({_LAST}) ** 2 - 2 * ({_NEXT}) ** 2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) END AS a FROM e)
SELECT scanner, model, any_value(n) AS n, sum(a * x) ** 2 / any_value(ss) AS w FROM w GROUP BY 1, 2 HAVING any_value(n) > 5""")
def shapiro_w(spark, sf):
    """The statistic of the test of normality; its tail is shapiro_test's."""
    return stats.shapiro(evaluation(spark, sf), ["scanner", "model"], "m_avg").where("n > 5")


@query("shapiro_test", "scanner model n:l w:d p:d")
def shapiro_test(spark, sf):
    return stats.shapiro(evaluation(spark, sf), ["scanner", "model"], "m_avg")


@query("bootstrap_ci", "model group metric n:l n_missing:l mean:d low:d high:d")
def bootstrap_ci(spark, sf):
    ev = evaluation(spark, sf)
    groups = F.array(F.lit("all"), F.concat(F.lit("scanner="), "scanner"), F.concat(F.lit("seen="), F.initcap(F.col("seen").cast("string"))))
    long = R.long(ev, ["participant", "model", "scanner", "seen"], M)
    return stats.bootstrap_ci(long, ["model", "group", "metric"], "value", "scanner", "participant", together=["metric"], groups=groups)


@query("paired_table", "family a b metric n:l mean_a:d mean_b:d mean_diff:d low:d high:d p:d p_holm:d")
def paired_table(spark, sf):
    return stats.paired_table(differences(spark, sf), "scanner", "participant")


@query("seen_unseen_table", "model metric n_seen:l n_unseen:l mean_seen:d mean_unseen:d diff:d low:d high:d p:d p_holm:d")
def seen_unseen_table(spark, sf):
    long = R.long(evaluation(spark, sf), ["participant", "model", "scanner", "seen"], M)
    return stats.unpaired_table(long, ["model", "metric"], "seen", "scanner", "participant", ["metric"], together=["metric"])


@query("gain_unseen_table", "a b metric n_seen:l n_unseen:l mean_seen:d mean_unseen:d diff:d low:d high:d p:d p_holm:d")
def gain_unseen_table(spark, sf):
    d = differences(spark, sf).withColumn("value", F.col("va") - F.col("vb"))
    return stats.unpaired_table(d, ["a", "b", "metric"], "seen", "scanner", "participant", ["a", "b"], together=["metric"])


@query("agreement_table", "rater_name n:l n_excluded:l icc:d icc_from:d icc_to:d bias:d sd:d loa_low:d loa_high:d shapiro_p:d raw_diff:d ratio:d")
def agreement_table(spark, sf):
    return stats.agreement(rater_pairs(spark, sf).select("rater_name", "participant", "scanner", "rater", "ref"), ["rater_name"], "log", "scanner", "participant")


@query("bias_by_scanner", "rater_name scanner n:l bias:d low:d high:d p:d p_holm:d")
def bias_by_scanner(spark, sf):
    return stats.bias_by_scanner(rater_pairs(spark, sf).select("rater_name", "participant", "scanner", "rater", "ref"), ["rater_name"], "scanner", "participant", "log")


_KINDS = {"m_avg": "log", "m_max": "log", "m_min": "log1p", "m_sum": "raw", "m_n": "log1p"}


@query("agreement_run", "split rater_name biomarker n:l n_excluded:l icc:d bias:d sd:d loa_low:d loa_high:d h_site:d p_site:d p_site_holm:d", f"""
WITH {EV_SQL}, u AS (UNPIVOT (SELECT participant, scanner, model, m_avg, m_max, m_min, m_sum, m_n FROM ev) ON m_avg, m_max, m_min, m_sum, m_n INTO NAME biomarker VALUE value),
p AS (SELECT a.model AS rater_name, a.biomarker, a.participant, a.scanner, a.value AS rater, b.value AS ref FROM u a JOIN u b ON a.participant = b.participant AND a.biomarker = b.biomarker AND b.model = 'F' AND a.model IN ('O', 'P')),
x AS (SELECT *, CASE WHEN biomarker IN ('m_avg', 'm_max') THEN CASE WHEN rater > 0 THEN ln(rater) END WHEN biomarker = 'm_sum' THEN rater ELSE CASE WHEN rater > -1 THEN ln(1 + rater) END END AS x,
  CASE WHEN biomarker IN ('m_avg', 'm_max') THEN CASE WHEN ref > 0 THEN ln(ref) END WHEN biomarker = 'm_sum' THEN ref ELSE CASE WHEN ref > -1 THEN ln(1 + ref) END END AS y FROM p),
d AS (SELECT *, x - y AS d FROM x),
s AS (SELECT rater_name, biomarker, count(d) AS n, count(*) - count(d) AS n_excluded, avg(d) AS bias, stddev_samp(d) AS sd, quantile_cont(d, CAST(0.025 AS DOUBLE)) AS loa_low, quantile_cont(d, CAST(0.975 AS DOUBLE)) AS loa_high,
  avg(x) - avg(y) AS gap, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c FROM d GROUP BY 1, 2),
i AS (SELECT *, n * (vx + vy + 2 * c) / (2.0 * (n - 1)) AS msr, n * gap * gap / 2 AS msc, n * (vx + vy - 2 * c) / (2.0 * (n - 1)) AS mse FROM s),
u2 AS (SELECT rater_name, biomarker, scanner, round(d, 12) AS d FROM d WHERE d IS NOT NULL), r AS (SELECT *, {_RANKED.format(k='rater_name, biomarker', v='d')} AS r FROM u2),
t AS (SELECT rater_name, biomarker, sum(CAST(c AS DOUBLE) ** 3 - c) AS ties FROM (SELECT rater_name, biomarker, count(*) AS c FROM r GROUP BY rater_name, biomarker, d) GROUP BY 1, 2),
k AS (SELECT rater_name, biomarker, sum(m) AS m, count(*) AS g, sum(s * s / m) AS q FROM (SELECT rater_name, biomarker, scanner, sum(r) AS s, count(*) AS m FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2),
h AS (SELECT k.rater_name, k.biomarker, g, (12 / (CAST(m AS DOUBLE) * (m + 1)) * q - 3 * (m + 1)) / (1 - ties / (CAST(m AS DOUBLE) ** 3 - m)) AS h FROM k JOIN t ON t.rater_name = k.rater_name AND t.biomarker = k.biomarker),
v AS (SELECT rater_name, biomarker, h, CASE WHEN g = 5 THEN exp(-h / 2) * (1 + h / 2) WHEN g = 3 THEN exp(-h / 2) END AS p FROM h),
o AS (SELECT *, row_number() OVER (ORDER BY p, rater_name, biomarker) AS at, count(p) OVER () AS m FROM v WHERE p IS NOT NULL)
SELECT 'test' AS split, i.rater_name, i.biomarker, i.n, n_excluded, (msr - mse) / (msr + mse + 2 * (msc - mse) / n) AS icc, bias, sd, loa_low, loa_high, o.h AS h_site, o.p AS p_site,
  least(1, max((o.m - o.at + 1) * o.p) OVER (ORDER BY o.at)) AS p_site_holm FROM i LEFT JOIN o ON o.rater_name = i.rater_name AND o.biomarker = i.biomarker""")
def agreement_run(spark, sf):
    """Every metric on its scale, every model beside F. The intervals are agreement_table's."""
    table_ = evaluation(spark, sf).withColumn("split", F.lit("test"))
    return stats.agreement_run(table_, _KINDS, "F", sources=["O", "P"], subject="participant", source="model", tables=["overall"])[0]


@query("agreement_by_scanner", "split rater_name biomarker scanner n:l bias:d low:d high:d p:d p_holm:d")
def agreement_by_scanner(spark, sf):
    table_ = evaluation(spark, sf).withColumn("split", F.lit("test"))
    return stats.agreement_run(table_, _KINDS, "F", sources=["O", "P"], subject="participant", source="model", tables=["by_scanner"])[1]


#: All components of a vector are features.
FEATURES = [f"f{i}" for i in range(64)]


def features(spark, sf, names=FEATURES):
    """vec_id, site, FEATURES (or the first of them)."""
    v = F.col("embedding")
    return table(spark, sf, "embeddings").where("embedding is not null").select("vec_id", F.col("label").cast("string").alias("site"), *[F.get(v, F.lit(i)).cast("double").alias(f) for i, f in enumerate(names)])


@query("isolation_forest", "vec_id:l iforest_score:d iforest_outlier")
def isolation_forest(spark, sf):
    return ml.isolation_forest(features(spark, sf), "vec_id", FEATURES)


@query("combat", "vec_id:l site " + " ".join(f"{f}:d" for f in FEATURES))
def combat(spark, sf):
    return ml.combat(features(spark, sf), "vec_id", FEATURES, "site")


@query("site_classifier", "harmonised fold:l n_test:l balanced_accuracy:d")
def site_classifier(spark, sf):
    return ml.site_classifier(features(spark, sf), "vec_id", FEATURES, "site")
