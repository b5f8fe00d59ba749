"""Resampling by parts: the distribution of drawing whole strata, whatever the parts, and memory of a part."""

import subprocess
import sys

import numpy as np
import pytest
from conftest import ROOT
from pyspark.sql import functions as F

from cohortis.functions import columns as C
from cohortis.functions import kernels as K
from cohortis.operators import resample, scans, stats


def cell(rng, n):
    return [(i, "xyz"[i % 3], float(v + (i % 3))) for i, v in enumerate(rng.gamma(2.0, 1.0, n))]


def test_numbers_of_parts_add_up_and_agree(spark):
    """Every part walks the tree alone; together they have dealt exactly a stratum's draws."""
    data = cell(np.random.default_rng(1), 700)
    df = spark.createDataFrame(data, "o long, s string, v double").withColumn("k", F.lit("c"))
    rows = df.select("k", resample.cell_name(["k"]).alias("_cell"), F.col("s").alias("_s"), F.col("o").alias("_o"), F.col("v").alias("_v"))
    dealt = resample.with_paths(resample.hashed_parts(rows, ["_s", "_o", "_v"], 50))
    assert dealt.select("_part").distinct().count() == 14
    dealt = dealt.withColumn("_one", F.lit(1.0))
    parts = resample.draws(dealt, ["_o"], ["_v", "_one"], 200, 3, by_part=True)
    whole = parts.groupBy("_draw").agg(F.sum("_n").alias("n")).collect()
    assert len(whole) == 200 and {r.n for r in whole} == {700}
    sizes = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}
    spread = parts.groupBy("_part").agg(F.avg("_n").alias("m"), F.stddev("_n").alias("sd")).collect()
    for r in spread:  # a part's number is about binomial in each stratum
        n = sizes[r["_part"]]
        assert abs(r.m - n) < 5 * np.sqrt(n / 200) and 0.75 < r.sd / np.sqrt(n * (1 - n / 700)) < 1.25


@pytest.mark.parametrize("part", [10_000, 64])
def test_means_have_the_distribution_of_whole_strata(spark, part):
    data = cell(np.random.default_rng(2), 500)
    df = spark.createDataFrame([("c", *r) for r in data], "k string, o long, s string, v double").repartition(5)
    got = np.sort([r["_mean"] for r in resample.means(df, ["k"], "v", "s", "o", 4000, 7, part).collect()])
    v, s = np.array([r[2] for r in data]), np.array([r[1] for r in data])
    want = np.sort(K.bootstrap_means(v, s, 4000, np.random.default_rng(0)))
    both = np.sort(np.concatenate([got, want]))
    gap = np.abs(np.searchsorted(got, both, side="right") - np.searchsorted(want, both, side="right")).max() / 4000
    assert len(got) == 4000 and gap < 1.95 * np.sqrt(2 / 4000)  # Kolmogorov and Smirnov's, at 0.1 %
    assert abs(got.std() / want.std() - 1) < 0.06


def test_results_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    data = [(f"c{i % 2}", i // 2, "ab"[i % 3 == 0], float(rng.normal()) if i % 11 else None) for i in range(900)]
    df = spark.createDataFrame(data, "k string, o long, s string, v double")
    one, many = (sorted(map(tuple, stats.bootstrap_ci(d, ["k"], "v", "s", "o", 300).collect())) for d in (df.coalesce(1), df.repartition(17)))
    assert len(one) == 2 and all(a[:3] == b[:3] and np.allclose(a[3:], b[3:], rtol=1e-12) for a, b in zip(one, many, strict=True))


@pytest.mark.parametrize("part", [10_000, 40])
def test_agreement_against_whole_cells(spark, part):
    rng = np.random.default_rng(4)
    ref = rng.gamma(3.0, 2.0, 400)
    data = [("m", i, "pqr"[i % 3], float(r * np.exp(rng.normal(0.1, 0.3))), float(r)) for i, r in enumerate(ref)] + [("m", 900, "p", -1.0, 2.0), ("few", 1, "p", 1.0, 1.0)]
    df = spark.createDataFrame(data, "k string, id long, s string, rater double, ref double").repartition(6)
    got = {r.k: r for r in stats.agreement(df, ["k"], "log", "s", "id", 1500, part=part).collect()}
    r = got["m"]
    x = np.log(np.array([d[3:] for d in data[:400]]))
    d, strata = x[:, 0] - x[:, 1], np.array([row[2] for row in data[:400]])
    assert (r.n, r.n_excluded, got["few"].n, got["few"].icc, got["few"].loa_low, got["few"].shapiro_p) == (400, 1, 1, None, None, None)
    assert r.icc == pytest.approx(K.icc_a1(x)) and r.bias == pytest.approx(d.mean()) and r.sd == pytest.approx(d.std(ddof=1)) and r.ratio == pytest.approx(np.exp(d.mean()))
    assert [r.loa_low, r.loa_high] == pytest.approx(np.percentile(d, [2.5, 97.5]).tolist()) and r.shapiro_p == pytest.approx(K.shapiro(d), rel=1e-6)
    index = K.stratified_indices(strata, 1500, np.random.default_rng(9))
    want = {"icc": [K.icc_a1(x[i]) for i in index], "loa_low": np.percentile(d[index], 2.5, axis=1), "loa_high": np.percentile(d[index], 97.5, axis=1)}
    for name, values in want.items():
        error = 6 * np.std(values) * np.sqrt(0.025 * 0.975 / 1500) / 0.058  # of a 2.5 % quantile of 1,500 draws, of both sides
        low, high = np.quantile(values, [0.025, 0.975])
        assert abs(r[f"{name}_from"] - low) < error and abs(r[f"{name}_to"] - high) < error, name


def test_order_statistics_are_those_of_the_same_draws(spark):
    """The values at a rank are found by parts; here the draws are put together and sorted."""
    data = cell(np.random.default_rng(5), 300)
    df = spark.createDataFrame(data, "o long, s string, v double")
    rows = scans.numbered(df.select(F.lit("c").alias("_cell"), F.col("s").alias("_s"), F.col("o").alias("_o"), F.col("v").alias("d")), ["_cell"], ["d"], "_row")
    dealt = resample.with_paths(rows.withColumns({"_part": F.floor((F.col("_row") - 1) / 32), "_levels": resample.levels(F.lit(10))}))
    by_part = resample.draws(dealt, ["_o", "d"], ["d"], 50, 11, by_part=True)
    ranks = df.sparkSession.createDataFrame([("c", i) for i in (0, 7, 150, 299)], "_cell string, _rank long")
    got = {(r["_draw"], r["_rank"]): r.d for r in resample.order_statistics(dealt, ["_o", "d"], "d", by_part, ranks, 50, 11).collect()}
    pdf = dealt.toPandas()
    drawn = {b: [] for b in range(50)}
    for part, own in pdf.groupby("_part"):
        own = own.sort_values(["_s", "_o", "d"])
        for rows_, c in resample.counts("c", int(part), resample.strata_of(own), 50, 11):
            for i, b in enumerate(range(rows_.start, rows_.stop)):
                drawn[b] += np.repeat(own.d.to_numpy(), c[i]).tolist()
    assert all(len(x) == 300 for x in drawn.values())
    assert got == {(b, i): sorted(x)[i] for b, x in drawn.items() for i in (0, 7, 150, 299)}


def test_shapiro_by_ranks(spark):
    rng = np.random.default_rng(6)
    cells = {"three": [1.0, 2.0, 4.0], "four": [1.0, 2.0, 4.0, 4.5], "five": [5.0, 1.0, 2.0, 2.0, 9.0], "eleven": rng.normal(size=11).tolist(), "twelve": rng.exponential(size=12).tolist(), "many": rng.normal(size=900).tolist(), "skew": rng.gamma(3, size=300).tolist(), "flat": [2.0] * 8, "two": [1.0, 2.0], "gaps": [1.0, None, float("nan"), 3.0, 7.0, 8.5]}
    df = spark.createDataFrame([(k, v) for k, vs in cells.items() for v in vs], "k string, v double").repartition(4)
    got = {r.k: r for r in stats.shapiro(df, ["k"], "v").collect()}
    for k, vs in cells.items():
        want = K.shapiro(np.array([np.nan if v is None else v for v in vs]))
        assert (got[k].p is None) if np.isnan(want) else got[k].p == pytest.approx(want, rel=1e-6, abs=1e-12), k


def test_normal_quantile(spark):
    from statistics import NormalDist

    at = [1e-300, 1e-20, 1e-9, 0.001, 0.02, 0.0749, 0.0751, 0.3, 0.5, 0.6, 0.925001, 0.99, 1 - 1e-9]
    got = [r.q for r in C.with_normal_quantiles(spark.createDataFrame([(p,) for p in at], "p double"), q=F.col("p")).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in at], rel=1e-13, abs=1e-15)


def test_memory_is_that_of_a_part():
    """A part of a cell of 200,000 rows, 2,000 draws: a task needs under 60 MB beyond what a worker has."""
    code = f"""
import resource, sys
sys.path.insert(0, {ROOT!r})
import numpy as np
from cohortis.operators import resample
path = [{{"level": i + 1, "n": 200_000 >> i, "left": 100_000 >> i, "right": bool(i % 2)}} for i in range(6)]
x = np.random.default_rng(0).normal(size=(3125, 6))
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
total = 0
for own, c in resample.counts("c", 21, [("s", 3125, path)], 2000, 1):
    total += (c @ x).sum() * 0 + c.sum()
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) / 1024, total / 2000)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-1500:]
    used, mean = map(float, done.stdout.split())
    assert used < 60 and abs(mean - 3125) < 10
