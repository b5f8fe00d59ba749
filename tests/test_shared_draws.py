"""Cells with the same rows take the same draws, and what is costly is read once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortis.operators import stats
from cohortis.operators import tabular as R


def scans_of(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("FileScan parquet")


@pytest.fixture(scope="module")
def rows():
    """(id, scanner, seen, metric, value): twice is double once, and gaps lacks a few rows."""
    rng, out = np.random.default_rng(1), []
    for i, v in enumerate(rng.gamma(2.0, 1.0, 300)):
        s = "xyz"[i % 3]
        out += [(i, s, s != "z", m, None if m == "gaps" and i % 7 == 0 else float(v * k)) for m, k in (("once", 1), ("twice", 2), ("gaps", 1))]
    return out


def test_bootstrap_ci_draws_a_stratum_once(spark, rows):
    df = spark.createDataFrame(rows, "id long, s string, seen boolean, metric string, v double")
    groups = F.array(F.lit("all"), F.concat(F.lit("s="), "s"), F.concat(F.lit("seen="), F.col("seen").cast("string")))
    got = {(r.group, r.metric): r for r in stats.bootstrap_ci(df, ["group", "metric"], "v", "s", "id", 400, together=["metric"], groups=groups).collect()}
    assert len(got) == 6 * 3
    for g in ("all", "s=x", "s=z", "seen=true", "seen=false"):
        a, b, gaps = (got[g, m] for m in ("once", "twice", "gaps"))
        assert [b.mean, b.low, b.high] == pytest.approx([2 * a.mean, 2 * a.low, 2 * a.high], rel=1e-12)
        assert a.n_missing == 0 and gaps.n + gaps.n_missing == a.n and gaps.n_missing > 0
    # A group of one stratum is that stratum.
    assert [got["s=z", "once"].low, got["s=z", "once"].high] == pytest.approx([got["seen=false", "once"].low, got["seen=false", "once"].high], rel=1e-12)
    # The same intervals as of cells drawn apart, but for the noise of drawing.
    apart = {(r.group, r.metric): r for r in stats.bootstrap_ci(df.withColumn("group", F.explode(groups)), ["group", "metric"], "v", "s", "id", 400).collect()}
    assert {k: (r.n, r.n_missing) for k, r in got.items()} == {k: (r.n, r.n_missing) for k, r in apart.items()}
    assert all(abs((r.high - r.low) / (apart[k].high - apart[k].low) - 1) < 0.35 for k, r in got.items())


def test_labels_that_part_a_stratum_are_drawn_apart(spark, rows):
    df = spark.createDataFrame(rows, "id long, s string, seen boolean, metric string, v double")
    groups = F.array(F.lit("all"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    keys = ["group", "metric"]
    got = sorted(map(tuple, stats.bootstrap_ci(df, keys, "v", "s", "id", 200, together=["metric"], groups=groups).collect()))
    want = sorted(map(tuple, stats.bootstrap_ci(df.withColumn("group", F.explode(groups)), keys, "v", "s", "id", 200, together=["metric"]).collect()))
    assert len(got) == 9 and all(a[:4] == b[:4] and np.allclose(a[4:], b[4:], rtol=1e-12) for a, b in zip(got, want, strict=True))


def test_paired_metrics_share_draws(spark, rows):
    df = spark.createDataFrame(rows, "id long, s string, seen boolean, metric string, va double").withColumn("vb", F.col("va") * F.cos("id"))
    got = {r.metric: r for r in stats.paired_table(df.withColumns({"family": F.lit("f"), "a": F.lit("A"), "b": F.lit("B")}), "s", "id", 300).collect()}
    assert [got["twice"].low, got["twice"].high] == pytest.approx([2 * got["once"].low, 2 * got["once"].high], rel=1e-12)
    assert got["gaps"].n < got["once"].n and got["twice"].p == got["once"].p


@pytest.mark.parametrize("family", ["metric", "m"])
def test_unpaired_metrics_share_draws(spark, rows, family):
    df = spark.createDataFrame(rows, "id long, s string, seen boolean, metric string, value double").withColumn("m", F.lit("M"))
    got = {r.metric: r for r in stats.unpaired_table(df, ["m", "metric"], "seen", "s", "id", [family], 300, together=["metric"]).collect()}
    assert [got["twice"].low, got["twice"].high] == pytest.approx([2 * got["once"].low, 2 * got["once"].high], rel=1e-12)


def test_rank_tests_and_holm_read_their_rows_once(spark, rows, tmp_path):
    spark.createDataFrame(rows, "id long, s string, seen boolean, metric string, v double").write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    assert scans_of(stats.signed_rank_sums(df.withColumn("d", F.col("v") - 1), ["metric"], "d")) == 1
    assert scans_of(stats.rank_sums(df, ["metric"], "v", "seen")) == 1
    held = R.holm(df.groupBy("metric").agg(F.avg("v").alias("p")), [], "p", ["metric"])
    assert str(tmp_path) not in held._jdf.queryExecution().toString()


def test_agreement_run_makes_only_the_table_asked_for(spark, monkeypatch):
    df = spark.createDataFrame([(i, "x", "t", s, float(i + 1 + k)) for i in range(5) for k, s in enumerate(("ref", "m"))], "participant_id long, scanner string, split string, source string, b double")
    made = []
    monkeypatch.setattr(stats, "agreement", lambda *a, **k: made.append("agreement"))
    monkeypatch.setattr(stats, "biases", lambda *a, **k: made.append("biases"))
    monkeypatch.setattr(stats, "holm", lambda *a, **k: None)
    assert stats.agreement_run(df, {"b": "raw"}, "ref", tables=["by_scanner"]) == (None, None) and made == ["biases"]
