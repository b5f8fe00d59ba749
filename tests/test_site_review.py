"""The review's work on texts and rows: counts by batch, several quantiles at once, and a plan that moves no row to flag it."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortis.functions import texts
from cohortis.operators import tabular as R
from cohortis.operators.quantiles import exact_quantiles
from jobs import measures, site_review

PATTERNS = {"space": r"[ \t-\r]", "digits": "[0-9]", "marks": r"[!-/:-@\[-`{-~]", "breaks": r"\n", "words": r"[^ \t-\r]+"}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [1, 3, 1 << 20])
def test_counts_are_those_of_regular_expressions(spark, monkeypatch, block):
    monkeypatch.setattr(texts, "BLOCK", block)
    rng = random.Random(5)
    some = ["", " ", "a", "a b", "\u00e9\u20ac\U0001f600 \u00a0\u2003x", "", "1,2\r\n\n3 \x0b\x1c\x85", ""] + ["".join(rng.choice("ab 1!\n\t~\u00e9\U0001f600") for _ in range(rng.randrange(40))) for _ in range(60)]
    table = np.zeros(256, np.uint8)
    for i, characters in enumerate(measures.CLASSES.values()):
        table[[*characters.encode()]] |= 1 << i
    want = [[len(re.findall(p, t)) for t in some] for p in PATTERNS.values()]
    for kind in (pa.string(), pa.large_string()):
        cut = pa.array(["x y"] + some, kind)[1:]  # an array that begins within its buffers
        assert texts.counted(*texts.utf8(cut), table, 4, 1).tolist() == want
    if block > 3:
        rows = spark.createDataFrame([(i, t) for i, t in enumerate([*some, None])], "i int, t string").select("i", measures.counted(F.col("t")).alias("c")).orderBy("i").select("c.*")
        assert rows.columns == [*PATTERNS] and [list(r) for r in rows.collect()] == [[*x] for x in zip(*want)] + [[0] * 5]


def test_several_quantiles_in_one_pass(spark):
    rng = np.random.default_rng(3)
    rows = [("ab"[i % 2], float(x), None if i % 3 else float(y)) for i, (x, y) in enumerate(zip(rng.normal(size=900), rng.integers(0, 5, 900)))] + [("c", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: (r.p, r.q) for r in exact_quantiles(df, ["g"], {"p": "x", "q": "y"}, 0.5, 20).collect()}
    assert got == {r.g: (r.x, r.y) for r in df.groupBy("g").agg(F.median("x").alias("x"), F.median("y").alias("y")).collect()}
    one = {(r.g, r.x): r.z for r in R.robust_z(df, ["g"], "x").collect()}
    met = df.join(R.robust_limits(df, ["g"], ["x", "y"]), "g").withColumn("z", F.coalesce(F.try_divide(F.col("x") - F.col("med_x"), 1.4826 * F.col("mad_x")), F.lit(0.0)))
    assert one == {(r.g, r.x): r.z for r in met.collect()} and {r.g: r.n for r in met.select("g", "n").distinct().collect()} == {"a": 450, "b": 450, "c": 1}


def test_texts_are_not_searched_and_flagged_rows_not_moved(spark, data, tmp_path):
    made = site_review.measured(spark.read.parquet(f"{data}/documents.parquet"), site_review.DEFAULTS["columns"])
    assert "regexp" not in plan(made)[0] and plan(made)[1].count("ArrowEvalPython") == 1 and "SortAggregate" not in plan(made)[1]
    made.write.parquet(f"{tmp_path}/measures")
    found = site_review.flags(spark.read.parquet(f"{tmp_path}/measures"), site_review.DEFAULTS)
    assert "BroadcastHashJoin" in plan(found)[1] and not re.search("SortMergeJoin|Exchange hash|Generate|Aggregate", plan(found)[1])


def test_rows_that_are_repeated_are_counted(spark):
    docs = spark.createDataFrame([(1, "a 1", "en", "s"), (1, "a 1", "en", "s"), (None, "", "en", "s"), (None, None, "en", "s"), (1, "a 1", "en", None)], "doc_id long, text string, lang string, source string")
    got = {(r.record, r.site): (r.rows, r.chars, r.word_length, r.digits) for r in site_review.measured(docs, site_review.DEFAULTS["columns"]).collect()}
    assert got == {(1, "s"): (2, 3.0, 1.0, 1 - 2 / 3), (None, "s"): (2, 0.0, None, None), (1, None): (1, 3.0, 1.0, 1 - 2 / 3)}
