"""Scans over ranges: groups of any size, a hot one among them, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortis.operators import ml, scans
from cohortis.operators import tabular as R


@pytest.fixture(scope="module", autouse=True)
def small_ranges(spark):
    """Ranges stay as they are dealt: else adaptive execution makes one of so few rows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def hot(spark):
    """Half of all rows in one group, ties, nulls in both columns."""
    rng = np.random.default_rng(3)
    data = [(i, None if i % 97 == 0 else "hot" if i % 2 else f"g{i % 40}", None if i % 31 == 0 else float(rng.integers(0, 400)) if i % 3 else float(rng.normal())) for i in range(6000)]
    return data, spark.createDataFrame(data, "id long, g string, v double").repartition(9)


def in_groups(data):
    groups = {}
    for i, g, v in data:
        groups.setdefault(g, []).append((v is not None, v or 0.0, i, v))
    return {g: sorted(rows) for g, rows in groups.items()}


def test_a_hot_group_spans_ranges(hot):
    rows = scans.placed(hot[1], ["g"], ["v", "id"])
    per_range = rows.where("g = 'hot'").groupBy(F.shiftright(scans.AT, 33)).count().collect()
    assert len(per_range) > 1 and max(r["count"] for r in per_range) < 2900


def test_numbers_sums_and_maxima(hot):
    data, df = hot
    rows = scans.placed(df, ["g"], ["v", "id"])
    got = scans.running_max(scans.sums_before(scans.row_numbers(rows, ["g"], "n"), ["g"], "v", "before"), ["g"], "id", "top").collect()
    want = {}
    for members in in_groups(data).values():
        total, top = 0.0, 0
        for n, (_, _, i, v) in enumerate(members, 1):
            top = max(top, i)
            want[i] = (n, total, top)
            total += v or 0.0
    assert {r.id: r.n for r in got} == {i: w[0] for i, w in want.items()} and {r.id: r.top for r in got} == {i: w[2] for i, w in want.items()}
    assert {r.id: r.before for r in got} == pytest.approx({i: w[1] for i, w in want.items()})


def test_holm_of_a_hot_family(spark):
    rng = np.random.default_rng(4)
    data = [(i, "hot" if i % 3 else "small", None if i % 50 == 0 else float(rng.uniform() ** 8)) for i in range(3000)]
    got = {r.id: r.p_holm for r in R.holm(spark.createDataFrame(data, "id long, f string, p double").repartition(5), ["f"], "p", ["id"]).collect()}
    for f in ("hot", "small"):
        own = sorted((p, i) for i, g, p in data if g == f and p is not None)
        top = 0.0
        for k, (p, i) in enumerate(own):
            top = max(top, (len(own) - k) * p)
            assert got[i] == pytest.approx(min(1.0, top))
    assert all(got[i] is None for i, _, p in data if p is None)


def test_folds_and_turns(hot):
    data, df = hot
    some = df.where("g is not null")
    folds = ml.stratified_folds(some, "id", "g", 5).collect()
    per = {}
    for r in folds:
        per.setdefault(r.g, [0] * 5)[r.fold] += 1
    assert len(folds) == some.count() and all(max(n) - min(n) <= 1 for n in per.values())
    assert sorted(map(str, folds)) == sorted(map(str, ml.stratified_folds(some.coalesce(1), "id", "g", 5).collect()))
    turns = R.round_robin(some, "g", ["id"]).collect()
    by_group = {}
    for r in sorted(turns, key=lambda r: r.id):
        by_group.setdefault(r.g, []).append(r.turn)
    assert all(t == list(range(1, len(t) + 1)) for t in by_group.values())


def test_empty_tables(hot):
    none = hot[1].limit(0)
    assert R.holm(none, ["g"], "v", ["id"]).count() == R.mid_ranks(none, "v", ["g"]).count() == R.min_ranks(none, "v", True).count() == R.round_robin(none, "g", ["id"]).count() == 0


def test_the_forest_is_the_same_however_rows_lie(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 3))
    x[:5] += 9
    x[1000:2000] = x[1000]  # a third of all rows are copies
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    some = df.withColumns({"a": F.col("a") + 20, "b": F.col("b") + 20, "c": F.col("c") + 20})
    one, many = (ml.isolation_forest(d, "id", ["a", "b", "c"], trees=60).orderBy("id").toPandas() for d in (some.coalesce(1), some.repartition(23)))
    assert one.equals(many) and set(one.id[one.iforest_score.rank(ascending=False) <= 5]) == set(range(5))
    # Copies are drawn one by one: trees have some of them, not all or none.
    rows = some.select(F.lit(None).cast("long").alias("id"), F.array("a", "b", "c").alias("x"))
    drawn = ml._samples(rows, 60, 1, 0.1).groupBy("tree", "x").count().groupBy("tree").agg(F.sum("count").alias("n"), F.max("count").alias("copies")).collect()
    assert all(220 < r.n < 400 and 60 < r.copies < 150 for r in drawn)
