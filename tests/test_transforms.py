"""Transforms against matrices, resampling against a plain loop."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cohortis.operators import transforms as X


def plain_rigid(angles, shift, centre):
    (x, y, z), c = angles, np.array(centre)
    rx = np.array([[1, 0, 0], [0, np.cos(x), -np.sin(x)], [0, np.sin(x), np.cos(x)]])
    ry = np.array([[np.cos(y), 0, np.sin(y)], [0, 1, 0], [-np.sin(y), 0, np.cos(y)]])
    rz = np.array([[np.cos(z), -np.sin(z), 0], [np.sin(z), np.cos(z), 0], [0, 0, 1]])
    turn = rz @ rx @ ry
    return np.concatenate([turn, (c + np.array(shift) - turn @ c)[:, None]], axis=1)


def some(rng):
    return rng.uniform(-0.6, 0.6, 3), rng.uniform(-20, 20, 3), rng.uniform(-50, 50, 3)


def test_rigid_composed_inverse(spark):
    rng = np.random.default_rng(1)
    cases = [some(rng) for _ in range(20)]
    df = spark.createDataFrame([(i, [*map(float, np.concatenate(c))]) for i, c in enumerate(cases)], "id int, p array<double>")
    p = [F.get("p", F.lit(i)) for i in range(9)]
    df = df.withColumn("m", X.rigid(p[:3], p[3:6], p[6:]))
    df = df.withColumns({"back": X.inverse(F.col("m")), "twice": X.composed(F.col("m"), F.col("m"))}).withColumn("same", X.composed(F.col("back"), F.col("m")))
    full = lambda m: np.concatenate([np.reshape(m, (3, 4)), [[0, 0, 0, 1]]])
    for r in df.collect():
        want = full(plain_rigid(*cases[r.id]).ravel())
        assert np.allclose(full(r.m), want) and np.allclose(full(r.back), np.linalg.inv(want)) and np.allclose(full(r.twice), want @ want) and np.allclose(full(r.same), np.eye(4))
    flat = spark.createDataFrame([([0.0] * 12,), (None,)], "m array<double>")
    assert [r.i for r in flat.select(X.inverse(F.col("m")).alias("i")).collect()] == [None, None]


def test_comparison_over_points(spark):
    rng = np.random.default_rng(2)
    one, two = some(rng), some(rng)
    text = lambda c: "(TransformParameters {})\n(CenterOfRotationPoint {})\n".format(" ".join(map(repr, map(float, [*c[0], *c[1]]))), " ".join(map(repr, map(float, c[2]))))
    points = rng.uniform(-80, 80, (200, 3))
    pairs = spark.createDataFrame([("a", text(one), text(two)), ("b", text(one), text(one)), ("none", text(one), text(two))], "k string, x1 string, x2 string")
    pairs = pairs.select("k", X.rigid_of_parameters(F.col("x1")).alias("ours"), X.rigid_of_parameters(F.col("x2")).alias("theirs"))
    table = spark.createDataFrame([(k, *map(float, p)) for k in "ab" for p in points], "k string, x double, y double, z double")
    got = {r.k: r for r in X.compared(pairs, ["k"], "ours", "theirs", table).collect()}
    a, b = plain_rigid(*one), plain_rigid(*two)
    far = np.linalg.norm((points @ a[:, :3].T + a[:, 3]) - (points @ b[:, :3].T + b[:, 3]), axis=1)
    angle = np.degrees(np.arccos(np.clip((np.trace(a[:, :3] @ b[:, :3].T) - 1) / 2, -1, 1)))
    assert (got["a"].n, got["a"].disp_mean_mm, got["a"].disp_max_mm, got["a"].rot_diff_deg) == (200, pytest.approx(far.mean(), abs=6e-4), pytest.approx(far.max(), abs=6e-4), pytest.approx(angle, abs=6e-4))
    assert (got["b"].disp_max_mm, got["none"].n, got["none"].disp_mean_mm) == (0, 0, None) and got["b"].rot_diff_deg == pytest.approx(0, abs=2e-3)


def test_a_missing_parameter_raises(spark):
    df = spark.createDataFrame([("(TransformParameters 0 0 0 1 2 3)",)], "t string")
    with pytest.raises(PySparkException, match="CenterOfRotationPoint not found"):
        df.select(X.rigid_of_parameters(F.col("t"))).collect()
    assert spark.createDataFrame([(None,)], "t string").select(X.rigid_of_parameters(F.col("t")).alias("m")).first().m is None


def plain_resampled(data, places, to, nearest):
    out = np.zeros(to)
    n = np.array(data.shape)
    for at in np.ndindex(*to):
        p = places[:, :3] @ np.array(at) + places[:, 3]
        if nearest:
            q = np.floor(p + 0.5).astype(int)
            out[at] = data[tuple(q)] if (q >= 0).all() and (q < n).all() else 0
        elif (p >= -1e-9).all() and (p <= n - 1 + 1e-9).all():
            low = np.clip(np.floor(p + 1e-9).astype(int), 0, np.maximum(n - 2, 0))
            f = np.clip(p - low, 0, 1)
            for corner in np.ndindex(2, 2, 2):
                w = np.prod(np.where(corner, f, 1 - f))
                out[at] += w * data[tuple(np.minimum(low + corner, n - 1))]
    return out


@pytest.mark.parametrize("nearest", [False, True])
def test_resampling_against_a_plain_loop(spark, nearest):
    rng = np.random.default_rng(3)
    shape, to = (5, 4, 3), (4, 6, 5)
    data = rng.normal(size=shape)
    source = np.concatenate([np.diag([1.0, 1.5, 3.0]), [[-2.0], [1.0], [0.5]]], axis=1)
    target = np.concatenate([np.diag([1.2, 0.9, 1.6]), [[-1.9], [1.1], [0.6]]], axis=1)
    moved = plain_rigid((0.1, -0.05, 0.2), (0.1, 0.2, -0.1), (0.0, 2.0, 3.0))
    df = spark.createDataFrame([(data.ravel(order="F").tolist(), *(m.ravel().tolist() for m in (source, target, moved)))], "v array<double>, s array<double>, t array<double>, m array<double>")
    full = lambda m: np.concatenate([m, [[0, 0, 0, 1]]])
    for how, extra in ((None, np.eye(4)), (F.col("m"), full(moved))):
        places = X.index_map(F.col("s"), F.col("t"), how)
        got = df.select(X.resampled(F.col("v"), shape, places, to, nearest).alias("r")).first().r
        want = plain_resampled(data, (np.linalg.inv(full(source)) @ extra @ full(target))[:3], to, nearest)
        assert np.allclose(np.reshape(got, to, order="F"), want) and np.count_nonzero(want) > 10
    same = df.select(X.resampled(F.col("v"), shape, X.index_map(F.col("s"), F.col("s")), shape, nearest).alias("r")).first().r
    assert np.allclose(same, data.ravel(order="F"))
    assert df.select(X.fraction_volume(F.array(F.lit(0.5), F.lit(1.0)), 3.0).alias("ml")).first().ml == pytest.approx(0.0045)
    none = spark.createDataFrame([(None,)], "v array<double>").select(X.resampled(F.col("v"), shape, F.array(*[F.lit(0.0)] * 12), to).alias("r")).first()
    assert none.r is None


def test_mask_volume_is_rounded_from_its_exact_value(spark, data):
    from decimal import ROUND_HALF_UP, Decimal
    from fractions import Fraction

    from cohortis.plans import catalogue
    from cohortis.plans.base import table

    def axis(step, n, shift=Fraction(0)):
        """(voxel, its weight) of the one or two voxels about each place inside four voxels."""
        for p in (step * i + shift for i in range(n)):
            if p <= 3:
                low = min(p.numerator // p.denominator, 2)
                yield [(low, 1 - (p - low)), (low + 1, p - low)]

    want = {}
    for r in table(spark, data, "embeddings").collect():
        if r.embedding is None or len(r.embedding) != 64:
            continue
        places = [(x, y, z) for z in axis(Fraction(1, 2), 7) for y in axis(Fraction(3, 4), 5, Fraction(r.label, 10)) for x in axis(Fraction(3, 4), 5)]
        total = sum(a * b * c for x, y, z in places for i, a in x for j, b in y for k, c in z if r.embedding[i + 4 * j + 16 * k] > 0.1)
        ml = total * Fraction(27, 32) / 1000
        want[r.vec_id] = float((Decimal(ml.numerator) / Decimal(ml.denominator)).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    assert {r.vec_id: r.mask_ml for r in catalogue.queries()["resampled_volume"](spark, data).collect()} == want
