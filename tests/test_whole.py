"""Statistics and tests of models cover all rows, however few a fit is bounded to."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortis.functions import kernels as K
from cohortis.operators import ml


def sites(spark):
    rng = np.random.default_rng(8)
    data = [(i, "rare" if i == 77 or i == 78 else "abc"[i % 3], *(rng.normal(size=3) + i % 3).tolist()) for i in range(400)]
    return spark.createDataFrame(data, "id long, site string, f0 double, f1 double, f2 double").repartition(4)


def test_combat_of_parts_is_that_of_all_rows(spark):
    rng = np.random.default_rng(9)
    x, site, cov = rng.normal(size=(300, 4)) + 1e3, np.array(list("abc") * 100), rng.normal(size=(300, 1))
    x[:, 0] += 3 * cov[:, 0]
    whole = K.Combat(x, site, cov)
    made = K.Combat.from_sums(K.Combat.merged(K.Combat.sums(x[a : a + 70], site[a : a + 70], cov[a : a + 70]) for a in range(0, 300, 70)), 4)
    assert np.allclose(whole.apply(x, site, cov), made.apply(x, site, cov)) and abs(whole.beta[3, 0] - 3) < 0.5
    df = sites(spark)
    pdf = df.toPandas().sort_values("id")
    want = K.Combat(pdf[["f0", "f1", "f2"]].to_numpy(), pdf.site.to_numpy()).apply(pdf[["f0", "f1", "f2"]].to_numpy(), pdf.site.to_numpy())
    got = ml.combat(df, "id", ["f0", "f1", "f2"], "site").orderBy("id").toPandas()
    assert np.allclose(got[["f0", "f1", "f2"]], want) and "most" not in inspect.signature(ml.combat).parameters


def plainly_fitted(x, label, rounds=5000):
    """The same model by accelerated gradient steps over all rows at once."""
    names, y = np.unique(label, return_inverse=True)
    data, want = np.concatenate([np.ones((len(x), 1)), x], axis=1), np.eye(len(names))[y]
    keep = np.r_[0.0, np.ones(x.shape[1])][:, None]
    rate = 1 / (0.5 * np.linalg.norm(data, 2) ** 2 + 1)
    w = v = np.zeros((data.shape[1], len(names)))
    for i in range(rounds):
        s = data @ v
        p = np.exp(s - s.max(axis=1, keepdims=True))
        fresh = v - rate * (data.T @ (p / p.sum(axis=1, keepdims=True) - want) + keep * v)
        w, v = fresh, fresh + i / (i + 3) * (fresh - w)
    return names, w


@pytest.mark.parametrize("apart", [0.3, 1.0, 50.0])
def test_newton_steps_from_parts_reach_the_plain_fit(apart):
    rng = np.random.default_rng(4)
    label = rng.integers(0, 3, 240)
    x = rng.normal(size=(240, 4)) + apart * label[:, None]
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    data, fit, passes = np.concatenate([np.ones((240, 1)), x], axis=1), K.Softmax(4, 3), 0
    while not fit.done and passes < 40:
        fit.take(sum(K.softmax_sums(data[a : a + 70], label[a : a + 70], fit.at) for a in range(0, 240, 70)))
        passes += 1
    _, want = plainly_fitted(x, label, 20000)
    assert fit.done and np.allclose(fit.w[1:], want[1:], atol=1e-5) and np.allclose(fit.w[0] - fit.w[0].mean(), want[0] - want[0].mean(), atol=1e-5)


def test_every_row_is_learnt_from_and_tested_in_a_fold(spark):
    df = sites(spark)
    features = ["f0", "f1", "f2"]
    got = {(r.harmonised, r.fold): r for r in ml.site_classifier(df, "id", features, "site").collect()}
    assert sum(r.n_test for (w, _), r in got.items() if not w) == 400 and sum(r.n_test for (w, _), r in got.items() if w) in (399, 400) and len(got) == 10
    pdf = ml.stratified_folds(df, "id", "site").toPandas()
    for fold in range(5):
        train, test = pdf[pdf.fold != fold], pdf[pdf.fold == fold]
        for way in (False, True):
            x, t, truth = train[features].to_numpy(), test[features].to_numpy(), test.site.to_numpy()
            if way:
                model = K.Combat(x, train.site.to_numpy())
                known = np.isin(truth, model.sites)
                x, t, truth = model.apply(x, train.site.to_numpy()), model.apply(t[known], truth[known]), truth[known]
            mean, sd = x.mean(axis=0), x.std(axis=0)
            names, w = plainly_fitted((x - mean) / sd, train.site.to_numpy())
            guess = names[np.argmax(np.concatenate([np.ones((len(t), 1)), (t - mean) / sd], axis=1) @ w, axis=1)]
            assert abs(got[way, fold].balanced_accuracy - K.balanced_accuracy(truth, guess)) < 1e-6


def test_the_classifier_is_the_same_under_any_partitioning_and_takes_odd_tables(spark):
    df = sites(spark).withColumn("fold", F.lit("clash")).withColumn("model", F.lit(1))
    sorted_ = lambda d: sorted(map(tuple, ml.site_classifier(d, "id", ["f0", "f1", "f2"], "site").collect()))
    assert sorted_(df.coalesce(1)) == sorted_(df.repartition(40))
    none = df.where("id < 0")
    assert sorted_(none) == [] and sorted_(df.withColumn("f0", F.lit(None).cast("double"))) == []
    assert len(sorted_(df.where("id = 0"))) == 0 and {r[3] for r in sorted_(df.where("site = 'a'"))} == {1.0}


def test_the_forest_keeps_every_row(spark):
    df = spark.createDataFrame([(None, 1.0, "x"), (None, 2.0, "y"), (3, 3.0, "z"), (3, 90.0, "z"), (4, None, None)], "id long, a double, extra string")
    got = ml.isolation_forest(df, "id", ["a"], trees=20).collect()
    assert sorted(map(str, (r.extra for r in got))) == ["None", "x", "y", "z", "z"] and all(r.iforest_score is not None for r in got)


def test_outlier_share_is_of_all_rows(spark):
    df = spark.createDataFrame([(i, float(i % 97), float(i * 7 % 101)) for i in range(1000)], "id long, a double, b double")
    got = ml.isolation_forest(df, "id", ["a", "b"], trees=20, contamination=0.05).toPandas()
    assert (got.iforest_outlier == (got.iforest_score > np.quantile(got.iforest_score, 0.95))).all() and 0 < got.iforest_outlier.sum() <= 50
