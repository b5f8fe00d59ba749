"""Models over feature tables: outlier forest, ComBat, and the cross-validated site classifier.

The forest learns from samples of all rows, a tree a task; ComBat from sums over all rows; the classifier from sums of gradients and
curvatures over all rows, one pass a Newton step. All are applied wherever the rows are.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..session import ship, written
from . import scans
from .quantiles import exact_quantile

#: Numbers of a long sum that travel together.
_CHUNK = 1 << 15


def _samples(rows: DataFrame, trees: int, seed: int, share: float) -> DataFrame:
    """(tree, hash, x): of each tree the rows of (id, x) whose hash is among the smallest `share` of all, one for each copy.

    Equal rows are counted first and numbered as copies, so a hash never has many rows and every copy its own chance. What is left
    is about that share of rows a tree, wherever they came from.
    """
    block = 1 << 16
    once = rows.groupBy("id", "x").agg(F.count(F.lit(1)).alias("copies"))
    blocks = once.select("id", "x", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / block))).alias("block"))
    upto = F.least(F.col("copies"), (F.col("block") + 1) * block) - 1
    each = blocks.select("x", F.explode(F.transform(F.sequence(F.col("block") * block, upto), lambda c: F.xxhash64("id", "x", c))).alias("copy"))
    least = F.lit(min((1 << 63) - 1, -(1 << 63) + int(min(1.0, share) * (1 << 64))))
    drawn = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(F.lit(seed), t, F.col("copy")).alias("hash"))), lambda s: s["hash"] <= least)
    return each.select("x", F.explode(drawn).alias("s")).select("s.tree", "s.hash", "x")


def fitted_forest(rows: DataFrame, trees: int = 500, sample: int = 256, seed: int = 42) -> K.IsolationForest | None:
    """A forest of rows (id, x array<double>), of all of which each tree has the `sample` with the smallest hashes of its own. The
    same forest however the rows are partitioned. None for fewer than two rows.

    A tree is grown in a task from its own sample; the driver gets the trees, which are no larger than samples.
    """
    n = rows.count()
    if n < 2:
        return None
    ship(rows.sparkSession)
    size = min(sample, n)
    # Ten standard deviations above the mean; if a tree still got too few, once more with twice the share.
    share = (size + 10 * size**0.5 + 20) / n

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["x"].to_numpy())
        first = np.lexsort((*x.T[::-1], pdf["hash"].to_numpy()))[:size]
        tree = K.IsolationForest.grown(x[first], np.random.default_rng([seed, int(key[0])]))
        return pd.DataFrame({"tree": [key[0]], "rows": [len(first)], "grown": [pickle.dumps(tree)]})

    while True:
        got = _samples(rows, trees, seed, share).groupBy("tree").applyInPandas(grow, "tree int, rows int, grown binary").collect()
        if len(got) == trees and all(r.rows == size for r in got):
            return K.IsolationForest([pickle.loads(bytes(r.grown)) for r in sorted(got, key=lambda r: r.tree)], size)
        share *= 2


def isolation_forest(df: DataFrame, key: str, features: Sequence[str], trees: int = 500, contamination: float = 0.05, seed: int = 42) -> DataFrame:
    """df with iforest_score (larger: more isolated) and iforest_outlier, the top `contamination` share of all rows.
    Missing features count as 0; fewer than two rows: nulls. Fitted on samples of all rows, scored wherever they are."""
    of = F.array(*[F.greatest(F.coalesce(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features])
    forest = fitted_forest(df.select(F.col(key).alias("id"), of.alias("x")), trees, seed=seed)
    if forest is None:
        return df.withColumns({"iforest_score": F.lit(None).cast("double"), "iforest_outlier": F.lit(None).cast("boolean")})
    told = df.sparkSession.sparkContext.broadcast(forest)

    def scored(rows: pd.Series) -> pd.Series:
        return pd.Series(told.value.score(np.stack(rows.to_numpy())) if len(rows) else [], dtype=float)

    # A column function, so that rows keep all they have, whatever their keys are.
    scores = df.withColumn("iforest_score", F.pandas_udf(scored, "double")(of))
    cut = exact_quantile(scores, [], "iforest_score", 1 - contamination).first()["quantile"]
    return scores.withColumn("iforest_outlier", F.col("iforest_score") > cut)


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """fold 0 to k - 1, balanced in every class: rows of a class dealt round by the order of a seeded hash."""
    at = scans.numbered(df, [label], [F.xxhash64(F.lit(seed), F.col(key)), key], "_at")
    return at.withColumn("fold", ((F.col("_at") - 1) % k).cast("int")).drop("_at")


def _combat_sums(df: DataFrame, features: Sequence[str], site: str, covariates: Sequence[str], part: str | None = None) -> dict:
    """part (0 without one) -> the sums of all its rows that ComBat is learnt from. Only sums reach the driver."""

    def summed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in parts:
            for p, own in pdf.groupby(part) if part else [(0, pdf)]:
                if len(own):
                    held[p] = K.Combat.merged([held.get(p, {}), K.Combat.sums(own[[*features]].to_numpy(), own[site].to_numpy(), own[[*covariates]].to_numpy() if covariates else None)])
        yield pd.DataFrame({"part": [int(p) for p in held], "sums": [pickle.dumps(x) for x in held.values()]})

    found: dict = {}
    for r in df.mapInPandas(summed, "part int, sums binary").toLocalIterator():
        found[r.part] = K.Combat.merged([found.get(r.part, {}), pickle.loads(bytes(r.sums))])
    return found


def combat(df: DataFrame, key: str, features: Sequence[str], site: str, covariates: Sequence[str] = ()) -> DataFrame:
    """key, site and the features harmonised across sites; learnt from sums over all rows without nulls, and applied to them."""
    need = [*features, *covariates]
    some = df.select(key, site, *[F.col(c).cast("double").alias(c) for c in need]).dropna()
    model = K.Combat.from_sums(_combat_sums(some, features, site, covariates).get(0, {}), len(features)) if some.limit(1).count() else None
    told = some.sparkSession.sparkContext.broadcast(model)

    def applied(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                pdf[[*features]] = told.value.apply(pdf[[*features]].to_numpy(), pdf[site].to_numpy(), pdf[[*covariates]].to_numpy() if covariates else None)
                yield pdf[[key, site, *features]]

    kinds = dict(some.dtypes)
    return some.mapInPandas(applied, ", ".join(f"{c} {kinds[c]}" for c in (key, site, *features)))


def _added(parts: DataFrame) -> dict[int, np.ndarray]:
    """model -> the elementwise sum of its vectors, of which every task gives one in chunks (model, chunk, v). Added up by chunk in
    tasks, a batch at a time; the driver gets one vector a model, however many tasks there were."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, chunk, total = 0, 0, 0.0
        for pdf in batches:
            if len(pdf):
                model, chunk, total = int(pdf.model.iloc[0]), int(pdf.chunk.iloc[0]), total + sum(np.frombuffer(v) for v in pdf.v)
        yield pd.DataFrame({"model": [model], "chunk": [chunk], "v": [total.tobytes()]})

    found: dict[int, dict[int, list]] = {}
    for r in parts.groupBy("model", "chunk").applyInPandas(add, "model int, chunk int, v binary").toLocalIterator():
        found.setdefault(r.model, {})[r.chunk] = np.frombuffer(bytes(r.v))
    return {m: np.concatenate([own[i] for i in sorted(own)]) for m, own in found.items()}


def _vectors(rows: DataFrame, of) -> DataFrame:
    """(model, chunk, v) for _added: of(rows) gives pairs of a model and a vector, which are added up in each task first."""

    def summed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in parts:
            for model, v in of(pdf):
                held[model] = held[model] + v if model in held else v
        for model, v in held.items():
            cut = range(0, len(v), _CHUNK)
            yield pd.DataFrame({"model": model, "chunk": range(len(cut)), "v": [v[i : i + _CHUNK].tobytes() for i in cut]})

    return rows.mapInPandas(summed, "model int, chunk int, v binary")


def site_classifier(df: DataFrame, key: str, features: Sequence[str], site: str, covariates: Sequence[str] = (), k: int = 5, seed: int = 42, harmonise: bool = True, rounds: int = 100) -> DataFrame:
    """harmonised, fold, n_test, balanced_accuracy: how well a linear classifier tells sites apart, raw and after ComBat.

    Every row without nulls is dealt to a fold and tested in it. ComBat, scaler and classifier learn from all rows of the other
    folds: the classifiers of all folds and ways take a Newton step in one pass over the rows, from sums that tasks add up. What
    tasks hold grows with the square of sites times features, not with rows. Without rows to learn from a fold has no result;
    a site that only the tested fold has counts as missed (after ComBat, which can't place it, it is left out).
    RuntimeError where a fit needs more than `rounds` passes.
    """
    need = [*features, *covariates]
    ship(df.sparkSession)
    kept = df.select(key, F.col(site).alias("_site"), *[F.col(c).cast("double").alias(c) for c in need]).dropna()
    folds = written(stratified_folds(kept, key, "_site", k, seed).select("fold", "_site", *need), "folds")
    seen = folds.groupBy("fold", "_site").agg(F.count(F.lit(1)).alias("n")).collect()
    ways = [False, True] if harmonise else [False]
    combats: dict = {}
    if harmonise:
        sums = _combat_sums(folds, features, "_site", covariates, "fold")
        training = {i: K.Combat.merged(x for f, x in sums.items() if f != i) for i in range(k)}
        combats = {i: K.Combat.from_sums(x, len(features)) for i, x in training.items() if x}
    names = {i: np.array(sorted({r["_site"] for r in seen if r["fold"] != i})) for i in range(k)}
    keys = [(w, i) for w in ways for i in range(k) if len(names[i])]
    sc = df.sparkSession.sparkContext
    told = sc.broadcast(combats)

    def shaped(pdf: pd.DataFrame, way: bool, fold: int) -> tuple[np.ndarray, np.ndarray]:
        """Features and sites; after ComBat, of the sites that the training folds have."""
        x, y = pdf[[*features]].to_numpy(dtype=float), pdf["_site"].to_numpy()
        if not way:
            return x, y
        known = np.isin(y, told.value[fold].sites)
        cov = pdf[[*covariates]].to_numpy(dtype=float)[known] if covariates else None
        return told.value[fold].apply(x[known], y[known], cov), y[known]

    middle = np.array([v or 0.0 for v in folds.agg(*[F.avg(f) for f in features]).first()], dtype=float)

    def spread(pdf: pd.DataFrame):
        for m, (way, test) in enumerate(keys):
            own = pdf[pdf.fold != test]
            if len(own):
                x = shaped(own, way, test)[0] - middle
                yield m, np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    d = len(features)
    scales = {}
    for m, v in _added(_vectors(folds, spread)).items():
        mean = v[1 : 1 + d] / v[0]
        scales[m] = (mean + middle, np.sqrt(np.maximum(v[1 + d :] / v[0] - mean**2, 0)) + 1e-12)
    fits = {m: K.Softmax(d, len(names[keys[m][1]])) for m in scales}
    for _ in range(rounds):
        now = sc.broadcast({m: fit.at for m, fit in fits.items() if not fit.done})

        def sloped(pdf: pd.DataFrame, now=now):
            for m, w in now.value.items():
                way, test = keys[m]
                own = pdf[pdf.fold != test]
                if len(own):
                    x, y = shaped(own, way, test)
                    yield m, K.softmax_sums(np.concatenate([np.ones((len(x), 1)), (x - scales[m][0]) / scales[m][1]], axis=1), np.searchsorted(names[test], y), w)

        if not now.value:
            break
        for m, v in _added(_vectors(folds, sloped)).items():
            fits[m].take(v)
    else:
        if not all(fit.done for fit in fits.values()):
            raise RuntimeError(f"no fit in {rounds} passes")
    learnt = sc.broadcast({keys[m]: (*scales[m], names[keys[m][1]], fit.w) for m, fit in fits.items()})

    def tested(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for fold, own in pdf.groupby("fold"):
                for way in ways:
                    if (way, fold) not in learnt.value:
                        continue
                    mean, sd, known, w = learnt.value[way, fold]
                    x, y = shaped(own, way, fold)
                    guess = known[np.argmax(np.concatenate([np.ones((len(x), 1)), (x - mean) / sd], axis=1) @ w, axis=1)]
                    got = pd.DataFrame({"site": y, "n": 1, "hits": (guess == y).astype(int)}).groupby("site", as_index=False).sum()
                    yield got.assign(harmonised=way, fold=int(fold))[["harmonised", "fold", "site", "n", "hits"]]

    by_site = folds.mapInPandas(tested, f"harmonised boolean, fold int, site {dict(folds.dtypes)['_site']}, n long, hits long").groupBy("harmonised", "fold", "site").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    return by_site.groupBy("harmonised", "fold").agg(F.sum("n").alias("n_test"), F.avg(F.col("hits") / F.col("n")).alias("balanced_accuracy"))
