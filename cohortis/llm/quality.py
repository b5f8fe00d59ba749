"""Quality by hierarchical empirical Bayes: a document's own evidence, and what its host and path are like.

A logistic classifier of form features (case, signs, repetition, line shape) gives each document a log likelihood
ratio. Grouped sums of the documents' probabilities by (host, path) give, level by level, Beta posteriors whose prior
strengths are estimated from the spread between groups: a host is shrunk toward the global mean, a path toward its host,
the more the fewer documents it has. The posterior of a document is its own evidence times the odds of its path.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .toxicity import _logistic

#: Labelled documents that the classifier learns from, about (by a hash of their ids; all of them where there are fewer).
TRAIN_DOCUMENTS = 20_000
ACCEPT = 0.5
#: Log odds are kept within this of 0, and prior strengths within these bounds.
MOST_ODDS, STRENGTHS = 12.0, (1.0, 1000.0)

FEATURES = ("log_words", "upper", "digits", "signs", "marks", "doubled", "distinct", "word_length", "line_repeats")
_KIND = np.zeros(256, dtype=np.uint8)  # 0 others, 1 lower-case and non-ASCII, 2 upper-case, 3 digits, 4 white space, 5 usual marks
_KIND[[*range(97, 123), *range(128, 256)]] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[32, 9, 10, 11, 12, 13]] = 4
_KIND[[ord(c) for c in ".,;:'\"-()?"]] = 5


def features(text: bytes) -> list[float]:
    """FEATURES of a text in UTF-8; all 0 for one without words."""
    if len(text) > common.PIECE:
        return _features_of_long(text)
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_KIND[np.frombuffer(text, dtype=np.uint8)], minlength=6)
    upper = kinds[2]
    if not text.isascii():
        # Two-byte capitals (U+00C0 to U+00DE) are C3 80 to C3 9E.
        raw = np.frombuffer(text, dtype=np.uint8)
        upper = upper + int(((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)).sum())
    lines = text.split(b"\n")
    letters = max(1, int(kinds[1] + kinds[2]))
    seen = int(len(text) - kinds[4]) or 1
    return [
        float(np.log1p(n)),
        float(upper / letters),
        float(kinds[3] / seen),
        float(kinds[0] / seen),
        float(kinds[5] / seen),
        sum(map(bytes.__eq__, words, words[1:])) / n,
        len(set(words)) / n**0.8,
        seen / n,
        1 - len(set(lines)) / len(lines),
    ]


def _different(found: list[np.ndarray]) -> int:
    codes = np.concatenate(found)
    codes.sort()
    return int((codes[1:] != codes[:-1]).sum()) + 1


def _features_of_long(text: bytes, most: int = common.PIECE) -> list[float]:
    """features() of a long text, piece by piece: words and lines are told apart by 64-bit hashes."""
    import xxhash

    digest, gaps = xxhash.xxh64_intdigest, np.ones(256, dtype=np.uint8)
    gaps[[9, 10, 11, 12, 13, 32]] = 0
    n = doubled = upper = 0
    kinds, words_seen, lines_seen, n_lines = np.zeros(6, dtype=np.int64), [], [], 0
    for begin, end, shared in common.pieces(text, gaps, 1, most):
        words = text[begin:end].split()
        n += len(words) - shared
        doubled += sum(map(bytes.__eq__, words, words[1:]))  # the shared word meets the next here, and was met before there
        words_seen.append(np.unique(np.fromiter((digest(w) for w in words), dtype=np.uint64, count=len(words))))
    if not n:
        return [0.0] * len(FEATURES)
    start, raw = 0, np.frombuffer(text, dtype=np.uint8)
    for begin in range(0, len(text), most):
        part = raw[begin : begin + most + 1]
        kinds += np.bincount(_KIND[part[:most]], minlength=6)
        upper += int(((part[:-1] == 0xC3) & (part[1:] >= 0x80) & (part[1:] <= 0x9E)).sum())
        own = []
        for at in (np.flatnonzero(part[:most] == 10) + begin).tolist():
            own.append(digest(text[start:at]))
            start = at + 1
        n_lines += len(own)
        lines_seen.append(np.unique(np.array(own, dtype=np.uint64)))
    lines_seen.append(np.array([digest(text[start:])], dtype=np.uint64))
    n_lines, letters, seen = n_lines + 1, max(1, int(kinds[1] + kinds[2])), int(len(text) - kinds[4]) or 1
    return [
        float(np.log1p(n)), float((kinds[2] + upper) / letters), float(kinds[3] / seen), float(kinds[0] / seen), float(kinds[5] / seen), doubled / n,
        _different(words_seen) / n**0.8, seen / n, 1 - _different(lines_seen) / n_lines,
    ]


@dataclass
class Classifier:
    """Standardisation, coefficients (intercept first), and the training data's log odds, which evidence leaves out."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    base: float
    #: The global prior's log odds.
    prior: float

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log likelihood ratios; 0, no evidence, for a text without words."""
        z = np.concatenate([np.ones((len(x), 1)), (x - self.mean) / self.scale], axis=1)
        out = np.clip(z @ self.weights - self.base, -MOST_ODDS, MOST_ODDS)
        return np.where((x != 0).any(axis=1), out, 0.0)


def expanded(x: np.ndarray) -> np.ndarray:
    """Features with squares, so that either end of a feature can tell."""
    return np.concatenate([x, x * x], axis=1)


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCUMENTS) -> Classifier:
    """Fit the classifier on docs (doc_id, text) and labels (doc_id, quality), about `most` of them.

    Null labels are left out; an id labelled twice is good only if all its labels say so. With labels of one kind or none
    there is no evidence: every ratio is 0.
    """
    common.ship(docs.sparkSession)
    told = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    told = common.about(told, "doc_id", most)

    def measured(texts: pa.Array) -> pa.Array:
        return pa.array([features(t) for t in common.text_bytes(texts)], pa.list_(pa.float64()))

    chosen = docs.select("doc_id", "text").join(F.broadcast(told), "doc_id").select(F.arrow_udf(measured, "array<double>")(F.col("text")).alias("x"), "quality")
    got = chosen.toPandas()  # a few numbers for each of `most` rows
    n = 2 * len(FEATURES)
    y = got.quality.to_numpy(dtype=float) if len(got) else np.zeros(0)
    if len(set(y.tolist())) < 2:
        odds = float(np.clip(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)), -4, 4))
        return Classifier(np.zeros(n), np.ones(n), np.zeros(n + 1), 0.0, odds)
    x = expanded(np.stack(got.x.to_numpy()))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    weights = _logistic(np.concatenate([np.ones((len(x), 1)), (x - mean) / scale], axis=1), y, ridge=1e-4)
    odds = float(np.log(y.mean() / (1 - y.mean())))
    return Classifier(mean, scale, weights, odds, odds)


def evidence_udf(spark, model: Classifier):
    """An Arrow function of a text: its log likelihood ratio. A null text counts as empty: 0."""
    common.ship(spark)

    def of(texts: pa.Array) -> pa.Array:
        raw = common.text_bytes(texts)
        out = pa.array(model.evidence(expanded(np.array([features(t) for t in raw]))) if raw else [], pa.float64())
        del raw
        common.tidy(thorough=False)
        return out

    return F.arrow_udf(of, "double")


def site_priors(scored: DataFrame, prior: float) -> DataFrame:
    """host, path, n, host_mean, path_mean from rows of (host, path, evidence): Beta posteriors by grouped sums.

    One aggregation by (host, path), summed before it is shuffled, so a host with a third of all rows costs no more than
    any other; everything after works on one row a site. Null hosts or paths are groups of their own ('').
    """
    spark = scored.sparkSession
    p = 1 / (1 + F.exp(-(F.col("evidence") + F.lit(prior))))
    paths = common.written(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("s")), "site-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_s").alias("s")).first()
    if not total.n:
        return spark.createDataFrame([], "host string, path string, n long, host_mean double, path_mean double")
    mean = min(max(total.s / total.n, 1e-4), 1 - 1e-4)

    def strength(groups: DataFrame, n: str, s: str, about) -> float:
        """Of a Beta prior about `about`, by moments: v / (between-group variance) - 1 for v = about * (1 - about)."""
        rate, v = F.col(s) / F.col(n), about * (1 - about)
        r = groups.agg(F.sum(F.col(n) * (rate - about) ** 2).alias("q"), F.sum(v).alias("w"), F.sum(F.col(n) * v).alias("nv"), F.sum(n).alias("n"), F.count(F.lit(1)).alias("k")).first()
        between = ((r.q or 0.0) - (r.w or 0.0)) / max(r.n, 1)
        typical = (r.nv or 0.0) / max(r.n, 1)
        return float(min(max(typical / between - 1, STRENGTHS[0]), STRENGTHS[1])) if between > 1e-12 else STRENGTHS[1]

    k_host = strength(hosts, "host_n", "host_s", F.lit(mean))
    hosts = hosts.select("host", ((F.col("host_s") + k_host * mean) / (F.col("host_n") + k_host)).alias("host_mean"))
    met = common.written(paths.join(hosts, "host"), "site-hosts")
    k_path = strength(met, "n", "s", F.col("host_mean"))
    return met.select("host", "path", "n", "host_mean", ((F.col("s") + k_path * F.col("host_mean")) / (F.col("n") + k_path)).alias("path_mean"))


def posterior(rows: DataFrame, priors: DataFrame) -> DataFrame:
    """rows (host, path, evidence) with host_mean, path_mean, posterior. Priors are broadcast up to common.BROADCAST_ROWS sites,
    else joined by shuffle (a hot site is a skewed join, which adaptive execution splits)."""
    sites = priors.select("host", "path", "host_mean", "path_mean")
    if priors.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS:
        sites = F.broadcast(sites)
    odds = F.log(F.col("path_mean") / (1 - F.col("path_mean"))) + F.col("evidence")
    return rows.join(sites, ["host", "path"]).withColumn("posterior", 1 / (1 + F.exp(-odds)))


def judged(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", model: Classifier | None = None, accept: float = ACCEPT) -> DataFrame:
    """doc_id, host, path, evidence, host_mean, path_mean, posterior, accepted of every row.

    Documents without a url have their source for a host and their language for a path. A null or empty text has no
    evidence and stands as its site does; null hosts and paths count as ''; repeated rows are each judged; an empty
    table gives an empty result. Texts are read twice at most: labelled ones to learn, all of them for evidence, which
    is written; only numbers are shuffled.
    """
    spark = docs.sparkSession
    model = model or train(docs, labels)
    named = docs.select("doc_id", F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), evidence_udf(spark, model)(F.col("text")).alias("evidence"))
    scored = common.written(named, "evidence")
    out = posterior(scored, site_priors(scored, model.prior))
    return out.select("doc_id", "host", "path", "evidence", "host_mean", "path_mean", "posterior", (F.col("posterior") >= accept).alias("accepted"))


def accepted(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", model: Classifier | None = None, accept: float = ACCEPT) -> DataFrame:
    """docs without the rows that judged() rejects; columns stay, and texts are not shuffled while sites can be broadcast.

    Rows are written once with their evidence, so that texts are measured once: priors read the numbers alone. Nulls,
    repeated rows and empty tables as in judged().
    """
    spark = docs.sparkSession
    model = model or train(docs, labels)
    # Names that no document column has.
    host, path, evidence, mean = (f"__cohortis_{c}" for c in ("host", "path", "evidence", "mean"))
    own = {host: F.coalesce(F.col(host_col).cast("string"), F.lit("")), path: F.coalesce(F.col(path_col).cast("string"), F.lit("")), evidence: evidence_udf(spark, model)(F.col("text"))}
    rows = common.written(docs.withColumns(own), "measured")
    priors = site_priors(rows.select(F.col(host).alias("host"), F.col(path).alias("path"), F.col(evidence).alias("evidence")), model.prior)
    priors = priors.select(F.col("host").alias(host), F.col("path").alias(path), F.col("path_mean").alias(mean))
    if priors.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS:
        priors = F.broadcast(priors)
    odds = F.log(F.col(mean) / (1 - F.col(mean))) + F.col(evidence)
    return rows.join(priors, [host, path]).where(1 / (1 + F.exp(-odds)) >= accept).select(*docs.columns)
