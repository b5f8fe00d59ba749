"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding lower-cases, drops invisible characters, maps homoglyphs and full-width forms to Latin letters, and reads
digits and signs as letters inside words that hold a letter ("1d10t"). Entries are whole words, or stems that begin
words; hits inside an exception phrase don't count. Weights are log odds learnt from labelled documents, of which
copies count once. The score is a logistic function of the summed weights, as such and for each 100 words.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled documents that a model learns from, about (by a hash of their ids; all of them where there are fewer).
TRAIN_DOCUMENTS = 20_000
THRESHOLD = 0.7
#: An entry occurs in this share of the toxic documents at least; its log odds are at least those of its kind, and a
#: weight is WEIGHT at most.
LEAST_SHARE, WORD_ODDS, STEM_ODDS, WEIGHT = 0.01, 3.0, 1.5, 6.0
#: A stem begins at least so many different words of toxic documents.
STEM_LENGTHS, STEM_WORDS = (3, 4, 5, 6, 7), 4

# Characters that look like the Latin letter beside them.
HOMOGLYPHS = {
    "а": "a", "ɑ": "a", "α": "a", "в": "b", "с": "c", "ϲ": "c", "ԁ": "d", "е": "e", "ε": "e", "ё": "e",
    "ɡ": "g", "һ": "h", "і": "i", "ı": "i", "ι": "i", "ї": "i", "ј": "j", "к": "k", "κ": "k", "ӏ": "l",
    "м": "m", "п": "n", "ո": "n", "о": "o", "ο": "o", "σ": "o", "р": "p", "ρ": "p", "ԛ": "q", "г": "r",
    "ѕ": "s", "т": "t", "τ": "t", "υ": "u", "ս": "u", "ν": "v", "ѵ": "v", "ԝ": "w", "ω": "w", "х": "x",
    "χ": "x", "у": "y", "γ": "y", "ʏ": "y", "ᴢ": "z",
}
# Digits and signs that stand for letters inside words.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
# Phrases in which an insult is none.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "circus clown", "pathetic fallacy", "sympathetic", "stupid simple")

_GLYPHS = str.maketrans(HOMOGLYPHS)
_INVISIBLE = re.compile(r"[\u200b-\u200d\u2060\ufeff\u00ad]")
_WIDE = re.compile(r"[\uff01-\uff5e]")
_ODD = re.compile(f"[{''.join(HOMOGLYPHS)}]|{_INVISIBLE.pattern}|{_WIDE.pattern}")
_HAS_LEET = re.compile("[013457@$]")
_MIXED = re.compile(r"[^\W\d_]+[013457@$][\w@$]*|[013457@$]+[^\W\d_][\w@$]*")
_LEET = str.maketrans(LEET)
_GAP = re.compile(r"[ \n]")
_WORD = re.compile(r"[^\W\d_]+")


def folded(text: str) -> str:
    text = text.lower()
    if _ODD.search(text):
        text = _WIDE.sub(lambda m: chr(ord(m[0]) - 0xFEE0).lower(), _INVISIBLE.sub("", text)).translate(_GLYPHS)
    if _HAS_LEET.search(text):
        text = _MIXED.sub(lambda m: m[0].translate(_LEET), text)
    return text


@dataclass
class Model:
    """words and stems: folded entry -> weight; curve: the logistic's intercept and three slopes."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, ...] = (-6.0, 1.0, 1.0, 1.0)
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        import ahocorasick

        if self._automaton is None:
            found: dict[str, dict[str, float]] = {}
            for kind, entries in (("word", self.words), ("stem", self.stems), ("exception", dict.fromkeys(map(folded, self.exceptions), 0.0))):
                for entry, weight in entries.items():
                    found.setdefault(entry, {})[kind] = weight
            built = ahocorasick.Automaton()
            for entry, kinds in found.items():
                built.add_word(entry, (len(entry), kinds))
            if found:
                built.make_automaton()
            self._automaton = built
        return self._automaton

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(begin, end, weight) in the folded text, the heaviest for each begin, outside exception phrases."""
        built, best, spared = self.automaton(), {}, []
        if not len(built):
            return []
        for last, (size, kinds) in built.iter(text):
            begin, end = last - size + 1, last + 1
            if begin and text[begin - 1].isalnum():
                continue
            whole = end == len(text) or not text[end].isalnum()
            if whole and "exception" in kinds:
                spared.append((begin, end))
            weight = max(kinds.get("stem", 0.0), kinds.get("word", 0.0) if whole else 0.0)
            if weight and weight >= best.get(begin, (0, 0.0))[1]:
                best[begin] = (end, weight)
        # A hit is spared if a phrase that begins no later ends no earlier: the farthest end so far tells.
        spared.sort()
        begins, ends = [a for a, _ in spared], [*accumulate((b for _, b in spared), max)]
        return [(a, b, w) for a, (b, w) in best.items() if not (n := bisect_right(begins, a)) or ends[n - 1] < b]

    def _parts(self, text: str) -> Iterator[tuple[str, str, str]]:
        """A text cut at spaces and line ends: what a part may need of the words before it, the part, and of the words after it.
        Phrases are whole words with one space between, so as many words as the longest has are enough."""
        words = max((e.count(" ") for e in (*self.words, *self.stems, *self.exceptions)), default=0) + 2

        def back(at: int) -> int:
            for _ in range(words):
                at = max(text.rfind(" ", 0, at), text.rfind("\n", 0, at))
                if at < 0:
                    return 0
            return at

        def on(at: int) -> int:
            for _ in range(words):
                found = _GAP.search(text, at + 1)
                if not found:
                    return len(text)
                at = found.start()
            return at

        begin = 0
        while begin < len(text):
            gap = _GAP.search(text, begin + common.PIECE)
            end = gap.start() if gap else len(text)
            yield text[back(begin) : begin] if begin else "", text[begin:end], text[end : on(end)]
            begin = end

    def features(self, text: str | None) -> tuple[float, float, float]:
        """log1p of the summed weights, of the same for each 100 words, and of the hits; zeros for a null or empty text."""
        if not text:
            return 0.0, 0.0, 0.0
        total, n, gaps = 0.0, 0, 0
        for before, part, after in [("", text, "")] if len(text) <= common.PIECE else self._parts(text):
            before, part = folded(before), folded(part)
            own = [w for a, _, w in self.hits(f"{before}{part}{folded(after)}" if before or after else part) if 0 <= a - len(before) < len(part)]
            total, n, gaps = total + sum(own), n + len(own), gaps + part.count(" ") + part.count("\n")
        return (math.log1p(total), math.log1p(100 * total / (gaps + 1)), math.log1p(n)) if n else (0.0, 0.0, 0.0)

    def score(self, text: str | None) -> float:
        x = self.curve[0] + sum(c * f for c, f in zip(self.curve[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Coefficients by Newton's method; the intercept (column 0) isn't shrunk."""
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge * len(y))
    keep[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, most: int = TRAIN_DOCUMENTS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Learn a Model from docs (doc_id, text) and labels (doc_id, toxic).

    may_learn: a condition on doc_id. Labels that are null are left out; an id labelled twice is toxic if either says
    so. About `most` labels are used, chosen by a hash, and broadcast; only their documents leave the scan. Near copies (equal minimal shingle hash) count once. With no toxic document the lexicon is empty.
    """
    spark = docs.sparkSession
    common.ship(spark)
    told = labels.where("doc_id is not null and toxic is not null").where(F.lit(True) if may_learn is None else may_learn)
    told = common.about(told.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), "doc_id", most)

    # What an exception phrase says counts for neither side.
    spared = re.compile("|".join(rf"\b{re.escape(folded(e))}\b" for e in exceptions) or "(?!)")

    def shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            words = [_WORD.findall(spared.sub(" ", folded(x or ""))) for x in batch.column(0).to_pylist()]
            signs = [min((xxhash.xxh64_intdigest(" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))), default=0) >> 1 for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(signs, pa.int64()), batch.column(1), pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))], ["sign", "toxic", "words"])

    chosen = common.written(docs.select("doc_id", "text").join(F.broadcast(told), "doc_id").select("text", "toxic"), "toxic-train")
    once = common.written(chosen.mapInArrow(shaped, "sign long, toxic int, words array<string>").groupBy("sign", "toxic").agg(F.min("words").alias("words")), "toxic-words")
    n = {r.toxic: r["count"] for r in once.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    terms = [F.transform("words", lambda w: F.struct(F.lit(0).alias("stem"), w.alias("term"))), *map(_stems, STEM_LENGTHS)]
    counted = once.select("toxic", F.explode(F.concat(*terms)).alias("x")).groupBy("x.stem", "x.term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    least = max(3.0, LEAST_SHARE * n_toxic)
    strong = counted.where(F.col("t") >= 2).withColumn("odds", odds).where(F.col("odds") >= F.when(F.col("stem") == 1, STEM_ODDS).otherwise(WORD_ODDS))
    strong = common.written(strong, "toxic-terms")
    # How many strong words each stem begins. What reaches the driver stands in LEAST_SHARE of the toxic documents, so it
    # is no more than 1 / LEAST_SHARE times the terms of one of them, on average.
    longer = F.filter(F.array(*map(F.lit, STEM_LENGTHS)), lambda n: n < F.length("term"))
    begun = strong.where("stem = 0").select(F.explode(F.transform(longer, lambda n: F.substring("term", F.lit(1), n))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_words"))
    frequent = strong.where((F.col("t") >= least) & ((F.col("stem") == 0) | (F.col("t") >= 2 * least))).join(begun, "term", "left").where(f"stem = 0 or n_words >= {STEM_WORDS}").collect() if n_toxic else []
    words = {r.term: (r.t, min(r.odds, WEIGHT)) for r in frequent if not r.stem}
    stems: dict[str, float] = {}
    # Stems may begin one another, if the longer one weighs more: of all entries at a place, the heaviest counts.
    for r in sorted((r for r in frequent if r.stem), key=lambda r: (len(r.term), r.term)):
        weight = min(r.odds, WEIGHT)
        if not any(r.term.startswith(s) and w >= weight for s, w in stems.items()):
            stems[r.term] = weight
    model = Model({w: weight for w, (_, weight) in words.items()}, stems, exceptions)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([model.features(x) for x in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    if n_toxic and n_clean:
        seen = chosen.mapInArrow(measured, "x array<double>, toxic int").toPandas()  # a few numbers for each of `most` rows
        x = np.concatenate([np.ones((len(seen), 1)), np.stack(seen.x.to_numpy())], axis=1)
        model.curve = tuple(float(v) for v in _logistic(x, seen.toxic.to_numpy(dtype=float), ridge=1e-4))
    return model


def _stems(size: int) -> Column:
    return F.transform(F.array_distinct(F.transform(F.filter("words", lambda w: F.length(w) >= size), lambda w: F.substring(w, 1, size))), lambda w: F.struct(F.lit(1).alias("stem"), w.alias("term")))


def score_udf(spark, model: Model):
    """An Arrow function of a text: its score, 0 to 1. A null text scores as an empty one, which is the curve's least; repeated
    texts score alike; an empty table stays empty. A text is scored whole, whatever its length: a long one in parts of a million
    characters, in time that grows with its length."""
    common.ship(spark)
    told = spark.sparkContext.broadcast(model)  # its size is bounded in train()

    def scored(texts: pa.Array) -> pa.Array:
        out = pa.array([told.value.score(x) for x in texts.to_pylist()], pa.float64())
        common.tidy(thorough=False)
        return out

    return F.arrow_udf(scored, "double")
