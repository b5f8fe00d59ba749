"""Mixtures and fill-in-the-middle against plain versions, and on odd rows."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortis.llm import infill, mixture, queries

CLASH = ["size", "h", "step", "seed", "rate", "target", "copies", "copy_no", "weight", "_key", "part", "n", "form", "output", "h1"]
LONG = "word, and näïve <P words\n" * 120_000


def plain_targets(sizes: dict, weights: dict, times: int = 3) -> dict:
    """Shares by weight; those above their limit are set to it and the rest shared again."""
    total, full = Fraction(sum(sizes.values())), {}
    while True:
        free = sum(weights[s] for s in sizes if s not in full)
        rest = total - sum(full.values())
        share = {s: rest * weights[s] / free for s in sizes if s not in full}
        above = [s for s, x in share.items() if x > times * sizes[s]]
        if not above:
            return {**full, **share}
        full |= {s: Fraction(times * sizes[s]) for s in above}


def by_order(sources, weights=(5, 2, 1)):
    ordered = sorted(sources, key=lambda s: (s is None, (s or "").encode()))
    return {s: weights[i % len(weights)] for i, s in enumerate(ordered)}


def test_op11(spark, data):
    docs = queries.table(spark, data, "documents").select("doc_id", "text", "source").collect()
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    sizes = Counter()
    for r in docs:
        sizes[r.source] += words[r.doc_id]
    want = plain_targets(sizes, by_order(sizes))
    got = queries.op11_mixture(spark, data).collect()
    assert sorted(r.doc_id for r in got) == sorted(words)
    taken = Counter()
    for r in got:
        assert r.size == words[r.doc_id] and r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]), rel=1e-12)
        rate = r.target / r.source_size if r.source_size else 0.0
        assert r.copies - np.floor(rate) in (0, 1) and r.taken == r.copies * r.size <= 3 * r.size and (r.copies == np.floor(rate) or rate % 1)
        taken[r.source] += r.taken
    assert sum(float(x) for x in want.values()) == pytest.approx(sum(sizes.values()))
    for s in sizes:  # within the longest document at any size, and much nearer where there are many
        assert abs(taken[s] - float(want[s])) <= max(w for r in docs if r.source == s for w in [words[r.doc_id]])
    again = queries.op11_mixture(spark, data).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 1000}, {"é": 1, "z": 100, "Z": 100, None: 7, "": 3, "😀": 50, "￮": 9}, {"a": 5}, {"a": 0, "b": 0}, {"a": 0, "b": 4, "c": 8}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r for r in mixture.shared_out(mixture.cycled(rows, (5, 2, 1))).collect()}
    weights = by_order(sizes)
    want = plain_targets(sizes, weights)
    assert {s: r.weight for s, r in got.items()} == weights
    assert {s: r.target for s, r in got.items()} == pytest.approx({s: float(x) for s, x in want.items()})


def odd_rows(spark):
    rows = [(1, "one two  three", "a"), (2, None, "a"), (3, "", "a"), (None, "no id", "b"), (None, "no id", "b"), (None, None, None), (4, " \t\n", None), (5, "x", ""), (5, "x", ""), (6, LONG, "hot"), *((100 + i, "hot words here", "hot") for i in range(500))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7).withColumns({c: F.lit("extra") for c in CLASH})


def test_mixture_of_odd_rows(spark):
    docs = odd_rows(spark)
    got = mixture.copies(docs).collect()
    assert len(got) == docs.count() and {r.size for r in got if r.doc_id == 6} == {600_000} and sum(r.size == 0 for r in got) == 4
    by_source = defaultdict(list)
    for r in got:
        by_source[r.source].append(r)
    assert all(r.target == 0 and r.copies == 0 for r in by_source[None])
    assert len({r.copies for r in got if r.doc_id is None and r.source == "b"}) == len({r.copies for r in got if r.doc_id == 5}) == 1
    mix = mixture.emitted(docs)
    assert mix.columns == [*docs.columns, "copy"]
    n = Counter((r.doc_id, r.source) for r in mix.select("doc_id", "source").collect())
    assert n == Counter({k: sum(r.copies for r in got if (r.doc_id, r.source) == k) for k in {(r.doc_id, r.source) for r in got if r.copies}})
    assert sorted(map(str, mixture.copies(docs.coalesce(1)).collect())) == sorted(map(str, got))
    empty = docs.limit(0)
    assert mixture.copies(empty).count() == 0 and mixture.emitted(empty).count() == 0


def test_mixture_of_given_weights(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 9 + 1), "abc"[i % 3]) for i in range(600)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("a", 3), ("b", 1), ("b", 1), ("elsewhere", 9)], "source string, weight long")
    got = mixture.copies(docs, weights).groupBy("source").agg(F.sum("size").alias("n"), F.first("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("taken"))
    rows = {r.source: r for r in got.collect()}
    total = sum(r.n for r in rows.values())
    assert rows["c"].target == rows["c"].taken == 0 and rows["a"].target == pytest.approx(0.75 * total) and abs(rows["a"].taken - rows["a"].target) <= 9


def plain_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_automaton_against_byte_by_byte_and_expressions():
    rng = np.random.default_rng(12)
    parts = ["<", ">", "P", "S", "M", "a", "Z", "é", "漢", "🙂", " ", "\n", "\0", "1", "<P>", "<M", "S>", "word"]
    for _ in range(2000):
        text = "".join(rng.choice(parts, rng.integers(0, 40)))
        raw, state, emitted = text.encode(), 0, []
        for b in raw:
            k = infill.CLASSES[b]
            emitted.append(int(infill.EMITS[state, k]))
            state = int(infill.NEXT[state, k])
        got, last = infill.transitions(raw, 0)
        assert got.tolist() == emitted and last == (state if raw else 0)
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        for block in (1, 2, 3, 7, 1 << 20):
            blocks, marked = infill.counted(raw, block)
            assert sum(n for _, n in blocks) == len(units) and marked == any(t in text for t in ("<P>", "<S>", "<M>"))
            for cut in {0, len(units), int(rng.integers(0, len(units) + 1))}:
                assert infill.located(raw, blocks, cut, block) == len("".join(units[:cut]).encode())
    assert infill.REACH == 2


def test_infill_of_odd_rows(spark):
    docs = odd_rows(spark).union(odd_rows(spark).limit(0))
    odd = spark.createDataFrame([(7, "a<P>b"), (8, "<<S>"), (9, "<P"), (10, "<"), (11, "ends with <"), (12, "\U0001f642‍漢"), (13, "<S<M")] + [(i, f"<P {i} é<S< x") for i in range(20, 60)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(odd)
    made = infill.infilled(rows.withColumns({c: F.lit("extra") for c in CLASH}))
    back = made.withColumn("text", infill.restored(F.col("output"), F.col("form"))).collect()
    want = Counter((r.doc_id, *plain_infill(r.doc_id, r.text), r.text or "") for r in rows.collect())
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.text) for r in back) == want
    assert {r.form for r in back} == {"plain", "psm", "spm"} and infill.infilled(rows.limit(0)).count() == 0


def test_op12(spark, data):
    texts = {r.doc_id: r.text for r in queries.table(spark, data, "documents").select("doc_id", "text").collect()}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for doc, text in sorted(texts.items()):
        *head, output = plain_infill(doc, text)
        want.append((doc, *head, digest(output), digest(text or "")))
    assert sorted(map(tuple, queries.op12_infill(spark, data).collect())) == want
