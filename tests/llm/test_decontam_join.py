"""Decontamination beyond the broadcast bound equals that under it."""

import numpy as np
import pytest

from cohortis.llm import common, decontam

ITEM = "one two three four five six seven eight nine ten eleven"
DOCS = [(1, f"Before, {ITEM.upper()}! after É"), (1, "clean row of the same id"), (None, f"É é {ITEM}. {ITEM} end"), (None, "clean, no id"), (2, None), (3, ""), (4, f"x {ITEM[:-7]} y two words {ITEM}")]


@pytest.mark.parametrize("bound", [0, decontam.BROADCAST_BYTES])
def test_rows_are_judged_one_by_one_at_any_size(spark, bound):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(1, ITEM), (2, "two words")], "item_id long, text string")
    order = lambda rows: sorted(rows, key=str)
    kept = decontam.remove_documents(docs, bench, broadcast_bytes=bound)
    assert kept.columns == docs.columns and order(map(tuple, kept.collect())) == order([DOCS[1], DOCS[3], DOCS[4], DOCS[5]])
    cut = decontam.remove_spans(docs, bench, broadcast_bytes=bound)
    want = [(1, "Before, ! after É"), DOCS[1], (None, "É é  end"), DOCS[3], DOCS[4], DOCS[5], (4, "x  y ")]
    assert cut.columns == docs.columns and [tuple(r) for r in order(map(tuple, cut.collect()))] == order(want)


def test_spans_by_join(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM), (2, "two words")], "item_id long, text string")
    got, want = (sorted(map(str, decontam.scan(docs, bench, broadcast_bytes=b).collect())) for b in (0, decontam.BROADCAST_BYTES))
    assert got == want


@pytest.mark.parametrize("bound", [0, decontam.BROADCAST_BYTES])
def test_items_without_an_id_hit_like_any_other(spark, bound):
    docs = spark.createDataFrame([(1, f"a {ITEM} b"), (2, "two words"), (3, "else")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, ITEM), (7, ITEM), (None, ITEM + " twelve"), (None, "two words")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.item_ids) for r in decontam.scan(docs, bench, broadcast_bytes=bound).collect()}
    assert got == {1: (11, [7, None]), 2: (2, [None]), 3: (0, [])}


def test_pieces_of_long_texts_give_the_same():
    rng = np.random.default_rng(5)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 9, n))
    items = [words(rng.integers(1, 16)) for _ in range(40)]
    known = decontam.WindowSet(b"".join(decontam.WindowSet.packed([*range(40)], [t.encode() for t in items], 4)))
    texts = [f"É, {words(n)}!".encode() for n in (1, 5, 40, 200, 900)] + [b"", b"w" * 500, b"?" * 500, b"w1 " + b"w" * 300 + b" w2 w3 w4 w5"]
    whole, cut = ([*decontam._scan_batches(known, common.word_table(), texts, most)] for most in (1 << 20, 40))
    assert [tuple(map(str, x)) for x in whole] == [tuple(map(str, x)) for x in cut] and sum(x[1] for x in whole) > 100


def test_a_large_benchmark_takes_some_40_bytes_a_window():
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9999, 500)).encode() for _ in range(400)]
    data = b"".join(decontam.WindowSet.packed([*range(400)], texts))
    assert len(data) < 45 * 400 * 500 + sum(map(len, texts)) + (4 << 20)
