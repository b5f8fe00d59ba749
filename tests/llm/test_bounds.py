"""What is bounded by parameters, under tiny bounds: templates of any length, pieces, shards, rounds, batches of queries."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from cohortis.llm import ann, common, licenses, queries, sharding, tokenshards


def test_templates_of_any_length(monkeypatch):
    rng = np.random.default_rng(4)
    body = [f"t{x}" for x in rng.integers(0, 400, 900)]
    cut = [w for i, w in enumerate(body) if i % 60]  # 15 words gone, five shingles for each
    known = licenses.Templates({"long": " ".join(body), "two": "All rights", "three": "All rights reserved.", "one": "copyleft"})
    filler = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 900, n))
    texts = [f"{filler(37)} {' '.join(body)} {filler(9)}", f"{filler(900)} {' '.join(cut)}", f"{' '.join(body[:500])} x {filler(30)}", "ALL RIGHTS, reserved", "all rights", "all the rights reserved", "Copyleft; all rights reserved " + filler(50) + " all rights reserved", ""]
    found = known.matches([t.encode() for t in texts])
    assert [[m["template"] for m in x] for x in found] == [["long"], ["long"], [], ["three", "two"], ["two"], [], ["one", "three", "two"], []]
    assert found[0][0]["containment"] == 1.0 and 0.85 < found[1][0]["containment"] < 0.95 and found[6][1]["begin"] == 10
    own = {tuple(body[i : i + 5]) for i in range(len(body) - 4)}
    have = {tuple(cut[i : i + 5]) for i in range(len(cut) - 4)}
    assert found[1][0]["containment"] == pytest.approx(len(own & have) / len(own))
    monkeypatch.setattr(licenses, "PIECE", 300)
    for text, want in zip(texts, found, strict=True):
        assert known.in_long(text.encode(), licenses.CONTAINMENT)[1] == want


def test_pieces_of_long_texts_match_as_whole_ones(monkeypatch):
    rng, known, texts = np.random.default_rng(9), licenses.Templates(licenses.TEMPLATES), []
    for _ in range(12):
        words = [f"w{x}" for x in rng.integers(0, 50, 400)]
        for at in rng.integers(0, 400, 8):
            words.insert(at, list(licenses.TEMPLATES.values())[rng.integers(0, len(licenses.TEMPLATES))])
        texts.append(" ".join(words).encode())
    want = known.matches(texts)
    monkeypatch.setattr(licenses, "PIECE", 200)
    assert [known.in_long(t, licenses.CONTAINMENT)[1] for t in texts] == want and sum(map(len, want)) > 40


def test_shards_close_at_their_bounds(spark):
    path = queries.tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(i // 3 if i % 5 else None, f"text {i % 17} " * (i % 9)) for i in range(120)] + [(None, "the same row")] * 60 + [(7, "the same row")] * 60
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for bounds in ({"shard_docs": 10}, {"shard_bytes": 1}):
        manifest = tokenshards.write_token_shards(df, path, **bounds)
        shards = manifest.orderBy("shard").collect()
        assert len(shards) > 12 or "shard_bytes" in bounds
        assert all(r.n_docs <= 10 for r in shards) or "shard_bytes" in bounds
        ends = [(r.least_id, r.greatest_id) for r in shards if r.least_id is not None]
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False)) and sum(r.null_ids for r in shards) == sum(d is None for d, _ in rows)
        got = tokenshards.read_token_shards(spark, manifest).orderBy("start").collect()
        want = sorted((d is not None, d or 0, *library.encode(t, add_special_tokens=False).ids, 0) for d, t in rows)
        assert sorted((r.doc_id is not None, r.doc_id or 0, *np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
        assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [w[:2] for w in sorted(want, key=lambda w: w[:2])]
        at = 0
        for r in got:
            assert r.start == at
            at += r.n_tokens
        some = tokenshards.read_token_shards(spark, manifest, [3, 7, 10**9]).collect()
        assert sorted(r.doc_id for r in some) == sorted(d for d, _ in rows if d in (3, 7))
        assert tokenshards.read_token_shards(spark, manifest, [None]).count() == sum(d is None for d, _ in rows)


def test_differencing_in_rounds(spark):
    rng = np.random.default_rng(2)
    texts = ["x" * int(n) for n in rng.integers(1, 400, 300)] + ["copy"] * 50 + [None] * 5
    df = spark.createDataFrame([*enumerate(texts), *[(None, "no id")] * 40], "doc_id long, text string")
    got = sharding.assign(df, 4, groups_a_part=6, most_tuples=3).toPandas()
    total = got.groupby("shard")["size"].sum()
    assert len(got) == len(texts) + 40 and len(total) == 4 and total.max() - total.min() < 800
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    assert got[got.doc_id.between(300, 349)]["shard"].nunique() == 1 and got[got.doc_id.isna()]["shard"].nunique() == 1


def test_queries_in_small_batches(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    run = lambda: sorted(map(tuple, ann.nearest(df, df.where("vec_id % 7 = 0"), k=5, leaf_rows=20, recall=1.0).collect()))
    want = run()
    monkeypatch.setattr(common, "BATCH_BYTES", 8 * 8 * 3)
    assert run() == want and len(want) == 43 * 5
