"""The pipeline's near-duplicate stage against all pairs."""

from itertools import combinations

import numpy as np

from cohortis.llm import shingles, simhash


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited_texts():
    """Bases with copies of which a few words are other ones, a chain, and unlike texts."""
    rng, texts = np.random.default_rng(7), []
    for b in range(12):
        base = [f"w{x}" for x in rng.integers(0, 3000, 60 + 20 * b)]
        texts.append(" ".join(base))
        for _ in range(8):
            own = list(base)
            for at in rng.integers(0, len(own), rng.integers(1, 5)):
                own[at] = f"n{rng.integers(0, 10**6)}"
            texts.append(" ".join(own))
    return [*texts, "few words", "Few  words", "", " \n"]


def test_similarities_are_those_of_the_sets():
    texts = edited_texts()
    pairs = [*combinations(range(len(texts)), 2)]
    got = shingles.similarities([texts[a].encode() for a, _ in pairs], [texts[b].encode() for _, b in pairs])
    sets = [shingle_set(t) for t in texts]
    assert np.allclose(got, [jaccard(sets[a], sets[b]) for a, b in pairs])


def test_spanning_links_connect_what_all_links_do():
    rng = np.random.default_rng(3)
    for trial in range(60):
        base = rng.integers(0, 2**63, 40, dtype=np.uint64)
        sets = [np.unique(np.where(rng.random(40) < rng.choice([0.02, 0.1, 0.2]), rng.integers(0, 2**63, 40, dtype=np.uint64), base)) for _ in range(rng.integers(1, 40))]
        part = rng.integers(0, max(1, len(sets) // 3), len(sets)) + 100
        want, got = simhash.Forest(200 + len(sets)), simhash.Forest(200 + len(sets))
        for i, p in enumerate(part.tolist()):  # rows of one part are one component
            want.join(i, len(sets) + p - 100), got.join(i, len(sets) + p - 100)
        for a, b in combinations(range(len(sets)), 2):
            if len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.8:
                want.join(a, b)
        links = shingles.spanning_links(sets, part, 0.8)
        for a, b in links:
            assert len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.8 and got.join(a, b)
        assert [got.root(i) for i in range(len(sets))] == [want.root(i) for i in range(len(sets))]


def test_simhashes_are_majorities_of_the_sets():
    texts = [t.encode() for t in edited_texts()]
    doc, code = shingles.sets_of(texts)
    _, size, prints, _ = shingles.sketches(texts)
    for i in range(len(texts)):
        own = [int(c) for c in code[doc == i]]
        assert size[i] == len(own) and int(prints[i]) == sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in own) > len(own))


def test_cells_of_a_few_rows_give_the_same(spark, monkeypatch):
    rng, base = np.random.default_rng(11), [f"w{i}" for i in range(60)]
    texts = [" ".join(w if rng.random() > p else f"n{rng.integers(0, 10**6)}" for w in base) for p in rng.choice([0.0, 0.01, 0.02, 0.04], 120)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    sets = [shingle_set(t) for t in texts]
    forest = simhash.Forest(len(texts))
    for a, b in combinations(range(len(texts)), 2):
        if jaccard(sets[a], sets[b]) >= 0.8:
            forest.join(a, b)
    monkeypatch.setattr(shingles, "BLOCK_ROWS", 3)
    assert sorted(r.doc_id for r in simhash.deduplicated(df).collect()) == sorted({forest.root(i) for i in range(len(texts))})


def test_no_kept_row_has_a_near_copy(spark):
    texts = edited_texts()
    sets = [shingle_set(t) for t in texts]
    forest = simhash.Forest(len(texts))
    for a, b in combinations(range(len(texts)), 2):
        if jaccard(sets[a], sets[b]) >= 0.8:
            forest.join(a, b)
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash.deduplicated(df).collect()) == sorted({forest.root(i) for i in range(len(texts))})


def test_rows_without_an_id_are_copies_too(spark):
    words = [f"w{i}" for i in range(40)]
    near = lambda *at: " ".join("other" if i in at else w for i, w in enumerate(words))
    # 1 and 2 are joined by a row without an id; three more without an id are copies of each other only.
    rows = [(1, near()), (None, near(0, 1)), (2, near(0, 1, 38, 39)), (None, "no id at all"), (None, "no id at all"), (None, "no  id at all"), (3, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = simhash.deduplicated(df).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 3]
