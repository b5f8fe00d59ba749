"""Every registered query on the driver's tables against its contract, by brute force, and plain versions of the learnt ones."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cohortis.llm import quality, queries, simhash, toxicity


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r.doc_id: r.text for r in queries.table(spark, data, "documents").select("doc_id", "text").collect()}


def test_op1(spark, data, texts):
    library = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    library.no_truncation()
    at, want = 0, []
    for doc in sorted(texts):
        ids = [*library.encode(texts[doc] or "", add_special_tokens=False).ids, 0]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op1_token_shards(spark, data).collect())) == want


def test_op5(spark, data, texts):
    got = queries.op5_sharding(spark, data).collect()
    size, rows, home = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        size[r.shard] += r.size
        rows[r.shard].append(r.slot)
        home[texts[r.doc_id]].add(r.shard)
    assert sorted(r.doc_id for r in got) == sorted(texts) and set(rows) == set(range(16))
    assert all(sorted(x) == [*range(len(x))] for x in rows.values()) and all(len(x) == 1 for x in home.values())
    assert max(size.values()) - min(size.values()) <= 0.02 * max(size.values())


def test_op7(spark, data):
    rows = [(r.vec_id, r.embedding) for r in queries.table(spark, data, "embeddings").select("vec_id", "embedding").collect()]
    usable = {i: np.array(v, dtype=float) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = np.array(sorted(usable))
    x = np.stack([usable[i] for i in ids])
    got = defaultdict(list)
    for r in queries.op7_ann(spark, data).orderBy("query_id", "rank").collect():
        assert r.rank == len(got[r.query_id]) + 1 and r.score == pytest.approx(float((usable[r.query_id] * usable[r.vec_id]).sum()), abs=1e-12)
        got[r.query_id].append((-r.score, r.vec_id))
    assert set(got) == {i for i in usable if i % 20 == 0}
    found = 0
    for q, near in got.items():
        score = x @ usable[q]
        best = [int(i) for i in ids[np.lexsort((ids, -score))] if i != q][:20]
        assert near == sorted(near) and len(near) == len(best) and q not in {i for _, i in near}
        found += len({i for _, i in near} & set(best)) / len(best)
    assert found / len(got) >= 0.9


def plain_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op9(spark, data, texts):
    prints = {doc: plain_print(t) for doc, t in texts.items()}
    ids, forest = sorted(prints), simhash.Forest(len(prints))
    for i, a in enumerate(ids):
        for j in range(i + 1, len(ids)):
            if (prints[a] ^ prints[ids[j]]).bit_count() <= 4:
                forest.join(i, j)
    want = [(doc, f"{prints[doc]:016x}", ids[forest.root(i)]) for i, doc in enumerate(ids)]
    assert sorted(map(tuple, queries.op9_simhash(spark, data).collect())) == want


def test_op10(spark, data, texts):
    library = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    digest = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for doc in sorted(texts):
        ids = library.encode(texts[doc] or "", add_special_tokens=False).ids
        want.append((doc, len(ids), digest(np.array(ids, dtype="<u4").tobytes()), digest(library.decode(ids, skip_special_tokens=False).encode())))
    assert sorted(map(tuple, queries.op10_bpe(spark, data).collect())) == want


def test_op3_scores_and_labels(spark, data, texts):
    got = queries.op3_toxicity(spark, data).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def plain_hits(model, text):
    """Every entry tried at every place, without an automaton."""
    spared = [(i, i + len(e)) for e in map(toxicity.folded, model.exceptions) for i in range(len(text)) if text.startswith(e, i) and (not i or not text[i - 1].isalnum()) and (i + len(e) == len(text) or not text[i + len(e)].isalnum())]
    out = []
    for i in range(len(text)):
        if i and text[i - 1].isalnum():
            continue
        whole = [(w, i + len(e)) for e, w in model.words.items() if text.startswith(e, i) and (i + len(e) == len(text) or not text[i + len(e)].isalnum())]
        begun = [(w, i + len(e)) for e, w in model.stems.items() if text.startswith(e, i)]
        if best := max(whole + begun, default=None):
            if not any(a <= i and best[1] <= b for a, b in spared):
                out.append((i, *best[::-1]))
    return out


def test_toxicity_against_a_naive_matcher():
    rng = np.random.default_rng(8)
    entries = ["idiot", "idio", "id", "clown", "trash", "scum", "scumbag", "bag", "foo bar", "étron"]
    for _ in range(300):
        pick = lambda: {e: float(w) for e, w in zip(entries, rng.uniform(1, 6, len(entries)), strict=True) if rng.random() < 0.6}
        model = toxicity.Model(pick(), pick())
        parts = [*entries, "idiotic", "trash can", "Trash Can", "circus clown", "clown fish", "clownfish", "1d10t", "sсum", "x", "a-", ", ", "can", "5cumbag"]
        text = toxicity.folded("".join(str(rng.choice(parts)) + str(rng.choice([" ", " ", "", "-", "\n"])) for _ in range(12)))
        assert sorted(model.hits(text)) == plain_hits(model, text), (text, model.words, model.stems)


def test_quality_posteriors_by_plain_loops(spark, data):
    docs, labels = (queries.table(spark, data, t) for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = quality.judged(docs, labels, model=model).collect()
    sure = lambda r: 1 / (1 + np.exp(-(r.evidence + model.prior)))
    paths, hosts = defaultdict(list), defaultdict(list)
    for r in got:
        paths[r.host, r.path].append(sure(r))
        hosts[r.host].append(sure(r))
    every = [p for x in hosts.values() for p in x]
    mean = min(max(float(np.mean(every)), 1e-4), 1 - 1e-4)

    def strength(groups):
        """Moments of (values, what they are shrunk to)."""
        n = sum(len(x) for x, _ in groups)
        between = (sum(len(x) * (np.mean(x) - m) ** 2 for x, m in groups) - sum(m * (1 - m) for _, m in groups)) / n
        typical = sum(len(x) * m * (1 - m) for x, m in groups) / n
        return min(max(typical / between - 1, 1.0), 1000.0) if between > 1e-12 else 1000.0

    k = strength([(x, mean) for x in hosts.values()])
    host_mean = {h: (sum(x) + k * mean) / (len(x) + k) for h, x in hosts.items()}
    k = strength([(x, host_mean[h]) for (h, _), x in paths.items()])
    path_mean = {key: (sum(x) + k * host_mean[key[0]]) / (len(x) + k) for key, x in paths.items()}
    for r in got:
        m = path_mean[r.host, r.path]
        post = 1 / (1 + np.exp(-(np.log(m / (1 - m)) + r.evidence)))
        assert r.host_mean == pytest.approx(host_mean[r.host]) and r.path_mean == pytest.approx(m) and r.posterior == pytest.approx(post) and r.accepted == (r.posterior >= 0.5)


@pytest.fixture(scope="module")
def odd_tables(spark, data, tmp_path_factory):
    """Folders with tables of odd rows, and of none."""
    top = tmp_path_factory.mktemp("odd")
    docs = queries.table(spark, data, "documents")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (None, "", "en", None, 0), (None, "word " * 300_000, None, "s", None), (10**6 + 1, " \n", "en", "s", 1), (None, None, None, None, None)], docs.schema)
    some = docs.limit(40)
    odd.union(some).union(some).withColumns({"node": F.lit(1), "key": F.lit("x"), "word": F.lit("w"), "host": F.lit(None).cast("string")}).coalesce(2).write.parquet(f"{top}/odd/documents.parquet")
    docs.limit(0).write.parquet(f"{top}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        queries.table(spark, data, name).coalesce(1).write.parquet(f"{top}/odd/{name}.parquet")
        queries.table(spark, data, name).limit(0).write.parquet(f"{top}/none/{name}.parquet")
    return top


def test_pipeline_on_odd_and_empty_tables(spark, odd_tables):
    assert corpus_pipeline.run(spark, f"{odd_tables}/none").count() == 0
    docs = queries.table(spark, f"{odd_tables}/odd", "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, f"{odd_tables}/odd")
        assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0
    ids = [r.doc_id for r in corpus_pipeline.run(spark, f"{odd_tables}/odd").collect()]
    assert len(ids) > 5 and len({i for i in ids if i is not None}) == sum(i is not None for i in ids)
