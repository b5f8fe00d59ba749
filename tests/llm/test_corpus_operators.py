"""Each operator against a brute-force version or an exact round trip, and on the odd rows that every table has."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortis.llm import ann, bpe, common, decontam, licenses, pieces, quality, queries, sharding, simhash, tokenshards, toxicity, urlfilter

BYTES, WORDS = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
LONG = " ".join(f"word{i % 977} and{i % 13}, then." for i in range(40_000))
#: (doc_id, text): nulls, empties, repeats, ties, white space, other scripts, a very long text.
ODD = [(1, "One plain text, with words."), (2, None), (3, ""), (None, "no id at all"), (4, "   \n "), (5, "same text"), (6, "same text"), (7, "same text"), (5, "same text"), (8, "naïve Ünïcode 漢字 🙂 <|endoftext|> don't  stop\r\nhere "), (9, LONG), (10, "a"), (None, None)]
#: Columns that operators could trip over.
CLASH = ["print", "node", "shard", "row", "size", "digest", "ids", "evidence", "path_mean", "posterior", "leaf", "u", "v", "hit", "n", "word", "key"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
    df = df.withColumns({"lang": F.when(F.col("doc_id") != 3, "en"), "source": F.when(F.col("doc_id") != 1, "s"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit(f"extra {c}") for c in CLASH})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def some_labels(spark, name):
    return spark.createDataFrame([(1, 1), (5, 0), (5, 1), (6, None), (None, 1), (999, 1)], f"doc_id long, {name} int")


# -- op1 -------------------------------------------------------------------------------------------------------------


def test_pieces_equal_the_library():
    rng, known, library = np.random.default_rng(0), pieces.PieceEncoder(open(BYTES).read()), Tokenizer.from_file(BYTES)
    parts = [" ", "  ", "\n", "\t", "a", "b", "'s", "é", "Ω", "1", "23", "!", "<|endoftext|>", "<|endo", "\x1c", "\x85", "\xa0", "漢", "🙂", "don't", " \n", "\r\n", ".", ","]
    for _ in range(1500):
        text = "".join(rng.choice(parts, rng.integers(0, 14)))
        assert np.frombuffer(known.encode(text), known.type).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_shards_round_trip(spark, odd):
    library = Tokenizer.from_file(BYTES)
    manifest = tokenshards.write_token_shards(odd, BYTES)
    got = tokenshards.read_token_shards(spark, manifest).collect()
    got.sort(key=lambda r: r.start)
    want = sorted(((d is not None, d or 0, t or "") for d, t in ODD), key=lambda x: x[:2])
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [w[:2] for w in want]
    at = 0
    texts = {}
    for has, doc, text in want:
        texts.setdefault((has, doc), []).append(library.encode(text, add_special_tokens=False).ids + [0])
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        texts[(r.doc_id is not None, r.doc_id or 0)].remove(ids)
        assert (r.start, r.n_tokens) == (at, len(ids))
        at += len(ids)
    some = tokenshards.read_token_shards(spark, manifest, [8, 9]).collect()
    assert sorted(r.doc_id for r in some) == [8, 9]


def test_shards_are_plain_zstandard_and_show_damage(tmp_path):
    import io

    import zstandard

    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    file = File()
    writer = tokenshards.ShardWriter(file, 2)
    data = [np.arange(i * 999 % 70_000, dtype="<u4").astype("<u2").tobytes() for i in range(40)]
    for i, ids in enumerate(data):
        writer.add(i, ids)
    writer.close()
    reader = tokenshards.ShardReader(file)
    assert len(reader.frames) > 3 and [d for _, _, d in reader.documents()] == data
    assert [(i, d) for i, _, d in reader.documents({3, 39})] == [(3, data[3]), (39, data[39])]
    raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(file.getvalue()), read_across_frames=True).read()
    assert raw == b"".join(data), "any zstandard reader skips the index and the seek table"
    harmed = bytearray(file.getvalue())
    harmed[int(reader.places[1]) + 20] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(tokenshards.ShardReader(File(bytes(harmed))).documents())


def test_token_shards_of_nothing(spark, empty):
    assert tokenshards.read_token_shards(spark, tokenshards.write_token_shards(empty, BYTES)).count() == 0


# -- op2 -------------------------------------------------------------------------------------------------------------


def brute_licenses(text, least=0.8):
    cut = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    words, out = cut(text), set()
    for name, template in licenses.TEMPLATES.items():
        w = cut(template)
        n = min(5, len(w))
        own = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        have = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
        if len(own & have) / len(own) >= least:
            out.add(name)
    return out


def test_licenses_found_wherever_they_stand(spark):
    rng, texts = np.random.default_rng(2), []
    filler = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 500, n))
    for name, template in licenses.TEMPLATES.items():
        for before in (0, 1, 7, 30, 301):
            texts.append((name, f"{filler(before)} {template.upper() if before % 2 else template}\n{filler(40)}"))
    texts += [(None, filler(200)) for _ in range(20)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.matches for r in licenses.scan(df).collect()}
    for i, (name, text) in enumerate(texts):
        assert {m.template for m in got[i]} == brute_licenses(text), (name, text)
        assert name is None or name in {m.template for m in got[i]}
        for m in got[i]:
            part = text.encode()[m.begin : m.end].decode().lower()
            assert part.split()[0].strip('"').lower() in licenses.TEMPLATES[m.template].lower()


def test_license_bodies_without_their_opening_and_short_notices(spark):
    body = lambda name, cut: " ".join(licenses.TEMPLATES[name].split()[cut:])
    texts = [body("MIT-text", 25), body("ISC-text", 15), body("BSD-2-Clause-text", 25), body("Zlib-text", 14), "Copyright 2020 X. ALL RIGHTS\nRESERVED!", "all rights are reserved", body("MIT-text", 60)]
    df = spark.createDataFrame(list(enumerate("lorem ipsum " * 50 + t + " dolor sit" * 300 for t in texts)), "doc_id long, text string")
    got = {r.doc_id: [m.template for m in r.matches] for r in licenses.scan(df).collect()}
    assert got == {0: ["MIT-text"], 1: ["ISC-text"], 2: ["BSD-2-Clause-text"], 3: ["Zlib-text"], 4: ["All-rights-reserved"], 5: [], 6: []}


def test_license_odd_rows(odd, empty):
    got = licenses.scan(odd).collect()
    assert len(got) == len(ODD) and not any(r.matches for r in got) and licenses.scan(empty).count() == 0
    with pytest.raises(ValueError, match="words"):
        licenses.Templates({"nothing": " -- "})


# -- op3 -------------------------------------------------------------------------------------------------------------


def toxic_table(spark, n=400):
    rng, rows = np.random.default_rng(7), []
    bad = ["idiot", "moron", "scum"]
    for i in range(n):
        words = [f"w{x}" for x in rng.integers(0, 300, 60)]
        toxic = i % 5 == 0
        if toxic:
            for at in rng.integers(0, 60, 4):
                words[at] = bad[int(rng.integers(0, 3))]
        elif i % 7 == 0:
            words[3:3] = ["idiot", "box"]
        rows.append((i, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_learns_folds_and_spares(spark):
    table = toxic_table(spark)
    model = toxicity.train(table, table.select("doc_id", "toxic"), F.col("doc_id") % 3 != 1, exceptions=("idiot box",))
    assert {"moron", "scum"} <= set(model.words)
    score = {r.doc_id: r.s for r in table.select("doc_id", toxicity.score_udf(spark, model)("text").alias("s")).collect()}
    held = [(r.toxic, score[r.doc_id]) for r in table.collect() if r.doc_id % 3 == 1]
    assert all((s >= 0.7) == bool(t) for t, s in held)
    plain = "you m0ron, you m\u043er\u043en, SC\u200bUM and \uff4d\uff4f\uff52\uff4f\uff4e " + "w1 " * 20
    assert len(model.hits(toxicity.folded(plain))) == 4 and model.score(plain) > 0.7
    assert not model.hits("moronic scumble an idiot box") and model.hits("an idiot boxes")
    assert model.score(None) == model.score("") < 0.7


def test_toxicity_stems_and_ignored_columns(spark):
    rows = [(i, ("vex" + "abcdefghijkl"[i % 12] + " ") * 3 + f"x{i} y{i}", 1) for i in range(60)] + [(i, f"clean words number x{i} here", 0) for i in range(60, 400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(table, table.select("doc_id", "toxic"))
    assert "vex" in model.stems and model.score("some vexzz words vexq") > model.score("some revex words")


def test_toxicity_odd_rows(spark, odd, empty):
    model = toxicity.train(odd, some_labels(spark, "toxic"))
    got = odd.select("doc_id", toxicity.score_udf(spark, model)("text").alias("s")).collect()
    assert len(got) == len(ODD) and all(0 <= r.s <= 1 for r in got)
    nothing = toxicity.train(empty, some_labels(spark, "toxic").limit(0))
    assert not nothing.words and empty.select(toxicity.score_udf(spark, nothing)("text")).count() == 0


# -- op4 -------------------------------------------------------------------------------------------------------------

RULES = queries.URL_RULES


def test_url_rules_and_aliases(spark):
    link = lambda u: f'<html><head><link href="{u}" rel="canonical"></head></html>'
    moved = lambda u: f"<html><head><META http-equiv='Refresh' content='0; URL={u}'></head></html>"
    pages = [
        (1, "https://a.net/x", ""), (2, "https://plain.org/de/1", link("https://a.net/x")), (3, "https://EXAMPLE.net/en/1?q#f", None), (4, "https://b.example.com/de/9", link("https://m.example.net/en/2")),
        (5, "https://other.info/1", moved("https://chain.info/2")), (6, "https://chain.info/2", link("//a.net/x#top")), (7, "https://both.info/", link("https://x.net/")), (8, "https://w.org/fr/1", link("https://both.info/")),
        (9, None, "x"), (10, "no scheme", "x"), (11, "https://notnet/x", ""), (12, "https://a.net", ""), (13, "https://quiet.info/?a://b", ""), (2, "https://plain.org/de/1", link("https://a.net/x")),
        (14, "https://rel.info/p/q", link("/canon")), (15, "https://rel.info/canon", link("https://a.net/x")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"rule": F.lit("x"), "host": F.lit("y"), "node": F.lit("z"), "component": F.lit(1)})
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict, r.via) for r in urlfilter.judged(df, RULES).orderBy("page_id", "via").collect()]
    by = {g[0]: g[1:] for g in got}
    assert len(got) == len(pages)
    assert by[1] == ("a.net", "/x", "net/", "block", "rule") and by[2] == ("plain.org", "/de/1", None, "block", "alias")
    assert by[3] == ("example.net", "/en/1", "example.net/en/", "allow", "rule") and by[4][2:] == ("example.com/de/", "block", "rule")
    assert by[5][3:] == ("block", "alias") and by[6][3:] == ("block", "alias"), "two steps from the blocked page"
    assert by[7][3:] == ("allow", "alias"), "an explicit allow precedes"
    assert by[9] == by[10] == ("", "", None, "allow", "default") and by[11][3:] == ("allow", "default") and by[12][1:] == ("", None, "allow", "default")
    assert by[13][:2] == ("quiet.info", "/") and by[14][3:] == by[15][3:] == ("block", "alias")
    assert urlfilter.judged(df.limit(0), RULES).count() == 0


def test_url_rules_by_join_equal_the_expression(spark, monkeypatch):
    rng = np.random.default_rng(3)
    urls = [(i, f"http://{'.'.join(rng.choice(['a', 'b', 'net', 'org'], rng.integers(1, 4)))}/{''.join(rng.choice(list('xy/'), 3))}", None) for i in range(200)]
    pages = spark.createDataFrame(urls, "page_id long, url string, html string")
    rules = [urlfilter.Rule(str(rng.choice(["allow", "block"])), ".".join(rng.choice(["a", "b", "net", "org"], rng.integers(1, 3))), "/" + "".join(rng.choice(list("xy/"), rng.integers(0, 3)))) for _ in range(40)]
    one = sorted(map(tuple, urlfilter.judged(pages, rules).collect()), key=str)
    monkeypatch.setattr(urlfilter, "EXPRESSION_RULES", 0)
    assert sorted(map(tuple, urlfilter.judged(pages, rules).collect()), key=str) == one
    assert urlfilter.judged(pages, []).where("verdict = 'allow'").count() == 200


def test_components_against_union_find(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 500)] + [(7, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")
    got = {r.node: r.component for r in common.connected_components(df, "a", "b").collect()}
    assert got == {x: root(x) for x in up}
    assert common.connected_components(df.limit(0), "a", "b").count() == 0


# -- op5 -------------------------------------------------------------------------------------------------------------


def test_differencing_is_karmarkar_karp():
    sums, slots = sharding.differenced(np.array([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]]))
    assert sorted(sums) == [14, 16], "the textbook example"
    rng = np.random.default_rng(0)
    size = rng.integers(1, 10_000, 500)
    start = np.zeros((500, 16), dtype=np.int64)
    start[:, 0] = size
    sums, slots = sharding.differenced(start)
    assert (np.bincount(slots[:, 0], weights=size, minlength=16) == sums).all() and sums.max() - sums.min() < 50
    assert sorted(slots[7]) == list(range(16))


@pytest.mark.parametrize("part", [10, 60_000])
def test_sharding(spark, part):
    rng = np.random.default_rng(1)
    texts = ["x" * int(n) for n in rng.integers(1, 3000, 150)] + ["copy"] * 70 + [None, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sharding.assign(df, 16, groups_a_part=part).toPandas().set_index("doc_id")
    assert len(got) == len(texts)
    total = got.groupby("shard")["size"].sum()
    # Ten groups a part leave coarse tuples to the second differencing: less than one large group apart.
    assert len(total) == 16 and total.max() - total.min() <= (3000 if part == 10 else 200)
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    for i, text in enumerate(texts):
        assert got["size"][i] == len((text or "").encode()) + 1 and got["text_crc32"][i] == zlib.crc32((text or "").encode())
    assert got["shard"].loc[list(range(150, 220))].nunique() == 1 and set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()


def test_sharding_odd_rows(odd, empty):
    got = sharding.assign(odd).collect()
    assert len(got) == len(ODD) and len({r.shard for r in got if r.doc_id in (5, 6, 7)}) == 1
    assert len({(r.shard, r.slot) for r in got}) == len(ODD) and sharding.assign(empty).count() == 0


# -- op6 -------------------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(text, items):
    words, hit, found = words_of(text), set(), set()
    for item, own in items:
        w = words_of(own)
        k = min(10, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in windows:
                found.add(item)
                hit |= set(range(i, i + k))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("bound", [0, decontam.BROADCAST_BYTES])
def test_decontamination_against_brute_force(spark, bound):
    rng = np.random.default_rng(4)
    say = lambda n: " ".join(rng.choice(["a", "b", "É", "É1", "c'd", "the"], n))
    items = [(i, say(int(n))) for i, n in enumerate(rng.integers(0, 25, 12))] + [(50, None), (51, "!!"), (52, "a b É")]
    docs = [(i, f"{say(30)} {items[i % 12][1].upper() if i % 3 else ''}; {say(15)}") for i in range(60)] + [(60, None), (61, ""), (60, "a b É x")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in decontam.scan(d, b, broadcast_bytes=bound).collect())
    assert got == sorted((i, *brute_hits(t, items)) for i, t in docs)


def test_spans_and_documents_are_removed(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"Before, {item.upper()}! after É"), (2, "one two three"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    cleaned = {r.doc_id: r.text for r in decontam.remove_spans(docs, bench).collect()}
    assert cleaned == {1: "Before, ! after É", 2: "one two three", 3: None}
    assert sorted(r.doc_id for r in decontam.remove_documents(docs, bench).collect()) == [2, 3]
    assert decontam.item_digest([10, 9]) == hashlib.sha256(b"10,9").hexdigest()


def test_decontamination_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "same text"), (None, "a")], "item_id long, text string").withColumn("w", F.lit(1))
    got = decontam.scan(odd, bench).collect()
    assert len(got) == len(ODD) and sum(r.n_hit for r in got) == 9  # an item without an id hits too
    assert decontam.scan(empty, bench).count() == 0 and decontam.scan(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    kept = decontam.remove_documents(odd, bench)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 5


# -- op7 -------------------------------------------------------------------------------------------------------------


def brute_nearest(ids, x, q, k=20):
    s = (x * x[q]).sum(axis=1)
    s[ids == ids[q]] = -np.inf
    order = [i for i in np.lexsort((ids, -s)) if s[i] > -np.inf][:k]
    return ids[order].tolist(), s[order].tolist()


def test_nearest_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(12, 16))
    x = (centre[rng.integers(0, 12, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32).astype(float)
    x[100:400] = x[100]  # one very common vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), leaf_rows=64).toPandas()
    ids, found, asked = np.arange(3000), 0, 0
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        want, scores = brute_nearest(ids, x, int(q))
        assert own["rank"].tolist() == list(range(1, 21))
        found += len(set(want) & set(own.vec_id))
        asked += 20
        s = (x[own.vec_id] * x[int(q)]).sum(axis=1)
        assert own.score.tolist() == s.tolist() and [*zip(-own.score, own.vec_id, strict=True)] == sorted(zip(-own.score, own.vec_id, strict=True))
    assert asked == 3000 and found / asked >= 0.9
    same = [v for v in got[got.query_id == 100].sort_values("rank").vec_id if 100 <= v < 400]
    assert len(same) > 10 and same == list(range(101, 101 + len(same))), "ties go to the smaller id"


def test_nearest_blocks_of_hot_leaves(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 50)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 2 = 0"), k=5, recall=1.0, leaf_rows=200).toPandas()
    ids = np.arange(600)
    hits = sum(len(set(brute_nearest(ids, x, int(q), 5)[0]) & set(own.vec_id)) for q, own in got.groupby("query_id"))
    assert len(got) == 1500 and hits >= 0.99 * 1500 and not got.duplicated(["query_id", "vec_id"]).any()


def test_nearest_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (40, None), (60, [0.0, 0.0]), (80, [float("nan"), 1.0]), (100, [1.0]), (120, [None, 1.0]), (1, [0.5, 0.5]), (2, [float("inf"), 0.0]), (None, [1.0, 1.0]), (3, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("leaf", "v", "row", "query_id", "rank")})
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.nearest(df, df.where("vec_id % 20 = 0")).collect()}
    assert got == {(0, 1): (1, 0.5), (0, 2): (20, 0.0), (20, 1): (1, 0.5), (20, 2): (0, 0.0)}
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    assert ann.nearest(df.where("vec_id in (40, 60)"), df).count() == 0


# -- op8 -------------------------------------------------------------------------------------------------------------


def quality_table(spark, n=300):
    rng, rows = np.random.default_rng(3), []
    for i in range(n):
        words = [f"w{x}" for x in rng.integers(0, 900, 50)]
        good = i % 4 != 0
        rows.append((i, " ".join(words) if good else " ".join(w + "!!" for w in words).upper(), "en", "s0" if i % 3 else f"s{i % 40}", int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, quality int")


def test_quality_judges_and_shrinks(spark):
    table = quality_table(spark)
    got = quality.judged(table, table.select("doc_id", "quality").where("doc_id % 2 = 0")).toPandas().set_index("doc_id")
    truth = table.toPandas().set_index("doc_id").quality
    assert ((got.accepted.astype(int) == truth[got.index]).mean()) > 0.99 and len(got) == 300
    model = quality.train(table, table.select("doc_id", "quality"))
    rows = spark.createDataFrame([("big", "p", 3.0)] * 200 + [("big", "q", -3.0)] + [("small", "p", -3.0)], "host string, path string, evidence double")
    priors = {(r.host, r.path): r for r in quality.site_priors(rows, 0.0).collect()}
    assert priors[("small", "p")].path_mean > 0.3, "one document says little about its site"
    assert priors[("big", "p")].path_mean > priors[("big", "q")].path_mean > 0.2 and model.evidence(np.zeros((1, 2 * len(quality.FEATURES))))[0] == 0


def test_quality_odd_rows(spark, odd, empty):
    labels = some_labels(spark, "quality")
    got = quality.judged(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.posterior <= 1 for r in got)
    table = quality_table(spark)
    model = quality.train(table, table.select("doc_id", "quality"))
    kept = quality.accepted(odd, labels, model=model)
    assert kept.columns == odd.columns and kept.count() == sum(r.accepted for r in quality.judged(odd, labels, model=model).collect())
    assert quality.judged(empty, labels).count() == 0 and quality.accepted(empty, labels.limit(0)).count() == 0


# -- op9 -------------------------------------------------------------------------------------------------------------


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    up = {i: i for i in range(len(prints))}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    best = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            best[root(i)] = min(best.get(root(i), doc), doc)
    return [best.get(root(i)) for i in range(len(prints))]


def test_fingerprints():
    for text in [None, "", " \t", "One", "a b c", "a b c d", "A\x0bB\x0cc d e", "x\xa0y z é 漢 w", *[t for _, t in ODD[:9]]]:
        assert simhash.fingerprint((text or "").encode()) == brute_print(text), text


def test_golay_covers_and_keys_meet():
    golay = simhash.Golay()
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 23, 2000)
    code = golay.decode(x)
    word = code << 11 | golay.syndromes(code << 11)
    assert (golay.syndrome(word) == 0).all() and np.bitwise_count((word ^ x).astype(np.uint64)).max() <= 3
    _, ok = golay.near(x, 23)
    assert set(ok.sum(axis=1)) <= {1, 6}
    a = rng.integers(0, 1 << 64, 1500, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    ka, kb = ({} for _ in range(2))
    for keys, of in ((ka, a), (kb, b)):
        for r, k in zip(*simhash.keys_of(of), strict=True):
            keys.setdefault(int(r), set()).add(int(k))
    assert all(ka[i] & kb[i] for i in range(len(a)))


@pytest.mark.parametrize("block", [8, 8192])
def test_near_duplicate_components(spark, monkeypatch, block):
    monkeypatch.setattr(simhash.fingerprint_links, "__defaults__", (block,))
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    prints = [int(p) for p in base]
    for p in base[:6]:  # clouds of near fingerprints, one of them large
        for _ in range(150 if p == base[0] else 12):
            x = int(p)
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            prints.append(x)
    prints += prints[:10]
    rows = [(i if i % 17 else None, simhash.signed(p)) for i, p in enumerate(prints)]
    df = spark.createDataFrame(rows, "doc_id long, print long")
    got = {r.print: r.component_id for r in simhash.components_of_prints(df).collect()}
    want = brute_components([r[0] for r in rows], prints)
    for (_, p), c in zip(rows, want, strict=True):
        assert got.get(p) == c or c is not None and p not in got


def test_large_groups_span_as_all_pairs_do():
    rng = np.random.default_rng(6)
    x = np.unique(np.array([int(rng.integers(0, 4)) << 60 ^ sum(1 << int(b) for b in rng.choice(24, rng.integers(0, 5), replace=False)) for _ in range(700)], dtype=np.uint64))
    forest = simhash.Forest(len(x))
    edges = simhash._spanning(x)
    assert all(forest.join(a, b) for a, b in edges), "no edge is needless"
    assert all((int(x[a]) ^ int(x[b])).bit_count() <= 4 for a, b in edges)
    want = brute_components(list(range(len(x))), [int(v) for v in x])
    assert [forest.root(i) for i in range(len(x))] == want


def test_near_duplicates_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert sorted((r.doc_id or -1, r.print) for r in got) == sorted((d or -1, simhash.signed(brute_print(t))) for d, t in ODD)
    prints = [brute_print(t) for _, t in ODD]
    want = Counter((d, c) for (d, _), c in zip(ODD, brute_components([d for d, _ in ODD], prints), strict=True))
    assert Counter((r.doc_id, r.component_id) for r in got) == want
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for (_, c) in want if c is not None})
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicated(empty).count() == 0


# -- op10 ------------------------------------------------------------------------------------------------------------


def test_transducer_is_minimal_and_exact():
    words = sorted({("".join(p)).encode() for n in range(1, 5) for p in combinations("abcdefg", n)} | {b"\xc3\xa9t\xc3\xa9", b"zoo", b"zoos"})
    data = {w: (w * 2)[: len(w) + 1] for w in words}
    t = bpe.Transducer(bpe.Transducer.packed(data))
    assert t.ranks(words).tolist() == list(range(len(words))) and [t.output(i) for i in range(len(words))] == [data[w] for w in words]
    assert (t.ranks([b"", b"h", b"abcde", b"zo", b"zooss", b"\xc3"]) == -1).all()
    # States of the minimal automaton are the different right languages.
    rights = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in {w[:i] for w in words for i in range(len(w) + 1)}}
    assert len(t.final) == len(rights)
    assert bpe.Transducer(bpe.Transducer.packed({})).ranks([b"a"]).tolist() == [-1]
    with pytest.raises(ValueError, match="lexicon"):
        bpe.Transducer(b"something else, long enough")


@pytest.mark.parametrize("n_words", [0, 5, 100_000])
def test_bpe_equals_the_library(spark, odd, n_words):
    library = Tokenizer.from_file(WORDS)
    rng = np.random.default_rng(1)
    parts = [" ", "  ", "\n", "a", "B", "'s", "É", "Ω", "Σ", "1", "23", "!", "%%%", "<|endoftext|>", "\x1c", "\x85", "\xa0", "漢", "é", "İ", "ß", "don't", "ª", "Œ", "The", "the"]
    more = [(100 + i, "".join(rng.choice(parts, rng.integers(0, 14)))) for i in range(300)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    lexicon = bpe.compile_lexicon(docs, WORDS, n_words)
    assert lexicon.n_words <= n_words
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in bpe.decode_ids(bpe.encode_texts(docs, lexicon), lexicon).collect())
    want = Counter()
    for doc, text in ODD + more:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[(doc, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False))] += 1
    assert got == want
    assert got == Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in bpe.encode_texts(docs, lexicon, decode=True).collect())


def test_bpe_of_nothing(empty):
    lexicon = bpe.compile_lexicon(empty, WORDS)
    assert lexicon.n_words == 0 and bpe.decode_ids(bpe.encode_texts(empty, lexicon), lexicon).count() == 0


# -- words -----------------------------------------------------------------------------------------------------------


def test_words_of_many_texts():
    texts = [b"", b"One  two", b"!", "É x1".encode(), b"a"]
    w = common.Words(texts, common.word_table())
    assert [w.word(i) for i in range(len(w.start))] == [b"one", b"two", "É".encode(), b"x1", b"a"] and w.doc.tolist() == [1, 1, 3, 3, 4]
    at, code = w.windows(2)
    assert at.tolist() == [0, 2] and common.Words([b"ONE,TWO"], common.word_table()).windows(2)[1][0] == code[0]
    assert len(common.Words([], common.word_table()).start) == 0
    assert common.text_bytes(pa.array(["é", None])) == ["é".encode(), b""]
