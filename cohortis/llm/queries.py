"""The registered queries of the corpus operators, thin over the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontam, infill, licenses, mixture, quality, sharding, simhash, tokenshards, toxicity, urlfilter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file, by the package that holds them."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenshards.write_token_shards(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0)
    read = tokenshards.read_token_shards(spark, manifest)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.size("matches").cast("long").alias("n_licenses"), F.array_join("matches.template", ",").alias("licenses"), F.coalesce(F.array_max("matches.containment"), F.lit(0.0)).alias("best_containment"))


def held_out(doc_id="doc_id"):
    """Whether crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    return toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity_model(spark, sf_dir)
    scored = table(spark, sf_dir, "documents").select("doc_id", held_out().alias("held_out"), toxicity.score_udf(spark, model)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


#: (verdict, host, path)
URL_RULES = [urlfilter.Rule("block", "net", "/"), urlfilter.Rule("allow", "example.net", "/en/"), urlfilter.Rule("block", "example.com", "/de/"), urlfilter.Rule("allow", "org", "/fr/")]


#: Weights of sources in order, repeating.
MIX_WEIGHTS = (5, 2, 1)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), sharding.SHARDS)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), decontam.SIZE)
    names = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = bpe.compile_lexicon(docs, tokenizer("word_bpe_49k.json"))
    coded = bpe.encode_texts(docs, lexicon, decode=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op11_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixture.copies(table(spark, sf_dir, "documents"), MIX_WEIGHTS)
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.infilled(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c, 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest(infill.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: Aliases too: components over canonical links and refreshes. The SQL resolves references without dot segments or a base
#: element, and reads &amp; alone of the references to characters; the rest is for the tests.
OP4_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, html, trim(url) AS u,
    translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(rule, verdict, rhost, rpath) AS (VALUES
  ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
  ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
tags AS (SELECT u, path, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM p WHERE u IS NOT NULL AND html IS NOT NULL),
refs AS (
  SELECT u, path, regexp_extract(tag, '(?is)[\s"''/]href\s*=\s*["'']?([^"''\s>]*)', 1) AS ref FROM tags
  WHERE regexp_matches(tag, '(?is)^<link.*[\s"''/]rel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|''(?:[^'']*\s)?canonical(?:\s[^'']*)?''|canonical[\s/>])')
  UNION ALL
  SELECT u, path, regexp_extract(tag, '(?is)[\s"''/]content\s*=\s*["'']?[^"''>=]*\burl\s*=\s*["'']?([^"''\s>]*)', 1) FROM tags
  WHERE regexp_matches(tag, '(?is)^<meta.*[\s"''/]http-equiv\s*=\s*["'']?\s*refresh\b')),
parts AS (
  SELECT u, path, regexp_replace(replace(ref, '&amp;', '&'), '#.*$', '') AS ref, regexp_extract(u, '^([\s\S]*?://[^/?#]*)', 1) AS head,
    regexp_extract(u, '^[^?#]*(\?[^#]*)', 1) AS query FROM refs WHERE ref <> ''),
found AS (
  SELECT u AS source, CASE
    WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN ref WHEN head = '' THEN NULL
    WHEN starts_with(ref, '//') THEN regexp_extract(u, '^([\s\S]*?:)//', 1) || ref WHEN ref = '' THEN head || path || query
    WHEN starts_with(ref, '?') THEN head || path || ref WHEN starts_with(ref, '/') THEN head || ref
    ELSE head || CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END || ref END AS target FROM parts),
urls AS (SELECT url, regexp_replace(url, '#.*$', '') AS bare FROM (SELECT u AS url FROM p UNION SELECT target FROM found) WHERE url IS NOT NULL),
normal AS (
  SELECT url, translate(head, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(bare, length(head) + 1) AS node
  FROM (SELECT url, bare, regexp_extract(bare, '^([\s\S]*?://[^/?#]*)', 1) AS head FROM urls)),
edges AS (SELECT DISTINCT a.node AS a, b.node AS b FROM found JOIN normal a ON a.url = source JOIN normal b ON b.url = target WHERE a.node <> b.node),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a, b FROM both_ways UNION SELECT reach.a, e.b FROM reach JOIN both_ways e ON e.a = reach.b),
places AS (
  SELECT DISTINCT host, path FROM p UNION
  SELECT regexp_extract(b, '^[\s\S]*?://([^/?#]*)', 1), regexp_extract(b, '^[\s\S]*?://[^/?#]*([^?#]*)', 1) FROM reach),
fit AS (
  SELECT x.host, x.path, r.rule, r.verdict, row_number() OVER (PARTITION BY x.host, x.path ORDER BY length(r.rule) DESC) AS n
  FROM places x JOIN r ON (x.host = r.rhost OR ends_with(x.host, '.' || r.rhost)) AND starts_with(x.path, r.rpath)),
told AS (
  SELECT reach.a AS node, CASE WHEN bool_or(f.verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict
  FROM reach JOIN fit f ON f.n = 1 AND f.host = regexp_extract(reach.b, '^[\s\S]*?://([^/?#]*)', 1) AND f.path = regexp_extract(reach.b, '^[\s\S]*?://[^/?#]*([^?#]*)', 1)
  GROUP BY 1)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, t.verdict, 'allow') AS verdict
FROM p LEFT JOIN fit f ON f.n = 1 AND p.host = f.host AND p.path = f.path LEFT JOIN normal ON normal.url = p.u LEFT JOIN told t ON t.node = normal.node
"""

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS window
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS window
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN ks WHERE len(w) >= k)),
h AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.window = bw.window AND dw.k = bw.k),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  sha256(coalesce(t.names, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_LOWER_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TEMPLATES = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in licenses.TEMPLATES.items())
OP2_SQL = f"""
WITH tpl(name, text) AS (VALUES {_TEMPLATES}),
tw AS (SELECT name, {_LOWER_WORDS} AS w FROM tpl),
ts AS (SELECT DISTINCT name, size, array_to_string(w[i : i + size - 1], ' ') AS sh, CASE WHEN len(w) - 4 <= 3 THEN 2 WHEN len(w) - 4 <= 9 THEN 8 WHEN len(w) - 4 <= 33 THEN 32 WHEN len(w) - 4 <= 129 THEN 128 ELSE 512 END AS s
  FROM (SELECT name, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM (SELECT name, w, least(5, len(w)) AS size FROM tw))),
tn AS (SELECT name, any_value(s) AS s, count(*) AS n FROM ts GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, {_LOWER_WORDS} AS w FROM documents),
h AS (SELECT r, name, i, sh FROM (SELECT r, size, i, array_to_string(w[i : i + size - 1], ' ') AS sh
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d JOIN (SELECT DISTINCT size FROM ts) ON len(w) >= size)) JOIN ts USING (size, sh)),
m AS (SELECT a.r, a.name, a.i, CAST(count(DISTINCT b.sh) AS DOUBLE) / any_value(n) AS share FROM h a JOIN tn ON tn.name = a.name JOIN h b ON b.r = a.r AND b.name = a.name AND b.i >= a.i AND b.i < a.i + 2 * tn.s GROUP BY 1, 2, 3),
f AS (SELECT r, name, max(share) AS share FROM m WHERE share >= 0.8 GROUP BY 1, 2),
g AS (SELECT r, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names, max(share) AS share FROM f GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_licenses, coalesce(names, '') AS licenses, coalesce(share, 0.0) AS best_containment FROM d LEFT JOIN g USING (r)
"""

#: Targets in closed form: in the order of limit over weight, the first source whose share is within its limit ends the capping.
OP11_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    sha256('11:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || text, '')) AS x FROM documents),
h AS (SELECT doc_id, source, size, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h, CAST('0x' || substr(x, 9, 8) AS BIGINT) | 1 AS step FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM h GROUP BY 1),
w AS (SELECT *, (ARRAY[5, 2, 1])[1 + (row_number() OVER (ORDER BY source IS NULL, encode(coalesce(source, ''))) - 1) % 3] AS weight FROM s),
o AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS free,
    row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source) AS place
  FROM w WINDOW before AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stop AS (SELECT place, rest, free FROM o WHERE 3 * source_size * free >= rest * weight ORDER BY place LIMIT 1),
t AS (
  SELECT o.source, source_size, CASE WHEN f.place IS NULL OR o.place < f.place THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(f.rest AS DOUBLE) * weight / CAST(f.free AS DOUBLE) END AS target
  FROM o LEFT JOIN stop f ON true),
r AS (SELECT *, coalesce(target / nullif(source_size, 0), 0.0) AS rate FROM t),
k AS (
  SELECT h.*, source_size, target, seed, CAST(floor(rate) AS BIGINT) + CAST((h + seed * step) % 4294967296 < (rate - floor(rate)) * 4294967296.0::DOUBLE AS BIGINT) AS copies
  FROM h JOIN r ON h.source IS NOT DISTINCT FROM r.source CROSS JOIN (SELECT unnest(range({mixture.SEEDS})) AS seed)),
best AS (
  SELECT source, arg_min(seed, (off, seed)) AS seed FROM (SELECT source, seed, abs(CAST(sum(copies * size) AS DOUBLE) - any_value(target)) AS off FROM k GROUP BY 1, 2) GROUP BY 1)
SELECT doc_id, size, source_size, target, copies * size AS taken, k.source, copies FROM k JOIN best ON k.source IS NOT DISTINCT FROM best.source AND k.seed = best.seed
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT doc_id, n, form, text, coalesce(array_to_string(u[1 : a], ''), '') AS p, coalesce(array_to_string(u[a + 1 : b], ''), '') AS m, coalesce(array_to_string(u[b + 1 : n], ''), '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(p || m || s) AS restored_sha256
FROM c
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_shards": op1_token_shards,
    "op2_license_scan": op2_license_scan,
    "op3_toxicity": op3_toxicity,
    "op4_url_filter": op4_url_filter,
    "op5_sharding": op5_sharding,
    "op6_decontamination": op6_decontamination,
    "op7_ann": op7_ann,
    "op8_quality": op8_quality,
    "op9_simhash": op9_simhash,
    "op10_bpe": op10_bpe,
    "op11_mixture": op11_mixture,
    "op12_infill": op12_infill,
}

ORACLES: dict[str, str] = {"op2_license_scan": OP2_SQL, "op4_url_filter": OP4_SQL, "op6_decontamination": OP6_SQL, "op11_mixture": OP11_SQL, "op12_infill": OP12_SQL}
