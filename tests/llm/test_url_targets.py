"""Relative and escaped targets of canonical links and refreshes."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from cohortis.llm import urlfilter

BASES = ["http://a.net/b/c/d;p?q", "http://a.net", "http://a.net/x/", "http://a.net?z=1"]
REFS = ["g", "./g", "g/", "/g", "?y=1", "g?y", "g?y/./x", "g;x", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g", "/./g", "/../g", "g.", "..g", "./g/.", "g/./h", "g/../h", "?u=http://z.org/"]


def test_references_resolve_as_rfc_3986_says(spark):
    df = spark.createDataFrame([(b, r) for b in BASES for r in REFS], "b string, r string")
    for row in df.withColumn("got", urlfilter.resolved(F.col("b"), F.col("r"))).collect():
        assert row.got == urljoin(row.b, row.r), row
    whole = {"//g.org/x/../y": "http://g.org/y", "http://z.org/a/../b?q=/../": "http://z.org/b?q=/../"}  # urljoin leaves these
    df = spark.createDataFrame([(BASES[0], r) for r in whole], "b string, r string")
    assert {row.r: row.got for row in df.withColumn("got", urlfilter.resolved(F.col("b"), F.col("r"))).collect()} == whole


def test_references_to_characters(spark):
    cases = {"/a?x=1&amp;y=2": "/a?x=1&y=2", "&#38;&#x26;&#233;&#x1F642;": "&&é🙂", "&amp;amp;&amp;#38;": "&amp;&#38;", "a&b=1&ampx=2&amp": "a&b=1&ampx=2&", "&quot;&lt;&gt;&apos;": "\"<>'", "&#0;&#xD800;&#9999999;": "&#0;&#xD800;&#9999999;", "plain": "plain", "": ""}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string")
    for row in df.withColumn("got", urlfilter.unescaped(F.col("t"))).collect():
        assert row.got == row.want, row


def test_verdicts_follow_relative_and_escaped_targets(spark):
    link = lambda u, more="": f'<html><head>{more}<link rel="canonical" href="{u}"></head></html>'
    moved = lambda u: f'<meta http-equiv="refresh" content="0; url={u}">'
    pages = [(1, "https://bad.net/x/y?k=1&l=2", ""), (2, "https://p.info/1", link("https://bad.net/x/y?k=1&amp;l=2")), (3, "https://p.info/d/2", link("../1")), (4, "https://p.info/d/e", moved("2")), (5, "https://p.info/d/e?v=1", moved("?")), (6, "https://p.info/d/f", link("e", "<base href='/d/'>")), (7, "https://p.info/alone", link("#top"))]
    got = {r.page_id: (r.verdict, r.via) for r in urlfilter.judged(spark.createDataFrame(pages, "page_id long, url string, html string"), [urlfilter.Rule("block", "net", "/")]).collect()}
    assert got == {1: ("block", "rule"), **dict.fromkeys((2, 3, 4, 6), ("block", "alias")), 5: ("allow", "default"), 7: ("allow", "default")}
