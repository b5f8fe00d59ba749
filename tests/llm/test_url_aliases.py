"""Aliases at random: chains, hubs, relative links and rules that conflict, against union-find and against the SQL."""

import random

import duckdb
from conftest import same

from cohortis.llm import queries, urlfilter

HOSTS = ["a.net", "www.example.net", "example.com", "de.example.com", "x.org", "plain.info", "Other.INFO", "third.info"]
PATHS = ["/", "/en/1", "/de/1", "/fr/1", "/x/y", "/x/z?q=1&r=2", ""]


def tag(rng, target):
    """A canonical link or a refresh, written in one of the ways that pages write them."""
    quote, target = rng.choice("\"'"), target.replace("&", rng.choice(["&amp;", "&"]))
    if rng.random() < 0.5:
        return f"<LINK {rng.choice(['', 'data-x=1 '])}rel={quote}{rng.choice(['canonical', 'alternate canonical', 'Canonical'])}{quote}\n href={quote}{target}{quote} />"
    return f"<meta http-equiv={quote}refresh{quote} content={quote}{rng.choice(['0; url=', '5;URL='])}{target}{quote}>"


def random_pages(seed):
    """(page_id, url, html) and the edges between normal urls that the html states."""
    rng, rows, edges = random.Random(seed), [], []
    urls = [f"https://{h}{p}" for h in HOSTS for p in PATHS]
    normal = lambda u: "https://" + u[8:].replace(u[8:].split("/")[0], u[8:].split("/")[0].lower(), 1)
    for i in range(140):
        url = rng.choice(urls) + (f"#{i}" if rng.random() < 0.1 else "")
        bare, html = url.split("#")[0], "<html><link rel='stylesheet' href='/s.css'><link rel='nocanonical' href='https://a.net/'><meta name=refresh content='0; url=https://a.net/'>"
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            head, path = bare[: 8 + len(bare[8:].split("/")[0])], bare[8 + len(bare[8:].split("/")[0]) :].split("?")[0]
            kind, to = rng.random(), rng.choice([rng.choice(urls), urls[5]])
            if kind < 0.6:
                html, other = html + tag(rng, to), to
            elif kind < 0.75:
                html, other = html + tag(rng, "/de/1"), head + "/de/1"
            elif kind < 0.9:
                html, other = html + tag(rng, "1"), head + (path.rsplit("/", 1)[0] + "/1" if path else "/1")
            else:
                html, other = html + tag(rng, "?q=1&r=2"), head + path + "?q=1&r=2"
            edges.append((normal(bare), normal(other)))
        rows.append((i, url, html))
    return [*rows, (900, None, "<link rel=canonical href='https://a.net/'>"), (901, "https://plain.info/alone", None), (902, "no url", "")], edges, normal


def expected(rows, edges, normal):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[root(a)] = root(b)

    def rule(url):
        host, _, path = (url or "").partition("://")[2].partition("/")
        if not url or "://" not in url:
            return None
        path = ("/" + path if _ else "").split("?")[0].split("#")[0]
        host = host.split("?")[0].split("#")[0].lower()
        fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.text), default=None)

    kinds = {}
    for node in [*up]:
        if (r := rule(node)) is not None:
            kinds.setdefault(root(node), set()).add(r.verdict)
    out = {}
    for page, url, _ in rows:
        own, alias = rule(url), kinds.get(root(normal(url.split("#")[0])), set()) if url and "://" in url and normal(url.split("#")[0]) in up else set()
        out[page] = (own.text, own.verdict) if own else (None, "allow" if "allow" in alias or not alias else "block")
    return out


def test_aliases_against_union_find_and_sql(spark, tmp_path):
    for seed in (1, 2, 3):
        rows, edges, normal = random_pages(seed)
        df = spark.createDataFrame(rows, "page_id long, url string, html string")
        got = urlfilter.judged(df, queries.URL_RULES)
        want = expected(rows, edges, normal)
        assert {r.page_id: (r.rule, r.verdict) for r in got.collect()} == want
        assert got.where("via = 'alias'").count() > 5
        df.coalesce(1).write.parquet(f"{tmp_path}/{seed}")
        db = duckdb.connect()
        db.sql(f"create view pages as select * from '{tmp_path}/{seed}/*.parquet'")
        same(got.select("page_id", "host", "path", "rule", "verdict"), db.sql(queries.OP4_SQL))


def test_many_rules_of_one_host(spark, monkeypatch):
    rules = [urlfilter.Rule("block" if i % 3 else "allow", h, f"/{'x' * (i % 7)}{i % 50}") for i in range(400) for h in ("a.net", "net")]
    pages = spark.createDataFrame([(i, f"http://{h}/{'x' * (i % 9)}{i % 60}/more", "") for i in range(200) for h in ("a.net", "b.a.net", "c.net", "d.org")], "page_id long, url string, html string")
    want = sorted(map(tuple, urlfilter.judged(pages, rules).collect()))
    monkeypatch.setattr(urlfilter, "EXPRESSION_RULES", 10**6)
    assert sorted(map(tuple, urlfilter.judged(pages, rules).collect())) == want and {r[3] is None for r in want} == {True, False}
