"""URL rules, and block decisions that follow redirects and canonical links to every alias of a page.

Only DataFrame and SQL functions. Pages whose urls a redirect or a canonical link joins are aliases; distributed
connected components over those edges find them. A page that a rule fits gets that rule's verdict. A page that none
fits is blocked if an alias of it is blocked by a rule, unless an alias is allowed by one: explicit allow precedes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Up to so many rules are tried as one expression; more are joined on the host's suffixes.
EXPRESSION_RULES = 256


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or where there is none."""
    return common.ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def ruled(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """pages (with host, path) and rule, rule_verdict: the longest rule that fits (ties: allow), else null.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    order = sorted(set(rules), key=lambda r: (-len(r.text), r.verdict, r.text))
    if len(order) <= EXPRESSION_RULES:
        if not order:
            return pages.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
        text = verdict = None
        for r in order:
            ok = _fits(r, F.col("host"), F.col("path"))
            text = F.when(ok, r.text) if text is None else text.when(ok, r.text)
            verdict = F.when(ok, r.verdict) if verdict is None else verdict.when(ok, r.verdict)
        return pages.withColumns({"rule": text, "rule_verdict": verdict})
    # A host's suffixes are its labels. A path meets, by equality, its own beginnings of such lengths as the rules of the
    # suffix have, so a host with any number of rules is never one row.
    spark = pages.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.text, r.verdict) for r in order], "r_host string, r_path string, rule string, rule_verdict string")
    pairs = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = table.groupBy("r_host").agg(F.collect_set(F.length("r_path")).alias("lengths"))
    met = pairs.join(pairs.select("host").distinct().select("host", F.explode(suffixes).alias("r_host")).join(lengths, "r_host"), "host")
    tried = met.select("host", "path", "r_host", F.explode("lengths").alias("n")).where("length(path) >= n").select("host", "path", "r_host", F.expr("substring(path, 1, n)").alias("r_path"))
    best = tried.join(table, ["r_host", "r_path"]).groupBy("host", "path").agg(F.min(F.struct(-F.length("rule"), "rule_verdict", "rule")).alias("_best"))
    return pages.join(best, ["host", "path"], "left").withColumns({"rule": F.col("_best.rule"), "rule_verdict": F.col("_best.rule_verdict")}).drop("_best").select(*pages.columns, "rule", "rule_verdict")


def normal_url(url: Column) -> Column:
    """The form in which urls are compared: without surrounding white space and fragment, scheme and host A-Z lower-cased."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.regexp_extract(bare, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.concat(common.ascii_lower(head), F.substring(bare, F.length(head) + 1, F.length(bare)))


def unescaped(text: Column) -> Column:
    """HTML's character references read once: numbers, and the names amp, lt, gt, quot and apos. Others stay as they are."""
    parts = F.split(text, "&")
    names = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}

    def read(p: Column) -> Column:
        digits, hexed = F.regexp_extract(p, r"^#([0-9]{1,7});?", 1), F.regexp_extract(p, r"^#[xX]([0-9a-fA-F]{1,6});?", 1)
        code = F.when(digits != "", digits.cast("int")).when(hexed != "", F.conv(hexed, 16, 10).cast("int"))
        able = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        rest = F.regexp_replace(p, r"^#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});?", "")
        out = F.when(able, F.concat(F.decode(F.unhex(F.lpad(F.hex(F.when(able, code).otherwise(1).cast("long")), 8, "0")), "UTF-32"), rest))
        for name, char in names.items():
            out = out.when(p.startswith(f"{name};"), F.concat(F.lit(char), F.substring(p, len(name) + 2, 1 << 30)))
        return out.when(p.rlike("^amp(?![=0-9A-Za-z;])"), F.concat(F.lit("&"), F.substring(p, 4, 1 << 30))).otherwise(F.concat(F.lit("&"), p))

    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), read), ""))


def _without_dots(path: Column) -> Column:
    """A path that begins with a slash, without the segments . and .. (RFC 3986, 5.2.4)."""
    segments = F.split(F.substring(path, 2, 1 << 30), "/")
    none = F.array().cast("array<string>")
    kept = F.aggregate(segments, none, lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    ends = F.when(F.element_at(segments, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), ends)).otherwise(path)


def resolved(base: Column, target: Column) -> Column:
    """A reference against the url of its page (RFC 3986, 5.2), without a fragment; null if the base has no ://, and the
    reference no scheme."""
    ref = F.regexp_replace(F.trim(target), "(?s)#.*$", "")
    head, query = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(base, r"(?s)^[^?#]*(\?[^#]*)", 1)
    path = path_of(base)
    ref_path, ref_query = F.regexp_extract(ref, r"(?s)^([^?]*)", 1), F.regexp_extract(ref, r"(?s)^[^?]*(\?.*)$", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, "(?s)^(.*/)", 1))
    whole = lambda url: F.concat(F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), _without_dots(path_of(url)), F.regexp_extract(url, r"(?s)^[^?]*(\?.*)$", 1))
    scheme = F.regexp_extract(base, "(?s)^(.*?:)//", 1)
    within = F.when(ref == "", F.concat(head, path, query)).when(ref_path == "", F.concat(head, path, ref_query)).when(ref.startswith("/"), F.concat(head, _without_dots(ref_path), ref_query)).otherwise(F.concat(head, _without_dots(F.concat(folder, ref_path)), ref_query))
    absolute = F.when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), whole(ref)).when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
    return F.coalesce(absolute, F.when(head != "", F.when(ref.startswith("//"), whole(F.concat(scheme, ref))).otherwise(within)))


def _attribute(tag: Column, name: str) -> Column:
    """The value that a tag gives an attribute, whichever way it is quoted; empty without one."""
    pattern = rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source, target): every canonical link and every meta refresh that the html states.

    Targets are unescaped and resolved against the page's url, or against its base element where it has one. A rel of
    several words counts if one of them is canonical. Only pages that hold such a tag are taken apart. Nulls give no edges.
    """
    url, html = F.col(url_col), F.col(html_col)
    some = pages.where(url.isNotNull() & html.isNotNull() & html.rlike(r"(?is)<(?:link\b[^>]*canonical|meta\b[^>]*refresh)"))
    base = F.regexp_extract(html, r"(?is)<base\b[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    tag, value = F.col("tag"), F.col("value")
    # One step at a time, each a generator: the optimizer would else write a step's expression out at each of its uses.
    step = lambda df, keep, c, name: df.select(*keep, F.explode(F.array(c)).alias(name))
    found = some.select(url.alias("source"), base.alias("base"), F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("tag"))
    canonical = tag.rlike("(?i)^<link") & F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical")
    refresh = tag.rlike("(?i)^<meta") & (F.lower(F.trim(_attribute(tag, "http-equiv"))) == "refresh")
    found = step(found, ["source", "base", refresh.alias("moved")], F.when(canonical, _attribute(tag, "href")).when(refresh, _attribute(tag, "content")), "value").where("value <> ''")
    found = step(found, ["source", "moved", "value"], unescaped(F.col("base")), "base")
    found = step(found, ["source", "moved", "base"], unescaped(value), "value")
    found = step(found, ["source", "base"], F.when(F.col("moved"), F.regexp_extract(value, r"(?is)^[^\"'=]*?\burl\s*=\s*[\"']?\s*([^\"']*)", 1)).otherwise(value), "target").where("trim(target) <> ''")
    found = step(found, ["source", "target"], F.when(F.col("base") == "", F.trim("source")).otherwise(F.coalesce(resolved(F.trim("source"), F.col("base")), F.trim("source"))), "base")
    found = step(found, ["source"], resolved(F.col("base"), F.col("target")), "target")
    return found.select(normal_url(F.col("source")).alias("source"), normal_url(F.col("target")).alias("target")).where("target is not null and source <> target")


def judged(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict and how it came about (via: rule, alias or default) of every page.

    redirects: further edges (source, target) between urls, e.g. from a crawl log. A null url, or one without ://, has
    an empty host and path, fits no rule and gets the default. Repeated pages are each judged; an empty table gives an
    empty result; other columns are ignored.

    Edges come from a column-pruned scan of the html; components run over linked urls only, so pages that nothing links
    cost no shuffle beyond one left join, and none where there are no edges at all.
    """
    shaped = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    marked = ruled(shaped.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}), rules)
    edges = link_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.union(redirects.select(normal_url(F.col("source")), normal_url(F.col("target"))).where("source is not null and target is not null"))
    edges = common.written(edges.distinct(), "url-edges")
    own = F.col("rule_verdict")
    if edges.limit(1).count() == 0:
        return marked.select("page_id", "host", "path", "rule", F.coalesce(own, F.lit(default)).alias("verdict"), F.when(own.isNotNull(), "rule").otherwise("default").alias("via"))
    parts = common.connected_components(edges, "source", "target")
    # A rule can fit a url that is only linked to, so verdicts are taken over the linked urls themselves.
    nodes = ruled(parts.withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))}), rules)
    by_part = nodes.groupBy("component").agg(F.bool_or(F.col("rule_verdict") == "block").alias("blocked"), F.bool_or(F.col("rule_verdict") == "allow").alias("allowed"))
    inherited = parts.join(by_part, "component").where("coalesce(blocked, false) or coalesce(allowed, false)").select(F.col("node").alias("_url"), F.when(F.coalesce("allowed", F.lit(False)), "allow").otherwise("block").alias("alias_verdict"))
    met = marked.withColumn("_url", normal_url(F.col("url"))).join(inherited, "_url", "left")
    return met.select("page_id", "host", "path", "rule", F.coalesce(own, "alias_verdict", F.lit(default)).alias("verdict"), F.when(own.isNotNull(), "rule").when(F.col("alias_verdict").isNotNull(), "alias").otherwise("default").alias("via"))
