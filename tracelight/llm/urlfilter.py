"""URL filters whose decisions reach the aliases of an address, in DataFrame functions only.

Rules name a host and the beginning of a path; a rule fits its host and all subdomains,
and the longest that fits an address decides. Addresses that no rule fits are judged by
redirect equivalence: connected components over

* canonical links of a page (`<link rel=canonical>`) and redirects by its header
  (`<meta http-equiv=refresh>`), relative ones against the page, without `..` resolved,
* redirecting addresses, whose query carries a whole address (`?url=https%3A%2F%2F...`),
* addresses with and without tracking parameters (`utm_...`), and
* a table of redirects, if one is given.

An address is its host, path and query; scheme and fragment make no difference. A class
that holds a blocked address is blocked, unless one of it is allowed by a rule; addresses that are
on no page count as well. A rule for the address itself always goes before its class.

Null urls and those without `://` have no address, host or path and are allowed. Null and
empty pages have no links. Rows repeat as they come; columns other than page_id, url
and html are ignored. An empty table gives no row. Hubs, such as one target of a third of
all pages, are never gathered: components() combines minima before it moves them. Only
addresses of blocked classes are joined to the pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import runtime as R
from .graph import components

#: The contract's rules: host, beginning of the path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Query parameters that hold the target of a redirecting address.
TARGETS = "url|uri|to|dest|destination|target|redirect|redirect_url|redirect_uri"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
_NOT_SHOWN = r"(?is)<!--.*?-->|<script\b.*?</script>"
#: Blocked addresses up to which they are broadcast: about 10 MB.
FEW = 50_000


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def address(url: Column) -> Column:
    """Host, path (at least /) and query; null if there is no `://`."""
    p, q = F.regexp_extract(url, _PARTS, 2), F.regexp_extract(url, _PARTS, 3)
    return F.when(F.contains(url, F.lit("://")), F.concat(host(url), F.when(p == "", "/").otherwise(p), F.when(q == "?", "").otherwise(q)))


def untracked(node: Column) -> Column:
    """An address without its tracking parameters."""
    q = F.regexp_replace(F.regexp_extract(node, r"(?s)\?(.*)$", 1), r"(?i)(^|&)utm_[^&]*", "")
    q = F.regexp_replace(q, "^&", "")
    return F.when(F.contains(node, F.lit("utm_")) & F.contains(node, F.lit("?")), F.concat(F.substring_index(node, "?", 1), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))).otherwise(node)


def rule(host_: Column, path_: Column, rules) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    fits = []
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        here = ((host_ == h) | F.endswith(host_, F.lit("." + h))) & F.startswith(path_, F.lit(p))
        fits.append(F.when(here, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, quoted or not."""
    got = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1)
    return F.trim(F.replace(F.regexp_replace(got, r"""^["']|["']$""", ""), F.lit("&amp;"), F.lit("&")))


def _tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)(<{name}\b[^>]{{0,1000}}>)"), 1)


def links(html: Column) -> Column:
    """Targets that a page names as itself, as they are written."""
    shown = F.regexp_replace(html, _NOT_SHOWN, " ")
    # an array of one, so that the page is cleaned once
    def of(page: Column) -> Column:
        canonical = F.transform(F.filter(_tags(page, "link"), lambda t: F.lower(_attribute(t, "rel")) == "canonical"), lambda t: _attribute(t, "href"))
        refresh = F.transform(F.filter(_tags(page, "meta"), lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh"), lambda t: F.trim(F.regexp_extract(_attribute(t, "content"), r"""(?is)^[^;,]*[;,]\s*url\s*=\s*["']?([^"']*)""", 1)))
        return F.concat(canonical, refresh)

    none = F.array().cast("array<string>")
    return F.when(html.rlike("(?i)canonical|refresh"), F.flatten(F.transform(F.array(shown), of))).otherwise(none)


def resolved(link: Column, host_: Column, path_: Column) -> Column:
    """The address that a link on a page names, or null."""
    base = F.concat(F.lit("http://"), host_)
    return address(
        F.when(link.rlike("^(?i)https?://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(base, link))
        .when(link.startswith("?"), F.concat(base, path_, link))
        .when(link.rlike(r"^[^#?/:][^?#/:]*([/?#].*)?$"), F.concat(base, F.regexp_replace(F.when(path_ == "", "/").otherwise(path_), "[^/]*$", ""), link))
    )


def carried(node: Column) -> Column:
    """The address in the query of a redirecting address, or null."""
    value = F.regexp_extract(node, rf"(?i)[?&](?:{TARGETS})=(https?(?::|%3a)(?:/|%2f)(?:/|%2f)[^&]*)", 1)
    return F.when(value != "", address(F.try_url_decode(value)))


def read_pages(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, own (struct rule, verdict), node and aliases of every page."""
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), address(F.col("url")).alias("node"), links(F.coalesce(F.col("html").cast("string"), F.lit(""))).alias("links"))
    named = F.transform("links", lambda x: resolved(x, F.col("host"), F.col("path")))
    aliases = F.concat(named, F.array(untracked(F.col("node")), carried(F.col("node"))))
    return rows.select("page_id", "host", "path", rule(F.col("host"), F.col("path"), rules).alias("own"), "node", F.array_distinct(F.filter(aliases, lambda a: a.isNotNull() & (a != F.col("node")))).alias("aliases"))


def blocked(edges: DataFrame, rules=RULES) -> DataFrame:
    """edges(a, b) of addresses: (node) of every class that holds a blocked address and
    no allowed one."""
    found = components(edges)  # without a row for the roots themselves
    classes = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    url = F.concat(F.lit("http://"), F.col("node"))
    judged = classes.select("node", "root", rule(host(url), path(url), rules)["verdict"].alias("verdict"))
    bad = judged.groupBy("root").agg(F.bool_or(F.col("verdict") == "block").alias("block"), F.bool_or(F.col("verdict") == "allow").alias("allow")).where("block and not coalesce(allow, false)")
    return judged.join(bad.select("root"), "root", "left_semi").where("verdict is null").select("node")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Per page page_id, host, path, rule, verdict and by: rule, class (an alias is blocked)
    or default. redirects(source_url, target_url): known redirects beside those on pages."""
    found = R.stored(read_pages(R.spread(pages), rules), "urls")
    # an alias may have one of its own: from an address with both, to that without either
    edges = found.where(F.size("aliases") > 0).select(F.col("node").alias("a"), F.explode("aliases").alias("b"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(address(F.col("source_url")).alias("a"), address(F.col("target_url")).alias("b")).where("a is not null and b is not null"))
    more = F.array(untracked(F.col("b")), carried(F.col("b")))
    edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.explode(more).alias("b")).where("b is not null and a <> b"))
    bad = R.stored(blocked(edges, rules).withColumn("bad", F.lit(True)), "blocked")
    n = bad.count()
    # rows without address have a key of their own each, not one for all
    key = F.coalesce("node", F.concat(F.lit("\n"), F.col("page_id").cast("string")), F.lit("\n"))
    out = found.withColumn("node", key).join(F.broadcast(bad) if n <= FEW else bad, "node", "left")
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("bad"), "block"), F.lit("allow"))
    by = F.when(F.col("own").isNotNull(), "rule").when(F.col("bad"), "class").otherwise("default")
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), by.alias("by"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(R.table(spark, sf_dir, "pages"))


def _oracle() -> str:
    """Links that are no whole address are left to the tests."""
    low = lambda x: f"translate({x}, '{_UPPER}', '{_LOWER}')"
    h = lambda u: low(f"coalesce(regexp_extract({u}, '{_PARTS}', 1), '')")
    p = lambda u: f"coalesce(regexp_extract({u}, '{_PARTS}', 2), '')"
    q = lambda u: f"coalesce(regexp_extract({u}, '{_PARTS}', 3), '')"
    node = lambda u: f"CASE WHEN contains({u}, '://') THEN {h(u)} || CASE WHEN {p(u)} = '' THEN '/' ELSE {p(u)} END || CASE WHEN {q(u)} = '?' THEN '' ELSE {q(u)} END END"
    rest = r"regexp_replace(regexp_replace(regexp_extract(x, '(?s)\?(.*)$', 1), '(?i)(^|&)utm_[^&]*', '', 'g'), '^&', '')"
    plain = f"CASE WHEN contains(x, 'utm_') AND contains(x, '?') THEN split_part(x, '?', 1) || CASE WHEN {rest} = '' THEN '' ELSE '?' || {rest} END ELSE x END"
    sent = f"regexp_extract(x, '(?i)[?&](?:{TARGETS})=(https?(?::|%3a)(?:/|%2f)(?:/|%2f)[^&]*)', 1)"
    attr = lambda n: rf"""trim(replace(regexp_replace(regexp_extract(tag, '(?is)\s{n}\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1), '^["'']|["'']$', '', 'g'), '&amp;', '&'))"""
    rules = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in RULES)
    judged = lambda t: f"(SELECT {t}.*, r.h || r.p AS rule, r.verdict AS own, row_number() OVER (PARTITION BY {t}.k ORDER BY length(r.h || r.p) DESC) AS best FROM {t} LEFT JOIN (VALUES {rules}) r(h, p, verdict) ON ({t}.host = r.h OR ends_with({t}.host, '.' || r.h)) AND starts_with({t}.path, r.p))"
    return f"""
WITH RECURSIVE pg AS (SELECT row_number() OVER () AS k, page_id, {h('url')} AS host, {p('url')} AS path, {node('url')} AS node, regexp_replace(coalesce(html, ''), '{_NOT_SHOWN}', ' ', 'g') AS html FROM pages),
tags AS (SELECT node, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]{{0,1000}}>')) AS tag FROM pg WHERE node IS NOT NULL),
said AS (SELECT node, CASE WHEN lower({attr('rel')}) = 'canonical' THEN {attr('href')} WHEN lower({attr('http-equiv')}) = 'refresh' THEN trim(regexp_extract({attr('content')}, '(?is)^[^;,]*[;,]\\s*url\\s*=\\s*["'']?([^"'']*)', 1)) END AS link FROM tags),
linked AS (SELECT node AS a, {node('link')} AS b FROM said WHERE regexp_matches(link, '^(?i:https?)://')),
xs AS (SELECT node AS x FROM pg WHERE node IS NOT NULL UNION SELECT b FROM linked),
own AS (SELECT x AS a, {plain} AS b FROM xs UNION SELECT x, {node(f'url_decode({sent})')} FROM xs WHERE {sent} <> ''),
twice AS (SELECT b AS x FROM own WHERE b IS NOT NULL),
own2 AS (SELECT x AS a, {plain} AS b FROM twice UNION SELECT x, {node(f'url_decode({sent})')} FROM twice WHERE {sent} <> ''),
e AS (SELECT a, b FROM linked UNION SELECT a, b FROM own WHERE b IS NOT NULL UNION SELECT a, b FROM own2 WHERE b IS NOT NULL),
sym AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach AS (SELECT DISTINCT a AS s, a AS t FROM sym UNION SELECT s, b FROM reach JOIN sym ON a = t),
nodes AS (SELECT DISTINCT t AS k, regexp_extract('x://' || t, '{_PARTS}', 1) AS host, regexp_extract('x://' || t, '{_PARTS}', 2) AS path FROM reach),
nj AS (SELECT k, own FROM {judged('nodes')} WHERE best = 1),
bad AS (SELECT s FROM reach JOIN nj ON k = t GROUP BY s HAVING bool_or(own = 'block') AND NOT coalesce(bool_or(own = 'allow'), FALSE)),
pj AS (SELECT * FROM {judged('pg')} WHERE best = 1)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN s IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN own IS NOT NULL THEN 'rule' WHEN s IS NOT NULL THEN 'class' ELSE 'default' END AS by
FROM pj LEFT JOIN bad ON s = node
"""


ORACLE = _oracle()
