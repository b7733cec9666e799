"""URL filters with redirect equivalence, with DataFrame operations only.

A rule is a host and a path; it fits the host and its subdomains when the path begins
with the rule's, and the longest fitting rule decides. A url without a rule takes the
decision of its aliases: redirects (``meta http-equiv=refresh``) and canonical links join
urls into components, a component with a blocked url blocks its urls that no rule
decides, and an explicit allow anywhere in the component takes precedence over that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lexmill.functions.ordered import ordered_scan
from lexmill.llm.components import connected
from lexmill.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"^(?s)(.*?)://([^/?#]*)([^?#]*)([^#]*)"
#: Rules (verdict, host, path) that the query uses.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Tags that may name another url, what makes them do so, and where. ``canonical`` may be any
#: of the rel tokens.
LINK_TAG, META_TAG = r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>"
CANONICAL = r"(?is)[\s\"'/]rel\s*=\s*(?:\"(?:[^\"]*\s)?canonical(?:\s[^\"]*)?\"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical[\s/>])"
REFRESH = r"(?is)[\s\"'/]http-equiv\s*=\s*[\"']?\s*refresh\b"
HREF = r"(?is)[\s\"'/]href\s*=\s*[\"']?([^\"'\s>]+)"
TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def _part(url: Column, k: int) -> Column:
    found = F.coalesce(F.regexp_extract(url, PARTS, k), F.lit(""))
    return F.translate(found, UPPER, LOWER) if k in (1, 2) else found


def host_of(url: Column) -> Column:
    """Host in lower case; empty without ``://``."""
    return _part(url, 2)


def path_of(url: Column) -> Column:
    return _part(url, 3)


def decide(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null. ``rules`` is a short
    list that becomes part of the expression."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_key(url: Column) -> Column:
    """A url without its fragment, scheme and host in lower case; null without ``://``."""
    key = F.concat(_part(url, 1), F.lit("://"), _part(url, 2), _part(url, 3), _part(url, 4))
    return F.when(url.contains("://"), key)


def resolved(target: Column, base: Column) -> Column:
    """Absolute url of a link on the page ``base``."""
    origin = F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    folder = F.regexp_replace(F.concat(_part(base, 3)), r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(_part(base, 1), F.lit(":"), target))
        .when(target.startswith("/"), F.concat(origin, target))
        .when(target.startswith("?"), F.concat(origin, _part(base, 3), target))
        .when((target == "") | target.startswith("#"), F.lit(None))
        .otherwise(F.concat(origin, folder, target))
    )


def alias_links(url: Column, html: Column) -> Column:
    """Array of the urls that a page names as canonical or redirect targets, in all its tags."""

    def targets(tag: str, kind: str, place: str) -> Column:
        tags = F.filter(F.regexp_extract_all(html, F.lit(tag), 0), lambda t: t.rlike(kind))
        return F.transform(tags, lambda t: F.regexp_extract(t, place, 1))

    every = F.concat(targets(LINK_TAG, CANONICAL, HREF), targets(META_TAG, REFRESH, TARGET))
    found = F.transform(every, lambda t: url_key(resolved(F.replace(t, F.lit("&amp;"), F.lit("&")), url)))
    named = html.rlike("(?i)canonical|refresh") & url.contains("://")  # most pages name none
    return F.when(named, F.filter(found, lambda k: k.isNotNull() & (k != url_key(url)))).otherwise(F.array().cast("array<string>"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, edges: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``edges`` may add redirects from elsewhere (columns source, target: absolute urls).
    A url that is null or has no ``://`` has an empty host and path, no aliases, and is
    allowed, as is a url that neither a rule nor an alias decides. A null html names no
    alias. Repeated rows get equal answers; other columns are ignored.
    """
    url = F.col("url")
    rows = pages.select(
        "page_id", host_of(url).alias("host"), path_of(url).alias("path"), url_key(url).alias("_key"), alias_links(url, F.col("html")).alias("_links")
    )
    rows = materialize(rows.withColumn("_own", decide(F.col("host"), F.col("path"), rules)), "pages")
    links = rows.where(F.size("_links") > 0).select(F.col("_key").alias("s"), F.explode("_links").alias("t"))
    if edges is not None:
        links = links.unionByName(edges.select(url_key(F.col("source")).alias("s"), url_key(F.col("target")).alias("t")))
    links = materialize(links.where("s is not null and t is not null and s <> t").distinct(), "links")
    own = F.col("_own.verdict")
    if links.isEmpty():
        verdict = F.coalesce(own, F.lit("allow"))
        return rows.select("page_id", "host", "path", F.col("_own.rule").alias("rule"), verdict.alias("verdict"))
    names = materialize(links.select(F.col("s").alias("key")).unionByName(links.select(F.col("t").alias("key"))).distinct(), "urls")
    numbered = materialize(ordered_scan(names, [], ["key"], {"n": ("row_number",)}).withColumn("n", F.col("n").cast("long")), "urls")
    a = numbered.select(F.col("key").alias("s"), F.col("n").alias("a"))
    b = numbered.select(F.col("key").alias("t"), F.col("n").alias("b"))
    roots = connected(links.join(a, "s").join(b, "t").select("a", "b"))
    members = materialize(numbered.join(roots, numbered.n == roots.node).select("key", "root"), "members")
    ruled = members.withColumn("_v", decide(host_of(F.col("key")), path_of(F.col("key")), rules)["verdict"])
    groups = ruled.groupBy("root").agg(F.max(F.col("_v") == "block").alias("blocked"), F.max(F.col("_v") == "allow").alias("allowed"))
    spread = members.join(groups, "root").where("blocked and not coalesce(allowed, false)").select(F.col("key").alias("_key"), F.lit("block").alias("_alias"))
    out = rows.join(spread, "_key", "left")
    verdict = F.coalesce(own, F.col("_alias"), F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("_own.rule").alias("rule"), verdict.alias("verdict"))
