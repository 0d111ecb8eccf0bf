"""URL filters with redirect equivalence, in DataFrame operations only.

A url's own rule decides first (the longest that fits). Urls without a rule inherit: those which redirect and
canonical-link edges connect are aliases, and a block rule on any of them blocks every alias that no rule allows.
An explicit allow on a url takes precedence over what its aliases carry. Everything else is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

#: (verdict, rule)
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without it."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. Of equally long ones the first in code-point order wins."""
    out = None
    for verdict, rule in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        name, slash, path_part = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + path_part)
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def url_key(url: Column) -> Column:
    """One key for a document: host, path and query, without scheme and fragment; an empty path is ``/``; null without a host."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), query))


def resolved(base: Column, link: Column) -> Column:
    """``link`` as an absolute url, seen from ``base``."""
    link = F.trim(F.regexp_replace(link, "&amp;", "&"))
    root = F.concat(F.regexp_extract(base, "^[^:/?#]*://", 0), host_of(base))
    return (
        F.when(link.isNull() | (link == ""), F.lit(None).cast("string"))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, "^[^:/?#]*:", 0), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .otherwise(F.concat(root, F.coalesce(F.nullif(F.regexp_extract(path_of(base), "^.*/", 0), F.lit("")), F.lit("/")), link))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """``(source, target)`` urls of canonical links and immediate refreshes in ``html``."""
    head = F.coalesce(F.col("html"), F.lit(""))
    link_tag = F.regexp_extract(head, r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*>", 0)
    meta_tag = F.regexp_extract(head, r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*>", 0)
    value = lambda tag, name: F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1)
    bare = lambda c: F.regexp_replace(c, "^[\"']|[\"']$", "")
    canonical = F.when(head.contains("anonical") | head.contains("ANONICAL"), bare(value(link_tag, "href")))
    refresh = F.when(head.contains("efresh") | head.contains("EFRESH"), bare(F.regexp_extract(bare(value(meta_tag, "content")), r"(?is)url\s*=\s*(.*)$", 1)))
    # written once: the few links that there are, so html is read and searched a single time
    links = written(pages.select(F.col("url").alias("source"), F.explode(F.array(canonical, refresh)).alias("link")).filter("link <> ''"), "links")
    return links.select("source", resolved(F.col("source"), F.col("link")).alias("target"))


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, component`` for every row of ``pages(page_id, url, html)``.

    ``redirects(source, target)`` adds edges seen while crawling. A null url, or one without ``://``, has an empty
    host and path and fits no rule; null html has no links. Repeated rows are judged alike and all returned, an
    empty table gives no rows, and other columns are ignored. ``component`` is the least url key among the aliases,
    null for a page that no edge touches.
    """
    url = F.col("url")
    base = pages.select("page_id", "url", url_key(url).alias("url_key"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = base.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("source", "target"))
    edges = written(edges.select(url_key(F.col("source")).alias("a"), url_key(F.col("target")).alias("b")), "links")
    member = written(components(edges), "aliases")
    at = F.concat(F.lit("x://"), F.col("node"))
    blocked = member.withColumn("v", rule_of(host_of(at), path_of(at), rules)["verdict"]).groupBy("component").agg(F.max(F.coalesce(F.col("v") == "block", F.lit(False))).alias("blocked")).filter("blocked")
    aliases = member.join(blocked, "component", "left").select("node", "component", "blocked")
    # only pages without a rule of their own may inherit
    return judged.join(aliases, judged.url_key == aliases.node, "left").select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", F.when(F.col("blocked"), F.lit("block")), F.lit("allow")).alias("verdict"), "component",
    )
