"""URL rules with redirect equivalence.

Pages whose url redirects to another (meta refresh) or names another as canonical are
aliases, and so are a url and its plain form: the host without a leading "www." or "m.",
the path without a trailing slash, the query without the parameters that only tell where a
reader came from (``TRACKING``). Aliases are joined into components, and what a rule decides
for one member (page, link target or plain form) counts for the members that no rule fits.
Precedence: a url's own longest rule; else allow if a rule allows any alias; else block if a
rule blocks any; else allow. Ties between rules of equal length go to allow.

Every canonical link and refresh of a page counts; character references in them are decoded.
A vertex is host and path (without "." and ".." segments) with query but no fragment; two
pages with the same vertex are aliases too. Null urls, and those without "://", have an empty
host and path, fit no rule, have no aliases and are allowed. Null html has no links; very long
html is searched whole. Repeated rows are judged each; an empty table gives an empty result;
columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .graph import components


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: Query parameters that do not change what a url shows.
TRACKING = r"(?:utm_\w+|ref|fbclid|gclid)"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
LINK = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*["']?\s*([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, SPLIT, 1), UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def resolved(path: Column) -> Column:
    """A path without its segments "." and ".."."""
    parts = F.split(path, "/", -1)
    step = lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"), step)
    ends = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), ends)).otherwise(path)


NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def decoded(c: Column) -> Column:
    """Text of an attribute: character references by number and those of ``NAMED``, each once."""

    def one(s):
        number = F.when(s.rlike(r"^&#[0-9]{1,7};$"), F.regexp_extract(s, "[0-9]+", 0).cast("long")).when(s.rlike(r"^&#[xX][0-9A-Fa-f]{1,6};$"), F.conv(F.regexp_extract(s, "[xX]([0-9A-Fa-f]+)", 1), 16, 10).cast("long"))
        fits = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(fits, number).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        out = F.when(number.isNotNull(), char)
        for name, x in NAMED.items():
            out = out.when(s == f"&{name};", x)
        return out.otherwise(s)

    pieces = F.regexp_extract_all(c, F.lit(r"(?s)(&#?\w+;|&|[^&]+)"), F.lit(1))
    return F.when(c.contains("&"), F.array_join(F.transform(pieces, one), "")).otherwise(c)


def vertex_of(url: Column) -> Column:
    return F.concat(host_of(url), resolved(path_of(url)), F.coalesce(F.regexp_extract(url, SPLIT, 3), F.lit("")))


def plain_of(vertex: Column) -> Column:
    """A vertex's plain form."""
    host, path, query = (F.regexp_extract(vertex, r"(?s)^([^/?]*)([^?]*)(\?.*)?$", i) for i in (1, 2, 3))
    kept = F.regexp_replace(F.regexp_replace(query, rf"(?<=[?&]){TRACKING}(=[^&]*)?(&|$)", ""), r"[?&]$", "")
    return F.concat(F.regexp_replace(host, r"^(www|m)\.(?=.*\.)", ""), F.regexp_replace(path, r"/+$", ""), kept)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, allow before block where two are equal; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.verdict == "allow")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, r.host + r.path).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def absolute(target: Column, page: Column) -> Column:
    """A link's target as a url; relative ones are taken from the page's folder."""
    scheme, root = F.regexp_extract(page, r"(?s)^(.*?)://", 1), F.regexp_extract(page, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(page, r"(?s)^.*?://[^/?#]*(/(?:[^?#]*/)?)", 1), F.lit("")), F.lit("/"))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .otherwise(F.concat(root, folder, target))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): a page's vertex and one that its html redirects to or names as canonical."""
    targets = F.explode(F.concat(*[F.regexp_extract_all(pages["html"], F.lit(x), F.lit(1)) for x in (LINK, REFRESH)]))
    links = pages.where(pages["url"].contains("://") & (pages["html"].rlike(LINK) | pages["html"].rlike(REFRESH))).select("url", targets.alias("target"))
    links = links.select("url", F.btrim(decoded(F.col("target")), F.lit("\"' \t\r\n")).alias("target")).where("target <> ''")
    return links.select(vertex_of(F.col("url")).alias("a"), vertex_of(absolute(F.col("target"), F.col("url"))).alias("b")).where("a <> b")


def plain_edges(vertices: DataFrame) -> DataFrame:
    """(a, b): each vertex (column a) and its plain form, where that is another."""
    return vertices.select("a", plain_of(F.col("a")).alias("b")).where("a <> b")


def judge(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict; redirects: more edges as columns source and target (urls)."""
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(vertex_of(F.col("source")), vertex_of(F.col("target"))))
    edges = saved(edges, "links")  # html is searched once
    ends = edges.select("a").union(edges.select("b")).union(pages.where(pages["url"].contains("://")).select(vertex_of(pages["url"]).alias("a")))
    member = components(edges.union(plain_edges(ends)))
    cut = F.regexp_extract("node", r"(?s)^([^/?]*)([^?]*)", 1), F.regexp_extract("node", r"(?s)^([^/?]*)([^?]*)", 2)
    named = member.select("node", "root", longest_rule(*cut, rules)[1].alias("said"))
    whole = named.groupBy("root").agg(F.bool_or(F.col("said") == "allow").alias("allows"), F.bool_or(F.col("said") == "block").alias("blocks"))
    found = named.join(whole, "root").select("node", F.when(F.col("allows"), "allow").when(F.col("blocks"), "block").alias("inherited"))
    rows = pages.select("page_id", host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"), vertex_of(pages["url"]).alias("vertex"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", "vertex", rule.alias("rule"), verdict.alias("own"))
    judged = rows.join(found, (rows["vertex"] == found["node"]) & rows["own"].isNull(), "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("own", "inherited", F.lit("allow")).alias("verdict"))
