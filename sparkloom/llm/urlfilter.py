"""URL filters with redirect equivalence, with DataFrame operations only.

Rules allow or block a host with its subdomains and a path prefix; the longest rule that fits a URL decides. URLs that no rule
fits take over what rules say of their aliases: redirects and canonical links join URLs into components, found distributedly,
and a block anywhere in a component reaches every alias that no rule allows itself. An explicit allow thus always precedes.

Links come from the pages (``<link rel="canonical">`` and meta refresh, resolved against the page's URL or its ``<base>``) and from
tables of redirects. URLs are the same when they differ in the case of scheme and host or in the fragment, and else only by a link;
``variants`` also joins those that sites usually redirect to one another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.components import connected_components
from sparkloom.storage import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path) of the rules that the query judges by.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The URL with scheme and host in lower case and without a fragment; null for null, or without ``://``."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), _UPPER, _LOWER)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(scheme, F.lit("://"), host_of(url), rest))


def variant_of(url: Column) -> Column:
    """The form that variants of a URL (scheme, ``www.`` and ``m.`` hosts, query, ``.html``, final slash) have in common; null where there is no host."""
    host, path = F.regexp_replace(host_of(url), r"^(?:www|m)\.", ""), F.regexp_replace(path_of(url), r"(?:/+|/?index\.html?|\.html?)$", "")
    return F.when(host_of(url) != "", F.concat(F.lit("canonical://"), host, path))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is written into the expression once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _without_dots(path: Column) -> Column:
    """A path (from its first slash) without ``.`` and ``..`` segments."""
    up = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))

    def cut(parts: Column) -> Column:
        kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"), up)
        # A path that ends in a dot segment names a folder.
        folder = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.lit("/"), F.array_join(F.concat(kept, folder), "/"))

    return _let(path, lambda p: F.when(F.contains(p, F.lit("/.")), _let(F.split(p, "/", -1), cut)).otherwise(p))


def resolve(base: Column, link: Column) -> Column:
    """The URL that ``link`` stands for on a page at ``base``; null for null, empty and fragment links, and where there is no ``://``."""

    def absolute(at: Column, to: Column) -> Column:
        scheme, site = F.regexp_extract(at, r"(?s)^(.*?)://", 1), F.regexp_extract(at, r"(?s)^(.*?://[^/?#]*)", 1)
        folder = F.regexp_extract(path_of(at), r"(?s)^(.*/)", 1)
        return (
            F.when((to == "") | to.startswith("#"), F.lit(None).cast("string"))
            .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), to)
            .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
            .when(to.startswith("/"), F.concat(site, to))
            .when(to.startswith("?"), F.concat(site, path_of(at), to))
            .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), to))
        )

    def clean(full: Column) -> Column:
        found = F.concat(F.regexp_extract(full, r"(?s)^(.*?://[^/?#]*)", 1), _without_dots(path_of(full)), F.regexp_extract(full, r"(?s)^.*?://[^?#]*(.*)", 1))
        return F.when(F.contains(full, F.lit("://")), found)

    plain = F.regexp_replace(F.trim(F.regexp_replace(link, r"[\t\r\n]", "")), "&(?:amp|#38|#[xX]26);", "&")
    return _let(base, lambda at: _let(_let(plain, lambda to: absolute(at, to)), clean))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The fitting rule with the longest host and path as a struct (length, rule, verdict), or null; allow wins a tie."""
    fits = []
    for verdict, h, p in rules:
        fit = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        fits.append(F.when(fit, F.struct(F.lit(len(h) + len(p)).alias("length"), F.lit(int(verdict == "allow")).alias("allows"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length: int, allows: int, rule: string, verdict: string>")


def page_links(pages: DataFrame) -> DataFrame:
    """(u, v): each page's URL with its canonical link and with the target of its meta refresh, as nodes."""
    html, url = F.col("html"), F.col("url")

    def tag(pattern: str) -> Column:
        return F.regexp_extract(html, rf"(?is)({pattern}[^>]*>)", 1)

    def href(of: Column) -> Column:
        return F.nullif(F.concat(*[F.regexp_extract(of, rf"(?is)\bhref\s*=\s*{p}", 1) for p in (r'"([^"]*)"', r"'([^']*)'", r"([^\"'\s>]+)")]), F.lit(""))

    link = href(tag(r"<link\b[^>]*\brel\s*=\s*[\"']?canonical\b"))
    refresh = F.nullif(F.regexp_extract(tag(r"<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b"), r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)", 1), F.lit(""))
    found = pages.select(url.alias("url"), href(tag(r"<base\b")).alias("base"), F.array_compact(F.array(link, refresh)).alias("to")).filter(F.size("to") > 0)
    found = found.select("url", F.coalesce(resolve(F.col("url"), F.col("base")), "url").alias("base"), F.explode("to").alias("to"))
    return found.select(node_of(F.col("url")).alias("u"), _let(resolve(F.col("base"), F.col("to")), node_of).alias("v")).filter("u is not null and v is not null")


#: Salts by which blocked components are repeated for the join with their nodes.
SALTS = 16


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, variants: bool = False) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url, html).

    redirects: (u, v), more pairs of equivalent URLs; URLs in them need not be pages, and rules hold for them too. With ``variants``,
    URLs that differ only in what :func:`variant_of` drops are equivalent as well. Null and malformed URLs have an empty host and
    path, fit no rule, have no aliases and are allowed. Repeated rows are judged alike. Other columns are not looked at; an
    empty table gives an empty result.
    """
    links = page_links(pages)
    if redirects is not None:
        more = redirects.select(node_of(F.col("u").cast("string")).alias("u"), node_of(F.col("v").cast("string")).alias("v"))
        links = links.unionByName(more.filter("u is not null and v is not null"))
    if variants:
        ends = pages.select(node_of(F.col("url")).alias("u")).union(links.select("u")).union(links.select("v")).distinct()
        links = links.unionByName(ends.select("u", variant_of(F.col("u")).alias("v")).filter("v is not null"))
    nodes = materialize(connected_components(links), "aliases")
    own = longest_rule(host_of(F.col("node")), path_of(F.col("node")), rules)
    blocked = nodes.filter(own["verdict"] == "block").select("component").distinct()
    blocked = blocked.select("component", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = nodes.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    reached = salted.join(blocked, ["component", "salt"], "left_semi").select(F.col("node").alias("_node"), F.lit(True).alias("_hit"))
    judged = pages.select("page_id", node_of(F.col("url")).alias("_url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # Rows without a URL each have a key of their own, which no node equals, so that they don't meet in one task.
    key = F.coalesce("_url", F.concat(F.lit("\0"), F.xxhash64("page_id").cast("string")))
    judged = judged.withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("_key", key).join(reached, F.col("_key") == F.col("_node"), "left")
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_hit"), "block"), F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"))
