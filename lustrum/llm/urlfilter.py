"""URL filter with redirect equivalence, DataFrame operations only.

Rules name a host and the start of a path; a rule fits its host and all subdomains, and
the longest that fits decides.  Pages without a rule take the method's verdict: URLs
that a redirect (meta refresh) or a canonical link joins are aliases of each other, and
if some alias in the component is blocked by its rule and none is expressly allowed,
the page is blocked; else it is allowed.

URLs meet as browsers settle them: scheme and host in lower case, no default port, no
fragment, dot segments resolved, character references of the markup read; links within
comments, scripts, styles and templates don't count.  Components are found by star
contraction over the link edges; pages without links aren't shuffled for them beyond one
aggregation by URL.

Defined results: a null url, or one without ``://``, has empty host and path, no rule,
and verdict allow; repeated rows are judged alike, once each; relative link targets
are resolved against the page's own scheme, host and folder; a link whose target has no
page still joins others that name it, and is judged by its own rule; very long values
are read whole; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, durable
from .components import connected_components

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"\A(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"\A(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as it is written, or null."""
    out = F.lit(None).cast("string")
    for name, _ in sorted(rules, key=lambda r: len(r[0])):
        at, _, start = name.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{start}")
        out = F.when(fits, name).otherwise(out)
    return out


def verdict_of(rule: Column, rules: tuple = RULES) -> Column:
    out = F.lit(None).cast("string")
    for name, verdict in rules:
        out = F.when(rule == name, verdict).otherwise(out)
    return out


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): a page's url, and the absolute URL its canonical link or meta refresh names."""
    tag = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
    refresh = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*['"]?([^"'\s>]+)"""
    hinted = pages.where(F.col("url").isNotNull() & F.col("html").rlike(r"(?i)canonical|http-equiv"))
    unseen = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|textarea|noscript)\b.*?(?:</\1\s*>|\z)"
    hinted = hinted.select("url", F.regexp_replace("html", unseen, " ").alias("html"))
    targets = F.concat(F.regexp_extract_all("html", F.lit(tag), 1), F.regexp_extract_all("html", F.lit(refresh), 1))
    named = hinted.select("url", F.explode(targets).alias("to")).where("to != ''")
    url, to = F.col("url"), F.col("to")
    root = F.regexp_extract(url, r"\A(?s:.*?)://[^/?#]*", 0)
    folder = F.regexp_extract(url, r"\A(?s:.*?)://[^/?#]*(?:/[^?#]*/|/)?", 0)
    full = (
        F.when(to.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.startswith("//"), F.concat(F.regexp_extract(url, r"\A([^:/?#]*:)", 1), to))
        .when(to.startswith("/"), F.concat(root, to))
        .when(to.startswith("?") | to.startswith("#"), F.concat(F.regexp_extract(url, r"\A[^?#]*", 0), to))
        .otherwise(F.concat(folder, F.when(folder == root, "/").otherwise(""), to))
    )
    return named.withColumn("to", _read(to)).select(settled(url).alias("a"), settled(full).alias("b"))


#: Character references that URLs in markup use, the ampersand last
_REFERENCES = (("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#47;", "/"), ("&#x2f;", "/"), ("&#58;", ":"), ("&#x3a;", ":"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def _read(value: Column) -> Column:
    """An attribute's value without character references."""
    out = F.trim(value)
    for name, ch in _REFERENCES:
        out = F.regexp_replace(out, f"(?i){name}", ch)
    return F.when(value.contains("&"), out).otherwise(F.trim(value))


def settled(url: Column) -> Column:
    """A URL as those that name the same page are spelled; one without ``://`` is left as it is."""
    scheme = ascii_lower(F.regexp_extract(url, r"\A\s*([^:/?#]*)://", 1))
    host = F.regexp_replace(host_of(url), r":\z", "")
    host = F.when(scheme == "http", F.regexp_replace(host, r":80\z", "")).when(scheme == "https", F.regexp_replace(host, r":443\z", "")).otherwise(host)
    query = F.regexp_extract(url, r"\A[^?#]*(\?[^#]*)", 1)
    path = path_of(url)

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1))
        return F.when(part == ".", done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    parts = F.split(F.substring(path, 2, 1 << 30), "/", -1)
    walked = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    ended = F.when(path.rlike(r"/\.\.?\z") & (walked != ""), "/").otherwise("")
    path = F.when(path == "", "/").when(path.rlike(r"/\.\.?(?:/|\z)"), F.concat(F.lit("/"), walked, ended)).otherwise(path)
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), host, path, query)).otherwise(url)


def filter_urls(pages: DataFrame, redirects: DataFrame | None = None, rules: tuple = RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict.

    ``redirects`` (a, b) adds edges known from elsewhere to those that the pages hold.
    """
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(settled(F.col("a")).alias("a"), settled(F.col("b")).alias("b")))
    found = durable(connected_components(durable(edges.distinct())))
    roots = found.select(F.col("root").alias("node"), "root").distinct()
    members = found.unionByName(roots)
    own = verdict_of(rule_of(host_of(F.col("node")), path_of(F.col("node")), rules), rules)
    judged = members.withColumn("own", own)
    spread = judged.groupBy("root").agg(F.max(F.col("own") == "block").alias("blocked"), F.max(F.col("own") == "allow").alias("allowed"))
    hit = spread.where("coalesce(blocked, false) and not coalesce(allowed, false)").select("root")
    blocked = members.join(hit, "root").select(F.col("node").alias("__alias")).distinct()

    url = F.col("url")
    host, path = host_of(url), path_of(url)
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    out = rows.join(blocked, settled(rows["url"]) == F.col("__alias"), "left")
    method = F.when(F.col("__alias").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "url", "host", "path", "rule", F.coalesce(verdict_of(F.col("rule"), rules), method).alias("verdict"))
