"""URL filters: block and allow rules, carried along redirects and canonical links.

A rule is a host and a path prefix. It fits its host and all subdomains; of the rules that fit, the longest
decides. URLs that lead to one another (redirects, canonical links) form classes, found as connected
components. A class with a member that a rule blocks is blocked as a whole, except the members that a rule
allows: an explicit allow always stands. All steps are DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import let, stage
from feedloom.llm.components import connected_components

# The rules of the registered query.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """From behind the first `://` to `/`, `?`, `#` or the end, A-Z in lower case; empty without `://`."""
    found = F.regexp_extract(_after_scheme(url), "^([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From behind the host to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def page_key(url: Column) -> Column:
    """What names a page among aliases: the URL without its fragment, scheme and host in lower case."""
    plain = F.regexp_extract(url, "^([^#]*)", 1)
    at = F.instr(plain, "://")
    scheme = F.translate(F.substring(plain, F.lit(1), at + 2), UPPER, LOWER)
    rest = F.regexp_extract(_after_scheme(plain), "^[^/?#]*((?s).*)$", 1)
    return F.when(at > 0, F.concat(scheme, host_of(plain), rest))


def deciding_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null without one; allow goes first among equals."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(prefix))
        rule = F.when(fits, F.lit(rule_host + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _resolve(target: Column, base: Column) -> Column:
    """A link's target as an absolute URL."""
    scheme = F.regexp_extract(base, "^([^:]*):", 1)
    site = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_replace(path_of(base), "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(F.instr(target, "://") > 0, target)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(site, target))
        .when(target != "", F.concat(site, folder, target))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Edges (source, target) of page keys: canonical links and refresh redirects in the pages' HTML."""
    html = F.coalesce(F.col("html"), F.lit(""))
    link = F.regexp_extract(html, "(?is)<link\\b[^>]*\\brel\\s*=\\s*[\"']?canonical\\b[^>]*>", 0)
    canonical = F.regexp_extract(link, "(?is)\\bhref\\s*=\\s*[\"']?([^\"'\\s>]+)", 1)
    meta = F.regexp_extract(html, "(?is)<meta\\b[^>]*http-equiv\\s*=\\s*[\"']?refresh\\b[^>]*>", 0)
    refresh = F.regexp_extract(meta, "(?is)url\\s*=\\s*[\"']?([^\"'\\s>]+)", 1)
    targets = F.filter(F.array(canonical, refresh), lambda t: t != "")
    found = pages.filter(F.instr(F.col("url"), "://") > 0).select("url", F.explode(targets).alias("target"))
    return found.select(
        page_key(F.col("url")).alias("source"),
        let(F.regexp_replace("target", "&amp;", "&"), lambda t: page_key(_resolve(t, F.col("url")))).alias("target"),
    )


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None
) -> DataFrame:
    """Each row of `pages` (page_id, url, html) with host, path, rule and verdict.

    `rules`: (allow or block, host, path prefix); a short list, kept in the plan. `redirects`: known redirects
    (from_url, to_url), such as those a crawler met; their ends need not be pages. Canonical links and refresh
    redirects in the HTML are added. A URL that no rule decides is blocked when a rule blocks any URL of its
    class, and allowed otherwise.

    A null URL or one without `://` has an empty host and path, no rule, and is allowed. Repeated rows are judged
    alike, each kept. Null HTML has no links; other columns are not read. No pages give no rows.
    """
    edges = page_links(pages)
    if redirects is not None:
        edges = edges.unionByName(
            redirects.select(page_key(F.col("from_url")).alias("source"), page_key(F.col("to_url")).alias("target"))
        )
    edges = stage(edges.filter("source is not null and target is not null").distinct(), "links")
    classes = stage(connected_components(edges, "source", "target"), "classes")
    _, verdict = deciding_rule(host_of(F.col("node")), path_of(F.col("node")), rules)
    blocked = stage(classes.filter(verdict == "block").select("component").distinct(), "blocked")
    aliases = classes.join(blocked, "component", "left_semi").select(F.col("node").alias("_key"), F.lit(True).alias("_alias"))

    judged = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, own = deciding_rule(F.col("host"), F.col("path"), rules)
    judged = judged.select("page_id", "url", "host", "path", rule.alias("rule"), own.alias("_own"))
    joined = judged.withColumn("_key", page_key(F.col("url"))).join(aliases, "_key", "left")
    inherited = F.when(F.col("_alias"), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select("page_id", "url", "host", "path", "rule", F.coalesce("_own", inherited).alias("verdict"))
