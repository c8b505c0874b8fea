"""URL filters with redirect equivalence (operator 10), in DataFrame functions.

A rule (verdict, host, path) fits its host and all subdomains where the url's path starts with the
rule's; the longest rule (host and path together, then the longer host, then allow) decides. Urls that
no rule decides take the method's verdict: pages and the targets of their redirects and canonical
links are aliases, connected components over those edges are one resource, and a block rule on any
alias blocks the others. An explicit allow has precedence: a url with an allow rule of its own stays
allowed, whatever its aliases are. Without a blocked alias the verdict is allow.

Edges: <link rel="canonical" href>, <meta http-equiv="refresh" content="...url=">, and rows of an
optional redirects table (from_url, to_url). Aliases are compared by host and path. Up to
``INLINE`` rules are one expression without a shuffle; more are joined on the host's suffixes.

Null url, or one without "://": host and path empty, no rule fits, no aliases. Null html: no edges.
Repeated pages: one row each. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialise

INLINE = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the registered query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _best(verdict: Column, host: Column, path: Column) -> Column:
    """Sorts by precedence: the greatest decides."""
    return F.struct(
        (F.length(host) + F.length(path)).alias("n"), F.length(host).alias("h"), (verdict == "allow").alias("allow"), F.concat(host, path).alias("rule")
    )


def decide(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds decision (struct, null where no rule fits) to rows with host and path."""
    kind = "decision struct<n: int, h: int, allow: boolean, rule: string>"
    if not rules:
        return df.withColumn("decision", F.lit(None).cast(kind.split(" ", 1)[1]))
    if len(rules) <= INLINE:
        fits = []
        for verdict, host, path in rules:
            under = (F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))
            fits.append(F.when(under & F.startswith(F.col("path"), F.lit(path)), _best(F.lit(verdict), F.lit(host), F.lit(path))))
        return df.withColumn("decision", F.greatest(*fits) if len(fits) > 1 else fits[0])
    table = df.sparkSession.createDataFrame(rules, "verdict string, rule_host string, rule_path string")
    places = df.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hit = places.withColumn("rule_host", F.explode(suffix)).join(table, "rule_host").where(F.startswith("path", "rule_path"))
    best = hit.groupBy("host", "path").agg(F.max(_best(F.col("verdict"), F.col("rule_host"), F.col("rule_path"))).alias("decision"))
    return df.join(best, ["host", "path"], "left")


def link_targets(html: Column) -> Column:
    """Raw targets of the canonical link and of a refresh, an array without nulls."""
    link = F.regexp_extract(html, r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>""", 0)
    canonical = F.regexp_extract(link, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    meta = F.regexp_extract(html, r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""", 0)
    refresh = F.regexp_extract(meta, r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+)""", 1)
    return F.filter(F.array(canonical, refresh), lambda t: t.isNotNull() & (t != ""))


def _resolved(target: Column, host: Column, path: Column) -> Column:
    """host and path, together, of a target as seen from a page."""
    there, its = host_and_path(target)
    bare = F.regexp_extract(target, r"^[^?#]*", 0)
    beside = F.concat(host, F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", "")), bare)
    full = F.concat(F.lit("x:"), target)
    scheme_host, scheme_path = host_and_path(full)
    return (
        F.when(F.startswith(target, F.lit("//")), F.concat(scheme_host, scheme_path))
        .when(F.contains(target, F.lit("://")), F.concat(there, its))
        .when(F.startswith(target, F.lit("/")), F.concat(host, bare))
        .when(bare == "", F.concat(host, path))
        .otherwise(beside)
    )


def judge_pages(
    pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, alias_group (smallest alias)."""
    host, path = host_and_path(F.col(url))
    seen = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html).alias("html"))
    found = seen.where("host <> ''").select("host", "path", F.explode(link_targets(F.col("html"))).alias("target"))
    edges = found.select(F.concat("host", "path").alias("a"), _resolved(F.col("target"), F.col("host"), F.col("path")).alias("b"))
    if redirects is not None:
        ends = [F.concat(*host_and_path(F.col(c))) for c in ("from_url", "to_url")]
        edges = edges.union(redirects.select(ends[0].alias("a"), ends[1].alias("b")).where("a <> '' AND b <> ''"))
    groups = materialise(connected_components(edges), "aliases")
    nodes = groups.select("component", F.regexp_extract("node", r"^[^/]*", 0).alias("host"), F.regexp_extract("node", r"^[^/]*(.*)$", 1).alias("path"))
    blocked = decide(nodes, rules).groupBy("component").agg(F.coalesce(F.bool_or(~F.col("decision.allow")), F.lit(False)).alias("blocked"))
    alias = groups.join(blocked, "component")
    judged = decide(seen.drop("html"), rules).withColumn("node", F.concat("host", "path")).join(alias, "node", "left")
    allow = F.coalesce(F.col("decision.allow"), ~F.coalesce("blocked", F.lit(False)))
    return judged.select(
        "page_id", "host", "path", F.col("decision.rule").alias("rule"), F.when(allow, "allow").otherwise("block").alias("verdict"), F.coalesce("component", "node").alias("alias_group")
    )


SQL = r"""
WITH RECURSIVE u AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
t AS (
  SELECT host, path, regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS target FROM p
  UNION ALL
  SELECT host, path, regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1) FROM p),
e AS (
  SELECT host || path AS a, translate(regexp_extract(substr(target, instr(target, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
         || regexp_extract(substr(target, instr(target, '://') + 3), '^[^/?#]*([^?#]*)', 1) AS b
  FROM t WHERE target <> '' AND instr(target, '://') > 0 AND host <> ''),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(node, other) AS (
  SELECT a, a FROM both_ways UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
ruled AS (
  SELECT n.host, n.path, max(struct_pack(n := length(rhost) + length(rpath), h := length(rhost), allow := verdict = 'allow', rule := rhost || rpath)) AS best
  FROM (SELECT DISTINCT host, path FROM p UNION SELECT DISTINCT regexp_extract(other, '^[^/]*'), regexp_extract(other, '^[^/]*(.*)$', 1) FROM reach) n
  JOIN r ON (n.host = rhost OR n.host LIKE '%.' || rhost) AND starts_with(n.path, rpath) GROUP BY ALL),
alias AS (
  SELECT reach.node, min(reach.other) AS grp, bool_or(coalesce(NOT ruled.best.allow, false)) AS blocked
  FROM reach LEFT JOIN ruled ON ruled.host || ruled.path = reach.other GROUP BY reach.node)
SELECT page_id, p.host, p.path, ruled.best.rule AS rule,
       CASE WHEN coalesce(ruled.best.allow, NOT coalesce(alias.blocked, false)) THEN 'allow' ELSE 'block' END AS verdict,
       coalesce(alias.grp, p.host || p.path) AS alias_group
FROM p LEFT JOIN ruled ON p.host = ruled.host AND p.path = ruled.path LEFT JOIN alias ON alias.node = p.host || p.path
"""
