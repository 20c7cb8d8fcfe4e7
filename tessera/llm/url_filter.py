"""URL filters with redirect equivalence.

Rules decide the urls they fit. Pages that name another address (canonical link, meta refresh) or
that are given as redirects are joined by edges; decisions spread through connected components to
urls without a rule of their own: allow if any member is explicitly allowed, else block if any is
blocked. Urls that no decision reaches are allowed.

A url's node is its host and what follows, without scheme and fragment. Hosts are lower-cased (A-Z).

Edge cases: null urls and urls without "://" have empty host and path, no node and no edges, and are
allowed; null html has no links; relative link targets other than "/..." and "//..." are resolved
only if absolute and otherwise ignored; repeated pages are judged row by row; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.llm.graph import components

#: (verdict, host, path): what the query applies.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, node) of a url; node is null without "://"."""
    whole = F.instr(url, "://") > 0
    rest = F.when(whole, F.regexp_extract(url, r"^[\s\S]*?://([\s\S]*)$", 1)).otherwise("")
    raw = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.translate(raw, UPPER, LOWER)
    tail = F.regexp_extract(rest, r"^[^/?#]*([\s\S]*)$", 1)
    path = F.regexp_extract(tail, r"^([^?#]*)", 1)
    node = F.when(whole, F.concat(host, F.regexp_extract(tail, r"^([^#]*)", 1)))
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit("")), node


def decide(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, quoted either way or bare."""
    found = F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*("([^"]*)"|'([^']*)'|[^\s"'>]+)""", 1)
    return F.trim(F.regexp_replace(found, r"""^["']|["']$""", ""))


def targets(html: Column) -> Column:
    """The addresses a page names as its canonical or refreshed self (array, maybe empty strings)."""
    canonical = F.regexp_extract(html, r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>""", 0)
    refresh = F.regexp_extract(html, r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""", 0)
    moved = F.regexp_extract(refresh, r"""(?is)\burl\s*=\s*['"]?([^"'>\s]+)""", 1)
    return F.array(_attribute(canonical, "href"), moved)


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): nodes of pages and of the addresses that their html names."""
    _, _, node = parts(F.col("url"))
    host = F.regexp_extract(F.col("node"), r"^([^/?#]*)", 1)
    found = pages.where(F.instr("url", "://") > 0).select(node.alias("node"), F.explode(targets(F.coalesce("html", F.lit("")))).alias("to")).where("to <> ''")
    absolute = F.when(F.instr("to", "://") > 0, F.col("to")).when(F.col("to").startswith("//"), F.concat(F.lit("x:"), "to")).when(F.col("to").startswith("/"), F.concat(F.lit("x://"), host, "to"))
    return found.select(F.col("node").alias("a"), parts(absolute)[2].alias("b")).where("b IS NOT NULL AND a <> b")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict; redirects: (from_url, to_url) known beside the pages."""
    host, path, node = parts(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"), node.alias("node"))
    rule, verdict = decide(F.col("host"), F.col("path"), rules)
    seen = seen.withColumns({"rule": rule, "own": verdict})
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(parts(F.col("from_url"))[2].alias("a"), parts(F.col("to_url"))[2].alias("b")).where("a <> b"))
    edges = written(edges.distinct())
    labels = components(edges)
    h, p, _ = parts(F.concat(F.lit("x://"), F.col("id")))
    members = labels.select("id", "component", decide(h, p, rules)[1].alias("v"))
    spread = members.groupBy("component").agg(F.max((F.col("v") == "allow").cast("int")).alias("allow"), F.max((F.col("v") == "block").cast("int")).alias("block"))
    reached = spread.where("allow = 1 OR block = 1").select("component", F.when(F.col("allow") == 1, F.lit("allow")).otherwise("block").alias("spread"))
    alias = members.join(reached, "component").select(F.col("id").alias("node"), "spread")
    return seen.join(alias, "node", "left").select("page_id", "host", "path", "rule", F.coalesce("own", "spread", F.lit("allow")).alias("verdict"))


#: The same in DuckDB SQL, with the components as a recursive closure.
ORACLE = r"""
WITH RECURSIVE rules(verdict, h, p) AS (VALUES ('block','com','/en/'),('allow','example.com','/en/7'),('allow','net','/de/'),('block','example.net','/de/8'),('block','org','/es/')),
u AS (SELECT page_id, html, CASE WHEN instr(url,'://')>0 THEN substr(url, instr(url,'://')+3) ELSE '' END AS rest, instr(url,'://')>0 AS whole FROM pages),
s AS (SELECT page_id, html, coalesce(whole, false) AS whole, translate(regexp_extract(coalesce(rest,''),'^([^/?#]*)',1),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') AS host,
  substr(coalesce(rest,''), length(regexp_extract(coalesce(rest,''),'^([^/?#]*)',1))+1) AS tail FROM u),
n AS (SELECT page_id, html, host, regexp_extract(tail,'^([^?#]*)',1) AS path, CASE WHEN whole THEN host || regexp_extract(tail,'^([^#]*)',1) END AS node FROM s),
t AS (SELECT node, host, trim(regexp_replace(regexp_extract(regexp_extract(html,'(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>',0),'(?is)\bhref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)',1),'^["'']|["'']$','','g')) AS target FROM n
  UNION ALL SELECT node, host, regexp_extract(regexp_extract(html,'(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>',0),'(?is)\burl\s*=\s*[''"]?([^"''>\s]+)',1) FROM n),
x AS (SELECT node AS a, CASE WHEN instr(target,'://')>0 THEN substr(target, instr(target,'://')+3) WHEN target LIKE '//%' THEN substr(target,3) WHEN target LIKE '/%' THEN host || target END AS r FROM t WHERE node IS NOT NULL AND target <> ''),
e AS (SELECT DISTINCT a, translate(regexp_extract(r,'^([^/?#]*)',1),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') || regexp_extract(substr(r, length(regexp_extract(r,'^([^/?#]*)',1))+1),'^([^#]*)',1) AS b FROM x WHERE r IS NOT NULL),
both_ AS (SELECT a, b FROM e WHERE a<>b UNION SELECT b, a FROM e WHERE a<>b),
reach AS (SELECT a AS id, b AS other FROM both_ UNION SELECT reach.id, both_.b FROM reach JOIN both_ ON reach.other = both_.a),
near AS (SELECT id, other, regexp_extract(other,'^([^/?#]*)',1) AS host, regexp_extract(substr(other, length(regexp_extract(other,'^([^/?#]*)',1))+1),'^([^?#]*)',1) AS path FROM reach UNION ALL SELECT DISTINCT id, id, regexp_extract(id,'^([^/?#]*)',1), regexp_extract(substr(id, length(regexp_extract(id,'^([^/?#]*)',1))+1),'^([^?#]*)',1) FROM reach),
spread AS (SELECT id, CASE WHEN bool_or(v='allow') THEN 'allow' WHEN bool_or(v='block') THEN 'block' END AS v FROM (SELECT id, (SELECT r.verdict FROM rules r WHERE (near.host=r.h OR ends_with(near.host,'.'||r.h)) AND starts_with(near.path,r.p) ORDER BY length(r.h||r.p) DESC LIMIT 1) AS v FROM near) q GROUP BY id)
SELECT n.page_id, n.host, n.path, (SELECT r.h||r.p FROM rules r WHERE (n.host=r.h OR ends_with(n.host,'.'||r.h)) AND starts_with(n.path,r.p) ORDER BY length(r.h||r.p) DESC LIMIT 1) AS rule,
  coalesce((SELECT r.verdict FROM rules r WHERE (n.host=r.h OR ends_with(n.host,'.'||r.h)) AND starts_with(n.path,r.p) ORDER BY length(r.h||r.p) DESC LIMIT 1), spread.v, 'allow') AS verdict
FROM n LEFT JOIN spread ON n.node = spread.id
"""
