"""URL filters by redirect equivalence: block decisions reach all aliases of a page; explicit allows come first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table
from .components import components

#: Fixed values of the query: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Scheme, host and path. Host: what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to
    `?`, `#` or the end. Null or no `://`: all empty."""
    part = lambda pattern: F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    return F.translate(part(r"(?s)^(.*?)://"), _UPPER, _LOWER), F.translate(part(r"(?s)^.*?://([^/?#]*)"), _UPPER, _LOWER), part(r"(?s)^.*?://[^/?#]*([^?#]*)")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as "verdict text", or null. A rule fits its host and all subdomains, where the path
    starts with the rule's. The rules are a short fixed list, so they become one CASE expression; of two equally long ones the
    allow comes first."""
    found = None
    for said, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, f"{said} {h}{p}") if found is None else found.when(fits, f"{said} {h}{p}")
    return F.lit(None).cast("string") if found is None else found


def node_of(url: Column) -> Column:
    """The url without fragment, scheme and host in lower case: two spellings of one node. Null where there is no `://`."""
    begin = F.translate(F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), _UPPER, _LOWER)
    tail = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(begin, F.coalesce(F.nullif(tail, F.lit("")), F.lit("/"))))


def resolve(link: Column, base: Column) -> Column:
    """An absolute url from a link found on the page `base`."""
    begin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    folder = F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"[^/]*$", "")).otherwise("/")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), link))
        .when(link.startswith("/"), F.concat(begin, link))
        .when((link != "") & ~link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~link.startswith("#"), F.concat(begin, folder, link))
    )


_TAG = r"(?is)<(?:link|meta)\b[^>]*>"
_CANONICAL = r"(?is)\brel\s*=\s*[\"']?\s*canonical\b"
_HREF = r"(?is)\bhref\s*=\s*[\"']?\s*([^\s\"'>]+)"
_REFRESH = r"(?is)\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"
_TARGET = r"(?is)\bcontent\s*=\s*[\"']?[^\"'>]*?url\s*=\s*'?\s*([^\s\"'>]+)"


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(a, b): nodes that a canonical link or a meta refresh in the page, or a recorded redirect (src_url, dst_url), ties. Computed once."""
    tag = pages.select("url", F.explode(F.regexp_extract_all(F.col("html"), F.lit(_TAG), F.lit(0))).alias("tag"))
    link = F.when(F.col("tag").rlike(_CANONICAL), F.regexp_extract("tag", _HREF, 1)).when(F.col("tag").rlike(_REFRESH), F.regexp_extract("tag", _TARGET, 1))
    link = F.regexp_replace(link, "&amp;", "&")
    found = tag.select("url", link.alias("link")).where("link is not null and link != ''").select("url", resolve(F.col("link"), F.col("url")).alias("to"))
    if redirects is not None:
        found = found.unionByName(redirects.select(F.col("src_url").alias("url"), resolve(F.col("dst_url"), F.col("src_url")).alias("to")))
    found = found.distinct().select(node_of(F.col("url")).alias("a"), node_of(F.col("to")).alias("b"))
    shared_dir(pages.sparkSession)
    return found.distinct().checkpoint()


def url_verdicts(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, via.

    A page with a fitting rule gets the rule's verdict (via `rule`). Any other page looks at all nodes that redirects and
    canonical links tie to it, crawled or not: an explicit allow among them allows it, else a block blocks it (via `alias`);
    with neither it is allowed (via `default`). Null urls and urls without `://` have an empty host and path, no aliases and the
    default. Repeated rows stay; rows that share a url share its verdict; null or empty html has no links. Only page_id, url and
    html are read, so further columns do not matter. Empty tables give no rows.
    """
    edges = alias_edges(pages, redirects)
    member = components(edges)
    _, host, path = url_parts(F.col("node"))
    judged = member.select("node", "component", host.alias("host"), path.alias("path"))
    judged = judged.select("node", "component", F.substring_index(rule_of(F.col("host"), F.col("path"), rules), " ", 1).alias("said"))
    decided = judged.groupBy("component").agg(F.when(F.bool_or(F.col("said") == "allow"), "allow").when(F.bool_or(F.col("said") == "block"), "block").alias("alias_verdict"))
    of_node = judged.join(decided, "component").select("node", "alias_verdict")
    _, host, path = url_parts(F.col("url"))
    page = pages.select("page_id", host.alias("host"), path.alias("path"), node_of(F.col("url")).alias("node"))
    page = page.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    page = page.select("page_id", "host", "path", "node", F.substr(F.col("found"), F.instr("found", " ") + 1).alias("rule"), F.substring_index("found", " ", 1).alias("said")).join(of_node, "node", "left")
    return page.select(
        "page_id", "host", "path", "rule",
        F.coalesce("said", "alias_verdict", F.lit("allow")).alias("verdict"),
        F.when(F.col("said").isNotNull(), "rule").when(F.col("alias_verdict").isNotNull(), "alias").otherwise("default").alias("via"),
    )


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


#: The same rows in DuckDB: the components come from a recursive query.
OP3_SQL = r"""
with recursive rules(rule_text, said, h, p) as (
  values ('net/','block','net','/'), ('example.net/en/','allow','example.net','/en/'),
         ('example.com/de/','block','example.com','/de/'), ('org/fr/','allow','org','/fr/')),
links as (
  select url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) as tag from pages),
targets as (
  select url, replace(case when regexp_matches(tag, '(?is)\brel\s*=\s*["'']?\s*canonical\b') then regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?\s*([^\s"''>]+)', 1)
              when regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?\s*refresh\b') then regexp_extract(tag, '(?is)\bcontent\s*=\s*["'']?[^"''>]*?url\s*=\s*''?\s*([^\s"''>]+)', 1) end, '&amp;', '&') as link
  from links),
resolved as (
  select url, case
    when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') then link
    when starts_with(link, '//') then regexp_extract(url, '^(.*?)://', 1) || ':' || link
    when starts_with(link, '/') then regexp_extract(url, '^.*?://[^/?#]*') || link
    when link != '' and not regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') and not starts_with(link, '#')
      then regexp_extract(url, '^.*?://[^/?#]*') || coalesce(nullif(regexp_extract(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '^.*/'), ''), '/') || link end as target
  from targets where link is not null and link != '' and contains(url, '://')),
nodes as (
  select u, lower(regexp_extract(u, '^.*?://[^/?#]*')) || coalesce(nullif(regexp_extract(u, '^.*?://[^/?#]*([^#]*)', 1), ''), '/') as node
  from (select url as u from pages union select target from resolved) where contains(u, '://')),
edges as (select distinct a.node as a, b.node as b from resolved r join nodes a on a.u = r.url join nodes b on b.u = r.target where a.node != b.node),
reach(node, other) as (
  select a, b from edges union select b, a from edges union select a, a from edges union select b, b from edges
  union
  select r.node, e.y from reach r join (select a as x, b as y from edges union select b, a from edges) e on e.x = r.other),
parts as (
  select u, node, regexp_extract(node, '://([^/?#]*)', 1) as h, regexp_extract(node, '://[^/?#]*([^?#]*)', 1) as pa from nodes),
judged as (
  select distinct node, (select r.said from rules r where (parts.h = r.h or ends_with(parts.h, '.' || r.h)) and starts_with(parts.pa, r.p) order by length(r.rule_text) desc limit 1) as said from parts),
alias as (
  select reach.node, case when bool_or(said = 'allow') then 'allow' when bool_or(said = 'block') then 'block' end as verdict
  from reach join judged on judged.node = reach.other group by reach.node),
page as (
  select page_id, url,
    case when contains(url, '://') then lower(regexp_extract(url, '://([^/?#]*)', 1)) else '' end as host,
    case when contains(url, '://') then regexp_extract(url, '://[^/?#]*([^?#]*)', 1) else '' end as path
  from pages),
ruled as (
  select page_id, url, host, path,
    (select r.rule_text from rules r where (page.host = r.h or ends_with(page.host, '.' || r.h)) and starts_with(page.path, r.p) order by length(r.rule_text) desc limit 1) as rule,
    (select r.said from rules r where (page.host = r.h or ends_with(page.host, '.' || r.h)) and starts_with(page.path, r.p) order by length(r.rule_text) desc limit 1) as said
  from page)
select page_id, host, path, rule, coalesce(said, alias.verdict, 'allow') as verdict,
  case when said is not null then 'rule' when alias.verdict is not null then 'alias' else 'default' end as via
from ruled left join (select distinct u, node from nodes) n on n.u = ruled.url left join alias on alias.node = n.node
"""
