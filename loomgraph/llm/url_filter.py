"""URL filter by rules, with block decisions spread over redirects and canonical links.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import column, redeal, unwrap, wrap, write_table
from loomgraph.operators.components import connected_components

#: (verdict, host, path): a rule fits its host and all subdomains, if the url's path starts with its path.
RULES = (
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
)

_ATTR = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_CANONICAL = r"""(?is)<link\b(?=[^>]*?\brel\s*=\s*(?:"(?:[^">]*\s)?canonical[\s"]|'(?:[^'>]*\s)?canonical[\s']|canonical(?=[\s/>])))[^>]*>"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*?\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*>"""


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct(rule, verdict) of the longest rule that fits (of equally long ones, the first given), else null."""
    best = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        best = F.when(fits, value) if best is None else best.when(fits, value)
    return best if best is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def match_rule_table(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """(_h, _p, _rule: struct(rule, verdict)) of the ``addresses`` (_h, _p) that some rule of a table (verdict, host, path) fits; the longest wins.

    For rules by the million: each distinct address asks by the suffixes of its host and
    those beginnings of its path that have the length of some rule's path, so a join on
    equal keys finds what ``match_rule`` finds, whatever number of rules a host has. Of
    equal rules the one with the smaller verdict counts.
    """
    known = rules.select("verdict", "host", "path").where("host is not null and path is not null")
    lengths = sorted(r["n"] for r in known.select(F.length("path").alias("n")).distinct().collect())  # no more than the longest path has characters
    labels = F.split("_h", "\\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = addresses.select("_h", "_p").distinct().withColumn("host", F.explode(suffixes))
    asked = asked.withColumn("_n", F.explode(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("_p")))).withColumn("path", F.substring("_p", F.lit(1), F.col("_n")))
    best = F.struct(F.length(F.concat("host", "path")).alias("n"), F.struct(F.concat("host", "path").alias("rule"), "verdict").alias("r"))
    longest = asked.join(redeal(known.groupBy("host", "path").agg(F.min("verdict").alias("verdict")), "host", "path"), ["host", "path"]).groupBy("_h", "_p").agg(F.max(best).alias("b"))
    return longest.select("_h", "_p", F.col("b.r").alias("_rule"))


def _attribute(tag: Column, name: str) -> Column:
    parts = [F.regexp_extract(tag, rf"(?is)\b{name}{_ATTR}", i) for i in (1, 2, 3)]
    return F.concat(*parts)


def link_targets(html: Column) -> Column:
    """Array of the urls that a page names as its canonical form or redirects to (link rel=canonical, meta refresh)."""
    page = F.coalesce(html, F.lit(""))
    canonical = F.transform(F.regexp_extract_all(page, F.lit(_CANONICAL), F.lit(0)), lambda t: _attribute(t, "href"))
    refresh = F.transform(
        F.regexp_extract_all(page, F.lit(_REFRESH), F.lit(0)),
        lambda t: F.regexp_extract(_attribute(t, "content"), r"""(?is)\burl\s*=\s*["']?\s*([^"'\s]+)""", 1),
    )
    return F.filter(F.transform(F.concat(canonical, refresh), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&"))), lambda u: u != "")


def base_href(html: Column) -> Column:
    """The href of the page's first base tag that has one; empty without."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<base\b[^>]*>"), F.lit(0))
    found = F.filter(F.transform(tags, lambda t: F.trim(_attribute(t, "href"))), lambda u: u != "")
    return F.replace(F.coalesce(F.get(found, 0), F.lit("")), F.lit("&amp;"), F.lit("&"))


def without_dots(path: Column) -> Column:
    """A path that begins with ``/`` without its segments ``.`` and ``..``; one at the end leaves a ``/``."""
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))
    step = lambda acc, x: F.when(x == "..", up(acc)).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    parts = F.aggregate(F.split(F.regexp_replace(path, r"(/\.\.?)\z", "$1/"), "/", -1), F.expr("cast(array() as array<string>)"), step)
    return F.when(path.rlike(r"/\.\.?(/|\z)"), F.array_join(parts, "/")).otherwise(path)


def resolved(df: DataFrame, target: str, host: str, path: str) -> DataFrame:
    """``df`` with _host and _path: where the url ``target`` leads from a page at ``host`` and ``path`` (all columns of ``df``).

    Query and fragment are left out. Null for other schemes (mailto:, javascript:), and for a relative
    target on a page without a host. In steps, as each is named more than once by the next.
    """
    t = F.col(target)
    df = df.withColumns({
        "_whole": F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t).when(t.startswith("//"), F.concat(F.lit("x:"), t)),
        "_own": F.when(~t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & (F.col(host) != ""), F.regexp_extract(t, r"(?s)^([^?#]*)", 1)),
        "_folder": F.regexp_extract(path, r"(?s)^(.*/)", 1),
    })
    folder = F.when(F.col("_folder") == "", F.lit("/")).otherwise(F.col("_folder"))
    df = df.withColumns({
        "_host": F.when(F.col("_whole").isNotNull(), url_host(F.col("_whole"))).when(F.col("_own").isNotNull(), F.col(host)),
        "_raw": F.when(F.col("_whole").isNotNull(), url_path(F.col("_whole"))).when(F.col("_own").startswith("/"), F.col("_own")).otherwise(F.concat(folder, "_own")),
    })
    # An empty target is the page itself, whose path stays as it is.
    df = df.withColumn("_path", F.when(F.col("_own") == "", F.col(path)).otherwise(without_dots(F.col("_raw"))))
    return df.drop("_whole", "_own", "_folder", "_raw")


def address(url: Column) -> Column:
    """What identifies a page's address: host and path; null where there is no host."""
    host = url_host(url)
    return F.when(host != "", F.concat(host, url_path(url)))


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): a page's address and that of each redirect or canonical target.

    Relative targets are resolved against the page's base tag, if it has one, or its url.
    """
    found = pages.select(F.col(url).alias("u"), F.col(html).alias("html"), link_targets(F.col(html)).alias("_t")).where(F.size("_t") > 0)
    found = found.select(url_host(F.col("u")).alias("h"), url_path(F.col("u")).alias("p"), base_href(F.col("html")).alias("b"), "_t")
    found = resolved(found, "b", "h", "p")
    based = (F.col("b") != "") & F.col("_host").isNotNull() & (F.col("_host") != "")
    found = found.select("h", "p", F.when(based, F.col("_host")).otherwise(F.col("h")).alias("bh"), F.when(based, F.col("_path")).otherwise(F.col("p")).alias("bp"), F.explode("_t").alias("t"))
    edges = resolved(found.withColumn("t", F.trim("t")), "t", "bh", "bp").where("h <> '' and _host <> ''")
    return edges.select(F.concat("h", "p").alias("a"), F.concat("_host", "_path").alias("b")).where("a is not null and b is not null and a <> b").distinct()


def filter_urls(
    pages: DataFrame, url: str = "url", html: str = "html", rules=RULES, redirects: DataFrame | None = None
) -> DataFrame:
    """``pages`` with host, path, rule, verdict (allow or block) and verdict_by (rule, alias or default).

    A page that a rule fits gets that rule's verdict; an explicit allow therefore
    holds even among blocked aliases. Every other page is blocked if a rule blocks
    any address in its component of redirect and canonical-link edges (also one that
    is only named as a target), else allowed. ``rules``: (verdict, host, path) each, a
    few in a list, or a table of them. ``redirects`` adds edges of its own: columns
    ``from_url`` and ``to_url``. Pages with the same host and path (ties) are one
    address. Null url, or one without ``://``: empty host and path, no rule, allowed.
    Null or empty html: no edges; urls and html may be of any length. Repeated rows are
    judged alike; an empty table stays empty. Columns named like the results are
    replaced, all others pass through, whatever their names. A component that holds a
    third of all addresses is judged by many tasks: only its number and verdict are joined.
    """
    link, page = column(pages, url), column(pages, html)
    slim = pages.select(link.alias("url"), page.alias("html"))
    edges = alias_edges(slim)
    if redirects is not None:
        more = redirects.select(address(F.col("from_url")).alias("a"), address(F.col("to_url")).alias("b"))
        edges = edges.unionByName(more.where("a is not null and b is not null and a <> b")).distinct()
    edges = write_table(edges, "alias-edges")
    groups = write_table(connected_components(edges, "a", "b", contract=False), "alias-groups")
    named = groups.withColumns({"_h": F.regexp_extract("node", r"(?s)^([^/]*)", 1), "_p": F.regexp_extract("node", r"(?s)^[^/]*(.*)$", 1)})
    out = wrap(pages, url_host(link).alias("_h"), url_path(link).alias("_p"))
    if isinstance(rules, DataFrame):
        found = write_table(match_rule_table(out.select("_h", "_p").where("_h <> ''").unionByName(named.select("_h", "_p")), rules), "matched-rules")
        judge = lambda df: df.join(redeal(found, "_h", "_p"), ["_h", "_p"], "left")
    else:
        judge = lambda df: df.withColumn("_rule", match_rule(F.col("_h"), F.col("_p"), rules))
    bad = judge(named).where(F.col("_rule")["verdict"] == "block").select("component").distinct()
    blocked = groups.join(redeal(bad, "component"), "component", "left_semi").select(F.col("node").alias("_node"))
    out = judge(out).join(redeal(blocked, "_node"), F.concat("_h", "_p") == F.col("_node"), "left")
    by_alias = F.when(F.col("_node").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return unwrap(out, pages.columns, {
        "host": F.col("_h"), "path": F.col("_p"), "rule": F.col("_rule")["rule"],
        "verdict": F.coalesce(F.col("_rule")["verdict"], by_alias),
        "verdict_by": F.when(F.col("_rule").isNotNull(), F.lit("rule")).when(F.col("_node").isNotNull(), F.lit("alias")).otherwise(F.lit("default")),
    })


def query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "verdict_by")


def alias_query(spark, sf_dir):
    """The same over a table of redirects, as the pages themselves hold none: each third page leads to the one seven before it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    at = lambda name, k: pages.select(k.alias("k"), F.col("url").alias(name))
    redirects = at("from_url", F.col("page_id") - 7).where((F.col("k") + 7) % 3 == 0).join(at("to_url", F.col("page_id")), "k").select("from_url", "to_url")
    rules = spark.createDataFrame([*RULES, *(("block", f"none{i}.example", "/") for i in range(1000))], "verdict string, host string, path string")
    return filter_urls(pages, rules=rules, redirects=redirects).select("page_id", "host", "path", "rule", "verdict", "verdict_by")


def _sql_rule(column: str, host: str, path: str) -> str:
    whens = [
        f"WHEN ({host} = '{h}' OR suffix({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{h + p if column == 'rule' else v}'"
        for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    ]
    return "CASE " + " ".join(whens) + " END"


_SQL = f"""
WITH RECURSIVE parsed AS (
  SELECT page_id, html,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
),
EDGESboth_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(node, other) AS (SELECT a, a FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
blocked AS (
  SELECT DISTINCT node FROM reach
  WHERE {_sql_rule('verdict', "regexp_extract(other, '^([^/]*)', 1)", "regexp_extract(other, '^[^/]*(.*)$', 1)")} = 'block'
)
SELECT page_id, host, path, {_sql_rule('rule', 'host', 'path')} AS rule,
       coalesce({_sql_rule('verdict', 'host', 'path')}, CASE WHEN b.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN {_sql_rule('rule', 'host', 'path')} IS NOT NULL THEN 'rule' WHEN b.node IS NOT NULL THEN 'alias' ELSE 'default' END AS verdict_by
FROM parsed LEFT JOIN blocked b ON host <> '' AND host || path = b.node
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sql_resolved(name: str, source: str, target: str, host: str, path: str, keep: str) -> str:
    """A table expression: ``resolved`` in SQL."""
    scheme = "^[A-Za-z][A-Za-z0-9+.-]*:"
    dots = (
        "CASE WHEN regexp_matches(raw, '/\\.\\.?(/|$)') THEN array_to_string(list_reduce(list_transform("
        "string_split(regexp_replace(raw, '(/\\.\\.?)$', '\\1/'), '/'), lambda s: [s]), lambda acc, x: "
        "CASE WHEN x[1] = '..' THEN acc[1:greatest(len(acc) - 1, 1)] WHEN x[1] = '.' THEN acc ELSE list_concat(acc, x) END), '/') ELSE raw END"
    )
    return f"""{name}_1 AS (
  SELECT *, CASE WHEN regexp_matches({target}, '{scheme}//') THEN {target} WHEN starts_with({target}, '//') THEN 'x:' || {target} END AS whole,
         CASE WHEN NOT regexp_matches({target}, '{scheme}') AND {host} <> '' THEN regexp_extract({target}, '^([^?#]*)', 1, 's') END AS own,
         regexp_extract({path}, '^(.*/)', 1, 's') AS folder FROM {source}
),
{name}_2 AS (
  SELECT *, CASE WHEN whole IS NOT NULL THEN {_LOWER.format("regexp_extract(whole, '^.*?://([^/?#]*)', 1, 's')")} WHEN own IS NOT NULL THEN {host} END AS t_host,
         CASE WHEN whole IS NOT NULL THEN regexp_extract(whole, '^.*?://[^/?#]*([^?#]*)', 1, 's') WHEN starts_with(own, '/') THEN own
              ELSE (CASE WHEN folder = '' THEN '/' ELSE folder END) || own END AS raw FROM {name}_1
),
{name} AS (SELECT {keep}, t_host, CASE WHEN whole IS NULL AND own = '' THEN {path} ELSE {dots} END AS t_path FROM {name}_2)"""


def _sql_attribute(tag: str, name: str) -> str:
    return " || ".join(f"regexp_extract({tag}, '(?is)\\b{name}\\s*=\\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\\s\"''>]+))', {i})" for i in (1, 2, 3))


# RE2 has no look-ahead: a tag's own attribute says whether it counts.
_TARGETS = f"""tags AS (
  SELECT page_id, host, path, coalesce(html, '') AS page, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM parsed
),
named AS (
  SELECT page_id, host, path, page, replace(CASE WHEN regexp_matches(tag, '(?i)^<link') THEN
      CASE WHEN list_contains(string_split_regex(lower({_sql_attribute('tag', 'rel')}), '\\s+'), 'canonical') THEN {_sql_attribute('tag', 'href')} ELSE '' END
    ELSE CASE WHEN regexp_matches(tag, '(?is)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')
      THEN regexp_extract({_sql_attribute('tag', 'content')}, '(?is)\\burl\\s*=\\s*["'']?\\s*([^"''\\s]+)', 1) ELSE '' END END, '&amp;', '&') AS target
  FROM tags
),
bases AS (
  SELECT * EXCLUDE page, replace(coalesce(list_filter(list_transform(regexp_extract_all(page, '(?is)<base\\b[^>]*>'), lambda t: trim({_sql_attribute('t', 'href')})), lambda u: u <> '')[1], ''), '&amp;', '&') AS base
  FROM named WHERE target <> ''
),
{_sql_resolved('based', 'bases', 'base', 'host', 'path', 'host, path, trim(target) AS target, base')},
places AS (
  SELECT host, path, target, CASE WHEN base <> '' AND t_host <> '' THEN t_host ELSE host END AS b_host, CASE WHEN base <> '' AND t_host <> '' THEN t_path ELSE path END AS b_path FROM based
),
{_sql_resolved('led', 'places', 'target', 'b_host', 'b_path', 'host, path')},
edges AS (SELECT DISTINCT host || path AS a, t_host || t_path AS b FROM led WHERE host <> '' AND t_host <> ''),
"""
SQL = _SQL.replace("EDGES", _TARGETS)
ALIAS_SQL = _SQL.replace("EDGES", """edges AS (
  SELECT x.host || x.path AS a, y.host || y.path AS b FROM parsed x JOIN parsed y ON y.page_id = x.page_id - 7 WHERE x.page_id % 3 = 0 AND x.host <> '' AND y.host <> ''
),
""")
