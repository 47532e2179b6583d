"""URL filters with redirect equivalence.

Rules are (host, path prefix) pairs; the longest that fits a URL decides. URLs that
redirect to each other, or name each other as canonical, are aliases: distributed
connected components over those edges. An alias without a rule of its own takes its
class's decision: allow if a rule allows any member, else block if a rule blocks any.
A URL's own rule always comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import components
from ._work import Scratch

#: The rules of the query, host and path prefix as one string, and what each says.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed patterns: a URL's host and path; what begins with a scheme, and with a scheme and a host; the tags that name another URL, and the URL in them.
URL = r"://([^/?#]*)([^?#]*)"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*://"
CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
BASE = r"(?is)<base\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def host(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or nulls; of equally long ones, allow goes first."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[1] == "allow", r[0])):
        at = rule.index("/")
        name, prefix = rule[:at], rule[at:]
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def without_dots(path: Column) -> Column:
    """A path with its . and .. segments carried out."""
    parts = F.split(path, "/")
    step = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    left = F.aggregate(parts, F.array().cast("array<string>"), step)
    left = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(left, F.array(F.lit("")))).otherwise(left)
    return F.when(path.contains("/."), F.array_join(left, "/")).otherwise(path)


def key(url: Column) -> Column:
    """What aliases are told by: the URL without scheme and fragment, its host lower-cased, . and .. carried out."""
    query = F.regexp_extract(url, r"(?s)://[^/?#]*[^?#]*(\?[^#]*)", 1)
    plain = without_dots(path(url))
    return F.concat(host(url), F.when(plain == "", F.lit("/")).otherwise(plain), query)


def absolute(href: Column, base: Column) -> Column:
    """A reference as seen from the URL base, as RFC 3986 resolves it (. and .. are left to `key`); null if it names no host."""
    href = F.replace(href, F.lit("&amp;"), F.lit("&"))
    origin = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    own_path, own_query = path(base), F.regexp_extract(base, r"(?s)://[^/?#]*[^?#]*(\?[^#]*)", 1)
    folder = F.regexp_extract(own_path, r"(?s)^(.*/)", 1)
    return (
        F.when(href.rlike(ABSOLUTE), href)
        .when(href.rlike(SCHEME), F.lit(None).cast("string"))
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:/?#]+:)//", 1), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(origin, own_path, href))
        .when(href.startswith("#"), F.concat(origin, own_path, own_query, href))
        .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), href))
    )


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(from_url, to_url) of all canonical links and refreshes of each page, seen from its <base> if it has one."""
    url, html = F.col(f"`{url_col}`"), F.col(f"`{html_col}`")
    every = lambda tag, link: F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, link, 1))
    links = F.filter(F.concat(every(CANONICAL, HREF), every(REFRESH, REFRESH_URL)), lambda x: x != "")
    based = F.regexp_extract(F.regexp_extract(html, BASE, 0), HREF, 1)
    named = pages.filter(url.rlike(ABSOLUTE) & html.isNotNull()).select(url.alias("from_url"), based.alias("based"), links.alias("links")).filter(F.size("links") > 0)
    seen_from = F.when(F.col("based") != "", F.coalesce(absolute(F.col("based"), F.col("from_url")), F.col("from_url"))).otherwise(F.col("from_url"))
    named = named.select("from_url", seen_from.alias("base"), F.explode("links").alias("link"))
    return named.select("from_url", absolute(F.col("link"), F.col("base")).alias("to_url")).filter("to_url IS NOT NULL")


def url_filter(
    spark: SparkSession,
    pages: DataFrame,
    rules: tuple[tuple[str, str], ...] = RULES,
    redirects: DataFrame | None = None,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    redirects: further edges (from_url, to_url). A page without a rule takes its alias class's decision,
    then `default`. Null URLs and those without :// have empty host and path, no rule and no aliases; one whose :// does not
    follow a scheme at its start has a host by the first ://, but no aliases. Repeated rows get the same verdict each; a null or empty
    html names no other URL, one of any length is read whole. Of rules of the same length, allow goes first. Null ids stay null; an
    empty table gives an empty one; other columns do not matter, whatever their names.
    """
    scratch = Scratch(spark, "urls")
    url = F.col(f"`{url_col}`")
    edges = page_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("from_url", "to_url"))
    edges = edges.filter(F.col("from_url").rlike(ABSOLUTE) & F.col("to_url").rlike(ABSOLUTE))
    edges = scratch.table(edges.select(key(F.col("from_url")).alias("f"), key(F.col("to_url")).alias("t")).filter("f <> t").distinct())
    nodes = edges.select(F.col("f").alias("name")).unionByName(edges.select(F.col("t").alias("name"))).distinct()
    nodes = scratch.table(nodes.withColumn("node", F.monotonically_increasing_id()))
    ends = edges.join(nodes.select(F.col("name").alias("f"), F.col("node").alias("u")), "f").join(nodes.select(F.col("name").alias("t"), F.col("node").alias("v")), "t")
    classes = components(ends.select("u", "v"), scratch)
    # a node's key has no scheme left, so it is read with one put before it
    whole = F.concat(F.lit("x://"), F.col("name"))
    judged = nodes.join(classes, "node").withColumn("own", longest_rule(host(whole), path(whole), rules)["verdict"])
    said = judged.groupBy("component").agg(F.max(F.col("own") == "allow").alias("allows"), F.max(F.col("own") == "block").alias("blocks"))
    decided = said.select("component", F.when(F.col("allows"), F.lit("allow")).when(F.col("blocks"), F.lit("block")).alias("of_class"))
    aliases = scratch.table(judged.select("name", "component").join(decided.filter("of_class IS NOT NULL"), "component").select("name", "of_class"))
    out = pages.select(F.col(f"`{id_col}`").alias("page_id"), host(url).alias("host"), path(url).alias("path"), F.when(url.rlike(ABSOLUTE), key(url)).alias("name"))
    out = out.withColumn("own", longest_rule(F.col("host"), F.col("path"), rules)).join(aliases, "name", "left")
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "of_class", F.lit(default)).alias("verdict"))


def oracle_sql(rules: tuple[tuple[str, str], ...] = RULES, default: str = "allow") -> str:
    """The same for DuckDB over the view pages; classes by a recursive closure."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({quoted(r)}, {quoted(r[: r.index('/')])}, {quoted(r[r.index('/') :])}, {quoted(v)})" for r, v in rules)
    every = lambda tag, link: f"list_transform(regexp_extract_all(html, {quoted(tag)}), lambda t: regexp_extract(t, {quoted(link)}, 1))"
    host_of = lambda u: f"translate(coalesce(regexp_extract({u}, {quoted(URL)}, 1), ''), '{UPPER}', '{LOWER}')"
    path_of = lambda u: f"coalesce(regexp_extract({u}, {quoted(URL)}, 2), '')"
    query_of = lambda u: f"regexp_extract({u}, '(?s)://[^/?#]*[^?#]*(\\?[^#]*)', 1)"
    folded = lambda p: f"list_reduce(list_transform(string_split({p}, '/'), lambda x: [x]), lambda done, x: CASE x[1] WHEN '..' THEN done[1:greatest(len(done) - 1, 1)] WHEN '.' THEN done ELSE done || x END)"
    plain = lambda p: f"CASE WHEN contains({p}, '/.') THEN array_to_string({folded(p)} || CASE WHEN string_split({p}, '/')[-1] IN ('.', '..') THEN [''] ELSE []::VARCHAR[] END, '/') ELSE {p} END"
    key_of = lambda u: f"{host_of(u)} || CASE WHEN {path_of(u)} = '' THEN '/' ELSE {plain(path_of(u))} END || {query_of(u)}"
    seen = lambda link, base: f"""CASE WHEN regexp_matches({link}, {quoted(ABSOLUTE)}) THEN {link} WHEN regexp_matches({link}, {quoted(SCHEME)}) THEN NULL
    WHEN starts_with({link}, '//') THEN regexp_extract({base}, '^([^:/?#]+:)//', 1) || {link}
    ELSE regexp_extract({base}, '^([^:/?#]+://[^/?#]*)', 1) || CASE {link}[1] WHEN '/' THEN {link} WHEN '?' THEN {path_of(base)} || {link} WHEN '#' THEN {path_of(base)} || {query_of(base)} || {link}
      ELSE CASE WHEN contains({path_of(base)}, '/') THEN regexp_extract({path_of(base)}, '(?s)^(.*/)', 1) ELSE '/' END || {link} END END"""  # noqa: E731
    return f"""
WITH RECURSIVE rules(rule, rhost, rpath, said) AS (VALUES {table}),
tags AS (
  SELECT url, replace(regexp_extract(regexp_extract(html, {quoted(BASE)}), {quoted(HREF)}, 1), '&amp;', '&') AS based, replace(unnest(list_concat({every(CANONICAL, HREF)}, {every(REFRESH, REFRESH_URL)})), '&amp;', '&') AS link
  FROM pages WHERE regexp_matches(url, {quoted(ABSOLUTE)})),
found AS (SELECT url, link, CASE WHEN based <> '' THEN coalesce({seen('based', 'url')}, url) ELSE url END AS base FROM tags WHERE link <> ''),
linked AS (SELECT url, {seen('link', 'base')} AS link FROM found),
edges AS (SELECT DISTINCT {key_of('url')} AS f, {key_of('link')} AS t FROM linked WHERE regexp_matches(link, {quoted(ABSOLUTE)})),
both_ways AS (SELECT f, t FROM edges WHERE f <> t UNION SELECT t, f FROM edges WHERE f <> t),
reach AS (SELECT f, t FROM both_ways UNION SELECT r.f, b.t FROM reach r JOIN both_ways b ON r.t = b.f),
fits AS (
  SELECT name, arg_max(said, length(rule) * 2 + (said = 'allow')::INT) AS said
  FROM (SELECT DISTINCT t AS name FROM reach) n JOIN rules ON ({host_of("'x://' || name")} = rhost OR ends_with({host_of("'x://' || name")}, '.' || rhost)) AND starts_with({path_of("'x://' || name")}, rpath)
  GROUP BY name),
classes AS (SELECT f AS name, CASE WHEN bool_or(said = 'allow') THEN 'allow' ELSE 'block' END AS of_class FROM reach JOIN fits ON t = fits.name GROUP BY f),
judged AS (SELECT page_id, {host_of('url')} AS host, {path_of('url')} AS path, CASE WHEN regexp_matches(url, {quoted(ABSOLUTE)}) THEN {key_of('url')} END AS name, row_number() OVER () AS n FROM pages),
own AS (
  SELECT n, arg_max(rule, length(rule) * 2 + (said = 'allow')::INT) AS rule, arg_max(said, length(rule) * 2 + (said = 'allow')::INT) AS said
  FROM judged JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(said, of_class, {quoted(default)}) AS verdict
FROM judged LEFT JOIN own USING (n) LEFT JOIN classes USING (name)"""
