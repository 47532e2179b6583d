"""Queries of rules over names, links, texts, caches and releases; the SQL finds each answer from the same texts, by its own expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import format as fmt
from ..functions import names, text, urls
from ..operators import cache, changelog, index, releases
from ..sources import dumps
from .catalog import KV, _kv, query, read
from .modules import _pick, _s, _sql_list, _sql_pick

# --- names and paths --------------------------------------------------------------------------------

_FOLDERS = ["pkg", "pkg/sub", "pkg/tests", "pkg/_vendor", "docs", "../up", "pkg/3d", "tests", "pkg_stubs", "pkg-stubs/in"]
_FILES = ["__init__.py", "mod.py", "test_a.py", "conftest.py", "_hidden.pyi", "a_test.py", "typed.pyi", "setup.py", "note.txt", "my-mod.py"]
_PATHS = f"paths AS (SELECT p_partkey, {_sql_pick(_FOLDERS, 'p_partkey')} || '/' || {_sql_pick(_FILES, 'p_partkey // 10')} AS path FROM part)"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select("p_partkey", F.concat(_pick(_FOLDERS, k), F.lit("/"), _pick(_FILES, F.expr("p_partkey div 10"))).alias("path"))


@query(f"""
WITH {_PATHS}, f AS (SELECT *, string_split(path, '/') AS seg, regexp_extract(path, '[^/]*$') AS base FROM paths)
SELECT p_partkey, path,
  replace(regexp_replace(regexp_replace(path, '\\.pyi?$', ''), '(^|/)__init__$', ''), '/', '.') AS module,
  regexp_matches(base, '^test_.*\\.pyi?$|_test\\.pyi?$|^(conftest|tests)\\.pyi?$') OR len(list_filter(seg[2:-2], lambda x: x IN ('tests', 'test'))) > 0 AS test,
  len(list_filter(seg[2:], lambda x: starts_with(x, '_') AND NOT regexp_matches(x, '^__init__\\.pyi?$'))) > 0 AS hidden,
  regexp_matches(path, '\\.pyi?$') AND len(list_filter(string_split(regexp_replace(path, '\\.pyi?$', ''), '/'), lambda x: NOT regexp_matches(x, '^[A-Za-z_][A-Za-z0-9_]*$'))) = 0 AND len(list_filter(seg[:-2], lambda x: x IN ('tests', 'test', 'docs', 'doc', 'examples'))) = 0 AS importable,
  NOT contains(path, '../') AS safe,
  regexp_replace(regexp_replace(path, '\\.pyi$', '.py'), '^([^/]+?)[-_]stubs/', '\\1/') AS source
FROM f""")
def module_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-14, FIL-15, FIL-16, FIL-17, STR-25, STR-35: what a file's path says, for a hundred kinds of paths."""
    p = F.col("path")
    return _paths(spark, sf_dir).select(
        "p_partkey", "path", names.module_name(p).alias("module"), names.is_test_module(p).alias("test"), names.is_private_module(p).alias("hidden"), names.importable_path(p).alias("importable"),
        names.safe_path(p).alias("safe"), names.source_path(p).alias("source"),
    )


_MEMBERS = ["run", "_run", "__run", "__init__", "__", "____", "_", "__a__b", "run_", "__x__"]


@query(f"""
WITH m AS (SELECT p_partkey, {_sql_pick(_MEMBERS, 'p_partkey')} AS name, CASE WHEN p_size % 3 = 0 THEN ['run', '_run', p_name] END AS listed FROM part),
d AS (SELECT *, length(name) > 4 AND regexp_matches(name, '^__.*__$') AS dunder FROM m)
SELECT p_partkey, dunder, starts_with(name, '_') AND NOT dunder AS private, CASE WHEN listed IS NULL THEN NOT starts_with(name, '_') ELSE list_contains(listed, name) END AS public FROM d""")
def member_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-11, FIL-12, FIL-13: which members are public, with and without an export list."""
    name = _pick(_MEMBERS, F.col("p_partkey"))
    listed = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("run"), F.lit("_run"), F.col("p_name")))
    return read(spark, sf_dir, "part").select("p_partkey", names.is_dunder(name).alias("dunder"), names.is_private_member(name).alias("private"), names.is_public(name, listed).alias("public"))


@query("SELECT p_partkey, 'docs:' || lower(p_name) || ':' || p_size || ':' || p_brand AS key FROM part")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-33."""
    return read(spark, sf_dir, "part").select("p_partkey", names.cache_key("docs", F.col("p_name"), _s("p_size"), F.col("p_brand")).alias("key"))


# --- what symbols are -------------------------------------------------------------------------------

_CONSTANTS = ["MAX_SIZE", "T", "alias", "JsonValue", "__all__", "Json_Value", "lower", "A1", "_HIDDEN", "Élan"]
_NOTES = [None, "int", "'typing.TypeAlias'", "TypeAlias"]
_VALUES = ["1", "typing.TypeVar('T')", "typing.Union[int, str]", "make()", "dict[str, int]", "NewType('U', int)", "other[0]"]


@query(f"""
WITH c AS (SELECT p_partkey, {_sql_pick(_CONSTANTS, 'p_partkey')} AS name, {_sql_pick(_NOTES, 'p_partkey // 10')} AS note, {_sql_pick(_VALUES, 'p_size')} AS value FROM part),
t AS (SELECT *, regexp_matches(value, '(^|\\.)(TypeVar|TypeVarTuple|ParamSpec|NewType)\\(') AS param, regexp_extract(value, '([^.\\[]*)\\[', 1) AS generic FROM c)
SELECT p_partkey, param AS type_param, NOT (length(name) > 4 AND regexp_matches(name, '^__.*__$')) AND NOT param AND (
  (name = upper(name) AND name <> lower(name)) OR regexp_matches(coalesce(note, ''), '(^|[.\\x27"])TypeAlias[\\x27"]*$')
  OR (regexp_matches(name, '^\\p{{Lu}}') AND NOT contains(name, '_') AND generic IN ('Union', 'dict'))) AS constant FROM t""")
def constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-23, FIL-24: names, annotations and values in all combinations that the parts give."""
    from ..operators import symbols

    k = F.col("p_partkey")
    name, note, value = _pick(_CONSTANTS, k), _pick(_NOTES, F.expr("p_partkey div 10")), _pick(_VALUES, F.col("p_size"))
    return read(spark, sf_dir, "part").select("p_partkey", symbols.is_type_param(value).alias("type_param"), symbols.is_constant(name, note, value).alias("constant"))


_DECORATORS = ["abc.abstractclassmethod", "staticmethod", "region.cache(5)", "functools.cache", "typing.final", "cache", "lru_cache(maxsize=1)", "app.route('/a.b')", "override", "dataclasses.dataclass", "classmethod"]
_PARENTS = ["errors.BaseError[T]", "Errors", "KeyboardInterrupt", "x.SystemExit", "Warning", "MyException(1)", "Base", "StopIteration2"]


@query(f"""
WITH d AS (SELECT p_partkey, [{_sql_pick(_DECORATORS, 'p_partkey')}, {_sql_pick(_DECORATORS, 'p_size')}] AS decs, {_sql_pick(_PARENTS, 'p_size + p_partkey')} AS base FROM part),
u AS (SELECT p_partkey, unnest(decs) AS dec, unnest([1, 2]) AS ord FROM d), n AS (SELECT *, split_part(dec, '(', 1) AS head, regexp_extract(split_part(split_part(dec, '(', 1), '[', 1), '([^.]*)$', 1) AS last FROM u),
s AS (SELECT *, CASE WHEN last IN ('abstractclassmethod', 'abstractstaticmethod', 'abstractmethod') THEN 'abstractmethod' WHEN last = 'cache' THEN CASE WHEN head IN ('cache', 'functools.cache') THEN 'cache' END WHEN last IN ('final', 'override', 'dataclass', 'lru_cache') THEN last END AS shown FROM n),
k AS (SELECT p_partkey, arg_min(replace(last, 'abstract', ''), ord) FILTER (last IN ('abstractclassmethod', 'classmethod', 'staticmethod')) AS kind FROM n GROUP BY 1),
f AS (SELECT p_partkey, shown, min(ord) AS ord FROM s WHERE shown IS NOT NULL GROUP BY 1, 2)
SELECT d.p_partkey, coalesce(kind, '') AS kind, coalesce((SELECT string_agg(shown, ',' ORDER BY ord) FROM f WHERE f.p_partkey = d.p_partkey), '') AS served,
  regexp_extract(regexp_extract(base, '^[^(\\[]*'), '([^.]*)$', 1) IN ('KeyboardInterrupt', 'StopIteration') OR regexp_matches(regexp_extract(base, '^[^(\\[]*'), '(Error|Exception|Warning|Exit)$') AS exception
FROM d JOIN k USING (p_partkey)""")
def decorators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-26, STR-27, FIL-25: pairs of decorators, and bases by their names."""
    from ..operators import symbols

    k, size = F.col("p_partkey"), F.col("p_size")
    decs, base = F.array(_pick(_DECORATORS, k), _pick(_DECORATORS, size)), _pick(_PARENTS, size + k)
    return read(spark, sf_dir, "part").select("p_partkey", symbols.method_kind(decs).alias("kind"), F.array_join(symbols.served_decorators(decs), ",").alias("served"), symbols.is_exception_name(base).alias("exception"))


@query("""
WITH c AS (SELECT s_suppkey, unnest(['Topic :: Text Processing', 'License :: X', 'Topic :: A :: ' || s_name, 'Framework :: Django', 'Topic :: Text Processing', 'Topic', 'Framework :: N' || s_nationkey]) AS c, unnest([1, 2, 3, 4, 5, 6, 7]) AS ord FROM supplier),
l AS (SELECT s_suppkey, lower(trim(regexp_extract(c, '([^:]*)$', 1))) AS k, min(ord) AS ord FROM c WHERE regexp_matches(c, '^(Topic|Framework)\\s*::') GROUP BY 1, 2)
SELECT s_suppkey, array_to_string(list(k ORDER BY ord)[1:5], ',') AS keywords FROM l GROUP BY 1""")
def ad_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-31, ARR-01."""
    of = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    classes = F.array(F.lit("Topic :: Text Processing"), F.lit("License :: X"), of("Topic :: A :: ", F.col("s_name")), F.lit("Framework :: Django"), F.lit("Topic :: Text Processing"), F.lit("Topic"), of("Framework :: N", _s("s_nationkey")))
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(fmt.keywords(classes), ",").alias("keywords"))


@query("""
WITH a AS (SELECT p_partkey, p_name || CASE WHEN p_size % 3 = 0 THEN '' ELSE ': ' || p_brand END || CASE WHEN p_size % 2 = 0 THEN ' = ' || p_size ELSE '' END AS body FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'property ' || body || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' [read-only]' END ELSE body END AS signature FROM a""")
def attribute_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-29."""
    k, size = F.col("p_partkey"), F.col("p_size")
    line = text.attribute_signature(F.col("p_name"), F.when(size % 3 != 0, F.col("p_brand")), F.when(size % 2 == 0, _s(size)).otherwise(""), k % 3 == 0, k % 2 == 0)
    return read(spark, sf_dir, "part").select("p_partkey", line.alias("signature"))


# --- links and texts --------------------------------------------------------------------------------


@query("""
WITH l AS (SELECT page_id, [{'label': 'a', 'url': url}, {'label': 'b', 'url': 'https://index/' || (page_id % 4)}] AS links, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN 'https://docs/' || page_id ELSE '' END AS doc, 'https://index/' || (page_id % 8) AS home FROM pages),
n AS (SELECT page_id, CASE WHEN doc <> '' AND NOT list_contains([x.url FOR x IN links], doc) THEN ['Documentation ' || doc] ELSE [] END || [x.label || ' ' || x.url FOR x IN links] || CASE WHEN NOT list_contains([x.url FOR x IN links], home) THEN ['Index page ' || home] ELSE [] END AS shown FROM l)
SELECT page_id, array_to_string(shown, '|') AS shown FROM n""")
def shown_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-05: links with the documentation before and the index page after them, unless they are there."""
    k = F.col("page_id")
    links = F.array(F.struct(F.lit("a").alias("label"), F.col("url").alias("url")), F.struct(F.lit("b").alias("label"), F.concat(F.lit("https://index/"), _s(k % 4)).alias("url")))
    doc = F.when(k % 3 == 0, F.col("url")).when(k % 3 == 1, F.concat(F.lit("https://docs/"), _s(k))).otherwise("")
    shown = urls.shown_links(links, doc, F.concat(F.lit("https://index/"), _s(k % 8)))
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(F.transform(shown, lambda x: F.concat_ws(" ", x["label"], x["url"])), "|").alias("shown"))


@query("SELECT doc_id, coalesce(contains(text, '.. ') OR contains(text, ':target:') OR contains(text, ':alt:'), false) AS rst FROM documents")
def rst_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-29: texts that look like reStructuredText."""
    return read(spark, sf_dir, "documents").select("doc_id", text.looks_like_rst(F.col("text")).alias("rst"))


_ACCEPT = ["text/plain", "*/*", "", None, "text/plain;q=0.5, application/json;q=0.4", "text/*;q=2, application/json", "text/markdown;q=0.3,*/*;q=0.8", "TEXT/PLAIN; q=1, application/xml;q=0.9"]


@query(f"""SELECT p_partkey, {_sql_list(["t", "f", "f", "f", "t", "f", "f", "t"])}[p_partkey % 8 + 1] = 't' AS plain FROM part""")
def accept_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-30: headers that weigh text above all else; a weight of 2 counts as 1."""
    return read(spark, sf_dir, "part").select("p_partkey", text.prefers_text(_pick(_ACCEPT, F.col("p_partkey"))).alias("plain"))


@query("""
WITH r AS (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN year(a) = year(b) THEN strftime(a, '%b %-d') ELSE strftime(a, '%b %-d, %Y') END || ' – ' || strftime(b, '%b %-d, %Y') AS label FROM r""")
def date_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT-04: first and last day, the year on both sides only where it differs."""
    found = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return found.select("o_custkey", text.range_label(F.col("a"), F.col("b")).alias("label"))


@query("""
WITH n AS (SELECT o_orderkey, o_orderkey * (o_custkey % 97) * 7 AS n, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS stamp, o_orderdate AS d FROM orders)
SELECT o_orderkey, CASE WHEN n >= 1000000000 THEN printf('%.1fB', floor(n / 1e8 + 0.5) / 10) WHEN n >= 1000000 THEN printf('%.1fM', floor(n / 1e5 + 0.5) / 10) WHEN n >= 1000 THEN floor(n / 1e3 + 0.5)::BIGINT || 'K' ELSE n::VARCHAR END AS count,
  CASE WHEN n = 0 THEN '—' WHEN n >= 1048576 THEN printf('%.1f MB', floor(n / 104857.6::DOUBLE + 0.5) / 10) WHEN n >= 1024 THEN floor(n / 1024.0::DOUBLE + 0.5)::BIGINT || ' KB' ELSE n || ' B' END AS size, strftime(d, '%b %-d, %Y') AS shown, stamp[1:10] AS day FROM n""")
def short_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-22, STR-23: counts, sizes and days as the interface shows them."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * (F.col("o_custkey") % 97) * 7).alias("n"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("stamp"))
    return orders.select("o_orderkey", fmt.short_count(F.col("n")).alias("count"), fmt.short_size(F.col("n")).alias("size"), fmt.short_date(F.col("stamp")).alias("shown"), fmt.date_prefix(F.col("stamp")).alias("day"))


# --- releases, tags, notes --------------------------------------------------------------------------

_TAGS = ["v{}.1", "{}.2rc1", "release-{}", "v{}", "nightly", "{}.0-beta.1", "V{}.3"]


@query(f"""
WITH t AS (SELECT user_id, event_id, replace({_sql_pick(_TAGS, 'event_id')}, '{{}}', event_id::VARCHAR) AS tag FROM events), v AS (SELECT * FROM t WHERE regexp_matches(tag, '^v?\\d+\\.\\d[\\d.a-zA-Z-]*$'))
SELECT user_id, newer, older FROM (SELECT user_id, tag AS newer, lead(tag) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS older FROM v) WHERE older IS NOT NULL""")
def version_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-22, SRC-10, SRC-14, WIN-03: neighbours among the tags that name a version."""
    tag = F.replace(_pick(_TAGS, F.col("event_id")), F.lit("{}"), _s("event_id"))
    rows = changelog.version_tags(read(spark, sf_dir, "events").select("user_id", tag.alias("tag"), (-F.col("event_id")).alias("o")), "tag")
    return changelog.tag_pairs(rows, ["user_id"], "tag", "o")


@query("SELECT p_partkey, 'https://forge/' || p_brand || '/compare/v' || p_size || '...v' || (p_size + 1) AS url FROM part")
def compare_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-11, SRC-15: where two tags are compared."""
    size = F.col("p_size")
    return read(spark, sf_dir, "part").select("p_partkey", changelog.compare_url("https://forge/{ref}/compare/{older}...{newer}", F.col("p_brand"), F.concat(F.lit("v"), _s(size)), F.concat(F.lit("v"), _s(size + 1))).alias("url"))


@query("""
WITH e AS (SELECT p_brand, p_size::VARCHAR AS version, arg_max(p_name, p_partkey) AS body FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1, 2)
SELECT p_partkey, body FROM part LEFT JOIN e ON e.p_brand = part.p_brand AND e.version = part.p_size::VARCHAR""")
def version_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-13: releases with their changelog entry, of repeated versions the last."""
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_brand", _s("p_size").alias("version"), "p_name")
    entries = rows.filter("p_partkey % 3 <> 0").select("p_brand", "version", F.col("p_name").alias("body"), F.col("p_partkey").alias("ord"))
    return changelog.version_notes(rows, entries, ["p_brand"]).select("p_partkey", "body")


@query("""
SELECT p_partkey, p_size || '.' || (p_partkey % 20) AS version FROM part WHERE p_size * 100 + p_partkey % 20 > 1203 AND p_size * 100 + p_partkey % 20 <= 2007""")
def notes_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-07, TOP-06: entries after one version up to another, newest first."""
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(".", _s("p_size"), _s(F.col("p_partkey") % 20)).alias("version"))
    return changelog.between(rows, F.lit("12.3"), F.lit("20.7"))


@query("""
WITH v AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS upload_time, 'v' || o_orderkey AS version FROM orders)
SELECT o_custkey, version, row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(upload_time, '') DESC NULLS LAST, version) AS place, row_number() OVER (PARTITION BY o_custkey ORDER BY try_cast(nullif(upload_time, '') AS TIMESTAMP) DESC NULLS LAST, version) AS by_date FROM v""")
def versions_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-04, TOP-05: versions of a package, newest first, by the text of the time and by the time."""
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select("o_custkey", F.when(k % 4 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("upload_time"), F.concat(F.lit("v"), _s(k)).alias("version"))
    return releases.in_time(rows, ["o_custkey"]).select("o_custkey", "version", "place", "by_date")


@query("""
WITH f AS (SELECT o_custkey, o_orderpriority AS v, o_orderkey AS ord, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS t FROM orders),
t AS (SELECT o_custkey, v, arg_min(t, ord) AS released_at FROM f WHERE t IS NOT NULL GROUP BY 1, 2)
SELECT o_custkey, v, released_at FROM t""")
def version_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04, DAT-01: a version's time is that of its first file with a readable one."""
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("v"), k.alias("ord"), F.when(k % 5 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("stamp"))
    found = releases.version_times(rows, ["o_custkey"], "v", F.try_to_timestamp("stamp"), "ord")
    return found.withColumn("released_at", F.col("released_at").cast("timestamp_ntz"))


# --- joins with landed tables -------------------------------------------------------------------------


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN s.s_name END AS conda_version, p_size % 3 = 0 AS available FROM part LEFT JOIN supplier s ON s.s_suppkey = 1""")
def channel_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-06: what a channel has of each name, whatever its case."""
    part = read(spark, sf_dir, "part").withColumn("name", F.concat("p_name", _s("p_partkey")))
    first = read(spark, sf_dir, "supplier").filter("s_suppkey = 1").select(F.col("s_name").alias("version"), F.lit(0).alias("zero"))
    channel = part.filter("p_size % 3 = 0").select(F.upper("name").alias("name"), F.lit(0).alias("zero")).join(F.broadcast(first), "zero")  # one row
    return dumps.conda_info(part.select("p_partkey", "name"), channel).select("p_partkey", "conda_version", "available")


@query("""
SELECT o_orderkey, CASE WHEN c_custkey % 3 = 0 OR c_custkey IS NULL THEN 'login' || o_custkey ELSE c_name END AS owner_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def repository_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-08: the owner's shown name, else the login."""
    owners = read(spark, sf_dir, "customer").select(F.concat(F.lit("login"), _s("c_custkey")).alias("login"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("name"))
    return dumps.repo_info(read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("login"), _s("o_custkey")).alias("login")), owners).select("o_orderkey", "owner_name")


_LOGS = ["CHANGELOG.md", "CHANGES.rst", "HISTORY.md"]
_LANDED = ["HISTORY.md", "README.md", "CHANGES.rst", "setup.py", "CHANGELOG.md", "docs/CHANGELOG.md", "NEWS"]


@query(f"""
WITH f AS (SELECT l_orderkey, {_sql_pick(_LANDED, 'l_partkey')} AS path, list_position({_sql_list(_LOGS)}, {_sql_pick(_LANDED, 'l_partkey')}) AS rank FROM lineitem)
SELECT l_orderkey, arg_min(path, rank) AS path FROM f WHERE rank > 0 GROUP BY 1""")
def first_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-09, SRC-13: the first of some files that is there."""
    files = read(spark, sf_dir, "lineitem").select("l_orderkey", _pick(_LANDED, F.col("l_partkey")).alias("path"), F.lit("text").alias("content"))
    return dumps.first_file(files, ["l_orderkey"], _LOGS).select("l_orderkey", "path")


# --- caches and work ----------------------------------------------------------------------------------


@query(f"WITH {KV} SELECT key, epoch(TIMESTAMP '1998-08-02') - epoch(created_at) < 86400 * 365 AS fresh FROM kv WHERE key = (SELECT min(key) FROM kv)")
def cache_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-27, STM-02: one row of the cache, and whether it is fresh."""
    kv = _kv(spark, sf_dir)
    return cache.get(kv, kv.agg(F.min("key")).first()[0], 86400 * 365, datetime(1998, 8, 2)).select("key", "fresh")


@query(f"WITH {KV} SELECT key FROM kv WHERE NOT (starts_with(key, 'stats:') AND status = 'error')")
def cache_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-07: rows of some keys go."""
    kv = _kv(spark, sf_dir)
    return cache.delete(kv, kv.filter("startswith(key, 'stats:') AND status = 'error'").select("key")).select("key")


@query(f"""
WITH {KV}, old AS (SELECT DISTINCT key FROM kv WHERE epoch(TIMESTAMP '1998-08-02') - epoch(created_at) >= 86400 * 700)
SELECT kv.key, CASE WHEN old.key IS NOT NULL AND status <> 'error' THEN 'anew' ELSE status END AS value FROM kv LEFT JOIN old ON old.key = kv.key""")
def cache_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-04: stale rows are fetched anew, each once; where that fails the old row stays."""
    kv = _kv(spark, sf_dir).select("key", F.col("status").alias("value"), "created_at")
    asked = kv.unionByName(kv)  # by two at once
    stale = cache.expired(asked, 86400 * 700, datetime(1998, 8, 2))
    fetched = stale.join(kv.select("key", "value"), "key").select("key", F.when(F.col("value") != "error", "anew").alias("value"), F.lit(datetime(2000, 1, 1)).alias("created_at"))
    return cache.revalidated(kv, fetched).select("key", "value")


@query("""
WITH RECURSIVE j AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS o, least(greatest(max(l_partkey) * 100000, 4194304), 67108864)::BIGINT AS c, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS r FROM lineitem GROUP BY l_suppkey, l_orderkey, l_linenumber),
w AS (SELECT l_suppkey, r, o, c, c AS used, 0 AS wave FROM j WHERE r = 1
  UNION ALL SELECT j.l_suppkey, j.r, j.o, j.c, CASE WHEN w.used + j.c <= 67108864 THEN w.used + j.c ELSE j.c END, CASE WHEN w.used + j.c <= 67108864 THEN w.wave ELSE w.wave + 1 END FROM w JOIN j ON j.l_suppkey = w.l_suppkey AND j.r = w.r + 1)
SELECT l_suppkey, o, c AS cost, wave::INT AS wave FROM w""")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-08, MTH-02: jobs in order, as many at once as the budget holds."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o")).agg((F.max("l_partkey") * 100000).alias("weight"))
    return cache.admitted(rows, ["l_suppkey"], "o", "weight").select("l_suppkey", "o", "cost", "wave")


@query("SELECT 'same' AS state, false AS stale UNION ALL SELECT 'layout', true UNION ALL SELECT 'rows', true UNION ALL SELECT 'none', true")
def index_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-05: an index of the same rows and layout holds; one of another layout, of fewer rows, or none does not."""
    names_ = read(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    fewer = names_.filter(F.col("name") != names_.agg(F.min("name")).first()[0])
    found = [("same", index.is_stale(names_, names_.unionByName(names_), 3, 3)), ("layout", index.is_stale(names_, names_, 3, 2)), ("rows", index.is_stale(names_, fewer, 3, 3)), ("none", index.is_stale(names_, fewer.limit(0), 3, None))]
    return spark.createDataFrame(found, "state string, stale boolean")
