"""Queries over the test tables, each in the role its operator needs, with the same in DuckDB SQL.

A query takes (spark, sf_dir); README tells which table plays what.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..code import docstrings, extract
from ..functions import dates, names, requirements, urls, versions
from ..functions import format as fmt
from ..operators import cache, changelog, diff, graph, index, releases, search, stats, symbols, text_sinks, vulns
from ..shared import new_folder, spread
from ..streaming import sync

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = date(2024, 1, 31)
ORDERS_AS_OF = date(1998, 9, 1)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as downloads: a row is one download, its type the category; `view` is what is counted."""
    return read(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"), F.col("event_type").alias("category"), F.lit(1).cast("bigint").alias("n"), "user_id")


# --- statistics ---------------------------------------------------------------------------------


@query("""
SELECT label, year, week, downloads FROM (
  SELECT *, strftime(make_date(year, 1, 1) + (week - 1) * 7, '%b %d') AS label, row_number() OVER (ORDER BY year DESC, week DESC) AS r
  FROM (SELECT isoyear(ts)::INT AS year, week(ts)::INT AS week, count(*) AS downloads FROM events WHERE event_type = 'view' AND ts::DATE >= DATE '2024-01-31' - 28 GROUP BY ALL)) WHERE r <= 4""")
def stats_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01, WIN-01, FIL-03, FIL-04: weekly sums of the counted category in the default period."""
    days, weeks, _ = stats.period("4w")
    rows = stats.since(_downloads(spark, sf_dir), F.col("day"), AS_OF, days)
    return stats.weekly(rows, [], "day", "category", "n", weeks, counted="view").select("label", "year", "week", "downloads")


@query("""
SELECT category, downloads FROM (SELECT event_type AS category, count(*) AS downloads FROM events WHERE ts::DATE >= DATE '2024-01-31' - 90 AND event_type NOT IN ('null', '') GROUP BY 1)
ORDER BY downloads DESC, category LIMIT 3""")
def stats_top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-02, WIN-02: the largest categories."""
    rows = stats.since(_downloads(spark, sf_dir), F.col("day"), AS_OF, stats.period("3m")[0])
    return stats.by_category(rows, [], "category", "n", 3)


@query("""
SELECT user_id, category, downloads FROM (
  SELECT user_id, event_type AS category, count(*) AS downloads, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r
  FROM events GROUP BY 1, 2) WHERE r <= 2""")
def stats_top_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-02 for many packages at once."""
    return stats.by_category(_downloads(spark, sf_dir), ["user_id"], "category", "n", 2)


@query("SELECT min(ts::DATE) AS first_day, max(ts::DATE) AS last_day FROM events WHERE event_type IN ('view', 'click', 'purchase')")
def stats_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-03: the days of three series together."""
    rows = _downloads(spark, sf_dir)
    return stats.date_range([], "day", *[rows.filter(F.col("category") == c) for c in ("view", "click", "purchase")])


@query("""
WITH w AS (SELECT user_id, isoyear(ts)::INT AS year, week(ts)::INT AS week, count(*) AS downloads FROM events WHERE event_type = 'view' GROUP BY ALL),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY year DESC, week DESC) AS r, strftime(make_date(year, 1, 1) + (week - 1) * 7, '%b %d') AS label FROM w)
SELECT user_id, sum(downloads)::BIGINT AS total, floor(avg(downloads) + 0.5)::BIGINT AS weekly_average, arg_max(label, downloads * 1000000 - (year * 100 + week)) AS peak_label, max(downloads) AS peak
FROM l WHERE r <= 4 GROUP BY user_id""")
def stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-20: total, mean and peak of each weekly series."""
    weeks = stats.weekly(_downloads(spark, sf_dir), ["user_id"], "day", "category", "n", 4, counted="view")
    return stats.series_summary(weeks, ["user_id"])


@query("""
WITH w AS (SELECT isoyear(ts)::INT AS year, week(ts)::INT AS week, count(*) AS downloads FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT year, week, round((row_number() OVER (ORDER BY year, week) - 1)::DOUBLE / greatest(count(*) OVER () - 1, 1) * 800, 4) AS x,
       round(10 + (1 - downloads::DOUBLE / greatest(max(downloads) OVER (), 1)) * 100, 4) AS y FROM w""")
def stats_sparkline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-11: points of the line over all weeks."""
    weeks = stats.weekly(_downloads(spark, sf_dir), [], "day", "category", "n", None, counted="view")
    return stats.sparkline(weeks, []).select("year", "week", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


# --- index ---------------------------------------------------------------------------------------


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as packages: name and key, type as the summary, quantity ordered as downloads."""
    sold = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("downloads"))
    part = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws("-", F.col("p_name"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_type").alias("summary"))
    return part.join(sold, part.p_partkey == sold.l_partkey, "left").select("name", "summary", F.coalesce("downloads", F.lit(0)).alias("downloads"))


PACKAGES = """packages AS (
  SELECT p_name || '-' || p_partkey AS name, p_type AS summary, coalesce(downloads, 0) AS downloads
  FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity::BIGINT)::BIGINT AS downloads FROM lineitem GROUP BY 1) ON p_partkey = l_partkey)"""


@query(f"WITH {PACKAGES} SELECT * FROM packages WHERE downloads > 0 ORDER BY downloads DESC, name LIMIT 12")
def popular_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-01, FIL-05: the most downloaded packages."""
    return index.top(_packages(spark, sf_dir))


@query(f"WITH {PACKAGES}, t AS (SELECT * FROM packages WHERE downloads > 0 ORDER BY downloads DESC, name LIMIT 50) SELECT max(downloads) AS most, min(downloads) AS least, count(*) AS n FROM t")
def popular_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-21: largest and smallest of the list."""
    return index.top(_packages(spark, sf_dir), 50).agg(F.max("downloads").alias("most"), F.min("downloads").alias("least"), F.count("*").alias("n"))


@query("SELECT c_custkey, c_name AS name FROM customer WHERE lower(c_name) = 'customer#000000007' ORDER BY c_name LIMIT 1")
def lookup_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-06: one name, whatever its case."""
    customers = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    return index.lookup(customers, "CUSTOMER#000000007")


@query("SELECT count(*) AS n FROM customer")
def index_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-09."""
    return read(spark, sf_dir, "customer").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey AS name, o_orderpriority AS summary, 'base' AS origin FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, min(upper(o_orderpriority)), 'batch' FROM orders WHERE o_orderkey % 2 <> 0 GROUP BY 1""")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-01: even orders are the table; the batch has all others and multiples of three besides, each twice."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"), F.col("o_orderpriority").alias("summary"))
    base = orders.filter("name % 2 = 0").withColumn("origin", F.lit("base"))
    batch = orders.filter("name % 2 <> 0 OR name % 3 = 0").withColumns({"summary": F.upper("summary"), "origin": F.lit("batch"), "ord": F.lit(1)})
    again = batch.withColumns({"summary": F.lit("never"), "ord": F.lit(2)})
    return index.insert_absent(base, batch.unionByName(again), "ord")


@query("""
WITH base AS (SELECT c_name AS name, 1 AS downloads FROM customer),
batch AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS name, c_custkey::INT AS downloads, c_custkey AS ord FROM customer WHERE c_custkey % 2 = 0),
hits AS (SELECT base.name, batch.downloads, ord FROM base JOIN batch ON base.name = batch.name OR (lower(base.name) = lower(batch.name) AND batch.name NOT IN (SELECT name FROM base)))
SELECT name, coalesce((SELECT arg_max(h.downloads, h.ord) FROM hits h WHERE h.name = base.name), base.downloads)::BIGINT AS downloads FROM base""")
def update_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-02: exact names, else any case."""
    customers = read(spark, sf_dir, "customer")
    base = customers.select(F.col("c_name").alias("name"), F.lit(1).cast("bigint").alias("downloads"))
    name = F.when(F.col("c_custkey") % 3 == 0, F.upper("c_name")).otherwise(F.col("c_name"))
    batch = customers.filter("c_custkey % 2 = 0").select(name.alias("name"), F.col("c_custkey").alias("downloads"), F.col("c_custkey").alias("ord"))
    return index.update_downloads(base, batch, "ord")


@query("SELECT c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN 'new ' || c_mktsegment ELSE c_mktsegment END AS summary FROM customer")
def update_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-03: exact names; the later of two rows of a batch wins."""
    customers = read(spark, sf_dir, "customer")
    base = customers.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("summary"))
    batch = customers.filter("c_custkey % 5 = 0").select(F.col("c_name").alias("name"), F.concat(F.lit("new "), "c_mktsegment").alias("summary"), F.lit(2).alias("ord"))
    return index.update_summaries(base, batch.unionByName(batch.withColumns({"summary": F.lit("old"), "ord": F.lit(1)})), "ord")


@query(f"""
WITH {PACKAGES}, popular AS (SELECT name FROM packages WHERE downloads > 0 ORDER BY downloads DESC, name LIMIT 20),
cached AS (SELECT DISTINCT p_name || '-' || p_partkey AS name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_shipdate >= TIMESTAMP '1998-06-01')
SELECT '/packages/' || name AS loc, 'daily' AS changefreq, 1.0::DOUBLE AS priority, 'popular' AS sitemap FROM popular
UNION ALL SELECT '/packages/' || name, 'weekly', 0.5::DOUBLE, 'cached' FROM cached WHERE name NOT IN (SELECT name FROM popular)""")
def sitemap_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-04, PRJ-03: popular names, and recent ones besides."""
    recent = read(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") >= F.lit("1998-06-01").cast("timestamp_ntz")).select(F.col("l_partkey").alias("p_partkey")).distinct()
    part = read(spark, sf_dir, "part").join(recent, "p_partkey", "left_semi").select(F.concat_ws("-", F.col("p_name"), F.col("p_partkey").cast("string")).alias("name"))
    return index.sitemap(index.top(_packages(spark, sf_dir), 20), part)


@query("""
WITH c AS (SELECT n_name AS name, 'types-' || n_name AS a, n_name || '-stubs' AS b, n_nationkey AS k FROM nation)
SELECT name, CASE WHEN k % 3 = 0 OR k % 2 = 0 THEN 'stubs' ELSE 'untyped' END AS status, CASE WHEN k % 3 = 0 THEN a WHEN k % 2 = 0 THEN b END AS stubs_package FROM c""")
def stub_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-03, JOIN-17: stub packages by the first name that exists."""
    nation = read(spark, sf_dir, "nation")
    a = nation.filter("n_nationkey % 3 = 0").select(F.concat(F.lit("types-"), "n_name").alias("name"))
    b = nation.filter("n_nationkey % 2 = 0").select(F.concat("n_name", F.lit("-stubs")).alias("name"))
    return index.stub_of(a.unionByName(b), nation.select(F.col("n_name").alias("name"))).select("name", "status", "stubs_package")


@query("""
SELECT doc_id, 'text/' || md5(text) || CASE WHEN r = 1 THEN '' ELSE '~' || r END AS id, n > 1 AS repeated
FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY md5(text)) AS n FROM documents)""")
def id_disambiguation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-04, AGG-22, JOIN-14: ids of repeated paths."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("text/"), F.md5(F.col("text").cast("binary"))).alias("path"))
    return index.disambiguate(docs, "path", ["doc_id"]).select("doc_id", "id", "repeated")


# --- search --------------------------------------------------------------------------------------

_WORDS = "list_filter(regexp_split_to_array(lower({c}), '[^\\pL\\pN]+'), lambda x: x <> '')"


def _phrase_sql(column: str, words: list[str]) -> str:
    """A phrase prefix over the words of a column."""
    joined = f"' ' || array_to_string({_WORDS.format(c=column)}, ' ')"
    return f"contains({joined}, ' {' '.join(words)}')"


@query(f"""
WITH {PACKAGES} SELECT name, summary, downloads FROM packages
WHERE {_phrase_sql("name", ["small", "ri"])} OR {_phrase_sql("summary", ["small", "ri"])}
ORDER BY CASE WHEN lower(name) = 'small ri' THEN 0 ELSE 1 END, downloads DESC, name LIMIT 25""")
def search_phrase_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-01, TOP-02, JOIN-01, STR-01: a phrase whose last word is open."""
    return search.search(_packages(spark, sf_dir), ' "Small" Ri ', 25)


@query(f"""
WITH {PACKAGES} SELECT name, summary, downloads FROM packages
WHERE {_phrase_sql("name", ["econ"])} OR {_phrase_sql("summary", ["econ"])}
ORDER BY CASE WHEN lower(name) = 'econ' THEN 0 ELSE 1 END, downloads DESC, name LIMIT 10""")
def search_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-01, SNK-04 through the inverted index, written by token and read by filters."""
    packages, folder = _packages(spark, sf_dir), new_folder(spark, "postings")
    search.write_postings(search.postings(packages), folder)
    return search.search_postings(spark.read.parquet(folder), packages, "econ", 10)


@query()
def search_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-02: stems of both sides; no SQL, unit tests compare it with another implementation."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("summary"), F.col("n_chars").alias("downloads"))
    return search.search(docs, "of the", 20, stemmed=True).select("name", "downloads")


@query("""
SELECT p_partkey, trim(replace(replace(replace(replace(replace(replace(replace(replace(replace(trim(q), '"', ''), ' OR ', ' '), ' or ', ' '), ' AND ', ' '), ' and ', ' '), ' NOT ', ' '), ' not ', ' '), ' NEAR ', ' '), ' near ', ' ')) AS clean
FROM (SELECT p_partkey, ' "' || p_name || '" OR OR ' || p_type || ' and not ' || p_brand || ' NEAR ' AS q FROM part)""")
def sanitize_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-01."""
    q = F.concat(F.lit(' "'), "p_name", F.lit('" OR OR '), "p_type", F.lit(" and not "), "p_brand", F.lit(" NEAR "))
    return read(spark, sf_dir, "part").select("p_partkey", search.sanitize(q).alias("clean"))


# --- releases ------------------------------------------------------------------------------------


def _order_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as releases of their customer."""
    return read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("timestamp").alias("released_at"))


@query("""
SELECT o_custkey, max(o_orderdate) AS last_released_at, count_if(o_orderdate >= TIMESTAMP '1997-09-01') AS releases_last_12mo,
  CASE WHEN count(*) >= 2 THEN round((epoch(max(o_orderdate)) - epoch(min(o_orderdate))) / 3600 / 24 / (count(*) - 1) * 10) / 10 ELSE 0 END::DOUBLE AS avg_days_between_releases
FROM orders GROUP BY 1""")
def release_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04, DAT-01, MTH-01: release frequency."""
    found = releases.cadence(_order_times(spark, sf_dir), ["o_custkey"], ORDERS_AS_OF)
    return found.withColumn("last_released_at", F.col("last_released_at").cast("timestamp_ntz"))


@query("""
WITH spine AS (SELECT o_custkey, q AS start FROM (SELECT DISTINCT o_custkey FROM orders), generate_series(TIMESTAMP '1996-07-01', TIMESTAMP '1998-09-01', INTERVAL 3 MONTHS) s(q)),
counts AS (SELECT o_custkey, date_trunc('quarter', o_orderdate) AS start, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_custkey, year(start) || ' Q' || quarter(start) AS quarter, coalesce(n, 0)::BIGINT AS releases FROM spine LEFT JOIN counts USING (o_custkey, start)""")
def release_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-05, WIN-07: zero-filled quarters."""
    return releases.quarters(_order_times(spark, sf_dir), ["o_custkey"], ORDERS_AS_OF)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as release files of its order: returned ones are wheels, the rest source archives."""
    kind = F.when(F.col("l_returnflag") == "R", "bdist_wheel").when(F.col("l_returnflag") == "N", "sdist").otherwise("egg")
    tags = F.array(*map(F.lit, ("any", "manylinux2014_x86_64", "manylinux_2_17_aarch64", "musllinux_1_1_x86_64", "macosx_11_0_universal2", "macosx_11_0_arm64", "win_amd64", "odd")))
    tag = F.element_at(tags, (F.col("l_partkey") % 8 + 1).cast("int"))
    base = F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit("-1.0"))
    end = F.when(F.col("l_linenumber") % 2 == 0, ".zip").otherwise(".tar.gz")
    name = F.when(kind == "bdist_wheel", F.concat(base, F.lit("-py3-none-"), tag, F.lit(".whl"))).otherwise(F.concat(base, end))
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", (F.col("l_linenumber").cast("bigint") * 10**9 + F.col("l_partkey")).alias("ord"), kind.alias("packagetype"), name.alias("filename"), (F.col("l_quantity") - 1).cast("bigint").alias("size"), F.concat(F.lit("https://files/"), name).alias("url")
    )


FILES = """files AS (
  SELECT *, 'https://files/' || filename AS url FROM (
  SELECT l_orderkey, l_linenumber::BIGINT * 1000000000 + l_partkey AS ord, kind AS packagetype, (l_quantity - 1)::BIGINT AS size, tag,
    CASE WHEN kind = 'bdist_wheel' THEN 'p' || l_partkey || '-1.0-py3-none-' || tag || '.whl' ELSE 'p' || l_partkey || '-1.0' || CASE WHEN l_linenumber % 2 = 0 THEN '.zip' ELSE '.tar.gz' END END AS filename
  FROM (SELECT *, CASE l_returnflag WHEN 'R' THEN 'bdist_wheel' WHEN 'N' THEN 'sdist' ELSE 'egg' END AS kind,
    ['any', 'manylinux2014_x86_64', 'manylinux_2_17_aarch64', 'musllinux_1_1_x86_64', 'macosx_11_0_universal2', 'macosx_11_0_arm64', 'win_amd64', 'odd'][l_partkey % 8 + 1] AS tag FROM lineitem)))"""


@query(f"""
WITH RECURSIVE {FILES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, packagetype ORDER BY ord, packagetype, size) AS r FROM files WHERE packagetype <> 'egg'),
fold AS (
  SELECT l_orderkey, packagetype, 0::BIGINT AS r, 0::BIGINT AS acc FROM (SELECT DISTINCT l_orderkey, packagetype FROM ranked)
  UNION ALL SELECT f.l_orderkey, f.packagetype, f.r + 1, CASE WHEN f.acc = 0 OR n.size < f.acc THEN n.size ELSE f.acc END FROM fold f JOIN ranked n ON n.l_orderkey = f.l_orderkey AND n.packagetype = f.packagetype AND n.r = f.r + 1),
ends AS (SELECT l_orderkey, packagetype, arg_max(acc, r) AS least FROM fold GROUP BY 1, 2)
SELECT o.l_orderkey, CASE WHEN coalesce(w.least, 0) > 0 THEN w.least ELSE coalesce(s.least, 0) END AS install_size
FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN ends w ON w.l_orderkey = o.l_orderkey AND w.packagetype = 'bdist_wheel' LEFT JOIN ends s ON s.l_orderkey = o.l_orderkey AND s.packagetype = 'sdist'""")
def install_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-06: with the zero that means unknown."""
    return releases.install_size(_files(spark, sf_dir), ["l_orderkey"])


@query(f"""
WITH {FILES}, t AS (SELECT l_orderkey, CASE WHEN packagetype = 'bdist_wheel' THEN tag ELSE '' END AS t FROM files)
SELECT l_orderkey, bool_or(t = 'any') AS pure_python, bool_or(t LIKE '%manylinux%x86_64%') AS linux_x86_64, bool_or(t LIKE '%manylinux%aarch64%') AS linux_arm64,
  bool_or(t LIKE '%macosx%universal2%') AS macos_x86_64, bool_or(t LIKE '%macosx%') AS macos_arm64, bool_or(t = 'win_amd64') AS windows_x86_64, bool_or(t LIKE '%musllinux%') AS musl
FROM t GROUP BY 1""")
def platform_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-07, STR-10."""
    return releases.platforms(_files(spark, sf_dir), ["l_orderkey"])


@query(f"""
WITH {FILES}, w AS (SELECT *, filename NOT LIKE '%none-any%' AS impure FROM files)
SELECT o.l_orderkey, (SELECT filename FROM w WHERE w.l_orderkey = o.l_orderkey AND packagetype = 'bdist_wheel' ORDER BY impure, size, filename LIMIT 1) AS wheel,
  (SELECT filename FROM w WHERE w.l_orderkey = o.l_orderkey AND packagetype = 'sdist' ORDER BY CASE WHEN filename LIKE '%.tar.gz' THEN 0 ELSE 1 END, filename LIMIT 1) AS sdist,
  coalesce((SELECT url FROM w WHERE w.l_orderkey = o.l_orderkey AND packagetype = 'bdist_wheel' ORDER BY impure, ord, url LIMIT 1), '') AS wheel_url
FROM (SELECT DISTINCT l_orderkey FROM lineitem) o""")
def best_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-16, AGG-17, AGG-18, SRC-18."""
    return releases.best_files(_files(spark, sf_dir), ["l_orderkey"])


@query(f"""
WITH {FILES} SELECT o.l_orderkey, coalesce((SELECT CASE WHEN tag IN ('any', 'odd') THEN 'py3-none-' || tag ELSE 'platform-specific' END FROM files WHERE files.l_orderkey = o.l_orderkey AND packagetype = 'bdist_wheel' ORDER BY ord LIMIT 1), 'sdist-only') AS module_format
FROM (SELECT DISTINCT l_orderkey FROM lineitem) o""")
def module_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-19, FIL-28."""
    return releases.first_format(_files(spark, sf_dir), ["l_orderkey"])


@query("""
SELECT p_brand, arg_max(v, k) AS latest FROM (
  SELECT p_brand, p_size || '.' || (p_partkey % 20) AS v, p_size * 100 + p_partkey % 20 AS k FROM part) GROUP BY 1""")
def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15, VER-01, JOIN-15."""
    part = read(spark, sf_dir, "part").select("p_brand", F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 20).cast("string")).alias("v"))
    return releases.latest_version(part, ["p_brand"], "v")


@query("""
SELECT p_brand, coalesce(arg_max(v, k) FILTER (p_size = 7), arg_max(v, k)) AS stub_version FROM (
  SELECT p_brand, p_size, p_size || '.' || (p_partkey % 20) AS v, p_size * 100 + p_partkey % 20 AS k FROM part) GROUP BY 1""")
def stub_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VER-02."""
    part = read(spark, sf_dir, "part").select("p_brand", F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 20).cast("string")).alias("v"))
    return releases.stub_version(part, ["p_brand"], "v", F.lit("7"))


@query("""
SELECT p_partkey, v AS version, rank FROM (SELECT p_partkey, p_size || '.' || (p_partkey % 20) AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey % 20 DESC, p_partkey) AS rank FROM part WHERE p_size * 100 + p_partkey % 20 > 1003 AND p_size * 100 + p_partkey % 20 <= 3007)""")
def version_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-07, TOP-06: versions of each brand after 10.3 up to 30.7, newest first."""
    v = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 20).cast("string"))
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", v.alias("version"))
    fit = part.filter(versions.in_range(F.col("version"), F.lit("10.3"), F.lit("30.7")))
    newest = Window.partitionBy("p_brand").orderBy(F.desc(versions.version_key(F.col("version"))), "p_partkey")
    return fit.withColumn("rank", F.row_number().over(newest)).drop("p_brand")


@query("""
SELECT p_partkey, CASE WHEN p_size < s2 OR (p_size = s2 AND a < b) THEN -1 WHEN p_size = s2 AND a = b THEN 0 ELSE 1 END AS cmp,
  CASE WHEN p_size > s2 OR (p_size = s2 AND a >= b) THEN 'from must be older than to' END AS problem
FROM (SELECT *, p_partkey % 7 + 1 AS s2, p_partkey % 20 AS a, p_partkey % 3 AS b FROM part)""")
def version_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VER-01, FIL-08."""
    a = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 20).cast("string"), F.lit("0rc1"))
    b = F.concat_ws(".", (F.col("p_partkey") % 7 + 1).cast("string"), (F.col("p_partkey") % 3).cast("string"))
    return read(spark, sf_dir, "part").select("p_partkey", versions.compare(a, b).alias("cmp"), versions.diff_problem(a, b).alias("problem"))


# --- requirements, people, links -----------------------------------------------------------------


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 2 THEN '' WHEN 3 THEN 'https://x/' || p_size ELSE '>=' || p_size END AS constraint_, 'pkg' || p_size AS name, CASE WHEN p_partkey % 2 = 0 THEN 'e' || (p_partkey % 4) END AS extra FROM part""")
def requirement_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-03, STR-04, STR-05: five forms of a requirement, taken apart."""
    size, k = F.col("p_size").cast("string"), F.col("p_partkey")
    spec = (
        F.when(k % 5 == 0, F.concat(F.lit("pkg"), size, F.lit(" (>="), size, F.lit(")")))
        .when(k % 5 == 1, F.concat(F.lit("pkg"), size, F.lit("[all] >="), size))
        .when(k % 5 == 2, F.concat(F.lit(" pkg"), size, F.lit(" ")))
        .when(k % 5 == 3, F.concat(F.lit("pkg"), size, F.lit(" @ https://x/"), size))
        .otherwise(F.concat(F.lit("pkg"), size, F.lit(">="), size))
    )
    raw = F.when(k % 2 == 0, F.concat(spec, F.lit(' ; extra == "e'), (k % 4).cast("string"), F.lit('"'))).otherwise(F.concat(spec, F.lit(' ; python_version < "3.8"')))
    parsed = read(spark, sf_dir, "part").select("p_partkey", requirements.requirement(raw).alias("r"))
    return parsed.select("p_partkey", F.col("r.constraint").alias("constraint_"), "r.name", "r.extra")


@query("""
WITH d AS (SELECT l_orderkey, l_linenumber, 'pkg' || l_partkey AS name, CASE WHEN l_linenumber % 3 = 0 THEN 'x' || (l_suppkey % 2) END AS extra FROM lineitem)
SELECT l_orderkey, count_if(extra IS NULL) AS n_required, array_to_string(list(name ORDER BY l_linenumber, name) FILTER (extra IS NULL), ',') AS required_names, count(DISTINCT extra) AS n_extras FROM d GROUP BY 1""")
def dependency_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10, TOP-09, TOP-10: requirements of an order by extra."""
    k = F.col("l_linenumber")
    name = F.concat(F.lit("pkg"), F.col("l_partkey").cast("string"))
    raw = F.when(k % 3 == 0, F.concat(name, F.lit(' ; extra == "x'), (F.col("l_suppkey") % 2).cast("string"), F.lit('"'))).otherwise(name)
    lists = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", raw.alias("raw")))), lambda x: x["raw"]).alias("raw"))
    tree = lists.select("l_orderkey", requirements.dependency_tree(F.col("raw")).alias("t"))
    names_ = F.transform("t.required", lambda d: d["name"])
    return tree.select("l_orderkey", F.size("t.required").cast("bigint").alias("n_required"), F.when(F.size(names_) > 0, F.array_join(names_, ",")).alias("required_names"), F.size("t.extras").cast("bigint").alias("n_extras"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN 'maintained by ' || c_name ELSE c_name END AS first_name,
  CASE c_custkey % 4 WHEN 0 THEN 'a' || c_custkey || '@x.org' WHEN 1 THEN 'b' || c_custkey || '@x.org' WHEN 2 THEN '' ELSE 'c@x.org' END AS first_email, CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 1 END AS people FROM customer""")
def maintainers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-06..09, TOP-13: addresses, positional names, names alone, the maintainer's."""
    k, n = F.col("c_custkey"), F.col("c_name")
    ks = k.cast("string")
    email = F.when(k % 4 == 0, F.concat(n, F.lit(" <a"), ks, F.lit("@x.org>, Doe, Jane <jane@x.org>"))).when(k % 4 == 1, F.concat(F.lit("b"), ks, F.lit("@x.org")))
    author = F.when(k % 4 <= 2, n)
    other = F.when(k % 4 == 3, F.concat(F.lit("maintained by "), n, F.lit(" <c@x.org>")))
    people = requirements.maintainers(author, email, F.lit(None).cast("string"), other)
    found = read(spark, sf_dir, "customer").select("c_custkey", people.alias("p"))
    return found.select("c_custkey", F.col("p")[0]["name"].alias("first_name"), F.col("p")[0]["email"].alias("first_email"), F.size("p").alias("people"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 6 = 5 THEN '' ELSE (p_size % 3 + 2) || '.' || (p_partkey % 9) END AS python_min FROM part""")
def python_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-11: lower bounds by operator."""
    k = F.col("p_partkey")
    v = F.concat_ws(".", (F.col("p_size") % 3 + 2).cast("string"), (k % 9).cast("string"))
    spec = (
        F.when(k % 6 == 0, F.concat(F.lit("<4, >="), v))
        .when(k % 6 == 1, F.concat(F.lit("~="), v, F.lit(",!=3.9")))
        .when(k % 6 == 2, F.concat(F.lit("=="), v, F.lit(".*")))
        .when(k % 6 == 3, F.concat(F.lit(">1.0 , >= "), v))
        .when(k % 6 == 4, F.concat(F.lit("==="), v))
        .otherwise(F.concat(F.lit("<"), v))
    )
    return read(spark, sf_dir, "part").select("p_partkey", requirements.python_minimum(spec).alias("python_min"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN p_brand WHEN 2 THEN p_name ELSE 'Line ' || p_brand END AS license FROM part""")
def license_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-12: four places a licence may stand."""
    k = F.col("p_partkey")
    expr = F.when(k % 4 == 0, F.concat(F.lit(" "), "p_type"))
    classes = F.array(F.lit("Topic :: Text"), F.lit("License :: Odd"), F.when(k % 4 <= 1, F.concat(F.lit("License :: OSI Approved :: "), "p_brand")).otherwise("x"))
    raw = F.when(k % 4 <= 2, F.col("p_name")).otherwise(F.concat(F.lit("Line "), "p_brand", F.lit("\n"), F.repeat(F.lit("body "), 60)))
    return read(spark, sf_dir, "part").select("p_partkey", requirements.license_name(expr, classes, raw).alias("license"))


@query("""
SELECT page_id, contains(url, '://') AND NOT regexp_matches(url, '[\\x00-\\x1F\\x7F]') AND regexp_extract(url, '^([^:/?#]+):', 1) IN ('http', 'https', 'mailto', 'ftp', 'tel') AS link,
  page_id % 2 = 0 AS image FROM pages""")
def url_allow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-18, FIL-19: which URLs may be links, and which data URLs images."""
    data = F.when(F.col("page_id") % 2 == 0, "data:image/PNG;base64,AA").otherwise("data:image/svg+xml;base64,AA")
    return read(spark, sf_dir, "pages").select("page_id", urls.is_link(F.col("url")).alias("link"), urls.is_image(data).alias("image"))


@query("""
SELECT page_id, url AS doc, 'https://github.com/o' || page_id || '/r.git' AS repo, 'o' || page_id AS owner, 'r' AS name, 'g/s/p' || page_id AS gitlab, 3 AS safe FROM pages""")
def project_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-13..16, FIL-20, MAP-01: links by key priority."""
    k = F.col("page_id").cast("string")
    links = F.create_map(
        F.lit("Docs"), F.col("url"), F.lit("Homepage"), F.concat(F.lit("https://github.com/o"), k, F.lit("/r.git")), F.lit("Mirror"), F.concat(F.lit("https://gitlab.com/g/s/p"), k), F.lit("Bad"), F.lit("javascript:x")
    )
    gh = urls.github_repo(links)
    return read(spark, sf_dir, "pages").select(
        "page_id", urls.doc_url(links).alias("doc"), urls.repo_url(links).alias("repo"), gh["owner"].alias("owner"), gh["repo"].alias("name"), urls.gitlab_path(links).alias("gitlab"), F.size(urls.safe_links(links)).alias("safe")
    )


@query("""
SELECT p_partkey, regexp_matches(p_name, '^[a-zA-Z0-9]([a-zA-Z0-9._-]*[a-zA-Z0-9])?$') AND NOT contains(p_name, '..') AS name_ok, regexp_matches(p_brand, '^[a-zA-Z0-9][a-zA-Z0-9._+!~-]*$') AS version_ok,
  translate(lower(p_name), '-.', '__') AS module FROM part""")
def name_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-01, FIL-02, STR-24."""
    return read(spark, sf_dir, "part").select("p_partkey", names.valid_name(F.col("p_name")).alias("name_ok"), names.valid_version(F.col("p_brand")).alias("version_ok"), names.import_name(F.col("p_name")).alias("module"))


# --- formats -------------------------------------------------------------------------------------


@query("""
SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' ELSE (round_even(n_chars::DECIMAL(38, 0) * 10 / 1024, 0)::BIGINT // 10) || '.' || (round_even(n_chars::DECIMAL(38, 0) * 10 / 1024, 0)::BIGINT % 10) || ' KB' END AS size,
  CASE WHEN n_chars < 1000 THEN n_chars::VARCHAR ELSE (round_even(n_chars / 100.0, 0)::BIGINT // 10) || '.' || (round_even(n_chars / 100.0, 0)::BIGINT % 10) || 'K' END AS count,
  CASE WHEN length(text) > 28 THEN text[1:27] || '…' ELSE text END AS cell,
  CASE WHEN length(text) > 120 THEN sha256(text)[1:16] ELSE '' END AS digest, format('{:,}', n_chars) AS commas
FROM documents""")
def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-17..21."""
    n, t = F.col("n_chars"), F.col("text")
    return read(spark, sf_dir, "documents").select(
        "doc_id", fmt.human_bytes(n).alias("size"), fmt.human_count(n).alias("count"), fmt.cell(t).alias("cell"), fmt.shown_default(t)["digest"].alias("digest"), fmt.with_commas(n).alias("commas")
    )


@query("""
WITH o AS (SELECT o_custkey, max(o_orderdate) AS released FROM orders GROUP BY 1), c AS (SELECT o_custkey, max(l_shipdate) AS committed FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey, CASE WHEN released IS NULL THEN NULL WHEN c_custkey % 50 = 0 THEN 'likely_unmaintained'
  WHEN committed IS NOT NULL THEN CASE WHEN rd >= 1095 AND cd >= 730 THEN 'likely_unmaintained' WHEN rd >= 548 AND cd >= 365 THEN 'possibly_unmaintained' END
  ELSE CASE WHEN rd >= 1095 THEN 'likely_unmaintained' WHEN rd >= 730 THEN 'possibly_unmaintained' END END AS status
FROM (SELECT c_custkey, released, CASE WHEN c_custkey % 2 = 0 THEN committed END AS committed, (epoch(TIMESTAMP '2000-06-01') - epoch(released)) / 86400 AS rd, (epoch(TIMESTAMP '2000-06-01') - epoch(committed)) / 86400 AS cd
  FROM customer LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN c ON c.o_custkey = c_custkey)""")
def maintenance_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT-03: orders are releases, shipments commits of every second customer."""
    orders = read(spark, sf_dir, "orders")
    released = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("released"))
    shipped = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    committed = orders.join(shipped, "o_orderkey").groupBy("o_custkey").agg(F.max("l_shipdate").alias("committed"))
    all_ = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")).join(released, "o_custkey", "left").join(committed, "o_custkey", "left")
    commit = F.when(F.col("o_custkey") % 2 == 0, F.col("committed"))
    return all_.select(F.col("o_custkey").alias("c_custkey"), dates.maintenance_status(F.col("released"), commit, F.col("o_custkey") % 50 == 0, date(2000, 6, 1)).alias("status"))


# --- advisories ----------------------------------------------------------------------------------


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity::INT AS q FROM lineitem)
SELECT l_orderkey, 'V-' || l_orderkey || '-' || l_linenumber AS id, 'part ' || l_partkey AS summary, CASE l_returnflag WHEN 'R' THEN 'HIGH' WHEN 'A' THEN 'low' ELSE 'Unknown' END AS severity,
  CASE WHEN l_linenumber % 4 = 0 THEN '' WHEN q % 2 = 0 THEN '>=' || l_suppkey || ', <' || q ELSE '>=' || l_suppkey END AS affected_range,
  CASE WHEN l_linenumber % 4 <> 0 AND q % 2 = 0 THEN q::VARCHAR ELSE '' END AS fixed_in, 'https://v/' || l_partkey AS url FROM r""")
def vuln_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-03, SRC-05: nested advisories from JSON text, one row each."""
    q, k = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber")
    severity = F.when(F.col("l_returnflag") == "R", '[{"type":"X","score":"HIGH"}]').when(F.col("l_returnflag") == "A", '[{"type":"X","score":"low"},{"type":"X","score":"HIGH"}]').otherwise("[]")
    kind = F.when(k % 4 == 0, "GIT").otherwise("ECOSYSTEM")
    fixed = F.when(F.col("l_quantity").cast("int") % 2 == 0, F.concat(F.lit(',{"fixed":"1"},{"fixed":"'), q, F.lit('"}'))).otherwise("")
    text = F.concat(
        F.lit('{"id":"V-'), F.col("l_orderkey").cast("string"), F.lit("-"), k.cast("string"), F.lit('","summary":"part '), F.col("l_partkey").cast("string"), F.lit('","severity":'), severity,
        F.lit(',"affected":[{"ranges":[{"type":"SEMVER","events":[{"introduced":"9"}]},{"type":"'), kind, F.lit('","events":[{"introduced":"0"},{"introduced":"'), F.col("l_suppkey").cast("string"), F.lit('"}'), fixed,
        F.lit(']}]}],"references":[{"url":"https://v/'), F.col("l_partkey").cast("string"), F.lit('"},{"url":"no"}]}'),
    )
    parsed = read(spark, sf_dir, "lineitem").select("l_orderkey", F.from_json(text, vulns.SCHEMA).alias("v")).select("l_orderkey", "v.*")
    return vulns.flatten(parsed, ["l_orderkey"])


@query("""
WITH s AS (SELECT o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 1 ELSE 0 END AS r FROM orders)
SELECT o_custkey, CASE max(r) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' ELSE 'UNKNOWN' END AS max_severity FROM s GROUP BY 1""")
def max_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-08: order priorities as labels and CVSS vectors."""
    p = F.col("o_orderpriority")
    severity = F.when(p == "1-URGENT", "CVSS:3.1/AV:N/C:H/I:N/A:N").when(p == "2-HIGH", "high").when(p == "3-MEDIUM", "CVSS:3.1/AV:N/C:N/I:L/A:N").when(p == "4-NOT SPECIFIED", "Low").otherwise("odd")
    return vulns.worst(read(spark, sf_dir, "orders").withColumn("severity", severity), ["o_custkey"], "severity")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-01, PRJ-04: one field of a document."""
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


# --- comparisons ---------------------------------------------------------------------------------


def _supplier_parts(spark: SparkSession, sf_dir: str, late: bool) -> DataFrame:
    """Parts of a supplier before and after a day as requirements; the largest discount is the constraint."""
    cut = F.lit("1995-06-17").cast("timestamp_ntz")
    rows = read(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") >= cut if late else F.col("l_shipdate") < cut)
    return rows.groupBy("l_suppkey", F.concat(F.lit("Part"), F.col("l_partkey").cast("string")).alias("name")).agg(F.round(F.max("l_discount") * 100).cast("bigint").cast("string").alias("constraint"), F.lit(1).alias("ord"))


_SIDES = """
a AS (SELECT l_suppkey, 'part' || l_partkey AS name, round(max(l_discount) * 100)::BIGINT::VARCHAR AS c FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-17' GROUP BY 1, 2),
b AS (SELECT l_suppkey, 'part' || l_partkey AS name, round(max(l_discount) * 100)::BIGINT::VARCHAR AS c FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-17' GROUP BY 1, 2),
d AS (SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' WHEN a.c <> b.c THEN 'changed' END AS change, coalesce(a.name, b.name) AS name, a.c AS old, b.c AS new
  FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey AND a.name = b.name)"""


@query(f"WITH {_SIDES} SELECT * FROM d WHERE change IS NOT NULL")
def dep_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-03, SET-01, TOP-07."""
    return diff.dependency_changes(_supplier_parts(spark, sf_dir, False), _supplier_parts(spark, sf_dir, True), ["l_suppkey"])


@query(f"""
WITH {_SIDES} SELECT l_suppkey, change, name, old, new, truncated FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey, change ORDER BY name) AS r, greatest(count(*) OVER (PARTITION BY l_suppkey, change) - 5, 0) AS truncated FROM d WHERE change IS NOT NULL) WHERE r <= 5""")
def api_diff_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-09, SET-02."""
    return diff.capped(dep_diff(spark, sf_dir), ["l_suppkey"], 5)


@query("""
WITH o AS (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1),
req AS (SELECT r AS ord, 'customer#' || lpad((r * 13)::VARCHAR, 9, '0') AS name, r * 13 AS k FROM range(1, 200) t(r))
SELECT ord, req.name, c.c_nationkey, n_name, coalesce(orders, 0) AS orders, c.c_custkey IS NULL AS skipped
FROM req LEFT JOIN customer c ON lower(c.c_name) = req.name LEFT JOIN nation ON n_nationkey = c.c_nationkey LEFT JOIN o ON o_custkey = c.c_custkey""")
def compare_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-02: requested names with all that is known; missing ones are marked."""
    requested = spark.range(1, 200).select(F.col("id").alias("ord"), F.concat(F.lit("customer#"), F.lpad((F.col("id") * 13).cast("string"), 9, "0")).alias("name"))
    customers = read(spark, sf_dir, "customer").withColumn("name", F.lower("c_name"))
    nation = customers.join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("name", "n_name")
    counts = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders")).join(customers, "c_custkey").select("name", "orders")
    found = diff.compare(requested, customers.select("name", "c_nationkey"), nation, counts)
    return found.select("ord", "name", "c_nationkey", "n_name", F.coalesce("orders", F.lit(0)).alias("orders"), "skipped")


@query("""
SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 2 THEN NULL ELSE lower(n_name) || ',pkg' END AS names, CASE n_nationkey % 3 WHEN 2 THEN 'invalid package name: a..b' END AS problem
FROM (SELECT n_nationkey, replace(n_name, ' ', '') AS n_name FROM nation)""")
def compare_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-14, TOP-03."""
    name = F.replace("n_name", F.lit(" "), F.lit(""))
    raw = F.when(F.col("n_nationkey") % 3 == 2, "x,a..b").otherwise(F.concat(name, F.lit(", PKG,,pkg, "), F.lower(name)))
    parsed = read(spark, sf_dir, "nation").select("n_nationkey", diff.parse_names(raw).alias("p"))
    return parsed.select("n_nationkey", F.array_join("p.names", ",").alias("names"), "p.problem")


# --- changelogs ----------------------------------------------------------------------------------


@query("""
WITH lines AS (SELECT conv_id, turn, role, text FROM conversations)
SELECT conv_id, turn + 1 AS ord, '1.' || turn AS version, CASE WHEN turn % 2 = 0 THEN 'v1.' || turn ELSE '1.' || turn END AS tag_name, CASE WHEN turn % 2 = 0 THEN '2024-01-0' || (turn % 9 + 1) ELSE '' END AS date, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS body
FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS turn FROM lines)) WHERE n >= 2""")
def changelog_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-02, WIN-05: turns of a conversation, whole, as sections of one text, taken apart again."""
    rows = read(spark, sf_dir, "conversations").withColumn("t", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1)
    head = F.when(F.col("t") % 2 == 0, F.concat(F.lit("## v1."), F.col("t").cast("string"), F.lit(" - 2024-01-0"), (F.col("t") % 9 + 1).cast("string"))).otherwise(F.concat(F.lit("## [1."), F.col("t").cast("string"), F.lit("]")))
    section = F.concat(head, F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    texts = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", section.alias("s")))), lambda x: x["s"]), "\n").alias("text"))
    return changelog.parse(texts, ["conv_id"], "text")


@query("""
SELECT lang, source, doc_id FROM (SELECT lang, source, doc_id, substr(source, 4)::INT AS p, min(substr(source, 4)::INT) OVER (PARTITION BY lang, doc_id % 10) AS least FROM documents) WHERE p = least""")
def source_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-08, STM-07: entries of the first source that has any."""
    docs = read(spark, sf_dir, "documents").select("lang", (F.col("doc_id") % 10).alias("bin"), "source", F.substring("source", 4, 9).cast("int").alias("priority"), "doc_id")
    return changelog.by_priority(docs, ["lang", "bin"]).select("lang", "source", "doc_id")


@query("""
SELECT user_id, newer, older FROM (SELECT user_id, 'v' || event_id AS newer, 'v' || lead(event_id) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS older FROM events) WHERE older IS NOT NULL""")
def tag_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-03, JOIN-16: neighbours in time."""
    events = read(spark, sf_dir, "events").select("user_id", F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("tag"), F.struct(-F.unix_micros(F.col("ts").cast("timestamp")), -F.col("event_id")).alias("o"))
    return changelog.tag_pairs(events, ["user_id"], "tag", "o")


@query("""
SELECT user_id, array_to_string(list(m ORDER BY event_id)[1:30], '|') AS messages, max(event_id) AS head FROM (
  SELECT user_id, event_id, CASE WHEN event_type NOT IN ('click') THEN event_type || ' done' END AS m FROM events) GROUP BY 1""".replace("list(m ORDER BY event_id)", "list(m ORDER BY event_id) FILTER (m IS NOT NULL)"))
def commit_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-11, SRC-15, FIL-21: first lines of commits without noise, at most thirty."""
    text = F.when(F.col("event_type") == "click", "Merge branch x\n\nlong").otherwise(F.concat("event_type", F.lit(" done\n\nwhy")))
    events = read(spark, sf_dir, "events").withColumn("message", text)
    found = changelog.commit_messages(events, ["user_id"], "message", "event_id", "event_id")
    return found.select("user_id", F.when(F.size("messages") > 0, F.array_join("messages", "|")).alias("messages"), F.col("head_date").alias("head"))


# --- symbols and graphs --------------------------------------------------------------------------


@query("""
WITH RECURSIVE edges AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 0),
reach AS (SELECT p_partkey AS node FROM part WHERE p_brand = 'Brand#7' UNION SELECT child FROM reach JOIN edges ON parent = node)
SELECT node FROM reach""")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-08: all parts below those of one brand, the parent of k being k div 2."""
    part = read(spark, sf_dir, "part")
    edges = part.filter("p_partkey > 0").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 2").alias("parent"))
    return graph.closure(edges, part.filter("p_brand = 'Brand#7'").select(F.col("p_partkey").alias("node")))


@query("""
WITH RECURSIVE up AS (
  SELECT p_partkey AS node, p_partkey AS at, CASE WHEN p_size % 5 = 0 THEN p_name END AS v, 0 AS hop FROM part
  UNION ALL SELECT node, p.p_partkey, CASE WHEN p.p_size % 5 = 0 THEN p.p_name END, hop + 1 FROM up JOIN part p ON p.p_partkey = up.at // 2 WHERE v IS NULL AND up.at > 0)
SELECT node, arg_max(v, hop) AS init FROM (SELECT node, v, hop FROM up WHERE v IS NOT NULL UNION ALL SELECT p_partkey, NULL, -1 FROM part) GROUP BY node""")
def inherited_constructor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-07: the nearest ancestor with a value."""
    part = read(spark, sf_dir, "part")
    nodes = part.select(F.col("p_partkey").alias("node"), F.when(F.col("p_size") % 5 == 0, F.col("p_name")).alias("init"))
    edges = part.filter("p_partkey > 0").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 2").alias("parent"))
    return graph.inherit(nodes, edges, "init")


@query("""
SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY n, l_suppkey) = 1 AS published FROM (SELECT l_partkey, l_suppkey, min(l_linenumber) AS n FROM lineitem GROUP BY 1, 2)""")
def publish_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-05, WIN-06: one place for each definition."""
    places = read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_linenumber").alias("n"))
    return graph.publish_once(places, ["l_partkey"], [F.col("n"), F.col("l_suppkey")]).select("l_partkey", "l_suppkey", "published")


@query("""
WITH RECURSIVE defs AS (SELECT 'm' || (p_size % 10) AS module, 'n' || p_partkey AS name FROM part WHERE p_partkey % 3 = 0),
imps AS (SELECT 'm' || (p_partkey % 10) AS module, 'n' || p_partkey AS bound, 'm' || CASE WHEN p_partkey % 3 = 0 THEN p_size % 10 ELSE (p_partkey + 1) % 10 END AS source FROM part),
go AS (
  SELECT module AS m0, bound AS n, module AS m, 0 AS hop FROM imps
  UNION ALL SELECT m0, n, source, hop + 1 FROM go JOIN imps ON imps.module = go.m AND imps.bound = go.n WHERE hop < 15 AND NOT EXISTS (SELECT 1 FROM defs WHERE defs.module = go.m AND defs.name = go.n))
SELECT m0 AS module, n AS name, m AS def_module, n AS def_name, min(hop)::INT AS hops FROM go JOIN defs ON defs.module = go.m AND defs.name = go.n GROUP BY 1, 2, 3, 4""")
def import_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-02: what imported names stand for; two of three are never defined and stay unknown."""
    part, mod = read(spark, sf_dir, "part"), lambda c: F.concat(F.lit("m"), c.cast("string"))
    name = F.concat(F.lit("n"), F.col("p_partkey").cast("string"))
    defs = part.filter("p_partkey % 3 = 0").select(mod(F.col("p_size") % 10).alias("module"), name.alias("name"))
    source = mod(F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") % 10).otherwise((F.col("p_partkey") + 1) % 10))
    imps = part.select(mod(F.col("p_partkey") % 10).alias("module"), name.alias("bound"), source.alias("source"), name.alias("name"))
    return graph.lookup(defs, imps, imps.select("module", "name"))


@query("""
WITH RECURSIVE names AS (SELECT 'm' || p_size AS module, 'n' || p_partkey AS name FROM part UNION SELECT 'm' || (substr(module, 2)::INT - 1), name FROM names WHERE substr(module, 2)::INT > 40)
SELECT module, name FROM names""")
def star_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-03: stars of stars; m41 to m50 are imported whole by the module before each."""
    part = read(spark, sf_dir, "part")
    exports = part.select(F.concat(F.lit("m"), F.col("p_size").cast("string")).alias("module"), F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("name"))
    stars = spark.range(41, 51).select(F.concat(F.lit("m"), (F.col("id") - 1).cast("string")).alias("module"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("source"))
    return graph.star_names(exports, stars)


@query("""
SELECT l_suppkey, k AS name, arg_max(l_partkey, o) AS l_partkey, min(o) AS ord FROM (SELECT l_suppkey, l_partkey % 7 AS k, l_partkey, l_orderkey * 10 + l_linenumber AS o FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) = 1) GROUP BY 1, 2""")
def collapse_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12: the last item of a name at the place of the first. Of lines of one part in one place, the SQL leaves open which counts; here it is that of the smallest supplier."""
    one = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey")
    rows = read(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(one)).filter("r = 1")
    rows = rows.select("l_suppkey", (F.col("l_partkey") % 7).alias("name"), "l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return symbols.collapse_last(rows, ["l_suppkey", "name"])


_ENDINGS = ["\n:param x: y", "\n\nParameters\n----------\nx : int", "\n\nArgs:\n    x: y", "\n---\n"]


@query("""
WITH t AS (SELECT doc_id, text || [chr(10) || ':param x: y', chr(10) || chr(10) || 'Parameters' || chr(10) || '----------' || chr(10) || 'x : int', chr(10) || chr(10) || 'Args:' || chr(10) || '    x: y', chr(10) || '---' || chr(10)][doc_id % 4 + 1] AS raw FROM documents)
SELECT doc_id, CASE WHEN contains(raw, ':param ') OR contains(raw, ':type ') OR contains(raw, ':returns:') OR contains(raw, ':rtype:') THEN 'sphinx'
  WHEN regexp_matches(raw, '(?im)^[ \\t]*(parameters|params|other parameters|returns|return|yields|yield|receives|raises|raise|warns|warnings|see also|notes|references|examples|attributes|methods)[ \\t]*\\n[ \\t]*-{3,}[ \\t]*$') THEN 'numpy'
  WHEN regexp_matches(raw, '(?m)^\\s*(Args|Arguments|Returns|Return|Raises|Yields|Yield|Examples|Example|Note|Notes|Attributes|Todo|References|Parameters|Params):\\s*$') THEN 'google' ELSE 'plain' END AS style FROM t""")
def docstring_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-03: the style of every whole text, with one of four endings; a text that holds a field or section of its own is judged by all it holds."""
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("doc_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", docstrings.style(F.concat("text", ending)).alias("style"))


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module of source for each part."""
    k = F.col("p_partkey").cast("string")
    source = F.concat(
        F.lit('"""Module '), k, F.lit('."""\nfrom .base import *\nfrom typing import overload as ov\n__all__ = ["run", "Part"]\n__all__ += ["LIMIT"]\nLIMIT: int = 0x'), (F.col("p_size") + 10).cast("string"),
        F.lit("\n\nclass Part(Base):\n    size: int = "), F.col("p_size").cast("string"), F.lit('\n\n    def __init__(self, a, *, b="x"):\n        self.a = a\n\n    @property\n    def name(self) -> str: ...\n\n    @staticmethod\n    def make(x, /): ...\n\n'),
        F.when(F.col("p_partkey") % 10 == 0, "def broken(:\n    pass\n\n").otherwise(""), F.lit("async def run(*args: int, k=1) -> None:\n    pass\n"),
    )
    parts = spread(read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    return parts.select(F.concat(F.lit("pkg.m"), k).alias("module"), source.alias("source"))


@query("""
SELECT 'pkg.m' || p_partkey || s.path AS path, s.kind, replace(s.sig, '@', p_size::VARCHAR) AS signature, s.pub AS public
FROM part, (VALUES ('.LIMIT', 'attribute', NULL, true), ('.Part', 'class', 'class Part(Base)', true), ('.Part.size', 'attribute', NULL, true), ('.Part.__init__', 'method', 'def __init__(a, *, b="x")', true),
  ('.Part.a', 'attribute', NULL, true), ('.Part.name', 'property', NULL, true), ('.Part.make', 'method', 'def make(x, /)', true), ('.run', 'function', 'async def run(*args: int, k=1) -> None', true)) s(path, kind, sig, pub)""")
def extract_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LEX-01, PAR-01, SYM-01..05, SET-07, STR-28, FIL-11: symbols of generated modules; every tenth has a broken statement."""
    parsed = extract.modules(_modules(spark, sf_dir), parsed=extract.only("symbols", symbols=("path", "kind", "signature", "public")))
    return extract.symbols(parsed, ["module"]).select("path", "kind", "signature", "public")


@query("SELECT count(*) AS files, sum((p_partkey % 10 = 0)::INT)::BIGINT AS errors, count_if(p_partkey % 10 = 0) AS broken FROM part")
def parse_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14."""
    return extract.parse_totals(extract.modules(_modules(spark, sf_dir), parsed=extract.only("parse_errors")), [])


@query("""
SELECT 'pkg.m' || p_partkey AS module, s.source, s.star FROM part, (VALUES ('pkg.base', true), ('typing', false)) s(source, star)""")
def import_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-01: where imports lead."""
    found = extract.imports(extract.modules(_modules(spark, sf_dir), parsed=extract.only("imports")), ["module"])
    return found.select("module", graph.import_source(F.col("module"), F.lit(False), F.col("level"), F.col("source")).alias("source"), "star")


@query("""
SELECT 'pkg.m' || p_partkey || '.Part.a.b' AS dotted, 'pkg.m' || p_partkey || '.Part.a' AS path, 'attribute' AS kind FROM part""")
def resolve_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-12: the longest known prefix of a dotted path."""
    found = extract.symbols(extract.modules(_modules(spark, sf_dir), parsed=extract.only("symbols", symbols=("path", "kind"))), ["module"])
    asked = read(spark, sf_dir, "part").select(F.concat(F.lit("pkg.m"), F.col("p_partkey").cast("string"), F.lit(".Part.a.b")).alias("dotted"))
    return symbols.resolve(asked, found)


@query("""
SELECT path, kind, signature FROM (SELECT 'pkg.m' || p_partkey || s.path AS path, s.kind, s.sig AS signature FROM part, (VALUES ('.Part.make', 'method', 'def make(x, /)'), ('.Part.__init__', 'method', 'def __init__(a, *, b="x")')) s(path, kind, sig))
WHERE contains(lower(path), 'm1') ORDER BY path, kind LIMIT 40""")
def symbol_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SYM-10, FIL-10, TOP-08."""
    parsed = extract.modules(_modules(spark, sf_dir), parsed=extract.only("symbols", symbols=("path", "kind", "ord", "signature")))
    found = extract.symbols(parsed, ["module"])
    return symbols.listing(found, "M1", "method", 40)


@query("""
WITH a AS (SELECT 's' || l_suppkey || '.' || l_partkey AS p, max(l_quantity)::INT AS s FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1),
b AS (SELECT 's' || l_suppkey || '.' || l_partkey AS p, max(l_quantity)::INT AS s FROM lineitem WHERE l_linenumber > 2 GROUP BY 1),
ends AS (SELECT l_suppkey AS i, 's' || l_suppkey || '.' || min(l_partkey) AS t0, 's' || l_suppkey || '.' || CASE WHEN l_suppkey % 2 = 0 THEN min(l_partkey) ELSE max(l_partkey) END AS t1 FROM lineitem GROUP BY 1),
ra AS (SELECT p AS path, 'def f(' || s || ')' AS sig, NULL AS t FROM a UNION ALL SELECT 'x.' || i, coalesce('def f(' || s || ')', '-> ' || t0), t0 FROM ends LEFT JOIN a ON a.p = t0),
rb AS (SELECT p AS path, 'def f(' || s || ')' AS sig, NULL AS t FROM b UNION ALL SELECT 'x.' || i, coalesce('def f(' || s || ')', '-> ' || t1), t1 FROM ends LEFT JOIN b ON b.p = t1),
d AS (SELECT coalesce(ra.path, rb.path) AS name, ra.path IS NULL AS only_b, rb.path IS NULL AS only_a, CASE WHEN ra.t <> rb.t THEN '-> ' || ra.t ELSE ra.sig END AS old, CASE WHEN ra.t <> rb.t THEN '-> ' || rb.t ELSE rb.sig END AS new FROM ra FULL JOIN rb ON ra.path = rb.path)
SELECT CASE WHEN only_b THEN 'added' WHEN only_a THEN 'removed' ELSE 'changed' END AS change, name, old, new FROM d WHERE only_a OR only_b OR old <> new""")
def api_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-04, JOIN-10, JOIN-11, STR-32: signatures of two versions, a module for each supplier, a function for each of its parts, an alias for each module; those of odd ones move."""
    root = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit("."), F.col("l_partkey").cast("string"))
    lines = read(spark, sf_dir, "lineitem")
    side = lambda rows: rows.groupBy(root.alias("root")).agg(F.max("l_quantity").cast("int").alias("s")).select("root", F.lit("").alias("suffix"), F.concat(F.lit("def f("), F.col("s").cast("string"), F.lit(")")).alias("signature"))
    ends = lines.groupBy("l_suppkey").agg(F.min("l_partkey").alias("low"), F.max("l_partkey").alias("high"))
    path = F.concat(F.lit("x."), F.col("l_suppkey").cast("string"))
    alias = lambda c: ends.select(path.alias("path"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit("."), c.cast("string")).alias("target"))
    return diff.api_changes(side(lines.filter("l_linenumber <= 3")), side(lines.filter("l_linenumber > 2")), alias(F.col("low")), alias(F.when(F.col("l_suppkey") % 2 == 0, F.col("low")).otherwise(F.col("high"))))


# --- caches, text, streams -----------------------------------------------------------------------


def _kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as cache rows of four families and three versions."""
    k = F.col("o_orderkey")
    family = F.element_at(F.array(*map(F.lit, ("pkg:", "docs:v1:", "docs:v2:", "diff:v2:", "stats:"))), (k % 5 + 1).cast("int"))
    status = F.element_at(F.array(*map(F.lit, ("ok", "error", "empty"))), (k % 3 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select(F.concat(family, k.cast("string")).alias("key"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_totalprice").alias("value"))


KV = """kv AS (SELECT ['pkg:', 'docs:v1:', 'docs:v2:', 'diff:v2:', 'stats:'][o_orderkey % 5 + 1] || o_orderkey AS key, ['ok', 'error', 'empty'][o_orderkey % 3 + 1] AS status, o_orderdate AS created_at FROM orders)"""


@query(f"WITH {KV} SELECT substr(key, 5) AS name FROM kv WHERE starts_with(key, 'pkg:')")
def cached_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-28: names below a prefix."""
    return cache.names(_kv(spark, sf_dir))


@query(f"WITH {KV} SELECT key FROM kv WHERE NOT starts_with(key, 'docs:v1:')")
def cache_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-08: families of another version go."""
    return cache.purge_before(_kv(spark, sf_dir), 2).select("key")


@query(f"WITH {KV} SELECT key, status FROM kv WHERE status = 'ok' OR epoch(TIMESTAMP '1995-01-02 00:00:00') - epoch(created_at) < CASE status WHEN 'error' THEN 300 ELSE 86400 END")
def cache_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-10: what still holds, by status."""
    return cache.usable(_kv(spark, sf_dir), datetime(1995, 1, 2)).select("key", "status")


@query(f"""
WITH {KV}, new AS (SELECT key, 'new' AS status FROM kv WHERE starts_with(key, 'stats:')) SELECT key, status FROM kv WHERE key NOT IN (SELECT key FROM new) UNION ALL SELECT * FROM new""")
def cache_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-06: rows replaced by key."""
    kv = _kv(spark, sf_dir)
    new = kv.filter(F.col("key").startswith("stats:")).withColumns({"status": F.lit("new"), "created_at": F.lit(datetime(2000, 1, 1))})
    older = new.withColumns({"status": F.lit("older"), "created_at": F.lit(datetime(1999, 1, 1))})
    return cache.put(kv, new.unionByName(older)).select("key", "status")


@query("""
SELECT p_partkey, 'p' || p_partkey || chr(9) || p_size || chr(9) || p_name || ' ' || p_type AS line FROM part""")
def search_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-11: result lines; tabs and breaks in a summary become blanks."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").alias("downloads"), F.concat("p_name", F.lit("\t"), "p_type").alias("summary"))
    lines = text_sinks.search_tsv(part).filter("ord >= 0").select("line")
    return lines.select(F.expr("CAST(substring(split(line, '\t')[0], 2) AS BIGINT)").alias("p_partkey"), "line")


@query("""
SELECT s_suppkey, 'name: ' || s_name || chr(10) || 'nation: ' || s_nationkey AS text FROM supplier""")
def key_value_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-13: `key: value` lines, blank values left out."""
    return read(spark, sf_dir, "supplier").select("s_suppkey", fmt.key_values(("name", F.col("s_name")), ("summary", F.lit("")), ("nation", F.col("s_nationkey").cast("string")), ("none", F.lit(None).cast("string"))).alias("text"))


@query(f"""
WITH {_SIDES}, l AS (SELECT l_suppkey, name, CASE change WHEN 'added' THEN 0 WHEN 'removed' THEN 1 ELSE 2 END AS r,
  CASE change WHEN 'added' THEN '+ added: ' || name WHEN 'removed' THEN '- removed: ' || name ELSE '~ bumped: ' || name || ' (' || old || ' → ' || new || ')' END AS line FROM d WHERE change IS NOT NULL)
SELECT l_suppkey, '## dependency changes' || chr(10) || string_agg(line, chr(10) ORDER BY r, name) AS text FROM l GROUP BY 1""")
def diff_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-13, STR-32: a diff as lines."""
    return text_sinks.changes_text(dep_diff(spark, sf_dir), ["l_suppkey"], "dependency changes", "bumped")


@query("""
SELECT conv_id, string_agg('## 1.' || t || CASE WHEN t % 2 = 0 THEN ' — 2024-01-0' || (t % 9 + 1) ELSE '' END || CASE WHEN body = '' THEN '' ELSE chr(10) || body END, chr(10) || chr(10) ORDER BY t) AS text
FROM (SELECT *, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS t, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE n >= 2 GROUP BY 1""")
def changelog_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-13: sections written out again."""
    return text_sinks.changelog_text(changelog_sections(spark, sf_dir), ["conv_id"])


@query("SELECT date_trunc('week', ts)::TIMESTAMP AS start, event_type AS category, count(*) AS downloads FROM events GROUP BY ALL")
def weekly_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event time: the weekly sums as a stream over landed files, run until all is read; changed sums go to files."""
    schema = read(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet") if not _is_file(spark, f"{sf_dir}/events.parquet") else spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    sums = sync.weekly_stream(events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("category")))
    folder = new_folder(spark, "weekly")
    sync.keep_sums(sums, f"{folder}/sums", f"{folder}/checkpoint").awaitTermination()
    return sync.latest_sums(spark, f"{folder}/sums").withColumn("start", F.col("start").cast("timestamp_ntz"))


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


from . import landed, modules, rules, wheels  # noqa: E402, F401  they register their queries
