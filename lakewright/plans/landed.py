"""Queries over landed documents: rows are written out as the JSON files a source lands, one file a document, and read back by its reader."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import variants
from ..shared import new_folder
from ..sources import dumps
from ..streaming import cycle
from .catalog import query, read


def _land(df: DataFrame, document: Column, name: str) -> str:
    """The folder of one file for each row; the documents here are as many as nations or kinds of events."""
    folder = new_folder(df.sparkSession, name)
    df.select(F.to_json(document).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return folder


def _by_nation(spark: SparkSession, sf_dir: str, item: Column) -> DataFrame:
    """(nation, items): customers in the order of their keys as a list for each nation; a list is what such a document is."""
    rows = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.struct("c_custkey", item.alias("item")).alias("x"))
    return rows.groupBy("nation").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["item"]).alias("items"))


@query("SELECT c_name AS name FROM customer")
def landed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-16: the name index."""
    rows = _by_nation(spark, sf_dir, F.struct(F.col("c_name").alias("name"), F.lit(1).alias("more")))
    return dumps.name_index(spark, _land(rows, F.struct(F.col("items").alias("projects"), F.lit("x").alias("meta")), "names"))


@query("SELECT c_name AS name, c_custkey * 10 AS downloads FROM customer")
def landed_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-17: the list of most downloaded packages."""
    rows = _by_nation(spark, sf_dir, F.struct(F.col("c_name").alias("project"), (F.col("c_custkey") * 10).alias("download_count")))
    return dumps.top_packages(spark, _land(rows, F.struct(F.col("items").alias("rows")), "top"))


@query("SELECT c_name AS name FROM customer")
def split_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-16: the name index, each document read in ranges by several tasks."""
    rows = _by_nation(spark, sf_dir, F.struct(F.col("c_name").alias("name"), F.lit(1).alias("more")))
    folder = _land(rows, F.struct(F.lit('x] "projects": [').alias("meta"), F.col("items").alias("projects"), F.array(F.lit(1)).alias("after")), "split-names")
    return dumps.name_index_split(spark, folder, 4096)


@query("SELECT c_name AS name, c_custkey * 10 AS downloads FROM customer")
def split_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-17: the list of most downloaded packages, in ranges."""
    rows = _by_nation(spark, sf_dir, F.struct(F.col("c_name").alias("project"), (F.col("c_custkey") * 10).alias("download_count")))
    return dumps.top_packages_split(spark, _land(rows, F.struct(F.col("items").alias("rows")), "split-top"), 4096)


@query("SELECT event_type AS package, 'overall' AS series, CASE WHEN ts::DATE >= DATE '2024-01-10' THEN 'late' ELSE 'early' END AS category, ts::DATE AS day, count(*) AS downloads FROM events GROUP BY ALL")
def landed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-04: a download series for each kind of event."""
    day = F.col("ts").cast("date")
    sums = read(spark, sf_dir, "events").groupBy("event_type", day.alias("date"), F.when(day >= F.lit(date(2024, 1, 10)), "late").otherwise("early").alias("category")).agg(F.count("*").alias("downloads"))
    rows = sums.groupBy("event_type").agg(F.collect_list(F.struct("category", "date", "downloads")).alias("data"))  # days of a kind
    return dumps.downloads(spark, _land(rows, F.struct(F.col("event_type").alias("package"), F.lit("overall").alias("type"), "data"), "series"))


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package document for each nation, with two releases and their files."""
    k = F.col("n_nationkey")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    file = lambda name, size, kind, stamp: F.struct(name.alias("filename"), size.cast("long").alias("size"), F.lit(kind).alias("packagetype"), F.lit(stamp).alias("upload_time_iso_8601"), F.struct(F.lit("00").alias("sha256")).alias("digests"))
    wheel = file(text("pk-2.0-py3-none-", F.when(k % 2 == 0, "any").otherwise("win_amd64"), ".whl"), k + 1, "bdist_wheel", "2024-03-01T00:00:00Z")
    sdist, old = file(F.lit("pk-2.0.tar.gz"), k + 500, "sdist", "2024-03-02T00:00:00Z"), file(F.lit("pk-1.0.zip"), k + 7, "sdist", "2024-02-20T00:00:00Z")
    info = F.struct(
        F.col("n_name").alias("name"), F.lit("2.0").alias("version"), text("about ", F.col("n_name")).alias("summary"), F.lit("MIT").alias("license"), text(">=3.", k % 9).alias("requires_python"),
        F.array(text("dep", k, ">=1"), F.lit('more ; extra == "x"')).alias("requires_dist"), F.create_map(F.lit("Docs"), text("https://docs/", k), F.lit("Bad"), F.lit("javascript:x")).alias("project_urls"),
        text("a", k, "@x.org").alias("author_email"), F.array(F.lit("Topic :: Text")).alias("classifiers"),
    )
    document = F.struct(info.alias("info"), F.create_map(F.lit("1.0"), F.array(old), F.lit("2.0"), F.array(wheel, sdist)).alias("releases"), F.when(k % 3 == 0, F.array(sdist)).otherwise(F.array(wheel, sdist)).alias("urls"))
    return dumps.packages(spark, _land(read(spark, sf_dir, "nation"), document, "packages"))


@query("""
SELECT n_name AS name, '2.0' AS version, 'about ' || n_name AS summary, 'MIT' AS license, '3.' || (n_nationkey % 9) AS python_min, 'dep' || n_nationkey AS requires, 'a' || n_nationkey || '@x.org' AS email, 'https://docs/' || n_nationkey AS doc_url, 1 AS links,
  (CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey + 500 ELSE n_nationkey + 1 END)::BIGINT AS install_size, CASE WHEN n_nationkey % 3 = 0 THEN 'sdist-only' WHEN n_nationkey % 2 = 0 THEN 'py3-none-any' ELSE 'platform-specific' END AS module_format,
  n_nationkey % 3 <> 0 AND n_nationkey % 2 = 0 AS pure, 10.0::DOUBLE AS days FROM nation""")
def package_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-01, PRJ-01, JSON-02: what a package page shows of a package document."""
    rows = dumps.package_row(_packages(spark, sf_dir), date(2024, 6, 1))
    return rows.select(
        "name", "version", "summary", "license", "python_min", F.col("dependencies.required")[0]["name"].alias("requires"), F.col("maintainers")[0]["email"].alias("email"), "doc_url", F.size("project_urls").alias("links"),
        "install_size", "module_format", F.col("platforms.pure_python").alias("pure"), F.col("avg_days_between_releases").alias("days"),
    )


@query("SELECT min(n_name) AS name, '2.0' AS version, 'dep' || arg_min(n_nationkey, n_name) || '>=1' AS first FROM nation")
def package_at_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-02: one version of one package, whatever the case of its name."""
    name = read(spark, sf_dir, "nation").agg(F.min("n_name")).first()[0]
    found = dumps.at_version(_packages(spark, sf_dir), name.lower(), "2.0")
    return found.select("info.name", "info.version", F.col("info.requires_dist")[0].alias("first"))


@query("""
SELECT n_name AS package, '2.0' AS version, 0 AS ord, 'pk-2.0-py3-none-' || CASE WHEN n_nationkey % 2 = 0 THEN 'any' ELSE 'win_amd64' END || '.whl' AS filename, (n_nationkey + 1)::BIGINT AS size FROM nation
UNION ALL SELECT n_name, '2.0', 1, 'pk-2.0.tar.gz', n_nationkey + 500 FROM nation UNION ALL SELECT n_name, '1.0', 0, 'pk-1.0.zip', n_nationkey + 7 FROM nation""")
def landed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-02, SRC-18: the files of all releases."""
    return dumps.release_files(_packages(spark, sf_dir)).select("package", "version", "ord", "filename", "size")


@query("""
SELECT 'v' || c_custkey || '.0' AS tag_name, c_custkey || '.0' AS version, c_name AS title, (r - 1)::INT AS ord FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) WHERE r <= 100""")
def landed_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-07, SRC-12: releases as a forge lists them, the first hundred of each repository."""
    tag = F.concat(F.lit("v"), F.col("c_custkey").cast("string"), F.lit(".0"))
    rows = _by_nation(spark, sf_dir, F.struct(tag.alias("tag_name"), F.col("c_name").alias("name"), F.lit(False).alias("draft")))
    return dumps.forge_releases(spark, _land(rows, F.col("items"), "releases")).select("tag_name", "version", "title", "ord")


@query("""
SELECT t AS name, 'sha' || c_custkey AS sha FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 'build-' || c_custkey ELSE 'v' || c_custkey || '.1' END AS t, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) WHERE r <= 50 AND regexp_matches(t, '^v?\\d+\\.\\d')""")
def landed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10, SRC-14, FIL-22: of the first fifty tags of each repository those that name a version."""
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("build-"), k.cast("string"))).otherwise(F.concat(F.lit("v"), k.cast("string"), F.lit(".1")))
    sha = F.concat(F.lit("sha"), k.cast("string"))
    commit = F.when(k % 2 == 0, F.struct(sha.alias("sha"), F.lit(None).cast("string").alias("id"))).otherwise(F.struct(F.lit(None).cast("string").alias("sha"), sha.alias("id")))
    rows = _by_nation(spark, sf_dir, F.struct(name.alias("name"), commit.alias("commit")))
    return dumps.forge_tags(spark, _land(rows, F.col("items"), "tags")).select("name", "sha")


#: Documents of events: a number that is a text now and then, a field that some have, one that a kind lacks, and some that are broken.
_DOCUMENTS = """
SELECT event_id, event_type, concat('{"k": ', CASE WHEN event_type = 'click' AND event_id % 97 = 0 THEN concat('"', CAST(user_id AS STRING), '"') ELSE CAST(user_id AS STRING) END, CASE WHEN user_id % 50 = 7 THEN ', "extra": true' ELSE '' END,
  CASE WHEN event_type <> 'view' THEN concat(', "n": ', CAST(event_id AS STRING)) ELSE '' END, ', "in": {"of": [', CAST(event_id % 10 AS STRING), ', 1]}', CASE WHEN event_id % 89 = 0 THEN '' ELSE '}' END) AS doc FROM events"""
_DOCUMENTS_SQL = f"d AS ({_DOCUMENTS.replace('AS STRING', 'AS VARCHAR')}), ok AS (SELECT *, CASE WHEN json_valid(doc) THEN doc::JSON END AS j FROM d)"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "events").select("event_id", "event_type", "user_id").createOrReplaceTempView("lakewright_events")
    found = spark.sql(_DOCUMENTS.replace("FROM events", "FROM lakewright_events"))
    return found.select("event_id", "event_type", variants.parsed(F.col("doc")).alias("doc"))


@query(f"""
WITH {_DOCUMENTS_SQL} SELECT event_id, CASE WHEN json_type(j, '$.k') <> 'VARCHAR' THEN (j->>'$.k')::BIGINT ELSE try_cast(j->>'$.k' AS BIGINT) END AS k, (j->>'$.n')::BIGINT AS n, (j->>'$.in.of[0]')::BIGINT AS first, (j->>'$.extra')::BOOLEAN AS extra FROM ok""")
def variant_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-01, JSON-02, PRJ-04: documents parsed once, four fields by path and type."""
    wanted = {"k": ("$.k", "bigint"), "n": ("$.n", "bigint"), "first": ("$.in.of[0]", "bigint"), "extra": ("$.extra", "boolean")}
    return _documents(spark, sf_dir).select("event_id", *variants.fields(F.col("doc"), wanted))


#: What these documents should be.
_CONTRACT = "k bigint, n bigint, in struct<of: array<bigint>>, gone string"


@query(f"""
WITH {_DOCUMENTS_SQL}, kinds AS (SELECT DISTINCT event_type FROM ok), keys AS (SELECT DISTINCT event_type, unnest(json_keys(j)) AS key FROM ok WHERE j IS NOT NULL),
types AS (SELECT event_type, key, CASE WHEN count(DISTINCT t) > 1 THEN 'variant' ELSE min(t) END AS t FROM (
  SELECT event_type, key, CASE json_type(j, '$.' || key) WHEN 'UBIGINT' THEN 'bigint' WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'other' END AS t
  FROM ok JOIN (SELECT unnest(['k', 'n', 'in', 'extra']) AS key) u ON json_exists(j, '$.' || key)) GROUP BY ALL),
wanted(key, want) AS (VALUES ('k', 'bigint'), ('n', 'bigint'), ('in', 'other'), ('gone', 'string'))
SELECT event_type, '$.' || t.key AS path, CASE WHEN want IS NULL THEN 'unknown' ELSE 'changed' END AS what, coalesce(want, '') AS expected, t AS found FROM types t LEFT JOIN wanted w ON w.key = t.key WHERE want IS NULL OR want <> t
UNION ALL SELECT event_type, '$.' || w.key, 'missing', want, '' FROM kinds CROSS JOIN wanted w WHERE NOT EXISTS (SELECT 1 FROM keys WHERE keys.event_type = kinds.event_type AND keys.key = w.key)""")
def variant_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-04: the schema that the documents of each kind of event have, and where it leaves the contract."""
    found = variants.found_schema(_documents(spark, sf_dir), "doc", ["event_type"]).collect()  # a row for each kind of document
    contract = T._parse_datatype_string(_CONTRACT)
    rows = [(r.event_type, *x) for r in found for x in variants.deviations(r.schema, contract)]
    return spark.createDataFrame(rows, "event_type string, path string, what string, expected string, found string")


@query("""
WITH n AS (SELECT DISTINCT CASE WHEN c_custkey % 5 = 0 THEN lower(c_name) ELSE c_name END AS name, c_custkey, c_mktsegment FROM customer),
o AS (SELECT o_custkey, count(*) AS downloads FROM orders GROUP BY 1), d AS (SELECT n.*, coalesce(downloads, 0) AS downloads FROM n LEFT JOIN o ON o_custkey = c_custkey),
r AS (SELECT *, row_number() OVER (ORDER BY downloads DESC, name) AS place FROM d)
SELECT name, CASE WHEN place <= 50 AND name LIKE 'C%' THEN c_mktsegment ELSE '' END AS summary, downloads FROM r""")
def index_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-01: customers' names land twice, every fifth in lower case; counts come by the proper name, and summaries go to the fifty most ordered."""
    customer, folder = read(spark, sf_dir, "customer"), new_folder(spark, "index")
    name = F.when(F.col("c_custkey") % 5 == 0, F.lower("c_name")).otherwise(F.col("c_name"))
    landed = customer.select(name.alias("name"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("c_custkey") % 60).alias("landed_at"))
    landed.unionByName(landed).write.json(f"{folder}/names")
    counts = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("downloads"))
    customer.join(counts, "c_custkey").select(F.col("c_name").alias("name"), "downloads").write.json(f"{folder}/downloads")
    customer.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("summary")).write.json(f"{folder}/summaries")
    names = spark.readStream.schema("name string, landed_at timestamp").json(f"{folder}/names")
    cycle.follow(names, f"{folder}/downloads", f"{folder}/summaries", f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return cycle.index(spark, f"{folder}/table")
