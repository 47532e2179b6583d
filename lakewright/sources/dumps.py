"""Landed JSON documents, with explicit schemas: nothing is inferred, unknown fields go."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays

NAMES = "projects array<struct<name: string>>"
TOP = "rows array<struct<project: string, download_count: bigint>>"
FILE = "struct<filename: string, url: string, size: bigint, packagetype: string, python_version: string, requires_python: string, upload_time_iso_8601: string, digests: struct<sha256: string>>"
INFO = (
    "struct<name: string, version: string, summary: string, description: string, description_content_type: string, license: string, license_expression: string, author: string, author_email: string, maintainer: string, maintainer_email: string, "
    "requires_python: string, requires_dist: array<string>, classifiers: array<string>, project_urls: map<string, string>, keywords: string, home_page: string, yanked: boolean>"
)
PACKAGE = f"info {INFO}, releases map<string, array<{FILE}>>, urls array<{FILE}>"
SERIES = "data array<struct<category: string, date: string, downloads: bigint>>, package string, type string"
VULN_FIELDS = (
    "id: string, summary: string, severity: array<struct<type: string, score: string>>, "
    "affected: array<struct<ranges: array<struct<type: string, events: array<struct<introduced: string, fixed: string>>>>>>, references: array<struct<url: string>>"
)
VULNS = f"vulns array<struct<{VULN_FIELDS}>>"


def _read(spark: SparkSession, schema: str, path: str | list[str], mode: str = "PERMISSIVE") -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", mode).json(path)


def name_index(spark: SparkSession, path: str) -> DataFrame:
    """One row a name of the whole index; a cut-off document fails."""
    return _read(spark, NAMES, path, "FAILFAST").select(F.explode("projects").alias("p")).select(F.col("p.name").alias("name"))


def name_index_split(spark: SparkSession, path: str, split_bytes: int = arrays.SPLIT_BYTES) -> DataFrame:
    """The rows of `name_index`, each document read by as many tasks as it has ranges of split_bytes."""
    parsed = F.from_json("element", "name string", {"mode": "FAILFAST"})
    return arrays.array_elements(spark, path, "projects", split_bytes).select(parsed.getField("name").alias("name"))


def top_packages_split(spark: SparkSession, path: str, split_bytes: int = arrays.SPLIT_BYTES) -> DataFrame:
    parsed = F.from_json("element", "project string, download_count bigint", {"mode": "FAILFAST"})
    rows = arrays.array_elements(spark, path, "rows", split_bytes).select(parsed.alias("r"))
    return rows.select(F.col("r.project").alias("name"), F.col("r.download_count").alias("downloads"))


def top_packages(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, TOP, path, "FAILFAST").select(F.explode("rows").alias("r")).select(F.col("r.project").alias("name"), F.col("r.download_count").alias("downloads"))


def packages(spark: SparkSession, path: str) -> DataFrame:
    """One package document a row; filter on info.name and info.version for a point read."""
    return _read(spark, PACKAGE, path)


def release_files(documents: DataFrame) -> DataFrame:
    """(package, version, ord, filename, url, size, packagetype, ...) of all releases."""
    files = documents.select(F.col("info.name").alias("package"), F.explode("releases").alias("version", "files")).select("package", "version", F.posexplode("files").alias("ord", "f"))
    return files.select(
        "package", "version", "ord", "f.filename", "f.url", "f.size", "f.packagetype", "f.python_version", "f.requires_python", F.col("f.upload_time_iso_8601").alias("upload_time"), F.col("f.digests.sha256").alias("sha256")
    )


def downloads(spark: SparkSession, path: str) -> DataFrame:
    """(package, series, category, day, downloads): one row a day of each series."""
    rows = _read(spark, SERIES, path).select("package", F.col("type").alias("series"), F.explode("data").alias("d"))
    return rows.select("package", "series", "d.category", F.col("d.date").try_cast("date").alias("day"), "d.downloads")


def vulnerabilities(spark: SparkSession, path: str) -> DataFrame:
    """One advisory a row, as `vulns.flatten` takes them; the file's name tells the package."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)\.json$", 1)
    return _read(spark, VULNS, path).select(name.alias("package"), F.explode("vulns").alias("v")).select("package", "v.*")


def at_version(documents: DataFrame, name: str, version: str) -> DataFrame:
    """The document of one version of a package, whose requirements are those of that version; none for names and versions that may not be asked for."""
    from ..functions import names

    ok = names.valid_name(F.lit(name)) & names.valid_version(F.lit(version))
    return documents.filter(ok & (F.lower("info.name") == name.lower()) & (F.col("info.version") == version))


def _listed(spark: SparkSession, schema: str, path: str | list[str], limit: int) -> DataFrame:
    """Rows of files that each hold one list, with `repo` (the file's name) and `ord`, the place in the list; the first `limit` of each list."""
    repo = F.regexp_extract("path", r"([^/]+?)\.json$", 1)
    files = spark.read.format("text").option("wholetext", True).load(path).select(F.input_file_name().alias("path"), "value")
    # a repository that is not there, or not open, lands as an object with a message: no list, no rows
    items = F.when(F.ltrim("value").startswith("["), F.slice(F.from_json("value", f"array<struct<{schema}>>"), 1, limit))
    return files.select(repo.alias("repo"), F.posexplode(items).alias("ord", "item")).select("repo", "ord", "item.*")


def forge_releases(spark: SparkSession, path: str | list[str], limit: int = 100) -> DataFrame:
    """(repo, ord, version, tag_name, title, body, published_at, url): the first hundred releases of each file, one file a repository."""
    rows = _listed(spark, "tag_name: string, name: string, body: string, published_at: string, html_url: string", path, limit)
    return rows.select("repo", "ord", F.regexp_replace("tag_name", "^v", "").alias("version"), "tag_name", F.col("name").alias("title"), "body", "published_at", F.col("html_url").alias("url"))


def forge_tags(spark: SparkSession, path: str | list[str], limit: int = 50) -> DataFrame:
    """(repo, ord, name, sha): of the first fifty tags of each file those that name a version."""
    from ..operators import changelog

    rows = _listed(spark, "name: string, commit: struct<sha: string, id: string>", path, limit)
    return changelog.version_tags(rows, "name").select("repo", "ord", "name", F.coalesce("commit.sha", "commit.id").alias("sha"))


def first_file(files: DataFrame, keys: list[str], candidates: list[str]) -> DataFrame:
    """Of each key the first candidate that exists: (keys, path, content)."""
    rank = F.array_position(F.array(*map(F.lit, candidates)), F.col("path"))
    found = files.withColumn("_rank", rank).filter("_rank > 0")
    return found.groupBy(*keys).agg(F.min_by(F.struct("path", "content"), "_rank").alias("f")).select(*keys, "f.*")


def package_row(documents: DataFrame, as_of: date) -> DataFrame:
    """The columns a package page shows; as_of is the day that the release frequency counts back from."""
    from ..functions import requirements, urls
    from ..operators import releases

    i = F.col("info")
    given = lambda name: F.coalesce(i[name], F.lit("")).alias(name)
    files = F.transform("urls", lambda f: F.struct(f["filename"].alias("filename"), f["size"].alias("size"), f["packagetype"].alias("packagetype"), f["python_version"].alias("python_version"), f["upload_time_iso_8601"].alias("upload_time")))
    rows = documents.select(
        i["name"].alias("name"), i["version"].alias("version"), given("summary"), given("description"), given("description_content_type"), requirements.license_name(i["license_expression"], i["classifiers"], i["license"]).alias("license"),
        given("author"), given("author_email"), given("home_page"), given("requires_python"), i["requires_dist"].alias("requires_dist"), urls.safe_links(i["project_urls"]).alias("project_urls"), i["classifiers"].alias("classifiers"), files.alias("files"),
        requirements.python_minimum(F.coalesce(i["requires_python"], F.lit(""))).alias("python_min"), requirements.dependency_tree(i["requires_dist"]).alias("dependencies"),
        requirements.maintainers(i["author"], i["author_email"], i["maintainer"], i["maintainer_email"]).alias("maintainers"),
        urls.doc_url(urls.safe_links(i["project_urls"])).alias("doc_url"), urls.repo_url(urls.safe_links(i["project_urls"])).alias("repo_url"), i["yanked"].alias("yanked"),
    )
    shown = documents.select(i["name"].alias("name"), i["version"].alias("version"), F.posexplode_outer("urls").alias("ord", "f")).select("name", "version", "ord", "f.filename", "f.size", "f.packagetype", "f.url")
    key = ["name", "version"]
    rows = rows.join(releases.install_size(shown, key), key, "left").join(releases.first_format(shown, key), key, "left")
    flags = releases.platforms(shown.filter("filename IS NOT NULL"), key)
    rows = rows.join(flags.select(*key, F.struct(*[c for c in flags.columns if c not in key]).alias("platforms")), key, "left")
    stamps = release_files(documents).withColumnRenamed("version", "release")
    times = releases.version_times(stamps, ["package"], "release", F.try_to_timestamp("upload_time"), "ord")
    return rows.join(releases.cadence(times, ["package"], as_of).withColumnRenamed("package", "name"), "name", "left")


def conda_info(names: DataFrame, channel: DataFrame) -> DataFrame:
    """Each name with what a channel has of it; one that is not there is not available."""
    known = channel.select(F.lower("name").alias("_n"), F.col("version").alias("conda_version"), F.lit(True).alias("_there"))
    return names.join(known, F.lower("name") == F.col("_n"), "left").withColumn("available", F.coalesce("_there", F.lit(False))).drop("_n", "_there")


def repo_info(repos: DataFrame, owners: DataFrame) -> DataFrame:
    """Repositories with their owner's shown name, the login where there is none."""
    return repos.join(owners.select("login", F.col("name").alias("_name")), "login", "left").withColumn("owner_name", F.coalesce(F.nullif("_name", F.lit("")), "login")).drop("_name")
