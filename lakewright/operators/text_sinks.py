"""Tables as the lines agents and shells read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import format as fmt

#: The rows of a comparison in order.
METRICS = ("version", "summary", "license", "python_min", "install_size", "module_format", "last_released_at", "releases_last_12mo", "dep_count", "downloads_30d", "vuln_count", "typed", "repo_url", "doc_url")


def one_line(text: Column) -> Column:
    return F.translate(text, "\t\n\r", "   ")


def search_tsv(found: DataFrame) -> DataFrame:
    """(ord, line): a head line and name, downloads, summary of each row."""
    line = F.concat_ws("\t", "name", F.col("downloads").cast("string"), F.coalesce(one_line(F.col("summary")), F.lit("")))
    head = found.sparkSession.createDataFrame([(-1, "# name\tdownloads\tsummary")], "ord bigint, line string")
    return head.unionByName(found.select(F.monotonically_increasing_id().alias("ord"), line.alias("line")))


def symbols_tsv(symbols: DataFrame) -> DataFrame:
    return symbols.select(F.concat_ws("\t", "path", "kind", F.coalesce(one_line(F.col("signature")), F.lit(""))).alias("line"))


def package_text(packages: DataFrame) -> DataFrame:
    """(name, text): `key: value` lines of what a package row has."""
    join = lambda c: F.array_join(F.transform(c, lambda d: F.trim(F.concat_ws(" ", d["name"], d["constraint"]))), ", ")
    lines = fmt.key_values(
        ("name", F.col("name")), ("version", F.col("version")), ("summary", F.col("summary")), ("license", F.col("license")), ("python_min", F.col("python_min")),
        ("requires", join(F.col("dependencies.required"))), ("extras", F.array_join(F.array_sort(F.map_keys("dependencies.extras")), ", ")), ("repo_url", F.col("repo_url")), ("doc_url", F.col("doc_url")),
    )
    return packages.select("name", lines.alias("text"))


def changelog_text(entries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): sections with their versions and dates, in order."""
    head = F.concat(F.lit("## "), "version", F.when(F.coalesce("date", F.lit("")) != "", F.concat(F.lit(" — "), "date")).otherwise(""))
    section = F.struct("ord", F.concat_ws("\n", head, F.when(F.col("body") != "", F.col("body"))).alias("s"))
    return entries.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(section)), lambda x: x["s"]), "\n\n").alias("text"))


def changes_text(changes: DataFrame, keys: list[str], title: str, changed: str = "changed") -> DataFrame:
    """(keys, text): + added, - removed and ~ changed lines under a title; `(none)` is left to the caller."""
    was = F.concat(F.lit("  (was: "), "old", F.lit("; now: "), "new", F.lit(")")) if changed == "changed" else F.concat(F.lit(" ("), "old", F.lit(" → "), "new", F.lit(")"))
    line = F.when(F.col("change") == "added", F.concat(F.lit("+ added: "), "name")).when(F.col("change") == "removed", F.concat(F.lit("- removed: "), "name")).otherwise(F.concat(F.lit(f"~ {changed}: "), F.col("name"), was))
    rank = F.when(F.col("change") == "added", 0).when(F.col("change") == "removed", 1).otherwise(2)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "name", line.alias("line")))), lambda x: x["line"])
    return changes.groupBy(*keys).agg(F.concat(F.lit(f"## {title}\n"), F.array_join(lines, "\n")).alias("text"))


def compare_text(packages: DataFrame, order: str = "ord") -> DataFrame:
    """The comparison of a few packages as one table: (ord, line). Cells are cut, not padded."""
    cells = F.array(*[F.coalesce(fmt.cell(F.col(m).cast("string")), F.lit("")) for m in METRICS])
    row = F.transform(F.array_sort(F.collect_list(F.struct(order, "name", cells.alias("cells")))), lambda x: x)
    one = packages.agg(row.alias("p"))
    names = F.concat(F.lit("| metric             | "), F.array_join(F.transform("p", lambda x: x["name"]), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|--------------------|"), F.array_join(F.transform("p", lambda _: F.lit("-" * (fmt.CELL + 2) + "|")), ""))
    lines = [names, rule]
    values = lambda i: F.transform("p", lambda x: x["cells"][i])
    for i, metric in enumerate(METRICS):
        lines.append(F.concat(F.lit(f"| {metric:<18} | "), F.array_join(values(i), " | "), F.lit(" |")))
    return one.select(F.posexplode(F.array(*lines)).alias("ord", "line"))


def docs_json(symbols: DataFrame, module: str = "module") -> DataFrame:
    """One JSON document a module: (module, json)."""
    item = F.struct("path", "kind", "signature")
    return symbols.groupBy(module).agg(F.to_json(F.struct(F.first(module).alias("name"), F.array_sort(F.collect_list(item)).alias("symbols"))).alias("json"))
