"""Changelogs: sections of a text, sources by priority, pairs of tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import versions

#: Fixed patterns: headings of Markdown changelogs with groups (version, date), of RST ones, and what a version is.
MARKDOWN = (
    r"^#{1,3}\s+\[v?([0-9]+[0-9a-zA-Z.\-]*)\]\s*-\s*(\d{4}-\d{2}-\d{2})",
    r"^#{1,3}\s+\[v?([0-9]+[0-9a-zA-Z.\-]*)\](?:\([^)]*\))?\s*\((\d{4}-\d{2}-\d{2})\)",
    r"^#{1,3}\s+v?([0-9]+[0-9a-zA-Z.\-]*)\s+\((\d{4}-\d{2}-\d{2})\)\s*$",
    r"^#{1,3}\s+\[v?([0-9]+[0-9a-zA-Z.\-]*)\]\s*()$",
    r"^#{1,3}\s+v?([0-9]+\.[0-9][0-9a-zA-Z.\-]*)\s*(?:-\s*(\d{4}-\d{2}-\d{2}))?\s*$",
)
RST = (r"^Version\s+(v?[0-9]+\.[0-9][0-9a-zA-Z.\-]*)\s*$", r"^(v?[0-9]+\.[0-9][0-9a-zA-Z.\-]*)\s*$")
UNDERLINE = r"^[-=~^#*+]{3,}\s*$"
RST_DATE = r"(?:Released|Date:)\s*(\d{4}-\d{2}-\d{2})"
IS_VERSION = r"^\d+\.\d[\d.a-zA-Z\-]*$"
#: Fixed patterns: tags that name a version, and commits that say nothing.
TAG = r"^v?\d+\.\d[\d.a-zA-Z\-]*$"
NOISE = r"(?i)^(merge\b|bump version|version bump|chore[:(]|release[:(]|prepare release|update changelog)"
MOST_COMMITS = 30


def _heading(line: Column) -> Column:
    """struct(version, date) of a Markdown heading: the first pattern that fits with a version; null otherwise."""
    out = F.lit(None)
    for pattern in reversed(MARKDOWN):
        version = F.regexp_extract(line, pattern, 1)
        out = F.when(line.rlike(pattern) & version.rlike(IS_VERSION), F.struct(version.alias("version"), F.regexp_extract(line, pattern, 2).alias("date"))).otherwise(out)
    return out


def _sections(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of lines by the heading before them: (keys, style, ord, version, tag_name, date, body)."""
    texts = Window.partitionBy(*keys, "style").orderBy("line_no")
    so_far = texts.rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("ord", F.sum(F.col("version").isNotNull().cast("int")).over(so_far)).filter("ord > 0")
    in_section = Window.partitionBy(*keys, "style", "ord").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    # RST: a date among the first four lines of a body is the section's, and no body
    kept = F.col("version").isNull() & ~F.coalesce(F.col("dated") != "", F.lit(False))
    early = F.coalesce(F.sum(kept.cast("int")).over(in_section), F.lit(0)) < 4
    marked = marked.withColumn("_date", F.when(F.col("version").isNull() & early & (F.col("dated") != ""), F.col("dated")))
    body = F.when(F.col("version").isNull() & F.col("_date").isNull(), F.struct("line_no", "line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(body)), lambda x: x["line"]), "\n")
    return marked.groupBy(*keys, "style", "ord").agg(
        F.max("version").alias("version"), F.max("tag_name").alias("tag_name"), F.coalesce(F.max_by("_date", F.when(F.col("_date").isNotNull(), F.col("line_no"))), F.max("date"), F.lit("")).alias("date"), F.regexp_replace(joined, r"^\s+|\s+$", "").alias("body")
    )


def parse(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Sections of changelog texts, Markdown if it has two or more, else RST if it has; a text with fewer has none.

    All lines of all texts at once: a running count of headings makes the groups. A line of a text stands in its
    text's task only, and the longest text bounds a task.
    """
    lines = texts.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    following = F.lead("line").over(Window.partitionBy(*keys).orderBy("line_no"))
    lines = lines.withColumn("_next", following)
    h = _heading(F.col("line"))
    plain = h["version"]
    tag = F.when(F.col("line").contains(F.concat(F.lit("v"), plain)), F.concat(F.lit("v"), plain)).otherwise(plain)
    md = lines.select(*keys, "line_no", "line", F.lit("markdown").alias("style"), plain.alias("version"), tag.alias("tag_name"), h["date"].alias("date"), F.lit("").alias("dated"))
    raw = F.coalesce(*[F.when(F.col("line").rlike(p), F.regexp_extract("line", p, 1)) for p in RST])
    raw = F.when(F.col("_next").rlike(UNDERLINE), raw)
    rst = lines.select(
        *keys, "line_no", "line", F.lit("rst").alias("style"), F.regexp_replace(raw, "^v", "").alias("version"), raw.alias("tag_name"), F.when(raw.isNotNull(), F.lit("")).alias("date"), F.regexp_extract("line", RST_DATE, 1).alias("dated")
    )
    found = _sections(md.unionByName(rst), keys)
    n = F.count("*").over(Window.partitionBy(*keys, "style"))
    found = found.withColumn("_n", n).filter("_n >= 2")
    best = F.min("style").over(Window.partitionBy(*keys))  # markdown before rst
    return found.withColumn("_best", best).filter("style = _best").select(*keys, "ord", "version", "tag_name", "date", "body")


def by_priority(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Entries of the source that comes first among those with any: (keys, source, priority, ...)."""
    first = F.min("priority").over(Window.partitionBy(*keys))
    return entries.withColumn("_p", first).filter("priority = _p").drop("_p")


def version_tags(tags: DataFrame, tag: str) -> DataFrame:
    """Tags that name a version."""
    return tags.filter(F.col(tag).rlike(TAG))


def tag_pairs(tags: DataFrame, keys: list[str], tag: str, newest_first: str) -> DataFrame:
    """(newer, older) of tags that follow each other."""
    older = F.lead(tag).over(Window.partitionBy(*keys).orderBy(newest_first))
    return tags.select(*keys, F.col(tag).alias("newer"), older.alias("older")).filter("older IS NOT NULL")


def compare_url(template: str, ref: Column, older: Column, newer: Column) -> Column:
    out = F.replace(F.lit(template), F.lit("{ref}"), ref)
    return F.replace(F.replace(out, F.lit("{older}"), older), F.lit("{newer}"), newer)


def commit_messages(commits: DataFrame, keys: list[str], message: str, stamp: str, order: str) -> DataFrame:
    """(messages, head_date) of each comparison: first lines that say something, at most thirty, and the date of the last commit."""
    rows = commits.select(*keys, F.split(message, "\n")[0].alias("_m"), F.col(stamp).alias("_d"), F.col(order).alias("_o"))
    said = F.when(~F.col("_m").rlike(NOISE), F.struct("_o", "_m"))
    return rows.groupBy(*keys).agg(F.slice(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["_m"]), 1, MOST_COMMITS).alias("messages"), F.max_by("_d", "_o").alias("head_date"))


def between(entries: DataFrame, after: Column, upto: Column) -> DataFrame:
    """Entries with after < version <= upto, newest version first, ties by text."""
    return entries.filter(versions.in_range(F.col("version"), after, upto)).orderBy(F.desc(versions.version_key(F.col("version"))), "version")


def version_notes(releases: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """Each version with its changelog entry; of repeated versions the last entry."""
    last = entries.groupBy(*keys, "version").agg(F.max_by("body", "ord").alias("body"))
    return releases.join(last, [*keys, "version"], "left")
