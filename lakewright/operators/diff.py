"""Comparisons of two versions, and of several packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as fnames

CAP = 200
MOST_NAMES = 5


def changes(old: DataFrame, new: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """(keys, change, name, old, new): added, removed and changed names, from one full outer join."""
    a = old.select(*keys, F.col(name).alias("name"), F.col(value).alias("old"), F.lit(True).alias("_in_old"))
    b = new.select(*keys, F.col(name).alias("name"), F.col(value).alias("new"), F.lit(True).alias("_in_new"))
    both = a.join(b, [*keys, "name"], "full_outer")
    change = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.select(*keys, change.alias("change"), "name", "old", "new").filter("change IS NOT NULL")


def dependency_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Changes of required dependencies by lower-case name; of repeated names the last by `ord` counts."""
    last = lambda df: df.groupBy(*keys, F.lower("name").alias("name")).agg(F.max_by("constraint", "ord").alias("constraint"))
    return changes(last(old), last(new), keys, "name", "constraint")


def capped(found: DataFrame, keys: list[str], cap: int = CAP) -> DataFrame:
    """The first `cap` of each kind of change by name, and how many more there are."""
    kind = Window.partitionBy(*keys, "change")
    place = F.row_number().over(kind.orderBy("name"))
    more = F.greatest(F.count("*").over(kind) - cap, F.lit(0))
    return found.withColumn("_r", place).withColumn("truncated", more).filter(F.col("_r") <= cap).drop("_r")


def alias_rows(members: DataFrame, aliases: DataFrame) -> DataFrame:
    """(path, signature) of all symbols and of what can be reached by aliases.

    members: (root, suffix, signature), root the path of a function, class or constant, suffix what is below it.
    aliases: (path, target). An alias counts as each member of its target, under its own path; a definition
    of the same path beats it; without a known target it is one row `-> target`.
    """
    roots = members.select("root").distinct()
    free = aliases.join(roots.withColumnRenamed("root", "path"), "path", "left_anti")
    own = members.select(F.concat("root", "suffix").alias("path"), "signature")
    reached = free.join(members, F.col("target") == F.col("root")).select(F.concat("path", "suffix").alias("path"), "signature")
    lost = free.join(roots.withColumnRenamed("root", "target"), "target", "left_anti").select("path", F.concat(F.lit("-> "), "target").alias("signature"))
    extra = reached.join(own.select("path"), "path", "left_anti").unionByName(lost)
    return own.unionByName(extra)


def api_changes(old: DataFrame, new: DataFrame, old_aliases: DataFrame, new_aliases: DataFrame) -> DataFrame:
    """Changes of signatures by path; an alias that keeps its path and moves to another target changed, whatever the signatures."""
    find = lambda members, aliases: alias_rows(members, aliases).join(aliases, "path", "left")
    a = find(old, old_aliases).select("path", F.col("signature").alias("old"), F.col("target").alias("_t0"), F.lit(1).alias("_a"))
    b = find(new, new_aliases).select("path", F.col("signature").alias("new"), F.col("target").alias("_t1"), F.lit(1).alias("_b"))
    both = a.join(b, "path", "full_outer").withColumn("_moved", F.coalesce(F.col("_t0") != F.col("_t1"), F.lit(False)))
    arrow = lambda t, sig: F.when(F.col("_moved"), F.concat(F.lit("-> "), F.col(t))).otherwise(F.col(sig))
    both = both.withColumns({"old": arrow("_t0", "old"), "new": arrow("_t1", "new")})
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.select(change.alias("change"), F.col("path").alias("name"), "old", "new").filter("change IS NOT NULL")


def parse_names(raw: Column) -> Column:
    """struct(names, problem) of a comma-separated list: lower case, each once, at most five."""
    names = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda n: F.lower(F.trim(n))), lambda n: n != ""))
    bad = F.try_element_at(F.filter(names, lambda n: ~fnames.valid_name(n)), F.lit(1))
    problem = (
        F.when(F.coalesce(raw, F.lit("")) == "", "query parameter 'pkgs' is required")
        .when(bad.isNotNull(), F.concat(F.lit("invalid package name: "), bad))
        .when(F.size(names) == 0, "no valid package names provided")
        .when(F.size(names) > MOST_NAMES, f"too many packages, max {MOST_NAMES}")
    )
    return F.struct(F.when(problem.isNull(), names).alias("names"), problem.alias("problem"))


def compare(requested: DataFrame, meta: DataFrame, *sides: DataFrame) -> DataFrame:
    """The requested names in their order with all that is known of them; those without meta are marked skipped."""
    out = requested.join(meta.withColumn("_known", F.lit(True)), "name", "left")
    for side in sides:
        out = out.join(side, "name", "left")
    return out.withColumn("skipped", F.col("_known").isNull()).drop("_known")
