"""The package index: point reads, top lists, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top(packages: DataFrame, limit: int = 12) -> DataFrame:
    """The most downloaded packages, those without downloads left out; ties by name."""
    limit = min(max(limit, 1), 50)
    return packages.filter("downloads > 0").orderBy(F.desc("downloads"), "name").limit(limit)


def lookup(packages: DataFrame, name: str) -> DataFrame:
    """One package, whatever the case of its name; of several the smallest name."""
    return packages.filter(F.lower("name") == name.lower()).orderBy("name").limit(1)


def insert_absent(base: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """base with the rows of batch whose name it lacks; of a name that a batch repeats, the first by order.

    The new names alone are ranked; the base is read once and never shuffled but for its names.
    """
    first = batch.groupBy("name").agg(F.min_by(F.struct(*[F.col(c) for c in base.columns]), order).alias("row")).select("row.*")
    return base.unionByName(first.join(base.select("name"), "name", "left_anti").select(*base.columns))


def update_downloads(base: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """base with new download counts: by exact name, and where a batch's name has no exact match, by any case of it.

    A later row of the batch wins over an earlier one, whichever way it matched.
    """
    new = batch.select(F.col("name").alias("_new"), F.col("downloads").alias("_downloads"), F.col(order).alias("_order"))
    exact = new.join(base.select(F.col("name").alias("_new")), "_new", "left_semi").select(F.col("_new").alias("name"), "_downloads", "_order")
    loose = new.join(base.select(F.col("name").alias("_new")), "_new", "left_anti").join(base.select("name", F.lower("name").alias("_low")), F.lower("_new") == F.col("_low")).select("name", "_downloads", "_order")
    last = exact.unionByName(loose).groupBy("name").agg(F.max_by("_downloads", "_order").alias("_downloads"))
    return base.join(last, "name", "left").withColumn("downloads", F.coalesce("_downloads", "downloads")).select(*base.columns)


def update_summaries(base: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """base with new summaries by exact name; the last of the batch wins."""
    last = batch.groupBy("name").agg(F.max_by("summary", order).alias("_summary"))
    return base.join(last, "name", "left").withColumn("summary", F.coalesce("_summary", "summary")).select(*base.columns)


def is_stale(packages: DataFrame, indexed: DataFrame, version: int, built_version: int | None) -> bool:
    """Whether an index must be built anew: none, another layout, or other row counts."""
    if built_version != version:
        return True
    return packages.count() != indexed.select("name").distinct().count()


def sitemap(popular: DataFrame, cached: DataFrame) -> DataFrame:
    """Popular names daily, other cached ones weekly."""
    entry = lambda df, freq, weight, kind: df.select(
        F.concat(F.lit("/packages/"), F.col("name")).alias("loc"), F.lit(freq).alias("changefreq"), F.lit(weight).alias("priority"), F.lit(kind).alias("sitemap")
    )
    names = popular.select("name").distinct()
    rest = cached.select("name").join(names, "name", "left_anti")
    return entry(names, "daily", 1.0, "popular").unionByName(entry(rest, "weekly", 0.5, "cached"))


def stub_of(packages: DataFrame, names: DataFrame) -> DataFrame:
    """(name, status, stubs_package): the first of types-<name> and <name>-stubs that exists."""
    candidates = names.select("name", F.posexplode(F.array(F.concat(F.lit("types-"), "name"), F.concat("name", F.lit("-stubs")))).alias("rank", "stub"))
    found = candidates.join(packages.select(F.col("name").alias("stub")), "stub", "left_semi").groupBy("name").agg(F.min_by("stub", "rank").alias("stubs_package"))
    return names.select("name").join(found, "name", "left").withColumn("status", F.when(F.col("stubs_package").isNotNull(), "stubs").otherwise("untyped"))


def disambiguate(df: DataFrame, path: str, order: list[str]) -> DataFrame:
    """An id for each row: its path, from the second of a path on with ~2, ~3 and so on; and how often it repeats."""
    place = Window.partitionBy(path).orderBy(*order)
    k = F.row_number().over(place)
    return df.withColumn("id", F.when(k == 1, F.col(path)).otherwise(F.concat(F.col(path), F.lit("~"), k.cast("string")))).withColumn("repeated", F.count("*").over(Window.partitionBy(path)) > 1)
