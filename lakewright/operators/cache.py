"""The key/value table: reads with freshness, replacement, purges."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Families of keys that carry a version, and how long an answer holds by what it was, in seconds.
VERSIONED = ("docs:", "docs-err:", "diff:", "diffjson:")
HOLDS = {"error": 300, "empty": 86400}


def fresh(created: Column, ttl: int, now: datetime) -> Column:
    return F.lit(now).cast("timestamp").cast("double") - created.cast("timestamp").cast("double") < ttl


def get(kv: DataFrame, key: str, ttl: int, now: datetime) -> DataFrame:
    """The row of a key, fresh or not, and which."""
    return kv.filter(F.col("key") == key).withColumn("fresh", fresh(F.col("created_at"), ttl, now))


def put(kv: DataFrame, rows: DataFrame) -> DataFrame:
    """kv with rows in the place of those of the same key; of repeated keys the latest, of equally late ones the largest row."""
    last = Window.partitionBy("key").orderBy(F.desc("created_at"), *[F.desc(c) for c in kv.columns if c not in ("key", "created_at")])
    new = rows.select(*kv.columns).withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")
    return kv.join(new.select("key"), "key", "left_anti").select(*kv.columns).unionByName(new)


def delete(kv: DataFrame, keys: DataFrame) -> DataFrame:
    return kv.join(keys.select("key"), "key", "left_anti")


def names(kv: DataFrame, family: str = "pkg:") -> DataFrame:
    """Names below a family's prefix."""
    return kv.filter(F.col("key").startswith(family)).select(F.expr(f"substring(key, {len(family) + 1})").alias("name"))


def purge_before(kv: DataFrame, version: int) -> DataFrame:
    """kv without the rows of versioned families that are of another version."""
    old = F.lit(False)
    for family in VERSIONED:
        old = old | (F.col("key").startswith(family) & ~F.col("key").startswith(f"{family}v{version}:"))
    return kv.filter(~old)


def usable(kv: DataFrame, now: datetime) -> DataFrame:
    """Rows that still hold: errors five minutes, empty answers a day, others always."""
    age = F.lit(now).cast("timestamp").cast("double") - F.col("created_at").cast("timestamp").cast("double")
    limit = F.lit(None).cast("int")
    for status, seconds in HOLDS.items():
        limit = F.when(F.col("status") == status, seconds).otherwise(limit)
    return kv.filter(limit.isNull() | (age < limit))


def expired(kv: DataFrame, ttl: int, now: datetime) -> DataFrame:
    """(key) of the rows to be fetched anew, each once however often it is asked for; the stale rows are served meanwhile."""
    return kv.filter(~fresh(F.col("created_at"), ttl, now)).select("key").distinct()


def revalidated(kv: DataFrame, fetched: DataFrame) -> DataFrame:
    """kv with what was fetched anew; a row whose refresh failed (value null) stays as it was."""
    return put(kv, fetched.filter("value IS NOT NULL"))


#: What an extraction is charged, at least and at most, in bytes; the most is the whole budget.
LEAST_COST, BUDGET = 4 << 20, 64 << 20


def cost(weight: Column) -> Column:
    """A weight held between the least cost and the whole budget; one that is not known costs the least."""
    return F.coalesce(F.least(F.greatest(weight, F.lit(LEAST_COST)), F.lit(BUDGET)), F.lit(LEAST_COST)).cast("long")


def admitted(jobs: DataFrame, keys: list[str], order: str, weight: str) -> DataFrame:
    """jobs with `cost` and `wave`: the jobs of a wave fit into the budget together, in order; one that costs all of it runs alone.

    A wave is what runs at once on one machine (the keys). A running sum cut at the budget would let a job straddle it, so the wave is
    found by a fold over the machine's jobs in order; those are what is collected.
    """
    row = F.struct(F.col(order).alias("o"), cost(F.col(weight)).alias("c"), F.struct(*jobs.columns).alias("job"))
    listed = jobs.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("jobs"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("wave"), F.array().cast("array<int>").alias("waves"))

    def step(done: Column, job: Column) -> Column:
        fits = done["used"] + job["c"] <= BUDGET
        wave = F.when(fits, done["wave"]).otherwise(done["wave"] + 1)
        return F.struct(F.when(fits, done["used"] + job["c"]).otherwise(job["c"]).alias("used"), wave.alias("wave"), F.concat(done["waves"], F.array(wave)).alias("waves"))

    waves = listed.select("jobs", F.aggregate("jobs", start, step)["waves"].alias("waves"))
    each = waves.select(F.explode(F.arrays_zip("jobs", "waves")).alias("x"))
    return each.select("x.jobs.job.*", F.col("x.jobs.c").alias("cost"), F.col("x.waves").alias("wave"))
