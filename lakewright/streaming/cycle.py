"""The package index kept up by cycles: names as they land, then download counts, then summaries of the most downloaded.

A cycle is a micro-batch and one write: the partition `cycle=<number>` of a plain Parquet folder, with the rows that it made or changed.
It reads the partitions of earlier cycles alone and overwrites its own, so a cycle that died at any step and runs again leaves the
same table; the index is the last row of each name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ROW = "name string, summary string, downloads bigint"
#: Fixed value: how many of the most downloaded get their summaries in a cycle.
TOP = 50


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def index(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """(name, summary, downloads) as the last cycle has them, or the last before a cycle."""
    if not _exists(spark, path):
        return spark.createDataFrame([], ROW)
    rows = spark.read.schema(f"{ROW}, cycle bigint").parquet(path)
    if before is not None:
        rows = rows.filter(F.col("cycle") < before)
    return rows.groupBy("name").agg(F.max_by(F.struct("summary", "downloads"), "cycle").alias("r")).select("name", "r.*")


def changed(known: DataFrame, names: DataFrame, downloads: DataFrame, summaries: DataFrame, top: int = TOP) -> DataFrame:
    """Rows (name, summary, downloads) that a cycle makes or changes in `known`.

    Names (name) that are not there come with nothing. Counts (name, downloads) go to the name as it is, else to all names that differ in case
    alone; of several for one, the largest. Summaries (name, summary) go by the exact name, to the most downloaded only, ties by name.
    """
    fresh = names.select("name").filter("name IS NOT NULL").distinct().join(known, "name", "left_anti").select("name", F.lit("").alias("summary"), F.lit(0).cast("bigint").alias("downloads"))
    rows = known.withColumn("_new", F.lit(False)).unionByName(fresh.withColumn("_new", F.lit(True)))
    counts = downloads.groupBy("name").agg(F.max("downloads").alias("_exact"))
    exact = rows.join(counts, "name", "left")
    spare = counts.join(rows.select("name"), "name", "left_anti").groupBy(F.lower("name").alias("_low")).agg(F.max("_exact").alias("_any"))
    counted = exact.withColumn("_low", F.lower("name")).join(spare, "_low", "left").withColumn("_now", F.coalesce("_exact", "_any", "downloads"))
    first = counted.orderBy(F.desc("_now"), "name").limit(top).select("name")
    texts = summaries.groupBy("name").agg(F.max("summary").alias("_text")).join(first, "name", "left_semi")
    done = counted.join(texts, "name", "left").withColumn("_said", F.coalesce("_text", "summary"))
    moved = F.col("_new") | (F.col("_now") != F.col("downloads")) | (F.col("_said") != F.col("summary"))
    return done.filter(moved).select("name", F.col("_said").alias("summary"), F.col("_now").alias("downloads"))


def follow(names: DataFrame, downloads: str, summaries: str, path: str, checkpoint: str, late: str = "1 day", top: int = TOP) -> StreamingQuery:
    """Runs a cycle for each micro-batch of a stream (name, landed_at), until all that has landed is read.

    Names that land again within the watermark are known to the state and cost nothing; later ones are held against the index. The folders of counts and
    summaries are read anew in each cycle.
    """
    spark = names.sparkSession
    once = names.withWatermark("landed_at", late).dropDuplicatesWithinWatermark(["name"])

    def cycle(batch: DataFrame, number: int) -> None:
        counts = spark.read.schema("name string, downloads bigint").json(downloads)
        texts = spark.read.schema("name string, summary string").json(summaries)
        rows = changed(index(spark, path, number), batch, counts, texts, top)
        rows.write.mode("overwrite").parquet(f"{path}/cycle={number}")

    return once.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
