"""Micro-batches of landed documents into the package table, and state that ages.

The table is a folder of Parquet buckets next to manifests that name the
current ones, so a reader never sees a half-written table and a batch that runs
twice changes nothing: insert-if-absent and last-wins updates are idempotent.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import index

PACKAGES = "name string, summary string, downloads bigint"


class PackageTable:
    """A table in buckets of the name, and its versions: a small manifest each, which says in which version each bucket was last written.

    A merge reads and writes the buckets that its batch touches and no others. The manifest comes last and in one step, so a merge that
    fails leaves the version before; what neither of the last `keep` versions names is deleted.
    """

    def __init__(self, spark: SparkSession, base: str, schema: str = PACKAGES, buckets: int = 64, keep: int = 2):
        self.spark, self.base, self.schema, self.buckets, self.keep = spark, base.rstrip("/"), schema, buckets, keep
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    def bucket(self, name: Column) -> Column:
        """Names that differ in case alone are in one bucket."""
        return F.pmod(F.xxhash64(F.lower(name)), F.lit(self.buckets)).cast("int")

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.base}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json"))

    def manifest(self, version: int) -> dict[int, int]:
        """The version in which each filled bucket was written."""
        return {int(k): v for k, v in json.loads("".join(r[0] for r in self.spark.read.text(f"{self.base}/manifests/{version}.json").collect())).items()}  # a row

    def _folder(self, version: int, bucket: int) -> str:
        return f"{self.base}/data/{version}/bucket={bucket}"

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        versions = self.versions()
        held = self.manifest(versions[-1]) if versions else {}
        paths = [self._folder(v, k) for k, v in held.items() if buckets is None or k in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, f: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """f(rows that are there, batch) takes the place of what the buckets of the batch's names hold."""
        touched = [r[0] for r in batch.select(self.bucket(F.col("name")).alias("b")).distinct().collect()]  # a bucket each
        if not touched:
            return
        versions = self.versions()
        new = versions[-1] + 1 if versions else 0
        rows = f(self.read(touched), batch).withColumn("bucket", self.bucket(F.col("name")))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.base}/data/{new}")
        written = {int(n.split("=")[1]) for n in self._names(f"data/{new}") if n.startswith("bucket=")}
        held = {k: v for k, v in (self.manifest(versions[-1]) if versions else {}).items() if k not in touched} | dict.fromkeys(written, new)
        out = self._fs.create(self._path(f"{self.base}/manifests/{new}.part"), True)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        self._fs.rename(self._path(f"{self.base}/manifests/{new}.part"), self._path(f"{self.base}/manifests/{new}.json"))
        self._clear()

    def _clear(self) -> None:
        versions = self.versions()
        for v in versions[: -self.keep]:
            self._fs.delete(self._path(f"{self.base}/manifests/{v}.json"), False)
        named = {(v, k) for m in versions[-self.keep :] for k, v in self.manifest(m).items()}
        for version in self._names("data"):
            if int(version) <= versions[-1]:
                for n in self._names(f"data/{version}"):
                    if n.startswith("bucket=") and (int(version), int(n.split("=")[1])) not in named:
                        self._fs.delete(self._path(f"{self.base}/data/{version}/{n}"), True)


def sync_names(stream: DataFrame, table: PackageTable, checkpoint: str) -> StreamingQuery:
    """Names as they land, those already there left alone."""

    def batch(df: DataFrame, _: int) -> None:
        new = df.select("name", F.lit("").alias("summary"), F.lit(0).cast("bigint").alias("downloads"), F.lit(0).alias("ord"))
        table.merge(new, lambda old, rows: index.insert_absent(old, rows, "ord"))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync_downloads(stream: DataFrame, table: PackageTable, checkpoint: str) -> StreamingQuery:
    """Download counts as they land, by exact name or any case of it; of a name that a batch has more than once, the largest count."""

    def batch(df: DataFrame, _: int) -> None:
        table.merge(df.withColumn("ord", F.col("downloads")), lambda old, rows: index.update_downloads(old, rows, "ord"))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync_summaries(stream: DataFrame, table: PackageTable, checkpoint: str) -> StreamingQuery:
    """Summaries as they land, by exact name; of a name that a batch has more than once, the largest text."""

    def batch(df: DataFrame, _: int) -> None:
        table.merge(df.withColumn("ord", F.col("summary")), lambda old, rows: index.update_summaries(old, rows, "ord"))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def weekly_stream(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Sums by category and calendar week of an event stream. The state of a week goes once the watermark passes it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "7 days", startTime="4 days"), "category").agg(F.count("*").alias("downloads"))


def keep_sums(sums: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the sums that each micro-batch changed as files; a batch that runs again writes the same ones. `latest_sums` reads them."""

    def batch(df: DataFrame, number: int) -> None:
        df.select(F.col("window.start").alias("start"), "category", "downloads").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sums.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_sums(spark: SparkSession, path: str) -> DataFrame:
    """(start, category, downloads) as the last batch that changed each has it."""
    return spark.read.parquet(path).groupBy("start", "category").agg(F.max_by("downloads", "batch").alias("downloads"))


def token_bucket(rate: float = 30.0, burst: float = 60.0, idle_ms: int | None = 600_000) -> Callable:
    """State function of applyInPandasWithState: which requests of a key a token bucket lets through.

    Rows (key, ts: seconds, id); out (id, allowed). A key idle for ten minutes is forgotten, that is, full again.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (burst, None)
        for batch in batches:
            out = []
            for ts, rid in sorted(zip(batch["ts"], batch["id"], strict=True)):
                tokens = burst if last is None else min(burst, tokens + max(0.0, ts - last) * rate)
                last = ts if last is None else max(last, ts)
                allowed = tokens >= 1
                tokens -= allowed
                out.append((rid, bool(allowed)))
            yield pd.DataFrame(out, columns=["id", "allowed"])
        state.update((tokens, last))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)

    return run


def rate_limited(requests: DataFrame, rate: float = 30.0, burst: float = 60.0, idle_ms: int | None = 600_000) -> DataFrame:
    """A stream of requests (key, ts, id) as (id, allowed).

    A job that runs until all is read (availableNow) takes idle_ms None: with a timeout of wall-clock time such a job never ends.
    """
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return requests.groupBy("key").applyInPandasWithState(token_bucket(rate, burst, idle_ms), "id long, allowed boolean", "tokens double, last double", "append", timeout)


def ttl_state(ttl: float) -> Callable:
    """State function: the latest value of each key, and whether it was fresh when it was asked for.

    Rows (key, ts, id, value); a row with a value stores it, one without asks. Out (id, value, fresh).
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, stored = state.get if state.exists else (None, None)
        for batch in batches:
            out = []
            for row in batch.sort_values(["ts", "id"]).itertuples():
                if row.value is not None and row.value == row.value:
                    value, stored = row.value, row.ts
                else:
                    out.append((row.id, value, stored is not None and row.ts - stored < ttl))
            yield pd.DataFrame(out, columns=["id", "value", "fresh"])
        if stored is not None:
            state.update((value, stored))

    return run


def cached_reads(rows: DataFrame, ttl: float) -> DataFrame:
    return rows.groupBy("key").applyInPandasWithState(ttl_state(ttl), "id long, value string, fresh boolean", "value string, stored double", "append", GroupStateTimeout.NoTimeout)


def lru_state(entries: int, budget: int) -> Callable:
    """State function: a cache of a number of entries and of bytes that lets go what was used least recently.

    Rows (shard, id, op, key, size): `put` stores, `get` asks. Out (id, hit) of each get. An entry larger than the whole budget is not kept,
    and leaves an older one of its key as it was. The state is bounded by both limits.
    """

    def run(shard: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[str, int] = dict(json.loads(state.get[0])) if state.exists else {}  # in the order of use
        for batch in batches:
            out = []
            for row in batch.sort_values("id").itertuples():
                if row.op == "get":
                    out.append((row.id, row.key in held))
                    if row.key in held:
                        held[row.key] = held.pop(row.key)
                elif row.size <= budget:
                    held.pop(row.key, None)
                    held[row.key] = int(row.size)
                    while len(held) > entries or sum(held.values()) > budget:
                        del held[next(iter(held))]
            yield pd.DataFrame(out, columns=["id", "hit"])
        state.update((json.dumps(list(held.items())),))

    return run


def lru_reads(rows: DataFrame, entries: int = 1000, budget: int = 128 << 20) -> DataFrame:
    return rows.groupBy("shard").applyInPandasWithState(lru_state(entries, budget), "id long, hit boolean", "held string", "append", GroupStateTimeout.NoTimeout)


def breaker(failures: int = 5, cooldown: float = 30.0) -> Callable:
    """State function of a three-state circuit breaker: closed, open for `cooldown` after `failures` in a row, then one trial.

    Rows (key, ts, id, ok); out (id, allowed, state). A call that is not allowed does not count.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mode, failed, since = state.get if state.exists else ("closed", 0, 0.0)
        for batch in batches:
            out = []
            for row in batch.sort_values(["ts", "id"]).itertuples():
                if mode == "open" and row.ts - since >= cooldown:
                    mode = "half-open"
                allowed = mode != "open"
                if allowed and row.ok:
                    mode, failed = "closed", 0
                elif allowed:
                    failed += 1
                    if mode == "half-open" or failed >= failures:
                        mode, since = "open", row.ts
                out.append((row.id, allowed, mode))
            yield pd.DataFrame(out, columns=["id", "allowed", "state"])
        state.update((mode, failed, since))

    return run


def guarded(calls: DataFrame, failures: int = 5, cooldown: float = 30.0) -> DataFrame:
    return calls.groupBy("key").applyInPandasWithState(breaker(failures, cooldown), "id long, allowed boolean, state string", "mode string, failed int, since double", "append", GroupStateTimeout.NoTimeout)
