"""Shared plumbing of the training-data operators: scratch tables and Arrow batches.

Intermediate results that several later steps read, or that cut a long lineage,
are written as Parquet below the folder the cluster names in
``spark.checkpoint.dir``: every executor sees that folder, so a lost executor
costs nothing but the tasks it was running.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are turned into numpy arrays at once; bounds a worker's memory.
SLICE_BYTES = 1 << 20
#: Rows of a narrow join side that one task may hash.
HASHED_ROWS = 500_000


#: A temporary folder for each application that has set none and runs on one machine, as tests do.
_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, a temporary one if all runs on this machine, else an error."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="lakewright-")
        root = _LOCAL[context.applicationId]
    return root.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    """(the Hadoop file system of a path, the path) on the JVM."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def release(spark: SparkSession) -> None:
    """Deletes the tables of all operator calls of this application, once their results are written or no longer wanted."""
    fs, p = _file_system(spark, f"{shared_root(spark)}/lakewright/{spark.sparkContext.applicationId}")
    fs.delete(p, True)


class Scratch:
    """Tables of one operator call, in a folder of its own below the shared root.

    An operator drops what only its own steps read. What its result reads stays until `release`, or until the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        top = f"{shared_root(spark)}/lakewright/{spark.sparkContext.applicationId}"
        self.base = f"{top}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        fs, p = _file_system(spark, top)
        fs.deleteOnExit(p)

    def table(self, df: DataFrame) -> DataFrame:
        """Writes df and reads it back: computed once, short lineage, files all executors share."""
        self.sweep()
        self._n += 1
        path = f"{self.base}/t{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lakewright_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of this scratch that nothing reads any more."""
        path = getattr(df, "_lakewright_path", None)
        if path:
            fs, p = _file_system(self.spark, path)
            fs.delete(p, True)

    def sweep(self) -> None:
        """Spark deletes the shuffle files of a finished step once the driver's JVM finds its plan unused, which may take hours on a
        quiet driver; so it is asked to look. Steps whose DataFrames are still held keep theirs, and so does the last query that was run,
        which is why a tiny one goes before."""
        self.spark.range(1).collect()
        gc.collect()
        self.spark._jvm.System.gc()


def trim() -> None:
    """Hands what this worker has freed back to the machine: idle workers are kept for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable) -> Callable:
    """A mapInArrow function that leaves a small worker behind."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def few_a_task(narrow_side: DataFrame, rows: int) -> DataFrame:
    """A join side of few narrow columns, to be hashed where the rows of a task take some 50 MB at most; beyond that Spark sorts and spills."""
    return narrow_side.hint("shuffle_hash") if rows <= HASHED_ROWS * partitions(narrow_side.sparkSession) else narrow_side


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, as name=source; other columns, clashing names included, go."""
    return df.select(*[F.col(f"`{src}`").alias(name) for name, src in columns.items()])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as (bytes, offsets): text i is bytes[offsets[i]:offsets[i + 1]]; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about `most` bytes of text, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def binary_array(blobs: list[bytes]) -> pa.Array:
    return pa.array(blobs, pa.binary())
