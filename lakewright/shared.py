"""Where intermediate results go that all executors must see."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: A temporary folder for each application that has set none and runs on one machine, as tests do.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one if all runs on this machine, else an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="lakewright-")
        folder = _LOCAL[context.applicationId]
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; deleted when the application ends."""
    path = f"{shared_folder(spark)}/lakewright-work/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over some tasks a core by keys, for work in which a narrow row costs much: a small file comes as one or two partitions."""
    return df.repartition(max(32, 4 * df.sparkSession.sparkContext.defaultParallelism), *keys)


def met_by_key(df: DataFrame) -> DataFrame:
    """df for joins that move both sides by key. A table that is derived row by row is larger than its size is estimated, and a broadcast goes through the driver."""
    return df.hint("merge")


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
