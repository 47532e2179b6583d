"""Queries over archives: a wheel or a source archive is built from each part, weighed by its directory, dealt out by weight and read."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut_lineage, spread
from ..sources import archives
from .catalog import query, read

_PARTS = 8


def _members(k: int, name: str, kind: str, size: int) -> list[tuple[str, str]]:
    """The files of a part's archive: sources, stubs, a marker, and what does not count."""
    if kind == "wheel":
        files = [(f"pk{k}/__init__.py", name), (f"pk{k}/__pycache__/old.py", "x"), (f"pk{k}/data.bin", "x"), (f"pk{k}-1.dist-info/top_level.txt", f"pk{k}\n")]
        files += [(f"pk{k}/part.pyi", f"size: {size}")] if size % 2 == 0 else []
        return files + ([(f"pk{k}/py.typed", "")] if size % 3 == 0 else [])
    top = f"pk{k}-1/src" if size % 2 == 0 else f"pk{k}-1"
    return [(f"pk{k}-1/setup.py", "setup()"), (f"{top}/pk{k}/__init__.py", name), (f"{top}/pk{k}/notes.txt", "x")]


def _built(k: int, name: str, kind: str, size: int) -> tuple[str, bytes]:
    out, files = io.BytesIO(), _members(k, name, kind, size)
    if kind == "sdist" and k % 3 == 1:
        with tarfile.open(fileobj=out, mode="w:gz") as t:
            for path, text in files:
                info = tarfile.TarInfo(path)
                info.size = len(text.encode())
                t.addfile(info, io.BytesIO(text.encode()))
        return f"pk{k}-1.tar.gz", out.getvalue()
    with zipfile.ZipFile(out, "w") as z:
        for path, text in files:
            z.writestr(path, text)
    return (f"pk{k}-1-py3-none-any.whl" if kind == "wheel" else f"pk{k}-1.zip"), out.getvalue()


def _archives(parts: DataFrame) -> DataFrame:
    """(archive, kind, size, content, k) of parts: a third of each are wheels, tars and zips."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kinds = ["wheel" if k % 3 == 0 else "sdist" for k in batch["p_partkey"]]
            built = [_built(int(k), n, kind, int(s)) for k, n, s, kind in zip(batch["p_partkey"], batch["p_name"], batch["p_size"], kinds, strict=True)]
            yield pd.DataFrame({"archive": [a for a, _ in built], "kind": kinds, "size": [len(c) for _, c in built], "content": [c for _, c in built], "k": batch["p_partkey"]})

    return parts.select("p_partkey", "p_name", "p_size").mapInPandas(run, "archive string, kind string, size bigint, content binary, k bigint")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives where their weights put them: weighed first, and only then read."""
    parts = _parts(spark, sf_dir)
    known = archives.weighed(_archives(parts)).select(F.regexp_extract("archive", r"^pk(\d+)", 1).cast("bigint").alias("p_partkey"), "weight")
    weighed = cut_lineage(parts.join(known, "p_partkey"))  # so that archives are built once to be weighed, and once to be read
    return _archives(archives.dealt(weighed, "weight", max(_PARTS, 4 * spark.sparkContext.defaultParallelism)))


_FILES = """
w AS (SELECT p_partkey AS k, p_name, p_size, p_partkey % 3 AS m FROM part),
f AS (SELECT 'pk' || k || '-1-py3-none-any.whl' AS archive, 'pk' || k || '/__init__.py' AS path, p_name AS content, p_size % 3 = 0 AS typed, k FROM w WHERE m = 0
  UNION ALL SELECT 'pk' || k || '-1-py3-none-any.whl', 'pk' || k || '/part.pyi', 'size: ' || p_size, p_size % 3 = 0, k FROM w WHERE m = 0 AND p_size % 2 = 0
  UNION ALL SELECT 'pk' || k || CASE WHEN m = 1 THEN '-1.tar.gz' ELSE '-1.zip' END, 'pk' || k || '/__init__.py', p_name, false, k FROM w WHERE m > 0
  UNION ALL SELECT 'pk' || k || CASE WHEN m = 1 THEN '-1.tar.gz' ELSE '-1.zip' END, 'setup.py', 'setup()', false, k FROM w WHERE m > 0 AND p_size % 2 = 1)"""


@query(f"WITH {_FILES} SELECT archive, path, content, typed, false AS truncated, 'pk' || k AS top FROM f")
def archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-19, SRC-22, SRC-23, SRC-25, STR-34: sources of wheels, tars and zips, read where their weights put them."""
    found = archives.source_files(_planned(spark, sf_dir))
    return found.select("archive", "path", F.col("content").cast("string").alias("content"), "typed", "truncated", F.element_at("top_level", 1).alias("top"))


@query(f"WITH {_FILES} SELECT archive, path, content FROM f WHERE path LIKE '%.pyi'")
def stub_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-26: stubs alone, with the same limits."""
    found = archives.source_files(_archives(_parts(spark, sf_dir)), archives.STUBS)
    return found.select("archive", "path", F.col("content").cast("string").alias("content"))


@query(f"WITH {_FILES} SELECT archive, (2 * sum(strlen(content)))::BIGINT AS weight FROM f WHERE archive LIKE '%.whl' GROUP BY archive")
def archive_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-24: what reading each wheel will cost, by its directory; these are stored, so packed bytes are source bytes."""
    return archives.weighed(_archives(_parts(spark, sf_dir))).filter("kind = 'wheel'").select("archive", "weight")
