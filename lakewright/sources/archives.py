"""Python files in wheels and source archives.

Archives come as the binaryFile source lists them, one row each; a mapInPandas over
them yields one row a file, within the same limits for each archive wherever it is read.
An archive that a limit cut says so: `truncated`. `listed_files` reads archives of any size by
their paths, and of wheels only the directory and the files that are wanted.
"""

from __future__ import annotations

import contextlib
import heapq
import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranges

#: Files, bytes of a file and bytes of all files that are read of one archive, and of an inflated tar.
MOST_FILES, MOST_FILE, MOST_TOTAL, MOST_TAR = 50_000, 32 << 20, 200 << 20, 1 << 30
SCHEMA = "archive string, kind string, path string, content binary, top_level array<string>, typed boolean, truncated boolean"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
SOURCES, STUBS = (".py", ".pyi"), (".pyi",)


def _wanted(path: str, suffixes: tuple[str, ...]) -> bool:
    return path.endswith(suffixes) and "__pycache__" not in path and not path.startswith("/") and "\\" not in path and "\0" not in path and ".." not in path.split("/")


def read_wheel(data, suffixes: tuple[str, ...] = SOURCES) -> tuple[dict[str, bytes], list[str], bool, bool]:
    """(files, names of top_level.txt or of the top folders, whether a py.typed marker is there, whether a limit cut the files) of bytes or an open file; a broken entry is left out."""
    top: list[str] = []
    with zipfile.ZipFile(io.BytesIO(data) if isinstance(data, (bytes, bytearray, memoryview)) else data) as z:
        entries = z.infolist()
        typed = any(e.filename.endswith("/py.typed") for e in entries)
        for e in entries:
            if e.filename.endswith(".dist-info/top_level.txt"):
                top = [x.strip() for x in z.read(e).decode("utf-8", "replace").split("\n") if x.strip()]
        files, cut = _collect(((e.filename, e.file_size, lambda e=e: z.read(e)) for e in entries), suffixes)
    return files, top or top_folders(files), typed, cut


def top_folders(files) -> list[str]:
    """Importable names at the top: folders, and single files without their suffix."""
    names = [f.split("/")[0] if "/" in f else f.rsplit(".", 1)[0] for f in files]
    return list(dict.fromkeys(n for n in names if n.isidentifier() and n not in ("setup", "conftest")))


def read_sdist(data, name: str, suffixes: tuple[str, ...] = SOURCES) -> tuple[dict[str, bytes], bool]:
    """(Python files of a .tar.gz or .zip, below its one top folder, and below src/ if all packages stand there; whether a limit cut them)."""
    source = io.BytesIO(data) if isinstance(data, (bytes, bytearray, memoryview)) else data
    if name.endswith(".zip"):
        with zipfile.ZipFile(source) as z:
            files, cut = _collect(((e.filename, e.file_size, lambda e=e: z.read(e)) for e in z.infolist()), suffixes)
    else:
        files, cut = _read_tar(source, suffixes)
    below = {p.split("/", 1)[1]: c for p, c in files.items() if "/" in p}
    in_src = {p[4:]: c for p, c in below.items() if p.startswith("src/")}
    return (in_src if any(p.endswith("/__init__.py") for p in in_src) else below), cut


def _read_tar(source, suffixes: tuple[str, ...]) -> tuple[dict[str, bytes], bool]:
    ended = []

    def members(t: tarfile.TarFile):
        total = 0
        for m in t:
            total += m.size
            if total > MOST_TAR:
                ended.append(m.name)
                return
            if m.isfile():
                yield m.name, m.size, lambda m=m: (f.read() if (f := t.extractfile(m)) else b"")

    with tarfile.open(fileobj=source, mode="r|gz") as t:
        files, cut = _collect(members(t), suffixes)
    return files, cut or bool(ended)


def _collect(members, suffixes: tuple[str, ...] = SOURCES) -> tuple[dict[str, bytes], bool]:
    """(the wanted files of (path, size, read), whether a limit left one out)."""
    files: dict[str, bytes] = {}
    total, cut = 0, False
    for path, size, read in members:
        if not _wanted(path, suffixes):
            continue
        if size > MOST_FILE:
            cut = True
            continue
        if len(files) >= MOST_FILES or total + size > MOST_TOTAL:
            return files, True
        try:
            files[path] = read()
        except (zipfile.BadZipFile, OSError, RuntimeError):
            continue
        total += size
    return files, cut


def weigh(data: bytes) -> int:
    """What reading a wheel will cost: source and packed bytes by its directory alone; six times its size if that cannot be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return sum(e.file_size + e.compress_size for e in z.infolist() if _wanted(e.filename, (".py", ".pyi")))
    except zipfile.BadZipFile:
        return 6 * len(data)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """All wheels and source archives below a path: (archive, kind, size, content)."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(name.endswith(".whl"), "wheel").when(name.rlike(r"\.(tar\.gz|tgz|zip)$"), "sdist")
    return rows.select(name.alias("archive"), kind.alias("kind"), F.col("length").alias("size"), "content").filter("kind IS NOT NULL")


def weighed(archives_: DataFrame) -> DataFrame:
    """archives with `weight`, what reading each will cost: to sort, split or admit the work by."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["archive", "kind", "size"]].assign(weight=[weigh(c) if k == "wheel" else 6 * len(c) for k, c in zip(batch["kind"], batch["content"], strict=True)])

    return archives_.select("archive", "kind", "size", "content").mapInPandas(run, "archive string, kind string, size bigint, weight bigint")


#: Rows that one task deals out.
DEALT_ROWS = 10_000


def dealt(rows: DataFrame, weight: str, parts: int) -> DataFrame:
    """rows in `parts` partitions of nearly equal weight: the heaviest first, each to the partition with the least so far.

    Only weights and keys are needed to deal, so this comes before anything is read. Groups of some thousand rows are dealt one by one, each to
    partitions of its own if there are enough, else each beginning with another one; a single row heavier than a fair share stays whole.
    """
    count = rows.count()
    groups = max(1, -(-count // DEALT_ROWS))
    share = max(1, parts // groups)
    names = rows.columns
    keyed = rows.withColumn("_group", F.pmod(F.xxhash64(*names), F.lit(groups)).cast("int"))

    def deal(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(weight, ascending=False, kind="stable")
        first = int(group["_group"].iloc[0]) * share
        heap = [(0.0, (first + k) % parts) for k in range(share if groups <= parts else parts)]
        heapq.heapify(heap)
        bins = []
        for w in group[weight].fillna(0):
            load, at = heap[0]
            bins.append(at)
            heapq.heapreplace(heap, (load + max(float(w), 1.0), at))
        return group.assign(_bin=bins).drop(columns="_group")

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "_bin int"])
    return keyed.groupBy("_group").applyInPandas(deal, schema).repartitionById(parts, F.col("_bin")).drop("_bin")


def _rows(archive: str, kind: str, source, suffixes: tuple[str, ...]) -> list[tuple]:
    files, top, typed, cut = read_wheel(source, suffixes) if kind == "wheel" else (lambda f, c: (f, [], False, c))(*read_sdist(source, archive, suffixes))
    top = top or top_folders(files)
    return [(archive, kind, path, content, top, typed, cut) for path, content in files.items()]


#: Bytes of files that a frame holds before it goes out; those of one archive stay together.
FRAME_BYTES = 8 << 20


def _frames(archives_: Iterator[list[tuple]]) -> Iterator[pd.DataFrame]:
    """The rows of many small archives as one frame; no frame is empty, as that has no types."""
    held, size = [], 0
    for rows in archives_:
        held += rows
        size += sum(len(r[3]) for r in rows)
        if size >= FRAME_BYTES or len(held) >= 10_000:
            yield pd.DataFrame(held, columns=_COLUMNS)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=_COLUMNS)


def source_files(archives_: DataFrame, suffixes: tuple[str, ...] = SOURCES) -> DataFrame:
    """One row a Python file of each archive (with STUBS, its stubs alone); an archive that cannot be opened has none."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
        for batch in batches:
            for archive, kind, content in zip(batch["archive"], batch["kind"], batch["content"], strict=True):
                with contextlib.suppress(zipfile.BadZipFile, tarfile.TarError, OSError, EOFError):
                    yield _rows(archive, kind, content, suffixes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _frames(each(batches))

    return archives_.select("archive", "kind", "content").mapInPandas(run, SCHEMA)


def listed_files(paths: DataFrame, suffixes: tuple[str, ...] = SOURCES) -> DataFrame:
    """The same for a table of (path) on a file system that Arrow reads: no archive is loaded whole unless it is small."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
        for batch in batches:
            for path in batch["path"]:
                archive = path.rsplit("/", 1)[-1]
                with contextlib.suppress(zipfile.BadZipFile, tarfile.TarError, OSError, EOFError):
                    source, close = ranges.opened(path)
                    try:
                        yield _rows(archive, "wheel" if archive.endswith(".whl") else "sdist", source, suffixes)
                    finally:
                        close()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _frames(each(batches))

    return paths.select("path").mapInPandas(run, SCHEMA)
