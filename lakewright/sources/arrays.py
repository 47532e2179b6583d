"""One large JSON document read by many tasks: the elements of an array of its root object, a row each.

A byte range in the middle of a document does not tell whether it begins inside a string, nor how deep. So a first
pass looks at each range under both assumptions and reports a few numbers: how many quotes it has, how the
depth moves and how low it gets, and where the array's name stands. These add up from the beginning, exactly, and tell
each range's state. The second pass is a data source whose partitions are ranges with their states: a range yields the
elements whose separator lies in it, and reads on to the end of the last one. Nothing of the document goes through the driver.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 32 << 20
#: Tasks that read ranges smaller than that.
MOST_TASKS = 256
#: Bytes that are looked at at once, and bytes before a block in which the name of an array that opens in it may begin.
BLOCK_BYTES = 4 << 20
BEFORE = 1 << 16
_QUOTE, _BACK, _COMMA = 0x22, 0x5C, 0x2C
_STEP = np.zeros(256, np.int8)
_STEP[[0x7B, 0x5B]], _STEP[[0x7D, 0x5D]] = 1, -1
SUMMARY = "path string, start long, odd boolean, ends array<long>, lows array<long>, places array<struct<at:long,inside:boolean,depth:long,low:long>>"


def _open(path: str):
    """A file that can be read from any place."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return open(unquote(url.path) if url.scheme else path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _backslashes(file, at: int) -> int:
    """How many backslashes end just before a place."""
    size = 64
    while at:
        begin = max(at - size, 0)
        file.seek(begin)
        tail = file.read(at - begin)
        run = len(tail) - len(tail.rstrip(b"\\"))
        if run < len(tail) or not begin:
            return run
        size *= 4
    return 0


class _Scan:
    """Strings and depth over the blocks of a document from some place on."""

    def __init__(self, inside: bool, depth: int, backslashes: int):
        self.inside, self.depth, self.back = inside, depth, backslashes

    def block(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each byte stands outside of strings, the depth behind each byte)."""
        n = len(data)
        quote = data == _QUOTE
        at = np.flatnonzero(quote)
        if self.back or (data == _BACK).any():
            plain = np.where(data != _BACK, np.arange(n), -1 - self.back)
            last = np.maximum.accumulate(np.concatenate([[-1 - self.back], plain]))  # the last byte before each that is no backslash
            quote[at[(at - 1 - last[at]) % 2 == 1]] = False
            self.back = int(n - 1 - last[n])
        odd = (np.cumsum(quote) + self.inside) % 2 == 1
        outside = ~odd & ~quote
        depth = np.cumsum(_STEP[data] * outside) + self.depth
        self.inside, self.depth = bool(odd[-1]), int(depth[-1])
        return outside, depth


def _blocks(file, start: int, stop: int, size: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks from a place on, the first of `size` bytes at most and each of twice the one before up to BLOCK_BYTES."""
    file.seek(start)
    size = max(min(size, BLOCK_BYTES), 1)
    while start < stop:
        data = file.read(min(size, stop - start))
        if not data:
            return
        yield start, np.frombuffer(data, np.uint8)
        start, size = start + len(data), min(2 * size, BLOCK_BYTES)


def _summary(path: str, start: int, stop: int, key: str) -> dict:
    """What a range does to the state before it, under both assumptions on that."""
    name = re.compile(rb'"' + re.escape(json.dumps(key)[1:-1].encode()) + rb'"\s*:\s*\[')
    ends, lows, places, odd = [], [], [], False
    with _open(path) as file:
        back = _backslashes(file, start)
        for inside in (False, True):
            scan, low, found = _Scan(inside, 0, back), 0, {}
            for base, data in _blocks(file, start, stop):
                outside, depth = scan.block(data)
                low = min(low, int(depth.min()))
                for place in found.values():
                    place["low"] = min(place["low"], int(depth.min()))
                prefix = _read(file, max(base - BEFORE, 0), min(base, BEFORE))
                file.seek(base + len(data))
                text = prefix + data.tobytes()
                for m in name.finditer(text):
                    k = m.end() - 1 - len(prefix)
                    # the bracket stands outside of strings, so the name before it is one, unless its first quote is escaped
                    if k >= 0 and outside[k] and text[max(m.start() - 1, 0)] != _BACK:
                        level = int(depth[k]) - 1
                        found.setdefault(level, {"at": base + k, "inside": inside, "depth": level, "low": int(depth[k:].min())})
            ends.append(scan.depth)
            lows.append(low)
            places += found.values()
            if not inside:
                odd = scan.inside
    return {"path": path, "start": start, "odd": odd, "ends": ends, "lows": lows, "places": places}


def _read(file, at: int, size: int) -> bytes:
    file.seek(at)
    return file.read(size)


def _states(summaries: list[dict], path: str) -> list[dict]:
    """The ranges of a document that hold elements, with where they begin and in which state."""
    inside, depth, begin, out, closed = False, 0, None, [], False
    summaries = sorted(summaries, key=lambda s: s["start"])
    for s, following in zip(summaries, [*summaries[1:], None], strict=True):
        stop = following["start"] if following else None
        if begin is None:
            fitting = [p for p in s["places"] if p["inside"] == inside and p["depth"] + depth == 1]
            if fitting:
                place = min(fitting, key=lambda p: p["at"])
                begin = place["at"] + 1
                low = place["low"] + depth
        else:
            low = s["lows"][inside] + depth
        if begin is not None and not closed and (stop is None or begin < stop):
            first = s["start"] <= begin
            out.append({"path": path, "begin": max(s["start"], begin), "stop": stop, "inside": inside and not first, "depth": 2 if first else depth, "first": first})
            closed = low < 2
        depth += s["ends"][inside]
        inside ^= s["odd"]
    if depth or inside:
        raise ValueError(f"{path} is cut off")
    return out


def _elements(state: dict) -> Iterator[str]:
    """The elements whose separator lies in a range."""
    stop = state["stop"]
    with _open(state["path"]) as file:
        begin = state["begin"]
        scan = _Scan(state["inside"], state["depth"], 0 if state["first"] else _backslashes(file, begin))
        held: list[bytes] | None = [] if state["first"] else None
        for base, data in _blocks(file, begin, 1 << 62, BLOCK_BYTES if stop is None else stop - begin + 1024):  # what is read does not grow with the file
            outside, depth = scan.block(data)
            ends = np.flatnonzero(outside & (((data == _COMMA) & (depth == 2)) | (depth < 2)))
            text, done = data.tobytes(), 0
            for k in ends.tolist():
                if held is not None:
                    held.append(text[done:k])
                    element = b"".join(held).strip()
                    if element:
                        yield element.decode()
                if depth[k] < 2 or (stop is not None and base + k >= stop):
                    return
                held, done = [], k + 1
            if held is not None:
                held.append(text[done:])
            elif stop is not None and base + len(data) >= stop:
                return


class _Ranges(InputPartition):
    def __init__(self, states: list[dict]):
        self.states = states


class _Reader(DataSourceReader):
    def __init__(self, states: list[dict]):
        self.states = states

    def partitions(self) -> list[_Ranges]:
        """Neighbouring ranges together, in MOST_TASKS tasks at most, or as many as there are SPLIT_BYTES."""
        size = sum(s["stop"] - s["begin"] for s in self.states if s["stop"] is not None)
        each = -(-len(self.states) // max(MOST_TASKS, size // SPLIT_BYTES))
        return [_Ranges(self.states[k : k + each]) for k in range(0, len(self.states), each)]

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for element in (e for s in partition.states for e in _elements(s)):
            held.append(element)
            size += len(element)
            if size >= BLOCK_BYTES or len(held) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["element"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["element"])


class JsonArray(DataSource):
    """The data source `json_array`; its option `states` is what `array_elements` has found."""

    @classmethod
    def name(cls) -> str:
        return "json_array"

    def schema(self) -> str:
        return "element string"

    def reader(self, schema) -> _Reader:
        return _Reader(json.loads(self.options["states"]))


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a folder, a pattern or a file itself; names that begin with a dot or an underscore do not count."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for status in system.globStatus(pattern) or []:
        for f in system.listStatus(status.getPath()):
            if f.isFile() and not f.getPath().getName().startswith(("_", ".")):
                out.append((f.getPath().toString(), f.getLen()))
    return sorted(out)


def array_elements(spark: SparkSession, path: str, key: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(element): the text of each element of the array `key` of the documents' root objects; a document without it has none, one that is cut off fails.

    The driver gets a few numbers for each range of split_bytes. Files must be reachable from every executor by their path.
    """
    ranges = [(name, start, min(start + split_bytes, size)) for name, size in _files(spark, path) for start in range(0, size, split_bytes)]
    rows = spark.createDataFrame(ranges, "path string, start long, stop long").repartition(max(1, min(len(ranges), max(MOST_TASKS, sum(e - a for _, a, e in ranges) // SPLIT_BYTES))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_summary(r["path"], r["start"], r["stop"], key) for r in batch.to_pylist()]
            place = pa.list_(pa.struct([("at", pa.int64()), ("inside", pa.bool_()), ("depth", pa.int64()), ("low", pa.int64())]))
            kinds = [("path", pa.string()), ("start", pa.int64()), ("odd", pa.bool_()), ("ends", pa.list_(pa.int64())), ("lows", pa.list_(pa.int64())), ("places", place)]
            yield pa.RecordBatch.from_pylist(found, schema=pa.schema(kinds))

    by_path: dict[str, list[dict]] = {}
    for row in rows.mapInArrow(run, SUMMARY).collect():
        by_path.setdefault(row.path, []).append(row.asDict(recursive=True))
    states = [s for name, summaries in sorted(by_path.items()) for s in _states(summaries, name)]
    if not states:
        return spark.createDataFrame([], "element string")
    spark.dataSource.register(JsonArray)
    return spark.read.format("json_array").option("states", json.dumps(states)).load()
