"""Fuzzy search of many queries at once: blocks of symbols, as tries, against blocks of queries, as bits.

The score of a symbol is 0 if its path holds the query in any case, else the smaller of the edit distances of name and path to it, over
the longer of the two. Symbols and queries are dealt into blocks of a bounded size that meet by an equi-join; a pair of blocks is looked at as a
whole. The texts of one length form a trie, so a beginning that many share is compared once; all queries of lengths that are near enough go down
its levels side by side, a column of the table of edit distances being two numbers (Myers, Hyyrö). Containment goes down the same tries, a bit for each
letter of a query (shift-and). A symbol and a query meet in one place only, so an answer is a row that is neither moved nor counted again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A quarter of the tasks that compare, and the parts of the symbols for each; a query goes to all parts.
PARTS = 32
PARTS_A_TASK = 4
#: Symbols and queries of a block, cells of their table that are looked at at once, and last letters that do not part symbols of one beginning.
SYMBOLS, QUERIES = 1 << 13, 1 << 12
CELLS = 1 << 19
LAST = 3


def _dump(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _load(blob: pa.Scalar) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(blob.as_buffer())))


def _blocks(rows: DataFrame, most: int, name: str) -> DataFrame:
    """(part, block) of rows that are sorted by part; without a part, (block)."""
    by_part = "part" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part").to_numpy() if by_part else np.zeros(batch.num_rows, np.int32)
            begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            for a, b in zip(begin.tolist(), np.append(begin[1:], len(part)).tolist(), strict=True):
                for k in range(a, b, most):
                    block = pa.array([_dump(batch.slice(k, min(most, b - k)))], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(part[k : k + 1], pa.int32()), block] if by_part else [block], names=["part", name] if by_part else [name])

    return rows.mapInArrow(run, f"part int, {name} binary" if by_part else f"{name} binary")


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(the code points of all texts, one after another; lengths)."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(t) for t in texts], np.int64)


class _Trie:
    """Different texts of one length in order: of each level the node above each node, and its letter; the last level's nodes are the texts."""

    def __init__(self, letters: np.ndarray):
        new = np.zeros(len(letters), bool)
        new[:1] = True
        above, self.levels = np.zeros(len(letters), np.int64), []
        for column in letters.T:
            new[1:] |= column[1:] != column[:-1]
            first = np.flatnonzero(new)
            self.levels.append((above[first], column[first]))
            above = new.cumsum() - 1

    def apart(self, bits: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Edit distances of texts and queries; bits[letter, query] has the places of the letter in the query."""
        kind = bits.dtype.type
        one, full = kind(1), np.invert(kind(0))
        plus, minus = np.full((1, bits.shape[1]), full, bits.dtype), np.zeros((1, bits.shape[1]), bits.dtype)
        for above, letter in self.levels:
            eq, plus, minus = bits.take(letter, axis=0), plus.take(above, axis=0), minus.take(above, axis=0)
            zero = eq & plus
            zero += plus
            zero ^= plus
            zero |= eq
            zero |= minus
            up = zero | plus  # the place of eq is free now
            np.bitwise_or(minus, np.invert(up, out=up), out=up)
            down = np.bitwise_and(zero, plus, out=eq)
            up <<= one
            up |= one
            down <<= one
            np.bitwise_or(zero, up, out=plus)
            np.bitwise_or(down, np.invert(plus, out=plus), out=plus)
            np.bitwise_and(up, zero, out=minus)
        held = full >> (kind(8 * bits.itemsize) - lengths.astype(bits.dtype))
        plus &= held
        minus &= held
        found = np.bitwise_count(plus).view(np.int8) - np.bitwise_count(minus).view(np.int8)
        # at most the length of the query above and the length of the text below
        return found + np.int8(len(self.levels)) if len(self.levels) < 64 else found + np.int32(len(self.levels))

    def apart_long(self, query: np.ndarray) -> np.ndarray:
        """Edit distances of texts and one query of any length, by whole columns of the table."""
        steps = np.arange(len(query) + 1, dtype=np.int32)
        row = steps[None]
        for k, (above, letter) in enumerate(self.levels):
            before = row[above]
            row = np.empty_like(before)
            row[:, 0] = k + 1
            row[:, 1:] = np.minimum(before[:, 1:] + 1, before[:, :-1] + (letter[:, None] != query))
            row = np.minimum.accumulate(row - steps, axis=1) + steps
        return row[:, -1:]

    def holds(self, bits: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Which texts hold which queries."""
        kind = bits.dtype.type
        last = kind(1) << (lengths - 1).astype(bits.dtype)
        state = found = np.zeros((1, bits.shape[1]), bits.dtype)
        for above, letter in self.levels:
            state = state.take(above, axis=0)
            state <<= kind(1)
            state |= kind(1)
            state &= bits.take(letter, axis=0)
            found = found.take(above, axis=0)
            found |= state & last
        return found != 0


class _Symbols:
    """The lower-case names and paths of a block: a trie for each length, and the symbols that have each text as name and as path."""

    def __init__(self, names: list, paths: list):
        self.paths = paths
        texts = sorted({t for t in names + paths if t is not None}, key=lambda t: (len(t), t))
        letters, sizes = _letters(texts)
        self.alphabet, at = np.unique(letters, return_inverse=True)
        number = {t: k for k, t in enumerate(texts)}
        self.owners = []
        for column in (names, paths):
            of = np.array([-1 if t is None else number[t] for t in column], np.int64)
            order = np.argsort(of, kind="stable")
            self.owners.append((np.searchsorted(of[order], np.arange(len(texts) + 1)), order))
        self.is_path = np.diff(self.owners[1][0]) > 0
        begin = np.append(0, sizes.cumsum())
        #: (length, number of the first text, trie, which are paths)
        self.tries = []
        for n in np.unique(sizes[sizes > 0]).tolist():
            a, b = np.searchsorted(sizes, [n, n + 1])
            self.tries.append((n, int(a), _Trie(at[begin[a] : begin[b]].reshape(b - a, n)), self.is_path[a:b]))
        paths_letters = "\n".join(t for t, p in zip(texts, self.is_path, strict=True) if p)
        self.grams = {paths_letters[k : k + 2] for k in range(len(paths_letters) - 1)} | set(paths_letters)

    def rows(self, kind: int, texts: np.ndarray, queries: np.ndarray, scores: np.ndarray) -> tuple:
        """(symbols, queries, scores) of the symbols that have the texts as name (0) or path (1)."""
        begin, order = self.owners[kind]
        many = begin[texts + 1] - begin[texts]
        place = np.repeat(begin[texts] - (many.cumsum() - many), many) + np.arange(many.sum())
        return order[place], np.repeat(queries, many), np.repeat(scores, many)

    def scores(self, queries: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, queries, scores) of all that are no further than the threshold."""
        found = []
        letters, sizes = _letters(queries)
        at = np.minimum(np.searchsorted(self.alphabet, letters), len(self.alphabet) - 1)
        known = self.alphabet[at] == letters
        query = np.repeat(np.arange(len(queries)), sizes)
        place = np.arange(len(letters)) - np.repeat(sizes.cumsum() - sizes, sizes)
        maybe = np.array([all(q[k : k + 2] in self.grams for k in range(max(len(q) - 1, 1))) for q in queries])
        least = 0
        for dtype in (np.uint8, np.uint16, np.uint32, np.uint64, None):
            most = 8 * np.dtype(dtype).itemsize if dtype else np.inf
            mine = (sizes > least) & (sizes <= most)
            least = most
            if not mine.any():
                continue
            bits = None
            if dtype:
                bits = np.zeros((len(self.alphabet), len(queries)), dtype)
                here = known & mine[query]
                np.bitwise_or.at(bits, (at[here], query[here]), (np.uint64(1) << place[here].astype(np.uint64)).astype(dtype))
            for n, first, trie, is_path in self.tries:
                longer = np.maximum(sizes, n)
                near = np.flatnonzero(mine & (np.abs(sizes - n) <= np.floor(longer * threshold + 1e-9)))
                if len(near):
                    if dtype:
                        apart = trie.apart(bits[:, near], sizes[near])
                    else:
                        apart = np.concatenate([trie.apart_long(np.where(known, at, -1)[query == q]) for q in near], axis=1)
                    most_apart = np.floor(longer[near] * threshold + 1e-9).astype(np.int32)
                    if apart.dtype == np.int8:
                        most_apart = most_apart.astype(np.int8)  # both are of 64 letters at most
                    hit = np.flatnonzero(apart <= most_apart)
                    text, q = np.divmod(hit, len(near))
                    score = apart.ravel()[hit] / longer[near][q]
                    exact = score <= threshold
                    text, q, score = text[exact], q[exact], score[exact]
                    found += [self.rows(kind, first + text, near[q], score) for kind in (0, 1)]
                asked = np.flatnonzero(mine & maybe & (sizes <= n)) if is_path.any() else ()
                if len(asked):
                    if dtype:
                        text, q = np.divmod(np.flatnonzero(trie.holds(bits[:, asked], sizes[asked]) & is_path[:, None]), len(asked))
                    else:
                        text, q = self._held(first, is_path, [queries[k] for k in asked])
                    found.append(self.rows(1, first + text, asked[q], np.zeros(len(q))))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        symbol, of, score = (np.concatenate(x) for x in zip(*found, strict=True))
        key = symbol * len(queries) + of
        order = np.lexsort((score, key))
        order = order[np.flatnonzero(np.append(True, np.diff(key[order]) != 0)) if len(key) else order]
        return symbol[order], of[order], score[order]

    def _held(self, first: int, is_path: np.ndarray, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, query) of texts of a trie that hold long queries."""
        begin, order = self.owners[1]
        texts = np.flatnonzero(is_path)
        found = [(t, q) for t in texts.tolist() for q, asked in enumerate(queries) if asked in self.paths[order[begin[first + t]]]]
        return tuple(np.array(found, np.int64).reshape(-1, 2).T)

def near(symbols: DataFrame, queries: DataFrame, threshold: float = 0.4) -> DataFrame:
    """(query, score, columns of symbols) of symbols (path, name, ...) near the queries (query), by score and path within a query.

    Null and empty queries find nothing. The threshold must stay below a half: beyond it two strings may share no gram at all.
    Names and paths may be null. Equal rows of symbols count once. The answer may grow with the product of both tables; memory does not.
    """
    if not 0 <= threshold < 0.5:
        raise ValueError("a threshold from 0 to below 0.5")
    columns = symbols.columns
    asked = queries.select("query").filter("query <> ''").distinct().select("query", F.lower("query").alias("_q"))
    # symbols that differ in their last letters alone stay together, so tries share what they can
    beginning = F.expr(f"substring(_path, 1, length(_path) - {LAST})")
    rows = symbols.distinct().withColumns({"_name": F.lower("name"), "_path": F.lower("path")})
    rows = rows.withColumn("part", F.pmod(F.xxhash64(beginning), F.lit(4 * PARTS * PARTS_A_TASK)).cast("int"))
    # a number of partitions of its own: rows are few, pairs are many
    dealt = lambda df: df.repartition(4 * PARTS, "part")
    texts = _blocks(dealt(rows).sortWithinPartitions("part", "_path"), SYMBOLS, "texts")
    wanted = _blocks(asked.coalesce(8).sortWithinPartitions(F.length("_q"), "_q"), QUERIES, "wanted").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(4 * PARTS * PARTS_A_TASK - 1))))
    met = dealt(texts).join(dealt(wanted).hint("merge"), "part").select("texts", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = held = None
        for batch in batches:
            for blob, wanted_blob in zip(batch.column("texts"), batch.column("wanted"), strict=True):
                if at is None or not at.equals(blob):
                    at, block = blob, _load(blob)
                    held = _Symbols(block.column("_name").to_pylist(), block.column("_path").to_pylist())
                    shown = block.select(columns)
                wanted = _load(wanted_blob)
                step = max(CELLS // block.num_rows, 1)
                for k in range(0, wanted.num_rows, step):
                    some = wanted.slice(k, step)
                    s, q, score = held.scores(some.column("_q").to_pylist(), threshold)
                    if len(s):
                        yield pa.RecordBatch.from_arrays([some.column("query").take(pa.array(q)), pa.array(score), *(c.take(pa.array(s)) for c in shown.columns)], names=["query", "score", *columns])

    return met.mapInArrow(run, T.StructType([T.StructField("query", T.StringType()), T.StructField("score", T.DoubleType()), *symbols.schema.fields]))
