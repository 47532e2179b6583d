"""Removal of passages that repeat across documents, by level-wise doubling.

Level one looks at all windows of FIRST words. Of each document only the runs of words stay in
which every window is repeated elsewhere and which are long enough for the next level; there the
windows are twice as long, and so on, the last level being held to the target width: 4, 8, 13.
A level is one exchange over the survivors of the level before, and the loop ends early once
nothing survives. Shorter windows than FIRST repeat nearly everywhere and would prune nothing;
the removal is defined at the target width, so no window need be extended beyond it.

Documents travel in chunks of a megabyte or two as word numbers with the chunk's own table of word
hashes, about two bytes a word, so that no level reads or shuffles a text. A chunk sends one entry
for each distinct window to that window's bucket and gets back one bit for each, in the order it
sent them: of a window that a third of all documents share, a bucket holds one entry a chunk.
Buckets are as many as the survivors of the level ask for, so what a task holds does not grow
with the input. Before the target width, windows are told apart by some 40 bits or more, where a
collision only keeps a candidate alive; at the target width by 96 bits, 64 over one hash of each word
and 32 over another.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words
from ._work import Scratch, binary_array, lean, narrow, partitions, slices, utf8

#: Words of the windows of the first level.
FIRST = 4
#: Words of a chunk, bytes of entries that a bucket should get, and rows of entries a mapper hands on at once.
CHUNK_WORDS = 1 << 18
BUCKET_BYTES = 16 << 20
ROWS_AT_ONCE = 64
_LOW = np.uint64(0xFFFFFFFF)
#: bytes.split() splits at the six blanks only; no other byte counts as one.
_BLANKS = bytes(0x20 if 0x09 <= b <= 0x0D else b for b in range(256))
STATE = "chunk long, words long, state binary"
ENTRIES = "bucket int, chunk long, entries binary"
ANSWERS = "chunk long, bucket int, bits binary"


class _State:
    """What is alive of a chunk: segments (document, first word, words), their words as numbers into `vocab` and `second`, two hashes of words."""

    __slots__ = ("docs", "index", "length", "of", "second", "start", "texts", "vocab")

    def __init__(self, docs, texts, of, start, length, vocab, second, index):
        self.docs, self.texts, self.of, self.start, self.length, self.vocab, self.second, self.index = docs, texts, of, start, length, vocab, second, index

    @classmethod
    def load(cls, blob) -> _State:
        *rest, low, planes = pickle.loads(blob)
        index = low
        for k, plane in enumerate(planes):
            index = index | np.unpackbits(plane, count=len(low)).astype(np.uint32) << np.uint32(16 + k)
        return cls(*rest, index)

    def dump(self) -> bytes:
        """Documents and words that no segment needs any more are left out; numbers take two bytes and a bit for each power of two above."""
        docs, of = _numbered(self.of, len(self.docs))
        words, index = _numbered(self.index, len(self.vocab))
        planes = [np.packbits((index >> bit & 1).astype(bool)) for bit in range(16, max(len(words) - 1, 0).bit_length())]
        return pickle.dumps((self.docs[docs], self.texts[docs], of.astype(np.uint32), self.start, self.length, self.vocab[words], self.second[words], (index & 0xFFFF).astype(np.uint16), planes), 5)

    def places(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(places in the chunk's words from which `width` words lie in one segment, the segment of each)."""
        size = self.length.astype(np.int64)
        return _words.inside(np.concatenate([[0], size.cumsum()]), width), np.repeat(np.arange(len(size)), np.maximum(size - width + 1, 0))

    def hashes(self, width: int, at: np.ndarray, which: int = 0) -> np.ndarray:
        return _words.windows((self.second if which else self.vocab)[self.index], width, which)[at]

    def narrowed(self, at: np.ndarray, segment: np.ndarray, alive: np.ndarray, width: int, least: int) -> _State | None:
        """The runs of places that are alive, as segments of `least` words or more; None if there are none."""
        at, segment = at[alive], segment[alive]
        if not len(at):
            return None
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (segment[1:] != segment[:-1])]))
        size = np.diff(np.append(new, len(at))) + width - 1
        new, size = new[size >= least], size[size >= least]
        if not len(new):
            return None
        begin, of = at[new], segment[new]
        base = np.concatenate([[0], self.length.cumsum(dtype=np.int64)])[of]
        take = np.repeat(begin - np.concatenate([[0], size.cumsum()[:-1]]), size) + np.arange(size.sum())
        return _State(self.docs, self.texts, self.of[of], (self.start[of] + begin - base).astype(np.uint32), size.astype(np.uint32), self.vocab, self.second, self.index[take])


def _numbered(numbers: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(the numbers below `most` that occur, each number's place among them)."""
    occurs = np.zeros(most, bool)
    occurs[numbers] = True
    return np.flatnonzero(occurs), (occurs.cumsum() - 1)[numbers]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new key begins in sorted key columns."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def chunks(docs: DataFrame, width: int) -> DataFrame:
    """(chunk, words, state) of documents (doc_id, th, text) with `width` words or more; a document is never cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            docs, texts, length, one, two, index = (np.concatenate(x) for x in zip(*held, strict=True))
            words, second, again = _words.distinct(one, two)  # of the pieces' tables one for the chunk
            offset = np.repeat(np.cumsum([0, *(len(x[3]) for x in held[:-1])]), [len(x[5]) for x in held])
            state = _State(docs, texts, np.arange(len(docs), dtype=np.uint32), np.zeros(len(docs), np.uint32), length, words, second, again[index + offset])
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | n]), pa.array([len(index)]), binary_array([state.dump()])], names=["chunk", "words", "state"])

        for batch in slices(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            starts, ends, first = _words.bounds(data, offsets)
            count = np.diff(first)
            long = count >= width
            if not long.any():
                continue
            of_long = np.repeat(long, count)
            one, two, index = _words.distinct(*_words.hashes(data, starts[of_long], ends[of_long]))
            held.append((batch.column("doc_id").to_numpy()[long], batch.column("th").to_numpy()[long], count[long].astype(np.uint32), one, two, index))
            size += len(index)
            if size >= CHUNK_WORDS:
                yield out()
                n, held, size = n + 1, [], 0
        if held:
            yield out()

    return docs.mapInArrow(lean(run), STATE)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


class _Level:
    """The distinct windows of a chunk at one length, in the order in which they are sent and answered."""

    def __init__(self, state: _State, width: int, last: bool):
        self.at, self.segment = state.places(width)
        doc = state.docs[state.of[self.segment]]
        self.h = state.hashes(width, self.at)
        if last:
            self.second = (state.hashes(width, self.at, 1) & _LOW).astype(np.uint32)
            order = np.lexsort((self.second, self.h))
            begin = _runs(self.h[order], self.second[order])
        else:
            order = np.argsort(self.h, kind="stable")
            begin = _runs(self.h[order])
        self.order, self.size = order, np.diff(np.append(begin, len(order)))
        self.doc, self.distinct = doc, self.h[order[begin]]
        self.least = np.minimum.reduceat(doc[order], begin) if len(order) else doc
        if last:
            self.second = self.second[order[begin]]
        else:
            self.several = np.maximum.reduceat(doc[order], begin) > self.least if len(order) else np.zeros(0, bool)

    def spread(self, of_distinct: np.ndarray) -> np.ndarray:
        """A value of each distinct window, for each place."""
        out = np.empty(len(self.order), of_distinct.dtype)
        out[self.order] = np.repeat(of_distinct, self.size)
        return out


def _entries(states: DataFrame, width: int, last: bool, buckets: int) -> DataFrame:
    """(bucket, chunk, entries): hashes of the chunk's distinct windows, with the smallest document at the last level, else whether it has several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("state"), strict=True):
                level = _Level(_State.load(blob.as_buffer()), width, last)
                cut = np.searchsorted(_bucket(level.distinct, buckets), np.arange(buckets + 1, dtype=np.uint64))
                filled = np.flatnonzero(np.diff(cut))
                for k in range(0, len(filled), ROWS_AT_ONCE):
                    ids, blobs = filled[k : k + ROWS_AT_ONCE], []
                    for b in ids.tolist():
                        part = slice(cut[b], cut[b + 1])
                        if last:
                            blobs.append(level.distinct[part].tobytes() + level.second[part].tobytes() + level.least[part].tobytes())
                        else:
                            blobs.append((level.distinct[part] & _LOW).astype(np.uint32).tobytes() + np.packbits(level.several[part]).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([chunk] * len(ids), pa.int64()), binary_array(blobs)], names=["bucket", "chunk", "entries"])

    return states.mapInArrow(lean(run), ENTRIES)


def _repeated(blobs: list[bytes]) -> list[np.ndarray]:
    """For each chunk's entries of a bucket before the last level: whether a window is in another document, too."""
    n = [8 * len(x) // 33 for x in blobs]  # four bytes and a bit each
    h = np.concatenate([np.frombuffer(x, np.uint32, k) for x, k in zip(blobs, n, strict=True)])
    several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8, offset=4 * k), count=k).astype(bool) for x, k in zip(blobs, n, strict=True)])
    order = np.argsort(h, kind="stable")
    begin = _runs(h[order])
    size = np.diff(np.append(begin, len(h)))
    out = np.empty(len(h), bool)
    out[order] = np.repeat((size > 1) | np.logical_or.reduceat(several[order], begin), size)
    return np.split(out, np.cumsum(n)[:-1])


def _earlier(blobs: list[bytes]) -> list[np.ndarray]:
    """For each chunk's entries of a bucket at the last level: whether another chunk has the window in a smaller document than this one."""
    n = [len(x) // 20 for x in blobs]
    h1 = np.concatenate([np.frombuffer(x, np.uint64, k) for x, k in zip(blobs, n, strict=True)])
    h2 = np.concatenate([np.frombuffer(x, np.uint32, k, 8 * k) for x, k in zip(blobs, n, strict=True)])
    doc = np.concatenate([np.frombuffer(x[12 * k :], np.int64, k) for x, k in zip(blobs, n, strict=True)])
    order = np.lexsort((h2, h1))
    begin = _runs(h1[order], h2[order])
    least = np.repeat(np.minimum.reduceat(doc[order], begin), np.diff(np.append(begin, len(h1))))
    out = np.empty(len(h1), bool)
    out[order] = doc[order] > least
    return np.split(out, np.cumsum(n)[:-1])


def _answers(entries: DataFrame, last: bool) -> DataFrame:
    """(chunk, answers: array of (bucket, bits)) after one exchange; a bucket is held whole, one at a time."""
    judge: Callable = _earlier if last else _repeated

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(bucket: int, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
            bits = [np.packbits(x).tobytes() for x in judge([x for _, x in held])]
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in held], pa.int64()), pa.array([bucket] * len(held), pa.int32()), binary_array(bits)], names=["chunk", "bucket", "bits"])

        at, held = None, []
        for batch in batches:
            for b, chunk, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "entries")), strict=True):
                if b != at and held:
                    yield out(at, held)
                    held = []
                at = b
                held.append((chunk, blob))
        if held:
            yield out(at, held)

    dealt = entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(run), ANSWERS)
    return dealt.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))


def _answered(batch: pa.RecordBatch, width: int, last: bool, buckets: int) -> Iterator[tuple[int, _State, _Level, np.ndarray]]:
    """(chunk, state, level, the answer for each place) of rows (chunk, state, answers)."""
    for chunk, blob, answers in zip(batch.column("chunk").to_pylist(), batch.column("state"), batch.column("answers").to_pylist(), strict=True):
        state = _State.load(blob.as_buffer())
        level = _Level(state, width, last)
        cut = np.searchsorted(_bucket(level.distinct, buckets), np.arange(buckets + 1, dtype=np.uint64))
        got = np.zeros(len(level.distinct), bool)
        for a in answers or ():
            part = slice(cut[a["bucket"]], cut[a["bucket"] + 1])
            got[part] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=part.stop - part.start).astype(bool)
        yield chunk, state, level, level.spread(got)


def _survivors(states: DataFrame, answers: DataFrame, width: int, least: int, buckets: int) -> DataFrame:
    """The chunks' states with the runs of repeated windows alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, state, level, alive in _answered(batch, width, False, buckets):
                left = state.narrowed(level.at, level.segment, alive, width, least)
                if left is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([len(left.index)]), binary_array([left.dump()])], names=["chunk", "words", "state"])

    return states.join(answers, "chunk").select("chunk", "state", "answers").mapInArrow(lean(run), STATE)


def _spans(states: DataFrame, answers: DataFrame, width: int, buckets: int) -> DataFrame:
    """(id, th, spans: bytes of [first word, end) pairs) of documents that lose words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, state, level, gone in _answered(batch, width, True, buckets):
                gone |= level.doc > level.spread(level.least)  # a smaller document of the same chunk has it
                left = state.narrowed(level.at, level.segment, gone, width, width)
                if left is None:
                    continue
                begin, end = left.start.astype(np.int64), left.start.astype(np.int64) + left.length
                of = left.of
                # starts and ends ascend in a document; ranges that touch are one
                new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (begin[1:] > end[:-1])]))
                pairs = np.stack([begin[new], end[np.append(new[1:], len(end)) - 1]], 1)
                of = of[new]
                by = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]]))
                blobs = [pairs[a:b].tobytes() for a, b in zip(by[:-1].tolist(), by[1:].tolist(), strict=True)]
                own = of[by[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array(state.docs[own]), pa.array(state.texts[own]), binary_array(blobs)], names=["id", "th", "spans"])

    found = states.join(answers, "chunk").select("chunk", "state", "answers").mapInArrow(lean(run), "id long, th long, spans binary")
    return found.groupBy("id", "th").agg(F.first("spans").alias("spans"))  # rows of the same id and text have the same


def repeats(docs: DataFrame, scratch: Scratch, width: int = 13, first: int = FIRST, levels: list[tuple[int, int]] | None = None) -> DataFrame | None:
    """(id, th, spans) of documents (doc_id, th, text) with windows that a document of a smaller id has, too; None if nothing repeats.

    levels gets the length and the words alive of each level.
    """
    at = min(first, width)
    states = scratch.table(chunks(docs, width))
    while True:
        words = states.agg(F.sum("words")).first()[0]
        if not words:
            scratch.drop(states)
            return None
        if levels is not None:
            levels.append((at, words))
        last = at == width
        buckets = min(max(4 * partitions(scratch.spark), -(-words * (20 if last else 5) // BUCKET_BYTES)), 1 << 30)
        # as a table, so that the entries' shuffle can go before the states are joined
        answers = scratch.table(_answers(_entries(states, at, last, buckets), last))
        if last:
            spans = scratch.table(_spans(states, answers, width, buckets))
            scratch.drop(states)
            scratch.drop(answers)
            return spans
        following = min(2 * at, width)
        left = scratch.table(_survivors(states, answers, at, following, buckets))
        scratch.drop(states)
        scratch.drop(answers)
        states, at = left, following


def substring_dedup(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, keep: tuple[str, ...] = (), with_text: bool = True, first: int = FIRST
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans, kept, and the columns named in `keep`) of every row.

    Removes each word that a window of `width` words covers which also starts in a document of a
    smaller id; windows are judged on the input. spans are the removed word ranges [first, end).
    kept (with_text) is the words that stay, joined by single blanks, where any were removed, and the
    text as it was elsewhere. kept_sha256 is over the joined words in either case. Null and blank texts have no words; texts
    shorter than `width` lose none. Rows of the same doc_id never count against each other, and repeated rows
    get the same result each. A row whose doc_id is null is passed on whole, and counts against none. An empty
    table gives an empty one; other columns do not matter, whatever their names. The longest text bounds a task.
    """
    scratch = Scratch(spark, "substring")
    key, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    named = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").filter("doc_id IS NOT NULL")
    spans = repeats(named, scratch, width, first)
    kept_cols = [f"keep_{c}" for c in keep]
    rows = docs.select(key.alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"), *[F.col(f"`{c}`").alias(f"keep_{c}") for c in keep])
    if spans is None:
        rows = rows.withColumn("spans", F.lit(None).cast("binary"))
    else:
        found = spans.select(F.col("id").alias("found_id"), F.col("th").alias("found_th"), "spans")
        rows = rows.join(found, (F.col("doc_id") == F.col("found_id")) & (F.col("th") == F.col("found_th")), "left")
    rows = rows.select("doc_id", "text", "spans", *kept_cols)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = ["doc_id long", "n_words long", "n_removed long", "kept_sha256 string", "spans array<array<long>>"] + ["kept string"] * with_text + [f"`{c}` {types[c]}" for c in kept_cols]

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            data, at = data.tobytes(), offsets.tolist()
            counts, removed, shas, ranges, texts = [], [], [], [], {}
            for i, (a, b, blob) in enumerate(zip(at, at[1:], batch.column("spans").to_pylist(), strict=False)):
                words = data[a:b].translate(_BLANKS).split()
                pairs = np.frombuffer(blob, np.int64).reshape(-1, 2).tolist() if blob else []
                counts.append(len(words))
                removed.append(sum(e - s for s, e in pairs))
                ranges.append(pairs or None)
                left, done = [], 0
                for s, e in pairs:
                    left += words[done:s]
                    done = e
                joined = b" ".join(left + words[done:] if pairs else words)
                shas.append(hashlib.sha256(joined).hexdigest())
                if pairs and with_text:
                    texts[i] = joined.decode("utf-8", "replace")
            cols = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(ranges, pa.list_(pa.list_(pa.int64())))]
            if with_text:
                column = batch.column("text")
                cols.append(pa.array([texts[i] if i in texts else column[i].as_py() for i in range(batch.num_rows)], column.type) if texts else column)
            yield pa.RecordBatch.from_arrays([*cols, *(batch.column(c) for c in kept_cols)], names=[f.split(" ")[0].strip("`") for f in out])

    found = rows.mapInArrow(lean(strip), ", ".join(out))
    return found.select(*[f.split(" ")[0] for f in out if not f.startswith("`keep_")], *[F.col(f"keep_{c}").alias(c) for c in keep])
