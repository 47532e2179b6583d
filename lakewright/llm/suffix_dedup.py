"""Removal of byte passages that repeat across documents, by suffix arrays of shards that are merged.

A window is WIDTH consecutive bytes of one document. Each window is owned by one of the GRAM-byte
strings in it, the one of the smallest hash (leftmost of equal ones), so equal windows have the same
owner at the same place: only owners and the stretch of bytes that their windows cover ever have to meet.

1. Shards of documents ask which owners stand in another document, too. Two thirds and more do not.
2. Equal stretches of the owners left collapse into one with its smallest document; all others that
   hold the same stretch lose its windows. What stays are stretches that differ from the others of
   their owner: the ends of passages, and copies with edits.
3. These meet by ranges of owners, as shards of a bounded size. Each gets a suffix array by Larsson-Sadakane
   refinement: suffixes sorted by eight bytes, then groups of equal ones alone by the rank of what
   follows, at twice the depth each round. Kasai's common prefixes tell where windows are equal over their
   whole width, and the sorted windows of a range's shards are merged by binary search, which leaves the smallest document
   of each window. A bit for each window goes back.

A round is one exchange of some 5 to 30 bytes an owner; texts stay in their shards. Owners that stand in
very many places are not gathered: their stretches go by their own hashes, and their windows one by one.
In the first round a collision keeps a candidate, in the second stretches are told apart by 96 bits of
BLAKE2, in the third by their bytes.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._words import mix
from ._work import SLICE_BYTES, Scratch, binary_array, lean, narrow, partitions, slices, utf8

WIDTH, GRAM = 50, 16
EDGE = WIDTH - 1
#: Bytes of text of a shard of documents, positions that are looked at at once, bytes of a shard of stretches, and bytes of entries that a bucket should get.
#: A round has a row for each shard and bucket, so both are as large as a task's memory allows; positions are few enough for a core's cache.
SHARD_BYTES = 8 << 20
POSITIONS = 1 << 16
SUFFIX_BYTES = 1 << 19
BUCKET_BYTES = 8 << 20
#: Places of an owner beyond which it is hot, rows of entries that are handed on at once, and stretches that are copied at once.
HOT_PLACES = 1 << 16
ROWS_AT_ONCE = 64
STRETCHES = 1 << 12
#: Ranges of owners of a bucket that get a suffix array each; their windows never meet.
RANGES = 8
SHARD = "shard long, n long, state binary"
_PLACE = np.uint64(POSITIONS - 1)
_LOW = np.uint64(0xFFFFFFFF)
_BYTES = np.array([1 << 8 * k for k in range(8)], np.uint64)
#: Two ranks and a place fit into one number where a suffix array has at most so many suffixes.
_BITS = np.int64(21)


# suffix arrays


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number, zeros behind the end."""
    w = np.zeros(len(data) + 8, np.uint64)
    w[: len(data)] = data
    for k in (1, 2, 4):
        w[:-k] = (w[:-k] << np.uint64(8 * k)) | w[k:]
    return w[: len(data)]


def suffix_array(data: np.ndarray, depth: int, starts: np.ndarray | None = None) -> np.ndarray:
    """The suffixes in ascending order of their first `depth` bytes or more, a shorter one first (Larsson and Sadakane).

    A group of suffixes that are equal so far is ranked by the place of its first; groups of one are done and never touched again.
    Where starts are given, only these are in order to that depth, and others are refined as far as the ranks of these need it.
    """
    n = len(data)
    word = eights(data)
    order = np.argsort(word)
    rank = np.empty(n, np.int64)
    open_, keys, known = np.arange(n), word[order], 8
    while True:
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(keys)))
        rank[order[open_]] = np.repeat(open_[start], size)
        open_ = open_[np.repeat(size > 1, size)]
        if known >= depth or not len(open_):
            return order
        if starts is not None:
            need = np.zeros(n, bool)
            for ahead in range(0, depth, 2 * known):
                need[np.minimum(starts + ahead, n - 1)] = True
            open_ = open_[need[order[open_]]]
        suffixes = order[open_]
        behind = suffixes + known
        follow = np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        if n < 1 << _BITS:  # numbers alone are sorted several times as fast as places by them
            keys = (rank[suffixes] << _BITS | follow) << _BITS | np.arange(len(suffixes))
            keys.sort()
            by, keys = keys & ((1 << _BITS) - 1), keys >> _BITS
        else:
            keys = rank[suffixes] << 32 | follow
            by = np.argsort(keys)
            keys = keys[by]
        order[open_], known = suffixes[by], 2 * known


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int, lane: int = 16) -> np.ndarray:
    """How many bytes each suffix in order shares with the one before it there, `most` at most (Kasai). The order may leave suffixes out.

    In the order of the text a suffix shares at most one byte less than the suffix before it did, if the neighbour moves on to a suffix in order,
    too. Suffixes that are equal to the depth of the array stand in any order, so behind a suffix that shared `most` that holds for the same
    neighbour only; beside another one counting begins anew. Lanes of the text go side by side.
    """
    n, m = len(data), len(order)
    word = np.concatenate([eights(data), np.zeros(most + 8, np.uint64)])
    at = np.full(n + 1, -1, np.int64)
    at[order] = np.arange(m)
    suffixes = np.flatnonzero(at >= 0)
    before = np.full(m, -1, np.int64)
    before[1:] = order[:-1]
    before = before[at[suffixes]]
    lanes = -(-m // lane)
    deal = lambda x, fill: np.ascontiguousarray(np.concatenate([x, np.full(lanes * lane - m, fill, np.int64)]).reshape(lanes, lane).T)
    found = np.zeros((lane, lanes), np.int64)
    h = np.zeros(lanes, np.int64)
    i, j = np.full(lanes, -2, np.int64), np.full(lanes, -2, np.int64)
    for step, (here, neighbour) in enumerate(zip(deal(suffixes, -1), deal(before, -1), strict=True)):
        goes_on = (here == i + 1) & (j >= 0) & (at[j + 1] >= 0) & ((h < most) | (neighbour == j + 1))
        i, j = here, neighbour
        h = np.where((j < 0) | ~goes_on, 0, np.maximum(h - 1, 0))
        active = np.flatnonzero((j >= 0) & (h < most))
        while len(active):
            same = 8 - np.searchsorted(_BYTES, word[i[active] + h[active]] ^ word[j[active] + h[active]], "right")
            h[active] += same
            active = active[(same == 8) & (h[active] < most)]
        h = np.minimum(h, np.minimum(most, n - np.maximum(i, j)))
        found[step] = h
    shared = np.empty(m, np.int64)
    shared[at[suffixes]] = found.T.ravel()[:m]
    return shared


class Windows:
    """The different windows of a shard of stretches in order, each with its smallest document."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, docs: np.ndarray, width: int):
        order = suffix_array(data, width, starts)
        number = np.full(len(data), -1, np.int64)
        number[starts] = np.arange(len(starts))
        order = order[number[order] >= 0]  # suffixes that begin no window have served the ranks
        new = common_prefixes(data, order, width) < width
        first = np.flatnonzero(new)
        window = number[order]
        self.least = np.minimum.reduceat(docs[window], first)
        #: Which of the different windows each window is.
        self.of = np.empty(len(starts), np.int64)
        self.of[window] = new.cumsum() - 1
        self._data, self._starts, self._width = data, starts[window[first]], width

    @cached_property
    def keys(self) -> np.ndarray:
        """Their bytes."""
        # a last byte that is not zero keeps numpy from cutting zeros off
        view = np.lib.stride_tricks.sliding_window_view(self._data, self._width)[self._starts]
        return np.ascontiguousarray(np.concatenate([view, np.ones((len(view), 1), np.uint8)], 1)).view(f"S{self._width + 1}").ravel()


def merge(shards: list[Windows]) -> tuple[np.ndarray, np.ndarray]:
    """(the different windows of all shards in order, the smallest document of each), each shard's looked up in what is there."""
    keys, least = shards[0].keys, shards[0].least.copy()
    for shard in shards[1:]:
        at = np.searchsorted(keys, shard.keys)
        known = np.zeros(len(at), bool)
        inner = at < len(keys)
        known[inner] = keys[at[inner]] == shard.keys[inner]
        least[at[known]] = np.minimum(least[at[known]], shard.least[known])
        keys, least = np.insert(keys, at[~known], shard.keys[~known]), np.insert(least, at[~known], shard.least[~known])
    return keys, least


# owners


def owner_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each owner that says nothing of the one by which it was chosen: those are small, and would crowd the first buckets."""
    both = np.lib.stride_tricks.sliding_window_view(data, GRAM)[at] if len(at) else np.zeros((0, GRAM), np.uint8)
    words = np.ascontiguousarray(both).view(">u8").astype(np.uint64)
    return mix(mix(words[:, 1] ^ _LOW) + words[:, 0])


def owners(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, place of the owner) of the runs of neighbouring windows with one owner, over texts data[offsets[i]:offsets[i + 1]]."""
    found = []
    step = POSITIONS - width
    for base in range(0, max(len(data) - width + 1, 0), step):
        part = data[base : base + step + width - 1]
        begin = np.maximum(offsets[:-1] - base, 0)
        count = np.maximum(np.minimum(offsets[1:] - base - width + 1, step) - begin, 0)
        if not count.sum():
            continue
        word = eights(part)
        key = (mix(mix(word[: len(part) - GRAM + 1]) + word[8 : len(part) - 7]) & ~_PLACE) | np.arange(len(part) - GRAM + 1, dtype=np.uint64)
        span, have = width - GRAM + 1, 1
        while have < span:
            more = min(have, span - have)
            key = np.minimum(key[: len(key) - more], key[more:])
            have += more
        starts = np.repeat(begin - (count.cumsum() - count), count) + np.arange(count.sum())
        owner = (key[starts] & _PLACE).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        found.append((starts[new] + base, np.diff(np.append(new, len(starts))), owner[new] + base))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def _gather(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes data[begin:begin + size] of all stretches, one after another."""
    to = size.cumsum()
    out = np.empty(to[-1] if len(to) else 0, np.uint8)
    for k in range(0, len(size), STRETCHES):
        part = slice(k, k + STRETCHES)
        base, end = to[k] - size[k], to[part][-1]
        np.take(data, np.repeat(begin[part] - (to[part] - size[part]), size[part]) + np.arange(base, end), out=out[base:end])
    return out


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where a new key begins in sorted key columns."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _dump(*values) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(values, 5))


def _load(blob) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


# rounds: `asks` gives the sorted routes of what a shard asks for and a function that packs a range of it


def shards(docs: DataFrame) -> DataFrame:
    """Shards of documents (doc_id, text): (ids, whether there is one, offsets, bytes, runs of windows with their owners); a document is never cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def out() -> pa.RecordBatch:
            column = pa.concat_arrays([i for i, _, _ in held])
            sizes = np.concatenate([np.diff(o) for _, o, _ in held])
            data = np.concatenate([d for _, _, d in held])
            offsets = np.concatenate([[0], sizes.cumsum()])
            known = column.is_valid().to_numpy(zero_copy_only=False)
            first, count, at = _known(data, offsets, known)
            state = _dump(column.fill_null(0).to_numpy(), known, offsets, data, first, count.astype(np.uint8), (at - first).astype(np.uint8))
            return pa.RecordBatch.from_arrays([pa.array([base + n]), pa.array([len(first)]), binary_array([state])], names=["shard", "n", "state"])

        for batch in slices(batches, "text", min(SHARD_BYTES, SLICE_BYTES)):
            data, offsets = utf8(batch.column("text"))
            held.append((batch.column("doc_id"), offsets, data))
            size += len(data)
            if size >= SHARD_BYTES:
                yield out()
                n, held, size = n + 1, [], 0
        if held:
            yield out()

    return docs.mapInArrow(lean(run), SHARD)


def _known(data: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The owners of texts that have an id."""
    first, count, at = owners(data, offsets, WIDTH)
    left = known[np.searchsorted(offsets, first, side="right") - 1]
    return first[left], count[left], at[left]


Asks = tuple[np.ndarray, Callable[[slice], bytes]]


def _bucket(route: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each route, in the order of routes; the ranges of a bucket are those of a multiple of their number."""
    return ((route >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


class _Owners:
    """Round one: which owners of a shard of documents stand in another document, and which in very many places."""

    def __init__(self, state: tuple):
        self.ids, _, self.offsets, self.data, self.first, self.count, ahead = state
        self.first = self.first.astype(np.int64)
        self.hash = owner_hashes(self.data, self.first + ahead)
        self.row = np.searchsorted(self.offsets, self.first, side="right") - 1
        self.order = np.argsort(self.hash)
        begin = _groups(self.hash[self.order])
        self.size = np.diff(np.append(begin, len(self.order)))
        self.different = self.hash[self.order[begin]]
        row = self.row[self.order]
        several = np.minimum.reduceat(row, begin) != np.maximum.reduceat(row, begin)
        self.flag = (several * np.uint8(128) + np.minimum(self.size, 127)).astype(np.uint8)

    def asks(self, _: int) -> Asks:
        return self.different, lambda part: (self.different[part] & _LOW).astype(np.uint32).tobytes() + self.flag[part].tobytes()

    def left(self, answers: bytes) -> tuple | None:
        """(id, row, first byte, windows, owner, hot, bytes) of the stretches that may repeat."""
        got = np.empty(len(self.order), np.uint8)
        got[self.order] = np.repeat(np.frombuffer(answers, np.uint8), self.size)
        left = np.flatnonzero(got)
        if not len(left):
            return None
        first, count, row = self.first[left], self.count[left], self.row[left]
        data = _gather(self.data, first, count.astype(np.int64) + EDGE)
        return self.ids[row], row.astype(np.uint32), (first - self.offsets[row]), count, self.hash[left], got[left] > 1, data


def _judge_owners(blobs: list[bytes], hot_places: int) -> list[bytes]:
    n = [len(x) // 5 for x in blobs]
    h = np.concatenate([np.frombuffer(x, np.uint32, k) for x, k in zip(blobs, n, strict=True)])
    flag = np.concatenate([np.frombuffer(x, np.uint8, offset=4 * k) for x, k in zip(blobs, n, strict=True)])
    order = np.argsort(h)
    begin = _groups(h[order])
    size = np.diff(np.append(begin, len(h)))
    repeated = (size > 1) | np.logical_or.reduceat(flag[order] >= 128, begin)
    hot = np.add.reduceat((flag[order] & 127).astype(np.int64), begin) > hot_places
    out = np.empty(len(h), np.uint8)
    out[order] = np.repeat(repeated * (1 + hot), size)
    return [x.tobytes() for x in np.split(out, np.cumsum(n)[:-1])]


class _Stretches:
    """Round two: equal stretches of owners collapse into the one of the smallest document."""

    def __init__(self, state: tuple):
        self.id, self.row, self.first, self.count, self.owner, self.hot, self.data = state
        self.size = self.count.astype(np.int64) + EDGE
        self.end = self.size.cumsum()
        whole = self.data.tobytes()
        # taken again for the answers: hashes do not compress, and kept with the stretches they would move with them
        digests = b"".join([hashlib.blake2b(whole[a:b], digest_size=12).digest() for a, b in zip((self.end - self.size).tolist(), self.end.tolist(), strict=True)])
        parts = np.frombuffer(digests, np.uint32).reshape(-1, 3).astype(np.uint64)
        self.one, self.two = parts[:, 0] << np.uint64(32) | parts[:, 1], parts[:, 2].astype(np.uint32)
        route = np.where(self.hot, self.one, self.owner)
        self.order = np.lexsort((self.two, self.one, route))
        self.begin = _groups(route[self.order], self.one[self.order], self.two[self.order])
        self.of = np.empty(len(self.order), np.int64)
        self.of[self.order] = np.repeat(np.arange(len(self.begin)), np.diff(np.append(self.begin, len(self.order))))
        self.some = self.order[self.begin]
        self.least = np.minimum.reduceat(self.id[self.order], self.begin)
        self.route = route[self.some]

    def asks(self, _: int) -> Asks:
        columns = (self.route, self.one[self.some], self.least, self.two[self.some], self.hot[self.some])
        return self.route, lambda part: b"".join(x[part].tobytes() for x in columns)

    def left(self, answers: bytes) -> tuple | None:
        """(runs of windows that go: row, first byte, windows; runs to be resolved: the same and the stretch of each; stretches: document, owner, windows, hot, bytes)."""
        got = np.frombuffer(answers, np.uint8)
        gone = (got[self.of] == 1) | (self.id > self.least[self.of])
        asked = ~gone & (got[self.of] == 2)
        if not gone.any() and not asked.any():
            return None
        run = lambda which: (self.row[which], self.first[which], self.count[which])
        kept = np.flatnonzero(got == 2)
        some = self.some[kept]
        number = np.full(len(got), -1, np.int64)
        number[kept] = np.arange(len(kept))
        data = _gather(self.data, self.end[some] - self.size[some], self.size[some])
        return run(gone), (*run(asked), number[self.of[asked]]), (self.least[kept], self.owner[some], self.count[some], self.hot[some], data)


def _judge_stretches(blobs: list[bytes]) -> list[bytes]:
    n = [len(x) // 29 for x in blobs]
    column = lambda kind, at: np.concatenate([np.frombuffer(x, kind, k, at * k) for x, k in zip(blobs, n, strict=True)])
    route, one, doc, two, hot = column(np.uint64, 0), column(np.uint64, 8), column(np.int64, 16), column(np.uint32, 24), column(bool, 28)
    order = np.lexsort((two, one, route))
    begin = _groups(route[order], one[order], two[order])
    size = np.diff(np.append(begin, len(order)))
    least = np.repeat(np.minimum.reduceat(doc[order], begin), size)
    by_route = _groups(route[order])
    stretches = np.diff(np.append(np.searchsorted(begin, by_route), len(begin)))
    mixed = np.repeat(stretches > 1, np.diff(np.append(by_route, len(order)))) | hot[order]
    out = np.empty(len(route), np.uint8)
    out[order] = np.where(doc[order] > least, 1, np.where(mixed, 2, 0))
    return [x.tobytes() for x in np.split(out, np.cumsum(n)[:-1])]


class _Ends:
    """Round three: stretches that differ from others of their owner, window by window. Of a hot owner each window is an entry of its own."""

    def __init__(self, state: tuple):
        self.gone, self.asked, (doc, owner, count, hot, data) = state
        count = count.astype(np.int64)
        size = count + EDGE
        begin = size.cumsum() - size
        #: Of each entry: its stretch, its first window and its windows.
        cold, warm = np.flatnonzero(~hot), np.flatnonzero(hot)
        inner = np.arange(count[warm].sum()) - np.repeat(count[warm].cumsum() - count[warm], count[warm])
        of = np.concatenate([cold, np.repeat(warm, count[warm])])
        first = np.concatenate([np.zeros(len(cold), np.int64), inner])
        windows = np.concatenate([count[cold], np.ones(len(inner), np.int64)])
        place, whole = begin[of] + first, memoryview(data.tobytes())
        own = [int.from_bytes(hashlib.blake2b(whole[p : p + WIDTH], digest_size=8).digest(), "little") for p in place[len(cold) :].tolist()]
        route = np.concatenate([owner[cold], np.array(own, np.uint64)])
        order = np.argsort(route, kind="stable")
        self.route, self.doc, self.windows, self.place = route[order], doc[of[order]], windows[order], place[order]
        self.data, self.count, self.target = data, count, (count.cumsum() - count)[of[order]] + first[order]

    def asks(self, buckets: int) -> Asks:
        def pack(part: slice) -> bytes:
            sizes = self.windows[part] + EDGE
            ranges = np.bincount((_bucket(self.route[part], buckets * RANGES) % np.uint64(RANGES)).astype(np.int64), minlength=RANGES)
            return ranges.astype(np.uint32).tobytes() + self.doc[part].tobytes() + self.windows[part].astype(np.uint8).tobytes() + _gather(self.data, self.place[part], sizes).tobytes()

        return self.route, pack

    def spans(self, answers: bytes) -> dict[int, np.ndarray]:
        """Row of the shard -> its removed byte ranges [begin, end), which neither touch nor overlap."""
        bits = np.frombuffer(answers, np.uint8).astype(bool)
        removed = np.zeros(int(self.count.sum()), bool)
        removed[np.repeat(self.target - (self.windows.cumsum() - self.windows), self.windows) + np.arange(self.windows.sum())] = bits
        row, first, count, stretch = self.asked
        count = count.astype(np.int64)
        within = np.arange(count.sum()) - np.repeat(count.cumsum() - count, count)
        goes = removed[np.repeat((self.count.cumsum() - self.count)[stretch], count) + within]
        rows, begins = np.repeat(row, count)[goes], (np.repeat(first, count) + within)[goes]
        ends = begins + WIDTH
        rows, begins = np.concatenate([rows, self.gone[0]]), np.concatenate([begins, self.gone[1]])
        ends = np.concatenate([ends, self.gone[1] + self.gone[2].astype(np.int64) + EDGE])
        order = np.lexsort((ends, begins, rows))
        rows, begins, ends = rows[order].astype(np.int64), begins[order], ends[order]
        out: dict[int, np.ndarray] = {}
        cut = np.append(_groups(rows), len(rows))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if a < b:
                far = np.maximum.accumulate(ends[a:b])
                new = np.flatnonzero(np.concatenate([[True], begins[a + 1 : b] > far[:-1]]))
                out[int(rows[a])] = np.stack([begins[a:b][new], far[np.append(new[1:], b - a) - 1]], 1)
        return out


def _judge_range(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], suffix_bytes: int) -> np.ndarray:
    """For each window of the entries (documents, windows, bytes): whether a smaller document has it. Entries form shards of a bounded size that are merged."""
    shards_, docs_of, some, done = [], [], [], 0
    for k, entry in enumerate(held):
        some.append(entry)
        done += len(entry[2])
        if done >= suffix_bytes or k == len(held) - 1:
            windows = np.concatenate([w for _, w, _ in some]).astype(np.int64)
            size = windows + EDGE
            starts = np.repeat((size.cumsum() - size) - (windows.cumsum() - windows), windows) + np.arange(windows.sum())
            docs_of.append(np.repeat(np.concatenate([d for d, _, _ in some]), windows))
            shards_.append(Windows(np.concatenate([x for _, _, x in some]), starts, docs_of[-1], WIDTH))
            some, done = [], 0
    if len(shards_) == 1:
        return shards_[0].least[shards_[0].of] < docs_of[0]
    keys, least = merge(shards_)
    return np.concatenate([least[np.searchsorted(keys, x.keys)][x.of] < docs for x, docs in zip(shards_, docs_of, strict=True)])


def _judge_ends(blobs: list[bytes], suffix_bytes: int) -> list[bytes]:
    """For each window of each entry: whether a smaller document has it, by ranges of owners."""
    ranges: list[list[tuple]] = [[] for _ in range(RANGES)]
    out = []
    for k, blob in enumerate(blobs):
        head = 4 * RANGES
        cut = np.append(0, np.frombuffer(blob, np.uint32, RANGES).cumsum(dtype=np.int64))
        n = int(cut[-1])
        docs, windows, data = np.frombuffer(blob, np.int64, n, head), np.frombuffer(blob, np.uint8, n, head + 8 * n), np.frombuffer(blob, np.uint8, offset=head + 9 * n)
        at = np.append(0, windows.cumsum(dtype=np.int64))[cut].tolist()
        cut = cut.tolist()
        out.append(np.empty(at[-1], np.uint8))
        for r, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if a < b:
                ranges[r].append((k, at[r], docs[a:b], windows[a:b], data[at[r] + EDGE * a : at[r + 1] + EDGE * b]))
    for held in ranges:
        if held:
            removed, done = _judge_range([x[2:] for x in held], suffix_bytes), 0
            for k, begin, _, windows, _ in held:
                n = int(windows.sum(dtype=np.int64))
                out[k][begin : begin + n] = removed[done : done + n]
                done += n
    return [x.tobytes() for x in out]


def _answers(states: DataFrame, kind: type, judge: Callable, buckets: int) -> DataFrame:
    """(shard, answers: array of (bucket, found)) after one exchange; a bucket is held whole, one at a time."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("state"), strict=True):
                route, pack = kind(_load(blob.as_buffer())).asks(buckets)
                bucket = _bucket(route, buckets)
                begin = _groups(bucket)
                cut = np.append(begin, len(bucket)).tolist()
                for k in range(0, len(begin), ROWS_AT_ONCE):
                    some = begin[k : k + ROWS_AT_ONCE]
                    blobs = [pack(slice(a, b)) for a, b in zip(cut[k : k + len(some)], cut[k + 1 : k + 1 + len(some)], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[some].astype(np.int32)), pa.array([shard] * len(some), pa.int64()), binary_array(blobs)], names=["bucket", "shard", "entries"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=1)

        def out(bucket: int, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
            found = [compressor.compress(x) for x in judge([x for _, x in held])]
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in held], pa.int64()), pa.array([bucket] * len(held), pa.int32()), binary_array(found)], names=["shard", "bucket", "found"])

        at, held = None, []
        for batch in batches:
            for b, shard, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "shard", "entries")), strict=True):
                if b != at and held:
                    yield out(at, held)
                    held = []
                at = b
                held.append((shard, blob))
        if held:
            yield out(at, held)

    entries = states.mapInArrow(lean(ask), "bucket int, shard long, entries binary")
    dealt = entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(answer), "shard long, bucket int, found binary")
    return dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("bucket", "found"))).alias("answers"))


def _found(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple, bytes]]:
    """(shard, state, answers in the order of what was asked)."""
    expand = zstandard.ZstdDecompressor().decompress
    for shard, blob, answers in zip(batch.column("shard").to_pylist(), batch.column("state"), batch.column("answers"), strict=True):
        yield shard, _load(blob.as_buffer()), b"".join(expand(a["found"]) for a in answers.as_py() or ())


def _round(states: DataFrame, kind: type, judge: Callable, entry: int, scratch: Scratch) -> DataFrame | None:
    """The shards' states after a round whose entries take `entry` bytes of a task; None if nothing is left."""
    n = states.agg(F.sum("n")).first()[0] or 0
    if not n and kind is not _Ends:
        return None
    buckets = min(max(2 * partitions(scratch.spark), -(-n * entry // BUCKET_BYTES)), 1 << 28)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, state, answers in _found(batch):
                asked = kind(state)
                if kind is _Ends:
                    spans = asked.spans(answers)
                    n, left = len(spans), spans or None
                else:
                    left = asked.left(answers)
                    n = 0 if left is None else len(left[2][0]) if kind is _Stretches else len(left[0])
                if left is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([n], pa.int64()), binary_array([_dump(left) if kind is _Ends else _dump(*left)])], names=["shard", "n", "state"])

    busy = states.filter("n > 0")
    # of the last round, shards that ask nothing still have windows that go
    # as a table, so that the entries' shuffle can go before the states are joined
    answers = scratch.table(_answers(busy, kind, judge, buckets))
    joined = (states if kind is _Ends else busy).join(answers, "shard", "left")
    left = scratch.table(joined.select("shard", "state", "answers").mapInArrow(lean(run), SHARD))
    scratch.drop(answers)
    return left


def suffix_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, hot_places: int = HOT_PLACES, suffix_bytes: int = SUFFIX_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept) of every row.

    Removes each byte that a window of WIDTH bytes covers which also starts in a document of a smaller id; windows are judged
    on the input. spans are the removed byte ranges [begin, end), maximal ones; kept (with_text) the bytes that stay, which need not be
    UTF-8 any more. Null texts are empty; texts of fewer than WIDTH bytes lose none. Rows of one id never count
    against each other, and equal ones get the same result each. A row whose id is null is passed on whole, and counts
    against none. An empty table gives an empty one; other columns do not matter, whatever their names. The longest text bounds a
    task: some four times its bytes.
    """
    scratch = Scratch(spark, "suffixes")
    named = narrow(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    whole = scratch.table(shards(named))
    states = whole
    for kind, judge, entry in ((_Owners, partial(_judge_owners, hot_places=hot_places), 5), (_Stretches, _judge_stretches, 29), (_Ends, partial(_judge_ends, suffix_bytes=suffix_bytes), 500)):
        left = _round(states, kind, judge, entry, scratch) if states is not None else None
        if states is not whole and states is not None:
            scratch.drop(states)
        states = left
    if states is None:
        joined = whole.select("state", F.lit(None).cast("binary").alias("spans"))
    else:
        joined = whole.join(states.select("shard", F.col("state").alias("spans")), "shard", "left").select("state", "spans")
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>" + ", kept binary" * with_text

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, found in zip(batch.column("state"), batch.column("spans"), strict=True):
                ids, known, offsets, data, *_ = _load(blob.as_buffer())
                spans = _load(found.as_buffer())[0] if found.is_valid else {}
                data, at, rows = memoryview(data.tobytes()), offsets.tolist(), []
                for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    pairs, digest, pieces, done = spans[i].tolist() if i in spans else [], hashlib.sha256(), [], a
                    for s, e in [*pairs, (b - a, b - a)]:
                        digest.update(data[done : a + s])
                        if with_text:
                            pieces.append(data[done : a + s])
                        done = a + e
                    rows.append((int(ids[i]) if known[i] else None, b - a, sum(e - s for s, e in pairs), len(pairs), digest.hexdigest(), pairs or None, b"".join(pieces)))
                types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.list_(pa.int64()))] + [pa.binary()] * with_text
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names=[f.split(" ")[0] for f in out.split(", ")])

    return joined.mapInArrow(lean(strip), out)
