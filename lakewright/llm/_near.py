"""Near copies for `simhash_dedup.deduplicate`: sets of five-word shingles with a Jaccard similarity of 0.8 or more.

The trie self-join over all fingerprints, spread by agreeing bit blocks, looks first, within WIDE bits. At a similarity of
0.8 some 10 of 64 bits differ, and up to 28, and a budget of that size leaves a trie over all fingerprints next to nothing to
prune. So the same join then runs once more within BUDGET bits, spread by min-wise bands of the shingles instead of blocks of
bits: 24 bands of five minima each, so that a pair at exactly 0.8 misses all of them with probability 0.00007, and one above
that less often. Every pair that is looked at comes from a paired descent in a trie; what it finds is held against the exact
shingle sets, so bands and bits decide only who is looked at, not who is linked.

Texts of the same set are one node, and a fingerprint is the bitwise majority over a set, in which a shingle counts once, as it does for the
similarity. Of the pairs that the descent finds in a group, each node first hands on the nearest one and the one with a node that is
picked for the group, which joins large groups in a number of pairs that grows with the group; after that, what is of several components yet is
compared across them, by a descent again. A task holds some thousand sets of a group; a larger group is cut into chunks, and each pair of chunks
that may hold a link is a task of its own. No row is dropped; a pair is missed if no band is shared, or if its fingerprints differ in more
than BUDGET bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _words
from ._graph import components
from ._trie import near_pairs
from ._work import Scratch, binary_array, lean, slices, unused, utf8

WIDTH = 5
#: Similarity as a fraction: 4 / 5.
PART, WHOLE = 4, 5
BANDS, ROWS = 24, 5
#: Nodes of a bucket that one task holds on a side.
MOST = 4096
#: Bits within which the join over all fingerprints looks, and the one inside a bucket. At a similarity of 0.8 a bit differs
#: with probability 0.151 (sets of 4 and 5 shingles: 0.188).
WIDE, BUDGET = 3, 28
#: Nodes of a bucket up to which it shares a walk with others; a larger one has its own. Pairs that are held against bands at once.
FEW = 64
AT_ONCE = 1 << 16
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_ODD = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASK = np.random.default_rng(43).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingles of text i, ascending, are hashes[first[i]:first[i + 1]].

    A text of fewer than `width` words is one shingle; one without a word has none.
    """
    data = _LOWER[data]
    starts, ends, first = _words.bounds(data, offsets)
    words, _ = _words.hashes(data, starts, ends)
    at = _words.inside(first, width)
    value = _words.windows(words, width)[at]
    text = np.searchsorted(first, at, side="right") - 1
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        whole = [xxhash.xxh64_intdigest(words[first[i] : first[i + 1]].tobytes(), 42) for i in short.tolist()]
        value, text = np.concatenate([value, np.array(whole, np.uint64)]), np.concatenate([text, short])
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    if len(value):
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (text[1:] != text[:-1])])
        value, text = value[new], text[new]
    return value, np.searchsorted(text, np.arange(len(offsets)))


def signatures(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, bands) of the texts that have a shingle: a hash of the whole set, and one hash for each band."""
    starts = first[:-1][np.diff(first) > 0]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros((0, BANDS), np.uint64)
    node = _words.mix(np.add.reduceat(_words.mix(value ^ np.uint64(0x5851F42D4C957F2D)), starts))
    bands = np.empty((len(starts), BANDS), np.uint64)
    for b in range(BANDS):
        held = np.full(len(starts), b + 1, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            held = _words.mix(held ^ np.minimum.reduceat((value ^ _MASK[k]) * _ODD[k], starts))
        bands[:, b] = held
    return node, bands


def simhashes(items: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each set: the bitwise majority over its hashes."""
    out = np.zeros((len(items), 8), np.uint8)
    for i, x in enumerate(items):
        ones = np.zeros(64, np.int64)
        for k in range(0, len(x), 1 << 14):
            part = _words.mix(x[k : k + (1 << 14)])
            ones += np.unpackbits(part.view(np.uint8)).reshape(len(part), 64).sum(0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > len(x))
    return out.view(np.uint64).ravel()


def _marks(rows: DataFrame) -> DataFrame:
    """(doc_id, th, node, n, fp, bands) of rows (doc_id, th, text); a text without a word has node 0 and no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            value, first = shingle_sets(*utf8(batch.column("text")))
            n = np.diff(first)
            found, bands = signatures(value, first)
            node = np.zeros(len(n), np.uint64)
            node[n > 0] = found
            fp = simhashes([value[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)])
            ends = np.concatenate([[0], (n > 0).cumsum() * BANDS]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(node.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(fp.view(np.int64)), lists], names=["doc_id", "th", "node", "n", "fp", "bands"])

    return rows.mapInArrow(lean(run), "doc_id long, th long, node long, n long, fp long, bands array<long>")


def _sets(rows: DataFrame) -> DataFrame:
    """(node, items: the shingle hashes in order) of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            value, first = shingle_sets(*utf8(batch.column("text")))
            blobs = [value[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), binary_array(blobs)], names=["node", "items"])

    return rows.mapInArrow(lean(run), "node long, items binary")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending arrays of distinct values have a Jaccard similarity of PART / WHOLE or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * WHOLE >= PART * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            keep = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(a, b, strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("node").alias(x), F.col("items").alias(y)) for x, y in (("u", "a"), ("v", "b")))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(lean(run), "u long, v long")


def _runs(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
    return edge[:-1], np.diff(edge)


def _fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of such sizes can be similar at all."""
    return np.minimum(a, b) * WHOLE >= np.maximum(a, b) * PART


def _shared(nodes: DataFrame) -> DataFrame:
    """(g, c, node, n, fp, hub) of buckets that hold more than one node, c of them; hub is one of them, another one in each bucket.

    A bucket is only counted and joined, so its rows may be in many tasks; the derived second key lets adaptive execution split them.
    """
    turn = F.xxhash64("g")
    buckets = nodes.select("node", "n", "fp", F.explode("bands").alias("g"))
    hubs = buckets.groupBy("g").agg(F.count("*").alias("c"), F.min(F.col("node").bitwiseXOR(turn)).alias("h")).filter("c > 1")
    hubs = hubs.select("g", turn.alias("k"), "c", F.col("h").bitwiseXOR(turn).alias("hub"))
    return buckets.withColumn("k", turn).join(hubs, ["g", "k"]).select("g", "c", "node", "n", "fp", "hub")


def _everywhere(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): a spanning forest of what the trie self-join over all fingerprints links within WIDE bits."""
    from .simhash_dedup import links  # which imports this module

    fps = scratch.table(nodes.groupBy("fp").agg(F.min("node").alias("rep")))
    same = nodes.join(fps.withColumnRenamed("fp", "_fp"), F.col("fp") == F.col("_fp")).filter("node <> rep").select(F.col("rep").alias("u"), F.col("node").alias("v"))
    return same.unionByName(links(fps, WIDE, scratch)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def nearest(group: np.ndarray, node: np.ndarray, n: np.ndarray, fp: np.ndarray, hub: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs that the trie self-join finds in each group, if their sizes allow them to be similar at all: for each node the nearest one, and those with a hub.

    Rows are sorted by group; hub tells which node is the group's.
    """
    order = np.lexsort((fp, group))
    group, node, n, fp, hub = (x[order] for x in (group, node, n, fp, hub))
    off, to = np.full(len(fp), 127, np.int8), np.full(len(fp), -1)
    found = []
    for i, j in near_pairs(group, fp, BUDGET):
        keep = _fits(n[i], n[j])
        i, j = i[keep], j[keep]
        star = hub[i] | hub[j]
        found.append((i[star], j[star]))
        d = np.bitwise_count(fp[i] ^ fp[j]).astype(np.int8)
        for x, y in ((i, j), (j, i)):
            less = np.flatnonzero(d < off[x])
            less = less[np.argsort(-d[less], kind="stable")]  # the last one stays
            off[x[less]], to[x[less]] = d[less], y[less]
    at = np.flatnonzero(to >= 0)
    u, v = (np.concatenate(x) for x in zip(*found, (at, to[at]), strict=True))
    return node[u], node[v]


def _looked_at(shared: DataFrame, most: int) -> DataFrame:
    """(u, v): the pairs of `nearest` in each bucket; one of more than `most` nodes is cut into chunks, and its hub is in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(k, node, n, fp, hub):
            u, v = nearest(k, node, n, fp.view(np.uint64), hub)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "node", "n", "fp", "hub")))
            size += batch.num_rows
            if size >= 1 << 16:  # whole groups, and the last one waits for the rest of it
                whole = tuple(map(np.concatenate, zip(*held, strict=True)))
                cut = int(np.searchsorted(whole[0], whole[0][-1]))
                if cut:
                    yield out(*(x[:cut] for x in whole))
                held, size = [tuple(x[cut:] for x in whole)], len(whole[0]) - cut
        if size:
            yield out(*map(np.concatenate, zip(*held, strict=True)))

    chunks = F.ceil(F.col("c") / most).cast("int")
    own = F.pmod(F.xxhash64("node"), chunks).cast("int")
    places = F.when(F.col("node") == F.col("hub"), F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(own))
    rows = shared.select("g", "node", "n", "fp", (F.col("node") == F.col("hub")).alias("hub"), F.explode(places).alias("place"))
    rows = rows.select(F.xxhash64("g", "place").alias("k"), "node", "n", "fp", "hub")
    return rows.repartition("k").sortWithinPartitions("k").mapInArrow(lean(run), "u long, v long").distinct()


def _tasks(marks: DataFrame, most: int) -> DataFrame:
    """(g, node, label, k, side, two) of buckets that are of several labels yet: rows of one k are compared in one task.

    A bucket of up to `most` nodes is one task. In a larger one the nodes of its most frequent label, which need no comparison with each other,
    and the others are cut into chunks by hash; each chunk of the one meets each of the others, and those meet each other.
    `two` tells that the sides 0 and 1 are compared with each other only.
    """
    kinds = marks.groupBy("g", "label").agg(F.count("*").alias("c"))
    open_ = kinds.groupBy("g").agg(F.sum("c").alias("all"), F.max(F.struct("c", "label")).alias("main"), F.count("*").alias("labels")).filter("labels > 1")
    open_ = open_.select("g", F.xxhash64("g").alias("k"), "all", F.col("main.label").alias("main"), F.col("main.c").alias("c"))
    rows = marks.withColumn("k", F.xxhash64("g")).join(open_, ["g", "k"]).drop("k")
    chunks = lambda n: F.ceil(n / most).cast("int")
    a, b = chunks(F.col("c")), chunks(F.col("all") - F.col("c"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("label") == F.col("main"), a).otherwise(b)).cast("int")
    place = lambda kind, i, j, side, two: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"), two.alias("two"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    rows = rows.withColumn("own", own)
    main = each(b, lambda j: place(1, F.col("own"), j, zero, yes))
    others = F.concat(each(a, lambda i: place(1, i, F.col("own"), F.lit(1), yes)), each(b, lambda o: place(2, F.least("own", o), F.greatest("own", o), F.col("own") > o, F.col("own") != o)))
    places = F.when(F.col("all") <= most, F.array(place(0, zero, zero, zero, no))).when(F.col("label") == F.col("main"), main).otherwise(others)
    rows = rows.select("g", "node", "label", F.explode(places).alias("p"))
    return rows.select("g", "node", "label", F.xxhash64("g", "p.kind", "p.i", "p.j").alias("k"), "p.side", "p.two")


def crossing(k: np.ndarray, g: np.ndarray, node: np.ndarray, label: np.ndarray, bands: np.ndarray, items: list[np.ndarray], side: np.ndarray, two: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the components of each task's rows as all pairs of one component with another would.

    Rows are sorted by k, the task, of which g is the bucket. The trie self-join finds the pairs, of two subtrees where `two` holds. A pair counts
    in the first bucket it meets in; one that other links have joined is left out.
    """
    found = []
    mark, fp = label.copy(), simhashes(items)
    n = np.array([len(x) for x in items])
    starts, sizes = _runs(k)
    run = np.repeat(np.arange(len(starts)), sizes)
    place = (bands == g[:, None]).argmax(1)
    side = np.where(two, side, 0)
    few = sizes <= FEW
    walks = [np.flatnonzero(few[run])] + [np.arange(a, a + m) for a, m in zip(starts[~few].tolist(), sizes[~few].tolist(), strict=True)]
    for rows in walks:
        if not len(rows):
            continue
        rows = rows[np.lexsort((fp[rows], side[rows], run[rows]))]
        for left, right in near_pairs(run[rows], fp[rows], BUDGET, side[rows], two[rows]):
            for a in range(0, len(left), AT_ONCE):
                i, j = rows[left[a : a + AT_ONCE]], rows[right[a : a + AT_ONCE]]
                keep = (mark[i] != mark[j]) & _fits(n[i], n[j])
                i, j = i[keep], j[keep]
                new = ~((bands[i] == bands[j]) & (np.arange(BANDS) < place[i][:, None])).any(1)
                for x, y in zip(i[new].tolist(), j[new].tolist(), strict=True):
                    if mark[x] != mark[y] and similar(items[x], items[y]):
                        found.append((int(node[x]), int(node[y])))
                        own = mark[starts[run[x]] : starts[run[x]] + sizes[run[x]]]
                        own[own == mark[y]] = mark[x]
    return found


def _crossing_links(rows: DataFrame) -> DataFrame:
    """Links (u, v) of rows (k, g, node, label, bands, items, side, two) between the components of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            k, g, node, label, side = (np.concatenate([x.column(c).to_numpy() for x in rows]) for c in ("k", "g", "node", "label", "side"))
            two = np.concatenate([x.column("two").to_numpy(zero_copy_only=False) for x in rows])
            bands = np.concatenate([x.column("bands").flatten().to_numpy() for x in rows]).reshape(-1, BANDS)
            items = [np.frombuffer(y.as_buffer(), np.uint64) for x in rows for y in x.column("items")]  # not copied
            found = np.array(crossing(k, g, node, label, bands, items, side, two), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            # whole tasks at a time: the last one of the batch waits for the rest of it
            if not batch.num_rows:
                continue
            k = batch.column("k").to_numpy()
            last = int(np.searchsorted(k, k[-1]))
            if last or (held and held[-1].column("k")[-1].as_py() != k[0]):
                if held and held[-1].column("k")[-1].as_py() != k[0]:
                    yield out(held)
                    held = []
                if last:
                    yield out([*held, batch.slice(0, last)])
                    held = []
                batch = batch.slice(last)
            held.append(batch)
        if held:
            yield out(held)

    return rows.select("k", "g", "node", "label", "bands", "items", "side", "two").repartition("k").sortWithinPartitions("k").mapInArrow(lean(run), "u long, v long")


def labelled(rows: DataFrame, scratch: Scratch, most: int = MOST) -> DataFrame:
    """(doc_id, th, label) of rows (doc_id, th, text): equal labels are linked directly or through others. Texts without a word are one group."""
    marked = scratch.table(_marks(rows))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "th")).alias("r")
    nodes = scratch.table(marked.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), least))
    shared = scratch.table(_shared(nodes))
    pairs = scratch.table(_everywhere(nodes, scratch).unionByName(_looked_at(shared, most)).distinct())
    seen = shared.select("node").unionByName(pairs.select(F.col("u").alias("node"))).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    asked = nodes.join(seen, "node", "left_semi").select("node", F.col("r.doc_id").alias("_id"), F.col("r.th").alias("_th"))
    sets = scratch.table(_sets(rows.join(asked, rows["doc_id"].eqNullSafe(asked["_id"]) & (rows["th"] == asked["_th"])).select("node", "text").dropDuplicates(["node"])))
    links = scratch.table(_verified(pairs, sets))
    joined = scratch.table(components(links, scratch))
    marks = scratch.table(shared.select("g", "node").join(joined, "node", "left").select("g", "node", F.coalesce("component", "node").alias("label")))
    rest = _tasks(marks, most)
    more = scratch.table(_crossing_links(rest.join(nodes.select("node", "bands"), "node").join(sets, "node")))
    joined = scratch.table(components(links.unionByName(more), scratch))
    out = scratch.table(marked.join(joined, "node", "left").select("doc_id", "th", F.coalesce("component", "node").alias("label")))
    for t in (marked, nodes, shared, pairs, marks, sets, links, more, joined):
        scratch.drop(t)
    return out


def keep_first(docs: DataFrame, rows: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """docs with one row of each label of rows (doc_id, th, label): the one of the smallest id, one without an id only where all are;
    of rows that share that id, the one of the smallest hash of the text."""
    key, th = F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.col(f"`{text_col}`"))
    own, text, place = (unused(docs, f"_{x}") for x in ("id", "th", "place"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "th")).alias("r")
    kept = scratch.table(rows.groupBy("label").agg(least).select(F.col("r.doc_id").alias(own), F.col("r.th").alias(text)))
    twice = rows.groupBy("doc_id", "th").count().filter("count > 1").select("doc_id", "th")
    twice = scratch.table(twice.join(kept, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col("th") == F.col(text)), "left_semi").select(F.col("doc_id").alias(own), F.col("th").alias(text)))
    on = lambda table: key.eqNullSafe(table[own]) & (th == table[text])
    out = docs.join(kept, on(kept), "left_semi")
    if twice.isEmpty():
        return out
    # the same id and text again: any of them
    several = out.join(twice, on(twice), "left_semi").withColumn(place, F.row_number().over(Window.partitionBy(key, th).orderBy(F.lit(0)))).filter(F.col(place) == 1).drop(place)
    return out.join(twice, on(twice), "left_anti").unionByName(several)
