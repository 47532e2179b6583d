"""SimHash near-duplicates by a binary trie self-join.

A document's fingerprint is the bitwise majority over the XXH64 hashes of its
word shingles. Distinct fingerprints stand in a binary trie; pairs of trie nodes
are traversed together from the root, the bits in which the two paths differ are
added up, and a pair of subtrees is left as soon as that sum exceeds the budget.

The trie is spread over tasks by the pigeonhole rule: of b blocks of bits, two
fingerprints that differ in at most d bits agree on some b - d. For each choice
of b - d blocks one task holds the subtree of all fingerprints that agree there
and walks it. A subtree with more than `most` fingerprints is handed on as the
pairs of its subtrees eight bits further down that are still within the budget,
each pair to a task of its own, until all are small: nothing is dropped.

A few bits hold copies that are all but equal. `deduplicate` is for near copies at a
similarity of their shingle sets, for which the trie self-join runs inside smaller
groups and exact sets decide (`_near`).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _near
from ._graph import components
from ._trie import BITS, walk
from ._work import Scratch, lean, narrow, slices, utf8

SEED = 42
_LOWER_AND_BLANKS = bytes(0x20 if 0x09 <= b <= 0x0D else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(text: bytes, width: int) -> int:
    """The fingerprint of UTF-8 bytes; zero if they hold no word."""
    words = text.translate(_LOWER_AND_BLANKS).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.fromiter(map(len, words), np.int64, len(words))
    ends = (ends + 1).cumsum() - 1
    starts = np.concatenate([[0], ends[:-width] + 1]).tolist()
    pieces = [joined[a:b] for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(pieces)).astype(">u8")
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashed), 1 << 14):
        part = hashed[k : k + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8)).reshape(len(part), BITS).sum(0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * ones > len(hashed)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, th: a hash of the text, fp: the 64 bits as a signed long) of every document; null and blank texts have fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            data, at = data.tobytes(), offsets.tolist()
            fps = np.fromiter((fingerprint(data[a:b], width) for a, b in zip(at, at[1:], strict=False)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(fps.view(np.int64))], names=["doc_id", "th", "fp"])

    rows = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(lean(run), "doc_id long, th long, fp long")


def _blocks(n: int, budget: int) -> int:
    """Blocks of bits so that a subtree below the agreeing ones holds few of n fingerprints."""
    for b in range(budget + 1, budget + 4):
        if n >> (BITS * (b - budget) // b) <= 8:
            return b
    return budget + 3


def links(fps: DataFrame, budget: int, scratch: Scratch, most: int = 4096) -> DataFrame:
    """Edges (u, v) of reps that join exactly the fingerprints within the budget, directly or through others.

    fps: (fp distinct, rep). Each task emits a spanning forest of the links it finds, not all of them.
    """
    n = fps.count()
    b = _blocks(n, budget)
    edge = [BITS * i // b for i in range(b + 1)]
    block = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(b)]
    masks = [sum(block[i] for i in keep) for keep in combinations(range(b), b - budget)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tables = F.explode(F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(signed)]))
    rows = fps.select("fp", "rep", tables.alias("g"), F.lit(0).alias("side"), F.lit(False).alias("two"), F.lit(0).alias("d"))
    sized = lambda r: r.groupBy("g").count().filter(F.col("count") > most).select("g")
    flips = F.array(*[F.lit(x) for x in range(256) if x.bit_count() <= budget])
    done = None
    for level in range(BITS // 8):
        hot = scratch.table(sized(rows))
        if hot.isEmpty():
            break
        cool = rows.join(hot, "g", "left_anti")
        done = cool if done is None else done.unionByName(cool)
        p = F.shiftrightunsigned("fp", BITS - 8 * (level + 1)).bitwiseAND(F.lit(255)).cast("int")
        large = scratch.table(rows.join(hot, "g", "left_semi").withColumn("p", p))
        # the subtrees that are there, and the pairs of them within what is left of the budget
        nodes = large.select("g", "two", "d", "side", "p").distinct()
        ask = nodes.filter("side = 0").select("g", "two", "d", "p", F.explode(flips).alias("x")).withColumn("e", F.col("d") + F.bit_count("x")).filter(F.col("e") <= budget)
        ask = ask.select("g", "two", "p", F.col("p").bitwiseXOR(F.col("x")).alias("q"), "e", F.col("two").cast("int").alias("other"))
        pairs = ask.join(nodes.select("g", F.col("p").alias("q"), F.col("side").alias("other")), ["g", "q", "other"]).filter("two OR p <= q")
        pairs = scratch.table(pairs.select("g", "p", "q", "other", F.xxhash64("g", "p", "q").alias("h"), (F.col("two") | (F.col("p") < F.col("q"))).alias("cross"), "e"))
        one = large.filter("side = 0").join(pairs, ["g", "p"]).select("fp", "rep", F.col("h").alias("g"), F.lit(0).alias("side"), F.col("cross").alias("two"), F.col("e").alias("d"))
        ends = pairs.filter("cross").select("g", F.col("q").alias("p"), F.col("other").alias("side"), "h", "e")
        other = large.select("g", "p", "side", "fp", "rep").join(ends, ["g", "p", "side"]).select("fp", "rep", F.col("h").alias("g"), F.lit(1).alias("side"), F.lit(True).alias("two"), F.col("e").alias("d"))
        rows = scratch.table(one.unionByName(other))
    rows = (rows if done is None else done.unionByName(rows)).select("g", "side", "two", "fp", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(g, side, two, fp, rep):
            order = np.lexsort((fp, side, g))
            g, side, two, fp, rep = (x[order] for x in (g, side, two, fp, rep))
            i, j = walk(g, fp, budget, side, two)
            return pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[j])], names=["u", "v"])

        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            two = batch.column("two").to_numpy(zero_copy_only=False).astype(bool)
            held.append((batch.column("g").to_numpy(), batch.column("side").to_numpy(), two, batch.column("fp").to_numpy().view(np.uint64), batch.column("rep").to_numpy()))
            size += batch.num_rows
            if size >= 1 << 16:  # whole groups, and the last one waits for the rest of it
                whole = tuple(map(np.concatenate, zip(*held, strict=True)))
                cut = int(np.searchsorted(whole[0], whole[0][-1]))
                if cut:
                    yield out(*(x[:cut] for x in whole))
                held, size = [tuple(x[cut:] for x in whole)], len(whole[0]) - cut
        if size:
            yield out(*map(np.concatenate, zip(*held, strict=True)))

    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(lean(run), "u long, v long")


def simhash_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every document.

    component_id is the smallest doc_id reachable over links of at most `budget` differing bits.
    Null and blank texts have fingerprint 0 and link like any other. A text of fewer than `width`
    words is one shingle, a text of any length counts whole. Repeated rows stay, each with its result; a bit that is
    set in just half the hashes is 0. A row whose doc_id is null keeps its row and gets the component of its fingerprint
    among rows with an id (else null). An empty table gives an empty one; other columns do not matter, whatever their names.
    """
    scratch = Scratch(spark, "simhash")
    marked = scratch.table(fingerprints(docs, id_col, text_col, width))
    fps = scratch.table(marked.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links(fps, budget, scratch), scratch).withColumnRenamed("node", "rep")
    named = scratch.table(fps.join(found, "rep", "left").select(F.col("fp").alias("fp"), F.coalesce("component", "rep").alias("component_id")))
    return marked.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def deduplicate(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float | None = 0.8, budget: int = 3) -> DataFrame:
    """docs with one row of each group of near copies, linked directly or through others.

    Near copies are texts whose sets of five-word shingles (A-Z lower-cased) have a Jaccard similarity of 0.8 or more, or
    with similarity None, texts whose fingerprints over `width` words differ in at most `budget` bits. The row of the smallest id
    stays, a row without an id only where the group has none; of rows that share that id, the one of the smallest hash of the
    text, and of equal rows any. Null, empty and blank texts are one group. A text of fewer than five words is one shingle; a text
    of any length is compared whole. Rows, not ids, go: another text of the same id is judged by itself. An empty table gives an empty
    one; other columns stay as they are, whatever their names.
    """
    scratch = Scratch(spark, "near-copies")
    if similarity is None:
        marked = scratch.table(fingerprints(docs, id_col, text_col, width))
        fps = scratch.table(marked.select("fp").distinct().withColumn("rep", F.monotonically_increasing_id()))
        found = components(links(fps, budget, scratch), scratch).withColumnRenamed("node", "rep")
        named = scratch.table(fps.join(found, "rep", "left").select("fp", F.coalesce("component", "rep").alias("label")))
        return _near.keep_first(docs, marked.join(named, "fp").select("doc_id", "th", "label"), scratch, id_col, text_col)
    if (similarity, width) != (_near.PART / _near.WHOLE, _near.WIDTH):
        raise ValueError("near copies are compared by five-word shingles at a similarity of 0.8")
    key, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    rows = docs.select(key.alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    return _near.keep_first(docs, _near.labelled(rows, scratch), scratch, id_col, text_col)
