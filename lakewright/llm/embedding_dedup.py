"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected onto random orthonormal directions, eight at a time,
scaled, and decoded to the nearest point of the E8 lattice; a table's cell is one
or more such points. Each vector stands in its own cell of every table and asks
in the cells next to it, those whose lattice points come next. Vectors that meet
in a cell are compared by cosine in double precision, a block of them at once.

Equal vectors of a label are one vector with a multiplicity, so a group of copies costs
as much as one of them. A pair may meet in several cells; it counts in the first of them
alone, which each task tells from the cells the two vectors carry. So a task emits a count
for each vector and a spanning forest of its links, never the pairs. Cells with more than
`most` vectors are cut into chunks, and each pair of chunks is a task's work of its own.

How fine the cells are follows the number of different vectors, as cells that hold ever more
of them would make the work grow with its square. The three settings are made to find the
same share of links: SETTINGS has the share measured for pairs at exactly the threshold,
those that are hardest to find; a test holds each to 0.985.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import components, forest
from ._work import Scratch, lean

#: Projected unit vectors are scaled by this before decoding; near pairs are then about half a cell apart.
SCALE = 4.0
#: For one, two and three lattice points a cell: tables, and the most different vectors it is used for. A cell of more
#: points is shared more rarely, so it takes more tables. Measured share of random pairs at cosine 0.93 in 64 dimensions
#: that meet (`python -m lakewright.llm.embedding_dedup` prints it): 0.998, 0.996, 0.997.
SETTINGS = ((6, 1 << 21), (18, 1 << 30), (54, None))
#: Neighbouring cells asked in each table.
PROBES = 1
SEED = 20240229


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: where the neighbouring cells lie."""
    whole = []
    for (i, j), (a, b) in product(combinations(range(8), 2), product((1.0, -1.0), repeat=2)):
        v = np.zeros(8)
        v[i], v[j] = a, b
        whole.append(v)
    halves = [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + halves)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: rounds, and where the sum is odd rounds the worst coordinate the other way."""
    near = np.rint(x)
    rest = x - near
    odd = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(rest[odd]).argmax(1)
    near[odd, worst] += np.where(rest[odd, worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points: of the even integer points and their shift by one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _hash(points: np.ndarray, seed: int) -> np.ndarray:
    """64 bits of each row of integers."""
    h = np.full(len(points), seed * 0x9E3779B97F4A7C15 + 1 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for column in points.T:
        h = (h ^ column.astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return h


def cells(unit: np.ndarray, labels: np.ndarray, blocks: int, tables: int, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
    """(own cell of each vector and table, the cells asked besides: vectors x tables x probes), as 64-bit hashes with the label."""
    n, d = unit.shape
    own, asked = np.zeros((n, tables), np.uint64), np.zeros((n, tables, probes), np.uint64)
    shortest = roots()
    for t in range(tables):
        rng = np.random.default_rng([SEED, t, d])
        points, nexts, gains = [], [], []
        for _ in range(blocks):
            axes = np.linalg.qr(rng.normal(size=(max(d, 8), 8)))[0][:d]
            x = unit @ axes * SCALE + rng.random(8)
            p = decode(x)
            closer = (x - p) @ shortest.T  # the larger, the nearer that neighbour
            top = np.argsort(-closer, axis=1, kind="stable")[:, :probes]
            points.append(p)
            nexts.append(p[:, None, :] + shortest[top])
            gains.append(np.take_along_axis(closer, top, 1))
        keyed = lambda parts: _hash(np.concatenate([labels[:, None], np.rint(2 * np.concatenate(parts, 1)).astype(np.int64)], 1), t * 64 + d)
        own[:, t] = keyed(points)
        gain = np.concatenate(gains, 1)  # the nearest neighbours over all blocks; one block moves at a time
        best = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
        for k in range(probes):
            block, which = best[:, k] // probes, best[:, k] % probes
            moved = [np.where((block == b)[:, None], nexts[b][np.arange(n), which], points[b]) for b in range(blocks)]
            asked[:, t, k] = keyed(moved)
    return own, asked


def _first(own_a, asked_a, own_b, asked_b) -> tuple[np.ndarray, np.ndarray]:
    """(table, cell) in which each pair meets first; pairs are rows."""
    none = np.uint64(1 << 32)  # cells are told apart by 32 bits here
    table, cell = np.full(len(own_a), -1), np.full(len(own_a), none)
    for t in range(own_a.shape[1]):
        left = np.flatnonzero(table < 0)
        if not len(left):
            break
        a, b = own_a[left, t], own_b[left, t]
        met = np.where(a == b, a, none)
        met = np.minimum(met, np.where((asked_b[left, t] == a[:, None]).any(1), a, none))
        met = np.minimum(met, np.where((asked_a[left, t] == b[:, None]).any(1), b, none))
        hit = met != none
        table[left[hit]], cell[left[hit]] = t, met[hit]
    return table, cell


def _links(x, owner, table, cell, own, asked, one: bool, chunk, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a cell's vectors with cosine >= threshold that meet here first. chunk tells the two sides of a pair of chunks."""
    found_i, found_j = [], []
    n = len(x)
    for a in range(0, n, 1024):
        cos = x[a : a + 1024] @ x[a:].T
        i, j = np.nonzero(cos >= threshold)
        i, j = i + a, j + a
        keep = (i < j) & (owner[i] | owner[j]) & (one | (chunk[i] != chunk[j]))
        i, j = i[keep], j[keep]
        for k in range(0, len(i), 1 << 16):
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            t, c = _first(own[p], asked[p], own[q], asked[q])
            here = (t == table) & (c == cell)
            found_i.append(p[here])
            found_j.append(q[here])
    if not found_i:
        z = np.zeros(0, np.int64)
        return z, z
    return np.concatenate(found_i), np.concatenate(found_j)


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    x = v.astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]  # so that no square over- or underflows
    return x / np.sqrt((x * x).sum(1))[:, None]


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def recall(blocks: int, cosine: float = 0.93, d: int = 64, pairs: int = 4000, seed: int = 1) -> float:
    """The share of random pairs at this cosine that meet in a cell."""
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(2, pairs, d))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    none = np.zeros(pairs, np.int64)
    (own_a, asked_a), (own_b, asked_b) = (cells(x, none, blocks, SETTINGS[blocks - 1][0]) for x in (a, cosine * a + np.sqrt(1 - cosine**2) * b))
    return float(((own_a == own_b) | (asked_a == own_b[:, :, None]).any(2) | (asked_b == own_a[:, :, None]).any(2)).any(1).mean())


def embedding_dedup(
    spark: SparkSession, vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", most: int = 4096, blocks: int | None = None
) -> DataFrame:
    """(vec_id, n_links, component_id, kept, tables) of every row.

    Links are the pairs found of equal non-null label and equal length with cosine >= threshold. Vectors that are null,
    empty or zero, or hold a null or non-finite component, and rows with a null id or label, link with nothing; they are kept.
    component_id is the smallest vec_id reachable over links. Repeated rows, of the same id or not, are vectors of their own:
    equal ones link with each other, and share a component. tables tells which of SETTINGS was used; blocks chooses one.
    Equal cosines need no order, as a link has none. Other columns do not matter, whatever their names; an empty table gives an empty one.
    """
    scratch = Scratch(spark, "embedding")
    floats = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind, numbers = ("array<float>", np.float32) if floats else ("array<double>", np.float64)
    v = F.col(f"`{vector_col}`").cast(kind)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), v.alias("v"))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    ok = ok & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    # equal vectors of a label share 128 bits of hash
    rows = rows.withColumns({"ok": F.coalesce(ok, F.lit(False)), "k1": F.xxhash64("label", "v"), "k2": F.xxhash64(F.lit(1), "v", "label")})
    same = rows.filter("ok").groupBy("k1", "k2").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.min("vec_id").alias("least"), F.count("*").alias("m"))
    reps = scratch.table(same.withColumn("uid", F.monotonically_increasing_id()))
    if blocks is None:
        n = reps.count()
        blocks = next(i for i, (_, upto) in enumerate(SETTINGS, 1) if upto is None or n <= upto)
    tables = SETTINGS[blocks - 1][0]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pa.compute.list_value_length(batch.column("v")).to_numpy()
            for d in np.unique(size):
                part = batch.filter(pa.array(size == d))
                v = _matrix(part.column("v"), numbers)
                own, asked = cells(_unit(v), part.column("label").to_numpy(), blocks, tables)
                lists = lambda a: pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.size // len(a), dtype=np.int32), a.reshape(-1).copy())
                short = lambda a: lists((a & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))
                asked = asked.reshape(len(v), -1)
                cols = [part.column("uid"), part.column("m"), lists(v), lists(np.concatenate([own, asked], 1).view(np.int64)), short(own), short(asked)]
                yield pa.RecordBatch.from_arrays(cols, names=["uid", "m", "v", "cells", "own", "asked"])

    named = reps.select("uid", "m", F.xxhash64("label").alias("label"), "v")
    placed = scratch.table(named.mapInArrow(lean(assign), f"uid long, m long, v {kind}, cells array<long>, own array<int>, asked array<int>"))
    # the first `tables` cells are a vector's own, the others those it asks in
    place = F.posexplode("cells").alias("i", "cell")
    table = F.when(F.col("i") < tables, F.col("i")).otherwise(F.floor((F.col("i") - tables) / PROBES)).cast("int").alias("table")
    owner = (F.col("i") < tables).alias("owner")
    sized = placed.select(place).select("cell", table, owner).groupBy("cell", "table").agg(F.count("*").alias("n"), F.max("owner").alias("owned"))
    crowded = scratch.table(sized.filter((F.col("n") > most) & F.col("owned")).select("cell", "table", F.ceil(F.col("n") / (most // 2)).cast("int").alias("chunks")))
    carried = ["uid", "m", "v", "own", "asked"]
    spread = placed.select(*carried, place).select(*carried, "cell", table, owner)
    if crowded.isEmpty():
        spread = spread.withColumns({"chunk": F.lit(0), "i": F.lit(0), "j": F.lit(0)})
    else:
        spread = spread.join(crowded, ["cell", "table"], "left").withColumn("chunk", F.pmod(F.xxhash64("uid"), F.coalesce("chunks", F.lit(1))).cast("int"))
        others = F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)
        spread = spread.withColumn("o", F.explode(others)).withColumns({"i": F.least("chunk", "o"), "j": F.greatest("chunk", "o")}).drop("o", "chunks")
    key = ["cell", "table", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(t: pa.RecordBatch, a: int, b: int, out: list) -> None:
            part = t.slice(a, b - a)
            owner = part.column("owner").to_numpy(zero_copy_only=False).astype(bool)
            if not owner.any():
                return
            uid, m = part.column("uid").to_numpy(), part.column("m").to_numpy()
            own = _matrix(part.column("own"), np.int32).view(np.uint32).astype(np.uint64)
            asked = _matrix(part.column("asked"), np.int32).view(np.uint32).astype(np.uint64).reshape(len(own), own.shape[1], -1)
            one = part.column("i")[0].as_py() == part.column("j")[0].as_py()
            cell = np.uint64(part.column("cell")[0].as_py() & 0xFFFFFFFF)
            i, j = _links(_unit(_matrix(part.column("v"), numbers)), owner, part.column("table")[0].as_py(), cell, own, asked, one, part.column("chunk").to_numpy(), threshold)
            if len(i):
                count = np.zeros(len(uid), np.int64)
                np.add.at(count, i, m[j])
                np.add.at(count, j, m[i])
                at = np.flatnonzero(count)
                out.append((np.zeros(len(at), np.int32), uid[at], count[at]))
                u, w = forest(uid[i], uid[j])
                out.append((np.ones(len(u), np.int32), u, w))

        def run(held: list[pa.RecordBatch], final: bool) -> tuple[list, list[pa.RecordBatch]]:
            t = pa.concat_batches(held) if hasattr(pa, "concat_batches") else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            keys = np.stack([t.column(k).to_numpy().astype(np.int64) for k in key])
            new = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
            ends = np.append(new[1:], t.num_rows)
            last = len(new) if final else len(new) - 1
            out: list = []
            for a, b in zip(new[:last].tolist(), ends[:last].tolist(), strict=True):
                if b - a > 1:
                    group(t, a, b, out)
            rest = [] if final else [t.slice(int(new[-1]))]
            return out, rest

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 8192:
                out, held = run(held, False)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["kind", "a", "b"])
        if held:
            out, _ = run(held, True)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["kind", "a", "b"])

    found = scratch.table(spread.repartition(*key).sortWithinPartitions(*key).mapInArrow(lean(compare), "kind int, a long, b long"))
    scratch.drop(placed)
    counts = found.filter("kind = 0").groupBy(F.col("a").alias("uid")).agg(F.sum("b").alias("linked"))
    joined = components(found.filter("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")), scratch).withColumnRenamed("node", "uid")
    judged = reps.select("uid", "k1", "k2", "least", "m").join(counts, "uid", "left").join(joined, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    judged = scratch.table(judged)
    smallest = judged.groupBy("component").agg(F.min("least").alias("component_id"))
    links = (F.coalesce("linked", F.lit(0)) + F.col("m") - 1).alias("n_links")
    judged = judged.join(smallest, "component").select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), links, "component_id")
    out = rows.select("vec_id", "ok", "k1", "k2").join(judged, F.col("ok") & (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.lit(tables).alias("tables")
    )


if __name__ == "__main__":
    for number in (1, 2, 3):
        print(number, SETTINGS[number - 1][0], recall(number))
