"""Exact top-k search by exhaustive term-at-a-time accumulation.

The queries are cut into blocks of a bounded size; for each block there is one pass over the
candidates, which stay where they are. A task turns its candidates, a few thousand at a time, into
postings, one list for each dimension, and goes through the terms one after another: the weight a
query gives the term times the postings is scattered into the dense score rows of the queries. A
partition selection keeps k of each row, and what a task has kept so far bounds what comes next.
Tasks hand on at most k rows a query; those are merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._work import Scratch, lean

#: Candidates scored at once, queries scored at once, and bytes of a block of queries, which is all that is broadcast.
CANDIDATES = 4096
QUERIES = 512
BLOCK_BYTES = 16 << 20
_SAFE = 1 << 61
_LONG = (-(1 << 63), (1 << 63) - 1)
FOUND = "query long, query_id long, vec_id long, uid long, score long"


def select(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k highest scores of each row, ties to smaller columns; all of a row if it has fewer."""
    n = scores.shape[1]
    if n > k:
        least = np.partition(scores, n - k, axis=1)[:, n - k]
        row, column = np.nonzero(scores >= least[:, None])
    else:
        row, column = (x.ravel() for x in np.indices(scores.shape))
    return _best(row, scores[row, column], column, k)


def _best(row: np.ndarray, score: np.ndarray, column: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((column, ~score, row))  # ~ turns the order of all longs round
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _most(x: np.ndarray) -> int:
    return max(-int(x.min(initial=0)), int(x.max(initial=0)))


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products, queries x candidates, term at a time; exact in 64 bits, beyond that held at the ends of a long."""
    size = max(queries.shape[1], 1)
    wide = _most(queries) * _most(candidates) * size >= _SAFE
    kind = object if wide else np.int64
    scores = np.zeros((len(queries), len(candidates)), kind)
    for d in range(queries.shape[1]):
        posting = np.flatnonzero(candidates[:, d])
        asking = np.flatnonzero(queries[:, d])
        if len(posting) and len(asking):
            products = np.outer(queries[asking, d].astype(kind), candidates[posting, d].astype(kind))
            if len(posting) == len(candidates) and len(asking) == len(queries):
                scores += products
            else:
                scores[np.ix_(asking, posting)] += products
    return np.clip(scores, *_LONG).astype(np.int64) if wide else scores


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of whole numbers, shorter ones filled up with zeros."""
    size = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(size.max(initial=0))
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = min(a.shape[1], b.shape[1])
    return a[:, :width], b[:, :width]


class _Best:
    """What a task has kept for a block of queries: up to k (score, vec_id, uid) each, best first."""

    def __init__(self, uid: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.uid, self.ids, self.vectors, self.k = uid, ids, vectors, k
        z = np.zeros(0, np.int64)
        self.row, self.score, self.vec_id, self.at = z, z, z, z

    def add(self, vec_id: np.ndarray, uid: np.ndarray, vectors: np.ndarray) -> None:
        order = np.lexsort((uid, vec_id))
        vec_id, uid, vectors = vec_id[order], uid[order], vectors[order]
        rows, scores, ids, ats = [self.row], [self.score], [self.vec_id], [self.at]
        for a in range(0, len(self.uid), QUERIES):
            q, c = _same_width(self.vectors[a : a + QUERIES], vectors)
            score = accumulate(q, c)
            row, column = select(score, self.k + 1)  # one more: the query itself may be among them
            own = self.uid[a + row] == uid[column]
            row, column = row[~own], column[~own]
            rows.append(row + a)
            scores.append(score[row, column])
            ids.append(vec_id[column])
            ats.append(uid[column])
        row, score, vec_id, uid = (np.concatenate(x) for x in (rows, scores, ids, ats))
        order = np.lexsort((uid, vec_id, ~score, row))
        sorted_ = row[order]
        order = order[np.arange(len(row)) - np.searchsorted(sorted_, sorted_) < self.k]
        self.row, self.score, self.vec_id, self.at = (x[order] for x in (row, score, vec_id, uid))


def top_k(spark: SparkSession, vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score) for each row whose id is divisible by `every`, against all other rows.

    Components are floor(scale * x), x as double; those beyond the range of a long are held at its ends, and so are scores.
    Vectors that are null or hold a null or non-finite component take no part, nor do rows without an id.
    Vectors of different lengths are compared over the components both have. Rows of the same id are rows of their own:
    each is a candidate for the others, and of a repeated query id each row has its ranks. Ties go to the smaller id; fewer
    than k candidates give fewer rows. An empty table, or one without queries, gives an empty one; other columns do not matter.
    """
    scratch = Scratch(spark, "topk")
    x = F.col(f"`{vector_col}`")
    ok = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), whole.alias("v"), ok.alias("ok")).filter("vec_id IS NOT NULL AND ok").drop("ok")
    rows = scratch.table(rows.withColumn("uid", F.monotonically_increasing_id()))
    asked = rows.filter(F.col("vec_id") % every == 0)
    count, size = asked.agg(F.count("*"), F.sum(8 * F.size("v") + 64)).first()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # what a query takes on the driver: its vector and what is kept for it
    blocks = -(-(size + 32 * k * count) // block_bytes)
    found = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == b)
        table = part.select("uid", "vec_id", "v").toArrow().combine_chunks()
        if not table.num_rows:
            continue
        held = [pa.concat_arrays(table.column(c).chunks) for c in ("uid", "vec_id", "v")]
        shared = spark.sparkContext.broadcast((held[0].to_numpy(), held[1].to_numpy(), _matrix(held[2])))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = _Best(*shared.value, k)
            for batch in batches:
                for a in range(0, batch.num_rows, CANDIDATES):
                    piece = batch.slice(a, CANDIDATES)
                    best.add(piece.column("vec_id").to_numpy(), piece.column("uid").to_numpy(), _matrix(piece.column("v")))
            cols = [best.uid[best.row], best.ids[best.row], best.vec_id, best.at, best.score]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query", "query_id", "vec_id", "uid", "score"])

        passed = rows.mapInArrow(lean(run), FOUND)
        passed = passed if blocks == 1 else scratch.table(passed)
        found = passed if found is None else found.unionByName(passed)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
