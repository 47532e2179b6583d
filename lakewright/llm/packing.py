"""Mixture-controlled packing of documents into fixed-length token sequences.

Each source is a queue of its documents, in the order of a hash of id and tokens. A window is a round of
deficit round-robin: every queue gets its target share of the window's tokens as credit, sends whole
documents while the credit lasts, and carries what is left to the next window, across sequences and
partitions alike. Once a queue has credit for all it holds, its share goes to the others by their weights.

The schedule is a closed form, found by all tasks at once instead of by a loop over windows. While it has
tokens, a queue of weight w has got w * v tokens of credit at a common level v, so that all of them have
S(v) = sum of min(tokens, w * v) over the queues, and window k ends at the level where S(v) = k windows. The
document that ends at token e of its queue is covered at the level e / w, so it goes out in window
ceil(S(e / w) / window). Weights are a parameter, so S has a corner for each listed queue and one for all
others, which share what is left by their tokens and run dry together. The windows, laid one after another,
are cut every `length` tokens; only the last sequence of all is short.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._tokens import tokenizer
from ._work import Scratch, binary_array, few_a_task, lean, slices

#: Digits of 64 by which rows of a queue are added up: a row is in one of 64 ** 2 buckets of the hash.
DIGITS = 2


def tokenized(docs: DataFrame, path: str, end_id: int | None, keys: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """The key columns, n_tokens and ids (little-endian unsigned 32-bit) of each text; null texts are empty."""
    rows = docs.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text_col}`").alias("text"))
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode
        for batch in slices(batches, "text"):
            blobs = [encode(t or "") + tail for t in batch.column("text").to_pylist()]
            n = pa.array([len(b) // 4 for b in blobs], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), n, binary_array(blobs)], names=[*keys, "n_tokens", "ids"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(lean(run), f"{types}, n_tokens long, ids binary")


def _before(value: str, keys: list[str], *order: str) -> Column:
    """The sum of value over the rows before this one in its group."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _queue_ends(rows: DataFrame) -> DataFrame:
    """rows (uid, h, queue, n_tokens) with `ends`, the tokens of the queue up to and with the row.

    Sums by one digit of the hash after the other keep a large queue out of any one task: a window has 64 rows, or those of a bucket.
    """
    digits = [f"d{i}" for i in range(DIGITS)]
    rows = rows.withColumns({d: F.shiftrightunsigned("h", 58 - 6 * i).bitwiseAND(F.lit(63)).cast("int") for i, d in enumerate(digits)})
    sums, placed = rows, None
    for i in range(DIGITS, 0, -1):
        keys = ["queue", *digits[:i]]
        sums = sums.groupBy(*keys).agg(F.sum("n_tokens").alias("n_tokens"))
        here = sums.withColumn(f"from{i}", _before("n_tokens", keys[:-1], keys[-1])).drop("n_tokens")
        placed = here if placed is None else placed.join(here, keys)
    rows = rows.withColumn("row_from", _before("n_tokens", ["queue", *digits], "h", "uid")).join(placed, ["queue", *digits])
    return rows.select("uid", "queue", "n_tokens", (sum((F.col(f"from{i}") for i in range(1, DIGITS + 1)), F.col("row_from")) + F.col("n_tokens")).alias("ends"))


def _checked(weights: dict[str | None, float] | None) -> dict[str, float]:
    """Weights by queue: finite, none below zero, of a sum up to 1."""
    out = {"n" if name is None else f"s{name}": float(w) for name, w in (weights or {}).items()}
    if any(not math.isfinite(w) or w < 0 for w in out.values()) or sum(out.values()) > 1 + 1e-9:
        raise ValueError("weights must be finite, not negative, and of a sum up to 1")
    return out


def levels(tokens: dict[str, int], rest: int, weights: dict[str, float]) -> tuple[dict[str, tuple[int, int]], list[tuple[float, float, float]]]:
    """({queue: (phase, weight as a divisor of its ends)}, corners of S as (level, tokens by then, slope from there)).

    Levels of the second phase, that of queues with weight 0, begin where those of the first end.
    """
    share = max(0.0, 1 - sum(weights.values()))
    first = {q: (n, weights[q]) for q, n in tokens.items() if n and weights[q] > 0}
    second = {q: n for q, n in tokens.items() if n and weights[q] == 0}
    if rest and share > 1e-9:
        first[""] = (rest, share)
    elif rest:
        second[""] = rest
    corners, done, slope, at = [(0.0, 0.0, sum(w for _, w in first.values()))], 0.0, sum(w for _, w in first.values()), 0.0
    for level, w in sorted((n / w, w) for n, w in first.values()):
        done += slope * (level - at)
        slope, at = max(0.0, slope - w), level
        corners.append((at, done, slope))
    first_sum = sum(n for n, _ in first.values())
    corners[-1] = (at, float(first_sum), 1.0)  # then those without a weight, by their tokens: one token a level
    total = sum(second.values())
    divide = {q: (0.0, w) for q, (_, w) in first.items()} | {q: (at, n / total) for q, n in second.items()}
    return divide, corners


def schedule(rows: DataFrame, scratch: Scratch, window_tokens: int, weights: dict[str | None, float] | None = None) -> DataFrame:
    """(uid, window, at) of each row of (uid, h, queue, n_tokens >= 1): its window, and where it begins in the stream of all windows."""
    weights = _checked(weights)
    ends = _queue_ends(rows)
    if weights:
        named = F.when(F.col("queue").isin(*weights), F.col("queue")).otherwise("")
        tokens = {r[0]: r[1] for r in rows.groupBy(named.alias("queue")).agg(F.sum("n_tokens")).collect()}  # a row a listed weight
    else:
        tokens = {"": rows.agg(F.sum("n_tokens")).first()[0]}
    rest = tokens.pop("", 0) or 0
    divide, corners = levels(tokens, rest, weights)
    if rest:  # an unlisted queue's part of what the others leave is its part of their tokens: its level is that of its share of itself
        of_queue = rows.groupBy("queue").agg(F.sum("n_tokens").alias("of_queue"))
        ends = ends.join(of_queue, "queue")
        base, weight = divide[""]
        level = F.lit(base) + F.col("ends") / F.col("of_queue") * F.lit(rest / weight)
    else:
        level = F.lit(0.0)
    for queue, (base, weight) in divide.items():
        if queue:
            level = F.when(F.col("queue") == F.lit(queue), F.lit(base) + F.col("ends") / F.lit(weight)).otherwise(level)
    ends = ends.withColumn("level", level)
    covered = F.lit(0.0)
    for at, done, slope in corners:
        covered = F.when(F.col("level") >= F.lit(at), F.lit(done) + (F.col("level") - F.lit(at)) * F.lit(slope)).otherwise(covered)
    # a millionth of a token against rounding: a document that is covered exactly at a window's end belongs to it
    window = F.greatest(F.lit(1), F.ceil((covered - F.lit(1e-6)) / F.lit(float(window_tokens))).cast("long"))
    ends = scratch.table(ends.withColumn("window", window).select("uid", "queue", "n_tokens", "ends", "window"))
    cells = ends.groupBy("window", "queue").agg(F.sum("n_tokens").alias("n"), F.min(F.col("ends") - F.col("n_tokens")).alias("first")).withColumn("span", F.shiftright("window", 10))
    spans = cells.groupBy("span").agg(F.sum("n").alias("n"))  # one row for 1024 windows
    spans = spans.select("span", F.coalesce(F.sum("n").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("span_from"))
    sums = cells.groupBy("span", "window").agg(F.sum("n").alias("n")).withColumn("window_from", _before("n", ["span"], "window")).drop("n")
    cells = cells.withColumn("cell_from", _before("n", ["window"], "queue")).join(sums, ["span", "window"]).join(spans, "span")
    cells = cells.select("window", "queue", (F.col("span_from") + F.col("window_from") + F.col("cell_from") - F.col("first")).alias("shift"))
    return ends.join(cells, ["window", "queue"]).select("uid", "window", (F.col("shift") + F.col("ends") - F.col("n_tokens")).alias("at"))


def pack(
    spark: SparkSession,
    docs: DataFrame,
    path: str,
    length: int = 2048,
    end_id: int | None = 1,
    window_sequences: int = 64,
    weights: dict[str | None, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids): every token of every row in exactly one piece.

    ids are little-endian unsigned 32-bit. Each window of window_sequences * length tokens takes from each source its
    weight's share, to within one document; sources without a weight share what is left of 1 by their tokens (without
    any weights: each source takes its share of all tokens). Once a source has run dry, the others take its share by
    their weights; a source of weight 0, or one that is not listed where the weights listed make 1, goes out after
    all others. Weights that are negative, not finite or of a sum above 1 raise ValueError; None names null sources, which
    are a queue of their own. Sequences depend on the rows alone, not on how they are split over files.

    Null and empty texts have only the end token (with end_id None, no piece at all); a text of any length is cut
    over sequences. Repeated rows are packed as often as they occur; a null doc_id stays null. An empty table gives an
    empty one; other columns do not matter, whatever their names.
    """
    scratch = Scratch(spark, "packing")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit("n")).alias("queue"), F.col(f"`{text_col}`").alias("text"))
    coded = tokenized(rows, path, end_id, ("doc_id", "queue")).filter("n_tokens > 0").withColumn("uid", F.monotonically_increasing_id())
    # rows of the same hash have the same id and tokens, or next to never, so that their order makes no difference
    coded = scratch.table(coded.withColumn("h", F.xxhash64("doc_id", "ids")))
    at = schedule(coded.select("uid", "h", "queue", "n_tokens"), scratch, window_sequences * length, weights)
    placed = coded.select("uid", "doc_id", "ids").join(few_a_task(at.select("uid", "at"), coded.count()), "uid").select("doc_id", "at", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("ids").combine_chunks() if isinstance(batch.column("ids"), pa.ChunkedArray) else batch.column("ids")
            n = pa.compute.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64) // 4
            at = batch.column("at").to_numpy()
            first, last = at // length, (at + n - 1) // length
            pieces = last - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            seq = first[row] + np.arange(len(row)) - np.repeat(pieces.cumsum() - pieces, pieces)
            begin, end = np.maximum(at[row], seq * length), np.minimum((at + n)[row], (seq + 1) * length)
            start, size = begin - at[row], end - begin
            blobs = data.to_pylist()
            ids = [blobs[r][4 * a : 4 * (a + k)] for r, a, k in zip(row.tolist(), start.tolist(), size.tolist(), strict=True)]
            cols = [batch.column("doc_id").take(pa.array(row)), *map(pa.array, (start, size, n[row], seq, begin - seq * length)), binary_array(ids)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    kind = coded.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(lean(cut), f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
