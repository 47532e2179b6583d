"""Repair of conversation structure by a scan over min-plus matrices.

A legal conversation is an optional system turn followed by pairs of user and assistant, or nothing.
Four states say where one stands: at the start, behind a system turn, behind a user's and behind an
assistant's. Each turn becomes a 4 x 4 matrix of (cost, audit): the cheapest edits of that turn that
lead from state to state, with the closure of insertions behind it. Matrices multiply by (min, plus):
costs add up and audits are strung together, and of equal costs the audit that is least in ASCII wins.
Audits of equal cost over the same turns are never prefixes of one another (a further letter costs
something or takes a turn), so that choice survives multiplication and the product is associative.

So conversations of any length are reduced as trees: rows are dealt out by ranges of conversation and
turn, a task multiplies blocks of them, and blocks of a conversation that ranges have cut meet
in groups of a bounded size, level by level. Then each block gets its part of the audit and is written out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import Scratch, lean, narrow

#: Turns and bytes of text of a block, nodes that one step of the reduction multiplies, and turns whose product is kept.
BLOCK_TURNS = 2048
BLOCK_BYTES = 8 << 20
FAN = 16
KEPT_TURNS = 8
BLANKS = " \t\n\x0b\x0c\r"
#: Costs of edits, and of leaving a truncated turn in.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Role initials (others are o) and faults (fine, blank, duplicate, truncated); a turn's symbol is a letter for both.
INITIALS, FAULTS = "suao", "FBDT"
SYMBOLS = "abcdefghijklmnop"
#: The role that must come next in each state, and the state behind it.
NEXT = ("user", "user", "assistant", "user")
AFTER = (2, 2, 3, 2)
FINAL = (0, 3)
LEGAL = {"su", "ua", "au"}

Matrix = tuple  # of 16 (cost, audit) or None, row by row
NODE = "part long, symbols string, first long, last long, turns long, parts array<struct<part: long, n: long>>, costs array<long>, audits array<string>"
REPORT = ("gaps long", "blank long", "duplicate long", "truncated long", "illegal long", "cost long", "audit string")


def multiply(x: Matrix, y: Matrix) -> Matrix:
    out = []
    for i in range(0, 16, 4):
        for j in range(4):
            best = None
            for k in range(4):
                a, b = x[i + k], y[4 * k + j]
                if a is None or b is None:
                    continue
                cost = a[0] + b[0]
                if best is None or cost <= best[0]:
                    found = (cost, a[1] + b[1])
                    if best is None or found < best:
                        best = found
            out.append(best)
    return tuple(out)


def _closure() -> Matrix:
    """Any number of insertions: one leads to the next state, two to the one behind; more lead back at a price."""
    out: list = [(0, "") if i == j else None for i in range(4) for j in range(4)]
    for i in range(4):
        one = AFTER[i]
        out[4 * i + one] = (INSERT, "I")
        if AFTER[one] != i:
            out[4 * i + AFTER[one]] = (2 * INSERT, "II")
    return tuple(out)


CLOSURE = _closure()


def _behind(state: int, initial: str) -> int | None:
    """The state behind a turn that is kept, if it may stand here."""
    if initial == "s":
        return 1 if state == 0 else None
    return AFTER[state] if NEXT[state][0] == initial else None


def _turn(symbol: str) -> Matrix:
    number = SYMBOLS.index(symbol)
    initial, fault = INITIALS[number // 4], FAULTS[number % 4]
    out: list = [None] * 16
    for i in range(4):
        ways = [(i, (DELETE, "D"))]
        if fault not in "BD":
            left = TRUNCATED if fault == "T" else 0
            ways.append((AFTER[i], (REROLE + left, "R")))
            if (to := _behind(i, initial)) is not None:
                ways.append((to, (left, "K")))
        for to, way in ways:
            at = 4 * i + to
            out[at] = min(x for x in (out[at], way) if x)
    return multiply(tuple(out), CLOSURE)


@lru_cache(maxsize=20_000)
def _short(symbols: str) -> Matrix:
    if len(symbols) == 1:
        return _turn(symbols)
    half = len(symbols) // 2
    return multiply(_short(symbols[:half]), _short(symbols[half:]))


def product(symbols: str) -> Matrix:
    """The matrix of some turns, one or more, by halves."""
    if len(symbols) <= KEPT_TURNS:
        return _short(symbols)
    half = (len(symbols) // 2 + KEPT_TURNS - 1) // KEPT_TURNS * KEPT_TURNS
    return multiply(product(symbols[:half]), product(symbols[half:]))


def cheapest(matrix: Matrix) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    whole = multiply(CLOSURE, matrix)
    return min(whole[j] for j in FINAL if whole[j] is not None)


def _walk(state: int, audit: str, symbols: str, at: int = 0) -> Iterator[tuple[str, int, int]]:
    """(letter, number of its turn, state before it) of an audit; an insertion has the number of the turn that follows."""
    for letter in audit:
        yield letter, at, state
        if letter == "K" and INITIALS[SYMBOLS.index(symbols[at]) // 4] == "s":
            state = 1
        elif letter != "D":
            state = AFTER[state]
        at += letter != "I"


def _pack(matrix: Matrix) -> tuple[list[int], list[str]]:
    return [-1 if x is None else x[0] for x in matrix], ["" if x is None else x[1] for x in matrix]


def _unpack(costs: list[int], audits: list[str]) -> Matrix:
    return tuple(None if c < 0 else (c, a) for c, a in zip(costs, audits, strict=True))


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with faults by crc32 of `conv_id:turn`, modulo 20: 0 drops a row, 1 empties its text, 2 takes out its
    `[.!?]`, 3 repeats it, 4 makes it the user's. Nulls of role and text are one blank, and so are they in what is hashed."""
    named = narrow(rows, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    out = named.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    return out.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("copy", "kind")


def marked(rows: DataFrame) -> DataFrame:
    """The different rows (conv_id, turn, role, text) with how often each stands there, its symbol and that of its copies.

    Equal rows stand next to one another in their conversation, so they are counted before anything is ordered; a text was
    seen earlier if the first turn that holds it in this role is an earlier one.
    """
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = counted.groupBy(F.col("conv_id").alias("of"), F.col("role").alias("by"), F.col("text").alias("said")).agg(F.min(when).alias("first"))
    found = counted.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("role") == F.col("by")) & (F.col("text") == F.col("said")))
    said = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(said == "", 1).when(when > F.col("first"), 2).when(~F.right(said, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.instr(F.lit(INITIALS), F.left("role", F.lit(1))) - 1).otherwise(3)
    letter = lambda f: F.substring(F.lit(SYMBOLS), (4 * initial + f).cast("int") + 1, F.lit(1))
    again = F.when(said == "", 1).otherwise(2)
    return found.select("conv_id", "turn", "role", "text", "n", letter(fault).alias("symbol"), letter(again).alias("again"), F.xxhash64("role", "text").alias("tie"))


def blocks(found: DataFrame) -> DataFrame:
    """Consecutive turns of one conversation with their product: NODE, conv_id, and roles, texts and n of the different rows."""
    ordered = found.repartitionByRange("conv_id", "turn", "tie").sortWithinPartitions("conv_id", "turn", "tie", "role", "text")
    kind = found.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId() << 32, 0
        conv, held, size = None, [], 0
        types = None

        def out() -> pa.RecordBatch:
            symbols = "".join(r["symbol"] + r["again"] * (r["n"] - 1) for r in held)
            turns = [r["turn"] for r in held if r["turn"] is not None]
            costs, audits = _pack(product(symbols))
            row = {"conv_id": conv, "part": part + n, "symbols": symbols, "first": turns[0] if turns else None, "last": turns[-1] if turns else None, "turns": len(set(turns))}
            row |= {"parts": [{"part": part + n, "n": len(symbols)}], "costs": costs, "audits": audits}
            row |= {"roles": [r["role"] for r in held], "texts": [r["text"] for r in held], "n": [r["n"] for r in held]}
            return pa.RecordBatch.from_pylist([row], schema=types)

        for batch in batches:
            if types is None:
                node = [("part", pa.int64()), ("symbols", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("turns", pa.int64())]
                node += [("parts", pa.list_(pa.struct([("part", pa.int64()), ("n", pa.int64())]))), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
                types = pa.schema([("conv_id", batch.schema.field("conv_id").type), *node, ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))])
            for row in batch.to_pylist():
                if held and (row["conv_id"] != conv or len(held) >= BLOCK_TURNS or size >= BLOCK_BYTES):
                    yield out()
                    n, held, size = n + 1, [], 0
                conv = row["conv_id"]
                held.append(row)
                size += len(row["text"]) + len(row["role"])
        if held:
            yield out()

    return ordered.mapInArrow(lean(run), f"conv_id {kind}, {NODE}, roles array<string>, texts array<string>, n array<long>")


def _joined(nodes: list[dict]) -> dict:
    """One node of a conversation's neighbouring ones."""
    out = nodes[0]
    matrix = _unpack(out["costs"], out["audits"])
    symbols, parts = [out["symbols"]], list(out["parts"])
    for x in nodes[1:]:
        matrix = multiply(matrix, _unpack(x["costs"], x["audits"]))
        symbols.append(x["symbols"])
        parts += x["parts"]
        both = out["last"] is not None and out["last"] == x["first"]
        out |= {"first": x["first"] if out["first"] is None else out["first"], "last": out["last"] if x["last"] is None else x["last"], "turns": out["turns"] + x["turns"] - both}
    costs, audits = _pack(matrix)
    return out | {"symbols": "".join(symbols), "parts": parts, "costs": costs, "audits": audits}


def reduced(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """One node for each conversation. Those of one block pass; of the others at most FAN numbers of tasks meet in a step."""
    names = [f.split(" ")[0] for f in NODE.split(", ")][:5] + ["parts", "costs", "audits"]
    kind = nodes.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"conv_id": r["conv_id"], **_joined(r["nodes"]), "part": r["up"]} for r in batch.to_pylist()]
            inner = batch.schema.field("nodes").type.value_type
            types = pa.schema([("conv_id", batch.schema.field("conv_id").type), *((c, inner.field(c).type) for c in names)])
            yield pa.RecordBatch.from_pylist(rows, schema=types)

    done = []
    up = F.shiftright("part", 32)
    while True:
        counts = nodes.groupBy("conv_id").agg(F.count("*").alias("nodes"))
        several = scratch.table(counts.filter("nodes > 1").select(F.col("conv_id").alias("of")))
        if several.isEmpty():
            done.append(nodes)
            break
        same = F.col("conv_id").eqNullSafe(F.col("of"))
        done.append(nodes.join(several, same, "left_anti"))
        rest = nodes.join(several, same, "left_semi").withColumn("up", up)
        met = rest.groupBy("conv_id", "up").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("nodes"))
        nodes = scratch.table(met.mapInArrow(lean(run), f"conv_id {kind}, {NODE}"))
        up = F.floor(F.col("part") / FAN).cast("long")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def _slices(nodes: DataFrame) -> DataFrame:
    """For each block: the state it begins in, its part of the audit and whether it is the only one; the first has the report of the conversation."""
    kind = nodes.schema["conv_id"].dataType.simpleString()
    head = [("part", pa.int64()), ("state", pa.int32()), ("edits", pa.string()), ("alone", pa.bool_())]
    tail = [(c.split(" ")[0], pa.int64() if c.endswith("long") else pa.string()) for c in REPORT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                symbols, parts = r["symbols"], r["parts"]
                cost, audit = cheapest(_unpack(r["costs"], r["audits"]))
                numbers = [SYMBOLS.index(x) for x in symbols]
                initials = "".join(INITIALS[x // 4] for x in numbers)
                faults = [sum(x % 4 == f for x in numbers) for f in (1, 2, 3)]
                gaps = 0 if r["first"] is None else r["last"] - r["first"] + 1 - r["turns"]
                illegal = sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))
                values = dict(zip((c for c, _ in tail), (gaps, *faults, illegal, cost, audit), strict=True))
                if len(parts) == 1:
                    rows.append({"conv_id": r["conv_id"], "part": parts[0]["part"], "state": 0, "edits": audit, "alone": True, **values})
                    continue
                ends, total = [], 0
                for p in parts:
                    total += p["n"]
                    ends.append(total)
                cuts, states, b = [0], [0], 0
                for k, (letter, at, state) in enumerate(_walk(0, audit, symbols)):
                    while b < len(ends) - 1 and at >= ends[b]:  # insertions before a block's first turn are its own
                        cuts.append(k)
                        states.append(state)
                        b += 1
                cuts += [len(audit)] * (len(parts) + 1 - len(cuts))
                for b, p in enumerate(parts):
                    rows.append({"conv_id": r["conv_id"], "part": p["part"], "state": states[b], "edits": audit[cuts[b] : cuts[b + 1]], "alone": False, **(values if not b else dict.fromkeys(values))})
            types = pa.schema([("conv_id", batch.schema.field("conv_id").type), *head, *tail])
            yield pa.RecordBatch.from_pylist(rows, schema=types)

    return nodes.mapInArrow(lean(run), f"conv_id {kind}, part long, state int, edits string, alone boolean, {', '.join(REPORT)}")


def _lines(row: dict) -> Iterator[tuple[str, str]]:
    """(role, text) of a block's repaired turns."""
    own = [(role, text) for role, text, n in zip(row["roles"], row["texts"], row["n"], strict=True) for _ in range(n)]
    for letter, at, state in _walk(row["state"], row["edits"], row["symbols"]):
        if letter == "K":
            yield own[at]
        elif letter != "D":
            yield NEXT[state], own[at][1] if letter == "R" else ""


class Repair(NamedTuple):
    """report has a row for each conversation, turns one for each turn after repair, in the order of (part, number)."""

    report: DataFrame
    turns: DataFrame


def repair(
    spark: SparkSession, rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", ids: DataFrame | None = None
) -> Repair:
    """Repairs the conversations of `rows`.

    report: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), for the conversations of `ids` (its
    column conv_id), too, if they have no row: zeros, an empty audit and the hash of nothing. turns: (conv_id, part, number, role, text).

    Turns are taken by number, nulls first, and those of one number by a hash of role and text: equal rows are neighbours, and the
    result does not depend on the order of files. Nulls of role and text are one blank; rows without a conversation are one. Roles other than
    those that begin with s, u or a fit nowhere as they are. An empty table gives an empty report; other columns do not
    matter, whatever their names. The hash of a conversation that ranges have cut is taken over its blocks in order, as they stream
    through one task that holds one block; the reduction itself never holds more than FAN nodes.
    """
    scratch = Scratch(spark, "conversations")
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    named = narrow(rows, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    named = named.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    rows_ = scratch.table(marked(named))
    held = scratch.table(blocks(rows_))
    scratch.drop(rows_)
    kind = held.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "part", "symbols", "first", "last", "turns", "parts", "costs", "audits"]
    slices = _slices(reduced(held.select(*names), scratch))
    found = scratch.table(held.select("part", "symbols", "roles", "texts", "n").join(slices, "part"))
    scratch.drop(held)
    report = [c.split(" ")[0] for c in REPORT]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, pieces = [], []
            for row in batch.select(["symbols", "roles", "texts", "n", "state", "edits", "alone"]).to_pylist():
                piece = "\n".join(f"{role}:{text}" for role, text in _lines(row)).encode()
                shas.append(hashlib.sha256(piece).hexdigest() if row["alone"] else None)
                pieces.append(None if row["alone"] else piece)
            kept = ["conv_id", "part", "alone", *report]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(shas, pa.string()), pa.array(pieces, pa.binary())], names=[*kept, "repaired_sha256", "piece"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, first, lead, columns = None, None, True, None, None

        def out() -> pa.RecordBatch:
            row = lead | {"repaired_sha256": digest.hexdigest()}
            return pa.RecordBatch.from_pylist([row], schema=columns)

        for batch in batches:
            columns = pa.schema([batch.schema.field(c) for c in ["conv_id", *report, "repaired_sha256"]])
            for i, piece in enumerate(batch.column("piece")):
                own = batch.column("conv_id")[i].as_py()
                if lead is None or own != conv:
                    if lead is not None:
                        yield out()
                    conv, digest, first = own, hashlib.sha256(), True
                    lead = {c: batch.column(c)[i].as_py() for c in ["conv_id", *report]}
                piece = piece.as_py()
                if piece:
                    digest.update(piece if first else b"\n" + piece)
                    first = False
        if lead is not None:
            yield out()

    written = scratch.table(found.mapInArrow(lean(write), f"conv_id {kind}, part long, alone boolean, {', '.join(REPORT)}, repaired_sha256 string, piece binary"))
    whole = written.filter("alone").select("conv_id", *report, "repaired_sha256")
    cut = written.filter("NOT alone").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    out = whole.unionByName(cut.mapInArrow(lean(chain), f"conv_id {kind}, {', '.join(REPORT)}, repaired_sha256 string"))
    if ids is not None:
        every = narrow(ids, of="conv_id").distinct()
        out = every.join(out, F.col("of").eqNullSafe(F.col("conv_id")), "left")
        nothing = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
        out = out.select(F.col("of").alias("conv_id"), *[F.coalesce(c, F.lit(nothing.get(c, 0))).alias(c) for c in [*report, "repaired_sha256"]])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                turns = list(_lines(row))
                ids = batch.column("conv_id").take(pa.array([i] * len(turns), pa.int64()))
                rest = [pa.array([row["part"]] * len(turns), pa.int64()), pa.array(range(len(turns)), pa.int64()), *(pa.array([t[k] for t in turns], pa.string()) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays([ids, *rest], names=["conv_id", "part", "number", "role", "text"])

    return Repair(out, found.mapInArrow(lean(lines), f"conv_id {kind}, part long, number long, role string, text string"))
