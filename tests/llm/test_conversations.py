"""Conversation repair against a search over edits turn by turn, damage against plain loops."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import reduce
from itertools import product as every

import pyarrow.parquet as pq
import pytest
from lakewright.llm import conversation_repair as cr
from lakewright.llm.queries import QUERIES

BLANK = "[^\x20\x09-\x0d]"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
NOTHING = hashlib.sha256(b"").hexdigest()


def damaged(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if x is None else x for x in (conv, turn)]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(turns: list[tuple]) -> list[str]:
    seen, out = set(), []
    for _, role, text in turns:
        if not re.search(BLANK, text):
            out.append("B")
        elif (role, text) in seen:
            out.append("D")
        else:
            out.append("F" if re.findall(BLANK, text)[-1] in ".!?" else "T")
        seen.add((role, text))
    return out


def solve(turns: list[tuple]) -> tuple[int, str, list[tuple]]:
    """Dijkstra without a queue: the best (cost, audit, turns) of each state after each turn, insertions tried until nothing is gained."""
    def relax(best):
        while True:
            new = dict(best)
            for state, (cost, audit, out) in best.items():
                role = "assistant" if state == "u" else "user"
                way = (cost + 5, audit + "I", [*out, (role, "")])
                if role[0] not in new or way[:2] < new[role[0]][:2]:
                    new[role[0]] = way
            if new == best:
                return best
            best = new

    best = relax({"": (0, "", [])})
    for (_, role, text), fault in zip(turns, faults(turns), strict=True):
        new = {}
        for state, (cost, audit, out) in best.items():
            ways = [(state, cost + 2, audit + "D", out)]
            if fault not in "BD":
                more = 5 * (fault == "T")
                want = "assistant" if state == "u" else "user"
                ways.append((want[0], cost + 1 + more, audit + "R", [*out, (want, text)]))
                if role[:1] == want[0] or (state == "" and role[:1] == "s"):
                    ways.append((role[0], cost + more, audit + "K", [*out, (role, text)]))
            for to, c, a, o in ways:
                if to not in new or (c, a) < new[to][:2]:
                    new[to] = (c, a, o)
        best = relax(new)
    return min(x for s, x in best.items() if s in ("", "a"))


def brute(rows: list[tuple], tie) -> list[tuple]:
    of = defaultdict(list)
    for conv, turn, role, text in damaged(rows):
        of[conv].append((turn, role, text))
    out = []
    for conv in {r[0] for r in rows}:
        turns = sorted(of[conv], key=lambda t: (t[0] is not None, t[0] or 0, tie(t)))
        known = [t[0] for t in turns if t[0] is not None]
        found = faults(turns)
        initials = [t[1][:1] for t in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, repaired = solve(turns)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, *(found.count(f) for f in "BDT"), illegal, cost, audit, sha))
    return sorted(out, key=repr)


def result(df) -> list[tuple]:
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def ties(spark, rows):
    """The order of turns of one number, which is any fixed one."""
    texts = sorted({(r, t) for _, _, r, t in damaged(rows)})
    hashed = spark.createDataFrame(texts, "role string, text string").selectExpr("role", "text", "xxhash64(role, text) AS h").collect() if texts else []
    order = {(r.role, r.text): (r.h, r.role, r.text) for r in hashed}
    return lambda t: order[t[1:]]


def run(spark, rows, schema="conv_id long, turn long, role string, text string"):
    df = spark.createDataFrame(rows, schema)
    return cr.repair(spark, cr.damage(df), ids=df)


def drawn(seed: int, convs: int, turns: int) -> list[tuple]:
    draw = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "Sys", "unknown"], ["one.", "two!", "cut", " \t\x0b", "", None, "three? ", "four.\n"]
    weigh = [6, 6, 2, 1, 1, 1, 1, 1]
    return [(c, draw.choice([t, t, t, t // 2, None]), draw.choices(roles, weigh)[0], draw.choice([*texts, f"say {t}.", f"and {t}"])) for c in range(convs) for t in range(draw.randint(1, turns))]


@pytest.mark.parametrize("sizes", [(2048, 16), (3, 2)])
def test_random_conversations(spark, monkeypatch, sizes):
    monkeypatch.setattr(cr, "BLOCK_TURNS", sizes[0])
    monkeypatch.setattr(cr, "FAN", sizes[1])
    rows = drawn(3, 120, 12) + [(None, t, "user" if t % 2 else "assistant", f"none {t}") for t in range(9)] + [(7, 1, "user", "same.")] * 5
    assert result(run(spark, rows).report) == brute(rows, ties(spark, rows))


def test_one_long_conversation(spark, monkeypatch):
    """A conversation that is cut over tasks and over several levels of the reduction, and a crowd of equal rows."""
    monkeypatch.setattr(cr, "BLOCK_TURNS", 16)
    monkeypatch.setattr(cr, "FAN", 2)
    rows = [(5, t, r, x) for _, t, r, x in drawn(11, 1, 3000)] + [(5, 40, "user", "again.")] * 300 + [(6, 0, "user", "hi."), (6, 1, "assistant", "ho.")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = run(spark, rows)
        assert result(found.report) == brute(rows, ties(spark, rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    turns = [(r.role, r.text) for r in found.turns.filter("conv_id = 5").orderBy("part", "number").collect()]
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
    assert sha == found.report.filter("conv_id = 5").first().repaired_sha256
    parts = found.turns.filter("conv_id = 5").select("part").distinct().collect()
    assert len({p.part >> 32 for p in parts}) > 1


def test_product_is_associative():
    draw = random.Random(9)
    for _ in range(300):
        symbols = "".join(draw.choices(cr.SYMBOLS, k=draw.randint(1, 14)))
        assert cr.product(symbols) == reduce(cr.multiply, map(cr._turn, symbols))


def test_short_sequences():
    """All sequences of three turns of all kinds against the search."""
    text = {"F": "{}.", "B": " ", "T": "{}"}
    for kinds in every([(r, f) for r in ("system", "user", "assistant", "x") for f in "FBT"], repeat=3):
        turns = [(i, r, text[f].format(i)) for i, (r, f) in enumerate(kinds)]
        symbols = "".join(cr.SYMBOLS[4 * "suao".index(r[0] if r != "x" else "o") + "FBDT".index(f)] for r, f in kinds)
        assert cr.cheapest(cr.product(symbols)) == solve(turns)[:2]


def test_empty_and_clashing(spark):
    assert run(spark, []).report.collect() == []
    rows = [(1, 0, "user", "hi."), (1, 1, "assistant", "ho.")]
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, part string")
    assert result(cr.repair(spark, df).report) == [(1, 0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:hi.\nassistant:ho.").hexdigest())]
    gone = next((c, 0, "user", "x.") for c in range(999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert result(run(spark, [gone]).report) == [(gone[0], 0, 0, 0, 0, 0, 0, "", NOTHING)]


def test_whole_table(spark):
    rows = [tuple(r.values()) for r in pq.read_table("/root/testdata/sf0.001/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()]
    assert result(QUERIES["op12_conversation_repair"](spark, "/root/testdata/sf0.001")) == brute(rows, ties(spark, rows))
