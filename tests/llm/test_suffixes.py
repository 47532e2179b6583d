"""Suffix arrays against sorting, and the removal of repeated bytes against looking at every window."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from lakewright.llm import suffix_dedup as sd
from lakewright.llm.queries import QUERIES

WIDTH = 50
COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def brute(rows: list[tuple]) -> list[tuple]:
    texts = [(d, (t or "").encode()) for d, t in rows]
    least: dict[bytes, int] = {}
    for d, t in texts:
        if d is not None:
            for i in range(len(t) - WIDTH + 1):
                w = t[i : i + WIDTH]
                least[w] = min(least.get(w, d), d)
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        if d is not None:
            for i in range(len(t) - WIDTH + 1):
                if least[t[i : i + WIDTH]] < d:
                    gone[i : i + WIDTH] = b"\1" * WIDTH
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df) -> list[tuple]:
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def run(spark, rows, schema="doc_id long, text string", **kw):
    return sd.suffix_dedup(spark, spark.createDataFrame(rows, schema), **kw)


def drawn(seed: int, n: int) -> list[tuple]:
    draw = random.Random(seed)
    word = lambda k=8: "".join(draw.choices("abc é\x00", k=draw.randint(1, k)))
    passages = [" ".join(word() for _ in range(draw.randint(5, 60))) for _ in range(8)]
    phrase = "the phrase that stands nearly everywhere "
    rows = []
    for d in range(n):
        parts = []
        for _ in range(draw.randint(0, 6)):
            kind = draw.random()
            p = draw.choice(passages)
            if kind < 0.3:
                parts.append(p)
            elif kind < 0.5:
                a = draw.randrange(len(p))
                parts.append(p[a : a + draw.randint(20, 120)])
            elif kind < 0.6:
                at = draw.randrange(len(p))
                parts.append(p[:at] + "X" + p[at + 1 :])
            elif kind < 0.8:
                parts.append(word(20) + phrase + word(20))
            else:
                parts.append(draw.choice(["a", "ab", "\x00", "é"]) * draw.randint(10, 140))
        rows.append((draw.choice([d, d, d // 2]), draw.choice(["", " ", word(30)]).join(parts)))
    return rows


def test_suffix_array_and_prefixes():
    draw = random.Random(2)
    for alphabet in (b"a", b"ab", b"\x00\x01", bytes(range(256))):
        for n in (1, 2, 9, 70, 400):
            data = bytes(draw.choice(alphabet) for _ in range(n // 2)) * 2 + b"b" * (n % 2)
            array = np.frombuffer(data, np.uint8)
            order = sd.suffix_array(array, n)
            padded = data + bytes(2 * n + 16)
            assert sorted(order.tolist()) == list(range(n))
            assert [padded[i : i + n] for i in order] == sorted(padded[i : i + n] for i in range(n))
            shared = sd.common_prefixes(array, order, 50, lane=8)
            short = sd.suffix_array(array, 10)
            for k, x in enumerate(sd.common_prefixes(array, short, 10, lane=8)[1:], 1):
                a, b = data[short[k - 1] :][:10], data[short[k] :][:10]
                assert x == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            for k in range(1, n):
                a, b = data[order[k - 1] :], data[order[k] :]
                assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y or i == 50), min(len(a), len(b), 50))


@pytest.mark.parametrize("bits", [3, 21])
def test_prefixes_of_some_suffixes(monkeypatch, bits):
    """An order that leaves suffixes out tells what those that are left share; ranks that do not fit into one number sort the same."""
    monkeypatch.setattr(sd, "_BITS", np.int64(bits))
    draw = random.Random(5)
    for n in (1, 9, 70, 400):
        data = bytes(draw.choice(b"ab") for _ in range(n // 2)) * 2 + b"b" * (n % 2)
        array, padded = np.frombuffer(data, np.uint8), data + bytes(2 * n + 16)
        order = sd.suffix_array(array, n)
        assert [padded[i : i + n] for i in order] == sorted(padded[i : i + n] for i in range(n))
        some = order[np.isin(order, [i for i in range(n) if draw.random() < 0.6])]
        for most, lane in ((50, 8), (5, 64)):
            shared = sd.common_prefixes(array, some, most, lane=lane)
            assert len(shared) == len(some)
            for k in range(1, len(some)):
                a, b = data[some[k - 1] :][:most], data[some[k] :][:most]
                assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_order_of_starts_alone():
    """Suffixes that begin no window are refined no further than those that do need, whose order is that of their first bytes."""
    draw = random.Random(7)
    for n, depth in ((1, 50), (9, 50), (400, 50), (400, 20), (3000, 50)):
        data = bytes(draw.choice(b"ab") for _ in range(n // 2)) * 2 + b"b" * (n % 2)
        array, padded = np.frombuffer(data, np.uint8), data + bytes(2 * n + 66)
        starts = np.array([i for i in range(n) if i % 67 < 18])
        order = sd.suffix_array(array, depth, starts)
        assert sorted(order.tolist()) == list(range(n))
        mine = [padded[i : i + depth] for i in order[np.isin(order, starts)]]
        assert mine == sorted(mine)


def test_rounds_have_few_rows(spark):
    """A round has a row for each shard and bucket, so a shard holds several slices of text."""
    rows = [(d, f"{d} " + "lorem ipsum dolor " * 6000) for d in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sum(len(t) for _, t in rows) > 6 << 20 and sd.shards(table).count() == 1


@pytest.mark.parametrize("positions", [128, 1 << 20])
def test_owners(monkeypatch, positions):
    """Each window has one owner, which is a function of its bytes, wherever a slice ends."""
    monkeypatch.setattr(sd, "POSITIONS", positions)
    monkeypatch.setattr(sd, "_PLACE", np.uint64(positions - 1))
    draw = random.Random(4)
    texts = [bytes(draw.choice(b"ab ") for _ in range(draw.choice([0, 10, 49, 50, 51, 300, 2000]))) for _ in range(30)]
    texts += [texts[-1], b"x" * 400]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    first, count, at = sd.owners(data, offsets, WIDTH)
    windows = [w for f, c in zip(first.tolist(), count.tolist()) for w in range(f, f + c)]
    assert windows == [int(o) + i for o, t in zip(offsets, texts) for i in range(len(t) - WIDTH + 1)]
    place = defaultdict(set)
    whole = data.tobytes()
    for f, c, a in zip(first.tolist(), count.tolist(), at.tolist()):
        for w in range(f, f + c):
            assert w <= a <= w + WIDTH - sd.GRAM
            place[whole[w : w + WIDTH]].add(a - w)
    assert all(len(x) == 1 for x in place.values())


@pytest.mark.parametrize("limits", [{}, {"hot_places": 2, "suffix_bytes": 300}, {"hot_places": 0, "suffix_bytes": 1}])
def test_against_every_window(spark, monkeypatch, limits):
    monkeypatch.setattr(sd, "SHARD_BYTES", 1500)
    rows = drawn(6, 160) + [(None, drawn(6, 20)[3][1]), (None, None), (5, None), (3, ""), (3, "z" * 49), (4, "z" * 50), (9, "z" * 120)]
    assert result(run(spark, rows, **limits)) == brute(rows)


def test_copies_of_one_text(spark):
    """A text that a third of all rows hold, with edits here and there: nothing is dropped to get by."""
    draw = random.Random(8)
    base = "".join(draw.choices("abcdefgh ", k=700))
    rows = [(d, base if d % 3 else base[: (k := draw.randrange(600))] + "#" + base[k:]) for d in range(250)]
    assert result(run(spark, rows, hot_places=50)) == brute(rows)


def test_kept_bytes_and_odd_tables(spark):
    passage = "é" * 30
    got = {r.doc_id: r for r in run(spark, [(1, "a" + passage), (2, "b" + passage + "c", )]).collect()}
    assert got[2].kept == b"bc" and got[2].spans == [[1, 61]] and got[1].spans is None and got[1].kept.decode() == "a" + passage
    assert run(spark, []).collect() == []
    clash = run(spark, [(1, "x", 3, "y")], "doc_id long, text string, shard int, kept string")
    assert result(clash) == brute([(1, "x")])


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    assert result(QUERIES["op11_suffix_dedup"](spark, "/root/testdata/sf0.001")) == brute(rows)
