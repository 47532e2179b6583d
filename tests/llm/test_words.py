"""Word bounds and hashes, and words that a polynomial modulo 2**64 cannot tell apart."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from lakewright.llm import _words, simhash_dedup, substring_dedup


def thue_morse(n: int) -> tuple[str, str]:
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("at_once", [7, 1 << 22])
def test_bounds(monkeypatch, at_once):
    monkeypatch.setattr(_words, "BYTES_AT_ONCE", at_once)
    monkeypatch.setattr(_words, "WORDS_AT_ONCE", at_once)
    draw = random.Random(1)
    texts = [bytes(draw.choice(b"ab \t\n\xc3") for _ in range(draw.randint(0, 30))) for _ in range(60)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts, ends, first = _words.bounds(data, offsets)
    want = [w for t in texts for w in re.findall(rb"[^\x20\x09-\x0d]+", t)]
    assert [data[a:b].tobytes() for a, b in zip(starts, ends)] == want
    assert np.diff(first).tolist() == [len(re.findall(rb"[^\x20\x09-\x0d]+", t)) for t in texts]
    one, two, index = _words.distinct(*_words.hashes(data, starts, ends))
    assert len(one) == len(set(want)) and len({(int(one[i]), int(two[i]), w) for i, w in zip(index, want)}) == len(one)


def test_distinct_by_both_hashes():
    one, two = np.array([5, 5, 3, 5], np.uint64), np.array([1, 2, 1, 1], np.uint32)
    a, b, index = _words.distinct(one, two)
    assert [(int(a[i]), int(b[i])) for i in index] == [(5, 1), (5, 2), (3, 1), (5, 1)] and len(a) == 3


@pytest.mark.parametrize("n", [1 << k for k in range(10, 15)])
def test_crafted_words(n):
    words = [w.encode() for w in thue_morse(n)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = _words.bounds(data, np.array([0, len(data)]))
    one, two = _words.hashes(data, starts, ends)
    assert one[0] != one[1] and two[0] != two[1]


def test_crafted_words_lose_nothing(spark):
    """Two documents whose only windows differ in one crafted word, and two near copies that share no word."""
    a, b = thue_morse(1 << 11)
    rest = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a} {rest}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(spark, docs).collect()} == {1: 0, 2: 0, 3: 13}
    apart = spark.createDataFrame([(1, " ".join([a] * 8), "x", "s", 1), (2, " ".join([b] * 8), "x", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in simhash_dedup.deduplicate(spark, apart).collect()) == [1, 2]
