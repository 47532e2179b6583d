"""The pipeline's near-copy stage against all pairs of exact shingle sets."""

from __future__ import annotations

import random
import re

import corpus_pipeline
import numpy as np
from lakewright.llm import _near, _trie, simhash_dedup
from lakewright.llm._work import Scratch

from .test_operators import smallest

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = BLANK.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()


def close(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def edited(rng, words, n):
    """words with n of them, far from each other, replaced."""
    words = list(words)
    for k in rng.sample(range(5, len(words) - 5, 12), n):
        words[k] = f"edit{rng.randrange(10**9)}"
    return words


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], DOCS).repartition(4)


def test_edited_copies(spark):
    rng = random.Random(7)
    plain = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, at = [], []
    for n, edits in ((100, 1), (100, 2), (300, 5), (1000, 5), (1000, 20)) * 8:
        base = plain(n)
        copy = edited(rng, base, edits)
        a, b = shingles(" ".join(base)), shingles(" ".join(copy))
        at.append(len(a & b) / len(a | b))
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    assert 0.8 <= min(at) < 0.83 and max(at) > 0.94
    hub = plain(200)  # each close to the hub, few to each other
    rows += [(len(rows) + k, " ".join(edited(rng, hub, 4))) for k in range(40)] + [(900, " ".join(hub))]
    half = plain(100)  # 0.5 to 0.79 stays
    rows += [(1000 + k, " ".join(edited(rng, half, 4))) for k in range(8)]
    rows += [(1100, "one two"), (1101, "One  two"), (1102, "two one"), (1103, rows[0][1].upper()), (1104, "x")]
    sets = {i: shingles(t) for i, t in rows}
    want = set(smallest(list(sets), [(i, j) for i in sets for j in sets if i < j and close(sets[i], sets[j])]).values())
    got = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, table(spark, rows), "").collect()]
    assert sorted(got) == sorted(want)
    assert not want & set(range(1, 80, 2)) and {1000 + k for k in range(8)} <= want


def test_ids_that_repeat(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(50)) for x in "ab")
    rows = [(1, a), (5, a), (5, b), (6, b), (7, None), (8, ""), (None, b), (None, "nameless"), (9, "twice"), (9, "twice")]
    got = simhash_dedup.deduplicate(spark, table(spark, rows)).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got))) == sorted(map(repr, [(1, a), (5, b), (7, None), (None, "nameless"), (9, "twice")]))
    assert simhash_dedup.deduplicate(spark, table(spark, [])).count() == 0


def test_bands_miss_few():
    """Pairs at 0.8 meet in some band."""
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(500):
        x = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        a, b = np.sort(x[:90]), np.sort(x[10:])
        _, bands = _near.signatures(np.concatenate([a, b]), np.array([0, 90, 180]))
        missed += not (bands[0] == bands[1]).any()
    assert missed <= 2


def test_crossing(monkeypatch):
    """One bucket of several components, compared pair by pair and by counts."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    items = [np.sort(np.concatenate([rng.permutation(base)[:54], rng.integers(0, 1 << 63, 3, dtype=np.uint64)])) for _ in range(30)]
    want = smallest(range(30), [(i, j) for i in range(30) for j in range(i) if close(set(items[i].tolist()), set(items[j].tolist()))])
    bands = np.concatenate([np.full((30, 1), 7), rng.integers(0, 1 << 62, (30, _near.BANDS - 1))], 1)
    for few in (64, 4):
        monkeypatch.setattr(_near, "FEW", few)
        same = (np.full(30, 7), np.full(30, 7), np.arange(30), np.arange(30), bands, items)
        found = _near.crossing(*same, np.zeros(30, np.int64), np.zeros(30, bool))
        assert smallest(range(30), found) == want
        side = np.arange(30) % 2
        across = smallest(range(30), [(i, j) for i in range(30) for j in range(i) if side[i] != side[j] and close(set(items[i].tolist()), set(items[j].tolist()))])
        assert smallest(range(30), _near.crossing(*same, side, np.ones(30, bool))) == across
    assert 1 < len(set(want.values())) < 30


def test_crowded_groups_are_cut(spark):
    """Large groups in chunks find what one task finds."""
    rng = random.Random(8)
    hub = [f"w{rng.randrange(300)}" for _ in range(150)]
    rows = [(k, " ".join(edited(rng, hub, rng.choice([1, 2, 3, 5, 7])))) for k in range(120)]
    rows += [(200 + k, " ".join(hub[:60] + [f"v{rng.randrange(10**6)}" for _ in range(90)])) for k in range(30)]
    sets = {i: shingles(t) for i, t in rows}
    want = smallest(list(sets), [(i, j) for i in sets for j in sets if i < j and close(sets[i], sets[j])])
    named = table(spark, rows).selectExpr("doc_id", "xxhash64(text) AS th", "text")
    for most in (4096, 7):
        got = {r.doc_id: r.label for r in _near.labelled(named, Scratch(spark, "t"), most).collect()}
        assert [{i for i in got if got[i] == x} for x in sorted(set(got.values()), key=lambda x: min(i for i in got if got[i] == x))] == [{i for i in want if want[i] == x} for x in sorted(set(want.values()))]
    assert 1 < len(set(want.values())) < 150


def test_equal_fingerprints_in_the_trie(monkeypatch):
    """Pairs of a group with itself and of two subtrees, in which fingerprints repeat."""
    rng = np.random.default_rng(9)
    monkeypatch.setattr(_trie, "FRONTIER", 16)
    group, fp = np.sort(rng.integers(0, 3, 90)), rng.integers(0, 6, 90, dtype=np.uint64) * np.uint64(0x0100_0000_0001_0101)
    two = group == 2
    side = np.where(two, rng.integers(0, 2, 90), 0)
    order = np.lexsort((fp, side, group))
    group, fp, two, side = (x[order] for x in (group, fp, two, side))
    got = [(min(x), max(x)) for i, j in _trie.near_pairs(group, fp, 3, side, two) for x in zip(i.tolist(), j.tolist(), strict=True)]
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if group[i] == group[j] and (not two[i] or side[i] != side[j]) and int(fp[i] ^ fp[j]).bit_count() <= 3}
    assert len(got) == len(set(got)) and set(got) == want


def test_pairs_come_from_the_trie(spark, monkeypatch):
    """In buckets of any size, and over all fingerprints before."""
    rng = np.random.default_rng(10)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    items = [np.sort(np.concatenate([base[: 60 - k], rng.integers(0, 1 << 63, k, dtype=np.uint64)])) for k in range(1, 5)]
    bands = np.full((4, _near.BANDS), 7)
    same = (np.full(4, 7), np.full(4, 7), np.arange(4), np.arange(4), bands, items, np.zeros(4, np.int64), np.zeros(4, bool))
    fp, n = _near.simhashes(items), np.full(4, 60)
    hub = np.arange(4) == 2
    u, v = _near.nearest(np.full(4, 7), np.arange(4), n, fp, hub)
    assert {frozenset(x) for x in zip(u.tolist(), v.tolist(), strict=True)} >= {frozenset((2, k)) for k in (0, 1, 3)}
    assert len(_near.crossing(*same)) == 3
    far = spark.createDataFrame([(1, 0b0111), (2, 0), (3, 0), (4, -1)], "node long, fp long")  # no bands
    pairs = [(r.u, r.v) for r in _near._everywhere(far, Scratch(spark, "t")).collect()]
    assert smallest([1, 2, 3, 4], pairs) == {1: 1, 2: 1, 3: 1, 4: 4}
    monkeypatch.setattr(_near, "near_pairs", lambda *a: iter(()))
    assert _near.crossing(*same) == []
