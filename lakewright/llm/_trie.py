"""The binary trie self-join: pairs of 64-bit fingerprints that differ in few bits.

Pairs of trie nodes are traversed together from the root, the bits in which the two paths differ are
added up, and a pair of subtrees is left as soon as that sum exceeds the budget.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ._graph import forest

BITS = 64
#: Node pairs held at once in a walk.
FRONTIER = 1 << 19


def near_pairs(group: np.ndarray, fp: np.ndarray, budget: int, side: np.ndarray | None = None, two: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one group whose fingerprints differ in at most `budget` bits, each once, some at a time.

    group, side and fp are sorted by (group, side, fp). A group is one subtree,
    paired with itself, or where `two` holds, two subtrees (sides 0 and 1), paired with each other. A trie node is
    a range of fp that shares all bits above a level; both ranges of a pair descend together, level by level.
    """
    side = np.zeros(len(group), np.int8) if side is None else side
    two = np.zeros(len(group), bool) if two is None else two
    edge = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (side[1:] != side[:-1]), [True]]))
    lo, hi = edge[:-1], edge[1:]
    own = ~two[lo] & (hi - lo > 1)
    left = np.flatnonzero(two[lo[:-1]] & (group[lo[:-1]] == group[lo[1:]])) if len(lo) > 1 else np.zeros(0, np.int64)
    start = [np.concatenate(x) for x in ((lo[own], lo[left]), (hi[own], hi[left]), (lo[own], lo[left + 1]), (hi[own], hi[left + 1]))]
    stack = [(BITS - 1, *start, np.zeros(len(start[0]), np.int8))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        level, al, ah, bl, bh, d = stack.pop()
        if not len(al):
            continue
        if len(al) > FRONTIER:
            half = len(al) // 2
            stack += [(level, al[:half], ah[:half], bl[:half], bh[:half], d[:half]), (level, al[half:], ah[half:], bl[half:], bh[half:], d[half:])]
            continue
        leaf = (ah - al == 1) & (bh - bl == 1)  # two leaves: their remaining paths at once
        if leaf.any():
            i, j = al[leaf], bl[leaf]
            near = (np.bitwise_count(fp[i] ^ fp[j]) <= budget) & (i != j)
            if near.any():
                yield i[near], j[near]
            al, ah, bl, bh, d = (x[~leaf] for x in (al, ah, bl, bh, d))
        if not len(al):
            continue
        if level < 0:
            yield from _products(al, ah, bl, bh)
            continue
        if level not in ones:
            ones[level] = np.concatenate([[0], ((fp >> np.uint64(level)) & np.uint64(1)).cumsum(dtype=np.int64)])
        c = ones[level]
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])  # where the one-subtrees begin
        own = al == bl
        parts = [(al, am, bl, bm, d), (am, ah, bm, bh, d), (al, am, bm, bh, d + 1)]
        cross = tuple(x[~own] for x in (am, ah, bl, bm, d + 1))  # of a node with itself, the same as the pair before
        nxt = [np.concatenate(x) for x in zip(*parts, cross, strict=True)]
        al, ah, bl, bh, d = nxt
        live = (al < ah) & (bl < bh) & (d <= budget) & ~((al == bl) & (ah - al == 1))
        stack.append((level - 1, al[live], ah[live], bl[live], bh[live], d[live]))


def _products(al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs of each two ranges, or of a range with itself: what is left of subtrees that hold equal fingerprints."""
    size = ah - al
    i = np.repeat(al - (size.cumsum() - size), size) + np.arange(size.sum())
    lo, hi = np.where(np.repeat(al == bl, size), i + 1, np.repeat(bl, size)), np.repeat(bh, size)
    ends = (hi - lo).cumsum()
    start = 0
    while start < len(i):
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + FRONTIER, side="right")))
        wide = (hi - lo)[start:stop]
        first = np.repeat(lo[start:stop] - (ends[start:stop] - wide - done), wide)
        if len(first):
            yield np.repeat(i[start:stop], wide), first + np.arange(len(first))
        start = stop


def walk(group: np.ndarray, fp: np.ndarray, budget: int, side: np.ndarray | None = None, two: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of `near_pairs` as a spanning forest of them."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for i, j in near_pairs(group, fp, budget, side, two):
        found.append((i, j))
        held += len(i)
        if held > 4 * FRONTIER:
            found = [forest(*map(np.concatenate, zip(*found, strict=True)))]
            held = len(found[0][0])
    if not found:
        z = np.zeros(0, np.int64)
        return z, z
    return forest(*map(np.concatenate, zip(*found, strict=True)))
