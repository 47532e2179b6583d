"""Whole-batch word handling on UTF-8 bytes with numpy: no Python object per word that outlives a block of them.

Words are the runs between the six ASCII blanks (space, tab to carriage return).
"""

from __future__ import annotations

import numpy as np
import xxhash

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes and words that are looked at at once: a long text takes no more than a short one besides its word table.
BYTES_AT_ONCE = 1 << 22
WORDS_AT_ONCE = 1 << 16
_WORD_BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F))
_LOW = np.uint64(0xFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher on 64 bits: multiply and xor-shift rounds."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of all words: word w is data[starts[w]:ends[w]]; text i has the words first[i]:first[i + 1]."""
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(data), BYTES_AT_ONCE):
        b = min(a + BYTES_AT_ONCE, len(data))
        word = np.zeros(b - a + 2, bool)  # a byte more on each side
        word[1:-1] = ~BLANK[data[a:b]]
        word[0] = a > 0 and not BLANK[data[a - 1]]
        word[-1] = b < len(data) and not BLANK[data[b]]
        cut = np.zeros(b - a + 1, bool)  # a text begins here
        cut[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, side="right")] - a] = True
        here = word[1:-1]
        starts.append(np.flatnonzero(here & (~word[:-2] | cut[:-1])) + a)
        ends.append(np.flatnonzero(here & (~word[2:] | cut[1:])) + a + 1)
    start = np.concatenate(starts)
    return start, np.concatenate(ends), np.searchsorted(start, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word's bytes, of 64 and of 32 bits: parts of XXH3 with 128 bits, so that no word stands for another."""
    one, two = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint32)
    for k in range(0, len(starts), WORDS_AT_ONCE):
        a, b = starts[k : k + WORDS_AT_ONCE], ends[k : k + WORDS_AT_ONCE]
        base = int(a[0])
        held = data[base : int(b[-1])].tobytes()
        digests = b"".join([xxhash.xxh3_128_digest(held[x:y]) for x, y in zip((a - base).tolist(), (b - base).tolist(), strict=True)])
        both = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        one[k : k + len(a)], two[k : k + len(a)] = both[:, 0], both[:, 1] & _LOW
    return one, two


def distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the different words by both hashes, in two columns; each word's place among them)."""
    found, at, index = np.unique(one, return_index=True, return_inverse=True)
    if (two[at][index] == two).all():
        return found, two[at], index
    order = np.lexsort((two, one))
    new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
    index = np.empty(len(one), np.int64)
    index[order] = new.cumsum() - 1
    return one[order][new], two[order][new], index


def windows(words: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of the `width` words from each place; places near the end of all words have none."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = mix(words[:n].astype(np.uint64))
    for k in range(1, width):
        total *= _WORD_BASES[which]
        total += words[k : k + n]
        total ^= total >> np.uint64(32)
    return mix(total)


def inside(first: np.ndarray, width: int) -> np.ndarray:
    """Places from which `width` words lie in one text; ascending."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    shift = np.repeat(first[:-1] - np.concatenate([[0], counts.cumsum()[:-1]]), counts)
    return np.arange(counts.sum()) + shift
