"""Edit-aware token counting.

A document is a sequence of chunks, the runs between blanks and line feeds, which
no token of a word vocabulary crosses. Chunks stand in segments, and a binary tree
over the segments holds the sums of characters and of tokens below each node. An
edit is found by descending on characters; the chunks it touches, with what is left
of them on either side, are encoded again and no others; the sums are updated along
the paths of the segments touched.

What is kept between rounds of edits is the tree: its segments with their sums and a
token count for each chunk, and a digest of the text they belong to. A later round
splits the segments that its edits touch and no others; a state of another text is
told by the digest and not used.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tokens import TextTokenizer, tokenizer
from ._work import binary_array, lean, slices

#: Chunks of a new segment, and the most it may grow to before it is cut into new ones.
SEGMENT = 64
CROWDED = 1024
EDITS = "array<struct<pos: long, cut: long, put: string>>"
#: The state's head: layout, digest of the text, segments, bytes of a chunk's count.
HEAD = struct.Struct("<B16sIB")
LAYOUT = 2


class TokenTree:
    """Sums of characters and tokens over segments of chunks; level 0 is the segments, the last level one node.

    A segment is loaded, that is, its chunks' characters are known, only once an edit touches it.
    """

    def __init__(self, sums: np.ndarray, sizes: np.ndarray, counts: np.ndarray, load: Callable[[int, int], np.ndarray]):
        """sums: (characters, tokens) of each segment; sizes: its chunks; counts: tokens of all chunks; load(start, characters): those of each chunk there."""
        first = np.concatenate([[0], sizes.cumsum()])
        self.sizes, self.counts_of = sizes.tolist(), [counts[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        self.chars_of: list[np.ndarray | None] = [None] * len(self.sizes)
        self.load = load
        self._sum_up(sums)

    @classmethod
    def of(cls, chars: np.ndarray, tokens: np.ndarray, load: Callable[[int, int], np.ndarray]) -> TokenTree:
        """chars: of each chunk and the blank after it."""
        at = np.arange(0, max(len(chars), 1), SEGMENT)
        sizes = np.diff(np.append(at, len(chars)))
        return cls(np.stack([np.add.reduceat(chars, at), np.add.reduceat(tokens, at)], 1).astype(np.int64), sizes, tokens, load)

    def _sum_up(self, level: np.ndarray) -> None:
        self.levels = [level]
        while len(level) > 1:
            if len(level) % 2:
                level = np.concatenate([level, np.zeros((1, 2), np.int64)])
                self.levels[-1] = level
            level = level[0::2] + level[1::2]
            self.levels.append(level)

    @property
    def tokens(self) -> int:
        return int(self.levels[-1][0, 1])

    @property
    def chunks(self) -> int:
        return sum(self.sizes)

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sums, sizes, counts) as the constructor takes them."""
        return self.levels[0][: len(self.sizes)], np.array(self.sizes, np.int64), np.concatenate(self.counts_of)

    def locate(self, char: int) -> tuple[int, int]:
        """(segment, chunk in it) that holds this character."""
        node, rest = 0, char
        for level in reversed(self.levels[:-1]):
            node *= 2
            if rest >= level[node, 0]:
                rest -= int(level[node, 0])
                node += 1
        if node >= len(self.sizes):  # beyond the text: its last segment
            node = len(self.sizes) - 1
            rest += int(self.levels[0][node, 0])
        if self.chars_of[node] is None:
            self.chars_of[node] = self.load(char - rest, int(self.levels[0][node, 0]))
        at = int(np.searchsorted(self.chars_of[node].cumsum(), rest, side="right"))
        return node, min(at, self.sizes[node] - 1)

    def replace(self, first: tuple[int, int], last: tuple[int, int], chars: np.ndarray, tokens: np.ndarray) -> None:
        """Puts chunks in the place of those from first to last."""
        (a, i), (b, j) = first, last
        chars = np.concatenate([self.chars_of[a][:i], chars, self.chars_of[b][j + 1 :]])
        tokens = np.concatenate([self.counts_of[a][:i], tokens, self.counts_of[b][j + 1 :]])
        if len(chars) > CROWDED:
            at = list(range(0, len(chars), SEGMENT))
            pieces = [slice(x, x + SEGMENT) for x in at]
            self.sizes[a : b + 1] = [len(chars[p]) for p in pieces]
            self.chars_of[a : b + 1] = [chars[p] for p in pieces]
            self.counts_of[a : b + 1] = [tokens[p] for p in pieces]
            new = np.stack([np.add.reduceat(chars, at), np.add.reduceat(tokens, at)], 1)
            old = self.levels[0][: len(self.sizes) - len(at) + b + 1 - a]
            self._sum_up(np.concatenate([old[:a], new, old[b + 1 :]]).astype(np.int64))
            return
        none = np.zeros(0, np.int64)
        for s in range(a, b + 1):
            self.sizes[s], self.chars_of[s], self.counts_of[s] = (len(chars), chars, tokens) if s == a else (0, none, none)
            self.levels[0][s] = (chars.sum(), tokens.sum()) if s == a else (0, 0)
        low, high = a, b
        for below, level in zip(self.levels, self.levels[1:], strict=False):
            low, high = low // 2, high // 2
            level[low : high + 1] = below[2 * low : 2 * high + 2 : 2] + below[2 * low + 1 : 2 * high + 2 : 2]


def _split(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


def _chars(chunks: list[str]) -> np.ndarray:
    return np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1


def _tokens(chunks: list[str], coder: TextTokenizer) -> np.ndarray:
    coder.bound()
    return np.fromiter(map(len, map(coder.chunks.__getitem__, chunks)), np.int64, len(chunks)) // 4


def digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


class Counted:
    """A text with its tree."""

    def __init__(self, text: str, coder: TextTokenizer, state: bytes | None = None):
        """state: what `state()` gave for this text; without it, or with that of another text, all chunks are encoded."""
        self.text, self.coder, self.encoded = text, coder, 0
        self.tree = self._kept(state) if state else None
        if self.tree is None:
            chunks = _split(text)
            self.encoded = len(chunks)
            self.tree = TokenTree.of(_chars(chunks), _tokens(chunks, coder), self._load)

    def _load(self, start: int, chars: int) -> np.ndarray:
        return _chars(_split(self.text[start : start + chars - 1]))

    def _kept(self, state: bytes) -> TokenTree | None:
        if len(state) < HEAD.size:
            return None
        layout, mark, n, width = HEAD.unpack_from(state)
        if layout != LAYOUT or mark != digest(self.text):
            return None
        sums = np.frombuffer(state, "<u4", 3 * n, HEAD.size).reshape(n, 3).astype(np.int64)
        counts = np.frombuffer(state, np.uint8 if width == 1 else "<u4", offset=HEAD.size + 12 * n).astype(np.int64)
        return TokenTree(sums[:, :2].copy(), sums[:, 2], counts, self._load)

    def state(self) -> bytes:
        """The tree as bytes: one byte a chunk where all counts are small, else four."""
        sums, sizes, counts = self.tree.segments()
        filled = sizes > 0
        width = 1 if counts.max(initial=0) < 256 else 4
        rows = np.concatenate([sums, sizes[:, None]], 1)[filled].astype("<u4")
        return HEAD.pack(LAYOUT, digest(self.text), len(rows), width) + rows.tobytes() + counts.astype(np.uint8 if width == 1 else "<u4").tobytes()

    def edit(self, pos: int, cut: int, put: str) -> None:
        """Cuts `cut` characters from pos on and puts a text there; both are held within the text."""
        text = self.text
        pos = min(max(pos, 0), len(text))
        end = min(pos + max(cut, 0), len(text))
        left = max(text.rfind(" ", 0, pos), text.rfind("\n", 0, pos)) + 1
        stops = [at for at in (text.find(" ", end), text.find("\n", end)) if at >= 0]
        right = min(stops, default=len(text))
        chunks = _split(text[left:pos] + put + text[end:right])
        first, last = self.tree.locate(left), self.tree.locate(right)
        self.tree.replace(first, last, _chars(chunks), _tokens(chunks, self.coder))
        self.encoded += len(chunks)
        self.text = text[:pos] + put + text[end:]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", state_col: str | None = None, edits_col: str | None = None, with_text: bool = True) -> DataFrame:
    """(doc_id, n_tokens, n_edited, n_chunks, n_encoded, and with_text: text, state) of every row.

    n_tokens counts the text as given, n_edited after its edits (an array of (pos, cut, put), in order, positions in
    characters of the text so far). n_chunks is all chunks after the edits, n_encoded those encoded in this call. state is
    what a later call takes as state_col with the edited text, so that it need not encode what the edits leave alone; a state
    that is null, or of another text, is not used. Null texts count as empty and come back empty; a null id stays null. Null edits,
    and null fields of an edit, change nothing. Edits beyond the text are held within it. The vocabulary must be one whose tokens
    cross no white space. A text of any length is counted whole, repeated rows are counted each, an empty table gives an empty one,
    and other columns do not matter, whatever their names.
    """
    cols = {"doc_id": F.col(f"`{id_col}`"), "text": F.col(f"`{text_col}`")}
    cols["state"] = F.col(f"`{state_col}`") if state_col else F.lit(None).cast("binary")
    cols["edits"] = F.col(f"`{edits_col}`").cast(EDITS) if edits_col else F.lit(None).cast(EDITS)
    rows = docs.select(*[c.alias(n) for n, c in cols.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        if not coder.by_chunk:
            raise ValueError("tokens of this vocabulary cross white space")
        for batch in slices(batches, "text"):
            out: list[tuple] = []
            for text, state, edits in zip(*(batch.column(c).to_pylist() for c in ("text", "state", "edits")), strict=True):
                doc = Counted(text or "", coder, state)
                before = doc.tree.tokens
                for e in edits or ():
                    if e and e["pos"] is not None:
                        doc.edit(e["pos"], e["cut"] or 0, e["put"] or "")
                out.append((before, doc.tree.tokens, doc.tree.chunks, doc.encoded, *((doc.text, doc.state()) if with_text else ())))
            numbers = [pa.array([x[k] for x in out], pa.int64()) for k in range(4)]
            texts = [pa.array([x[4] for x in out]), binary_array([x[5] for x in out])] if with_text else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, *texts], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "n_edited", "n_chunks", "n_encoded", *(["text", "state"] if with_text else [])]
    schema = f"doc_id {kind}, n_tokens long, n_edited long, n_chunks long, n_encoded long" + ", text string, state binary" * with_text
    return rows.mapInArrow(lean(run), schema)
