"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide counts of linked ids.

A byte-level vocabulary (A) and one of pieces (B) cut the bytes of blank + text differently. Where a
token of each ends at the same byte, the two are linked and a group of tokens ends. Texts become token
interval tables (id, first byte, end byte) of a slice of documents, and DuckDB works on those inside
the task: an equi-join on the end byte finds the links, a running sum over them numbers the groups,
ASOF joins find the group that each token lies in and the first B token that it overlaps, a range of
token numbers the last. What leaves a task is one row for a document with its different linked id
pairs; Spark adds up the pairs of all documents.

Ranges that end together are suffixes of one another, so a vocabulary's token can be linked with one
token of the other for each of its bytes at most: the table of pair counts has no more rows than the two
vocabularies have bytes together (some 600,000), whatever the corpus. That is what makes it safe to
send it to every task.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import Scratch, binary_array, lean, narrow, slices

#: Text bytes that one DuckDB call sees, characters of the longest chunk that a worker keeps, and chunks kept.
SLICE_BYTES = 1 << 20
CACHE_CHARS = 48
CACHE_CHUNKS = 600_000
MARK = "▁"
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>\Z")
#: A blank after a blank of any kind, or at the end: no place to cut a text at.
_UNSAFE = re.compile(r"\s | \Z")
ROWS = "n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, pairs binary"

#: Each A token with the last B token that it overlaps, and whether the two end together; token numbers follow byte order.
_MEET = """
CREATE OR REPLACE TEMP TABLE met AS
SELECT a.i, a.doc, a.id AS a_id, b.i AS b_last, b.id AS b_id, (b.e = a.e)::INT AS linked
FROM a ASOF JOIN b ON a.e > b.s ORDER BY a.i"""
#: The group that each A token lies in, and how many B tokens are in its range: from the last one met before, or the one after it if it was linked.
#: The windows need no order of their own: the table was filled in token order, which the database preserves.
_GROUPS = """
SELECT doc, b_last, linked, sum(linked) OVER before - linked AS g, b_last + 1 - coalesce(lag(b_last + linked) OVER (), 0) AS overlaps
FROM met WINDOW before AS (ROWS UNBOUNDED PRECEDING)"""
_PAIRS = "SELECT doc, (a_id::UINTEGER << 16) | b_id AS pair, count(*) AS n FROM met WHERE linked = 1 GROUP BY ALL ORDER BY doc, pair"


class _Vocabularies:
    """Both tokenizers, the bytes of their tokens, and the ids of chunks met before.

    A chunk is a blank and what follows up to the next blank. Neither tokenizer has a token that reaches from a character
    other than a blank over the blank behind it, so a text's ids are its chunks' ids one after another; where a blank follows
    blank space of any kind, the chunks around it stay together, and so does a blank that ends the text.
    """

    def __init__(self, ranks: str, pieces: str, pattern: str):
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.a = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        a_bytes = [token for token, _ in sorted(table.items(), key=lambda x: x[1])]  # ranks are 0, 1, 2 and so on
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes.fromhex(m.group(1)) if (m := _BYTE_PIECE.match(p)) else p.replace(MARK, " ").encode() for p in names]
        self.by_chunk = not any(MARK in p.lstrip(MARK) for p in names)
        if max(len(a_bytes), len(names)) > 1 << 16:
            raise ValueError("token ids must fit in 16 bits")
        self.sizes = [np.array([len(x) for x in side], np.int64) for side in (a_bytes, self.b_bytes)]
        self.a_known: dict[str, bytes] = {}
        self.b_known: dict[str, bytes] = {}

    def _learn(self, chunks: list[str]) -> None:
        """The ids of blank + chunk as 16-bit numbers; none if the tokens' bytes differ from it. A's are the bytes themselves, cut."""
        a_known, b_known, encode, b_bytes = self.a_known, self.b_known, self.a.encode_ordinary, self.b_bytes.__getitem__
        for chunk, b in zip(chunks, self.b.encode(chunks, num_threads=1), strict=True):
            blank = " " + chunk
            if b"".join(map(b_bytes, b)) == blank.encode():
                a_known[chunk], b_known[chunk] = array("H", encode(blank)).tobytes(), array("H", b).tobytes()
            else:
                a_known[chunk] = b_known[chunk] = b""

    def _chunks(self, text: str) -> list[str]:
        if not self.by_chunk:
            return [text]
        chunks = text.split(" ")
        if not _UNSAFE.search(" " + text):
            return chunks
        kept = [[chunks[0]]]
        for before, chunk in pairwise(chunks):
            if not chunk or not before or before[-1].isspace():
                kept[-1].append(chunk)
            else:
                kept.append([chunk])
        return [" ".join(x) for x in kept]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """(A's ids, B's ids) of blank + text for each text; None without tokens."""
        cut = [self._chunks(t) if t else [] for t in texts]
        a_known, b_known = self.a_known, self.b_known
        if len(a_known) > CACHE_CHUNKS:
            a_known.clear()
            b_known.clear()
        new = list(set().union(*cut).difference(a_known))
        self._learn(new)
        out = []
        for chunks in cut:
            ids = [a_known[c] for c in chunks]
            out.append((np.frombuffer(b"".join(ids), np.uint16), np.frombuffer(b"".join([b_known[c] for c in chunks]), np.uint16)) if ids and b"" not in ids else None)
        for c in new:
            if len(c) > CACHE_CHARS:
                del a_known[c], b_known[c]
        return out


@lru_cache(maxsize=2)
def _vocabularies(ranks: str, pieces: str, pattern: str) -> _Vocabularies:
    return _Vocabularies(ranks, pieces, pattern)


@lru_cache(maxsize=1)
def _database():
    """One in a worker, in memory and on one thread: Spark deals the work out."""
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": "", "preserve_insertion_order": True})


def _intervals(ids: list[np.ndarray], sizes: np.ndarray) -> pa.Table:
    """The token table of the documents' ids: number, document, id, first byte and end byte, counted through all documents."""
    joined = np.concatenate(ids)
    end = sizes[joined].cumsum().astype(np.int32)
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in ids])
    return pa.table({"i": np.arange(len(joined), dtype=np.int32), "doc": doc, "id": joined, "s": end - sizes[joined].astype(np.int32), "e": end})


class Aligned:
    """Groups, links and overlaps of a few documents' tokens."""

    def __init__(self, a_ids: list[np.ndarray], b_ids: list[np.ndarray], sizes: list[np.ndarray]):
        db = _database()
        a, b = _intervals(a_ids, sizes[0]), _intervals(b_ids, sizes[1])
        db.register("a", a)
        db.register("b", b)
        try:
            db.execute(_MEET)
            rows, pairs = db.execute(_GROUPS).fetchnumpy(), db.execute(_PAIRS).fetchnumpy()
        finally:
            db.execute("DROP TABLE IF EXISTS met")
            db.unregister("a")
            db.unregister("b")
        linked = rows["linked"].astype(bool)
        self.a_group = rows["g"].astype(np.int64)
        # a B token lies in the group that the next linked one ends
        self.b_group = np.searchsorted(rows["b_last"][linked], np.arange(b.num_rows))
        self.links = np.bincount(rows["doc"][linked], minlength=len(a_ids))
        self.overlaps = np.bincount(rows["doc"], rows["overlaps"], minlength=len(a_ids)).astype(np.int64)
        cut = np.searchsorted(pairs["doc"], np.arange(len(a_ids) + 1))
        self.pairs = [(pairs["pair"][x:y].astype(np.uint32), pairs["n"][x:y].astype(np.uint32)) for x, y in pairwise(cut)]
        self.a, self.b, self.b_doc = a["id"].to_numpy(), b["id"].to_numpy(), b["doc"].to_numpy()

    def written(self) -> list[bytes]:
        """The groups of each document, as `a1,a2|b1;a3|b2,b3`."""
        ga, gb = self.a_group, self.b_group
        in_a, in_b = np.bincount(ga), np.bincount(gb)
        before_a, before_b = in_a.cumsum() - in_a, in_b.cumsum() - in_b
        # in a group A's tokens come first, then B's
        at_a = np.arange(len(ga)) + before_b[ga]
        at_b = np.arange(len(gb)) + (before_a + in_a)[gb]
        token = np.empty(len(ga) + len(gb), np.uint16)
        token[at_a], token[at_b] = self.a, self.b
        text = _digits()[token]
        text[:, 5] = ord(",")
        text[at_a[np.append(ga[1:] != ga[:-1], True)], 5] = ord("|")
        text[at_b[np.append(gb[1:] != gb[:-1], True)], 5] = ord(";")
        shown = text != 0
        size = np.count_nonzero(shown, 1).cumsum()
        data = text[shown].tobytes()
        ends = size[at_b[np.append(self.b_doc[1:] != self.b_doc[:-1], True)]].tolist()
        return [data[x : y - 1] for x, y in pairwise([0, *ends])]


@lru_cache(maxsize=1)
def _digits() -> np.ndarray:
    """The decimal digits of each 16-bit number as five characters and a place for a mark, leading zeros being 0."""
    number = np.arange(1 << 16)[:, None]
    power = 10 ** np.arange(4, -1, -1)
    digits = np.where((number >= power) | (power == 1), number // power % 10 + ord("0"), 0)
    return np.concatenate([digits, np.zeros((1 << 16, 1), np.int64)], 1).astype(np.uint8)


def align(docs: DataFrame, ranks: str, pieces: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_overlaps, groups_sha256, pairs) of every row, in the rows' own partitions.

    pairs holds the different linked id pairs, A's id in the upper 16 bits of a 32-bit number, then how often each is linked.
    """
    named = narrow(docs, doc_id=id_col, text=text_col)
    kind = named.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = _vocabularies(ranks, pieces, pattern)
        for batch in slices(batches, "text", SLICE_BYTES):
            encoded = vocabularies.encode(batch.column("text").to_pylist())
            rows = [(0, 0, 0, 0, 0, "", b"")] * len(encoded)
            full = [i for i, x in enumerate(encoded) if x]
            if full:
                found = Aligned([encoded[i][0] for i in full], [encoded[i][1] for i in full], vocabularies.sizes)
                for k, (i, written) in enumerate(zip(full, found.written(), strict=True)):
                    a, b = encoded[i]
                    links = int(found.links[k])
                    blob = b"".join(x.tobytes() for x in found.pairs[k])
                    rows[i] = (len(a), len(b), links, links, int(found.overlaps[k]), hashlib.sha256(written).hexdigest(), blob)
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(cols[5], pa.string()), binary_array(list(cols[6]))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", *(f.split(" ")[0] for f in ROWS.split(", "))])

    return named.mapInArrow(lean(run), f"doc_id {kind}, {ROWS}")


def _split(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(blob, np.uint32)
    return both[: len(both) // 2], both[len(both) // 2 :]


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many links of all documents join the two ids. Tasks add up their documents first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for batch in batches:
            got = [_split(x.as_buffer()) for x in batch.column("pairs") if x.is_valid]
            if got:
                pairs, at = np.unique(np.concatenate([pairs, *(p for p, _ in got)]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, *(n for _, n in got)]).astype(np.float64), len(pairs)).astype(np.int64)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(counts)], names=["pair", "n"])

    return aligned.select("pairs").mapInArrow(lean(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align_documents(spark: SparkSession, docs: DataFrame, ranks: str, pieces: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_overlaps, n_best, count_sum, groups_sha256) of every row.

    n_overlaps counts pairs of tokens that share a byte; n_best are links whose pair no other pair of the same B id
    outnumbers in the corpus, ties included; count_sum adds up the corpus counts of the links' pairs. A text that is null, empty or
    that the two vocabularies' tokens do not spell back (one that holds U+2581) has zeros and ''. Null ids stay null, repeated rows are aligned and
    counted each, an empty table gives an empty one, and other columns do not matter, whatever their names. A text is encoded by its chunks between
    blanks; a longest text bounds a task: some 40 bytes a byte of it.
    """
    scratch = Scratch(spark, "alignment")
    aligned = scratch.table(align(docs, ranks, pieces, pattern, id_col, text_col))
    # no more rows than the vocabularies have bytes, see above
    found = pair_counts(aligned).toArrow()
    pair, n = found["pair"].to_numpy().astype(np.uint32), found["n"].to_numpy()
    order = np.argsort(pair)
    pair, n = pair[order], n[order]
    highest = np.zeros(1 << 16, np.int64)
    np.maximum.at(highest, pair & 0xFFFF, n)
    shared = spark.sparkContext.broadcast((pair, n, n == highest[pair & 0xFFFF]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            sums, bests = [], []
            for blob in batch.column("pairs"):
                own, times = _split(blob.as_buffer()) if blob.is_valid else (pair[:0], n[:0])
                at = np.searchsorted(pair, own)
                sums.append(int((n[at] * times).sum()))
                bests.append(int(times[best[at]].sum()))
            kept = [c for c in batch.schema.names if c != "pairs"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(bests, pa.int64()), pa.array(sums, pa.int64())], names=[*kept, "n_best", "count_sum"])

    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema if f.name != "pairs"]
    out = aligned.mapInArrow(lean(run), ", ".join([*names, "n_best long", "count_sum long"]))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_best", "count_sum", "groups_sha256")
