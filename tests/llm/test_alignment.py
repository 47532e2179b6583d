"""Token alignment against the vocabularies' own libraries and loops over tokens."""

from __future__ import annotations

import hashlib
import json
import random
import re
from bisect import bisect_left
from collections import Counter

import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import sentencepiece
from lakewright.llm import token_alignment
from lakewright.llm.queries import QUERIES, tokenizer_path
from tokenizers import Tokenizer

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [None, "", " ", "  ", "a", " lead", "tail ", "two  blanks", "tab\tand\n new\n\n  line ", "x\n y", "x \n  y", "<|endoftext|> <s>x</s> <unk>", "a▁b", "▁", "é é ﬁ", "\x00nul\x1c x", "!\x1c y", "a\xa0b \xa0 c", "　 z",
       "👩‍🚀 🚀", "don't we'll", "123 4567", "日本語 テキスト", "a" * 300, " " * 70 + "w", "word " * 50, "<0x41> <0x0A>", "  x  y"]


def byte_level() -> dict[str, int]:
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = {chr(b): b for b in kept}
    for n, b in enumerate(b for b in range(256) if b not in set(kept)):
        chars[chr(256 + n)] = b
    return chars


def brute(rows: list[tuple]) -> list[tuple]:
    a_lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    names = {i: t for t, i in json.load(open(tokenizer_path("byte_bpe_50k.json")))["model"]["vocab"].items()}
    char = byte_level()

    def b_bytes(i: int) -> bytes:
        piece = b_lib.id_to_piece(i)
        hexed = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes([int(hexed[1], 16)]) if hexed else piece.replace("▁", " ").encode()

    found, counts = [], Counter()
    for doc, text in rows:
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        a_bytes, b_own = [bytes(char[c] for c in names[i]) for i in a], [b_bytes(i) for i in b]
        whole = (" " + text).encode() if text else b""
        if b"".join(a_bytes) != whole or b"".join(b_own) != whole:
            a, b, a_bytes, b_own = [], [], [], []
        ends = [{}, {}]
        for side, (ids, own) in enumerate(((a, a_bytes), (b, b_own))):
            at = 0
            for i, x in zip(ids, own, strict=True):
                at += len(x)
                ends[side][at] = i
        common = sorted(ends[0].keys() & ends[1].keys())
        links = [(ends[0][e], ends[1][e]) for e in common]
        counts.update(links)
        inside = [[[], []] for _ in common]
        for side in (0, 1):
            for at, i in sorted(ends[side].items()):
                inside[bisect_left(common, at)][side].append(str(i))
        groups = ["|".join(",".join(x) for x in g) for g in inside]
        found.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    return [(d, n_a, n_b, n, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), sha) for d, n_a, n_b, n, links, sha in found]


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def align(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    return token_alignment.align_documents(spark, df, tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("piece_bpe_32k.model"), P.PATTERN)


def test_odd_texts(spark, monkeypatch):
    rows = [*enumerate(ODD), (None, "no id"), (3, "repeated row"), (3, "repeated row")]
    assert rows_of(align(spark, rows)) == sorted(brute(rows), key=repr)


def test_random_strings():
    """Chunks give the ids of whole texts, whatever blank space and marks stand where they are cut."""
    draw = random.Random(5)
    v = token_alignment._Vocabularies(tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("piece_bpe_32k.model"), P.PATTERN)
    a_lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    texts = ["".join(draw.choice("ab Z9'.,! \n\t\x1c\x85　é́<|>s日") + draw.choice(["", "", " "]) for _ in range(draw.randint(1, 60))) for _ in range(1500)]
    for text, ids in zip(texts, v.encode(texts), strict=True):
        assert ids[0].tolist() == a_lib.encode(" " + text, add_special_tokens=False).ids
        assert ids[1].tolist() == v.b.encode(text)


def test_bounded_cache(monkeypatch):
    monkeypatch.setattr(token_alignment, "CACHE_CHUNKS", 3)
    v = token_alignment._Vocabularies(tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("piece_bpe_32k.model"), P.PATTERN)
    first = [x[0].tolist() for x in v.encode(["one two three four five", "x" * 100])]
    assert [x[0].tolist() for x in v.encode(["one two three four five", "x" * 100])] == first and not any(len(c) > token_alignment.CACHE_CHARS for c in v.a_known)


def test_empty_and_clashing(spark):
    assert align(spark, []).collect() == []
    got = align(spark, [(1, "a b", 5, "x")], "doc_id long, text string, n_a int, pairs string")
    assert rows_of(got) == brute([(1, "a b")])


@pytest.mark.parametrize("slice_bytes", [200, 1 << 20])
def test_whole_table(spark, monkeypatch, slice_bytes):
    """The query over the smallest table, and its overlaps: two cuts of the same bytes overlap in one pair more than they have inner ends."""
    monkeypatch.setattr(token_alignment, "SLICE_BYTES", slice_bytes)
    got = QUERIES["op13_token_alignment"](spark, "/root/testdata/sf0.001")
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert rows_of(got) == sorted(brute([(r["doc_id"], r["text"]) for r in table]), key=repr)
    assert all(r.n_overlaps == r.n_a + r.n_b - r.n_links for r in got.collect())
