"""Token trees that are kept, and states that do not belong to a text."""

from __future__ import annotations

import random

from lakewright.llm import token_counts
from lakewright.llm._tokens import TextTokenizer
from lakewright.llm.queries import tokenizer_path
from pyspark.sql import functions as F

PATH = tokenizer_path("word_bpe_49k.json")
EDITED = "doc_id long, text string, edits array<struct<pos: long, cut: long, put: string>>"


def test_tree_through_many_rounds():
    """Each round starts from the state of the one before; splits, emptied segments and crowded ones on the way."""
    coder, rng = TextTokenizer(PATH), random.Random(1)
    now, state = " ".join(rng.choice(["alpha", "be", "gamma,", "é", "x1"]) for _ in range(5000)), None
    for turn in range(60):
        doc = token_counts.Counted(now, coder, state)
        assert doc.encoded == (0 if turn else 5000)
        for _ in range(rng.randint(0, 3)):
            pos, cut, put = rng.randint(0, len(now)), rng.choice([0, 5, 40, 3000]), rng.choice(["", "xy", " a\nb ", "many words " * 400, "z" * 50])
            doc.edit(pos, cut, put)
            now = now[:pos] + put + now[min(pos + cut, len(now)) :]
        assert doc.text == now and doc.tree.tokens == len(coder.encode(now)) // 4 and doc.tree.chunks == len(now.replace("\n", " ").split(" "))
        state = doc.state()


def test_only_touched_segments_are_loaded():
    coder = TextTokenizer(PATH)
    text = "some words here " * 20_000
    state = token_counts.Counted(text, coder).state()
    doc = token_counts.Counted(text, coder, state)
    doc.edit(100_000, 4, "other")
    assert doc.encoded <= 2 and sum(c is not None for c in doc.tree.chars_of) <= 2


def test_states_of_other_texts(spark):
    texts = ["one two three", "supercalifragilistic antidisestablishmentarianism floccinaucinihilipilification", "", None]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], EDITED)
    states = [r.state for r in sorted(token_counts.count_tokens(df, PATH, edits_col="edits").collect())]
    coder = TextTokenizer(PATH)
    rows = [(10 * i + j, t, s) for i, t in enumerate(texts) for j, s in enumerate([*states, b"", b"\2no state at all", None])]
    mixed = spark.createDataFrame(rows, "doc_id long, text string, state binary")
    for r in token_counts.count_tokens(mixed, PATH, state_col="state").collect():
        assert r.n_tokens == r.n_edited == len(coder.encode(texts[r.doc_id // 10] or "")) // 4
        assert r.n_encoded == (0 if states[r.doc_id // 10] == (states + [None] * 3)[r.doc_id % 10] else r.n_chunks)


def test_odd_rows(spark):
    huge = "word " * 400_000
    rows = [(None, "a b", [(0, 1, "cc")]), (1, None, [(5, 5, "new")]), (1, huge, [(10, 0, "x"), None]), (1, huge, [(10, 0, "x"), None]), (2, "a", [(None, 1, "x"), (0, None, None)]), (3, "", [])]
    df = spark.createDataFrame(rows, EDITED).withColumns({c: F.lit(1) for c in ("state", "n_tokens", "n_encoded")})
    got = token_counts.count_tokens(df, PATH, edits_col="edits").collect()
    assert sorted((str(r.doc_id), len(r.text), r.n_chunks) for r in got) == sorted([("None", 4, 2), ("1", 3, 1), ("1", len(huge) + 1, 400_001), ("1", len(huge) + 1, 400_001), ("2", 1, 1), ("3", 0, 1)])
    assert token_counts.count_tokens(df.limit(0), PATH, edits_col="edits").count() == 0
