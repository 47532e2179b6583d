"""The pipeline against a brute-force version of its stages, on a few documents."""

from __future__ import annotations

import random
import re

import corpus_pipeline
from lakewright.llm._tokens import TextTokenizer
from lakewright.llm.queries import tokenizer_path

from .test_operators import fingerprint, smallest

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def test_run(spark, tmp_path):
    rng = random.Random(11)
    words = [a + b + c for a in ("th", "an", "re", "st") for b in ("e", "o", "i") for c in ("n", "r", "d", "")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randint(30, 80)), "en", f"src{i % 3}") for i in range(60)]
    passage = text(30)
    rows += [(60 + i, text(20) + " " + passage + " " + text(20), "en", "src1") for i in range(10)]
    rows += [(80 + i, rows[i][1], None, "src2") for i in range(10)]
    rows += [(95, None, "en", "src0"), (96, "", "en", "src0"), (97, "12 34 !!", "en", "src0")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))

    kept = [(i, t) for i, t, *_ in rows if t and re.search(r"[^\W\d_]", t)]
    fps = {i: fingerprint(t) for i, t in kept}
    label = smallest(list(fps), [(a, b) for a in fps for b in fps if (fps[a] ^ fps[b]).bit_count() <= 3])
    kept = [(i, BLANK.findall(t)) for i, t in kept if label[i] == i]
    first: dict[tuple, int] = {}
    for i, w in kept:
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    left = {}
    for i, w in kept:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        left[i] = [x for x, g in zip(w, gone, strict=True) if not g]

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{n}"))
        docs = spark.read.parquet(str(tmp_path / f"{n}"))
        if n < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS), name
        if n == 2:
            assert {r.doc_id: BLANK.findall(r.text) for r in docs.collect()} == left
        if n == 3:
            mixed = {r.doc_id: r.text for r in docs.collect()}
    total = sum(map(len, left.values()))
    assert abs(sum(len(BLANK.findall(t)) for t in mixed.values()) - total * 900 // 1000) <= 20
    for i, t in mixed.items():
        assert left[i][: len(BLANK.findall(t))] == BLANK.findall(t)
    coder = TextTokenizer(tokenizer_path("word_bpe_49k.json"))
    assert sum(p.length for p in docs.collect()) == sum(len(coder.encode(t)) // 4 + 1 for t in mixed.values())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
