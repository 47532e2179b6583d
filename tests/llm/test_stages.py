"""Each stage of the pipeline on rows that are odd in every way."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"passage{i}" for i in range(40))
HUGE = " ".join(f"huge{i}" for i in range(200_000))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    words = [a + b + c for a in ("th", "an", "re", "st") for b in ("e", "o", "i") for c in ("n", "r", "d", "")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    plain = [text(50) for _ in range(30)]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(plain)]
    rows += [
        (None, plain[0], "en", "src0", 1), (None, text(40), None, None, None), (40, None, "en", "src0", None), (41, "", "en", "src0", 0), (42, " \n\t ", None, "src0", 4), (43, "12 34 !!", "en", "src1", 8),
        (44, HUGE, "en", "src2", len(HUGE)), (45, plain[3], "en", "src1", 1), (45, plain[3], "en", "src1", 1), (46, text(30) + " " + PASSAGE, "en", None, 9), (47, PASSAGE + " " + text(30), None, "src0", 9), (48, PASSAGE, "en", "src0", 9), (48, text(25), "en", "src0", 9),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def extra(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in ("_id", "kept", "label", "th", "lang_pred", "fit", "keep_text", "spans", "_take", "uid", "queue", "h", "n_tokens")})


def texts(df):
    return sorted((str(r.doc_id), r.text or "") for r in df.collect())


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_columns_and_empty_tables(spark, odd, name, stage):
    got = stage(spark, odd, "")
    assert got.columns == list(corpus_pipeline.COLUMNS) and got.schema.simpleString() == odd.schema.simpleString()
    assert texts(stage(spark, extra(odd), "")) == texts(got)
    empty = stage(spark, odd.limit(0), "")
    assert empty.columns == list(corpus_pipeline.COLUMNS) and empty.count() == 0


def test_language(spark, odd):
    got = corpus_pipeline.identify_language(spark, odd, "").collect()
    ids = [r.doc_id for r in got]
    assert not {40, 41, 42, 43} & set(ids) and ids.count(None) == 2 and ids.count(45) == 2 and 44 in ids and all(r.lang for r in got)
    assert corpus_pipeline.identify_language(spark, odd.withColumn("lang", F.lit(None).cast("string")), "").count() == 0


def test_near_copies(spark, odd):
    got = corpus_pipeline.drop_near_copies(spark, odd, "").collect()
    ids = [r.doc_id for r in got]
    assert ids.count(None) == 1 and 45 not in ids and {44, 46, 47, 3} <= set(ids)
    assert ids.count(48) == 2  # two texts of one id, neither a copy
    assert [i for i in (40, 41, 42) if i in ids] == [40]  # without a word: one group
    assert 43 in ids


def test_repeats(spark, odd):
    got = {(r.doc_id, r.source): r for r in corpus_pipeline.drop_repeats(spark, odd, "").collect()}
    assert PASSAGE in got[46, None].text and "passage" not in got[47, "src0"].text and got[47, "src0"].n_chars == len(got[47, "src0"].text)
    assert got[44, "src2"].text == HUGE and got[40, "src0"].text is None and got[41, "src0"].text == ""
    assert corpus_pipeline.drop_repeats(spark, odd, "").filter("doc_id IS NULL").count() == 2
    assert (45, "src1") not in got  # nothing is left of copies of document 3
    assert [r.text for r in corpus_pipeline.drop_repeats(spark, odd, "").filter("doc_id = 48").collect()] != [PASSAGE]


def test_mixing(spark, odd):
    small = odd.filter("doc_id IS NULL OR doc_id <> 44")
    got = corpus_pipeline.mix_sources(spark, small, "")
    total = sum(len(r.text.split()) for r in small.collect() if r.text)
    left = sum(len(r.text.split()) for r in got.collect())
    assert abs(left - total * 900 // 1000) <= 12 and not {40, 41, 42} & {r.doc_id for r in got.collect()}
    assert got.filter("doc_id = 45").count() <= 2


def test_packing(spark, odd):
    pieces = corpus_pipeline.pack_sequences(spark, extra(odd), "").collect()
    whole = {}
    for p in pieces:
        whole.setdefault(str(p.doc_id), []).append(p)
    assert sum(p.length for p in whole["40"]) == 1 and sum(p.length for p in whole["41"]) == 1 and {p.doc_tokens for p in whole["45"]} == {whole["45"][0].doc_tokens}
    assert sum(p.length for p in whole["44"]) == whole["44"][0].doc_tokens > 200_000
    assert corpus_pipeline.pack_sequences(spark, odd.limit(0), "").count() == 0
