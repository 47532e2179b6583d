"""Operators against plain versions of the same rule, and rows that are odd in every way."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from lakewright.llm import _work, embedding_dedup, language_id, license_scan, mixing, packing, simhash_dedup, substring_dedup, topk_search
from lakewright.llm._work import Scratch
from lakewright.llm.queries import tokenizer_path
from pyspark.sql import functions as F

from .test_operators import BLANK, DOCS, docs, empty, smallest, texts  # noqa: F401

CLASH = ("_id", "_th", "_n", "_take", "_rank", "_row", "_count", "_key", "_many", "_place", "uid", "h", "queue", "node", "label", "component", "th", "spans", "k1", "fp", "keep_text", "ids", "n_tokens")


def clashing(df):
    """df with columns that carry names an operator may use itself."""
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH if c not in df.columns})


# --- packing -------------------------------------------------------------------------------------


def rounds(queues, weights, window):
    """Deficit round-robin round by round: {queue: [window of each document]}. queues: {name: [tokens of each document]}."""
    total = {q: sum(d) for q, d in queues.items()}
    listed = {q: w for q, w in weights.items() if q in queues}
    rest = sum(n for q, n in total.items() if q not in weights)
    share = max(0.0, 1 - sum(weights.values()))
    w = {q: listed[q] if q in listed else share * total[q] / rest for q in queues}
    got, sent, out = dict.fromkeys(queues, 0.0), dict.fromkeys(queues, 0), {q: [] for q in queues}
    k = 0
    while any(len(out[q]) < len(queues[q]) for q in queues):
        k += 1
        credit = float(window)
        while credit > 1e-7:  # what a queue cannot use goes to the others
            open_ = [q for q in queues if got[q] < total[q] - 1e-7 and w[q] > 1e-12]
            weight = {q: w[q] for q in open_}
            if not open_:  # those without a weight come last, by their tokens
                open_ = [q for q in queues if got[q] < total[q] - 1e-7]
                weight = {q: total[q] for q in open_}
            if not open_:
                break
            all_ = sum(weight.values())
            step = min(credit / all_, *((total[q] - got[q]) / weight[q] for q in open_))
            for q in open_:
                got[q] += step * weight[q]
            credit -= step * all_
        for q, sizes in queues.items():
            while len(out[q]) < len(sizes) and sent[q] + sizes[len(out[q])] <= got[q] + 1e-5:
                sent[q] += sizes[len(out[q])]
                out[q].append(k)
    return out


@pytest.mark.parametrize("weights", [{}, {"a": 0.5}, {"a": 0.6, "b": 0.3, "c": 0.1}, {"a": 0.7, "b": 0.0}, {"a": 0.5, "b": 0.5}, {"a": 0.05}, {"x": 0.4}, {"a": 1.0}, {None: 0.3}])
def test_schedule_is_round_by_round(spark, weights):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a"] * 6 + ["b", "b", "c", None]), rng.choice([1, 5, 30, 200, 700])) for i in range(900)]
    df = spark.createDataFrame(rows, "uid long, source string, n_tokens long").repartition(7).withColumn("h", F.xxhash64("uid"))
    df = df.withColumn("queue", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    got = {r.uid: (r.window, r["at"]) for r in packing.schedule(df.select("uid", "h", "queue", "n_tokens"), Scratch(spark, "t"), 1000, weights).collect()}
    queues = {}
    for r in sorted(df.collect(), key=lambda r: r.h & (1 << 64) - 1):
        queues.setdefault(r.source, []).append((r.uid, r.n_tokens))
    want = rounds({q: [n for _, n in d] for q, d in queues.items()}, weights, 1000)
    for q, d in queues.items():
        assert [got[u][0] for u, _ in d] == want[q], q
    size = {u: n for u, _, n in rows}
    stream = sorted(got, key=lambda u: got[u][1])
    assert [got[u][1] for u in stream] == np.cumsum([0, *(size[u] for u in stream[:-1])]).tolist()
    assert [got[u][0] for u in stream] == sorted(w for w, _ in got.values())


def test_packing_odd_rows(spark, docs, empty):  # noqa: F811
    path = tokenizer_path("word_bpe_49k.json")
    for bad in ({"a": -0.1}, {"a": math.nan}, {"a": 0.7, "b": 0.7}):
        with pytest.raises(ValueError, match="weights"):
            packing.pack(spark, docs, path, weights=bad)
    key = lambda df: sorted((str(r.doc_id), r.start, r.length, r.sequence_id, r.offset) for r in df.collect())
    one = key(packing.pack(spark, docs.coalesce(1), path, length=64, window_sequences=4))
    assert one == key(packing.pack(spark, clashing(docs.repartition(6)), path, length=64, window_sequences=4))  # not by how rows are split over files
    assert packing.pack(spark, empty, path, weights={"a": 0.5}).count() == 0


# --- languages -----------------------------------------------------------------------------------


def test_mixture_is_plain_em(spark, docs):  # noqa: F811
    model = language_id.train(spark, docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "b").otherwise("c")))
    plain = model.p.astype(float)
    rows = language_id.identify(spark, docs, model, keep=("text",)).collect()
    checked = 0
    for r in rows:
        slots, _ = language_id.grams([r.text])
        if not len(slots) or len(slots) > 5000:
            continue

        def em(columns, share, slots=slots):
            for _ in range(40):
                new = [0.0] * len(columns)
                for s in slots:  # gram by gram, as it is written down
                    parts = [w * plain[s, c] for w, c in zip(share, columns, strict=True)]
                    for i, x in enumerate(parts):
                        new[i] += x / sum(parts)
                new = [x / len(slots) for x in new]
                moved = max(abs(a - b) for a, b in zip(new, share, strict=True))
                share = new
                if moved < 2e-3:
                    break
            return share, sum(math.log(sum(w * plain[s, c] for w, c in zip(share, columns, strict=True))) for s in slots)

        single = [sum(math.log(plain[s, c]) for s in slots) for c in range(3)]
        share, _ = em(range(3), [1 / 3] * 3)
        best = max(range(3), key=lambda c: single[c])
        order = [best, *sorted((c for c in range(3) if c != best), key=lambda c: -share[c])]
        chosen, score = {order[0]: 1.0}, single[best]
        for k in (2, 3):
            if share[order[k - 1]] < 1e-3:
                break
            start = [max(share[c], 1e-3) for c in order[:k]]
            found, like = em(order[:k], [x / sum(start) for x in start])
            if like - language_id.PENALTY * math.log(max(len(slots), 2)) * (k - 1) <= score:
                break
            chosen, score = dict(zip(order[:k], found, strict=True)), like - language_id.PENALTY * math.log(max(len(slots), 2)) * (k - 1)
        assert {model.languages.index(n): round(s, 4) for n, s in zip(r.languages, r.shares, strict=True)} == pytest.approx({c: round(s, 4) for c, s in chosen.items()}, abs=2e-4)
        checked += 1
    assert checked > 100


def test_many_labels(spark):
    rng = random.Random(2)
    rows = []
    for k in range(300):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 6)
        rows += [(10 * k + i, " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(60)), f"l{k}") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language_id.train(spark, df.filter("doc_id % 10 < 2"))
    assert len(model.languages) == 300 and model.p.nbytes == 300 << 18
    got = language_id.identify(spark, df.filter("doc_id % 10 = 2"), model, keep=("lang",)).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 295


def test_language_odd_rows(spark, docs, empty):  # noqa: F811
    model = language_id.train(spark, docs)
    rows = [(None, "the of and", "x"), (1, "the delta " * 300_000, None), (1, "the delta " * 300_000, None), (2, None, "x"), (3, "", "x"), (4, "\n", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(7) for c in ("score", "lang_pred", "keep_doc_id", "fit")})
    got = language_id.identify(spark, df, model, keep=("doc_id", "score")).toDF("doc_id", "own", "lang_pred", "score", "languages", "shares", "fit").collect()
    assert len(got) == 6 and all(r.own == 7 for r in got) and len({(r.lang_pred, r.score) for r in got if r.doc_id == 1}) == 1
    assert all(r.lang_pred == "und" for r in got if r.doc_id in (2, 3, 4)) and next(r for r in got if r.doc_id is None).lang_pred != "und"
    assert language_id.identify(spark, empty, model, keep=("doc_id",)).count() == 0


# --- licences ------------------------------------------------------------------------------------


def places(text):
    """(words, base places) by going through the characters and comparing words one by one."""
    words, now = [], ""
    for c in (text or "") + " ":
        if ord(c) >= 0x80 or c.isalnum():
            now += c.lower() if "A" <= c <= "Z" else c
        elif now:
            words.append(now)
            now = ""
    found = [(i, label) for i in range(len(words)) for phrase, label in license_scan.BASE_PHRASES.items() if words[i : i + len(phrase.split())] == phrase.split()]
    return words, sorted(found)


def test_license_is_a_word_scan(spark, docs):  # noqa: F811
    rng = random.Random(6)
    bits = ["gnu", "GENERAL", "public", "license", "Apache", "cc", "BY", "mit", "cc-by", "gnu general public license", "é", "ǅ", "x", "\n", "\0", "apache license", "İ", "mit,license", " "]
    rows = [(i, "".join(rng.choice(bits) + rng.choice([" ", "", "-", "  ", "_"]) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    for r in license_scan.license_scan(clashing(df).withColumn("text", F.col("text"))).join(df.select("doc_id", "text").distinct(), "doc_id").collect():
        words, found = places(r.text)
        if r.doc_id not in (5, 7):  # ids that stand on two texts in one of the tables or both
            assert r.doc_id < 170 or (r.n_words, r.n_base) == (len(words), len(found))
    by = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        words, found = places(t)
        r = by[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(found), found[0][0] if found else None, found[-1][0] if found else None)
        assert r.base_labels == ",".join(sorted({x for _, x in found}))


def test_license_tags_of_long_texts():
    line = "// SPDX-License-Identifier: MIT OR (Apache-2.0 AND BSD-3-Clause)\n"
    _, _, own, _, expressions, allowed, score = license_scan.scan((line * 40_000).encode())
    assert len(expressions) == 40_000 and allowed and score == 1.0 and "spdx:mit" in own
    one = license_scan.scan(("x " * 10 + "SPDX-License-Identifier: MIT " * 40_000).encode())
    assert len(one[4]) == 40_000


# --- embeddings, top k ----------------------------------------------------------------------------


def test_lattice_settings_find_alike():
    for blocks in (1, 2, 3):
        assert embedding_dedup.recall(blocks) >= 0.985


def test_many_equal_vectors(spark):
    base = [float(x) for x in range(1, 9)]
    ids = spark.range(200_000).select(F.col("id").alias("vec_id"), F.array(*map(F.lit, base)).cast("array<float>").alias("embedding"), (F.col("id") % 2).cast("int").alias("label"))
    near = spark.createDataFrame([(300_001, [x * 2 for x in base], 1), (300_002, [-x for x in base], 1), (300_003, base, None), (7, base, 1), (None, base, 1)], "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.embedding_dedup(spark, ids.unionByName(near).withColumns({c: F.lit(1) for c in ("uid", "k1", "m", "least", "ok")}))
    counts = {tuple(r)[:-1]: r["count"] for r in got.groupBy("n_links", "component_id", "kept", F.col("vec_id").isin(7, 300_001, 300_002, 300_003).alias("own"), F.col("vec_id").isNull().alias("nameless")).count().collect()}
    assert counts[100_001, 1, False, True, False] == 3 and counts[100_001, 1, True, False, False] == 1  # 7 twice, 300001; the vector of id 1
    assert counts[100_001, 1, False, False, False] == 99_998 and counts[99_999, 0, False, False, False] == 99_999 and counts[99_999, 0, True, False, False] == 1
    assert counts[0, 300_002, True, True, False] == counts[0, 300_003, True, True, False] == 1 and counts[0, None, True, None, True] == 1


def test_topk_ends_of_the_range_and_rows_of_one_id(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    assert topk_search.accumulate(np.array([[low]], np.int64), np.array([[low], [1]], np.int64)).tolist() == [[high, low]]
    assert topk_search.accumulate(np.array([[low]], np.int64), np.array([[low], [-1], [0]], np.int64)).tolist() == [[high, high, 0]]
    rows = [(0, [1.0, 2.0]), (0, [3.0, 1.0]), (5, [1.0, 1.0]), (5, [2.0, 2.0]), (5, [1.0, 1.0]), (8, []), (9, [4.0]), (None, [9.0, 9.0]), (11, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("uid", "v", "ok", "query", "score")})
    for size in (1 << 20, 100):  # one block of queries, and one a query
        got = sorted(tuple(r) for r in topk_search.top_k(spark, df, every=100, k=3, block_bytes=size).collect())
        k = 1 << 20
        assert got == sorted([(0, 1, 5, 6 * k), (0, 2, 0, 5 * k), (0, 3, 9, 4 * k), (0, 1, 9, 12 * k), (0, 2, 5, 8 * k), (0, 3, 0, 5 * k)])


# --- copies and repeats ---------------------------------------------------------------------------


def test_levels_of_doubling(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(120))) for i in range(60)]
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(100 + i, rows[i][1] + " " + passage) for i in range(20)]
    named = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.xxhash64("text").alias("th"), "text")
    levels = []
    substring_dedup.repeats(named, Scratch(spark, "t"), levels=levels)
    assert [n for n, _ in levels] == [4, 8, 13] and levels[0][1] == 60 * 120 + 20 * 160
    tokens = [(i, t.split()) for i, t in rows]
    for (width, _), (longer, alive) in zip(levels, levels[1:], strict=False):
        seen = {}
        for i, w in tokens:
            for k in range(len(w) - width + 1):
                seen.setdefault(tuple(w[k : k + width]), set()).add(i)
        expected = 0
        for _, w in tokens:  # words in runs of repeated windows that are long enough for the next length
            run = 0
            for k in range(len(w) - width + 2):
                if k <= len(w) - width and len(seen[tuple(w[k : k + width])]) > 1:
                    run += 1
                else:
                    expected += run + width - 1 if run and run + width - 1 >= longer else 0
                    run = 0
        assert alive <= expected  # survivors of the level before are judged among themselves
        assert alive >= 40 * 120
    alone = []
    single = spark.createDataFrame([(1, passage)], "doc_id long, text string").select("doc_id", F.xxhash64("text").alias("th"), "text")
    assert substring_dedup.repeats(single, Scratch(spark, "t"), levels=alone) is None and [n for n, _ in alone] == [4]  # nothing survives


def test_names_that_clash(spark, docs, empty):  # noqa: F811
    odd = clashing(docs)
    kept = simhash_dedup.deduplicate(spark, odd)
    assert kept.columns == odd.columns and kept.count() == simhash_dedup.deduplicate(spark, docs).count()
    bits = simhash_dedup.deduplicate(spark, odd, width=3, similarity=None)
    assert bits.columns == odd.columns and bits.filter("_id <> 'own _id'").count() == 0
    mixed = mixing.select_mixture(spark, odd, per_mille=500)
    assert mixed.columns == odd.columns and sorted(map(str, mixed.select(*docs.columns).collect())) == sorted(map(str, mixing.select_mixture(spark, docs, per_mille=500).collect()))
    cut = substring_dedup.substring_dedup(spark, odd, keep=("keep_text", "_id"))
    assert cut.columns[-2:] == ["keep_text", "_id"] and cut.filter("_id = 'own _id'").count() == docs.count()
    assert simhash_dedup.simhash_components(spark, odd).count() == docs.count() and mixing.mix(spark, odd).count() == mixing.mix(spark, docs).count()
    for f in (simhash_dedup.deduplicate, mixing.select_mixture):
        assert f(spark, clashing(empty)).count() == 0


def test_mixture_of_equal_rows(spark):
    """Of equal rows as many stay as the budget holds, and one may be cut."""
    rows = [(1, "a b c d", "en", "src0", 7, 0.0)] * 10 + [(1, "e f g h", "en", "src0", 7, 0.0)] * 5 + [(None, "i j", "en", "src0", 3, 0.0)] * 5
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for per_mille in (1, 100, 330, 500, 777, 1000):
        left = mixing.select_mixture(spark, df, per_mille=per_mille).collect()
        assert sum(len(r.text.split()) for r in left) == 70 * per_mille // 1000
        assert sum(r.text not in ("a b c d", "e f g h", "i j") for r in left) <= 1


def test_scratch_goes(spark, docs, empty):  # noqa: F811
    simhash_dedup.simhash_components(spark, docs).collect()
    fs, path = _work._file_system(spark, f"{_work.shared_root(spark)}/lakewright/{spark.sparkContext.applicationId}")
    assert fs.exists(path)
    _work.release(spark)
    assert not fs.exists(path)
    assert smallest([1], []) == {1: 1} and BLANK.findall("a b") == ["a", "b"]
