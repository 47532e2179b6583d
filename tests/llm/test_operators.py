"""Each operator against a brute-force version on small tables with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from lakewright.llm import embedding_dedup, language_id, license_scan, mixing, packing, simhash_dedup, substring_dedup, token_counts, topk_search, url_filter
from lakewright.llm._graph import components
from lakewright.llm._tokens import TextTokenizer
from lakewright.llm._work import Scratch
from lakewright.llm.queries import tokenizer_path
from pyspark.sql import functions as F

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["the", "of", "and", "été", "straße", "x1", "Alpha,", "beta.", "GAMMA", "delta"] + [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        rows.append([i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 90)))])
    shared = " ".join(f"s{i}" for i in range(60))
    for i in range(120, 150):  # a passage that many share, and near copies
        rows.append([i, rows[i - 100][1] + "\n" + shared + " " + rng.choice(words)])
    for i in range(150, 160):
        rows.append([i, rows[i - 150][1]])
    rows += [[160, None], [161, ""], [162, " \t\n "], [163, "one"], [164, "two words"], [165, "w " * 20000], [166, None], [5, rows[5][1]], [7, "another text of the same id"], [None, "a row without an id " + shared]]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if (i or 0) % 3 else None, f"src{(i or 0) % 4}" if (i or 0) % 5 else None, len(t or ""), 0.5) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


def smallest(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def test_components(spark):
    rng = random.Random(1)
    for links in ([(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(99, i) for i in range(40, 60)], [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)]):
        df = spark.createDataFrame([*links, (5, 5), links[0], (None, 1)], "u long, v long")
        want = smallest({n for e in links for n in e} | {5}, links)
        assert {r.node: r.component for r in components(df, Scratch(spark, "t")).collect()} == want
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def fingerprint(text):
    words = BLANK.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs, texts, empty):
    got = simhash_dedup.simhash_components(spark, docs).collect()
    fps = {(i, t): fingerprint(t) for i, t in texts}
    named = [(i, f) for (i, _), f in fps.items() if i is not None]
    links = [(a, b) for a, f in named for b, g in named if (f ^ g).bit_count() <= 3]
    want = smallest({i for i, _ in named}, links)
    assert len(got) == len(texts)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id] and r.fp & (1 << 64) - 1 in {f for i, f in named if i == r.doc_id}
    kept = simhash_dedup.deduplicate(spark, docs, width=3, similarity=None)
    assert kept.columns == docs.columns
    # rows, not ids, are kept or go: one of each group
    kinds = sorted(fps.items(), key=lambda x: (x[0][0] is None, x[0][0] or 0))
    label = smallest(range(len(kinds)), [(i, j) for i in range(len(kinds)) for j in range(i) if (kinds[i][1] ^ kinds[j][1]).bit_count() <= 3])
    got = [(r.doc_id, r.text) for r in kept.collect()]
    place = {k: i for i, (k, _) in enumerate(kinds)}
    assert len(got) == len(set(got)) == len(set(label.values())) == len({label[place[k]] for k in got})
    least = {}
    for k, i in place.items():
        if k[0] is not None:
            least[label[i]] = min(k[0], least.get(label[i], k[0]))
    assert all(k[0] == least.get(label[place[k]]) for k in got)
    assert simhash_dedup.simhash_components(spark, empty).count() == 0


def test_trie_walk_and_hot_subtrees(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [np.uint64(1) << np.uint64(b) for b in range(20)]
    near = np.unique(np.concatenate([base, *[b ^ rng.choice(flips, 30) ^ rng.choice(flips, 30) for b in base]]))
    links = [(i, j) for i in range(len(near)) for j in range(i) if int(near[i] ^ near[j]).bit_count() <= 3]
    want = smallest(range(len(near)), links)
    i, j = simhash_dedup.walk(np.zeros(len(near), np.int64), near, 3)
    assert smallest(range(len(near)), list(zip(i.tolist(), j.tolist(), strict=True))) == want
    df = spark.createDataFrame([(int(np.int64(f.view(np.int64))), k) for k, f in enumerate(near)], "fp long, rep long")
    for most in (4096, 10):  # the second hands large subtrees on
        edges = [(r.u, r.v) for r in simhash_dedup.links(df, 3, Scratch(spark, "t"), most=most).collect()]
        assert smallest(range(len(near)), edges) == want


def test_substring(spark, docs, texts, empty):
    rows = [(i, BLANK.findall(t or "")) for i, t in texts]
    first = {}
    for i, w in rows:
        for k in range(len(w) - 12):
            if i is not None:
                first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    want = []
    for i, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((str(i), len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = substring_dedup.substring_dedup(spark, docs, keep=("lang",)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)
    assert any(r.n_removed for r in got)
    for r in got:
        assert sum(b - a for a, b in r.spans or []) == r.n_removed
        assert hashlib.sha256(" ".join(BLANK.findall(r.kept or "")).encode()).hexdigest() == r.kept_sha256
    plain = substring_dedup.substring_dedup(spark, docs, with_text=False).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in plain) == sorted(want)
    assert substring_dedup.substring_dedup(spark, empty).count() == 0


def test_packing(spark, docs, texts, empty):
    path = tokenizer_path("word_bpe_49k.json")
    coder = TextTokenizer(path)
    want = sorted([*np.frombuffer(coder.encode(t or ""), "<u4").tolist(), 1] for _, t in texts)
    for weights in (None, {"src1": 0.5, "src2": 0.1}):
        pieces = packing.pack(spark, docs, path, length=64, window_sequences=4, weights=weights).collect()
        at = {}
        for p in pieces:
            assert p.length > 0 and len(p.ids) == 4 * p.length and p.offset + p.length <= 64
            at.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert sorted(at) == list(range(len(at)))
        for s, ps in at.items():
            ps.sort()
            assert [o for o, _ in ps] == [sum(n for _, n in ps[:k]) for k in range(len(ps))]
            assert s == len(at) - 1 or sum(n for _, n in ps) == 64
        stream = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
        found, now = [], []
        for p in stream:  # a document's pieces follow each other in the stream
            assert p.start == len(now)
            now += np.frombuffer(bytes(p.ids), "<u4").tolist()
            if len(now) == p.doc_tokens:
                found.append(now)
                now = []
        assert sorted(found) == want
    assert packing.pack(spark, empty, path).count() == 0


def test_packing_holds_the_mixture(spark):
    rows = [(i, "word " * 50, "en", "big" if i % 4 else "small", 0, 0.0) for i in range(800)]
    pieces = packing.pack(spark, spark.createDataFrame(rows, DOCS), tokenizer_path("word_bpe_49k.json"), length=128, window_sequences=16).collect()
    for w in range(len({p.sequence_id for p in pieces}) // 16):
        inside = [p for p in pieces if p.sequence_id // 16 == w]
        small = sum(p.length for p in inside if p.doc_id % 4 == 0)
        assert abs(small - 512) <= 2 * 51


def test_tokens_are_the_librarys():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    own, theirs = TextTokenizer(path), Tokenizer.from_file(path)
    rng = random.Random(9)
    letters = "abcdefgXYZéßÀ'0123.,<|>  \n\t" + "́  ﬁ中😀\x1c"
    for _ in range(3000):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) + rng.choice(["", "<|endoftext|>", " <|endoftext|>x"])
        assert np.frombuffer(own.encode(s), "<u4").tolist() == theirs.encode(s, add_special_tokens=False).ids


def test_language(spark, empty):
    rng = random.Random(4)
    syllables = {"aa": ["ba", "bo", "ka", "lo"], "bb": ["shi", "tru", "xen", "qir"], "cc": ["über", "größ", "ung", "keit"]}
    make = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, make(lang, 60), lang, "s", 0, 0.0) for i in range(240) for lang in [rng.choice(list(syllables))]]
    rows += [(1000, make("aa", 200) + " " + make("bb", 120), None, "s", 0, 0.0), (1001, None, "aa", "s", 0, 0.0), (1002, "1234 ... !", None, "s", 0, 0.0), (1003, "", None, "s", 0, 0.0), (1004, "zzyyxxvv wwjjpp " * 50, None, "s", 0, 0.0)]
    df = spark.createDataFrame(rows, DOCS)
    model = language_id.train(spark, df.filter(~language_id.held_out()))
    assert model.languages == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in language_id.identify(spark, df.withColumn("held_out", language_id.held_out()), model, keep=("doc_id", "lang", "held_out")).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    test = [r for i, r in got.items() if i < 1000 and r.held_out]
    assert test and all(r.lang_pred == r.lang and 0 <= r.score <= 1 and r.fit > 0 for r in test)
    mixed = got[1000]
    assert set(mixed.languages) == {"aa", "bb"} and mixed.lang_pred == "aa" and abs(mixed.shares[0] - 0.55) < 0.15
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].fit is None for i in (1001, 1002, 1003))
    assert got[1004].fit < 0
    nothing = language_id.train(spark, empty)
    assert nothing.languages == [] and {r.lang_pred for r in language_id.identify(spark, df, nothing).collect()} == {"und"}


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:20] + 0.12 * rng.normal(size=(20, 16)), np.repeat(base[:1], 40, 0) + 0.05 * rng.normal(size=(40, 16))])
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)]
    odd = [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [1.0, None], 1), (504, x[0].tolist(), None), (505, [], 1), (506, [1e200] * 3, 1), (507, [2e200] * 3, 1), (508, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit(1))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = [(i, j) for i in range(len(x)) for j in range(i) if i % 2 == j % 2 and unit[i] @ unit[j] >= 0.93]
    near.append((506, 507))
    for most, blocks in ((4096, 1), (8, 1), (4096, 2)):  # the second cuts crowded cells into chunks
        got = {r.vec_id: r for r in embedding_dedup.embedding_dedup(spark, df, most=most, blocks=blocks).collect()}
        assert len(got) == len(rows) + len(odd)
        links = sum(r.n_links for r in got.values()) / 2
        assert 0.95 * len(near) <= links <= len(near)
        if links == len(near):
            want = smallest(list(got), near)
            assert all(r.component_id == want[i] and r.kept == (want[i] == i) for i, r in got.items())
        assert all(got[i].n_links == 0 and got[i].kept for i in (500, 501, 502, 503, 504, 505, 508))
    assert embedding_dedup.embedding_dedup(spark, df.limit(0)).count() == 0


def test_e8_decoder():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 8)) * 2
    p = embedding_dedup.decode(x)
    own = ((x - p) ** 2).sum(1)
    roots = embedding_dedup.roots()
    assert len(roots) == 240 and np.allclose((roots**2).sum(1), 2)
    assert (((x[:, None] - p[:, None] - roots) ** 2).sum(2) >= own[:, None] - 1e-9).all() and (own <= 1 + 1e-9).all()
    twice = np.rint(2 * p).astype(int)
    assert ((twice % 2).sum(1) % 8 == 0).all() and ((twice.sum(1) % 4) == 0).all()


def test_topk(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(450, 6)).round(1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1100, [float("inf")] * 6), (1200, [1.0, None]), (None, [1.0] * 6), (7, x[7].tolist()), (2000, [3e17] * 6), (2001, [1e17] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = {}
    for r in topk_search.top_k(spark, df, every=50, k=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ints = {i: [int(np.floor(1024 * c)) for c in v] for i, v in enumerate(x.tolist())}
    top, least = (1 << 63) - 1, -(1 << 63)
    ints |= {2000: [top] * 6 if 1024 * 3e17 > top else [int(1024 * 3e17)] * 6, 2001: [min(top, int(1024 * 1e17))] * 6}
    assert set(got) == {*range(0, 450, 50), 2000}
    for q, found in got.items():
        score = {i: max(least, min(top, sum(a * b for a, b in zip(ints[q], v, strict=True)))) for i, v in ints.items() if i != q}
        best = sorted(score, key=lambda i: (-score[i], i))[:10]
        assert sorted(found) == [(k + 1, i, score[i]) for k, i in enumerate(best)]
    assert topk_search.top_k(spark, df.limit(0)).count() == 0


def test_license(spark, docs, empty):
    rows = [
        (0, "Under the MIT License. GNU general-public LICENSE! cc by cc by"), (1, None), (2, ""), (3, "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\nrest"),
        (4, "spdx-license-identifier: GPL-3.0-only AND\n"), (5, "SPDX-License-Identifier: MIT */ gnu gnu general public license"), (6, "mit licenses, xmit license; mit-license"), (6, "mit license"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit(1))
    got = {(r.doc_id, r.n_words): r for r in license_scan.license_scan(df).collect()}
    a = got[0, 12]
    assert (a.n_base, a.first_word, a.last_word, a.base_labels) == (4, 2, 10, "cc-by,gpl,mit")
    assert (got[1, 0].n_base, got[1, 0].first_word, got[1, 0].base_labels, got[1, 0].score) == (0, None, "", 0.0)
    b = next(r for r in got.values() if r.doc_id == 3)
    assert b.expressions == ["mit apache-2.0 or gpl-2.0-only classpath-exception-2.0 with and"] and b.permissive is False and b.labels == "spdx:apache-2.0,spdx:gpl-2.0-only,spdx:mit"
    assert next(r for r in got.values() if r.doc_id == 4).score == 0.5
    c = next(r for r in got.values() if r.doc_id == 5)
    assert c.permissive and c.base_labels == "gpl" and c.first_word == 5 and "spdx:mit" in c.labels
    assert next(r for r in got.values() if r.doc_id == 6 and r.n_words > 2).n_base == 1
    assert license_scan.license_scan(docs).count() == docs.count() and license_scan.license_scan(empty).count() == 0


def test_license_expressions():
    assert license_scan.parse(" MIT or Apache-2.0 and BSD-3-Clause") == ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]
    assert license_scan.parse("(MIT") is None and license_scan.parse("") is None and license_scan.parse("AND MIT") is None
    assert license_scan.permitted(license_scan.parse("GPL-2.0+ OR MIT")) and not license_scan.permitted(license_scan.parse("GPL-2.0 AND MIT"))


def test_urls(spark):
    link = '<html><LINK rel="canonical" href="{}"></html>'
    rows = [
        (0, "http://A.Example.org/es/1?x#y", None), (1, "https://example.org/en/12", ""), (2, "https://x.com/de/1", link.format("https://alias.net/a")), (3, "http://alias.net/a", "<p>"),
        (4, "http://other.net/b", link.format("/a?x=1&amp;y=2")), (5, None, None), (6, "no scheme", link.format("https://x.com/de/1")), (7, "http://org/", "x"), (8, "http://free.com/fr/x", link.format("//both.net/z")),
        (9, "http://both.net/z", '<meta http-equiv="Refresh" content="0; url=https://x.com/de/9">'), (10, "http://host.com", None), (3, "http://alias.net/a", "<p>"), (11, "http://alias.net/a#frag", None), (12, "http://deep.net/p/q", link.format("r")), (13, "http://deep.net/p/r", link.format("https://y.com/de/")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("verdict", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(spark, df).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("x.com", "/de/1", "com/de/", "block") and got[3] == ("alias.net", "/a", None, "block") and got[11][3] == "block"
    assert got[4] == ("other.net", "/b", None, "allow") and got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow")
    assert got[7][3] == "allow" and got[9] == ("both.net", "/z", None, "allow") and got[10] == ("host.com", "", None, "allow")
    assert got[12] == ("deep.net", "/p/q", None, "block")
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert {r[0]: r[1:] for r in con.execute("SELECT page_id, host, path, rule, verdict FROM (" + url_filter.oracle_sql() + ")").fetchall()} == got
    more = spark.createDataFrame([("http://other.net/b", "https://x.com/de/1")], "from_url string, to_url string")
    assert {r.page_id: r.verdict for r in url_filter.url_filter(spark, df, redirects=more).collect()}[4] == "block"
    assert url_filter.url_filter(spark, df.limit(0)).count() == 0


def waterfill(children, budget):
    """children: {name: (has, weight)}; shares by weight, at most what each has, in real numbers."""
    got, open_ = dict.fromkeys(children, 0.0), set(children)
    while open_ and budget > 1e-9:
        unit = budget / sum(children[c][1] for c in open_)
        full = {c for c in open_ if children[c][0] - got[c] <= unit * children[c][1] + 1e-9}
        for c in full or open_:
            add = min(children[c][0] - got[c], unit * children[c][1])
            got[c] += add
            budget -= add
        open_ -= full
        if not full:
            break
    return got


def test_mixing(spark, docs, texts, empty):
    weights = {"lang": {"en": 3}, "domain": {"d0": 2, "d1": 5}, "source": {}}
    got = mixing.mix(spark, docs, weights=weights, epochs=2, per_mille=700).collect()
    leaves = {}
    for i, t in texts:
        n = len(BLANK.findall(t or ""))
        if n:
            source = f"src{(i or 0) % 4}" if (i or 0) % 5 else None
            key = (f"d{int(source[3:]) % 4}" if source else "-", "en" if (i or 0) % 3 else "-", source or "-")
            leaves[key] = leaves.get(key, 0) + n
    total = sum(leaves.values())
    w = lambda level, name: weights[level].get(name, 1)
    group = lambda k, prefix: {x[: k + 1]: sum(v for y, v in leaves.items() if y[: k + 1] == x[: k + 1]) * 2 for x in leaves if x[:k] == prefix}
    want = {}
    for d, bd in waterfill({d: (h, w("domain", d[0])) for d, h in group(0, ()).items()}, total * 700 // 1000).items():
        for ln, bl in waterfill({x: (h, w("lang", x[1])) for x, h in group(1, d).items()}, bd).items():
            for s, bs in waterfill({x: (h, w("source", x[2])) for x, h in group(2, ln).items()}, bl).items():
                want[s] = bs
    taken = {}
    for r in got:
        taken[r.domain, r.lang, r.source] = taken.get((r.domain, r.lang, r.source), 0) + r.take_tokens
    assert abs(sum(taken.values()) - total * 700 // 1000) <= len(leaves)
    for leaf, budget in want.items():
        assert abs(taken.get(leaf, 0) - budget) <= 4, leaf
    assert sum(r.take_tokens < r.n_tokens for r in got) <= len(leaves)
    assert mixing.mix(spark, empty).count() == 0
    some = mixing.select_mixture(spark, docs, weights=weights, per_mille=500)
    assert some.columns == docs.columns and 0 < some.count() < docs.count()


def test_token_counts(spark, texts, empty):
    path = tokenizer_path("word_bpe_49k.json")
    coder = TextTokenizer(path)
    count = lambda t: len(coder.encode(t)) // 4
    rng = random.Random(8)
    rows, want = [], []
    for k, (i, t) in enumerate(texts):
        edits, now = [], t or ""
        for _ in range(rng.randint(0, 4)):
            pos, cut, put = rng.randint(-3, len(now) + 5), rng.randint(0, 60), rng.choice(["", "xy", " a b\nc ", "longword" * 3, "w " * 300])
            edits.append((pos, cut, put))
            p = min(max(pos, 0), len(now))
            now = now[:p] + put + now[p + cut :]
        rows.append((k, t, edits or None))
        want.append((k, count(t or ""), count(now), now))
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<pos: long, cut: long, put: string>>").withColumn("n_tokens", F.lit(1))
    first = token_counts.count_tokens(df, path, edits_col="edits")
    got = sorted(first.collect())
    assert [(r.doc_id, r.n_tokens, r.n_edited, r.text) for r in got] == want
    again = sorted(token_counts.count_tokens(first.withColumn("edits", F.expr("array(struct(0L AS pos, 1L AS cut, 'q' AS put))")), path, state_col="state", edits_col="edits").collect())
    assert [(r.n_tokens, r.n_edited) for r in again] == [(w[2], count("q" + w[3][1:])) for w in want]
    assert all(r.n_encoded <= 2 for r in again)
    assert token_counts.count_tokens(empty, path).count() == 0
