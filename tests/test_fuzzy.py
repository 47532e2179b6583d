"""Fuzzy search through grams against scoring every symbol, and prefixes of many at once."""

from __future__ import annotations

import random

import pytest
from lakewright.operators import fuzzy, symbols, variants
from pyspark.sql import functions as F
from pyspark.sql import types as T


def test_near_equals_the_scan(spark):
    draw = random.Random(3)
    word = lambda n: "".join(draw.choices("abcX_", k=draw.randint(0, n)))
    rows = list({(f"{word(5)}.{word(7)}", word(7)) for _ in range(150)}) + [("aaaa.aaaa", "aaaa"), (None, "a"), ("b", None), ("", ""), ("É.é", "é")]
    asked = [word(9) for _ in range(40)] + ["a", "", None, "aaaa", "AAAA", "é", ".a", "%", "x_"]
    table, queries = spark.createDataFrame(rows, "path string, name string").cache(), spark.createDataFrame([(q,) for q in asked], "query string")
    for threshold in (0.4, 0.0, 0.25):
        got = {(r.query, r.path, r.name): round(r.score, 9) for r in fuzzy.near(table, queries, threshold).collect()}
        want = {}
        off = lambda c: F.levenshtein(F.lower(c), F.lower("query")) / F.greatest(F.length(c), F.length("query"), F.lit(1))
        score = F.when(F.lower("path").contains(F.lower("query")), 0.0).otherwise(F.least(off("name"), off("path")))
        for r in table.crossJoin(F.broadcast(queries.filter("query <> ''").distinct())).withColumn("score", score).filter(F.col("score") <= threshold).collect():
            want[(r["query"], r.path, r["name"])] = round(r.score, 9)
        assert got == want
    with pytest.raises(ValueError):
        fuzzy.near(table, queries, 0.5)


def test_near_compares_few(spark):
    """Candidates of a hundred queries are a small part of all pairs, and no join of the plan compares all."""
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(6, 12)))
    table = spark.createDataFrame([(f"{word()}.{word()}", word()) for _ in range(2000)], "path string, name string")
    queries = spark.createDataFrame([(word(),) for _ in range(100)], "query string")
    plan = fuzzy.near(table, queries)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_near_deals_pairs_to_many_tasks(spark):
    """A table that comes as one partition is still compared by many tasks, and no row of the plan is counted by grams."""
    table = spark.createDataFrame([("pkg.a.n1", "n1")], "path string, name string").coalesce(1)
    plan = fuzzy.near(table, table.select(F.col("name").alias("query")))._jdf.queryExecution().executedPlan().toString()
    assert f", {4 * fuzzy.PARTS}), REPARTITION_BY_NUM" in plan and "count(" not in plan.replace("bit_count(", "").split("SortMergeJoin [part")[1].split("Aggregate")[0]


def test_near_neither_moves_nor_counts_answers(spark):
    """Above the join of blocks there is no exchange, sort or aggregate: a symbol and a query meet in one place only."""
    table = spark.createDataFrame([("pkg.a.n1", "n1")], "path string, name string")
    plan = fuzzy.near(table, table.select(F.col("name").alias("query")))._jdf.queryExecution().executedPlan().toString()
    above = plan.split("SortMergeJoin [part")[0]
    assert "Aggregate" not in above and "Exchange" not in above and "Sort [" not in above


def test_near_of_long_texts_and_small_blocks(spark, monkeypatch):
    """Queries of any length, in 8, 16, 32, 64 bits and beyond, rows that are there twice, names in two cases, other columns."""
    monkeypatch.setattr(fuzzy, "SYMBOLS", 7)
    monkeypatch.setattr(fuzzy, "QUERIES", 5)
    draw = random.Random(11)
    base = ["".join(draw.choices("abé.\n😀", k=n)) for n in (3, 8, 9, 16, 17, 31, 32, 33, 63, 64, 65, 66, 90, 200)]

    def edited(text: str) -> str:
        for _ in range(draw.randint(0, len(text) // 2)):
            k = draw.randrange(len(text) + 1)
            text = text[:k] + draw.choice(["", "a", "Z"]) + text[k + draw.randint(0, 1) :]
        return text

    rows = [(edited(draw.choice(base)) + "." + edited(b), edited(b), k % 3) for k, b in enumerate(base * 5)] + [("x" + base[-1], None, 1), ("A.B", "B", 0), ("a.b", "b", 0)]
    asked = [edited(b) for b in base for _ in range(3)] + [base[-1], base[-3][5:], "B", "b"]
    table, queries = spark.createDataFrame(rows + rows[:9], "path string, name string, ord int").cache(), spark.createDataFrame([(q,) for q in asked], "query string")
    got = sorted((r.query, r.path, r.name or "", r.ord, round(r.score, 9)) for r in fuzzy.near(table, queries).collect())
    off = lambda c: F.levenshtein(F.lower(c), F.lower("query")) / F.greatest(F.length(c), F.length("query"), F.lit(1))
    score = F.when(F.lower("path").contains(F.lower("query")), 0.0).otherwise(F.least(off("name"), off("path")))
    want = table.distinct().crossJoin(F.broadcast(queries.filter("query <> ''").distinct())).withColumn("score", score).filter(F.col("score") <= 0.4).collect()
    assert got == sorted((r["query"], r.path, r["name"] or "", r.ord, round(r.score, 9)) for r in want)


def test_below_each(spark):
    rows = spark.createDataFrame([("a", 1), ("a.b", 2), ("a.b.c", 3), ("a.bc", 4), ("d.e", 5), ("", 6)], "path string, ord int")
    aliases = spark.createDataFrame([("x.one", "a.b"), ("a.b.two", "d.e"), ("x.lost", "z")], "path string, target string")
    asked = ["a", "a.b", "x", "a.b.c.d", "", "d"]
    df = symbols.below_each(rows, aliases, spark.createDataFrame([(p,) for p in asked * 2], "prefix string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("NestedLoop") + plan.count("Cartesian") <= 2  # with the one row of the empty prefix
    got = sorted((r.prefix, r.path, r.via or "") for r in df.collect())
    assert got == sorted((p, r.path, r.via or "") for p in asked for r in symbols.below(rows, aliases, p).collect())


def test_below_each_of_crowded_prefixes(spark, monkeypatch):
    """Paths above many rows are met where the rows are, and neither they nor the prefixes fill one task."""
    rows = spark.createDataFrame([(f"p.m{k % 3}.n{k}", k) for k in range(30)] + [("p.m1", 30), ("q", 31), ("q", 32), (None, 33)], "path string, ord int")
    aliases = spark.createDataFrame([(f"p.al{k}", f"p.m{k % 3}.n{k}") for k in range(9)] + [("r.x", None)], "path string, target string")
    asked = ["p", "p.m1", "p.m2.n2", "q", "r", "p.m"]
    for hot in (1 << 16, 4):
        monkeypatch.setattr(symbols, "HOT", hot)
        df = symbols.below_each(rows, aliases, spark.createDataFrame([(p,) for p in asked * 2], "prefix string"))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [prefix" in plan and "REPARTITION_BY_NUM" in plan
        got = sorted((r.prefix, r.path, r.via or "", r.ord) for r in df.collect())
        assert got == sorted((p, r.path, r.via or "", r.ord) for p in asked for r in symbols.below(rows, aliases, p).collect())


def test_deviations(spark):
    rows = ['{"a": 1, "b": {"c": [1, 2]}, "m": {"x": 1.5}}', '{"a": "t", "b": {"c": [], "d": null}, "m": {"y": 2}}', "broken", None]
    docs = spark.createDataFrame([(r,) for r in rows], "s string").select(variants.parsed(F.col("s")).alias("doc"))
    found = variants.found_schema(docs, "doc").first()
    assert (found.documents, found.broken) == (4, 2)
    contract = T._parse_datatype_string("a bigint, b struct<c: array<bigint>>, m map<string, double>, e string")
    got = sorted(variants.deviations(found.schema, contract))
    assert got == [("$.a", "changed", "bigint", "variant"), ("$.b.d", "unknown", "", "void"), ("$.e", "missing", "string", "")]
