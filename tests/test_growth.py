"""Steps whose work or memory must not grow faster than their tables."""

from __future__ import annotations

import io
import json
import zipfile

from lakewright.operators import exports, graph, search, symbols
from lakewright.plans import catalog, modules
from lakewright.shared import cut_lineage
from lakewright.sources import archives, arrays
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def _watched(monkeypatch, look):
    """What is looked at in each frame that the graph operators cut off."""
    seen = []

    def cut(df):
        seen.append(look(df))
        return cut_lineage(df)

    monkeypatch.setattr(graph, "cut_lineage", cut)
    return seen


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cycles_end_with_the_longest_chain(spark, monkeypatch):
    rounds = _watched(monkeypatch, lambda df: 1)
    classes = spark.range(200).selectExpr("id AS node", "CAST(NULL AS STRING) AS init", "id = 2 AS dataclass", "CAST(array() AS array<struct<name:string,value:string>>) AS fields")
    edges = spark.createDataFrame([(0, 1), (1, 0), (3, 2), (4, 3), (5, 0)], "child long, parent long")
    got = {r.node: r.origin for r in graph.constructors(classes, edges).collect()}
    assert {k: got[k] for k in range(6)} == {0: None, 1: None, 2: 2, 3: 2, 4: 2, 5: None}
    assert len(rounds) <= 8  # two for the tables, three for each of the two walks


def test_frontiers_are_not_broadcast(spark, monkeypatch):
    plans = _watched(monkeypatch, _plan)
    edges = spark.createDataFrame([(2, 1), (3, 2)], "child long, parent long")
    assert graph.closure(edges, spark.createDataFrame([(1,)], "node long")).count() == 3
    assert len(plans) > 3 and not any("BroadcastHashJoin" in p for p in plans)


def test_paths_are_resolved_without_a_broadcast(spark):
    paths = spark.createDataFrame([("a.b.c",)], "dotted string")
    found = symbols.resolve(paths, spark.createDataFrame([("a.b", "class"), ("a", "module")], "path string, kind string"))
    assert "BroadcastHashJoin" not in _plan(found)
    assert [tuple(r) for r in found.collect()] == [("a.b.c", "a.b", "class")]


def test_lookup_carries_paths_alone(spark, monkeypatch):
    columns = _watched(monkeypatch, lambda df: set(df.columns))
    known = spark.createDataFrame([("c", "x")], "module string, name string")
    imports = spark.createDataFrame([("a", "x", "b", "x"), ("b", None, "a", None), ("b", "x", "c", "x")], "module string, bound string, source string, name string")
    found = graph.lookup(known, imports, spark.createDataFrame([("a", "x")], "module string, name string"))
    assert [tuple(r) for r in found.collect()] == [("a", "x", "c", "x", 2)]
    assert not any("seen" in c for c in columns)


def test_star_sets_are_made_once(spark, monkeypatch):
    made, looked = [], []
    stars, lookup = exports.star_sets, graph.lookup
    monkeypatch.setattr(exports, "star_sets", lambda *a, **k: made.append(1) or stars(*a, **k))
    monkeypatch.setattr(graph, "lookup", lambda *a, **k: looked.append(1) or lookup(*a, **k))
    modules.settled_definitions(spark, FOLDER)
    assert (len(made), len(looked)) == (1, 0)


def test_modules_are_dealt_and_only_what_is_asked_comes_back(spark):
    for name, field in (("parse_totals", "parse_errors"), ("import_sources", "imports"), ("extract_symbols", "symbols")):
        plan = catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution()
        assert "REPARTITION_BY_NUM" in plan.executedPlan().toString()
        assert f"{field}" and "parsed#" in plan.analyzed().toString()
    from lakewright.code import extract

    parsed = extract.modules(spark.createDataFrame([("m", "x = 1")], "module string, source string"), parsed=extract.only("symbols", symbols=("path", "kind")))
    assert parsed.select("parsed.*").columns == ["symbols"] and parsed.first().parsed.symbols[0].asDict() == {"path": "m.x", "kind": "attribute"}
    for name in ("module_shapes", "stub_files", "archive_weights"):
        assert "REPARTITION_BY_NUM" in _plan(catalog.QUERIES[name](spark, FOLDER))


def test_a_range_reads_no_more_than_it_must(tmp_path, monkeypatch):
    path = tmp_path / "d.json"
    path.write_text(json.dumps({"list": list(range(200_000))}))
    size = path.stat().st_size
    states = arrays._states([arrays._summary(str(path), k, min(k + 4096, size), "list") for k in range(0, size, 4096)], str(path))
    read, blocks = [], arrays._blocks

    def counted(*args):
        for base, data in blocks(*args):
            read.append(len(data))
            yield base, data

    monkeypatch.setattr(arrays, "_blocks", counted)
    assert [int(e) for s in states[:8] for e in arrays._elements(s)] == list(range(sum(1 for s in states[:8] for _ in arrays._elements(s))))
    assert sum(read) < 2 * 8 * 4 * 4096
    assert len(arrays._Reader(states * 40).partitions()) <= arrays.MOST_TASKS


def test_small_archives_share_a_frame():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a/__init__.py", "x")
    rows = archives._rows("a-1-py3-none-any.whl", "wheel", out.getvalue(), archives.SOURCES)
    frames = list(archives._frames(iter([rows, [], rows])))
    assert [len(f) for f in frames] == [2] and frames[0]["content"].tolist() == [b"x", b"x"]
    assert list(archives._frames(iter([[], []]))) == []


def test_stems_of_a_batch(spark):
    rows = spark.createDataFrame([(1, ["running", "cats"]), (2, None), (3, []), (4, ["cats", None])], "k int, w array<string>").coalesce(1)
    got = {r.k: r.s for r in rows.filter("k > 0").select("k", search.stems(F.col("w")).alias("s")).collect()}
    assert got == {1: ["run", "cat"], 2: None, 3: [], 4: ["cat", None]}
