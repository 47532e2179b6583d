"""Archives, dumps, streams."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from datetime import date

import numpy as np
import pytest
from lakewright.operators import graph, text_sinks, vulns
from lakewright.sources import archives, dumps, ranges
from lakewright.streaming import sync
from pyspark.sql import functions as F


@pytest.fixture
def landed(tmp_path):
    with zipfile.ZipFile(tmp_path / "a-1.0-py3-none-any.whl", "w") as z:
        z.writestr("a/__init__.py", "X = 1\n")
        z.writestr("a/py.typed", "")
        z.writestr("a/__pycache__/x.py", "")
        z.writestr("../evil.py", "")
        z.writestr("a-1.0.dist-info/top_level.txt", "a\n")
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w:gz") as t:
        for name in ("b-1.0/setup.py", "b-1.0/src/b/__init__.py", "b-1.0/src/b/c.py"):
            info = tarfile.TarInfo(name)
            info.size = 2
            t.addfile(info, io.BytesIO(b"1\n"))
    (tmp_path / "b-1.0.tar.gz").write_bytes(data.getvalue())
    (tmp_path / "broken-1.0-py3-none-any.whl").write_bytes(b"no zip")
    return str(tmp_path)


def test_archives(spark, landed):
    rows = archives.archives(spark, landed)
    assert rows.count() == 3
    got = {(r.archive, r.path): (r.top_level, r.typed) for r in archives.source_files(rows).collect()}
    assert got == {("a-1.0-py3-none-any.whl", "a/__init__.py"): (["a"], True), ("b-1.0.tar.gz", "b/__init__.py"): (["b"], False), ("b-1.0.tar.gz", "b/c.py"): (["b"], False)}
    assert archives.weigh(b"no zip") == 36


def test_dumps(spark, tmp_path):
    (tmp_path / "index.json").write_text(json.dumps({"meta": {"x": 1}, "projects": [{"name": "Valve"}, {"name": "Boiler2", "y": 1}]}))
    assert [r.name for r in dumps.name_index(spark, str(tmp_path / "index.json")).collect()] == ["Valve", "Boiler2"]
    (tmp_path / "cut.json").write_text('{"projects": [{"name": "a"}, {"na')
    with pytest.raises(Exception):  # noqa: B017
        dumps.name_index(spark, str(tmp_path / "cut.json")).collect()
    (tmp_path / "top.json").write_text(json.dumps({"rows": [{"project": "a", "download_count": 5}]}))
    assert dumps.top_packages(spark, str(tmp_path / "top.json")).first().downloads == 5
    doc = {"info": {"name": "a", "version": "1.0", "license": "MIT", "requires_python": ">=3.8", "requires_dist": ["x>=1", 'y ; extra == "e"'], "project_urls": {"Source": "https://github.com/o/r", "Bad": "javascript:x"}},
           "releases": {"1.0": [{"filename": "a-1.0.tar.gz", "size": 7, "packagetype": "sdist", "digests": {"sha256": "00"}}]}, "urls": []}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    documents = dumps.packages(spark, str(tmp_path / "a.json"))
    assert [(r.package, r.version, r.size, r.sha256) for r in dumps.release_files(documents).collect()] == [("a", "1.0", 7, "00")]
    row = dumps.package_row(documents, date(2024, 6, 1))
    got = row.first()
    assert len(row.columns) >= 23 and (got.install_size, got.module_format, got.platforms, got.releases_last_12mo) == (0, "sdist-only", None, None)
    assert (got["license"], got.python_min, got.repo_url, got.dependencies.required[0].constraint, list(got.dependencies.extras)) == ("MIT", "3.8", "https://github.com/o/r", ">=1", ["e"])
    assert text_sinks.package_text(row).first().text == "name: a\nversion: 1.0\nlicense: MIT\npython_min: 3.8\nrequires: x >=1\nextras: e\nrepo_url: https://github.com/o/r"
    (tmp_path / "pkg.json").write_text(json.dumps({"vulns": [{"id": "V1", "affected": [{"ranges": [{"type": "ECOSYSTEM", "events": [{"introduced": "0"}, {"fixed": "7.19.0"}]}]}]}]}))
    v = vulns.flatten(dumps.vulnerabilities(spark, str(tmp_path / "pkg.json")), ["package"]).first()
    assert (v.package, v.affected_range, v.fixed_in, v.severity) == ("pkg", ">=0, <7.19.0", "7.19.0", "Unknown")
    (tmp_path / "s.json").write_text(json.dumps({"package": "a", "type": "system", "data": [{"category": "Linux", "date": "2024-01-02", "downloads": 3}, {"category": "null", "date": "bad", "downloads": 1}]}))
    assert [(r.category, str(r.day)) for r in dumps.downloads(spark, str(tmp_path / "s.json")).collect()] == [("Linux", "2024-01-02"), ("null", "None")]


def test_graph_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 4)], "child long, parent long")
    assert sorted(r.node for r in graph.closure(edges, spark.createDataFrame([(3,)], "node long")).collect()) == [1, 2, 3]
    defs = spark.createDataFrame([("b", "x")], "module string, name string")
    imps = spark.createDataFrame([("a", "x", "b", "x"), ("c", None, "a", None), ("d", "y", "e", "y"), ("e", "y", "d", "y")], "module string, bound string, source string, name string")
    want = spark.createDataFrame([("a", "x"), ("c", "x"), ("d", "y"), ("b", "x")], "module string, name string")
    assert sorted((r.module, r.def_module, r.hops) for r in graph.lookup(defs, imps, want).collect()) == [("a", "b", 1), ("b", "b", 0), ("c", "b", 2)]


def test_sync(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    table = sync.PackageTable(spark, f"file://{tmp_path}/packages")
    for batch in (["Valve", "valve", "piston"], ["piston", "boilers"]):
        (land / f"{len(list(land.iterdir()))}.json").write_text("\n".join(json.dumps({"name": n}) for n in batch))
        sync.sync_names(spark.readStream.schema("name string").json(str(land)), table, str(tmp_path / "c1")).awaitTermination()
    assert sorted(r.name for r in table.read().collect()) == ["Valve", "boilers", "piston", "valve"]
    counts = tmp_path / "counts"
    counts.mkdir()
    (counts / "0.json").write_text("\n".join(json.dumps({"name": n, "downloads": d}) for n, d in [("PISTON", 7), ("Valve", 3), ("Valve", 2), ("nope", 1)]))
    sync.sync_downloads(spark.readStream.schema("name string, downloads bigint").json(str(counts)), table, str(tmp_path / "c2")).awaitTermination()
    assert {r.name: r.downloads for r in table.read().collect()} == {"Valve": 3, "piston": 7, "valve": 0, "boilers": 0}


def _stream(spark, tmp_path, rows, schema, f):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("\n".join(json.dumps(r) for r in rows))
    name = "t" + tmp_path.name.replace("-", "_")
    q = f(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    return spark.table(name).orderBy("id").collect()


def test_token_bucket(spark, tmp_path):
    rows = [{"key": "a", "ts": 0.0, "id": i} for i in range(5)] + [{"key": "a", "ts": 1.0, "id": 5}]
    got = _stream(spark, tmp_path, rows, "key string, ts double, id long", lambda s: sync.rate_limited(s, rate=1, burst=3, idle_ms=None))
    assert [r.allowed for r in got] == [True, True, True, False, False, True]


def test_ttl(spark, tmp_path):
    rows = [{"key": "a", "ts": 0.0, "id": 0}, {"key": "a", "ts": 1.0, "id": 1, "value": "v"}, {"key": "a", "ts": 2.0, "id": 2}, {"key": "a", "ts": 99.0, "id": 3}]
    got = _stream(spark, tmp_path, rows, "key string, ts double, id long, value string", lambda s: sync.cached_reads(s, 10))
    assert [(r.value, r.fresh) for r in got] == [(None, False), ("v", True), ("v", False)]


def test_breaker(spark, tmp_path):
    oks = [(0, False), (1, False), (2, True), (40, False), (41, True), (80, True), (81, True)]
    rows = [{"key": "a", "ts": float(t), "id": i, "ok": ok} for i, (t, ok) in enumerate(oks)]
    got = _stream(spark, tmp_path, rows, "key string, ts double, id long, ok boolean", lambda s: sync.guarded(s, failures=2, cooldown=30))
    assert [(r.allowed, r.state) for r in got] == [(True, "closed"), (True, "open"), (False, "open"), (True, "open"), (False, "open"), (True, "closed"), (True, "closed")]


def test_compare_text(spark):
    df = spark.createDataFrame([(0, "boilers", "4.11.2", "Steam engines of every gauge there is")], "ord int, name string, version string, summary string")
    for m in text_sinks.METRICS:
        if m not in df.columns:
            df = df.withColumn(m, F.lit(None).cast("string"))
    lines = [r.line for r in text_sinks.compare_text(df).orderBy("ord").collect()]
    assert lines[0] == "| metric             | boilers |" and lines[3] == "| summary            | Steam engines of every gaug… |"


def test_cut_archives_say_so(spark, landed, monkeypatch):
    monkeypatch.setattr(archives, "MOST_FILES", 1)
    files, cut = archives.read_sdist(open(f"{landed}/b-1.0.tar.gz", "rb").read(), "b-1.0.tar.gz")
    assert cut and len(files) <= 1
    assert archives.read_wheel(open(f"{landed}/a-1.0-py3-none-any.whl", "rb").read())[3] is False
    assert archives.read_wheel(open(f"{landed}/a-1.0-py3-none-any.whl", "rb").read(), archives.STUBS)[0] == {}
    assert {r.weight for r in archives.weighed(archives.archives(spark, landed)).collect() if r.archive.startswith("broken")} == {36}


def test_ranges(spark, tmp_path):
    data = np.random.default_rng(1).integers(0, 256, 12 << 20, dtype=np.uint8).tobytes()
    f = ranges.RangeFile(len(data), lambda a, b: data[a:b])
    assert f.requests == 1
    f.seek(1 << 20)
    got = b"".join(iter(lambda: f.read(64 << 10) if f.at < 5 << 20 else b"", b""))
    assert got == data[1 << 20 : 5 << 20] and f.requests <= 7  # sixteen blocks after the tail
    f.seek(-100, 2)
    assert f.read(200) == data[-100:] and f.requests <= 7
    with zipfile.ZipFile(tmp_path / "big-1.0-py3-none-any.whl", "w") as z:
        z.writestr("big/data.bin", data)
        z.writestr("big/__init__.py", "X = 1\n")
        z.writestr("big-1.0.dist-info/top_level.txt", "big\n")
    paths = spark.createDataFrame([(f"{tmp_path}/big-1.0-py3-none-any.whl",), (f"{tmp_path}/none.whl",)], "path string")
    assert [(r.path, bytes(r.content), r.top_level, r.truncated) for r in archives.listed_files(paths).collect()] == [("big/__init__.py", b"X = 1\n", ["big"], False)]


def test_releases_of_each_repository(spark, tmp_path):
    for repo, n in (("one", 130), ("two", 3)):
        (tmp_path / f"{repo}.json").write_text(json.dumps([{"tag_name": f"v{n - i}.0" if i % 2 else f"nightly{i}", "name": "t", "draft": i == 1, "commit": {"sha": f"s{i}"}} for i in range(n)]))
    (tmp_path / "gone.json").write_text('{"message": "Not Found"}')
    got = dumps.forge_releases(spark, str(tmp_path))
    assert {r.repo: r["count"] for r in got.groupBy("repo").count().collect()} == {"one": 100, "two": 3}
    assert [(r.version, r.tag_name) for r in got.filter("repo = 'two'").orderBy("ord").collect()] == [("nightly0", "nightly0"), ("2.0", "v2.0"), ("nightly2", "nightly2")]
    (tmp_path / "tags").mkdir()
    for repo, n in (("one", 130), ("two", 3)):
        (tmp_path / "tags" / f"{repo}.json").write_text(json.dumps([{"name": f"v{n - i}.0" if i % 2 else f"nightly{i}", "commit": {"sha": f"s{i}"}} for i in range(n)]))
    tags = dumps.forge_tags(spark, str(tmp_path / "tags"))
    assert {r.repo: r["count"] for r in tags.groupBy("repo").count().collect()} == {"one": 25, "two": 1} and tags.filter("repo = 'two'").first().sha == "s1"


def test_table_keeps_two_versions(spark, tmp_path):
    table = sync.PackageTable(spark, f"file://{tmp_path}/t", buckets=4)
    for k in range(5):
        rows = spark.createDataFrame([(f"n{i}", "", k) for i in range(k + 1)], sync.PACKAGES).withColumn("ord", F.lit(0))
        table.merge(rows, lambda old, new: old.join(new, "name", "left_anti").unionByName(new.drop("ord")))
    assert sorted((r.name, r.downloads) for r in table.read().collect()) == [(f"n{i}", 4) for i in range(5)]
    assert table.versions() == [3, 4]
    held = {(v, k) for m in (3, 4) for k, v in table.manifest(m).items()}
    there = {(int(d.parent.name), int(d.name.split("=")[1])) for d in (tmp_path / "t" / "data").glob("*/bucket=*")}
    assert there == held


def test_least_recently_used(spark, tmp_path):
    """A read keeps an entry; entries and bytes are held to their budgets; what is larger than all of it is not kept."""
    rows = [("s", 0, "put", "a", 40), ("s", 1, "put", "b", 40), ("s", 2, "get", "a", None), ("s", 3, "put", "c", 40), ("s", 4, "get", "b", None), ("s", 5, "get", "a", None), ("s", 6, "put", "d", 400), ("s", 7, "get", "d", None), ("s", 8, "put", "a", 90), ("s", 9, "get", "c", None), ("s", 10, "get", "a", None)]
    rows = [{"shard": s, "id": i, "op": op, "key": k, "size": n} for s, i, op, k, n in rows]
    got = _stream(spark, tmp_path, rows, "shard string, id long, op string, key string, size long", lambda s: sync.lru_reads(s, entries=10, budget=100))
    assert [(r.id, r.hit) for r in got] == [(2, True), (4, False), (5, True), (7, False), (9, False), (10, True)]
