"""Cycles of the package index, one of which dies between its steps."""

from __future__ import annotations

import json

import pytest
from lakewright.streaming import cycle


def _land(folder, name: str, rows: list[dict]) -> None:
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))


def _run(spark, base, write=None):
    names = spark.readStream.schema("name string, landed_at timestamp").option("maxFilesPerTrigger", 1).json(str(base / "names"))
    cycle.follow(names, str(base / "counts"), str(base / "texts"), f"file://{base}/table", str(base / "checkpoint"), top=2).awaitTermination()
    return sorted(tuple(r) for r in cycle.index(spark, f"file://{base}/table").collect())


def test_a_cycle_that_dies_runs_again(spark, tmp_path, monkeypatch):
    at = lambda k: f"2024-01-01T00:00:{k:02d}Z"
    results = []
    for broken in (None, "changed", "written"):
        base = tmp_path / str(broken)
        base.mkdir()
        _land(base / "names", "1", [{"name": n, "landed_at": at(1)} for n in ("Flask", "b", "b", "c")])
        _land(base / "counts", "1", [{"name": "flask", "downloads": 5}, {"name": "b", "downloads": 9}, {"name": "c", "downloads": 1}, {"name": "c", "downloads": 2}])
        _land(base / "texts", "1", [{"name": n, "summary": f"about {n}"} for n in ("Flask", "b", "c", "e")])
        first = _run(spark, base)
        assert first == [("Flask", "about Flask", 5), ("b", "about b", 9), ("c", "", 2)]
        _land(base / "names", "2", [{"name": n, "landed_at": at(2)} for n in ("b", "d", "e")])
        _land(base / "counts", "2", [{"name": "e", "downloads": 70}, {"name": "c", "downloads": 80}])
        if broken:
            whole = cycle.changed

            def dies(*args, at=broken, base=base):
                if at == "changed":
                    raise RuntimeError("gone")
                number = len(list((base / "table").glob("cycle=*")))  # cycles without a name count, too
                args[0].sparkSession.range(3).selectExpr("'half' AS name", "'' AS summary", "id AS downloads").write.parquet(f"file://{base}/table/cycle={number}")
                raise RuntimeError("gone with half of its files")

            monkeypatch.setattr(cycle, "changed", dies)
            with pytest.raises(Exception, match="gone"):
                _run(spark, base)
            monkeypatch.setattr(cycle, "changed", whole)
        results.append(_run(spark, base))
    assert results[0] == results[1] == results[2] == [("Flask", "about Flask", 5), ("b", "about b", 9), ("c", "about c", 80), ("d", "", 0), ("e", "about e", 70)]
