"""One JSON document read in ranges, against the parser of the whole."""

from __future__ import annotations

import json
import random

import pytest
from lakewright.sources import arrays


def document(seed: int, n: int, indent: int | None) -> tuple[str, list]:
    draw = random.Random(seed)
    tricky = ['","', "],[", '"list": [', "\\", '\\"', "{}", "}{", "a\\\\", "é日", "", "\n\t", '{"list":[1,2]}', "[" * 5]
    items = []
    for i in range(n):
        text = "".join(draw.choice(tricky) for _ in range(draw.randint(0, 4)))
        items.append(draw.choice([{"name": text, "list": [i, [text]]}, text, i, None, [], {}, {"a": {"list": [text]}}]))
    root = {"list of": 'x "list": [', "inner": {"list": [9, 9]}, 'odd\\"list': [7], "list": items, "after": [1, {"list": [3]}], "z": "]"}
    return json.dumps(root, indent=indent, ensure_ascii=draw.random() < 0.5), items


@pytest.mark.parametrize("block", [64, 1 << 22])
def test_ranges_without_spark(tmp_path, monkeypatch, block):
    monkeypatch.setattr(arrays, "BLOCK_BYTES", block)
    for seed, n, indent, split in [(1, 40, None, 37), (2, 60, 2, 61), (3, 0, None, 11), (4, 1, 1, 5), (5, 80, None, 1), (6, 30, 3, 100_000)]:
        text, items = document(seed, n, indent)
        path = tmp_path / f"{seed}.json"
        path.write_text(text, encoding="utf-8")
        size = path.stat().st_size
        summaries = [arrays._summary(str(path), k, min(k + split, size), "list") for k in range(0, size, split)]
        states = arrays._states(summaries, str(path))
        assert [json.loads(e) for s in states for e in arrays._elements(s)] == items


def test_array_elements(spark, tmp_path):
    want = []
    for seed in (11, 12, 13):
        text, items = document(seed, 200, seed % 2)
        (tmp_path / f"d{seed}.json").write_text(text, encoding="utf-8")
        want += items
    (tmp_path / "none.json").write_text('{"other": [1, 2]}')
    (tmp_path / "_SUCCESS").write_text("")
    df = arrays.array_elements(spark, str(tmp_path), "list", 1000)
    assert df.rdd.getNumPartitions() > 10
    assert sorted(json.dumps(json.loads(r.element)) for r in df.collect()) == sorted(map(json.dumps, want))
    assert arrays.array_elements(spark, str(tmp_path), "nowhere", 1000).collect() == []
    (tmp_path / "cut.json").write_text('{"list": [1, 2')
    with pytest.raises(ValueError, match="cut off"):
        arrays.array_elements(spark, str(tmp_path), "list", 1000)
