"""docstring_style judges whole texts, not their first characters."""

from __future__ import annotations

from lakewright.plans.catalog import QUERIES


def test_whole_texts(spark, tmp_path):
    long = "words " * 20
    rows = [(3, long + "\n\nArgs:\n    a: b"), (7, long + "\n\nParameters\n----------\na : int"), (11, long)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.style for r in QUERIES["docstring_style"](spark, str(tmp_path)).collect()}
    assert got == {3: "google", 7: "numpy", 11: "plain"}
