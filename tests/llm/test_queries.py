"""The queries of this subpackage on the smallest tables."""

from __future__ import annotations

import pytest
from lakewright.llm.queries import ORACLE_SQL, QUERIES

from tests.compare import database, rows

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    1: "page_id host path rule verdict", 2: "doc_id start length ids_crc32 doc_tokens sequence_id offset", 3: "doc_id fingerprint component_id", 4: "doc_id held_out lang_pred score",
    5: "vec_id n_links component_id kept", 6: "doc_id n_words n_base first_word last_word base_labels labels score", 7: "query_id rank vec_id score", 10: "doc_id n_words n_removed kept_sha256",
    11: "doc_id n_bytes n_removed n_spans kept_sha256", 12: "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256", 13: "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    got = df.collect()
    assert got
    assert set(COLUMNS.get(int(name[2:].split("_")[0]), "").split()) <= set(df.columns)
    if name in ORACLE_SQL:
        found = database(FOLDER).execute(ORACLE_SQL[name])
        columns = [c[0] for c in found.description]
        assert sorted(df.columns) == sorted(columns) and rows(df.columns, got) == rows(columns, found.fetchall())
