"""Agreement of the training-data queries with their SQL on a small table, and of pairs with classes."""

import os

import pytest
from agreement import FOLDER, disagreement

from tidewright.llm import models, queries, truncation


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_agree_with_their_sql(spark, name):
    assert disagreement(spark, queries.QUERIES[name], queries.SQL[name]) == ""


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_found_columns(spark):
    want = {
        "p1_found": [("result_id", "bigint"), ("field", "string"), ("hop_no", "int")], "p2_found": [("term_key", "string"), ("mark", "string")],
        "p3_found": [("result_id", "bigint"), ("original_at", "int"), ("hop_at", "int")], "p4_found": [("result_id", "bigint"), ("field", "string"), ("hop_no", "int"), ("sent_at", "int")],
        "p5_found": [("field", "string"), ("hop_no", "int"), ("result_a", "bigint"), ("result_b", "bigint")], "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    }
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, FOLDER).dtypes == columns


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_models_are_fitted_once(spark, tmp_path, monkeypatch):
    found = lambda folder: sorted(map(repr, queries._scored(spark, FOLDER, folder).collect()))
    first = found(str(tmp_path))
    assert {p.name for p in tmp_path.iterdir()} == {"splitter", "tables", "truncation"}
    monkeypatch.setattr(truncation, "train", None)  # nothing is fitted again
    assert found(str(tmp_path)) == first
    with pytest.raises(ValueError, match="no model"):
        models.load(spark, str(tmp_path / "tables"), "sentences")
