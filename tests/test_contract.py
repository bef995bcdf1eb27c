"""The driver's contract: names, signatures, and agreement of the core queries with their SQL on a small table."""

import os

import pytest
from agreement import FOLDER, disagreement

import __spark_entry__ as entry
from tidewright.plans import catalog


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100 and all(callable(f) for f in entry.queries().values())


def test_optional_part_is_not_imported_by_the_rest():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "tidewright"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not any("import" in x and "llm" in x.split() or ".llm" in x for x in p.read_text().splitlines())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_queries_agree_with_their_sql(spark, name):
    assert disagreement(spark, catalog.QUERIES[name], catalog.SQL[name]) == ""
