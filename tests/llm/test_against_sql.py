"""Every training-data query that SQL can express against its SQL, on the smallest tables."""

import os

import pytest

from marginalia.llm import queries
from tests.oracle import compare

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    assert compare(queries.QUERIES[name], queries.ORACLE[name], spark, SF_DIR) == []


def test_entry_has_all_queries():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {n.split("_")[0] + "_" for n in names if n[:2] == "op" and n[2].isdigit()}
    assert "pipeline" in names
