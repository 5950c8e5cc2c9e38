"""Registered queries with SQL, on a small table."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from check import compare, duck  # noqa: E402

from alertsieve.llm.queries import LLM_ORACLE, LLM_QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_query_equals_sql(spark, name):
    if LLM_ORACLE[name]:
        assert compare(spark, duck("/root/testdata/sf0.001"), name, LLM_QUERIES[name], LLM_ORACLE[name], "/root/testdata/sf0.001") is None
