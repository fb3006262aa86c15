"""Queries with SQL, against it."""

from __future__ import annotations

import pytest

from oracle import compare, duck
from sessionmeter.llm import queries, sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(sql.ORACLE))
def test_query(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), duck(SF), sql.ORACLE[name]) == ""
