"""Training-data queries that SQL can express, against it."""

from __future__ import annotations

import pytest

from tessera.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(name, spark, sf_dir, same_rows):
    same_rows(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name])
