"""Each registered query against its SQL; those without have their values tested in test_candidates, test_fuzzy_all and
test_search_indexes."""

from __future__ import annotations

import pytest

from tessera.plans.registry import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, same_rows):
    query, sql = QUERIES[name]
    df = query(spark, sf_dir)
    if sql:
        same_rows(df, sql)
    else:
        assert df.columns and not df.isEmpty()
