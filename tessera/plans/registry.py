"""All queries outside the training-data subpackage: name -> (callable, DuckDB SQL or None)."""

from __future__ import annotations

from tessera.plans import detection, feeds, markets, titles

QUERIES = {**detection.QUERIES, **titles.QUERIES, **markets.QUERIES, **feeds.QUERIES}
