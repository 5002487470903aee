"""Joins of words are never broadcast, however small their files."""

from __future__ import annotations

from tessera.llm import variants


def test_tables_of_words_are_not_broadcast(spark):
    words = spark.createDataFrame([("letters", 50), ("leters", 5), ("lettersx", 6), ("another", 9)], "word string, n long")
    grouped = variants.grouped(words)
    assert {r["word"]: r["form"] for r in grouped.collect()} == {"letters": None, "leters": "letters", "lettersx": "letters", "another": None}
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
