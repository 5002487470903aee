"""Samples hold rare labels and are not filled by repeated rows."""

from __future__ import annotations

from tessera.llm.samples import labelled_texts


def test_rare_labels_are_drawn(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = docs.selectExpr("doc_id", "CAST(doc_id NOT IN (4001, 77, 5003) AS INT) AS quality")
    found = labelled_texts(docs, labels, 50)
    assert sorted(r["text"] for r in found if r["label"] == 0) == ["text 4001", "text 5003", "text 77"]
    assert 20 <= len(found) <= 100


def test_one_row_of_an_id(spark):
    docs = spark.range(3000).selectExpr("IF(id < 2900, 1, id) AS doc_id", "concat('text ', id % 7) AS text")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality").distinct().unionAll(spark.sql("SELECT 99999L, 1"))
    found = labelled_texts(docs, labels, 1000)
    assert len(found) == 101 and {r["label"] for r in found} == {0, 1}
    assert sorted(found) == sorted(labelled_texts(docs.repartition(5), labels, 1000))
