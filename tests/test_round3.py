"""Plans that stay small, results on ids and pages beyond the smallest tables, and nearest vectors of odd shapes."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import jobs, retrieve, scoped, web
from tessera.plans import titles
from tessera.plans.registry import QUERIES


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_normal_forms_are_not_repeated_in_plans(spark, sf_dir):
    q = titles._queries(spark, sf_dir)
    assert "regexp_replace" not in _plan(q.where("franchise_hint is not null and ordinal is not null"))
    assert len(_plan(QUERIES["franchise_join"][0](spark, sf_dir))) < 20_000


@pytest.mark.parametrize("name", ["candidate_coverage", "candidate_decision"])
def test_candidates_have_small_plans(spark, sf_dir, name):
    plan = _plan(QUERIES[name][0](spark, sf_dir))
    assert len(plan) < 100_000 and "regexp_replace" not in plan


@pytest.mark.parametrize("name", ["trigram_search", "plausible_pairs", "db_search_cascade"])
def test_searches_do_not_repeat_the_normal_form(spark, sf_dir, name):
    assert "germany" not in _plan(QUERIES[name][0](spark, sf_dir))


def _as_sql(name: str, folder, df) -> None:
    db = duckdb.connect()
    for p in folder.glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}/*.parquet')")
    found = db.execute(QUERIES[name][1])
    columns = [d[0] for d in found.description]
    assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*columns).collect())


def test_audit_trail_where_new_ids_meet_old_ones(spark, tmp_path):
    ids = [0, 13, 17, 34, 1_000_000, 1_000_013, 1_000_017, 1_000_034]
    part = spark.createDataFrame([(i, f"name {i % 7}", f"Brand#{i % 5}") for i in ids], "p_partkey long, p_name string, p_brand string")
    part.write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(i, f"Supplier {i}") for i in (0, 17, 34, 1_000_034)], "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    df = QUERIES["audit_trail"][0](spark, str(tmp_path))
    assert df.where("entity_id > 1000000").count() > 0
    _as_sql("audit_trail", tmp_path, df)


def test_audit_by_columns_and_by_version(spark):
    before, after = (spark.createDataFrame(rows, "id long, name string, version long") for rows in ([(1, "a", 1), (2, "b", 1), (3, "c", 1)], [(1, "x", 1), (2, "b", 2), (4, "d", 1)]))
    got = lambda **how: sorted((r["entity_id"], r["action"]) for r in jobs.audit_entries(before, after, "id", **how).collect())
    assert got() == [(1, "update"), (2, "update"), (3, "delete"), (4, "create")]
    assert got(version="version") == [(2, "update"), (3, "delete"), (4, "create")]


def test_page_parts_of_long_pages(spark, tmp_path):
    rows = [(1, "x" * 60_000 + '<meta property="og:image" content="a">'), (2, None), (3, "y" * 49_990)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    df = QUERIES["page_parts"][0](spark, str(tmp_path))
    assert {r["page_id"]: r["title"] for r in df.collect()} == {1: "End & 1", 2: "End & 2", 3: "End & 3"}
    _as_sql("page_parts", tmp_path, df)
    late = spark.createDataFrame([("x" * 60_000 + "<title>late</title>",)], "html string")
    assert late.select(web.whole_parts("html")["title"], web.parts("html")["title"]).first()[:] == ("late", None)


def _cosine(a, b):
    norm = lambda v: None if v is None or None in v else math.sqrt(sum(x * x for x in v))
    x, y = norm(a), norm(b)
    if x is None or y is None or x * y == 0:
        return 0.0
    return None if len(a) != len(b) else sum(p * q for p, q in zip(a, b, strict=True)) / (x * y)


def test_nearest_of_odd_vectors(spark, monkeypatch):
    vectors = {i: [math.sin(i), math.cos(3 * i), float(i % 4)] for i in range(30)} | {30: None, 31: [0.0, 0.0, 0.0], 32: [1.0, 2.0], 33: [], 34: [1.0, None, 2.0], 35: [1.0, 2.0, 3.0], 36: [1.0, 2.0, 3.0], 37: [2.0, 4.0, 6.0]}
    country = {i: (None, "A", "B")[i % 3] for i in vectors}
    v = spark.createDataFrame([(i, x, country[i]) for i, x in vectors.items()], "id long, v array<double>, country string")
    q = v.withColumnRenamed("id", "query_id")

    def want(k, among):
        out = []
        for a in vectors:
            near = [(b, _cosine(vectors[a], vectors[b])) for b in vectors if a != b and among(a, b)]
            near.sort(key=lambda x: (x[1] is None, -round(x[1] or 0, 9), x[0]))
            out += [(a, b, rank, None if c is None else round(c, 9) + 0.0) for rank, (b, c) in enumerate(near[:k], 1)]
        return sorted(out, key=repr)

    got = lambda df: sorted(((r["query_id"], r["id"], r["rank"], None if r["cosine"] is None else round(r["cosine"], 9) + 0.0) for r in df.collect()), key=repr)
    for block, part in ((5000, 10_000), (7, 4)):
        monkeypatch.setattr(retrieve, "NEAREST_BLOCK", block)
        monkeypatch.setattr(retrieve, "NEAREST_PART", part)
        for k in (5, 100):
            found = retrieve.nearest(q, v, k)
            assert "CoGroups" in found._jdf.queryExecution().executedPlan().toString()  # blocks of vectors meet, not rows
            assert got(found) == want(k, lambda a, b: True)
        own = retrieve.nearest(q, v, 5, by="country")
        assert got(own) == sorted((r for r in want(5, lambda a, b: country[a] is not None and country[a] == country[b])), key=repr)
    there = scoped.nearest(q, v, 3)
    assert there.where(F.col("query_id") == 30).count() == 0


def test_nearest_of_no_rows(spark):
    v = spark.createDataFrame([(1, [1.0])], "id long, v array<double>")
    q = v.withColumnRenamed("id", "query_id")
    assert retrieve.nearest(q, v.where("id > 1")).count() == retrieve.nearest(q.where("query_id > 1"), v).count() == retrieve.nearest(q, v).count() == 0
