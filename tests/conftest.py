"""One local session for all tests, and the comparison of a query with its SQL."""

from __future__ import annotations

import math
import os
import tempfile
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession

SMALL = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return str(SMALL)


@pytest.fixture(scope="session")
def duck():
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for p in sorted(SMALL.glob("*.parquet")):
        files = f"{p}/*.parquet" if p.is_dir() else str(p)
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{files}')")
    return db


def _plain(v: object) -> object:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


def _sorted(rows: list[tuple]) -> list[tuple]:
    return sorted((tuple(map(_plain, r)) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same_rows(duck):
    """Asserts that a DataFrame has the rows of a DuckDB query, columns met by name."""

    def check(df: DataFrame, sql: str) -> None:
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(df.columns) == sorted(names)
        want = _sorted(found.fetchall())
        got = _sorted([tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()])
        assert len(got) == len(want)
        wrong = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
        assert not wrong, f"{len(wrong)} of {len(want)} rows differ, columns {names}: {wrong[:3]}"

    return check
