"""The split CSV reader against Python's csv module, at several sizes of byte ranges."""

from __future__ import annotations

import csv
import random

import pytest

from tessera.sources import files, split_csv


def expected(path, blank=True):
    with open(path, newline="", encoding="utf-8-sig", errors="replace") as f:
        rows = [r for r in csv.reader(f) if r or blank]
    return list(enumerate(rows))


def scribble(rng: random.Random, rows: int) -> bytes:
    """Rows with quotes where they belong and where they don't, line breaks of all kinds, and bad bytes."""
    ends = rng.choice([["\n"], ["\r\n"], ["\n", "\r\n", "\r"]])
    out = []
    for _ in range(rows):
        cells = []
        for _ in range(rng.randrange(1, 5)):
            plain = "".join(rng.choice("ab ,é\"\n\r'x") for _ in range(rng.randrange(8)))
            kind = rng.random()
            if kind < 0.55:
                cells.append('"' + plain.replace('"', '""') + '"')
            elif kind < 0.6:
                cells.append('5" disc')
            else:
                cells.append("".join(c for c in plain if c not in ',"\n\r'))
        out.append(",".join(cells) + rng.choice(ends))
        if rng.random() < 0.1:
            out.append(rng.choice(ends))
    text = "".join(out).encode().replace(b"x", rng.choice([b"x", b"\xff"]))
    if rng.random() < 0.3:
        text = text.rstrip(b"\r\n")
    return rng.choice([b"", b"\xef\xbb\xbf"]) + text


@pytest.fixture
def ranges_of(spark):
    """Sets the bytes of a range; the former settings come back."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def put(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")
        spark.conf.set(names[2], "1")

    yield put
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def read(spark, path, blank=True):
    return sorted((r["number"], r["cells"]) for r in split_csv.read_cells(spark, str(path), blank).collect())


@pytest.mark.parametrize("size", [17, 64, 300, 5000])
def test_random_files(spark, tmp_path, ranges_of, size):
    ranges_of(size)
    rng = random.Random(size)
    for k in range(4):
        path = tmp_path / f"{k}.csv"
        path.write_bytes(scribble(rng, 60))
        assert read(spark, path) == expected(path)
        assert read(spark, path, False) == expected(path, False)


def test_a_cell_over_many_ranges(spark, tmp_path, ranges_of, monkeypatch):
    ranges_of(50)
    path = tmp_path / "a.csv"
    path.write_text('h\n"' + "line of it\n" * 90 + '",2\nlast\n')
    assert read(spark, path) == expected(path)
    path.write_text('h\n"never closed\n' + "x\n" * 40)
    assert read(spark, path) == expected(path)
    monkeypatch.setattr(split_csv, "LONGEST_ROW", 60)
    with pytest.raises(ValueError, match="isn't closed"):
        split_csv.read_cells(spark, str(path))


def test_rows_of_several_files_are_numbered(spark, tmp_path, ranges_of):
    ranges_of(40)
    want = []
    for k in range(5):
        rows = [[f"t{k}-{i}", "a\n,b" if i % 3 else "", f"{i}"] for i in range(k * 4)]
        with open(tmp_path / f"part-{k}.csv", "w", newline="") as f:
            csv.writer(f).writerows([[" Name ", "Note", "n"], *rows])
        want += rows
    df = split_csv.read_table(spark, str(tmp_path))
    assert df.columns == ["Name", "Note", "n", "row_index"]
    assert [tuple(r) for r in df.orderBy("row_index").collect()] == [(*r, i) for i, r in enumerate(want)]


def test_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n\na,b,a,,\n1,2,3\n\n4,5,6,7,8,9\n")
    got = split_csv.read_table(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["a", "b", "_c3", "_c4", "row_index"]
    assert [tuple(r) for r in got.orderBy("row_index").collect()] == [("3", "2", None, None, 0), ("6", "5", "7", "8", 1)]
    (tmp_path / "b.csv").write_text("A,a\n1,2\n")
    with pytest.raises(ValueError, match="case only"):
        split_csv.read_table(spark, str(tmp_path / "b.csv"))
    (tmp_path / "c.csv").write_text("row_index\n1\n")
    with pytest.raises(ValueError, match="row_index"):
        split_csv.read_table(spark, str(tmp_path / "c.csv"))
    with pytest.raises(ValueError, match="different headers"):
        split_csv.read_table(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    (tmp_path / "d.csv").write_text("")
    assert split_csv.read_cells(spark, str(tmp_path / "d.csv")).count() == 0
    assert split_csv.read_table(spark, str(tmp_path / "d.csv")).count() == 0


def test_title_upload_keeps_all_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿ Title ,SHOW_DATE,Ticketing_URL,Screen\r\n"A ""b"", c\nd",2024-01-02,http://x,7\r\nx,,,\r\n'.encode())
    df = files.title_upload(files.read_csv(spark, str(tmp_path / "a.csv")))
    assert df.columns == ["Title", "SHOW_DATE", "Ticketing_URL", "Screen", "row_index"]
    assert [tuple(r) for r in df.orderBy("row_index").collect()] == [('A "b", c\nd', "2024-01-02", "http://x", "7", 0), ("x", "", "", "", 1)]
    fields = files.upload_fields(df)
    assert [tuple(r) for r in df.orderBy("row_index").select(*[c.alias(n) for n, c in fields.items()]).collect()] == [('A "b", c\nd', "2024-01-02", "http://x", ""), ("x", "", "", "")]
    with pytest.raises(ValueError, match="country"):
        files.title_upload(df, "international")
    with pytest.raises(ValueError, match="movie_title, ticketing_url"):
        files.title_upload(df.drop("Title", "Ticketing_URL"))
