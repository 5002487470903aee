"""CSV files read in byte ranges, with quoted line breaks across ranges and row numbers in file order."""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.written import cut

#: Bytes of a row that goes over the end of a byte range, at most; more is taken for a quote that nobody closed.
LONGEST_ROW = 64 << 20
#: Byte ranges that begin within a quoted cell, which are broadcast, at most.
MOST_OPEN = 1_000_000
BOM = b"\xef\xbb\xbf"
_BLOCK = "file string, block long, lines long, ends0 long, ends1 long, open0 boolean, open1 boolean"


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """line BINARY, file, block (where its byte range begins): lines in file order within a task, each range in one task."""
    df = spark.read.option("lineSep", "\n").text(path)
    return df.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[str, int, list[bytes]]]:
    """Stretches of a batch that come from one range."""
    block = batch.column(2).to_numpy(zero_copy_only=False)
    file = batch.column(1).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero((block[1:] != block[:-1]) | (file[1:] != file[:-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        if a < b:
            yield batch.column(1)[a].as_py(), int(block[a]), batch.column(0).slice(a, b - a).to_pylist()


def _text_lines(lines: list[bytes], quoted: bool, first: bool) -> list[str]:
    """Lines as the csv module takes them, each with its end. quoted: they begin within a quoted cell; first: of a file."""
    if first and lines[0].startswith(BOM):
        lines = [lines[0][len(BOM) :], *lines[1:]]
    text = (b"\n".join(lines) + b"\n").decode("utf-8", "replace")
    return list(io.StringIO('"' + text if quoted else text, newline=""))


def _rows(lines: list[str]) -> Iterator[tuple[list[str], int]]:
    """Whole rows and how many lines end with them; a row that is still open at the end isn't given."""
    taken, over = 0, False

    def feed() -> Iterator[str]:
        nonlocal taken, over
        for line in lines:
            taken += 1
            yield line
        over = True

    csv.field_size_limit(sys.maxsize)
    for row in csv.reader(feed()):
        if over:
            return
        yield row, taken


def _ends(lines: list[bytes], quoted: bool, first: bool, blank: bool) -> tuple[int, bool]:
    """Rows that end in the lines, and whether one is open behind them."""
    if quoted and not any(b'"' in line for line in lines):
        return 0, True
    lines = _text_lines(lines, quoted, first)
    n = taken = 0
    for row, taken in _rows(lines):
        n += blank or bool(row)
    return n, taken < len(lines)


def _scan(blank: bool):
    """Lines to a row (_BLOCK) for each stretch: rows that end in it and whether one stays open, if it begins between
    rows (0) and if it begins in a quoted cell (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: tuple | None = None  # of the range at hand: file, block, lines, [rows, open] for either beginning

        def told() -> pa.RecordBatch:
            file, block, n, ways = state
            return pa.RecordBatch.from_pylist([{"file": file, "block": block, "lines": n, "ends0": ways[0][0], "ends1": ways[1][0], "open0": ways[0][1], "open1": ways[1][1]}], _BLOCK_ARROW)

        for batch in batches:
            for file, block, lines in _segments(batch):
                if state is None or state[:2] != (file, block):
                    if state:
                        yield told()
                    state = (file, block, 0, [(0, False), (0, True)])
                first = not block and not state[2]
                found = {is_open: _ends(lines, is_open, first, blank) for is_open in {w[1] for w in state[3]}}
                state = (file, block, state[2] + len(lines), [(n + found[is_open][0], found[is_open][1]) for n, is_open in state[3]])
        if state:
            yield told()

    return run


_BLOCK_ARROW = pa.schema([("file", pa.string()), ("block", pa.int64()), ("lines", pa.int64()), ("ends0", pa.int64()), ("ends1", pa.int64()), ("open0", pa.bool_()), ("open1", pa.bool_())])


def _ranges(spark: SparkSession, path: str | list[str], blank: bool) -> DataFrame:
    """file, block, open (it begins in a quoted cell), open_end, first (the number of its first row), ends for each byte range; a small table, as a range has megabytes.

    A range maps how it begins to how it ends. It begins as the last range before it ended whose end is the same either
    way, turned by each range since then that swaps the two; so windows over a file's ranges carry it forward.
    """
    found = _lines(spark, path).mapInArrow(_scan(blank), _BLOCK)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    through = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    fixed = F.col("open0") == F.col("open1")
    swaps = F.when(~fixed & F.col("open0"), 1).otherwise(0)
    df = found.withColumn("s", F.sum(swaps).over(through)).withColumn("fix", F.when(fixed, F.struct("open0", "s")))
    df = df.withColumns({"last": F.last("fix", ignorenulls=True).over(before), "so_far": F.coalesce(F.lag("s").over(Window.partitionBy("file").orderBy("block")), F.lit(0))})
    turned = (F.col("so_far") - F.coalesce("last.s", F.lit(0))) % 2 == 1
    df = df.withColumn("open", F.coalesce("last.open0", F.lit(False)) != turned)
    df = df.withColumn("ends", F.when(F.col("open"), F.col("ends1")).otherwise(F.col("ends0")))
    df = df.withColumn("first", F.coalesce(F.sum("ends").over(before), F.lit(0)).cast("long"))
    return cut(df.select("file", "block", "open", F.when(F.col("open"), F.col("open1")).otherwise(F.col("open0")).alias("open_end"), "first", "ends"), "csv-ranges")


_CELL = "file string, block long, number long, cells array<string>, piece string"


def _parsed(blank: bool, pieces: bool):
    """Lines of ranges to their whole rows, numbered from 0 in each range, or (pieces) to what they hold of rows that go
    over their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        held: list[str] = []  # lines of the row that is open
        head, number = False, 0
        out: list[tuple] = []

        def told() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string())
            batch = pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], ["file", "block", "number", "cells", "piece"])
            out.clear()
            return batch

        for batch in batches:
            k = 0
            for file, block, lines in _segments(batch):
                begins = bool(batch.column(3)[k].as_py())
                k += len(lines)
                if new := at != (file, block):
                    if at and held and pieces:
                        out.append((*at, number, None, "".join(held)))
                    at, held, head, number = (file, block), [], begins, 0
                now = held + _text_lines(lines, False, new and not block)
                if head:
                    # the end of a row that began in a range before
                    done = next(_rows(['"' + now[0], *now[1:]]), None)
                    if done is None:
                        held = now
                        continue
                    if pieces:
                        out.append((*at, number, None, "".join(now[: done[1]])))
                    head, now, number = False, now[done[1] :], number + 1
                taken = 0
                for cells, taken in _rows(now):
                    if cells or blank:
                        if not pieces:
                            out.append((*at, number, cells, None))
                        number += 1
                held = now[taken:]
            if out:
                yield told()
        if at and held and pieces:
            out.append((*at, number, None, "".join(held)))
        if out:
            yield told()

    return run


def _one_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, number, piece) of rows put together, to their cells."""
    csv.field_size_limit(sys.maxsize)
    for batch in batches:
        cells = [next(csv.reader(io.StringIO(t, newline="")), []) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.list_(pa.string()))], ["file", "number", "cells"])


def _read(spark: SparkSession, path: str | list[str], blank_rows: bool) -> tuple[DataFrame, DataFrame]:
    """The cells of read_cells, and the table of byte ranges."""
    ranges = _ranges(spark, path, blank_rows)
    lines = _lines(spark, path)
    opened = ranges.where("open").select("file", "block", F.lit(True).alias("open"))
    if (n := opened.count()) > MOST_OPEN:
        raise ValueError(f"{n} byte ranges begin within a quoted cell: read the files in several calls, or with larger ranges")
    # broadcast, as lines must stay in their order
    lines = lines.join(F.broadcast(opened), ["file", "block"], "left").select("line", "file", "block", "open") if n else lines.withColumn("open", F.lit(False))
    first = ranges.select("file", "block", "first")

    def numbered(pieces: bool) -> DataFrame:
        return lines.mapInArrow(_parsed(blank_rows, pieces), _CELL).join(first, ["file", "block"]).withColumn("number", F.col("first") + F.col("number"))

    whole = numbered(False).select("file", "number", "cells")
    if ranges.where("open or open_end").isEmpty():
        return whole, ranges
    parts = cut(numbered(True).select("file", "number", "block", "piece"), "csv-pieces")  # two of a range at most
    size = parts.groupBy("file", "number").agg(F.sum(F.length("piece")).alias("n"))
    if bad := size.where(F.col("n") > LONGEST_ROW).first():
        raise ValueError(f"row {bad['number']} of {bad['file']} is open for {bad['n']} characters: a quote isn't closed")
    joined = parts.groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("block", "piece"))).alias("p"))
    joined = joined.select("file", "number", F.array_join("p.piece", "").alias("piece"))
    return whole.unionByName(joined.mapInArrow(_one_row, "file string, number long, cells array<string>")), ranges


def read_cells(spark: SparkSession, path: str | list[str], blank_rows: bool = True) -> DataFrame:
    """file, number, cells ARRAY<STRING>: every row of CSV files with its number in its file, from 0, the header's included.

    Rows are those of Python's csv module on files opened without newline translation: cells between commas, quoted ones
    with commas, doubled quotes and line breaks; rows end at \\n, \\r\\n or \\r. A byte order mark is dropped, bad bytes
    become U+FFFD, rows may have any number of cells, and blank lines are rows without cells, or left out without
    blank_rows. An empty file has no rows. A file that ends within a quoted cell ends that cell with a line break.

    Files are read in the byte ranges of Spark's text source, however long a file is. A first pass finds what each range
    does to a quoted cell and how many rows end in it, windows over the ranges carry both forward, and the second pass
    reads each range by itself. Only a row that goes over the end of its range is put together from pieces; a ValueError
    names one of over LONGEST_ROW characters, as its quote was probably never closed.
    """
    return _read(spark, path, blank_rows)[0]


def headers(cells: DataFrame) -> list[str]:
    """The trimmed header of the files, in its own case; a ValueError says that they have different ones."""
    found = [r["cells"] for r in cells.where("number = 0").select("cells").distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"files have different headers: {found[0]} and {found[1]}")
    return [c.strip() for c in found[0]] if found else []


def read_table(spark: SparkSession, path: str | list[str], index: str = "row_index") -> DataFrame:
    """The rows of CSV files under their header, all columns as strings, and their number over all files, from 0, by path.

    Header names keep their case and lose blanks around them; of equal names the last column counts, an empty name is
    _c and the column's place. Blank lines are no rows; cells that a row lacks are null, those beyond the header are
    dropped. A ValueError names headers that differ only by case, or clash with `index`.
    """
    cells, ranges = _read(spark, path, False)
    place = {n or f"_c{k}": k for k, n in enumerate(headers(cells))}
    low = [n.lower() for n in [*place, index]]
    if twice := {n for n in low if low.count(n) > 1}:
        raise ValueError(f"headers differ by case only, or clash with the row number: {', '.join(sorted(twice))}")
    rows_in = F.sum("ends") + F.max_by("open_end", "block").cast("long") - 1
    counts = ranges.groupBy("file").agg(F.greatest(rows_in, F.lit(0)).alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    rows = cells.where("number > 0").join(counts.select("file", offset.alias("before")), "file")
    columns = [F.get("cells", F.lit(k)).alias(n) for n, k in place.items()]
    return rows.select(*columns, (F.col("before") + F.col("number") - 1).cast("long").alias(index))
