"""Periodic runs of words: stretches that repeat themselves three times or more, found by suffix trees."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.textblocks import slices, text_buffer

#: A run is at least so many words long, and at least so many of its periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of a window that must come again at a period's distance in any run: 24 - q, or 2 * q, is 16 at least.
WINDOW = 16
#: Bytes of text that a task holds as words at once, but for a longer document.
SLICE = 1 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def suffix_tree(s: list[int]) -> tuple[list[dict[int, int]], list[int], list[int]]:
    """Ukkonen's tree of s, whose last symbol stands nowhere else: children by first symbol, and the start and end of
    each node's edge label. Node 0 is the root; the end of a leaf's label is len(s)."""
    n = len(s)
    children: list[dict[int, int]] = [{}]
    start, end, link = [0], [0], [0]
    node, edge, length, rest = 0, 0, 0, 0  # the active point, and suffixes still to be added
    for i, symbol in enumerate(s):
        rest += 1
        last = 0
        while rest:
            if not length:
                edge = i
            here = children[node]
            child = here.get(s[edge])
            if child is None:
                here[s[edge]] = len(start)
                children.append({})
                start.append(i)
                end.append(n)
                link.append(0)
                if last:
                    link[last] = node
                last = node
            else:
                at = start[child]
                size = (i + 1 if end[child] > i else end[child]) - at
                if length >= size:
                    edge += size
                    length -= size
                    node = child
                    continue
                if s[at + length] == symbol:
                    if last and node:
                        link[last] = node
                    length += 1
                    break
                split = len(start)
                start += [at, i]
                end += [at + length, n]
                link += [0, 0]
                children += [{s[at + length]: child, symbol: split + 1}, {}]
                here[s[edge]] = split
                start[child] = at + length
                if last:
                    link[last] = split
                last = split
            rest -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - rest + 1
    return children, start, end


class Extensions:
    """Longest common extensions of any two suffixes of a sequence, each by one look-up.

    The tour of the suffix tree passes its leaves in order; the least depth between two leaves of the tour is that of
    their lowest common ancestor, so only this depth is kept for each pair of neighbouring leaves, with a table of
    minima over all powers of two.
    """

    def __init__(self, symbols: np.ndarray) -> None:
        """symbols: at least 1 each; 0 is the end."""
        n = len(symbols) + 1
        children, start, end = suffix_tree([*symbols.tolist(), 0])
        order, depth = [], []
        stack = [(0, 0, 0)]  # node, its depth, depth of the ancestor that its first leaf shares with the leaf before
        while stack:
            v, d, shared = stack.pop()
            below = children[v]
            if below:
                first = True
                later = []
                for symbol in sorted(below):
                    c = below[symbol]
                    later.append((c, d + end[c] - start[c], shared if first else d))
                    first = False
                stack += reversed(later)
            else:
                order.append(n - d)
                depth.append(shared)
        self.rank = np.empty(n, np.int32)
        self.rank[order] = np.arange(n, dtype=np.int32)
        self.minima = [np.array(depth, np.int32)]
        width = 1
        while 2 * width <= n:
            low = self.minima[-1]
            self.minima.append(np.minimum(low[:-width], low[width:]))
            width *= 2

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common symbols from i and from j on, i <> j, at most len(symbols)."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.zeros(len(i), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.minima[k]
            out[at] = np.minimum(row[low[at]], row[high[at] + 1 - (1 << int(k))])
        return out


def _next_smaller(rank: list[int]) -> np.ndarray:
    """For each place the next one of smaller rank, or the end: where its longest Lyndon word stops."""
    out = [len(rank)] * len(rank)
    stack: list[int] = []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, np.int64)


def stretch_runs(symbols: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """(start, length, period) rows, sorted by start and period, of the maximal runs of a sequence of integers.

    By the runs theorem each run has a root that is the longest Lyndon word at its place, for the order of symbols or
    for the reversed one. Each such word is a candidate period, extended to the right by the suffix tree of the sequence
    and to the left by that of its reversal.
    """
    n = len(symbols)
    symbols = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    ahead, back = Extensions(symbols), Extensions(symbols[::-1])
    rank = ahead.rank[:n].tolist()
    found = [np.zeros((0, 3), np.int64)]
    for ranks in (rank, [n - r for r in rank]):
        stop = _next_smaller(ranks)
        i = np.flatnonzero(stop < n)
        p = stop[i] - i
        fits = periods * p <= n
        i, p = i[fits], p[fits]
        right = ahead.of(i, i + p)
        inner = i > 0
        left = np.zeros(len(i), np.int64)
        # words before i and before i + p, read backwards
        left[inner] = back.of(n - i[inner], n - (i[inner] + p[inner]))
        length = left + p + right
        good = length >= np.maximum(least, periods * p)
        found.append(np.stack([(i - left)[good], length[good], p[good]], axis=1))
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


_MIX = np.uint64(0xBF58476D1CE4E5B9)
_STEP = 0x9E3779B97F4A7C15


def _repeating(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows [a, b) of words that any run must lie in, for documents whose words are ids between bounds.

    In a run of period q each window of WINDOW words stands again q words on or back, and q is at most a third of the
    run. So only stretches that such windows cover can hold a run; a shorter stretch allows shorter distances, and so on
    until nothing changes. Equal hashes of different windows only make a stretch longer.
    """
    n = len(ids)
    none = np.zeros((0, 2), np.int64)
    if n < LEAST_WORDS:
        return none
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(_STEP)
    h = (h ^ (h >> np.uint64(31))) * _MIX
    width, factor = 1, _STEP
    while width < WINDOW:
        h = h[: len(h) - width] * np.uint64(factor) + h[width:]
        width, factor = 2 * width, factor * factor % 2**64
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = np.flatnonzero(doc[: len(h)] == doc[WINDOW - 1 :])
    if not len(inside):
        return none
    key = h[inside] ^ (doc[inside].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    sorted_key, place = key[order], inside[order]
    again = sorted_key[1:] == sorted_key[:-1]
    gap = place[1:] - place[:-1]
    far = np.int64(1) << 60
    nearest = np.full(len(order), far)
    nearest[1:][again] = gap[again]
    nearest[:-1][again] = np.minimum(nearest[:-1][again], gap[again])
    some = nearest < far
    at, nearest = place[some], nearest[some]
    back = np.argsort(at)
    at, nearest = at[back], nearest[back]
    allowed = np.diff(bounds)[doc[at]] // LEAST_PERIODS
    while True:
        near = nearest <= allowed
        at, nearest = at[near], nearest[near]
        if not len(at):
            return none
        # stretches: windows of one document that overlap or touch
        first = np.concatenate([[True], (at[1:] > at[:-1] + WINDOW) | (doc[at[1:]] != doc[at[:-1]])])
        starts = np.flatnonzero(first)
        a, b = at[starts], at[np.concatenate([starts[1:] - 1, [len(at) - 1]])] + WINDOW
        allowed = np.repeat(np.where(b - a >= LEAST_WORDS, (b - a) // LEAST_PERIODS, 0), np.diff(np.concatenate([starts, [len(at)]])))
        if (nearest <= allowed).all():
            return np.stack([a, b], axis=1)


def document_runs(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each list of words, as rows (start, length, period)."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for words in texts for w in words], np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(words) for words in texts], dtype=np.int64)]).astype(np.int64)
    found: dict[int, list[np.ndarray]] = {}
    for a, b in _repeating(ids, bounds):
        rows = stretch_runs(ids[a:b])
        if len(rows):
            k = int(np.searchsorted(bounds, a, "right")) - 1
            rows[:, 0] += a - bounds[k]
            found.setdefault(k, []).append(rows)
    none = np.zeros((0, 3), np.int64)
    out = []
    for k in range(len(texts)):
        rows = np.concatenate(found[k]) if k in found else none
        out.append(rows[np.lexsort((rows[:, 2], rows[:, 0]))])
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, joined by a space, that no run holds after its first period."""
    if not len(runs):
        return b" ".join(words)
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()])


def with_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None, results: tuple[str, str] = ("runs", "collapsed")) -> DataFrame:
    """docs without its texts, plus `runs`, the maximal runs of its words by start and period, and `collapsed`, the text
    without their repetitions, its words joined by single spaces.

    Words are what stands between ASCII white space. A run has a smallest period q (words q apart are equal), is 24 words
    and 3 * q long at least, and cannot be extended. edit(doc_id, words), if given, replaces the words first. A text is
    read whole, however long; nothing is shuffled, so hot keys and repeated rows make no difference. A task holds about
    a megabyte of texts as words, and for each word of a stretch that may repeat itself some 500 bytes of suffix trees.
    Null and blank texts have no runs and an empty collapsed text; an empty table gives an empty one; other columns stay,
    whatever their names, but those that `results` names are replaced.
    """
    kept = [f.name for f in docs.schema.fields if f.name != text and f.name not in results]
    bare = docs.select(*[f"`{n}`" for n in kept])
    schema = bare.select("*", F.lit(None).cast(RUNS).alias(results[0]), F.lit("").alias(results[1])).schema
    # by place, as names may clash in any case
    table = docs.select(*[F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate(kept)], F.col(f"`{doc_id}`").cast("long").alias("own"), F.col(f"`{text}`").cast("string").alias("own_text"))
    of_runs = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, ids = batch.column(len(kept) + 1), batch.column(len(kept)).to_pylist()
            _, offsets = text_buffer(column)
            for a, b in slices(offsets, SLICE):
                texts = [(t or b"").split() for t in column.slice(a, b - a).cast(pa.binary()).to_pylist()]
                if edit:
                    texts = [edit(k, words) for k, words in zip(ids[a:b], texts, strict=True)]
                runs = document_runs(texts)
                rows = np.concatenate([np.zeros((0, 3), np.int64), *runs])
                ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, c])) for c in range(3)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values).cast(of_runs)
                joined = pa.array([collapsed(w, r) for w, r in zip(texts, runs, strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in range(len(kept))), lists, joined], [f.name for f in schema.fields])

    return table.mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length over period, compared exactly; of equal ones the first, then the shortest period."""

    def better(best: Column, r: Column) -> Column:
        left, right = r["length"] * best["period"], best["length"] * r["period"]
        earlier = (r["start"] < best["start"]) | ((r["start"] == best["start"]) & (r["period"] < best["period"]))
        return F.when(best.isNull() | (left > right) | ((left == right) & earlier), r).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, in every tenth document by crc32 of its id with a tail that repeats itself; a null id is no tenth."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * -(-(n - a) // p))[: n - a]


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run's start, length, period and exponent_milli (four nulls without a run), and the
    sha256 of all runs and of the collapsed text, for the results of with_runs."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = F.col("best")
    return found.withColumn("best", strongest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(F.lit(1000) * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


__all__ = ["collapsed", "digests", "document_runs", "repeated_tail", "strongest", "stretch_runs", "suffix_tree", "with_runs"]
