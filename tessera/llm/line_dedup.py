"""Removal of globally repeated passages by content-defined chunks of lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import cut
from tessera.llm.textblocks import power_table, slices, span_hashes, text_buffer

#: Words of the window of lines of which the least hash begins a chunk.
WINDOW_WORDS = 12
#: Words of the stretch of chunks that is compared, at least.
SPAN_WORDS = 12
#: Words beside a repeated stretch that are compared line by line, about.
MARGIN_WORDS = 24
#: Words of a passage that is removed, at least.
PASSAGE_WORDS = 25
#: Columns that `without_repeats` adds.
RESULTS = ("n_removed", "n_passages", "cut_bytes")
#: Bits of the filter of document keys that is broadcast.
FILTER_BITS = 1 << 26
#: Bytes of texts that are taken apart at once.
_SLICE = 1 << 20
#: Distinct lines whose bytes a task remembers.
_KNOWN_LINES = 400_000

_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), 32]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
# Full stops of scripts that set no space after them.
_WIDE_STOPS = (b"\xe3\x80\x82", b"\xef\xbc\x81", b"\xef\xbc\x9f", b"\xe0\xa5\xa4")
#: First bytes of characters that are written without spaces between words; Thai has a second byte too.
_UNSPACED = np.zeros(256, bool)
_UNSPACED[0xE3:0xEA] = True


@dataclass
class Lines:
    """Lines with a word of consecutive texts: bytes [starts, ends), hash and words of each; text k has those from bounds[k] on.

    A line ends at a line break, and at a full stop, so that passages within a long line are lines too. Hashes and words
    leave white space around a line out; two letters without spaces between words count as a word.
    """

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    words: np.ndarray
    bounds: np.ndarray
    inner: tuple[np.ndarray, np.ndarray]  # [starts, ends) without white space around

    @staticmethod
    def of(data: np.ndarray, bounds: np.ndarray) -> Lines:
        """bounds: offsets of the texts in data, the first 0 and the last len(data)."""
        n = len(data)
        blank = _BLANK[data]
        spaces = np.flatnonzero(data[1:] == 32) + 1
        cuts = np.zeros(n + 1, bool)
        cuts[np.flatnonzero(data == 10) + 1] = True
        cuts[spaces[_STOP[data[spaces - 1]]] + 1] = True
        high = data >= 0xE0
        if high.any():
            at = np.flatnonzero(high[: n - 2])
            three = (data[at].astype(np.int64) << 16) | (data[at + 1].astype(np.int64) << 8) | data[at + 2]
            cuts[at[np.isin(three, [int.from_bytes(x, "big") for x in _WIDE_STOPS])] + 3] = True
        cuts[bounds] = True
        edges = np.flatnonzero(cuts)
        starts, ends = (edges[:-1], edges[1:]) if n else (edges[:0], edges[:0])
        filled = np.flatnonzero(~blank)
        first, after = np.searchsorted(filled, starts), np.searchsorted(filled, ends)
        some = first < after
        starts, ends, first, after = starts[some], ends[some], first[some], after[some]
        low, up = filled[first], filled[after - 1] + 1
        opens = np.zeros(n + 1, np.int64)
        begins = ~blank
        begins[1:] &= blank[:-1]
        np.cumsum(begins, out=opens[1:])
        words = opens[up] - opens[low] + ~begins[low]
        if high.any():
            own = _UNSPACED[data]
            thai = np.flatnonzero(data[: n - 1] == 0xE0)
            own[thai[(data[thai + 1] == 0xB8) | (data[thai + 1] == 0xB9)]] = True
            total = np.concatenate([[0], np.cumsum(own)])
            words = words + (total[up] - total[low]) // 2
        return Lines(starts, ends, span_hashes(data, low, up), words, np.searchsorted(starts, bounds), (low, up))

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """(first line, line after the last) of stretches of chunks of at least SPAN_WORDS words, one from each chunk
        on as far as its text goes.

        A line begins a chunk if its hash is the least of a window, which is the shortest run of lines of WINDOW_WORDS
        words from some line on; so does a line after one that is a window by itself, and a text's first. Whatever
        stands around a passage, its windows are the same, and so are its chunks from the first such line to the last.
        """
        n = len(self.starts)
        upto = np.concatenate([[0], np.cumsum(self.words)])
        last = np.repeat(self.bounds[1:], np.diff(self.bounds))  # the line after those of a line's text
        heads = np.zeros(n + 1, bool)
        heads[self.bounds] = True
        ahead = np.searchsorted(upto, upto[:-1] + WINDOW_WORDS, "left")
        whole = np.flatnonzero(ahead <= last)
        least, size = whole.copy(), ahead[whole] - whole
        for k in range(1, int(size.max(initial=0))):
            at = np.flatnonzero(size > k)
            lower = self.hashes[whole[at] + k] < self.hashes[least[at]]
            least[at[lower]] = whole[at[lower]] + k
        heads[least] = True
        heads[whole[size == 1] + 1] = True
        chunk = np.flatnonzero(heads)  # n is the last
        words = upto[chunk]
        end = np.searchsorted(words, words[:-1] + SPAN_WORDS, "left")
        fits = end < len(chunk)
        a, b = chunk[:-1][fits], chunk[end[fits]]
        inside = b <= last[a]
        return a[inside], b[inside]

    def run(self, a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
        """A hash of each run of lines [a, b), as a signed number."""
        n = len(self.starts)
        powers, inverses = power_table(n + 1)
        total = np.zeros(n + 1, np.uint64)
        mixed = self.hashes ^ np.uint64(salt)
        np.cumsum((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) * powers[:n], out=total[1:])
        h = (total[b] - total[a]) * inverses[a]
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _sliced(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the first text, bytes, offsets) of runs of texts."""
    data, offsets = text_buffer(column)
    for a, b in slices(offsets, _SLICE):
        yield a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _filter_bits(key: Column) -> Column:
    return F.array(*(F.shiftrightunsigned(key, k).bitwiseAND(F.lit(FILTER_BITS - 1)) for k in (0, 30)))


def _key_filter(keys: DataFrame):
    """A broadcast Bloom filter of FILTER_BITS bits over keys (_k): of one size for any number of keys. Where there are
    more of them than it can tell apart it lets more keys through, never fewer."""
    bits = keys.select(F.explode(_filter_bits(F.col("_k"))).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(table)


def _passing(docs: DataFrame, key: str, known, inside: bool) -> DataFrame:
    """The rows of docs whose key passes the filter, or those whose key doesn't."""
    at = docs.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(at).to_numpy().view(np.uint64)
            ok = np.ones(len(k), bool)
            for shift in (0, 30):
                bit = (k >> np.uint64(shift) & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                ok &= (known.value[bit >> 6] >> (bit & 63)) & 1 == 1
            yield batch.filter(pa.array(ok if inside else ~ok))

    return docs.mapInArrow(run, docs.schema)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """docs with text cut down to what is not a repeat, and with n_removed, n_passages and cut_bytes.

    Stretches of content-defined chunks (`Lines.spans`) meet by their hashes, all over the table. The first by doc_id
    stays (then by a hash of its text, then by place); later ones are removed, with the lines beside them as far as the
    first document has the same lines beside the stretch. Passages of under passage_words words stay. So an equal
    passage is cut whole wherever it stands; equal means equal bytes, but for white space around lines, and what is
    removed always has an equal line before it in that order, so one of each stays.

    Only hashes are shuffled for the search: partial sums find those that repeat, and a join keeps the places of these.
    A stretch is known by 128 bits over its lines' hashes. Texts with such a place are then fetched and the bytes of
    their lines compared, distinct lines once a task; a line whose hash stands for different bytes stays. Groups of any
    size meet in partial aggregates and in joins that the adaptive planner may split. A Bloom filter of fixed size keeps most other texts out of the
    shuffles of texts. n_removed counts repeated stretches, n_passages and cut_bytes what is cut.

    A null text stays null; texts of any length are read whole; rows that share id and text are one document and are
    cleaned alike. Columns with the name of a result are replaced by it, all others are kept.
    """
    names = [c for c in docs.columns if c not in RESULTS]
    packed = docs.select(F.struct(*(f"`{c}`" for c in names)).alias("_row"), F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_h"), F.col(text).alias("_text"))
    packed = packed.withColumn("_k", F.xxhash64("_id", "_h"))
    slim = packed.select("_k", "_id", "_h", "_text").where("_text is not null")
    kind = docs.schema[doc_id].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data, bounds in _sliced(batch.column(2)):
                lines = Lines.of(data, bounds)
                a, b = lines.spans()
                of = np.searchsorted(lines.bounds, a, "right") - 1
                take = pa.array(of + base)
                own = [pa.array((x - lines.bounds[of]).astype(np.int32)) for x in (a, b)]
                yield pa.RecordBatch.from_arrays([pa.array(lines.run(a, b, 0)), pa.array(lines.run(a, b, 1)), batch.column(0).take(take), batch.column(1).take(take), *own], ["hash", "more", "_id", "_h", "first", "end"])

    spans = cut(slim.select("_id", "_h", "_text").mapInArrow(placed, f"hash long, more long, _id {kind}, _h long, first int, end int"), "spans", "zstd")
    repeated = cut(spans.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    rows = cut(spans.join(repeated, "hash"), "places", "zstd")
    order = F.struct("_id", "_h", "first")
    first = cut(rows.groupBy("hash", "more").agg(F.min(order).alias("least")), "first")
    marked = rows.join(first, ["hash", "more"]).select("_id", "_h", F.struct("first", "end", "hash", "n", (~order.eqNullSafe(F.col("least"))).alias("later")).alias("span"))
    own = cut(marked.groupBy(F.xxhash64("_id", "_h").alias("_k"), "_h").agg(F.sort_array(F.collect_set("span")).alias("spans")), "own", "zstd")
    met = _passing(slim, "_k", _key_filter(own.select("_k")), True).join(own, ["_k", "_h"]).select("_k", "_h", "spans", "_text")
    met = cut(met, "met", "zstd")

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data, bounds in _sliced(batch.column(3)):
                lines = Lines.of(data, bounds)
                m = _margins(lines, batch.column(2).slice(base, len(bounds) - 1))
                take, own = pa.array(m.of + base), lines.bounds[m.of]
                rows = [*(batch.column(k).take(take) for k in range(2)), *map(pa.array, (m.hashes, m.more, (m.low - own).astype(np.int32), (m.up - own).astype(np.int32), m.later))]
                yield pa.RecordBatch.from_arrays(rows, ["_k", "_h", "hash", "more", "first", "end", "later"])

    sides = cut(met.mapInArrow(beside, "_k long, _h long, hash long, more long, first int, end int, later boolean"), "sides", "zstd")
    given = cut(sides.where("not later").select("hash", "more").distinct(), "given-sides")
    later = sides.where("later").join(given, ["hash", "more"], "left_semi")

    # next to no line shares its hash with another, as hashes have 64 bits
    told = met.select("spans", "_text").mapInArrow(_line_bytes, "hash long, body binary").repartition("hash").sortWithinPartitions("hash")
    void = np.unique(told.mapInArrow(_differing, "hash long").toArrow()["hash"].to_numpy())

    cuts = own.select("_k", "_h", F.explode("spans").alias("s")).where("s.later").select("_k", "_h", "s.first", "s.end", F.lit(True).alias("span"))
    cuts = cuts.unionByName(later.select("_k", "_h", "first", "end", F.lit(False).alias("span")))
    cuts = cut(cuts.groupBy("_k", "_h").agg(F.collect_set(F.struct("first", "end", "span")).alias("_cuts")), "cuts", "zstd")
    known = _key_filter(cuts.select("_k"))
    work = packed.select("_row", "_k", "_h")
    touched = _passing(work, "_k", known, True).join(cuts.hint("shuffle_hash"), ["_k", "_h"], "left").select("_row", "_cuts")
    at = names.index(text)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            columns = [row.field(k) for k in range(len(names))]
            texts, counts = [], [np.zeros((0, len(RESULTS)), np.int64)]
            for base, data, bounds in _sliced(columns[at]):
                own, count = _cleaned(data, bounds, batch.column(1).slice(base, len(bounds) - 1), void, passage_words)
                texts += own
                counts.append(count)
            count = np.concatenate(counts)
            columns[at] = pa.array(texts, pa.binary(), mask=columns[at].is_null().to_numpy(zero_copy_only=False)).cast(columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(count[:, k]) for k in range(len(RESULTS)))], [*names, *RESULTS])

    plain = docs.select(*(f"`{c}`" for c in names))
    schema = plain.schema
    for c in RESULTS:
        schema = schema.add(c, "long")
    untouched = _passing(work, "_k", known, False).select("_row.*", *(F.lit(0).cast("long").alias(c) for c in RESULTS))
    return touched.mapInArrow(cleaned, schema).unionByName(untouched)


def _cleaned(data: np.ndarray, bounds: np.ndarray, cuts: pa.Array, void: np.ndarray, passage_words: int) -> tuple[list[bytes], np.ndarray]:
    """Each text without its passages, and its n_removed, n_passages and cut_bytes."""
    lines = Lines.of(data, bounds)
    of, first, end, span = _flat(lines, cuts, "span")
    gone = (_covered(len(lines.starts), first, end)) & ~np.isin(lines.hashes.view(np.int64), void)
    begins, ends = gone.copy(), gone.copy()
    begins[1:] &= ~gone[:-1]
    ends[:-1] &= ~gone[1:]
    edge = lines.bounds[(lines.bounds > 0) & (lines.bounds < len(gone))]  # no passage runs from one text to the next
    begins[edge] = gone[edge]
    ends[edge - 1] = gone[edge - 1]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    upto = np.concatenate([[0], np.cumsum(lines.words)])
    long = upto[b] - upto[a] >= passage_words
    a, b = a[long], b[long]
    counts = np.zeros((len(bounds) - 1, len(RESULTS)), np.int64)
    if len(a):
        first, end, of = first[span], end[span], of[span]
        within = np.searchsorted(a, first, "right") - 1
        np.add.at(counts[:, 0], of[(within >= 0) & (end <= b[within])], 1)
    text = np.searchsorted(lines.bounds, a, "right") - 1
    low, up = lines.starts[a], lines.ends[b - 1]
    np.add.at(counts[:, 1], text, 1)
    np.add.at(counts[:, 2], text, up - low)
    raw, out = data.tobytes(), []
    passages = np.searchsorted(text, np.arange(len(bounds))).tolist()
    spots = list(zip(low.tolist(), up.tolist(), strict=True))
    for left, last, x, y in zip(bounds.tolist(), bounds[1:].tolist(), passages, passages[1:], strict=False):
        parts = []
        for p, q in spots[x:y]:
            parts.append(raw[left:p])
            left = q
        out.append(b"".join([*parts, raw[left:last]]) if parts else raw[left:last])
    return out, counts


def _covered(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """True for the lines of n that a run [a, b) holds."""
    return np.cumsum(np.bincount(a, minlength=n + 1)[: n + 1] - np.bincount(b, minlength=n + 1)[: n + 1])[:n] > 0


def _flat(lines: Lines, lists: pa.Array, *names: str) -> tuple[np.ndarray, ...]:
    """Text, first line and line after the last of what lists has for each text, and further fields."""
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(lists)), size)
    flat = lists.flatten()
    a, b, *more = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("first", "end", *names))
    return of, a + lines.bounds[of], b + lines.bounds[of], *more


def _line_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, bytes) of each distinct line of texts (spans, text) in a stretch or as near to one as may be cut."""
    known: dict[int, bytes] = {}
    for batch in batches:
        for base, data, bounds in _sliced(batch.column(1)):
            lines = Lines.of(data, bounds)
            own = batch.column(0).slice(base, len(bounds) - 1)
            _, a, b = _flat(lines, own)
            m = _margins(lines, own)
            seen = np.flatnonzero(_covered(len(lines.starts), np.concatenate([a, m.low]), np.concatenate([b, m.up])))
            low, up = lines.inner
            raw = data.tobytes()
            hashes, found = [], []
            for x, p, q in zip(lines.hashes[seen].view(np.int64).tolist(), low[seen].tolist(), up[seen].tolist(), strict=True):
                body = raw[p:q]
                if known.get(x) != body:
                    known[x] = body
                    hashes.append(x)
                    found.append(body)
            if len(known) > _KNOWN_LINES:
                known.clear()
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(found, pa.binary())], ["hash", "body"])


def _differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of sorted rows (hash, bytes) that come with different bytes."""
    last: pa.RecordBatch | None = None
    for batch in batches:
        if not len(batch):
            continue
        if last is not None:
            batch = pa.concat_batches([last, batch])
        h, body = batch.column(0), batch.column(1)
        differ = pc.and_(pc.equal(h[1:], h[:-1]), pc.not_equal(body[1:], body[:-1]))
        yield pa.RecordBatch.from_arrays([h[1:].filter(differ)], ["hash"])
        last = batch.slice(len(batch) - 1)


@dataclass
class _Margins:
    """Runs of lines [low, up) beside repeated stretches, their text, a hash of the run, the side and the stretch, and one
    more of the run; later: whether the run goes if the first text with the stretch has it too."""

    of: np.ndarray
    low: np.ndarray
    up: np.ndarray
    hashes: np.ndarray
    more: np.ndarray
    later: np.ndarray


def _margins(lines: Lines, spans: pa.Array) -> _Margins:
    """Runs of lines from a repeated stretch on, up to about MARGIN_WORDS words: of a later one whose neighbour doesn't
    repeat, and of the first one where its neighbour is met less often, so that other texts may have other lines there."""
    of, a, b, h, n, later = _flat(lines, spans, "hash", "n", "later")
    all_first = lines.spans()[0]
    place = np.searchsorted(all_first, a)
    met = np.zeros(len(all_first) + 2, np.int64)  # how often the stretch at a place is met, if it repeats
    met[place + 1] = n
    text_of = np.concatenate([[-1], np.searchsorted(lines.bounds, all_first, "right") - 1, [-1]])
    upto = np.concatenate([[0], np.cumsum(lines.words)])
    out = []
    for side, step in ((0, 1), (1, -1)):
        beside = place + 1 + step
        often = np.where(text_of[beside] == of, met[beside], 0)
        alone = np.flatnonzero(np.where(later, often == 0, often < n))
        edge = (b if step > 0 else a)[alone]
        stop = lines.bounds[of[alone] + (step > 0)]
        for k in range(1, MARGIN_WORDS + 1):
            far = edge + step * k
            open_ = (far <= stop) if step > 0 else (far >= stop)
            near = np.where(open_, far - step, edge)
            open_ &= np.abs(upto[near] - upto[edge]) < MARGIN_WORDS
            if not open_.any():
                break
            alone, edge, stop, far = alone[open_], edge[open_], stop[open_], far[open_]
            low, up = np.minimum(edge, far), np.maximum(edge, far)
            mixed = (lines.run(low, up, 2).view(np.uint64) + h[alone].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * k + side)) * np.uint64(0xD6E8FEB86659FD93)
            out.append((of[alone], low, up, (mixed ^ (mixed >> np.uint64(32))).view(np.int64), lines.run(low, up, 3), later[alone]))
    if not out:
        none = np.zeros(0, np.int64)
        return _Margins(none, none, none, none, none, none.astype(bool))
    return _Margins(*(np.concatenate(x) for x in zip(*out, strict=True)))
