"""Benchmark decontamination by suffix arrays over shards of the training documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.scratch import cut
from tessera.llm.textblocks import slices, span_hashes, text_buffer, word_spans

WINDOW = 13
#: Words of the test set that are broadcast at once; a larger set goes over the documents in several passes.
BLOCK_WORDS = 1 << 20
#: Bytes of document text in one shard.
SHARD_BYTES = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_SLOTS = 1 << 20
_LAST = (1 << 21) - 1
_MASK = np.uint64(_SLOTS - 1)


@dataclass
class Spelling:
    """Words as they are spelt, lower-cased: data from starts to ends."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def same(self, own: np.ndarray, other: Spelling, theirs: np.ndarray) -> np.ndarray:
        """True where word own[k] has the bytes of the other spelling's word theirs[k]."""
        size = self.ends[own] - self.starts[own]
        equal = size == other.ends[theirs] - other.starts[theirs]
        at = np.flatnonzero(equal)
        if not len(at):
            return equal
        n = size[at]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differ = self.data[np.repeat(self.starts[own[at]], n) + inner] != other.data[np.repeat(other.starts[theirs[at]], n) + inner]
        equal[at] = ~np.logical_or.reduceat(differ, np.cumsum(n) - n)
        return equal


def _hashed_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, Spelling]:
    folded = _FOLD[data]
    starts, ends, upto = word_spans(folded, bounds, _WORD)
    return span_hashes(folded, starts, ends), upto, Spelling(folded, starts, ends)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a * np.uint64(0x9E3779B97F4A7C15)) ^ (b >> np.uint64(7))) >> np.uint64(20) & _MASK


@dataclass
class QueryBlock:
    """Items of a test set, word by word: ids into its own sorted vocabulary from 1 on, a 0 after each item."""

    vocabulary: np.ndarray
    words: np.ndarray
    ends: np.ndarray  # for each place, the place after the item's last word
    item: np.ndarray  # for each place, the item's number
    names: list[str]
    begins: np.ndarray  # places where a window begins
    widths: np.ndarray  # its words: WINDOW, or all of a shorter item
    first: np.ndarray  # slots of the first words of one-word windows
    pairs: np.ndarray  # slots of the first two words of the others
    spelling: Spelling  # a word at a place is that of the place less the number of its item

    @staticmethod
    def of(texts: list[str], names: list[str], window: int = WINDOW) -> QueryBlock:
        column = pa.array(texts, pa.string())
        data, offsets = text_buffer(column)
        hashes, upto, spelling = _hashed_words(data[offsets[0] : offsets[-1]], offsets - offsets[0])
        vocabulary = np.unique(hashes)
        sizes = np.diff(upto)
        n = len(hashes) + len(texts)
        item = np.repeat(np.arange(len(texts)), sizes + 1)
        ends = np.repeat(upto[1:] + np.arange(len(texts)), sizes + 1)
        words = np.zeros(n, np.int64)
        place = np.arange(len(hashes)) + np.repeat(np.arange(len(texts)), sizes)
        words[place] = np.searchsorted(vocabulary, hashes) + 1
        left = ends - np.arange(n)
        size = np.repeat(sizes, sizes + 1)
        begins = np.flatnonzero((left > 0) & ((left >= window) | (left == size)))
        widths = np.minimum(left[begins], window)
        first, pairs = np.zeros(_SLOTS, bool), np.zeros(_SLOTS, bool)
        spread = np.zeros(n + 1, np.uint64)
        spread[place] = hashes
        one = begins[widths == 1]
        first[spread[one] & _MASK] = True
        two = begins[widths > 1]
        pairs[_pair(spread[two], spread[two + 1])] = True
        return QueryBlock(vocabulary, words, ends, item, names, begins, widths, first, pairs, spelling)


@dataclass
class Shard:
    """Suffixes of documents in the order of their words, as far as a test suffix can start like them.

    Words are ids of the test vocabulary, 0 for any other word and after each document. A suffix whose first two words
    start no window of the test set can't match one, so it is left out; hash slots may let a few more in, never fewer.
    """

    words: np.ndarray
    suffixes: np.ndarray
    keys: np.ndarray
    upto: np.ndarray
    spelling: Spelling

    @staticmethod
    def of(data: np.ndarray, bounds: np.ndarray, block: QueryBlock) -> Shard:
        hashes, upto, spelling = _hashed_words(data, bounds)
        n = len(hashes)
        docs = len(bounds) - 1
        able = block.first[hashes & _MASK]
        if n > 1:
            able[:-1] |= block.pairs[_pair(hashes[:-1], hashes[1:])]
        at = np.flatnonzero(able)
        words = np.zeros(n + docs + 1, np.int64)
        if len(at):
            # only words from a kept suffix up to the longest window after it are ever compared
            near = np.zeros(n, np.int64)
            near[at] = 1
            near = np.flatnonzero(_within(near, int(block.widths.max(initial=1))))
            slot = np.searchsorted(block.vocabulary, hashes[near])
            slot[slot == len(block.vocabulary)] = 0
            shift = np.repeat(np.arange(docs), np.diff(upto))
            words[near + shift[near]] = np.where(block.vocabulary[slot] == hashes[near], slot + 1, 0)
            at = at + shift[at]
            at = at[words[at] > 0]
        keys = _packed(words, at, 0)
        order = np.argsort(keys, kind="stable")
        at, keys = at[order], keys[order]
        # suffixes that agree so far are sorted by three more words, again and again
        group = np.cumsum(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(at) else keys
        tail = keys & _LAST
        depth, longest = 3, int(block.widths.max(initial=1))
        while depth < longest and len(at):
            counts = np.bincount(group)
            tied = np.flatnonzero((counts[group] > 1) & (tail > 0))
            if not len(tied):
                break
            more = _packed(words, at[tied], depth)
            inner = np.lexsort((more, group[tied]))
            at[tied] = at[tied][inner]
            more = more[inner]
            new = np.zeros(len(at), bool)
            new[tied[1:]] = (more[1:] != more[:-1]) & (group[tied][1:] == group[tied][:-1])
            breaks = np.concatenate([[True], group[1:] != group[:-1]]) | new
            group = np.cumsum(breaks)
            tail[tied] = more & _LAST
            depth += 3
        return Shard(words, at, keys, upto, spelling)

    def matches(self, block: QueryBlock) -> tuple[np.ndarray, np.ndarray]:
        """Binary search of every window of the test set: pairs of (index into block.begins, place in words)."""
        if not len(self.suffixes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begins, widths = block.begins, block.widths
        keys = _packed(block.words, begins, 0, widths)
        low = np.searchsorted(self.keys, keys, "left")
        high = np.searchsorted(self.keys, keys + (np.int64(1) << (21 * np.maximum(3 - widths, 0))) - 1, "right")
        live = np.flatnonzero(low < high)
        low, high = low[live], high[live]
        for depth in range(3, int(widths.max(initial=0))):
            deep = widths[live] > depth
            if not deep.any():
                break
            want = block.words[begins[live[deep]] + depth]
            a, b = low[deep], high[deep]
            low[deep], high[deep] = self._bisect(a, b, want, depth, False), self._bisect(a, b, want, depth, True)
            some = low < high
            live, low, high = live[some], low[some], high[some]
        many = high - low
        rank = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        return np.repeat(live, many), self.suffixes[rank]

    def verbatim(self, block: QueryBlock, window: np.ndarray, place: np.ndarray) -> np.ndarray:
        """True for the matches whose words have the same bytes, not only the same hashes."""
        width = block.widths[window]
        of = np.repeat(np.arange(len(window)), width)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(width) - width, width)
        theirs, own = block.begins[window][of] + inner, place[of] + inner
        pair, back = np.unique(theirs * len(self.words) + own, return_inverse=True)
        theirs, own = pair // len(self.words), pair % len(self.words)
        doc = np.searchsorted(self.upto[:-1] + np.arange(len(self.upto) - 1), own, "right") - 1
        equal = self.spelling.same(own - doc, block.spelling, theirs - block.item[theirs])
        return np.logical_and.reduceat(equal[back], np.cumsum(width) - width)

    def _bisect(self, low: np.ndarray, high: np.ndarray, want: np.ndarray, depth: int, after: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        last = len(self.words) - 1
        while (open_ := low < high).any():
            mid = (low + high) // 2
            word = self.words[np.minimum(self.suffixes[np.minimum(mid, len(self.suffixes) - 1)] + depth, last)]
            up = open_ & ((word <= want) if after else (word < want))
            low, high = np.where(up, mid + 1, low), np.where(open_ & ~up, mid, high)
        return low

    def longest(self, block: QueryBlock, begin: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Words that the item from begin on and the document from place on have in common."""
        n = np.zeros(len(begin), np.int64)
        live = np.arange(len(begin))
        while len(live):
            a, b = block.words[begin[live] + n[live]], self.words[np.minimum(place[live] + n[live], len(self.words) - 1)]
            live = live[(a > 0) & (a == b)]
            n[live] += 1
        return n


def _within(marks: np.ndarray, width: int) -> np.ndarray:
    """True at each mark and the width - 1 places after it."""
    total = np.cumsum(marks)
    total[width:] = total[width:] - total[:-width].copy()
    return total > 0


def _packed(words: np.ndarray, at: np.ndarray, depth: int, widths: np.ndarray | None = None) -> np.ndarray:
    """Three words from depth on as one number; a suffix ends at its first 0, and at its width."""
    last = len(words) - 1
    out = np.zeros(len(at), np.int64)
    alive = np.ones(len(at), bool)
    for k in range(depth, depth + 3):
        word = words[np.minimum(at + k, last)]
        alive &= word > 0
        if widths is not None:
            alive &= k < widths
        out = (out << 21) | np.where(alive, word, 0)
    return out


def scan(column: pa.Array, block: QueryBlock) -> Iterator[tuple[int, np.ndarray, list[tuple[int, int]], dict[str, tuple[int, int]]]]:
    """For each text: n_words, the words hit as sorted disjoint spans [a, b), and for each item the longest verbatim
    match found: (words, first word of it in the text)."""
    data, offsets = text_buffer(column)
    for a, b in slices(offsets, SHARD_BYTES):
        shard = Shard.of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], block)
        upto = shard.upto
        hits: dict[int, tuple[list[tuple[int, int]], dict[str, tuple[int, int]]]] = {}
        window, place = shard.matches(block)
        if len(window):
            same = shard.verbatim(block, window, place)
            window, place = window[same], place[same]
            starts = upto[:-1] + np.arange(b - a)
            doc = np.searchsorted(starts, place, "right") - 1
            first = place - starts[doc]
            width = block.widths[window]
            common = shard.longest(block, block.begins[window], place)
            for k in np.lexsort((first, doc)):
                spans, items = hits.setdefault(int(doc[k]), ([], {}))
                x, y = int(first[k]), int(first[k] + width[k])
                if spans and x <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(spans[-1][1], y))
                else:
                    spans.append((x, y))
                name = block.names[block.item[block.begins[window[k]]]]
                if common[k] > items.get(name, (0, 0))[0]:
                    items[name] = (int(common[k]), x)
        for d in range(b - a):
            yield int(upto[d + 1] - upto[d]), *hits.get(d, ([], {}))


def query_blocks(spark: SparkSession, items: DataFrame, item_id: str = "item_id", text: str = "text", block_words: int = BLOCK_WORDS, window: int = WINDOW) -> list:
    """The test set as broadcast blocks of at most about block_words words, however many there are.

    Long items are cut into pieces that overlap by window - 1 words, so each window stands whole in one piece. Equal
    pieces of an item are one; running sums of words, first over the parts of the table, deal pieces to blocks, so no
    block grows with the set, and the driver holds one block at a time.
    """
    folded = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(folded, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda x: x != "")
    piece = max(window, block_words // 8)
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words.alias("w")).where("size(w) > 0")
    step = piece - window + 1
    rows = rows.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1), F.lit(step))).alias("at"))
    rows = rows.select("item", F.array_join(F.slice("w", F.col("at"), F.lit(piece)), " ").alias("text"), F.least(F.size("w") - F.col("at") + 1, F.lit(piece)).alias("n"))
    rows = cut(rows.distinct().withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33)), "test-set")
    # words before each piece: those of earlier parts of the table, then those before it in its own part
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n").alias("words")).withColumn("skip", F.coalesce(F.sum("words").over(upto), F.lit(0))).select("part", "skip")
    own = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    block = F.floor((F.col("skip") + F.coalesce(F.sum("n").over(own), F.lit(0))) / F.lit(max(1, block_words - piece)))
    dealt = cut(rows.join(parts, "part").select("item", "text", block.cast("long").alias("block")), "test-blocks")
    blocks = 1 + (dealt.agg(F.max("block")).first()[0] or 0)
    out = []
    for k in range(blocks):
        found = dealt.where(F.col("block") == k).collect()
        out.append(spark.sparkContext.broadcast(QueryBlock.of([r["text"] for r in found], [r["item"] for r in found], window)))
    return out


_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StructType([T.StructField("item", T.StringType()), T.StructField("longest", T.LongType()), T.StructField("at", T.LongType())]))),
])
_ARROW = [pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])), pa.list_(pa.struct([("item", pa.string()), ("longest", pa.int64()), ("at", pa.int64())]))]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted(spans):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], y))
        else:
            out.append((x, y))
    return out


def _pass(docs: DataFrame, block, text: str, keep_text: bool, before: bool) -> DataFrame:
    rest = [f for f in docs.schema.fields if f.name not in _FOUND.names and (keep_text or f.name != text)]
    read = [f"`{f.name}`" for f in rest] + ([] if keep_text else [f"`{text}`"]) + (["hits", "items"] if before else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            found = [[], [], []]
            old = zip(batch.column(at("hits")).to_pylist(), batch.column(at("items")).to_pylist(), strict=True) if before else None
            for n, spans, items in scan(batch.column(at(text)), block.value):
                if before:
                    h, i = next(old)
                    spans = _merge([*spans, *((x["first"], x["end"]) for x in h)])
                    for x in i:
                        items[x["item"]] = max(items.get(x["item"], (0, 0)), (x["longest"], x["at"]), key=lambda v: v[0])
                found[0].append(n)
                found[1].append([{"first": x, "end": y} for x, y in spans])
                found[2].append([{"item": k, "longest": n, "at": x} for k, (n, x) in sorted(items.items())])
            yield pa.RecordBatch.from_arrays([*(batch.column(at(f.name)) for f in rest), *map(pa.array, found, _ARROW)], [*(f.name for f in rest), *_FOUND.names])

    return docs.select(*read).mapInArrow(run, T.StructType([*rest, *_FOUND.fields]))


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep_text: bool = False, block_words: int = BLOCK_WORDS, window: int = WINDOW) -> DataFrame:
    """docs (without text unless keep_text) with n_words, hits (spans of words inside an occurrence of a window), items
    (item, words of its longest verbatim match, where that begins), n_hit, n_items, items_sha256 and contaminated.

    Words are runs of ASCII letters and digits, lower-cased, and of all non-ASCII characters. A window is `window`
    consecutive words of an item, or all of a shorter one; items without a word have none. A document is contaminated
    if a twentieth of its words or more are hit. Each task sorts the suffixes of shards of its own documents and
    searches them for every window of the test set, which is broadcast in blocks of proven size: a set beyond one block
    goes over the documents once for each, so nothing is shuffled and neither side has a limit; between two passes the
    documents are written with what was found so far. Search goes by word hashes, and the words of each match are then
    compared byte by byte. Null and blank texts have no words, long ones are searched whole; null item ids are listed
    as an empty string; equal ids are one item; repeated rows each get a row. Columns of docs with the name of a result
    are replaced by it, all others are kept.
    """
    blocks = query_blocks(docs.sparkSession, items, item_id, item_text, block_words, window)
    out = docs
    for k, block in enumerate(blocks):
        more = k + 1 < len(blocks)
        out = _pass(out, block, text, keep_text or more, k > 0)
        if more:
            out = cut(out, "hits")
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["first"])
    out = out.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long"))
    out = out.withColumn("items_sha256", F.sha2(F.array_join(F.sort_array(F.transform("items", lambda x: x["item"])), ","), 256))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated, all columns unchanged."""
    blocks = query_blocks(docs.sparkSession, items, item_id, item_text)
    if len(blocks) > 1:
        marked = contamination(docs.select(F.struct("*").alias("row"), F.col(text).alias("text")), items, "text", item_id, item_text)
        return marked.where("not contaminated").select("row.*")
    block = blocks[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = []
            for n, spans, _ in scan(batch.column(batch.schema.get_field_index(text)), block.value):
                hit = sum(y - x for x, y in spans)
                stay.append(not (hit > 0 and 20 * hit >= n))
            yield batch.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, width, array_to_string(w[i:i + width - 1], ' ') AS words
  FROM (SELECT *, least(len(w), 13) AS width, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
), places AS (
  SELECT doc_id, width, i, array_to_string(w[i:i + width - 1], ' ') AS words
  FROM (SELECT d.*, width, unnest(range(1, len(w) - width + 2)) AS i FROM d, (SELECT DISTINCT width FROM windows) WHERE len(w) >= width)
), hits AS (
  SELECT doc_id, item, i, width FROM places JOIN windows USING (width, words)
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN items USING (doc_id)
"""
