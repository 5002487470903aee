"""A content-addressed store of token ids: unique chunks, document recipes and Merkle manifests.

A store is a folder of three Parquet tables:
  chunks    digest, n, ids    each chunk of ids once, as little-endian integers of the manifest's width
  recipes   shard, row, doc_id, start, n_tokens, root, digests    a document is the chunks of its digests, in order;
            shards and rows ascend by doc_id; start counts the ids before it in its shard; root is its Merkle root
  manifest  shard, n_docs, n_tokens, root; shard -1 has the root over all shards and the width in n_docs
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.scratch import cut, scratch_path
from tessera.llm.textblocks import power_table, slices, text_buffer

#: Ids in a chunk: none has fewer, but a document's last; about MEAN more on average; none has more.
LEAST, MEAN, MOST = 128, 512, 2048  # MEAN: a power of two
#: Ids under the rolling hash.
SPAN = 16
#: Ids whose rolling hashes are computed at once.
_BLOCK = 1 << 20
#: Bytes of text that are encoded at once; a longer text is by itself.
SLICE_BYTES = 1 << 20
#: Bytes of a unit that the table holds under its bytes themselves; longer units are kept in a dictionary.
_SHORT = 15
#: Units whose ids a worker remembers; beyond that it starts anew.
REMEMBERED = 1 << 21
#: Slots of the table of short units, at least twice as many as it may hold.
_SLOTS = 1 << 22
#: Units that are looked up at once.
_UNITS = 1 << 19

_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True  # or the first byte of a wider blank
_WIDE = np.zeros(256, bool)
_WIDE[[0xE1, 0xE2, 0xE3]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_MARK = ~_ALNUM
_MARK[:33] = _MARK[127:] = False
_OPENS = np.zeros(256, bool)  # what may begin a unit: a space, a line break or a mark
_OPENS[[10, 32]] = True
_OPENS |= _MARK


def unit_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places at which a token starts whatever stands around them, those where a text starts among them.

    By the pattern of the tokenizer a token starts at a space or line break between two characters that are not white
    space, and at an ASCII mark after a letter or digit. bounds: offsets of the texts in data, which has 3 bytes more.
    """
    at = np.flatnonzero(_OPENS[data[: bounds[-1]]])
    own, before = data[at], data[at - 1]
    mark = _MARK[own] & (_ALNUM[before] | ((data[at - 2] == 0xC3) & (before != 0x97) & (before != 0xB7)))
    gap = ~_MARK[own] & ~_BLANK[before] & ~_BLANK[data[at + 1]] & ~_WIDE[data[at - 3]] & (data[at - 2] != 0xC2)
    first = bounds[:-1][np.diff(bounds) > 0]
    flags = np.zeros(int(bounds[-1]), bool)
    flags[at[mark | gap]] = flags[first] = True
    return np.flatnonzero(flags)


class Encoder:
    """Whole texts to ids by a byte-level BPE file of the tokenizers library, each distinct unit encoded once.

    A unit stands between two places at which a token always starts, so it has the same ids in any text. Short units
    are found by an open-addressed table of their bytes, so a lookup is exact; no word is handled one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values(), default=0) + 1
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = np.zeros(size, np.int64)  # bytes of a token: it is spelt with a letter for each
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.slots = np.full(_SLOTS, -1, np.int32)
        self.long: dict[bytes, int] = {}
        self.rows = 0
        self.low, self.high = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64)
        self.ids, self.used = np.zeros(1 << 18, self.kind), 0
        self.first = np.zeros((1 << 16) + 1, np.int64)  # row k has ids first[k] to first[k + 1]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, units: list[bytes]) -> list[np.ndarray]:
        """Ids of each unit. Those after a space or line break go in one text as far as they can be told apart in it."""
        out: list[np.ndarray | None] = [None] * len(units)
        chained = [k for k, u in enumerate(units) if _chains(u)]
        for a in range(0, len(chained), 500):
            part = chained[a : a + 500]
            ids = self._whole([b"".join(units[k] for k in part).decode()])[0]
            ends = np.cumsum([len(units[k]) for k in part])
            upto = np.cumsum(self.width[ids])
            cuts = np.searchsorted(upto, ends)
            if len(upto) and upto[-1] == ends[-1] and (upto[cuts] == ends).all():
                for k, x, y in zip(part, [0, *(cuts[:-1] + 1).tolist()], (cuts + 1).tolist(), strict=True):
                    out[k] = ids[x:y]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, ids in zip(rest, self._whole([units[k].decode() for k in rest]), strict=True):
            out[k] = ids
        return out

    def _learn(self, units: list[bytes]) -> int:
        """New rows of the table, in the units' order; the first of them."""
        found = self._encoded(units)
        begin, n = self.rows, len(units)
        sizes = np.array([len(x) for x in found], np.int64)
        ids = np.concatenate([*found, np.zeros(0, self.kind)])
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.low) < begin + n:
            self.low, self.high = (np.concatenate([x, np.zeros_like(x)]) for x in (self.low, self.high))
            self.first = np.concatenate([self.first, np.zeros(len(self.first) - 1, np.int64)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.first[begin + 1 : begin + n + 1] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        self.rows += n
        return begin

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        out = np.full(len(low), -1, np.int32)
        slot = _slot(low, high)
        row = self.slots[slot]
        hit = (row >= 0) & (self.low[row] == low) & (self.high[row] == high)
        out[hit] = row[hit]
        open_ = np.flatnonzero(~hit & (row >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (_SLOTS - 1)
            row = self.slots[slot[open_]]
            hit = (row >= 0) & (self.low[row] == low[open_]) & (self.high[row] == high[open_])
            out[open_[hit]] = row[hit]
            open_ = open_[~hit & (row >= 0)]
        return out

    def _place(self, low: np.ndarray, high: np.ndarray, begin: int) -> None:
        """Put new, distinct keys into the table as rows from begin on."""
        rows = np.arange(begin, begin + len(low), dtype=np.int32)
        self.low[rows], self.high[rows] = low, high
        slot = _slot(low, high)
        while len(rows):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = rows[free]
            left = self.slots[slot] != rows
            rows, slot = rows[left], (slot[left] + 1) & (_SLOTS - 1)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin and end; bounds: their offsets in data, from 0 on."""
        size = int(bounds[-1])
        padded = np.zeros(size // 8 * 8 + 32, np.uint8)
        padded[:size] = data[:size]
        raw = padded[:size].tobytes()
        starts = unit_starts(padded, bounds)
        if any(x in raw for x in self.added):  # a text with one of these is a unit
            odd = np.array([any(x in raw[a:b] for x in self.added) for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)])
            of = np.searchsorted(bounds, starts, "right") - 1
            starts = starts[~odd[of] | np.isin(starts, bounds)]
        ends = np.append(starts[1:], size)[: len(starts)]
        found = [self._units(padded, raw, starts[k : k + _UNITS], ends[k : k + _UNITS]) for k in range(0, len(starts), _UNITS)]
        counts = np.concatenate([np.zeros(1, np.int64), *(c for _, c in found)])
        return np.concatenate([np.zeros(0, self.kind), *(x for x, _ in found)]), np.cumsum(counts)[np.searchsorted(starts, bounds)]

    def _units(self, padded: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units in a row, and how many each has."""
        if self.rows > REMEMBERED:
            self._forget()
        sizes = ends - starts
        row = np.empty(len(starts), np.int32)
        short = np.flatnonzero(sizes <= _SHORT)
        low, high = _keys(padded, starts[short], sizes[short])
        found = self._find(low, high)
        new = np.flatnonzero(found < 0)
        if len(new):
            order = new[np.lexsort((low[new], high[new]))]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
            one = order[fresh]
            at = short[one]
            begin = self._learn([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            self._place(low[one], high[one], begin)
            found[order] = begin + np.cumsum(fresh) - 1
        row[short] = found
        wide = np.flatnonzero(sizes > _SHORT)
        units = [raw[a:b] for a, b in zip(starts[wide].tolist(), ends[wide].tolist(), strict=True)]
        unknown = list(dict.fromkeys(u for u in units if u not in self.long))
        begin = self._learn(unknown)
        self.long.update(zip(unknown, range(begin, begin + len(unknown)), strict=True))
        row[wide] = [self.long[u] for u in units]
        first = self.first[row]
        count = self.first[row + 1] - first
        upto = np.concatenate([[0], np.cumsum(count)])
        return self.ids[np.repeat(first - upto[:-1], count) + np.arange(upto[-1])], count


def _chains(unit: bytes) -> bool:
    """True if the unit's tokens stand apart from those of others of this kind before and after it."""
    return len(unit) > 1 and unit[0] in (10, 32) and not _BLANK[unit[1]] and (33 <= unit[-1] < 127 or unit[-2] == 0xC3)


def _keys(padded: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of units of up to _SHORT bytes as two numbers; the second has the number of bytes on top."""
    words = padded.view(np.uint64)
    at, shift = starts >> 3, ((starts & 7) * 8).astype(np.uint64)
    a, b, c = words[at], words[at + 1], words[at + 2]
    back = np.uint64(63) - shift  # a shift by 64 in two steps
    low = (a >> shift) | (b << np.uint64(1) << back)
    high = (b >> shift) | (c << np.uint64(1) << back)
    n = sizes.astype(np.int64)
    low &= _HEADS[np.minimum(n, 8)]
    high &= _HEADS[np.maximum(n - 8, 0)]
    return low, high | (n.astype(np.uint64) << np.uint64(56))


_HEADS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _slot(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    h = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(42)).astype(np.int64)


def chunk_ends(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all documents' chunks, and how many each document has; document k has the ids from bounds[k] to bounds[k + 1].

    A chunk ends where a hash of the last SPAN ids is rare, at LEAST to MOST ids from the last end, and with its document.
    """
    rare = []
    powers, inverse = power_table(_BLOCK + SPAN)
    for a in range(0, len(ids) - SPAN + 1, _BLOCK):
        mixed = (ids[a : a + _BLOCK + SPAN - 1].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        total = np.zeros(len(mixed) + 1, np.uint64)
        np.cumsum(mixed * powers[: len(mixed)], out=total[1:])
        rolling = (total[SPAN:] - total[:-SPAN]) * inverse[: len(mixed) + 1 - SPAN]
        rolling = (rolling ^ (rolling >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)
        rare.append(np.flatnonzero(rolling & np.uint64(MEAN - 1) == 0) + (a + SPAN))
    places = np.concatenate([np.zeros(0, np.int64), *rare])
    own = np.searchsorted(places, bounds).tolist()
    all_places = places.tolist()
    ends: list[int] = []
    counts = []
    for last, end, x, y in zip(bounds.tolist(), bounds[1:].tolist(), own, own[1:], strict=False):
        before = len(ends)
        for place in all_places[x:y] if end - last > LEAST else ():
            while place - last > MOST:
                last += MOST
                ends.append(last)
            if place - last >= LEAST:
                last = place
                ends.append(place)
        while end - last > MOST:
            last += MOST
            ends.append(last)
        if last < end:
            ends.append(end)
        counts.append(len(ends) - before)
    return np.array(ends, np.int64), np.array(counts, np.int64)


def chunk_bounds(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document."""
    return chunk_ends(ids, np.array([0, len(ids)]))[0].tolist()


def merkle_root(leaves: Iterable[bytes]) -> bytes:
    """Root of a binary tree of SHA-256 digests over leaves in order; it keeps one digest a level. Empty: of no bytes."""
    stack: list[tuple[int, bytes]] = []
    for leaf in leaves:
        node = (0, hashlib.sha256(b"\0" + leaf).digest())
        while stack and stack[-1][0] == node[0]:
            node = (node[0] + 1, hashlib.sha256(b"\1" + stack.pop()[1] + node[1]).digest())
        stack.append(node)
    if not stack:
        return hashlib.sha256(b"").digest()
    root = stack.pop()[1]
    while stack:
        root = hashlib.sha256(b"\1" + stack.pop()[1] + root).digest()
    return root


_ENCODERS: dict[str, Encoder] = {}


def encoded(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """doc_id, n_tokens and chunks (digest, n, ids) of each document, its end id included; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.setdefault(tokenizer, None) or Encoder(tokenizer)
        _ENCODERS[tokenizer] = encoder
        width = encoder.kind.itemsize
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in slices(offsets, SLICE_BYTES):
                plain, at = encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                bounds = at + np.arange(b - a + 1)
                ids = np.full(bounds[-1], end_id, encoder.kind)
                inner = np.ones(len(ids), bool)
                inner[bounds[1:] - 1] = False
                ids[inner] = plain
                ends, counts = chunk_ends(ids, bounds)
                raw, cuts = memoryview(ids.tobytes()), (np.append(0, ends) * width).tolist()
                digests = [hashlib.sha256(raw[x:y]).digest() for x, y in zip(cuts, cuts[1:], strict=False)]
                pieces = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.array(cuts, np.int32)), pa.py_buffer(raw)])
                chunks = pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(np.diff(ends, prepend=0), pa.int32()), pieces], ["digest", "n", "ids"])
                chunks = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), chunks)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(bounds)), chunks], ["doc_id", "n_tokens", "chunks"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, chunks array<struct<digest: binary, n: int, ids: binary>>")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted recipes of one shard, with places and Merkle roots; at the end the shard's manifest, as row -1."""
    shard, row, start = TaskContext.get().partitionId(), 0, 0
    roots: list[bytes] = []
    names = ["shard", "row", "doc_id", "start", "n_tokens", "root", "digests"]
    kind = None
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        n = len(batch)
        sizes = batch.column(1).to_numpy()
        ends = start + np.cumsum(sizes)
        own = [merkle_root(d) for d in batch.column(2).to_pylist()]
        roots += own
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(np.arange(row, row + n)), batch.column(0), pa.array(ends - sizes), batch.column(1), pa.array(own, pa.binary()), batch.column(2)], names)
        row, start = row + n, int(ends[-1]) if n else start
    if kind is not None:
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([-1]), pa.array([None], kind), pa.array([row]), pa.array([start]), pa.array([merkle_root(roots)], pa.binary()), pa.array([[]], pa.list_(pa.binary()))], names)


def write_store(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> None:
    """Encode docs and write a store at path, a folder that all executors reach.

    Texts are encoded once, into a staged table; chunks are deduplicated by digest in one shuffle, which a thousand
    copies of a chunk cross once for each task that met them; recipes, which carry no ids, are dealt by ranges of
    doc_id (then of the first digest, so equal ids spread too) and sorted within. Null ids come first; repeated rows
    each have a recipe.
    """
    spark = docs.sparkSession
    staged = cut(encoded(docs, tokenizer, doc_id, text, end_id), "encoded", "zstd")
    pieces = staged.select(F.explode("chunks").alias("c")).select("c.digest", "c.n", "c.ids")
    pieces.dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = staged.select("doc_id", "n_tokens", F.col("chunks.digest").alias("digests"))
    dealt = recipes.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("doc_id"), F.get("digests", F.lit(0)))
    kind = staged.schema["doc_id"].dataType.simpleString()
    rows = dealt.sortWithinPartitions("doc_id", "digests").mapInArrow(_shards, f"shard long, row long, doc_id {kind}, start long, n_tokens long, root binary, digests array<binary>")
    rows.write.parquet(f"{path}/rows")
    written = spark.read.parquet(f"{path}/rows")
    shards = written.where("row = -1").select("shard", F.col("start").alias("n_docs"), "n_tokens", "root").orderBy("shard").collect()  # one a partition
    width = Encoder(tokenizer).kind.itemsize
    rows = [(r["shard"], r["n_docs"], r["n_tokens"], bytes(r["root"])) for r in shards]
    total = (-1, width, sum(r[2] for r in rows), merkle_root([r[3] for r in rows]))
    spark.createDataFrame([total, *rows], "shard long, n_docs long, n_tokens long, root binary").coalesce(1).write.parquet(f"{path}/manifest")


def _shift_tables() -> np.ndarray:
    """For each k, tables by byte of what 2**k zero bytes make of a CRC-32."""
    column = np.array([1 << i for i in range(32)], np.uint64)
    table = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint64)
    step = table[column & np.uint64(255)] ^ (column >> np.uint64(8))  # one zero byte
    out = []
    for _ in range(40):
        tables = np.zeros((4, 256), np.uint64)
        for byte in range(4):
            for bit in range(8):
                tables[byte] ^= np.where(np.arange(256) >> bit & 1, step[8 * byte + bit], np.uint64(0)).astype(np.uint64)
        out.append(tables)
        step = _through(tables, step)
    return np.array(out)


def _through(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.int64)
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24 & 255]


_SHIFTS = _shift_tables()


def combined_crc(first: np.ndarray, count: np.ndarray, crcs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of each document from those of its chunks and their sizes in bytes; chunks lie from first on, count of them."""
    out = np.zeros(len(first), np.uint64)
    for k in range(int(count.max(initial=0))):
        at = np.flatnonzero(count > k)
        size, head = sizes[first[at] + k], out[at]
        for bit in range(int(size.max(initial=0)).bit_length()):
            head = np.where(size >> bit & 1, _through(_SHIFTS[bit], head), head)
        out[at] = head ^ crcs[first[at] + k]
    return out


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict[int, tuple[int, int, bytes]]]:
    """The width of ids, and for each shard n_docs, the ids before it and its root, after a check of the root over all."""
    rows = {r["shard"]: r for r in spark.read.parquet(f"{path}/manifest").collect()}  # one a partition of the recipes
    top, before, out = rows.pop(-1), 0, {}
    for k in sorted(rows):
        out[k] = (rows[k]["n_docs"], before, bytes(rows[k]["root"]))
        before += rows[k]["n_tokens"]
    if merkle_root([out[k][2] for k in sorted(out)]) != bytes(top["root"]):
        raise ValueError("the manifest's root doesn't fit its shards")
    return top["n_docs"], out


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Verify a store and return doc_id, start, n_tokens, ids_crc32 of each document, all from its files.

    Every chunk's ids are read and must have their digest. Recipes meet the chunks' counts and CRCs by digest; a
    document's CRC follows from those of its chunks, so ids are neither shuffled nor gathered. Each document's Merkle
    root, each shard's and the store's must be as written.
    """
    width, shards = _manifest(spark, path)

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, crc = [], []
            for digest, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if hashlib.sha256(ids).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                own = np.frombuffer(ids, f"<u{width}")
                n.append(len(own))
                crc.append(zlib.crc32(own.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["digest", "n", "crc"])

    chunks = spark.read.parquet(f"{path}/chunks").select("digest", "ids").mapInArrow(facts, "digest binary, n long, crc long")
    recipes = spark.read.parquet(f"{path}/rows").where("row >= 0")
    kind = recipes.schema["doc_id"].dataType.simpleString()
    parts = recipes.select("shard", "row", "doc_id", "start", "n_tokens", "root", F.posexplode("digests").alias("at", "digest"))
    parts = parts.join(chunks, "digest", "left")
    docs = parts.groupBy("shard", "row", "doc_id", "start", "n_tokens", "root").agg(F.sort_array(F.collect_list(F.struct("at", "digest", "n", "crc"))).alias("parts"))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, roots = None, []

        def ended() -> None:
            if shard is not None and (len(roots) != shards[shard][0] or merkle_root(roots) != shards[shard][2]):
                raise ValueError(f"shard {shard} doesn't fit its manifest")

        for batch in batches:
            lists = batch.column(6)
            bounds = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
            parts = lists.values
            digests = parts.field("digest").to_pylist()
            n, crc = (parts.field(x).fill_null(-1).to_numpy(zero_copy_only=False) for x in ("n", "crc"))
            first, count = bounds[:-1], np.diff(bounds)
            total = np.concatenate([[0], np.cumsum(n)])
            sizes = total[bounds[1:]] - total[first]
            of = batch.column(0).to_numpy()
            if (n < 0).any() or (sizes != batch.column(4).to_numpy()).any():
                raise ValueError("a document's chunks are missing or of other sizes")
            for k, root, a, b in zip(of.tolist(), batch.column(5).to_pylist(), bounds.tolist(), bounds[1:].tolist(), strict=False):
                if k != shard:
                    ended()
                    shard, roots = k, []
                if merkle_root(digests[a:b]) != root:
                    raise ValueError(f"a document of shard {k} can't be rebuilt from its chunks")
                roots.append(root)
            own = combined_crc(first, count, crc.astype(np.uint64), 4 * n).astype(np.int64)
            before = np.array([shards[k][1] for k in of.tolist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(batch.column(3).to_numpy() + before), pa.array(sizes), pa.array(own)], ["doc_id", "start", "n_tokens", "ids_crc32"])
        ended()

    dealt = docs.repartition(max(1, len(shards)), "shard").sortWithinPartitions("shard", "row")
    return dealt.mapInArrow(verified, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids (array of int) of each document, rebuilt from its chunks."""
    width, shards = _manifest(spark, path)
    recipes = spark.read.parquet(f"{path}/rows").where("row >= 0")
    kind = recipes.schema["doc_id"].dataType.simpleString()
    parts = recipes.select("shard", "row", "doc_id", "start", F.posexplode("digests").alias("at", "digest")).join(spark.read.parquet(f"{path}/chunks"), "digest")
    docs = parts.groupBy("shard", "row", "doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("parts"))

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in own), f"<u{width}").astype(np.int32) for own in batch.column(4).to_pylist()]
            start = [s + shards[k][1] for k, s in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(start, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return docs.mapInArrow(rebuilt, f"doc_id {kind}, start long, ids array<int>")


def stored(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """docs written to a new store in the shared folder, and what `read_store` finds there."""
    path = scratch_path(docs.sparkSession, "store")
    write_store(docs, path, tokenizer, doc_id, text, end_id)
    return read_store(docs.sparkSession, path)
