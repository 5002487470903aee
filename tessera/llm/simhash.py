"""SimHash near-duplicate detection by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from tessera.llm.components import connected_components
from tessera.llm.scratch import cut
from tessera.llm.textblocks import slices, text_buffer

#: For each byte, eight one-byte counters: counter j is bit j.
_LANES = (((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint8)).reshape(-1).view(np.uint64)
#: Rows of a bucket that one task compares at once; larger buckets are dealt out by pairs of parts.
PART = 4096
SMALL = 48


def shingle_fingerprints(texts: list[bytes], words: int = 4, seed: int = 42) -> np.ndarray:
    """Signed 64-bit SimHash of each text: lower-cased A-Z, words between ASCII white space, XXH64 of each shingle of
    `words` words joined by spaces (all words if fewer). A bit is set if it is in over half the hashes; no word: 0."""
    digests: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        tokens = text.lower().split()
        if not tokens:
            continue
        line = b" ".join(tokens)
        if len(tokens) <= words:
            digests.append(xxh64_digest(line, seed))
            counts[k] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        starts = np.concatenate([[0], ends[:-words] + 1])
        digests += [xxh64_digest(line[a:b], seed) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)]
        counts[k] = len(starts)
    out = np.zeros(len(texts), np.int64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    lanes = _LANES[np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)]
    first = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
    # a counter holds 255 at most: add up runs of 255 rows, then the runs of each text
    runs = -(-counts[full] // 255)
    run_of = np.concatenate([[0], np.cumsum(runs)[:-1]])
    cuts = np.repeat(first - 255 * run_of, runs) + 255 * np.arange(runs.sum())
    sums = np.add.reduceat(np.ascontiguousarray(np.add.reduceat(lanes, cuts, axis=0)).view(np.uint8).astype(np.int64), run_of, axis=0)
    bits = (2 * sums > counts[full][:, None]).reshape(-1, 8, 8)[:, :, ::-1]
    out[full] = np.packbits(bits.reshape(-1, 64), axis=1).reshape(-1).view(">u8").astype(np.uint64).view(np.int64)
    return out


def with_fingerprints(docs: DataFrame, text: str = "text", words: int = 4, seed: int = 42, name: str = "fp") -> DataFrame:
    """docs without its texts, plus their fingerprint as a BIGINT."""
    kept = [f for f in docs.schema.fields if f.name not in (text, name)]
    schema = docs.select(*[f"`{f.name}`" for f in kept], F.lit(0).cast("long").alias(name)).schema
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            _, offsets = text_buffer(column)
            found = [np.zeros(0, np.int64)]
            for a, b in slices(offsets, 1 << 20):
                found.append(shingle_fingerprints(column.slice(a, b - a).cast(pa.binary()).fill_null(b"").to_pylist(), words, seed))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(np.concatenate(found))], [*names, name])

    return docs.select(*[f"`{f}`" for f in names], f"`{text}`").mapInArrow(run, schema)


def _blocks(distinct: int, bits: int) -> int:
    """Fewest blocks whose keys, of all blocks but `bits`, spread the fingerprints to under eight a key."""
    m = bits + 2
    while m < 16 and distinct >> (64 * (m - bits) // m) >= 8:
        m += 1
    return m


def _spanning(a: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the fingerprints in a, linked at `bits` or fewer differing bits."""
    left, right, rest = [], [], a
    while len(rest) > 1:
        edge, rest = rest[:1], rest[1:]
        while len(edge) and len(rest):
            node, edge = edge[0], edge[1:]
            near = np.bitwise_count(rest ^ node) <= bits
            if near.any():
                new, rest = rest[near], rest[~near]
                left.append(np.full(len(new), node))
                right.append(new)
                edge = np.concatenate([edge, new])
    return (np.concatenate(left), np.concatenate(right)) if left else (a[:0], a[:0])


def _links(bits: int):
    """Sorted (key, fp) batches to links within each key: all of them in small buckets, a spanning forest in others."""

    def close(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fp = fp.view(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([first, [len(key)]]))
        left, right = [fp[:0]], [fp[:0]]
        small = np.repeat(np.where(size <= SMALL, size, 0), size)
        place = np.arange(len(key)) - np.repeat(first, size)
        for d in range(1, int(small.max(initial=0))):
            at = np.flatnonzero(place + d < small)
            x, y = fp[at], fp[at + d]
            near = np.bitwise_count(x ^ y) <= bits
            left.append(x[near])
            right.append(y[near])
        for k in np.flatnonzero(size > SMALL):
            x, y = _spanning(np.unique(fp[first[k] : first[k] + size[k]]), bits)
            left.append(x)
            right.append(y)
        return np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            key, fp = (np.concatenate([old, column.to_numpy(zero_copy_only=False)]) for old, column in ((key, batch.column(0)), (fp, batch.column(1))))
            whole = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch; a bucket has 2 * PART rows at most
            if whole:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in close(key[:whole], fp[:whole])], ["u", "v"])
                key, fp = key[whole:], fp[whole:]
        if len(key):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in close(key, fp)], ["u", "v"])

    return run


def close_links(fingerprints: DataFrame, bits: int = 4) -> DataFrame:
    """Links (u, v) that join all fingerprints (fp BIGINT, distinct) at `bits` or fewer differing bits into the same
    components as all such pairs would.

    64 bits fall into m blocks; two fingerprints of at most `bits` differing bits agree on m - bits of them at least, so
    each choice of that many blocks is a key to join on, and the Hamming distance decides. m follows from the number of
    fingerprints, so that few unrelated ones share a key. A key of over PART fingerprints is cut into parts, and each
    pair of its parts is compared apart from the others, so any bucket spreads over tasks and none is dropped.
    """
    spark = fingerprints.sparkSession
    n = fingerprints.count()
    m = _blocks(n, bits)
    edges = np.linspace(0, 64, m + 1).round().astype(int)
    parts = [F.shiftrightunsigned("fp", int(a)).bitwiseAND(F.lit(int((1 << (b - a)) - 1))) for a, b in zip(edges, edges[1:], strict=False)]
    widths = np.diff(edges)
    keys = []
    for k, chosen in enumerate(combinations(range(m), m - bits)):
        value = F.lit(k).cast("long")
        room = 64 - max(7, comb(m, bits).bit_length())
        if sum(int(widths[i]) for i in chosen) <= room:
            for i in chosen:
                value = F.shiftleft(value, int(widths[i])).bitwiseOR(parts[i])
        else:
            value = F.xxhash64(value, *[parts[i] for i in chosen])  # a shared hash only adds pairs to verify
        keys.append(value)
    keyed = fingerprints.select("fp", F.explode(F.array(*keys)).alias("key"))
    large = cut(keyed.groupBy("key").count().where(F.col("count") > PART), "large-keys")
    if not large.isEmpty():
        # part = a hash of the fingerprint; a key of c rows has p parts and p * (p + 1) / 2 pairs of parts
        sized = keyed.join(large.withColumn("p", F.ceil(F.col("count") * 2 / PART).cast("int")).drop("count"), "key", "left").withColumn("p", F.coalesce("p", F.lit(1)))
        sized = sized.withColumn("part", F.pmod(F.xxhash64("fp", F.lit(1)), "p").cast("int"))
        sized = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
        keyed = sized.select("fp", F.when(F.col("p") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))).alias("key"))
    dealt = keyed.select("key", "fp").repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_links(bits), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, fp BIGINT, component_id.

    component_id is the smallest doc_id of all documents that chains of links at `bits` or fewer differing bits reach,
    itself included; null ids count only if there is no other. Documents of equal fingerprint need no pairs: they meet
    in one aggregate and links are sought between distinct fingerprints. Null and blank texts have fingerprint zero and
    are linked like any other. Texts are read whole, however long. Repeated rows stay; further columns of docs take no
    part; an empty table gives an empty one.
    """
    base = cut(with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words=words, seed=seed), "fingerprints")
    return grouped(base, bits).drop("root")


def grouped(base: DataFrame, bits: int = 4) -> DataFrame:
    """base (doc_id, fp, ...) with its component_id and the component's root, a fingerprint."""
    distinct = cut(base.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(close_links(distinct.select("fp"), bits))
    member = roots.join(distinct, roots["node"] == distinct["fp"]).select("root", "least", F.col("fp"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = member.join(least, "root").select("fp", "root", "component_id")
    label = distinct.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"))
    label = cut(label, "labels")
    return base.join(label, "fp")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """docs with one document of each group of near duplicates, that of the smallest doc_id; all columns unchanged,
    whatever their names.

    Rows are told apart by doc_id and a hash of the text, so repeated ids or rows never both stay for one group. Null
    and blank texts are one group; texts of any length are read whole; an empty table gives an empty one.
    """
    h = F.xxhash64(F.col(text), F.lit(11))
    base = with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), h.alias("h"), F.col(text).alias("text")), words=words, seed=seed)
    base = cut(base, "fingerprints")
    groups = grouped(base, bits).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = groups.groupBy("root", "doc_id").agg(F.min("h").alias("h"), F.count("*").alias("rows"))
    chosen = cut(chosen.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "rows"), "chosen").hint("shuffle_hash")
    packed = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_own"), h.alias("_h0"))
    kept = packed.join(chosen, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_h0") == F.col("_h")))
    if chosen.where("rows > 1").isEmpty():
        return kept.select("_row.*")
    # rows > 1: the chosen id stands on several rows; one of those that carry the chosen text stays
    alone, shared = kept.where("rows = 1").select("_row"), kept.where("rows > 1")
    return alone.unionByName(shared.dropDuplicates(["_id", "_h"]).select("_row")).select("_row.*")


__all__ = ["close_links", "drop_near_duplicates", "near_duplicates", "shingle_fingerprints", "with_fingerprints"]
