"""An inverted-file index of vectors: lists by nearest centroid, a few of which a query probes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.written import cut

#: Rows that centroids are fitted on, about, drawn by a hash of the id; and lists at most.
SAMPLE, MOST_LISTS = 50_000, 4096
#: Queries, drawn from the rows, by which the number of probes is chosen, and the share of their neighbours to be found.
TRIED, RECALL = 200, 0.95
#: Rows of a list, and queries that probe it, that one task compares; more are dealt out by parts.
PART = 20_000


@dataclass(frozen=True)
class VectorIndex:
    """rows: list, part, parts, id, v (of length 1), written; centroids: one row a list, at most MOST_LISTS; probes: lists
    that a query needs."""

    rows: DataFrame
    centroids: np.ndarray
    probes: int


def _unit(batch: np.ndarray) -> np.ndarray:
    size = np.sqrt((batch * batch).sum(axis=1, keepdims=True))
    return np.divide(batch, size, out=np.zeros_like(batch), where=size > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _vectors(m: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(m.reshape(-1)), m.shape[1]).cast(pa.list_(pa.float64()))


def _probed(centroids: np.ndarray, probes: int):
    """(id, v) to (list, id, v): each row with its `probes` nearest centroids, v of length 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _unit(_matrix(batch.column(1)))
            near = np.argsort(-(v @ centroids.T), axis=1, kind="stable")[:, :probes]
            at = np.repeat(np.arange(len(v)), near.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(near.reshape(-1).astype(np.int32)), batch.column(0).take(pa.array(at)), _vectors(v[at])], ["list", "id", "v"])

    return run


def _centroids(sample: np.ndarray, lists: int, seed: int, rounds: int = 8) -> np.ndarray:
    """k-means by angle, from rows drawn at random; a centroid that loses its rows stays where it was."""
    out = sample[np.random.default_rng(seed).permutation(len(sample))[:lists]]
    for _ in range(rounds):
        nearest = np.concatenate([(sample[a : a + 4096] @ out.T).argmax(axis=1) for a in range(0, len(sample), 4096)])
        sums = np.zeros_like(out)
        np.add.at(sums, nearest, sample)
        full = np.bincount(nearest, minlength=len(out)) > 0
        out[full] = _unit(sums[full])
    return out


def _drawn(rows: DataFrame, n: int, most: int, seed: int) -> DataFrame:
    """About `most` of n rows, by a hash of their id."""
    return rows if n <= most else rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < F.lit(int(1_000_000 * most / n)))


def build(vectors: DataFrame, lists: int | None = None, seed: int = 42, recall: float = RECALL, k: int = 10) -> VectorIndex:
    """An index of vectors (id BIGINT, v ARRAY of one length) by angle; all rows that have a vector are in it, once each.

    Centroids come from about SAMPLE rows, which pass through the driver, as many lists as the root of the number of rows,
    MOST_LISTS at most. A list of over PART rows is dealt into parts. About TRIED of the rows are then searched for
    exactly, and as many probes are chosen as find the share `recall` of their k neighbours. An empty table gives an empty
    index.
    """
    rows = vectors.where("v is not null and size(v) > 0").select("id", F.col("v").cast("array<double>").alias("v"))
    n = rows.count()
    some = _drawn(rows, n, SAMPLE, seed).toArrow()
    if not some.num_rows:
        some = rows.limit(1).toArrow()
    sample = _unit(_matrix(some["v"].combine_chunks())) if some.num_rows else np.zeros((1, 1))
    centroids = _centroids(sample, min(MOST_LISTS, lists or max(1, ceil(sqrt(n)))), seed)
    placed = cut(rows.mapInArrow(_probed(centroids, 1), "list int, id long, v array<double>"), "vector-lists")
    sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    placed = placed.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int"))
    placed = cut(placed.select("list", "part", "parts", "id", "v").repartition("list", "part").sortWithinPartitions("list", "part"), "vector-index")
    index = VectorIndex(placed, centroids, len(centroids))
    if n < 2 or recall >= 1:
        return index
    tried = _drawn(placed.select("id", "v"), n, TRIED, seed + 1).withColumnRenamed("id", "query_id")
    hits = search(tried, index, k).select("query_id", "id").join(placed.select("id", "list"), "id").join(tried, "query_id").select("v", "list").toArrow()
    if not hits.num_rows:
        return index
    near = np.argsort(-(_matrix(hits["v"].combine_chunks()) @ centroids.T), axis=1, kind="stable")
    place = np.argmax(near == hits["list"].to_numpy()[:, None], axis=1)
    return VectorIndex(placed, centroids, 1 + int(np.quantile(place, recall, method="higher")))


def _best(k: int):
    """Queries (list, part, block, query_id, v) and rows (list, part, block, id, v) of one part to the k nearest rows of each query."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        kinds = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("cosine", pa.float64())])
        if not asked.num_rows or not rows.num_rows:
            return kinds.empty_table()
        asked, rows = asked.combine_chunks(), rows.combine_chunks()
        own, ids = asked["query_id"].to_numpy(), rows["id"].to_numpy()
        a, b = _matrix(asked["v"].chunk(0)), _matrix(rows["v"].chunk(0))
        found: list[list[np.ndarray]] = [[], [], []]
        step = max(1, (1 << 22) // len(ids))
        for at in range(0, len(own), step):
            cosine = a[at : at + step] @ b.T
            cosine[own[at : at + step, None] == ids[None, :]] = -2  # a row isn't its own neighbour
            # of equal cosines the least ids, as the last step orders them
            order = np.lexsort((np.broadcast_to(ids, cosine.shape), -np.round(cosine, 9)), axis=1)[:, :k] if len(ids) <= 4 * k else _top(cosine, ids, k)
            picked = np.take_along_axis(cosine, order, axis=1)
            keep = picked > -2
            found[0].append(np.repeat(own[at : at + step], order.shape[1])[keep.reshape(-1)])
            found[1].append(ids[order][keep])
            found[2].append(picked[keep])
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in found], schema=kinds)

    return run


def _top(cosine: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of each row by rounded cosine, then id; ties at the end of the k are settled by id."""
    rounded = np.round(cosine, 9)
    limit = -np.partition(-rounded, k - 1, axis=1)[:, k - 1]
    out = np.empty((len(cosine), k), np.int64)
    for i, row in enumerate(rounded):
        at = np.flatnonzero(row >= limit[i])
        out[i] = at[np.lexsort((ids[at], -row[at]))[:k]]
    return out


def _by_length(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each length; null vectors and those with a null in them are in none."""
    sizes = set(pc.unique(pc.list_value_length(column)).to_pylist())
    if len(sizes) == 1 and not column.null_count and not column.flatten().null_count:
        n = sizes.pop()
        return {n: (np.arange(len(column)), _matrix(column) if n else np.zeros((len(column), 0)))}
    rows = [(at, v) for at, v in enumerate(column.to_pylist()) if v is not None and None not in v]
    found = {}
    for n in sizes - {None}:
        own = [(at, v) for at, v in rows if len(v) == n]
        if own:
            found[n] = np.array([at for at, _ in own]), np.array([v for _, v in own], np.float64).reshape(len(own), n)
    return found


def _cosines(a: dict, b: dict, low: int, high: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of the rows low to high of a with the `width` rows of b, as similarity.cosine has them, and which are null: those of
    vectors of two lengths. Without a vector, or with one of length 0, they are 0."""
    cosine, missing = np.zeros((high - low, width)), np.zeros((high - low, width), bool)
    for n, (at, m) in a.items():
        own = (at >= low) & (at < high)
        for other, (to, r) in b.items():
            size = np.sqrt((m[own] * m[own]).sum(axis=1))[:, None] * np.sqrt((r * r).sum(axis=1))[None, :]
            some = ~(size <= 0)
            if n != other:
                missing[np.ix_(at[own] - low, to)] = some
                continue
            found = np.divide(m[own] @ r.T, size, out=np.zeros_like(size), where=some)
            if len(found) == high - low and len(to) == width:
                cosine = found
            else:
                cosine[np.ix_(at[own] - low, to)] = found
    return cosine, missing


def exact_best(k: int):
    """Queries (..., query_id, v) and rows (..., id, v) of one group to the k nearest rows of each query, each but itself: query_id,
    id, cosine, by rounded cosine, then id."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        kinds = pa.schema([asked.schema.field("query_id"), rows.schema.field("id"), pa.field("cosine", pa.float64())])
        if not asked.num_rows or not rows.num_rows:
            return kinds.empty_table()
        asked, rows = asked.combine_chunks(), rows.combine_chunks()
        own, ids = (c.to_numpy(zero_copy_only=False) for c in (asked["query_id"].chunk(0), rows["id"].chunk(0)))
        a, b = _by_length(asked["v"].chunk(0)), _by_length(rows["v"].chunk(0))
        asking, taken, cosines, nulls = [], [], [], []
        step = max(1, (1 << 21) // len(ids))
        for low in range(0, len(own), step):
            high = min(low + step, len(own))
            cosine, missing = _cosines(a, b, low, high, len(ids))
            order = np.where(np.isnan(cosine), 9.0, cosine)  # NaN comes first, null last
            order[missing] = -3
            itself = own[low:high, None] == ids[None, :]
            order[itself] = -9
            picked = _top(order, ids, min(k, len(ids)))
            keep = ~np.take_along_axis(itself, picked, axis=1)
            asking.append(np.repeat(np.arange(low, high), picked.shape[1])[keep.reshape(-1)])
            taken.append(picked[keep])
            cosines.append(np.take_along_axis(cosine, picked, axis=1)[keep])
            nulls.append(np.take_along_axis(missing, picked, axis=1)[keep])
        columns = [asked["query_id"].take(pa.array(np.concatenate(asking))), rows["id"].take(pa.array(np.concatenate(taken))), pa.array(np.concatenate(cosines), mask=np.concatenate(nulls))]
        return pa.Table.from_arrays(columns, schema=kinds)

    return run


def search(queries: DataFrame, index: VectorIndex, k: int = 10, probes: int | None = None) -> DataFrame:
    """query_id, id, cosine, rank: the k nearest of the rows in the `probes` lists nearest to each query (query_id BIGINT, v),
    those of the index if not given, each but itself, of equal cosines the least ids. All lists give the exact result.

    Cosines within the probed lists are exact. Queries of a list are dealt into blocks of about PART, and each block meets
    each part of the list apart, so neither a large list nor one that many queries probe is one task's. Queries without a
    vector have no rows.
    """
    asked = queries.where("v is not null and size(v) > 0").select(F.col("query_id").alias("id"), F.col("v").cast("array<double>").alias("v"))
    asked = cut(asked.mapInArrow(_probed(index.centroids, min(probes or index.probes, len(index.centroids))), "list int, id long, v array<double>"), "vector-probes")
    blocks = asked.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("blocks"))
    parts = index.rows.groupBy("list").agg(F.max("parts").alias("parts"))
    deal = F.broadcast(blocks.join(parts, "list"))  # MOST_LISTS rows at most
    q = asked.join(deal, "list").withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks")).cast("int"))
    q = q.select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", F.col("id").alias("query_id"), "v")
    rows = index.rows.drop("parts").join(deal, "list").select("list", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "v")
    keys = ["list", "part", "block"]
    hits = q.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(_best(k), "query_id long, id long, cosine double")
    order = Window.partitionBy("query_id").orderBy(F.round("cosine", 9).desc(), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the pairs (query_id, id) of exact that found has; 1 if exact is empty."""
    n = exact.count()
    return found.select("query_id", "id").intersect(exact.select("query_id", "id")).count() / n if n else 1.0
