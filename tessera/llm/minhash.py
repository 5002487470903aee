"""Near duplicates by MinHash: an inverted join on signature coordinates, confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessera.llm.components import connected_components
from tessera.llm.scratch import cut
from tessera.llm.textblocks import slices, text_buffer

#: Coordinates of a signature, and how many must agree. Sets of similarity 0.8 agree in fewer than 32 of 64 in one of
#: some 10**8 cases, by the binomial distribution.
COORDINATES, AGREE = 64, 32
#: Two sets whose signatures agree in AGREE places share one of the rarest PREFIX coordinates of each.
PREFIX = COORDINATES - AGREE + 1
#: Documents of a posting list, and of a candidate group, that one task compares with each other; more are dealt in pairs of parts.
PART = 4096
#: Shingles that a task holds at once for the same reason.
PART_SHINGLES = 2_000_000
#: Ids that are broadcast at most; beyond, tables are joined by shuffles.
MOST_BROADCAST = 1_000_000

_A, _B = (np.random.default_rng(13).integers(1, 2**63, COORDINATES, dtype=np.uint64) for _ in range(2))
_A |= np.uint64(1)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _WordHashes(dict):
    """XXH64 of words, kept for the words of late."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxh64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _C2
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: list[bytes | None], words: int, known: _WordHashes) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles: its words, A-Z in lower case, between ASCII white space,
    `words` at a time; fewer are one shingle, none make an empty set."""
    split = [(t or b"").lower().split() for t in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    flat = np.fromiter((known[w] for s in split for w in s), np.uint64, int(sizes.sum()))
    h = flat[: max(0, len(flat) - words + 1)].copy()
    for k in range(1, words):
        h = (h ^ (h >> np.uint64(32))) * _C1 + flat[k : k + len(h)]
    h = _mixed(h * _C1)
    out, at = [], 0
    for n in sizes.tolist():
        if n >= words:
            out.append(np.unique(h[at : at + n - words + 1]))
        elif n:
            short = flat[at : at + n]
            total = np.uint64(n)
            for w in short:
                total = (total ^ (total >> np.uint64(30))) * _C2 + w
            out.append(_mixed(np.array([total], np.uint64)))
        else:
            out.append(flat[:0])
        at += n
    return out


def set_nodes(sets: list[np.ndarray]) -> np.ndarray:
    """One 64-bit number for each set, equal for equal ones."""
    size = np.array([len(s) for s in sets], np.int64)
    out = np.zeros(len(sets), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        every = np.concatenate([sets[k] for k in full])
        first = np.concatenate([[0], np.cumsum(size[full])[:-1]])
        x, y = np.add.reduceat(_mixed(every * _C1), first), np.bitwise_xor.reduceat(_mixed(every + _C2), first)
        out[full] = _mixed(_mixed(x ^ size[full].astype(np.uint64) * _C1) + y * _C2)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """COORDINATES 32-bit minima for each set, none of which may be empty."""
    every = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat((every ^ _B[k]) * _A[k], first) >> np.uint64(32)
    return out


def _texts(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[pa.Array, list[bytes | None]]]:
    """First columns and texts of (id, text) batches, about `most` bytes at a time."""
    for batch in batches:
        _, offsets = text_buffer(batch.column(1))
        for a, b in slices(offsets, most):
            yield batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a).cast(pa.binary()).to_pylist()


def _sketches(words: int):
    """(doc_id, text) to (doc_id, n_shingles, node, sig); no node and no signature without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for ids, texts in _texts(batches):
            sets = shingle_sets(texts, words, known)
            size = np.array([len(s) for s in sets], np.int64)
            full = size > 0
            sig = signatures([s for s in sets if len(s)]).tobytes() if full.any() else b""
            rows, step = iter(range(0, len(sig) or 1, 4 * COORDINATES)), 4 * COORDINATES
            packed = [sig[(at := next(rows)) : at + step] if f else None for f in full.tolist()]
            node = pa.array(set_nodes(sets).view(np.int64), mask=~full)
            yield pa.RecordBatch.from_arrays([ids, pa.array(size), node, pa.array(packed, pa.binary())], ["doc_id", "n_shingles", "node", "sig"])

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, sig) to (node, token): a token for each coordinate and its value."""
    place = np.arange(COORDINATES, dtype=np.int64) << 32
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES)
        node = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), COORDINATES)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array((sig.astype(np.int64) | place).reshape(-1))], ["node", "token"])


def _low_bytes(sigs: list[bytes]) -> np.ndarray:
    """A byte of each coordinate. Unequal coordinates share it once in 256, which only adds pairs to confirm."""
    return np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, 4 * COORDINATES)[:, ::4]


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by their first column, cut so that no key goes on in the next one."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        whole = int(np.searchsorted(key, key[-1]))
        if whole:
            yield pa.Table.from_batches([*rest, batch.slice(0, whole)]).combine_chunks().to_batches()[0]
            rest = [batch.slice(whole)]
        elif rest and rest[0].column(0)[0].as_py() != int(key[0]):
            yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
            rest = [batch]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


def _bounds(key: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])


def _agreeing(percent: int):
    """Sorted (key, node, sig, n) to links (u, v) that join the sets of each list into the same components as all its pairs
    would that agree in AGREE places and have sizes that a link allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_key(batches):
            key, node, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
            sig = _low_bytes(batch.column(2).to_pylist())
            left, right = [node[:0]], [node[:0]]
            cuts = _bounds(key)
            two = cuts[:-1][np.diff(cuts) == 2]
            near = ((sig[two] == sig[two + 1]).sum(axis=1) >= AGREE) & (100 * np.minimum(n[two], n[two + 1]) >= percent * np.maximum(n[two], n[two + 1]))
            left.append(node[two[near]])
            right.append(node[two[near] + 1])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                rest, edge = np.arange(a, b if b - a > 2 else a), []
                while len(rest):
                    if not edge:
                        edge, rest = [int(rest[0])], rest[1:]
                    k = edge.pop()
                    fits = rest[100 * np.minimum(n[rest], n[k]) >= percent * np.maximum(n[rest], n[k])]
                    new = fits[(sig[fits] == sig[k]).sum(axis=1) >= AGREE]
                    if len(new):
                        left.append(np.full(len(new), node[k]))
                        right.append(node[new])
                        edge += new.tolist()
                        rest = np.setdiff1d(rest, new, assume_unique=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (left, right)], ["u", "v"])

    return run


def _sets(words: int):
    """(doc_id, text) to (node, n, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for _, texts in _texts(batches):
            sets = shingle_sets(texts, words, known)
            yield pa.RecordBatch.from_arrays([pa.array(set_nodes(sets).view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "n", "shingles"])

    return run


def _linked(common: np.ndarray, a: np.ndarray | int, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


def spanning_links(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges that join all sets of at least that similarity in per cent into the same components as all such pairs would.

    A set found linked is not compared with other linked ones: from each reached set the search goes on among the rest.
    """
    places = np.unique(np.concatenate(sets), return_inverse=True)[1]
    size = np.array([len(s) for s in sets], np.int64)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    mark = np.zeros(int(places.max()) + 1, np.int32)
    rest = np.arange(len(sets))
    found, edge = [], []
    cat = starts = None
    while len(rest) or edge:
        if not edge:
            edge, rest, cat = [int(rest[0])], rest[1:], None
        if not len(rest):
            break
        if cat is None:
            cat = np.concatenate([places[first[k] : first[k] + size[k]] for k in rest.tolist()])
            starts = np.concatenate([[0], np.cumsum(size[rest])[:-1]])
        k = edge.pop()
        own = places[first[k] : first[k] + size[k]]
        mark[own] = 1
        near = _linked(np.add.reduceat(mark[cat], starts), int(size[k]), size[rest], percent)
        mark[own] = 0
        if near.any():
            new = rest[near].tolist()
            found += [(int(nodes[k]), int(nodes[j])) for j in new]
            edge += new
            rest, cat = rest[~near], None
    return found


def _confirmed(percent: int):
    """Sorted (key, node, n, shingles) to links (u, v) within each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_key(batches):
            key = batch.column(0).to_numpy(zero_copy_only=False)
            found: list[tuple[int, int]] = []
            for a, b in zip((cuts := _bounds(key))[:-1], cuts[1:], strict=True):
                node, at = np.unique(batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False), return_index=True)  # an id may come on several rows
                if len(at) > 1:
                    column = batch.column(3).slice(a, b - a)
                    found += spanning_links(node, [np.frombuffer(column[int(k)].as_py(), np.uint64) for k in at], percent)
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    return run


def _dealt(df: DataFrame, key: Column, parts: Column, kept: list[str], salt: int) -> DataFrame:
    """df with `key` first, sorted by it within tasks; a key of p > 1 parts is replaced by one for each pair of its parts."""
    spark = df.sparkSession
    part = F.pmod(F.xxhash64("node", F.lit(salt)), F.col("_p")).cast("int")
    wide = df.withColumn("_key", key).withColumn("_p", parts.cast("int"))
    wide = wide.withColumn("_part", part).withColumn("_other", F.explode(F.when(F.col("_p") > 1, F.sequence(F.lit(0), F.col("_p") - 1)).otherwise(F.array(F.lit(0)))))
    own = F.when(F.col("_p") <= 1, F.xxhash64("_key")).otherwise(F.xxhash64("_key", F.least("_part", "_other"), F.greatest("_part", "_other")))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return wide.select(own.alias("_own"), *kept).repartition(tasks, "_own").sortWithinPartitions("_own")


def _few(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast where its counted rows allow it."""
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Two documents are linked if their sets of shingles of `words` words have at least `percent` per cent of their union
    in common. component_id is the smallest doc_id that chains of links reach, itself included. A text of fewer words is
    one shingle; one without words, or null, is linked with nothing. Texts are read whole, however long. Rows of one
    text are one class; repeated rows and ids stay; a null id counts only where a component has no other. Further columns
    take no part; an empty table gives an empty one.

    Distinct sets are posted under each (coordinate, value) of their signatures. Only the PREFIX coordinates that are
    rarest of each set are kept, as long lists are seldom needed: sets that agree in AGREE places meet there. In each list
    collisions are counted, and a spanning forest of the sets that agree often enough is kept, so a list gives fewer links
    than it has members. What such links join is a candidate group, whose links are found on whole sets, by a spanning
    search in tasks of bounded size: no pairs of a group are ever written out. Sets are known by 64-bit hashes of
    shingles, classes by 64 bits over these.
    """
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    base = cut(docs.mapInArrow(_sketches(words), "doc_id long, n_shingles long, node long, sig binary"), "sketches")
    classes = cut(base.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "classes")
    groups = candidate_groups(prefixes(classes), classes, percent)
    roots = connected_components(confirmed_links(docs, classes, groups, words, percent))
    label = classes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    label = cut(label, "roots")
    least = label.groupBy("root").agg(F.min("least").alias("component_id"))
    label = cut(label.join(least, "root").select("node", "component_id"), "labels")
    return base.join(label, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def prefixes(classes: DataFrame) -> DataFrame:
    """(node, token, c): the tokens of each set that are among its PREFIX rarest and that others have too, with the number
    of sets that have them. Tokens of one set alone come first in its prefix, and need no row."""
    postings = classes.select("node", "sig").mapInArrow(_postings, "node long, token long")
    shared = cut(postings.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"), "shared-values")
    own = postings.join(shared, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("t"))  # COORDINATES at most
    first = F.slice("t", F.lit(1), F.greatest(F.lit(0), F.lit(PREFIX - COORDINATES) + F.size("t")))
    return cut(own.select("node", F.explode(first).alias("t")).select("node", "t.token", "t.c"), "prefixes")


def candidate_groups(lists: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(node, root): what chains of sets that share a list and agree in AGREE places join."""
    rows = lists.join(classes.select("node", "sig", "n"), "node")
    parts = F.when(F.col("c") <= PART, 1).otherwise(F.ceil(F.col("c") * 2 / PART))
    links = _dealt(rows, F.col("token"), parts, ["node", "sig", "n"], 9).mapInArrow(_agreeing(percent), "u long, v long")
    return cut(connected_components(links), "candidate-groups")


def confirmed_links(docs: DataFrame, classes: DataFrame, groups: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (u, v) that join the sets of each group (node, root) as all its pairs would."""
    sizes = groups.join(classes.select("node", "n"), "node").groupBy("root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    parts = F.greatest(F.ceil(F.col("c") * 2 / PART), F.ceil(F.col("s") * 2 / PART_SHINGLES))
    parts = F.when((F.col("c") <= PART) & (F.col("s") <= PART_SHINGLES), 1).otherwise(parts)
    member = groups.join(classes.select("node", "least"), "node").join(sizes.select("root", parts.alias("p")), "root")
    member = cut(member.select("node", "root", "least", "p"), "group-members")
    n = member.count()
    # ids, and then nodes, are broadcast only where they are few
    texts = docs.join(_few(member.select(F.col("least").alias("_least")).distinct(), n), F.col("doc_id").eqNullSafe(F.col("_least")), "left_semi")
    rows = texts.mapInArrow(_sets(words), "node long, n long, shingles binary").join(_few(member, n), "node")
    return _dealt(rows, F.col("root"), F.col("p"), ["node", "n", "shingles"], 8).mapInArrow(_confirmed(percent), "u long, v long")


SQL = r"""
WITH RECURSIVE split AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM split)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY u, v
), links AS (
    SELECT u, v FROM common JOIN sizes x ON u = x.doc_id JOIN sizes y ON v = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach AS (
    SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), least AS (
    SELECT u, min(v) AS component_id FROM reach GROUP BY u
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id JOIN least l ON d.doc_id = l.u
"""


__all__ = ["SQL", "near_duplicates", "shingle_sets", "signatures", "spanning_links"]
