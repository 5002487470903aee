"""Spelling variants: words one edit apart, joined by exact PartEnum signatures of their letter multisets."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import cut

#: Words have so many code points and occurrences at least; a form has so many times the occurrences of its variant.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Letter multisets of words one edit apart differ in so many places at most.
DISTANCE = 2
#: Distinct words that a task counts before it passes them on.
HELD = 200_000
# A text in Latin-1: A-Z in lower case, letters as they are, anything else (other scripts are "?") a blank.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))

Edit = Callable[[int | None, set[bytes]], dict[bytes, bytes]]


def misspelt(doc_id: int | None, words: set[bytes]) -> dict[bytes, bytes]:
    """Words in Latin-1 that lose a letter in this document: one in 199 by crc32 of `doc_id:word` in UTF-8, and what is
    left of them. A null id counts as an empty text."""
    lead = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    crc = zlib.crc32
    lost = {w: h for w in words if not (h := crc(w if w.isascii() else w.decode("latin-1").encode(), lead)) % 199}
    return {w: w[: h % len(w)] + w[h % len(w) + 1 :] for w, h in lost.items()}


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = LEAST_LENGTH, edit: Edit | None = None) -> DataFrame:
    """(word, n) of all texts: maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of least_length letters.

    Each task counts its texts, so a word that a third of all texts hold comes as one row of a task. edit gives, for a
    document and its words in Latin-1, those that change and what they become. Whole texts of any length are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def passed_on() -> pa.RecordBatch:
            words = [w for w, n in counts.items() if n and len(w) >= least_length]
            n = [counts[w] for w in words]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array(n, pa.int64())], ["word", "n"])

        for batch in batches:
            for own, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not t:
                    continue
                words = t.encode("latin-1", "replace").translate(_LETTERS).split()
                counts.update(words)
                if edit:
                    lost = edit(own, set(words))
                    for word, times in Counter(filter(lost.__contains__, words)).items() if lost else ():
                        counts[word] -= times
                        counts[lost[word]] += times
                if len(counts) > HELD:
                    yield passed_on()
        yield passed_on()

    table = docs.select(F.col(f"`{doc_id}`").cast("long").alias("own"), F.col(f"`{text}`").cast("string").alias("own_text")).where("own_text is not null")
    return table.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def parts_for(words: int) -> tuple[int, int]:
    """First- and second-level parts (n1, n2) of PartEnum, by the number of words.

    One first-level part keeps the whole allowance of DISTANCE in its second level; more words need longer signatures,
    so that few unrelated ones share one: a signature holds all but DISTANCE of n2 parts, of C(n2, 2) choices.
    """
    return (1, 6) if words < 20_000 else (1, 7) if words < 500_000 else (1, 8)


def signatures(words: list[str], n1: int, n2: int, distance: int = DISTANCE) -> np.ndarray:
    """A row of 64-bit signatures for each word: two words whose letter multisets differ in at most `distance` places
    have one in common, in the same column.

    A multiset is a binary vector with a place for each letter's first, second, ... occurrence. Places are partitioned
    in n1 parts: one of them differs in at most k2 = (distance + 1) / n1 - 1 places, rounded up. Each part falls into n2
    smaller ones, of which n2 - k2 at least agree whole, so each choice of so many is a signature.
    """
    k2 = -(-(distance + 1) // n1) - 1
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.array([len(w) for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    order = np.lexsort((points, owner))
    points = points[order]
    new = np.ones(len(points), bool)
    new[1:] = (points[1:] != points[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    nth = np.arange(len(points)) - np.repeat(first, np.diff(np.concatenate([first, [len(points)]])))
    place = (points * 64 + np.minimum(nth, 63)).astype(np.uint64)
    mixed = (place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    # neighbouring places fall into different parts, whatever the alphabet
    part = ((points * 5 + nth * 3) % (n1 * n2)).astype(np.int64)
    sums = np.zeros((len(words), n1 * n2), np.uint64)
    np.add.at(sums, (owner, part), mixed)
    columns = []
    for outer in range(n1):
        for chosen in combinations(range(n2), n2 - k2):
            h = np.full(len(words), len(columns) + 1, np.uint64)
            for inner in chosen:
                h = (h ^ sums[:, outer * n2 + inner]) * np.uint64(0x94D049BB133111EB)
                h ^= h >> np.uint64(30)
            columns.append(h)
    return np.stack(columns, axis=1) if words else np.zeros((0, 1), np.uint64)


def _keyed(n1: int, n2: int):
    """Batches (word, ...) to (key, word, upper): a key for each signature and length group. Group g compares words of
    g letters with each other and with those of g - 1, as one edit changes the length by one at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 20_000):
                column = batch.column(0).slice(a, 20_000)
                words = column.to_pylist()
                found = signatures(words, n1, n2)
                size = np.array([len(w) for w in words], np.uint64)
                for step, upper in ((np.uint64(0), True), (np.uint64(1), False)):
                    keys = (found ^ ((size + step) * np.uint64(0xD6E8FEB86659FD93))[:, None]) * np.uint64(0x9E3779B97F4A7C15)
                    n = keys.shape[1]
                    at = pa.array(np.repeat(np.arange(len(words)), n))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), column.take(at), pa.array(np.full(len(words) * n, upper))], ["key", "word", "upper"])

    return run


#: Words that share a key, of which one task compares at most so many at once; more are dealt out in pairs of parts.
PART = 500


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, word, upper) batches to the pairs of different words of each key that could be one edit apart."""

    def pairs(key: np.ndarray, word: pa.Array, upper: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.repeat(np.diff(np.concatenate([first, [len(key)]])), np.diff(np.concatenate([first, [len(key)]])))
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.concatenate([first, [len(key)]])))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d in range(1, int(size.max(initial=1))):
            at = np.flatnonzero(place + d < size)
            at = at[upper[at] | upper[at + d]]
            left.append(at)
            right.append(at + d)
        return pa.RecordBatch.from_arrays([word.take(pa.array(np.concatenate(x))) for x in (left, right)], ["a", "b"])

    def held(rest: list[pa.RecordBatch]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        table = pa.Table.from_batches(rest).combine_chunks()
        key, word, upper = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns)
        return key.to_numpy(zero_copy_only=False), word, upper.to_numpy(zero_copy_only=False)

    rest: list[pa.RecordBatch] = []
    for batch in batches:
        rest.append(batch)
        key, word, upper = held(rest)
        whole = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on in the next batch
        if whole:
            yield pairs(key[:whole], word.slice(0, whole), upper[:whole])
            rest = [pa.RecordBatch.from_arrays([pa.array(key[whole:]), word.slice(whole), pa.array(upper[whole:])], ["key", "word", "upper"])]
    if rest:
        yield pairs(*held(rest))


def _large(df: DataFrame) -> DataFrame:
    """df, not to be broadcast: it grows with the words, and its file, by whose size Spark judges, is a small part of what the
    driver would hold."""
    return df.hint("merge")


def near_words(words: DataFrame) -> DataFrame:
    """(word, other), both ways, of the distinct words that differ by exactly one inserted, deleted or replaced code point.

    PartEnum signatures are exact: an edit changes a letter multiset in DISTANCE places at most, so near words share a
    signature. They meet by it, and the edit distance decides. A signature that more than PART words share is dealt out
    by pairs of parts, so none is dropped and none is one task's.
    """
    spark = words.sparkSession
    n1, n2 = parts_for(words.count())
    keyed = words.select("word").mapInArrow(_keyed(n1, n2), "key long, word string, upper boolean")
    shared = keyed.groupBy("key").agg(F.count("*").alias("c"), F.max("upper").alias("any")).where("c > 1 and any").select("key", "c")
    keyed = keyed.join(_large(cut(shared, "shared-signatures")), "key")
    # part = a hash of the word; c words have p parts, and each pair of parts meets once
    p = F.ceil(F.col("c") * 2 / PART).cast("int")
    part = F.pmod(F.xxhash64("word", F.lit(3)), p).cast("int")
    other = F.explode(F.when(p > 1, F.sequence(F.lit(0), p - 1)).otherwise(F.array(F.lit(0))))
    dealt = keyed.select("key", "word", "upper", p.alias("p"), part.alias("part"), other.alias("other"))
    key = F.when(F.col("p") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.select(key.alias("key"), "word", "upper").repartition(tasks, "key").sortWithinPartitions("key")
    pairs = dealt.mapInArrow(_candidates, "a string, b string").where(F.levenshtein("a", "b", 1) == 1)
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-words")
    return pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))


def grouped(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for words (word, n): the near word of most occurrences, of equal ones the first
    in code-point order, is the form of a word that has a ratio-th of its occurrences at most; the root is the last form.

    Occurrences grow by ratio at each step, so roots are a few steps away; each pass doubles the steps.
    """
    known = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    near = near_words(words).join(_large(known), "other").groupBy("word").agg(F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"), F.count("*").alias("n_near"))
    base = words.join(_large(near), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.minus") >= ratio * F.col("n"), F.struct(F.col("best.other").alias("form"), (-F.col("best.minus")).alias("form_n"))).alias("hit"))
    base = cut(base, "forms")
    roots = cut(base.where("hit is not null").select("word", F.col("hit.form").alias("root")), "roots")
    while True:
        further = roots.join(_large(roots.select(F.col("word").alias("_w"), F.col("root").alias("_r"))), F.col("root") == F.col("_w"), "left")
        further = cut(further.select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        roots = further.select("word", "root")
        if further.where("moved").isEmpty():
            break
    out = base.join(_large(roots), "word", "left")
    return out.select("word", F.col("hit.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("hit.form_n").alias("form_n"))


def spelling_variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, edit: Edit | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of least_length letters that docs hold least_count times.

    Null and empty texts have no words; an empty table gives an empty one; repeated rows count each time, and further
    columns of docs take no part. Of ties for a form the first in code-point order wins.
    """
    words = word_counts(docs, text, doc_id, least_length, edit).where(F.col("n") >= least_count)
    return grouped(cut(words, "words"), ratio)


_BYTES = "list_transform(range(length({0}) // 2), lambda i: 16 * (instr('0123456789ABCDEF', substr({0}, 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr({0}, 2 * i + 2, 1)) - 1)"
_ROUND = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
SQL = rf"""
WITH RECURSIVE crc AS (
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: {_ROUND}) AS c FROM (SELECT unnest(range(256)) AS i))
), runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents
), counted AS (
    SELECT doc_id, w, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM runs GROUP BY doc_id, w
), hashed AS (
    SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {_BYTES.format("x")}::BIGINT[]), lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)]))) AS h FROM counted, crc
), words AS (
    SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM hashed)
    WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}
), places AS (
    SELECT word, n, unnest(range(1, length(word) + 2)) AS i FROM words
), holes AS (
    SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM places WHERE i <= length(word)
), gaps AS (
    SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i) AS tail FROM places
), near AS (
    SELECT a.word, b.word AS other, b.n AS m FROM holes a JOIN holes b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM holes a JOIN gaps b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail
    UNION SELECT b.word, a.word, a.n FROM holes a JOIN gaps b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail
), best AS (
    SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS other, max(m) AS m FROM near GROUP BY word
), forms AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= {RATIO} * w.n THEN b.other END AS form, CASE WHEN b.m >= {RATIO} * w.n THEN b.m END AS form_n
    FROM words w LEFT JOIN best b ON w.word = b.word
), steps AS (
    SELECT word, word AS at FROM forms UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON s.at = f.word WHERE f.form IS NOT NULL
), roots AS (
    SELECT s.word, s.at AS root FROM steps s JOIN forms f ON s.at = f.word WHERE f.form IS NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r ON f.word = r.word
"""


__all__ = ["SQL", "grouped", "misspelt", "near_words", "parts_for", "signatures", "spelling_variants", "word_counts"]
