"""Operator 13: ranked lexical search over length-ordered impact vectors (norm buckets with coordinate bounds).

Every text becomes a vector of impacts, one per term that some query holds: ``w * ((10^9 tf) div (1000 tf + 8 m))`` with the
rarity ``w`` of the term and the length factor ``m`` of the text. A task orders the vectors of a run of documents by their
Euclidean length and cuts them into buckets of similar length. For a query with the tenth best score ``t`` so far, a bucket
is skipped if its greatest length times the query's length stays below ``t`` (Cauchy-Schwarz), or if the sum of the query's
weights times the bucket's greatest impact per coordinate does. Inside a bucket the coordinates are taken by their greatest
possible share; after them, a document whose partial score plus the bound of the rest (the lesser of the coordinates'
maxima and the Cauchy-Schwarz bound of what is left of both vectors) stays below ``t`` is dropped. The survivors are scored
exactly, in 64-bit integers. Bounds are floating-point numbers with room to spare, and equal scores survive, so the result
does not depend on them.

In Spark: one pass over the texts writes the vectors (term hashes and counts, restricted by a bit table of fixed size that
holds every query term); document frequencies are partial counts per task, summed by term; queries are taken in parts of
at most about ``PART`` terms, which bounds what the driver and a task hold of them; a first search over a bounded number of
documents only gives lower bounds of the tenth best scores, then every document is searched, and each task returns at most
ten rows per query that reach the bound. No vectors are shuffled, and no task holds more than a run of them.

Terms are compared by 64-bit hashes. Defined results: null or empty texts have no terms and are never returned; a query
without terms has no rows; repeated queries are ranked each on its own; repeated documents each take a rank; equal scores
go by ascending doc_id (null first); empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekpanel.llm.base import NOT_ALNUM, keep, ship, words_of

#: Constants of the score (fixed values): b in percent, the scale of impacts.
B_PERCENT, SCALE = 75, 1_000_000_000
TOP = 10
#: Bits of the table of query terms (2 MB), query terms of a part, postings of a run, documents of a bucket.
TABLE_BITS = 24
PART = 1 << 20
RUN_POSTINGS = 1 << 21
BUCKET = 1024
#: Documents searched first for lower bounds.
FIRST_DOCS = 1 << 15
#: Room for rounding in the bounds.
EASE = 1 + 1e-9
NO_ID = np.iinfo(np.int64).min


def term_counts(texts: list) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, terms of each text with repeats, text of each entry, term hash, count), entries by (text, hash)."""
    for first, hashes, at in words_of(texts, True, NOT_ALNUM):
        n = np.diff(at)
        yield first, n, *_counted(np.repeat(np.arange(len(n)), n), hashes)


def _counted(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    starts = np.flatnonzero(new)
    return text[starts], hashes[starts], np.diff(np.append(starts, len(text)))


def _slot(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - TABLE_BITS)


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive slices of ``values`` as a binary column."""
    ends = np.concatenate(([0], np.cumsum(sizes))) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def vector_batches(batches, table: np.ndarray | None):
    """(key, n, terms, counts) for batches of (key, text); only terms in the bit table, if there is one."""
    for batch in batches:
        sizes, totals = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        terms, counts = [], []
        for first, n, text, hashes, tf in term_counts(batch.column(1).to_pylist()):
            totals[first : first + len(n)] = n
            if table is not None:
                slot = _slot(hashes)
                in_table = (table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
                text, hashes, tf = text[in_table], hashes[in_table], tf[in_table]
            sizes[first : first + len(n)] = np.bincount(text, minlength=len(n))
            terms.append(hashes)
            counts.append(tf.astype(np.uint32))
        yield pa.record_batch([
            batch.column(0), pa.array(totals), _binary(np.concatenate([np.zeros(0, np.uint64), *terms]), sizes),
            _binary(np.concatenate([np.zeros(0, np.uint32), *counts]), sizes)], ["key", "n", "terms", "counts"])


def slot_batches(batches):
    """(word, bits): words of the bit table that a batch's terms set."""
    for batch in batches:
        slot = np.unique(_slot(_flat(batch.column(0), np.uint64)[0]))
        word, start = np.unique(slot >> np.uint64(6), return_index=True)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (slot & np.uint64(63)), start) if len(slot) else np.zeros(0, np.uint64)
        yield pa.record_batch([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])


def frequency_batches(batches):
    """(term, df): documents per term, summed over runs of batches."""
    held, size = [], 0

    def summed():
        terms, df = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch([pa.array(terms.view(np.int64)), pa.array(df.astype(np.int64))], ["term", "df"])

    for batch in batches:
        held.append(_flat(batch.column(0), np.uint64)[0])
        size += len(held[-1])
        if size > RUN_POSTINGS:
            yield summed()
            held, size = [], 0
    if held:
        yield summed()


def _flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column in a row, and how many each row has."""
    values = [np.frombuffer(x, kind) for x in column.to_pylist()]
    return np.concatenate([np.zeros(0, kind), *values]), np.array([len(v) for v in values], np.int64)


@dataclass
class Queries:
    """A part of the queries: rows of (term, weight) one after another, the sorted terms with their rarity, bounds."""

    at: np.ndarray  # offsets of the queries
    term: np.ndarray  # places in ``terms``
    weight: np.ndarray  # how often the query holds the term
    terms: np.ndarray
    rarity: np.ndarray
    n_docs: int
    n_terms: int
    least: np.ndarray  # a lower bound of each query's tenth best score, at least 1

    def __len__(self) -> int:
        return len(self.at) - 1

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of each query's values."""
        return np.bincount(np.repeat(np.arange(len(self)), np.diff(self.at)), weights=values, minlength=len(self))


@dataclass
class Run:
    """Vectors of some documents: document and place in the terms of each posting, and its impact."""

    keys: np.ndarray
    doc: np.ndarray
    term: np.ndarray
    impact: np.ndarray

    @classmethod
    def of(cls, batches: list[pa.RecordBatch], q: Queries) -> Run:
        keys, n, docs, hashes, counts = [], [], [], [], []
        first = 0
        for batch in batches:
            keys.append(batch.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False))
            n.append(batch.column(1).to_numpy(zero_copy_only=False))
            flat, sizes = _flat(batch.column(2), np.uint64)
            hashes.append(flat)
            counts.append(_flat(batch.column(3), np.uint32)[0])
            docs.append(np.repeat(np.arange(first, first + len(sizes)), sizes))
            first += len(sizes)
        n, docs, hashes, tf = (np.concatenate(x) for x in (n, docs, hashes, counts))
        place = np.minimum(np.searchsorted(q.terms, hashes), max(0, len(q.terms) - 1))
        known = q.terms[place] == hashes if len(q.terms) else np.zeros(len(hashes), bool)
        docs, place, tf = docs[known], place[known], tf[known].astype(np.int64)
        m = 100 - B_PERCENT + (B_PERCENT * n.astype(np.int64) * q.n_docs) // q.n_terms
        return cls(np.concatenate(keys), docs, place, q.rarity[place] * (SCALE * tf // (1000 * tf + 8 * m[docs])))


class Best:
    """The ten best (score, key) of each query so far."""

    def __init__(self, q: Queries):
        self.least = q.least.copy()
        self.score = [np.zeros(0, np.int64)] * len(q)
        self.key = [np.zeros(0, np.int64)] * len(q)

    def add(self, i: int, score: np.ndarray, key: np.ndarray) -> None:
        score, key = np.concatenate([self.score[i], score]), np.concatenate([self.key[i], key])
        order = np.lexsort((key, -score))[:TOP]
        self.score[i], self.key[i] = score[order], key[order]
        if len(order) == TOP:
            self.least[i] = max(self.least[i], self.score[i][-1])


def search_run(run: Run, q: Queries, best: Best) -> None:
    """All queries against the vectors of a run, bucket by bucket from the longest on."""
    n = len(run.keys)
    squares = np.bincount(run.doc, weights=run.impact.astype(float) ** 2, minlength=n)
    by_length = np.argsort(-squares, kind="stable")
    rank = np.empty(n, np.int64)
    rank[by_length] = np.arange(n)
    # postings by bucket, then term
    place = rank[run.doc]
    order = np.lexsort((run.term, place // BUCKET))
    place, term, impact = place[order], run.term[order], run.impact[order]
    edges = np.searchsorted(place // BUCKET, np.arange(-(-n // BUCKET) + 1))
    q_squares = q.sums(q.weight.astype(float) ** 2)
    for b in range(len(edges) - 1):
        a, z = edges[b], edges[b + 1]
        first = b * BUCKET
        docs = by_length[first : first + BUCKET]
        length = squares[docs]
        # Cauchy-Schwarz over the bucket
        alive = np.sqrt(q_squares * length[0]) * EASE >= best.least
        if not alive.any() or a == z:
            continue
        heads, starts = np.unique(term[a:z], return_index=True)
        ends = np.append(starts[1:], z - a)
        most = np.zeros(len(q.terms), np.int64)
        most[heads] = np.maximum.reduceat(impact[a:z], starts)
        start, end = np.zeros(len(q.terms), np.int64), np.zeros(len(q.terms), np.int64)
        start[heads], end[heads] = a + starts, a + ends
        share = q.weight * most[q.term]
        for i in np.flatnonzero(alive & (q.sums(share) * EASE >= best.least)):
            found = _search(i, q, share, most, start, end, place, impact, length, first, best.least[i])
            if found is not None:
                best.add(i, found[1], run.keys[docs[found[0]]])


def _search(i: int, q: Queries, share, most, start, end, place, impact, length, first, least) -> tuple[np.ndarray, np.ndarray] | None:
    """(places in the bucket, exact scores of at least ``least``) of one query."""
    rows = slice(q.at[i], q.at[i + 1])
    here = np.flatnonzero(share[rows])
    terms, weights, shares = q.term[rows][here], q.weight[rows][here], share[rows][here]
    order = np.argsort(-shares, kind="stable")
    terms, weights, shares = terms[order], weights[order], shares[order]
    rest = np.append(np.cumsum(shares[::-1])[::-1], 0)  # the most that the terms from k on can add
    rest_square = np.append(np.cumsum((weights.astype(float) ** 2)[::-1])[::-1], 0)
    score, seen = np.zeros(len(length), np.int64), np.zeros(len(length))
    # a document without any of the first k terms cannot reach the bound
    k = int(np.searchsorted(-rest, -least, side="right"))
    for t, w in zip(terms[:k], weights[:k], strict=True):
        at = place[start[t] : end[t]] - first
        score[at] += w * impact[start[t] : end[t]]
        seen[at] += impact[start[t] : end[t]].astype(float) ** 2
    # what is left of both vectors bounds what the other terms can add
    left = np.sqrt(rest_square[k] * np.maximum(length * EASE - seen, 0))
    alive = np.flatnonzero((score > 0) & (score + np.minimum(rest[k], left) * EASE >= least))
    if not len(alive):
        return None
    for t, w in zip(terms[k:], weights[k:], strict=True):
        at = place[start[t] : end[t]] - first
        own = np.isin(at, alive) if len(alive) < len(length) else slice(None)
        score[at[own]] += w * impact[start[t] : end[t]][own]
    alive = alive[score[alive] >= least]
    return (alive, score[alive]) if len(alive) else None


def search_batches(batches, q: Queries):
    """(query, doc_id, score): the ten best of the task's documents for each query, from its lower bound on."""
    best = Best(q)
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(2).nbytes // 8
        if size > RUN_POSTINGS:
            search_run(Run.of(held, q), q, best)
            held, size = [], 0
    if held:
        search_run(Run.of(held, q), q, best)
    if len(q):
        keys, scores = np.concatenate(best.key), np.concatenate(best.score)
        query = np.repeat(np.arange(len(q)), [len(s) for s in best.score])
        yield pa.record_batch([pa.array(query), pa.array(keys, mask=keys == NO_ID), pa.array(scores)], ["query", "doc_id", "score"])


def _vectors(rows: DataFrame, table: np.ndarray | None) -> DataFrame:
    kind = dict(rows.dtypes)["key"]
    return keep(rows.mapInArrow(lambda batches: vector_batches(batches, table), f"key {kind}, n long, terms binary, counts binary"))


def _bit_table(queries: DataFrame) -> np.ndarray:
    """The bit table of all query terms: at most 2^18 words reach the driver."""
    words = queries.select("terms").mapInArrow(slot_batches, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = words.toArrow()
    table = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return table


def _ranked(found: DataFrame, *columns) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP).select("query", "rank", "doc_id", "score", *columns)


def search(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", query_key: str = "item_id",
           query_text: str = "text", part: int = PART, first_docs: int = FIRST_DOCS) -> DataFrame:
    """item_id, rank, doc_id, score: the ten best documents of every query."""
    spark = docs.sparkSession
    ship(spark)
    asked = _vectors(queries.select(F.col(query_key).alias("key"), F.col(query_text).alias("text")), None)
    asked = keep(asked.where("n > 0").withColumn("size", F.octet_length("terms") / 8))
    vectors = _vectors(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), _bit_table(asked))
    n_docs, n_terms = vectors.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    result = spark.createDataFrame([], f"item_id {dict(queries.dtypes)[query_key]}, rank int, doc_id long, score long")
    postings = asked.agg(F.sum("size")).first()[0] or 0
    if not n_docs or not postings:
        return result
    counted = vectors.select("terms").mapInArrow(frequency_batches, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = keep(counted)
    parts = math.ceil(postings / part)
    share = first_docs / n_docs
    for p in range(parts):
        own = asked.where(F.pmod(F.xxhash64("key", "terms"), F.lit(parts)) == p).orderBy("key", "terms")
        own = own.select("key", "terms", "counts").toArrow()
        if not own.num_rows:
            continue
        q = _queries(spark, own, df, n_docs, n_terms)

        def run(rows, q=q):
            return rows.mapInArrow(lambda batches: search_batches(batches, q), "query long, doc_id long, score long")

        if share < 1:  # any documents give valid lower bounds
            few = vectors.where(F.pmod(F.xxhash64("key", "terms"), F.lit(1 << 30)) < int(share * (1 << 30)))
            tenth = _ranked(run(few.repartition(max(1, first_docs >> 12)))).where(F.col("rank") == TOP).toArrow()
            q.least[tenth["query"].to_numpy()] = np.maximum(tenth["score"].to_numpy(), 1)
        names = spark.createDataFrame(own.select(["key"]).append_column("query", pa.array(np.arange(own.num_rows))))
        names = names.select("query", F.col("key").cast(dict(queries.dtypes)[query_key]).alias("item_id"))
        found = _ranked(keep(run(vectors))).join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int"), "doc_id", "score")
        result = result.unionByName(found)
    return result


def _queries(spark, own: pa.Table, df: DataFrame, n_docs: int, n_terms: int) -> Queries:
    """The queries of a part, with the rarity of their terms."""
    hashes, sizes = _flat(own["terms"].combine_chunks(), np.uint64)
    counts = _flat(own["counts"].combine_chunks(), np.uint32)[0].astype(np.int64)
    wanted = np.unique(hashes)
    asked = spark.createDataFrame(pa.table({"term": pa.array(wanted.view(np.int64))}))
    found = df.join(asked, "term").toArrow()
    order = np.argsort(found["term"].to_numpy().view(np.uint64))
    terms, freq = found["term"].to_numpy().view(np.uint64)[order], found["df"].to_numpy()[order]
    rarity = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in freq], np.int64)
    # terms that no document holds add nothing
    place = np.minimum(np.searchsorted(terms, hashes), max(0, len(terms) - 1))
    known = terms[place] == hashes if len(terms) else np.zeros(len(hashes), bool)
    held = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[known], minlength=len(sizes))
    at = np.concatenate(([0], np.cumsum(held)))
    return Queries(at, place[known], counts[known], terms, rarity, int(n_docs), int(n_terms), np.ones(len(sizes), np.int64))
