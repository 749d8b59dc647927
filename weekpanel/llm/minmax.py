"""Operator 7: near-duplicates by min-max hashing.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case; a document's set holds its distinct five-word shingles
(with fewer words the whole sequence is one). Documents with 100 * intersection >= ``percent`` * union are linked;
components of links are labelled by their smallest id, and that document is kept. The operator's contract is ``PERCENT``;
stages without one of their own take ``STAGE_PERCENT``.

* Both the minimum and the maximum under each of ``HASHES`` permutations enter the signature, so 160 evaluations give 320
  values. A band holds as many permutations as let a pair at the bound miss all bands with probability ``MISS`` at most:
  four at 85 of 100 (40 bands, 3e-6), three at 80 (53 bands, 1e-7).
* Equal sets form one class, found by a combinable aggregate, and only classes go on.
* Classes that share a band are tied to the band's smallest id (a star, never all pairs), and the heads of a class's stars to
  one another; connected ties are a cluster, and each class's set is sent to its cluster once. There the full sets are compared through an inverted index: first
  all against the most typical member; pairs of two members linked to it need no test of their own, since the component
  is the same; every other member is compared with all. A cluster beyond ``BLOCK`` shingles is split into blocks, one task
  for each two of them. Nothing is capped.

Null texts and texts without words have an empty set, are linked with nothing and kept. Rows with the same id count as
one document. Empty tables give no rows; columns besides the id and text are ignored. Nothing but loop counters reaches
the driver; the ids of clustered classes are broadcast up to a checked size and joined by a shuffle beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.llm.base import WINDOW_MULT, components, keep, mix, ship, small, windows, words_of

SHINGLE = 5
PERCENT = 85
STAGE_PERCENT = 80
HASHES = 160
MISS = 1e-5
BLOCK = 2_000_000
BROADCAST_ROWS = 2_000_000
_random = np.random.default_rng(85)
MULTIPLIERS = _random.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """Distinct shingles, sorted."""
    return np.unique(windows(hashes, min(SHINGLE, len(hashes)))) if len(hashes) else hashes


def sets_of(texts: list) -> Iterator[tuple[int, list[np.ndarray]]]:
    for first, hashes, offsets in words_of(texts, True):
        yield first, [shingle_set(hashes[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]


def band_rows(percent: int) -> int:
    """Permutations a band, as many as keep the miss of a pair at the bound within ``MISS``."""
    fit = [r for r in range(1, 17) if (1 - (percent / 100) ** (2 * r)) ** (HASHES // r) <= MISS]
    if not fit:
        raise ValueError(f"{HASHES} permutations cannot find pairs at {percent} of 100")
    return max(fit)


def bands(values: np.ndarray, starts: np.ndarray, rows: int) -> np.ndarray:
    """Band keys, a row for each set; the sets lie in a row and begin at ``starts``."""
    many = HASHES // rows
    out = np.zeros((len(starts), many), np.uint64)
    for k in range(many * rows):
        h = values * MULTIPLIERS[k]
        low, high = np.minimum.reduceat(h, starts), np.maximum.reduceat(h, starts)
        out[:, k // rows] += low * WINDOW_MULT[2 * (k % rows)] + high * WINDOW_MULT[2 * (k % rows) + 1]
    return mix(out + np.arange(many, dtype=np.uint64) * WINDOW_MULT[63])


_SIGNED = "doc_id long, n_shingles long, a long, b long, keys array<long>"


def _sign(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for first, sets in sets_of(batch.column(1).to_pylist()):
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            ends = np.cumsum(n)
            values = np.concatenate([*sets, np.zeros(0, np.uint64)])
            keys = [None] * len(sets)
            digest = np.zeros((2, len(sets)), np.int64)
            if len(full):
                starts = (ends - n)[full]
                # many short sets at a time keep the products in the processor's cache
                for at in range(0, len(full), 64):
                    part = full[at : at + 64]
                    low, high = ends[part[0]] - n[part[0]], ends[part[-1]]
                    for i, row in zip(part, bands(values[low:high], (ends - n)[part] - low, rows).view(np.int64), strict=True):
                        keys[i] = row
                for k in range(2):
                    digest[k, full] = np.add.reduceat(mix(values ^ WINDOW_MULT[40 + k]), starts).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                ids.slice(first, len(sets)), pa.array(n), pa.array(digest[0]), pa.array(digest[1]), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "a", "b", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, sets in sets_of(batch.column("text").to_pylist()):
            part = batch.slice(first, len(sets))
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("cluster"), part.column("parts"), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["doc_id", "cluster", "parts", "data"])


def links(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between the members of a cluster, enough of them to span its components."""
    n = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), n)
    _, token, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(token, kind="stable")
    member = owner[order]
    first = np.concatenate(([0], np.cumsum(many)))
    ends = np.cumsum(n)
    parent = np.arange(len(sets))
    out: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def compare(i: int) -> np.ndarray:
        own = token[ends[i] - n[i] : ends[i]]
        size = many[own]
        place = np.repeat(first[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        common = np.bincount(member[place], minlength=len(sets))
        near = np.flatnonzero(100 * common >= percent * (n + n[i] - common))
        for j in near.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(ids[i]), int(ids[j])))
        return near

    typical = int(np.argmax(np.bincount(owner, weights=many[token], minlength=len(sets)) / np.maximum(n, 1)))
    core = np.zeros(len(sets), bool)
    core[compare(typical)] = True
    # a member without a shared shingle has no link
    shared = np.bincount(owner, weights=many[token] > 1, minlength=len(sets))
    for i in np.flatnonzero(~core & (100 * shared >= percent * n)).tolist():
        compare(i)
    return out


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    name, ids, sets = None, [], []

    def done() -> pa.RecordBatch:
        found = links(np.array(ids), sets, percent) if len(ids) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    for batch in batches:
        for cluster, i, j, doc, data in zip(*(batch.column(c) for c in ("cluster", "i", "j", "doc_id", "data")), strict=True):
            key = (cluster.as_py(), i.as_py(), j.as_py())
            if key != name and ids:
                yield done()
                ids, sets = [], []
            name = key
            ids.append(doc.as_py())
            sets.append(np.frombuffer(data.as_py(), np.uint64))
    if ids:
        yield done()


def _ties(heads: DataFrame) -> DataFrame:
    """(a, b) rows with the components of the (a, node) rows: a node is tied to its smallest head only, and that head to the
    node's others, which many nodes have in common. A node has at most a head for each band."""
    held = heads.groupBy("node").agg(F.min("a").alias("a"), F.collect_set("a").alias("heads"))
    return held.select("a", F.explode(F.array_union(F.array("node"), "heads")).alias("b")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    spark, rows = docs.sparkSession, band_rows(percent)
    ship(spark)
    docs = docs.select("doc_id", "text")
    signed = keep(docs.mapInArrow(lambda b: _sign(b, rows), _SIGNED))
    digest = ["a", "b", "n_shingles"]
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = keep(full.groupBy(*digest).agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys")))
    buckets = classes.select("node", F.explode("keys").alias("key"))
    stars = buckets.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    clusters = components(_ties(buckets.join(stars, "key").where("node <> a").select("a", "node"))).withColumnRenamed("root", "cluster")
    weight = classes.join(clusters, "node").groupBy("cluster").agg(F.sum("n_shingles").alias("weight"))
    parts = F.ceil(F.col("weight") / BLOCK).cast("int").alias("parts")
    members = small(clusters.join(weight.select("cluster", parts), "cluster").withColumnRenamed("node", "doc_id"), BROADCAST_ROWS)
    sets = docs.join(members, "doc_id").select("doc_id", "cluster", "parts", "text").mapInArrow(
        _sets, "doc_id long, cluster long, parts int, data binary")
    # a member of block p meets every other block q once, in the task of the pair
    own = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    other = F.explode(F.when(F.col("parts") < 2, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: q != F.col("p"))))
    dealt = sets.withColumn("p", own).withColumn("q", other).select(
        "cluster", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "doc_id", "data")
    pairs = dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "doc_id")
    found = components(pairs.mapInArrow(lambda b: _verify(b, percent), "a long, b long"))
    named = found.select(F.col("node"), "root")
    roots = classes.select(*digest, "node").join(named, "node", "left").select(*digest, F.coalesce("root", "node").alias("root"))
    out = signed.select("doc_id", *digest).join(roots, digest, "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def filter_near_duplicates(docs: DataFrame, percent: int = STAGE_PERCENT) -> DataFrame:
    """``docs`` with one document of each component: the rows whose id is not among those that go."""
    gone = near_duplicates(docs, percent).where("not kept").select("doc_id").distinct()
    return docs.join(small(gone, BROADCAST_ROWS), "doc_id", "left_anti").select(*docs.columns)
