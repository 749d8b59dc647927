"""Operator 3: benchmark decontamination by SimHash windows, Hamming blocks and exact weighted-shingle similarity.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case. For every benchmark item a window of the item's own
number of words slides over a document. A window's SimHash adds the signs of its words' hashed bits; running sums make
this a difference of two rows. Fingerprints (``BITS`` bits) are cut into ``BLOCKS`` wide blocks: two within ``RADIUS`` bits
differ in at most ``BLOCK_RADIUS`` bits of some block (pigeonhole), so no fingerprint within the radius is lost, and of
unrelated ones 4 of 100 pass. Then the whole distance must lie within the radius. Candidates are verified by the exact similarity of weighted shingles: five-word shingles weigh their
number of uses, the sum of minima over the sum of maxima must reach ``SIMILARITY``. Items with fewer words than a shingle
are one shingle.

A verified window shares a shingle with its item. That exact bound decides where windows have to be laid: at every
place from which the item's window would put a shared shingle where the item has it. All documents are read whole; all
windows so placed are fingerprinted and looked up among the items of their size. For what the index returns, the number
of the window's shingles that the item has bounds the sum of minima: pairs that cannot reach the similarity are not verified.

A window at the similarity may lie beyond the radius: a fifth of the weight in shingles leaves room for about (N-4)/9
changed words, on average 19 of 128 bits, with a deviation of 4; the tests measure the share that is lost.

The benchmark goes to the tasks in parts of about ``ITEM_BYTES`` of text (a broadcast of bounded size); a larger benchmark
takes a pass over the documents per part, whose result is written before the next part is sent. Nothing is shuffled but
an item's matches.

Null or empty items and documents match nothing. Repeated rows give repeated matches; equal items all match. One row per
(document row, item) has the best window (highest similarity, then first). Empty tables give no rows; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.llm.base import keep, mix, ship, windows, words_of

SHINGLE = 5
SIMILARITY = 0.8
BITS = 128
RADIUS = 39
BLOCKS = 4
BLOCK_RADIUS = RADIUS // BLOCKS
ITEM_BYTES = 16 << 20
FILTER_BITS = 22
#: Turns a word's hash into its second half.
SECOND = np.uint64(0xD1B54A32D192ED03)
STRETCH = 1 << 16
SCHEMA = "doc_id long, item_id long, start long, n_words long, similarity double, distance int"


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Shingle hashes in order; a shorter text is one shingle."""
    return windows(hashes, SHINGLE if len(hashes) >= SHINGLE else len(hashes)) if len(hashes) else hashes


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """Signs of the summed bits of each row, as ``BLOCKS`` numbers."""
    return np.packbits(sums > 0, axis=1).view(">u4").astype(np.uint32)


def signs(hashes: np.ndarray) -> np.ndarray:
    """Running sums of the words' bit signs, one row more than words."""
    both = np.stack([hashes, mix(hashes ^ SECOND)], axis=1).astype(">u8")
    bits = np.unpackbits(both.view(np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.int32) * 2 - 1
    return np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])


def lookup(prints: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, distances) of the fingerprints within the radius of ``value``: those near in a block, then the whole distance."""
    differ = np.bitwise_count(prints ^ value)
    rows = np.flatnonzero((differ <= BLOCK_RADIUS).any(axis=1))
    distance = differ[rows].sum(axis=1)
    return rows[distance <= RADIUS], distance[distance <= RADIUS]


def weighted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(hashes), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima of two weighted sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][i], b[1][j]).sum())
    high = int(a[1].sum() + b[1].sum()) - low
    return low / high if high else 0.0


class Index:
    """Items of one pass: shingle offsets, fingerprints in blocks, weighted shingles."""

    def __init__(self, items: list[tuple[int, str]]):
        hashed = [h[a:b] for _, h, offsets in words_of([t for _, t in items], True) for a, b in zip(offsets, offsets[1:], strict=False)]
        keep = [i for i, h in enumerate(hashed) if len(h)]
        self.ids = [items[i][0] for i in keep]
        self.words = [hashed[i] for i in keep]
        self.size = np.array([len(h) for h in self.words], np.int64)
        self.sets = [weighted(h) for h in self.words]
        prints = np.array([fingerprint(signs(h)[-1:])[0] for h in self.words], np.uint32).reshape(-1, BLOCKS)
        # the items of each size, with their fingerprints
        self.of_size = {int(n): (rows := np.flatnonzero(self.size == n), prints[rows]) for n in np.unique(self.size)}
        # where each shingle stands in which item, sorted by shingle
        parts = [shingles(h) for h in self.words]
        key = np.concatenate([*parts, np.zeros(0, np.uint64)])
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.item = np.repeat(np.arange(len(parts)), [len(p) for p in parts])[order]
        self.offset = np.concatenate([*[np.arange(len(p)) for p in parts], np.zeros(0, int)]).astype(np.int64)[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.key >> np.uint64(64 - FILTER_BITS)] = True
        self.short = sorted({len(h) for h in self.words if len(h) < SHINGLE})

    def places(self, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows (item size, window start) to lay windows at, from a document's shingles, and rows (item, place) of the
        shingles shared with each item; both distinct and sorted."""
        maybe = np.flatnonzero(self.filter[keys >> np.uint64(64 - FILTER_BITS)])
        low = np.searchsorted(self.key, keys[maybe], "left")
        many = np.searchsorted(self.key, keys[maybe], "right") - low
        if not many.sum():
            return np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64)
        at = np.repeat(maybe, many)
        entry = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        item = self.item[entry]
        size = self.size[item]
        # a window of the item's size that would overhang the text is moved inside
        start = np.clip(at - self.offset[entry], 0, np.maximum(0, n - size))
        return np.unique(np.stack([size, start], axis=1), axis=0), np.unique(np.stack([item, at], axis=1), axis=0)

    def matches(self, hashes: np.ndarray) -> list[tuple[int, int, int, float, int]]:
        """(item, start, words, similarity, distance) of the best window per item."""
        n = len(hashes)
        rows = [self.places(windows(hashes, SHINGLE), n)] if n >= SHINGLE else []
        for width in self.short:
            if n >= width:
                keys = windows(hashes, width)
                found, shared = self.places(keys, n)
                rows.append((found[found[:, 0] == width], shared[self.size[shared[:, 0]] == width]))
        place = np.concatenate([*(r for r, _ in rows), np.zeros((0, 2), np.int64)])
        if not len(place):
            return []
        # an item's shingles are of one width, so the rows of both kinds keep apart
        shared = np.concatenate([s for _, s in rows])
        held = np.sort(shared[:, 0] * (n + 1) + shared[:, 1])
        place = place[np.argsort(place[:, 1], kind="stable")]
        size, start = place[:, 0], place[:, 1]
        end = np.minimum(start + size, n)
        # running sums over stretches of bounded length: 256 bytes a word
        prints = np.zeros((len(place), BLOCKS), np.uint32)
        for part in np.unique(start // STRETCH):
            rows = np.flatnonzero(start // STRETCH == part)
            low = int(start[rows].min())
            sums = signs(hashes[low : int(end[rows].max())])
            prints[rows] = fingerprint(sums[end[rows] - low] - sums[start[rows] - low])
        best: dict[int, tuple] = {}
        for row, value in enumerate(prints):
            items, own = self.of_size[int(size[row])]
            near, distance = lookup(own, value)
            if not len(near):
                continue
            near = items[near]
            width, whole = (max(1, int(m) - SHINGLE + 1) for m in (end[row] - start[row], size[row]))
            first = near * (n + 1) + start[row]
            common = np.searchsorted(held, first + width) - np.searchsorted(held, first)
            # low / (width + whole - low) reaches the similarity
            able = (1 + SIMILARITY) * common >= SIMILARITY * (width + whole) - 1e-6
            for i, bits in zip(near[able].tolist(), distance[able].tolist(), strict=True):
                s = similarity(weighted(hashes[start[row] : end[row]]), self.sets[i])
                if s >= SIMILARITY and (i not in best or s > best[i][3]):
                    best[i] = (i, int(start[row]), int(end[row] - start[row]), s, bits)
        return list(best.values())


_built: dict[str, Index] = {}


def _index(items, name: str) -> Index:
    if name not in _built:
        _built.clear()
        _built[name] = Index(items.value)
    return _built[name]


def _clean(batches: Iterator[pa.RecordBatch], items, name: str) -> Iterator[pa.RecordBatch]:
    index = _index(items, name)
    for batch in batches:
        clean = np.ones(batch.num_rows, bool)
        for first, hashes, offsets in words_of(batch.column("text").to_pylist(), True):
            for k, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False)):
                clean[first + k] = not index.matches(hashes[a:b])
        yield batch.filter(pa.array(clean))


def _scan(batches: Iterator[pa.RecordBatch], items, name: str) -> Iterator[pa.RecordBatch]:
    index = _index(items, name)
    for batch in batches:
        keys = batch.column(0).to_pylist()
        out: list[tuple] = []
        for first, hashes, offsets in words_of(batch.column(1).to_pylist(), True):
            for k, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False)):
                out += [(keys[first + k], index.ids[m[0]], *m[1:]) for m in index.matches(hashes[a:b])]
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("doc_id", "item_id", "start", "n_words", "similarity", "distance"), r, strict=True)) for r in out],
            pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64()), ("distance", pa.int32())]))


def _passes(spark, benchmark: DataFrame, item_bytes: int) -> Iterator[tuple]:
    """(broadcast items, name, whether there are more parts) of about ``item_bytes`` each."""
    ship(spark)
    items = benchmark.where("text is not null").select("item_id", "text", F.octet_length("text").alias("size"))
    total = items.agg(F.sum("size")).first()[0] or 0
    # parts are dealt by hash: a quarter more of them leaves room for uneven ones
    parts = 1 if total <= item_bytes else int(1.25 * total // item_bytes) + 1
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).select("item_id", "text").collect()
        held = spark.sparkContext.broadcast(sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])))
        yield held, f"{spark.sparkContext.applicationId}-{held._jbroadcast.id()}", parts > 1
        if parts > 1:
            held.unpersist()


def find(docs: DataFrame, benchmark: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """One row per document and benchmark item that the document holds."""
    out = None
    for held, name, more in _passes(docs.sparkSession, benchmark, item_bytes):
        found = docs.select("doc_id", "text").mapInArrow(lambda b, h=held, n=name: _scan(b, h, n), SCHEMA)
        found = keep(found) if more else found
        out = found if out is None else out.unionByName(found)
    return out


def filter_leaks(docs: DataFrame, benchmark: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    for held, name, more in _passes(docs.sparkSession, benchmark, item_bytes):
        docs = docs.mapInArrow(lambda b, h=held, n=name: _clean(b, h, n), docs.schema)
        docs = keep(docs) if more else docs
    return docs
