"""Shared pieces of the training-data operators: readers, cut lineage, word hashes, components, numbering.

Nothing outside this subpackage imports it. Python kernels run inside Arrow batches; ``ship`` puts the package on the
executors once per Spark context, so that kernels are imported there and caches live as long as a Python worker.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekpanel.session import cut_lineage

#: ASCII white space: the separators of words in every contract here.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything in ASCII but letters and digits.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])

_rng = np.random.default_rng(20240607)
#: Odd multipliers for windows of words, and a random odd value per byte.
WINDOW_MULT = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 2**64)
_shipped: set[str] = set()
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors (once per Spark context), and keep Arrow batches of texts small."""
    context = spark.sparkContext
    # ten thousand texts, the default, are tens of megabytes per batch and worker, more with long texts
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # the driver's file server hands the file to executors, late ones too: it stays until the driver ends
    folder = tempfile.mkdtemp(prefix="weekpanel-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "weekpanel_kernels.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for place, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(place, name)
                    archive.write(full, os.path.join("weekpanel", os.path.relpath(full, root)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def keep(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder; survives lost executors."""
    return cut_lineage(df)


def mix(values: np.ndarray) -> np.ndarray:
    """Finalising mixer on uint64 (bijective)."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        base = np.full(max(n, 2 * len(have)), _ODD if kind == "up" else _ODD_INVERSE, np.uint64)
        base[0] = 1
        have = _powers[kind] = np.cumprod(base, dtype=np.uint64)
    return have


def _pieces(data: bytes, limit: int) -> Iterator[bytes]:
    """A very long text cut at white space into pieces of about ``limit`` bytes."""
    start = 0
    while len(data) - start > limit:
        cut = re.compile(rb"[\x20\x09-\x0D]").search(data, start + limit)
        if not cut:
            break
        yield data[start : cut.start()]
        start = cut.start()
    yield data[start:]


def word_spans(buf: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of a buffer."""
    edge = np.diff(np.concatenate(([True], separators[buf], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums of values (uint64), one more than values."""
    n = len(values) + 1
    total = np.zeros(n, np.uint64)
    np.cumsum(values * _power("up", n)[: n - 1], out=total[1:])
    return total


def hash_spans(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span, from prefix sums: moved to a common origin, then mixed."""
    return mix((total[ends] - total[starts]) * _power("down", len(total))[starts] + (ends - starts).astype(np.uint64))


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every byte span."""
    return hash_spans(prefix_sums(_BYTE[buf]), starts, ends) if len(starts) else np.zeros(0, np.uint64)


@dataclass
class Run:
    """Texts of a batch side by side: bytes, word spans and hashes, and where each text's bytes and words begin.

    ``text`` is the index of the first text. A text beyond the limit comes in several runs of one text each; ``last`` is
    false for all but its last one.
    """

    text: int
    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    words: np.ndarray
    bytes: np.ndarray
    last: bool = True

    @property
    def n(self) -> int:
        return len(self.bytes) - 1

    def hashes(self) -> np.ndarray:
        return hash_words(self.buf, self.starts, self.ends)


def runs_of(texts: list, lower: bool = False, separators: np.ndarray = SPACE, limit: int = 1 << 19, cut: bool = True) -> Iterator[Run]:
    """Runs of about ``limit`` bytes; null and empty texts have no words. Every text is followed by one line feed.

    Without ``cut`` a longer text is one run, at about 60 bytes of memory a byte."""
    held: list[bytes] = []
    first = size = 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if lower:
            data = data.lower()
        if len(data) > limit:
            if held:
                yield _run(first, held, separators)
            parts = list(_pieces(data, limit)) if cut else [data]
            for k, piece in enumerate(parts):
                run = _run(i, [piece], separators)
                run.last = k == len(parts) - 1
                yield run
            held, first, size = [], i + 1, 0
            continue
        held.append(data)
        size += len(data) + 1
        if size > limit:
            yield _run(first, held, separators)
            held, first, size = [], i + 1, 0
    if held:
        yield _run(first, held, separators)


def _run(first: int, held: list[bytes], separators: np.ndarray) -> Run:
    buf = np.frombuffer(b"\n".join(held) + b"\n", np.uint8)
    starts, ends = word_spans(buf, separators)
    edges = np.concatenate(([0], np.cumsum([len(x) + 1 for x in held])))
    return Run(first, buf, starts, ends, np.searchsorted(starts, edges), edges)


def words_of(texts: list, lower: bool, separators: np.ndarray = SPACE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text index, word hashes, offsets of each text's words) in runs; a very long text is put together again."""
    held: list[np.ndarray] = []
    for run in runs_of(texts, lower, separators):
        hashes = run.hashes()
        if not run.last or held:
            held.append(hashes)
            if run.last:
                whole = np.concatenate(held)
                yield run.text, whole, np.array([0, len(whole)])
                held = []
            continue
        yield run.text, hashes, run.words


class SpanTable:
    """Token ids of byte spans seen before, as an open-addressing table in arrays.

    ``learn`` gives the ids of new spans. About 40 bytes a span; beyond ``most`` spans the table starts anew.
    """

    def __init__(self, kind: np.dtype, learn: Callable[[list[bytes]], list[np.ndarray]], most: int = 1 << 21):
        self.kind, self.learn, self.most = kind, learn, most
        self._clear(1 << 16)

    def _clear(self, slots: int) -> None:
        self.shift = np.uint64(64 - slots.bit_length() + 1)
        self.key, self.start, self.size = np.zeros(slots, np.uint64), np.zeros(slots, np.int64), np.zeros(slots, np.int32)
        self.pool, self.used, self.n = np.zeros(1 << 16, self.kind), 0, 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash, or -1."""
        at = (hashes >> self.shift).astype(np.int64)
        out = np.full(len(hashes), -1)
        left = np.arange(len(hashes))
        while len(left):
            key = self.key[at]
            hit = key == hashes[left]
            out[left[hit]] = at[hit]
            on = ~hit & (key != 0)
            left, at = left[on], (at[on] + 1) & (len(self.key) - 1)
        return out

    def _place(self, hashes: np.ndarray) -> np.ndarray:
        """Slots for new distinct hashes."""
        out = np.full(len(hashes), -1)
        left, at = np.arange(len(hashes)), (hashes >> self.shift).astype(np.int64)
        while len(left):
            free = self.key[at] == 0
            self.key[at[free]] = hashes[left[free]]
            won = self.key[at] == hashes[left]
            out[left[won]] = at[won]
            left, at = left[~won], (at[~won] + 1) & (len(self.key) - 1)
        return out

    def _grow(self, room: int) -> None:
        slots = len(self.key)
        if 2 * (self.n + room) <= slots:
            return
        while 2 * (self.n + room) > slots:
            slots *= 2
        old = self.key, self.start, self.size
        used = np.flatnonzero(old[0])
        self.shift = np.uint64(64 - slots.bit_length() + 1)
        self.key, self.start, self.size = np.zeros(slots, np.uint64), np.zeros(slots, np.int64), np.zeros(slots, np.int32)
        at = self._place(old[0][used])
        self.start[at], self.size[at] = old[1][used], old[2][used]

    def ids(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all spans in a row, and the number of ids of each span."""
        hashes = np.maximum(hash_words(buf, starts, ends), np.uint64(1))
        slots = self._find(hashes)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            new, first = np.unique(hashes[missing], return_index=True)
            if self.n and self.n + len(new) > self.most:
                self._clear(1 << 16)
                return self.ids(buf, starts, ends)
            data = buf.tobytes()
            found = self.learn([data[starts[i] : ends[i]] for i in missing[first].tolist()])
            sizes = np.array([len(x) for x in found], np.int64)
            self._grow(len(new))
            while self.used + sizes.sum() > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + sizes.sum()] = np.concatenate([*found, np.zeros(0, self.kind)])
            at = self._place(new)
            self.start[at], self.size[at] = self.used + np.cumsum(sizes) - sizes, sizes
            self.used, self.n = self.used + int(sizes.sum()), self.n + len(new)
            slots = self._find(hashes)
        size = self.size[slots].astype(np.int64)
        ends_ = np.cumsum(size)
        place = np.repeat(self.start[slots] - (ends_ - size), size) + np.arange(ends_[-1] if len(size) else 0)
        return self.pool[place], size


def gap_spans(texts: list[bytes], limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last text, bytes, span starts, ends, offsets of each text's spans) in runs of about ``limit`` bytes.

    Spans begin at every space and line feed (which they hold) and at every text's begin."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size < limit):
            size += len(texts[last])
            last += 1
        buf = np.frombuffer(b"".join(texts[first:last]), np.uint8)
        edges = np.concatenate(([0], np.cumsum([len(t) for t in texts[first:last]])))
        begin = (buf == 0x20) | (buf == 0x0A)
        begin[edges[:-1][edges[:-1] < len(buf)]] = True
        starts = np.flatnonzero(begin)
        yield first, last, buf, starts, np.append(starts[1:], len(buf)), np.searchsorted(starts, edges)
        first = last


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words (order matters)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += hashes[k : k + n] * WINDOW_MULT[k]
    return mix(total)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) with the smallest node of each component, from (a, b) rows, for the nodes that have an edge.

    Min-label hooking with pointer jumping: every round joins labels to both ends, takes the minimum per node (map-side
    combined) and jumps to the label's label. A hub is one key of a combinable minimum, never a collected group.
    """
    spark = edges.sparkSession
    edges = keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    for _ in range(max_rounds):
        # hook: the smallest root among the neighbours
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").select(F.col("a").alias("node"), "root")
        own = labels.select(F.col("root").alias("node"), "root")
        # a root takes the smallest root that any of its members sees
        seen = near.join(labels.select("node", F.col("root").alias("old")), "node").select(F.col("old").alias("node"), "root")
        least = near.unionByName(seen).unionByName(own).groupBy("node").agg(F.min("root").alias("root"))
        least = keep(least.join(labels.select("node", F.col("root").alias("old")), "node", "full").select(
            "node", F.coalesce(F.least("root", "old"), "old", "root").alias("root"), "old"))
        # jump: the root of the root
        up = least.select(F.col("node").alias("root"), F.col("root").alias("up"))
        jumped = keep(least.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"), "old"))
        moved = jumped.where("old is null or root < old").limit(1).count()
        labels = jumped.select("node", "root")
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds ({spark.sparkContext.appName})")


def numbered(df: DataFrame, group: str, bucket, order: list, name: str) -> DataFrame:
    """Gapless numbers from 0 within ``group``, ordered by ``bucket`` (a small integer column) and then by ``order``.

    Two levels: a count per (group, bucket), whose running sums are a table of bounded size (groups x buckets), and a row
    number inside one bucket. No task holds a whole group.
    """
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(group, "_bucket").count()
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_bucket").orderBy(*order)
    out = df.withColumn("_row", F.row_number().over(inside)).join(F.broadcast(starts), [group, "_bucket"])
    return out.withColumn(name, F.col("_start") + F.col("_row") - 1).drop("_bucket", "_start", "_row")


def small(df: DataFrame, rows: int, weight: str = "1") -> DataFrame:
    """Materialised ``df``: to be broadcast up to ``rows`` rows, joined by a shuffle (with skew handling) beyond them.

    Rows of unequal size count by ``weight``, an expression."""
    table = keep(df)
    return F.broadcast(table) if (table.agg(F.sum(F.expr(weight))).first()[0] or 0) <= rows else table
