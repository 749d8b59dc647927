"""Operator 5: token ids in an entropy-coded file format (static range asymmetric numeral system).

* Texts are encoded by the ``tokenizers`` library. White space decides where its pre-tokenizer must cut, so the ids of
  a word with its leading space come from a bounded table per worker and only unseen words go through the library's
  model; texts with runs of white space go through the library whole.
* Documents are packed by parts: ranges of ids with about ``PART_ROWS`` rows each, cut at quantiles of the ids (and
  evenly between them in very large tables), so that dense, sparse and hashed ids give parts of one size. An id that
  fills several parts (one id in many rows, or null ids) is dealt over them. One compressed row per part and batch is
  shuffled by part, and token counts are summed over all documents into one shared frequency table (at most one row
  per token of the vocabulary).
* Each part is written in ascending id order as independent blocks. The tokens of a block are dealt over interleaved
  lanes; every ``STRIDE`` steps a checkpoint holds the lanes' states and the stream position.
* Readers decode every block from its checkpoints: segment by segment, each with its own states and piece of the stream.
  Segments of blocks beyond ``DEAL_TOKENS`` (one giant document) are dealt over tasks. Checksums of the pieces are joined
  into those of documents and of the block, which must equal the stored one.

The files are Parquet: ``blocks`` (one row per block) and ``table`` (token, frequency). Only the frequency table reaches
the driver, and the bounds of the parts. A null text is empty and holds only the end id; repeated rows stay separate
documents, in the order of their ids' bytes unless they fill several parts; a null id sorts first; an empty table gives no
rows. Blocks hold whole documents, so a writer's memory follows the longest document; a reader's does not.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekpanel.llm.base import SpanTable, gap_spans, keep, mix, ship
from weekpanel.session import checkpoint_dir

BITS = 20
LOW = np.uint64(1 << 31)
LANES = 2048
STRIDE = 64
BLOCK_TOKENS = 1 << 19
PART_ROWS = 1024
MOST_BOUNDS = 4096
DEAL_TOKENS = 1 << 20
NO_ID = -(1 << 63)
CACHE_PIECES = 200_000
#: Runs of white space, and white space other than a space or line feed: such texts are encoded whole.
_RUNS = ("  ", " \n", "\n ", "\n\n")
_OTHER = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
BATCH = 1024
_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Ids of texts, with a table of words seen before."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.width = 2 if self.model.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        # the model's letter for each byte: its own pre-tokenizer tells
        letters = {b: self._letter(b) for b in range(128)}
        free = iter(range(0x100, 0x200))
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        self.letters = {b: chr(b) if b in plain else chr(next(free)) for b in range(256)}
        if any(self.letters[b] != x for b, x in letters.items() if x):
            raise ValueError("only byte-level models are read")
        self.pieces: dict[str, np.ndarray] = {}
        self.table = SpanTable(self.kind, self._learn)

    def _letter(self, byte: int) -> str:
        said = self.model.pre_tokenizer.pre_tokenize_str(chr(byte))
        return said[0][0] if said else ""

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _learn(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of unseen words: cut by the tokenizer's pattern, each piece through its model."""
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        known, tokenize, out = self.pieces, self.model.model.tokenize, []
        for word in words:
            ids = []
            for piece in self.cut(word.decode("utf-8", "surrogatepass")):
                got = known.get(piece)
                if got is None:
                    letters = piece.encode("utf-8", "surrogatepass").decode("latin1").translate(self.letters)
                    got = known[piece] = [t.id for t in tokenize(letters)]
                ids += got
            out.append(np.array(ids, self.kind))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and their number per text."""
        odd = [any(x in t for x in _RUNS) or any(x in t for x in _OTHER) for t in texts]
        plain = [b"" if o else t.encode("utf-8", "surrogatepass") for t, o in zip(texts, odd, strict=True)]
        parts, sizes = [], np.zeros(len(texts), np.int64)
        for first, last, buf, starts, ends, offsets in gap_spans(plain):
            ids, count = self.table.ids(buf, starts, ends)
            at = np.concatenate(([0], np.cumsum(count)))[offsets]
            sizes[first:last] = np.diff(at)
            done = 0
            for i in range(first, last):
                if odd[i]:
                    parts += [ids[done : at[i - first]], self.whole(texts[i])]
                    sizes[i], done = len(parts[-1]), at[i - first]
            parts.append(ids[done : at[-1]])
        return np.concatenate([*parts, np.zeros(0, self.kind)]), sizes


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


@dataclass
class Model:
    """Static frequencies scaled to 2^BITS; every occurring token has at least one slot."""

    freq: np.ndarray
    start: np.ndarray
    slots: np.ndarray

    @staticmethod
    def of(tokens: list[int], counts: list[int]) -> "Model":
        size = (max(tokens) + 1) if tokens else 1
        count = np.zeros(size, np.float64)
        count[tokens] = counts
        used = count > 0
        freq = np.zeros(size, np.int64)
        total = 1 << BITS
        if used.any():
            freq[used] = np.maximum(1, np.floor(count[used] / count.sum() * total)).astype(np.int64)
            spare = total - int(freq.sum())
            order = np.argsort(-freq, kind="stable")
            if spare > 0:
                freq[order[0]] += spare
            for k in order:
                if spare >= 0:
                    break
                cut = min(-spare, int(freq[k]) // 2)
                freq[k] -= cut
                spare += cut
        start = np.concatenate(([0], np.cumsum(freq)[:-1]))
        slots = np.repeat(np.arange(size), freq).astype(np.uint32)
        return Model(freq.astype(np.uint64), start.astype(np.uint64), slots)


def encode_block(tokens: np.ndarray, model: Model, lanes: int) -> tuple[bytes, bytes, list[int], list[bytes]]:
    """(final states, words, stream position and states per checkpoint)."""
    state = np.full(lanes, LOW, np.uint64)
    chunks: list[np.ndarray] = []
    steps = -(-len(tokens) // lanes)
    freq, begin = model.freq[tokens], model.start[tokens]
    limit = freq << np.uint64(63 - BITS)
    marks: list[tuple[int, bytes]] = []
    written = 0
    bits, half, mask = np.uint64(BITS), np.uint64(32), np.uint64(0xFFFFFFFF)
    for step in range(steps - 1, -1, -1):
        a, b = step * lanes, min((step + 1) * lanes, len(tokens))
        x = state[: b - a]
        full = x >= limit[a:b]
        out = x[full]
        chunks.append((out & mask).astype(np.uint32))
        written += len(out)
        x[full] = out >> half
        quotient, rest = np.divmod(x, freq[a:b])
        x[:] = (quotient << bits) + rest + begin[a:b]
        if step and step % STRIDE == 0:
            marks.append((written, state.tobytes()))
    words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, np.uint32)
    marks.reverse()
    return state.tobytes(), words.tobytes(), [len(words) - at for at, _ in marks], [s for _, s in marks]


def decode_block(n: int, states: bytes, words: bytes, model: Model, lanes: int, step: int = 0, position: int = 0) -> np.ndarray:
    """Tokens from ``step`` on, given the lanes' states and stream position there."""
    x = np.frombuffer(states, "<u8").copy()
    stream = np.frombuffer(words, "<u4").astype(np.uint64)
    out = np.empty(n - step * lanes, np.uint32)
    bits, half, mask = np.uint64(BITS), np.uint64(32), np.uint64((1 << BITS) - 1)
    at, end = position, 0
    while end < len(out):
        live = min(lanes, len(out) - end)
        y = x[:live]
        slot = y & mask
        token = model.slots[slot]
        y[:] = model.freq[token] * (y >> bits) + slot - model.start[token]
        low = np.flatnonzero(y < LOW)
        y[low] = (y[low] << half) | stream[at : at + len(low)]
        at += len(low)
        out[end : end + live] = token
        end += live
    return out


@dataclass
class Parts:
    """Ascending bounds of the ids (with repeats for an id that fills several parts), and parts between two bounds."""

    bounds: np.ndarray
    fine: int
    least: int = 0
    most: int = 0

    def of(self, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Part of each id; ``places`` number the rows and deal those of an id that fills several parts."""
        low, high = (np.searchsorted(self.bounds, ids, side) for side in ("left", "right"))
        drawn = mix(places.astype(np.uint64) + np.uint64(1))
        # an id on two bounds or more has whole ranges of its own between them
        own = high - low > 1
        coarse = low + own + (drawn % np.where(own, high - low - 1, high - low + 1).astype(np.uint64)).astype(np.int64)
        if self.fine == 1 or not len(self.bounds):
            return coarse
        ends = np.concatenate(([min(self.least, self.bounds[0])], self.bounds, [max(self.most, self.bounds[-1])])).astype(float)
        begin, size = ends[coarse], ends[coarse + 1] - ends[coarse]
        inside = np.where(size > 0, (ids.astype(float) - begin) / np.where(size > 0, size, 1.0), 0.0)
        # in a range of one id its rows are dealt again
        inside = np.where(size == 0, (drawn >> np.uint64(40)).astype(float) / 2**24, inside)
        inside = np.where(ids < begin, 0.0, inside)  # null, below every id
        return coarse * self.fine + np.clip((inside * self.fine).astype(np.int64), 0, self.fine - 1)


def parts_of(docs: DataFrame, part_rows: int, most_bounds: int) -> Parts:
    """Bounds at quantiles of the ids of all rows."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"))
    rows = ids.count()
    many = -(-rows // part_rows)
    coarse = min(many, most_bounds)
    if coarse < 2:
        return Parts(np.zeros(0, np.int64), 1)
    cuts = [k / coarse for k in range(1, coarse)]
    known = F.when(F.col("id") > NO_ID, F.col("id"))
    found = ids.agg(F.percentile_approx("id", cuts, max(10_000, 10 * coarse)), F.min(known), F.max(known)).first()
    return Parts(np.array(found[0], np.int64), -(-many // coarse), found[1] or 0, found[2] or 0)


def _pack(batches: Iterator[pa.RecordBatch], path: str, end_id: int, parts: Parts) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    coder = encoder(path)
    squeeze = zstandard.ZstdCompressor(1)
    place = TaskContext.get().partitionId() << 40
    for whole in batches:
        for first in range(0, whole.num_rows, BATCH):
            batch = whole.slice(first, BATCH)
            keys = batch.column(0).to_pylist()
            ids, sizes = coder.encode([t or "" for t in batch.column(1).to_pylist()])
            ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
            ends = np.cumsum(sizes)
            own = parts.of(np.array([NO_ID if k is None else k for k in keys], np.int64), np.arange(place, place + len(keys)))
            place += len(keys)
            groups: dict[int, list[int]] = {}
            for i, part in enumerate(own.tolist()):
                groups.setdefault(part, []).append(i)
            for part, rows in groups.items():
                body = ids if len(groups) == 1 else np.concatenate([ids[ends[i] - sizes[i] : ends[i]] for i in rows])
                yield pa.RecordBatch.from_arrays([
                    pa.array([part], pa.int64()), pa.array([[keys[i] for i in rows]], pa.list_(pa.int64())),
                    pa.array([sizes[rows].tolist()], pa.list_(pa.int32())),
                    pa.array([squeeze.compress(body.tobytes())], pa.binary())], ["part", "ids", "lens", "data"])


PACK = "part long, ids array<long>, lens array<int>, data binary"


def _counts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    open_ = zstandard.ZstdDecompressor()
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for data in batch.column(3):
            tokens = np.frombuffer(open_.decompress(data.as_py()), f"<u{width}")
            count = np.bincount(tokens, minlength=len(total))
            if len(count) > len(total):
                total = np.pad(total, (0, len(count) - len(total)))
            total[: len(count)] += count
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["token", "n"])


BLOCK = ("part long, block int, ids array<long>, lens array<int>, lanes int, states binary, words binary, "
         "at array<int>, marks array<binary>, crc long")


def _write_part(part: int, packs: list[tuple], model: Model, width: int) -> Iterator[pa.RecordBatch]:
    keys = [k for p in packs for k in p[0]]
    lens = np.array([n for p in packs for n in p[1]], np.int64)
    tokens = np.concatenate([p[2] for p in packs])
    ends = np.cumsum(lens)
    # ids first, then the content, so that repeated ids have one order
    order = sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i] or 0, tokens[ends[i] - lens[i] : ends[i]].tobytes()))
    number, at = 0, 0
    while at < len(order):
        rows, size = [], 0
        while at < len(order) and (not rows or size + lens[order[at]] <= BLOCK_TOKENS):
            rows.append(order[at])
            size += int(lens[order[at]])
            at += 1
        body = np.concatenate([tokens[ends[i] - lens[i] : ends[i]] for i in rows])
        lanes = max(1, min(LANES, size // 64))
        states, words, places, marks = encode_block(body, model, lanes)
        yield pa.RecordBatch.from_arrays([
            pa.array([part], pa.int64()), pa.array([number], pa.int32()), pa.array([[keys[i] for i in rows]], pa.list_(pa.int64())),
            pa.array([[int(lens[i]) for i in rows]], pa.list_(pa.int32())), pa.array([lanes], pa.int32()), pa.array([states], pa.binary()),
            pa.array([words], pa.binary()), pa.array([places], pa.list_(pa.int32())), pa.array([marks], pa.list_(pa.binary())),
            pa.array([zlib.crc32(body.astype("<u4").tobytes())], pa.int64())],
            ["part", "block", "ids", "lens", "lanes", "states", "words", "at", "marks", "crc"])
        number += 1


def _blocks(batches: Iterator[pa.RecordBatch], table, width: int) -> Iterator[pa.RecordBatch]:
    model, open_ = Model.of(*table.value), zstandard.ZstdDecompressor()
    part, packs = None, []
    for batch in batches:
        for row in zip(*(batch.column(k) for k in range(4)), strict=True):
            if packs and row[0].as_py() != part:
                yield from _write_part(part, packs, model, width)
                packs = []
            part = row[0].as_py()
            packs.append((row[1].as_py(), row[2].as_py(), np.frombuffer(open_.decompress(row[3].as_py()), f"<u{width}")))
    if packs:
        yield from _write_part(part, packs, model, width)


def _powers() -> list[int]:
    """x^(2^k) modulo the checksum's polynomial (bits reversed)."""
    out = [1 << 30]
    for _ in range(31):
        out.append(_multiply(out[-1], out[-1]))
    return out


def _multiply(a: int, b: int) -> int:
    """Product of two polynomials modulo that of crc32."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return out


POWERS = _powers()


def join_crc(first: int, second: int, size: int) -> int:
    """crc32 of two pieces in a row; ``size``: bytes of the second."""
    moved, n, k = 1 << 31, 8 * size, 0
    while n:
        if n & 1:
            moved = _multiply(POWERS[k % 32], moved)
        n, k = n >> 1, k + 1
    return _multiply(moved, first) ^ second


def segments(row: dict) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(number, first token, tokens, states, piece of the stream) from each checkpoint of a block to the next."""
    total, lanes = sum(row["lens"]), row["lanes"]
    places, states = [0, *row["at"], len(row["words"]) // 4], [row["states"], *row["marks"]]
    for k, state in enumerate(states):
        first = k * STRIDE * lanes
        yield k, first, min(total, first + STRIDE * lanes) - first, state, row["words"][4 * places[k] : 4 * places[k + 1]]


def pieces(ends: np.ndarray, first: int, tokens: np.ndarray) -> list[tuple[int, int, int]]:
    """(document, tokens, crc32) of a segment that begins at token ``first``; ``ends``: where the documents end."""
    out, at, last = [], first, first + len(tokens)
    k = int(np.searchsorted(ends, first, "right"))
    while at < last:
        to = min(last, int(ends[k]))
        out.append((k, to - at, zlib.crc32(tokens[at - first : to - first].tobytes())))
        at, k = to, k + 1
    return out


DOC = "part long, block int, doc_id long, at long, n_tokens long, ids_crc32 long"
NAMES = ["part", "block", "doc_id", "at", "n_tokens", "ids_crc32"]


def _documents(part: int, block: int, ids: list, lens: list[int], crc: int, found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    """Rows of a block from the pieces of its segments in order; their joined checksum must be the stored one."""
    whole, own, seen = 0, [0] * len(lens), [0] * len(lens)
    for k, n, piece in found:
        own[k] = join_crc(own[k], piece, 4 * n) if seen[k] else piece
        seen[k] += n
    for n, value in zip(lens, own, strict=True):
        whole = join_crc(whole, value, 4 * n) if whole else value
    if seen != list(lens) or whole != crc:
        raise ValueError(f"checksum of block {block} in part {part}")
    ends = np.cumsum(np.array(lens, np.int64))
    return pa.RecordBatch.from_arrays([
        pa.array([part] * len(lens), pa.int64()), pa.array([block] * len(lens), pa.int32()), pa.array(ids, pa.int64()),
        pa.array(ends - np.array(lens, np.int64)), pa.array(lens, pa.int64()), pa.array(own, pa.int64())], NAMES)


def _read(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    model = Model.of(*table.value)
    for batch in batches:
        for row in batch.to_pylist():
            found, ends = [], np.cumsum(np.array(row["lens"], np.int64))
            for _, first, n, states, words in segments(row):
                found += pieces(ends, first, decode_block(n, states, words, model, row["lanes"]).astype("<u4"))
            yield _documents(row["part"], row["block"], row["ids"], row["lens"], row["crc"], found)


SEGMENT = "part long, block int, number int, first long, n long, lanes int, states binary, words binary, lens array<int>"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            for number, first, n, states, words in segments(row):
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["part"]], pa.int64()), pa.array([row["block"]], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()),
                    pa.array([n], pa.int64()), pa.array([row["lanes"]], pa.int32()), pa.array([states], pa.binary()), pa.array([words], pa.binary()),
                    pa.array([row["lens"]], pa.list_(pa.int32()))], ["part", "block", "number", "first", "n", "lanes", "states", "words", "lens"])


def _decode(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    model = Model.of(*table.value)
    for batch in batches:
        for row in batch.to_pylist():
            tokens = decode_block(row["n"], row["states"], row["words"], model, row["lanes"]).astype("<u4")
            for k, n, crc in pieces(np.cumsum(np.array(row["lens"], np.int64)), row["first"], tokens):
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["part"]], pa.int64()), pa.array([row["block"]], pa.int32()), pa.array([row["number"]], pa.int32()),
                    pa.array([k], pa.int32()), pa.array([n], pa.int64()), pa.array([crc], pa.int64())], ["part", "block", "number", "k", "n", "crc"])


def _joined(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: (r["number"], r["k"]))
    head = rows[0]
    return pa.Table.from_batches([_documents(head["part"], head["block"], head["ids"], head["lens"], head["whole"], [(r["k"], r["n"], r["crc"]) for r in rows])])


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, part_rows: int = PART_ROWS,
                 most_bounds: int = MOST_BOUNDS) -> str:
    """Encode (doc_id, text) rows and write them; returns the folder with ``blocks`` and ``table``."""
    spark = docs.sparkSession
    ship(spark)
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    width = encoder(tokenizer).width
    parts = parts_of(docs, part_rows, most_bounds)
    packed = docs.select("doc_id", "text").mapInArrow(lambda b: _pack(b, tokenizer, end_id, parts), PACK)
    packed = keep(packed.repartition("part").sortWithinPartitions("part"))
    counts = packed.mapInArrow(lambda b: _counts(b, width), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = sorted((r["token"], r["n"]) for r in counts.collect())  # bounded by the vocabulary
    table = spark.sparkContext.broadcast(([t for t, _ in found], [n for _, n in found]))
    spark.createDataFrame(found, "token long, n long").coalesce(1).write.parquet(f"{folder}/table")
    packed.mapInArrow(lambda b: _blocks(b, table, width), BLOCK).write.option("compression", "none").parquet(f"{folder}/blocks")
    return folder


def read_tokens(spark: SparkSession, folder: str, deal_tokens: int = DEAL_TOKENS) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files."""
    ship(spark)
    found = sorted((r["token"], r["n"]) for r in spark.read.parquet(f"{folder}/table").collect())
    table = spark.sparkContext.broadcast(([t for t, _ in found], [n for _, n in found]))
    blocks = spark.read.parquet(f"{folder}/blocks")
    size = F.aggregate("lens", F.lit(0).cast("long"), lambda a, n: a + n)
    near = blocks.where(size <= deal_tokens).mapInArrow(lambda b: _read(b, table), DOC)
    giant = blocks.where(size > deal_tokens)
    dealt = giant.mapInArrow(_segments, SEGMENT).repartition("part", "block", "number").mapInArrow(
        lambda b: _decode(b, table), "part long, block int, number int, k int, n long, crc long")
    heads_of = giant.select("part", "block", "ids", "lens", F.col("crc").alias("whole"))
    docs = near.unionByName(dealt.join(heads_of, ["part", "block"]).groupBy("part", "block").applyInArrow(_joined, DOC))
    # running sums over parts and blocks from the headers alone, in two levels
    heads = blocks.select("part", "block", size.alias("n"), F.shiftright("part", 12).alias("coarse"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = heads.groupBy("coarse").agg(F.sum("n").alias("n"))
    coarse = coarse.withColumn("first", before(Window.orderBy("coarse"))).select("coarse", "first")
    inner = heads.withColumn("within", before(Window.partitionBy("coarse").orderBy("part", "block")))
    starts = inner.join(coarse, "coarse").select("part", "block", (F.col("first") + F.col("within")).alias("first"))
    return docs.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
