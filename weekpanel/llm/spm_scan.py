"""Operator 2: SentencePiece encoding as a max-plus scan, and decoding.

The pieces and scores of a SentencePiece model define the best segmentation of the normalised text: the highest sum of
scores, among equals the one that takes the longest piece at each position, seen from the end. (For a model of type BPE
this is the unigram reading of its vocabulary; ids and decoding are those of the model.) A character without a piece of
its own costs the lowest score less ten and is written as byte pieces.

* Texts up to ``CHUNK`` characters are encoded at once. No piece holds ``▁`` behind another character (checked when the
  model is loaded), so segmentations always cut before such a ``▁`` and words can be looked up in a bounded cache.
* Longer texts are cut into chunks. The state at a chunk's boundary is the distance to the last cut (0 to the longest
  piece less one); a chunk yields the max-plus matrix from entry to exit states. Matrices of one text are combined
  associatively into the true score vector at every boundary. Given that vector, each chunk backtraces on its own: for
  every exit state the entry state it leads to and the ids between. Composing these maps from the end picks one path.

Null and empty texts have no ids. ``▁`` in a text is read as a space, as the library does. Repeated rows stay separate; an
empty table gives no rows; columns besides the id and text are ignored. Nothing reaches the driver.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.llm.base import SpanTable, gap_spans, hash_spans, keep, mix, prefix_sums, ship

CHUNK = 1 << 15
CHUNKS = 64
BATCH = 512
SHORT = 40
MOST_WORDS = 1 << 18
TABLE_BITS = 18
CACHE_SEGMENTS = 10_000
BAR = "▁"
_CUTS = re.compile(f"(?<=[^{BAR}])(?={BAR})")
LOWEST = float("-inf")
_loaded: dict[str, "Pieces"] = {}


class Pieces:
    """A piece table with its encoder."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(f"ﬁ  a\n") != f"{BAR}ﬁ{BAR}{BAR}a\n":
            raise ValueError("only models with identity normalisation and a leading mark are read")
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.bytes = [0] * 256
        self.surface: list[bytes] = []
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            plain = not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            else:
                self.surface.append(piece.replace(BAR, " ").encode() if plain else b"")
                if plain:
                    self.score[piece], self.id[piece] = model.get_score(i), i
        if any(_CUTS.search(p) or "\n" in p for p in self.score):
            raise ValueError("a piece holds the mark behind another character, or a line feed")
        self.longest = max(map(len, self.score))
        self.unknown = min(self.score.values()) - 10
        # what each id adds to a sum of scores: a character in byte pieces counts once, with its first byte
        self.worth = np.array([self.score.get(model.id_to_piece(i), 0.0) for i in range(model.vocab_size())])
        for value, i in enumerate(self.bytes):
            self.worth[i] = 0.0 if 0x80 <= value < 0xC0 else self.unknown
        # surfaces of all ids as one run of bytes
        self.surface_size = np.array([len(s) for s in self.surface], np.int64)
        self.surface_start = np.cumsum(self.surface_size) - self.surface_size
        self.surface_bytes = np.frombuffer(b"".join(self.surface), np.uint8)
        # every begin of a piece; those that are no piece score lowest
        self.tree = {p[:k]: LOWEST for p in self.score for k in range(1, len(p) + 1)} | self.score
        self.kind = np.dtype("<u2" if model.vocab_size() <= 1 << 16 else "<u4")
        self.table = SpanTable(self.kind, self._learn, MOST_WORDS)
        # the begins as a table of hashes, for many words at once
        names = list(self.tree)
        self.row_score, self.row_id = np.array([self.tree[p] for p in names]), np.array([self.id.get(p, -1) for p in names], np.int32)
        code = np.frombuffer("".join(names).encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(p) for p in names])
        hashes = np.maximum(hash_spans(prefix_sums(_values(code)), ends - [len(p) for p in names], ends), np.uint64(1))
        self.keys, self.rows = np.zeros(1 << TABLE_BITS, np.uint64), np.zeros(1 << TABLE_BITS, np.int32)
        for row, value in enumerate(hashes.tolist()):
            at = value >> (64 - TABLE_BITS)
            while self.keys[at]:
                at = (at + 1) & ((1 << TABLE_BITS) - 1)
            self.keys[at], self.rows[at] = value, row
        self.segments: dict[str, tuple[bytes, float]] = {}

    def forward(self, text: str, first: np.ndarray | None = None) -> tuple[list[float], list[int]]:
        """Best score and last cut per position; ``first``: scores of the first positions that are known already.

        Begins are taken in ascending order and only a higher score replaces one, so equals keep the longest piece."""
        n = len(text)
        best, back = [LOWEST] * (n + 1), [-1] * (n + 1)
        known = 1
        if first is None:
            best[0] = 0.0
        else:
            known = len(first)
            best[:known] = first.tolist()
        look, unknown, longest = self.tree.get, self.unknown, self.longest
        for i in range(n):
            at = best[i]
            if at == LOWEST:
                continue
            value = look(text[i])
            if (value is None or value == LOWEST) and i + 1 >= known and at + unknown > best[i + 1]:
                best[i + 1], back[i + 1] = at + unknown, i
            end = i
            while value is not None:
                end += 1
                if at + value > best[end] and end >= known:
                    best[end], back[end] = at + value, i
                if end == n or end - i == longest:
                    break
                value = look(text[i : end + 1])
        return best, back

    def ids_between(self, text: str, back: list[int], end: int, stop: int) -> tuple[list[int], int]:
        """Ids of the path that ends at ``end``, back to the first cut at or before ``stop``."""
        out: list[int] = []
        look = self.id.get
        while end > stop:
            piece = text[back[end] : end]
            known = look(piece)
            if known is None:
                out.extend(self.bytes[x] for x in reversed(piece.encode("utf-8", "surrogatepass")))
            else:
                out.append(known)
            end = back[end]
        out.reverse()
        return out, end

    def segment(self, text: str) -> tuple[bytes, float]:
        """Ids and score of a normalised string that segmentations cannot cross."""
        if (got := self.segments.get(text)) is None:
            best, back = self.forward(text)
            ids = self.ids_between(text, back, len(text), 0)[0]
            got = np.array(ids, self.kind).tobytes(), best[-1]
            if len(self.segments) > CACHE_SEGMENTS:
                self.segments.clear()
            if len(text) < 64:
                self.segments[text] = got
        return got

    def _learn(self, words: list[bytes]) -> list[np.ndarray]:
        texts = [w.decode("utf-8", "surrogatepass") for w in words]
        # no piece holds a line feed, so that a word behind one has no mark and is cut there
        texts = [t if t[:1] == "\n" else BAR + t.removeprefix(" ") for t in texts]
        short = [i for i, t in enumerate(texts) if 0 < len(t) <= SHORT]
        out: list = [None] * len(texts)
        for at in range(0, len(short), 8_000):
            part = short[at : at + 8_000]
            for i, ids in zip(part, self.side_by_side([texts[i] for i in part]), strict=True):
                out[i] = ids
        for i, text in enumerate(texts):
            if out[i] is None:
                out[i] = np.array(self.ids_between(text, self.forward(text)[1], len(text), 0)[0], self.kind)
        return out

    def _look(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hashed begin of a piece, or -1."""
        at = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        out = np.full(len(hashes), -1, np.int32)
        left = np.arange(len(hashes))
        while len(left):
            key = self.keys[at]
            hit = key == hashes[left]
            out[left[hit]] = self.rows[at[hit]]
            on = ~hit & (key != 0)
            left, at = left[on], (at[on] + 1) & ((1 << TABLE_BITS) - 1)
        return out

    def side_by_side(self, texts: list[str]) -> list[np.ndarray | None]:
        """``forward`` and ``ids_between`` for many short strings at once; None where a character needs several bytes."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        size = np.array([len(texts[i]) for i in order])
        code = np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum(size)
        first, end_of = ends - size, np.repeat(ends, size)
        total = prefix_sums(_values(code))
        # score and id of the piece of each length at each position
        score = np.full((self.longest, len(code)), LOWEST)
        piece = np.full((self.longest, len(code)), -1, np.int32)
        at = np.arange(len(code))
        for k in range(self.longest):
            row = self._look(np.maximum(hash_spans(total, at, at + k + 1), np.uint64(1)))
            at, row = at[row >= 0], row[row >= 0]
            score[k, at], piece[k, at] = self.row_score[row], self.row_id[row]
            at = at[at + k + 1 < end_of[at]]
        alone = score[0] == LOWEST
        score[0, alone] = self.unknown
        hard = np.zeros(len(texts), bool)
        np.logical_or.at(hard, np.repeat(np.arange(len(texts)), size)[alone & (code >= 128)], True)
        piece[0, alone] = np.array(self.bytes)[np.minimum(code[alone], 255)]
        # one place more than characters for every string
        base = first + np.arange(len(texts))
        best, back = np.full(len(code) + len(texts), LOWEST), np.zeros(len(code) + len(texts), np.int64)
        best[base] = 0.0
        live = np.searchsorted(-size, -np.arange(size[0] + 1), "left")
        for t in range(size[0]):
            n = live[t]
            for k in range(self.longest):
                m = min(n, live[t + k]) if t + k < size[0] else 0
                if not m:
                    break
                value = best[base[:m] + t] + score[k, first[:m] + t]
                to = base[:m] + t + k + 1
                better = value > best[to]
                best[to[better]], back[to[better]] = value[better], t
        found: list[np.ndarray] = []
        string, cut = np.arange(len(texts)), size.copy()
        while len(string):
            start = back[base[string] + cut]
            found.append(np.stack([string, start, piece[cut - start - 1, first[string] + start]]))
            on = start > 0
            string, cut = string[on], start[on]
        string, start, ids = np.concatenate(found, axis=1)
        put = np.lexsort((start, string))
        parts = np.split(ids[put].astype(self.kind), np.cumsum(np.bincount(string, minlength=len(texts)))[:-1])
        out: list = [None] * len(texts)
        for k, i in enumerate(order):
            out[i] = None if hard[k] else parts[k]
        return out

    def whole(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.segment(s)[0] for s in _CUTS.split(normal(text)) if s), self.kind)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and their number per text."""
        odd = [t[:1] in " \n" or "  " in t or BAR in t for t in texts]
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

    def join(self, surfaces: list[bytes]) -> str:
        text = b"".join(surfaces).decode("utf-8", "surrogatepass")
        return text[1:] if text[:1] == " " else text

    def decode(self, ids) -> str:
        """The text of ids: byte pieces joined, marks read as spaces, the leading one dropped."""
        return self.join([self.surface[i] for i in ids])

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the surfaces of ids, and where each id's begin (one more than ids)."""
        size = self.surface_size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ids) else 0
        return self.surface_bytes[np.repeat(self.surface_start[ids] - (ends - size), size) + np.arange(total)], np.concatenate(([0], ends))

    def middle(self, text: str) -> np.ndarray:
        """Ids of a part of a normalised text that begins and ends at cuts."""
        if BAR + BAR in text:  # a run of marks is one word with what follows it
            return np.frombuffer(b"".join(self.segment(x)[0] for x in _CUTS.split(text) if x), self.kind)
        found = [self.table.ids(buf, starts, ends)[0] for _, _, buf, starts, ends, _ in gap_spans([text.replace(BAR, " ").encode("utf-8", "surrogatepass")])]
        return np.concatenate([np.zeros(0, self.kind), *found])

    def transfer(self, text: str, context: int) -> np.ndarray:
        """Max-plus matrix of a chunk: entry state (cut ``s`` before its begin) to exit state (cut ``t`` before its end)."""
        size = self.longest
        out = np.full((size, size), LOWEST)
        cuts = [m.start() for m in _CUTS.finditer(text) if m.start() >= context]
        if not cuts:
            for s in range(min(size, context + 1)):
                first = np.full(context + 1, LOWEST)
                first[context - s] = 0.0
                best = self.forward(text, first)[0]
                for t in range(min(size, len(text) - context + 1 + context)):
                    out[s, t] = best[len(text) - t]
            return out
        head, tail = text[: cuts[0]], text[cuts[-1] :]
        middle = self.worth[self.middle(text[cuts[0] : cuts[-1]])].sum()
        last = self.forward(tail)[0]
        for s in range(min(size, context + 1)):
            first = np.full(context + 1, LOWEST)
            first[context - s] = 0.0
            at = self.forward(head, first)[0][-1]
            for t in range(min(size, len(tail) + 1)):
                out[s, t] = at + middle + last[len(tail) - t]
        return out

    def backtrace(self, text: str, context: int, entry: np.ndarray) -> tuple[list[int], bytes, list[bytes]]:
        """Entry state per exit state (-1: no path), ids common to all paths, and the further ids per exit state.

        ``entry``: true scores of the entry states."""
        size = self.longest
        first = np.array([entry[context - i] for i in range(context + 1)])
        cuts = [m.start() for m in _CUTS.finditer(text) if m.start() >= context]
        pack = lambda ids: np.array(ids, self.kind).tobytes()
        to, tails, common = [-1] * size, [b""] * size, b""
        if not cuts:
            best, back = self.forward(text, first)
            for t in range(min(size, len(text) + 1)):
                if best[len(text) - t] > LOWEST:
                    ids, cut = self.ids_between(text, back, len(text) - t, context)
                    to[t], tails[t] = context - cut, pack(ids)
            return to, common, tails
        head, tail = text[: cuts[0]], text[cuts[-1] :]
        ids, cut = self.ids_between(head, self.forward(head, first)[1], len(head), context)
        middle = self.middle(text[cuts[0] : cuts[-1]]).tobytes()
        back = self.forward(tail)[1]
        for t in range(min(size, len(tail) + 1)):
            to[t], tails[t] = context - cut, pack(self.ids_between(tail, back, len(tail) - t, 0)[0])
        return to, pack(ids) + middle, tails


def _values(code: np.ndarray) -> np.ndarray:
    return mix(code.astype(np.uint64) + np.uint64(0x51ED2701))


def normal(text: str) -> str:
    return BAR + text.replace(" ", BAR) if text else ""


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product (associative)."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def prefixes(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Products of the first 0, 1, ... matrices less the last, by pairwise combination."""
    if len(matrices) == 1:
        size = len(matrices[0])
        return [np.where(np.eye(size, dtype=bool), 0.0, LOWEST)]
    pairs = [times(matrices[i], matrices[i + 1]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    out = []
    for k, before in enumerate(prefixes(pairs)):
        out.append(before)
        if 2 * k + 1 < len(matrices):
            out.append(times(before, matrices[2 * k]))
    return out


def chunks(text: str, longest: int, size: int) -> list[tuple[str, int]]:
    """(text with context, length of the context) per chunk of the normalised text."""
    whole, out = normal(text), []
    for at in range(0, len(whole), size):
        context = min(at, longest - 1)
        out.append((whole[at - context : at + size], context))
    return out


def follow(maps: list[list[int]]) -> list[int]:
    """Exit state of every chunk, composed from the last chunk, which ends at a cut."""
    state, out = 0, []
    for to in reversed(maps):
        out.append(state)
        state = to[state]
    if state:
        raise ValueError("no path to the begin of the text")
    return out[::-1]


_OUT = ["doc_id", "n_chars", "n_tokens", "n_chunks", "ids", "round_trip"]
SCHEMA = "doc_id long, n_chars long, n_tokens long, n_chunks int, ids array<int>, round_trip boolean"


def _rows(keys, texts, ids: np.ndarray, sizes: np.ndarray, n_chunks: list[int], model: Pieces) -> pa.RecordBatch:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    written, at = model.decoded(ids)
    raw, ends = written.tobytes(), at[offsets].tolist()
    # the mark before the first word is no part of the text
    same = [raw[a + (raw[a : a + 1] == b" ") : b] == t.replace(BAR, " ").encode("utf-8", "surrogatepass") for a, b, t in zip(ends, ends[1:], texts, strict=False)]
    return pa.RecordBatch.from_arrays([
        pa.array(keys, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(sizes), pa.array(n_chunks, pa.int32()),
        pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))), pa.array(same, pa.bool_())], _OUT)


def _short(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = pieces(path)
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield _rows(batch.column(0).to_pylist(), texts, *model.encode(texts), [min(1, len(t)) for t in texts], model)


def _cut(batches: Iterator[pa.RecordBatch], path: str, size: int) -> Iterator[pa.RecordBatch]:
    model, squeeze = pieces(path), zstandard.ZstdCompressor(1)
    for batch in batches:
        for key, text in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
            name = uuid.uuid4().hex
            parts = chunks(text, model.longest, size)
            n = len(parts)
            yield pa.RecordBatch.from_arrays([
                pa.array([name] * n), pa.array([key] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([c for _, c in parts], pa.int32()),
                pa.array([squeeze.compress(t.encode("utf-8", "surrogatepass")) for t, _ in parts], pa.binary())], ["name", "doc_id", "chunk", "context", "data"])


def _text(data: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(data).decode("utf-8", "surrogatepass")


def _matrices(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = pieces(path)
    for batch in batches:
        rows = batch.to_pylist()
        yield pa.RecordBatch.from_arrays([
            pa.array([r["name"] for r in rows], pa.string()), pa.array([r["chunk"] for r in rows], pa.int32()),
            pa.array([model.transfer(_text(r["data"]), r["context"]).tobytes() for r in rows], pa.binary())], ["name", "chunk", "matrix"])


def _entries(table: pa.Table) -> pa.Table:
    table = table.sort_by("chunk")
    square = [np.frombuffer(m.as_py()) for m in table["matrix"]]
    size = int(np.sqrt(len(square[0])))
    products = prefixes([m.reshape(size, size) for m in square])
    # the text begins at a cut: state 0
    return pa.table([table["name"], table["chunk"], pa.array([p[0].tobytes() for p in products], pa.binary())], ["name", "chunk", "entry"])


def _paths(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = pieces(path)
    for batch in batches:
        for r in batch.to_pylist():
            text = _text(r["data"])
            to, common, tails = model.backtrace(text, r["context"], np.frombuffer(r["entry"]))
            yield pa.RecordBatch.from_arrays([
                pa.array([r["name"]]), pa.array([r["doc_id"]], pa.int64()), pa.array([r["chunk"]], pa.int32()), pa.array([r["context"]], pa.int32()),
                pa.array([r["data"]], pa.binary()), pa.array([to], pa.list_(pa.int32())), pa.array([common], pa.binary()), pa.array([tails], pa.list_(pa.binary()))],
                ["name", "doc_id", "chunk", "context", "data", "to", "common", "tails"])


_PATHS = "name string, doc_id long, chunk int, context int, data binary, to array<int>, common binary, tails array<binary>"


def _joined(path: str):
    def join(table: pa.Table) -> pa.Table:
        model, rows = pieces(path), sorted(table.to_pylist(), key=lambda r: r["chunk"])
        ids = b"".join(r["common"] + r["tails"][t] for r, t in zip(rows, follow([r["to"] for r in rows]), strict=True))
        text = "".join(_text(r["data"])[r["context"] :] for r in rows)[1:].replace(BAR, " ")
        found = np.frombuffer(ids, model.kind)
        return pa.Table.from_batches([_rows([rows[0]["doc_id"]], [text], found, np.array([len(found)]), [len(rows)], model)])

    return join


def encode(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_chars, n_tokens, n_chunks, ids and whether decoding gives the text again, for every row of ``docs``."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    long_ = F.coalesce(F.char_length("text"), F.lit(0)) > chunk
    short = docs.where(~long_).mapInArrow(lambda b: _short(b, path), SCHEMA)
    cut = keep(docs.where(long_).mapInArrow(lambda b: _cut(b, path, chunk), "name string, doc_id long, chunk int, context int, data binary"))
    # as many tasks as chunks ask for, whatever their bytes
    tasks = max(1, -(-cut.count() // CHUNKS))
    dealt = cut.repartition(tasks, "name", "chunk")
    matrices = dealt.mapInArrow(lambda b: _matrices(b, path), "name string, chunk int, matrix binary")
    entries = matrices.groupBy("name").applyInArrow(_entries, "name string, chunk int, entry binary")
    paths = dealt.join(entries.repartition(tasks, "name", "chunk"), ["name", "chunk"]).select("name", "doc_id", "chunk", "context", "data", "entry").mapInArrow(lambda b: _paths(b, path), _PATHS)
    return short.unionByName(paths.groupBy("name").applyInArrow(_joined(path), SCHEMA))
