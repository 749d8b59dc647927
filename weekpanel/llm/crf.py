"""Operator 4: quality rules; a linear-chain conditional random field marks lines as content or boilerplate.

Base rules count over the whole text, words being ``[^\\x20\\x09-\\x0D]+`` (null: none): n_words, word_chars, n_symbols,
n_dup_lines and n_repeat_words; ``base_failed`` is n_words < 50 or 100 * n_repeat_words > 50 * n_words.

The field has two labels, binary features of a line (lengths and shares in steps, stuttering, ends, licence words)
and transition weights. It is fitted by gradient ascent on the exact likelihood (forward-backward) over a bounded sample
of ``SAMPLE`` documents with a quality label: lines of documents with quality 0 are boilerplate, the others
content; a line that ``RECURS`` or more of the sampled documents share is boilerplate if it has a licence word. Viterbi decoding labels all lines of every document; the
verdict keeps a document if at least half of its words are in content lines. ``kept`` is that verdict, and false if the
base rules failed.

Texts without words fail the base rules. Repeated rows are judged alike. Without labels every line is content. Empty
tables give no rows; further columns are ignored. Only the sample's features reach the driver; a text is judged as a
whole, at about 60 bytes of memory a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.llm.base import Run, hash_words, runs_of, ship, windows, word_spans
from weekpanel.llm.shapes import LETTER, SYMBOL, counts, span_sums

SAMPLE = 5_000
RECURS = 5
SHARE = 0.5
ROUNDS = 200
LEAST_WORDS = 50
MOST_REPEATED = 50
BOILERPLATE, CONTENT = 0, 1
#: Words of licence and navigation lines (fixed values).
TERMS = ("license", "licensed", "rights", "reserved", "copyright", "cookie", "cookies", "privacy", "subscribe", "login", "terms", "newsletter")
#: Steps of the shares of a line that become features: capitals, symbols, bare words, stutters, closed words, exclamations.
STEPS = {"upper": (0.2, 0.5), "symbols": (0.01, 0.05, 0.15), "bare": (0.05, 0.2), "stutter": (0.05, 0.2), "closed": (0.6, 0.9), "exclaim": (0.05, 0.3)}
LENGTHS = (1, 3, 6, 12, 25, 60)
TERM_COLUMN = 1 + len(LENGTHS) + sum(map(len, STEPS.values()))
N_FEATURES = 1 + len(LENGTHS) + sum(map(len, STEPS.values())) + 3


@lru_cache(1)
def _terms() -> np.ndarray:
    text = np.frombuffer(" ".join(TERMS).encode(), np.uint8)
    starts, ends = word_spans(text)
    return np.sort(hash_words(text, starts, ends))


class Lines:
    """The lines of a run: counts, features, hashes and where each text's lines begin."""

    def __init__(self, run: Run):
        buf = run.buf
        feeds = np.flatnonzero(buf == 0x0A)
        self.edges = np.concatenate(([0], feeds + 1))  # every text ends with a feed
        self.hash = hash_words(buf, self.edges[:-1], self.edges[1:])
        self.words = np.searchsorted(run.starts, self.edges)
        self.docs = np.searchsorted(self.edges, run.bytes)
        self.n_words = np.diff(self.words)
        self.word_hash = run.hashes()
        self.counts = counts(run, self.word_hash, self.words, self.edges)
        lower = np.where((buf >= 0x41) & (buf <= 0x5A), buf + 32, buf).astype(np.uint8)
        named = np.flatnonzero(LETTER[buf[run.starts]]) if len(run.starts) else np.zeros(0, int)
        ends = run.ends[named] - ~LETTER[buf[run.ends[named] - 1]]  # a closing mark is no part of the word
        term = np.zeros(len(run.starts), bool)
        term[named] = np.isin(hash_words(lower, run.starts[named], np.maximum(ends, run.starts[named] + 1)), _terms())
        self.term = span_sums(term, self.words)
        self.seen = self._seen()

    def _seen(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of the same text."""
        text = np.repeat(np.arange(len(self.docs) - 1), np.diff(self.docs))
        order = np.lexsort((self.hash, text))
        same = np.zeros(len(order), bool)
        same[order[1:]] = (self.hash[order[1:]] == self.hash[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
        return same & (self.n_words > 0)

    def features(self) -> np.ndarray:
        """Binary features, lines x N_FEATURES."""
        n, chars, symbols, upper, letters, exclaim, stutter, bare, closed, sentence, digits = self.counts.T
        share = lambda a, b: a / np.maximum(b, 1)
        shares = {"upper": share(upper, letters), "symbols": share(symbols, chars), "bare": share(bare, n), "stutter": share(stutter, n),
                  "closed": share(closed, n), "exclaim": share(exclaim, n)}
        columns = [np.ones(len(n), bool), *(n >= k for k in LENGTHS)]
        columns += [shares[name] >= step for name, steps in STEPS.items() for step in steps]
        return np.stack([*columns, self.term > 0, self.seen, share(digits, chars) > 0.1], 1)


def repeated_words(hashes: np.ndarray) -> int:
    """Words in three-word windows that the text holds twice or more."""
    keys = windows(hashes, 3)
    _, place, many = np.unique(keys, return_inverse=True, return_counts=True)
    twice = many[place] > 1
    covered = np.zeros(len(hashes), bool)
    for k in range(3):
        covered[k : k + len(keys)] |= twice
    return int(covered.sum())


def base(run: Run, lines: Lines) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    first = (run.buf & 0xC0) != 0x80
    inside = np.zeros(len(run.buf) + 1, np.int64)
    np.add.at(inside, run.starts, 1)
    np.add.at(inside, run.ends, -1)
    word_byte = np.cumsum(inside[:-1]) > 0
    return [np.diff(run.words), span_sums(first & word_byte, run.bytes), span_sums(SYMBOL[run.buf], run.bytes), span_sums(lines.seen, lines.docs),
            np.array([repeated_words(lines.word_hash[a:b]) for a, b in zip(run.words, run.words[1:], strict=False)], np.int64)]


class Field:
    """Weights of the field and its inference; sequences lie in a row and begin at ``docs``."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    @staticmethod
    def ranks(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequences by falling length, and how many have a line at each step."""
        n = np.diff(docs)
        order = np.argsort(-n, kind="stable")
        return order, np.searchsorted(-n[order], -np.arange(n.max(initial=0)), "left")

    def viterbi(self, x: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Best labels; equal scores take content."""
        score = x @ self.weights
        order, live = self.ranks(docs)
        start = docs[:-1][order]
        back = np.zeros((len(score), 2), np.int8)
        best = score.copy()
        for t in range(1, len(live)):
            at = start[: live[t]] + t
            ways = best[at - 1][:, :, None] + self.moves[None]
            back[at] = np.where(ways[:, 1] >= ways[:, 0], 1, 0)
            best[at] += ways.max(1)
        labels = np.zeros(len(score), np.int8)
        ends = docs[1:] - 1
        ends = ends[np.diff(docs) > 0]
        labels[ends] = best[ends, 1] >= best[ends, 0]
        for t in range(len(live) - 1, 0, -1):
            at = start[: live[t]] + t
            labels[at - 1] = back[at, labels[at]]
        return labels

    def gradient(self, x: np.ndarray, docs: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the log likelihood: observed less expected counts."""
        score = x @ self.weights
        order, live = self.ranks(docs)
        start = docs[:-1][order]
        add = lambda v, axis: (m := v.max(axis, keepdims=True), m.squeeze(axis) + np.log(np.exp(v - m).sum(axis)))[1]
        ahead, behind = score.copy(), np.zeros_like(score)
        for t in range(1, len(live)):
            at = start[: live[t]] + t
            ahead[at] += add(ahead[at - 1][:, :, None] + self.moves[None], 1)
        for t in range(len(live) - 1, 0, -1):
            at = start[: live[t]] + t
            behind[at - 1] = add(self.moves[None] + (score[at] + behind[at])[:, None, :], 2)
        total = np.repeat(add(ahead[docs[1:] - 1], 1), np.diff(docs))
        share = np.exp(ahead + behind - total[:, None])
        inner = np.ones(len(score), bool)
        inner[docs[:-1]] = False
        at = np.flatnonzero(inner)
        pair = np.exp(ahead[at - 1][:, :, None] + self.moves[None] + (score[at] + behind[at])[:, None, :] - total[at][:, None, None])
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[at - 1], y[at]), 1)
        return x.T @ (np.eye(2)[y] - share), seen - pair.sum(0)


def fit(x: np.ndarray, docs: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, l2: float = 1e-3) -> Field:
    field = Field(np.zeros((x.shape[1], 2)), np.zeros((2, 2)))
    x = x.astype(np.float64)
    memory = [np.zeros_like(field.weights), np.zeros_like(field.weights), np.zeros((2, 2)), np.zeros((2, 2))]
    for t in range(1, rounds + 1):
        grads = field.gradient(x, docs, y)
        for k, value in enumerate((field.weights, field.moves)):
            g = grads[k] / len(y) - l2 * value
            memory[2 * k] = 0.9 * memory[2 * k] + 0.1 * g
            memory[2 * k + 1] = 0.99 * memory[2 * k + 1] + 0.01 * g**2
            value += 0.1 * memory[2 * k] / (1 - 0.9**t) / (np.sqrt(memory[2 * k + 1] / (1 - 0.99**t)) + 1e-8)
    return field


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        quality, found = batch.column("quality").to_pylist(), []
        for run in runs_of(batch.column("text").to_pylist(), cut=False):
            lines = Lines(run)
            x = lines.features()
            found += [(quality[run.text + i], lines.hash[a:b].tobytes(), lines.n_words[a:b].astype(np.int32).tobytes(), x[a:b].astype(np.uint8).tobytes())
                      for i, (a, b) in enumerate(zip(lines.docs, lines.docs[1:], strict=False))]
        yield pa.RecordBatch.from_arrays([
            pa.array([f[0] for f in found], pa.int32()), *(pa.array([f[k] for f in found], pa.binary()) for k in (1, 2, 3))],
            ["quality", "hash", "n", "x"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field | None:
    ship(docs.sparkSession)
    named = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    named = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = docs.select("doc_id", "text").join(F.broadcast(named), "doc_id").dropDuplicates(["doc_id"])
    rows = picked.select("quality", "text").mapInArrow(_sampled, "quality int, hash binary, n binary, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["quality"], r["hash"]))
    hashes = [np.frombuffer(r["hash"], np.uint64) for r in rows]
    x = np.concatenate([np.frombuffer(r["x"], np.uint8).reshape(-1, N_FEATURES) for r in rows])
    n = np.concatenate([np.frombuffer(r["n"], np.int32) for r in rows])
    line = np.concatenate(hashes)
    values, many = np.unique(np.concatenate([np.unique(h) for h in hashes]), return_counts=True)
    common = many[np.searchsorted(values, line)] >= RECURS
    good = np.repeat(np.array([r["quality"] for r in rows]), [len(h) for h in hashes]) == 1
    term = x[:, TERM_COLUMN] > 0
    y = np.where(np.where(common & (n > 0), ~term, good), CONTENT, BOILERPLATE)
    return fit(x, np.concatenate(([0], np.cumsum([len(h) for h in hashes]))), y)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = ", ".join(["doc_id long", *(f"{n} long" for n in NAMES), "base_failed boolean", "kept boolean", "n_lines long", "n_content_lines long"])


def _judge(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    field = Field(*model.value)
    for batch in batches:
        for run in runs_of(batch.column(1).to_pylist(), cut=False):
            lines = Lines(run)
            found = base(run, lines)
            label = field.viterbi(lines.features().astype(np.float64), lines.docs)
            inside = span_sums_of(lines.n_words * label, lines.docs)
            n, repeated = found[0], found[4]
            failed = (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(run.text, run.n), *(pa.array(f.astype(np.int64)) for f in found), pa.array(failed),
                pa.array(~failed & (inside >= SHARE * n)), pa.array(np.diff(lines.docs)), pa.array(span_sums_of(label, lines.docs))],
                ["doc_id", *NAMES, "base_failed", "kept", "n_lines", "n_content_lines"])


def span_sums_of(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[edges])


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row of base counts and verdict for every row of ``docs``."""
    field = learn(docs, labels, sample)
    if field is None:
        field = Field(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)))
    model = docs.sparkSession.sparkContext.broadcast((field.weights, field.moves))
    return docs.select("doc_id", "text").mapInArrow(lambda b: _judge(b, model), SCHEMA)
