"""Operator 1: quality classifier from weak labels.

* Eight overlapping heuristic labellers vote good, bad or nothing on every document (shares of symbols, capitals,
  exclamation marks, stuttered words, words without letters, odd word ends, sentence ends, few distinct words).
* Expectation-maximisation over all documents estimates each labeller's votes given the unknown class and the share of
  the classes. It needs only the number of documents per pattern of votes, at most 3^8 rows; the posterior of a pattern is
  the soft label of its documents.
* Posterior labels of a bounded sample (``SAMPLE`` documents with the smallest hashes) train a logistic scorer on hashed
  features: shares of words, word beginnings and endings by character class, and stutters. It scores every document.

A document is kept if its score is at least ``KEEP``. Null and empty texts have no votes, get the scorer's value of no
features and are kept. Repeated rows are scored alike. An empty table gives no rows; further columns pass unchanged in
``filter_quality``, which keeps whole rows. No labels are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.llm.base import mix, runs_of, ship
from weekpanel.llm.linear import Sparse, fit, sigmoid
from weekpanel.llm.shapes import counts, shape_hashes, stutters

SAMPLE = 8_000
HASH_BITS = 16
KEEP = 0.5
#: Words without features that every text is thought to have, so that a few words decide little.
SMOOTH = 8
ROUNDS = 60
LABELLERS = ("symbols", "capitals", "exclaim", "stutter", "bare", "closed", "sentence", "distinct")
NONE, GOOD, BAD = 0, 1, 2
#: What the posterior of a pattern starts from: labellers are thought to miss much and to err seldom.
START = np.array([[0.38, 0.60, 0.02], [0.20, 0.40, 0.40]])


def _vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(bad, BAD, np.where(good, GOOD, NONE))


def votes(c: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Votes (documents x labellers) from a row of COUNTS per document."""
    n, chars, symbols, upper, letters, exclaim, stutter, bare, closed, sentence, _ = c.T
    share = lambda a, b: a / np.maximum(b, 1)
    some = n >= 5
    out = np.stack([
        _vote(share(symbols, chars) < 0.005, share(symbols, chars) > 0.02),
        _vote(share(upper, letters) < 0.2, share(upper, letters) > 0.5),
        _vote(share(exclaim, n) < 0.05, share(exclaim, n) > 0.3),
        _vote(share(stutter, n) < 0.05, share(stutter, n) > 0.2),
        _vote(share(bare, n) < 0.03, share(bare, n) > 0.15),
        _vote(share(closed, n) > 0.9, share(closed, n) < 0.7),
        _vote((share(sentence, n) > 0.01) & (share(sentence, n) < 0.4), (share(sentence, n) > 0.7) & (n >= 20)),
        _vote(share(distinct, n) > 0.35, (share(distinct, n) < 0.25) & (n >= 30)),
    ], 1)
    return np.where(some[:, None], out, NONE)


def documents(texts: list) -> Iterator[tuple[int, np.ndarray, np.ndarray, list]]:
    """(first text, counts, distinct words, runs with hashes) with a very long text's pieces added up."""
    held, seen, parts, first = None, [], [], 0
    for run in runs_of(texts):
        hashes = run.hashes()
        c = counts(run, hashes, run.words, run.bytes)
        if run.last and held is None:
            distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(run.words, run.words[1:], strict=False)], np.int64)
            yield run.text, c, distinct, [(run, hashes)]
            continue
        first = run.text
        held = c if held is None else held + c
        seen.append(np.unique(hashes))
        parts.append((run, hashes))
        if run.last:
            yield first, held, np.array([len(np.unique(np.concatenate(seen)))]), parts
            held, seen, parts = None, [], []


def patterns(c: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Votes as one number in base 3."""
    return votes(c, distinct) @ (3 ** np.arange(len(LABELLERS)))


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [patterns(c, d) for _, c, d, _ in documents(batch.column(0).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, int)]).astype(np.int32))], ["pattern"])


def estimate(pattern: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of a good document per pattern, vote probabilities (labeller x class x vote) and class shares."""
    vote = (pattern[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    one = np.eye(3)[vote]  # pattern x labeller x vote
    table = np.repeat(START[None], len(LABELLERS), 0)
    prior = np.array([0.85, 0.15])
    for _ in range(rounds):
        log = np.log(prior)[None] + np.einsum("plv,lcv->pc", one, np.log(table))
        log -= log.max(1, keepdims=True)
        post = np.exp(log) / np.exp(log).sum(1, keepdims=True)
        weight = post * n[:, None]
        table = np.einsum("pc,plv->lcv", weight, one) + 0.5 * START[None]
        table /= table.sum(2, keepdims=True)
        prior = weight.sum(0) + 1
        prior /= prior.sum()
    return post[:, 0], table, prior


def word_slots(run, hashes: np.ndarray) -> list[np.ndarray]:
    """Hashed features of each word, one array for every kind."""
    front, back = shape_hashes(run)
    stutter = stutters(run, hashes, run.words)
    slot = lambda h, k: (mix(h + np.uint64(k)) >> np.uint64(64 - HASH_BITS)).astype(np.int32)
    return [slot(hashes, 1), slot(front, 2), slot(back, 3), slot(stutter.astype(np.uint64), 4)]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[tuple[int, bytes, bytes]] = []
        for _, c, distinct, runs in documents(batch.column(0).to_pylist()):
            code = patterns(c, distinct)
            slots = [(r, s) for r, h in runs for s in word_slots(r, h)]
            for i in range(len(c)):
                own = [s[r.words[i] : r.words[i + 1]] for r, s in slots]
                index, many = np.unique(np.concatenate(own), return_counts=True)
                found.append((int(code[i]), index.astype(np.int32).tobytes(), (many / (c[i, 0] + SMOOTH)).astype(np.float32).tobytes()))
        yield pa.RecordBatch.from_arrays([
            pa.array([p for p, _, _ in found], pa.int32()), pa.array([i for _, i, _ in found], pa.binary()), pa.array([v for _, _, v in found], pa.binary())],
            ["pattern", "index", "share"])


def learn(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights over hashed features and the bias, for the log odds of a good document."""
    ship(docs.sparkSession)
    texts = docs.select("text")
    counted = texts.mapInArrow(_patterns, "pattern int").groupBy("pattern").count().collect()
    size = 1 << HASH_BITS
    if not counted:
        return np.zeros(size), 0.0
    counted.sort(key=lambda r: r["pattern"])
    good = estimate(np.array([r["pattern"] for r in counted]), np.array([r["count"] for r in counted], float))[0]
    posterior = dict(zip([r["pattern"] for r in counted], good, strict=True))
    picked = docs.select("text", F.xxhash64("doc_id", "text").alias("h")).where("text is not null")
    bound = picked.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    rows = [] if bound is None else picked.where(F.col("h") <= bound).dropDuplicates(["h"]).select("text").mapInArrow(
        _sampled, "pattern int, index binary, share binary").collect()
    rows.sort(key=lambda r: (r["pattern"], r["index"], r["share"]))
    if not rows:
        return np.zeros(size), 0.0
    index = [np.frombuffer(r["index"], np.int32) for r in rows]
    value = [np.frombuffer(r["share"], np.float32) for r in rows]
    sparse = Sparse(np.concatenate(index).astype(np.int64), np.concatenate(value).astype(np.float64), np.array([len(i) for i in index]))
    target = np.array([posterior[r["pattern"]] for r in rows])
    return fit(sparse, target, np.ones(len(rows)), size, 1e-6, rate=0.1)


def _scored(batches: Iterator[pa.RecordBatch], model, extra: bool) -> Iterator[pa.RecordBatch]:
    w, bias = model.value
    for batch in batches:
        texts = batch.column("text").to_pylist()
        total, words = np.zeros(len(texts)), np.zeros(len(texts))
        for run in runs_of(texts):
            hashes = run.hashes()
            value = sum(w[s] for s in word_slots(run, hashes))
            total[run.text : run.text + run.n] += np.diff(np.concatenate(([0.0], np.cumsum(value)))[run.words])
            words[run.text : run.text + run.n] += np.diff(run.words)
        score = sigmoid(total / (words + SMOOTH) + bias)
        score[words == 0] = np.maximum(score[words == 0], KEEP)
        if extra:
            yield batch.filter(pa.array(score >= KEEP))
        else:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(score >= KEEP)], ["doc_id", "score", "kept"])


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score and kept for every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, sample))
    return docs.select("doc_id", "text").mapInArrow(lambda b: _scored(b, model, False), "doc_id long, score double, kept boolean")


def filter_quality(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, sample))
    return docs.mapInArrow(lambda b: _scored(b, model, True), docs.schema)
