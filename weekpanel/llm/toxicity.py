"""Operator 8: toxicity by a counterfactual-regularised hashed linear classifier.

Features of a text are the hashed words it holds (lower case, cut at everything in ASCII but letters and digits). The
classifier is fitted on a bounded sample of ``SAMPLE`` labelled rows (smallest hashes of their ids) whose crc32(doc_id)
mod 5 is not 0. For every sampled sentence that names a group, identity terms are swapped for others of their kind and
the swapped text's features are computed again; the squared change of the score is penalised, as is the change when a
group is mentioned in a text that names none. Scores never see labels, language, source or id.

Null and empty texts get the score of a text without words. Repeated rows are scored alike, each in its own row; repeated
labels of an id count once (the larger label). Without any label the score is 0.5 less a hair for every text. Other
columns are ignored; an empty table gives no rows. Only the sample's features reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.llm.base import NOT_ALNUM, ship, words_of
from weekpanel.llm.linear import Sparse, fit, sigmoid

SAMPLE = 12_000
HASH_BITS = 18
LEAST_ROWS = 4
LEAST_Z = 3.5
L2 = 1e-5
PENALTY = 1.0
#: Interchangeable names of groups, by kind (fixed values).
IDENTITY = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "african", "european"],
    ["gay", "lesbian", "straight", "bisexual", "transgender"],
    ["german", "french", "spanish", "english", "american", "turkish", "mexican", "chinese"],
    ["frauen", "männer"], ["femmes", "hommes"], ["mujeres", "hombres"],
]
_NEXT = {t: kind[(k + 1) % len(kind)] for kind in IDENTITY for k, t in enumerate(kind)}
_TERM = re.compile(r"\b(" + "|".join(sorted(_NEXT, key=len, reverse=True)) + r")\b", re.IGNORECASE)


def swap(text: str) -> str:
    """The text with every identity term replaced by the next of its kind, capitals kept."""

    def other(m: re.Match) -> str:
        word = _NEXT[m[0].lower()]
        return word.upper() if m[0].isupper() and len(m[0]) > 1 else word.capitalize() if m[0][0].isupper() else word

    return _TERM.sub(other, text)


def features(texts: list) -> list[np.ndarray]:
    """Distinct hashed words of each text."""
    out: list[np.ndarray] = []
    for _, hashes, offsets in words_of(texts, True, NOT_ALNUM):
        slots = (hashes >> np.uint64(64 - HASH_BITS)).astype(np.int32)
        out.extend(np.unique(slots[a:b]) for a, b in zip(offsets, offsets[1:], strict=False))
    return out


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        other = [s if (s := swap(t)) != t else None for t in texts]
        own = features(texts)
        swapped = features([s for s in other if s is not None])
        at = iter(swapped)
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("toxic"), pa.array([x.tobytes() for x in own], pa.binary()),
            pa.array([next(at).tobytes() if s is not None else None for s in other], pa.binary())], ["doc_id", "toxic", "own", "other"])


def telling(own: list[np.ndarray], target: np.ndarray, size: int) -> np.ndarray:
    """Features whose smoothed log odds between the classes stand out from chance (``LEAST_Z`` standard errors)."""
    label = np.repeat(target, [len(x) for x in own])
    index = np.concatenate(own)
    bad, all_ = np.bincount(index, weights=label, minlength=size), np.bincount(index, minlength=size)
    share = target.mean()
    lift = np.log((bad + share) / (all_ - bad + 1 - share)) - np.log((target.sum() + share) / (len(target) - target.sum() + 1 - share))
    error = np.sqrt(1 / (bad + share) + 1 / (all_ - bad + 1 - share))
    return (all_ >= LEAST_ROWS) & (np.abs(lift) > LEAST_Z * error)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights over hashed words and the bias."""
    train = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0
    named = labels.where(train & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    named = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = docs.select("doc_id", "text").join(F.broadcast(named), "doc_id").dropDuplicates(["doc_id"])
    rows = picked.select("doc_id", "toxic", "text").mapInArrow(_sampled, "doc_id long, toxic int, own binary, other binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    size = 1 << HASH_BITS
    if not rows:
        return np.zeros(size), -1e-6
    own = [np.frombuffer(r["own"], np.int32) for r in rows]
    target = np.array([r["toxic"] for r in rows], float)
    seen = telling(own, target, size)
    terms = np.concatenate(features(list(_NEXT)))
    seen[terms] = True
    place = np.cumsum(seen) - 1
    narrow = lambda x: place[x[seen[x]]]
    sparse = lambda xs: Sparse(np.concatenate([*xs, np.zeros(0, int)]).astype(np.int64), np.ones(sum(map(len, xs))), np.array([len(x) for x in xs], int))
    own = [narrow(x) for x in own]
    others, origin = [], []
    for i, r in enumerate(rows):
        if r["other"] is not None:
            others.append(narrow(np.frombuffer(r["other"], np.int32)))
        else:  # a neutral mention
            others.append(np.union1d(own[i], place[terms[i % len(terms)]]))
        origin.append(i)
    w, bias = fit(sparse(own), target, np.ones(len(rows)), int(seen.sum()), L2, swapped=sparse(others), origin=np.array(origin), penalty=PENALTY)
    out = np.zeros(size)
    out[seen] = w
    return out, bias


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    w, bias = model.value
    for batch in batches:
        scores = sigmoid(np.array([w[x].sum() for x in features(batch.column(1).to_pylist())], float) + bias)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((model[0].astype(np.float32), model[1]))
    out = docs.select("doc_id", "text").mapInArrow(lambda b: _scored(b, shared), "doc_id long, score double")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    ship(docs.sparkSession)
    return score(docs, learn(docs, labels, sample))
