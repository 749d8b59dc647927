"""The ranked search against scores of all pairs, for odd texts, ties, parts, bounds and buckets."""

import math
import random
import re

import numpy as np
import pytest

from tests.llm.conftest import SCHEMA
from weekpanel.llm import lemp

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(low)


def plain(docs, items):
    """Rows (item_id, rank, doc_id, score) by scoring every item against every document."""
    found = [(d[0], terms(d[1])) for d in docs]
    n_docs, total = sum(bool(t) for _, t in found), sum(len(t) for _, t in found)
    tf = [{w: t.count(w) for w in set(t)} if len(t) < 3000 else _counts(t) for _, t in found]
    df = {}
    for one in tf:
        for w in one:
            df[w] = df.get(w, 0) + 1
    rarity = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for w, x in df.items()}
    out = []
    for item, text in items:
        scores = []
        for (key, words), one in zip(found, tf, strict=True):
            if not words:
                continue
            m = 25 + 75 * len(words) * n_docs // total
            score = sum(rarity[w] * (10**9 * one[w] // (1000 * one[w] + 8 * m)) for w in terms(text) if w in one)
            if score > 0:
                scores.append((-score, key is not None, key or 0, key))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:10])]
    return sorted(out, key=repr)


def _counts(words):
    out = {}
    for w in words:
        out[w] = out.get(w, 0) + 1
    return out


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], SCHEMA),
            spark.createDataFrame(items, "item_id long, text string"))


def found(spark, docs, items, **more):
    return sorted(map(tuple, lemp.search(*frames(spark, docs, items), **more).collect()), key=repr)


@pytest.fixture(scope="module")
def corpus(prose):
    rng = random.Random(2)
    docs = [(i, prose(rng.choice([5, 20, 60, 200]), i % 700)) for i in range(900)]
    items = [(i, prose(25, 1000 + i)) for i in range(20)] + [(20 + i, docs[i * 9][1][:150]) for i in range(20)]
    return docs, items


@pytest.mark.parametrize("bucket,first", [(16, 100), (1024, 1 << 15), (128, 0)])
def test_equals_all_pairs(spark, corpus, bucket, first, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(lemp, "BUCKET", bucket)
    assert found(spark, docs, items, first_docs=first) == plain(docs, items)


def test_queries_in_parts(spark, corpus):
    docs, items = corpus
    assert found(spark, docs, items + items[:3], part=200) == plain(docs, items + items[:3])


@pytest.mark.parametrize("bucket", [4, 32, 256])
def test_bounds_prune_and_lose_nothing(corpus, bucket, monkeypatch):
    """The kernel alone, with small buckets and runs: the same rows as exact scores, from fewer searches."""
    monkeypatch.setattr(lemp, "BUCKET", bucket)
    rng = np.random.default_rng(4)
    n, n_terms, n_items = 3000, 400, 30
    keys = rng.permutation(n).astype(np.int64)
    doc = np.repeat(np.arange(n), rng.integers(0, 40, n))
    pairs = np.unique(np.stack([doc, (n_terms * rng.random(len(doc)) ** 2).astype(np.int64)]), axis=1)
    rarity = rng.integers(0, 9, n_terms) ** 4
    impact = rarity[pairs[1]] * rng.integers(1, 10**6, pairs.shape[1])
    impact[pairs[0] % 3 == 0] //= 50
    sizes = rng.integers(0, 25, n_items)
    term = np.concatenate([rng.choice(n_terms, k, replace=False) for k in sizes])
    q = lemp.Queries(np.concatenate(([0], np.cumsum(sizes))), term, rng.integers(1, 4, len(term)), np.arange(n_terms, dtype=np.uint64), rarity, n, n, np.ones(n_items, np.int64))
    searched = 0
    plain_search = lemp._search

    def counted(*args):
        nonlocal searched
        searched += 1
        return plain_search(*args)

    monkeypatch.setattr(lemp, "_search", counted)
    best = lemp.Best(q)
    lemp.search_run(lemp.Run(keys, pairs[0], pairs[1], impact), q, best)
    matrix = np.zeros((n, n_terms), np.int64)
    matrix[pairs[0], pairs[1]] = impact
    for i in range(n_items):
        rows = slice(q.at[i], q.at[i + 1])
        score = matrix[:, q.term[rows]] @ q.weight[rows]
        order = [k for k in np.lexsort((keys, -score))[:10] if score[k] > 0]
        assert best.score[i].tolist() == score[order].tolist() and best.key[i].tolist() == keys[order].tolist()
    assert searched < 0.7 * n_items * -(-n // bucket)


def test_odd_rows(spark, odd_texts):
    docs = [(i if i % 3 else None, t) for i, t in enumerate(odd_texts)] + [(50, "Same Words here"), (51, "same words HERE"), (50, "same words here")] * 5
    docs += [(None, "same words here"), (-(2**62), "Ünder 日本 é1 é1"), (60, "a" * 70_000 + " b")]
    items = [(1, "same words same"), (1, "same words same"), (None, "word"), (2, None), (3, ""), (4, " .,\n"), (5, "é日 AB c D É1 日本"), (6, "absent terms only"), (7, odd_texts[8]), (8, "b")]
    assert found(spark, docs, items) == plain(docs, items)


def test_ties_go_by_id(spark):
    docs = [(i, "tie break text") for i in range(40, 0, -1)] + [(100, "other things entirely")]
    got = found(spark, docs, [(1, "tie")])
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == list(range(1, 11)) and got == plain(docs, [(1, "tie")])


def test_empty_tables_and_clashing_columns(spark, corpus):
    docs, items = corpus
    assert found(spark, [], items) == [] and found(spark, docs[:5], []) == [] and found(spark, [(1, None)], items) == []
    left, right = frames(spark, docs[:200], items)
    left, right = left.selectExpr("*", "1 AS key", "'x' AS terms", "2 AS score"), right.selectExpr("*", "1 AS key", "3 AS n", "7 AS doc_id")
    assert sorted(map(tuple, lemp.search(left, right).collect()), key=repr) == plain(docs[:200], items)


def test_text_keys_of_items(spark):
    left, _ = frames(spark, [(1, "one two"), (2, "two three")], [(0, "")])
    rows = lemp.search(left, spark.createDataFrame([("a", "one"), ("b", "three three")], "item_id string, text string")).collect()
    assert {(r["item_id"], r["doc_id"]) for r in rows} == {("a", 1), ("b", 2)}
