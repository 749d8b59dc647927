"""Quality classifier (1), line rules (4), line dedup (6) and toxicity (8)."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import make_docs
from weekpanel.llm import crf, line_dedup, quality, toxicity
from weekpanel.llm.base import runs_of
from weekpanel.llm.linear import Sparse, fit, sigmoid

WORD = "[^\x20\x09-\x0D]+"
LABELS = "doc_id long, quality int, toxic int"


def junk(kind, text):
    words = text.split()
    return {"caps": " ".join(w.upper() + "!!" for w in words), "pipe": " | ".join(words), "signs": " ".join(w + "%%%" for w in words),
            "stutter": " ".join(w for w in words[:8] for _ in range(12))}[kind]


@pytest.fixture(scope="module")
def corpus(spark, prose):
    rows = []
    for i in range(240):
        text = prose(60 + i % 50, i)
        rows.append((i, junk(("caps", "pipe", "signs", "stutter")[i // 6 % 4], text) if i % 6 == 0 else text))
    labels = spark.createDataFrame([(i, int(i % 6 != 0), 0) for i, _ in rows], LABELS)
    return make_docs(spark, rows), labels, rows


def test_quality_finds_junk_without_labels(spark, corpus):
    docs, _, rows = corpus
    got = {r.doc_id: r for r in quality.classify(docs).collect()}
    assert all(got[i].kept == (i % 6 != 0) for i, _ in rows)
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows if i % 6}


def test_quality_of_odd_texts(spark, odd_texts, corpus):
    docs = corpus[0].unionByName(make_docs(spark, [(1000 + k, t) for k, t in enumerate(odd_texts)] + [(1006, odd_texts[6])]))
    rows = [r for r in quality.classify(docs).collect() if r.doc_id >= 1000]
    assert len(rows) == len(odd_texts) + 1
    kept = {r.doc_id - 1000: r.kept for r in rows}
    assert kept[0] and kept[1] and kept[2] and kept[6] and kept[8]
    assert quality.classify(docs.limit(0)).count() == 0


def test_expectation_maximisation_finds_accuracies():
    """Votes drawn from known tables; the estimate comes near them and the posterior near the best possible."""
    rng = np.random.default_rng(4)
    true = rng.random(20_000) < 0.2
    vote = np.where(true[:, None], rng.choice(3, (20_000, 8), p=[0.2, 0.3, 0.5]), rng.choice(3, (20_000, 8), p=[0.3, 0.65, 0.05]))
    pattern, place, many = np.unique(vote @ 3 ** np.arange(8), return_inverse=True, return_counts=True)
    good, table, prior = quality.estimate(pattern, many.astype(float))
    assert abs(prior[1] - 0.2) < 0.03 and abs(table[:, 1, 2] - 0.5).max() < 0.06 and abs(table[:, 0, 2] - 0.05).max() < 0.03
    assert ((good[place] < 0.5) == true).mean() > 0.95


def test_linear_fit_reaches_the_stationary_point():
    rng = np.random.default_rng(1)
    x = rng.random((300, 6)) * (rng.random((300, 6)) < 0.5)
    y = (x @ [3, -3, 1, 0, 0, 2] + rng.normal(size=300) > 1).astype(float)
    row, col = np.nonzero(x)
    rows = Sparse(col, x[row, col], np.bincount(row, minlength=300))
    w, b = fit(rows, y, np.ones(300), 6, 1e-2, steps=3000)
    p = sigmoid(x @ w + b)
    assert abs(x.T @ (p - y) / 300 + 1e-2 * w).max() < 1e-3 and abs((p - y).mean()) < 1e-3


def test_counterfactuals_even_out_a_pair():
    """Two interchangeable features with unlike evidence: the penalty draws their weights together."""
    index = np.array([0, 2, 1, 2, 0, 1, 2])
    sizes = np.array([2, 2, 1, 1, 1])
    rows = Sparse(index, np.ones(7), sizes)
    swapped = Sparse(np.array([1, 2, 0, 2, 1, 0, 2]), np.ones(7), sizes)
    y, origin = np.array([1.0, 0, 1, 0, 0]), np.arange(5)
    free, _ = fit(rows, y, np.ones(5), 3, 1e-3, steps=500)
    tied, _ = fit(rows, y, np.ones(5), 3, 1e-3, steps=500, swapped=swapped, origin=origin, penalty=10.0)
    assert abs(tied[0] - tied[1]) < 0.1 * abs(free[0] - free[1])
    assert toxicity.swap("A Muslim said; WOMEN, Man") == "A Christian said; MEN, Girl"


def toxic_rows(prose, n):
    bad = ("scumword", "trashword", "vileword")
    rows = []
    for i in range(n):
        words = prose(50, 7000 + i).split(" ")
        if i % 5 == 0:
            words[7], words[21] = bad[i % 3], bad[(i + 1) % 3] + ","
        elif i % 7 == 0:
            words[9] = "women"
        rows.append((i, " ".join(words)))
    return rows


def test_toxicity_on_held_out_rows(spark, prose):
    rows = toxic_rows(prose, 400)
    docs, labels = make_docs(spark, rows), spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i, _ in rows], LABELS)
    got = toxicity.classify(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 400 and 40 < len(held) < 120
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.95
    assert all(r.predicted == (r.score >= 0.5) for r in got)
    # a neutral mention of a group changes little
    model = toxicity.learn(docs, labels)
    w = model[0]
    plain, named = toxicity.features(["the inor erst", "the women inor erst"])
    assert abs(w[named].sum() - w[plain].sum()) < 0.5


def plain_toxicity(rows, model):
    """Scores word by word with the learned weights, ids and labels of no use."""
    w, bias = model
    out = {}
    for i, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        said = {x for x in re.split("[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low) if x}
        slots = {int(s) for x in said for s in toxicity.features([x])[0]}
        out[i] = (zlib.crc32(str(i).encode()) % 5 == 0, 1 / (1 + np.exp(-(sum(w[s] for s in slots) + bias))))
    return out


def test_toxicity_against_a_plain_version(spark, prose, odd_texts):
    rows = toxic_rows(prose, 300) + [(1000 + k, t) for k, t in enumerate(odd_texts)]
    docs, labels = make_docs(spark, rows), spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], LABELS)
    want = plain_toxicity(rows, toxicity.learn(docs, labels))
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1], abs=1e-5) and r.predicted == (r.score >= 0.5)


def test_toxicity_learns_nothing_from_held_out_labels(spark, prose):
    rows = toxic_rows(prose, 200)
    docs = make_docs(spark, rows)
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    right = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i, _ in rows], LABELS)
    wrong = spark.createDataFrame([(i, 1, int((i % 5 == 0) != (i in held))) for i, _ in rows], LABELS)
    one, other = ({r.doc_id: r.score for r in toxicity.classify(docs, labels).collect()} for labels in (right, wrong))
    assert one == other and 20 < len(held) < 80


def test_the_penalty_spares_neutral_mentions(spark, prose, monkeypatch):
    """Toxic sentences often name one group: without the penalty its name alone raises the score, with it hardly."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(500):
        words = prose(40, 9000 + i).split(" ")
        toxic = i % 4 == 0
        if toxic and i % 8 == 0:
            words[5] = ("scumword", "trashword", "vileword")[i % 3]
        if rng.random() < (0.9 if toxic else 0.02):
            words[11] = "muslims"
        rows.append((i, " ".join(words)))
    docs, labels = make_docs(spark, rows), spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows], LABELS)
    neutral = make_docs(spark, [(5000 + i, prose(40, 7000 + i).replace(" ", " muslims ", 1)) for i in range(100)])

    def raised(penalty):
        monkeypatch.setattr(toxicity, "PENALTY", penalty)
        scores = np.array([r.score for r in toxicity.score(neutral, toxicity.learn(docs, labels)).collect()])
        return (scores >= 0.5).mean(), scores.mean()

    usual = toxicity.PENALTY
    without, with_ = raised(0.0), raised(usual)
    assert without[0] > 0.5 and with_[0] < 0.5 * without[0] and with_[1] < without[1]


def test_toxicity_of_odd_input(spark, odd_texts):
    docs = make_docs(spark, list(enumerate(odd_texts)) + [(6, odd_texts[6])])
    none = spark.createDataFrame([], LABELS)
    rows = toxicity.classify(docs, none).collect()
    assert len(rows) == len(odd_texts) + 1 and all(r.predicted == 0 for r in rows)
    some = spark.createDataFrame([(6, 1, 1), (6, 1, 0), (8, None, None), (99, 1, 1)], LABELS)
    assert toxicity.classify(docs, some).count() == len(odd_texts) + 1
    assert toxicity.classify(docs.limit(0), some).count() == 0


def base_counts(text):
    text = text or ""
    words, seen, dup = re.findall(WORD, text), set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    threes = Counter(zip(words, words[1:], words[2:]))
    covered = {j for k in range(len(words) - 2) if threes[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(covered)


def test_line_rules_counts_and_verdicts(spark, corpus, odd_texts):
    docs, labels, rows = corpus
    extra = [(1000 + k, t) for k, t in enumerate(odd_texts)] + [(1006, odd_texts[6])]
    got = crf.judge(docs.unionByName(make_docs(spark, extra)), labels).collect()
    assert len(got) == len(rows) + len(extra)
    texts = dict(rows) | dict(extra)
    for r in got:
        want = base_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)
    own = [r for r in got if r.doc_id < 1000]
    assert all(r.kept for r in own if r.doc_id % 6) and not any(r.kept for r in own if r.doc_id % 6 == 0)
    assert crf.judge(docs.limit(0), labels).count() == 0
    assert crf.judge(docs, labels.limit(0)).where("kept").count() > 150


def test_viterbi_and_gradient_against_enumeration():
    rng = np.random.default_rng(6)
    x, docs = rng.random((9, 4)), np.array([0, 4, 5, 9])
    y = rng.integers(0, 2, 9)
    field = crf.Field(rng.normal(size=(4, 2)), rng.normal(size=(2, 2)))
    worth = lambda labels, a: sum(x[a + k] @ field.weights[:, v] for k, v in enumerate(labels)) + sum(field.moves[u, v] for u, v in zip(labels, labels[1:], strict=False))
    best, total = [], 0.0
    for a, b in zip(docs, docs[1:], strict=False):
        ways = {w: worth(w, a) for w in itertools.product((0, 1), repeat=b - a)}
        best += max(ways, key=ways.get)
        total += worth(tuple(y[a:b]), a) - np.log(sum(map(np.exp, ways.values())))
    assert field.viterbi(x, docs).tolist() == best
    grads = field.gradient(x, docs, y)

    def likelihood():
        return sum(worth(tuple(y[a:b]), a) - np.log(sum(np.exp(worth(w, a)) for w in itertools.product((0, 1), repeat=b - a))) for a, b in zip(docs, docs[1:], strict=False))

    for grad, values in ((grads[0], field.weights), (grads[1], field.moves)):
        for at in np.ndindex(values.shape):
            old = values[at]
            values[at] = old + 1e-5
            up = likelihood()
            values[at] = old
            assert abs((up - total) / 1e-5 - grad[at]) < 1e-3


def edits(a, b):
    """Within one edit, by cases."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return len(b) - len(a) <= 1 and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :])


def test_line_dedup_against_all_pairs(spark, prose):
    rng = np.random.default_rng(8)
    pool = [prose(n, n).replace("\n", " ") for n in range(3, 15)] + ["short one", "short two", "page 1", "page 2", "  "]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.integers(1, 6)):
            line = pool[rng.integers(len(pool))]
            if len(line) > 25 and rng.random() < 0.6:
                k = int(rng.integers(len(line)))
                line = [line[:k] + line[k + 1 :], line[:k] + "q" + line[k:], line[:k] + "Z" + line[k + 1 :], line + "!", line[1:]][rng.integers(5)]
            lines.append(line + "  " * int(rng.integers(2)))
        rows.append((i, "\n".join(lines)))
    want = plain_lines(rows)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(make_docs(spark, rows[::-1])).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert sum(r.n_near for r in got.values()) > 20
    kept = line_dedup.filter_lines(make_docs(spark, rows).withColumn("mask", F.lit(1)).withColumn("n_lines", F.lit("x")))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "mask", "n_lines"]
    left, stage = {r.doc_id: r for r in kept.collect()}, plain_lines(rows, line_dedup.STAGE_CHARS)
    assert set(left) == {i for i, t in stage.items() if t.strip() or not dict(rows)[i].strip()}
    assert all(r.n_chars == len(r.text) and r.text == stage[i] for i, r in left.items())


def plain_lines(rows, least=1):
    """Texts without the lines that equal an earlier line or lie within one edit of it, removed or not; blank lines stay."""
    seen, out = [], {}
    for i, text in rows:
        stays = []
        for line in text.split("\n"):
            bare = line.strip(line_dedup.WHITE)
            if not bare or not any(bare == s or (len(bare) >= least and edits(bare, s)) for s in seen):
                stays.append(line)
            if bare:
                seen.append(bare)
        out[i] = "\n".join(stays)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup_of_short_lines_against_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(60):
        lines = ["".join(rng.choice(list("ab é"), rng.integers(0, (4, 8, 20)[rng.integers(3)]))) for _ in range(rng.integers(1, 5))]
        rows.append((i, "\n".join(lines)))
    want = plain_lines(rows)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(make_docs(spark, rows)).collect()}
    assert got == want and want != dict(rows)


def test_line_dedup_at_the_least_length(spark):
    line = "abcdefghij klmnopqrs"  # 20 characters
    other = "tuvwxyz tuvwxyz abc"  # 19 characters
    rows = [(1, line[:-1]), (2, line), (3, line[:-1] + "!"), (4, line[:-2] + "?"), (5, other + "."), (6, other), (7, other[:-1] + "d")]
    want = {1: False, 2: True, 3: True, 4: False, 5: False, 6: False, 7: False}
    # 2 and 3 go for a line of 19; 4, 6 and 7 are near earlier lines but too short themselves
    assert {i: not any(edits(t, s) for j, s in rows if j < i and len(t) >= line_dedup.STAGE_CHARS) for i, t in rows} == {i: not w for i, w in want.items()}
    got = {r.doc_id: r.all_removed for r in line_dedup.dedup_lines(make_docs(spark, rows), line_dedup.STAGE_CHARS).collect()}
    assert got == want


def test_line_dedup_near_a_line_without_an_id(spark):
    line = "a line without an id, of some length"
    rows = [(None, line), (1, line + "."), (2, line[:5] + line[6:]), (3, "another line of quite some length")]
    got = {r.doc_id: (r.all_removed, r.n_near) for r in line_dedup.dedup_lines(make_docs(spark, rows)).collect()}
    assert got == {None: (False, 0), 1: (True, 1), 2: (True, 1), 3: (False, 0)}


def test_line_dedup_of_odd_input(spark, odd_texts):
    docs = make_docs(spark, list(enumerate(odd_texts)) + [(None, "a line without an id, of some length"), (3, "a"), (40, "\n".join(["x y z"] + ["n%d of many" % k for k in range(200)] + ["x y z"]))])
    every = {(r.doc_id, r.n_lines): r for r in line_dedup.dedup_lines(docs).collect()}
    # lines of a number each lie within an edit of the first of their length
    assert every[40, 202].text == plain_lines([(40, docs.where("doc_id = 40").first().text)])[40] and every[40, 202].n_removed > 150
    got = {(r.doc_id, r.n_lines): r for r in line_dedup.dedup_lines(docs, line_dedup.STAGE_CHARS).collect()}
    assert got[0, 0].text is None and got[1, 1].text == "" and got[2, 2].text == " \n\t "
    assert got[6, odd_texts[6].count("\n") + 1].text == odd_texts[6] and got[7, odd_texts[7].count("\n") + 1].all_removed
    assert got[11, 30].n_removed == 29 and got[40, 202].n_removed == 1 and got[40, 202].text.count("\n") == 200
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_runs_join_pieces_of_long_texts():
    text = "ab cd " * 1000
    whole = next(runs_of([text]))
    parts = list(runs_of([None, text, ""], limit=500))
    assert np.array_equal(np.concatenate([p.hashes() for p in parts]), whole.hashes())


