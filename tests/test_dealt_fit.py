"""Fits of small inputs from whole copies of the sequences, of large ones from spread blocks, and the kernel behind both."""

import numpy as np
import pytest

from tests.test_fit import SETTINGS, arrays, plain_em, sequences
from weekpanel.functions import hmm_kernels as kernels
from weekpanel.operators import clustering, hmm

MODELS = [
    hmm.Candidate("a", 2, 2), hmm.Candidate("b", 3, 3, "full", 21, 12.0), hmm.Candidate("c", 2, 1, columns=(1,)),
    hmm.Candidate("d", 2, 1, "full", columns=(1,)), hmm.Candidate("e", 4, 2, "full", 21),
]


def check_against_plain_em(data, iterations):
    starts = clustering.kmeans(data, [hmm.setting_of(c) for c in MODELS])
    found = hmm.fit(data, MODELS, iterations=iterations, tolerance=-np.inf)
    assert [f.candidate for f in found] == MODELS
    for f in found:
        history, params = plain_em(arrays(data), f.candidate, hmm.initial_params(f.candidate, starts[hmm.setting_of(f.candidate)]), iterations)
        assert not f.error and f.history == pytest.approx(history, rel=1e-9)
        for key in ("means", "covars", "trans", "start"):
            assert f.params[key].shape == params[key].shape
            np.testing.assert_allclose(f.params[key], params[key], rtol=1e-6, atol=1e-8)


def test_sequences_of_several_partitions_take_a_job_per_many_passes(spark, monkeypatch):
    data = sequences(spark, parts=5)
    jobs, passes = [], hmm._passes
    monkeypatch.setattr(hmm, "_passes", lambda *a: jobs.append((a[3], len(a[1]))) or passes(*a))
    monkeypatch.setattr(hmm, "_summed_statistics", None)
    check_against_plain_em(data, 29)
    assert jobs == [(25, 4), (5, 4)]  # the two forms of one feature are one model


def test_sequences_beyond_one_partition_are_spread(spark, monkeypatch):
    data = sequences(spark, parts=5)
    monkeypatch.setattr(hmm, "PARTITION_VALUES", 200)
    monkeypatch.setattr(hmm, "_passes", None)
    check_against_plain_em(data, 6)


def test_a_deal_is_a_whole_copy_in_one_partition(spark):
    data = sequences(spark, parts=5)
    want = sorted(map(tuple, np.concatenate(arrays(data))))
    parts = hmm.deal(data, 3).rdd.mapPartitions(lambda rows: [[(r.deal, np.reshape(r.x, (-1, r.width)).tolist()) for r in rows]]).collect()
    assert sorted({deal for deal, _ in p} for p in parts if p) == [{0}, {1}, {2}]
    assert all(sorted(tuple(v) for _, x in p for v in x) == want for p in parts if p)


def test_dealt_kmeans_equals_one_deal(spark):
    data = sequences(spark, parts=4)
    one, dealt = clustering.kmeans(data, SETTINGS), clustering.kmeans_blocks(hmm.deal(data, 4), SETTINGS, whole=True, deals=4)
    assert one.keys() == dealt.keys()
    for s in SETTINGS:
        np.testing.assert_allclose(dealt[s].centres, one[s].centres, atol=1e-9)
        np.testing.assert_allclose(dealt[s].covariance, one[s].covariance, atol=1e-9)
        assert dealt[s].sizes.tolist() == one[s].sizes.tolist() and dealt[s].inertia == pytest.approx(one[s].inertia)


def some_params(rng, k, d, full):
    a = rng.normal(size=(k, d, d))
    covars = a @ a.transpose(0, 2, 1) + np.eye(d) if full else rng.uniform(0.5, 2, (k, d))
    return {"start": rng.dirichlet(np.ones(k)), "trans": rng.dirichlet(np.ones(k), k), "means": rng.normal(size=(k, d)), "covars": covars}


@pytest.mark.parametrize("run", [1, 16, 1 << 13])
@pytest.mark.parametrize("far", [False, True])
@pytest.mark.parametrize("few", [0, 3])
def test_kernel_equals_the_plain_version_over_any_runs_of_steps(monkeypatch, run, far, few):
    """Ragged lengths, features picked from any place, values so far from the means that densities leave the range of doubles."""
    monkeypatch.setattr(kernels, "FEW_FEATURES", few)
    monkeypatch.setattr(kernels, "RUN", run)
    monkeypatch.setattr(kernels, "LONGEST_RUN", run)
    rng = np.random.default_rng(3)
    xs = [rng.normal(size=(n, 3)) * (60 if far else 1) for n in (17, 40, 3, 1, 40, 22, 1)]
    values, lengths = kernels.pad([x.tolist() for x in xs])
    at = [[0], [0, 1], [2, 0], [0, 1, 2], [1]]
    for k in (1, 2, 4):
        given = [some_params(rng, k, len(a), i % 2 == 1) for i, a in enumerate(at)]
        for a, p, found in zip(at, given, kernels.statistics_many(values, lengths, at, given)):
            want = kernels.pack(kernels.statistics(values[..., a], lengths, p))
            np.testing.assert_allclose(kernels.pack(found), want, rtol=1e-7, atol=1e-7 * (3600 if far else 1))


@pytest.mark.parametrize("scale", [1, 5, 60])
def test_steps_that_are_all_but_impossible(scale):
    for seed in range(6):
        rng = np.random.default_rng(seed)
        values, lengths = kernels.pad([(rng.normal(size=(n, 2)) * scale).tolist() for n in (17, 40, 3, 1, 22)])
        given = [some_params(rng, 3, 2, full) | {"start": np.eye(3)[0], "trans": np.eye(3)[[0, 0, 1]]} for full in (False, True)]
        for p, found in zip(given, kernels.statistics_many(values, lengths, [[0, 1]] * 2, given)):
            assert np.isfinite(kernels.pack(found)).all() and found["weight"].sum() == pytest.approx(lengths.sum())
            if scale < 60:  # beyond, a state's share leaves the range of doubles
                np.testing.assert_allclose(kernels.pack(found), kernels.pack(kernels.statistics(values, lengths, p)), rtol=1e-7, atol=1e-7 * scale**2)


def test_gathered_batches_hold_every_sequence_once():
    rng = np.random.default_rng(2)
    parts = [(rng.normal(size=(int(n.sum()), 2)), n) for n in (rng.integers(1, 9, size) for size in (900, 700, 5))]
    batches = kernels.gathered(parts)
    assert all(len(lengths) <= kernels.GATHERED and (np.diff(lengths) <= 0).all() for _, lengths, _ in batches)
    found = sorted(tuple(v) for runs, _, _ in batches for x, running in runs for step, n in zip(x, running) for v in step[1:3, :n].T)
    assert found == sorted(tuple(v) for rows, _ in parts for v in rows)
