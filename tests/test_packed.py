"""Packed sequences and the kernels over many models: everything once, bounded, equal to the plain versions."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from weekpanel.functions import arrow_rows
from weekpanel.functions import hmm_kernels as kernels
from weekpanel.operators import clustering, hmm


def models(k, d, n, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        a = rng.normal(size=(k, d, d))
        covars = a @ a.transpose(0, 2, 1) + np.eye(d) if i % 2 else rng.uniform(0.5, 2, (k, d))
        out.append({"start": rng.dirichlet(np.ones(k)), "trans": rng.dirichlet(np.ones(k), k), "means": rng.normal(size=(k, d)), "covars": covars})
    return out


@pytest.mark.parametrize("lengths", [[7, 1, 30, 30, 2], [1], [1, 1, 1], [40]])
def test_many_models_equal_single_ones_in_any_order_of_lengths(lengths):
    rng, given = np.random.default_rng(5), models(3, 2, 5)
    values, lengths = kernels.pad([rng.normal(size=(n, 2)).tolist() for n in lengths])
    for p, found in zip(given, kernels.statistics_many(values, lengths, [[0, 1]] * 5, given)):
        np.testing.assert_allclose(kernels.pack(found), kernels.pack(kernels.statistics(values, lengths, p)), rtol=1e-9, atol=1e-9)


def test_many_models_need_bounded_memory():
    values, lengths = np.random.default_rng(1).normal(size=(512, 200, 2)), np.full(512, 200)
    tracemalloc.start()
    kernels.statistics_many(values, lengths, [[0, 1]] * 16, models(4, 2, 16))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def test_packed_blocks_hold_every_vector_once(spark):
    rows = [(i, [[float(i), float(t)] for t in range(n)]) for i, n in enumerate([3, 0, 700, 1, 5, 5] * 300)]
    data = spark.createDataFrame(rows, "entity int, x array<array<double>>").repartition(3)
    blocks = clustering.packed(data).collect()
    assert all(len(b.lengths) <= clustering.BLOCK_SEQUENCES and max(b.lengths) * len(b.lengths) <= clustering.BLOCK_STEPS for b in blocks)
    assert all(sum(b.lengths) * b.width == len(b.x) for b in blocks)
    found = sorted(tuple(v) for b in blocks for v in np.reshape(b.x, (-1, b.width)))
    assert found == sorted(tuple(v) for _, x in rows for v in x)


def test_large_inputs_are_dealt_over_bounded_partitions(spark, monkeypatch):
    monkeypatch.setattr(hmm, "PARTITION_VALUES", 2000)
    data = spark.createDataFrame([(i, [[float(i), 1.0]] * 50) for i in range(5000)], "entity int, x array<array<double>>").coalesce(1)
    dealt = hmm.deal(data)
    assert dealt.rdd.getNumPartitions() == 250 and dealt.selectExpr("sum(size(x))").first()[0] == 500_000


def test_arrow_rows_round_trip():
    column = pa.array([[[1.0, 2.0]], [[3.0, 4.0], [5.0, 6.0]]]).slice(1)
    rows, lengths = arrow_rows.vectors(column)
    assert rows.tolist() == [[3.0, 4.0], [5.0, 6.0]] and lengths.tolist() == [2]
    values = arrow_rows.padded(np.arange(6.0).reshape(3, 2), np.array([1, 2]))
    assert arrow_rows.cut(values, np.array([1, 2])).tolist() == np.arange(6.0).reshape(3, 2).tolist()
    assert arrow_rows.lists(arrow_rows.arrays(rows), np.array([2])).to_pylist() == [[[3.0, 4.0], [5.0, 6.0]]]
    assert [(r.start, r.stop) for r in arrow_rows.runs(np.array([1, 9, 1, 1, 1]), 2, 10)] == [(0, 1), (1, 2), (2, 4), (4, 5)]


def test_inference_holds_no_python_objects_per_value(spark):
    """The whole result goes from Arrow to Arrow; keys of any type and empty sequences pass."""
    rows = [(None if i == 3 else f"k{i}", i, [[float((t * i) % 5), 1.0] for t in range(n)], list(range(n))) for i, n in enumerate([4, 600, 1, 3, 0])]
    data = spark.createDataFrame(rows, "a string, b int, x array<array<double>>, t array<int>").coalesce(1)
    params = {"start": [0.6, 0.4], "trans": [[0.9, 0.1], [0.2, 0.8]], "means": [[1.0, 1.0], [3.0, 1.0]], "covars": [[1.0, 1.0], [2.0, 1.0]]}
    out = hmm.infer(data, ["a", "b"], params)
    assert "MapInArrow" in out._jdf.queryExecution().toString()
    assert [(r.a, r.b, r.t) for r in out.collect()] == [(a, b, t) for a, b, _, t in rows]
    p = {k: np.asarray(v) for k, v in params.items()}
    for r, (_, _, x, _) in zip(out.collect(), rows):
        if not x:
            assert r.filtered == r.smoothed == r.viterbi == [] and r.log_likelihood == 0
            continue
        values, lengths = kernels.pad([x])
        b = kernels.log_emissions(values, p["means"], p["covars"])
        alpha, beta = kernels.forward(b, p["start"], p["trans"]), kernels.backward(b, p["trans"], lengths)
        np.testing.assert_allclose(r.filtered, kernels.normalized(alpha)[0], atol=1e-12)
        np.testing.assert_allclose(r.smoothed, kernels.normalized(alpha + beta)[0], atol=1e-12)
        assert r.viterbi == kernels.viterbi(b, p["start"], p["trans"], lengths)[0].tolist()
