"""The time-parallel scan against the sequential recursions, for any cutting and any fan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekpanel.functions import hmm_kernels as kernels
from weekpanel.functions import scan_kernels as scan
from weekpanel.operators import hmm_scan

MODELS = {
    "diag": {"start": [0.5, 0.3, 0.2], "trans": [[0.8, 0.1, 0.1], [0.2, 0.7, 0.1], [0.05, 0.15, 0.8]],
             "means": [[0.0, 0.0], [1.5, 1.0], [-1.0, 2.0]], "covars": [[1.0, 0.5], [0.5, 1.5], [1.0, 1.0]]},
    "full": {"start": [0.9, 0.1], "trans": [[0.95, 0.05], [0.0, 1.0]], "means": [[0.0, 0.0], [1.0, 1.0]],
             "covars": [[[1.0, 0.4], [0.4, 1.0]], [[0.7, -0.2], [-0.2, 1.3]]]},
}
KIND = "a string, b int, t int, x1 double, x2 double"


def rows_of(seed, lengths):
    rng = np.random.default_rng(seed)
    out = []
    for i, n in enumerate(lengths):
        key = (None if i == 1 else f"k{i}", i % 2)
        out += [(*key, 3 * t, *[None if t % 11 == 5 and j else float(v) for j, v in enumerate(rng.normal((t // 15) % 2, 1, 2))]) for t in range(n)]
    return out


def sequential(rows, model):
    p = {k: np.asarray(v, float) for k, v in model.items()}
    out = {}
    for key in {r[:2] for r in rows}:
        own = sorted([r for r in rows if r[:2] == key and None not in r[3:]], key=lambda r: r[2])
        if not own:
            continue
        values, lengths = kernels.pad([[r[3:] for r in own]])
        b = kernels.log_emissions(values, p["means"], p["covars"])
        alpha, beta = kernels.forward(b, p["start"], p["trans"]), kernels.backward(b, p["trans"], lengths)
        path = kernels.viterbi(b, p["start"], p["trans"], lengths)[0]
        for r, f, s, v in zip(own, kernels.normalized(alpha)[0], kernels.normalized(alpha + beta)[0], path):
            out[r[:3]] = (f, s, v)
    return out


@pytest.mark.parametrize("model", list(MODELS))
@pytest.mark.parametrize("width,fan", [(1, 2), (9, 3), (30, 64), (100_000, 2)])
def test_chunked_equals_sequential(spark, model, width, fan):
    rows = rows_of(1, [140, 61, 1, 33, 6])
    found = hmm_scan.infer_long(spark.createDataFrame(rows[::-1], KIND), ["a", "b"], "t", ["x1", "x2"], MODELS[model], F.floor(F.col("t") / width), fan).collect()
    want = sequential(rows, MODELS[model])
    assert len(found) == len(want)
    for r in found:
        filtered, smoothed, path = want[r.a, r.b, r.t]
        np.testing.assert_allclose(r.filtered, filtered, atol=1e-9)
        np.testing.assert_allclose(r.smoothed, smoothed, atol=1e-9)
        assert r.viterbi == path


def test_empty_and_single_rows(spark):
    one = spark.createDataFrame([("a", 1, 5, 0.5, 0.5)], KIND)
    args = (["a", "b"], "t", ["x1", "x2"], MODELS["full"], F.col("t"))
    assert hmm_scan.infer_long(one, *args).first().viterbi in (0, 1)
    assert hmm_scan.infer_long(one.limit(0), *args).count() == 0


def test_products_are_associative():
    rng = np.random.default_rng(3)
    a, b, c = (scan.log(rng.random((3, 3))) for _ in range(3))
    for op in (scan.times, scan.most):
        np.testing.assert_allclose(op(op(a, b), c), op(a, op(b, c)), atol=1e-12)
    np.testing.assert_allclose(scan.times(a, b), np.log(np.exp(a) @ np.exp(b)), atol=1e-12)


def test_no_task_holds_a_whole_sequence(spark):
    rows = spark.createDataFrame(rows_of(2, [400]), KIND)
    chunks = hmm_scan.cut(rows, ["a", "b"], "t", ["x1", "x2"], F.floor(F.col("t") / 30))
    sizes = [len(r.x) for r in chunks.collect()]
    assert max(sizes) <= 10 and len(sizes) == 40 and sorted(r.idx for r in chunks.collect()) == list(range(40))


def test_scan_goes_from_arrow_to_arrow(spark):
    """No step of the scan turns members or values into Python objects."""
    out = hmm_scan.infer_long(spark.createDataFrame(rows_of(3, [60, 20]), KIND), ["a", "b"], "t", ["x1", "x2"], MODELS["diag"], F.floor(F.col("t") / 9), 2)
    plan = out._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
