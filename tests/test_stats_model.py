"""Statistics against numpy, hidden-Markov kernels against enumeration, EM, PCA."""

import datetime as dt
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekpanel.functions import hmm_kernels as hk
from weekpanel.operators import hmm, reduction
from weekpanel.operators import stats as st

WEEK = lambda i: dt.date(2015, 1, 2) + dt.timedelta(days=7 * i)


def frame(spark, n=500, seed=0):
    rng = np.random.default_rng(seed)
    # a third of all rows share one value and one group
    rows = [("hot" if i % 3 == 0 else f"g{i % 5}", 7.0 if i % 3 == 1 else float(rng.normal()), float(rng.exponential())) for i in range(n)]
    return spark.createDataFrame(rows, "g string, a double, b double"), rows


def test_exact_percentiles_with_hot_values_and_groups(spark):
    df, rows = frame(spark)
    probs = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)
    got = {(r.feature, r.p): r.value for r in st.exact_percentiles(df, ["a", "b"], probs, slices=7).collect()}
    for i, c in ((1, "a"), (2, "b")):
        for p in probs:
            assert got[(c, p)] == pytest.approx(np.quantile([r[i] for r in rows], p), abs=1e-12)
    by = {(r.g, r.p): r.value for r in st.exact_percentiles(df, ["b"], (0.3,), ["g"], slices=3).collect()}
    for g in {r[0] for r in rows}:
        assert by[(g, 0.3)] == pytest.approx(np.quantile([r[2] for r in rows if r[0] == g], 0.3))
    single = spark.createDataFrame([(5.0,), (None,)], "a double")
    assert st.exact_percentiles(single, ["a"], (0.5,)).first().value == 5.0


def test_moments_outliers_boxes(spark):
    df, rows = frame(spark)
    b = np.array([r[2] for r in rows])
    m = st.moments(df, ["b"]).first()
    z = (b - b.mean()) / b.std()
    assert m.skewness == pytest.approx((z**3).mean()) and m.kurtosis == pytest.approx((z**4).mean() - 3) and m.std == pytest.approx(b.std(ddof=1))
    q1, q3 = np.quantile(b, [0.25, 0.75])
    out = st.iqr_outliers(df, ["b"]).first()
    assert out.n_outliers == int(((b < q1 - 1.5 * (q3 - q1)) | (b > q3 + 1.5 * (q3 - q1))).sum())
    box = {r.g: r for r in st.box_stats(df, ["b"], ["g"]).collect()}["hot"]
    hot = np.array([r[2] for r in rows if r[0] == "hot"])
    h1, h3 = np.quantile(hot, [0.25, 0.75])
    assert box.whisker_high == pytest.approx(hot[hot <= h3 + 1.5 * (h3 - h1)].max()) and box.median == pytest.approx(np.median(hot))
    assert st.describe(df, ["b"]).first().p50 == pytest.approx(np.median(b))


def test_histogram_matches_numpy(spark):
    df, rows = frame(spark)
    b = np.array([r[2] for r in rows])
    counts, edges = np.histogram(b, bins=10)
    got = {r.bin: r for r in st.histogram(df, ["b"], 10).collect()}
    assert [got[i].n if i in got else 0 for i in range(10)] == counts.tolist()
    assert got[3].bin_start == pytest.approx(edges[3]) and got[0].density == pytest.approx(np.histogram(b, 10, density=True)[0][0])
    flat = spark.createDataFrame([(1.0,), (1.0,)], "a double")
    assert st.histogram(flat, ["a"]).first().n == 2


def test_missing_duplicates_correlation(spark):
    df = spark.createDataFrame([(1.0, None, 2.0), (2.0, 1.0, 4.0), (3.0, 5.0, 6.0), (3.0, 5.0, 6.0)], "a double, b double, c double")
    assert {r.feature: r.n_missing for r in st.missingness(df, ["a", "b"]).collect()} == {"a": 0, "b": 1}
    assert st.duplicate_rows(df).first()[:] == (4, 1)
    r = {(x.feature_a, x.feature_b): x.r for x in st.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert r[("a", "c")] == pytest.approx(1.0) and r[("a", "b")] == pytest.approx(np.corrcoef([2, 3, 3], [1, 5, 5])[0, 1]) and len(r) == 6
    assert {(x.feature_a, x.feature_b) for x in st.high_correlations(df, ["a", "b", "c"], threshold=0.99).collect()} >= {("a", "c")}


def test_autocorrelation(spark):
    x = np.random.default_rng(2).normal(size=60).cumsum()
    df = spark.createDataFrame([("k", i, float(v), 1.0) for i, v in enumerate(x)], "k string, t int, v double, flat double")
    c = x - x.mean()
    got = {r.lag: r.acf for r in st.autocorrelation(df, ["k"], "v", "t", 5).collect()}
    for lag in range(6):
        assert got[lag] == pytest.approx((c[lag:] * c[: len(c) - lag]).sum() / (c * c).sum())
    one = {r.feature: r for r in st.lag_one(df, ["k"], ["v", "flat"], "t").collect()}
    assert one["v"].acf_1 == pytest.approx(np.corrcoef(x[1:], x[:-1])[0, 1]) and one["v"].persistent and not one["flat"].persistent


def test_standardize_uses_fit_rows_and_population_spread(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (1, 3.0, 5.0), (2, 1000.0, 5.0)], "i int, a double, b double")
    out = sorted((r.i, r.a, r.b) for r in st.standardize(df, ["a", "b"], F.col("i") == 1).collect())
    assert out == [(1, -1.0, 0.0), (1, 1.0, 0.0), (2, 10.0, 0.0)]
    checks = st.scaling_checks(st.standardize(df, ["a"], F.col("i") == 1, None).filter("i = 1"), ["a"]).first()
    assert checks.mean_abs_max == 0.0 and checks.std_min == pytest.approx(1.0)
    assert sorted(round(r.scaled, 6) for r in st.min_max(df, "a", ["b"]).collect()) == [0.0, round(2 / 999, 6), 1.0]


PARAMS = {
    "start": [0.6, 0.4], "trans": [[0.7, 0.3], [0.2, 0.8]], "means": [[0.0, 0.0], [2.0, 1.0]], "covars": [[1.0, 0.5], [0.5, 1.5]],
}


def enumerate_paths(x):
    start, trans = np.array(PARAMS["start"]), np.array(PARAMS["trans"])
    b = np.exp(hk.log_emissions(x, np.array(PARAMS["means"]), np.array(PARAMS["covars"])))
    weights = {p: start[p[0]] * b[0, p[0]] * np.prod([trans[p[t - 1], p[t]] * b[t, p[t]] for t in range(1, len(x))]) for p in product((0, 1), repeat=len(x))}
    total = sum(weights.values())
    smooth = np.array([[sum(w for p, w in weights.items() if p[t] == k) / total for k in (0, 1)] for t in range(len(x))])
    return np.log(total), smooth, max(weights, key=weights.get)


def sequences(spark, data):
    rows = [(k, [WEEK(i) for i in range(len(x))], [list(map(float, r)) for r in x]) for k, x in data.items()]
    return spark.createDataFrame(rows, "entity string, t array<date>, x array<array<double>>")


def test_inference_matches_enumeration_and_is_causal(spark):
    rng = np.random.default_rng(5)
    data = {"long": rng.normal(1, 1, (6, 2)), "short": rng.normal(1, 1, (3, 2)), "one": rng.normal(1, 1, (1, 2))}
    seq = sequences(spark, data)
    out = {r.entity: r for r in hmm.infer(seq, ["entity"], PARAMS).collect()}
    native = {r.entity: r.filtered for r in hmm.forward_filter_sql(seq, ["entity"], PARAMS).collect()}
    for k, x in data.items():
        ll, smooth, path = enumerate_paths(x)
        assert out[k].log_likelihood == pytest.approx(ll)
        np.testing.assert_allclose(np.array(out[k].smoothed), smooth, atol=1e-10)
        assert tuple(out[k].viterbi) == path
        filtered = np.array([enumerate_paths(x[: t + 1])[1][-1] for t in range(len(x))])  # only the past
        np.testing.assert_allclose(np.array(out[k].filtered), filtered, atol=1e-10)
        np.testing.assert_allclose(np.array(native[k]), filtered, atol=1e-10)
    weeks = hmm.explode_inference(hmm.infer(seq, ["entity"], PARAMS), ["entity"], 2)
    assert weeks.count() == 10 and "smoothed_prob_regime_1" in weeks.columns


def test_full_covariance_density():
    x, cov = np.array([[0.3, -0.2]]), np.array([[[2.0, 0.5], [0.5, 1.0]]])
    want = -0.5 * (2 * np.log(2 * np.pi) + np.log(np.linalg.det(cov[0])) + x[0] @ np.linalg.inv(cov[0]) @ x[0])
    assert hk.log_emissions(x, np.zeros((1, 2)), cov)[0, 0] == pytest.approx(want)


def simulate(n_seq=12, steps=60, seed=0):
    rng = np.random.default_rng(seed)
    data = {}
    for i in range(n_seq):
        s, xs = 0, []
        for _ in range(steps):
            s = s if rng.random() < 0.95 else 1 - s
            xs.append(rng.normal([-2.0, 0.0] if s == 0 else [2.0, 1.0], 0.5))
        data[f"s{i}"] = np.array(xs)
    return data


def test_fit_is_monotone_and_recovers_states(spark):
    seq = sequences(spark, simulate())
    models = [hmm.Candidate("diag", 2, 2, "diag", 7), hmm.Candidate("full", 2, 2, "full", 21, sticky=12.0), hmm.Candidate("second", 2, 1, "diag", 7, columns=(1,))]
    fitted = {f.candidate.name: f for f in hmm.fit(seq, models, iterations=25)}
    for name in ("diag", "second"):
        assert (np.diff(fitted[name].history) > -1e-6).all()
    means = np.sort(np.asarray(fitted["diag"].params["means"])[:, 0])
    np.testing.assert_allclose(means, [-2, 2], atol=0.15)
    assert np.diag(fitted["diag"].params["trans"]).min() > 0.85
    table = hmm.results_table(spark, fitted.values(), hmm.score(seq, list(fitted.values())))
    row = table.filter("candidate = 'diag'").first()
    k = 1 + 2 + 4 + 4
    assert row.bic == pytest.approx(-2 * row.log_likelihood + k * np.log(720)) and row.val_ll_per_step is not None


def test_failed_candidates_keep_their_row(spark):
    bad = hmm.Fitted(hmm.Candidate("bad", 2, 1), {"start": np.ones(2), "trans": np.ones((2, 2)), "means": np.ones((2, 1)), "covars": np.ones((2, 1))}, error="nan")
    row = hmm.results_table(spark, [bad]).first()
    assert row.failed and row.error == "nan" and row.val_ll_per_step is None and row.bic is None


def test_grid_and_greedy(spark):
    data = simulate(6, 30)
    seq = sequences(spark, data)
    found = hmm.grid_search(seq, seq, hmm.grid((2,), (1, 2), ("diag",), (7, 21)), iterations=3)
    assert found.count() == 4 and found.filter("is_best_seed").count() == 2
    rows = [(k, WEEK(i), float(a), float(b), float(np.sin(i * 7.3) * 0.1)) for k, x in data.items() for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "entity string, week_end date, a double, b double, noise double")
    chosen, trace = hmm.greedy_bic(df, ["entity"], "week_end", ["a", "b", "noise"], [["zz", "b"]], 2, 2, 3, iterations=3)
    assert chosen[0] == "b" and len(chosen) >= 2 and len(trace) == len(chosen)


def test_components_match_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3)) @ np.array([[2, 1, 0], [0, 1, 0.5], [0, 0, 0.3]])
    z = (x - x.mean(0)) / x.std(0)
    df = spark.createDataFrame([tuple(map(float, r)) for r in z], "a double, b double, c double")
    got = reduction.fit_components(df, ["a", "b", "c"], F.lit(True))
    values, vectors = np.linalg.eigh(np.cov(z.T))
    np.testing.assert_allclose(got.explained, values[::-1] / values.sum(), atol=1e-9)
    np.testing.assert_allclose(np.abs(got.loadings), np.abs(vectors[:, ::-1]), atol=1e-6)
    assert (got.loadings[np.abs(got.loadings).argmax(0), range(3)] > 0).all()
    scores = np.array([(r.pc1, r.pc2) for r in reduction.project(df, got, 2).collect()])
    np.testing.assert_allclose(scores, z @ got.loadings[:, :2], atol=1e-9)
    assert reduction.Components(("a",), np.ones((1, 1)), np.ones(1)).choose() == 1
    many = reduction.Components(tuple("abcdefgh"), np.eye(8), np.full(8, 0.125))
    assert many.choose() == 5
