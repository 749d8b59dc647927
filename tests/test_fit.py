"""K-means starts and the distributed fit against plain numpy versions."""

import numpy as np
import pytest

from weekpanel.functions import hmm_kernels as kernels
from weekpanel.operators import clustering, hmm
from weekpanel.operators import stats as st


def sequences(spark, n=8, length=50, seed=3, parts=3):
    rng = np.random.default_rng(seed)
    rows = [(i, t, float(rng.normal(3 * ((t // 10) % 2), 1)), float(rng.normal(((t // 5) % 3), 0.5)), float(rng.normal())) for i in range(n) for t in range(length - i)]
    df = spark.createDataFrame(rows, "entity int, t int, a double, b double, c double")
    return hmm.cut_lineage(hmm.to_sequences(df, ["entity"], "t", ["a", "b", "c"]).repartition(parts))


def arrays(data):
    return [np.array(r.x) for r in data.orderBy("entity").select("x").collect()]


def sample_of(data):
    from pyspark.sql import functions as F

    return np.array([r.v for r in data.select(F.explode("x").alias("v")).orderBy(F.xxhash64("v"), "v").limit(clustering.SEEDING_ROWS).collect()])


def plain_lloyd(x, centres, rounds=200):
    for _ in range(rounds):
        at = np.array([np.argmin([((r - c) ** 2).sum() for c in centres]) for r in x])
        new = np.array([x[at == k].mean(0) if (at == k).any() else centres[k] for k in range(len(centres))])
        if ((new - centres) ** 2).sum() <= clustering.SHIFT:
            return new
        centres = new
    return centres


SETTINGS = [clustering.Setting(k, columns, seed) for k in (2, 3, 5) for columns in ((0, 1), (0, 1, 2), (1,)) for seed in (7, 21)]


def test_kmeans_equals_plain_lloyd(spark):
    data = sequences(spark)
    x, sample = np.concatenate(arrays(data)), sample_of(data)
    found = clustering.kmeans(data, SETTINGS)
    for s in SETTINGS:
        own = x[:, list(s.columns)]
        want = plain_lloyd(own, clustering.plus_plus(sample[:, list(s.columns)], s.k, s.seed))
        got = found[s]
        np.testing.assert_allclose(got.centres, want, atol=1e-9)
        at, distance = clustering.nearest(own, want)
        assert got.inertia == pytest.approx(distance.sum()) and got.sizes.tolist() == np.bincount(at, minlength=s.k).tolist()
        delta = own - want[at]
        np.testing.assert_allclose(got.covariance, delta.T @ delta / len(own), atol=1e-9)


def test_kmeans_is_reproducible_on_any_partitioning(spark):
    one, many = clustering.kmeans(sequences(spark, parts=1), SETTINGS[:6]), clustering.kmeans(sequences(spark, parts=7), SETTINGS[:6])
    for s in SETTINGS[:6]:
        np.testing.assert_allclose(one[s].centres, many[s].centres, atol=1e-9)


def test_kmeans_edge_cases(spark):
    same = spark.createDataFrame([([[1.0, 2.0]] * 5,)], "x array<array<double>>")
    found = clustering.kmeans(same, [clustering.Setting(3, (0, 1), 1)])
    (only,) = found.values()
    assert only.inertia == 0 and only.sizes.sum() == 5 and np.allclose(only.centres, [1.0, 2.0])
    with pytest.raises(ValueError, match="needs rows"):
        clustering.kmeans(same.limit(0), [clustering.Setting(2, (0,), 1)])


def plain_em(xs, candidate, params, iterations, min_covar=1e-3):
    history = []
    values, lengths = kernels.pad(xs)
    for step in range(iterations + 1):
        stats = kernels.statistics(values[..., candidate.positions], lengths, params)
        history.append(stats["ll"])
        if step < iterations:
            params = kernels.maximize(stats, candidate.full, min_covar, candidate.sticky)
    return history, params


@pytest.mark.parametrize("parts", [1, 5])
def test_fit_equals_plain_em(spark, parts):
    data = sequences(spark, parts=parts)
    models = [hmm.Candidate(f"m{k}{d}{c}", k, d, c, 7, sticky) for k in (2, 3) for d in (2, 3) for c, sticky in (("diag", 0.0), ("full", 12.0))]
    models.append(hmm.Candidate("picked", 2, 1, "diag", 21, columns=(1,)))
    starts = clustering.kmeans(data, [hmm.setting_of(c) for c in models])
    for f in hmm.fit(data, models, iterations=8, tolerance=-np.inf):
        history, params = plain_em(arrays(data), f.candidate, hmm.initial_params(f.candidate, starts[hmm.setting_of(f.candidate)]), 8)
        assert not f.error and f.history == pytest.approx(history, rel=1e-9)
        for key in ("means", "covars", "trans", "start"):
            np.testing.assert_allclose(f.params[key], params[key], rtol=1e-6, atol=1e-8)


def test_starts_are_likelier_than_random_draws(spark):
    data = sequences(spark)
    x = np.concatenate(arrays(data))
    values, lengths = kernels.pad(arrays(data))
    for k in (2, 3, 4):
        for seed in (7, 21, 42):
            c = hmm.Candidate("c", k, 3, "full", seed)
            start = hmm.initial_params(c, clustering.kmeans(data, [hmm.setting_of(c)])[hmm.setting_of(c)])
            rng, cov = np.random.default_rng(seed), np.cov(x.T)
            drawn = start | {"means": x.mean(0) + rng.standard_normal((k, 3)) @ np.linalg.cholesky(cov).T, "covars": np.repeat(cov[None], k, 0)}
            assert kernels.statistics(values, lengths, start)["ll"] >= kernels.statistics(values, lengths, drawn)["ll"]


def test_full_fit_converges_and_labels_the_states(spark):
    data = sequences(spark, n=6, length=60)
    (f,) = hmm.fit(data, [hmm.Candidate("m", 2, 1, "diag", 7)])
    assert f.converged and (np.diff(f.history) > -1e-7).all() and f.n_rows == sum(60 - i for i in range(6))
    truth = {(i, t): (t // 10) % 2 for i in range(6) for t in range(60 - i)}
    one = data.selectExpr("entity", "t", "transform(x, v -> array(v[0])) AS x")
    rows = hmm.explode_inference(hmm.infer(one, ["entity"], f.params), ["entity"], 2, "t").collect()
    agree = np.mean([truth[r.entity, r.t] == r.regime_viterbi for r in rows])
    assert max(agree, 1 - agree) > 0.85


def test_persistence_filter_before_the_greedy_search(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(4):
        walk = rng.normal(size=40).cumsum()
        rows += [(k, t, float(walk[t]), float(rng.normal()), float(-1.0) ** t) for t in range(40)]
    df = spark.createDataFrame(rows, "k int, t int, walk double, noise double, flip double")
    assert st.persistent_features(df, ["k"], ["noise", "walk", "flip"], "t") == ["walk", "flip"]
    chosen, _ = hmm.greedy_bic(df, ["k"], "t", ["walk", "flip"], [["none", "flip"]], 2, 2, 3, iterations=4)
    assert chosen[0] == "flip" and "noise" not in chosen


def test_data_in_one_partition_take_a_job_per_many_passes(spark, monkeypatch):
    """60 passes over one sequence: three jobs, none of which sums over tasks, with the results of plain EM."""
    data = sequences(spark, n=1, length=60, parts=1)
    models = [hmm.Candidate("a", 2, 2), hmm.Candidate("b", 3, 3, "full", 21, 12.0), hmm.Candidate("c", 2, 1, columns=(1,))]
    starts = clustering.kmeans(data, [hmm.setting_of(c) for c in models])
    jobs, passes = [], hmm._passes
    monkeypatch.setattr(hmm, "_passes", lambda *a: jobs.append(a[3]) or passes(*a))
    monkeypatch.setattr(hmm, "_summed_statistics", None)
    monkeypatch.setattr(clustering, "LOCAL_ROUNDS", 2)
    for f in hmm.fit(data, models, iterations=59, tolerance=-np.inf):
        history, params = plain_em(arrays(data), f.candidate, hmm.initial_params(f.candidate, starts[hmm.setting_of(f.candidate)]), 59)
        assert not f.error and not f.converged and f.n_rows == 60 and f.history == pytest.approx(history, rel=1e-8)
        for key in ("means", "covars", "trans", "start"):
            np.testing.assert_allclose(f.params[key], params[key], rtol=1e-5, atol=1e-7)
    assert jobs == [25, 25, 10]


def test_many_passes_per_job_equal_one_pass_per_job(spark, monkeypatch):
    """Converged, failed and unfinished models alike, and however many passes a job makes."""
    data = sequences(spark, n=1, length=60, parts=1)
    start = hmm.initial_params
    broken = lambda c, m: start(c, m) | ({"covars": -np.ones((2, 2, 2))} if c.name == "bad" else {})
    monkeypatch.setattr(hmm, "initial_params", broken)
    models = [hmm.Candidate("bad", 2, 2, "full"), *[hmm.Candidate(f"m{k}{s}", k, 2, "diag", s) for k in (2, 3) for s in (7, 21)]]
    found = []
    for passes in (1, 4, 25):
        monkeypatch.setattr(hmm, "PASSES", passes)
        found.append([(f.candidate.name, f.history, f.n_rows, f.converged, f.error, [f.params[k].tolist() for k in kernels.PARAMS]) for f in hmm.fit(data, models, 30)])
    assert found[0] == found[1] == found[2] and found[0][0][4] and {f[3] for f in found[0]} == {True, False}


def test_the_grid_is_fitted_anew_when_the_tables_of_a_folder_change(spark, monkeypatch):
    from pyspark.sql import functions as F

    from weekpanel.plans import regimes

    for name, values in (("GRID_STATES", (2,)), ("GRID_COMPONENTS", (2,)), ("GRID_COVARIANCES", ("diag",)), ("GRID_SEEDS", (7,))):
        monkeypatch.setattr(regimes, name, values)
    weeks = spark.range(120).selectExpr("'core' AS panel", "date_add(date '1998-01-02', cast(7 * id AS int)) AS week_end", "cast(id * 7 % 5 AS double) AS pc1", "cast(id div 9 % 2 AS double) AS pc2")
    changed = weeks.withColumn("pc1", F.col("pc1") * 2)
    monkeypatch.setattr(regimes, "prepared", lambda base: base)
    runs = []
    for table in (weeks, weeks.repartition(5), changed):
        monkeypatch.setattr(regimes, "state", lambda *_: table)
        runs.append(regimes.fitted_grid(spark, "a folder"))
    assert runs[0] is runs[1] and runs[2][0].agg(F.sum("pc1")).first() == changed.agg(F.sum("pc1")).first()
    (before,), (after,) = runs[0][3].values(), runs[2][3].values()
    assert not np.allclose(before.params["means"][:, 0], after.params["means"][:, 0])


def test_content_tells_places_of_nulls(spark):
    from weekpanel.plans import regimes

    rows = [spark.createDataFrame([r], "a double, b double") for r in ((1.0, None), (None, 1.0), (1.0, 1.0))]
    assert len({regimes.content(r) for r in rows}) == 3
