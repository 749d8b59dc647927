"""Calendar mapping, rolling rules, features, macro transforms and as-of joins."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weekpanel.functions.semantics import clip, null_if_nan, ordered, ratio, rolling, rolling_corr, safe_ln, zscore, whole
from weekpanel.operators import features as feat
from weekpanel.operators.asof import asof_backward, macro_features_weekly
from weekpanel.operators.calendar import densify, resample_weekly, week_end, week_ends, week_spine

D = dt.date


def prices(spark, n=90, skip=()):
    rng = np.random.default_rng(3)
    rows = []
    for s in feat.REQUIRED_TICKERS:
        level = 100.0
        for i in range(n):
            day = D(2015, 1, 1) + dt.timedelta(days=i)
            level *= float(np.exp(rng.normal(0, 0.01)))
            if (s, i) in skip:
                continue
            rows.append(("p", day, s, level, level * 1.01, level * 0.99, level, level, float(100 + i), "t"))
    return spark.createDataFrame(
        rows, "panel string, date date, symbol string, open double, high double, low double, close double, adj_close double, volume double, source string"
    )


def wide_pandas(df, column):
    return df.toPandas().pivot(index="date", columns="symbol", values=column).sort_index()


def test_week_end_is_friday_on_or_after(spark):
    days = [D(2015, 1, 1), D(2015, 1, 2), D(2015, 1, 3)]  # Thu, Fri, Sat
    out = spark.createDataFrame([(d,) for d in days], "d date").select(week_end("d")).collect()
    assert [r[0] for r in out] == [D(2015, 1, 2), D(2015, 1, 2), D(2015, 1, 9)]


def test_resample_keeps_empty_weeks_and_last_value_per_column(spark):
    rows = [("k", D(2015, 1, 1), 1.0, 5.0), ("k", D(2015, 1, 2), 2.0, None), ("k", D(2015, 1, 13), 3.0, None)]
    df = spark.createDataFrame(rows, "k string, date date, a double, b double")
    out = [tuple(r) for r in resample_weekly(df, ["k"], ["a", "b"]).orderBy("week_end").select("week_end", "a", "b").collect()]
    assert out == [(D(2015, 1, 2), 2.0, 5.0), (D(2015, 1, 9), None, None), (D(2015, 1, 16), 3.0, None)]
    assert week_spine(df, ["k"]).count() == 3
    assert [r.week_end for r in week_ends(week_spine(df, ["k"]), "2015-01-05").orderBy("week_end").collect()] == [D(2015, 1, 9), D(2015, 1, 16)]


def test_rolling_needs_full_non_null_frames(spark):
    rows = [("k", i, None if i == 2 else float(i), float(i * i)) for i in range(8)]
    df = spark.createDataFrame(rows, "k string, t int, x double, y double")
    w = ordered(["k"], "t")
    out = df.select("t", rolling(F.avg, "x", 3, w).alias("m"), rolling_corr("x", "y", 3, w).alias("c")).toPandas().sort_values("t")
    pdf = pd.DataFrame(rows, columns=["k", "t", "x", "y"])
    np.testing.assert_allclose(out["m"].to_numpy(float), pdf.x.rolling(3).mean().to_numpy(), equal_nan=True)
    np.testing.assert_allclose(out["c"].to_numpy(float), pdf.x.rolling(3).corr(pdf.y).to_numpy(), equal_nan=True)
    with pytest.raises(ValueError):
        ordered([], "t")


def test_scalar_rules(spark):
    df = spark.createDataFrame([(1, float("nan"), 0.0), (2, -1.0, 2.0)], "i int, x double, y double")
    out = [tuple(r) for r in df.orderBy("i").select(
        null_if_nan("x"), ratio("x", "y"), safe_ln(null_if_nan("x")), clip(F.lit(12.0), -10, 10)).collect()]
    assert out[0][0] is None and out[0][1] is None
    assert [o[2:] for o in out] == [(None, 10.0), (None, 10.0)] and out[1][:2] == (-1.0, -0.5)
    flat = spark.createDataFrame([("k", 2.0), ("k", 2.0)], "k string, x double")
    assert {r[0] for r in flat.select(zscore("x", whole(["k"]))).collect()} == {0.0}


def test_market_features_match_pandas_on_the_union_calendar(spark):
    p = prices(spark, skip={("TLT", 40), ("SPY", 41), ("SPY", 70)})
    out = feat.market_features_daily(p).toPandas().sort_values("date").reset_index(drop=True)
    px = wide_pandas(p, "adj_close")
    r = np.log(px / px.shift(1))
    vol = np.log1p(wide_pandas(p, "volume"))
    expected = {
        "spy_ret_5d": np.log(px.SPY / px.SPY.shift(5)), "tlt_vol_5d": r.TLT.rolling(5).std(),
        "spy_drawdown_60d": px.SPY / px.SPY.rolling(60).max() - 1, "gld_vol_20d": r.GLD.rolling(20).std(),
        "gld_ma_gap_5_20": px.GLD.rolling(5).mean() / px.GLD.rolling(20).mean() - 1,
        "spy_volume_z_20": (vol.SPY - vol.SPY.rolling(20).mean()) / vol.SPY.rolling(20).std(),
        "qqq_spy_ratio_chg_5d": np.log(px.QQQ / px.SPY).diff(5), "vix_change_5d": px["^VIX"].diff(5),
        "spy_tlt_corr_20d": r.SPY.rolling(20).corr(r.TLT),
    }
    assert len(out) == 90 and len(out.columns) == 38
    for name, series in expected.items():
        np.testing.assert_allclose(out[name].to_numpy(float), series.to_numpy(), atol=1e-9, equal_nan=True, err_msg=name)


def test_weekly_targets_fill_before_returns_and_trade_dates_differ(spark):
    # Friday 2015-01-09 has no SPY row: the anchor's last trade day is Thursday
    p = prices(spark, n=30, skip={("SPY", 8), ("GLD", 9), ("GLD", 10), ("GLD", 11), ("GLD", 12), ("GLD", 13), ("GLD", 14), ("GLD", 15)})
    t = feat.weekly_targets(p).toPandas().sort_values("week_end").reset_index(drop=True)
    px = wide_pandas(p, "adj_close")
    px.index = pd.to_datetime(px.index)
    weekly = px[["SPY", "TLT", "GLD"]].resample("W-FRI").last()
    for s in ("SPY", "TLT", "GLD"):
        nxt = weekly[s].ffill().pct_change(fill_method=None).shift(-1)
        np.testing.assert_allclose(t[f"next_return_{s.lower()}"].to_numpy(float), nxt.to_numpy(), atol=1e-9, equal_nan=True)
    assert np.isnan(float(t.gld_weekly_close[2]))
    from weekpanel.operators.joins import dropped_weeks

    dropped = dropped_weeks(feat.market_features_weekly(p), feat.weekly_targets(p)).collect()
    assert [(r.week_end, r.anchor_date, r.union_date) for r in dropped] == [(D(2015, 1, 9), D(2015, 1, 8), D(2015, 1, 9))]


def test_densify_and_rebase(spark):
    df = spark.createDataFrame([("k", D(2015, 1, 1), "A", 2.0), ("k", D(2015, 1, 2), "B", 5.0), ("k", D(2015, 1, 2), "A", 3.0)],
                               "k string, date date, s string, adj_close double")
    dense = densify(df, ["k"], "s", ("A", "B"))
    out = {(r.s, r.date.day): r.rebased for r in feat.rebase(dense, ["k", "s"]).collect()}
    assert out == {("A", 1): 100.0, ("A", 2): 150.0, ("B", 1): None, ("B", 2): None}


def test_macro_registry_and_release_lags(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(5, 1, 16)
    values[3] = -1.0
    rows = [(D(2014 + i // 12, i % 12 + 1, 31 if i == 0 else 1), "M", float(v), "monthly") for i, v in enumerate(values)]
    panel = spark.createDataFrame(rows, "date date, series_id string, value double, frequency string")
    meta = feat.SeriesMeta("M", "c", "monthly", "d", ", ".join(feat.TRANSFORMS))
    out = feat.macro_transforms(panel, [meta]).toPandas().sort_values("date").reset_index(drop=True)
    v = pd.Series(values)
    twins = {
        "level": v, "log_level": np.log(v.where(v > 0)), "sign": np.sign(v), "chg_5d": v.diff(5), "chg_4w": v.diff(4),
        "chg_3m": v.diff(3), "pct_chg_5d": v.pct_change(5), "pct_chg_4w": v.pct_change(4), "yoy": v.pct_change(12),
        "mean_3m": v.rolling(3).mean(),
    }
    for name, series in twins.items():
        np.testing.assert_allclose(out[name].to_numpy(float), series.to_numpy(), atol=1e-12, equal_nan=True, err_msg=name)
    assert out.effective_date[0] == D(2014, 2, 28)  # clamps to the month end
    assert meta.feature_columns()["m_yoy"] == "12m pct change"
    assert feat.SeriesMeta("CPIAUCSL", "", "monthly", "", "").feature_columns() == {"cpi_level": "level"}
    with pytest.raises(ValueError):
        feat.SeriesMeta("M", "", "monthly", "", "cube").transforms()
    with pytest.raises(ValueError):
        feat.SeriesMeta("M", "", "hourly", "", "").check_frequency()
    bad = panel.withColumn("frequency", F.lit("hourly"))
    with pytest.raises(Exception, match="unsupported frequency"):
        feat.macro_transforms(bad, [meta]).collect()


@pytest.mark.parametrize("seed", [0, 1])
def test_asof_matches_merge_asof(spark, seed):
    rng = np.random.default_rng(seed)
    day = lambda n: D(2010, 1, 1) + dt.timedelta(days=int(n))
    left = sorted({(k, day(n)) for k in "ab" for n in rng.integers(0, 2000, 60)})
    right = sorted({(k, day(n)) for k in "ab" for n in rng.integers(300, 1200, 25)})
    right = [(k, t, None if i % 5 == 0 else float(i)) for i, (k, t) in enumerate(right)]
    left += [("z", day(5))]  # a key without right rows
    got = asof_backward(
        spark.createDataFrame(left, "k string, t date"), spark.createDataFrame(right, "k string, r date, v double"), ["k"], "t", "r", ["r", "v"]
    ).toPandas()
    lp = pd.DataFrame(left, columns=["k", "t"]).assign(t=lambda d: pd.to_datetime(d.t)).sort_values("t")
    rp = pd.DataFrame(right, columns=["k", "r", "v"]).assign(r=lambda d: pd.to_datetime(d.r)).sort_values("r")
    want = pd.merge_asof(lp, rp, left_on="t", right_on="r", by="k", direction="backward").sort_values(["k", "t"])
    got = got.assign(t=pd.to_datetime(got.t), r=pd.to_datetime(got.r)).sort_values(["k", "t"])
    np.testing.assert_array_equal(got.r.to_numpy("datetime64[D]"), want.r.to_numpy("datetime64[D]"))
    np.testing.assert_allclose(got.v.to_numpy(float), want.v.to_numpy(float), equal_nan=True)


def test_macro_weekly_keeps_a_null_nearest_row(spark):
    panel = spark.createDataFrame([(D(2015, 1, 1), "S", 1.0, "daily"), (D(2015, 1, 6), "S", None, "daily")],
                                  "date date, series_id string, value double, frequency string")
    weeks = spark.createDataFrame([("p", D(2015, 1, 2), D(2015, 1, 2)), ("p", D(2015, 1, 9), D(2015, 1, 9))],
                                  "panel string, week_end date, week_last_trade_date date")
    out = macro_features_weekly(panel, weeks, [feat.SeriesMeta("S", "", "daily", "", "level")]).orderBy("week_end").collect()
    assert [r.s_level for r in out] == [1.0, None]
