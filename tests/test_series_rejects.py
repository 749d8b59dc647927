"""Rejects beside accepted rows, series selections, trial ranking and macro features of several panels."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weekpanel.constants import SERIES_PRESETS
from weekpanel.operators import asof
from weekpanel.operators import backtest as bt
from weekpanel.operators.features import SeriesMeta
from weekpanel.sources import parsing, readers

METAS = [SeriesMeta("DFF", "rates", "daily", "d", "level, 5d change"), SeriesMeta("CPI", "prices", "monthly", "c", "level, 12m pct change")]


def test_rejects_and_accepted_rows_are_the_input(spark):
    rows = [(1, "DFF", "2020-01-03", "1.5"), (2, "DFF", "n/a", "1.0"), (3, "XX", "2020-01-03", " "), (4, None, None, "."), (5, "CPI", "2020-02-30", "2"), (6, "CPI", " 2020-02-28", "1e3"), (7, "DFF", "2020-01-04", None)]
    raw = spark.createDataFrame(rows, "loaded int, series_id string, date string, value string")
    tagged = parsing.tag_series(raw, METAS)
    bad = {(r.loaded, r.column): (r.reason, r.raw) for r in parsing.rejected(tagged, ["loaded"]).collect()}
    assert bad == {(2, "date"): ("unreadable", "n/a"), (3, "value"): ("missing", " "), (3, "series_id"): ("unknown", "XX"), (4, "series_id"): ("missing", None),
                   (4, "date"): ("missing", None), (4, "value"): ("unreadable", "."), (5, "date"): ("unreadable", "2020-02-30"), (7, "value"): ("missing", None)}
    good = {r.loaded for r in parsing.accepted(tagged).collect()}
    assert good == {1, 6} and good | {k for k, _ in bad} == {r[0] for r in rows}
    kept = parsing.with_series_metadata(raw, METAS, "src", "loaded").collect()
    assert {(r.series_id, r.value, r.category) for r in kept} == {("DFF", 1.5, "rates"), ("CPI", 1000.0, "prices")}


def test_presets(spark):
    panel = spark.createDataFrame([("DFF", 1), ("DGS30", 2), ("NONE", 3)], "series_id string, v int")
    assert {r.v for r in readers.select_series(panel, "compact").collect()} == {1}
    assert {r.v for r in readers.select_series(panel, "core_plus_duration").collect()} == {1, 2}
    with pytest.raises(ValueError, match="unknown preset"):
        readers.select_series(panel, "all")
    table = readers.series_table(spark, "extended").collect()
    assert [r.series_id for r in table] == sorted(SERIES_PRESETS["extended"])
    everything = {r.series_id for r in readers.series_table(spark).collect()}
    assert all(set(s) <= everything for s in SERIES_PRESETS.values())


def test_trials_rank_by_score(spark):
    rows = [(3, 1.0), (1, 2.0), (2, 2.0), (4, None), (5, float("nan"))]
    out = bt.rank_trials(spark.createDataFrame(rows, "trial int, val_reward double")).collect()
    assert [r.trial for r in out] == [1, 2, 3, 4, 5] and [r.is_best for r in out] == [True, False, False, False, False]
    assert bt.rank_trials(spark.createDataFrame([(1, None)], "trial int, val_reward double")).first().is_best is False


def test_two_panels_in_one_table_are_as_alone(spark):
    start = dt.date(2020, 1, 1)
    rows = [(p, start + dt.timedelta(days=i * (1 + p.count("b"))), "DFF", float(i * i % 17 + len(p)), "daily") for p in ("a", "bb") for i in range(60)]
    rows += [(p, dt.date(2020, m, 1), "CPI", float(m + len(p)), "monthly") for p in ("a", "bb") for m in range(1, 6)]
    both = spark.createDataFrame(rows, "panel string, date date, series_id string, value double, frequency string")
    weeks = spark.createDataFrame([(p, start + dt.timedelta(weeks=w, days=2), start + dt.timedelta(weeks=w)) for p in ("a", "bb") for w in range(20)], "panel string, week_end date, week_last_trade_date date")
    together = sorted(map(tuple, asof.macro_features_weekly(both, weeks, METAS).collect()), key=repr)
    alone = []
    for p in ("a", "bb"):
        alone += map(tuple, asof.macro_features_weekly(both.where(F.col("panel") == p).drop("panel"), weeks.where(F.col("panel") == p), METAS).collect())
    assert together == sorted(alone, key=repr)
