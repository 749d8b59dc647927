"""Market features, weekly targets and the macro transform registry."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from weekpanel.constants import (
    CONTEXT_TICKERS,
    RELEASE_LAG_DAYS,
    RELEASE_LAG_MONTHS,
    REQUIRED_TICKERS,
    SERIES_PREFIX_ALIASES,
    TRACKED_ASSETS,
)
from weekpanel.functions.semantics import (
    change,
    forward_fill,
    log_change,
    ordered,
    pct_change,
    ratio,
    rolling,
    rolling_corr,
    safe_ln,
    so_far,
)
from weekpanel.operators.calendar import resample_weekly, week_end

PANEL = ("panel",)


def ticker_prefix(symbol: str) -> str:
    return symbol.lstrip("^").lower()


def pivot_prices(
    prices: DataFrame,
    columns: Sequence[str] = ("adj_close",),
    keys: Sequence[str] = PANEL,
    symbols: Sequence[str] = REQUIRED_TICKERS,
) -> DataFrame:
    """One row per date of the union calendar, one column per symbol and field.

    Conditional aggregates need one map-side combined shuffle on the date.
    """
    picks = [
        F.max(F.when(F.col("symbol") == s, F.col(c))).alias(f"{ticker_prefix(s)}_{c}")
        for s in symbols
        for c in columns
    ]
    return prices.groupBy(*keys, "date").agg(*picks)


def _asset_features(p: str, w: WindowSpec) -> dict[str, Column]:
    px, r = f"{p}_adj_close", f"{p}_ret_1d"
    lv = f"{p}_log_volume"
    return {
        f"{p}_ret_5d": log_change(px, 5, w),
        f"{p}_ret_20d": log_change(px, 20, w),
        f"{p}_vol_5d": rolling(F.stddev_samp, r, 5, w),
        f"{p}_vol_20d": rolling(F.stddev_samp, r, 20, w),
        f"{p}_drawdown_60d": ratio(px, rolling(F.max, px, 60, w)) - 1,
        f"{p}_ma_gap_5_20": ratio(rolling(F.avg, px, 5, w), rolling(F.avg, px, 20, w)) - 1,
        f"{p}_intraday_range": ratio(F.col(f"{p}_high") - F.col(f"{p}_low"), f"{p}_close"),
        f"{p}_volume_z_20": ratio(
            F.col(lv) - rolling(F.avg, lv, 20, w), rolling(F.stddev_samp, lv, 20, w)
        ),
    }


def market_feature_names() -> list[str]:
    per_asset = (
        "ret_1d", "ret_5d", "ret_20d", "vol_5d", "vol_20d",
        "drawdown_60d", "ma_gap_5_20", "intraday_range", "volume_z_20",
    )
    names = [f"{ticker_prefix(a)}_{f}" for a in TRACKED_ASSETS for f in per_asset]
    return names + [
        "qqq_spy_log_ratio", "qqq_spy_ratio_chg_5d", "spy_tlt_corr_20d", "spy_gld_corr_20d",
        "vix_level", "vix_change_5d", "tnx_level", "tnx_change_5d",
    ]


def market_features_daily(prices: DataFrame, keys: Sequence[str] = PANEL) -> DataFrame:
    """Daily features on the union calendar of all tickers of a panel.

    All windows share one partitioning and order, so the plan holds one
    exchange and one sort after the pivot.
    """
    w = ordered(keys, "date")
    wide = pivot_prices(prices, ("adj_close", "close", "high", "low", "volume"), keys)
    prefixes = [ticker_prefix(a) for a in TRACKED_ASSETS]
    base = wide.withColumns(
        {f"{p}_ret_1d": log_change(f"{p}_adj_close", 1, w) for p in prefixes}
        | {f"{p}_log_volume": F.log1p(f"{p}_volume") for p in prefixes}
        | {"qqq_spy_log_ratio": safe_ln(ratio("qqq_adj_close", "spy_adj_close"))}
    )
    features: dict[str, Column] = {}
    for p in prefixes:
        features |= _asset_features(p, w)
    features |= {
        "qqq_spy_ratio_chg_5d": change("qqq_spy_log_ratio", 5, w),
        "spy_tlt_corr_20d": rolling_corr("spy_ret_1d", "tlt_ret_1d", 20, w),
        "spy_gld_corr_20d": rolling_corr("spy_ret_1d", "gld_ret_1d", 20, w),
    }
    for ticker in CONTEXT_TICKERS[1:]:
        p = ticker_prefix(ticker)
        features[f"{p}_level"] = F.col(f"{p}_adj_close")
        features[f"{p}_change_5d"] = change(f"{p}_adj_close", 5, w)
    return base.withColumns(features).select(
        *keys, "date", *market_feature_names(), F.lit("derived_from_prices_daily").alias("source")
    )


def anchor_trade_dates(prices: DataFrame, keys: Sequence[str] = PANEL, anchor: str = "SPY") -> DataFrame:
    """Last date per week on which the anchor symbol itself has a row."""
    return (
        prices.filter(F.col("symbol") == anchor)
        .groupBy(*keys, week_end("date").alias("week_end"))
        .agg(F.max("date").alias("week_last_trade_date"))
    )


def market_features_weekly(prices: DataFrame, keys: Sequence[str] = PANEL) -> DataFrame:
    weekly = resample_weekly(market_features_daily(prices, keys), keys, market_feature_names())
    return weekly.join(anchor_trade_dates(prices, keys), [*keys, "week_end"], "left").select(
        *keys, "week_end", *market_feature_names(), "week_last_trade_date",
        F.lit("resampled_from_market_features_daily").alias("source"),
    )


def weekly_targets(prices: DataFrame, keys: Sequence[str] = PANEL) -> DataFrame:
    """Weekly closes and the next week's simple return of each tracked asset.

    Here the last trade date is the last date of the union calendar, and the
    return is taken over forward-filled closes.
    """
    prefixes = [ticker_prefix(a) for a in TRACKED_ASSETS]
    wide = pivot_prices(prices, ("adj_close",), keys)
    weekly = resample_weekly(
        wide, keys, [f"{p}_adj_close" for p in prefixes],
        extra=[F.max("date").alias("week_last_trade_date")],
    )
    w = ordered(keys, "week_end")
    filled = weekly.withColumns({f"_{p}": forward_fill(f"{p}_adj_close", w) for p in prefixes})
    returns = filled.withColumns({f"_{p}_ret": pct_change(f"_{p}", 1, w) for p in prefixes})
    return returns.select(
        *keys,
        "week_end",
        *[F.col(f"{p}_adj_close").alias(f"{p}_weekly_close") for p in prefixes],
        "week_last_trade_date",
        *[F.lead(f"_{p}_ret").over(w).alias(f"next_return_{p}") for p in prefixes],
        F.lit("resampled_from_prices_daily").alias("source"),
    )


def rebase(prices: DataFrame, keys: Sequence[str], value: str = "adj_close", base: float = 100.0) -> DataFrame:
    """Each series relative to its value on the first date of its calendar."""
    w = ordered(keys, "date")
    return prices.withColumn("rebased", ratio(value, F.first(value).over(so_far(w))) * base)


# ---------------------------------------------------------------------------
# macro series


@dataclass(frozen=True)
class SeriesMeta:
    series_id: str
    category: str
    frequency: str
    description: str
    suggested_transform: str

    @property
    def prefix(self) -> str:
        return SERIES_PREFIX_ALIASES.get(self.series_id, self.series_id.lower())

    def transforms(self) -> list[str]:
        parts = [p.strip().lower() for p in (self.suggested_transform or "").split(",")]
        names = [p for p in parts if p] or ["level"]
        unknown = [n for n in names if n not in TRANSFORMS]
        if unknown:
            raise ValueError(f"unsupported transform {unknown} for series {self.series_id}")
        return names

    def check_frequency(self) -> str:
        freq = self.frequency.strip().lower()
        if freq not in RELEASE_LAG_DAYS and freq not in RELEASE_LAG_MONTHS:
            raise ValueError(f"unsupported frequency {self.frequency}")
        return freq

    def feature_columns(self) -> dict[str, str]:
        """output column name -> transform name"""
        return {f"{self.prefix}_{TRANSFORMS[t][0]}": t for t in self.transforms()}


# transform name -> (column suffix, builder over (value, series window))
TRANSFORMS: dict[str, tuple[str, Callable[[Column, WindowSpec], Column]]] = {
    "level": ("level", lambda v, w: v),
    "log level": ("log_level", lambda v, w: safe_ln(v)),
    "sign": ("sign", lambda v, w: F.signum(v)),
    "5d change": ("chg_5d", lambda v, w: change(v, 5, w)),
    "4w change": ("chg_4w", lambda v, w: change(v, 4, w)),
    "3m change": ("chg_3m", lambda v, w: change(v, 3, w)),
    "5d pct change": ("pct_chg_5d", lambda v, w: pct_change(v, 5, w)),
    "4w pct change": ("pct_chg_4w", lambda v, w: pct_change(v, 4, w)),
    "12m pct change": ("yoy", lambda v, w: pct_change(v, 12, w)),
    "3m average": ("mean_3m", lambda v, w: rolling(F.avg, v, 3, w)),
}


def effective_date(date: Column, frequency: Column) -> Column:
    """Observation date shifted by the release lag; months clamp at month end."""
    expr = F.raise_error(F.concat(F.lit("unsupported frequency "), frequency)).cast("date")
    for name, days in RELEASE_LAG_DAYS.items():
        expr = F.when(frequency == name, F.date_add(date, days)).otherwise(expr)
    for name, months in RELEASE_LAG_MONTHS.items():
        expr = F.when(frequency == name, F.add_months(date, months)).otherwise(expr)
    return expr


def transform_columns(metas: Sequence[SeriesMeta]) -> list[str]:
    used = {t for m in metas for t in m.transforms()}
    return [t for t in TRANSFORMS if t in used]


def macro_transforms(panel: DataFrame, metas: Sequence[SeriesMeta], keys: Sequence[str] = ()) -> DataFrame:
    """Each series with every transform any series asks for, and its release date."""
    w = ordered([*keys, "series_id"], "date")
    value = F.col("value")
    built = {TRANSFORMS[t][0]: TRANSFORMS[t][1](value, w) for t in transform_columns(metas)}
    return panel.select(
        *keys, "series_id", "date", "frequency",
        effective_date(F.col("date"), F.lower(F.trim("frequency"))).alias("effective_date"),
        *[c.alias(n) for n, c in built.items()],
    )


def macro_features_long(panel: DataFrame, metas: Sequence[SeriesMeta], keys: Sequence[str] = ()) -> DataFrame:
    """Only the transforms suggested for each series, as (feature, value) rows."""
    wide = macro_transforms(panel, metas, keys)
    branches = []
    for m in metas:
        pairs = [
            F.struct(F.lit(name).alias("feature"), F.col(TRANSFORMS[t][0]).cast("double").alias("value"))
            for name, t in m.feature_columns().items()
        ]
        branches.append((m.series_id, F.array(*pairs)))
    picked = F.when(F.col("series_id") == branches[0][0], branches[0][1])
    for series_id, pairs in branches[1:]:
        picked = picked.when(F.col("series_id") == series_id, pairs)
    return wide.select(*keys, "series_id", "date", "effective_date", F.inline(picked))
