"""Market, macro and model-state queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekpanel.functions.semantics import forward_fill, ordered, r6, so_far
from weekpanel.operators import features as feat
from weekpanel.operators import joins
from weekpanel.operators.asof import macro_features_weekly as macro_weekly
from weekpanel.operators.calendar import densify, week_end, week_ends
from weekpanel.session import cut_lineage
from weekpanel.sources import given
from weekpanel.sources.manifest import manifest


def rounded(df: DataFrame) -> DataFrame:
    """Every floating column rounded to six places, the rest unchanged."""
    return df.select(*[r6(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def bars(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars, materialised: calendar-sized, so the line items are scanned
    and aggregated once however many feature tables are built on them."""
    return cut_lineage(given.price_daily(spark, d))


def price_daily(spark: SparkSession, d: str) -> DataFrame:
    return rounded(given.price_daily(spark, d))


def macro_panel(spark: SparkSession, d: str) -> DataFrame:
    return rounded(given.macro_panel(spark, d))


def market_features_daily(spark: SparkSession, d: str) -> DataFrame:
    return rounded(feat.market_features_daily(bars(spark, d)))


def market_features_weekly(spark: SparkSession, d: str) -> DataFrame:
    return rounded(feat.market_features_weekly(bars(spark, d)))


def weekly_targets(spark: SparkSession, d: str) -> DataFrame:
    return rounded(feat.weekly_targets(bars(spark, d)))


def rebased_prices(spark: SparkSession, d: str) -> DataFrame:
    prices = bars(spark, d).filter(F.col("symbol").isin("SPY", "TLT", "GLD"))
    dense = densify(
        prices.select("panel", "date", "symbol", "adj_close"), ["panel"], "symbol", ("SPY", "TLT", "GLD")
    )
    out = feat.rebase(dense, ["panel", "symbol"])
    return rounded(out.select("date", "symbol", "adj_close", "rebased"))


def macro_transforms(spark: SparkSession, d: str) -> DataFrame:
    return rounded(feat.macro_features_long(given.macro_panel(spark, d), given.SERIES))


def weekly_calendar(prices: DataFrame) -> DataFrame:
    """The weekly calendar of the market table (needs no features)."""
    bounds = prices.groupBy("panel").agg(F.min(week_end("date")).alias("lo"), F.max(week_end("date")).alias("hi"))
    weeks = bounds.select("panel", F.explode(F.expr("sequence(lo, hi, interval 7 days)")).alias("week_end"))
    return weeks.join(feat.anchor_trade_dates(prices), ["panel", "week_end"], "left")


def macro_features_weekly(spark: SparkSession, d: str) -> DataFrame:
    calendar = weekly_calendar(bars(spark, d))
    return rounded(macro_weekly(cut_lineage(given.macro_panel(spark, d)), calendar, given.SERIES))


def state(spark: SparkSession, d: str) -> DataFrame:
    prices = bars(spark, d)
    macro = macro_weekly(cut_lineage(given.macro_panel(spark, d)), weekly_calendar(prices), given.SERIES)
    return joins.model_state(feat.market_features_weekly(prices), macro, feat.weekly_targets(prices))


def model_state(spark: SparkSession, d: str) -> DataFrame:
    return rounded(state(spark, d))


def dropped_weeks(spark: SparkSession, d: str) -> DataFrame:
    prices = bars(spark, d)
    return joins.dropped_weeks(feat.market_features_weekly(prices), feat.weekly_targets(prices))


def dataset_manifest(spark: SparkSession, d: str) -> DataFrame:
    prices = bars(spark, d)
    return manifest(
        {
            "market_features_weekly": feat.market_features_weekly(prices),
            "macro_panel": given.macro_panel(spark, d),
            "weekly_asset_targets": feat.weekly_targets(prices),
            "price_daily": prices,
        }
    )


def series_summary(spark: SparkSession, d: str) -> DataFrame:
    return (
        given.macro_panel(spark, d)
        .groupBy("series_id")
        .agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"), F.count("*").alias("n_rows"))
    )


def source_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage timeline: prices, macro by frequency, news."""
    prices = bars(spark, d).select(F.lit("Price Data").alias("label"), "date")
    macro = given.macro_panel(spark, d).select(
        F.concat(F.initcap("frequency"), F.lit(" Macro")).alias("label"), "date"
    )
    news = given.news_events(spark, d).select(
        F.lit("News Snapshot").alias("label"), F.col("published_at").cast("date").alias("date")
    )
    return (
        joins.stack_rows([prices, macro, news])
        .groupBy("label")
        .agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"))
    )


def week_calendar(spark: SparkSession, d: str) -> DataFrame:
    lines = given.table(spark, d, "lineitem").select(week_end(F.col("l_shipdate").cast("date")).alias("week_end"))
    return week_ends(lines, "1996-01-01", "2000-12-31")


def forward_filled(spark: SparkSession, d: str) -> DataFrame:
    """Dense symbol calendar: forward fill, presence counts, running sum of nulls."""
    dense = densify(
        bars(spark, d).select("panel", "date", "symbol", "adj_close"),
        ["panel"], "symbol", tuple(given.PRICE_SCALE),
    )
    w = ordered(["panel", "symbol"], "date")
    return rounded(
        dense.select(
            "symbol", "date", forward_fill("adj_close", w).alias("filled"),
            F.count_if(F.col("adj_close").isNull()).over(so_far(w)).alias("missing_so_far"),
        )
    )


def trade_calendar_intersection(spark: SparkSession, d: str) -> DataFrame:
    prices = bars(spark, d)
    per_symbol = [prices.filter(F.col("symbol") == s).select("date") for s in ("SPY", "TLT", "GLD")]
    return joins.common_keys(per_symbol, "date")


def missing_tickers(spark: SparkSession, d: str) -> DataFrame:
    """Required tickers without a single bar; the list adds one that never trades."""
    required = spark.createDataFrame([(s,) for s in (*given.PRICE_SCALE, "DIA")], "symbol string")
    return joins.missing_members(bars(spark, d), "symbol", required)


QUERIES = {
    f.__name__: f
    for f in (
        price_daily, macro_panel, market_features_daily, market_features_weekly, weekly_targets,
        rebased_prices, macro_transforms, macro_features_weekly, model_state, dropped_weeks,
        dataset_manifest, series_summary, source_coverage, week_calendar, forward_filled,
        trade_calendar_intersection, missing_tickers,
    )
}
