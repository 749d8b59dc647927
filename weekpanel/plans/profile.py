"""Data-profiling queries on line items, weekly features and the supplier panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekpanel.operators import features as feat
from weekpanel.operators import stats as st
from weekpanel.plans.market import bars, rounded
from weekpanel.plans.sequences import MEASURES, TRAIN_END, panel
from weekpanel.session import cut_lineage
from weekpanel.sources import given

LINE_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return given.table(spark, d, "lineitem").select(*LINE_COLUMNS, "l_returnflag", "l_shipdate", "l_suppkey")


def percentiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.exact_percentiles(lines(spark, d), LINE_COLUMNS, (0.01, 0.25, 0.5, 0.75, 0.99)))


def profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.describe(lines(spark, d), LINE_COLUMNS, ["l_returnflag"]))


def moments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.moments(panel(spark, d), MEASURES, ["state"]))


def iqr_outliers(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.iqr_outliers(cut_lineage(panel(spark, d)), MEASURES))


def box_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.box_stats(cut_lineage(panel(spark, d)), MEASURES, ["state"]))


def missingness(spark: SparkSession, d: str) -> DataFrame:
    market = feat.market_features_weekly(bars(spark, d))
    return rounded(st.missingness(market, feat.market_feature_names()))


def duplicate_rows(spark: SparkSession, d: str) -> DataFrame:
    return st.duplicate_rows(lines(spark, d).select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_suppkey"))


def corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.correlation_matrix(lines(spark, d), LINE_COLUMNS, ["l_returnflag"]))


def corr_pairs(spark: SparkSession, d: str) -> DataFrame:
    market = feat.market_features_weekly(bars(spark, d))
    return rounded(st.high_correlations(market, feat.market_feature_names(), threshold=0.8))


def histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.histogram(lines(spark, d), LINE_COLUMNS))


def acf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.autocorrelation(panel(spark, d), ["entity"], "avg_price", "week_end"))


def acf_filter(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.lag_one(panel(spark, d), ["entity"], MEASURES, "week_end"))


def standardize(spark: SparkSession, d: str) -> DataFrame:
    fit = F.col("week_end") <= F.lit(TRAIN_END).cast("date")
    return rounded(st.standardize(panel(spark, d).select("entity", "week_end", *MEASURES), MEASURES, fit))


def scaling_checks(spark: SparkSession, d: str) -> DataFrame:
    fit = F.col("week_end") <= F.lit(TRAIN_END).cast("date")
    scaled = st.standardize(panel(spark, d).select("entity", "week_end", *MEASURES), MEASURES, fit, None)
    return rounded(st.scaling_checks(scaled.filter(fit), MEASURES))


def min_max_scaled(spark: SparkSession, d: str) -> DataFrame:
    scaled = st.min_max(panel(spark, d).select("entity", "week_end", "avg_price"), "avg_price", ["entity"])
    return rounded(scaled.drop("avg_price"))


def cumulative_returns(spark: SparkSession, d: str) -> DataFrame:
    market = feat.market_features_weekly(bars(spark, d))
    long = market.unpivot(["panel", "week_end"], ["spy_ret_20d", "tlt_ret_20d", "gld_ret_20d"], "feature", "value")
    return rounded(st.cumulative(long, ["panel", "feature"], "value", "week_end"))


QUERIES = {
    f.__name__: f
    for f in (
        percentiles, profile, moments, iqr_outliers, box_stats, missingness, duplicate_rows, corr_matrix, corr_pairs,
        histogram, acf, acf_filter, standardize, scaling_checks, min_max_scaled, cumulative_returns,
    )
}
