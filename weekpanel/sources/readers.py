"""Readers with explicit schemas, input checks and fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekpanel import schemas
from weekpanel.constants import MACRO_SERIES, REQUIRED_TICKERS, SERIES_PRESETS
from weekpanel.functions.semantics import null_if_nan
from weekpanel.operators.joins import missing_members


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_table(spark: SparkSession, path: str, schema: str, fmt: str | None = None) -> DataFrame:
    """CSV (with header), JSON or parquet by suffix; NaN becomes NULL."""
    fmt = fmt or ("csv" if path.endswith(".csv") else "json" if path.endswith(".json") else "parquet")
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    df = reader.format(fmt).load(path)
    return df.select(*[null_if_nan(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def load_prices(spark: SparkSession, path: str, required: Sequence[str] = REQUIRED_TICKERS) -> DataFrame:
    """Long price table; a required ticker without rows is an error."""
    prices = read_table(spark, path, schemas.PRICE_DAILY)
    wanted = spark.createDataFrame([(s,) for s in required], "symbol string")
    missing = sorted(r.symbol for r in missing_members(prices, "symbol", wanted).collect())
    if missing:
        raise ValueError(f"missing required symbols: {missing}")
    return prices


def load_macro(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.MACRO_PANEL)


def load_news_or_empty(spark: SparkSession, path: str) -> DataFrame:
    """Optional input: a typed, empty table where the path does not exist."""
    if exists(spark, path):
        return read_table(spark, path, schemas.NEWS_EVENTS)
    return spark.createDataFrame([], schemas.NEWS_EVENTS)


def load_scored_news(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.NEWS_SCORED).withColumn("asset", F.upper("asset"))


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {list(paths)} exists")


def strip_headers(df: DataFrame, required: str = "week_end") -> DataFrame:
    """Trim column names when the required column is missing because of blanks."""
    if required in df.columns:
        return df
    cleaned = df.toDF(*[c.strip() for c in df.columns])
    if required not in cleaned.columns:
        raise ValueError(f"column {required} not found")
    return cleaned


def preset_series(preset: str) -> tuple[str, ...]:
    """Series ids of a named selection; unknown names fail."""
    if preset not in SERIES_PRESETS:
        raise ValueError(f"unknown preset {preset}; there are {', '.join(sorted(SERIES_PRESETS))}")
    return SERIES_PRESETS[preset]


def select_series(panel: DataFrame, preset: str) -> DataFrame:
    """Rows of the series of a named selection."""
    return panel.filter(F.col("series_id").isin(*preset_series(preset)))


def series_table(spark: SparkSession, preset: str | None = None) -> DataFrame:
    """One row per series (of a selection): id, category, frequency, description, suggested transform; sorted by id."""
    wanted = preset_series(preset) if preset else None
    rows = [r for r in MACRO_SERIES if wanted is None or r[0] in wanted]
    return spark.createDataFrame(rows, schemas.SERIES_META).orderBy("series_id")


def normalize_price_history(history: DataFrame, symbol: str, source: str) -> DataFrame:
    """One ticker's history in the long layout (names, zone-less date, tags)."""
    names = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Adj Close": "adj_close", "Volume": "volume"}
    return history.select(
        F.col("Date").cast("date").alias("date"), F.lit(symbol).alias("symbol"),
        *[F.col(f"`{a}`").cast("double").alias(b) for a, b in names.items()], F.lit(source).alias("source"),
    )
