"""Weekly-panel inputs derived from the given relational tables.

Every view reads its whole table.  Price and macro views are aggregated to one
row per calendar date before anything is ordered by time, so later windows are
bounded by the calendar and not by the size of the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekpanel.operators.calendar import week_end
from weekpanel.operators.features import SeriesMeta

PANEL_NAME = "core"

# Split boundaries of the given calendar (1995-01 .. 2001-11).
SPLITS = (("warmup", "1995-06-30"), ("train", "1999-12-31"), ("validation", "2000-12-29"))
GAPPED_SPLITS = (
    ("warmup", "1995-01-02", "1995-06-30"),
    ("train", "1995-07-01", "1999-12-31"),
    ("validation", "2000-01-10", "2000-12-29"),
    ("locked_test", "2001-01-03", "2001-11-30"),
)

SERIES = (
    SeriesMeta("DFF", "rates", "daily", "policy rate", "level, 5d change"),
    SeriesMeta("T10Y3M", "rates", "daily", "curve slope", "level, sign, 5d pct change"),
    SeriesMeta("NFCI", "conditions", "weekly", "conditions index", "level, 4w change, 4w pct change"),
    SeriesMeta("CPIAUCSL", "prices", "monthly", "price index", "level, 12m pct change, 3m average"),
    SeriesMeta("UNRATE", "labour", "monthly", "unemployment", "level, log level, 3m change"),
)
# market segment -> (series, offset, scale): value = offset + avg(total price) / scale
SEGMENT_SERIES = {
    "AUTOMOBILE": ("DFF", 0.0, 97000.0),
    "BUILDING": ("T10Y3M", -2.5, 97000.0),
    "FURNITURE": ("NFCI", -2.0, 97000.0),
    "HOUSEHOLD": ("CPIAUCSL", 100.0, 48700.0),
    "MACHINERY": ("UNRATE", 0.0, 48700.0),
}
# symbol -> (offset, scale): price = offset + scale * ln(unit price)
PRICE_SCALE = {
    "SPY": (100.0, 2.0), "TLT": (100.0, 2.0), "GLD": (100.0, 2.0),
    "QQQ": (100.0, 3.0), "^VIX": (0.0, 3.0), "^TNX": (0.0, 0.5),
}
FLAG_SYMBOL = {"A": "SPY", "N": "TLT", "R": "GLD"}
STATUS_SYMBOL = {"F": "QQQ", "O": "^VIX"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choose(c: Column, mapping: dict, default=None) -> Column:
    expr = F.lit(default)
    for key, value in reversed(mapping.items()):
        expr = F.when(c == key, F.lit(value)).otherwise(expr)
    return expr


def _trade_key() -> Column:
    """Total order of the lines of one day (line key, then amount in cents)."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1048576 + cents % 1048576


def price_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per symbol from the line items.

    The first aggregation runs on the scan's own partitions and leaves at most
    six rows per date, so only calendar-sized data is shuffled and expanded.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("date"), "l_returnflag", "l_linestatus",
        _trade_key().alias("k"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"),
        F.col("l_quantity").alias("q"),
    )
    bars = lines.groupBy("date", "l_returnflag", "l_linestatus").agg(
        F.min("k").alias("k0"), F.min_by("p", "k").alias("open"),
        F.max("k").alias("k1"), F.max_by("p", "k").alias("close"),
        F.max("p").alias("high"), F.min("p").alias("low"), F.sum("q").alias("volume"),
    )
    symbols = F.array(
        choose(F.col("l_returnflag"), FLAG_SYMBOL), choose(F.col("l_linestatus"), STATUS_SYMBOL), F.lit("^TNX")
    )
    merged = (
        bars.withColumn("symbol", F.explode(symbols))
        .groupBy("date", "symbol")
        .agg(
            F.min_by("open", "k0").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", "k1").alias("close"), F.sum("volume").alias("volume"),
        )
    )
    offset = choose(F.col("symbol"), {s: o for s, (o, _) in PRICE_SCALE.items()})
    scale = choose(F.col("symbol"), {s: m for s, (_, m) in PRICE_SCALE.items()})
    level = {c: offset + scale * F.ln(c) for c in ("open", "high", "low", "close")}
    return merged.select(
        F.lit(PANEL_NAME).alias("panel"), "date", "symbol",
        *[e.alias(c) for c, e in level.items()], level["close"].alias("adj_close"), "volume",
        F.lit("line_items").alias("source"),
    )


def macro_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro series from orders: one observation per series and period.

    Orders are pre-aggregated per customer and day before the join, so a very
    large customer reaches it as one row per day.
    """
    orders = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("day"))
        .agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"), F.count("*").alias("n"))
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    segment = F.col("c_mktsegment")
    series = choose(segment, {k: v[0] for k, v in SEGMENT_SERIES.items()})
    frequency = choose(F.col("series_id"), {m.series_id: m.frequency for m in SERIES})
    period = (
        F.when(F.col("frequency") == "weekly", week_end("day"))
        .when(F.col("frequency") == "monthly", F.trunc("day", "MM"))
        .otherwise(F.col("day"))
    )
    observed = (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .withColumn("series_id", series)
        .withColumn("frequency", frequency)
        .groupBy("series_id", "c_mktsegment", "frequency", period.alias("date"))
        .agg((F.sum("cents") / F.sum("n") / 100).alias("mean_price"))
    )
    offset = choose(segment, {k: v[1] for k, v in SEGMENT_SERIES.items()})
    scale = choose(segment, {k: v[2] for k, v in SEGMENT_SERIES.items()})
    return observed.select(
        "date", "series_id", (offset + F.col("mean_price") / scale).alias("value"),
        choose(F.col("series_id"), {m.series_id: m.category for m in SERIES}).alias("category"),
        "frequency",
        choose(F.col("series_id"), {m.series_id: m.description for m in SERIES}).alias("description"),
        choose(F.col("series_id"), {m.series_id: m.suggested_transform for m in SERIES}).alias("suggested_transform"),
        F.lit("orders").alias("source"),
    )


HEADLINES = (
    "Fed signals higher rates as inflation worries grow",
    "SPY rally: strong earnings beat guidance",
    "Oil drops as slowdown and recession fear spread",
    "Treasury yield falls on weak demand",
    "China tariff threat and election policy risk",
    "Gold coast restaurant opens",
    "S&amp;P 500 stocks rebound &amp; gains in stock market",
    "Volatility selloff: hedge flows and momentum",
    "Warning signs for the box office",
    "<b>Gold prices</b> rise on spot gold buying - Src7",
    "Bond market and interest rates steady",
    "Jobless claims rise, layoffs slump",
    "Profit gain, loss cut",
    "VIX fear gauge calm, market volatility low",
    "Nothing to report",
    "",
)
SYMBOL_CYCLE = ("SPY", "TLT", "GLD", "QQQ")
RELATED_CYCLE = ("SPY, TLT", "AAPL,MSFT", "qqq", "", "GLD,XOM")


def pick(values: tuple[str, ...], position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (position % len(values) + 1).cast("int"))


def news_day(doc_id: Column) -> Column:
    return F.date_add(F.lit("1995-01-02").cast("date"), ((doc_id * 37) % 2400).cast("int"))


def news_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat news events: one per document, its whole text as the summary."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        pick(SYMBOL_CYCLE, d).alias("requested_symbol"),
        d.alias("news_id"),
        F.lit("STORY").alias("content_type"),
        pick(HEADLINES, d).alias("title"),
        F.col("text").alias("summary"),
        news_day(d).cast("timestamp").alias("published_at"),
        F.col("source").alias("publisher"),
        F.concat(F.lit("https://news.example.com/"), F.col("lang"), F.lit("/"), d.cast("string")).alias("canonical_url"),
        F.lit(None).cast("string").alias("click_url"),
        pick(RELATED_CYCLE, d).alias("related_tickers"),
        (d % 3 == 0).cast("int").alias("query_relevance_heuristic"),
    )


def supplier_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier and trading week: the multi-entity weekly panel."""
    lines = table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_discount") * 100).cast("bigint")
    return (
        lines.groupBy(F.col("l_suppkey").alias("entity"), week_end(F.col("l_shipdate").cast("date")).alias("week_end"))
        .agg(
            F.count("*").alias("n_lines"),
            F.sum(cents).alias("discount_points"),
            F.sum(F.round(F.col("l_quantity")).cast("bigint")).alias("quantity"),
            F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("revenue_cents"),
            *[
                F.sum(F.when(F.col("l_returnflag") == flag, F.round(F.col("l_quantity")).cast("bigint")).otherwise(0))
                .alias(f"qty_{symbol.lower()}")
                for flag, symbol in FLAG_SYMBOL.items()
            ],
        )
        .select(
            "*",
            # three states by mean discount, decided on exact integers
            F.when(F.col("discount_points") < 4 * F.col("n_lines"), 0)
            .when(F.col("discount_points") < 6 * F.col("n_lines"), 1)
            .otherwise(2)
            .alias("state"),
        )
    )
