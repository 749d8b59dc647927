"""Ingestion and parsing queries over raw text built from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekpanel.constants import SERIES_PRESETS
from weekpanel.functions import text as tx
from weekpanel.operators import joins
from weekpanel.plans.market import rounded
from weekpanel.plans.news import articles
from weekpanel.session import cut_lineage
from weekpanel.sources import given, parsing, readers

PRIORITY_SERIES = {
    "1-URGENT": "DFF", "2-HIGH": "T10Y3M", "3-MEDIUM": "NFCI", "4-NOT SPECIFIED": "CPIAUCSL", "5-LOW": "UNRATE",
}


def order_series() -> Column:
    return given.choose(F.col("o_orderpriority"), PRIORITY_SERIES)


def raw_observations(spark: SparkSession, d: str) -> DataFrame:
    """Observations as strings; pending orders of each priority hold another kind of unusable value."""
    pending, priority = F.col("o_orderstatus") == "P", F.col("o_orderpriority")
    day = F.col("o_orderdate").cast("date").cast("string")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return given.table(spark, d, "orders").select(
        F.when(pending & (priority == "4-NOT SPECIFIED"), "XRATE").otherwise(order_series()).alias("series_id"),
        F.col("o_orderkey").alias("loaded"),
        F.when(pending & priority.isin("1-URGENT", "5-LOW"), "n/a").otherwise(day).alias("date"),
        F.when(pending & priority.isin("2-HIGH", "5-LOW"), ".").when(pending & (priority == "3-MEDIUM"), " ").otherwise(price).alias("value"))


def series_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """Raw observations as strings; later orders correct earlier ones."""
    return rounded(parsing.with_series_metadata(raw_observations(spark, d), given.SERIES, "raw_orders", "loaded"))


def series_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Every value that the cleaning cannot use, with the reason."""
    return parsing.rejected(parsing.tag_series(raw_observations(spark, d), given.SERIES), ["loaded"])


def source_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Three sources; each series comes whole from the first that has it."""
    orders = given.table(spark, d, "orders").select(
        order_series().alias("series_id"), "o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("value")
    )
    first = orders.filter((F.col("o_orderstatus") == "F") & F.col("series_id").isin("DFF", "NFCI"))
    second = orders.filter((F.col("o_orderstatus") == "O") & F.col("series_id").isin("DFF", "T10Y3M", "UNRATE"))
    third = orders.filter(F.col("o_orderstatus") == "P")
    named = [f.withColumn("source", F.lit(n)) for n, f in (("primary", first), ("mirror", second), ("archive", third))]
    return joins.first_source(named, "series_id")


def upsert_rows(spark: SparkSession, d: str) -> DataFrame:
    """Latest candidate per asset and week against the stored earliest one."""
    base = articles(spark, d).select("asset", "week_end", "title", "summary", "url")
    new = joins.keep_last(base, ["asset", "week_end"], ["url"])
    old = joins.keep_first(base, ["asset", "week_end"], ["url"])
    return joins.upsert(new, old, ["asset", "week_end"])


def label_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every labelled document as a 'sentence@label' record."""
    docs = given.table(spark, d, "documents").select("doc_id", "text")
    labels = given.table(spark, d, "labels").select("doc_id", "quality")
    lines = docs.join(labels, "doc_id").select(
        "doc_id", "quality", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    records = lines.select(
        "doc_id", "line_no",
        F.when(tx.collapse(F.col("line")) == "", "").otherwise(
            F.concat(F.col("line"), F.lit("@"), F.when(F.col("quality") == 1, "positive").otherwise("negative"))
        ).alias("value"),
    )
    level = given.choose(F.col("doc_id") % 4, {0: "all_agree", 1: "agree_75", 2: "agree_66", 3: "agree_50"})
    return parsing.parse_labels(records, level=level)


def html_pairs(spark: SparkSession, d: str) -> DataFrame:
    return parsing.anchors(given.table(spark, d, "pages").select("page_id", "html"), "page_id", "html")


def table_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Date/value rows of table markup, one fragment per order."""
    day = F.col("o_orderdate").cast("date")
    price = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    cell = lambda a, b: F.concat(F.lit('<tr><th scope="row" class="x"> '), a.cast("string"), F.lit("</th>\n<td> "), b, F.lit(" </td></tr>"))
    body = F.concat(cell(day, price), F.lit("<p>no pair</p>"), cell(F.date_add(day, 1), F.lit("-1.5")))
    pages = given.table(spark, d, "orders").select("o_orderkey", body.alias("html"))
    return rounded(parsing.value_pairs(pages, "o_orderkey", "html"))


def listings(spark: SparkSession, d: str) -> DataFrame:
    """One listing per page: links to the pages with the five nearest ids, written as rooted paths with a step back, relative
    paths, many steps up, or queries; the page's own entry shows its headline with some words left out."""
    pages = given.table(spark, d, "pages").select(
        "page_id", "url", F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]+)", 1).alias("lang"), parsing.headline("html").alias("title"))
    k = F.col("page_id")
    n = k.cast("string")
    href = (
        F.when(k % 4 == 0, F.concat(F.lit("/news/../"), "lang", F.lit("/"), n))
        .when(k % 4 == 1, F.concat(F.lit("../"), "lang", F.lit("/./story-"), n))
        .when(k % 4 == 2, F.concat(F.lit("../../../../../../deep/"), n, F.lit(".html")))
        .otherwise(F.concat(F.lit("?post_type=news&p="), n))
    )
    short = F.array_join(F.filter(F.split("title", " "), lambda w, i: (i + k) % 5 != 0), " ")
    shown = pages.withColumn("step", F.explode(F.sequence(F.lit(-2), F.lit(2))))
    label = F.when(F.col("step") == 0, short).otherwise(F.substring("title", 1, 120))
    entry = F.concat(F.lit('<li><a class="r" href="'), href, F.lit('">'), F.regexp_replace(label, "[<>&]", " "), F.lit("</a></li>"))
    lists = shown.select((k + F.col("step")).alias("page_id"), "step", entry.alias("entry")).groupBy("page_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", "entry"))), lambda s: s["entry"]), "").alias("listing"))
    return pages.select("page_id", "url", "title").join(lists, "page_id")


def article_links(spark: SparkSession, d: str) -> DataFrame:
    """Closest article link of each page's listing to the page's headline."""
    links = parsing.anchors(listings(spark, d), "page_id", "listing")
    return rounded(parsing.best_links(links, "page_id"))


def flatten_news(spark: SparkSession, d: str) -> DataFrame:
    """Nested records built from the event stream, mixed ticker elements included."""
    e = F.col
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    record = F.concat(
        F.lit('{"id":'), quoted(e("event_id").cast("string")),
        F.lit(',"content":{"title":'), quoted(F.concat(F.lit("Report on "), e("event_type"))),
        F.when(e("event_id") % 3 != 0, F.concat(F.lit(',"summary":'), quoted(F.concat(F.lit("user "), e("user_id").cast("string"))))).otherwise(""),
        F.lit(',"contentType":"STORY","pubDate":'), quoted(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.lit(',"provider":{"displayName":"desk"},"canonicalUrl":{"url":"https://x.example/a"},"finance":["SPY",{"symbol":'),
        quoted(F.upper("event_type")), F.lit('},{"name":"none"}]}}'),
    )
    symbol = F.when(e("event_id") % 2 == 0, e("event_type")).otherwise("TLT")
    return parsing.flatten_news(given.table(spark, d, "events").select(symbol.alias("requested_symbol"), record.alias("record")))


def event_times(spark: SparkSession, d: str) -> DataFrame:
    """Events with their time as text; those of users divisible by 7 tell it in words, those divisible by 11 not at all."""
    e = F.col
    return given.table(spark, d, "events").select(
        F.upper("event_type").alias("requested_symbol"), F.floor(e("event_id") / 3).alias("news_id"), "event_id",
        F.when(e("user_id") % 11 == 0, "").when(e("user_id") % 7 == 0, "yesterday").otherwise(
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("published_at"))


def tagged_times(spark: SparkSession, d: str) -> DataFrame:
    return parsing.tag_rejects(event_times(spark, d), {"published_at": F.try_to_timestamp("published_at")})


def news_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """One event per (symbol, id), the earliest; a time that cannot be read is null, the event stays."""
    return joins.keep_first(tagged_times(spark, d).drop("rejects"), ["requested_symbol", "news_id"], ["event_id"])


def news_time_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Events whose time cannot be read, with the reason."""
    return parsing.rejected(tagged_times(spark, d), ["event_id"])


def preset_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Series of every named selection with their metadata and what the macro panel holds of them."""
    panel = given.macro_panel(spark, d)
    held = cut_lineage(panel.groupBy("series_id").agg(F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")))
    parts = [
        readers.series_table(spark, p).join(readers.select_series(held, p), "series_id", "left").withColumn("preset", F.lit(p))
        for p in SERIES_PRESETS
    ]
    return joins.stack_rows(parts).fillna(0, subset=["n_rows"]).drop("source")


def period_dates(spark: SparkSession, d: str) -> DataFrame:
    """Period strings, header-style dates and the date mask of a first cell."""
    o = given.table(spark, d, "orders")
    day = F.col("o_orderdate").cast("date")
    k = F.col("o_orderkey")
    period = F.when(k % 11 == 0, "total").otherwise(F.date_format(day, "yyyy:MM"))
    header = F.when(k % 7 == 0, "yesterday").otherwise(F.concat(F.date_format(day, "EEE, dd MMM yyyy"), F.lit(" 08:00:00 GMT")))
    cell = day.cast("string")
    parsed = o.select(
        "o_orderkey", parsing.period_date(period).alias("period_start"), tx.rfc_date(header).alias("header_date"),
        F.try_to_date(cell).alias("cell_date"),
    )
    return parsed.filter(F.col("cell_date").isNotNull())


QUERIES = {
    f.__name__: f
    for f in (
        series_cleanup, series_rejects, source_fallback, upsert_rows, label_lines, html_pairs, table_pairs, article_links,
        flatten_news, news_dedupe, news_time_rejects, preset_coverage, period_dates,
    )
}
