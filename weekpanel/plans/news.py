"""News and text queries over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekpanel.constants import NEWS_ASSETS
from weekpanel.functions import text as tx
from weekpanel.operators import joins
from weekpanel.operators import news as nw
from weekpanel.operators.calendar import week_end
from weekpanel.plans.market import rounded, state
from weekpanel.session import spread
from weekpanel.sources import given

ARTICLE_ASSETS = ("SPY", "TLT", "GLD", "VIX", "TNX")


def news_enriched(spark: SparkSession, d: str) -> DataFrame:
    out = nw.enrich(spread(given.news_events(spark, d)))
    return rounded(out.select(
        "news_id", "requested_symbol", "title", "published_at", "related_tickers", "sentiment_label", "sentiment_score",
        "topic_label", "impact_score", "relevance_score", "is_relevant", "week_end", "source",
    ))


def news_weekly(spark: SparkSession, d: str) -> DataFrame:
    return rounded(nw.weekly_features(nw.enrich(spread(given.news_events(spark, d)))))


def model_state_news(spark: SparkSession, d: str) -> DataFrame:
    full = joins.with_news(state(spark, d), nw.weekly_features(nw.enrich(spread(given.news_events(spark, d)))))
    return rounded(full.select(
        "week_end", "spy_ret_5d", "dff_level", "next_return_spy", "headline_count", "mean_sentiment_score",
        "max_impact_score", "topic_other_ratio", "has_news_features", "source",
    ))


def articles(spark: SparkSession, d: str) -> DataFrame:
    """Article candidates: one per document and asset rule, dated near its week."""
    doc = F.col("doc_id")
    day = given.news_day(doc)
    return given.table(spark, d, "documents").select(
        given.pick(ARTICLE_ASSETS, doc).alias("asset"),
        week_end(F.date_add(day, ((doc % 9) - 2).cast("int"))).alias("week_end"),
        day.alias("article_date"),
        given.pick(given.HEADLINES, doc).alias("title"),
        F.concat(given.pick(given.HEADLINES, doc + 5), F.lit(" "), F.col("text")).alias("description"),
        F.when(F.col("lang") == "en", F.col("text")).otherwise("").alias("summary"),
        F.col("source").alias("publisher"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com")).alias("publisher_url"),
        F.concat(F.lit("https://news.example.com/"), F.col("lang"), F.lit("/"), doc.cast("string")).alias("url"),
        F.concat(F.lit("query "), (doc % 3 + 1).cast("string")).alias("query"),
        (doc % 3 + 1).cast("int").alias("query_rank"),
        (doc % 10 + 1).cast("int").alias("gnews_rank"),
    )


def article_calendar(spark: SparkSession, d: str) -> DataFrame:
    weeks = given.table(spark, d, "documents").select(week_end(given.news_day(F.col("doc_id"))).alias("week_end")).distinct()
    return weeks.select(F.explode(F.array(*[F.lit(a) for a in ARTICLE_ASSETS])).alias("asset"), "week_end")


def best_article(spark: SparkSession, d: str) -> DataFrame:
    return nw.best_articles(spread(articles(spark, d)), article_calendar(spark, d))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return nw.score_texts(nw.choose_texts(spread(articles(spark, d))))


def choose_text(spark: SparkSession, d: str) -> DataFrame:
    return nw.choose_texts(spread(articles(spark, d))).select("url", "asset", "week_end", "finbert_text")


def class_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scored(spark, d).select(
        "url", "finbert_label", "finbert_score", "finbert_positive", "finbert_neutral", "finbert_negative", "finbert_compound"
    ))


def news_compound_pivot(spark: SparkSession, d: str) -> DataFrame:
    return rounded(nw.compound_pivot(scored(spark, d)))


def coverage_check(spark: SparkSession, d: str) -> DataFrame:
    """Weekly sentiment coverage of the trading weeks."""
    base = given.table(spark, d, "lineitem").select(week_end(F.col("l_shipdate").cast("date")).alias("week_end")).distinct()
    columns = [f"news_finbert_compound_{a.lower()}" for a in NEWS_ASSETS]
    return joins.coverage(base, nw.compound_pivot(scored(spark, d)), columns)


def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Cleaning and normalising of whole page sources."""
    return spread(given.table(spark, d, "pages")).select(
        "page_id", tx.clean_text("html").alias("cleaned"), tx.normalize("html").alias("normalized"),
        F.array_join(tx.title_tokens("html"), "|").alias("tokens"),
    )


def sentence_summary(spark: SparkSession, d: str) -> DataFrame:
    return spread(given.table(spark, d, "documents")).select(
        "doc_id", F.size(tx.sentences("text")).alias("n_sentences"), tx.first_sentences("text").alias("summary"),
        tx.boilerplate(F.col("text")).alias("is_boilerplate"), tx.snippet("text").alias("snippet"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        news_enriched, news_weekly, model_state_news, best_article, choose_text, class_scores,
        news_compound_pivot, coverage_check, text_normalize, sentence_summary,
    )
}
