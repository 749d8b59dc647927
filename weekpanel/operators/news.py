"""News enrichment, weekly aggregation, article choice and scoring hooks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.constants import ARTICLE_BLOCKED, ARTICLE_TERMS, COMMON_BLOCKED, NEWS_ASSETS, TOPIC_KEYWORDS, TRACKED_ASSETS
from weekpanel.functions import text as tx
from weekpanel.functions.semantics import ordered
from weekpanel.operators.calendar import week_end

RELATED = (*TRACKED_ASSETS, "QQQ")
TOPICS = (*TOPIC_KEYWORDS, "other")


def enrich(news: DataFrame, strict_reference: bool = True) -> DataFrame:
    """Sentiment, topic, impact, relevance and week of each event.

    With ``strict_reference`` the requested symbol is searched, upper-cased, in
    lower-cased text (so alphabetic symbols never match); otherwise in like case.
    """
    lowered = news.withColumn("_text", F.concat(F.lower(tx.text("title")), F.lit(" "), F.lower(tx.text("summary"))))
    hits = lowered.withColumns(tx.lexicon_hits(F.col("_text")))
    related = F.transform(F.split(tx.text("related_tickers"), ","), lambda t: F.upper(F.trim(t)))
    symbol = F.upper("requested_symbol") if strict_reference else F.lower("requested_symbol")
    topics = {t: F.col(f"_topic_{t}") for t in TOPIC_KEYWORDS}
    relevance = (
        (F.coalesce("query_relevance_heuristic", F.lit(0)) != 0).cast("int")
        + F.arrays_overlap(related, F.array(*[F.lit(a) for a in RELATED])).cast("int")
        + F.contains(F.col("_text"), symbol).cast("int")
        + (F.col("_imp") > 0).cast("int")
    )
    return hits.select(
        *news.columns,
        tx.sentiment_label(F.col("_pos"), F.col("_neg")).alias("sentiment_label"),
        tx.sentiment_score(F.col("_pos"), F.col("_neg")).alias("sentiment_score"),
        tx.topic_label(topics).alias("topic_label"),
        tx.impact_level(F.col("_imp")).alias("impact_score"),
        relevance.alias("relevance_score"),
        (relevance > 0).cast("int").alias("is_relevant"),
        week_end(F.col("published_at").cast("date")).alias("week_end"),
        F.lit("enriched_from_news").alias("source"),
    )


def weekly_aggregates() -> list[Column]:
    label, share = F.col("sentiment_label"), lambda c: F.avg(c.cast("int"))
    return [
        F.count("news_id").alias("headline_count"),
        F.sum("is_relevant").alias("relevant_headline_count"),
        F.avg("sentiment_score").alias("mean_sentiment_score"),
        F.avg("impact_score").alias("mean_impact_score"),
        F.max("impact_score").alias("max_impact_score"),
        F.avg("is_relevant").alias("relevance_ratio"),
        share(label == "negative").alias("negative_ratio"),
        share(label == "positive").alias("positive_ratio"),
        *[share(F.col("topic_label") == t).alias(f"topic_{t}_ratio") for t in TOPICS],
    ]


def weekly_features(enriched: DataFrame) -> DataFrame:
    """One combinable aggregation per week; a crowded week stays one partial row per task."""
    return (
        enriched.filter(F.col("week_end").isNotNull())
        .groupBy("week_end")
        .agg(*weekly_aggregates())
        .withColumn("source", F.lit("aggregated_from_news_events_enriched"))
    )


def compound_pivot(scored: DataFrame, assets: Sequence[str] = NEWS_ASSETS) -> DataFrame:
    """Mean compound score per week, one column per listed asset."""
    asset = F.upper("asset")
    cols = [
        F.avg(F.when(asset == a, F.col("finbert_compound"))).alias(f"news_finbert_compound_{a.lower()}") for a in assets
    ]
    return scored.filter(asset.isin(*assets)).groupBy("week_end").agg(*cols)


def article_matches(candidates: DataFrame, assets: Sequence[str] = tuple(ARTICLE_TERMS)) -> DataFrame:
    """Candidates inside their week without blocked terms, with their term hits."""
    fields = {c: tx.clean_text(c) for c in ("title", "description", "publisher", "url")}
    cleaned = candidates.withColumns(fields)
    inside = F.col("article_date").between(F.date_sub("week_end", 6), F.col("week_end"))
    own = phrase_table({a: ARTICLE_TERMS[a] for a in assets})[F.col("asset")]
    barred = phrase_table({a: (*COMMON_BLOCKED, *ARTICLE_BLOCKED[a]) for a in assets})[F.col("asset")]

    def counts(padded: Column) -> Column:
        found = lambda terms: F.size(F.filter(terms, lambda t: F.contains(padded, t)))
        return F.struct(found(barred).alias("barred"), found(own).alias("hits"))

    # the normalised text is bound once per row, not once per phrase
    padded = F.concat(F.lit(" "), tx.normalize("title", "description", "publisher"), F.lit(" "))
    matched = cleaned.filter(inside).withColumn("_m", F.transform(F.array(padded), counts)[0])
    return matched.filter(F.col("_m.barred") == 0).withColumn("hits", F.col("_m.hits")).drop("_m")


def phrase_table(terms: dict[str, Sequence[str]]) -> Column:
    """Literal map asset -> padded phrases; each row tests only its own asset's."""
    entries = [(F.lit(a), F.array(*[F.lit(f" {t} ") for t in ts])) for a, ts in terms.items()]
    return F.create_map(*[x for kv in entries for x in kv])


def best_articles(candidates: DataFrame, calendar: DataFrame) -> DataFrame:
    """Best article per (asset, week) of the calendar, blank rows where none fits.

    Matched candidates come before fallbacks.  The two best are kept (a
    row-number filter, limited per task before the shuffle); the first of them
    with a summary wins, else the first with its description as summary.
    """
    tier = (F.col("hits") == 0).cast("int")
    order = [
        tier, F.col("query_rank"), F.when(tier == 0, -F.col("hits")).otherwise(0), F.col("gnews_rank"),
        F.col("publisher_url"), F.col("url"),
    ]
    w = ordered(["asset", "week_end"], *order)
    top = article_matches(candidates).withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= 2)
    summary = tx.text("summary")
    row = F.struct(
        "article_date", "title", "description",
        F.when(summary != "", summary).otherwise(tx.snippet("description")).alias("summary"),
        "publisher", "url", "query", "query_rank", "gnews_rank",
    )
    best = top.groupBy("asset", "week_end").agg(
        F.min_by(row, F.struct((summary == "").cast("int"), F.col("_rank"))).alias("_row")
    )
    blank = {c: F.coalesce(F.col(f"_row.{c}"), F.lit("")) for c in ("title", "description", "summary", "publisher", "url", "query")}
    return calendar.join(best, ["asset", "week_end"], "left").select(
        "asset", "week_end", F.col("_row.article_date").alias("article_date"),
        *[e.alias(c) for c, e in blank.items()],
        F.col("_row.query_rank").alias("query_rank"), F.col("_row.gnews_rank").alias("gnews_rank"),
    )


def choose_texts(articles: DataFrame) -> DataFrame:
    """The text to score: publisher suffixes removed, repeats of the title skipped. A long text that is not needed is not
    cleaned, and none is cleaned twice."""
    own = lambda c: tx.strip_publisher(c, "_publisher")
    plain = articles.withColumn("_publisher", tx.plain_clean("publisher")).withColumn("_title", own("title"))
    title = F.col("_title")
    rest = lambda d, s: F.when((d != "") & tx.differs(d, title), d).when(title != "", title).when(d != "", d).otherwise(s)
    chosen = tx.bound(own("summary"), lambda s: F.when((s != "") & tx.differs(s, title), s).otherwise(tx.bound(own("description"), lambda d: rest(d, s))))
    return plain.withColumn("finbert_text", chosen).drop("_publisher", "_title")


def lexicon_scores(source: Column) -> Column:
    """Default scorer: lexicon hits as class probabilities."""
    hits = tx.bound(F.lower(source), lambda t: F.array(tx.keyword_hits(t, tx.POSITIVE_KEYWORDS), tx.keyword_hits(t, tx.NEGATIVE_KEYWORDS)))

    def shares(h: Column) -> Column:
        n = (h[0] + h[1] + 1).cast("double")
        return F.array(h[0] / n, F.lit(1.0) / n, h[1] / n)

    return F.map_from_arrays(F.array(F.lit("positive"), F.lit("neutral"), F.lit("negative")), tx.bound(hits, shares))


def score_texts(articles: DataFrame, scores: Column | None = None) -> DataFrame:
    probabilities = lexicon_scores(F.col("finbert_text")) if scores is None else scores
    with_map = articles.withColumn("_scores", probabilities)
    return with_map.withColumns(tx.class_scores(F.col("_scores"), F.col("finbert_text"))).drop("_scores")


def score_with(articles: DataFrame, make_scorer: Callable[[], Callable[[list[str]], list[dict]]], batch_size: int = 16) -> DataFrame:
    """Score texts with a user model, loaded once per task and called in batches.

    ``make_scorer()`` returns a function from a list of texts to a list of
    class -> probability dicts.
    """

    @F.pandas_udf("map<string,double>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = make_scorer()
        for texts in batches:
            values = texts.fillna("").tolist()
            out: list[dict] = []
            for i in range(0, len(values), batch_size):
                out.extend(scorer(values[i : i + batch_size]))
            yield pd.Series(out)

    return score_texts(articles, scored("finbert_text"))
