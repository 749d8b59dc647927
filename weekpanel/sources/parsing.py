"""Raw records to tables: news JSON, label lines, page pairs and links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel import schemas
from weekpanel.constants import AGREEMENT_FILES
from weekpanel.functions import text as tx
from weekpanel.functions.matching import matching_ratio
from weekpanel.operators.features import SeriesMeta
from weekpanel.operators.joins import keep_last

# The layouts the date/value extraction understands.
TABLE_PAIR = r'<th scope="row"[^>]*>\s*(\d{4}-\d{2}-\d{2})\s*</th>\s*<td[^>]*>\s*([\-0-9.,]+)\s*</td>'
EMBEDDED_PAIR = r'\\"date\\":\\"(\d{4}-\d{2}-\d{2})\\",\\"value\\":(-?[0-9.]+)'
ANCHOR = r'(?is)<a\s(?:[^>]*?\s)?href\s*=\s*"([^"]*)"[^>]*>(.*?)</a>'
# Fixed value: the least score of an article link.
LINK_SCORE = 8.0


def flatten_news(records: DataFrame, symbol: str = "requested_symbol", json: str = "record") -> DataFrame:
    """Twelve flat columns per raw record; tickers of strings and objects joined."""
    parsed = records.withColumn("_r", F.from_json(json, schemas.NEWS_RECORD))
    c = "_r.content."
    ticker = lambda e: F.when(F.startswith(F.trim(e), F.lit("{")), F.get_json_object(e, "$.symbol")).otherwise(e)
    tickers = F.filter(
        F.transform(F.coalesce(F.col(c + "finance"), F.array().cast("array<string>")), ticker),
        lambda t: t.isNotNull() & (t != ""),
    )
    title, summary = tx.text(c + "title"), tx.text(c + "summary")
    mentioned = F.contains(F.upper(F.concat_ws(" ", title, summary)), F.upper(symbol))
    return parsed.select(
        symbol,
        F.col("_r.id").alias("news_id"),
        F.col(c + "contentType").alias("content_type"),
        title.alias("title"),
        summary.alias("summary"),
        F.col(c + "pubDate").alias("published_at"),
        F.col(c + "provider.displayName").alias("publisher"),
        F.col(c + "canonicalUrl.url").alias("canonical_url"),
        F.col(c + "clickThroughUrl.url").alias("click_url"),
        F.array_join(tickers, ",").alias("related_tickers"),
        mentioned.cast("int").alias("query_relevance_heuristic"),
        F.lit("news_json").alias("source"),
    )


def parse_labels(lines: DataFrame, value: str = "value", level: Column | None = None) -> DataFrame:
    """'sentence@label' lines; the last '@' splits, blank lines are dropped."""
    line = F.trim(F.regexp_replace(value, "^\\s+|\\s+$", ""))
    return (
        lines.withColumn("_line", line)
        .filter(F.col("_line") != "")
        .select(
            *[c for c in lines.columns if c != value],
            (level if level is not None else F.lit(None).cast("string")).alias("agreement_level"),
            F.trim(F.regexp_extract("_line", "(?s)^(.*)@([^@]*)$", 1)).alias("sentence"),
            F.trim(F.regexp_extract("_line", "(?s)^(.*)@([^@]*)$", 2)).alias("label"),
        )
    )


def read_label_files(spark, folder: str) -> DataFrame:
    """Label files of a folder; the agreement level comes from the file name."""
    # the text reader is UTF-8 only: one unquoted column, split by a control character
    layout = {"encoding": "ISO-8859-1", "sep": "\u0001", "quote": "\u0000"}
    lines = spark.read.schema("value string").options(**layout).csv(folder)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    level = F.element_at(F.create_map(*[F.lit(x) for kv in AGREEMENT_FILES.items() for x in kv]), F.col("_file"))
    tagged = lines.select("value", name.alias("_file")).filter(F.col("_file").isin(*AGREEMENT_FILES))
    return parse_labels(tagged, level=level).drop("_file")


def value_pairs(pages: DataFrame, key: str, body: str, pattern: str = TABLE_PAIR) -> DataFrame:
    """All (date, value) pairs of a page text, in order, thousands separators removed."""
    dates = F.regexp_extract_all(body, F.lit(pattern), F.lit(1))
    values = F.regexp_extract_all(body, F.lit(pattern), F.lit(2))
    zipped = F.arrays_zip(dates.alias("date"), values.alias("value"))
    return pages.select(key, F.posexplode(zipped).alias("pos", "p")).select(
        key, "pos", F.try_to_date(F.col("p.date")).alias("date"),
        F.regexp_replace(F.col("p.value"), ",", "").try_cast("double").alias("value"),
    )


def anchors(pages: DataFrame, key: str, body: str) -> DataFrame:
    href = F.regexp_extract_all(body, F.lit(ANCHOR), F.lit(1))
    label = F.regexp_extract_all(body, F.lit(ANCHOR), F.lit(2))
    zipped = F.arrays_zip(href.alias("href"), label.alias("label"))
    keep = [c for c in pages.columns if c != body]
    return pages.select(*keep, F.posexplode(zipped).alias("pos", "p")).select(
        *keep, "pos", F.col("p.href").alias("href"), tx.clean_text("p.label").alias("label")
    )


def headline(body: Column | str) -> Column:
    """Headline of a page: its first heading, else its title tag, without markup."""
    body = F.col(body) if isinstance(body, str) else body
    heading, title = (F.regexp_extract(body, f"(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}\\s*>", 1) for tag in ("h1", "title"))
    text = lambda c: tx.clean_text(F.regexp_replace(c, "(?s)<[^>]*>", " "))
    return F.when(text(heading) != "", text(heading)).otherwise(text(title))


def best_links(links: DataFrame, key: str, url: str = "url", title: str = "title", threshold: float = LINK_SCORE) -> DataFrame:
    """The article link whose label is closest to the title.

    Score: ten times the matching-blocks ratio of title and label plus the title tokens found in label or link.  One
    combinable max_by per page; the first of equal links wins.
    """
    shown = links.withColumn("link", tx.join_url(F.col(url), F.col("href"))).filter(
        (F.col("label") != "") & tx.is_article_url(F.col("link"), tx.url_part(F.col(url), "host"))
    )
    norm = shown.withColumns(
        {"_t": tx.normalize(title), "_l": tx.normalize("label"), "_all": tx.normalize("label", "link"), "_tok": tx.title_tokens(title)}
    )
    padded = F.concat(F.lit(" "), F.col("_all"), F.lit(" "))
    hits = F.size(F.filter("_tok", lambda t: F.contains(padded, F.concat(F.lit(" "), t, F.lit(" ")))))
    scored = norm.withColumn("score", matching_ratio(F.col("_t"), F.col("_l")) * 10 + hits)
    order = F.struct("score", -F.col("pos"))
    return scored.filter(F.col("score") >= threshold).groupBy(key).agg(
        F.max_by("link", order).alias("link"), F.max("score").alias("score")
    )


def tag_rejects(raw: DataFrame, parsed: dict[str, Column], known: dict[str, Column] | None = None) -> DataFrame:
    """``raw`` with its columns parsed, and ``rejects``: one (column, reason, raw) per value that cannot be used.

    Reasons: ``missing`` (null or blank), ``unreadable`` (no parsed value), ``unknown`` (readable, but the column's condition
    in ``known`` does not hold). Nothing is dropped: ``accepted`` and ``rejected`` read the two sides of one pass."""
    checks = []
    for c in dict.fromkeys([*parsed, *(known or {})]):
        text = F.col(c).cast("string")
        reason = F.when(F.coalesce(F.trim(text), F.lit("")) == "", "missing")
        if c in parsed:
            reason = reason.when(parsed[c].isNull(), "unreadable")
        if known and c in known:
            reason = reason.when(~F.coalesce(known[c], F.lit(False)), "unknown")
        checks.append(F.struct(F.lit(c).alias("column"), reason.alias("reason"), text.alias("raw")))
    rejects = F.filter(F.array(*checks), lambda x: x["reason"].isNotNull())
    return raw.select(*[parsed[c].alias(c) if c in parsed else F.col(c) for c in raw.columns], rejects.alias("rejects"))


def accepted(tagged: DataFrame) -> DataFrame:
    """Rows of which every checked value can be used."""
    return tagged.where(F.size("rejects") == 0).drop("rejects")


def rejected(tagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, column, reason, raw): one row per value that cannot be used."""
    return tagged.select(*keys, F.inline("rejects"))


def tag_series(raw: DataFrame, metas: Sequence[SeriesMeta]) -> DataFrame:
    """Observations with parsed date and value; rejects name unreadable ones and series without metadata."""
    return tag_rejects(
        raw, {"date": F.try_to_date("date"), "value": F.col("value").try_cast("double")},
        {"series_id": F.col("series_id").isin(*[m.series_id for m in metas])})


def with_series_metadata(raw: DataFrame, metas: Sequence[SeriesMeta], source: str, order: str) -> DataFrame:
    """Coerce date and value, drop unusable rows (``rejected(tag_series(...))`` tells them), keep the last row per date,
    attach metadata."""
    clean = accepted(tag_series(raw.select("series_id", order, "date", "value"), metas))
    last = keep_last(clean, ["series_id", "date"], [order]).drop(order)
    columns = ("category", "frequency", "description", "suggested_transform")
    table = F.create_map(
        *[x for m in metas for x in (F.lit(m.series_id), F.struct(*[F.lit(getattr(m, c)).alias(c) for c in columns]))]
    )
    return last.withColumn("_m", F.element_at(table, F.col("series_id"))).select(
        "date", "series_id", "value", *[F.col(f"_m.{c}").alias(c) for c in columns], F.lit(source).alias("source")
    )


def period_date(c: Column | str) -> Column:
    """'YYYY:MM' -> first day of the month."""
    return F.try_to_date(F.concat(F.replace(F.col(c) if isinstance(c, str) else c, F.lit(":"), F.lit("-")), F.lit("-01")))
