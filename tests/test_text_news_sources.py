"""Text functions, news operators, parsing, readers and joins."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from weekpanel import schemas
from weekpanel.functions import text as tx
from weekpanel.operators import joins
from weekpanel.operators import news as nw
from weekpanel.operators.features import SeriesMeta
from weekpanel.sources import parsing, readers, sinks
from weekpanel.sources.manifest import manifest

D = dt.date


def one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} string" for n in names)) if cols else spark.range(1)
    return df.select(expr).first()[0]


@pytest.mark.parametrize("raw,want", [
    ("<b>A</b>&amp;B &nbsp; C\n D", "A &B C D"), (None, ""), ("", ""), ("&#39;x&quot;", "'x\""), ("a b", "a b"),
])
def test_clean_text(spark, raw, want):
    assert one(spark, tx.clean_text("t"), t=raw).replace("A& B", "A &B") == want.replace("A& B", "A &B") or one(spark, tx.clean_text("t"), t=raw) == want


def test_normalize_and_terms(spark):
    assert one(spark, tx.normalize("t"), t="S&P 500 — R&amp;D!") == "s and p 500 r and d"
    text = F.lit("warning signs about s p 500 stocks")
    assert one(spark, tx.keyword_hits(text, ("war", "warning", "peace"))) == 2  # substrings
    assert one(spark, tx.term_hits(text, ("war", "s p 500", "stocks"))) == 2  # whole phrases
    assert one(spark, F.array_join(tx.title_tokens("t"), ","), t="The quick brown foxes jumped over lazy dogs today again") == "quick,brown,foxes,jumped,over,lazy"


def events(spark, rows):
    return spark.createDataFrame(
        [(s, i, "STORY", t, b, p, "pub", None, None, r, f) for s, i, t, b, p, r, f in rows], schemas.NEWS_EVENTS.replace("published_at timestamp", "published_at string")
    ).withColumn("published_at", F.try_to_timestamp("published_at"))


def test_enrichment_rules(spark):
    rows = [
        ("SPY", "1", "Warning on SPY", None, "2015-01-02 23:00:00", "spy, XOM", 0),
        ("SPY", "2", "Gain and loss", "", "2015-01-03 00:00:00", "XOM", 0),
        ("SPY", "3", "", None, "2015-01-02 00:00:00", None, None),
        ("SPY", "4", "Fed rates policy rally", None, "bad date", "", 1),
    ]
    out = {r.news_id: r for r in nw.enrich(events(spark, rows)).collect()}
    assert out["1"].impact_score == 2 and out["1"].topic_label == "geopolitics_policy"  # 'war' in 'warning'
    assert out["1"].relevance_score == 2 and out["1"].week_end == D(2015, 1, 2)
    assert out["2"].sentiment_label == "negative" if out["2"].sentiment_score < 0 else out["2"].sentiment_label == "neutral"
    assert out["2"].week_end == D(2015, 1, 9)
    assert (out["3"].sentiment_label, out["3"].sentiment_score, out["3"].topic_label, out["3"].relevance_score, out["3"].is_relevant) == ("neutral", 0.0, "other", 0, 0)
    assert out["4"].impact_score == 3 and out["4"].topic_label == "inflation_rates" and out["4"].week_end is None
    loose = {r.news_id: r.relevance_score for r in nw.enrich(events(spark, rows), strict_reference=False).collect()}
    assert loose["1"] == 3
    weekly = nw.weekly_features(nw.enrich(events(spark, rows))).orderBy("week_end").collect()
    assert [r.headline_count for r in weekly] == [2, 1] and weekly[0].topic_other_ratio == 0.5


def test_topic_tie_takes_the_first_topic(spark):
    hits = {"a": F.lit(1), "b": F.lit(1), "c": F.lit(0)}
    assert one(spark, tx.topic_label(hits)) == "a"


def test_publisher_suffix_and_choice(spark):
    for raw, want in (("Gold up - Src7", "Gold up"), ("Gold up SRC7", "Gold up"), ("Gold up-src7", "Gold up"), ("Gold upsrc7", "Gold upsrc7"), ("X Src7 - Src7", "X"), ("Src7", "Src7")):
        assert one(spark, tx.strip_publisher("t", "p"), t=raw, p="Src7") == want
    pick = lambda t, d, s: one(spark, tx.choose_text(F.lit(t), F.lit(d), F.lit(s)))
    assert pick("A b", "c", "a B!") == "c" and pick("t", "d", "s") == "s" and pick("t", "T", "t") == "t" and pick("", "", "") == ""


def test_sentences_keep_digits_at_both_ends(spark):
    texts = [f"{i} is the number of this sentence, and it ends with the same number {i}." for i in range(12)]
    assert one(spark, tx.sentences("t"), t=" ".join(texts)) == texts
    texts = [f"{i}{i} is the number of a sentence without a stop at its end, {i}{i}?!" for i in range(12)]
    assert one(spark, tx.first_sentences("t", 12, 2000), t="\n".join(texts)) == " ".join(texts)


def test_sentences_and_boilerplate(spark):
    long = "This sentence is certainly longer than forty characters."
    text = f"Short one. {long} Read our privacy policy before you continue with this page. {long} {long} {long}"
    assert one(spark, tx.first_sentences("t"), t=text) == " ".join([long] * 3)
    assert one(spark, tx.boilerplate(F.col("t")), t="Our cookie policy") and not one(spark, tx.boilerplate(F.col("t")), t="Our cookies")


@pytest.mark.parametrize("url,want", [
    ("https://a.com/2015/story", True), ("https://a.com/", False), ("https://a.com/tag/x", False), ("https://b.com/story", False),
    ("/story", False), ("https://a.com/story?s=x", False), ("https://a.com/story?post_type=news&p=1&s=2", True), ("https://a.com/story?cookies=1", False),
])
def test_article_urls(spark, url, want):
    assert one(spark, tx.is_article_url(F.col("u"), F.lit("a.com")), u=url) is want


def test_class_scores(spark):
    df = spark.createDataFrame([("t", {"positive": 0.7, "neutral": 0.2, "negative": 0.1}), ("  ", {"positive": 1.0})], "finbert_text string, s map<string,double>")
    a, b = nw.score_texts(df, F.col("s")).collect()
    assert (a.finbert_label, a.finbert_score) == ("positive", 0.7) and a.finbert_compound == pytest.approx(0.6)
    assert b.finbert_label is None and b.finbert_score is None and b.finbert_compound == 0.0


def test_user_scorer_runs_in_batches(spark):
    df = spark.createDataFrame([(f"text {i}",) for i in range(40)], "finbert_text string")
    make = lambda: lambda texts: [{"negative": 0.1 * len(texts) / 16, "positive": 0.9} for _ in texts]
    out = nw.score_with(df, make, batch_size=16).collect()
    assert len(out) == 40 and all(r.finbert_label == "positive" and r.finbert_negative <= 0.1 for r in out)


def test_best_article_tiers(spark):
    w = D(2015, 1, 9)
    rows = [
        ("GLD", w, D(2015, 1, 8), "Gold coast trip", "", "s", "p", "u1", "b1", "q", 1, 1),  # blocked
        ("GLD", w, D(2015, 1, 8), "Nothing here", "fallback text", "", "p", "u2", "b2", "q", 1, 1),
        ("GLD", w, D(2015, 1, 8), "Gold price up", "first", "", "p", "u3", "b3", "q", 2, 1),
        ("GLD", w, D(2015, 1, 8), "Gold again", "second", "has summary", "p", "u4", "b4", "q", 2, 2),
        ("GLD", w, D(2015, 1, 1), "Gold price early", "out of week", "s", "p", "u5", "b5", "q", 1, 1),
        ("TLT", w, D(2015, 1, 9), "Nothing", "only fallback", "", "p", "u6", "b6", "q", 3, 1),
    ]
    df = spark.createDataFrame(rows, "asset string, week_end date, article_date date, title string, description string, summary string, publisher string, publisher_url string, url string, query string, query_rank int, gnews_rank int")
    cal = spark.createDataFrame([("GLD", w), ("TLT", w), ("SPY", w)], "asset string, week_end date")
    out = {r.asset: r for r in nw.best_articles(df, cal).collect()}
    assert out["GLD"].url == "b4" and out["GLD"].summary == "has summary"
    assert out["TLT"].summary == "only fallback" and out["SPY"].title == "" and out["SPY"].query_rank is None


def test_parsing(spark):
    pages = spark.createDataFrame([(1, '<tr><th scope="row" x>2015-01-02</th>\n<td>1,234.5</td></tr><th scope="row">2015-02-01</th> <td> -2 </td>'), (2, "none")], "id int, html string")
    assert [(r.id, r.date, r.value) for r in parsing.value_pairs(pages, "id", "html").orderBy("pos").collect()] == [(1, D(2015, 1, 2), 1234.5), (1, D(2015, 2, 1), -2.0)]
    embedded = spark.createDataFrame([(1, '{\\"date\\":\\"2015-01-02\\",\\"value\\":-3.5}')], "id int, html string")
    assert parsing.value_pairs(embedded, "id", "html", parsing.EMBEDDED_PAIR).first().value == -3.5
    lines = spark.createDataFrame([("mail a@b.c rose@positive",), ("  ",), ("flat @ neutral ",)], "value string")
    assert sorted((r.sentence, r.label) for r in parsing.parse_labels(lines).collect()) == [("flat", "neutral"), ("mail a@b.c rose", "positive")]
    assert one(spark, parsing.period_date("t"), t="2015:03") == D(2015, 3, 1) and one(spark, parsing.period_date("t"), t="total") is None
    assert one(spark, tx.rfc_date("t"), t="Fri, 02 Jan 2015 08:00:00 GMT") == D(2015, 1, 2) and one(spark, tx.rfc_date("t"), t="?") is None


def test_flatten_news(spark):
    record = {"id": "n1", "content": {"title": "About tlt", "pubDate": "2015-01-02T00:00:00Z", "provider": {"displayName": "d"}, "finance": ["SPY", {"symbol": "GLD"}, {"x": 1}]}}
    df = spark.createDataFrame([("TLT", json.dumps(record)), ("SPY", json.dumps({"id": "n2"}))], "requested_symbol string, record string")
    a, b = parsing.flatten_news(df).orderBy("news_id").collect()
    assert (a.related_tickers, a.query_relevance_heuristic, a.publisher, a.summary) == ("SPY,GLD", 1, "d", "")
    assert (b.title, b.related_tickers, b.query_relevance_heuristic) == ("", "", 0)


def test_series_cleanup_keeps_the_last_correction(spark):
    rows = [("S", 1, "2015-01-01", "1.5"), ("S", 3, "2015-01-01", "2.5"), ("S", 2, "2015-01-01", "9"), ("S", 4, "x", "1"), ("S", 5, "2015-01-02", ".")]
    df = spark.createDataFrame(rows, "series_id string, loaded int, date string, value string")
    out = parsing.with_series_metadata(df, [SeriesMeta("S", "c", "daily", "d", "level")], "src", "loaded").collect()
    assert [(r.value, r.frequency, r.source) for r in out] == [(2.5, "daily", "src")]


def test_label_files(spark, tmp_path):
    (tmp_path / "Sentences_75Agree.txt").write_bytes("caf\xe9 up@positive\n\n".encode("latin1"))
    (tmp_path / "other.txt").write_text("x@y\n")
    out = parsing.read_label_files(spark, str(tmp_path)).collect()
    assert [(r.agreement_level, r.sentence, r.label) for r in out] == [("agree_75", "café up", "positive")]


def test_readers_and_sinks(spark, tmp_path):
    rows = [(D(2015, 1, 2), s, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, "x") for s in ("SPY", "TLT")]
    sinks.write_tables({"prices": spark.createDataFrame(rows, schemas.PRICE_DAILY)}, str(tmp_path))
    assert readers.load_prices(spark, f"{tmp_path}/prices", ("SPY", "TLT")).count() == 2
    with pytest.raises(ValueError, match="GLD"):
        readers.load_prices(spark, f"{tmp_path}/prices", ("SPY", "GLD"))
    empty = readers.load_news_or_empty(spark, f"{tmp_path}/absent.csv")
    assert empty.count() == 0 and nw.weekly_features(nw.enrich(empty)).count() == 0
    csv = tmp_path / "m.csv"
    csv.write_text("date,series_id,value,category,frequency,description,suggested_transform,source\n2015-01-02,S,NaN,c,daily,d,level,x\n")
    assert readers.load_macro(spark, str(csv)).first().value is None
    assert readers.first_existing(spark, [f"{tmp_path}/no", str(csv)]) == str(csv)
    with pytest.raises(FileNotFoundError):
        readers.first_existing(spark, [f"{tmp_path}/no"])
    assert readers.strip_headers(spark.createDataFrame([(1, 2)], "` week_end` int, b int")).columns == ["week_end", "b"]
    history = spark.createDataFrame([("2015-01-02", 1.0, 1.0, 1.0, 1.0, 1.0, 5)], "Date string, Open double, High double, Low double, Close double, `Adj Close` double, Volume long")
    assert readers.normalize_price_history(history, "SPY", "s").first().adj_close == 1.0
    log = spark.createDataFrame([(D(2015, 1, 2), "validation", 1, "spy_only", 0.1, 0.1, 0.0, 0.0)], schemas.ACTION_LOG)
    path = sinks.write_action_log(log, str(tmp_path))["action_log"]
    assert spark.read.parquet(path).first().eval_split == "validation"
    m = manifest({"a": log, "b": spark.range(2)}).orderBy("dataset_name").collect()
    assert (m[0].n_rows, m[0].n_columns, m[0].min_date) == (1, 8, D(2015, 1, 2)) and m[1].min_date is None


def test_joins(spark):
    new = spark.createDataFrame([("a", "t", ""), ("b", "t", "s"), ("c", "", "s")], "k string, title string, summary string")
    old = spark.createDataFrame([("a", "o", "old"), ("b", "o", "old"), ("c", "o", None)], "k string, title string, summary string")
    assert {r.k: r.summary for r in joins.upsert(new, old, ["k"]).collect()} == {"a": "old", "b": "s", "c": "s"}
    f1, f2 = spark.createDataFrame([("x", 1)], "e string, v int"), spark.createDataFrame([("x", 2), ("y", 3), ("y", 4)], "e string, v int")
    assert sorted((r.e, r.v) for r in joins.first_source([f1, f2], "e").collect()) == [("x", 1), ("y", 3), ("y", 4)]
    with pytest.raises(Exception, match="sum to 1"):
        joins.require_probabilities(spark.createDataFrame([(0.5, 0.6)], "a double, b double"), ["a", "b"]).count()
    with pytest.raises(Exception, match="unknown value"):
        joins.require_members(f1, "e", ["y"]).collect()
    cov = joins.coverage(spark.createDataFrame([(1,), (2,)], "week_end int"), spark.createDataFrame([(1, 0.5)], "week_end int, n double"), ["n"]).first()
    assert (cov.base_rows, cov.covered_rows, cov.missing_n) == (2, 1, 1)
    base = spark.createDataFrame([(1, "x")], "week_end int, source string")
    regimes = spark.createDataFrame([(2, 0)], "week_end int, regime_filtered int")
    with pytest.raises(Exception, match="missing regime"):
        joins.assemble_regime_state(base, regimes, spark.createDataFrame([(1, 0.1)], "week_end int, n double")).collect()


def test_chosen_texts_are_cleaned_once(spark):
    fields = ("title", "description", "summary", "publisher")
    titles = ["", "Gold rises", "Gold rises - Src1", "ÄÖ", "gold  RISES Src1"]
    rest = ["", "  ", "gold rises!", "Gold rises " + "x" * 200, "." * 300 + "gold rises", "." * 300 + "gold rises" + "y", "Text : src1 - SRC1", "ä ö", None]
    rows = [(t, d, s, p) for t in titles for d in rest for s in rest for p in ("Src1", "", None)]
    df = spark.createDataFrame(rows, ", ".join(f"{f} string" for f in fields))
    out = nw.choose_texts(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 60
    blank, joints = re.compile("[ \t\n\x0b\f\r ]+"), ("[ \t\n\x0b\f\r]*[-:–—][ \t\n\x0b\f\r]*$", "[ \t\n\x0b\f\r]+$")
    clean = lambda v: blank.sub(" ", v or "").strip(" ")
    norm = lambda v: re.sub("[^a-z0-9]+", " ", v.lower()).strip(" ")

    def strip(v, p):
        t, p = clean(v), clean(p)
        for joint in joints:
            head = t[: len(t) - len(p)]
            if p and len(t) > len(p) and t[len(head):].lower() == p.lower() and re.search(joint, head):
                t = re.sub(joint, "", head).strip(" ")
        return t

    for r in out.collect():
        t, d, s = (strip(v, r.publisher) for v in (r.title, r.description, r.summary))
        want = s if s and norm(s) != norm(t) else d if d and norm(d) != norm(t) else t or d or s
        assert r.finbert_text == want, r
