"""Character references, link resolution, failing invariants and likelihoods of fits."""

import html
from urllib.parse import urljoin

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekpanel.functions import hmm_kernels as kernels
from weekpanel.functions import text as tx
from weekpanel.functions.matching import matching_ratio
from weekpanel.operators import hmm, joins
from weekpanel.operators import selection as sel
from weekpanel.sources import parsing

REFERENCES = [
    "a &copy; b", "x&middot;y", "&#8217;s &#x2014; &#X41;", "&amp;lt; &lt;", "&notit; &not &ampx", "&unknown; & && &;", "&#0; &#128; &#55296; &#1114112;",
    "&#11;|&#129;|&#99999999999999999999;", "&nbsp;&eacute;&Eacute&hellip;", "no reference", "&", "", "&CounterClockwiseContourIntegral;", "&lt;b&gt;tag&lt;/b&gt;",
]


def test_references_resolve_like_the_standard(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(REFERENCES)], "i int, t string").select("i", tx.unescape(F.col("t")).alias("u")).collect()
    assert {r.i: r.u for r in rows} == {i: html.unescape(t) for i, t in enumerate(REFERENCES)}


LINKS = ["http://b.org/x", "//c.org/y", "/rooted/z", "page.html", "sub/page?q=1", "?k=v", "#part", "", "./same", "../up", "../../top/x", "a/../b",
         "../../../../../../../x", "a/b/c/../../../../../../y?q=../z", "/../../r", "/a/./b/../c/", "..", ".", "a/..", "./", "//d.org/../e", "a//b", "?x=../y", "../#f"]


@pytest.mark.parametrize("page", ["https://a.org/dir/sub/index.html", "https://a.org/dir/?p=1", "https://a.org/x#frag", "https://a.org/1/2/3/4/5/6/7/8.html", "https://a.org"])
def test_links_resolve_like_the_standard(spark, page):
    links = LINKS
    rows = spark.createDataFrame([(page, h) for h in links], "page string, href string")
    got = {r.href: r.u for r in rows.select("href", tx.join_url(F.col("page"), F.col("href")).alias("u")).collect()}
    assert got == {h: urljoin(page, h) for h in links}


def test_nested_and_relative_anchors_are_found(spark):
    body = '<A class="x" href="story/one.html"><b>Rates</b> rise again today</a> <a href="//a.org/two">Other &amp; more</a> <a name="q">no link</a>'
    pages = spark.createDataFrame([(1, "https://a.org/news/", "Rates rise again today", body)], "page_id int, url string, title string, html string")
    found = parsing.anchors(pages, "page_id", "html")
    assert [(r.href, r.label) for r in found.orderBy("pos").collect()] == [("story/one.html", "Rates rise again today"), ("//a.org/two", "Other & more")]
    best = parsing.best_links(found, "page_id").first()
    assert best.link == "https://a.org/news/story/one.html" and best.score >= parsing.LINK_SCORE
    other = pages.withColumn("title", F.lit("nothing of the kind"))
    assert parsing.best_links(parsing.anchors(other, "page_id", "html"), "page_id").count() == 0


RATIOS = [("", ""), ("abc", ""), ("rates rise again today", "rates rise today"), ("abcd" * 30, "bcda" * 60), ("the fed holds", "holds the fed"), ("aab", "aba"), ("x", "y")]


def blocks(a, b):
    """Characters in matching blocks, recursively."""
    best = max(((k, -i, -j) for i in range(len(a)) for j in range(len(b)) for k in [next((n for n in range(min(len(a) - i, len(b) - j)) if a[i + n] != b[j + n]), min(len(a) - i, len(b) - j))]), default=(0, 0, 0))
    k, i, j = best[0], -best[1], -best[2]
    return k + blocks(a[:i], b[:j]) + blocks(a[i + k :], b[j + k :]) if k else 0


def test_matching_ratio_counts_blocks(spark):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(RATIOS)], "i int, a string, b string")
    got = {r.i: r.r for r in rows.select("i", matching_ratio(F.col("a"), F.col("b")).alias("r")).collect()}
    for i, (a, b) in enumerate(RATIOS):
        if len(b) < 200:  # longer second texts leave out their most frequent characters
            assert got[i] == pytest.approx(2 * blocks(a, b) / (len(a) + len(b)) if a or b else 1.0)


def test_headline_is_the_pages_own(spark):
    pages = ["<title>T &amp; t</title><h1 class='x'>The <b>head</b>\nline</h1><a href='x'>other</a>", "<TITLE>Only title</TITLE><h1> </h1>", "<h1x>no</h1x>", "<a href='y'>link</a>"]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    got = {r.i: r.t for r in rows.select("i", parsing.headline("html").alias("t")).collect()}
    assert got == {0: "The head line", 1: "Only title", 2: "", 3: ""}


def test_invariants_fail_loudly(spark):
    base = spark.createDataFrame([(1,), (2,)], "week_end int")
    half = spark.createDataFrame([(1, 0.5)], "week_end int, n double")
    with pytest.raises(Exception, match="missing feature values"):
        joins.require_coverage(base, half, ["n"]).collect()
    twice = spark.createDataFrame([(1, 0.5), (2, 0.1), (2, 0.2)], "week_end int, n double")
    with pytest.raises(Exception, match="repeated key"):
        joins.require_coverage(base, twice, ["n"]).collect()
    assert joins.require_coverage(base, twice.where("n <> 0.2"), ["n"]).count() == 2


def test_a_grid_without_survivor_and_fallback_fails(spark):
    nothing = spark.createDataFrame([(None, None)], "recommended struct<K:int>, statistical struct<K:int>")
    with pytest.raises(Exception, match="no surviving candidate"):
        sel.choose_pipeline(nothing, None, "order").collect()


def sequences(spark, n=6, length=40, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, t, float(rng.normal(3 * ((t // 10) % 2), 1)), float(rng.normal())) for i in range(n) for t in range(length)]
    return hmm.to_sequences(spark.createDataFrame(rows, "entity int, week_end int, a double, b double"), ["entity"], "week_end", ["a", "b"])


def test_reported_likelihood_is_that_of_the_reported_parameters(spark):
    data = sequences(spark)
    fitted = hmm.fit(data, [hmm.Candidate("a", 2, 2), hmm.Candidate("b", 2, 2, "full")], iterations=4)
    for name, (ll, _) in hmm.score(data, fitted).items():
        own = next(f for f in fitted if f.candidate.name == name)
        assert ll == pytest.approx(own.history[-1], abs=1e-8)


def test_a_failing_model_stops_no_other(spark, monkeypatch):
    data = sequences(spark)
    start = hmm.initial_params
    broken = lambda c, m: start(c, m) | ({"covars": -np.ones((2, 2, 2))} if c.name == "bad" else {})
    monkeypatch.setattr(hmm, "initial_params", broken)
    fitted = {f.candidate.name: f for f in hmm.fit(data, [hmm.Candidate("bad", 2, 2, "full"), hmm.Candidate("good", 2, 2)], iterations=3)}
    assert fitted["bad"].error and not fitted["good"].error
    table = hmm.results_table(spark, list(fitted.values()))
    assert {r.candidate: r.failed for r in table.collect()} == {"bad": True, "good": False}


def test_chunks_bound_the_padded_steps(monkeypatch):
    monkeypatch.setattr(kernels, "STEPS", 100)
    parts = kernels.chunks([[0]] * 30 + [[0] * 90] + [[0] * 3] * 40)
    assert sum(map(len, parts)) == 71 and all(len(p) == 1 or len(p) * max(map(len, p)) <= 100 for p in parts)


def test_labels_of_many_models(spark):
    data = sequences(spark)
    models = [hmm.Candidate(f"m{k}", k, 2, "diag", 7) for k in (2, 3)]
    labels = hmm.infer_many(data, ["entity"], hmm.fit(data, models, iterations=5), "int")
    assert labels.count() == 2 * 6 * 40 and labels.where("regime_viterbi is null or abs(aggregate(filtered, 0D, (a, b) -> a + b) - 1) > 1e-9").count() == 0


def test_regime_chain_end_to_end(spark):
    """Fits, filters, choice and labels agree with one another on the smallest given tables."""
    from weekpanel.plans import regimes

    d = "/root/testdata/sf0.01"
    table = {r.candidate: r for r in regimes.regime_pipeline_candidates(spark, d).collect()}
    assert len(table) == 24 and {r.K for r in table.values()} == {2, 3, 4}
    assert all(r.passes_hard_filters != (r.failed or any(r[f] for f in sel.FLAGS)) for r in table.values())
    choice = regimes.regime_pipeline_choice(spark, d).first()
    assert choice.role in ("project", "statistical", "fallback") and (choice.role == "fallback" or table[choice.candidate].passes_hard_filters)
