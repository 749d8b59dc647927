"""Text expressions: cleaning, phrase and substring matching, scoring."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from weekpanel.constants import (
    ARTICLE_PATH_EXCLUSIONS,
    ARTICLE_QUERY_EXCLUSIONS,
    ARTICLE_SEARCH_PARAMS,
    IMPACT_KEYWORDS,
    NEGATIVE_KEYWORDS,
    POSITIVE_KEYWORDS,
    TOPIC_KEYWORDS,
)
from weekpanel.functions.semantics import col

# A character reference of HTML: decimal, hexadecimal or named.
REFERENCE = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{1,32};?)"
# Names that count without a semicolon, the longest first, from the standard table.
BARE_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
# What the numbers 128-159 stand for: they are read as Windows-1252.
WINDOWS = {n: bytes([n]).decode("cp1252") for n in range(0x80, 0xA0) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
SPACE = "[\\s\\u00A0]+"


def text(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def literal_map(values: dict[str, str]) -> Column:
    """A constant map; the optimizer folds it once per plan."""
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def _character(number: Column) -> Column:
    """The character of a code point, by the rules for numeric references."""
    point = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    wrong = number.isNull() | (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    none = (
        number.between(0x1, 0x8) | (number == 0xB) | number.between(0xE, 0x1F) | number.between(0x7F, 0x9F)
        | number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    )
    kept = number.isin(0x81, 0x8D, 0x8F, 0x90, 0x9D)
    windows = F.try_element_at(literal_map({str(n): ch for n, ch in WINDOWS.items()}), number.cast("string"))
    return F.when(wrong, "\ufffd").otherwise(F.coalesce(windows, F.when(none & ~kept, "").otherwise(point)))


def _resolved(reference: Column) -> Column:
    """What one character reference stands for; unknown names stay as they are."""
    name = F.substr(reference, F.lit(2))
    decimal = F.regexp_extract(reference, "^&#([0-9]+)", 1)
    hexadecimal = F.regexp_extract(reference, "^&#[xX]([0-9a-fA-F]+)", 1)
    number = F.when(hexadecimal != "", F.conv(F.right(hexadecimal, F.lit(12)), 16, 10)).otherwise(F.right(decimal, F.lit(12)))
    names = literal_map(html5)
    bare = F.regexp_extract(name, "^(" + "|".join(BARE_NAMES) + ")", 1)
    longest = F.when(bare != "", F.concat(F.try_element_at(names, bare), F.substr(name, F.length(bare) + 1)))
    return F.when(F.substr(name, F.lit(1), F.lit(1)) == "#", _character(number.try_cast("long"))).otherwise(
        F.coalesce(F.try_element_at(names, name), longest, reference))


def unescape(c: Column) -> Column:
    """All character references of HTML resolved in one pass."""
    between, references = F.split(c, REFERENCE), F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(0))
    resolved = F.concat(F.transform(references, _resolved), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(between, resolved, lambda a, b: F.concat(a, b)), "")
    return F.when(F.contains(c, F.lit("&")), joined).otherwise(c)


def clean_text(c: Column | str) -> Column:
    """Character references resolved, tags removed, white space collapsed."""
    return collapse(F.regexp_replace(unescape(text(c)), "<[^>]+>", " "))


def plain_clean(c: Column | str) -> Column:
    return collapse(text(c))


def normalize(*parts: Column | str) -> Column:
    """Lower case, '&' spelled out, everything but letters and digits a space."""
    joined = F.concat_ws(" ", *[F.lower(clean_text(p)) for p in parts])
    spelled = F.replace(joined, F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(spelled, "[^a-z0-9]+", " "))


def plain_normalize(c: Column | str) -> Column:
    # white space needs no step of its own: it is among what becomes one space
    return F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "))


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` computed once, and only where the whole is needed."""
    return F.transform(F.array(c), lambda v: use(v))[0]


def differs(c: Column, title: Column) -> Column:
    """Whether normalised texts differ. The normalised beginning of a text is the beginning of the normalised text, so one
    longer than the whole title decides."""
    def decided(t: Column) -> Column:
        start = F.substring(c, F.lit(1), F.length(title) + 100)
        return F.when(F.length(plain_normalize(start)) > F.length(t), True).otherwise(plain_normalize(c) != t)

    return bound(plain_normalize(title), decided)


def total(flags: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [f.cast("int") for f in flags], F.lit(0))


def keyword_hits(lowered: Column, keywords: Sequence[str]) -> Column:
    """Distinct keywords found as substrings."""
    return total([lowered.contains(k) for k in keywords])


def term_hits(normalized: Column, terms: Sequence[str]) -> Column:
    """Distinct terms found as whole phrases of normalised text."""
    padded = F.concat(F.lit(" "), normalized, F.lit(" "))
    return total([padded.contains(f" {t} ") for t in terms])


def any_term(normalized: Column, terms: Sequence[str]) -> Column:
    padded = F.concat(F.lit(" "), normalized, F.lit(" "))
    return reduce(lambda a, b: a | b, [padded.contains(f" {t} ") for t in terms], F.lit(False))


def sentiment_label(pos: Column, neg: Column) -> Column:
    return F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("neutral")


def sentiment_score(pos: Column, neg: Column) -> Column:
    return (pos - neg).cast("double") / F.greatest(F.lit(1), pos + neg)


def topic_label(hits: dict[str, Column]) -> Column:
    """Topic with most hits, earlier topics first on ties, 'other' without hits."""
    best = F.greatest(*hits.values())
    expr = F.when(best == 0, "other")
    for topic, h in hits.items():
        expr = expr.when(h == best, topic)
    return expr


def impact_level(hits: Column) -> Column:
    return F.when(hits >= 2, 3).when(hits == 1, 2).otherwise(1)


def lexicon_hits(lowered: Column) -> dict[str, Column]:
    """Hit-count columns of every lexicon, to be computed once per text."""
    return {
        "_pos": keyword_hits(lowered, POSITIVE_KEYWORDS),
        "_neg": keyword_hits(lowered, NEGATIVE_KEYWORDS),
        "_imp": keyword_hits(lowered, IMPACT_KEYWORDS),
        **{f"_topic_{t}": keyword_hits(lowered, k) for t, k in TOPIC_KEYWORDS.items()},
    }


def strip_publisher(c: Column | str, publisher: Column | str) -> Column:
    """Drop a trailing publisher name: after a dash or colon, then after a space."""
    p = plain_clean(publisher)

    def drop(t: Column, joint: str) -> Column:
        def without(head: Column) -> Column:
            return F.when(head.rlike(joint), F.trim(F.regexp_replace(head, joint, ""))).otherwise(t)

        ends = (p != "") & (F.length(t) > F.length(p)) & (F.lower(F.right(t, F.length(p))) == F.lower(p))
        return F.when(ends, bound(F.substring(t, F.lit(1), F.length(t) - F.length(p)), without)).otherwise(t)

    return bound(plain_clean(c), lambda t: bound(drop(t, "\\s*[-:\\u2013\\u2014]\\s*$"), lambda u: drop(u, "\\s+$")))


def choose_text(title: Column, description: Column, summary: Column) -> Column:
    """Summary unless it repeats the title, then description, then the first non-empty."""
    t, d, s = plain_normalize(title), plain_normalize(description), plain_normalize(summary)
    return (
        F.when((summary != "") & (s != t), summary)
        .when((description != "") & (d != t), description)
        .when(title != "", title)
        .when(description != "", description)
        .otherwise(summary)
    )


def boilerplate(c: Column) -> Column:
    n = normalize(c)
    has = lambda *words: reduce(lambda a, b: a & b, [n.contains(w) for w in words])
    return has("privacy", "policy") | has("terms", "conditions") | has("cookie", "policy")


def sentences(c: Column | str) -> Column:
    """Sentences of at least 40 characters that are not boilerplate."""
    # a function of one parameter: F.trim itself would get the position as the characters to trim
    parts = F.transform(F.split(clean_text(c), "(?<=[.!?])\\s+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: (F.length(s) >= 40) & ~boilerplate(s))


def first_sentences(c: Column | str, max_sentences: int = 3, max_chars: int = 900) -> Column:
    joined = F.array_join(F.slice(sentences(c), 1, max_sentences), " ")
    return F.substring(clean_text(joined), 1, max_chars)


def snippet(c: Column | str, max_chars: int = 900) -> Column:
    return F.substring(clean_text(c), 1, max_chars)


def title_tokens(c: Column | str, n: int = 6, shortest: int = 4) -> Column:
    words = F.filter(F.split(normalize(c), " "), lambda w: F.length(w) >= shortest)
    return F.slice(words, 1, n)


def url_part(url: Column, part: str) -> Column:
    """scheme, host, path or query of a URL ('' where absent)."""
    patterns = {
        "scheme": "^([A-Za-z][A-Za-z0-9+.-]*)://",
        "host": "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)",
        "path": "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)",
        "query": "^[^?#]*\\?([^#]*)",
    }
    return F.regexp_extract(url, patterns[part], 1)


def resolve_steps(segments: Column) -> Column:
    """Path segments folded with a stack: ``..`` takes the one before it (none at the root), ``.`` is skipped."""
    def step(stack, s):
        return F.when(s == "..", F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))).when(s == ".", stack).otherwise(F.concat(stack, F.array(s)))

    return F.aggregate(segments, F.array().cast("array<string>"), step)


def join_url(page: Column, href: Column) -> Column:
    """A link resolved against its page: absolute, scheme-relative, rooted, query, fragment or relative, with any number of
    steps up or down."""
    scheme, host, base = (url_part(page, p) for p in ("scheme", "host", "path"))
    path, rest = F.regexp_extract(href, "^[^?#]*", 0), F.regexp_replace(href, "^[^?#]*", "")
    # the page's folder, unless the link begins at the root; empty segments inside count for nothing
    folder = F.regexp_replace(base, "[^/]*$", "")
    segments = F.split(F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path)), "/")
    ends = F.element_at(segments, -1).isin(".", "..")
    kept = F.filter(segments, lambda s, i: (s != "") | (i == F.size(segments) - 1))
    folded = F.array_join(F.concat(resolve_steps(kept), F.when(ends, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))), "/")
    root = F.concat(scheme, F.lit("://"), host)
    return (
        F.when(url_part(href, "scheme") != "", href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(href == "", page)
        .when(path != "", F.concat(root, F.lit("/"), F.regexp_replace(folded, "^/", ""), rest))
        .when(F.startswith(href, F.lit("?")), F.concat(root, base, href))
        .otherwise(F.concat(F.regexp_replace(page, "#.*$", ""), href))
    )


def is_article_url(url: Column, host: Column) -> Column:
    """An absolute URL of the host that is not a listing, legal or search page."""
    path, query = F.lower(url_part(url, "path")), F.lower(url_part(url, "query"))
    has = lambda c, parts: reduce(lambda a, b: a | b, [c.contains(p) for p in parts])
    search = has(query, ARTICLE_SEARCH_PARAMS) & ~(query.contains("post_type=news") & query.contains("p="))
    bad = path.isin("", "/") | has(path, ARTICLE_PATH_EXCLUSIONS) | has(query, ARTICLE_QUERY_EXCLUSIONS) | search
    return (url_part(url, "scheme") != "") & (url_part(url, "host") == host) & ~bad


def try_dates(c: Column, *formats: str) -> Column:
    """First format that parses, as a timestamp; NULL when none does."""
    return F.coalesce(F.try_to_timestamp(c), *[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def rfc_date(c: Column | str) -> Column:
    """Dates of mail-style headers, e.g. 'Fri, 02 Jan 2015 08:00:00 GMT'."""
    day = F.regexp_extract(clean_text(c), "(\\d{1,2} [A-Za-z]{3} \\d{4})", 1)
    return F.try_to_timestamp(F.when(day != "", day), F.lit("d MMM yyyy")).cast("date")


def class_scores(scores: Column, source_text: Column) -> dict[str, Column]:
    """Label, its score and the compound of a class -> probability map.

    Blank text keeps a null label and score and zero class values.
    """
    blank = ~F.rlike(text(source_text), F.lit("[^\\s\\u00A0]"))
    value = lambda k: F.when(blank, F.lit(0.0)).otherwise(F.coalesce(F.element_at(scores, F.lit(k)), F.lit(0.0)))
    pos, neu, neg = value("positive"), value("neutral"), value("negative")
    best = F.array_max(F.map_values(scores))
    label = F.element_at(F.map_keys(F.map_filter(scores, lambda k, v: v == best)), 1)
    return {
        "finbert_label": F.when(~blank & (F.size(scores) > 0), label),
        "finbert_score": F.when(~blank & (F.size(scores) > 0), best),
        "finbert_positive": pos,
        "finbert_neutral": neu,
        "finbert_negative": neg,
        "finbert_compound": pos - neg,
    }
