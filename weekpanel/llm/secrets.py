"""Operator 12: secret scan by corpus-wide ownership frequency, in DataFrame operations only.

Four patterns lay candidate spans over every whole text: assignments, access keys, hex strings (the base kinds) and mixed
tokens of letters and digits. The value of each candidate is hashed and counted over the corpus by distinct owners and
repositories. What more than ``MOST_OWNERS`` owners hold is a copied example; what at most so many hold, with enough
distinct characters, looks like a live credential of its owner. Base spans always stay; a mixed token outside them is added
as a span of kind ``owned`` if it is live-looking and owner-specific. Every span carries its counts in ``scan``'s output.

Positions are code points: a text is split at the matches of a pattern, and running sums of the lengths of gaps and matches
give starts and ends, as window sums over rows of one text. Counting goes by (value, owner, repository), then by (value,
owner), then by value, each combined before its shuffle. Counts come back to the candidates in two ways: values with more
than a fixed share of all candidates are at most ``HOT`` many and are broadcast, the rest are joined by a shuffle in which
no key is larger than that share.

Defined results: a null text counts as empty; null owners are one owner; repeated rows are scanned each on its own, but
count once per owner and repository; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekpanel.llm.base import keep

#: The base patterns (fixed values) and the shortest length of what they match: a match that is too short is dropped.
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
#: Runs of at least 16 of these characters; only those with a letter and a digit are candidates.
MIXED = "[A-Za-z0-9+/_=-]+"
KINDS = {"assign": (ASSIGN, 2, 6), "access": (ACCESS, 0, 20), "hex": (HEX, 0, 24), "owned": (MIXED, 0, 16)}
BASE = ("assign", "access", "hex")
MOST_OWNERS = 2
LEAST_CHARACTERS = 8
#: Values that may be broadcast: those with more than one in so many of all candidates, so fewer than this.
HOT = 20_000


def _pattern(kind: str) -> str:
    """Pattern that finds the same spans; where a match cannot change what follows, the least length is part of it."""
    pattern, group, least = KINDS[kind]
    if group:
        return pattern
    if kind == "owned":
        # a run is taken from its first character, which sees a letter and a digit in it
        return f"(?=[A-Za-z0-9+/_=-]{{{least}}})(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z]){pattern}"
    head = "AKIA" if kind == "access" else ""
    return f"{pattern[:-1]}{{{least - len(head)},}}"


def candidates(docs: DataFrame, key: str, text: str, owner: str, repository: Sequence[str]) -> DataFrame:
    """One row per text: id, doc_id, owner, repository and, per kind, gap lengths and what was found (null: nothing)."""
    body = F.col("body")
    rows = docs.select(
        F.col(key).alias("doc_id"), F.col(owner).cast("string").alias("owner"),
        F.struct(*[F.col(c).cast("string").alias(f"r{i}") for i, c in enumerate(repository)]).alias("repository"),
        F.coalesce(F.col(text), F.lit("")).alias("body"))
    found = []
    for kind, (_, group, _) in KINDS.items():
        pattern = F.lit(_pattern(kind))
        gaps = F.transform(F.split(body, _pattern(kind), -1), F.char_length)
        whole = F.regexp_extract_all(body, pattern, F.lit(0))
        value = F.regexp_extract_all(body, pattern, F.lit(group))
        found.append(F.when(F.regexp_like(body, pattern), F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value"))).alias(kind))
    # the number is written with the row, so it is the same for every reader
    return keep(rows.select("doc_id", "owner", "repository", *found).withColumn("id", F.monotonically_increasing_id()))


def _live(value: Column) -> Column:
    return F.size(F.array_distinct(F.split(value, ""))) >= LEAST_CHARACTERS


def spans(found: DataFrame) -> DataFrame:
    """id, doc_id, owner, repository, kind, first, last, value, valid: every match with its place; ``valid`` if it counts."""
    rows = None
    for rank, (kind, (_, _, least)) in enumerate(KINDS.items()):
        one = found.where(F.col(kind).isNotNull()).select(
            "id", "doc_id", "owner", "repository", F.lit(rank).alias("rank"), F.posexplode(kind).alias("at", "hit"), F.lit(least).alias("least"))
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.repartition("id").withColumn("size", F.coalesce(F.char_length("hit.whole"), F.lit(0)))
    run = Window.partitionBy("id", "rank").orderBy("at")
    placed = rows.withColumn("last", F.sum(F.col("hit.gap").cast("long") + F.col("size")).over(run))
    placed = placed.select(
        "id", "doc_id", "owner", "repository", "rank", (F.col("last") - F.col("size")).alias("first"), "last", F.col("hit.value").alias("value"),
        (F.char_length("hit.value") >= F.col("least")).alias("valid")).withColumn("valid", F.coalesce("valid", F.lit(False)))
    # a mixed token that shares a character with a base span is that span's own
    base = F.col("valid") & (F.col("rank") < len(BASE))
    before = Window.partitionBy("id").orderBy("first", "rank").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("id").orderBy(F.col("first").desc(), "rank").rowsBetween(Window.unboundedPreceding, 0)
    covered = F.coalesce(F.max(F.when(base, F.col("last"))).over(before) > F.col("first"), F.lit(False)) | F.coalesce(
        F.min(F.when(base, F.col("first"))).over(after) < F.col("last"), F.lit(False))
    return placed.withColumn("covered", covered).select(
        "id", "doc_id", "owner", "repository", "rank", "first", "last", F.when(F.col("valid"), F.sha2("value", 256)).alias("hash"),
        (F.col("valid") & (base | ~F.col("covered"))).alias("valid"), _live(F.col("value")).alias("live"))


def ownership(placed: DataFrame) -> DataFrame:
    """hash, found, repositories, owners: how often and how widely each candidate value occurs."""
    by_repository = placed.where("valid").groupBy("hash", "owner", "repository").agg(F.count("*").alias("found"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.sum("found").alias("found"), F.count("*").alias("repositories"))
    return by_owner.groupBy("hash").agg(
        F.sum("found").alias("found"), F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source",
         repository: Sequence[str] = ("source", "lang"), most_owners: int = MOST_OWNERS,
         most_hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(rows, spans). Rows: id and doc_id of every text. Spans: id, doc_id, rank, first, last, valid, found, repositories,
    owners, copied (an example held by many owners) and owned (owner-specific and live-looking)."""
    found = candidates(docs, key, text, owner, repository)
    placed = keep(spans(found))
    counts = keep(ownership(placed))
    total = counts.agg(F.sum("found")).first()[0] or 0
    # fewer than most_hot values can hold more than total / most_hot candidates each
    hot = F.col("found") > total / most_hot
    many = placed.where("hash is not null").join(F.broadcast(counts.where(hot)), "hash", "left")
    few = many.where("found is null").drop("found", "repositories", "owners").join(counts.where(~hot), "hash", "left")
    known = many.where("found is not null").unionByName(few).unionByName(placed.where("hash is null"), allowMissingColumns=True)
    copied = F.col("owners") > most_owners
    return found.select("id", "doc_id"), known.select(
        "id", "doc_id", "rank", "first", "last", "valid", "found", "repositories", "owners",
        (F.col("valid") & copied).alias("copied"), (F.col("valid") & F.col("live") & ~copied).alias("owned"))


def digest(rows: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, and n_owned and n_copied (spans of either class)."""
    base = F.col("valid") & (F.col("rank") < len(BASE))
    shown = base | (F.col("valid") & F.col("owned"))
    place = F.struct("first", "rank", "last")
    listed = known.groupBy("id", "doc_id").agg(
        *[F.count_if(base & (F.col("rank") == i)).alias(f"n_{kind}") for i, kind in enumerate(BASE)],
        F.sort_array(F.collect_list(F.when(base, place))).alias("base"), F.sort_array(F.collect_list(F.when(shown, place))).alias("all"),
        F.count_if(shown & F.col("owned")).alias("n_owned"), F.count_if(base & F.col("copied")).alias("n_copied"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def text(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["first"], s["last"])), ",")

    # a text without any match has no row in ``known``
    counts = ["n_assign", "n_access", "n_hex"]
    out = rows.join(listed.drop("doc_id"), "id", "left")
    return out.select(
        "doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.sha2(F.coalesce(text("base"), F.lit("")), 256).alias("base_sha256"), F.coalesce(text("all"), F.lit("")).alias("spans"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_owned", "n_copied")])
