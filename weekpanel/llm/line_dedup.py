"""Operator 6: line dedup within one edit, by a deletion-neighbourhood join in DataFrame operations only.

A line is the text between line feeds without outer white space. Lines without a word are never removed. Of equal lines
the earliest stays (smallest doc_id, then place in the text). A line also goes if an earlier line lies within one edit (a
character put in, taken out or changed). ``dedup_lines`` takes lines of every length; ``filter_lines``, the stage of the
pipeline, takes lines of ``STAGE_CHARS`` characters or more for near copies (the earlier line may be a character shorter),
since short lines one character apart often say different things.

* Lines within one edit agree outside some segment of a partition, once lengths are taken into account. Hashes of what
  lies outside, first for 2 segments over all lines and then for ``SEGMENTS`` over those that matched, lose no pair and
  leave few lines and few places for the edit.
* These emit their deletion variants at those places as hashed keys: (place, variant) for a changed character, so that
  all lines with a key lie within one edit of each other, and the variant alone for a character put in, which meets the
  shorter line itself. Equal keys join every line with the earliest line of the key: a group is a minimum, never pairs.
* The edit distance of each such pair is verified.

Whether an earlier line is itself removed does not matter. Rows with equal id and text count as one document. Null texts
stay null, empty texts empty; a null id sorts first. Removed places of a document are a bit mask, so long documents
take linear time. ``filter_lines`` keeps all other columns. An empty table gives no rows. Tables are broadcast up to a checked number of rows and shuffled beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.llm.base import keep, small

STAGE_CHARS = 20
SEGMENTS = 16
BROADCAST_ROWS = 500_000
WHITE = " \t\r\x0b\x0c"


def _outside(line: Column, n: Column, parts: int) -> Column:
    """Array of (key, own, low, high): hashes of the line outside each segment, as a line of its own length and as the
    longer of two; low and high are the places of an edit in the segment."""

    def keys(own: bool) -> Column:
        m = n if own else n - 1

        def one(j):
            low, high = F.floor(m * j / parts).cast("int"), F.floor(m * (j + 1) / parts).cast("int")
            key = F.xxhash64(m, j, F.substr(line, F.lit(1), low), F.substr(line, n - (m - high) + 1))
            return F.struct(key.alias("key"), F.lit(own).alias("own"), low.alias("low"), high.alias("high"))

        return F.transform(F.array(*[F.lit(j) for j in range(parts)]), one)

    return F.concat(keys(True), keys(False))


def _matched(rows: DataFrame) -> DataFrame:
    """Keys that two different lines share, at least one of them with its own length."""
    own = F.when(F.col("own"), F.col("hash"))
    found = rows.groupBy("key").agg(F.min(own).alias("a"), F.max(own).alias("b"), F.bool_or(~F.col("own")).alias("longer"))
    return found.where("a <> b or (a is not null and longer)").select("key")


def _lines(docs: DataFrame) -> DataFrame:
    split = docs.select("doc_id", F.xxhash64("text").alias("doc"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return split.select("doc_id", "doc", "at", F.btrim("line", F.lit(WHITE)).alias("line")).where("line <> ''")


def removals(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(doc_id, doc, at, near) of the lines to remove; ``doc`` is the hash of the text."""
    lines = _lines(docs).withColumn("n", F.char_length("line"))
    # the earlier line of a pair may be a character shorter
    pair = F.when(F.col("n") >= min_chars - 1, _outside(F.col("line"), F.col("n"), 2))
    base = keep(lines.select("doc_id", "doc", "at", F.xxhash64("line").alias("hash"), F.xxhash64(F.lit(1), "line").alias("more"),
                             F.transform(pair, lambda p: p["key"]).alias("keys")))
    place = F.struct("doc_id", "doc", "at")
    groups = base.groupBy("hash", "more").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = F.struct("doc_id", "at") > F.col("first")
    exact = base.select("hash", "more", "doc_id", "doc", "at").join(small(groups, BROADCAST_ROWS), ["hash", "more"]).where(later)
    exact = exact.select("doc_id", "doc", "at", F.lit(False).alias("near"))

    # lines that agree with another outside a half
    halves = base.where("keys is not null").select("hash", F.posexplode("keys").alias("k", "key")).withColumn("own", F.col("k") < 2)
    matched = small(_matched(halves), BROADCAST_ROWS)
    near_by = base.where("keys is not null").select("doc_id", "doc", "at", F.explode("keys").alias("key")).join(matched, "key", "left_semi")
    near_by = near_by.select(F.col("doc_id").alias("_id"), F.col("doc").alias("_doc"), F.col("at").alias("_at")).distinct()
    here = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("doc") == F.col("_doc")) & (F.col("at") == F.col("_at"))
    texts = lines.join(small(near_by, BROADCAST_ROWS), here).groupBy("line", "n").agg(F.min(F.struct("doc_id", "at")).alias("first"))
    texts = keep(texts.withColumn("hash", F.xxhash64("line")).withColumn("more", F.xxhash64(F.lit(1), "line")))

    # narrowed to segments, then deletion variants at the places that are left
    parts = texts.select("hash", "line", "n", "first", F.inline(_outside(F.col("line"), F.col("n"), SEGMENTS)))
    parts = keep(parts.join(_matched(parts.select("key", "own", "hash")), "key", "left_semi"))
    line, n, at = F.col("line"), F.col("n"), F.col("i")
    places = parts.withColumn("i", F.explode(F.sequence(F.col("low"), F.least(F.col("high"), n - 1))))
    without = F.concat(F.substr(line, F.lit(1), at), F.substr(line, at + 2))
    changed = places.where("own").select("hash", "first", F.xxhash64(F.lit("changed"), n, at, without).alias("key"), F.lit(True).alias("whole"))
    longer = places.where("not own").select("hash", "first", F.xxhash64(F.lit("put in"), without).alias("key"), F.lit(False).alias("whole"))
    itself = parts.where("own").select("hash", "first", F.xxhash64(F.lit("put in"), line).alias("key"), F.lit(True).alias("whole"))
    variants = keep(changed.unionByName(longer).unionByName(itself).distinct())
    # a changed character: all lines of the key are whole; a character put in: one whole line, the others against it
    own, other = F.when(F.col("whole"), F.struct("first", "hash")), F.when(~F.col("whole"), F.struct("first", "hash"))
    heads = variants.groupBy("key").agg(F.min(own).alias("own"), F.min(other).alias("other"), F.count("*").alias("n")).where(
        "n > 1 and own is not null")
    lead = F.when(F.col("whole") & F.col("other").isNotNull(), F.least("own", "other")).otherwise(F.col("own"))
    tied = variants.join(heads, "key").select("hash", "first", lead.alias("lead")).where(F.col("lead.first") < F.col("first"))
    tied = tied.select("hash", F.col("lead.hash").alias("lead")).distinct()
    named = texts.select("hash", "more", "line", "n")
    checked = tied.join(named.where(F.col("n") >= min_chars), "hash").join(
        named.select(F.col("hash").alias("lead"), F.col("line").alias("other")), "lead")
    checked = checked.where(F.levenshtein("line", "other", 1) == 1).select("hash", "more").distinct()
    near = base.select("hash", "more", "doc_id", "doc", "at").join(small(checked, BROADCAST_ROWS), ["hash", "more"])
    return exact.unionByName(near.select("doc_id", "doc", "at", F.lit(True).alias("near")))


def _dedup(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, text and at most one further column _row of ``docs``, with what ``dedup_lines`` adds."""
    gone = removals(docs.select("doc_id", "text"), min_chars)
    bits = gone.groupBy("doc_id", "doc", F.floor(F.col("at") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at") % 64)).alias("bits"),
        F.countDistinct(F.when(F.col("near"), F.col("at"))).alias("n_near"))
    masks = bits.groupBy("doc_id", "doc").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("map"), F.max("word").alias("most"), F.sum("n_near").alias("n_near"))
    masks = masks.select(F.col("doc_id").alias("_id"), F.col("doc").alias("_doc"), "n_near", F.transform(
        F.sequence(F.lit(0), F.col("most")), lambda w: F.coalesce(F.element_at("map", w), F.lit(0).cast("long"))).alias("mask"))
    masks = small(masks, BROADCAST_ROWS, "2 + size(mask)")
    here = docs.withColumn("_hash", F.xxhash64("text"))
    joined = here.join(masks, (F.col("doc_id").eqNullSafe(F.col("_id"))) & (F.col("_hash") == F.col("_doc")), "left")
    lines = F.split("text", "\n")
    word = lambda i: F.coalesce(F.get(F.col("mask"), F.floor(i / 64).cast("int")), F.lit(0).cast("long"))
    stays = F.filter(lines, lambda x, i: F.call_function("shiftright", word(i), i % 64).bitwiseAND(F.lit(1)) == 0)
    out = joined.withColumn("_stays", F.when(F.col("mask").isNotNull(), stays).otherwise(lines))
    left = F.exists("_stays", lambda x: F.btrim(x, F.lit(WHITE)) != "")
    names = [c for c in docs.columns if c != "text"]
    # a mask exists only where a line with a word was removed
    return out.select(
        *names, F.array_join("_stays", "\n").alias("text"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(lines) - F.size("_stays"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.coalesce(F.col("mask").isNotNull() & ~left, F.lit(False)).alias("all_removed"))


def dedup_lines(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """doc_id, text without repeated lines, n_lines, n_removed, n_near, all_removed (had words, has none) of every row."""
    return _dedup(docs.select("doc_id", "text"), min_chars)


def filter_lines(docs: DataFrame, min_chars: int = STAGE_CHARS) -> DataFrame:
    """``docs`` with repeated lines removed from the text (and n_chars, if there, counted anew); documents that lose all
    their lines go."""
    out = _dedup(docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row")), min_chars).where("not all_removed")
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return out.select(*[
        (F.when(F.col("n_removed") > 0, new[c]).otherwise(F.col("_row")[c]) if c in new else F.col("_row")[c]).alias(c) for c in docs.columns])
