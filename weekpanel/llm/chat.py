"""Operator 9: chat formatting, in DataFrame operations only.

A declarative template names the control strings, the roles whose text carries loss and the transitions of a finite-state
machine over roles. One conversation becomes an array of text segments with a loss flag each; their concatenation is the
formatted text. Control strings inside a text or role are escaped: ``&`` becomes ``&amp;`` and the opening ``<|`` becomes
``&lt;|`` (in a role, a line feed becomes ``&#10;``), so every control string in the output is the template's own.

Rows are ordered by (turn, role, text); repeated rows stay separate turns. A null text or role is empty. An order that
the machine rejects is still formatted, with ``valid`` false and the number of the first rejected turn. A row without
conversation id forms its own group (null). Other columns are ignored; an empty table gives no rows. One conversation is
one output record, so its text is held by one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATE = {
    "open": "<|im_start|>",
    "after_role": "\n",
    "close": "<|im_end|>\n",
    "loss": ["assistant"],
    "start": "start",
    "accept": ["assistant"],
    "next": {
        "start": ["system", "user"],
        "system": ["user"],
        "user": ["assistant"],
        "assistant": ["user", "tool"],
        "tool": ["assistant", "tool"],
    },
}


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def format_chat(rows: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """conv_id, segments (array of text, loss), formatted, valid, first_bad (turn index or null)."""
    clean = rows.select(
        "conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"),
                            F.coalesce("text", F.lit("")).alias("text")).alias("row"))
    turns = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, after in template["next"].items() for b in after])
    state = F.struct(F.lit(template["start"]).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(acc, t):
        fits = F.array_contains(allowed, F.concat(acc["state"], F.lit(">"), t["role"]))
        return F.struct(t["role"].alias("state"), (acc["at"] + 1).alias("at"),
                        F.coalesce(acc["bad"], F.when(~fits, acc["at"])).alias("bad"))

    def segments(t):
        return F.array(
            F.struct(F.concat(F.lit(template["open"]), escape_role(t["role"]), F.lit(template["after_role"])).alias("text"),
                     F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), t["role"].isin(template["loss"]).alias("loss")),
            F.struct(F.lit(template["close"]).alias("text"), F.lit(False).alias("loss")),
        )

    out = turns.select("conv_id", F.aggregate("turns", state, step).alias("end"),
                       F.flatten(F.transform("turns", segments)).alias("segments"))
    accepts = F.col("end.state").isin(template["accept"])
    return out.select(
        "conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("end.bad").isNull() & accepts).alias("valid"), F.col("end.bad").alias("first_bad"))


def parse_chat(formatted: Column, template: dict = TEMPLATE) -> Column:
    """Array of (role, text), read from the formatted text alone."""
    mark = reduce(lambda s, c: s.replace(c, "\\" + c), "|", template["open"])
    parts = F.filter(F.split(formatted, mark), lambda p, i: i > 0)

    def turn(p):
        head = F.substring_index(p, template["after_role"], 1)
        body = F.substr(p, F.char_length(head) + len(template["after_role"]) + 1)
        body = F.substr(body, F.lit(1), F.char_length(body) - len(template["close"]))
        return F.struct(unescape_role(head).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def digest(out: DataFrame) -> DataFrame:
    """The contract's columns, read back from ``format_chat``'s output."""
    said = out.withColumn("turns", parse_chat(F.col("formatted")))
    under = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return said.withColumn("under", under).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("under").cast("long").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "valid")
