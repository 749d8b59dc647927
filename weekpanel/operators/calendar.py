"""Week mapping, week spines and weekly resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.functions.semantics import col


def week_end(c: Column | str) -> Column:
    """The Friday on or after a date."""
    return F.next_day(F.date_sub(col(c).cast("date"), 1), "FRI")


def week_spine(df: DataFrame, keys: Sequence[str], date_col: str = "date") -> DataFrame:
    """Every week between the first and last date of each entity, gaps included."""
    bounds = df.groupBy(*keys).agg(
        F.min(week_end(date_col)).alias("_lo"), F.max(week_end(date_col)).alias("_hi")
    )
    return bounds.select(
        *keys, F.explode(F.expr("sequence(_lo, _hi, interval 7 days)")).alias("week_end")
    )


def last_valid(c: str, date_col: str = "date") -> Column:
    """Aggregate: the value at the latest date at which ``c`` is non-null."""
    return F.expr(f"max_by(`{c}`, if(`{c}` is not null, `{date_col}`, null))").alias(c)


def resample_weekly(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    date_col: str = "date",
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Weekly last non-null value per column; weeks without rows stay as nulls."""
    weekly = df.groupBy(*keys, week_end(date_col).alias("week_end")).agg(
        *[last_valid(c, date_col) for c in columns], *extra
    )
    return week_spine(df, keys, date_col).join(weekly, [*keys, "week_end"], "left")


def densify(df: DataFrame, keys: Sequence[str], entity: str, entities: Sequence[str], date_col: str = "date") -> DataFrame:
    """Every date of the union calendar for every listed entity (nulls where absent)."""
    spine = (
        df.select(*keys, date_col)
        .distinct()
        .withColumn(entity, F.explode(F.array(*[F.lit(e) for e in entities])))
    )
    return spine.join(df, [*keys, date_col, entity], "left")


def week_ends(df: DataFrame, start: str | None = None, end: str | None = None, week_col: str = "week_end") -> DataFrame:
    """The distinct weeks of a table inside a closed range."""
    weeks = df.select(F.col(week_col).cast("date").alias("week_end"))
    if start:
        weeks = weeks.filter(F.col("week_end") >= F.lit(start).cast("date"))
    if end:
        weeks = weeks.filter(F.col("week_end") <= F.lit(end).cast("date"))
    return weeks.distinct()
