"""Backward as-of join: the latest right row at or before each left time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekpanel.functions.semantics import ordered, so_far
from weekpanel.operators.features import TRANSFORMS, SeriesMeta, macro_transforms, transform_columns


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    right_cols: Sequence[str],
    bucket: str = "YEAR",
    tie: str | None = None,
) -> DataFrame:
    """``left`` with the columns of the nearest earlier-or-equal ``right`` row.

    Both sides are unioned and the last right row is carried as a struct, so a
    NULL inside the nearest row stays NULL; ``tie`` picks the row (its maximum)
    among right rows of the same time.  The carry runs per (keys, time
    bucket); only the last right row of each bucket travels to later buckets.
    A key holding most rows is therefore spread over its buckets, and no
    inequality join is planned.
    """
    payload = F.struct(*[F.col(c) for c in right_cols])
    left_cols = [c for c in left.columns if c not in keys]
    rows_l = left.select(
        *keys, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"),
        F.struct(*[F.col(c) for c in left_cols]).alias("_left"),
        F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_right"),
        F.lit(None).cast(right.schema[tie or right_ts].dataType).alias("_tie"),
    )
    left_type = rows_l.schema["_left"].dataType
    rows_r = right.filter(F.col(right_ts).isNotNull()).select(
        *keys, F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"),
        F.lit(None).cast(left_type).alias("_left"), payload.alias("_right"),
        F.col(tie or right_ts).alias("_tie"),
    )
    both = rows_l.unionByName(rows_r).withColumn("_bucket", F.trunc("_ts", bucket))
    within = both.withColumn(
        "_near", F.last("_right", ignorenulls=True).over(so_far(ordered([*keys, "_bucket"], "_ts", "_side", "_tie")))
    ).filter(F.col("_side") == 1)

    # One row per bucket and key: the last right row, then the carry between buckets.
    edges = (
        both.filter(F.col("_side") == 0)
        .groupBy(*keys, "_bucket")
        .agg(F.max_by("_right", F.struct("_ts", "_tie")).alias("_edge"))
    )
    buckets = both.filter(F.col("_side") == 1).select(*keys, "_bucket").distinct()
    w = ordered(keys, "_bucket")
    carry = (
        buckets.join(edges, [*keys, "_bucket"], "full")
        .withColumn("_carry", F.last("_edge", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        .select(*keys, "_bucket", "_carry")
    )
    joined = within.join(carry, [*keys, "_bucket"], "left")
    return joined.select(
        *keys, "_left.*", *[F.coalesce("_near", "_carry").getField(c).alias(c) for c in right_cols]
    )


def macro_features_weekly(
    panel: DataFrame,
    weekly_calendar: DataFrame,
    metas: Sequence[SeriesMeta],
    keys: Sequence[str] = ("panel",),
) -> DataFrame:
    """Release-lagged macro features on the weekly calendar, one join for all series.

    Series of a table with the key columns belong to their key alone (changes and averages never cross keys); a table
    without them serves every key."""
    own = [k for k in keys if k in panel.columns]
    features = macro_transforms(panel, metas, own)
    suffixes = [TRANSFORMS[t][0] for t in transform_columns(metas)]
    weeks = weekly_calendar.select(*keys, "week_end", "week_last_trade_date").withColumn(
        "series_id", F.explode(F.array(*[F.lit(m.series_id) for m in metas]))
    )
    aligned = asof_backward(weeks, features, [*own, "series_id"], "week_end", "effective_date", suffixes, tie="date")
    picks = [
        F.max(F.when(F.col("series_id") == m.series_id, F.col(TRANSFORMS[t][0]))).alias(name)
        for m in metas
        for name, t in m.feature_columns().items()
    ]
    return (
        aligned.groupBy(*keys, "week_end", "week_last_trade_date")
        .agg(*picks)
        .withColumn("source", F.lit("release_lag_aligned_from_macro_panel"))
    )
