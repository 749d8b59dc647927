"""Dataset manifest: rows, columns and date range of each table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest(datasets: dict[str, DataFrame]) -> DataFrame:
    """One aggregate pass per dataset; the range spans all date-like columns."""
    rows = []
    for name, df in datasets.items():
        dates = [c for c in df.columns if "date" in c or "week_end" in c]
        low = [F.min(F.try_to_date(F.col(c).cast("string"))) for c in dates] or [F.lit(None).cast("date")]
        high = [F.max(F.try_to_date(F.col(c).cast("string"))) for c in dates] or [F.lit(None).cast("date")]
        rows.append(
            df.agg(
                F.count("*").alias("n_rows"),
                (F.least(*low) if len(low) > 1 else low[0]).alias("min_date"),
                (F.greatest(*high) if len(high) > 1 else high[0]).alias("max_date"),
            ).select(
                F.lit(name).alias("dataset_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"),
                "min_date", "max_date",
            )
        )
    return reduce(DataFrame.unionByName, rows)
