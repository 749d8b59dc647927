"""Table sinks: one parquet folder per dataset, CSV on request."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_tables(tables: dict[str, DataFrame], folder: str, csv: bool = False, partition_by: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Write every table below ``folder``; returns name -> path."""
    paths = {}
    for name, df in tables.items():
        path = f"{folder.rstrip('/')}/{name}{'.csv' if csv else ''}"  # readers tell the format by the suffix
        writer = df.write.mode("overwrite")
        if partition_by and name in partition_by:
            writer = writer.partitionBy(*partition_by[name])
        (writer.option("header", True).csv(path) if csv else writer.parquet(path))
        paths[name] = path
    return paths


def write_pipeline(news: DataFrame, regimes: DataFrame, state: DataFrame, folder: str) -> dict[str, str]:
    return write_tables({"news_features": news, "regimes_full": regimes, "merged_state": state}, folder)


def write_action_log(log: DataFrame, folder: str) -> dict[str, str]:
    """The action log in its exchange layout, partitioned by split."""
    out = log.select(
        "week_end", "eval_split", "action_id", "action_name", "reward", "portfolio_return", "turnover", "transaction_cost"
    )
    return write_tables({"action_log": out}, folder, partition_by={"action_log": ["eval_split"]})
