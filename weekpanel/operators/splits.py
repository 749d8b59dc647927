"""Split labels, column roles and split summaries."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.constants import (
    CLOSED_SPLITS,
    CONTIGUOUS_SPLITS,
    FEATURE_PRESETS,
    FINAL_SPLIT,
    METADATA_COLUMNS,
    MODEL_EXCLUDED_COLUMNS,
    PRICE_PREFIXES,
    REGIME_TOKENS,
    TARGET_COLUMNS,
    TEXT_TOKENS,
)
from weekpanel.functions.semantics import col

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
BLOCKS = ("price", "macro", "regime", "text")
ENDOGENOUS = (
    "prev_weight_spy", "prev_weight_tlt", "prev_weight_gld", "prev_weight_cash",
    "portfolio_drawdown", "portfolio_volatility",
)


def split_label(date: Column | str, bounds: Sequence[tuple[str, str]] = CONTIGUOUS_SPLITS, final: str = FINAL_SPLIT) -> Column:
    """Contiguous splits: the first whose end is on or after the date."""
    expr = F.lit(final)
    for name, end in reversed(bounds):
        expr = F.when(col(date) <= F.lit(end).cast("date"), F.lit(name)).otherwise(expr)
    return expr


def split_label_gapped(date: Column | str, bounds: Sequence[tuple[str, str, str]] = CLOSED_SPLITS) -> Column:
    """Closed intervals; dates between two of them have no split."""
    expr = F.lit(None).cast("string")
    for name, start, end in reversed(bounds):
        inside = col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        expr = F.when(inside, F.lit(name)).otherwise(expr)
    return expr


@dataclass(frozen=True)
class FeatureGroups:
    price: tuple[str, ...]
    macro: tuple[str, ...]
    regime: tuple[str, ...]
    text: tuple[str, ...]
    metadata: tuple[str, ...]
    targets: tuple[str, ...]

    def columns(self, blocks: Sequence[str] = BLOCKS, endogenous: bool = False) -> list[str]:
        named = [c for b in blocks for c in getattr(self, b)]
        return [*named, *ENDOGENOUS] if endogenous else named


def column_role(name: str) -> str:
    """Role by name; the order of the tests is part of the contract."""
    if name in TARGET_COLUMNS:
        return "targets"
    if name in METADATA_COLUMNS:
        return "metadata"
    lower = name.lower()
    if any(t in lower for t in TEXT_TOKENS):
        return "text"
    if any(t in lower for t in REGIME_TOKENS):
        return "regime"
    return "price" if name.startswith(PRICE_PREFIXES) else "macro"


def infer_feature_groups(columns: Iterable[str]) -> FeatureGroups:
    roles: dict[str, list[str]] = {r: [] for r in ("price", "macro", "regime", "text", "metadata", "targets")}
    for c in columns:
        roles[column_role(c)].append(c)
    return FeatureGroups(**{r: tuple(cs) for r, cs in roles.items()})


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [c for c, t in df.dtypes if t in NUMERIC and c not in skip]


def select_feature_columns(df: DataFrame, preset: str = "full") -> list[str]:
    if preset not in FEATURE_PRESETS:
        raise ValueError(f"unknown feature preset {preset}; expected one of {sorted(FEATURE_PRESETS)}")
    available = numeric_columns(df, MODEL_EXCLUDED_COLUMNS)
    allowed = FEATURE_PRESETS[preset]
    if allowed is None:
        return available
    missing = [c for c in allowed if c not in available]
    if missing:
        raise ValueError(f"preset {preset} misses columns {missing}")
    return list(allowed)


def state_matrix(df: DataFrame, columns: Sequence[str], name: str = "x") -> DataFrame:
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in columns]))


def rl_input_frame(df: DataFrame, groups: FeatureGroups, blocks: Sequence[str] = BLOCKS, targets: bool = True) -> DataFrame:
    """Week, split, the feature blocks in order and the four return columns."""
    returns = ["next_return_spy", "next_return_tlt", "next_return_gld", "cash_return"] if targets else []
    return df.select("week_end", "eval_split", *groups.columns(blocks), *returns)


def subset(df: DataFrame, splits: str | Sequence[str], split_col: str = "split") -> DataFrame:
    wanted = [splits] if isinstance(splits, str) else list(splits)
    return df.filter(F.col(split_col).isin(*wanted))


def split_summary(df: DataFrame, keys: Sequence[str] = ("split",), week_col: str = "week_end") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.min(week_col).alias("start_week"), F.max(week_col).alias("end_week")
    )


def feature_blocks(df: DataFrame, groups: FeatureGroups) -> DataFrame:
    """Per block: number of columns, five examples and the filled cells."""
    described = []
    for block in BLOCKS:
        cols = getattr(groups, block)
        filled = F.lit(0).cast("bigint")
        for c in cols:
            filled = filled + F.count(c)
        described.append(
            F.struct(
                F.lit(block).alias("block"), F.lit(len(cols)).alias("n_columns"),
                F.lit(", ".join(cols[:5]) if cols else "(none)").alias("example_columns"),
                filled.alias("filled_cells"),
            )
        )
    return df.agg(F.array(*described).alias("blocks")).select(F.inline("blocks"))
