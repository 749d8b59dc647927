"""Similarity of two short texts by matching blocks: a small helper for Arrow batches."""

from __future__ import annotations

import sys
from difflib import SequenceMatcher

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def ratio(a: str | None, b: str | None) -> float:
    """Twice the characters in matching blocks (the longest common block first, then left and right of it) over both
    lengths; 1 for two empty texts."""
    return SequenceMatcher(None, a or "", b or "").ratio()


def matching_ratio(a: Column, b: Column) -> Column:
    @F.pandas_udf(DoubleType())
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([ratio(x, y) for x, y in zip(left, right)], dtype=float)

    return run(a, b)
