"""Invariants that are measured in the run that writes a result, not in a further one.

``observed`` attaches counts to a table; they are gathered by whatever action computes it, and ``verify`` reads them
afterwards.  ``merged`` joins feature tables to a calendar and observes both sides, so that a repeated key on a right side
shows as more rows than the calendar has, and a missing one as missing values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class InvariantError(ValueError):
    """Rows of a written result break an invariant; ``counts`` has the broken ones."""

    def __init__(self, counts: dict[str, int]):
        super().__init__("broken: " + ", ".join(f"{name} in {n} rows" for name, n in counts.items()))
        self.counts = counts


def observed(df: DataFrame, checks: dict[str, Column] | None = None) -> tuple[DataFrame, Observation]:
    """``df`` with the number of rows and, per check, the rows where it does not hold (missing counts as not)."""
    seen = Observation()
    counts = [F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in (checks or {}).items()]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts), seen


def sums_to_one(columns: Sequence[str], tolerance: float = 1e-6) -> Column:
    return F.abs(reduce(lambda a, b: a + b, [F.col(c) for c in columns]) - 1.0) <= tolerance


def complete(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def verify(seen: Observation, rows: Observation | int | None = None) -> dict[str, int]:
    """Counts of a table that an action has computed; broken checks, or another number of rows than ``rows``, fail."""
    found = dict(seen.get)
    broken = {name: n for name, n in found.items() if name != "rows" and n}
    expected = rows.get["rows"] if isinstance(rows, Observation) else rows
    if expected is not None and found["rows"] != expected:
        broken["rows"] = found["rows"] - expected
    if broken:
        raise InvariantError(broken)
    return found


def merged(base: DataFrame, parts: dict[str, tuple[DataFrame, Sequence[str]]], key: str = "week_end") -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """``base`` with the columns of every named part, and the function that checks it after it was computed: each row of the
    base once, no missing value in a part's columns."""
    out, of_base = observed(base)
    for df, columns in parts.values():
        out = out.join(df.select(key, *columns), key, "left")
    out, of_all = observed(out, {f"missing {name}": complete(columns) for name, (_, columns) in parts.items()})
    return out, lambda: verify(of_all, of_base)


def write_checked(df: DataFrame, checks: dict[str, Column], write: Callable[[DataFrame], object]) -> dict[str, int]:
    """Writes ``df`` and then checks what was written, without a further job; readers of a folder that is named only after
    the check see no broken result."""
    table, seen = observed(df, checks)
    write(table)
    return verify(seen)
