"""Stored tables that are refreshed by commits.

A table is a folder with ``data`` (immutable part folders) and ``commits`` (one single-file Parquet folder per commit that
maps every part to its folder, row count and checksum). A refresh writes the parts that differ from the last commit into a
new data folder and then the commit. Readers follow the last commit, so a refresh that fails before its commit leaves the
old version, one that changes nothing writes nothing, and the parts that it does not touch stay where they are. One writer
at a time; the folder that a failed commit leaves behind is passed over.

Only the part list (one row per part, bounded by the calendar) reaches the driver.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekpanel.operators import invariants, joins
from weekpanel.session import cut_lineage

PART = "_part"


@dataclass(frozen=True)
class Commit:
    """Number of the last commit (0: none yet) and, per part, folder, rows and checksum."""

    number: int
    parts: dict[str, tuple[str, int, int]]


def last_commit(spark: SparkSession, table: str) -> Commit:
    try:
        rows = spark.read.schema("part string, folder string, rows long, checksum long, commit int").parquet(f"{table}/commits")
        number = rows.agg(F.max("commit")).first()[0]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return Commit(0, {})
    found = rows.where(F.col("commit") == (number or 0)).collect()
    return Commit(number or 0, {r.part: (r.folder, r.rows, r.checksum) for r in found if r.part is not None})


def read(spark: SparkSession, table: str) -> DataFrame:
    """The table as of its last commit."""
    commit = last_commit(spark, table)
    if not commit.parts:
        raise FileNotFoundError(f"{table} has no commit")
    return spark.read.parquet(*[f"{table}/data/{folder}" for folder, _, _ in sorted(commit.parts.values())])


def _checksum(columns: Sequence[str]) -> Column:
    """A number that does not depend on the order of rows; equal rows count each."""
    return F.sum(F.pmod(F.xxhash64(*[F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in columns]), F.lit(1 << 40))).alias("checksum")


def publish(rows: DataFrame, table: str, part: Column, checks: dict[str, Column] | None = None) -> Commit:
    """Replaces the parts that ``rows`` hold (whole parts; ``part`` names a row's part, e.g. its year) and commits.

    Parts that equal the stored ones are not written; without any difference there is no new commit. Rows that break one of
    the ``checks``, counted while they are staged, fail the refresh before anything is written."""
    spark = rows.sparkSession
    tagged, seen = invariants.observed(rows.withColumn(PART, F.coalesce(part.cast("string"), F.lit("none"))), checks)
    staged = cut_lineage(tagged)
    invariants.verify(seen)
    found = staged.groupBy(PART).agg(F.count("*").alias("rows"), _checksum(sorted(rows.columns))).collect()
    old = last_commit(spark, table)
    changed = [r for r in found if old.parts.get(r[PART], (None, None, None))[1:] != (r.rows, r.checksum)]
    if not changed:
        return old
    odd = [r[PART] for r in changed if not re.fullmatch(r"[A-Za-z0-9_.-]+", r[PART])]
    if odd:
        raise ValueError(f"part names must be plain: {odd[:3]}")
    folder = uuid.uuid4().hex
    wanted = staged.where(F.col(PART).isin(*[r[PART] for r in changed]))
    wanted.repartition(PART).write.partitionBy(PART).parquet(f"{table}/data/{folder}")
    back = spark.read.schema(staged.schema).parquet(f"{table}/data/{folder}")
    written = {r[PART]: r["n"] for r in back.groupBy(PART).agg(F.count("*").alias("n")).collect()}
    if written != {r[PART]: r.rows for r in changed}:
        raise RuntimeError(f"{table}: the written parts do not hold the staged rows")
    parts = old.parts | {r[PART]: (f"{folder}/{PART}={r[PART]}", r.rows, r.checksum) for r in changed}
    return _commit(spark, table, Commit(old.number + 1, parts))


def _commit(spark: SparkSession, table: str, commit: Commit) -> Commit:
    rows = [(part, *rest) for part, rest in sorted(commit.parts.items())]
    listed = spark.createDataFrame(rows, "part string, folder string, rows long, checksum long")
    while True:
        try:  # one file, moved into place as a whole
            listed.coalesce(1).write.parquet(f"{table}/commits/commit={commit.number}")
            return commit
        except AnalysisException as taken:
            if taken.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            commit = Commit(commit.number + 1, commit.parts)


def upsert(new: DataFrame, table: str, keys: Sequence[str], part: Column) -> Commit:
    """Merges rows into the stored table: a new row wins over the stored one of its key unless it misses title or summary
    that the stored one has (``joins.upsert``); stored rows of other keys stay. Only the parts of new rows are read and
    replaced; ``part`` must depend on the keys alone."""
    spark = new.sparkSession
    commit = last_commit(spark, table)
    fresh = cut_lineage(new.withColumn(PART, F.coalesce(part.cast("string"), F.lit("none"))))
    touched = {r[PART] for r in fresh.select(PART).distinct().collect()}
    folders = sorted(folder for name, (folder, _, _) in commit.parts.items() if name in touched)
    if not folders:
        return publish(fresh.drop(PART), table, part)
    stored = spark.read.parquet(*[f"{table}/data/{f}" for f in folders]).select(*new.columns)
    others = stored.join(fresh.select(*keys), list(keys), "left_anti")
    return publish(joins.upsert(fresh.drop(PART), stored, list(keys)).select(*new.columns).unionByName(others), table, part)
