"""State sequences: runs, segments, transitions, profiles and naming.

Inputs are rows (keys..., order column, state).  One row per key and calendar
period is assumed, so a window over the keys is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.constants import MAX_STATES, SEMANTIC_LABELS, TREND_LABELS, TREND_LOOKBACK, TREND_NEUTRAL_Z
from weekpanel.functions.semantics import change, ordered, ratio, safe_ln, so_far, whole, zscore

WEEK = "week_end"


def with_runs(labels: DataFrame, keys: Sequence[str], order: str = WEEK, state: str = "state") -> DataFrame:
    """Adds ``starts_run`` (0/1) and ``run_id``; a null state is its own run."""
    w = ordered(keys, order)
    same = F.col(state).eqNullSafe(F.lag(state).over(w)) & (F.row_number().over(w) > 1)
    return labels.withColumn("starts_run", (~same).cast("int")).withColumn(
        "run_id", F.sum("starts_run").over(so_far(w)).cast("int")
    )


def run_lengths(labels: DataFrame, keys: Sequence[str], order: str = WEEK, state: str = "state") -> DataFrame:
    """Contiguous runs of one state; null states separate runs and are dropped."""
    return (
        with_runs(labels, keys, order, state)
        .filter(F.col(state).isNotNull())
        .groupBy(*keys, "run_id", state)
        .agg(F.min(order).alias("start_week"), F.max(order).alias("end_week"), F.count("*").alias("run_length"))
    )


def segments(labels: DataFrame, keys: Sequence[str], order: str = WEEK, state: str = "state") -> DataFrame:
    """Runs with the drawn end: the last date plus the median step of the calendar."""
    w = ordered(keys, order)
    steps = (
        labels.withColumn("_step", F.datediff(order, F.lag(order).over(w)))
        .groupBy(*keys)
        .agg(F.percentile("_step", F.lit(0.5)).alias("_median"))
    )
    days = F.when(F.col("_median") > 0, F.col("_median")).otherwise(7.0)
    return run_lengths(labels, keys, order, state).join(steps, list(keys)).select(
        *keys, "run_id", state, "start_week", "end_week", days.alias("step_days"),
        F.date_add("end_week", F.ceil(days).cast("int")).alias("drawn_end"),
    )


def state_diagnostics(labels: DataFrame, keys: Sequence[str], order: str = WEEK, state: str = "state") -> DataFrame:
    """Per key and state: weeks, share, runs, mean dwell, first run start, halves.

    Mean dwell is weeks over runs, so runs are counted and never materialised.
    """
    w = ordered(keys, order)
    runs = with_runs(labels, keys, order, state).withColumns(
        {"_pos": F.row_number().over(w) - 1, "_n": F.count("*").over(whole(keys))}
    )
    half = F.floor(F.col("_n") / 2)
    return (
        runs.groupBy(*keys, state)
        .agg(
            F.count("*").alias("n_weeks"),
            F.max("_n").alias("total_weeks"),
            F.sum("starts_run").alias("n_runs"),
            F.min(F.when(F.col("starts_run") == 1, F.col("_pos"))).alias("first_start"),
            F.max((F.col("_pos") < half).cast("int")).alias("in_early"),
            F.max((F.col("_pos") >= half).cast("int")).alias("in_late"),
        )
        .withColumn("pct", ratio("n_weeks", "total_weeks"))
        .withColumn("avg_duration_wks", ratio("n_weeks", "n_runs"))
    )


def wide_diagnostics(
    labels: DataFrame, keys: Sequence[str], n_states: Column, prefix: str, order: str = WEEK, state: str = "state"
) -> DataFrame:
    """One row per key: overall extremes and s0..s3 columns, null beyond ``n_states``.

    States that never occur count as zero share (they can trip the collapse
    filter) but not towards the minimum dwell.
    """
    diag = state_diagnostics(labels, keys, order, state)
    at = lambda k, c: F.max(F.when(F.col(state) == k, F.col(c)))
    aggs = []
    for k in range(MAX_STATES):
        aggs += [
            at(k, "pct").alias(f"s{k}_{prefix}pct"),
            at(k, "avg_duration_wks").alias(f"s{k}_{prefix}avg_dur_wks"),
            at(k, "n_runs").alias(f"s{k}_{prefix}n_runs"),
        ]
    wide = diag.groupBy(*keys).agg(
        F.count("*").cast("int").alias(f"{prefix}n_active_states"),
        F.min("pct").alias("_min"),
        F.max("pct").alias(f"{prefix}max_state_pct"),
        F.min("avg_duration_wks").alias(f"{prefix}min_avg_dur_wks"),
        *aggs,
    )
    within = lambda k, c: F.when(n_states > k, F.coalesce(F.col(c), F.lit(0))).alias(c)
    per_state = [
        within(k, f"s{k}_{prefix}{c}") for k in range(MAX_STATES) for c in ("pct", "avg_dur_wks", "n_runs")
    ]
    lowest = F.when(F.col(f"{prefix}n_active_states") < n_states, F.lit(0.0)).otherwise(F.col("_min"))
    return wide.select(
        *keys, f"{prefix}n_active_states", lowest.alias(f"{prefix}min_state_pct"),
        f"{prefix}max_state_pct", f"{prefix}min_avg_dur_wks", *per_state,
    )


def occupancy(labels: DataFrame, keys: Sequence[str], n_states: int, state: str = "state") -> DataFrame:
    """Weeks and share of each of ``n_states`` states, zero rows included."""
    counts = labels.groupBy(*keys).agg(
        F.count(state).alias("_n"), *[F.count_if(F.col(state) == k).alias(f"_{k}") for k in range(n_states)]
    )
    rows = F.array(
        *[
            F.struct(F.lit(k).alias(state), F.col(f"_{k}").alias("n_weeks"), ratio(f"_{k}", "_n").alias("pct"))
            for k in range(n_states)
        ]
    )
    return counts.select(*keys, F.inline(rows))


def transition_matrix(
    labels: DataFrame, keys: Sequence[str], n_states: int, order: str = WEEK, state: str = "state"
) -> DataFrame:
    """Row-normalised empirical transitions on the full K x K grid; empty rows are 0."""
    pairs = labels.withColumn("_to", F.lead(state).over(ordered(keys, order)))
    cells = [(i, j) for i in range(n_states) for j in range(n_states)]
    counts = pairs.groupBy(*keys).agg(
        *[F.count_if((F.col(state) == i) & (F.col("_to") == j)).alias(f"_{i}_{j}") for i, j in cells]
    )
    total = {i: sum((F.col(f"_{i}_{j}") for j in range(n_states)), F.lit(0)) for i in range(n_states)}
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("from_state"), F.lit(j).alias("to_state"), F.col(f"_{i}_{j}").alias("n"),
                F.coalesce(ratio(f"_{i}_{j}", total[i]), F.lit(0.0)).alias("probability"),
            )
            for i, j in cells
        ]
    )
    return counts.select(*keys, F.inline(rows))


def regime_summary(
    rows: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str = WEEK, state: str = "state"
) -> DataFrame:
    """Weeks, column means and mean dwell per state."""
    runs = with_runs(rows, keys, order, state)
    return runs.groupBy(*keys, state).agg(
        F.count("*").alias("n_weeks"),
        *[F.avg(c).alias(c) for c in columns],
        ratio(F.count("*"), F.sum("starts_run")).alias("avg_duration_wks"),
    )


def conditional_share(rows: DataFrame, given: str, outcome: str) -> DataFrame:
    """P(outcome | given): counts first, then shares over the small count table."""
    counts = rows.groupBy(given, outcome).agg(F.count("*").alias("n"))
    total = F.sum("n").over(whole([given]))
    return counts.withColumn("share", F.col("n") / (total + 1e-12))


def value_shares(rows: DataFrame, column: str, members: Sequence, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and shares of a column over a fixed vocabulary, absent members as 0."""
    counts = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"), *[F.count_if(F.col(column) == m).alias(f"_{i}") for i, m in enumerate(members)]
    )
    listed = F.array(
        *[
            F.struct(F.lit(m).alias(column), F.col(f"_{i}").alias("n"), ratio(f"_{i}", "_n").alias("share"))
            for i, m in enumerate(members)
        ]
    )
    return counts.select(*keys, F.inline(listed))


def regime_zprofile(rows: DataFrame, columns: Sequence[str], state: str = "state") -> DataFrame:
    """(state mean - global mean) / global std for every feature.

    A single rollup gives the state rows and the global row; everything after
    it works on (states + 1) x features rows.
    """
    rolled = rows.rollup(state).agg(
        F.grouping(state).alias("_global"),
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns],
    )
    long = rolled.select(
        state, "_global",
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(f"_m_{c}").alias("_mean"), F.col(f"_s_{c}").alias("_sd"))
            for c in columns
        ])),
    )
    over = whole(["feature"])
    g = lambda c: F.max(F.when(F.col("_global") == 1, F.col(c))).over(over)
    z = long.select(state, "feature", "_global", ratio(F.col("_mean") - g("_mean"), g("_sd")).alias("z"))
    return z.filter("_global = 0").drop("_global")


def top_drivers(zprofile: DataFrame, state: str = "state") -> DataFrame:
    """The feature with the largest |z| per state and its direction."""
    key = F.struct(F.abs("z"), "feature")
    best = zprofile.groupBy(state).agg(
        F.max_by("feature", key).alias("feature"), F.max_by("z", key).alias("z")
    )
    return best.withColumn("direction", F.when(F.col("z") > 0, "HIGH").otherwise("LOW"))


def trend_labels(
    rows: DataFrame, keys: Sequence[str], price: str, order: str = WEEK,
    lookback: int = TREND_LOOKBACK, neutral: float = TREND_NEUTRAL_Z,
) -> DataFrame:
    """Price trend: z-score of the trailing log change, cut at +/- ``neutral``."""
    w = ordered(keys, order)
    momentum = rows.withColumn("_m", change(safe_ln(price), lookback, w))
    scored = momentum.withColumn("trend_score", zscore("_m", whole(keys)))
    score = F.col("trend_score")
    rank = F.when(score <= -neutral, 0).when(score < neutral, 1).when(score >= neutral, 2)
    name = F.when(score <= -neutral, TREND_LABELS[0]).when(score < neutral, TREND_LABELS[1]).when(score >= neutral, TREND_LABELS[2])
    return scored.withColumns({"trend_rank": rank, "trend_name": name}).drop("_m")


def regime_names(
    rows: DataFrame, keys: Sequence[str], n_states: int, reward: str, risks: Sequence[str],
    calibrate: Column, state: str = "state",
) -> DataFrame:
    """States ranked from worst to best by (return z - mean risk z) and named.

    Means come from the calibration rows; a state absent there falls back to
    its full-sample means, and to zeros when it occurs nowhere.
    """
    columns = [reward, *risks]
    aggs = []
    for k in range(n_states):
        here = F.col(state) == k
        for c in columns:
            aggs.append(F.avg(F.when(here & calibrate, F.col(c))).alias(f"_fit_{k}_{c}"))
            aggs.append(F.avg(F.when(here, F.col(c))).alias(f"_all_{k}_{c}"))
    wide = rows.groupBy(*keys).agg(*aggs)

    def cell(k: int, c: str) -> Column:
        absent = sum((F.col(f"_fit_{k}_{x}").isNotNull().cast("int") for x in columns), F.lit(0)) == 0
        return F.when(absent, F.col(f"_all_{k}_{c}")).otherwise(F.col(f"_fit_{k}_{c}"))

    grid = wide.select(
        *keys,
        F.inline(F.array(*[
            F.struct(F.lit(k).alias(state), *[cell(k, c).alias(c) for c in columns]) for k in range(n_states)
        ])),
    )
    over = whole(keys)
    missing = F.max((F.coalesce(*columns).isNull()).cast("int")).over(over)
    filled = grid.withColumns({c: F.when(missing == 1, F.coalesce(c, F.lit(0.0))).otherwise(F.col(c)) for c in columns})
    risk = [zscore(c, over) for c in risks]
    present = sum((z.isNotNull().cast("int") for z in risk), F.lit(0))
    mean_risk = ratio(sum((F.coalesce(z, F.lit(0.0)) for z in risk), F.lit(0.0)), present)
    scored = filled.select(*keys, state, (zscore(reward, over) - mean_risk).alias("semantic_score"))
    names = SEMANTIC_LABELS.get(n_states) or tuple(f"Regime {i + 1}" for i in range(n_states))
    rank = F.row_number().over(ordered(keys, F.asc_nulls_last("semantic_score"), state)) - 1
    return scored.withColumn("regime_rank", rank).withColumn(
        "regime_name", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("regime_rank") + 1)
    )
