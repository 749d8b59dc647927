"""Descriptive statistics that stay distributed at any group size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekpanel.constants import CLIP_SIGMA
from weekpanel.functions.semantics import clip, correlation, ordered, ratio, so_far, whole, widest
from weekpanel.operators.moments import pair_moments
from weekpanel.session import broadcast_checked, cut_lineage


#: Rows up to which a table of percentiles or brackets is broadcast.
BROADCAST_ROWS = 200_000


def long_values(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, value) rows of the non-null values."""
    cast = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return cast.unpivot(list(keys), list(columns), "feature", "value").filter(F.col("value").isNotNull())


def _brackets(df: DataFrame, columns: Sequence[str], probs: Sequence[float], keys: Sequence[str], accuracy: int, margin: float) -> DataFrame:
    """(keys, feature, p, total, lo, hi): values between which the wanted ranks of every probability lie, from one mergeable
    sketch per column; groups of few rows take their whole range."""
    ends = [float(min(1.0, max(0.0, p + s * margin / accuracy))) for p in probs for s in (-1, 1)]
    rows = []
    for c in columns:
        v = F.col(c).cast("double")
        found, n = F.percentile_approx(v, ends, accuracy), F.count(v)
        few = n <= 2 * accuracy if margin < accuracy else F.lit(True)
        for k, p in enumerate(probs):
            rows.append(F.struct(
                F.lit(c).alias("feature"), F.lit(float(p)).alias("p"), n.alias("total"),
                F.when(few, F.min(v)).otherwise(F.get(found, F.lit(2 * k))).alias("lo"),
                F.when(few, F.max(v)).otherwise(F.get(found, F.lit(2 * k + 1))).alias("hi")))
    return df.groupBy(*keys).agg(F.array(*rows).alias("_b")).select(*keys, F.inline("_b")).where("total > 0")


def exact_percentiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], keys: Sequence[str] = (), slices: int | None = None,
    accuracy: int = 10_000,
) -> DataFrame:
    """Exact, linearly interpolated percentiles of arbitrarily large groups.

    A quantile sketch per column brackets each wanted rank; a second pass counts what lies below a bracket and keeps only
    the values inside, as counts per distinct value. These are range-partitioned into sorted slices, and only the slices
    that hold a wanted rank are ordered. No group is ever gathered in one task, and a hot value is one row. That every rank
    lies in its bracket is checked; brackets that miss one (which the sketch's bound rules out) are widened.
    """
    group, margin = [*keys, "feature", "p"], 4.0
    cells = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    while True:
        brackets = cut_lineage(_brackets(cells, columns, probs, keys, accuracy, margin))
        # tables of one row per key or bracket are broadcast up to a number of rows
        small = brackets.count() <= BROADCAST_ROWS
        rank = F.col("p") * (F.col("total") - 1)
        # one row per key holds the brackets of all its columns
        wide = brackets.groupBy(*keys).agg(*[
            F.max(F.when((F.col("feature") == c) & (F.col("p") == float(p)), F.col(e))).alias(f"_{e}{i}_{k}")
            for i, c in enumerate(columns) for k, p in enumerate(probs) for e in ("lo", "hi")])
        joined = _beside(cells, wide, keys, small)
        below = joined.groupBy(*keys).agg(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.lit(float(p)).alias("p"), F.count_if(F.col(c) < F.col(f"_lo{i}_{k}")).alias("below"),
                     F.count_if((F.col(c) >= F.col(f"_lo{i}_{k}")) & (F.col(c) <= F.col(f"_hi{i}_{k}"))).alias("inside"))
            for i, c in enumerate(columns) for k, p in enumerate(probs)]).alias("_c")).select(*keys, F.inline("_c"))
        placed = cut_lineage(_same(brackets, below, group).select(*group, "total", "below", "inside"))
        if not placed.where((F.floor(rank) < F.col("below")) | (F.ceil(rank) >= F.col("below") + F.col("inside"))).limit(1).count():
            break
        margin *= 16
    # a bracket of one value is the answer; the values inside the others are counted
    single = brackets.where("lo = hi").select(*group, F.col("lo").alias("value"))
    open_ = lambda i, k: (F.col(columns[i]) >= F.col(f"_lo{i}_{k}")) & (F.col(columns[i]) <= F.col(f"_hi{i}_{k}")) & (F.col(f"_lo{i}_{k}") < F.col(f"_hi{i}_{k}"))
    cases = [(i, k) for i in range(len(columns)) for k in range(len(probs))]
    inside = F.filter(F.array(*[
        F.when(open_(i, k), F.struct(F.lit(columns[i]).alias("feature"), F.lit(float(probs[k])).alias("p"), F.col(columns[i]).alias("value")))
        for i, k in cases]), lambda s: s.isNotNull())
    some = joined.where(reduce(lambda a, b: a | b, [open_(i, k) for i, k in cases]))
    counted = some.select(*keys, F.inline(inside)).groupBy(*group, "value").agg(F.count("*").alias("n"))
    ranged = counted.repartitionByRange(*([slices] if slices else []), *group, "value")
    # materialised: the slice of a row must not change between the passes below
    sliced = cut_lineage(ranged.withColumn("slice", F.spark_partition_id()))
    totals = sliced.groupBy(*group, "slice").agg(F.sum("n").alias("rows"))
    w = ordered(group, "slice")
    bounds = totals.select(*group, "slice", "rows", (F.sum("rows").over(so_far(w)) - F.col("rows")).alias("before"))
    bounds = _same(bounds, placed, group).select(*group, "slice", "rows", (F.col("before") + F.col("below")).alias("before"), "total")
    asked = bounds.withColumn("rank", F.explode(F.array(F.floor(rank), F.ceil(rank)))).where(
        (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("rows"))
    ).groupBy(*group, "slice").agg(F.max("before").alias("before"), F.max("total").alias("total"), F.collect_set("rank").alias("ranks"))
    inner = ordered([*group, "slice"], "value")
    # at most two slices per bracket
    located = _same(sliced, F.broadcast(asked) if small else asked, [*group, "slice"])
    located = located.withColumn("upto", F.col("before") + F.sum("n").over(so_far(inner)))
    hit = located.select(*group, "value", "n", "upto", "total", F.explode("ranks").alias("rank")).where(
        (F.col("rank") >= F.col("upto") - F.col("n")) & (F.col("rank") < F.col("upto")))
    low, high = F.min("value"), F.max("value")
    weight = F.max(rank - F.floor(rank))
    return hit.groupBy(*group).agg((low + (high - low) * weight).alias("value")).unionByName(single)


def _same(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join on columns of which missing values are equal; other columns must differ in name."""
    other = right.withColumnsRenamed({c: f"_same_{c}" for c in on})
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_same_{c}")) for c in on])
    return left.join(other, match).drop(*[f"_same_{c}" for c in on])


def _beside(rows: DataFrame, table: DataFrame, keys: Sequence[str], small: bool) -> DataFrame:
    """Rows with the columns of their key's row in ``table`` (of one row without keys), which is broadcast if ``small``."""
    if not keys:
        only = table.first()
        return rows.withColumns({c: F.lit(only[c] if only else None).cast("double") for c in table.columns})
    return _same(rows, F.broadcast(table) if small else table, keys)


def percentile_columns(long: DataFrame, probs: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """Wide layout: one column per named probability."""
    picks = [F.max(F.when(F.col("p") == float(p), F.col("value"))).alias(n) for n, p in probs.items()]
    return long.groupBy(*keys, "feature").agg(*picks)


def moments(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, spread, range, biased skewness and excess kurtosis."""
    stats = lambda c: F.struct(
        F.lit(c).alias("feature"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"), F.max(c).alias("max"), (F.max(c) - F.min(c)).alias("range"),
        F.skewness(c).alias("skewness"), F.kurtosis(c).alias("kurtosis"),
    )
    return df.groupBy(*keys).agg(F.array(*[stats(c) for c in columns]).alias("_s")).select(*keys, F.inline("_s"))


QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def describe(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), probs: dict[str, float] = QUARTILES) -> DataFrame:
    quantiles = percentile_columns(exact_percentiles(df, columns, list(probs.values()), keys), probs, keys)
    return moments(df, columns, keys).join(quantiles, [*keys, "feature"])


def _fences(df: DataFrame, columns: Sequence[str], keys: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Rows (keys and columns as doubles) beside the named percentiles of each column of their key, ``{name}{i}``."""
    q = cut_lineage(exact_percentiles(df, columns, tuple(probs.values()), keys))
    wide = q.groupBy(*keys).agg(*[
        F.max(F.when((F.col("feature") == c) & (F.col("p") == float(p)), F.col("value"))).alias(f"_{name}{i}")
        for i, c in enumerate(columns) for name, p in probs.items()])
    return _beside(df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]), wide, keys, q.count() <= BROADCAST_ROWS)


def iqr_outliers(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Bounds 1.5 IQR outside the quartiles and the values beyond them."""
    rows, out = _fences(df, columns, keys, {"q1": 0.25, "q3": 0.75}), []
    for i, c in enumerate(columns):
        spread = 1.5 * (F.col(f"_q3{i}") - F.col(f"_q1{i}"))
        low, high = F.col(f"_q1{i}") - spread, F.col(f"_q3{i}") + spread
        n = F.count_if((F.col(c) < low) | (F.col(c) > high))
        out.append(F.struct(F.lit(c).alias("feature"), F.any_value(low).alias("lower_bound"), F.any_value(high).alias("upper_bound"),
                            n.alias("n_outliers"), (F.try_divide(n, F.count(c)) * 100).alias("outlier_pct")))
    return rows.groupBy(*keys).agg(F.array(*out).alias("_o")).select(*keys, F.inline("_o")).where("lower_bound is not null")


def box_stats(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Quartiles and whiskers (most extreme values within 1.5 IQR), no fliers."""
    rows, out = _fences(df, columns, keys, {"q1": 0.25, "median": 0.5, "q3": 0.75}), []
    for i, c in enumerate(columns):
        v, q1, q3 = F.col(c), F.col(f"_q1{i}"), F.col(f"_q3{i}")
        spread = 1.5 * (q3 - q1)
        low, high = F.min(F.when(v >= q1 - spread, v)), F.max(F.when(v <= q3 + spread, v))
        first = {n: F.any_value(F.col(f"_{n}{i}")) for n in ("q1", "median", "q3")}
        out.append(F.struct(
            F.lit(c).alias("feature"), *[e.alias(n) for n, e in first.items()], F.count(v).alias("n"),
            F.least(low, first["q1"]).alias("whisker_low"), F.greatest(high, first["q3"]).alias("whisker_high")))
    return rows.groupBy(*keys).agg(F.array(*out).alias("_o")).select(*keys, F.inline("_o")).where("q1 is not null")


def missingness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null count and percentage per column."""
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.count_if(F.col(c).isNull()).alias("n_missing"),
                 (ratio(F.count_if(F.col(c).isNull()), F.count("*")) * 100).alias("missing_pct"))
        for c in columns
    ])
    return df.agg(rows.alias("_m")).select(F.inline("_m"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of identical rows."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("_n")).agg(
        F.sum("_n").alias("n_rows"), F.sum(F.col("_n") - 1).alias("n_duplicates")
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), diagonal: bool = True) -> DataFrame:
    """Pairwise-complete correlations of all column pairs, from one block of moments per task; NULL where a side does not
    vary."""
    names = F.array(*[F.lit(c) for c in columns])
    found = pair_moments(df, columns, keys, diagonal)
    r = F.try_divide(F.col("ss_ab"), F.sqrt("ss_a") * F.sqrt("ss_b"))
    return found.select(*keys, F.get(names, F.col("i")).alias("feature_a"), F.get(names, F.col("j")).alias("feature_b"), r.alias("r"))


def high_correlations(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), threshold: float = 0.8) -> DataFrame:
    return correlation_matrix(df, columns, keys, diagonal=False).filter(F.abs("r") > threshold)


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 50, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins between minimum and maximum, the last one closed; density too."""
    group = [*keys, "feature"]
    long = long_values(df, columns, keys)
    ends = long.groupBy(*group).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.count("*").alias("_n"))
    span = F.col("_hi") - F.col("_lo")
    position = F.coalesce(F.try_divide(F.col("value") - F.col("_lo"), span), F.lit(0.0))
    bin_id = F.least(F.floor(position * bins), F.lit(bins - 1)).cast("int")
    counts = long.join(broadcast_checked(ends), group).groupBy(*group, "_lo", "_hi", "_n", bin_id.alias("bin")).agg(F.count("*").alias("n"))
    width = span / bins
    return counts.select(
        *group, "bin", "n", (F.col("_lo") + F.col("bin") * width).alias("bin_start"),
        F.try_divide(F.col("n") / F.col("_n"), width).alias("density"),
    )


def autocorrelation(df: DataFrame, keys: Sequence[str], value: str, order: str, lags: int = 20) -> DataFrame:
    """Sample autocorrelation at lags 0..n (full-sample mean and variance)."""
    w = ordered(keys, order)
    centred = df.withColumn("_c", F.col(value) - F.avg(value).over(whole(keys)))
    lagged = centred.withColumns({f"_l{k}": F.lag("_c", k).over(w) for k in range(1, lags + 1)}).withColumn("_l0", F.col("_c"))
    sums = lagged.groupBy(*keys).agg(
        F.array(*[F.struct(F.lit(k).alias("lag"), ratio(F.sum(F.col("_c") * F.col(f"_l{k}")), F.sum(F.col("_c") * F.col("_c"))).alias("acf"))
                  for k in range(lags + 1)]).alias("_a")
    )
    return sums.select(*keys, F.inline("_a"))


def lag_one(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str, threshold: float = 0.3) -> DataFrame:
    """Lag-one correlation per column and whether it passes the persistence filter."""
    w = ordered(keys, order)
    lagged = df.withColumns({f"_{c}": F.lag(c).over(w) for c in columns})
    rows = []
    for c in columns:
        both = F.col(c).isNotNull() & F.col(f"_{c}").isNotNull()
        r = F.when(F.count_if(both) >= 2, correlation(F.col(c), F.col(f"_{c}")))
        rows.append(F.struct(F.lit(c).alias("feature"), r.alias("acf_1")))
    out = lagged.groupBy(*keys).agg(F.array(*rows).alias("_r")).select(*keys, F.inline("_r"))
    return out.withColumn("persistent", F.coalesce(F.abs("acf_1") >= threshold, F.lit(False)))


def persistent_features(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str, threshold: float = 0.3) -> list[str]:
    """Columns whose lag-one correlation, over the pairs of all keys together, reaches the threshold in size; in the given
    order. One aggregate row reaches the driver."""
    w = ordered(keys, order)
    lagged = df.select(*columns, *[F.lag(c).over(w).alias(f"_{c}") for c in columns])
    r = lagged.agg(*[correlation(F.col(c), F.col(f"_{c}")).alias(c) for c in columns]).first()
    return [c for c in columns if r[c] is not None and abs(r[c]) >= threshold]


def standardize(df: DataFrame, columns: Sequence[str], fit: Column, clip_sigma: float | None = CLIP_SIGMA) -> DataFrame:
    """(x - mean) / population std of the fit rows; zero spread divides by one.

    The fit is one aggregate, used as a scalar subquery.
    """
    stats = df.filter(fit).agg(
        F.struct(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    )
    fitted = df.withColumn("_fit", stats.scalar())

    def scaled(c: str) -> Column:
        sd = F.col(f"_fit.s_{c}")
        z = (F.col(c) - F.col(f"_fit.m_{c}")) / F.when(sd > 0, sd).otherwise(1.0)
        return clip(z, -clip_sigma, clip_sigma) if clip_sigma else z

    return fitted.withColumns({c: scaled(c) for c in columns}).drop("_fit")


def scaling_checks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(
        widest(F.greatest, [F.abs(F.avg(c)) for c in columns]).alias("mean_abs_max"),
        widest(F.least, [F.stddev_pop(c) for c in columns]).alias("std_min"),
        widest(F.greatest, [F.stddev_pop(c) for c in columns]).alias("std_max"),
    )


def min_max(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min + 1e-12) per group; the bounds are a small aggregate."""
    ends = df.groupBy(*keys).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    scaled = (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-12)
    return df.join(broadcast_checked(ends), list(keys)).withColumn("scaled", scaled).drop("_lo", "_hi")


def cumulative(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    w = ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.filter(F.col(value).isNotNull()).withColumn("cumulative", F.sum(value).over(w))
