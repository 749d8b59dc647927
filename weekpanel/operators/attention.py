"""Attention and attribution analytics over per-step tables.

A step row carries arrays (weights, regimes, values); per-step figures are array
expressions and only tiny position/feature groups are aggregated, combined on
the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.functions.semantics import ordered, so_far, whole
from weekpanel.operators.joins import require
from weekpanel.operators.windows import time_token

EPS = 1e-12


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def normalize_1d(values: Column) -> Column:
    """Divide by the sum; uniform where the sum is not positive."""
    s, n = total(values), F.size(values)
    return F.when(s > 0, F.transform(values, lambda x: x / s)).otherwise(F.array_repeat(F.lit(1.0) / n, n))


def normalize_row(values: Column) -> Column:
    s = total(values) + EPS
    return F.transform(values, lambda x: x / s)


def entropy(values: Column) -> Column:
    return -F.aggregate(values, F.lit(0.0), lambda a, x: a + x * F.ln(x + EPS))


def argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def require_shape(steps: DataFrame, column: str, length: int) -> DataFrame:
    return require(steps, F.size(column) == length, f"{column} does not have {length} entries")


def long_weights(steps: DataFrame, n: int, keep: Sequence[str] = ()) -> DataFrame:
    """(step, query_pos, key_pos, weight) from an array of rows ``attention``."""
    rows = steps.select("step", *keep, F.posexplode("attention").alias("query_pos", "_row"))
    return rows.select("step", *keep, "query_pos", F.posexplode("_row").alias("key_pos", "weight"))


def mean_attention(weights: DataFrame) -> DataFrame:
    return weights.groupBy("query_pos", "key_pos").agg(F.avg("weight").alias("weight"))


def key_importance(weights: DataFrame) -> DataFrame:
    """Key-side importance: the mean over query positions of the mean matrix."""
    return mean_attention(weights).groupBy("key_pos").agg(F.avg("weight").alias("importance"))


def regime_pairs(weights: DataFrame, n_regimes: int) -> DataFrame:
    """Mean weight per (query regime, key regime) on the full grid, empty cells 0.

    ``weights`` carries the per-step regime array ``regimes``.
    """
    q, k = F.get("regimes", F.col("query_pos")), F.get("regimes", F.col("key_pos"))
    cells = [(i, j) for i in range(n_regimes) for j in range(n_regimes)]
    grid = F.array(*[
        F.struct(
            F.lit(i).alias("query_regime"), F.lit(j).alias("key_regime"),
            F.coalesce(F.avg(F.when((q == i) & (k == j), F.col("weight"))), F.lit(0.0)).alias("weight"),
        )
        for i, j in cells
    ])
    return weights.agg(grid.alias("_g")).select(F.inline("_g"))


def latest_by_regime(weights: DataFrame, latest: int) -> DataFrame:
    k = F.get("regimes", F.col("key_pos"))
    return weights.filter(F.col("query_pos") == latest).groupBy(k.alias("key_regime")).agg(F.avg("weight").alias("attention"))


def by_action(weights: DataFrame) -> DataFrame:
    return weights.groupBy("action_id", "key_pos").agg(F.avg("weight").alias("attention"))


def concentration(steps: DataFrame, column: str, n: int) -> DataFrame:
    """How far the latest query row is from uniform, and a verdict."""
    row = F.col(column)
    uniform = 1.0 / n
    per = steps.select(
        F.aggregate(row, F.lit(0.0), lambda a, x: a + F.abs(x - uniform)).alias("_l1"),
        (entropy(row) / F.ln(F.lit(float(n)))).alias("_ent"),
        F.array_max(row).alias("_top"), F.posexplode(row).alias("pos", "w"),
    )
    once = lambda c: F.avg(F.when(F.col("pos") == 0, F.col(c)))
    out = per.agg(
        F.min("w").alias("min_weight"), F.max("w").alias("max_weight"), F.avg("w").alias("mean_weight"),
        F.stddev_pop("w").alias("std_weight"), F.lit(uniform).alias("uniform_weight"),
        once("_l1").alias("avg_l1_to_uniform"), once("_ent").alias("avg_norm_entropy"), once("_top").alias("avg_top1_share"),
    )
    e = F.col("avg_norm_entropy")
    return out.withColumn("verdict", F.when(e > 0.95, "very diffuse").when(e > 0.85, "moderately diffuse").otherwise("concentrated"))


def attribution(steps: DataFrame, features: Sequence[str], gradients: str = "gradients", inputs: str = "inputs") -> DataFrame:
    """Mean |gradient x input| per (timestep, feature) of row-major arrays."""
    n = len(features)
    score = F.transform(F.arrays_zip(gradients, inputs), lambda p: F.abs(p[gradients] * p[inputs]))
    rows = steps.select(F.posexplode(score).alias("_i", "v"))
    names = F.array(*[F.lit(f) for f in features])
    return (
        rows.groupBy("_i").agg(F.avg("v").alias("attribution"))
        .select(F.floor(F.col("_i") / n).cast("int").alias("timestep_pos"), F.get(names, F.col("_i") % n).alias("feature"), "attribution")
    )


def attribution_groups(attributed: DataFrame, groups: dict[str, str]) -> DataFrame:
    """Sums per feature group and timestep, with the group's mean over timesteps."""
    table = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    per = attributed.groupBy("timestep_pos", table[F.col("feature")].alias("group")).agg(F.sum("attribution").alias("attribution"))
    return per.withColumn("group_mean", F.avg("attribution").over(whole(["group"])))


def top_features(attributed: DataFrame, last: int, k: int = 15) -> DataFrame:
    return attributed.filter(F.col("timestep_pos") == last).orderBy(F.desc("attribution"), "feature").limit(k)


def saliency(steps: DataFrame, features: Sequence[str], gradients: str = "gradients") -> DataFrame:
    """Per-sample normalised |gradient|, averaged per (timestep, feature)."""
    n = len(features)
    share = normalize_row(F.transform(F.col(gradients), F.abs))
    rows = steps.select(F.posexplode(share).alias("_i", "v"))
    names = F.array(*[F.lit(f) for f in features])
    return rows.groupBy("_i").agg(F.avg("v").alias("saliency")).select(
        F.floor(F.col("_i") / n).cast("int").alias("timestep_pos"), F.get(names, F.col("_i") % n).alias("feature"), "saliency"
    )


def feature_importance(salient: DataFrame) -> DataFrame:
    per = salient.groupBy("feature").agg(F.sum("saliency").alias("s")).withColumn("_all", F.lit(1))
    t, n = F.sum("s").over(whole(["_all"])), F.count("*").over(whole(["_all"]))
    return per.select("feature", F.when(t > 0, F.col("s") / t).otherwise(1.0 / n).alias("importance"))


def timestep_saliency(gradients: Column, n_steps: int, n_features: int) -> Column:
    """Normalised |gradient| mass per timestep of a row-major gradient array."""
    mass = F.array(*[total(F.transform(F.slice(gradients, t * n_features + 1, n_features), F.abs)) for t in range(n_steps)])
    return normalize_row(mass)


def named_heads(steps: DataFrame, attn: str, sal: str, n: int) -> DataFrame:
    """Trend, risk and local heads of each step (row-normalised blends)."""
    grid = lambda a, b: F.array(*[F.lit(a + (b - a) * i / (n - 1)) for i in range(n)])
    scaled = lambda c, kernel: F.zip_with(c, kernel, lambda x, y: x * y)
    a, s = normalize_row(F.col(attn)), normalize_row(F.col(sal))
    heads = {
        "trend": normalize_row(scaled(a, grid(1.30, 0.70))),
        "risk": normalize_row(scaled(s, grid(0.70, 1.35))),
        "local": normalize_row(F.zip_with(a, s, lambda x, y: x * 0.55 + y * 0.45)),
    }
    rows = F.array(*[F.struct(F.lit(name).alias("head"), w.alias("weights")) for name, w in heads.items()])
    return steps.select("step", F.inline(rows))


def head_means(heads: DataFrame, n: int) -> DataFrame:
    rows = heads.select("head", F.posexplode("weights").alias("pos", "w"))
    return rows.groupBy("head", "pos").agg(F.avg("w").alias("mean_weight")).withColumn("token", time_token(F.col("pos"), n))


def head_focus(heads: DataFrame) -> DataFrame:
    return heads.select("step", "head", F.element_at("weights", -1).alias("recent_focus"))


def q_confidence(values: Column) -> Column:
    """Best minus second-best value (0 for a single action)."""
    s = F.sort_array(values, asc=False)
    return F.when(F.size(values) > 1, F.get(s, F.lit(0)) - F.get(s, F.lit(1))).otherwise(0.0)


def explain_table(steps: DataFrame, keys: Sequence[str], n: int, attn: str, sal: str, value: str = "weekly_return") -> DataFrame:
    """Aligned table per episode: cumulative return, focus, entropy, dominant token, regime."""
    w = so_far(ordered(keys, "step"))
    lag = argmax(F.col(attn))
    return steps.select(
        *keys, "step", "action_id", value,
        (F.product(1 + F.col(value)).over(w) - 1).alias("cum_return"),
        F.element_at(attn, -1).alias("attn_recent"), F.element_at(sal, -1).alias("sal_recent"),
        entropy(F.col(attn)).alias("attn_entropy"), lag.alias("dominant_lag"), time_token(lag, n).alias("dominant_token"),
        F.concat(F.lit("Regime_"), F.element_at("regimes", -1).cast("string")).alias("regime_name"),
    )
