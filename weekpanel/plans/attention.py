"""Attention and attribution queries over the embeddings as model steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekpanel.operators import attention as at
from weekpanel.plans.market import rounded
from weekpanel.sources import given

LENGTH, REGIMES, FEATURES = 4, 3, ("price_a", "macro_a", "text_a", "prev_alloc_spy")
GROUPS = {"price_a": "price", "macro_a": "macro", "text_a": "text", "prev_alloc_spy": "prev_alloc"}
EPISODE = 52


def part(start: int, size: int) -> Column:
    return F.slice(F.col("v"), start + 1, size)


def steps(spark: SparkSession, d: str) -> DataFrame:
    """Each vector is one rollout step: 4x4 attention, regime posteriors, values,
    gradients and inputs, read from fixed positions."""
    v = given.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("step"), F.col("embedding").cast("array<double>").alias("v")
    )
    attention = F.array(*[at.normalize_1d(F.transform(part(4 * q, 4), F.abs)) for q in range(LENGTH)])
    regimes = F.array(*[at.argmax(part(16 + 3 * p, 3)) for p in range(LENGTH)])
    return at.require_shape(v, "v", 64).select(
        "step", attention.alias("attention"), regimes.alias("regimes"), at.argmax(part(53, 7)).alias("action_id"),
        part(53, 7).alias("q_values"), part(28, 16).alias("gradients"), part(44, 16).alias("inputs"),
        (F.col("v")[60] * 0.05).alias("weekly_return"),
    )


def weights(spark: SparkSession, d: str) -> DataFrame:
    return at.long_weights(steps(spark, d), LENGTH, ("regimes", "action_id"))


def sampled(spark: SparkSession, d: str) -> DataFrame:
    return steps(spark, d).withColumns({
        "attn": F.element_at("attention", -1),
        "sal": at.timestep_saliency(F.col("gradients"), LENGTH, len(FEATURES)),
    })


def attention_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(at.mean_attention(weights(spark, d)))


def attention_importance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(at.key_importance(weights(spark, d)))


def attention_regime_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(at.regime_pairs(weights(spark, d), REGIMES))


def attention_latest_regime(spark: SparkSession, d: str) -> DataFrame:
    return rounded(at.latest_by_regime(weights(spark, d), LENGTH - 1))


def attention_by_action(spark: SparkSession, d: str) -> DataFrame:
    return rounded(at.by_action(weights(spark, d)))


def attention_concentration(spark: SparkSession, d: str) -> DataFrame:
    return rounded(at.concentration(sampled(spark, d), "attn", LENGTH))


def attribution_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(at.attribution(steps(spark, d), FEATURES))


def attribution_groups(spark: SparkSession, d: str) -> DataFrame:
    return rounded(at.attribution_groups(at.attribution(steps(spark, d), FEATURES), GROUPS))


def attribution_top(spark: SparkSession, d: str) -> DataFrame:
    return rounded(at.top_features(at.attribution(steps(spark, d), FEATURES), LENGTH - 1, 3))


def saliency_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(at.saliency(steps(spark, d), FEATURES))


def saliency_importance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(at.feature_importance(at.saliency(steps(spark, d), FEATURES)))


def named_heads(spark: SparkSession, d: str) -> DataFrame:
    return rounded(at.head_means(at.named_heads(sampled(spark, d), "attn", "sal", LENGTH), LENGTH))


def head_focus(spark: SparkSession, d: str) -> DataFrame:
    return rounded(at.head_focus(at.named_heads(sampled(spark, d), "attn", "sal", LENGTH)))


def q_confidence(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("q_values")
    return rounded(steps(spark, d).select("step", "action_id", at.q_confidence(q).alias("confidence_gap"), F.array_max(q).alias("q_max")))


def explain_table(spark: SparkSession, d: str) -> DataFrame:
    """Steps in episodes of 52, so the running return stays inside an episode."""
    episodes = sampled(spark, d).withColumn("episode", F.floor(F.col("step") / EPISODE))
    return rounded(at.explain_table(episodes, ["episode"], LENGTH, "attn", "sal"))


QUERIES = {
    f.__name__: f
    for f in (
        attention_mean, attention_importance, attention_regime_pairs, attention_latest_regime, attention_by_action,
        attention_concentration, attribution_features, attribution_groups, attribution_top, saliency_features,
        saliency_importance, named_heads, head_focus, q_confidence, explain_table,
    )
}
