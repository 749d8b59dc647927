"""Attention arithmetic on small steps; streams against their batch twins."""

import datetime as dt
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_stats_model import PARAMS, sequences
from weekpanel import schemas
from weekpanel.operators import attention as at
from weekpanel.operators import hmm
from weekpanel.operators import news as nw
from weekpanel.streaming.news import deduplicated, weekly_features_stream
from weekpanel.streaming.online_filter import online_filter, use_rocksdb

WEEK = lambda i: dt.date(2015, 1, 2) + dt.timedelta(days=7 * i)


def steps(spark):
    rows = [
        (0, [[0.5, 0.5], [0.2, 0.8]], [0, 1], 1, [1.0, 3.0, 2.0], [1.0, -1.0, 2.0, 0.0], [1.0, 2.0, 0.5, 9.0], 0.1),
        (1, [[1.0, 0.0], [0.6, 0.4]], [1, 1], 2, [1.0], [0.0, 0.0, 0.0, 0.0], [1.0, 1.0, 1.0, 1.0], -0.1),
    ]
    return spark.createDataFrame(rows, "step int, attention array<array<double>>, regimes array<int>, action_id int, q array<double>, gradients array<double>, inputs array<double>, weekly_return double")


def test_attention_tables(spark):
    w = at.long_weights(steps(spark), 2, ("regimes", "action_id"))
    mean = {(r.query_pos, r.key_pos): r.weight for r in at.mean_attention(w).collect()}
    assert mean == pytest.approx({(0, 0): 0.75, (0, 1): 0.25, (1, 0): 0.4, (1, 1): 0.6})
    assert {r.key_pos: r.importance for r in at.key_importance(w).collect()} == pytest.approx({0: 0.575, 1: 0.425})
    pairs = {(r.query_regime, r.key_regime): r.weight for r in at.regime_pairs(w, 3).collect()}
    assert len(pairs) == 9 and pairs[(0, 0)] == 0.5 and pairs[(2, 0)] == 0.0
    assert pairs[(1, 1)] == pytest.approx(np.mean([0.8, 1.0, 0.0, 0.6, 0.4]))
    assert {r.key_regime: r.attention for r in at.latest_by_regime(w, 1).collect()} == pytest.approx({0: 0.2, 1: np.mean([0.8, 0.6, 0.4])})
    assert at.by_action(w).count() == 4


def test_concentration_and_normalisation(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.5, 0.5],)], "a array<double>")
    r = at.concentration(df, "a", 2).first()
    assert r.avg_l1_to_uniform == pytest.approx(0.5) and r.avg_norm_entropy == pytest.approx(0.5) and r.avg_top1_share == 0.75 and r.verdict == "concentrated"
    assert r.std_weight == pytest.approx(np.std([1, 0, 0.5, 0.5]))
    zero = spark.createDataFrame([([0.0, 0.0],)], "a array<double>")
    assert zero.select(at.normalize_1d(F.col("a"))).first()[0] == [0.5, 0.5] and zero.select(at.normalize_row(F.col("a"))).first()[0] == [0.0, 0.0]
    with pytest.raises(Exception, match="does not have 3"):
        at.require_shape(df, "a", 3).collect()


def test_attribution_saliency_heads(spark):
    s = steps(spark)
    a = at.attribution(s, ("f", "g"))
    got = {(r.timestep_pos, r.feature): r.attribution for r in a.collect()}
    assert got == pytest.approx({(0, "f"): 0.5, (0, "g"): 1.0, (1, "f"): 0.5, (1, "g"): 0.0})
    groups = {(r.timestep_pos, r.group): (r.attribution, r.group_mean) for r in at.attribution_groups(a, {"f": "x", "g": "x"}).collect()}
    assert groups[(0, "x")] == pytest.approx((1.5, 1.0))
    assert [r.feature for r in at.top_features(a, 0, 1).collect()] == ["g"]
    sal = at.saliency(s, ("f", "g"))
    assert {r.feature: r.importance for r in at.feature_importance(sal).collect()} == pytest.approx({"f": 0.75, "g": 0.25})
    t = s.withColumns({"attn": F.element_at("attention", -1), "sal": at.timestep_saliency(F.col("gradients"), 2, 2)})
    heads = {(r.step, r.head): r.weights for r in at.named_heads(t, "attn", "sal", 2).collect()}
    trend = np.array([0.2, 0.8]) * [1.3, 0.7]
    np.testing.assert_allclose(heads[(0, "trend")], trend / trend.sum(), atol=1e-9)
    q = {r.step: r[1] for r in t.select("step", at.q_confidence(F.col("q"))).collect()}
    assert q == {0: 1.0, 1: 0.0}
    e = at.explain_table(t.withColumn("k", F.lit(1)), ["k"], 2, "attn", "sal").orderBy("step").collect()
    assert e[1].cum_return == pytest.approx(1.1 * 0.9 - 1) and e[0].dominant_token == "t-0" and e[0].regime_name == "Regime_1"


def run(stream, spark, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_weekly_stream_equals_batch(spark, tmp_path):
    base = dt.datetime(2015, 1, 1)
    rows = [("SPY", str(i), "STORY", "Fed rally" if i % 2 else "loss", None, base + dt.timedelta(hours=13 * i), "p", None, None, "SPY", i % 2) for i in range(60)]
    rows.append(("SPY", "end", "STORY", "x", None, base + dt.timedelta(days=90), "p", None, None, "", 0))
    df = spark.createDataFrame(rows, schemas.NEWS_EVENTS)
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schemas.NEWS_EVENTS).parquet(f"{tmp_path}/in")
    got = run(weekly_features_stream(source), spark, "weekly_out").orderBy("week_end").collect()
    want = nw.weekly_features(nw.enrich(df)).filter("week_end < date'2015-03-01'").select(*got[0].__fields__).orderBy("week_end").collect()
    assert len(got) == len(want) > 4
    for g, w in zip(got, want):
        assert g.week_end == w.week_end and g.headline_count == w.headline_count
        assert g.mean_sentiment_score == pytest.approx(w.mean_sentiment_score)


def test_stream_dedupe(spark, tmp_path):
    ts = dt.datetime(2015, 1, 1)
    rows = [("SPY", "1", "a", ts), ("SPY", "1", "b", ts), ("TLT", "1", "c", ts)]
    schema = "requested_symbol string, news_id string, title string, published_at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = run(deduplicated(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), spark, "dedupe_out")
    assert sorted(r.requested_symbol for r in out.collect()) == ["SPY", "TLT"]


def observations(spark, folder, parts):
    """One file per trigger, in the order of their names; rows of a file in any order."""
    schema = "entity string, t timestamp, x array<double>"
    for i, rows in enumerate(parts):
        path = f"{folder}/in/p{i}"
        if not os.path.exists(path):
            spark.createDataFrame(rows[::-1], schema).coalesce(1).write.parquet(path)
            time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")


def day(i):
    return dt.datetime.combine(WEEK(i), dt.time())


@pytest.fixture()
def typed_state(spark):
    use_rocksdb(spark)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_online_filter_equals_batch_over_triggers_and_a_restart(typed_state, tmp_path):
    spark = typed_state
    rng = np.random.default_rng(1)
    data = {"a": rng.normal(1, 1, (9, 2)), "b": rng.normal(0, 1, (5, 2)), "c": rng.normal(0, 1, (1, 2))}
    batch = {r.entity: np.array(r.filtered) for r in hmm.infer(sequences(spark, data), ["entity"], PARAMS).collect()}
    cut = [(0, 3), (3, 4), (4, 9)]
    parts = [[(k, day(i), list(map(float, r))) for k, x in data.items() for i, r in enumerate(x) if a <= i < b] for a, b in cut]
    out = f"{tmp_path}/out"

    def go(upto):
        stream = online_filter(observations(spark, tmp_path, parts[:upto]), PARAMS)
        q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").format("parquet").start(out)
        q.processAllAvailable()
        q.stop()

    go(2)
    go(3)  # a new query goes on from the checkpoint
    found = spark.read.parquet(out).orderBy("entity", "t").collect()
    for k in data:
        own = [r for r in found if r.entity == k]
        np.testing.assert_allclose(np.array([r.filtered for r in own]), batch[k], atol=1e-10)
        assert [r.regime for r in own] == [int(np.argmax(r.filtered)) for r in own]


def test_online_filter_goes_on_from_a_batch_run_and_leaves_out_late_rows(typed_state, tmp_path):
    spark = typed_state
    x = np.random.default_rng(2).normal(1, 1, (7, 2))
    batch = np.array(hmm.infer(sequences(spark, {"a": x}), ["entity"], PARAMS).first().filtered)
    initial = spark.createDataFrame([("a", batch[3].tolist(), day(3))], "entity string, posterior array<double>, t timestamp")
    rows = [("a", day(i), list(map(float, x[i]))) for i in (2, 4, 5, 6)]
    out = run(online_filter(observations(spark, tmp_path, [rows]), PARAMS, initial=initial), spark, "from_batch").orderBy("t").collect()
    assert [r.t for r in out] == [day(4), day(5), day(6)]
    np.testing.assert_allclose(np.array([r.filtered for r in out]), batch[4:], atol=1e-10)


def test_online_filter_drops_ended_sequences(typed_state, tmp_path):
    spark = typed_state
    x = np.random.default_rng(3).normal(1, 1, (4, 2))
    rows = lambda key, i, at: (key, day(at), list(map(float, x[i])))
    parts = [[rows("a", 0, 0), rows("b", 0, 0)], [rows("b", 1, 20)], [rows("b", 2, 21)], [rows("a", 3, 22), rows("b", 3, 22)]]
    out = run(online_filter(observations(spark, tmp_path, parts), PARAMS, idle="30 days"), spark, "ended").collect()
    fresh = np.array(hmm.infer(sequences(spark, {"a": x[3:]}), ["entity"], PARAMS).first().filtered)[0]
    found = {(r.entity, r.t): r.filtered for r in out}
    np.testing.assert_allclose(found["a", day(22)], fresh, atol=1e-10)  # a had ended: it starts anew
    whole = np.array(hmm.infer(sequences(spark, {"b": x}), ["entity"], PARAMS).first().filtered)
    assert len(found) == 6 and not np.allclose(found["b", day(22)], fresh) and whole.shape == (4, 2)
