"""Committed tables: idempotent refreshes, untouched parts, failed runs, upserts."""

import pytest
from pyspark.sql import functions as F

from weekpanel.sources import store

KIND = "week int, asset string, title string, summary string"


def frame(spark, rows):
    return spark.createDataFrame(rows, KIND)


def contents(spark, table):
    return sorted(map(tuple, store.read(spark, table).collect()), key=repr)


YEAR = 100


def year():
    return F.floor(F.col("week") / YEAR)


def test_second_run_changes_nothing_and_touched_parts_are_replaced(spark, tmp_path):
    table = f"file://{tmp_path}/t"
    rows = [(100 + i, "A", f"t{i}", None) for i in range(5)] + [(200 + i, "B", "x", "s") for i in range(3)]
    first = store.publish(frame(spark, rows), table, year())
    assert first.number == 1 and set(first.parts) == {"1", "2"} and contents(spark, table) == sorted(rows, key=repr)
    assert store.publish(frame(spark, rows[::-1]), table, year()) == first == store.last_commit(spark, table)
    second = store.publish(frame(spark, [(201, "B", "new", "s"), (305, None, None, "")]), table, year())
    assert second.number == 2 and second.parts["1"] == first.parts["1"] and second.parts["2"] != first.parts["2"]
    assert contents(spark, table) == sorted([*rows[:5], (201, "B", "new", "s"), (305, None, None, "")], key=repr)


def test_repeated_rows_count(spark, tmp_path):
    table = f"file://{tmp_path}/t"
    store.publish(frame(spark, [(1, "A", "t", "s")]), table, year())
    assert store.publish(frame(spark, [(1, "A", "t", "s")] * 2), table, year()).number == 2 and len(contents(spark, table)) == 2
    assert store.publish(frame(spark, []), table, year()).number == 2


def test_a_failed_run_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = f"file://{tmp_path}/t"
    old = [(1, "A", "t", "s")]
    store.publish(frame(spark, old), table, year())

    def lost(*args):
        (tmp_path / "t/commits/commit=2").mkdir()  # as a writer that ended before its file was in place
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lost)
        with pytest.raises(RuntimeError, match="lost"):
            store.publish(frame(spark, [(1, "A", "other", "s")]), table, year())
    assert contents(spark, table) == old and store.last_commit(spark, table).number == 1
    assert store.publish(frame(spark, [(1, "A", "other", "s")]), table, year()).number == 3
    assert contents(spark, table) == [(1, "A", "other", "s")]


def test_upsert_reads_and_replaces_touched_parts_only(spark, tmp_path):
    table = f"file://{tmp_path}/t"
    store.publish(frame(spark, [(101, "A", "old", "kept"), (102, "A", "old", "gone"), (103, "C", "stays", "s"), (201, "A", "far", "s")]), table, year())
    before = store.last_commit(spark, table)
    new = frame(spark, [(101, "A", "", "new"), (102, "A", "new", "newer"), (104, "D", "added", None), (301, "E", "year", "s")])
    after = store.upsert(new, table, ["week", "asset"], year())
    assert contents(spark, table) == sorted([(101, "A", "old", "kept"), (102, "A", "new", "newer"), (103, "C", "stays", "s"), (104, "D", "added", None),
                                             (201, "A", "far", "s"), (301, "E", "year", "s")], key=repr)
    assert after.number == 2 and after.parts["2"] == before.parts["2"]
    assert store.upsert(new, table, ["week", "asset"], year()).number == 2


def test_missing_tables_and_odd_parts(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        store.read(spark, f"file://{tmp_path}/none")
    with pytest.raises(ValueError, match="plain"):
        store.publish(frame(spark, [(1, "a/b", "t", "s")]), f"file://{tmp_path}/odd", F.col("asset"))


def test_the_stored_state_is_computed_once(spark, monkeypatch):
    from weekpanel.plans import storage

    slow = spark.range(10).groupBy((F.col("id") % 5).alias("week_end")).agg(F.max("id").alias("news_a"))
    names = ("regime_filtered", "regime_viterbi", "filtered_prob_regime_0", "filtered_prob_regime_1")
    monkeypatch.setattr(storage.model, "model_state_regimes", lambda *_: slow.withColumns({c: F.lit(0) for c in names}))
    written = []
    monkeypatch.setattr(storage.sinks, "write_pipeline", lambda *tables: written.extend(tables[:3]) or (_ for _ in ()).throw(InterruptedError))
    with pytest.raises(InterruptedError):
        storage.stored_state(spark, "")
    assert len(written) == 3 and all("Aggregate" not in t._jdf.queryExecution().optimizedPlan().toString() for t in written)
