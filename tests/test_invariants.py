"""Invariants are measured by the run that writes, and each broken one is told."""

import pytest
from pyspark.sql import functions as F

from weekpanel.operators import invariants
from weekpanel.sources import store


def state(spark, rows):
    return spark.createDataFrame(rows, "week_end int, p0 double, p1 double, regime int, news double")


GOOD = [(1, 0.4, 0.6, 1, 0.0), (2, 1.0, 0.0, 0, 0.1), (3, 0.5, 0.5, 0, 0.2)]


def checks():
    return {"probabilities": invariants.sums_to_one(["p0", "p1"]), "regimes": F.col("regime").isin(0, 1), "news": invariants.complete(["news"])}


@pytest.mark.parametrize("broken,name", [((4, 0.5, 0.4, 1, 0.0), "probabilities"), ((4, None, 1.0, 1, 0.0), "probabilities"), ((4, 0.5, 0.5, 2, 0.0), "regimes"), ((4, 0.5, 0.5, None, 0.0), "regimes"), ((4, 0.5, 0.5, 1, None), "news")])
def test_each_broken_invariant_is_told(spark, tmp_path, broken, name):
    path = f"file://{tmp_path}/out"
    with pytest.raises(invariants.InvariantError) as failed:
        invariants.write_checked(state(spark, [*GOOD, broken]), checks(), lambda df: df.write.parquet(path))
    assert failed.value.counts == {name: 1}


def test_good_rows_pass_and_cost_no_job(spark, tmp_path):
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext

    def jobs(name, run):
        context.setJobGroup(name, name)
        run()
        context.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(name))

    df = state(spark, GOOD).repartition(2)
    plain = jobs("plain", lambda: df.write.parquet(f"file://{tmp_path}/a"))
    found = {}
    checked = jobs("checked", lambda: found.update(invariants.write_checked(df, checks(), lambda x: x.write.parquet(f"file://{tmp_path}/b"))))
    assert found == {"rows": 3, "probabilities": 0, "regimes": 0, "news": 0} and checked == plain


def test_merged_tables_keep_the_calendar(spark):
    base = spark.createDataFrame([(1,), (2,), (3,)], "week_end int")
    whole = spark.createDataFrame([(1, 0.5), (2, 0.1), (3, 0.3), (9, 1.0)], "week_end int, n double")
    cases = [(whole, None), (whole.where("week_end <> 2"), {"missing news": 1}), (whole.unionByName(whole.where("week_end = 1")), {"rows": 1})]
    for news, broken in cases:
        out, check = invariants.merged(base, {"news": (news, ["n"])})
        out.write.format("noop").mode("overwrite").save()
        if broken is None:
            assert check()["rows"] == 3
        else:
            with pytest.raises(invariants.InvariantError) as failed:
                check()
            assert failed.value.counts == broken


def test_a_refresh_that_breaks_an_invariant_writes_nothing(spark, tmp_path):
    table = f"file://{tmp_path}/t"
    store.publish(state(spark, GOOD), table, F.lit("all"), checks())
    with pytest.raises(invariants.InvariantError):
        store.publish(state(spark, [(1, 0.4, 0.4, 1, 0.0)]), table, F.lit("all"), checks())
    assert store.last_commit(spark, table).number == 1 and store.read(spark, table).count() == 3
