"""Step functions on a grid: values, markers, versions and fills."""

import pytest
from pyspark.sql import functions as F

from driftline.operators import resample as R
from driftline.operators.rollup import rollup
from driftline.operators.timerange import TimeRange, missing, sort_and_merge


def dense(spark, rows, rng, schema="k string, epoch long, value double", **options):
    df = spark.createDataFrame(rows, schema)
    return [r["value"] for r in R.resample(df, rng, ["k"], **options).orderBy("epoch").collect()]


RNG = TimeRange(10, 50, 10)
FULL = "k string, epoch long, value double, marker string, version long"
T = "tombstone"


def full(*rows):
    return [("a", e, None if v is T else float(v), T if v is T else None, n) for e, v, n in rows]


def test_values_hold_until_the_next(spark):
    assert dense(spark, [("a", 5, 10.0), ("a", 20, 5.0), ("a", 40, 10.0)], RNG) == [10, 5, 5, 10]


def test_mean_is_weighted_by_time(spark):
    assert dense(spark, [("a", 10, 0.0), ("a", 15, 10.0)], RNG) == [5, 10, 10, 10]


@pytest.mark.parametrize(("rows", "expected"), [
    (full((10, 10, 1000), (20, T, 1000), (30, 5, 2000), (40, 10, 2000), (50, T, 2000)), [10, None, 5, 10]),
    (full((10, 10, 1000), (20, T, 1000), (20, 5, 2000), (40, 10, 2000), (50, T, 2000)), [10, 5, 5, 10]),
    (full((5, 10, 1000), (20, 5, 2000), (30, T, 1000), (40, 10, 2000), (50, T, 2000)), [10, 5, 5, 10]),
    (full((5, 10, 2000), (10, 10, 1000), (30, T, 1000), (50, T, 2000)), [10, 10, 10, 10]),
])
def test_markers_and_versions(spark, rows, expected):
    assert dense(spark, rows, RNG, FULL, gap=10) == expected


def test_fills(spark):
    rows = [("a", 20, 5.0), ("a", 30, None), ("a", 40, 9.0)]
    schema = "k string, epoch long, value double, marker string"
    rows = [(k, e, v, None if v is not None else "missing") for k, e, v in rows]
    assert dense(spark, rows, RNG, schema) == [None, 5, None, 9]
    assert dense(spark, rows, RNG, schema, fill=0) == [0, 5, 0, 9]
    assert dense(spark, rows, RNG, schema, fill="previous") == [None, 5, 5, 9]
    assert dense(spark, rows, RNG, schema, fill="linear") == [None, 5, 7, 9]


def test_default_dilutes_the_first_bucket(spark):
    assert dense(spark, [("a", 15, 10.0)], TimeRange(10, 30, 10), default=0.0, fill=0) == [5, 10]


def test_other_aggregates(spark):
    rows = [("a", 10, 4.0), ("a", 15, 2.0), ("a", 20, 1.0)]
    rng = TimeRange(10, 30, 10)
    assert dense(spark, rows, rng, how="max") == [4, 1]
    assert dense(spark, rows, rng, how="last") == [2, 1]
    assert dense(spark, rows, rng, how="sum") == [30, 10]
    with pytest.raises(ValueError):
        dense(spark, rows, rng, how="mode")


def test_rollup_is_labelled_with_the_end(spark):
    points = [("a", e, 100.0, None) for e in range(3800, 12600, 600)] + [("a", 12600, None, "tombstone")]
    df = spark.createDataFrame(points, "k string, epoch long, value double, marker string")
    got = {r["epoch"]: r["value"] for r in rollup(df, ["k"], TimeRange(3600, 18000, 3600), "sum", gap=400).collect()}
    assert {e: v for e, v in got.items() if v is not None} == {7200: 340000, 10800: 360000, 14400: 180000}
    got = {r["epoch"]: r["value"] for r in rollup(df, ["k"], TimeRange(0, 21600, 7200), "sum", gap=400).collect()}
    assert got[7200] == 340000 and got[14400] == 540000


def test_empty_input(spark):
    assert dense(spark, [], RNG) == []


def test_ranges():
    a, b = TimeRange(0, 10, 5), TimeRange(10, 20, 5)
    assert not a.overlaps(b) and a.touches(b)
    assert a.points() == 2 and list(a.epochs()) == [0, 5]
    assert TimeRange(3, 17, 5).aligned() == TimeRange(5, 20, 5)
    assert TimeRange(3, 17, 5).aligned(floor_start=True) == TimeRange(0, 20, 5)
    assert sort_and_merge([b, a]) == [a, b] and sort_and_merge([b, a], touching=True) == [TimeRange(0, 20, 5)]
    assert missing(TimeRange(0, 30, 5), [b]) == [a, TimeRange(20, 30, 5)]
    with pytest.raises(ValueError):
        TimeRange(0, 10, 0)


def test_cuts_keep_the_session_as_it_was(spark):
    from driftline import durable

    before = spark.conf.get(durable.CLEANUP, None)
    df = durable.cut(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
    assert df.count() == 7 and df.collect() == df.collect() and spark.conf.get(durable.CLEANUP, "false") == (before or "false")


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from driftline import durable

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        durable.cut(SimpleNamespace(sparkSession=session))


def test_bounds_reach_the_scan(spark, tmp_path):
    from driftline.queries import END, START, by_type, paths

    d = "/root/testdata/sf0.001"
    for df in (R.resample(by_type(spark, d, START, END), TimeRange(START, END, 3600), ["event_type"]), paths(spark, d).df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan and plan.count("FileScan") == 1


def test_lookback_by_era():
    assert R.default_lookback(1704067200) == 1800 and R.default_lookback(1600000000) == 43200 and R.default_lookback(1600000000, 3600) == 1800


def test_collisions_take_the_minimum(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 1, 3.0), ("a", 2, 1.0)], "k string, epoch long, value double")
    assert sorted(tuple(r) for r in R.dedupe(df, ["k"]).collect()) == [("a", 1, 3.0), ("a", 2, 1.0)]
