"""Path functions on literal vectors, the parser, and the planner."""

import pytest
from pyspark.sql import functions as F

from driftline.functions import graphite as G
from driftline.operators.series import ROW, Series, by_number, difference, merge
from driftline.operators.timerange import TimeRange
from driftline.plans import graphite as P
from driftline.plans import response


def make(spark, *lists, start=10, step=10, names=None):
    n = max(map(len, lists))
    names = names or [f"s{i}" for i in range(len(lists))]
    rows = [(i, s, s, start + j * step, None if v is None else float(v)) for i, (s, values) in enumerate(zip(names, lists, strict=True)) for j, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, series_id string, base_series_id string, epoch long, value double")
    return Series(df.withColumn("place", by_number(F.col("i"))).select(*ROW), TimeRange(start, start + n * step, step))


def values(s, idx=0):
    return [r["value"] for r in s.slice(idx, 1).df.orderBy("epoch").collect()]


def ids(s):
    found = s.positions().orderBy("position").collect()
    assert [r["position"] for r in found] == list(range(len(found)))
    return [r["series_id"] for r in found]


N = None


@pytest.mark.parametrize(("name", "args", "given", "expected"), [
    ("nonNegativeDerivative", (), [2, 2, 6, N, 6, 8], [N, 0, 4, N, N, 2]),
    ("nonNegativeDerivative", (), [4, 2, 4], [N, N, 2]),
    ("integral", (), [2, 3, N, 5, N, 7], [2, 5, 5, 10, 10, 17]),
    ("integral", (), [N, N], [0, 0]),
    ("movingAverage", ("20",), [2, 3, 4, N, N, 7], [2, 2.5, 3.5, 4, N, 7]),
    ("keepLastValue", (3,), [2, N, N, N, N, N], [2, 2, 2, 2]),
    ("keepLastValue", (), [N, 2, N, 3, N], [N, 2, 2, 3, 3]),
    ("delay", (2,), [1, 2, 3], [N, N, 1]),
    ("changed", (), [1, 1, 2, N, 2], [0, 0, 1, 0, 0]),
    ("removeAboveValue", (2,), [1, 2, 3], [1, 2, N]),
    ("removeBelowValue", (2,), [1, 2, 3], [N, 2, 3]),
    ("nPercentile", (50,), [1, 2, 3, N], [2, 2, 2, 2]),
    ("scaleToSeconds", (5,), [2, 4], [1, 2]),
    ("transformNull", (), [N, 1], [0, 1]),
    ("isNonNull", (), [N, 1], [0, 1]),
])
def test_one_series(spark, name, args, given, expected):
    s = make(spark, given)
    assert values(G.REGISTRY[name](s.rng, s, *args)) == expected


@pytest.mark.parametrize(("given", "args", "expected"), [
    ([2, 3, 4, 5, 6, 7], ("20", "sum"), {20: 5, 40: 9, 60: 13}),
    ([2, N, N, 5, N, N], ("20", "sum"), {20: 2, 40: 5, 60: N}),
    ([2, 3, 4, 5, 6, 7], ("30", "median", True), {20: 3, 50: 6}),
])
def test_summarize(spark, given, args, expected):
    s = make(spark, given, start=20)
    assert {r["epoch"]: r["value"] for r in G.summarize(s.rng, s, *args).df.collect()} == expected


def test_across_series(spark):
    s = make(spark, [42, 52, 62], [N, 20, 30])
    assert values(G.count_new_series(s.rng, s)) == [1, 1, 0]
    assert values(G.sum_series(s.rng, s)) == [42, 72, 92]
    assert values(G.diff_series(s.rng, s)) == [42, 32, 32]
    assert values(G.as_percent(s.rng, s, 100), 1) == [N, 20, 30]
    assert values(G.divide_series(s.rng, s, G.limit(s.rng, s, 1)), 1) == [N, 20 / 52, 30 / 62]
    assert values(G.count_series(s.rng, s)) == [2, 2, 2]
    assert values(G.constant_line(s.rng, 10, spark)) == [10, 10, 10]
    assert ids(G.highest(s.rng, s, 1)) == ["s0"]
    assert ids(G.sort_by_total(s.rng, s)) == ["s1", "s0"]
    assert ids(G.group(s.rng, s, s)) == ["s0", "s1", "s0", "s1"]
    assert ids(G.remove_empty_series(s.rng, s, 1)) == ["s0"]
    with pytest.raises(ValueError):
        G.n_percentile(s.rng, s, 101)


def test_two_divisors_are_an_error(spark):
    s = make(spark, [1, 2], [3, 4])
    with pytest.raises(Exception, match="one divisor"):
        G.divide_series(s.rng, s, s).df.collect()


def test_names_and_nodes(spark):
    names = [f"s1.n{a}.m{b}.count" for a in (1, 2) for b in (1, 2)]
    s = make(spark, [1, N], [3, N], [5, N], [7, N], names=names)
    assert ids(G.alias_by_node(s.rng, s, 2, 1))[0] == "n1.m1"
    assert ids(G.alias_sub(s.rng, s, r"n(\d)", r"x\1"))[3] == "s1.x2.m2.count"
    grouped = G.average_series_with_wildcards(s.rng, s, 2)
    assert ids(grouped) == ["s1.n1.count", "s1.n2.count"] and values(grouped, 1) == [6, N]
    assert values(G.group_by_node(s.rng, s, 1, "sum"), 0) == [4, N]
    assert values(G.group_by_nodes(s.rng, s, "diffSeries", 1), 0) == [-2, N]
    assert ids(G.exclude(s.rng, s, "m2")) == names[::2]


def test_merge_and_difference(spark):
    a, b = make(spark, [1, 2]), make(spark, [9, 2, 3])
    assert values(merge(a, b)) == [1, 2, 3]
    assert sorted((r["epoch"], r["kind"]) for r in difference(a, b).collect()) == [(10, "value"), (30, "right_only")]


@pytest.mark.parametrize("text", ["f(", "f(a", "f(a,,b)", "'open", "f(a) b", ""])
def test_bad_targets(text):
    with pytest.raises(ValueError):
        P.parse(text)


def test_parser():
    tree, options = P.parse("alias(scale(a.{b,c}.*, -2.5), 'x \\'y\\'')||nocache,lookback_sec=60")
    assert tree == P.Apply("alias", (P.Apply("scale", (P.Path("a.{b,c}.*"), -2.5)), "x 'y'"))
    assert options == {"nocache": True, "lookback_sec": "60"}
    assert P.decomposable("scale(a.b, 2)") and not P.decomposable("integral(a.b)")


def test_render(spark):
    points = spark.createDataFrame([("a.b.x", 0, 1.0), ("a.c.x", 60, 4.0), ("a.b.x", 120, 3.0), ("a.b", 0, 9.0)], "name string, epoch long, value double")
    planner = P.GraphitePlanner(points, storage_interval=60)
    out = planner.render("sumSeries(a.{b,c}.x)", "0", "180", max_points=3)
    assert values(out) == [1, 5, 7]
    assert response.graphite(out) == [{"target": "sumSeries", "datapoints": [[1.0, 0], [5.0, 60], [7.0, 120]]}]
    assert values(planner.render("nonNegativeDerivative(a.b.x)", "60", "180", max_points=2)) == [0, 2]
    with pytest.raises(ValueError):
        planner.render("nosuch(a.b)", "0", "60")


def test_names_sort_the_other_way_round(spark):
    names = ["a", "ab", "b", "é", "", "a.b", "B"]
    s = make(spark, *[[1]] * len(names), names=names)
    assert ids(G.sort_by_name(s.rng, s, reverse=True)) == sorted(names, key=str.encode, reverse=True)
    assert ids(G.sort_by_name(s.rng, s)) == sorted(names, key=str.encode)


def test_lists_divide_place_by_place(spark):
    a, b = make(spark, [4, 6], [8, N], names=["x", "y"]), make(spark, [2, 0], [4, 1], names=["p", "q"])
    out = G.divide_series_lists(a.rng, G.sort_by_name(a.rng, a, reverse=True), b)
    assert ids(out) == ["divideSeries(y,p)", "divideSeries(x,q)"]
    assert values(out) == [4, N] and values(out, 1) == [1, 6]
    with pytest.raises(Exception, match="same length"):
        G.divide_series_lists(a.rng, a, G.limit(b.rng, b, 1)).df.collect()


def test_no_task_ranks_all_series(spark):
    s = make(spark, [1, 2], [3, 4])
    for f in (lambda: G.sort_by_total(s.rng, s), lambda: G.sort_by_name(s.rng, s), lambda: G.as_percent(s.rng, s), lambda: G.group_by_node(s.rng, s, 0, "sum"), lambda: G.group(s.rng, s, s)):
        plan = f().df._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan
