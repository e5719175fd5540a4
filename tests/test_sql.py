"""The SQL dialect: literals, parsing, and results on small tables."""

import pytest

from driftline.functions.timeparse import interval_seconds, parse_time
from driftline.plans import influxql as Q
from driftline.plans import response
from driftline.plans.planner import SqlPlanner, Table


def test_time_literals():
    assert [interval_seconds(x) for x in ("10", "90s", "5min", "5m", "1h", "2d", "1mon", "1y", "1hour")] == [10, 90, 300, 300, 3600, 172800, 2592000, 31536000, 3600]
    assert parse_time("now() - 1h", 10000) == 6400 and parse_time("now", 7) == 7 and parse_time("-1m", 100) == 40
    assert parse_time("00:01_19700102") == 86460 and parse_time("1970-01-01T00:00:05Z") == 5
    for bad in ("", "5 parsecs", "h"):
        with pytest.raises(ValueError):
            interval_seconds(bad)


def test_parse():
    s = Q.parse('SELECT mean("value") AS m, a + 2*b FROM "ev" WHERE time > 9 AND time <= 29 AND (node = \'n*\' OR NOT dc IN (\'a\', \'b\')) GROUP BY time(10), node fill(previous)')
    assert [n for n, _ in s.expressions] == ["m", "a"] and s.group_by == ["node"] and s.fill == "previous"
    assert (s.range.start, s.range.end, s.range.interval) == (10, 30, 10)
    assert Q.parse("SELECT t.abs(x) FROM m WHERE time >= now() - 1h", now=7200).range.start == 3600


@pytest.mark.parametrize("text", [
    "SELECT a FROM m", "SELECT a FROM m WHERE time > 1 ORDER BY a", "SELECT a FROM m WHERE time > 1 LIMIT 3", "SELECT DISTINCT a FROM m WHERE time > 1",
    "SELECT a FROM m WHERE time > 1 OR time < 9", "SELECT a FROM m JOIN n WHERE time > 1", "DELETE FROM m", "SELECT a FROM m WHERE time > 1 GROUP BY f(x)", "SELECT FROM m",
])
def test_refused(text):
    with pytest.raises(Q.UnsupportedSql):
        Q.parse(text)


@pytest.fixture(scope="module")
def planner(spark):
    rows = [("n1", 10, 20.0, 2.0), ("n1", 20, 30.0, 3.0), ("n1", 25, 40.0, None), ("n2", 5, 30.0, 4.0), ("n2", 15, 40.0, 8.0), ("n2", 35, 50.0, 0.0)]
    return SqlPlanner({"ev": Table(spark.createDataFrame(rows, "node string, epoch long, s double, u double"), ["node"], ["s", "u"])})


def got(planner, text, *keys):
    df = next(iter(planner.run(text).values()))
    return [r["value"] for r in df.orderBy(*keys, "epoch").collect()]


TAIL = "FROM ev WHERE time >= 10 AND time < 40 GROUP BY time(5), node fill(null)"


def test_resampled_mean(planner):
    assert got(planner, f"SELECT mean(s) {TAIL}", "node") == [20, 20, 30, 40, 40, 40, 30, 40, 40, 40, 40, 50]


@pytest.mark.parametrize(("expression", "expected"), [
    ("sum(s)", [50, 60, 70, 80, 80, 90]), ("percentile(s, 50)", [25, 30, 35, 40, 40, 45]), ("std(s)", [5, 10, 5, 0, 0, 5]), ("count(s)", [2] * 6),
    ("topk(s, 1)", [[30], [40], [40], [40], [40], [50]]), ("max(s) - min(s) / 2", [20, 30, 25, 20, 20, 30]), ("sum(s) * 0 + 1", [1] * 6),
])
def test_across_series(planner, expression, expected):
    assert got(planner, f"SELECT {expression} {TAIL.replace(', node', '')}") == expected


@pytest.mark.parametrize(("expression", "expected"), [
    ("t.shift(s, 1)", [0, 20, 20, 30, 40, 40]), ("t.diff(s)", [0, 10, 10, 0, 0]), ("t.cumsum(s)", [20, 40, 70, 110, 150, 190]), ("t.gradient(s)", [0, 5, 10, 5, 0, 0]),
    ("s / 0", [None] * 6), ("s + u", [22, 22, 33, 43, 43, 43]), ("t.clip(s, 25, 35)", [25, 25, 30, 35, 35, 35]), ("-s", [-20, -20, -30, -40, -40, -40]),
])
def test_along_series(planner, expression, expected):
    assert got(planner, f"SELECT {expression} FROM ev WHERE time >= 10 AND time < 40 AND node = 'n1' GROUP BY time(5) fill(null)") == expected


def test_timeshift_and_response(planner):
    result = planner.run(f"SELECT timeshift(sum(s), '1h') AS x {TAIL.replace(', node', '')}")
    body = response.influx(result, "ms")
    assert body["results"][0]["series"][0]["values"][0] == [3610000, 50.0]
    for bad in ("SELECT nosuch(s) ", "SELECT q ", "SELECT mean(q) "):
        with pytest.raises(Q.UnsupportedSql):
            planner.run(bad + TAIL)


def test_rollup_choice(spark):
    raw = spark.createDataFrame([("a", 0, 1.0)], "node string, epoch long, s double")
    coarse = spark.createDataFrame([("a", 0, 2.0)], "node string, epoch long, s double")
    p = SqlPlanner({"ev": Table(raw, ["node"], ["s"], rollups={3600: coarse})})
    assert got(p, "SELECT s FROM ev WHERE time >= 0 AND time < 7200 GROUP BY time(1h)") == [2, 2]
    assert got(p, "SELECT s FROM ev WHERE time >= 0 AND time < 120 GROUP BY time(1m)") == [1, 1]


def test_a_literal_is_a_constant_line(planner):
    assert got(planner, f"SELECT 3 + 4 AS x {TAIL}") == [7] * 6


def test_field_patterns(planner):
    df = planner.run('SELECT max("*") AS x FROM ev WHERE time >= 10 AND time < 40 AND node = \'n1\' GROUP BY time(5), field fill(null)')["x"]
    assert {(r["field"], r["epoch"]): r["value"] for r in df.collect()} == {("s", e): v for e, v in zip(range(10, 40, 5), [20, 20, 30, 40, 40, 40], strict=True)} | {("u", e): v for e, v in zip(range(10, 40, 5), [2, 2, 3, 3, 3, 3], strict=True)}
    assert got(planner, "SELECT sum(\"{s;u}\") FROM ev WHERE time >= 10 AND time < 40 AND node = 'n1' GROUP BY time(5) fill(null)") == [22, 22, 33, 43, 43, 43]


def test_null_tags_meet(spark):
    rows = [(None, 0, 6.0, 2.0), ("a", 0, 8.0, 4.0)]
    p = SqlPlanner({"ev": Table(spark.createDataFrame(rows, "node string, epoch long, s double, u double"), ["node"], ["s", "u"])})
    tail = "FROM ev WHERE time >= 0 AND time < 5 GROUP BY time(5), node fill(null)"
    assert sorted(got(p, f"SELECT s / u {tail}", "node")) == [2, 3]
    assert sorted(got(p, f"SELECT sum(s) / timeshift(sum(u), '0') {tail}", "node")) == [2, 3]


def test_fields_share_one_scan(planner):
    plan = planner.run(f"SELECT max(s) - min(u) / s AS x {TAIL}")["x"]._jdf.queryExecution().optimizedPlan().toString()
    both = planner.run(f"SELECT (s + u) / u AS x {TAIL}")["x"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Join" not in both and both.count("LogicalRDD") + both.count("LocalRelation") == 1
