"""Registered queries over the test tables and their SQL, by family. Each pair shares its column names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import graphite as G
from .operators import resample as R
from .operators.series import Series, difference, merge
from .operators.timerange import TimeRange
from .sources.files import in_range

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: 2024-01-01, and thirty days.
START, END = 1704067200, 1706659200
DAYS = TimeRange(START, END, 86400)
HOURS = TimeRange(START, END, 3600)
SIXES = TimeRange(START, END, 21600)


def query(name: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def events(spark: SparkSession, d: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Points of the table ``events``: event_id, user_id, event_type, epoch, value; those of [lo, hi) only, by bounds that reach the scan."""
    df = spark.read.parquet(f"{d}/events.parquet")
    if lo is not None:
        df = in_range(df, "ts", lo, hi)
    return df.select("event_id", "user_id", "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("epoch"), "value")


def by_type(spark: SparkSession, d: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    return R.dedupe(events(spark, d, lo, hi), ["event_type"], "event_id")


EV = "ev AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, value FROM events)"
PTS = EV + ", pts AS (SELECT event_type, epoch, max_by(value, event_id) AS value FROM ev GROUP BY event_type, epoch)"


def twm_sql(step: int, value: str = "sum(v * d) / nullif(sum(CASE WHEN v IS NOT NULL THEN d END), 0)", first: str = "") -> str:
    """Step-weighted buckets of pts by event_type as the CTE ``dense``."""
    return f"""{PTS},
inside AS (SELECT event_type, epoch, value FROM pts WHERE epoch > {START - R.LOOKBACK} AND epoch < {END}),
steps AS (SELECT event_type, value AS v, epoch AS t0, epoch AS a, coalesce(lead(epoch) OVER (PARTITION BY event_type ORDER BY epoch), {END}) AS b FROM inside
  {first}),
clipped AS (SELECT event_type, v, t0, greatest(a, {START}) AS a, least(b, {END}) AS b FROM steps WHERE least(b, {END}) > greatest(a, {START})),
parts AS (SELECT event_type, v, t0, a, b, unnest(range({START} + (a - {START}) // {step} * {step}, b, {step})) AS bucket FROM clipped),
weighed AS (SELECT event_type, bucket, v, t0, least(b, bucket + {step}) - greatest(a, bucket) AS d FROM parts
  UNION ALL SELECT event_type, unnest(range({START}, {END}, {step})), NULL, NULL, 0 FROM (SELECT DISTINCT event_type FROM inside)),
dense AS (SELECT event_type, bucket AS epoch, {value} AS value FROM weighed GROUP BY event_type, bucket)"""


def out(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*(names or ("event_type",)), "epoch", F.round("value", digits).alias("value"))


def _resampled(how: str = "mean", fill=None, default=None, rng: TimeRange = HOURS):
    return lambda spark, d: out(R.resample(by_type(spark, d, rng.start - R.LOOKBACK, rng.end), rng, ["event_type"], how=how, fill=fill, default=default))


PICK = "SELECT event_type, epoch, round(value, 6) AS value FROM dense"
QUERIES["resample_twm_hourly"] = _resampled()
ORACLES["resample_twm_hourly"] = f"WITH {twm_sql(3600)} {PICK}"
QUERIES["resample_twm_fill0"] = _resampled(fill=0, default=0.0)
ORACLES["resample_twm_fill0"] = "WITH " + twm_sql(3600, first=f"UNION ALL SELECT event_type, 0.0, {START}, {START}, min(epoch) FROM inside GROUP BY event_type HAVING min(epoch) > {START}") + " SELECT event_type, epoch, round(coalesce(value, 0), 6) AS value FROM dense"
QUERIES["resample_twm_fill_prev"] = _resampled(fill="previous")
ORACLES["resample_twm_fill_prev"] = f"WITH {twm_sql(3600)} SELECT event_type, epoch, round(last_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY epoch), 6) AS value FROM dense"
for _how, _sql in {"max": "max(v)", "min": "min(v)", "sum": "sum(v * d)", "last": "max_by(v, CASE WHEN v IS NOT NULL THEN t0 END)"}.items():
    QUERIES[f"resample_{_how}"] = _resampled(_how)
    ORACLES[f"resample_{_how}"] = f"WITH {twm_sql(3600, _sql)} {PICK}"


def _by_user(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, START, END).withColumn("name", F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")))


_DENSE_USER = f"""{EV}, real AS (SELECT concat('u', user_id % 40) AS name, {START} + (epoch - {START}) // 3600 * 3600 AS bucket, value FROM ev WHERE epoch >= {START} AND epoch < {END}),
dense AS (SELECT name, bucket AS epoch, avg(value) AS value FROM (SELECT * FROM real UNION ALL SELECT name, unnest(range({START}, {END}, 3600)), NULL FROM (SELECT DISTINCT name FROM real)) GROUP BY name, bucket)"""


@query("resample_dense_mean", f"WITH {_DENSE_USER} SELECT name, epoch, round(value, 6) AS value FROM dense")
def _(spark, d):
    return out(R.resample_dense(_by_user(spark, d), HOURS, ["name"]), "name")


@query("resample_fill_linear", f"""WITH {_DENSE_USER},
l AS (SELECT name, epoch, value, last_value(CASE WHEN value IS NOT NULL THEN epoch END IGNORE NULLS) OVER w AS pe, last_value(value IGNORE NULLS) OVER w AS pv,
  first_value(CASE WHEN value IS NOT NULL THEN epoch END IGNORE NULLS) OVER x AS ne, first_value(value IGNORE NULLS) OVER x AS nv FROM dense
  WINDOW w AS (PARTITION BY name ORDER BY epoch), x AS (PARTITION BY name ORDER BY epoch ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT name, epoch, round(coalesce(value, pv + (nv - pv) * (epoch - pe) / nullif(ne - pe, 0)), 8) AS value FROM l""")
def _(spark, d):
    return out(R.resample_dense(_by_user(spark, d), HOURS, ["name"], fill="linear"), "name", digits=8)


@query("lookback_last_value", f"WITH {PTS} SELECT event_type, max(epoch) AS epoch, round(max_by(value, epoch), 6) AS value FROM pts WHERE epoch > {START + 864000 - 43200} AND epoch <= {START + 864000} GROUP BY event_type")
def _(spark, d):
    return out(R.last_values(by_type(spark, d, START + 864000 - 43200, START + 864001), ["event_type"], START + 864000, 43200))


# --- series frames for the path language -----------------------------------------------------------------------------


def paths(spark: SparkSession, d: str, rng: TimeRange = DAYS) -> Series:
    """Sixty series clusters.c_i.n_j.events.<type> of bucket means, with gaps."""
    name = F.concat(F.lit("clusters.c_"), (F.col("user_id") % 4).cast("string"), F.lit(".n_"), (F.col("user_id") % 3).cast("string"), F.lit(".events."), F.col("event_type"))
    points = events(spark, d, rng.start, rng.end).withColumn("name", name)
    return Series.of(R.resample_dense(points, rng, ["name"]), rng, F.col("name"))


def paths_sql(step: int = 86400) -> str:
    return f"""{EV}, named AS (SELECT concat('clusters.c_', user_id % 4, '.n_', user_id % 3, '.events.', event_type) AS sid, epoch, value FROM ev WHERE epoch >= {START} AND epoch < {END}),
filled AS (SELECT sid, {START} + (epoch - {START}) // {step} * {step} AS epoch, value FROM named UNION ALL SELECT sid, unnest(range({START}, {END}, {step})), NULL FROM (SELECT DISTINCT sid FROM named)),
s AS (SELECT sid, epoch, avg(value) AS v, dense_rank() OVER (ORDER BY sid) - 1 AS i FROM filled GROUP BY sid, epoch)"""


BASE = "WITH " + paths_sql()


def rows(s: Series | DataFrame, digits: int = 6) -> DataFrame:
    df = s.df if isinstance(s, Series) else s
    return df.select("series_id", "epoch", F.round("value", digits).alias("value"))


def graphite(name: str, sql: str, call: Callable[[Series], Series], rng: TimeRange = DAYS, digits: int = 6) -> None:
    """Register g_<name>; ``sql`` gives series_id, epoch, value over ``s`` (sid, epoch, v, i)."""
    QUERIES[f"g_{name}"] = lambda spark, d: rows(call(paths(spark, d, rng)), digits)
    ORACLES[f"g_{name}"] = f"WITH {paths_sql(rng.interval)} SELECT series_id, epoch, round(value, {digits}) AS value FROM ({sql}) t"


def each(name: str, value: str, call: Callable[[Series], Series], shown: str | None = None, args: str = "", rng: TimeRange = DAYS) -> None:
    """A function that keeps rows and renames series."""
    sid = f"concat('{shown or name}(', sid, '{args})')"
    graphite(name, f"SELECT {sid} AS series_id, epoch, {value} AS value FROM s", call, rng)


W = "OVER (PARTITION BY sid ORDER BY epoch)"
each("absolute", "abs(v)", lambda s: G.absolute(s.rng, s))
each("scale", "v * 2.5", lambda s: G.scale(s.rng, s, 2.5), args=",2.5")
each("offset", "v + -10.0", lambda s: G.offset(s.rng, s, -10), args=",-10")
each("scaleToSeconds", "v * (60.0 / 86400)", lambda s: G.scale_to_seconds(s.rng, s, 60), args=",60")
each("isNonNull", "CASE WHEN v IS NULL THEN 0.0 ELSE 1.0 END", lambda s: G.is_non_null(s.rng, s), rng=SIXES)
each("transformNull", "coalesce(v, -1.0)", lambda s: G.transform_null(s.rng, s, -1), args=",-1", rng=SIXES)
each("removeAboveValue", "CASE WHEN v <= 50 THEN v END", lambda s: G.remove_above_value(s.rng, s, 50), args=",50")
each("removeBelowValue", "CASE WHEN v >= 50 THEN v END", lambda s: G.remove_below_value(s.rng, s, 50), args=",50")
each("changed", f"CASE WHEN v <> lag(v) {W} THEN 1.0 ELSE 0.0 END", lambda s: G.changed(s.rng, s), rng=SIXES)
each("delay", f"lag(v, 3) {W}", lambda s: G.delay(s.rng, s, 3), args=", 3")
each("nonNegativeDerivative", f"CASE WHEN v - lag(v) {W} >= 0 THEN v - lag(v) {W} END", lambda s: G.non_negative_derivative(s.rng, s), rng=SIXES)
each("integral", "coalesce(sum(v) OVER (PARTITION BY sid ORDER BY epoch ROWS UNBOUNDED PRECEDING), 0)", lambda s: G.integral(s.rng, s))
each("movingAverage", "avg(v) OVER (PARTITION BY sid ORDER BY epoch ROWS 3 PRECEDING)", lambda s: G.moving_average(s.rng, s, "1d"), args=",1d", rng=SIXES)
each("keepLastValue", f"last_value(v IGNORE NULLS) {W}", lambda s: G.keep_last_value(s.rng, s), rng=SIXES)
graphite("keepLastValueLimit", """SELECT concat('keepLastValue(', sid, ',1)') AS series_id, epoch, f AS value FROM (
  SELECT sid, epoch, last_value(v IGNORE NULLS) OVER (PARTITION BY sid ORDER BY epoch) AS f, g, row_number() OVER (PARTITION BY sid, g ORDER BY epoch) - 1 AS age
  FROM (SELECT sid, epoch, v, sum(CASE WHEN v IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY sid ORDER BY epoch) AS g FROM s)) WHERE g = 0 OR age <= 1""", lambda s: G.keep_last_value(s.rng, s, 1), SIXES)
P = "OVER (PARTITION BY sid)"
each("nPercentile", f"quantile_cont(v, 0.9) {P}", lambda s: G.n_percentile(s.rng, s, 90), args=",90")
each("removeAbovePercentile", f"CASE WHEN v <= quantile_cont(v, 0.75) {P} THEN v END", lambda s: G.remove_above_percentile(s.rng, s, 75), args=",75")
each("removeBelowPercentile", f"CASE WHEN v >= quantile_cont(v, 0.25) {P} THEN v END", lambda s: G.remove_below_percentile(s.rng, s, 25), args=",25")
each("asPercent", "v * 100 / nullif(sum(v) OVER (PARTITION BY epoch), 0)", lambda s: G.as_percent(s.rng, s))
each("asPercentTotal", "v * 100 / 250.0", lambda s: G.as_percent(s.rng, s, 250), shown="asPercent", args=",250")
graphite("asPercentSeries", "SELECT concat('asPercent(', sid, ')') AS series_id, s.epoch, v * 100 / nullif(t, 0) AS value FROM s LEFT JOIN (SELECT epoch, sum(v) AS t FROM s WHERE i < 5 GROUP BY epoch) t ON s.epoch = t.epoch",
         lambda s: G.as_percent(s.rng, s, G.limit(s.rng, s, 5)))
graphite("summarize", f"SELECT concat('summarize(', sid, ',2d,sum)') AS series_id, epoch // 172800 * 172800 AS epoch, sum(v) AS value FROM s GROUP BY sid, epoch // 172800", lambda s: G.summarize(s.rng, s, "2d"))
for _f, _sql in {"avg": "avg(v)", "median": "median(v)", "max": "max(v)", "min": "min(v)", "std": "stddev_pop(v)", "count": "CAST(count(v) AS DOUBLE)", "last": "max_by(v, CASE WHEN v IS NOT NULL THEN epoch END)"}.items():
    graphite(f"summarize_{_f}", f"SELECT concat('summarize(', sid, ',3d,{_f})') AS series_id, {START} + (epoch - {START}) // 259200 * 259200 AS epoch, {_sql} AS value FROM s GROUP BY sid, {START} + (epoch - {START}) // 259200 * 259200",
             lambda s, f=_f: G.summarize(s.rng, s, "3d", f, True))
graphite("timeShift", "SELECT concat('timeShift(', sid, ',1d)') AS series_id, epoch + 86400 AS epoch, v AS value FROM s", lambda s: G.time_shift(s.rng, s, "1d"))

SAME = "SELECT sid AS series_id, epoch, v AS value FROM s"
graphite("alias", "SELECT 'one' AS series_id, epoch, v AS value FROM s", lambda s: G.alias(s.rng, s, "one"))
graphite("aliasSub", r"SELECT regexp_replace(sid, 'c_(\d)\.n_(\d)', 'x\2y\1', 'g') AS series_id, epoch, v AS value FROM s", lambda s: G.alias_sub(s.rng, s, r"c_(\d)\.n_(\d)", r"x\2y\1"))
graphite("aliasByNode", "SELECT concat(split_part(sid, '.', 2), '.', split_part(sid, '.', 5)) AS series_id, epoch, v AS value FROM s", lambda s: G.alias_by_node(s.rng, s, 4, 1))
graphite("exclude", SAME + " WHERE NOT contains(sid, 'n_1')", lambda s: G.exclude(s.rng, s, "n_1"))
graphite("limit", SAME + " WHERE i < 7", lambda s: G.limit(s.rng, s, 7))
graphite("group", SAME + " WHERE i < 3 UNION ALL " + SAME + " WHERE i < 2", lambda s: G.group(s.rng, G.limit(s.rng, s, 3), G.limit(s.rng, s, 2)))
for _f, _agg in {"currentAbove": "arg_max_null(v, epoch)", "averageAbove": "avg(v)", "maximumAbove": "max(v)"}.items():
    _n = {"currentAbove": 50, "averageAbove": 50, "maximumAbove": 200}[_f]
    graphite(_f, SAME + f" WHERE sid IN (SELECT sid FROM s GROUP BY sid HAVING {_agg} >= {_n})", lambda s, f=_f, n=_n: G.REGISTRY[f](s.rng, s, n))
graphite("removeEmptySeries", SAME + " WHERE sid IN (SELECT sid FROM s GROUP BY sid HAVING count(v) >= greatest(1.0, 0.8 * count(*)))", lambda s: G.remove_empty_series(s.rng, s, 0.8), SIXES)
for _f, _test in {"equal_to": "=", "not_equal": "<>"}.items():
    graphite(_f, f"SELECT sid AS series_id, epoch, CASE WHEN v {_test} 41.5 THEN v END AS value FROM s WHERE sid IN (SELECT sid FROM s WHERE v {_test} 41.5)", lambda s, f=_f: G.REGISTRY[f](s.rng, s, 41.5), SIXES)
graphite("greater", "SELECT sid AS series_id, epoch, CASE WHEN v > 150 THEN v END AS value FROM s WHERE sid IN (SELECT sid FROM s WHERE v > 150)", lambda s: G.greater(s.rng, s, 150), SIXES)


def ordered(name: str, key: str, order: str, call: Callable[[Series], Series], having: str = "", n: str = "") -> None:
    """A function that orders series: the order itself is part of the result."""
    def run(spark: SparkSession, d: str) -> DataFrame:
        s = call(paths(spark, d))
        points = s.df.groupBy("place").agg(F.count(F.lit(1)).alias("points"))
        return points.join(s.positions(int(n.split()[1]) if n else None), "place").select(F.col("position").cast("long").alias("idx"), "series_id", "points")

    QUERIES[f"g_{name}"] = run
    ORACLES[f"g_{name}"] = BASE + f" SELECT row_number() OVER (ORDER BY k {order}, i) - 1 AS idx, sid AS series_id, n AS points FROM (SELECT sid, i, {key} AS k, count(*) AS n FROM s GROUP BY sid, i {having}) t ORDER BY 1 {n}"


ordered("sortByName", "sid", "DESC", lambda s: G.sort_by_name(s.rng, s, reverse=True))
ordered("sortByMaxima", "coalesce(max(v), -1)", "DESC", lambda s: G.sort_by_maxima(s.rng, s))
ordered("sortByMinima", "min(v)", "ASC", lambda s: G.sort_by_minima(s.rng, s), having="HAVING max(v) > 0")
ordered("sortByTotal", "coalesce(sum(v), 0)", "ASC", lambda s: G.sort_by_total(s.rng, s))
ordered("highest", "coalesce(avg(v), -1)", "DESC", lambda s: G.highest(s.rng, s, 5), n="LIMIT 5")
ordered("highestAverage", "coalesce(avg(v), -1)", "DESC", lambda s: G.highest_average(s.rng, s, 6), n="LIMIT 6")
ordered("highestMax", "coalesce(max(v), -1)", "DESC", lambda s: G.highest_max(s.rng, s, 4), n="LIMIT 4")
ordered("highestCurrent", "coalesce(arg_max_null(v, epoch), -1)", "DESC", lambda s: G.highest_current(s.rng, s, 4), n="LIMIT 4")

for _f, _agg in {"maxSeries": "max(v)", "minSeries": "min(v)", "sumSeries": "sum(v)", "averageSeries": "avg(v)"}.items():
    graphite(_f, f"SELECT '{_f}' AS series_id, epoch, {_agg} AS value FROM s GROUP BY epoch", lambda s, f=_f: G.REGISTRY[f](s.rng, s), SIXES)
graphite("diffSeries", "SELECT 'diffSeries' AS series_id, epoch, max(CASE WHEN i = 0 THEN v END) - coalesce(sum(CASE WHEN i > 0 THEN v END), 0) AS value FROM s WHERE i < 4 GROUP BY epoch", lambda s: G.diff_series(s.rng, G.limit(s.rng, s, 4)))
graphite("divideSeries", "SELECT concat('divideSeries(', s.sid, ')') AS series_id, s.epoch, s.v / nullif(o.v, 0) AS value FROM s LEFT JOIN (SELECT epoch, v FROM s WHERE i = 0) o ON s.epoch = o.epoch", lambda s: G.divide_series(s.rng, s, G.limit(s.rng, s, 1)))
graphite("divideSeriesLists", "SELECT concat('divideSeries(', s.sid, ',scale(', s.sid, ',2))') AS series_id, s.epoch, s.v / nullif(o.v, 0) AS value FROM s LEFT JOIN (SELECT i, epoch, v * 2.0 AS v FROM s WHERE i < 5) o ON s.epoch = o.epoch AND s.i = o.i WHERE s.i < 5",
         lambda s: G.divide_series_lists(s.rng, G.limit(s.rng, s, 5), G.scale(s.rng, G.limit(s.rng, s, 5), 2)))
graphite("countSeries", f"SELECT 'count' AS series_id, unnest(range({START}, {END}, 86400)) AS epoch, CAST(n AS DOUBLE) AS value FROM (SELECT count(DISTINCT sid) AS n FROM s)", lambda s: G.count_series(s.rng, s))
graphite("countNewSeries", f"SELECT 'countNewSeries' AS series_id, g.epoch, CAST(count(f.sid) AS DOUBLE) AS value FROM (SELECT unnest(range({START}, {END}, 21600)) AS epoch) g LEFT JOIN (SELECT sid, min(epoch) AS epoch FROM s WHERE v IS NOT NULL GROUP BY sid) f ON f.epoch = g.epoch GROUP BY g.epoch", lambda s: G.count_new_series(s.rng, s), SIXES)
graphite("constantLine", f"SELECT 'constantLine(7.5)' AS series_id, unnest(range({START}, {END}, 86400)) AS epoch, 7.5 AS value", lambda s: G.constant_line(s.rng, 7.5, s.df.sparkSession))
_NODE = lambda *n: "concat_ws('.', " + ", ".join(f"split_part(sid, '.', {x + 1})" for x in n) + ")"
for _f, _agg in {"avg": "avg(v)", "sumSeries": "sum(v)", "max": "max(v)", "std": "stddev_pop(v)", "median": "median(v)"}.items():
    graphite(f"groupByNode_{_f}", f"SELECT {_NODE(1)} AS series_id, epoch, {_agg} AS value FROM s GROUP BY 1, 2", lambda s, f=_f: G.group_by_node(s.rng, s, 1, f))
graphite("groupByNodes", f"SELECT {_NODE(1, 4)} AS series_id, epoch, sum(v) AS value FROM s GROUP BY 1, 2", lambda s: G.group_by_nodes(s.rng, s, "sum", 4, 1))
graphite("groupByNodes_diff", f"SELECT k AS series_id, epoch, max(CASE WHEN i = f THEN v END) - coalesce(sum(CASE WHEN i <> f THEN v END), 0) AS value FROM (SELECT {_NODE(1, 2)} AS k, epoch, v, i, min(i) OVER (PARTITION BY {_NODE(1, 2)}) AS f FROM s) GROUP BY 1, 2",
         lambda s: G.group_by_nodes(s.rng, s, "diffSeries", 1, 2))
graphite("averageSeriesWithWildcards", f"SELECT {_NODE(0, 2, 3, 4)} AS series_id, epoch, avg(v) AS value FROM s GROUP BY 1, 2", lambda s: G.average_series_with_wildcards(s.rng, s, 1), digits=8)
graphite("sumSeriesWithWildcards", f"SELECT {_NODE(0, 3, 4)} AS series_id, epoch, sum(v) AS value FROM s GROUP BY 1, 2", lambda s: G.sum_series_with_wildcards(s.rng, s, 1, 2))
graphite("aggregateWithWildcards", f"SELECT {_NODE(0, 1, 3, 4)} AS series_id, epoch, max(v) AS value FROM s GROUP BY 1, 2", lambda s: G.aggregate_with_wildcards(s.rng, s, "max", 2))


@query("series_diff", BASE + """ SELECT coalesce(a.sid, b.sid) AS series_id, coalesce(a.epoch, b.epoch) AS epoch, round(a.v, 6) AS left_value, round(b.v, 6) AS right_value,
CASE WHEN b.sid IS NULL THEN 'left_only' WHEN a.sid IS NULL THEN 'right_only' ELSE 'value' END AS kind
FROM (SELECT * FROM s WHERE i < 6) a FULL JOIN (SELECT sid, epoch, CASE WHEN epoch % 172800 = 0 THEN v * 1.5 ELSE v END AS v FROM s WHERE i >= 3 AND i < 9) b ON a.sid = b.sid AND a.epoch = b.epoch
WHERE a.sid IS NULL OR b.sid IS NULL OR (a.v IS DISTINCT FROM b.v AND coalesce(abs(a.v - b.v) > 0.1 * abs(a.v), true))""")
def _(spark, d):
    s = paths(spark, d)
    left = G.limit(s.rng, s, 6)
    right = s.slice(3, 6).with_value(F.when(F.col("epoch") % 172800 == 0, F.col("value") * 1.5).otherwise(F.col("value")))
    return difference(left, right, 0.1).withColumn("left_value", F.round("left_value", 6)).withColumn("right_value", F.round("right_value", 6))


@query("series_merge", BASE + " SELECT sid AS series_id, epoch, round(CASE WHEN i < 6 THEN v ELSE v * 2 END, 6) AS value FROM s WHERE i < 9")
def _(spark, d):
    s = paths(spark, d)
    return rows(merge(G.limit(s.rng, s, 6), s.slice(3, 6).with_value(F.col("value") * 2)))
