"""Registered queries of the SQL dialect, the write path, metadata and detection, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.timeparse import interval_seconds
from .operators import anomaly, bands, explore, rollup, sparse
from .operators import resample as R
from .operators.timerange import TimeRange, missing
from .plans import graphite as paths_language
from .plans.config import Config, adler_shard
from .plans.planner import SqlPlanner, Table
from .queries import BASE, END, EV, ORACLES, PTS, QUERIES, SIXES, START, by_type, events, out, paths, query, rows, twm_sql
from .sources import codec

# --- the SQL dialect -----------------------------------------------------------------------------------------------------


def planner(spark: SparkSession, d: str) -> SqlPlanner:
    ev = events(spark, d, START - R.LOOKBACK, END).withColumn("grp", F.concat(F.lit("g"), (F.col("user_id") % 4).cast("string")))
    one = ev.groupBy("event_type", "grp", "epoch").agg(F.max_by("value", "event_id").alias("user"), F.max_by(F.col("value") * 3 + F.col("event_id") % 7, "event_id").alias("system"))
    return SqlPlanner({"ev": Table(one, ["event_type", "grp"], ["user", "system"])})


def _field_sql(name: str, value: str, where: str = "") -> str:
    """Dense series of a field by (event_type, grp) on six hours over the whole range."""
    return f"""{name}_p AS (SELECT event_type, concat('g', user_id % 4) AS grp, epoch, max_by({value}, event_id) AS value FROM ev GROUP BY 1, 2, 3),
{name}_i AS (SELECT * FROM {name}_p WHERE epoch > {START - R.LOOKBACK} AND epoch < {END} {where}),
{name}_s AS (SELECT event_type, grp, value AS v, greatest(epoch, {START}) AS a, coalesce(lead(epoch) OVER (PARTITION BY event_type, grp ORDER BY epoch), {END}) AS b FROM {name}_i),
{name}_b AS (SELECT event_type, grp, v, a, b, unnest(range({START} + (a - {START}) // 21600 * 21600, b, 21600)) AS bucket FROM {name}_s WHERE b > a),
{name}_w AS (SELECT event_type, grp, bucket, v, least(b, bucket + 21600) - greatest(a, bucket) AS d FROM {name}_b
  UNION ALL SELECT event_type, grp, unnest(range({START}, {END}, 21600)), NULL, 0 FROM (SELECT DISTINCT event_type, grp FROM {name}_i)),
{name} AS (SELECT event_type, grp, bucket AS epoch, sum(v * d) / nullif(sum(CASE WHEN v IS NOT NULL THEN d END), 0) AS v FROM {name}_w GROUP BY 1, 2, 3)"""


U = f"WITH {EV}, {_field_sql('u', 'value')}"
US = f"{U}, {_field_sql('y', 'value * 3 + event_id % 7')}"


#: Added before rounding to six digits: quotients of sums by 21600 are often exact ties, which the engines' sums hit from either side.
NUDGE = 3.3e-8


def sql(name: str, select: str, oracle: str, where: str = "", group: str = ", event_type", fill: str = "null", digits: int = 6, base: str = U) -> None:
    text = f"SELECT {select} AS x FROM ev WHERE time >= {START} AND time < {END} {where} GROUP BY time(6h){group} fill({fill})"

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = planner(spark, d).run(text)["x"]
        near = lambda x: F.round(x + NUDGE, digits)
        value = F.transform("value", near) if dict(df.dtypes)["value"].startswith("array") else near(F.col("value"))
        return df.withColumn("value", value)

    QUERIES[name] = run
    shown = f"list_transform(value, lambda x: round(x + {NUDGE}, {digits}))" if "list_transform" in oracle else f"round(value + {NUDGE}, {digits})"
    ORACLES[name] = f"{base} SELECT * REPLACE ({shown} AS value) FROM ({oracle})"


def _agg(f: str, order: str = "") -> str:
    return f"SELECT event_type, epoch, {f} AS value FROM u GROUP BY event_type, epoch"


for _name, _f in {"mean": "avg(v)", "sum": "sum(v)", "min": "min(v)", "max": "max(v)", "median": "median(v)", "std": "stddev_pop(v)", "var": "var_pop(v)", "count": "CAST(count(v) AS DOUBLE)", "ptp": "max(v) - min(v)", "prod": "product(v)"}.items():
    sql(f"sql_{_name}", f"{_name}(user)", _agg(_f), digits=2 if _name in ("prod", "var") else 6)
sql("sql_percentile", "percentile(user, 70)", _agg("quantile_cont(v, 0.7)"))
sql("sql_quantile", "quantile(user, 0.25)", _agg("quantile_cont(v, 0.25)"))
sql("sql_approx_percentile", "approx_percentile(user, 50)", _agg("quantile_disc(v, 0.5)"))
sql("sql_topk", "topk(user, 2)", "SELECT event_type, epoch, list_transform(list_sort(list(v) FILTER (v IS NOT NULL))[-2:], lambda x: x) AS value FROM u GROUP BY 1, 2 HAVING count(v) > 0 UNION ALL SELECT event_type, epoch, [] FROM u GROUP BY 1, 2 HAVING count(v) = 0")
sql("sql_as_percentage", "as_percentage(user)", "SELECT event_type, epoch, list_transform(coalesce(list_sort(list(v) FILTER (v IS NOT NULL)), []), lambda x: x * 100 / s) AS value FROM (SELECT *, sum(v) OVER (PARTITION BY event_type, epoch) AS s FROM u) GROUP BY event_type, epoch, s")
sql("sql_percent", "percent(mean(user), mean(system))", "SELECT u.event_type, u.epoch, (avg(u.v) * 100 / nullif(avg(y.v), 0)) AS value FROM u JOIN y USING (event_type, grp, epoch) GROUP BY 1, 2", base=US)
sql("sql_arith_two_fields", "system * 100 / user + 20", "SELECT event_type, grp, epoch, (y.v * 100 / nullif(u.v, 0) + 20) AS value FROM u FULL JOIN y USING (event_type, grp, epoch)", base=US)
sql("sql_arith_aggregates", "max(user) - min(user) * 2", "SELECT event_type, epoch, (max(v) - min(v) * 2) AS value FROM u GROUP BY 1, 2")
sql("sql_group_broadcast", "user / max(user)", "SELECT u.event_type, grp, u.epoch, u.v / nullif(m.v, 0) AS value FROM u LEFT JOIN (SELECT event_type, epoch, max(v) AS v FROM u GROUP BY 1, 2) m ON m.event_type = u.event_type AND m.epoch = u.epoch")
sql("sql_group_by_tags", "mean(user)", "SELECT event_type, grp, epoch, (avg(v)) AS value FROM u GROUP BY 1, 2, 3", group=", event_type, grp")
sql("sql_group_all", "sum(user)", "SELECT epoch, (sum(v)) AS value FROM u GROUP BY 1", group="")
sql("sql_where_like", "mean(user)", "SELECT event_type, epoch, (avg(v)) AS value FROM u GROUP BY 1, 2", where="AND event_type = '*c*'", base=f"WITH {EV}, {_field_sql('u', 'value', chr(65) + 'ND event_type LIKE ' + chr(39) + '%c%' + chr(39))}")
sql("sql_where_logic", "mean(user)", "SELECT event_type, epoch, (avg(v)) AS value FROM u GROUP BY 1, 2", where="AND NOT (grp = 'g1' OR grp IN ('g2'))", base=f"WITH {EV}, {_field_sql('u', 'value', chr(65) + 'ND grp NOT IN (' + chr(39) + 'g1' + chr(39) + ', ' + chr(39) + 'g2' + chr(39) + ')')}")
sql("sql_timeshift_ratio", "mean(user) / timeshift(mean(user), '1d')", "SELECT coalesce(a.event_type, b.event_type) AS event_type, coalesce(a.epoch, b.epoch) AS epoch, (a.v / nullif(b.v, 0)) AS value FROM (SELECT event_type, epoch, avg(v) AS v FROM u GROUP BY 1, 2) a FULL JOIN (SELECT event_type, epoch + 86400 AS epoch, avg(v) AS v FROM u GROUP BY 1, 2) b ON a.event_type = b.event_type AND a.epoch = b.epoch")
sql("sql_fill_previous", "user", "SELECT event_type, grp, epoch, (last_value(v IGNORE NULLS) OVER (PARTITION BY event_type, grp ORDER BY epoch)) AS value FROM u", fill="previous")
_T = "SELECT event_type, grp, epoch, {} AS value FROM u"
_O = "OVER (PARTITION BY event_type, grp ORDER BY epoch)"
sql("t_abs", "t.abs(user - 50)", _T.format("abs(v - 50)"))
sql("t_log1p", "t.log1p(user)", _T.format("ln(1 + v)"))
sql("t_sin", "sin(user)", _T.format("sin(v)"))
sql("t_clip_gradient", "t.clip(t.gradient(user), 0, 1000)", f"SELECT event_type, grp, epoch, (least(greatest(g, 0), 1000)) AS value FROM (SELECT *, CASE WHEN row_number() {_O} = 1 THEN lead(v) {_O} - v WHEN lead(epoch) {_O} IS NULL THEN v - lag(v) {_O} ELSE (lead(v) {_O} - lag(v) {_O}) / 2 END AS g FROM u) WHERE g IS NOT NULL UNION ALL SELECT event_type, grp, epoch, NULL FROM (SELECT *, CASE WHEN row_number() {_O} = 1 THEN lead(v) {_O} - v WHEN lead(epoch) {_O} IS NULL THEN v - lag(v) {_O} ELSE (lead(v) {_O} - lag(v) {_O}) / 2 END AS g FROM u) WHERE g IS NULL")
sql("t_cumsum", "t.cumsum(user)", _T.format(f"sum(v) {_O.replace(')', ' ROWS UNBOUNDED PRECEDING)')}"))
sql("t_diff", "t.diff(user)", f"SELECT event_type, grp, epoch, (d) AS value FROM (SELECT event_type, grp, epoch, v - lag(v) {_O} AS d, row_number() {_O} AS n FROM u) WHERE n > 1")
sql("t_shift", "t.shift(user, 3)", _T.format(f"lag(v, 3, 0) {_O}"))
sql("t_shift_left", "t.shift(user, -2)", _T.format(f"lead(v, 2, 0) {_O}"))
sql("t_as_percentage", "t.as_percentage(user)", _T.format("v * 100 / nullif(sum(v) OVER (PARTITION BY event_type, grp), 0)"))
sql("t_subtract", "t.subtract(system, user)", "SELECT event_type, grp, epoch, (y.v - u.v) AS value FROM u FULL JOIN y USING (event_type, grp, epoch)", base=US)
sql("t_divide", "t.divide(user, system)", "SELECT event_type, grp, epoch, (u.v / nullif(y.v, 0)) AS value FROM u FULL JOIN y USING (event_type, grp, epoch)", base=US)
sql("t_round", "t.rint(t.sqrt(user))", "SELECT event_type, grp, epoch, round_even(sqrt(v), 0) AS value FROM u")



# Transforms of single values and what DuckDB calls them (v: the value, w: the other field).
MAPPED = {
    "absolute": "abs(v)", "negative": "-v", "sign": "CAST(sign(v) AS DOUBLE)", "sqrt": "sqrt(v)", "cbrt": "cbrt(v)", "square": "v * v", "exp(user / 100)": "exp(v / 100)", "expm1(user / 100)": "exp(v / 100) - 1",
    "exp2(user / 100)": "pow(2.0, v / 100)", "log": "ln(v)", "log2": "log2(v)", "log10": "log10(v)", "cos": "cos(v)", "tan(user / 1000)": "tan(v / 1000)", "arcsin(user / 10000)": "asin(v / 10000)",
    "arccos(user / 10000)": "acos(v / 10000)", "arctan": "atan(v)", "sinh(user / 100)": "(exp(v / 100) - exp(-v / 100)) / 2", "cosh(user / 100)": "(exp(v / 100) + exp(-v / 100)) / 2",
    "tanh(user / 100)": "(exp(v / 50) - 1) / (exp(v / 50) + 1)", "degrees": "degrees(v)", "radians": "radians(v)", "floor": "CAST(floor(v) AS DOUBLE)", "ceil": "CAST(ceil(v) AS DOUBLE)",
    "trunc": "CAST(trunc(v) AS DOUBLE)", "nan_to_num": "v", "isnan": "CASE WHEN v IS NULL THEN NULL ELSE 0.0 END", "power(user, 2)": "pow(v, 2)", "arctan2(user, system)": "atan2(v, w)",
    "hypot(user, system)": "sqrt(v * v + w * w)", "maximum(user, system)": "CASE WHEN v IS NOT NULL AND w IS NOT NULL THEN greatest(v, w) END", "minimum(user, system)": "CASE WHEN v IS NOT NULL AND w IS NOT NULL THEN least(v, w) END",
    "add(user, system)": "v + w", "multiply(user, system)": "v * w", "floor_divide(system, 10)": "CAST(floor(w / 10) AS DOUBLE)",
}


@query("t_mapped", f"{US}, b AS (SELECT event_type, grp, epoch, u.v AS v, y.v AS w FROM u FULL JOIN y USING (event_type, grp, epoch)) SELECT event_type, grp, epoch, " + ", ".join(f"round({v} + {NUDGE}, 6) AS f{i}" for i, v in enumerate(MAPPED.values())) + " FROM b")
def _(spark, d):
    calls = ", ".join(f"t.{c if '(' in c else c + '(user)'} AS f{i}" for i, c in enumerate(MAPPED))
    df = planner(spark, d).columns(f"SELECT {calls} FROM ev WHERE time >= {START} AND time < {END} GROUP BY time(6h) fill(null)")
    return df.select("event_type", "grp", "epoch", *[F.round(F.col(f"f{i}") + NUDGE, 6).alias(f"f{i}") for i in range(len(MAPPED))])


sql("t_cumprod", "t.cumprod(user / user)", _T.format(f"product(v / nullif(v, 0)) {_O.replace(')', ' ROWS UNBOUNDED PRECEDING)')}"))
sql("sql_any_all", "any(user - user) + all(user)", _agg("max(CASE WHEN v - v <> 0 THEN 1.0 ELSE v * 0 END) + min(CASE WHEN v <> 0 THEN 1.0 ELSE v * 0 END)"))
sql("sql_field_pattern", 'max("*")', f"SELECT field, epoch, max(v) AS value FROM (SELECT 'user' AS field, * FROM u UNION ALL SELECT 'system', * FROM y) GROUP BY 1, 2", group=", field", base=US)
sql("sql_literal", "2 + 3 * 4", f"SELECT unnest(range({START}, {END}, 21600)) AS epoch, 14.0 AS value", group="")


@query("sql_rollup_choice", f"WITH {EV} SELECT event_type, {START} + (epoch - {START}) // 21600 * 21600 AS epoch, CAST(count(*) AS DOUBLE) AS value FROM ev WHERE epoch >= {START} AND epoch < {END} GROUP BY 1, 2")
def _(spark, d):
    ev = events(spark, d, START, END)
    bucket = F.lit(START) + F.floor((F.col("epoch") - START) / 21600) * 21600
    coarse = ev.groupBy("event_type", bucket.cast("long").alias("epoch")).agg(F.count(F.lit(1)).cast("double").alias("user"))
    tables = {"ev": Table(ev.select("event_type", "epoch", F.col("value").alias("user")), ["event_type"], ["user"], sparse=False, rollups={21600: coarse, 864000: coarse.limit(0)})}
    return SqlPlanner(tables).run(f"SELECT user FROM ev WHERE time >= {START} AND time < {END} GROUP BY time(6h) fill(null)")["user"].where(F.col("value").isNotNull())


# --- the path language -----------------------------------------------------------------------------------------------------


def _named(spark: SparkSession, d: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    name = F.concat(F.lit("clusters.c_"), (F.col("user_id") % 4).cast("string"), F.lit(".n_"), (F.col("user_id") % 3).cast("string"), F.lit(".events."), F.col("event_type"))
    return events(spark, d, lo, hi).withColumn("name", name)


def render(name: str, target: str, oracle: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        language = paths_language.GraphitePlanner(_named(spark, d, START, END).select("name", "epoch", "value"), storage_interval=86400, sparse=False)
        return rows(language.render(target, START, END, max_points=30))

    QUERIES[name], ORACLES[name] = run, f"{BASE} SELECT series_id, epoch, round(value, 6) AS value FROM ({oracle}) t"


render("render_set_pattern", "scale(clusters.c_{0,2}.n_*.events.view, 2)", "SELECT concat('scale(', sid, ',2)') AS series_id, epoch, v * 2 AS value FROM s WHERE split_part(sid, '.', 2) IN ('c_0', 'c_2') AND split_part(sid, '.', 5) = 'view'")
render("render_nested", 'alias(sumSeries(keepLastValue(clusters.*.n_1.events.*)), "all \\"n_1\\"")', """SELECT 'all "n_1"' AS series_id, epoch, sum(f) AS value FROM (SELECT epoch, last_value(v IGNORE NULLS) OVER (PARTITION BY sid ORDER BY epoch) AS f FROM s WHERE split_part(sid, '.', 3) = 'n_1') GROUP BY epoch""")
render("render_group_by_node", "groupByNode(clusters.c_?.n_[01].events.{click,view}, 4, 'max')", "SELECT split_part(sid, '.', 5) AS series_id, epoch, max(v) AS value FROM s WHERE split_part(sid, '.', 3) IN ('n_0', 'n_1') AND split_part(sid, '.', 5) IN ('click', 'view') GROUP BY 1, 2")


@query("scan_filter_like", f"WITH {EV} SELECT event_id, event_type, epoch, round(value, 6) AS value FROM ev WHERE event_type LIKE '%ic%' AND epoch > {START} AND epoch <= {END}")
def _(spark, d):
    from .plans.planner import wildcard

    return out(events(spark, d, START + 1, END + 1).where(F.col("event_type").like(wildcard("*ic*"))), "event_id", "event_type")


@query("scan_set_pattern", f"WITH {EV}, n AS (SELECT event_id, concat('clusters.c_', user_id % 4, '.n_', user_id % 3, '.events.', event_type) AS name, epoch, value FROM ev) SELECT event_id, name, epoch, round(value, 6) AS value FROM n WHERE regexp_matches(name, '^clusters\\.c_[13]\\.n_[^.]*\\.events\\.(click|error)$')")
def _(spark, d):
    return out(_named(spark, d).where(paths_language.path_predicate("clusters.c_{1,3}.n_*.events.{click;error}", F.col("name"))), "event_id", "name")


# --- text forms --------------------------------------------------------------------------------------------------------------


@query("parse_influx_lines", f"WITH {EV} SELECT concat('m_', event_type) AS datasource, f AS field, concat('c', user_id % 4) AS cluster, epoch, CASE WHEN f = 'cpu' THEN value ELSE CAST(event_id AS DOUBLE) END AS value, event_id AS id FROM ev, (VALUES ('cpu'), ('n')) t(f)")
def _(spark, d):
    line = F.concat(F.lit("m_"), "event_type", F.lit(",cluster=c"), (F.col("user_id") % 4).cast("string"), F.lit(",id="), F.col("event_id").cast("string"), F.lit(" cpu="), F.col("value").cast("string"), F.lit(",n="), F.col("event_id").cast("string"), F.lit("i "), F.col("epoch").cast("string"), F.lit("000000000"))
    points = codec.parse_influx(events(spark, d).select(line.alias("line")))
    return points.select("datasource", "field", F.col("tags")["cluster"].alias("cluster"), "epoch", "value", F.col("tags")["id"].cast("long").alias("id"))


@query("parse_graphite_lines", f"WITH {EV} SELECT event_type AS field, concat('c_', user_id % 4) AS tkn1, '4' AS tkns, epoch, value, event_id AS id FROM ev")
def _(spark, d):
    line = F.concat(F.lit("clusters.c_"), (F.col("user_id") % 4).cast("string"), F.lit(".e"), F.col("event_id").cast("string"), F.lit("."), "event_type", F.lit(" "), F.col("value").cast("string"), F.lit(" "), F.col("epoch").cast("string"))
    points = codec.parse_auto(events(spark, d).select(line.alias("line")))
    return points.select("field", F.col("tags")["tkn1"].alias("tkn1"), F.col("tags")["tkns"].alias("tkns"), "epoch", "value", F.substring(F.col("tags")["tkn2"], 2, 20).cast("long").alias("id"))


@query("series_ids", f"WITH {EV} SELECT DISTINCT concat('ev|type=', event_type, '|user=u', user_id % 4, '|value') AS series_id, concat('u', user_id % 4) AS user FROM ev")
def _(spark, d):
    tags = F.create_map(F.lit("user"), F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")), F.lit("type"), F.col("event_type"), F.lit("_datapoint_version"), F.col("event_id").cast("string"))
    sid = codec.series_id(F.lit("ev"), tags, F.lit("value"))
    return events(spark, d).select(sid.alias("series_id")).distinct().select("series_id", codec.parse_series_id(F.col("series_id"))["tags"]["user"].alias("user"))


@query("json_codec", f"WITH {EV} SELECT event_id, epoch AS time, value, event_type AS tag FROM ev")
def _(spark, d):
    body = codec.point_json(F.col("epoch"), F.col("value"), F.lit("f"), F.create_map(F.lit("type"), F.col("event_type")))
    return events(spark, d).select("event_id", F.from_json(body, "time long, value double, type string").alias("j")).select("event_id", "j.time", "j.value", F.col("j.type").alias("tag"))


@query("marker_codec", f"WITH {EV} SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 WHEN event_id % 5 = 1 THEN -3 WHEN event_id % 5 = 2 THEN -3.14159 WHEN event_id % 5 = 3 THEN -9.42477 ELSE value END AS stored, CASE WHEN event_id % 5 = 0 THEN 'missing' WHEN event_id % 5 = 1 THEN 'tombstone' END AS marker, CASE WHEN event_id % 5 = 2 THEN -1.0 WHEN event_id % 5 = 3 THEN -3.0 WHEN event_id % 5 = 4 THEN value END AS value FROM ev")
def _(spark, d):
    k = F.col("event_id") % 5
    stored = codec.stored_value(F.when(k == 2, -1.0).when(k == 3, -3.0).otherwise(F.col("value")), F.when(k == 0, "missing").when(k == 1, "tombstone"))
    value, marker = codec.loaded_value(F.col("stored"))
    return events(spark, d).select("event_id", stored.alias("stored")).select("event_id", "stored", marker.alias("marker"), value.alias("value"))


# Field names and what kind of metric each is.
FIELD_KINDS = {
    "m.m1_rate": "meter", "m.mean_rate": "meter", "m.p99": "histogram", "m.p95": "histogram", "m.p75": "histogram", "m.p50": "histogram", "m.max": "histogram", "m.min": "histogram",
    "m.mean": "histogram", "m.stddev": "histogram", "m.total": "histogram", "m.count": "counter", "m.discount": "gauge", "m.meter": "gauge", "clusters.c.admin.value": "gauge",
    "m.median": "gauge", "maximum": "gauge", "m.p98": "histogram", "m.value": "gauge", "count": "gauge",
}
_KIND = "(VALUES " + ", ".join(f"({i}, '{n}', '{k}')" for i, (n, k) in enumerate(FIELD_KINDS.items())) + ") t(i, name, kind)"


@query("metric_type", f"SELECT p_partkey, t.name, t.kind, CASE WHEN t.kind = 'histogram' THEN split_part(t.name, '.', -1) END AS category, CASE WHEN len(string_split(t.name, '.')) > 2 THEN concat_ws('.', split_part(t.name, '.', 2), split_part(t.name, '.', 3)) ELSE t.name END AS component FROM part JOIN {_KIND} ON t.i = p_partkey % {len(FIELD_KINDS)}")
def _(spark, d):
    name = F.get(F.array(*map(F.lit, FIELD_KINDS)), (F.col("p_partkey") % len(FIELD_KINDS)).cast("int"))
    named = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", name.alias("name"))
    return named.select("p_partkey", "name", codec.metric_kind(F.col("name")).alias("kind"), codec.histogram_category(F.col("name")).alias("category"), codec.component(F.col("name")).alias("component"))


@query("template_tags", BASE + " SELECT DISTINCT sid AS name, concat_ws('.', split_part(sid, '.', 1), split_part(sid, '.', 4)) AS measurement, split_part(sid, '.', 2) AS cluster, split_part(sid, '.', 5) AS field FROM s")
def _(spark, d):
    names = _named(spark, d).select("name").distinct()
    t = codec.template_tags(F.col("name"), "measurement.cluster.node.measurement.field*")
    return names.select("name", t["measurement"].alias("measurement"), t["cluster"].alias("cluster"), t["field"].alias("field"))


@query("allow_deny_filter", BASE + " SELECT DISTINCT sid AS name FROM s WHERE regexp_matches(sid, 'events\\.(view|click)') AND NOT regexp_matches(sid, 'n_2')")
def _(spark, d):
    return _named(spark, d).where(codec.allowed(F.col("name"), paths_language.glob("*events.{view,click}"), paths_language.glob("*n_2*"))).select("name").distinct()


# --- the write path ----------------------------------------------------------------------------------------------------------------


def _steps(spark: SparkSession, d: str) -> DataFrame:
    """Coarse values by event type, so that neighbours often agree."""
    return by_type(spark, d).select(F.col("event_type").alias("series_id"), "epoch", F.floor(F.col("value") / 40).cast("double").alias("value"))


STEPS = PTS + ", st AS (SELECT event_type AS series_id, epoch, floor(value / 40) AS value FROM pts)"


@query("sparse_lossless", f"WITH {STEPS} SELECT series_id, epoch, value FROM (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY epoch) AS b FROM st) WHERE value IS DISTINCT FROM b")
def _(spark, d):
    return sparse.changes(_steps(spark, d), ["series_id"])


def _machine(test: str, forced: int = 10**9) -> str:
    """The recursion over what was written last."""
    return f"""WITH RECURSIVE {PTS.replace('ev AS', 'ev AS', 1)}, st AS (SELECT event_type AS series_id, epoch, value, row_number() OVER (PARTITION BY event_type ORDER BY epoch) AS n FROM pts),
r AS (SELECT series_id, n, epoch, value, value AS w, epoch AS we, 'first' AS decision FROM st WHERE n = 1
  UNION ALL SELECT s.series_id, s.n, s.epoch, s.value, CASE WHEN {test} OR s.epoch - r.we > {forced} THEN s.value ELSE r.w END, CASE WHEN {test} OR s.epoch - r.we > {forced} THEN s.epoch ELSE r.we END,
    CASE WHEN {test} THEN 'changed' WHEN s.epoch - r.we > {forced} THEN 'forced' ELSE 'dropped' END FROM r JOIN st s ON s.series_id = r.series_id AND s.n = r.n + 1)
SELECT series_id, epoch, round(value, 6) AS value, decision FROM r"""


def _decided(spark: SparkSession, d: str, rule: sparse.Rule) -> DataFrame:
    points = by_type(spark, d).withColumnRenamed("event_type", "series_id")
    return sparse.decide(points, [rule]).select("series_id", "epoch", F.round("value", 6).alias("value"), "decision")


@query("sparse_delta", _machine("(CASE WHEN r.w > 0 THEN abs(s.value - r.w) / r.w > 0.5 ELSE s.value <> r.w END)"))
def _(spark, d):
    return _decided(spark, d, sparse.Rule("delta", min_delta=0.5, gap=10**9, forced=10**9))


@query("forced_write", _machine("(CASE WHEN r.w > 0 THEN abs(s.value - r.w) / r.w > 5.0 ELSE s.value <> r.w END)", 1800))
def _(spark, d):
    return _decided(spark, d, sparse.Rule("delta", min_delta=5.0, gap=10**9, forced=1800))


@query("sparse_percentile", _machine("(CASE WHEN s.q > 0 THEN abs(s.value - r.w) / s.q > 0.5 ELSE s.value <> r.w END)").replace(
    "AS n FROM pts)", "AS n, list_sort(list(value) OVER (PARTITION BY event_type ORDER BY epoch ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) AS before FROM pts0), pq AS (SELECT 1)", 1).replace("FROM pts0), pq AS (SELECT 1)", "FROM pts), st2 AS (SELECT *, before[greatest(1, CAST(ceil(len(before) * 0.9) AS INTEGER))] AS q FROM st)", 1).replace("FROM st WHERE n = 1", "FROM st2 WHERE n = 1").replace("JOIN st s", "JOIN st2 s"))
def _(spark, d):
    return _decided(spark, d, sparse.Rule("percentile", min_delta=0.5, gap=10**9, forced=10**9))


@query("drop_ratio", f"WITH {STEPS} SELECT series_id, count(*) AS received, sum(CASE WHEN value IS NOT DISTINCT FROM b THEN 1 ELSE 0 END)::BIGINT AS dropped, sum(CASE WHEN value IS NOT DISTINCT FROM b THEN 0 ELSE 1 END)::BIGINT AS written, round(sum(CASE WHEN value IS NOT DISTINCT FROM b THEN 1 ELSE 0 END) / count(*), 6) AS drop_ratio FROM (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY epoch) AS b FROM st) GROUP BY series_id")
def _(spark, d):
    found = sparse.decide(_steps(spark, d), [sparse.Rule("lossless", gap=10**9, forced=10**9)])
    return sparse.drop_report(found, "series_id").withColumn("drop_ratio", F.round("drop_ratio", 6))


@query("gap_markers", f"WITH {PTS} SELECT event_type, epoch + 1800 AS epoch, 'missing' AS marker FROM (SELECT event_type, epoch, lead(epoch) OVER (PARTITION BY event_type ORDER BY epoch) AS n FROM pts) WHERE n - epoch > 1800")
def _(spark, d):
    return sparse.gap_markers(by_type(spark, d), ["event_type"], 1800)


@query("tombstones", f"WITH {EV} SELECT event_type, user_id, max(epoch) + 600 AS epoch, 'tombstone' AS marker FROM ev GROUP BY 1, 2 HAVING {END} - max(epoch) > 86400")
def _(spark, d):
    return sparse.tombstones(events(spark, d), ["event_type", "user_id"], 600, END, 86400)


@query("bundle_tombstones", f"WITH {EV} SELECT event_type, max(epoch) + 600 AS epoch, 'tombstone' AS marker, CAST(7 AS BIGINT) AS version FROM ev GROUP BY 1")
def _(spark, d):
    return sparse.bundle_tombstones(events(spark, d), ["event_type"], 600, 7)


@query("new_series_keys", f"WITH {EV} SELECT event_type, user_id, min(epoch) AS epoch FROM ev WHERE epoch >= {START + 864000} AND (event_type, user_id) NOT IN (SELECT DISTINCT event_type, user_id FROM ev WHERE epoch < {START + 864000}) GROUP BY 1, 2")
def _(spark, d):
    return sparse.new_keys(events(spark, d, START + 864000, END), events(spark, d, START, START + 864000), ["event_type", "user_id"])


@query("drops_by_kind", f"WITH {STEPS} SELECT CASE WHEN series_id = 'click' THEN 'histogram' WHEN series_id = 'view' THEN 'counter' ELSE 'gauge' END AS kind, count(*) AS received, sum(CASE WHEN value IS NOT DISTINCT FROM b THEN 1 ELSE 0 END)::BIGINT AS dropped FROM (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY epoch) AS b FROM st) GROUP BY 1")
def _(spark, d):
    found = sparse.decide(_steps(spark, d), [sparse.Rule("lossless", gap=10**9, forced=10**9)])
    suffix = F.when(F.col("series_id") == "click", ".p99").when(F.col("series_id") == "view", ".count").otherwise(".value")
    return sparse.drop_report(found.withColumn("kind", codec.metric_kind(F.concat("series_id", suffix))), "kind").select("kind", "received", "dropped")


@query("cross_cluster_copy", BASE + """, p AS (SELECT DISTINCT sid AS name FROM s) SELECT name, concat('ts_', 0) AS datasource FROM p UNION ALL SELECT name, 'ts_ccluster_0' FROM p WHERE regexp_matches(name, 'events\\.(click|view)$')""")
def _(spark, d):
    config = Config(datasources={"": "ts"}, cross_cluster=("clusters.*.events.click", "clusters.*.events.view"))
    return config.with_cross_cluster(_named(spark, d).select("name").distinct()).select("name", "datasource")


@query("stream_transform_rate", f"WITH {PTS} SELECT event_type, epoch, round((value - lag(value) OVER w) / nullif(epoch - lag(epoch) OVER w, 0), 8) AS value, CASE WHEN lag(epoch) OVER w IS NULL THEN 'missing' END AS marker FROM pts WINDOW w AS (PARTITION BY event_type ORDER BY epoch)")
def _(spark, d):
    return sparse.rate(by_type(spark, d), ["event_type"]).withColumn("value", F.round("value", 8))


for _how, _value in {"mean": "sum(v * d) / nullif(sum(CASE WHEN v IS NOT NULL THEN d END), 0)", "max": "max(v)", "last": "max_by(v, CASE WHEN v IS NOT NULL THEN t0 END)", "sum": "sum(v * d)"}.items():
    QUERIES[f"rollup_{_how}"] = lambda spark, d, how=_how: rollup.rollup(by_type(spark, d, START - (END - START), END), ["event_type"], SIXES, how).withColumn("value", F.round("value", 4))
    ORACLES[f"rollup_{_how}"] = "WITH " + twm_sql(21600, _value).replace(f"epoch > {START - R.LOOKBACK}", f"epoch > {START - (END - START)}") + " SELECT event_type, epoch + 21600 AS epoch, round(value, 4) AS value, CASE WHEN value IS NULL THEN 'missing' END AS marker FROM dense"


@query("late_early_filter", f"WITH {EV} SELECT event_id, epoch FROM ev WHERE {START + 15 * 86400} - epoch <= 5 * 86400 AND {START + 15 * 86400} - epoch >= -2 * 86400")
def _(spark, d):
    from .sources.files import in_time

    return in_time(events(spark, d).withColumn("server_rx_epoch", F.lit(START + 15 * 86400)), 5 * 86400, 2 * 86400).select("event_id", "epoch")


@query("series_catalog", f"WITH {EV} SELECT event_type, CAST(make_timestamp(epoch * 1000000) AS DATE) AS day, min(epoch) AS epoch FROM ev GROUP BY 1, 2")
def _(spark, d):
    return sparse.catalog(events(spark, d), ["event_type"])


@query("bands")
def _(spark, d):
    return bands.bands(events(spark, d), "event_type", max_width=0.2)


@query("band_thinning")
def _(spark, d):
    ev = events(spark, d)
    thin = bands.thin_by_bands(ev, "event_type", bands.bands(ev, "event_type", max_width=0.2))
    return thin.groupBy("event_type").agg(F.count(F.lit(1)).alias("points"), F.count_if("outlier").alias("outliers"), F.countDistinct("value").alias("levels"))


@query("histogram", f"WITH {EV}, e AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM ev GROUP BY 1) SELECT event_type, CAST(least(floor((value - lo) / greatest((hi - lo) / 50, 1e-12)), 49) AS INTEGER) AS bin, round(min(lo + (least(floor((value - lo) / greatest((hi - lo) / 50, 1e-12)), 49) + 0.5) * greatest((hi - lo) / 50, 1e-12)), 6) AS center, count(*) AS n FROM ev JOIN e USING (event_type) GROUP BY 1, 2")
def _(spark, d):
    return bands.histogram(events(spark, d), ["event_type"], 50).withColumn("center", F.round("center", 6))


# --- detection and metadata ------------------------------------------------------------------------------------------------------------


_Z = "1 - exp(-power((v - avg(v) OVER (PARTITION BY sid)) / nullif(stddev_pop(v) OVER (PARTITION BY sid), 0), 2) / 2) / sqrt(2 * pi())"


@query("anomaly_gaussian", BASE + f" SELECT sid AS series_id, epoch, round({_Z}, 6) AS score, coalesce({_Z} > 0.95, false) AS anomalous FROM s")
def _(spark, d):
    return anomaly.gaussian(paths(spark, d).df, ["series_id"], 0.95).select("series_id", "epoch", F.round("score", 6).alias("score"), "anomalous")


_ZG = _Z.replace("PARTITION BY sid", "PARTITION BY split_part(sid, '.', 2)")


@query("anomaly_grouped", BASE + f" SELECT sid AS series_id, epoch, round({_ZG}, 6) AS score, coalesce({_ZG} > 0.95, false) AS anomalous FROM s")
def _(spark, d):
    return anomaly.gaussian(paths(spark, d).df, ["series_id"], 0.95, tokens=[1]).select("series_id", "epoch", F.round("score", 6).alias("score"), "anomalous")


@query("anomaly_static", BASE + " SELECT sid AS series_id, epoch, coalesce(v > 80, false) AS anomalous FROM s")
def _(spark, d):
    return anomaly.static(paths(spark, d).df, ["series_id"], 80).select("series_id", "epoch", "anomalous")


@query("anomaly_runs", BASE + """, b AS (SELECT sid, epoch FROM s WHERE v < 40), n AS (SELECT *, CASE WHEN epoch - lag(epoch) OVER (PARTITION BY sid ORDER BY epoch) <= 86400 THEN 0 ELSE 1 END AS new FROM b),
k AS (SELECT *, sum(new) OVER (PARTITION BY sid ORDER BY epoch) AS run FROM n) SELECT sid AS series_id, min(epoch) AS "start", max(epoch) AS "end", count(*) AS points, 1.0 AS score FROM k GROUP BY sid, run""")
def _(spark, d):
    return anomaly.detect(paths(spark, d).df, ["series_id"], 86400, "static", threshold=40, comparator="lt")


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    tags = F.create_map(F.lit("measurement"), F.concat(F.lit("m_"), F.col("event_type")), F.lit("cluster"), F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")), F.lit("node"), F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string")))
    return events(spark, d).select(tags.alias("tags"), F.when(F.col("user_id") % 2 == 0, "cpu").otherwise("disk").alias("field"), "epoch", "value")


@query("show_measurements", f"WITH {EV} SELECT DISTINCT concat('m_', event_type) AS name FROM ev WHERE contains(concat('m_', event_type), 'c')")
def _(spark, d):
    return explore.show(_tagged(spark, d), "SHOW MEASUREMENTS WITH MEASUREMENT =~ /c/ LIMIT 50")


@query("show_retention", "SELECT 'default' AS name")
def _(spark, d):
    return explore.show(_tagged(spark, d), "SHOW RETENTION POLICIES ON db")


@query("information_schema", "SELECT 'ev' AS datasource, * FROM (VALUES ('event_id', 'metric'), ('user_id', 'metric'), ('event_type', 'dimension'), ('epoch', 'time'), ('value', 'metric')) t(name, kind)")
def _(spark, d):
    return explore.information_schema({"ev": events(spark, d)})


@query("dedupe_min", f"WITH {EV} SELECT event_type, epoch, min(value) AS value FROM ev GROUP BY 1, 2")
def _(spark, d):
    return R.dedupe(events(spark, d), ["event_type"])


# Literals of time spans, and the same as SQL has them.
SPANS = {"10": "10 seconds", "90s": "90 seconds", "5min": "5 minutes", "5m": "5 minutes", "1h": "1 hour", "2d": "2 days", "1w": "7 days", "1mon": "30 days", "1y": "365 days"}


@query("time_spans", "SELECT text, CAST(epoch(span) AS BIGINT) AS seconds FROM (VALUES " + ", ".join(f"('{k}', INTERVAL '{v}')" for k, v in SPANS.items()) + ") t(text, span)")
def _(spark, d):
    return spark.createDataFrame([(k, interval_seconds(k)) for k in SPANS], "text string, seconds long")


@query("show_field_keys", f"WITH {EV} SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'cpu' ELSE 'disk' END AS field FROM ev WHERE event_type = 'click'")
def _(spark, d):
    return explore.show(_tagged(spark, d), 'SHOW FIELD KEYS FROM "m_click"')


@query("show_tag_keys", "SELECT unnest(['measurement', 'cluster', 'node']) AS tag")
def _(spark, d):
    return explore.show(_tagged(spark, d), "SHOW TAG KEYS FROM m_click")


@query("show_tag_values", f"WITH {EV} SELECT DISTINCT concat('n', user_id % 3) AS value FROM ev WHERE event_type = 'click' AND user_id % 4 = 1")
def _(spark, d):
    return explore.show(_tagged(spark, d), "SHOW TAG VALUES FROM m_click WITH KEY = node AND cluster = 'c1'")


@query("find_children", BASE + " SELECT DISTINCT split_part(sid, '.', 3) AS text, false AS leaf FROM s WHERE split_part(sid, '.', 2) IN ('c_0', 'c_1') ORDER BY 1 LIMIT 200")
def _(spark, d):
    return explore.find_children(_named(spark, d).select("name").distinct(), "clusters.c_{0,1}.*")


@query("leaf_counts", BASE + " SELECT concat_ws('.', split_part(sid, '.', 1), split_part(sid, '.', 2)) AS prefix, count(DISTINCT sid) AS leaves FROM s GROUP BY 1")
def _(spark, d):
    return explore.leaf_counts(_named(spark, d).select("name").distinct(), 2)


@query("missing_ranges", f"SELECT * FROM (VALUES ({START}, {START + 3600}), ({START + 10800}, {START + 14400})) t(\"start\", \"end\")")
def _(spark, d):
    wanted = TimeRange(START, START + 14400, 3600)
    found = missing(wanted, [TimeRange(START + 3600, START + 7200, 3600), TimeRange(START + 7200, START + 10800, 3600)])
    return spark.createDataFrame([(r.start, r.end) for r in found], "start long, end long")


@query("shard_adler32", BASE + """, n AS (SELECT DISTINCT sid AS name, list_transform(string_split(sid, ''), lambda c: ord(c)) AS codes FROM s)
SELECT name, CAST((((len(codes) + list_sum(list_transform(codes, lambda c, i: (len(codes) - i + 1) * c))) % 65521) * 65536 + (1 + list_sum(codes)) % 65521) % 8 AS INTEGER) AS shard FROM n""")
def _(spark, d):
    names = _named(spark, d).select("name").distinct()
    return names.select("name", adler_shard(F.col("name"), F.lit(8)).alias("shard"))
