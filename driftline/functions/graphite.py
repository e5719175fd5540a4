"""Functions on lists of series, by their names in the path-query language."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.series import ROW, Series, bounded, by_number, by_text, collapse, renamed, reversed_text, single, union
from ..operators.timerange import TimeRange
from .timeparse import interval_seconds

REGISTRY: dict[str, Callable] = {}
#: Functions whose result on a range is not made of results on its parts; a cache keeps their inputs instead.
NOT_DECOMPOSABLE: set[str] = set()


def graphite_function(*names: str, decomposable: bool = True):
    """Register f(rng, *args); lists of series arrive as ``Series``."""

    def add(f: Callable) -> Callable:
        for name in names or (f.__name__,):
            REGISTRY[name] = f
            if not decomposable:
                NOT_DECOMPOSABLE.add(name)
        return f

    return add


def V() -> Column:  # a column needs a session, which a module has not at import
    return F.col("value")


# --- names -------------------------------------------------------------------------------------------------------


@graphite_function("alias")
def alias(rng, s: Series, name: str) -> Series:
    return replace(s, df=s.df.withColumn("series_id", F.lit(name)).withColumn("base_series_id", F.lit(name)))


@graphite_function("aliasSub")
def alias_sub(rng, s: Series, search: str, replacement: str) -> Series:
    new = F.regexp_replace("base_series_id", search, re.sub(r"\\(\d)", r"$\1", replacement))
    return replace(s, df=s.df.withColumn("series_id", new).withColumn("base_series_id", F.col("series_id")))


def node_key(s: Series, nodes, keep: bool = True) -> Column:
    """Tokens of the base id at (or, without ``keep``, not at) the given places, in path order."""
    chosen = F.array(*[F.lit(int(n)) for n in sorted(set(nodes))]) if nodes else F.array().cast("array<int>")
    hit = lambda t, i: F.array_contains(chosen, i) if keep else ~F.array_contains(chosen, i)
    return F.array_join(F.filter(s.tokens(), hit), ".")


@graphite_function("aliasByNode")
def alias_by_node(rng, s: Series, *nodes) -> Series:
    return replace(s, df=s.df.withColumn("series_id", node_key(s, nodes)).withColumn("base_series_id", F.col("series_id")))


# --- order and choice of series -----------------------------------------------------------------------------------


def _sorted_by(s: Series, value: Column, desc: bool, default: float | None = None) -> Series:
    """By an aggregate of each series; the exchange by series is that of the aggregate, sorting adds none."""
    rows = replace(s, df=s.df.withColumn("k", F.coalesce(s.whole(value), F.lit(default))))
    return rows.before(by_number(-F.col("k") if desc else F.col("k")))


@graphite_function("sortByName", decomposable=False)
def sort_by_name(rng, s: Series, natural: bool = False, reverse: bool = False) -> Series:
    if natural:
        raise ValueError("natural order is not supported")
    return s.before(by_text(reversed_text(F.col("series_id")) if reverse else F.col("series_id")))


@graphite_function("sortByMaxima", decomposable=False)
def sort_by_maxima(rng, s: Series) -> Series:
    return _sorted_by(s, F.max("value"), True, -1.0)


@graphite_function("sortByMinima", decomposable=False)
def sort_by_minima(rng, s: Series) -> Series:
    return _sorted_by(s.where(F.max("value"), lambda k: k > 0), F.min("value"), False)


@graphite_function("sortByTotal", decomposable=False)
def sort_by_total(rng, s: Series) -> Series:
    return _sorted_by(s, F.sum("value"), False, 0.0)


@graphite_function("limit", decomposable=False)
def limit(rng, s: Series, n: int) -> Series:
    return s.slice(0, max(0, int(n)))


def _measure(how: str) -> Column:
    how = {"avg": "average", "last": "current"}.get(how, how)
    chosen = {"average": F.avg("value"), "max": F.max("value"), "current": F.max_by("value", "epoch"), "min": F.min("value"), "sum": F.sum("value")}
    if how not in chosen:
        raise ValueError(f"unknown measure {how!r}")
    return chosen[how]


@graphite_function("highest", decomposable=False)
def highest(rng, s: Series, n: int = 1, how: str = "average") -> Series:
    """The n series of the largest measure, largest first; equals in their order. No measure counts as -1.

    The n places meet in one task and are sent to the rows; no row of a series is shuffled.
    """
    k = F.coalesce(_measure(how), F.lit(-1.0))
    top = s.df.groupBy("place").agg(k.alias("k")).orderBy(F.col("k").desc(), "place").limit(int(n))
    rows = replace(s, df=s.df.join(bounded(top, int(n)), "place"))
    return rows.before(by_number(-F.col("k")))


@graphite_function("highestAverage", decomposable=False)
def highest_average(rng, s: Series, n: int = 1) -> Series:
    return highest(rng, s, n, "average")


@graphite_function("highestCurrent", decomposable=False)
def highest_current(rng, s: Series, n: int = 1) -> Series:
    return highest(rng, s, n, "current")


@graphite_function("highestMax", decomposable=False)
def highest_max(rng, s: Series, n: int = 1) -> Series:
    return highest(rng, s, n, "max")


@graphite_function("currentAbove", decomposable=False)
def current_above(rng, s: Series, n: float) -> Series:
    return s.where(F.max_by("value", "epoch"), lambda k: k >= n)


@graphite_function("averageAbove", decomposable=False)
def average_above(rng, s: Series, n: float) -> Series:
    return s.where(F.avg("value"), lambda k: k >= n)


@graphite_function("maximumAbove", decomposable=False)
def maximum_above(rng, s: Series, n: float) -> Series:
    return s.where(F.max("value"), lambda k: k >= n)


@graphite_function("exclude")
def exclude(rng, s: Series, pattern: str) -> Series:
    return replace(s, df=s.df.where(~F.col("series_id").contains(pattern)))


@graphite_function("removeEmptySeries", decomposable=False)
def remove_empty_series(rng, s: Series, x_files_factor: float = 0) -> Series:
    """Series with at least one value, and at least that share of their points."""
    w = Window.partitionBy("place")
    counted = s.df.withColumn("k", F.count("value").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    return replace(s, df=counted.where(F.col("k") >= F.greatest(F.lit(1.0), F.col("n") * float(x_files_factor))).select(*ROW))


# --- each value by itself or with its neighbours -------------------------------------------------------------------


@graphite_function("absolute")
def absolute(rng, s: Series) -> Series:
    return s.with_value(F.abs("value"), "absolute")


@graphite_function("scale")
def scale(rng, s: Series, factor: float) -> Series:
    return s.with_value(V() * float(factor), "scale", factor)


@graphite_function("offset")
def offset(rng, s: Series, amount: float) -> Series:
    return s.with_value(V() + float(amount), "offset", amount)


@graphite_function("scaleToSeconds")
def scale_to_seconds(rng, s: Series, seconds: float) -> Series:
    return s.with_value(V() * (float(seconds) / s.rng.interval), "scaleToSeconds", seconds)


@graphite_function("isNonNull")
def is_non_null(rng, s: Series) -> Series:
    return s.with_value(V().isNotNull().cast("double"), "isNonNull")


@graphite_function("transformNull")
def transform_null(rng, s: Series, default: float = 0, reference=None) -> Series:
    if reference is not None:
        raise ValueError("a reference series is not supported")
    return s.with_value(F.coalesce("value", F.lit(float(default))), "transformNull", *([default] if default else []))


@graphite_function("removeAboveValue")
def remove_above_value(rng, s: Series, n: float) -> Series:
    return s.with_value(F.when(V() <= float(n), V()), "removeAboveValue", n)


@graphite_function("removeBelowValue")
def remove_below_value(rng, s: Series, n: float) -> Series:
    return s.with_value(F.when(V() >= float(n), V()), "removeBelowValue", n)


@graphite_function("changed", decomposable=False)
def changed(rng, s: Series) -> Series:
    before = F.lag("value").over(s.over())
    return s.with_value(F.coalesce((V() != before).cast("double"), F.lit(0.0)), "changed")


@graphite_function("delay", decomposable=False)
def delay(rng, s: Series, steps: int) -> Series:
    if int(steps) < 0:
        raise ValueError("steps must not be negative")
    return s if not int(steps) else s.with_value(F.lag("value", int(steps)).over(s.over()), "delay", f" {steps}")


@graphite_function("nonNegativeDerivative", "counter_delta")
def non_negative_derivative(rng, s: Series) -> Series:
    step = V() - F.lag("value").over(s.over())
    return s.with_value(F.when(step >= 0, step), "nonNegativeDerivative")


@graphite_function("integral", decomposable=False)
def integral(rng, s: Series) -> Series:
    run = F.sum("value").over(s.over().rowsBetween(Window.unboundedPreceding, 0))
    return s.with_value(F.coalesce(run, F.lit(0.0)), "integral")


@graphite_function("movingAverage", decomposable=False)
def moving_average(rng, s: Series, window) -> Series:
    """Mean of the values in the window that ends at each point; numbers are seconds."""
    n = max(1, interval_seconds(window) // s.rng.interval)
    return s.with_value(F.avg("value").over(s.over().rowsBetween(1 - n, 0)), "movingAverage", window)


@graphite_function("keepLastValue", decomposable=False)
def keep_last_value(rng, s: Series, limit: int = 0) -> Series:
    """Nulls take the value before. With a limit, points further than that from their value are left out."""
    w = s.over()
    out = s.with_value(F.last("value", ignorenulls=True).over(w), "keepLastValue", *([limit] if limit else []))
    if limit:
        run = s.df.withColumn("island", F.sum(V().isNotNull().cast("int")).over(w))
        age = F.row_number().over(Window.partitionBy("place", "island").orderBy("epoch")) - 1
        late = run.withColumn("age", age + F.when(F.col("island") == 0, 1).otherwise(0)).withColumn("filled", F.last("value", ignorenulls=True).over(w))
        late = late.where((F.col("age") <= int(limit)) | F.col("island").eqNullSafe(0)).withColumn("value", F.col("filled"))
        return replace(s, df=renamed(late.select(*ROW), "keepLastValue", limit))
    return out


_REDUCE = {
    "sum": lambda v: F.sum(v), "total": lambda v: F.sum(v), "average": lambda v: F.avg(v), "avg": lambda v: F.avg(v), "mean": lambda v: F.avg(v),
    "median": lambda v: F.median(v), "min": lambda v: F.min(v), "max": lambda v: F.max(v), "std": lambda v: F.stddev_pop(v), "stddev": lambda v: F.stddev_pop(v),
    "var": lambda v: F.var_pop(v), "prod": lambda v: F.product(v), "multiply": lambda v: F.product(v), "ptp": lambda v: F.max(v) - F.min(v), "range": lambda v: F.max(v) - F.min(v),
    "count": lambda v: F.count(v).cast("double"), "last": lambda v: F.max_by(v, F.when(v.isNotNull(), F.col("epoch"))),
    "minSeries": lambda v: F.min(v), "maxSeries": lambda v: F.max(v), "sumSeries": lambda v: F.sum(v), "averageSeries": lambda v: F.avg(v),
}


def reducer(name: str) -> Callable[[Column], Column]:
    if name not in _REDUCE:
        raise ValueError(f"unknown aggregate {name!r}")
    return _REDUCE[name]


@graphite_function("summarize", decomposable=False)
def summarize(rng, s: Series, interval, how: str = "sum", align_to_from: bool = False) -> Series:
    """Tumbling buckets labelled with their start: multiples of the interval, or counted from the range's start."""
    step = max(interval_seconds(interval), s.rng.interval)
    origin = s.rng.start if align_to_from else s.rng.start // step * step
    bucket = F.lit(origin) + F.floor((F.col("epoch") - origin) / step) * step
    out = s.df.groupBy("place", "series_id", "base_series_id", bucket.alias("bucket")).agg(reducer(how)(V()).alias("value")).withColumnRenamed("bucket", "epoch")
    end = origin + -(-(s.rng.end - origin) // step) * step
    return Series(renamed(out.select(*ROW), "summarize", interval, how), TimeRange(origin, end, step))


@graphite_function("timeShift")
def time_shift(rng, s: Series, by) -> Series:
    d = interval_seconds(by)
    return Series(renamed(s.df.withColumn("epoch", F.col("epoch") + d), "timeShift", by), s.rng.shifted(d))


@graphite_function("nPercentile", decomposable=False)
def n_percentile(rng, s: Series, n: float) -> Series:
    """Each series as the constant of its percentile (linear interpolation)."""
    return s.with_value(F.percentile("value", float(_percent(n)) / 100).over(Window.partitionBy("place")), "nPercentile", n)


def _percent(n: float) -> float:
    if not 0 <= float(n) <= 100:
        raise ValueError("a percentile lies in 0..100")
    return n


@graphite_function("removeAbovePercentile", decomposable=False)
def remove_above_percentile(rng, s: Series, n: float) -> Series:
    p = F.percentile("value", float(_percent(n)) / 100).over(Window.partitionBy("place"))
    return s.with_value(F.when(V() <= p, V()), "removeAbovePercentile", n)


@graphite_function("removeBelowPercentile", decomposable=False)
def remove_below_percentile(rng, s: Series, n: float) -> Series:
    p = F.percentile("value", float(_percent(n)) / 100).over(Window.partitionBy("place"))
    return s.with_value(F.when(V() >= p, V()), "removeBelowPercentile", n)


# --- several series into one -----------------------------------------------------------------------------------------


def _all(lists) -> Series:
    return union(list(lists)) if len(lists) > 1 else lists[0]


@graphite_function("group")
def group(rng, *lists: Series) -> Series:
    return _all(lists)


@graphite_function("maxSeries")
def max_series(rng, *lists: Series) -> Series:
    s = _all(lists)
    return collapse(s.df, s.rng, F.max("value"), "maxSeries")


@graphite_function("minSeries")
def min_series(rng, *lists: Series) -> Series:
    s = _all(lists)
    return collapse(s.df, s.rng, F.min("value"), "minSeries")


@graphite_function("sumSeries", "sum")
def sum_series(rng, *lists: Series) -> Series:
    s = _all(lists)
    return collapse(s.df, s.rng, F.sum("value"), "sumSeries")


@graphite_function("averageSeries", "avg")
def average_series(rng, *lists: Series) -> Series:
    s = _all(lists)
    return collapse(s.df, s.rng, F.avg("value"), "averageSeries")


def _minus(first: Column) -> Column:
    """The first series less the sum of the others; a missing subtrahend is nothing, a missing minuend gives null."""
    return F.max(F.when(first, V())) - F.coalesce(F.sum(F.when(~first, V())), F.lit(0.0))


@graphite_function("diffSeries")
def diff_series(rng, *lists: Series) -> Series:
    s = _all(lists)
    first = s.df.agg(F.min("place").alias("first"))  # one row
    return collapse(s.df.join(F.broadcast(first)), s.rng, _minus(F.col("place") == F.col("first")), "diffSeries")


def _per_epoch(s: Series, value: Column) -> DataFrame:
    """(epoch, by): an aggregate for each point of the grid, which is sent to the rows where the grid is small."""
    return bounded(s.df.groupBy("epoch").agg(value.alias("by")), s.rng.points() + 1)


@graphite_function("divideSeries")
def divide_series(rng, dividends: Series, divisor: Series) -> Series:
    """Every dividend by the one divisor; null by zero. More than one divisor is an error when the plan runs."""
    by = _per_epoch(divisor, F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("divideSeries takes one divisor"))).otherwise(F.first("value")))
    return Series(dividends.df.join(by, "epoch", "left").withColumn("value", F.try_divide("value", "by")).withColumn("series_id", F.concat(F.lit("divideSeries("), F.col("series_id"), F.lit(")"))).select(*ROW), dividends.rng)


@graphite_function("divideSeriesLists")
def divide_series_lists(rng, dividends: Series, divisors: Series) -> Series:
    """The i-th by the i-th, as divideSeries(a,b). Lists of different lengths are an error when the plan runs."""
    left = dividends.positions().select(F.col("place").alias("left"), F.col("series_id").alias("a"), "position")
    right = divisors.positions().select(F.col("place").alias("right"), F.col("series_id").alias("b"), "position")
    both = left.join(right, "position", "full_outer")
    unequal = F.raise_error(F.lit("divideSeriesLists takes lists of the same length"))
    both = both.withColumn("left", F.when(F.col("left").isNull() | F.col("right").isNull(), unequal.cast("array<struct<n:double,s:string>>")).otherwise(F.col("left")))
    rows = dividends.df.join(both, F.col("place") == F.col("left"), "right")
    by = divisors.df.select(F.col("place").alias("right"), "epoch", F.col("value").alias("by"))
    out = rows.join(by, ["right", "epoch"], "left").withColumn("value", F.try_divide("value", "by"))
    return Series(out.withColumn("series_id", F.concat(F.lit("divideSeries("), "a", F.lit(","), "b", F.lit(")"))).select(*ROW), dividends.rng)


@graphite_function("asPercent")
def as_percent(rng, s: Series, total=None) -> Series:
    """Share of the epoch's sum, of a number, or of the sum of other series. Sums are partial before they are shuffled."""
    if total is None or isinstance(total, Series):
        by = _per_epoch(s if total is None else total, F.sum("value"))
        return Series(renamed(s.df.join(by, "epoch", "left").withColumn("value", F.try_divide(V() * 100, F.col("by"))).select(*ROW), "asPercent"), s.rng)
    return s.with_value(F.try_divide(V() * 100, F.lit(float(total))), "asPercent", total)


@graphite_function("countSeries", decomposable=False)
def count_series(rng, s: Series) -> Series:
    n = s.df.agg(F.countDistinct("place").cast("double").alias("value")).where(F.col("value") > 0)
    return Series(n.select(*single("count"), F.explode(s.rng.grid()).alias("epoch"), "value"), s.rng)


@graphite_function("countNewSeries", decomposable=False)
def count_new_series(rng, s: Series) -> Series:
    """How many series have their first value at each epoch."""
    first = s.df.where(V().isNotNull()).groupBy("place").agg(F.min("epoch").alias("epoch")).select("epoch", F.lit(1.0).alias("value"))
    blank = s.df.sparkSession.range(1).select(F.explode(s.rng.grid()).alias("epoch"), F.lit(0.0).alias("value"))
    return collapse(first.unionByName(blank), s.rng, F.sum("value"), "countNewSeries")


@graphite_function("constantLine")
def constant_line(rng: TimeRange, value: float, spark=None) -> Series:
    from pyspark.sql import SparkSession

    one = (spark or SparkSession.active()).range(1)
    name = f"constantLine({value})"
    return Series(one.select(*single(name), F.explode(rng.grid()).alias("epoch"), F.lit(float(value)).alias("value")), rng)


def _grouped(s: Series, key: Column, how: str) -> Series:
    keyed = s.df.withColumn("key", key)
    if how in ("diff", "diffSeries"):
        first = keyed.groupBy("key").agg(F.min("place").alias("first"))  # partial first, so no group's rows meet
        keyed = keyed.join(first, "key")
        value = _minus(F.col("place") == F.col("first"))
    else:
        value = reducer(how)(V())
    out = keyed.groupBy("key", "epoch").agg(value.alias("value"))
    return Series.of(out, s.rng, F.col("key"))


@graphite_function("groupByNode")
def group_by_node(rng, s: Series, node: int, how: str = "average") -> Series:
    return _grouped(s, node_key(s, [node]), how)


@graphite_function("groupByNodes")
def group_by_nodes(rng, s: Series, how: str, *nodes) -> Series:
    return _grouped(s, node_key(s, nodes), how)


@graphite_function("aggregateWithWildcards")
def aggregate_with_wildcards(rng, s: Series, how: str, *nodes) -> Series:
    return _grouped(s, node_key(s, nodes, keep=False), how)


@graphite_function("averageSeriesWithWildcards")
def average_series_with_wildcards(rng, s: Series, *nodes) -> Series:
    return _grouped(s, node_key(s, nodes, keep=False), "average")


@graphite_function("sumSeriesWithWildcards")
def sum_series_with_wildcards(rng, s: Series, *nodes) -> Series:
    return _grouped(s, node_key(s, nodes, keep=False), "sum")


# Condition macros of the client-side builder: values that fail become null, and series without any value go.


@graphite_function("greater", decomposable=False)
def greater(rng, s: Series, n: float) -> Series:
    return remove_empty_series(rng, s.with_value(F.when(V() > float(n), V())))


@graphite_function("equal_to", decomposable=False)
def equal_to(rng, s: Series, n: float) -> Series:
    return remove_empty_series(rng, s.with_value(F.when(V() == float(n), V())))


@graphite_function("not_equal", decomposable=False)
def not_equal(rng, s: Series, n: float) -> Series:
    return remove_empty_series(rng, s.with_value(F.when(V() != float(n), V())))
