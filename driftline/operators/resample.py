"""Sparse points to dense series: every point holds until the next one of its series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .timerange import TimeRange

#: Look-back before the start of a range, by default; and for ranges from before OLD, when points were forced less often.
LOOKBACK = 1800
OLD, LOOKBACK_OLD = 1640073600, 43200


def default_lookback(start: int, segment: int = 86400) -> int:
    """Seconds before ``start`` in which the last point is looked for; never more than half a segment."""
    return min(LOOKBACK_OLD if start < OLD else LOOKBACK, segment // 2)


def dedupe(points: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One value for each (keys, epoch): that of the largest ``order``, or the smallest value where there is no order."""
    one = F.min("value") if order is None else F.max_by("value", order)
    return points.groupBy(*keys, "epoch").agg(one.alias("value"))


def last_values(points: DataFrame, keys: list[str], start: int, lookback: int = LOOKBACK) -> DataFrame:
    """The latest point and the latest marker of each series in (start - lookback, start]."""
    near = points.where((F.col("epoch") > start - lookback) & (F.col("epoch") <= start))
    marked = F.col("marker").isNotNull() if "marker" in points.columns else F.lit(False)
    rest = [c for c in points.columns if c not in keys]
    latest = near.groupBy(*keys, marked.alias("is_marker")).agg(F.max_by(F.struct(*rest), "epoch").alias("p"))
    return latest.select(*keys, "p.*")


def accepted(points: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Points that count: not of an older version than one before, and no marker within ``gap`` of the point before.

    Surviving markers have a null value.
    """
    order = [F.col("epoch"), F.col("marker").isNotNull()]
    versioned = "version" in points.columns
    if versioned:
        order.append(F.col("version"))
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if versioned:
        newest = F.max("version").over(before)
        points = points.withColumn("__newest", newest)
        points = points.where(F.col("__newest").isNull() | (F.col("version") >= F.col("__newest"))).drop("__newest")
    last = F.max("epoch").over(before)
    points = points.withColumn("__last", last)
    kept = points.where(F.col("marker").isNull() | F.col("__last").isNull() | (F.col("epoch") - F.col("__last") >= gap))
    return kept.withColumn("value", F.when(F.col("marker").isNull(), F.col("value"))).drop("__last")


def resample(points: DataFrame, rng: TimeRange, keys: list[str], how: str = "mean", fill=None, lookback: int | None = None, gap: int | None = None, default: float | None = None) -> DataFrame:
    """(keys, epoch, value) on the grid of ``rng``, for every series with a point in reach.

    ``how``: mean (weighted by the seconds that a value holds), max, min, sum (of value times seconds) or last.
    Columns of ``points``: keys, epoch, value, and optionally marker (null, 'missing' or 'tombstone') and version.
    ``default`` holds from the start of the range to the first point. ``fill``: None, a number, 'previous' or 'linear'.

    One scan and two exchanges: by series, for the next point; by (series, bucket) for the aggregates. The grid of a series
    comes from its first row, as buckets without weight in the same aggregation.
    """
    lookback = default_lookback(rng.start) if lookback is None else lookback
    if how not in HOW:
        raise ValueError(f"unknown down-sampler {how!r}")
    cells = _cells(points, rng, keys, lookback, gap, default)
    dense = cells.groupBy(*keys, F.col("bucket").alias("epoch")).agg(HOW[how](F.col("v")).alias("value"))
    return fill_gaps(dense, keys, fill)


def resample_fields(points: DataFrame, rng: TimeRange, keys: list[str], fields: list[str], fill=None, lookback: int | None = None, default: float | None = None) -> DataFrame:
    """(keys, epoch, one column for each of ``fields``) of points with a column ``field``: means as by ``resample``.

    All fields share one scan and the same two exchanges, so arithmetic between them needs no join. Keys that any of the
    fields has are on the grid; a field that a series lacks is null there.
    """
    cells = _cells(points, rng, [*keys, "field"], default_lookback(rng.start) if lookback is None else lookback, None, default)
    dense = cells.groupBy(*keys, F.col("bucket").alias("epoch")).agg(*[HOW["mean"](F.when(F.col("field") == f, F.col("v"))).alias(f) for f in fields])
    for f in fields:
        dense = fill_gaps(dense, keys, fill, f)
    return dense


#: Down-samplers of cells (v, d, at): a value, the seconds that it holds in the bucket, and when it was written.
HOW = {
    "mean": lambda v: F.try_divide(F.sum(v * F.col("d")), F.sum(F.when(v.isNotNull(), F.col("d")))), "sum": lambda v: F.sum(v * F.col("d")),
    "max": lambda v: F.max(v), "min": lambda v: F.min(v), "last": lambda v: F.max_by(v, F.when(v.isNotNull(), F.col("at"))),
}
_CELL = "array<struct<bucket:bigint,d:bigint,at:bigint,v:double>>"


def _cells(points: DataFrame, rng: TimeRange, keys: list[str], lookback: int, gap: int | None, default: float | None) -> DataFrame:
    """(keys, bucket, d, at, v): each value in each bucket that it holds in, and every bucket of each series without weight."""
    inside = points.where((F.col("epoch") > rng.start - lookback) & (F.col("epoch") < rng.end))
    if "marker" in points.columns:
        inside = accepted(inside, keys, gap or rng.interval)
    order = [F.col("epoch")] + ([F.col("marker").isNotNull()] if "marker" in points.columns else []) + ([F.col("version")] if "version" in points.columns else [])
    ahead = Window.partitionBy(*keys).orderBy(*order)
    start, end, step = (F.lit(x).cast("long") for x in (rng.start, rng.end, rng.interval))
    rows = inside.select(*keys, F.col("epoch").alias("at"), F.col("value").cast("double").alias("v"), F.coalesce(F.lead("epoch").over(ahead), end).alias("next"), F.row_number().over(ahead).alias("rn"))

    def cells(a: Column, b: Column, at: Column, v: Column) -> Column:
        a, b = F.greatest(a, start), F.least(b, end)
        bucket_of = lambda x: start + F.floor((x - start) / step).cast("long") * step
        each = F.transform(F.sequence(bucket_of(a), bucket_of(b - 1), step), lambda x: F.struct(x.alias("bucket"), (F.least(b, x + step) - F.greatest(a, x)).alias("d"), at.alias("at"), v.alias("v")))
        return F.coalesce(F.when(b > a, each).cast(_CELL), F.array().cast(_CELL))

    first = F.col("rn") == 1
    blank = F.when(first, F.transform(rng.grid(), lambda x: F.struct(x.alias("bucket"), F.lit(0).cast("long").alias("d"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("double").alias("v"))).cast(_CELL))
    parts = [cells(F.col("at"), F.col("next"), F.col("at"), F.col("v")), F.coalesce(blank, F.array().cast(_CELL))]
    if default is not None:  # before the first point
        parts.append(F.when(first & (F.col("at") > start), cells(start, F.col("at"), start, F.lit(float(default)))).otherwise(F.array().cast(_CELL)))
    return rows.select(*keys, F.explode(F.concat(*parts)).alias("c")).select(*keys, "c.*")


def resample_dense(points: DataFrame, rng: TimeRange, keys: list[str], how: str = "mean", fill=None) -> DataFrame:
    """As ``resample`` for series that are written at every step: plain aggregates of the points in each bucket.

    One scan; points are aggregated by bucket before they are shuffled, and buckets without points come from the gap
    to the next one.
    """
    inside = points.where((F.col("epoch") >= rng.start) & (F.col("epoch") < rng.end))
    start, end, step = (F.lit(x).cast("long") for x in (rng.start, rng.end, rng.interval))
    bucket = start + F.floor((F.col("epoch") - start) / step).cast("long") * step
    how = {"mean": F.avg("value"), "sum": F.sum("value"), "max": F.max("value"), "min": F.min("value"), "last": F.max_by("value", "epoch")}[how]
    known = inside.groupBy(*keys, bucket.alias("bucket")).agg(how.alias("known"))
    w = Window.partitionBy(*keys).orderBy("bucket")
    spans = known.select(*keys, "known", "bucket", F.when(F.lag("bucket").over(w).isNull(), start).otherwise(F.col("bucket")).alias("a"), F.coalesce(F.lead("bucket").over(w), end).alias("b"))
    dense = spans.select(*keys, "known", "bucket", F.explode(F.sequence(F.col("a"), F.col("b") - 1, step)).alias("epoch"))
    return fill_gaps(dense.select(*keys, "epoch", F.when(F.col("epoch") == F.col("bucket"), F.col("known")).alias("value")), keys, fill)


def fill_gaps(dense: DataFrame, keys: list[str], fill, column: str = "value") -> DataFrame:
    """Nulls as a number, as the value before ('previous'), or on the line between the values around them ('linear')."""
    if fill is None or fill == "null":
        return dense
    w, value = Window.partitionBy(*keys).orderBy("epoch"), F.col(column)
    if fill == "previous":
        return dense.withColumn(column, F.last(value, ignorenulls=True).over(w))
    if fill == "linear":
        known = F.when(value.isNotNull(), F.struct("epoch", value.alias("value")))
        up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
        dense = dense.withColumn("p", F.last(known, ignorenulls=True).over(up)).withColumn("n", F.first(known, ignorenulls=True).over(down))
        slope: Column = (F.col("n.value") - F.col("p.value")) * (F.col("epoch") - F.col("p.epoch")) / F.nullif(F.col("n.epoch") - F.col("p.epoch"), F.lit(0))
        return dense.withColumn(column, F.coalesce(value, F.col("p.value") + slope)).drop("p", "n")
    return dense.withColumn(column, F.coalesce(value, F.lit(float(fill))))
