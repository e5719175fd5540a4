"""Dense series as a long frame: place, series_id, base_series_id, epoch, value (null where nothing is known)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..durable import cut
from .timerange import TimeRange

ROW = ("place", "series_id", "base_series_id", "epoch", "value")
#: Up to so many rows an aggregate by epoch is broadcast: a range's grid bounds it, whatever the number of series.
GRID = 1 << 17


def by_number(x: Column) -> Column:
    """A number as one element of a place."""
    return F.array(F.struct(x.cast("double").alias("n"), F.lit(None).cast("string").alias("s")))


def by_text(x: Column) -> Column:
    """A text as one element of a place."""
    return F.array(F.struct(F.lit(None).cast("double").alias("n"), x.cast("string").alias("s")))


def reversed_text(x: Column) -> Column:
    """Another text, which sorts the other way round: the complement of its bytes, with an end that is larger than any."""
    return F.concat(F.translate(F.lower(F.hex(x)), "0123456789abcdef", "fedcba9876543210"), F.lit("g"))


@dataclass(frozen=True)
class Series:
    """A list of series on the grid of ``rng``.

    ``place`` tells a series from the others and sorts as they stand in the list. It is not a number: sorts put new
    elements before the old ones, so ordering costs no shuffle until an order is asked for (``limit``, ``positions``).
    """

    df: DataFrame
    rng: TimeRange

    @staticmethod
    def of(dense: DataFrame, rng: TimeRange, name: Column) -> Series:
        """Series in the order of their names; ``dense`` has epoch and value besides what ``name`` reads."""
        rows = dense.select(name.alias("series_id"), "epoch", "value")
        return Series(rows.select(by_text(F.col("series_id")).alias("place"), "series_id", F.col("series_id").alias("base_series_id"), "epoch", "value"), rng)

    def with_value(self, value: Column, name: str | None = None, *args) -> Series:
        """A value for each row; with ``name`` the ids become name(id,args)."""
        df = self.df.withColumn("value", value)
        return replace(self, df=renamed(df, name, *args) if name else df)

    def over(self) -> Window:
        """Rows of a series in time order."""
        return Window.partitionBy("place").orderBy("epoch")

    def whole(self, value: Column) -> Column:
        """An aggregate of each series beside its rows."""
        return value.over(Window.partitionBy("place"))

    def where(self, value: Column, test) -> Series:
        """Only series whose aggregate passes ``test``: one exchange by series, no second scan."""
        df = self.df.withColumn("k", self.whole(value))
        return replace(self, df=df.where(test(F.col("k"))).select(*ROW))

    def before(self, *order: Column) -> Series:
        """Series sorted anew by elements (``by_number``, ``by_text``) that are constant within a series; equals stay in order."""
        return replace(self, df=self.df.withColumn("place", F.concat(*order, F.col("place"))).select(*ROW))

    def slice(self, first: int, count: int) -> Series:
        """``count`` series from the ``first`` on (0 is the first one). Only the chosen places are collected in one task."""
        chosen = self.df.select("place").distinct().orderBy("place")
        chosen = (chosen.offset(first) if first else chosen).limit(count)
        return replace(self, df=self.df.join(bounded(chosen, count), "place", "left_semi").select(*ROW))

    def positions(self, most: int | None = None) -> DataFrame:
        """(place, series_id, position) of every series: exact numbers from 0 in the order of the list.

        A list of at most ``most`` series, if that is few, is numbered in one task.
        Places are dealt by ranges and numbered in each; only the sizes of the ranges are added up in one task. The
        deal is written down, as both steps must see the same ranges.
        """
        one = self.df.groupBy("place").agg(F.first("series_id").alias("series_id"))
        if most is not None and most <= GRID:
            return one.limit(most).withColumn("position", F.row_number().over(Window.orderBy("place")) - 1)
        dealt = cut(one.repartitionByRange("place").withColumn("part", F.spark_partition_id()))
        sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = sizes.select("part", before.alias("start"))
        rank = F.row_number().over(Window.partitionBy("part").orderBy("place")) - 1
        return dealt.withColumn("rank", rank).join(F.broadcast(starts), "part").select("place", "series_id", (F.col("start") + F.col("rank")).alias("position"))

    def tokens(self) -> Column:
        return F.split("base_series_id", r"\.")


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of at most ``rows`` rows, broadcast if that is few."""
    return F.broadcast(df) if rows <= GRID else df


def renamed(df: DataFrame, name: str, *args) -> DataFrame:
    tail = "".join(f",{a}" for a in args)
    return df.withColumn("series_id", F.concat(F.lit(f"{name}("), F.col("series_id"), F.lit(f"{tail})")))


def single(name: str) -> list[Column]:
    """place, series_id and base_series_id of the only series of a list."""
    return [by_text(F.lit(name)).alias("place"), F.lit(name).alias("series_id"), F.lit(name).alias("base_series_id")]


def collapse(df: DataFrame, rng: TimeRange, value: Column, name: str) -> Series:
    """One series of an aggregate for each epoch."""
    out = df.groupBy("epoch").agg(value.alias("value"))
    return Series(out.select(*single(name), "epoch", "value"), rng)


def union(lists: list[Series]) -> Series:
    """All series of several lists one after another."""
    first = lists[0]
    if any(x.rng.interval != first.rng.interval for x in lists):
        raise ValueError("series of different intervals")
    df = None
    for i, x in enumerate(lists):
        rows = x.before(by_number(F.lit(i))).df
        df = rows if df is None else df.unionByName(rows)
    return Series(df, TimeRange(min(x.rng.start for x in lists), max(x.rng.end for x in lists), first.rng.interval))


def difference(left: Series, right: Series, tolerance: float = 0.0) -> DataFrame:
    """(series_id, epoch, left_value, right_value, kind): orphans of either side, and values that differ by over ``tolerance`` (share)."""
    a = left.df.select("series_id", "epoch", F.col("value").alias("left_value"), F.lit(1).alias("l"))
    b = right.df.select("series_id", "epoch", F.col("value").alias("right_value"), F.lit(1).alias("r"))
    both = a.join(b, ["series_id", "epoch"], "full_outer")
    off = F.abs(F.col("left_value") - F.col("right_value")) > tolerance * F.abs(F.col("left_value"))
    kind = F.when(F.col("r").isNull(), "left_only").when(F.col("l").isNull(), "right_only").when(~F.col("left_value").eqNullSafe(F.col("right_value")) & F.coalesce(off, F.lit(True)), "value")
    return both.withColumn("kind", kind).where(F.col("kind").isNotNull()).select("series_id", "epoch", "left_value", "right_value", "kind")


def merge(first: Series, second: Series) -> Series:
    """Points of both by (series_id, epoch); where both have a point the first wins."""
    rows = first.df.select(*ROW[1:], F.lit(0).alias("side")).unionByName(second.df.select(*ROW[1:], F.lit(1).alias("side")))
    one = rows.groupBy("series_id", "base_series_id", "epoch").agg(F.min_by("value", "side").alias("value"))
    return Series(one.withColumn("place", by_text(F.col("series_id"))).select(*ROW), first.rng.merge(second.rng))
