"""Anomalies of dense series."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def group_key(name: str, tokens: list[int]) -> Column:
    """The tokens of a dotted name at the given places: series with the same ones share a baseline."""
    parts = F.split(name, r"\.")
    return F.concat_ws(",", *[F.get(parts, F.lit(i)) for i in tokens])


def gaussian(rows: DataFrame, keys: list[str], threshold: float = 0.99, tokens: list[int] | None = None) -> DataFrame:
    """Adds ``score`` = 1 - φ(z) and ``anomalous`` = score > threshold, against the mean and deviation of the keys' values.

    With ``tokens`` the baseline is that of all series whose names (the first key) have the same tokens at these places;
    baselines are aggregated partially before they are shuffled, so a group may hold any share of the rows.
    """
    v = F.when(~F.isnan("value"), F.col("value"))
    baseline = [group_key(keys[0], tokens).alias("__group")] if tokens else [F.col(k).alias(f"__{k}") for k in keys]
    known = rows.groupBy(*baseline).agg(F.avg(v).alias("__mean"), F.stddev_pop(v).alias("__deviation"))
    on = [group_key(keys[0], tokens).eqNullSafe(F.col("__group"))] if tokens else [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    z = F.try_divide(v - F.col("__mean"), F.col("__deviation"))
    score = 1 - F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return rows.join(known, on, "left").select(*rows.columns, score.alias("score")).withColumn("anomalous", F.coalesce(F.col("score") > threshold, F.lit(False)))


def static(rows: DataFrame, keys: list[str], threshold: float, comparator: str = "gt") -> DataFrame:
    """Values over (gt) or under (lt) a threshold."""
    if comparator not in ("gt", "lt"):
        raise ValueError(f"unknown comparator {comparator!r}")
    hit = F.col("value") > threshold if comparator == "gt" else F.col("value") < threshold
    return rows.withColumn("score", hit.cast("double")).withColumn("anomalous", F.coalesce(hit, F.lit(False)))


#: Detectors by name; others may be added here.
DETECTORS: dict[str, Callable[..., DataFrame]] = {"gaussian": gaussian, "static": static}


def runs(flagged: DataFrame, keys: list[str], interval: int) -> DataFrame:
    """(keys, start, end, points, score): anomalous points at most ``interval`` apart as one run; the score is the mean."""
    w = Window.partitionBy(*keys).orderBy("epoch")
    bad = flagged.where("anomalous")
    bad = bad.withColumn("new", F.coalesce((F.col("epoch") - F.lag("epoch").over(w) > interval).cast("int"), F.lit(1)))
    bad = bad.withColumn("run", F.sum("new").over(w))
    return bad.groupBy(*keys, "run").agg(F.min("epoch").alias("start"), F.max("epoch").alias("end"), F.count(F.lit(1)).alias("points"), F.avg("score").alias("score")).drop("run")


def detect(rows: DataFrame, keys: list[str], interval: int, detector: str = "gaussian", **options) -> DataFrame:
    if detector not in DETECTORS:
        raise ValueError(f"unknown detector {detector!r}")
    return runs(DETECTORS[detector](rows, keys, **options), keys, interval)
