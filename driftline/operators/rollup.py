"""Tumbling time rollups of step functions, labelled with the window's end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resample import resample
from .timerange import TimeRange


def rollup(points: DataFrame, keys: list[str], rng: TimeRange, how: str = "mean", gap: int | None = None) -> DataFrame:
    """(keys, epoch, value, marker): each window of ``rng.interval`` under the label of its end.

    mean is weighted by the seconds that values hold; sum is values times seconds. A window without a valid
    second is a missing marker. Read back, a rollup lies one window later than the raw points.
    """
    out = resample(points, rng, keys, how=how, gap=gap, lookback=rng.end - rng.start)
    return out.select(*keys, (F.col("epoch") + rng.interval).alias("epoch"), "value", F.when(F.col("value").isNull(), "missing").alias("marker"))


def choose(windows: list[int], interval: int) -> int:
    """The largest window that still resolves the interval; 0: raw points."""
    return max([w for w in windows if w <= interval], default=0)
