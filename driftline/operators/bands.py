"""Bands of likely values, grown from density peaks of a histogram."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Band:
    low: float
    high: float
    probability: float

    def holds(self, v: float) -> bool:
        return self.low <= v <= self.high

    @property
    def middle(self) -> float:
        return (self.low + self.high) / 2


def grow(centers: list[float], counts: list[float], max_width: float = 0.05, least: float = 0.01, gain: float = 0.001, rejects: int = 3) -> list[Band]:
    """Bands of a histogram, densest first.

    From the densest free bin a band takes, on either side, the denser neighbour, until it would be wider than ``max_width``
    of the value range, gain less than ``gain`` of probability, or meet another band. Bands under ``least``
    probability are rejected; after more than ``rejects`` of them the search ends.
    """
    total = sum(counts)
    if not total or not centers:
        return []
    span = (centers[-1] - centers[0]) or 1.0
    half = span / max(1, len(centers) - 1) / 2
    used, bands, bad = [False] * len(centers), [], 0
    for peak in sorted(range(len(centers)), key=lambda i: -counts[i]):
        if used[peak] or not counts[peak]:
            continue
        lo = hi = peak
        mass = counts[peak]
        while True:
            sides = [i for i in (lo - 1, hi + 1) if 0 <= i < len(centers) and not used[i]]
            if not sides:
                break
            best = max(sides, key=lambda i: counts[i])
            width = centers[max(hi, best)] - centers[min(lo, best)] + 2 * half
            if width > max_width * span + 2 * half or counts[best] / total < gain:
                break
            lo, hi, mass = min(lo, best), max(hi, best), mass + counts[best]
        for i in range(lo, hi + 1):
            used[i] = True
        if mass / total >= least:
            bands.append(Band(centers[lo] - half, centers[hi] + half, mass / total))
        else:
            bad += 1
            if bad > rejects:
                break
    return bands


def histogram(points: DataFrame, keys: list[str], bins: int = 200) -> DataFrame:
    """(keys, bin, center, n) of equal bins over each group's range: two aggregates, bounded by bins a group."""
    ends = points.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    rows = points.join(ends, keys)
    width = F.greatest((F.col("hi") - F.col("lo")) / bins, F.lit(1e-12))
    at = F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1))
    return rows.select(*keys, at.cast("int").alias("bin"), (F.col("lo") + (at + 0.5) * width).alias("center")).groupBy(*keys, "bin").agg(F.min("center").alias("center"), F.count(F.lit(1)).alias("n"))


def bands(points: DataFrame, key: str, bins: int = 200, **options) -> DataFrame:
    """(key, low, high, probability) of each group; a task sees at most ``bins`` numbers of a group."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("bin")
        full = pd.DataFrame({"bin": range(int(f["bin"].max()) + 1)}).merge(f, on="bin", how="left")
        centers = full["center"].interpolate(limit_direction="both").tolist()
        found = grow(centers, full["n"].fillna(0).tolist(), **options)
        return pd.DataFrame([(frame[key].iloc[0], b.low, b.high, b.probability) for b in found], columns=[key, "low", "high", "probability"])

    return histogram(points, [key], bins).groupBy(key).applyInPandas(run, f"{key} string, low double, high double, probability double")


def thin_by_bands(points: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """Points with the middle of their band as value and a flag whether they are outliers; the bands are few for each key."""
    pairs = found.groupBy(key).agg(F.collect_list(F.struct("low", "high")).alias("bands"))
    inside = lambda b: (F.col("value") >= b["low"]) & (F.col("value") <= b["high"])
    hit = F.get(F.filter("bands", inside), F.lit(0))
    out = points.join(pairs, key, "left").withColumn("band", hit)
    return out.withColumn("outlier", F.col("band").isNull()).withColumn("value", F.coalesce((F.col("band.low") + F.col("band.high")) / 2, F.col("value"))).drop("bands")


def band_statistics(points: DataFrame, key: str, found: DataFrame, interval: int) -> DataFrame:
    """(key, epoch, low, high, points, mean) for each band and interval of ``interval`` seconds; outliers under null bounds."""
    inside = points.join(found.groupBy(key).agg(F.collect_list(F.struct("low", "high")).alias("bands")), key, "left")
    band = F.get(F.filter("bands", lambda b: (F.col("value") >= b["low"]) & (F.col("value") <= b["high"])), F.lit(0))
    at = (F.floor(F.col("epoch") / interval) * interval).alias("epoch")
    return inside.groupBy(key, at, band["low"].alias("low"), band["high"].alias("high")).agg(F.count(F.lit(1)).alias("points"), F.avg("value").alias("mean"))
