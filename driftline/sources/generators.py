"""Synthetic points with predictable values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def predictable(spark: SparkSession, start: int, end: int, step: int = 60, clusters: int = 2, nodes: int = 3) -> DataFrame:
    """Values 100, 200, ... a step plus 10 a node (field steady); the epoch itself (regular); the same with gaps (intermittent)."""
    n = (end - start) // step
    ids = spark.range(n * clusters * nodes)
    i, rest = F.col("id") % n, F.floor(F.col("id") / n)
    rows = ids.select(i.alias("i"), (rest % nodes).alias("node"), F.floor(rest / nodes).alias("cluster"), (F.lit(start) + i * step).alias("epoch"))
    fields = F.map_from_arrays(F.array(F.lit("steady"), F.lit("regular"), F.lit("intermittent")), F.array(100.0 * (F.col("i") + 1) + 10 * F.col("node"), F.col("epoch").cast("double"), F.when(F.col("i") % 40 <= 20, F.col("epoch").cast("double"))))
    out = rows.select(F.concat(F.lit("c_"), F.col("cluster").cast("string")).alias("cluster"), F.concat(F.lit("n_"), F.col("node").cast("string")).alias("node"), "epoch", F.explode(fields).alias("field", "value"))
    return out.where(F.col("value").isNotNull())


def random_walk(spark: SparkSession, series: int, points: int, start: int, step: int = 60, seed: int = 7, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """Bounded noise around a slow wave, the same for a seed whatever the partitions."""
    ids = spark.range(series * points)
    rows = ids.select(F.floor(F.col("id") / points).alias("series"), (F.lit(start) + (F.col("id") % points) * step).alias("epoch"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)).alias("noise"))
    wave = (low + high) / 2 + (high - low) / 4 * F.sin(F.col("epoch") / 7200.0 + F.col("series"))
    return rows.select(F.concat(F.lit("s"), F.col("series").cast("string")).alias("series_id"), "epoch", F.least(F.greatest(wave + (F.col("noise") - 500) / 500 * (high - low) / 8, F.lit(low)), F.lit(high)).alias("value"))


def _points(spark: SparkSession, series: int, points: int, start: int, step: int, seed: int) -> DataFrame:
    """series, i, epoch and noise (0 to 1), the same for a seed whatever the partitions."""
    ids = spark.range(series * points)
    noise = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    return ids.select(F.floor(F.col("id") / points).alias("series"), (F.col("id") % points).alias("i"), (F.lit(start) + (F.col("id") % points) * step).alias("epoch"), noise.alias("noise"))


def catch_all(spark: SparkSession, series: int, points: int, start: int, step: int = 60, seed: int = 7) -> DataFrame:
    """Series whose names no datasource's prefix takes."""
    rows = _points(spark, series, points, start, step, seed)
    return rows.select(F.concat(F.lit("unlisted.s_"), F.col("series").cast("string"), F.lit(".value")).alias("name"), "epoch", (F.col("noise") * 100).alias("value"))


def outliers(spark: SparkSession, series: int, points: int, start: int, step: int = 60, seed: int = 7, modes: tuple[tuple[float, float], ...] = ((10.0, 0.5), (90.0, 0.8), (200.0, 0.99))) -> DataFrame:
    """Values near one of the modes (value, cumulative probability) within one unit, the rest anywhere up to twice the largest."""
    rows = _points(spark, series, points, start, step, seed).withColumn("jitter", F.pmod(F.xxhash64("series", "i", F.lit(seed + 1)), F.lit(1000)) / 1000.0)
    value = F.col("jitter") * 2 * max(m for m, _ in modes)
    for m, upto in reversed(modes):
        value = F.when(F.col("noise") < upto, m - 1 + 2 * F.col("jitter")).otherwise(value)
    return rows.select(F.concat(F.lit("s"), F.col("series").cast("string")).alias("series_id"), "epoch", value.alias("value"))


def multi_cluster(spark: SparkSession, clusters: int, nodes: int, points: int, start: int, step: int = 60, seed: int = 7) -> DataFrame:
    """Dotted names clusters.c_i.n_j.load of every node of every cluster."""
    rows = _points(spark, clusters * nodes, points, start, step, seed)
    name = F.concat(F.lit("clusters.c_"), F.floor(F.col("series") / nodes).cast("string"), F.lit(".n_"), (F.col("series") % nodes).cast("string"), F.lit(".load"))
    return rows.select(name.alias("name"), "epoch", (F.col("noise") * 8).alias("value"))


def live(spark: SparkSession, per_second: int = 100, series: int = 10) -> DataFrame:
    """A stream of (series_id, epoch, value) at the rate of real time."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return ticks.select(F.concat(F.lit("s"), (F.col("value") % series).cast("string")).alias("series_id"), F.unix_timestamp("timestamp").alias("epoch"), F.pmod(F.xxhash64("value"), F.lit(1000)).cast("double").alias("value"))
