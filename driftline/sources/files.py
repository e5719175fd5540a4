"""Point files: partitioned newline JSON with a manifest, and partitioned Parquet."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_VERSION = 1


def write_bundle(points: DataFrame, path: str) -> dict:
    """One folder for each datasource, gzip JSON, and MANIFEST.json beside them; an existing target is an error."""
    points.write.partitionBy("datasource").mode("errorifexists").option("compression", "gzip").json(f"{path}/points")
    spark = points.sparkSession
    counts = {r["datasource"]: r["n"] for r in spark.read.json(f"{path}/points").groupBy("datasource").agg(F.count(F.lit(1)).alias("n")).collect()}
    manifest = {"version": MANIFEST_VERSION, "datasource_map": {k: {"filename": f"points/datasource={k}", "points_written": n, "size_bytes": _size(spark, f"{path}/points/datasource={k}")} for k, n in sorted(counts.items())}, "total_points_processed": sum(counts.values())}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/MANIFEST")
    return manifest


def _size(spark: SparkSession, path: str) -> int:
    """Bytes below a path, by the file system that Spark would use for it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/MANIFEST").first()[0])


def append_points(points: DataFrame, path: str) -> None:
    """Parquet by datasource and day, so that time bounds prune folders."""
    days = points.withColumn("day", F.to_date(F.timestamp_seconds("epoch")))
    days.repartition("datasource", "day").sortWithinPartitions("datasource", "day", "epoch").write.mode("append").partitionBy("datasource", "day").parquet(path)


def read_points(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Points of [start, end), with bounds on the day as well."""
    day = lambda t: F.to_date(F.timestamp_seconds(F.lit(t)))
    return spark.read.parquet(path).where((F.col("day") >= day(start)) & (F.col("day") <= day(end)) & (F.col("epoch") >= start) & (F.col("epoch") < end))


def in_range(df: DataFrame, column: str, start: int, end: int) -> DataFrame:
    """Rows whose timestamp (with or without a zone, then UTC) is in [start, end) epoch seconds.

    The column is compared as it is stored, with literals of its own type, so that the bounds reach the scan.
    """
    kind = df.schema[column].dataType.typeName()
    text = lambda t: datetime.fromtimestamp(t, UTC).strftime("%Y-%m-%d %H:%M:%S")
    at = (lambda t: F.expr(f"TIMESTAMP_NTZ'{text(t)}'")) if kind == "timestamp_ntz" else (lambda t: F.expr(f"TIMESTAMP'{text(t)}Z'"))
    return df.where((F.col(column) >= at(start)) & (F.col(column) < at(end)))


def regranulate(spark: SparkSession, path: str, target: str, unit: str = "month") -> None:
    """Rewrite day folders as coarser ones; folders that exist are replaced, others stay."""
    df = spark.read.parquet(path).withColumn("day", F.to_date(F.date_trunc(unit, F.col("day"))))
    df.repartition("datasource", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("datasource", "day").parquet(target)


def retained(points: DataFrame, now: int, days: int) -> DataFrame:
    """Points that retention keeps."""
    return points.where(F.col("epoch") >= now - days * 86400)


def in_time(points: DataFrame, late: int = 30 * 86400, early: int = 2 * 86400) -> DataFrame:
    """Points not later or earlier than allowed, against their time of arrival."""
    lag = F.col("server_rx_epoch") - F.col("epoch")
    return points.where((lag <= late) & (lag >= -early))
