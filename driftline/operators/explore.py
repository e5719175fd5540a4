"""Metadata of points: measurements, fields, tags, and the tree of dotted names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graphite import split_path, token_predicate


def measurements(points: DataFrame, contains: str | None = None, limit: int | None = 100) -> DataFrame:
    out = points.select(F.col("tags")["measurement"].alias("name")).where(F.col("name").isNotNull())
    if contains:
        out = out.where(F.col("name").contains(contains))
    out = out.distinct()
    return out.orderBy("name").limit(limit) if limit else out


def field_keys(points: DataFrame, measurement: str) -> DataFrame:
    return points.where(F.col("tags")["measurement"] == measurement).select("field").distinct()


def tag_keys(points: DataFrame) -> DataFrame:
    return points.select(F.explode(F.map_keys("tags")).alias("tag")).distinct()


def tag_values(points: DataFrame, measurement: str, key: str, where: dict[str, str] | None = None) -> DataFrame:
    out = points.where(F.col("tags")["measurement"] == measurement)
    for k, v in (where or {}).items():
        out = out.where(F.col("tags")[k] == v)
    return out.select(F.col("tags")[key].alias("value")).where(F.col("value").isNotNull()).distinct()


def find_children(names: DataFrame, pattern: str, limit: int = 200) -> DataFrame:
    """(text, leaf) of the next tokens under a pattern of dotted names (column ``name``), by text."""
    tokens = split_path(pattern)
    parts = F.split("name", r"\.")
    hit = F.size(parts) >= len(tokens)
    for i, t in enumerate(tokens):
        hit = hit & token_predicate(F.get(parts, F.lit(i)), t)
    found = names.where(hit).select(F.get(parts, F.lit(len(tokens) - 1)).alias("text"), (F.size(parts) == len(tokens)).alias("leaf")).distinct()
    return found.orderBy("text", "leaf").limit(limit)


def leaf_counts(names: DataFrame, depth: int) -> DataFrame:
    """Distinct names under each prefix of ``depth`` tokens."""
    parts = F.split("name", r"\.")
    return names.select(F.array_join(F.slice(parts, 1, depth), ".").alias("prefix"), "name").groupBy("prefix").agg(F.countDistinct("name").alias("leaves"))


def information_schema(tables: dict[str, DataFrame]) -> DataFrame:
    """(datasource, name, kind) of every column: texts are dimensions, ``epoch`` is the time, all else are metrics."""
    spark = next(iter(tables.values())).sparkSession
    kind = lambda f: "time" if f.name == "epoch" else "dimension" if f.dataType.typeName() == "string" else "metric"
    return spark.createDataFrame([(t, f.name, kind(f)) for t, df in tables.items() for f in df.schema], "datasource string, name string, kind string")


def show(points: DataFrame, statement: str) -> DataFrame:
    """SHOW RETENTION POLICIES | MEASUREMENTS | FIELD KEYS | TAG KEYS | TAG VALUES."""
    text = " ".join(statement.split())
    name = r'"?([\w.-]+)"?'
    if re.match(r"(?i)SHOW RETENTION", text):
        return points.sparkSession.createDataFrame([("default",)], "name string")
    if m := re.fullmatch(r"(?i)SHOW MEASUREMENTS(?: WITH MEASUREMENT =~ /(.*)/)?(?: LIMIT (\d+))?", text):
        return measurements(points, m[1], int(m[2]) if m[2] else 100)
    if m := re.fullmatch(rf"(?i)SHOW FIELD KEYS FROM {name}", text):
        return field_keys(points, m[1])
    if re.match(r"(?i)SHOW TAG KEYS", text):
        return tag_keys(points)
    if m := re.fullmatch(rf"(?i)SHOW TAG VALUES FROM {name} WITH KEY = {name}((?: (?:WHERE|AND) {name} = '?[^']*'?)*)", text):
        pairs = re.findall(rf"(?i)(?:WHERE|AND) {name} = '?([^']*?)'?(?= AND|$)", m[3])
        return tag_values(points, m[1], m[2], dict(pairs))
    raise ValueError(f"not a SHOW statement: {statement!r}")
