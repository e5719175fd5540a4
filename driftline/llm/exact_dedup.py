"""Exact deduplication that no group of copies can unbalance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scale import cut, skew_safe_lookup

#: Parts into which each digest group is dealt before its winners meet.
SALTS = 16


def _winners(docs: DataFrame, text: Column, best: Column, salts: int) -> DataFrame:
    """(digest, text, best, copies): the maximum of ``best`` for each distinct text.

    Three steps, each grouping by the whole text beside its digest: within a partition (partial aggregation),
    within a salt of a digest group, and over the salts' winners. A task hands on at most one row per distinct text.
    """
    rows = docs.select(text.alias("text"), best.alias("best"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    rows = rows.withColumn("digest", F.sha2("text", 256))
    salted = rows.groupBy("salt", "digest", "text").agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("copies"))
    return salted.groupBy("digest", "text").agg(F.max("best").alias("best"), F.sum("copies").alias("copies"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are compared whole and unchanged. Of equal texts the largest id stays.
    Null and empty texts are one group. Rows that repeat an id with the same text each count in group_size and each
    report the same decision. A null id never wins over another; a group of null ids only has keep_id null and
    keeps its rows. Other columns are ignored whatever their names. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    classes = _winners(docs, text, F.col(id_col), salts)
    # Two different texts under one digest would be two rows here; such a table must not be joined by digest.
    table = classes.groupBy("digest").agg(F.max("best").alias("keep_id"), F.max("copies").alias("group_size"), F.count(F.lit(1)).alias("classes"))
    table = table.select("digest", "keep_id", F.when(F.col("classes") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest"))).alias("group_size"))
    table = cut(table)
    total = table.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("digest"))
    joined = skew_safe_lookup(rows, table, ["digest"], "group_size", total, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return joined.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """``docs`` with one row for each distinct text: that of the largest id, all columns as they were.

    Null and empty texts are one group, and its row keeps the text it had. Repeated rows leave one.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    # fields are positional, so no column name can clash
    best = F.struct(F.col(id_col).alias("f0"), F.col(text_col).isNotNull().alias("f1"), *[F.col(c).alias(f"f{i + 2}") for i, c in enumerate(others)])
    kept = _winners(docs, F.coalesce(F.col(text_col), F.lit("")), best, salts)
    fields = {id_col: F.col("best.f0"), text_col: F.when(F.col("best.f1"), F.col("text"))} | {c: F.col(f"best.f{i + 2}") for i, c in enumerate(others)}
    return kept.select(*[fields[c].alias(c) for c in docs.columns])


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
