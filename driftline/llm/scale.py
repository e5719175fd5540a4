"""Plan helpers shared by the corpus operators: skew-safe lookups and durable cuts of lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import cut

__all__ = ["cut", "likely", "lookup", "skew_safe_lookup", "skew_safe_match"]

#: A key counts as hot when it holds more than 1/HOT_PARTS of all rows, so there are fewer hot keys than this.
HOT_PARTS = 1000


def skew_safe_lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int, spread: Column) -> DataFrame:
    """Left join of ``rows`` with ``table`` (unique on ``keys``), whatever share of the rows one key holds.

    ``weight`` in ``table`` is the number of rows of a key and ``total`` at least their sum. Keys above
    ``total / HOT_PARTS`` rows are fewer than HOT_PARTS by counting, so that side may be broadcast; their rows
    then take a key that matches nothing and is spread by ``spread``, and all others meet in an ordinary join
    in which no key holds more than that share. Result: the columns of ``rows`` and the other columns of ``table``.
    """
    values = [c for c in table.columns if c not in keys]
    hot_side = table.where(F.col(weight) * HOT_PARTS > total)
    hot = hot_side.select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.struct(*values).alias("__hot"))
    cold = table.where(F.col(weight) * HOT_PARTS <= total).select(
        *[F.col(k).alias(f"__c_{k}") for k in keys], F.xxhash64(*keys).alias("__c_side"), F.struct(*values).alias("__cold"))
    near = rows.join(F.broadcast(hot), on=[F.col(k) == F.col(f"__h_{k}") for k in keys], how="left").drop(*[f"__h_{k}" for k in keys])
    side = F.when(F.col("__hot").isNull(), F.xxhash64(*keys)).otherwise(F.xxhash64(spread))
    near = near.withColumn("__side", side)
    out = near.join(cold, on=[F.col(k) == F.col(f"__c_{k}") for k in keys] + [F.col("__side") == F.col("__c_side")], how="left")
    picked = F.coalesce("__hot", "__cold")
    return out.select(*rows.columns, *[picked[c].alias(c) for c in values])


def skew_safe_match(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (unique on ``keys``, materialised), whatever share of the rows one key holds.

    ``weight`` in ``table`` is the number of rows of a key and ``total`` at least their sum. Rows of keys above
    ``total / HOT_PARTS``, fewer than HOT_PARTS keys by counting, meet a broadcast table; they are taken out of
    what is shuffled for the others, which carries nothing but the rows themselves. Without ``weight`` in the result.
    """
    hot = F.broadcast(table.where(F.col(weight) * HOT_PARTS > total).drop(weight))
    cold = table.where(F.col(weight) * HOT_PARTS <= total).drop(weight)
    values = [c for c in table.columns if c not in (*keys, weight)]
    far = rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys).select(*rows.columns, *values)
    return far.union(rows.join(hot, keys).select(*rows.columns, *values))


#: Numbers that keys are hashed to before a join with few of them; so many at most are broadcast (a few MB).
CELLS = 1 << 19


def likely(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` hashes to a cell that some key of ``keys`` hashes to: all that a join with ``keys`` needs, and few
    others as long as ``keys`` has not many more than CELLS rows. What is left out need not be shuffled."""
    cell = F.pmod(F.xxhash64(key), F.lit(CELLS))
    cells = F.broadcast(keys.select(cell.alias("__cell")).distinct())
    return rows.withColumn("__cell", cell).join(cells, "__cell", "left_semi").drop("__cell")


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], spread: Column) -> DataFrame:
    """``skew_safe_lookup`` for a small materialised ``rows``: its hot keys are counted first."""
    total = rows.count()
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") * HOT_PARTS > total)
    weighed = table.join(F.broadcast(counts), keys, "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    return skew_safe_lookup(rows, weighed, keys, "__n", total, spread).drop("__n")
