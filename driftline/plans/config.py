"""Routing rules from configuration: datasources, sparse rules, transforms, rollups, sharding."""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sparse import Rule

# Seconds of each granularity.
GRANULARITIES = {"NONE": 0, "HOUR": 3600, "DAY": 86400, "WEEK": 604800, "MONTH": 2678400}


@dataclass(frozen=True)
class Config:
    grid: int = 1
    segment: str = "DAY"
    datasources: dict[str, str] = field(default_factory=dict)  # name prefix to datasource; '' is the catch-all
    rules: tuple[Rule, ...] = ()
    transforms: tuple[tuple[str, str | None, str], ...] = ()  # include, exclude, field suffix
    rollups: tuple[int, ...] = ()
    cross_cluster: tuple[str, ...] = ()
    shards: int = 1
    prefix: str = ""

    def __post_init__(self):
        if self.segment not in GRANULARITIES:
            raise ValueError(f"unknown granularity {self.segment!r}")
        if self.grid <= 0 or self.shards <= 0:
            raise ValueError("grid and shards are positive")
        for w in self.rollups:
            if w % self.grid:
                raise ValueError(f"rollup {w} is not a multiple of the grid {self.grid}")
        for pattern in [r.pattern for r in self.rules] + [t[0] for t in self.transforms]:
            re.compile(pattern)

    @property
    def forced_write(self) -> int:
        """Half a segment, so that a look-back never crosses two."""
        return GRANULARITIES[self.segment] // 2

    @staticmethod
    def load(text: str) -> Config:
        import yaml

        raw = yaml.safe_load(text) or {}
        unknown = set(raw) - set(Config.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        raw["rules"] = tuple(Rule(**r) for r in raw.get("rules", []))
        raw["transforms"] = tuple((t["include"], t.get("exclude"), t.get("suffix", "")) for t in raw.get("transforms", []))
        return Config(**raw | {k: tuple(raw[k]) for k in ("rollups", "cross_cluster") if k in raw})

    def datasource(self, name: Column) -> Column:
        """By the longest prefix of the name."""
        out = F.lit(self.prefix + self.datasources[""]) if "" in self.datasources else F.lit(None).cast("string")
        for p in sorted(self.datasources, key=len):
            if p:
                out = F.when(name.startswith(p), self.prefix + self.datasources[p]).otherwise(out)
        return out

    def algorithm(self, series_id: Column) -> Column:
        """The first rule's algorithm whose pattern the id matches."""
        out = F.lit("lossless")
        for r in reversed(self.rules):
            out = F.when(series_id.rlike(r.pattern), r.algorithm).otherwise(out)
        return out

    def transformed(self, series_id: Column) -> Column:
        """Suffix of the field if a transform takes the series, else null. Excluded series are not taken."""
        out = F.lit(None).cast("string")
        for include, exclude, suffix in reversed(self.transforms):
            hit = series_id.rlike(include)
            hit = hit & ~series_id.rlike(exclude) if exclude else hit
            out = F.when(hit, suffix).otherwise(out)
        return out

    def grid_epoch(self, epoch: Column) -> Column:
        return (F.ceil(epoch / self.grid) * self.grid).cast("long")

    def is_cross_cluster(self, name: Column) -> Column:
        out = F.lit(False)
        for g in self.cross_cluster:
            out = out | name.rlike(fnmatch.translate(g).replace(r"\Z", "$").replace("(?s:", "(?s:").replace(r"\z", "$"))
        return out

    def with_cross_cluster(self, points: DataFrame, name: str = "name") -> DataFrame:
        """``points`` with a datasource, and those that cross clusters a second time under the metric-sharded one.

        Clusters are dealt over shards by their own name; metrics that cross clusters by the metric's.
        """
        name = F.col(name)
        cluster, metric = F.split(name, r"\.")[1], F.substring_index(name, ".", -1)
        own = points.withColumn("datasource", F.concat_ws("_", self.datasource(name), self.shard(F.coalesce(cluster, name)).cast("string")))
        crossing = points.where(self.is_cross_cluster(name)).withColumn("datasource", F.concat_ws("_", self.datasource(name), F.lit("ccluster"), self.shard(metric).cast("string")))
        return own.unionByName(crossing)

    def shard(self, key: Column) -> Column:
        return adler_shard(key, F.lit(self.shards))


def adler_shard(key: Column, shards: Column) -> Column:
    """adler32 of the key's UTF-8 bytes modulo the number of shards, as writers in other systems compute it; null for null."""
    hexes = F.hex(F.encode(key, "UTF-8"))
    n = F.length(hexes) / 2
    at = F.sequence(F.lit(1), n.cast("int"))
    codes = F.when(n > 0, F.transform(at, lambda i: F.conv(F.substring(hexes, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    # sums of a key's bytes and of their running sums stay far under 2^63, so one remainder at the end is enough
    sums = F.aggregate(codes, F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b")), lambda s, c: F.struct((s["a"] + c).alias("a"), (s["b"] + s["a"] + c).alias("b")))
    whole = (sums["b"] % 65521) * 65536 + sums["a"] % 65521
    return F.when(key.isNotNull(), (whole % shards).cast("int"))
