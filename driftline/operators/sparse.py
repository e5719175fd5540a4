"""The write path: which points of a series are worth keeping, and the markers between them."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bands import grow


@dataclass(frozen=True)
class Rule:
    """How the series whose id matches ``pattern`` are thinned. algorithm: lossless, delta, percentile or none (keep all)."""

    algorithm: str = "lossless"
    pattern: str = ".*"
    min_delta: float = 0.0
    window: int = 10
    quantile: float = 0.9
    gap: int = 600
    forced: int = 1800
    grid: int = 1
    transform: bool = False  # counters become rates before they are judged

    def __post_init__(self):
        if self.algorithm not in ALGORITHMS:
            raise ValueError(f"unknown algorithm {self.algorithm!r}")
        if self.gap <= 0 or self.grid <= 0 or not 0 <= self.quantile <= 1:
            raise ValueError(f"not a rule: {self}")


@dataclass
class State:
    """What a series must remember."""

    received: int | None = None
    written: int | None = None
    value: float | None = None
    recent: list[float] = field(default_factory=list)
    raw: float | None = None
    bands: list[list[float]] | None = None


def _lossless(state: State, v: float, rule: Rule) -> bool:
    return v != state.value


def _delta(state: State, v: float, rule: Rule) -> bool:
    return abs(v - state.value) / state.value > rule.min_delta if state.value > 0 else v != state.value


def _percentile(state: State, v: float, rule: Rule) -> bool:
    """Change against a nearest-rank quantile of the values received before."""
    if not state.recent:
        return v != state.value
    ordered = sorted(state.recent)
    scale = ordered[max(0, math.ceil(len(ordered) * rule.quantile) - 1)]
    return abs(v - state.value) / scale > rule.min_delta if scale > 0 else v != state.value


def _banded(state: State, v: float, rule: Rule) -> float:
    """A value as the middle of its band, or as it is if it lies in none; the first ``window`` values make the bands, once."""
    if state.bands is None:
        state.recent = [*state.recent, v]
        if len(state.recent) < rule.window:
            return v
        low, high = min(state.recent), max(state.recent)
        width = max((high - low) / BINS, 1e-12)
        counts = [0] * BINS
        for x in state.recent:
            counts[min(int((x - low) / width), BINS - 1)] += 1
        state.bands = [[b.low, b.high] for b in grow([low + (i + 0.5) * width for i in range(BINS)], counts, max_width=rule.min_delta or 0.05)]
        state.recent = []
    return next(((a + b) / 2 for a, b in state.bands if a <= v <= b), v)


#: Bins of the histogram that bands grow from.
BINS = 200
#: Algorithms by name; add to it to plug in others. ``outlier``: values in a band are told once as its middle, others always.
ALGORITHMS = {"lossless": _lossless, "delta": _delta, "percentile": _percentile, "outlier": _lossless, "none": lambda state, v, rule: True}


def step(state: State, epoch: int, value: float, rule: Rule) -> list[tuple[int, float | None, str | None, str]]:
    """(epoch, value, marker, decision) that a received point makes; the state moves on. decision: first, changed, forced, gap, late or dropped."""
    epoch = -(-epoch // rule.grid) * rule.grid
    if state.written is not None and epoch < state.written:
        return [(epoch, value, None, "late")]
    out: list[tuple[int, float | None, str | None, str]] = []
    if rule.transform:
        raw = value
        if state.raw is None:  # nothing to compare with: the series begins with a marker
            state.received, state.written, state.raw = epoch, epoch, raw
            return [(epoch, None, "missing", "first")]
        value = (raw - state.raw) / (epoch - state.written) if epoch > state.written else 0.0
    if rule.algorithm == "outlier":
        value = _banded(state, value, rule)
    if state.received is not None and epoch - state.received > rule.gap:
        out.append((state.received + rule.gap, None, "missing", "gap"))
        decision = "changed"  # after a gap marker the value must be told again
    elif state.written is None:
        decision = "first"
    elif state.value is None:
        decision = "changed"
    elif ALGORITHMS[rule.algorithm](state, value, rule):
        decision = "changed"
    else:
        decision = "forced" if epoch - state.written > rule.forced else "dropped"
    out.append((epoch, value, None, decision))
    state.received = max(epoch, state.received or epoch)
    state.recent = [*state.recent, value][-rule.window :] if rule.algorithm == "percentile" else state.recent if rule.algorithm == "outlier" else []
    if decision != "dropped":
        state.written, state.value = epoch, value
        state.raw = raw if rule.transform else None
    return out


def rule_of(name: str, rules: list[Rule]) -> Rule:
    """The first rule whose pattern a series id matches, else the default."""
    return next((r for r in rules if re.search(r.pattern, name)), Rule())


SCHEMA = "series_id string, epoch long, value double, marker string, decision string"


def decide(points: DataFrame, rules: list[Rule]) -> DataFrame:
    """(series_id, epoch, value, marker, decision) for (series_id, epoch, value): the state machine over each series in time order.

    Decisions depend on what was written last, so they are sequential within a series; rows are dealt by series, sorted
    and streamed, so a task keeps the state of one series at a time and any series may be long.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state, rule = None, State(), Rule()
        for frame in frames:
            out = []
            for sid, epoch, value in zip(frame["series_id"], frame["epoch"].tolist(), frame["value"].tolist(), strict=True):
                if sid != name:
                    name, state, rule = sid, State(), rule_of(sid, rules)
                out += [(sid, *x) for x in step(state, epoch, value, rule)]
            yield pd.DataFrame(out, columns=["series_id", "epoch", "value", "marker", "decision"])

    rows = points.select("series_id", F.col("epoch").cast("long").alias("epoch"), "value").where(F.col("value").isNotNull())
    return rows.repartition("series_id").sortWithinPartitions("series_id", "epoch").mapInPandas(run, SCHEMA)


def kept(decisions: DataFrame) -> DataFrame:
    """What is written of ``decide``'s rows."""
    return decisions.where(~F.col("decision").isin("dropped", "late")).drop("decision")


def changes(points: DataFrame, keys: list[str]) -> DataFrame:
    """Lossless thinning without forced writes, as a window: points that differ from the one before."""
    w = Window.partitionBy(*keys).orderBy("epoch")
    return points.withColumn("before", F.lag("value").over(w)).where(~F.col("value").eqNullSafe(F.col("before"))).drop("before")


def gap_markers(points: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """A marker ``gap`` after each point that has no other within it but one later."""
    w = Window.partitionBy(*keys).orderBy("epoch")
    after = points.select(*keys, "epoch", F.lead("epoch").over(w).alias("next")).where(F.col("next") - F.col("epoch") > gap)
    return after.select(*keys, (F.col("epoch") + gap).alias("epoch"), F.lit("missing").alias("marker"))


def tombstones(points: DataFrame, keys: list[str], gap: int, now: int | None = None, termination: int = 0) -> DataFrame:
    """A marker ``gap`` after the last point of each series that has been silent for ``termination`` until ``now``."""
    last = points.groupBy(*keys).agg(F.max("epoch").alias("last"))
    if now is not None:
        last = last.where(now - F.col("last") > termination)
    return last.select(*keys, (F.col("last") + gap).alias("epoch"), F.lit("tombstone").alias("marker"))


def bundle_tombstones(points: DataFrame, keys: list[str], gap: int, version: int) -> DataFrame:
    """A versioned tombstone ``gap`` after the last point of every series of a bundle, whatever the time is."""
    return tombstones(points, keys, gap).withColumn("version", F.lit(version).cast("long"))


def new_keys(points: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Series of ``points`` that the catalogue ``known`` lacks, each with its first epoch: what a search index is told."""
    fresh = points.groupBy(*keys).agg(F.min("epoch").alias("epoch"))
    old = known.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    return fresh.join(old, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_anti")


def rate(points: DataFrame, keys: list[str], clamp: bool = False) -> DataFrame:
    """A counter's change per second since the point before; the first point is a missing marker.

    For counters of which every point is written. Where points are dropped, change and interval run from the last one
    written: that is ``Rule(transform=True)`` in ``decide``.
    """
    w = Window.partitionBy(*keys).orderBy("epoch")
    v = F.try_divide(F.col("value") - F.lag("value").over(w), F.col("epoch") - F.lag("epoch").over(w))
    v = F.when(v >= 0, v) if clamp else v
    return points.withColumn("rate", v).withColumn("marker", F.when(F.lag("epoch").over(w).isNull(), "missing")).withColumn("value", F.col("rate")).drop("rate")


def catalog(points: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each series and day."""
    return points.groupBy(*keys, F.to_date(F.timestamp_seconds("epoch")).alias("day")).agg(F.min("epoch").alias("epoch"))


def drop_report(decisions: DataFrame, *by: str) -> DataFrame:
    """Points received, written and dropped, and the dropped share."""
    real = decisions.where(F.col("decision") != "gap")
    out = real.groupBy(*by).agg(F.count(F.lit(1)).alias("received"), F.count_if(F.col("decision").isin("dropped", "late")).alias("dropped"))
    return out.withColumn("written", F.col("received") - F.col("dropped")).withColumn("drop_ratio", F.col("dropped") / F.col("received"))


def state_dict(state: State) -> dict:
    return asdict(state)
