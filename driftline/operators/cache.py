"""Results by query and time range, on the driver: which parts are known, and which are missing."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .timerange import TimeRange, missing


class RangeCache:
    """Frames with an ``epoch`` column, kept for each key as ranges that do not overlap; least recently used keys go first.

    A cached frame is released when its range, its key or the whole cache goes. ``points``: newest points of a range's
    grid that a key keeps; older ones are cut off.
    """

    def __init__(self, most: int = 100, points: int | None = None):
        self.most, self.points, self.entries = most, points, OrderedDict()

    def get(self, key: str, wanted: TimeRange) -> tuple[DataFrame | None, list[TimeRange]]:
        """What is known of the range, and the ranges that are not."""
        have = [(r, df) for r, df in self.entries.get(key, []) if r.overlaps(wanted) and r.interval == wanted.interval]
        if key in self.entries:
            self.entries.move_to_end(key)
        parts = [_within(df, max(r.start, wanted.start), min(r.end, wanted.end)) for r, df in have]
        return (reduce(DataFrame.unionByName, parts) if parts else None), missing(wanted, [r for r, _ in have])

    def set(self, key: str, rng: TimeRange, df: DataFrame) -> None:
        """Add a range; what is there already stays, so only the rest of the range is taken from ``df``."""
        entries = self.entries.setdefault(key, [])
        free = missing(rng, [r for r, _ in entries if r.interval == rng.interval])
        entries += [(r, df) for r in free]
        entries.sort(key=lambda x: x[0])
        if self.points is not None:
            self._prune(key, rng.interval)
        self.entries.move_to_end(key)
        while len(self.entries) > self.most:
            self._release(self.entries.popitem(last=False)[1])

    def _prune(self, key: str, interval: int) -> None:
        newest = max(r.end for r, _ in self.entries[key] if r.interval == interval)
        least, kept, gone = newest - self.points * interval, [], []
        for r, df in self.entries[key]:
            if r.interval != interval or r.start >= least:
                kept.append((r, df))
            elif r.end > least:
                kept.append((TimeRange(least, r.end, interval), df))
            else:
                gone.append((r, df))
        self.entries[key] = kept
        self._release(gone)

    def _release(self, gone: list[tuple[TimeRange, DataFrame]]) -> None:
        """Unpersist frames that no entry holds any more."""
        used = {id(df) for entries in self.entries.values() for _, df in entries}
        for df in {id(df): df for _, df in gone if id(df) not in used}.values():
            df.unpersist()

    def clear(self, key: str | None = None) -> None:
        gone = [x for k, entries in self.entries.items() if key in (None, k) for x in entries]
        self.entries.clear() if key is None else self.entries.pop(key, None)
        self._release(gone)

    def compute(self, key: str, wanted: TimeRange, evaluate: Callable[[TimeRange], DataFrame]) -> DataFrame:
        """The frame for a range; only what is missing is evaluated."""
        known, gaps = self.get(key, wanted)
        for gap in gaps:
            fresh = evaluate(gap).cache()
            part = _within(fresh, gap.start, gap.end)
            known = part if known is None else known.unionByName(part)
            self.set(key, gap, fresh)
        return known


def _within(df: DataFrame, start: int, end: int) -> DataFrame:
    return df.where((F.col("epoch") >= start) & (F.col("epoch") < end))
