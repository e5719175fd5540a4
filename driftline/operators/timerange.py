"""Half-open time ranges and their algebra, on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True, order=True)
class TimeRange:
    """[start, end) in epoch seconds, with a grid step."""

    start: int
    end: int
    interval: int

    def __post_init__(self):
        if self.interval <= 0 or self.end < self.start:
            raise ValueError(f"not a range: {self}")

    def points(self) -> int:
        return (self.end - self.start) // self.interval

    def epochs(self) -> range:
        return range(self.start, self.end, self.interval)

    def grid(self) -> Column:
        """The grid as an array column."""
        if self.end <= self.start:
            return F.array().cast("array<bigint>")
        return F.sequence(F.lit(self.start).cast("long"), F.lit(self.end - 1).cast("long"), F.lit(self.interval).cast("long"))

    def overlaps(self, other: TimeRange) -> bool:
        return self.start < other.end and other.start < self.end

    def touches(self, other: TimeRange) -> bool:
        return self.start <= other.end and other.start <= self.end

    def merge(self, other: TimeRange) -> TimeRange:
        if self.interval != other.interval:
            raise ValueError("ranges of different intervals")
        return TimeRange(min(self.start, other.start), max(self.end, other.end), self.interval)

    def aligned(self, floor_start: bool = False) -> TimeRange:
        """End moved up to the grid; start up too, or down with ``floor_start``."""
        i = self.interval
        start = self.start // i * i if floor_start else -(-self.start // i) * i
        return TimeRange(start, max(start, -(-self.end // i) * i), i)

    def shifted(self, seconds: int) -> TimeRange:
        return TimeRange(self.start + seconds, self.end + seconds, self.interval)


def sort_and_merge(ranges: list[TimeRange], touching: bool = False) -> list[TimeRange]:
    """Ranges by start, overlapping ones merged; with ``touching`` also adjacent ones."""
    out: list[TimeRange] = []
    for r in sorted(ranges):
        if out and (out[-1].touches(r) if touching else out[-1].overlaps(r)):
            out[-1] = out[-1].merge(r)
        else:
            out.append(r)
    return out


def missing(wanted: TimeRange, have: list[TimeRange]) -> list[TimeRange]:
    """The parts of ``wanted`` that no range of ``have`` covers."""
    out, at = [], wanted.start
    for r in sort_and_merge([x for x in have if x.overlaps(wanted)], touching=True):
        if r.start > at:
            out.append(TimeRange(at, r.start, wanted.interval))
        at = max(at, r.end)
    if at < wanted.end:
        out.append(TimeRange(at, wanted.end, wanted.interval))
    return out
