"""The write path on streams: the batch state machine with checkpointed state, and rollups under watermarks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import sparse
from ..sources import codec


def sparsify(points: DataFrame, rules: sparse.Rule | list[sparse.Rule], silence_ms: int | None = None) -> DataFrame:
    """Decisions of ``operators.sparse`` over a stream of (series_id, epoch, value), one state for each series.

    A series goes by the first of ``rules`` whose pattern it matches, as in ``sparse.decide``. With ``silence_ms`` a series that gets nothing for so long ends: a tombstone, and its state goes. Within a
    micro-batch points are taken in time order.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if silence_ms else GroupStateTimeout.NoTimeout

    rules = [rules] if isinstance(rules, sparse.Rule) else list(rules)

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rule = sparse.rule_of(key[0], rules)
        if held.hasTimedOut:
            state = sparse.State(**json.loads(held.get[0]))
            held.remove()
            rows = [(key[0], state.received + rule.gap, None, "tombstone", "gap")] if state.received is not None else []
            yield pd.DataFrame(rows, columns=["series_id", "epoch", "value", "marker", "decision"])
            return
        state = sparse.State(**json.loads(held.get[0])) if held.exists else sparse.State()
        frame = pd.concat(list(frames)).sort_values("epoch", kind="stable")
        out = [(key[0], *x) for e, v in zip(frame["epoch"].tolist(), frame["value"].tolist(), strict=True) for x in sparse.step(state, e, v, rule)]
        held.update((json.dumps(sparse.state_dict(state)),))
        if silence_ms:
            held.setTimeoutDuration(silence_ms)
        yield pd.DataFrame(out, columns=["series_id", "epoch", "value", "marker", "decision"])

    return points.groupBy("series_id").applyInPandasWithState(run, sparse.SCHEMA, "state string", "append", timeout)


STEP_SCHEMA = "series_id string, epoch long, mean double, sum double, max double, last double, marker string"


def rollup_steps(points: DataFrame, window: int, gap: int) -> DataFrame:
    """Step-weighted rollups of a stream of (series_id, epoch, value, marker): as ``operators.rollup``, once a window is over.

    A value holds until the next point of its series, at most ``gap`` seconds. A window is told, under the label of its end,
    by the first point behind it; one without a valid second is a missing marker. A tombstone tells the window that it
    falls into and then stands itself one window later. Within a micro-batch points are taken in time order.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = Steps(**json.loads(held.get[0])) if held.exists else Steps()
        frame = pd.concat(list(frames)).sort_values("epoch", kind="stable")
        out = []
        for e, v, m in zip(frame["epoch"].tolist(), frame["value"].tolist(), frame["marker"].tolist(), strict=True):
            out += [(key[0], *x) for x in state.step(e, None if m is not None else v, m == "tombstone", window, gap)]
        held.update((json.dumps(asdict(state)),))
        yield pd.DataFrame(out, columns=["series_id", "epoch", "mean", "sum", "max", "last", "marker"])

    return points.groupBy("series_id").applyInPandasWithState(run, STEP_SCHEMA, "state string", "append", GroupStateTimeout.NoTimeout)


@dataclass
class Steps:
    """The open window of a series: what holds now and since when, and the sums so far."""

    since: int | None = None
    value: float | None = None
    seconds: int = 0
    area: float = 0.0
    top: float | None = None
    last: float | None = None

    def _hold(self, start: int, end: int) -> None:
        if self.value is not None and end > start:
            self.seconds += end - start
            self.area += self.value * (end - start)
            self.top = self.value if self.top is None else max(self.top, self.value)
            self.last = self.value

    def _told(self, end: int) -> tuple:
        known = self.seconds > 0
        out = (end, self.area / self.seconds if known else None, self.area if known else None, self.top, self.last, None if known else "missing")
        self.seconds, self.area, self.top, self.last = 0, 0.0, None, None
        return out

    def step(self, epoch: int, value: float | None, tombstone: bool, window: int, gap: int) -> list[tuple]:
        """Rows (epoch, mean, sum, max, last, marker) of the windows that end by this point. A null value ends what holds."""
        out = []
        if self.since is not None:
            if epoch < self.since:
                return []
            at, stop = self.since, min(epoch, self.since + gap)
            while (end := (at // window + 1) * window) <= epoch:
                self._hold(at, min(end, max(at, stop)))
                out.append(self._told(end))
                at = end
            self._hold(at, max(at, stop))
        self.since, self.value = epoch, value
        if tombstone:
            end = -(-epoch // window) * window
            if self.seconds > 0:
                out.append(self._told(end))
            out.append((end + window, None, None, None, None, "tombstone"))
            self.since = None
        return out


def rollup(points: DataFrame, keys: list[str], window: int, late: str = "1 hour") -> DataFrame:
    """(keys, epoch, mean, max, n) of tumbling windows labelled with their end, each once its watermark has passed.

    Plain aggregates of the points received; the step-weighted form is ``operators.rollup`` on what has been stored.
    """
    timed = points.withColumn("at", F.timestamp_seconds("epoch")).withWatermark("at", late)
    out = timed.groupBy(*keys, F.window("at", f"{window} seconds")).agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.unix_timestamp("window.end").alias("epoch"), "mean", "max", "n")


def consume(points: DataFrame, rules: list[sparse.Rule], mode: str = "both", windows: tuple[int, ...] = (3600,), gap: int = 600) -> dict[str, DataFrame]:
    """The frames that a consumer writes: ``raw`` (what the sparsifier keeps) and ``rollup_<seconds>`` of what was received.

    ``mode``: realtime (raw only), rollup (rollups only, without sparse checks of raw points), both, or recovery (markers
    only: gaps and tombstones that an interrupted consumer owes; values are not written again).
    """
    if mode not in ("realtime", "rollup", "both", "recovery"):
        raise ValueError(f"unknown mode {mode!r}")
    out = {}
    if mode != "rollup":
        kept = sparse.kept(sparsify(points, rules) if points.isStreaming else sparse.decide(points, rules))
        out["raw"] = kept.where(F.col("marker").isNotNull()) if mode == "recovery" else kept
    if mode in ("rollup", "both"):
        marked = points if "marker" in points.columns else points.withColumn("marker", F.lit(None).cast("string"))
        out |= {f"rollup_{w}": rollup_steps(marked, w, gap) for w in windows}
    return out


def from_lines(lines: DataFrame, late: int = 30 * 86400, early: int = 2 * 86400) -> DataFrame:
    """Points of a stream of text lines (column ``value``, as Kafka gives it), without those that are too late or early."""
    rows = lines.select(F.col("value").cast("string").alias("line"))
    points = codec.parse_auto(rows).withColumn("server_rx_epoch", F.unix_timestamp(F.current_timestamp()))
    lag = F.col("server_rx_epoch") - F.col("epoch")
    points = points.where((lag <= late) & (lag >= -early))
    return points.withColumn("series_id", codec.series_id(F.col("datasource"), F.col("tags"), F.col("field")))


def kafka_source(spark, servers: str, topics: str, rewind_ms: int | None = None, per_batch: int | None = None) -> DataFrame:
    """A stream of metric lines; ``rewind_ms``: where a new query begins, as a timestamp in milliseconds; ``per_batch``: at most so many lines a micro-batch."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics)
    reader = reader.option("maxOffsetsPerTrigger", str(per_batch)) if per_batch else reader
    return (reader.option("startingTimestamp", str(rewind_ms)) if rewind_ms else reader).load()


def kafka_rows(points: DataFrame, prefix: str) -> DataFrame:
    """(topic, value) for a Kafka sink: one JSON object for each point, in its datasource's topic."""
    body = codec.point_json(F.col("epoch"), F.col("value"), F.col("field"), F.col("tags"))
    return points.select(F.concat(F.lit(prefix + "_"), F.col("datasource")).alias("topic"), body.alias("value"))


def append_batches(path: str):
    """A foreachBatch sink: each micro-batch in a folder of its own number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
