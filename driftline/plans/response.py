"""Answers in the shapes that clients of either language expect, from collected rows."""

from __future__ import annotations

import datetime
import math

from pyspark.sql import DataFrame

from ..operators.series import Series


def _plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else v


def stamp(epoch: int, form: str = "s"):
    """Seconds, milliseconds, or ISO text in UTC."""
    if form == "iso":
        return datetime.datetime.fromtimestamp(epoch, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return epoch * 1000 if form == "ms" else epoch


def influx(results: dict[str, DataFrame], form: str = "s") -> dict:
    """{"results": [{"statement_id", "series": [{"name", "tags", "columns", "values": [[time, value], ...]}]}]}"""
    out = []
    for i, (name, df) in enumerate(results.items()):
        tags = [c for c in df.columns if c not in ("epoch", "value")]
        series: dict[tuple, list] = {}
        for r in df.orderBy(*tags, "epoch").collect():
            series.setdefault(tuple(r[t] for t in tags), []).append([stamp(r["epoch"], form), _plain(r["value"])])
        out.append({"statement_id": i, "series": [{"name": name, "tags": dict(zip(tags, key, strict=True)), "columns": ["time", name], "values": v} for key, v in series.items()]})
    return {"results": out}


def graphite(series: Series) -> list[dict]:
    """[{"target", "datapoints": [[value, time], ...]}] in the order of the series."""
    out: dict[tuple, dict] = {}
    for r in series.df.orderBy("place", "epoch").collect():
        out.setdefault((*r["place"], r["series_id"]), {"target": r["series_id"], "datapoints": []})["datapoints"].append([_plain(r["value"]), r["epoch"]])
    return list(out.values())


def with_anomalies(series: Series, found: DataFrame) -> list[dict]:
    """As ``graphite``, each with its runs [start, end, score]."""
    runs: dict[str, list] = {}
    for r in found.collect():
        runs.setdefault(r["series_id"], []).append([r["start"], r["end"], r["score"]])
    return [x | {"anomalies": sorted(runs.get(x["target"], []))} for x in graphite(series)]
