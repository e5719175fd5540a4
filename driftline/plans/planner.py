"""From statements to one lazy DataFrame."""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dense
from ..functions.timeparse import interval_seconds
from ..operators.resample import resample, resample_dense, resample_fields
from ..operators.timerange import TimeRange
from . import influxql as q


@dataclass
class Table:
    """A measurement: rows with ``epoch``, tag columns and value columns; ``rollups`` are coarser copies by window."""

    df: DataFrame
    tags: list[str]
    fields: list[str]
    sparse: bool = True
    rollups: dict[int, DataFrame] = field(default_factory=dict)

    def source(self, interval: int) -> DataFrame:
        """The coarsest data that still has the interval's detail."""
        fit = [w for w in self.rollups if w <= interval]
        return self.rollups[max(fit)] if fit else self.df


@dataclass
class _Value:
    """An expression over a frame with ``epoch``. ``grouped``: it aggregates the frame by (keys, epoch), which is put off
    until it must be a frame, so that expressions over the same frame and keys become one aggregation."""

    df: DataFrame
    keys: list[str]
    value: Column
    grouped: bool = False

    def frame(self) -> DataFrame:
        value = self.value.alias("value")
        return self.df.groupBy(*self.keys, "epoch").agg(value) if self.grouped else self.df.select(*self.keys, "epoch", value)

    def fits(self, other: _Value) -> bool:
        return self.df is other.df and self.grouped == other.grouped and self.keys == other.keys

    def but(self, value: Column) -> _Value:
        return _Value(self.df, self.keys, value, self.grouped)


def _fields(e) -> list[str]:
    if isinstance(e, q.Field):
        return [e.name]
    parts = e.args if isinstance(e, q.Call) else (e.left, e.right) if isinstance(e, q.Binary) else ()
    return [n for x in parts for n in _fields(x)]


def predicate(test, tags: list[str]) -> Column:
    """A condition on tags as a column."""
    if test is None:
        return F.lit(True)
    if isinstance(test, q.Logic):
        parts = [predicate(x, tags) for x in test.args]
        if test.op == "not":
            return ~parts[0]
        out = parts[0]
        for p in parts[1:]:
            out = (out & p) if test.op == "and" else (out | p)
        return out
    if test.tag not in tags:
        raise q.UnsupportedSql(f"unknown tag {test.tag!r}")
    c, v = F.col(test.tag), test.value
    if test.op == "null":
        return c.isNull()
    if test.op == "in":
        return c.isin(*v)
    if test.op == "like":
        return c.like(v)
    if test.op in ("=~", "!~"):
        return c.rlike(v) if test.op == "=~" else ~c.rlike(v)
    if isinstance(v, str) and "*" in v and test.op in ("=", "!="):
        like = F.lit(True) if v == "*" else c.like(wildcard(v))
        return like if test.op == "=" else ~like
    return {"=": lambda: c == v, "!=": lambda: c != v, "<": lambda: c < v, "<=": lambda: c <= v, ">": lambda: c > v, ">=": lambda: c >= v}[test.op]()


def wildcard(pattern: str) -> str:
    """A pattern with stars as one for LIKE."""
    return pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")


class SqlPlanner:
    """Evaluates parsed statements over measurements by name."""

    def __init__(self, tables: dict[str, Table]):
        self.tables = tables

    def run(self, statement: str | q.Select, now: int | None = None) -> dict[str, DataFrame]:
        """Result name to (group tags, epoch, value)."""
        s = q.parse(statement, now) if isinstance(statement, str) else statement
        if s.measurement not in self.tables:
            raise q.UnsupportedSql(f"unknown measurement {s.measurement!r}")
        table = self.tables[s.measurement]
        for tag in s.group_by:
            if tag not in table.tags and tag != "field":
                raise q.UnsupportedSql(f"unknown tag {tag!r}")
        return {name: self._final(self._eval(e, s, self._sources(e, s, table)), s) for name, e in s.expressions}

    def columns(self, statement: str, now: int | None = None) -> DataFrame:
        """(group tags, epoch, one column for each expression) of expressions over the same fields and groups: one pass for all."""
        s = q.parse(statement, now)
        table = self.tables[s.measurement]
        names = list(dict.fromkeys(n for _, e in s.expressions for n in _fields(e)))
        sources = self._sources_of(names, s, table)
        values = [(name, self._eval(e, s, sources)) for name, e in s.expressions]
        first = values[0][1]
        if not all(isinstance(v, _Value) and v.fits(first) for _, v in values):
            raise q.UnsupportedSql("expressions of different groups cannot be columns of one frame")
        out = [v.value.alias(name) for name, v in values]
        return first.df.groupBy(*first.keys, "epoch").agg(*out) if first.grouped else first.df.select(*first.keys, "epoch", *out)

    def frame(self, statement: str, now: int | None = None) -> DataFrame:
        """All results in one frame with their names."""
        parts = [df.withColumn("name", F.lit(name)) for name, df in self.run(statement, now).items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def _final(self, v, s: q.Select) -> DataFrame:
        if isinstance(v, _Value):
            return v.frame()
        if not isinstance(v, (int, float)):
            raise q.UnsupportedSql("an expression needs a field or a number")
        one = next(iter(self.tables.values())).df.sparkSession.range(1)  # a literal alone is a constant line
        return one.select(F.explode(s.range.grid()).alias("epoch"), F.lit(float(v)).alias("value"))

    def _sources(self, e, s: q.Select, table: Table) -> dict[str, _Value]:
        return self._sources_of(list(dict.fromkeys(_fields(e))), s, table)

    def _sources_of(self, names: list[str], s: q.Select, table: Table) -> dict[str, _Value]:
        """The dense values of fields, from one scan.

        A field with stars, or a set such as ``{a;b}``, stands for all fields that it matches: series of their own, with ``field`` as a tag.
        """
        matched = {n: [f for f in table.fields if _matches(n, f)] for n in names}
        for n in names:
            if not matched[n]:
                raise q.UnsupportedSql(f"unknown field {n!r}")
        rows = table.source(s.interval).where(predicate(s.where, table.tags))
        extra = [c for c in ("marker", "version") if c in rows.columns]
        fill = s.fill
        default = fill if isinstance(fill, (int, float)) else None
        lookback = min(86400, int(s.options["lookback_sec"])) if "lookback_sec" in s.options else None
        sparse = table.sparse and not s.options.get("sparseness_disabled")

        def long(fields: list[str]) -> DataFrame:
            each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields]))
            return rows.select(*table.tags, "epoch", *extra, each.alias("p")).select(*table.tags, "epoch", *extra, "p.*").where(F.col("value").isNotNull())

        def dense(points: DataFrame, keys: list[str]) -> DataFrame:
            if sparse:
                return resample(points, s.range, keys, fill=fill, default=default, lookback=lookback)
            return resample_dense(points, s.range, keys, fill=fill)

        out, plain = {}, [n for n in names if n in table.fields]
        for n in names:
            if n not in table.fields:
                keys = [*table.tags, "field"]
                out[n] = _Value(dense(long(matched[n]), keys), keys, F.col("value"))
        if len(plain) > 1 and sparse and not extra:
            wide = resample_fields(long(plain), s.range, table.tags, plain, fill=fill, default=default, lookback=lookback)
            return out | {n: _Value(wide, list(table.tags), F.col(n)) for n in plain}
        for n in plain:
            points = rows.where(F.col(n).isNotNull()).select(*table.tags, "epoch", F.col(n).cast("double").alias("value"), *extra)
            out[n] = _Value(dense(points, table.tags), list(table.tags), F.col("value"))
        return out

    def _eval(self, e, s: q.Select, sources: dict[str, _Value]):
        if isinstance(e, q.Literal):
            return e.value
        if isinstance(e, q.Field):
            return sources[e.name]
        if isinstance(e, q.Binary):
            return self._binary(e.op, self._eval(e.left, s, sources), self._eval(e.right, s, sources), s)
        args = [self._eval(a, s, sources) for a in e.args]
        if not args or not isinstance(args[0], _Value):
            raise q.UnsupportedSql(f"{e.name} needs a field")
        first, rest = args[0], args[1:]
        if e.name == "timeshift":
            return _Value(first.frame().withColumn("epoch", F.col("epoch") + interval_seconds(rest[0])), first.keys, F.col("value"))
        if e.along and e.name in dense.ALONG:
            w = Window.partitionBy(*first.keys).orderBy("epoch")
            return _Value(dense.ALONG[e.name](first.frame(), w, first.keys, *rest), first.keys, F.col("value"))
        if e.name in dense.ELEMENTWISE:
            f = dense.ELEMENTWISE[e.name]
            if rest and isinstance(rest[0], _Value):
                both, l, r = self._aligned(first, rest[0])
                return both.but(f(l, r))
            return first.but(f(first.value, *rest))
        if not e.along and e.name in dense.AGGREGATES:
            if first.grouped:
                first = _Value(first.frame(), first.keys, F.col("value"))
            value = dense.AGGREGATES[e.name](first.value, *rest)
            if isinstance(s.fill, (int, float)) and e.name not in ("topk", "as_percentage"):
                value = F.coalesce(value, F.lit(float(s.fill)))
            return _Value(first.df, [k for k in first.keys if k in s.group_by], value, True)
        raise q.UnsupportedSql(f"unknown function {'t.' * e.along}{e.name}")

    def _aligned(self, a: _Value, b: _Value) -> tuple[_Value, Column, Column]:
        """Both sides as expressions over one frame. Where they come from different frames these meet by group and epoch,
        null tags with null tags; a side without some keys goes with every group of the other."""
        if a.fits(b):
            return a, a.value, b.value
        left, right = a.frame().withColumnRenamed("value", "l"), b.frame().withColumnRenamed("value", "r")
        on = [*(k for k in a.keys if k in b.keys), "epoch"]
        how = "full_outer" if set(a.keys) == set(b.keys) else "left" if len(a.keys) >= len(b.keys) else "right"
        keys = a.keys if len(a.keys) >= len(b.keys) else b.keys
        right = right.select(*[F.col(c).alias(f"__{c}") if c in on else F.col(c) for c in right.columns])
        both = left.join(right, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on], how)
        shared = [(F.col(f"__{c}") if how == "right" else F.coalesce(c, f"__{c}")).alias(c) for c in on]
        both = both.select(*[k for k in keys if k not in on], *shared, "l", "r")
        return _Value(both, list(keys), F.col("l")), F.col("l"), F.col("r")

    def _binary(self, op: str, a, b, s: q.Select):
        f = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: F.try_divide(x, y)}[op]
        if not isinstance(a, _Value) and not isinstance(b, _Value):
            return None if a is None or b is None or (op == "/" and not b) else {"+": a + b, "-": a - b, "*": a * b, "/": a / b if b else None}[op]
        if not isinstance(b, _Value):
            return a.but(f(a.value, F.lit(_number(b))))
        if not isinstance(a, _Value):
            return b.but(f(F.lit(_number(a)), b.value))
        both, l, r = self._aligned(a, b)
        if isinstance(s.fill, (int, float)):
            l, r = F.coalesce(l, F.lit(float(s.fill))), F.coalesce(r, F.lit(float(s.fill)))
        return both.but(f(l, r))


def _matches(pattern: str, field: str) -> bool:
    """A field name, a pattern with stars, or a set of those in braces."""
    return any(fnmatch.fnmatchcase(field, p.strip()) for p in re.split("[;,]", pattern.strip("{}")))


def _number(x) -> float:
    return None if x is None else float(interval_seconds(x)) if isinstance(x, str) else float(x)
