"""Positions of regular-expression matches with built-in functions only, in time linear in a text's length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers that are added up one after another; longer arrays are summed block by block.
BLOCK = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def _sums(values: Column) -> Column:
    """For each of a few numbers the sum of those before it; arrays only grow by appending, which copies them."""
    empty = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("out"))
    step = lambda done, x: F.struct((done["sum"] + x).alias("sum"), F.concat(done["out"], F.array(done["sum"])).alias("out"))
    return F.aggregate(values, empty, step, lambda done: done["out"])


def sums_before(values: Column, levels: int = 3) -> Column:
    """For each number of an array (bigint) the sum of those before it.

    Blocks of BLOCK numbers are summed by themselves and start from the sums of the blocks before, which are made in
    the same way: BLOCK steps a number, up to BLOCK ** levels of them, and longer arrays are still exact.
    """
    if levels == 1:
        return _sums(values)

    def blocks(v: Column) -> Column:
        last = F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(v, i * BLOCK + 1, BLOCK))

    def added(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda s, x: s + x))
        return F.flatten(F.zip_with(parts, sums_before(totals, levels - 1), lambda p, start: F.transform(_sums(p), lambda x: x + start)))

    return let(let(values, blocks), added)


def places(pieces: Column, found: Column, context: int = 0) -> Column:
    """Places of matches: array of (start, stop, value, before, after), in code points, stop exclusive.

    ``found`` are all matches of a pattern in a text and ``pieces`` that text split by the same pattern with limit -1,
    so both alternate and lengths add up to positions. ``before`` and ``after`` are up to ``context`` characters of the
    text around a match; they do not reach over the next match.
    """

    def joined(x: Column) -> Column:
        at = F.zip_with(F.slice(x["pieces"], 1, F.size(x["found"])), x["found"], lambda piece, value: F.struct(F.length(piece).cast("long").alias("gap"), piece.alias("piece"), value.alias("value")))
        at = F.zip_with(at, F.slice(x["pieces"], 2, F.greatest(F.size(x["found"]), F.lit(0))), lambda y, piece: F.struct(
            y["gap"].alias("gap"), y["value"].alias("value"), (F.right(y["piece"], F.lit(context)) if context else F.lit("")).alias("before"), (F.left(piece, F.lit(context)) if context else F.lit("")).alias("after")))
        return let(at, summed)

    def summed(at: Column) -> Column:
        before = sums_before(F.transform(at, lambda y: y["gap"] + F.length(y["value"])))
        return F.zip_with(at, before, lambda y, b: F.struct((b + y["gap"]).alias("start"), (b + y["gap"] + F.length(y["value"])).alias("stop"), y["value"].alias("value"), y["before"].alias("before"), y["after"].alias("after")))

    return let(F.struct(pieces.alias("pieces"), found.alias("found")), joined)
