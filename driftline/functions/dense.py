"""Functions of the SQL dialect: aggregates across series, and transforms of single series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def V() -> Column:  # a column needs a session, which a module has not at import
    return F.col("value")


def _shares(values: Column) -> Column:
    return F.transform(values, lambda x: F.try_divide(x * 100, F.aggregate(values, F.lit(0.0), lambda a, y: a + y)))


#: f(x, ...): one value for each group and epoch from the values of its series; nulls do not take part.
AGGREGATES: dict[str, Callable[..., Column]] = {
    "mean": F.avg, "average": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "amin": F.min, "amax": F.max,
    "nanmean": F.avg, "nansum": F.sum, "nanmin": F.min, "nanmax": F.max, "nanmedian": F.median, "nanstd": F.stddev_pop, "nanvar": F.var_pop,
    "median": F.median, "std": F.stddev_pop, "var": F.var_pop, "prod": F.product, "nanprod": F.product,
    "ptp": lambda v: F.max(v) - F.min(v), "count": lambda v: F.count(v).cast("double"),
    "percentile": lambda v, q: F.percentile(v, float(q) / 100), "quantile": lambda v, q: F.percentile(v, float(q)),
    "nanpercentile": lambda v, q: F.percentile(v, float(q) / 100), "nanquantile": lambda v, q: F.percentile(v, float(q)),
    "approx_percentile": lambda v, q: F.percentile_approx(v, float(q) / 100),
    "any": lambda v: F.max((v != 0).cast("double")), "all": lambda v: F.min((v != 0).cast("double")),
    "topk": lambda v, k: F.slice(F.sort_array(F.collect_list(v)), F.greatest(F.lit(1), F.count(v).cast("int") - int(k) + 1), F.lit(int(k))),
    "as_percentage": lambda v: _shares(F.sort_array(F.collect_list(v))),
}

def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


#: Value by value; further arguments are numbers or columns.
ELEMENTWISE: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "absolute": F.abs, "fabs": F.abs, "negative": lambda x: -x, "sign": F.signum, "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)), "cbrt": F.cbrt, "square": lambda x: x * x,
    "power": lambda x, p: F.pow(x, F.lit(p)), "exp": F.exp, "expm1": F.expm1, "exp2": lambda x: F.pow(F.lit(2.0), x),
    "log": lambda x: F.when(x > 0, F.ln(x)), "log2": lambda x: F.when(x > 0, F.log2(x)), "log10": lambda x: F.when(x > 0, F.log10(x)), "log1p": lambda x: F.when(x > -1, F.log1p(x)),
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "arctan2": lambda x, y: F.atan2(x, _column(y)), "hypot": lambda x, y: F.hypot(x, _column(y)), "degrees": F.degrees, "radians": F.radians,
    "floor": lambda x: F.floor(x).cast("double"), "ceil": lambda x: F.ceil(x).cast("double"), "rint": lambda x: F.bround(x, 0), "trunc": lambda x: F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("double"),
    "round": lambda x, n=0: F.bround(x, int(n)), "around": lambda x, n=0: F.bround(x, int(n)),
    "clip": lambda x, lo, hi: F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi))),  # least and greatest skip a null bound
    "nan_to_num": lambda x: F.nanvl(x, F.lit(0.0)), "isnan": lambda x: F.isnan(x).cast("double"),
    "maximum": lambda x, y: F.when(x.isNotNull() & _column(y).isNotNull(), F.greatest(x, _column(y))), "minimum": lambda x, y: F.when(x.isNotNull() & _column(y).isNotNull(), F.least(x, _column(y))),
    "add": lambda x, y: x + y, "subtract": lambda x, y: x - y, "multiply": lambda x, y: x * y, "divide": lambda x, y: F.try_divide(x, _column(y)),
    "mod": lambda x, y: F.when(_column(y) != 0, F.pmod(x, _column(y))), "floor_divide": lambda x, y: F.floor(F.try_divide(x, _column(y))).cast("double"),
    "percent": lambda x, y: F.try_divide(x * 100, _column(y)),
}


def _shift(df: DataFrame, w, keys, n: float) -> DataFrame:
    n = int(n)
    moved = F.lag("value", n, 0.0).over(w) if n > 0 else F.lead("value", -n, 0.0).over(w) if n < 0 else V()
    return df.withColumn("value", moved)


def _diff(df: DataFrame, w, keys) -> DataFrame:
    return df.withColumn("n", F.row_number().over(w)).withColumn("value", V() - F.lag("value").over(w)).where(F.col("n") > 1).drop("n")


def _gradient(df: DataFrame, w, keys) -> DataFrame:
    before, after = F.lag("value").over(w), F.lead("value").over(w)
    first, last = F.row_number().over(w) == 1, F.lead("epoch").over(w).isNull()
    return df.withColumn("value", F.when(first, after - V()).when(last, V() - before).otherwise((after - before) / 2))


def _running(f: Callable) -> Callable:
    return lambda df, w, keys: df.withColumn("value", f("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))


#: t.f(x, ...): along the time axis of each series.
ALONG: dict[str, Callable[..., DataFrame]] = {
    "shift": _shift, "diff": _diff, "gradient": _gradient, "cumsum": _running(F.sum), "cumprod": _running(F.product),
    "as_percentage": lambda df, w, keys: df.withColumn("value", F.try_divide(V() * 100, F.sum("value").over(Window.partitionBy(*keys)))),
}
