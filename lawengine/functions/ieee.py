"""Scalar functions with IEEE results under Spark's ANSI mode: inf and NaN where numbers have them, no errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def number(c: Column) -> Column:
    """Any numeric column as double, null as NaN."""
    return F.coalesce(c.cast("double"), F.lit(NAN))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(INF))


def divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, F.try_divide(a, b)).otherwise(a * F.pow(b, F.lit(-1.0)))


def _log(fn):
    def safe(x: Column) -> Column:
        return F.when(x > 0, fn(x)).when(x == 0, F.lit(-INF)).when(x.isNull(), F.lit(None).cast("double")).otherwise(F.lit(NAN))

    return safe


def least(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(F.least(a, b))


log, log2, log10 = _log(F.log), _log(F.log2), _log(F.log10)
FUNCTIONS = {
    "abs": F.abs,
    "arccos": F.acos,
    "arcsin": F.asin,
    "arctan": F.atan,
    "cos": F.cos,
    "cosh": F.cosh,
    "cot": F.cot,
    "csc": F.csc,
    "exp": F.exp,
    "inv": lambda x: divide(F.lit(1.0), x),
    "log": log,
    "log10": log10,
    "log2": log2,
    "max": F.greatest,
    "min": least,
    "pow2": lambda x: x * x,
    "pow3": lambda x: x * x * x,
    "sec": F.sec,
    "sech": lambda x: 1 / F.cosh(x),
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
    "sign": F.signum,
    "sin": F.sin,
    "sinh": F.sinh,
    "sqrt": F.sqrt,
    "tan": F.tan,
    "tanh": F.tanh,
}
