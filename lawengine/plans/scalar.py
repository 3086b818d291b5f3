"""Trees to Spark columns: everything stays in generated JVM code, and Catalyst prunes and pushes as usual."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import ieee
from .nodes import Binary, Call, Delay, Expr, GroupedParameter, Number, Parameter, Symbol, Unary

CONSTANTS = {"pi": math.pi, "e": math.e}


def to_column(e: Expr, parameters: dict | None = None, columns: dict | None = None) -> Column:
    """columns: columns (or other column expressions) by name; a name that isn't there is a column of the frame.

    parameters: numbers by name, or dictionaries of numbers by category for grouped parameters.
    """
    own = lambda x: to_column(x, parameters, columns)
    if isinstance(e, Number):
        return F.lit(float(e.value))
    if isinstance(e, Symbol):
        if columns is not None and e.name in columns:
            return columns[e.name]
        if e.value is not None:
            return F.lit(float(e.value))
        if columns is not None:
            if e.name in CONSTANTS:
                return F.lit(CONSTANTS[e.name])
            raise KeyError(f"no variable {e.name!r}")
        return F.lit(CONSTANTS[e.name]) if e.name in CONSTANTS else ieee.number(F.col(f"`{e.name}`"))
    if isinstance(e, Parameter):
        v = (parameters or {}).get(e.name, e.value)
        if v is None:
            raise ValueError(f"parameter {e.name!r} has no value")
        return v if isinstance(v, Column) else F.lit(float(v))
    if isinstance(e, GroupedParameter):
        return _grouped(e, parameters, columns)
    if isinstance(e, Unary):
        return -own(e.operand)
    if isinstance(e, Binary):
        a, b = own(e.left), own(e.right)
        if e.op == "/":
            return ieee.divide(a, b)
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "**": lambda: F.pow(a, b)}[e.op]()
    if isinstance(e, Call):
        return ieee.FUNCTIONS[e.name](*map(own, e.args))
    if isinstance(e, Delay):
        raise ValueError("a delay needs the order of time: see operators.delay")
    raise ValueError(f"{type(e).__name__} must be evaluated on a graph")


def _grouped(e: GroupedParameter, parameters: dict | None, columns: dict | None) -> Column:
    values = (parameters or {}).get(e.name, e.value)
    if not values and e.default is None:
        raise ValueError(f"grouped parameter {e.name!r} has no values")
    by = columns[e.by.name] if columns and isinstance(e.by, Symbol) and e.by.name in columns else F.col(f"`{e.by.name}`") if isinstance(e.by, Symbol) else to_column(e.by, parameters, columns)
    found = F.lit(None).cast("double")
    if values:
        table = F.create_map(*[F.lit(x) for k, v in values.items() for x in (str(k), float(v))])
        found = F.get(F.array(F.try_element_at(table, by.cast("string"))), F.lit(0))
    if e.default is not None:
        return F.coalesce(found, F.lit(float(e.default)))
    return F.coalesce(found, F.raise_error(F.concat(F.lit(f"grouped parameter {e.name!r} has no value for "), F.coalesce(by.cast("string"), F.lit("null")))).cast("double"))
