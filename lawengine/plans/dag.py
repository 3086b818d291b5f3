"""Many formulas as one graph: equal subexpressions are one node, which is worked out once for a batch of rows.

Values are NumPy's, with the results that the compiled columns have: inf and NaN where numbers have them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .nodes import Binary, Call, Expr, Number, Parameter, Symbol, Unary
from .scalar import CONSTANTS


def power(a, b):
    """As the JVM has it: a NaN exponent gives NaN, and so does an infinite one over 1 or -1."""
    return np.where(np.isnan(b) | (np.isinf(b) & (np.abs(a) == 1)), np.nan, np.power(a, b))


#: What a node does with its operands' values.
OPERATIONS = {
    "neg": np.negative, "+": np.add, "-": np.subtract, "*": np.multiply, "/": np.divide, "**": power, "max": np.maximum, "min": np.minimum,
    "inv": lambda x: 1 / x, "pow2": lambda x: x * x, "pow3": lambda x: x * x * x, "sec": lambda x: 1 / np.cos(x), "csc": lambda x: 1 / np.sin(x),
    "cot": lambda x: 1 / np.tan(x), "sech": lambda x: 1 / np.cosh(x), "sigmoid": lambda x: 1 / (1 + np.exp(-x)),
    **{f"defined_{n}": lambda x, f=f: f(np.where(x > 0, x, np.nan)) for n, f in (("log", np.log), ("log2", np.log2), ("log10", np.log10))},
}


def operation(name: str):
    return OPERATIONS.get(name) or getattr(np, name)


class Dag:
    """nodes[i]: ("value", x), ("name", column) or (operation, numbers of its operands, which are smaller)."""

    def __init__(self):
        self.nodes: list[tuple] = []
        self._numbers: dict[tuple, int] = {}

    def _put(self, *node) -> int:
        key = ("value", np.float64(node[1]).tobytes()) if node[0] == "value" else node
        if key not in self._numbers:
            self._numbers[key] = len(self.nodes)
            self.nodes.append(node)
        return self._numbers[key]

    def add(self, e: Expr, parameters: dict[str, float] | None = None) -> int:
        """The number of a formula's value; parameters take the place of the formula's own values."""
        if isinstance(e, Number):
            return self._put("value", float(e.value))
        if isinstance(e, Parameter):
            v = (parameters or {}).get(e.name, e.value)
            if v is None:
                raise ValueError(f"parameter {e.name!r} has no value")
            return self._put("value", float(v))
        if isinstance(e, Symbol):
            known = e.value if e.value is not None else CONSTANTS.get(e.name)
            return self._put("name", e.name) if known is None else self._put("value", float(known))
        if isinstance(e, Unary):
            return self._put("neg", (self.add(e.operand, parameters),))
        if isinstance(e, Binary):
            return self._put(e.op, (self.add(e.left, parameters), self.add(e.right, parameters)))
        if isinstance(e, Call):
            return self._put(e.name, tuple(self.add(x, parameters) for x in e.args))
        raise ValueError(f"{type(e).__name__} has no value in a row")

    @property
    def names(self) -> list[str]:
        return sorted(n[1] for n in self.nodes if n[0] == "name")

    def values(self, columns: dict[str, np.ndarray], wanted: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(number, value) of each wanted node, once each; what no later node needs is let go of."""
        last: dict[int, int] = {}
        for i, (kind, own) in enumerate(self.nodes):
            if kind not in ("value", "name"):
                last.update(dict.fromkeys(own, i))
        gone: dict[int, list[int]] = {}
        for k, i in last.items():
            gone.setdefault(i, []).append(k)
        asked, held = set(wanted), {}
        with np.errstate(all="ignore"):
            for i, (kind, own) in enumerate(self.nodes):
                held[i] = np.float64(own) if kind == "value" else columns[own] if kind == "name" else operation(kind)(*[held[k] for k in own])
                if i in asked:
                    yield i, held[i]
                for k in gone.get(i, ()):
                    del held[k]
                if i not in last:
                    del held[i]


def compiled(e: Expr, parameters: dict[str, float] | None = None):
    """A function from columns by name to the formula's values."""
    dag = Dag()
    root = dag.add(e, parameters)
    return lambda columns: next(v for _, v in dag.values(columns, [root]))
