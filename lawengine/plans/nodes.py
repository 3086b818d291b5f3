"""Formulas as immutable trees: the logical plans of this engine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields, replace
from typing import Any


def lift(x: Any) -> Expr:
    """Numbers become nodes; nodes stay."""
    if isinstance(x, Expr):
        return x
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        raise TypeError(f"not a formula or a number: {x!r}")
    return Number(x)


@dataclass(frozen=True, eq=False)
class Expr:
    def __add__(self, o):
        return Binary("+", self, lift(o))

    def __radd__(self, o):
        return Binary("+", lift(o), self)

    def __sub__(self, o):
        return Binary("-", self, lift(o))

    def __rsub__(self, o):
        return Binary("-", lift(o), self)

    def __mul__(self, o):
        return Binary("*", self, lift(o))

    def __rmul__(self, o):
        return Binary("*", lift(o), self)

    def __truediv__(self, o):
        return Binary("/", self, lift(o))

    def __rtruediv__(self, o):
        return Binary("/", lift(o), self)

    def __pow__(self, o):
        return Binary("**", self, lift(o))

    def __rpow__(self, o):
        return Binary("**", lift(o), self)

    def __neg__(self):
        return Unary(self)

    def __getitem__(self, indices):
        names = indices if isinstance(indices, tuple) else (indices,)
        return Indexed(self, tuple(n.name if isinstance(n, Symbol) else str(n) for n in names))

    @property
    def operands(self) -> tuple[Expr, ...]:
        return tuple(v for f in fields(self) for v in _parts(getattr(self, f.name)))

    def with_operands(self, new: tuple[Expr, ...]) -> Expr:
        rest = list(new)

        def put(v):
            if isinstance(v, Expr):
                return rest.pop(0)
            if isinstance(v, tuple) and v and all(isinstance(x, Expr) for x in v):
                return tuple(rest.pop(0) for _ in v)
            return v

        return replace(self, **{f.name: put(getattr(self, f.name)) for f in fields(self)})

    def iter_preorder(self) -> Iterator[Expr]:
        yield self
        for x in self.operands:
            yield from x.iter_preorder()

    def iter_postorder(self) -> Iterator[Expr]:
        for x in self.operands:
            yield from x.iter_postorder()
        yield self

    def transform(self, fn) -> Expr:
        """fn on every node, leaves first; fn returns the node or another."""
        own = self.operands
        new = tuple(x.transform(fn) for x in own)
        return fn(self if all(a is b for a, b in zip(own, new, strict=True)) else self.with_operands(new))

    def copy(self) -> Expr:
        return self.with_operands(tuple(x.copy() for x in self.operands))

    def replace(self, old: Expr, new: Expr) -> Expr:
        """The tree with one node, known by identity, replaced."""
        if self is old:
            return new
        own = self.operands
        got = tuple(x.replace(old, new) for x in own)
        return self if all(a is b for a, b in zip(own, got, strict=True)) else self.with_operands(got)

    def replace_at_path(self, path: tuple[int, ...], new: Expr) -> Expr:
        if not path:
            return new
        own = list(self.operands)
        own[path[0]] = own[path[0]].replace_at_path(path[1:], new)
        return self.with_operands(tuple(own))

    def __len__(self) -> int:
        """Complexity: the number of nodes."""
        return sum(1 for _ in self.iter_preorder())

    def __str__(self) -> str:
        return self.to_str()

    def to_str(self, *, latex: bool = False, number_format: str | None = None) -> str:
        from .render import to_latex, to_text

        return (to_latex if latex else to_text)(self, number_format)

    def to_tree(self) -> str:
        from .render import to_tree

        return to_tree(self)

    def to_column(self, parameters: dict | None = None, columns: dict | None = None):
        from .scalar import to_column

        return to_column(self, parameters, columns)

    def evaluate(self, data, *, parameters: dict | None = None, name: str = "value"):
        """A DataFrame with the value added, or of a graph: the value keyed by the free indices."""
        from .indexed import Graph, evaluate

        if isinstance(data, Graph):
            return evaluate(self, data, parameters)
        return data.withColumn(name, self.to_column(parameters))

    eval = evaluate

    def fit(self, data, target, **options):
        from ..operators.nonlinear import fit

        return fit(self, data, target, **options)


def _parts(v) -> tuple[Expr, ...]:
    if isinstance(v, Expr):
        return (v,)
    if isinstance(v, tuple):
        return tuple(x for x in v if isinstance(x, Expr))
    return ()


@dataclass(frozen=True, eq=False)
class Number(Expr):
    value: float


@dataclass(frozen=True, eq=False)
class Symbol(Expr):
    name: str
    value: float | None = None


@dataclass(frozen=True, eq=False)
class Parameter(Expr):
    name: str
    value: float | None = None


@dataclass(frozen=True, eq=False)
class GroupedParameter(Expr):
    by: Expr
    name: str
    value: dict | None = None
    default: float | None = None


@dataclass(frozen=True, eq=False)
class Unary(Expr):
    operand: Expr


@dataclass(frozen=True, eq=False)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True, eq=False)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True, eq=False)
class Delay(Expr):
    operand: Expr
    lag: Expr


@dataclass(frozen=True, eq=False)
class Indexed(Expr):
    base: Expr
    indices: tuple[str, ...]


@dataclass(frozen=True, eq=False)
class Reduction(Expr):
    """The sum of body over indices, weighted by a relation if one is given."""

    indices: tuple[str, ...]
    body: Expr
    relation: Expr | None = None


@dataclass(frozen=True, eq=False)
class Gather(Expr):
    """The value of body at each row of a relation."""

    relation: Expr
    body: Expr


@dataclass(frozen=True, eq=False)
class Aggregate(Expr):
    """Sugar: the sum over the edges into each node; relations list (target, source)."""

    relation: Expr
    body: Expr


@dataclass(frozen=True, eq=False)
class Lift(Expr):
    """Sugar inside Aggregate: the operand at the target or at the source of an edge."""

    role: str
    operand: Expr


Variable = Symbol


def param(name: str, value: float | None = None) -> Parameter:
    return Parameter(name, value)


def grouped_param(by, name: str, value: dict | None = None, default: float | None = None) -> GroupedParameter:
    return GroupedParameter(by if isinstance(by, Expr) else Symbol(by), name, value, default)


def function(name: str, *args) -> Call:
    from .parse import ALIASES, ARITY

    name = ALIASES.get(name, name)
    if ARITY.get(name) != len(args):
        raise ValueError(f"{name} is no function of {len(args)} arguments")
    return Call(name, tuple(map(lift, args)))


def reduction(indices, body, relation=None) -> Reduction:
    return Reduction((indices,) if isinstance(indices, str) else tuple(indices), lift(body), relation)


def gather(relation, body) -> Gather:
    return Gather(relation, lift(body))


def aggr(relation, body) -> Aggregate:
    return Aggregate(relation, lift(body))


def targ(x) -> Lift:
    return Lift("target", lift(x))


def sour(x) -> Lift:
    return Lift("source", lift(x))


def delay(x, lag) -> Delay:
    return Delay(lift(x), lift(lag))
