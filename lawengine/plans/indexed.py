"""Formulas over graphs: each tree becomes a DataFrame plan keyed by its free indices.

A value is asked for at coordinates: `attach` adds a column to a frame that holds index columns. A node value is a
join on the node, a relation's membership a left join filled with 0, and a sum an aggregate by the indices that
stay. Sums are rewritten first (linearity, factors that don't hold the summed index, indices that the body doesn't
hold), so that cross joins are left only where the formula itself asks for every pair.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ieee
from .expand import separated
from .lower import desugar, fold_constants
from .nodes import Binary, Call, Expr, Gather, Indexed, Number, Parameter, Reduction, Symbol, Unary
from .scalar import CONSTANTS, to_column

SAMPLE = "sample"


@dataclass
class Graph:
    """nodes: (node, a column for each variable[, sample]); relations: (row_id, then one column for each index);
    fields: name -> (relation, frame of row_id, value[, sample]); scalars: plain numbers. Nodes are 0..num_nodes-1."""

    num_nodes: int
    nodes: DataFrame
    relations: dict[str, DataFrame] = field(default_factory=dict)
    fields: dict[str, tuple[str, DataFrame]] = field(default_factory=dict)
    scalars: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        """A field may be given as its frame alone; it then belongs to the only relation that has as many rows."""
        for name, own in list(self.fields.items()):
            if isinstance(own, DataFrame):
                self.fields[name] = (self.relation_of(name, own), own)
        if not isinstance(self.num_nodes, int) or isinstance(self.num_nodes, bool) or self.num_nodes < 1:
            raise ValueError("num_nodes must be a positive integer")

    @property
    def spark(self):
        return self.nodes.sparkSession

    def relation_of(self, field_name: str, values: DataFrame) -> str:
        n = values.select("row_id").distinct().count()
        found = [r for r, rows in self.relations.items() if rows.count() == n]
        if len(found) != 1:
            raise ValueError(f"the relation of field {field_name!r} must be stated: {found or 'none'} has {n} rows")
        return found[0]

    def arity(self, relation: str) -> int:
        return len(self.relations[relation].columns) - 1

    def coordinates(self, relation: str, indices: tuple[str, ...]) -> DataFrame:
        df = self.relations[relation]
        if len(indices) != self.arity(relation):
            raise ValueError(f"relation {relation!r} has {self.arity(relation)} indices")
        return df.toDF("row_id", *indices)

    def sampled(self, name: str) -> bool:
        if name in self.fields:
            return SAMPLE in self.fields[name][1].columns
        return SAMPLE in self.nodes.columns and name in self.nodes.columns


def _kind(e: Expr, g: Graph) -> str:
    """Of an Indexed node: relation, field, node, or lifted (a gather's rows put back at their coordinates)."""
    if isinstance(e.base, Gather):
        return "lifted"
    name = e.base.name if isinstance(e.base, Symbol) else None
    return "relation" if name in g.relations else "field" if name in g.fields else "node" if name in g.nodes.columns else "reindex"


def free(e: Expr) -> tuple[str, ...]:
    """Free indices in order of appearance."""
    if isinstance(e, Indexed):
        return tuple(dict.fromkeys(e.indices))
    if isinstance(e, Reduction):
        own = dict.fromkeys(i for x in (e.relation, e.body) if x is not None for i in free(x))
        return tuple(i for i in own if i not in e.indices)
    if isinstance(e, Gather):
        return ()
    return tuple(dict.fromkeys(i for x in e.operands for i in free(x)))


def validate(e: Expr, g: Graph, active: tuple[str, ...] = (), row_wise: bool = False) -> None:
    """row_wise: the formula is one of a relation's rows, of which its fields have a value each."""
    if isinstance(e, Reduction):
        for i in e.indices:
            if i in active:
                raise ValueError(f"index {i!r} is already active")
        for x in (e.relation, e.body):
            if x is not None:
                validate(x, g, active + e.indices)
        return
    if isinstance(e, Gather):
        inner = free(e.relation)
        names = {x.base.name for x in e.relation.iter_preorder() if isinstance(x, Indexed) and _kind(x, g) == "relation"}
        if not names:
            raise ValueError("gather takes an indexed relation")
        for x in e.body.iter_preorder():
            if isinstance(x, Indexed) and not set(x.indices) <= set(inner):
                raise ValueError(f"index {next(i for i in x.indices if i not in inner)!r} is absent from the relation of gather")
        validate(e.relation, g, active)
        _no_bare(e.body, g, names)
        return
    if isinstance(e, Indexed):
        if isinstance(e.base, Gather):
            validate(e.base, g, ())
        elif not isinstance(e.base, Symbol):
            if len(free(e.base)) > 1:
                raise ValueError("only an expression of one free index can be indexed again")
            validate(e.base, g, active)
        elif e.base.name not in g.relations and e.base.name not in g.fields and e.base.name not in g.nodes.columns:
            raise KeyError(f"no variable {e.base.name!r}")
        return
    if isinstance(e, Symbol) and row_wise and e.name in g.fields:
        return
    if isinstance(e, Symbol) and e.name not in CONSTANTS and e.name not in g.scalars and e.value is None:
        if e.name in g.nodes.columns or e.name in g.relations or e.name in g.fields:
            raise ValueError(f"{e.name!r} must be indexed")
        raise KeyError(f"no variable {e.name!r}")
    for x in e.operands:
        validate(x, g, active, row_wise)


def _no_bare(e: Expr, g: Graph, relations: set[str]) -> None:
    """In a gather's body a field of its relation may stand without indices: it has a value for each row."""
    if isinstance(e, Symbol) and e.name in g.fields:
        if len(relations) > 1 or g.fields[e.name][0] not in relations:
            raise ValueError(f"field {e.name!r} belongs to another relation")
        return
    if isinstance(e, Symbol) and e.name in g.nodes.columns:
        raise ValueError(f"{e.name!r} must be indexed")
    if not isinstance(e, Indexed):
        for x in e.operands:
            _no_bare(x, g, relations)


def has_sample(e: Expr, g: Graph) -> bool:
    return any(isinstance(x, Symbol) and g.sampled(x.name) for x in e.iter_preorder())


def domain(g: Graph, indices: tuple[str, ...], sampled: bool = False) -> DataFrame:
    """Every combination of nodes (and samples): asked for by free indices at the root alone."""
    out = g.nodes.select(SAMPLE).distinct() if sampled else None
    for i in indices:
        own = g.spark.range(g.num_nodes).toDF(i)
        out = own if out is None else out.crossJoin(own)
    return out if out is not None else g.spark.range(1).select()


def near(c: str, fill: float) -> Column:
    """Whether an entry is the fill value, as far as doubles tell: such entries are no entries."""
    w = F.col(c)
    if fill != fill:
        return F.isnan(w)
    return F.coalesce((w == fill) | (F.abs(w - fill) <= 1e-8 + 1e-5 * abs(fill)), F.lit(False))


class Compiler:
    def __init__(self, g: Graph, parameters: dict | None = None):
        self.g, self.parameters, self.names = g, parameters, (f"_v{n}" for n in count())

    def attach(self, df: DataFrame, e: Expr, row_fields: bool = False) -> tuple[DataFrame, Column]:
        """df with what e needs added, and e as a column of it. row_fields: bare fields meet df by row_id."""
        if isinstance(e, Indexed):
            return self._indexed(df, e)
        if isinstance(e, Reduction):
            return self._sum(df, e)
        if isinstance(e, Gather):
            raise ValueError("gather stands at the root, or is put back by indices")
        if isinstance(e, Symbol) and e.name in self.g.scalars:
            return df, F.lit(float(self.g.scalars[e.name]))
        if isinstance(e, Symbol) and e.name in self.g.fields:
            if not row_fields:
                raise ValueError(f"{e.name!r} must be indexed")
            name, values = next(self.names), self.g.fields[e.name][1]
            keys = ["row_id", *[SAMPLE] * (SAMPLE in values.columns and SAMPLE in df.columns)]
            return df.join(values.select(*keys, F.col("value").cast("double").alias(name)), keys, "left"), F.col(name)
        if isinstance(e, (Number, Symbol, Parameter)):
            return df, to_column(e, self.parameters, {})
        values = []
        for x in e.operands:
            df, v = self.attach(df, x, row_fields)
            values.append(v)
        named = {f"_arg{i}": v for i, v in enumerate(values)}
        return df, to_column(e.with_operands(tuple(Symbol(n) for n in named)), self.parameters, named)

    def _on(self, df: DataFrame, other: DataFrame, keys: dict[str, str], how: str) -> DataFrame:
        """Join on df's columns (keys) and other's (values)."""
        other = other.select(*[F.col(v).alias(f"_k_{v}") if v in keys.values() else F.col(v) for v in other.columns])
        on = None
        for mine, theirs in keys.items():
            c = F.col(mine) == F.col(f"_k_{theirs}")
            on = c if on is None else on & c
        out = df.join(other, on, how) if on is not None else df.crossJoin(other)
        return out.drop(*[f"_k_{v}" for v in set(keys.values())])

    def _indexed(self, df: DataFrame, e: Indexed) -> tuple[DataFrame, Column]:
        kind, g, name = _kind(e, self.g), self.g, next(self.names)
        if kind == "node":
            if len(e.indices) != 1:
                raise ValueError(f"{e.base.name!r} has one index")
            values = g.nodes.select("node", *[SAMPLE] * (SAMPLE in g.nodes.columns), F.col(f"`{e.base.name}`").cast("double").alias(name))
            keys = {e.indices[0]: "node"} | ({SAMPLE: SAMPLE} if SAMPLE in values.columns and SAMPLE in df.columns else {})
            return self._on(df, values, keys, "inner"), F.col(name)
        if kind == "relation":
            have = g.coordinates(e.base.name, tuple(f"_c{k}" for k in range(len(e.indices)))).drop("row_id").distinct().withColumn(name, F.lit(1.0))
            return self._on(df, have, {i: f"_c{k}" for k, i in enumerate(e.indices)}, "left"), F.coalesce(F.col(name), F.lit(0.0))
        if kind in ("field", "lifted"):
            cols = tuple(f"_c{k}" for k in range(len(e.indices)))
            if kind == "field":
                relation, values = g.fields[e.base.name]
                rows = g.coordinates(relation, cols).join(values, "row_id")
            else:
                rows = self.gathered(e.base)
                rows = rows.toDF(*[{x: c for x, c in zip(free(e.base.relation), cols, strict=True)}.get(x, x) for x in rows.columns])
            keys = [*cols, *[SAMPLE] * (SAMPLE in rows.columns)]
            last = rows.groupBy(*keys).agg(F.max_by(F.col("value").cast("double"), "row_id").alias(name))  # of equal coordinates the last row counts
            on = {i: c for i, c in zip(e.indices, cols, strict=True)} | ({SAMPLE: SAMPLE} if SAMPLE in keys and SAMPLE in df.columns else {})
            return self._on(df, last, on, "left"), F.coalesce(F.col(name), F.lit(0.0))
        own = free(e.base)
        return self.attach(df, _renamed(e.base, dict(zip(own, e.indices, strict=False))))

    # relations as sparse tensors

    def tensor(self, e: Expr) -> tuple[DataFrame, float]:
        """(frame of e's indices and `w`, fill): the value where an entry is stored, and everywhere else."""
        if isinstance(e, Indexed) and _kind(e, self.g) == "relation":
            return self.g.coordinates(e.base.name, e.indices).drop("row_id").distinct().withColumn("w", F.lit(1.0)), 0.0
        if isinstance(e, Indexed) and _kind(e, self.g) == "field":
            relation, values = self.g.fields[e.base.name]
            rows = self.g.coordinates(relation, e.indices).join(values, "row_id")
            return rows.groupBy(*e.indices).agg(F.max_by(F.col("value").cast("double"), "row_id").alias("w")), 0.0
        own = [x for x in e.operands]
        sparse = [i for i, x in enumerate(own) if free(x)]
        plain = lambda cols: to_column(e.with_operands(tuple(Symbol(f"_a{i}") for i in range(len(own)))), self.parameters, cols)
        value = lambda i: F.lit(self.constant(own[i]))
        if len(sparse) == 1:
            k = sparse[0]
            rows, fill = self.tensor(own[k])
            rest = {f"_a{i}": value(i) for i in range(len(own)) if i != k}
            filled = self.constant_of(plain(rest | {f"_a{k}": F.lit(fill)}))
            return rows.withColumn("w", plain(rest | {f"_a{k}": F.col("w")})), filled
        if len(sparse) == 2 and len(own) == 2:
            (a, fa), (b, fb) = self.tensor(own[0]), self.tensor(own[1])
            keys = list(free(own[0]))
            if set(keys) != set(free(own[1])):
                raise ValueError("relations that are combined have the same indices")
            met = a.withColumnRenamed("w", "wa").join(b.withColumnRenamed("w", "wb"), keys, "full_outer")
            at = {"_a0": F.coalesce("wa", F.lit(fa)), "_a1": F.coalesce("wb", F.lit(fb))}
            fill = self.constant_of(plain({"_a0": F.lit(fa), "_a1": F.lit(fb)}))
            return met.select(*keys, plain(at).alias("w")).filter(~near("w", fill)), fill
        raise ValueError("not a relation")

    def constant(self, e: Expr) -> float:
        if isinstance(e, Symbol) and e.name in self.g.scalars:
            return float(self.g.scalars[e.name])
        return self.constant_of(to_column(e, self.parameters, {n: F.lit(float(v)) for n, v in self.g.scalars.items()}))

    def constant_of(self, c: Column) -> float:
        return float(self.g.spark.range(1).select(c.alias("v")).first()["v"])

    def is_relation(self, e: Expr) -> bool:
        leaves = [x for x in e.iter_preorder() if isinstance(x, Indexed)]
        return bool(leaves) and all(_kind(x, self.g) in ("relation", "field") for x in leaves) and any(_kind(x, self.g) == "relation" for x in leaves) and not any(isinstance(x, (Reduction, Gather)) for x in e.iter_preorder())

    # sums

    def _sum(self, df: DataFrame, e: Reduction) -> tuple[DataFrame, Column]:
        if e.relation is None and self.is_relation(e.body):
            e = Reduction(e.indices, Number(1.0), e.body)
        if e.relation is None:
            return self._plain_sum(df, e.indices, e.body)
        if not self.is_relation(e.relation):
            return self._plain_sum(df, e.indices, e.relation * e.body)
        held = free(e.relation)
        absent = [i for i in e.indices if i not in held]
        if absent:  # the relation doesn't hold the index: sum the body over it first
            return self._sum(df, Reduction(tuple(i for i in e.indices if i in held), Reduction(tuple(absent), e.body), e.relation))
        rows, fill = self.tensor(e.relation)
        rest = tuple(i for i in free(e) if i in df.columns)
        need = [i for i in free(e.body) if i not in held]
        sampled = has_sample(e.body, self.g)
        if need or (sampled and SAMPLE in df.columns):
            more = df.select(*[c for c in dict.fromkeys([*need, *[SAMPLE] * (sampled and SAMPLE in df.columns)])]).distinct()
            rows = rows.crossJoin(more)
        rows, v = self.attach(rows, e.body)
        keys = [*rest, *[SAMPLE] * (sampled and SAMPLE in df.columns)]
        name = next(self.names)
        weight = F.col("w") - F.lit(fill)
        total = rows.groupBy(*keys).agg(F.sum(v * weight).alias(name)) if keys else rows.agg(F.sum(v * weight).alias(name))
        df = self._on(df, total, {k: k for k in keys}, "left")
        out = F.coalesce(F.col(name), F.lit(0.0))
        if fill:
            df, base = self._plain_sum(df, e.indices, e.body)
            out = out + F.lit(fill) * base
        return df, out

    def _plain_sum(self, df: DataFrame, indices: tuple[str, ...], body: Expr) -> tuple[DataFrame, Column]:
        """Over the whole node domain."""
        used = free(body)
        absent = [i for i in indices if i not in used]
        indices = tuple(i for i in indices if i in used)
        times = float(self.g.num_nodes) ** len(absent)
        if not indices:
            df, v = self.attach(df, body)
            return df, v * F.lit(times)
        if isinstance(body, Unary):
            df, v = self._plain_sum(df, indices, body.operand)
            return df, -v * F.lit(times)
        if isinstance(body, Binary) and body.op in "+-":
            df, a = self._plain_sum(df, indices, body.left)
            df, b = self._plain_sum(df, indices, body.right)
            return df, (a + b if body.op == "+" else a - b) * F.lit(times)
        if isinstance(body, Binary) and body.op in "*/":
            for out, kept in ((body.left, body.right), (body.right, body.left)):
                if (body.op == "*" or out is body.right) and not set(free(out)) & set(indices):
                    df, v = self.attach(df, out)
                    df, s = self._plain_sum(df, indices, kept)
                    return df, (v * s if body.op == "*" else to_column(Binary("/", Symbol("a"), Symbol("b")), None, {"a": s, "b": v})) * F.lit(times)
        rest = [i for i in used if i not in indices]
        if rest and len(indices) == 1 and (pairs := separated(body, free, indices[0], self._middle)):
            out = None
            for outer, inner in pairs:  # products of totals: no pair of nodes is made
                df, v = self.attach(df, outer)
                df, s = self._plain_sum(df, indices, inner)
                out = v * s if out is None else out + v * s
            return df, out * F.lit(times)
        sampled = has_sample(body, self.g) and SAMPLE in df.columns
        keys = [*rest, *[SAMPLE] * sampled]
        grid = domain(self.g, indices)
        if keys:
            grid = df.select(*keys).distinct().crossJoin(grid)
        grid, v = self.attach(grid, body)
        name = next(self.names)
        total = grid.groupBy(*keys).agg(F.sum(v).alias(name)) if keys else grid.agg(F.sum(v).alias(name))
        return self._on(df, total, {k: k for k in keys}, "left"), F.coalesce(F.col(name), F.lit(0.0)) * F.lit(times)

    def _middle(self, e: Expr, how: str) -> float:
        """The mean or the greatest value of an expression of one index, over all nodes; 0 where there is none."""
        if not free(e):
            return self.constant(e)
        df, v = self.attach(domain(self.g, tuple(free(e)), has_sample(e, self.g)), e)
        got = df.agg((F.avg if how == "avg" else F.max)(F.when(ieee.finite(v), v))).first()[0]
        return 0.0 if got is None else float(got)

    # gathers

    def gathered(self, e: Gather) -> DataFrame:
        """row_id, the relation's indices (, sample), value: rows of a relation as they are stored; of relation
        algebra its entries other than zero, in order; of one filled with another number, every coordinate."""
        names, indices = e.relation, free(e.relation)
        if isinstance(names, Indexed):
            rows = self.g.coordinates(names.base.name, names.indices).withColumn("w", F.lit(1.0))
        else:
            tensor, fill = self.tensor(e.relation)
            if fill:
                tensor = domain(self.g, indices).join(tensor, list(indices), "left").withColumn("w", F.coalesce("w", F.lit(fill)))
            else:
                tensor = tensor.filter(~near("w", 0.0))
            rank = F.lit(0).cast("long")
            for i in indices:  # the place of a coordinate, which is unique and keeps the order
                rank = rank * self.g.num_nodes + F.col(i)
            rows = tensor.withColumn("row_id", rank)
        if has_sample(e.body, self.g):
            rows = rows.crossJoin(self.g.nodes.select(SAMPLE).distinct())
        rows, v = self.attach(rows, e.body, row_fields=True)
        return rows.select("row_id", *indices, *[SAMPLE] * (SAMPLE in rows.columns), (F.col("w") * v).alias("value"))


def _renamed(e: Expr, names: dict[str, str]) -> Expr:
    if isinstance(e, Indexed) and isinstance(e.base, Symbol):
        return Indexed(e.base, tuple(names.get(i, i) for i in e.indices))
    if isinstance(e, Reduction):
        inner = {k: v for k, v in names.items() if k not in e.indices}
        return e.with_operands(tuple(_renamed(x, inner) for x in e.operands))
    return e.with_operands(tuple(_renamed(x, names) for x in e.operands))


def evaluate(e: Expr, g: Graph, parameters: dict | None = None) -> DataFrame:
    """The free indices (, sample) and `value`, over the whole node domain; of a gather at the root, a row for each of its rows."""
    e = fold_constants(desugar(e))
    gathers = [x for x in _open(e) if isinstance(x, Gather)]
    validate(e, g, row_wise=bool(gathers))
    c = Compiler(g, parameters)
    if gathers:
        return _row_wise(e, gathers, c)
    indices, sampled = tuple(sorted(free(e))), has_sample(e, g)
    df, v = c.attach(domain(g, indices, sampled), e)
    return df.select(*indices, *[SAMPLE] * sampled, v.alias("value"))


def side_by_side(exprs: list[Expr], g: Graph, parameters: dict | None, target: str) -> tuple[DataFrame, list[Column]]:
    """A frame with a value of each formula, at the coordinates of the first one; and of the target, last.

    The target is a node variable, or a field where the first formula is one of a relation's rows.
    """
    exprs = [fold_constants(desugar(e)) for e in exprs]
    gathers = [x for x in _open(exprs[0]) if isinstance(x, Gather)]
    validate(exprs[0], g, row_wise=bool(gathers))
    c = Compiler(g, parameters)
    if not gathers:
        indices = tuple(sorted(free(exprs[0])))
        if len(indices) != 1:
            raise ValueError("a target of nodes is held against a formula of one free index")
        df = domain(g, indices, has_sample(exprs[0], g) or g.sampled(target))
        out = []
        for e in [*exprs, Indexed(Symbol(target), indices)]:
            df, v = c.attach(df, e)
            out.append(v)
        return df, out
    df, out = None, []
    for k, e in enumerate([*exprs, Symbol(target)]):
        own = [x for x in _open(e) if isinstance(x, Gather)]
        if not own and not any(isinstance(x, Symbol) and x.name in g.fields for x in e.iter_preorder()):
            out.append(to_column(e, parameters, {n: F.lit(float(v)) for n, v in g.scalars.items()}))
            continue
        if own:
            rows = _row_wise(e, own, c).withColumnRenamed("value", f"_e{k}")
            df = rows if df is None else df.join(rows, [x for x in rows.columns if x != f"_e{k}"])
            out.append(F.col(f"_e{k}"))
        else:
            df, v = c.attach(df, e, row_fields=True)
            out.append(v)
    return df, out


def _open(e: Expr):
    """Nodes outside of indexed ones, sums and gathers."""
    yield e
    if not isinstance(e, (Indexed, Reduction, Gather)):
        for x in e.operands:
            yield from _open(x)


def _row_wise(e: Expr, gathers: list[Gather], c: Compiler) -> DataFrame:
    """Arithmetic around gathers of one relation: row by row."""
    if any(str(x.relation) != str(gathers[0].relation) for x in gathers):
        raise ValueError("gathers that are combined are of one relation")
    df = c.gathered(gathers[0]).withColumnRenamed("value", "_g0")
    keys = [k for k in df.columns if k != "_g0"]
    for n, x in enumerate(gathers[1:], 1):
        df = df.join(c.gathered(x).withColumnRenamed("value", f"_g{n}"), keys)

    def swap(x: Expr) -> Expr:
        for n, y in enumerate(gathers):
            if x is y:
                return Symbol(f"_g{n}")
        return x.with_operands(tuple(swap(y) for y in x.operands))

    columns = {f"_g{n}": F.col(f"_g{n}") for n in range(len(gathers))} | {n: F.lit(float(v)) for n, v in c.g.scalars.items()}
    fields = {x.name for x in e.iter_preorder() if isinstance(x, Symbol) and x.name in c.g.fields}
    for name in fields:
        df, columns[name] = c.attach(df, Symbol(name), row_fields=True)
    return df.select(*keys, to_column(swap(e), c.parameters, columns).alias("value"))


__all__ = ["Call", "Compiler", "Graph", "evaluate", "free"]
