"""Constants of formulas: simple ones near their literals, and the best ones in a box. All candidates of a pass are one graph of
subexpressions (`plans.dag`), scored over the same rows in one scan."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ieee, tree
from ..functions.stored import drop, stored
from ..plans.dag import Dag
from ..plans.nodes import Binary, Expr, GroupedParameter, Number, Parameter, Symbol
from ..plans.parse import parse
from . import nonlinear
from .nonlinear import HUGE, FitResult

#: Values (rows of a batch times nodes) that a task holds at a time.
CELLS = 4_000_000


def columns_of(dag: Dag, data: DataFrame) -> list[Column]:
    return [ieee.number(F.col(f"`{n}`")).alias(n) for n in dag.names]


def squared_errors(data: DataFrame, formulas: list[Expr] | list[tuple[Expr, dict]], y: Column, sides: dict[str, Column] | None = None) -> dict[str, np.ndarray]:
    """For each side (a condition) the sums of squares of y less each formula, over its rows; formulas may come with parameters. One scan."""
    dag = Dag()
    roots = [dag.add(*f) if isinstance(f, tuple) else dag.add(f) for f in formulas]
    own = sorted(set(roots))
    place = {r: i for i, r in enumerate(own)}
    sides = sides or {"all": F.lit(True)}
    names, labels = dag.names, list(sides)
    rows = data.select(*columns_of(dag, data), y.alias("#y"), *[c.alias(f"#{i}") for i, c in enumerate(sides.values())])

    def run(it):
        sums, step = np.zeros((len(labels), len(own))), max(256, CELLS // max(1, len(dag.nodes)))
        for whole in it:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                cols = {n: b.column(n).to_numpy(zero_copy_only=False) for n in names}
                truth = b.column("#y").to_numpy(zero_copy_only=False)
                on = [b.column(f"#{i}").fill_null(False).to_numpy(zero_copy_only=False) for i in range(len(labels))]
                for r, v in dag.values(cols, own):
                    with np.errstate(all="ignore"):
                        e = truth - v
                        e = e * e
                    for k, rows_on in enumerate(on):
                        sums[k, place[r]] += e.sum() if rows_on.all() else e[rows_on].sum()
        return sums.ravel()

    got = tree.gathered(rows, run)
    got = np.zeros((len(labels), len(own))) if got is None else got.reshape(len(labels), -1)
    at = [place[r] for r in roots]
    return {s: got[k, at] for k, s in enumerate(labels)}


# simple constants


#: Constants that a literal may stand for, each times one of the factors.
KNOWN = {"pi": math.pi, "e": math.e, "sqrt(2)": math.sqrt(2), "sqrt(3)": math.sqrt(3), "sqrt(5)": math.sqrt(5), "sqrt(6)": math.sqrt(6), "sqrt(7)": math.sqrt(7), "sqrt(8)": math.sqrt(8), "sqrt(10)": math.sqrt(10)}
FACTORS = {"0.5*": 0.5, "": 1.0, "2*": 2.0, "-0.5*": -0.5, "-": -1.0, "-2*": -2.0}
LARGEST_INTEGER, LARGEST_NUMERATOR, LARGEST_DENOMINATOR = 1000, 32, 12


def nearby_constants(v: float, *, most: int = 4, within: float = 0.05) -> list[tuple[str, float]]:
    """Simple constants near a literal, nearest first: the nearest integer and simple fraction, and named ones."""
    options: dict[str, float] = {}
    if abs(round(v)) <= LARGEST_INTEGER:
        options[str(round(v))] = float(round(v))
    f = Fraction(v).limit_denominator(LARGEST_DENOMINATOR)
    if f.denominator > 1 and abs(f.numerator) <= LARGEST_NUMERATOR:
        options[str(f)] = float(f)
    options |= {factor + name: k * c for name, c in KNOWN.items() for factor, k in FACTORS.items()}
    off = {s: abs(c - v) / max(abs(v), 2.2250738585072014e-308) for s, c in options.items()}
    return [(s, options[s]) for s in sorted(options, key=lambda s: (off[s], len(s), s)) if off[s] <= within][:most]


def rationalised(v: float, *, constants: dict[str, float] | None = None, tolerance: float = 1e-5, largest: int = 1000) -> str:
    """A number as a short exact form: a fraction, or a fraction of a named constant, plus another fraction if need be."""
    named = {"pi": math.pi, "e": math.e} if constants is None else constants
    if not math.isfinite(v):
        return str(v)
    near = lambda w: abs(w - v) <= tolerance * max(1.0, abs(w), abs(v))

    def told(f: Fraction, name: str) -> str:
        n = "" if abs(f.numerator) == 1 and name else str(abs(f.numerator))
        return ("-" if f < 0 else "") + "*".join(x for x in (n, name) if x) + (f"/{f.denominator}" if f.denominator > 1 else "")

    def weight(*parts: Fraction) -> float:
        return sum(math.log2(abs(f.numerator) + 1) + math.log2(f.denominator + 1) for f in parts)

    plain = Fraction(v).limit_denominator(largest)
    found = [(len(told(plain, "")) + weight(plain), told(plain, ""))] if near(float(plain)) else []
    for name, c in named.items():
        f = Fraction(v / c).limit_denominator(largest)
        if f and near(float(f) * c):
            found.append((len(told(f, name)) + weight(f), told(f, name)))
        for a, b, d in product(range(-4, 5), range(-4, 5), range(1, 5)):  # (a c + b) / d
            if a and b and near((a * c + b) / d):
                x, z = Fraction(a, d), Fraction(b, d)
                text = told(x, name) + (" + " if z > 0 else " - ") + told(abs(z), "")
                found.append((len(text) + 5 + weight(x, z), text))
    return min(found)[1] if found else repr(v)


def constant_fit(e: Expr | str, data: DataFrame, target: str | Expr, *, held: str | None = None, limit: int = 50_000) -> list[dict]:
    """Each literal as it is or as a simple constant near it; all combinations are scored in one scan.

    Of each number of literals that are kept, the combination of the best R2 counts, and of these the ones that beat
    all with fewer literals kept: the front, fewest literals first. held: a boolean column; R2 over its rows then decides, and
    `train_r2` is that of the others. Combinations with a value that isn't finite are left out.
    """
    e = parse(e) if isinstance(e, str) else e
    literals = [x for x in e.iter_preorder() if isinstance(x, Number)]
    options = [[(None, x.value), *nearby_constants(float(x.value))] for x in literals]
    n = math.prod(map(len, options))
    if n > limit:
        raise ValueError(f"{n} combinations are more than {limit}")
    names = {id(x): f"#{k}" for k, x in enumerate(literals)}
    opened = e.transform(lambda x: Parameter(names[id(x)]) if id(x) in names else x)
    combos = list(product(*options))
    y = target.to_column() if isinstance(target, Expr) else ieee.number(F.col(f"`{target}`"))
    sides = {"r2": F.lit(True)} if held is None else {"r2": F.col(held), "train_r2": ~F.col(held)}
    spread = data.select(y.alias("_y"), *[c.alias(k) for k, c in sides.items()]).agg(*[(F.var_pop(F.when(F.col(k), F.col("_y"))) * F.count(F.when(F.col(k), F.col("_y")))).alias(k) for k in sides]).first()
    left = squared_errors(data, [(opened, {f"#{k}": v for k, (_, v) in enumerate(c)}) for c in combos], y, sides)

    def determination(rest: float, total: float | None) -> float:
        if not math.isfinite(rest) or total is None:
            return math.nan
        return 1 - rest / total if total else 1.0 if rest == 0 else math.nan

    scored = []
    for k, combo in enumerate(combos):
        r2 = {side: determination(float(left[side][k]), spread[side]) for side in sides}
        if all(map(math.isfinite, r2.values())):
            scored.append({"choices": [s for s, _ in combo], "values": [v for _, v in combo], "simple": sum(s is not None for s, _ in combo), **r2})
    front: list[dict] = []
    for kept in range(len(literals) + 1):
        own = [m for m in scored if len(literals) - m["simple"] == kept]
        if own:
            best = max(own, key=lambda m: (m["r2"], [str(c) for c in m["choices"]]))
            if not front or best["r2"] > front[-1]["r2"]:
                front.append(best)
    return sorted(front, key=lambda m: -m["r2"])


# constants in a box


def places(e: Expr, path: tuple[int, ...] = ()) -> Iterator[tuple[tuple[int, ...], Expr]]:
    """Every node with its path from the root."""
    yield path, e
    for i, x in enumerate(e.operands):
        yield from places(x, (*path, i))


@dataclass
class Literal:
    path: tuple[int, ...]
    value: float
    role: str
    variable: str | None = None


#: What a literal is for, by the operator over it and its place there; all others are free.
ROLES = {("**", 1): "exponent", ("-", 1): "shift"}
#: The box of a literal by its role, from its value and, for a shift, the range of its variable.
BOXES = {
    "free": lambda v, _: (-max(100.0, 10 * abs(v) + 1), max(100.0, 10 * abs(v) + 1)),
    "exponent": lambda v, _: (-10.0, 10.0),
    "shift": lambda v, r: (r[0] - max(0.2 * (r[1] - r[0]), 10.0), r[1] + max(0.2 * (r[1] - r[0]), 10.0)),
}


def literals_of(e: Expr, variables: set[str]) -> list[Literal]:
    """All literals of a formula and what they are for; only what is taken from a variable itself is a shift."""
    at = dict(places(e))
    out = []
    for path, x in at.items():
        if isinstance(x, Number):
            above = at[path[:-1]] if path else None
            role = ROLES.get((above.op, path[-1]), "free") if isinstance(above, Binary) else "free"
            of = above.left.name if role == "shift" and isinstance(above.left, Symbol) and above.left.name in variables else None
            out.append(Literal(path, float(x.value), "free" if role == "shift" and of is None else role, of))
    return out


def ranges_of(data: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    if not names:
        return {}
    cols = {n: ieee.number(F.col(f"`{n}`")) for n in names}
    r = data.agg(*[f(F.when(ieee.finite(c), c)).alias(f"{k}{i}") for i, c in enumerate(cols.values()) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    return {n: (r[f"lo{i}"], r[f"hi{i}"]) for i, n in enumerate(names) if r[f"lo{i}"] is not None}


def evolve(losses, lower: np.ndarray, upper: np.ndarray, *, rounds: int = 15, size: int = 5, seed: int = 0) -> np.ndarray:
    """Differential evolution (best/1/bin) in a box. losses(points): one loss for each; a generation is scored at once."""
    rng = np.random.default_rng(seed)
    n, k = max(5, size * len(lower)), len(lower)
    order = np.argsort(rng.random((n, k)), axis=0)
    points = lower + (order + rng.random((n, k))) / n * (upper - lower)  # each stretch of each side once
    score = losses(points)
    for _ in range(rounds):
        best = points[int(np.argmin(score))]
        pairs = np.array([rng.choice(n, 2, replace=False) for _ in range(n)])
        trial = best + rng.uniform(0.5, 1.0) * (points[pairs[:, 0]] - points[pairs[:, 1]])
        take = rng.random((n, k)) < 0.7
        take[np.arange(n), rng.integers(0, k, n)] = True
        trial = np.where(take, trial, points)
        outside = (trial < lower) | (trial > upper)
        trial = np.where(outside, lower + rng.random((n, k)) * (upper - lower), trial)
        new = losses(trial)
        better = new <= score
        points, score = np.where(better[:, None], trial, points), np.where(better, new, score)
        if np.std(score) <= 0.01 * abs(np.mean(score)):
            break
    return points[int(np.argmin(score))]


#: Names up to which a global search is worth its scans.
SEARCHED = 12


def fit_constants(e: Expr | str, data: DataFrame, target: str, *, starts: int = 3, seed: int = 0, global_search: bool = True) -> FitResult:
    """All literals and parameters of a formula, those of categories too, each in a bounded box: from their own values, from random
    points and, up to `SEARCHED` of them, from a global search, a generation of which is one scan. The best fit counts."""
    e = parse(e) if isinstance(e, str) else e
    found = literals_of(e, set(data.columns))
    own = {x.name: x for x in e.iter_preorder() if isinstance(x, (Parameter, GroupedParameter))}
    fresh = (n for k in range(len(found) + len(own)) if (n := f"c{k}") not in own)
    named = {next(fresh): x for x in found}
    if not named and not own:
        return nonlinear.fit(e, data, target)
    opened = e
    for n, x in named.items():
        opened = opened.replace_at_path(x.path, Parameter(n, x.value))
    spans = ranges_of(data, sorted({x.variable for x in found if x.variable}))
    box = {n: BOXES[x.role if x.role != "shift" or x.variable in spans else "free"](x.value, spans.get(x.variable)) for n, x in named.items()}
    begin = {n: x.value for n, x in named.items()}
    for n, x in own.items():
        first = x.default if isinstance(x, GroupedParameter) else x.value
        begin[n] = 1.0 if first is None else float(first)
        box[n] = BOXES["free"](begin[n], None)
    used = sorted({x.name for x in e.iter_preorder() if isinstance(x, Symbol)} & set(data.columns))
    held = stored(data.select(*[F.col(f"`{n}`") for n in used], ieee.number(F.col(f"`{target}`")).alias("_y")), "fit-rows")
    try:
        points = _starts(opened, held, begin, box, own, starts, seed, global_search)
        best = None
        for p in points:
            got = nonlinear.fit_stored(opened, held, p, bounds=box)
            best = got if best is None or got.loss < best.loss else best
            if best.loss <= 1e-24:
                break
    finally:
        drop(held)
    closed = best.expression.transform(lambda x: Number(x.value) if isinstance(x, Parameter) and x.name in named else x)
    return FitResult(closed, best.parameters, best.loss, best.success, best.message, best.n_iter, best.groups)


def _starts(opened: Expr, held: DataFrame, begin: dict, box: dict, own: dict, starts: int, seed: int, search: bool) -> list[dict]:
    """Where fits begin: a number for each name, or for a grouped parameter one for each category, if these are few."""
    groups = {n: x for n, x in own.items() if isinstance(x, GroupedParameter)}
    labels = {}
    for n, x in groups.items():
        met = [r[0] for r in held.select(nonlinear.category(x).alias("g")).filter("g is not null").distinct().limit(SEARCHED + 1).collect()]
        labels[n] = sorted(met, key=str) if len(met) <= SEARCHED else None
    flat, back, rows = nonlinear.flattened(opened, held, [n for n in groups if labels[n] is not None])
    names = [n for n in begin if labels.get(n) is None and n not in back]
    names = [n for n in names if n not in groups] + list(back)
    group = lambda n: back[n][0] if n in back else n
    lower, upper = (np.array([box[group(n)][k] for n in names]) for k in (0, 1))

    def point(v: np.ndarray) -> dict:
        out: dict = dict(begin)
        for n, x in zip(names, map(float, v), strict=True):
            if n in back:
                g, label = back[n]
                out[g] = {**(out[g] if isinstance(out[g], dict) else {}), label: x}
            else:
                out[n] = x
        return out

    rng = np.random.default_rng(seed)
    first = np.clip(np.array([begin[group(n)] for n in names]), lower, upper)
    for i, n in enumerate(names):
        if n in back and (given := (groups[back[n][0]].value or {}).get(back[n][1])) is not None:
            first[i] = float(np.clip(given, lower[i], upper[i]))
    found = [point(first), *[point(rng.uniform(lower, upper)) for _ in range(max(0, starts - 1))]]
    whole = all(labels[n] is not None for n in groups)
    if search and whole and 0 < len(names) <= SEARCHED:
        n_rows = rows.count()

        def losses(at: np.ndarray) -> np.ndarray:
            left = squared_errors(rows, [(flat, dict(zip(names, map(float, p), strict=True))) for p in at], F.col("_y"))["all"] / max(n_rows, 1)
            return np.where(np.isfinite(left), left, HUGE)

        found.append(point(evolve(losses, lower, upper, seed=seed)))
    return found
