"""Least squares with parameters of categories: normal equations of the shape of an arrow.

A category's own parameters meet the shared ones and no other category's. So each category's products are summed by a
grouped aggregate, its parameters are eliminated where its row lies (Schur complement), and only what is left for the
shared ones, a small system, reaches the driver; the categories' steps follow from its solution by their own rows again. One
scan of the data a step, whatever the number of categories. Up to `LOCAL` categories their rows are bounded and taken to
the driver; more of them stay in stored tables. Both ways run the same arithmetic.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tree
from ..functions.deploy import importable
from ..functions.stored import drop, stored

LOCAL = 4096
HUGE = 1e100
#: A step of this share that doesn't lower the loss is the last: what is left is rounding.
SMALL = 1e-10


@dataclass
class Shape:
    """s shared and p own parameters; how a row of sums is laid out."""

    s: int
    p: int

    def columns(self, r: Column, shared: list[Column], own: list[Column]) -> list[Column]:
        """Products of residual and slopes: r r, shared r, own r, shared shared, shared own, own own."""
        return [r * r, *[j * r for j in shared], *[j * r for j in own], *[a * b for a in shared for b in shared], *[a * b for a in shared for b in own], *[a * b for a in own for b in own]]

    def parts(self, sums: np.ndarray) -> tuple[np.ndarray, ...]:
        """(m, width) sums as loss, b_s, b_p, A_ss, B_sp, C_pp of each of m categories."""
        s, p, m = self.s, self.p, len(sums)
        sums = np.nan_to_num(sums, nan=0.0, posinf=HUGE, neginf=-HUGE)
        ends = np.cumsum([1, s, p, s * s, s * p, p * p])
        loss, bs, bp, a, b, c = np.split(sums, ends[:-1], axis=1)
        return loss[:, 0], bs, bp, a.reshape(m, s, s), b.reshape(m, s, p), c.reshape(m, p, p)


def damped(c: np.ndarray, damp: float) -> np.ndarray:
    out = c.copy()
    at = np.arange(c.shape[-1])
    out[..., at, at] += damp * np.maximum(c[..., at, at], 1e-12)
    return out


def eliminated(shape: Shape, sums: np.ndarray, damp: float) -> np.ndarray:
    """Over categories: A_ss, b_s, and what elimination takes from both, as one flat array."""
    _, bs, bp, a, b, c = shape.parts(sums)
    x = np.linalg.solve(damped(c, damp), np.concatenate([b.transpose(0, 2, 1), bp[:, :, None]], axis=2))
    less = np.einsum("msp,mpt->st", b, x)
    return np.concatenate([a.sum(0).ravel(), bs.sum(0), less[:, : shape.s].ravel(), less[:, shape.s]])


def shared_step(shape: Shape, flat: np.ndarray, damp: float) -> np.ndarray:
    s = shape.s
    if not s:
        return np.empty(0)
    a, b, less_a, less_b = np.split(flat, np.cumsum([s * s, s, s * s]))
    return np.linalg.lstsq(damped(a.reshape(s, s), damp) - less_a.reshape(s, s), b - less_b, rcond=None)[0]


def own_steps(shape: Shape, sums: np.ndarray, step: np.ndarray, damp: float) -> np.ndarray:
    """(m, p): the step of each category's parameters, once the shared ones' is known."""
    _, _, bp, _, b, c = shape.parts(sums)
    return np.linalg.solve(damped(c, damp), (bp - np.einsum("msp,s->mp", b, step))[:, :, None])[:, :, 0]


class _Few:
    """Parameters of a bounded number of categories, on the driver."""

    def __init__(self, spark, shape: Shape, kind: str, labels: list, values: np.ndarray):
        self.spark, self.shape, self.kind, self.labels, self.values = spark, shape, kind, labels, values

    def table(self) -> DataFrame:
        rows = [(k, *map(float, v)) for k, v in zip(self.labels, self.values, strict=True)]
        return F.broadcast(self.spark.createDataFrame(rows, f"_c {self.kind}, " + ", ".join(f"_g{i} double" for i in range(self.shape.p))))

    def look(self, sums: DataFrame) -> tuple[float, int]:
        place = {k: i for i, k in enumerate(self.labels)}
        width = 1 + self.shape.s + self.shape.p + (self.shape.s + self.shape.p) ** 2 - self.shape.s * self.shape.p
        self.sums, n = np.zeros((len(self.labels), width)), 0
        for r in sums.collect():  # a row for each of few categories
            self.sums[place[r["_c"]]] = r["sums"]
            n += r["n"]
        return float(self.sums[:, 0].sum()), n

    def eliminated(self, damp: float) -> np.ndarray:
        return eliminated(self.shape, self.sums, damp)

    def moved(self, step: np.ndarray, damp: float, low: np.ndarray, high: np.ndarray) -> tuple[_Few, float]:
        new = np.clip(self.values + own_steps(self.shape, self.sums, step, damp), low, high)
        return _Few(self.spark, self.shape, self.kind, self.labels, new), float((np.abs(new - self.values) / (1 + np.abs(self.values))).max(initial=0.0))

    def forget(self) -> None:
        pass


class _Many:
    """Parameters of any number of categories, in a stored table (_c, _g0 ...)."""

    def __init__(self, shape: Shape, values: DataFrame):
        self.shape, self.values, self.met = shape, values, None

    def table(self) -> DataFrame:
        return self.values

    def look(self, sums: DataFrame) -> tuple[float, int]:
        self.met = stored(sums.join(self.values, "_c"), "category-sums")
        r = self.met.agg(F.sum(F.get("sums", F.lit(0))).alias("loss"), F.sum("n").alias("n")).first()
        return (r["loss"], r["n"]) if r["n"] else (math.nan, 0)

    def eliminated(self, damp: float) -> np.ndarray:
        shape = self.shape

        def run(it):
            out = None
            for b in it:
                if b.num_rows:
                    own = eliminated(shape, _sums(b), damp)
                    out = own if out is None else out + own
            return out

        return tree.gathered(self.met.select("sums"), run)

    def moved(self, step: np.ndarray, damp: float, low: np.ndarray, high: np.ndarray) -> tuple[_Many, float]:
        shape, names = self.shape, [f"_g{i}" for i in range(self.shape.p)]
        kind = dict(self.met.dtypes)["_c"]

        def run(it):
            for b in it:
                if b.num_rows:
                    old = np.column_stack([b.column(n).to_numpy() for n in names])
                    new = np.clip(old + own_steps(shape, _sums(b), step, damp), low, high)
                    yield pa.RecordBatch.from_arrays([b.column("_c"), *[pa.array(np.ascontiguousarray(v)) for v in new.T], pa.array((np.abs(new - old) / (1 + np.abs(old))).max(1))], ["_c", *names, "_moved"])

        rows = stored(self.met.select("_c", *names, "sums").mapInArrow(run, f"_c {kind}, " + "".join(f"{n} double, " for n in names) + "_moved double"), "category-parameters")
        values = rows.drop("_moved")
        values._stored_at = rows._stored_at
        return _Many(shape, values), rows.agg(F.max("_moved")).first()[0] or 0.0

    def forget(self) -> None:
        drop(self.values, *([self.met] if self.met is not None else []))


def _sums(b: pa.RecordBatch) -> np.ndarray:
    return b.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


@dataclass
class Found:
    shared: np.ndarray
    #: {category: values}, or None where there are many.
    own: dict | None
    #: (_c, _g0 ...) of all categories.
    table: DataFrame
    loss: float
    message: str
    n_iter: int


def minimise(data: DataFrame, residual, slopes, start: np.ndarray, own_start: Column | list[Column], p: int, *, low: tuple, high: tuple, rounds: int = 200, tolerance: float = 1e-14, local: int | None = None) -> Found:
    """Levenberg-Marquardt over data with a column _c, the category; rows without one are left out.

    residual(shared, own): a column, from numbers and the columns of a category's parameters; slopes(shared, own): the
    columns of its slopes by the shared and by the own parameters. low, high: bounds of the shared and of the own ones. A
    start of a category's parameters is a column of its category.
    """
    spark, local = data.sparkSession, LOCAL if local is None else local
    importable(spark)
    data = data.filter("_c is not null")
    shape, names = Shape(len(start), p), [f"_g{i}" for i in range(p)]
    categories = data.select("_c").distinct()
    begin = categories.select("_c", *[F.coalesce(c.cast("double"), F.lit(1.0)).alias(n) for c, n in zip(own_start, names, strict=True)])
    some = begin.limit(local + 1).collect()
    clip = lambda x, k: np.clip(x, np.asarray(low[k], dtype=float), np.asarray(high[k], dtype=float))
    if len(some) <= local:
        some = sorted(some, key=lambda r: str(r["_c"]))
        state = _Few(spark, shape, dict(data.dtypes)["_c"], [r["_c"] for r in some], clip(np.array([[r[n] for n in names] for r in some], dtype=float).reshape(-1, p), 1))
    else:
        held = begin.select("_c", *[F.greatest(F.least(F.col(n), F.lit(float(h))), F.lit(float(b))).alias(n) for n, b, h in zip(names, low[1], high[1], strict=True)])
        state = _Many(shape, stored(held, "category-parameters"))
    own = [F.col(n) for n in names]

    def look(shared: np.ndarray, at) -> float:
        r, (js, jp) = residual(shared, own), slopes(shared, own)
        cols = {f"_v{i}": c for i, c in enumerate([r, *js, *jp])}
        met = data.join(at.table(), "_c").select("_c", *[c.alias(n) for n, c in cols.items()])
        v = [F.col(n) for n in cols]
        products = shape.columns(v[0], v[1 : 1 + shape.s], v[1 + shape.s :])
        loss, n = at.look(met.groupBy("_c").agg(F.count("*").alias("n"), F.array(*[F.sum(c) for c in products]).alias("sums")))
        return loss / n if n and math.isfinite(loss) else HUGE

    theta = clip(np.asarray(start, dtype=float), 0)
    loss, damp, done, message = look(theta, state), 1e-3, 0, "no more rounds"
    for done in range(1, rounds + 1):
        if loss >= HUGE:
            message = "not finite at the start"
            break
        step = clip(theta + shared_step(shape, state.eliminated(damp), damp), 0) - theta
        new, moved = state.moved(step, damp, np.asarray(low[1], dtype=float), np.asarray(high[1], dtype=float))
        got = look(theta + step, new)
        if got < loss:
            gain, old = loss - got, state
            theta, state, loss, damp = theta + step, new, got, max(damp / 10, 1e-15)
            old.forget()
            if loss == 0 or gain <= tolerance * loss or max(moved, np.abs(step / (1 + np.abs(theta))).max(initial=0.0)) <= 1e-15:
                message = "converged"
                break
        else:
            new.forget()
            damp *= 10
            if damp > 1e12 or max(moved, np.abs(step / (1 + np.abs(theta))).max(initial=0.0)) <= SMALL:
                message = "converged"
                break
    if isinstance(state, _Few):
        return Found(theta, dict(zip(state.labels, state.values.tolist(), strict=True)), state.table(), loss, message, done)
    drop(state.met)
    return Found(theta, None, state.values, loss, message, done)
