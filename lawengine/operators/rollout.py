"""Integration of a formula's rate over observed times: many trajectories step together, each with its own step control.

The rate is compiled once to array operations. A task has its trajectories sorted; it takes bounded chunks of rows, in which the
intervals of all trajectories are worked on side by side, and a trajectory that goes on in the next chunk hands its state on.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ieee
from ..functions.deploy import importable
from ..functions.together import together
from ..plans.dag import compiled
from ..plans.nodes import Expr, Symbol
from ..plans.parse import parse

#: The coefficients of the Dormand-Prince pair of orders five and four.
_C = (0, 1 / 5, 3 / 10, 4 / 5, 8 / 9, 1, 1)
_A = ((), (1 / 5,), (3 / 40, 9 / 40), (44 / 45, -56 / 15, 32 / 9), (19372 / 6561, -25360 / 2187, 64448 / 6561, -212 / 729), (9017 / 3168, -355 / 33, 46732 / 5247, 49 / 176, -5103 / 18656), (35 / 384, 0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84))
_E = (71 / 57600, 0, -71 / 16695, 71 / 1920, -17253 / 339200, 22 / 525, -1 / 40)
#: Rows that a task works on at a time.
ROWS = 65_536


def integrate(rate, t: np.ndarray, drives: dict[str, np.ndarray], first: np.ndarray, last: np.ndarray, start: np.ndarray, pace: np.ndarray, *, time: str, state: str, rtol: float = 1e-8, atol: float = 1e-10, steps: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """(states at all rows, the last step size of each trajectory). Trajectory k has the rows first[k] to last[k], of rising t; start and
    pace are its state and its step size there. drives: other variables at the rows, interpolated between them."""
    out = np.full(len(t), np.nan)
    out[first] = start
    at, x, h, now, taken = first.copy(), start.astype(float), pace.astype(float), t[first].astype(float), np.zeros(len(first), np.int64)
    todo = np.flatnonzero(first < last)
    h[todo] = np.where(h[todo] > 0, h[todo], t[first[todo] + 1] - t[first[todo]])
    with np.errstate(all="ignore"):
        while len(todo):
            k = todo
            i = at[k]
            begin, end = t[i], t[i + 1]
            taken[k] += 1
            step = np.minimum(h[k], end - now[k])
            bad = (taken[k] > steps) | (step <= 1e-14 * np.maximum(np.abs(now[k]), 1e-300))
            if bad.any():
                raise RuntimeError(f"integration stopped at {time} = {now[k][bad][0]}")

            def slope(c: float, y: np.ndarray, i=i, begin=begin, end=end, t0=now[k], step=step) -> np.ndarray:
                s = t0 + c * step
                share = (s - begin) / (end - begin)
                return np.broadcast_to(rate({time: s, state: y, **{n: v[i] + share * (v[i + 1] - v[i]) for n, v in drives.items()}}), y.shape)

            stages: list[np.ndarray] = []
            for c, own in zip(_C, _A, strict=True):
                stages.append(slope(c, x[k] + step * sum((w * s for w, s in zip(own, stages, strict=False)), np.zeros(len(k)))))
            new = x[k] + step * sum(w * s for w, s in zip(_A[-1], stages, strict=False))
            off = np.abs(step * sum(w * s for w, s in zip(_E, stages, strict=True))) / (atol + rtol * np.maximum(np.abs(x[k]), np.abs(new)))
            good = np.isfinite(off) & (off <= 1)
            grow = np.where(off == 0, 5.0, 0.9 * off**-0.2)
            h[k] = step * np.where(good, np.clip(grow, 0.2, 5.0), np.where(np.isfinite(off), np.maximum(0.2, grow), 0.1))
            there = good & (end - (now[k] + step) <= 1e-14 * np.abs(end))
            now[k] = np.where(there, end, np.where(good, now[k] + step, now[k]))
            x[k] = np.where(good, new, x[k])
            ended = k[there]
            at[ended] += 1
            out[at[ended]] = x[ended]
            taken[ended] = 0
            todo = todo[at[todo] < last[todo]]
    return out, h


def _rate(rate: Expr | str, time: str, state: str):
    rate = parse(rate) if isinstance(rate, str) else rate
    return compiled(rate), sorted({x.name for x in rate.iter_preorder() if isinstance(x, Symbol)} - {time, state, "pi", "e"})


def rollout(rate: Expr | str, rows: list[dict], *, time: str = "t", state: str = "x", rtol: float = 1e-8, atol: float = 1e-10, steps: int = 100_000) -> list[float]:
    """One trajectory's states, integrated from its first row over its observed times with steps of controlled error.

    Other variables of the rate are interpolated between the rows. Times must rise; a step that underflows, or more than
    `steps` of them between two rows, is an error.
    """
    f, names = _rate(rate, time, state)
    t = np.array([r[time] for r in rows], dtype=float)
    if len(rows) < 2 or not (np.diff(t) > 0).all():
        raise ValueError("a trajectory has two rows or more, of rising times")
    got, _ = integrate(f, t, {n: np.array([r[n] for r in rows], dtype=float) for n in names}, np.array([0]), np.array([len(t) - 1]), np.array([float(rows[0][state])]), np.zeros(1), time=time, state=state, rtol=rtol, atol=atol, steps=steps)
    return got.tolist()


def rollouts(df: DataFrame, rate: Expr | str, *, by: str, time: str = "t", state: str = "x", rtol: float = 1e-8, atol: float = 1e-10, steps: int = 100_000) -> DataFrame:
    """(by, time, state, rolled) of all trajectories, each integrated from its first state. Trajectories are told apart by `by`; a row
    without a time, or with the time of another row of its trajectory, is an error, and a trajectory of one row is its start."""
    importable(df.sparkSession)
    f, names = _rate(rate, time, state)
    kind = dict(df.dtypes)[by]
    cols = [F.col(by).alias("by"), *[ieee.number(F.col(f"`{n}`")).alias(f"v{i}") for i, n in enumerate([time, state, *names])]]

    def chunks(it):
        held, n = [], 0
        for b in it:
            for lo in range(0, b.num_rows, ROWS):
                held.append(b.slice(lo, ROWS))
                n += held[-1].num_rows
                if n >= ROWS:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(it):
        carried = None  # (key, its last row, state there, step size)
        for c in chunks(it):
            key = c.column("by").combine_chunks().dictionary_encode()
            code = key.indices.fill_null(-1).to_numpy()
            v = np.column_stack([c.column(f"v{i}").to_numpy() for i in range(2 + len(names))])
            name = lambda k: None if k < 0 else key.dictionary[int(k)].as_py()  # noqa: B023, E731
            joins = carried is not None and carried[0] == name(code[0])
            if joins:  # the row that the trajectory has come to stands before its next one
                v, code = np.vstack([carried[1], v]), np.r_[code[0], code]
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            last = np.r_[first[1:] - 1, len(code) - 1]
            rising = (np.diff(v[:, 0]) > 0) | (code[1:] != code[:-1])
            if not rising.all() or np.isnan(v[:, 0]).any():
                raise ValueError("a trajectory has rising times")
            start, pace = v[first, 1].copy(), np.zeros(len(first))
            if joins:
                start[0], pace[0] = carried[2], carried[3]
            got, h = integrate(f, v[:, 0], {n: v[:, 2 + i] for i, n in enumerate(names)}, first, last, start, pace, time=time, state=state, rtol=rtol, atol=atol, steps=steps)
            carried = (name(code[-1]), v[-1:], got[-1], h[-1])
            own = slice(1 if joins else 0, None)
            yield pa.RecordBatch.from_arrays([c.column("by").combine_chunks(), pa.array(v[own, 0]), pa.array(v[own, 1]), pa.array(got[own])], [by, time, state, "rolled"])

    rows = together(df.select(*cols), "by", order=("v0",))
    return rows.mapInArrow(run, f"`{by}` {kind}, `{time}` double, `{state}` double, rolled double")


def rollout_rmse(df: DataFrame, rate: Expr | str, *, by: str, time: str = "t", state: str = "x") -> DataFrame:
    """(by, n, rmse) of integrating each trajectory from its first state."""
    off = F.col("rolled") - F.col(f"`{state}`")
    return rollouts(df, rate, by=by, time=time, state=state).groupBy(by).agg(F.count("*").alias("n"), F.sqrt(F.avg(off * off)).alias("rmse"))


def scalar(e: Expr, at: dict[str, float]) -> float:
    """One value, on the driver."""
    v = compiled(e)({n: np.array([x], dtype=float) for n, x in at.items()})
    return float(np.ravel(v)[0]) if np.size(v) else math.nan
