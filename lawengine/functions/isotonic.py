"""Isotonic regression by pooling adjacent violators, in parts: ranges of x are pooled in tasks, and neighbouring stacks of blocks are
merged in a tree. Pooling any neighbours that violate the order leads to the same blocks, so parts may be pooled first.

Nothing reaches the driver. The last merge of a fit holds its blocks, which are as many as the fit has steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .deploy import importable

#: Different x of a task, neighbours that are merged at a time, rounds of pooling all runs before single steps follow.
CELLS, FAN, ROUNDS = 200_000, 16, 40
SCHEMA = "fit int, place int, data binary"


def pooled(w: np.ndarray, s: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks (weight, sum, least and greatest x) in the order of x, with rising means."""
    for _ in range(ROUNDS):
        mean = s / w
        down = mean[:-1] >= mean[1:]
        if not down.any():
            return w, s, lo, hi
        first = np.flatnonzero(np.r_[True, ~down])  # a run of falling means is one block
        w, s, lo, hi = np.add.reduceat(w, first), np.add.reduceat(s, first), lo[first], hi[np.r_[first[1:] - 1, len(hi) - 1]]
    stack: list[list[float]] = []
    for block in zip(w.tolist(), s.tolist(), lo.tolist(), hi.tolist(), strict=True):
        stack.append(list(block))
        while len(stack) > 1 and stack[-2][1] * stack[-1][0] >= stack[-1][1] * stack[-2][0]:
            top = stack.pop()
            below = stack[-1]
            stack[-1] = [below[0] + top[0], below[1] + top[1], below[2], top[3]]
    return tuple(np.array(v) for v in zip(*stack, strict=True))


def joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    parts = [p for p in parts if len(p[0])]
    return pooled(*[np.concatenate(v) for v in zip(*parts, strict=True)]) if parts else (np.empty(0),) * 4


def _row(fit: int, place: int, part: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([fit], pa.int32()), pa.array([place], pa.int32()), pa.array([np.stack(part).astype("<f8").tobytes()], pa.binary())], ["fit", "place", "data"])


def _part(data: bytes) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(data, "<f8").reshape(4, -1))


def blocks(cells: DataFrame, rising: list[bool], *, per_task: int | None = None) -> DataFrame:
    """fit, lo, hi, value: the blocks of several fits over the same x.

    cells: (x, w, s), one row for each x; w and s are arrays with each fit's weight and sum of y there. rising: the direction of each.
    """
    importable(cells.sparkSession)
    per_task = CELLS if per_task is None else per_task
    tasks = min(FAN**3, max(1, -(-cells.count() // per_task)))
    sign = np.where(rising, 1.0, -1.0)
    n = len(rising)

    def first(it):
        place, held, rows = TaskContext.get().partitionId(), [[] for _ in range(n)], 0

        def folded():
            return [[joined(h)] for h in held]

        for b in it:
            x = b.column("x").to_numpy()
            w, s = (b.column(c).flatten().to_numpy().reshape(-1, n) for c in ("w", "s"))
            for k in range(n):
                own = w[:, k] > 0
                held[k].append((w[own, k], s[own, k] * sign[k], x[own], x[own]))
            rows += len(x)
            if rows > CELLS:
                held, rows = folded(), 0
        for k, h in enumerate(held):
            got = joined(h)
            if len(got[0]):
                yield _row(k, place, got)

    def merge(it):
        now, held = None, []
        for b in it:
            for fit, place, data in zip(b.column("fit").to_pylist(), b.column("place").to_pylist(), b.column("data").to_pylist(), strict=True):
                if now != (fit, place // FAN):
                    if held:
                        yield _row(*now, joined(held))
                    now, held = (fit, place // FAN), []
                held.append(_part(data))
        if held:
            yield _row(*now, joined(held))

    def told(it):
        for b in it:
            for fit, data in zip(b.column("fit").to_pylist(), b.column("data").to_pylist(), strict=True):
                w, s, lo, hi = _part(data)
                for at in range(0, len(w), 65_536):
                    own = slice(at, at + 65_536)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w[own]), fit, np.int32)), pa.array(lo[own]), pa.array(hi[own]), pa.array(sign[fit] * s[own] / w[own])], ["fit", "lo", "hi", "value"])

    parts = cells.repartitionByRange(tasks, "x").sortWithinPartitions("x").mapInArrow(first, SCHEMA)
    left = tasks
    while left > 1:
        parts = parts.repartition("fit", F.expr(f"place div {FAN}")).sortWithinPartitions("fit", "place").mapInArrow(merge, SCHEMA)
        left = -(-left // FAN)
    return parts.mapInArrow(told, "fit int, lo double, hi double, value double")
