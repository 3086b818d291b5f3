"""Tall-skinny QR: the triangular factor of very many rows of few columns, made in tasks and merged in a tree.

Each Arrow batch is stacked under the factor of the rows before it and reduced again, so a task holds one batch and one factor. Tasks
hand on their factors, which are merged by place, and again by fewer places, until a handful reaches the driver. A column
of ones stands first, so the rows below the first one are the factor of the centred columns, and products of columns, which would
square the condition number, are never made. Each task takes the means of its first rows off; when two
factors meet, only the first row of one changes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .deploy import importable

#: Places that factors are merged to, level by level.
LEVELS = (64, 8)
#: Share of the largest singular value (of columns of one spread) below which a direction counts as none.
NOTHING = 1e-12


@dataclass
class Factor:
    """n rows; the triangular r of the columns (1, each name less its shift), the target last."""

    names: list[str]
    n: int
    shift: np.ndarray
    r: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.shift + self.r[0, 1:] / self.r[0, 0]

    @property
    def scale(self) -> np.ndarray:
        """Population standard deviations; 1 for a constant."""
        s = np.sqrt((self.r[1:, 1:] ** 2).sum(0) / self.n)
        return np.where(s > 0, s, 1.0)

    def columns(self, *, centred: bool) -> np.ndarray:
        return self.r[1:, 1:] if centred else self.r[:, 1:] + np.outer(self.r[:, 0], self.shift)

    def rms(self, i: int) -> float:
        return float(np.sqrt((self.columns(centred=False)[:, i] ** 2).sum() / self.n))

    def solve(self, use: list[int] | None = None, ridge: float = 0.0, intercept: bool = True) -> tuple[np.ndarray, float]:
        """(coefficients of the columns used, then the intercept), and the sum of squares left. ridge: for columns of spread one."""
        k = len(self.names) - 1
        use = list(range(k)) if use is None else use
        m, scale, mean = self.columns(centred=intercept), self.scale, self.mean
        a, b = m[:, use] / scale[use], m[:, k] / scale[k]
        c = np.empty(0)
        if use:
            more = np.sqrt(ridge) * np.eye(len(use)) if ridge else np.empty((0, len(use)))
            c = np.linalg.lstsq(np.vstack([a, more]), np.append(b, np.zeros(len(more))), rcond=NOTHING)[0]
        left = float(((b - a @ c) ** 2).sum()) * scale[k] ** 2
        c = c * scale[k] / scale[use]
        return np.append(c, mean[k] - c @ mean[use] if intercept else 0.0), left

    def inverse(self, use: list[int], intercept: bool = True) -> np.ndarray:
        """The inverse of the products of the columns used, in the columns' own units."""
        own = self.scale[use]
        p = np.linalg.pinv(self.columns(centred=intercept)[:, use] / own, rcond=NOTHING)
        return (p @ p.T) / np.outer(own, own)

    @property
    def rank(self) -> int:
        """Of the centred columns without the target."""
        k = len(self.names) - 1
        s = np.linalg.svd(self.r[1:, 1 : k + 1] / self.scale[:k], compute_uv=False) if k else np.empty(0)
        varies = ((self.r[1:, 1 : k + 1] ** 2).sum(0) / self.n > (NOTHING * np.maximum(np.abs(self.mean[:k]), 1e-300)) ** 2).sum()
        return int(min(varies, (s > NOTHING * s[0]).sum())) if k else 0


def reduced(rows: np.ndarray) -> np.ndarray:
    """The triangular factor, as many rows as columns."""
    r = np.linalg.qr(rows, mode="r")
    return r if len(r) == rows.shape[1] else np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


def joined(a: tuple, b: tuple) -> tuple:
    """Of two (n, shift, r) the one of all rows, with the first one's shift."""
    r = b[2].copy()
    r[:, 1:] += r[:, :1] * (b[1] - a[1])
    return a[0] + b[0], a[1], reduced(np.vstack([a[2], r]))


def merged(factors: list[Factor]) -> Factor:
    got = (factors[0].n, factors[0].shift, factors[0].r)
    for f in factors[1:]:
        got = joined(got, (f.n, f.shift, f.r))
    return Factor(factors[0].names, *got)


def _bytes(part: tuple) -> bytes:
    return np.concatenate([part[1], part[2].ravel()]).astype("<f8").tobytes()


def _part(n: int, data: bytes, width: int) -> tuple:
    v = np.frombuffer(data, "<f8")
    return n, v[:width].copy(), v[width:].reshape(width + 1, width + 1).copy()


def factor(df: DataFrame, columns: dict[str, Column], *, by: str | Column | None = None) -> Factor | dict:
    """The factor of columns, the last being the target, over rows where all are finite; one scan.

    by: a column of few values; then a factor for each of its values.
    """
    importable(df.sparkSession)
    names, width = list(columns), len(columns)
    key = F.lit(0) if by is None else F.col(by) if isinstance(by, str) else by
    rows = df.select(key.alias("key"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns.values())])
    kind = dict(rows.dtypes)["key"]
    schema = f"key {kind}, place int, n long, data binary"

    def batch(held: dict, types: dict):
        keys = list(held)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], types["key"]), pa.array([k[1] for k in keys], pa.int32()), pa.array([held[k][0] for k in keys], pa.int64()), pa.array([_bytes(held[k]) for k in keys], pa.binary())], ["key", "place", "n", "data"])

    def first(it):
        place, held, types = TaskContext.get().partitionId(), {}, {}
        for b in it:
            types["key"] = b.schema.field("key").type
            a = np.column_stack([b.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(width)]).astype(float)
            ok = np.isfinite(a).all(1)
            coded = b.column("key").dictionary_encode()
            code = coded.indices.fill_null(-1).to_numpy()
            for c in np.unique(code[ok]):
                own = a[ok & (code == c)]
                k = (None if c < 0 else coded.dictionary[int(c)].as_py(), place)
                shift = held[k][1] if k in held else own.mean(0)
                with_ones = np.column_stack([np.ones(len(own)), own - shift])
                held[k] = (held[k][0] + len(own), shift, reduced(np.vstack([held[k][2], with_ones]))) if k in held else (len(own), shift, reduced(with_ones))
        if held:
            yield batch(held, types)

    def meet(it):
        now, got, types = None, None, {}
        for b in it:
            types["key"] = b.schema.field("key").type
            for r in zip(b.column("key").to_pylist(), b.column("place").to_pylist(), b.column("n").to_pylist(), b.column("data").to_pylist(), strict=True):
                part = _part(r[2], r[3], width)
                if now == r[:2]:
                    got = joined(got, part)
                    continue
                if now is not None:
                    yield batch({now: got}, types)
                now, got = r[:2], part
        if now is not None:
            yield batch({now: got}, types)

    parts = rows.mapInArrow(first, schema)
    for n in LEVELS:
        parts = parts.withColumn("place", F.pmod("place", F.lit(n))).repartition("key", "place").sortWithinPartitions("key", "place").mapInArrow(meet, schema)
    found: dict = {}
    for r in parts.orderBy("place").collect():  # a handful for each key
        part = _part(r["n"], bytes(r["data"]), width)
        found[r["key"]] = joined(found[r["key"]], part) if r["key"] in found else part
    if not found:
        raise ValueError("no row is finite in all columns")
    out = {k: Factor(names, *p) for k, p in found.items()}
    return out if by is not None else out[0]
