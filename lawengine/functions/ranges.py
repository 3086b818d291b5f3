"""Orders of whole columns, exactly and without a task that sorts them: order statistics, quantiles, ranks, inversions.

Cut points come from Spark's approximate percentiles. They bound the ranges only: what is counted and sorted inside ranges is
exact, so the result doesn't depend on how good they are. A value that many rows share is a cut point, and so a
range of its own, in which nothing is left to sort.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .deploy import importable
from .stored import drop, stored
from .together import together

PARTS = 256
ACCURACY = 10_000
#: Different values of a bracket that the driver takes; a larger bracket is narrowed first.
FEW = 50_000
SALTS = 64


def order_statistics(df: DataFrame, wanted: dict[str, tuple[Column, list[float]]]) -> dict[str, dict]:
    """For each name its column's n, and at: for each share p the two values next to position p (n - 1), and that position.

    Nulls don't count. Brackets around the positions are narrowed until they hold few different values: one pass for
    the first ones, one that counts, and one that reads what lies inside.
    """
    columns = {n: c for n, (c, _) in wanted.items()}
    rows = df.select(*[c.alias(f"v{i}") for i, c in enumerate(columns.values())])
    v = {n: F.col(f"v{i}") for i, n in enumerate(columns)}
    margin = 2.0 / ACCURACY
    asks = {(n, p): [max(0.0, p - margin), min(1.0, p + margin)] for n, (_, ps) in wanted.items() for p in ps}
    first = rows.agg(
        *[F.count(v[n]).alias(f"n{i}") for i, n in enumerate(columns)],
        *[F.percentile_approx(v[n], [x for p in ps for x in asks[n, p]], ACCURACY).alias(f"q{i}") for i, (n, (_, ps)) in enumerate(wanted.items()) if ps],
    ).first()
    out: dict[str, dict] = {n: {"n": first[f"n{i}"], "at": {}} for i, n in enumerate(columns)}
    open_: dict[tuple, tuple] = {}
    for i, (n, (_, ps)) in enumerate(wanted.items()):
        if out[n]["n"]:
            for k, p in enumerate(ps):
                open_[n, p] = (first[f"q{i}"][2 * k] if p > margin else None, first[f"q{i}"][2 * k + 1] if p < 1 - margin else None)

    def inside(n: str, low, high) -> Column:
        c = v[n].isNotNull()
        c = c if low is None else c & (v[n] >= F.lit(low))
        return c if high is None else c & (v[n] <= F.lit(high))

    def position(key) -> tuple[int, int, float]:
        at = key[1] * (out[key[0]]["n"] - 1)
        return math.floor(at), min(math.floor(at) + 1, out[key[0]]["n"] - 1), at

    ready: dict[tuple, tuple] = {}
    while open_:
        keys = list(open_)
        sums = []
        for i, key in enumerate(keys):
            low, high = open_[key]
            below = F.count_if(v[key[0]] < F.lit(low)) if low is not None else F.lit(0)
            sums += [below.alias(f"b{i}"), F.count_if(inside(key[0], low, high)).alias(f"i{i}"), F.approx_count_distinct(F.when(inside(key[0], low, high), v[key[0]])).alias(f"d{i}")]
        got = rows.agg(*sums).first()
        narrow = []
        for i, key in enumerate(keys):
            below, n_in = got[f"b{i}"] or 0, got[f"i{i}"] or 0
            a, b, _ = position(key)
            low, high = open_[key]
            if a < below or b >= below + n_in:  # the cut points were too narrow
                open_[key] = (None if a < below else low, None if b >= below + n_in else high)
            elif got[f"d{i}"] > FEW and low != high:
                narrow.append((key, (a - below) / n_in, (b + 1 - below) / n_in))
            else:
                ready[key] = (low, high, below)
                del open_[key]
        if narrow:
            cut = rows.agg(*[F.percentile_approx(F.when(inside(k[0], *open_[k]), v[k[0]]), [max(0.0, s - margin), min(1.0, e + margin)], ACCURACY).alias(f"q{i}") for i, (k, s, e) in enumerate(narrow)]).first()
            for i, (k, _, _) in enumerate(narrow):
                if open_[k] == tuple(cut[f"q{i}"]):  # as narrow as it gets: it is read whole
                    ready[k] = (*open_[k], next(got[f"b{j}"] or 0 for j, x in enumerate(keys) if x == k))
                    del open_[k]
                else:
                    open_[k] = tuple(cut[f"q{i}"])
    if not ready:
        return out
    order = list(ready)
    cells = F.array(*[F.struct(F.lit(i).alias("k"), v[k[0]].cast("double").alias("d"), (v[k[0]].cast("long") if dict(rows.dtypes)[f"v{list(columns).index(k[0])}"] in ("bigint", "int") else F.lit(None).cast("long")).alias("l"), inside(k[0], *ready[k][:2]).alias("on")) for i, k in enumerate(order)])
    found: dict[int, list] = {}
    for r in rows.select(F.inline(cells)).filter("on").groupBy("k", "d", "l").agg(F.count("*").alias("n")).collect():
        found.setdefault(r["k"], []).append((r["d"] if r["l"] is None else r["l"], r["n"]))
    for i, key in enumerate(order):
        values = sorted(found[i])
        ends = ready[key][2] + np.cumsum([n for _, n in values])
        a, b, at = position(key)
        out[key[0]]["at"][key[1]] = (values[int(np.searchsorted(ends, a, "right"))][0], values[int(np.searchsorted(ends, b, "right"))][0], at)
    return out


def quantiles(df: DataFrame, wanted: dict[str, tuple[Column, list[float]]]) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation, one list for each name; None where there is no value."""
    got = order_statistics(df, wanted)

    def value(n: str, p: float):
        if p not in got[n]["at"]:
            return None
        a, b, at = got[n]["at"][p]
        return a + (b - a) * (at - math.floor(at))

    return {n: [value(n, p) for p in ps] for n, (_, ps) in wanted.items()}


def cuts(df: DataFrame, *names: str, parts: int = PARTS) -> dict[str, list[float]]:
    """At most `parts` rising cut points for each column."""
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(*[F.percentile_approx(n, shares, ACCURACY).alias(n) for n in names]).first()
    return {n: sorted({float(x) for x in found[n] or []}) for n in names}


def place(df: DataFrame, name: str, at: list[float], to: str) -> DataFrame:
    """A column `to`: 2 k for a value that is cut point k (from 1), 2 k + 1 for one after it, 1 before all."""
    from pyspark.ml.feature import Bucketizer

    if not at:
        return df.withColumn(to, F.lit(1))
    found = Bucketizer(splits=[-math.inf, *at, math.inf], inputCol=name, outputCol=to, handleInvalid="keep").transform(df)
    k = F.col(to).cast("int")
    return found.withColumn(to, 2 * k + F.when((k > 0) & (F.get(F.array(*map(F.lit, at)), k - 1) == F.col(name)), 0).otherwise(1))


def ranks(df: DataFrame, *names: str) -> DataFrame:
    """Average ranks, as `rank_<name>`, of double columns over the whole frame, which has no nulls and no NaN.

    Rows are numbered inside ranges of values; a range of one value has one rank and is dealt out by salt. The frame
    must give the same rows when it is read again.
    """
    df = df.withColumns({n: F.col(n) + 0.0 for n in names})  # minus zero is zero; as keys they are equal, in an order they aren't
    at = cuts(df, *names)
    for name in names:
        df = place(df, name, at[name], f"_at_{name}")
    totals = None
    for k, name in enumerate(names):
        own = df.groupBy(F.lit(k).alias("k"), F.col(f"_at_{name}").alias("at")).agg(F.count("*").alias("n"))
        totals = own if totals is None else totals.union(own)
    sizes: list[dict] = [{} for _ in names]
    for r in totals.collect() if totals is not None else ():  # at most 2 PARTS rows for each column
        sizes[r["k"]][r["at"]] = r["n"]
    for k, name in enumerate(names):
        top = max(sizes[k], default=0) + 1
        n = [sizes[k].get(i, 0) for i in range(top)] or [0]
        before = np.concatenate([[0], np.cumsum(n)[:-1]])
        here, alone = F.col(f"_at_{name}"), F.col(f"_at_{name}") % 2 == 0
        salt = F.when(alone, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0))
        along = Window.partitionBy(here, "_salt").orderBy(name)
        own = F.rank().over(along) + (F.count("*").over(along.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2
        rank = F.get(F.array(*[F.lit(int(x)) for x in before]), here) + F.when(alone, (F.get(F.array(*map(F.lit, n)), here) + 1) / 2).otherwise(own)
        df = df.withColumn("_salt", salt).withColumn(f"rank_{name}", rank.cast("double")).drop("_salt", f"_at_{name}")
    return df


def _inversions(group: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Over all pairs of rows of different groups, in their order: weights of pairs with rising y less those with falling y."""
    order = np.lexsort((y, group))
    group, y, n = group[order], np.unique(y[order], return_inverse=True)[1], n[order].astype(float)
    total, size = 0.0, len(y)
    # groups are merged two by two; in each merge the weights below and above each y on the left are cumulated
    starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1 if size else 0))
    bounds = [*starts.tolist(), size]
    while len(bounds) > 2:
        merged = [0]
        for a, b, c in zip(bounds[0::2], bounds[1::2], bounds[2::2], strict=False):
            left, w = y[a:b], np.concatenate([[0.0], np.cumsum(n[a:b])])
            lower, upper = w[np.searchsorted(left, y[b:c], "left")], w[-1] - w[np.searchsorted(left, y[b:c], "right")]
            total += float(np.sum(n[b:c] * (lower - upper)))
            both = a + np.argsort(y[a:c], kind="stable")
            y[a:c], n[a:c] = y[both], n[both]
            merged.append(c)
        if merged[-1] != size:
            merged.append(size)
        bounds = merged
    return total


#: Points of a subproblem that a task takes whole; ranges of a larger one.
TASK, SPLIT = 500_000, 64


def _grid(m: np.ndarray) -> float:
    """Of weights by (range of x, range of y): pairs in rising order less those in falling order, of different ranges of both."""
    before = np.cumsum(np.cumsum(m, axis=0), axis=1)
    lower, upper = np.zeros_like(m), np.zeros_like(m)
    lower[1:, 1:] = before[:-1, :-1]  # in ranges before both
    upper[1:, :] = np.cumsum(m, axis=0)[:-1, :].sum(axis=1, keepdims=True) - before[:-1, :]
    return float(np.sum(m * (lower - upper)))


def _by_key(it, *names: str):
    """(key, columns) of each key of sorted batches: a key's rows are held, no more."""
    held: list[tuple] = []
    now = None
    for b in it:
        cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("key", *names)]
        ends = [0, *(np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1).tolist(), b.num_rows]
        for lo, hi in zip(ends, ends[1:], strict=False):
            if lo == hi:
                continue
            if now is not None and cols[0][lo] != now:
                yield now, [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            now = cols[0][lo]
            held.append(tuple(c[lo:hi] for c in cols[1:]))
    if held:
        yield now, [np.concatenate(c) for c in zip(*held, strict=True)]


def concordance(df: DataFrame, *, task: int | None = None) -> float:
    """Over all pairs of rows of (x, y): how many agree in order, less how many disagree.

    Equal rows are counted first. Then ranges are split until they fit a task: pairs in different ranges of both x and y are
    settled by the counts of (range of x, range of y); what is left are pairs of one range of x, and pairs of one range of y but
    different ranges of x, which are problems of the same kind, of fewer points each. A range of one value has none left.
    """
    importable(df.sparkSession)
    task = TASK if task is None else task
    points = df.groupBy((F.col("x") + 0.0).alias("a"), (F.col("y") + 0.0).alias("b")).agg(F.count("*").cast("double").alias("n"))
    points, held = stored(points.select(F.lit("").alias("key"), "a", "b", "n"), "pairs"), []
    held.append(points)
    total = 0.0
    while True:
        sizes = points.groupBy("key").agg(F.count("*").alias("points"))
        large = stored(sizes.filter(F.col("points") > task), "pairs-large")  # at most the points over `task`
        held.append(large)
        of_large = large.agg(F.coalesce(F.sum("points"), F.lit(0))).first()[0]
        total += _small(points.join(large, "key", "left_anti"), 1 + 2 * (points.count() - of_large) // task)
        if not large.count():
            break
        cells = stored(_placed(points.join(large.select("key"), "key")), "pairs")
        held.append(cells)
        grid = cells.groupBy("key", "i", "j").agg(F.sum("n").alias("n"))
        total += _grids(grid)
        points = stored(_inside(cells), "pairs")
        held.append(points)
    drop(*held)
    return total


def _inside(cells: DataFrame) -> DataFrame:
    """The points of the problems that are left. Equal ones aren't merged: few are equal, and a hash table of a task's rows grows with them."""
    inner = cells.filter("i % 2 = 1").select(F.concat("key", F.lit("i"), "i").alias("key"), "a", "b", "n")
    across = cells.filter("j % 2 = 1").select(F.concat("key", F.lit("j"), "j").alias("key"), F.col("i").cast("double").alias("a"), "b", "n")
    return inner.unionByName(across)


def _placed(points: DataFrame) -> DataFrame:
    """i and j: the places of a and b among cut points of their own key; even for a value that is a cut point itself."""
    shares = [k / SPLIT for k in range(1, SPLIT)]
    at = points.groupBy("key").agg(*[F.array_sort(F.array_distinct(F.percentile_approx(c, shares, ACCURACY))).alias(f"at_{c}") for c in "ab"])

    def place(c: str) -> Column:
        k = F.size(F.filter(f"at_{c}", lambda e: e <= F.col(c)))
        return 2 * k + F.when((k > 0) & (F.get(f"at_{c}", k - 1) == F.col(c)), 0).otherwise(1)

    return points.join(at, "key").select("key", "a", "b", "n", place("a").alias("i"), place("b").alias("j"))


def _sum_of(parts: DataFrame) -> float:
    return float(parts.agg(F.coalesce(F.sum("s"), F.lit(0.0))).first()[0])


def _small(points: DataFrame, tasks: int) -> float:
    """Subproblems that a task takes whole, one after the other."""

    def run(it):
        for _, (a, b, n) in _by_key(it, "a", "b", "n"):
            yield pa.RecordBatch.from_arrays([pa.array([_inversions(a, b.copy(), n)])], ["s"])

    return _sum_of(together(points, "key", parts=tasks).mapInArrow(run, "s double"))


def _grids(cells: DataFrame) -> float:
    """The grid of each key, at most (2 SPLIT)^2 counts."""

    def run(it):
        for _, (i, j, n) in _by_key(it, "i", "j", "n"):
            m = np.zeros((int(i.max()) + 1, int(j.max()) + 1))
            m[i.astype(int), j.astype(int)] = n
            yield pa.RecordBatch.from_arrays([pa.array([_grid(m)])], ["s"])

    return _sum_of(cells.repartition("key").sortWithinPartitions("key").mapInArrow(run, "s double"))
