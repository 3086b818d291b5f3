"""Train and validation splits, and candidate tables with their ranking and Pareto front."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ranges
from ..functions.chance import chance


def chronological(df: DataFrame, time: str, fraction: float = 0.2, *, key: str | None = None) -> DataFrame:
    """The latest rows are validated on."""
    return by_quantile(df, time, fraction, key=key)


def out_of_domain(df: DataFrame, variable: str, fraction: float = 0.2, *, key: str | None = None) -> DataFrame:
    """The rows of the largest values are validated on; ties by key."""
    return by_quantile(df, variable, fraction, key=key)


def by_quantile(df: DataFrame, variable: str, fraction: float, *, key: str | None = None) -> DataFrame:
    """`split`: validation for the round-half-even(n * fraction) rows of the largest values, ties by key.

    The boundary is one value and, where rows tie with it, one key: both are order statistics, so no rows are sorted. Keys
    are numbers that tell the tied rows apart; without a key, rows that tie with the boundary stay together, in `train`.
    """
    n = df.count()
    k = int(round(n * fraction))
    if not 0 < k < n:
        return df.withColumn("split", F.lit("validation" if k else "train"))
    c = F.col(variable).cast("double")
    last = (n - k - 1) / (n - 1) if n > 1 else 0.0  # the last row of train
    bound = ranges.order_statistics(df, {"v": (c, [last])})["v"]["at"][last][0]
    above = df.filter(c > bound).count()
    held = c > bound
    if above < k and key is not None:
        tied = df.filter(c == bound)
        m = tied.count()
        share = (m - (k - above)) / (m - 1) if m > 1 else 0.0
        held = held | ((c == bound) & (F.col(key) >= ranges.order_statistics(tied, {"k": (F.col(key), [share])})["k"]["at"][share][0]))
    return df.withColumn("split", F.when(held, "validation").otherwise("train"))


def random(df: DataFrame, key: str, fraction: float = 0.2, *, seed: int = 0) -> DataFrame:
    """Rows by a digest of their key and a seed: the same at any size and partitioning, the share on average."""
    return df.withColumn("split", F.when(chance(F.col(key), seed) < fraction, "validation").otherwise("train"))


def permuted(df: DataFrame, key: str, fraction: float = 0.2, *, seed: int = 0, limit: int = 10_000_000) -> DataFrame:
    """Exactly as NumPy's RandomState(seed).permutation deals row numbers 0..n-1 in `key`; up to `limit` rows."""
    n = df.count()
    if n > limit:
        raise ValueError(f"more than {limit} rows: use random()")
    import pyarrow as pa

    held = np.random.RandomState(seed).permutation(n)[: int(round(n * fraction))]
    own = df.sparkSession.createDataFrame(pa.table({key: np.sort(held)})).withColumn("_held", F.lit(True))
    return df.join(own, key, "left").withColumn("split", F.when(F.col("_held"), "validation").otherwise("train")).drop("_held")


def folds(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.col(key), F.lit(k)))


def permuted_folds(df: DataFrame, key: str, k: int = 5, *, seed: int = 0, limit: int = 10_000_000) -> DataFrame:
    """`fold`: as NumPy's default_rng(seed).permutation of the row numbers 0..n-1 in `key` is cut into k nearly equal parts."""
    import pyarrow as pa

    n = df.count()
    if n > limit:
        raise ValueError(f"more than {limit} rows: use folds()")
    parts = np.array_split(np.random.default_rng(seed).permutation(n), k)
    own = pa.table({key: np.concatenate(parts), "fold": np.repeat(np.arange(k), [len(p) for p in parts])})
    return df.join(df.sparkSession.createDataFrame(own), key)


#: Rounds of the network that permutes row numbers.
ROUNDS = 4


def _mixed(value: Column, half: int, bits: int, seed: int) -> Column:
    """A Feistel network over numbers of 2 * bits bits: halves are swapped, and one is changed by a digest of the other, which can be undone."""
    left, right = F.shiftright(value, bits), value.bitwiseAND(F.lit(half))
    for k in range(ROUNDS):
        of = F.conv(F.substring(F.md5(F.concat_ws(":", right.cast("string"), F.lit(f"{seed}:{k}"))), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(half))
        left, right = right, left.bitwiseXOR(of)
    return F.shiftleft(left, bits).bitwiseOR(right)


def shuffled(df: DataFrame, number: str, n: int, *, seed: int = 0, name: str = "place") -> DataFrame:
    """df with a column `name`: a permutation of the row numbers 0..n-1 in `number`, at any n, worked out row by row.

    The network permutes 0..2^2b-1, the least power of four that has n numbers; what falls beyond n is permuted again until it
    doesn't (a walk along its cycle), so 0..n-1 are permuted among themselves. On average fewer than four steps are taken, and all
    rows have done in some dozens.
    """
    bits = max(1, -(-max(n - 1, 1).bit_length() // 2))
    half = (1 << bits) - 1
    step = lambda c: _mixed(c, half, bits, seed)
    outside = lambda c: c >= F.lit(n)
    # a bounded fold over steps that stand still once the walk is inside; no walk is longer than what lies outside
    longest = min((half + 1) ** 2 - n, STEPS)
    first = step(F.col(number).cast("long"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(max(longest, 1))), first, lambda at, _: F.when(outside(at), step(at)).otherwise(at))
    out = df.withColumn(name, F.when(outside(first), walked).otherwise(first))
    return out.withColumn(name, F.when(outside(F.col(name)), F.raise_error(F.lit("a walk didn't end"))).otherwise(F.col(name)))


#: Steps of a walk: at most three quarters of the numbers lie outside, so the chance that one of 10^12 rows needs more is below 10^-19.
STEPS = 256


def exact_folds(df: DataFrame, number: str, k: int = 5, *, seed: int = 0, n: int | None = None) -> DataFrame:
    """`fold`: the permuted row numbers cut into k parts, whose sizes differ by one at most, at any size. `number` has 0..n-1."""
    n = df.count() if n is None else n
    size, more = divmod(n, k)
    edge = more * (size + 1)
    place = F.col("_place")
    fold = F.when(place < edge, F.expr(f"_place div {size + 1}")).otherwise(F.lit(more) + F.expr(f"(_place - {edge}) div {max(size, 1)}"))
    return shuffled(df, number, n, seed=seed, name="_place").withColumn("fold", fold.cast("int")).drop("_place")


def exact_split(df: DataFrame, number: str, fraction: float = 0.2, *, seed: int = 0, n: int | None = None) -> DataFrame:
    """`split`: exactly round-half-even(n * fraction) rows are validated on, at any size. `number` has 0..n-1."""
    n = df.count() if n is None else n
    held = int(round(n * fraction))
    return shuffled(df, number, n, seed=seed, name="_place").withColumn("split", F.when(F.col("_place") < held, "validation").otherwise("train")).drop("_place")


def strictly_increasing(df: DataFrame, time: str, *by: str, order: str) -> DataFrame:
    """violations: how many rows, in the order of the column `order` (within by), have a time not later than the row before them."""
    step = F.col(time) - F.lag(time).over(Window.partitionBy(*by).orderBy(order))
    return df.select(step.alias("_step")).agg(F.count_if(F.col("_step") <= 0).alias("violations"))


# candidates: (candidate_id, formula, complexity, metric), in the order of candidate_id


def candidates(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "candidate_id long, formula string, complexity long, metric double")


def ranked(df: DataFrame, *, ascending: bool = True) -> DataFrame:
    metric = F.col("metric") if ascending else -F.col("metric")
    order = [F.isnan(metric), metric, "complexity", "candidate_id"]
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def pareto(df: DataFrame, *, ascending: bool = True) -> DataFrame:
    """In rank order, the candidates that are strictly simpler than all before them."""
    before = F.min("complexity").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    return ranked(df, ascending=ascending).withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("complexity") < F.col("_before"))).drop("_before")


def dominated(df: DataFrame) -> DataFrame:
    """Candidates that another one beats on metric or complexity and equals at least on the other."""
    best = df.groupBy("complexity").agg(F.min("metric").alias("_same"))
    before = F.min("_same").over(Window.orderBy("complexity").rowsBetween(Window.unboundedPreceding, -1))
    met = df.join(best.withColumn("_simpler", before), "complexity")
    beaten = (F.col("_same") < F.col("metric")) | F.coalesce(F.col("_simpler") <= F.col("metric"), F.lit(False))
    return met.filter(beaten).select(*df.columns)


def best_per_complexity(df: DataFrame) -> DataFrame:
    """The best candidate of each complexity that beats all simpler ones."""
    best = df.groupBy("complexity").agg(F.min("metric").alias("metric"), F.min_by("candidate_id", F.struct("metric", "candidate_id")).alias("candidate_id"))
    before = F.min("metric").over(Window.orderBy("complexity").rowsBetween(Window.unboundedPreceding, -1))
    return best.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("metric") < F.col("_before"))).drop("_before")


def search_tree(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Each node with its parent's metric and the gain over it."""
    p = nodes.select(F.col("candidate_id").alias("parent_id"), F.col("metric").alias("parent_metric"))
    return nodes.join(parents, "candidate_id", "left").join(p, "parent_id", "left").withColumn("gain", F.col("parent_metric") - F.col("metric"))
