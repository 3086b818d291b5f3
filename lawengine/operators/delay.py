"""Values of a series some time ago, by linear interpolation between neighbours: no range join, one scan forwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ranges

NAN = float("nan")
#: Least and greatest number of ranges of time that all series are cut into, and samples of a range on average between these.
BLOCKS, MOST_BLOCKS, SAMPLES = 32, 4096, 1_000_000


def delay(df: DataFrame, value: str, lag: Column | float, *, time: str, by: tuple[str, ...] = (), name: str = "delayed") -> DataFrame:
    """df with the value at time - lag; NaN outside of the series. by: the columns that tell series apart.

    Samples become segments, each with its successor. Then segments and questions are one sorted stream, in which only the
    last segment before a question is carried on: one scan forwards. All series are cut into the same ranges of time, and each
    range of a series gets the samples next to it, so a series of any length is many tasks' work. Samples and questions
    without a time have no place in a series; of samples of one time the one of the largest value counts last.
    """
    lag = lag if isinstance(lag, Column) else F.lit(float(lag))
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.withColumn("_q", F.col(time).cast("double") - lag)
    named = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    samples = rows.select(*named, F.col(time).cast("double").alias("_t"), F.col(value).cast("double").alias("_x")).filter(F.col("_t").isNotNull() & ~F.isnan("_t"))
    asks = rows.select(*named, F.col("_q").alias("_t"), F.struct("*").alias("_row"))
    found = interpolated(samples, asks, keys)
    return found.select("_row.*", F.coalesce("_between", F.lit(NAN)).alias(name)).drop("_q")


def interpolated(samples: DataFrame, asks: DataFrame, keys: list[str]) -> DataFrame:
    """_row and _between of each question (keys, _t, _row): the value at _t on the line between the samples (keys, _t, _x) next to it,
    null outside of them."""
    kind = asks.schema["_row"].dataType
    at = ranges.cuts(samples, "_t", parts=max(BLOCKS, min(MOST_BLOCKS, samples.count() // SAMPLES)))["_t"]
    samples, asks = _placed(samples, at), _placed(asks, at)
    w = Window.partitionBy(*keys, "_block").orderBy("_t", "_x")
    met = samples.unionByName(_neighbours(samples, asks, keys))
    segments = met.withColumns({"_t1": F.lead("_t").over(w), "_x1": F.lead("_x").over(w)})
    held = F.struct(F.col("_t").alias("t"), F.col("_x").alias("x"), F.col("_t1").alias("t1"), F.col("_x1").alias("x1"))
    stream = segments.select(*keys, "_block", "_t", "_x", F.lit(0).alias("_ask"), held.alias("_segment"), F.lit(None).cast(kind).alias("_row"))
    stream = stream.unionByName(asks.select(*keys, "_block", "_t", F.lit(None).cast("double").alias("_x"), F.lit(1).alias("_ask"), F.lit(None).cast(stream.schema["_segment"].dataType).alias("_segment"), "_row"))
    forwards = Window.partitionBy(*keys, "_block").orderBy("_t", "_ask", "_x").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_segment", ignorenulls=True).over(forwards)
    s = F.col("_last")
    gap = s["t1"] - s["t"]
    between = F.when(F.col("_t") == s["t"], s["x"]).when(gap > 0, s["x"] + (s["x1"] - s["x"]) * (F.col("_t") - s["t"]) / F.when(gap > 0, gap))
    return stream.withColumn("_last", last).filter("_ask = 1").select(*keys, "_t", "_row", between.alias("_between"))


def _placed(df: DataFrame, at: list[float]) -> DataFrame:
    return ranges.place(df, "_t", at, "_block").withColumn("_block", F.floor(F.col("_block") / 2).cast("int"))


def _neighbours(samples: DataFrame, asks: DataFrame, keys: list[str]) -> DataFrame:
    """For each range of a series the last sample before it and the first one after it: a row or two for each range."""
    point = F.struct("_t", "_x")
    ends = samples.select(*keys, "_block", point.alias("p")).unionByName(asks.select(*keys, "_block").distinct().withColumn("p", F.lit(None).cast("struct<_t:double,_x:double>")))
    ends = ends.groupBy(*keys, "_block").agg(F.min("p").alias("first"), F.max("p").alias("last"))
    up, down = Window.partitionBy(*keys).orderBy("_block"), Window.partitionBy(*keys).orderBy(F.desc("_block"))
    before = F.last("last", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("first", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))
    both = ends.withColumns({"_before": before, "_after": after}).select(*keys, "_block", F.explode(F.array("_before", "_after")).alias("p"))
    return both.filter("p is not null").select(*keys, "_block", "p._t", "p._x")


def by_step(df: DataFrame, value: str, steps: int, *, order: str, by: tuple[str, ...] = (), name: str = "delayed") -> DataFrame:
    """The value some rows ago: for series of equal steps."""
    return df.withColumn(name, F.coalesce(F.lag(F.col(value).cast("double"), steps).over(Window.partitionBy(*by).orderBy(order)), F.lit(NAN)))


def attach_delays(df: DataFrame, formula, *, time: str, by: tuple[str, ...] = (), strategy=delay):
    """(frame with a column for each delay of the formula, the formula with those columns in their places)."""
    from ..plans.nodes import Delay, Number, Symbol

    for n, x in enumerate([x for x in formula.iter_preorder() if isinstance(x, Delay)]):
        if not isinstance(x.operand, Symbol):
            df = df.withColumn(f"_of{n}", x.operand.to_column())
        lag = x.lag.value if isinstance(x.lag, Number) else x.lag.to_column()
        df = strategy(df, x.operand.name if isinstance(x.operand, Symbol) else f"_of{n}", lag, time=time, by=by, name=f"_delay{n}")
        formula = formula.replace(x, Symbol(f"_delay{n}"))
    return df, formula
