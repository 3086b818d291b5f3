"""Metrics of predictions, each as an aggregate column; bundles take one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ieee, ranges

NAN = float("nan")


def mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(mse(y, p))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def mape(y: Column, p: Column) -> Column:
    """Over targets other than zero; NaN if there are none."""
    return F.coalesce(F.avg(F.when(y != 0, F.abs(ieee.divide(y - p, y)))), F.lit(NAN))


def r2(y: Column, p: Column) -> Column:
    """1 for an exact fit of a constant, -inf for any other."""
    left, total = F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y)
    return F.when(total > 0, 1 - left / F.when(total > 0, total)).when(left == 0, 1.0).otherwise(float("-inf"))


def _information(y: Column, p: Column, penalty) -> Column:
    left, n = F.sum((y - p) * (y - p)), F.count(y)
    return F.when(left == 0, float("-inf")).otherwise(n * F.ln(F.when(left > 0, left / n)) + penalty(n))


def aic(y: Column, p: Column, k: int) -> Column:
    return _information(y, p, lambda n: F.lit(2.0 * k))


def bic(y: Column, p: Column, k: int) -> Column:
    return _information(y, p, lambda n: F.ln(n) * k)


def pearson(x: Column, y: Column) -> Column:
    """NaN where either is constant, or there are fewer than two rows."""
    vx, vy = F.var_pop(x), F.var_pop(y)
    ok = (F.count(x) > 1) & (vx > 0) & (vy > 0)
    return F.when(ok, F.covar_pop(x, y) / F.when(ok, F.sqrt(vx) * F.sqrt(vy))).otherwise(NAN)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    pairs = df.select(ieee.number(F.col(x)).alias("x"), ieee.number(F.col(y)).alias("y")).filter(ieee.finite(F.col("x")) & ieee.finite(F.col("y")))
    return ranges.ranks(pairs, "x", "y").agg(pearson(F.col("rank_x"), F.col("rank_y")).alias("spearman"), pearson(F.col("x"), F.col("y")).alias("pearson"), F.count("*").alias("n"))


def bundle(y: Column, p: Column, k: int) -> list[Column]:
    """mse, rmse, mae, mape, r2, aic, bic, pearson and n in one pass."""
    return [mse(y, p).alias("mse"), rmse(y, p).alias("rmse"), mae(y, p).alias("mae"), mape(y, p).alias("mape"), r2(y, p).alias("r2"), aic(y, p, k).alias("aic"), bic(y, p, k).alias("bic"), pearson(y, p).alias("pearson"), F.count(y).alias("n")]


def alternative(y: Column, p: Column) -> list[Column]:
    """The other definitions: sMAPE of range 0 to 2 and MAPE, with 1e-6 added below."""
    return [
        r2(y, p).alias("r2"),
        rmse(y, p).alias("rmse"),
        F.avg(2 * F.abs(y - p) / (F.abs(y) + F.abs(p) + 1e-6)).alias("smape"),
        F.avg(F.abs(y - p) / (F.abs(y) + 1e-6)).alias("mape"),
        mae(y, p).alias("mae"),
    ]


def benchmark(y: Column, p: Column) -> list[Column]:
    """Over predictions other than NaN: mse, nmse, r2, mape (denominators of machine epsilon at least), acc_01, n."""
    p = F.when(~F.isnan(p), p)
    y = F.when(p.isNotNull(), y)
    off = F.abs(y - p)
    return [
        mse(y, p).alias("mse"),
        (mse(y, p) / F.when(F.var_pop(y) > 0, F.var_pop(y))).alias("nmse"),
        r2(y, p).alias("r2"),
        F.avg(off / F.greatest(F.abs(y), F.lit(2.220446049250313e-16))).alias("mape"),
        F.avg(F.when(y.isNotNull(), (off <= 0.1 * F.abs(y)).cast("double"))).alias("acc_01"),
        F.count(y).alias("n"),
    ]


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Kendall's tau-b, exactly: n log n work in ranges of the values, and ties from the margins."""
    finite = lambda c: F.when(ieee.finite(F.col(c).cast("double")), F.col(c).cast("double"))
    pairs = df.select(finite(x).alias("x"), finite(y).alias("y")).dropna()
    s = ranges.concordance(pairs)
    n = pairs.agg(F.count("*").alias("n"))
    ties = lambda c: pairs.groupBy(c).agg(F.count("*").alias("m")).agg(F.coalesce(F.sum(F.col("m") * (F.col("m") - 1) / 2), F.lit(0.0)).alias(f"t{c}"))
    all_ = F.col("n") * (F.col("n") - 1) / 2
    bottom = F.sqrt((all_ - F.col("tx")) * (all_ - F.col("ty")))
    return n.crossJoin(ties("x")).crossJoin(ties("y")).select(F.when(bottom > 0, F.lit(s) / F.when(bottom > 0, bottom)).otherwise(NAN).alias("kendall_tau"))  # one row each


def close(p: Column, t: Column, *, atol: float = 1e-8, rtol: float = 1e-6) -> Column:
    """Whether all predictions are within tolerance of the truth; the tolerance scales with the prediction."""
    return F.coalesce(F.bool_and(F.when(ieee.finite(t), ieee.finite(p) & (F.abs(p - t) <= atol + rtol * F.abs(p)))), F.lit(False))


def hit_rates(results: DataFrame, *by: str, r2_column: str = "r2") -> DataFrame:
    """Shares of results whose R2 reaches 0.5, 0.9, 0.99, 0.999, and means without NaN: for each group and overall."""
    c = F.nanvl(F.col(r2_column), F.lit(None).cast("double"))
    rates = [F.avg(F.coalesce((c >= t).cast("double"), F.lit(0.0))).alias("hit_" + str(t).replace(".", "_")) for t in (0.5, 0.9, 0.99, 0.999)]
    return results.rollup(*by).agg(F.count("*").alias("n"), *rates, F.avg(c).alias("mean_r2"))


def first_seen(df: DataFrame, label: str, order: str) -> DataFrame:
    """label, code: the labels of a column numbered from 0 by where each is first seen; order tells all rows apart. Null is a label.

    One row for each label leaves the aggregate, and these are ranked in ranges, so neither rows nor labels are one task's.
    """
    first = df.groupBy(F.col(label).alias("label")).agg(F.min(order).cast("double").alias("first"))
    return ranges.ranks(first, "first").select("label", (F.col("rank_first") - 1).cast("long").alias("code"))


def confusion(df: DataFrame, true: str, predicted: str, *, k: int = 10) -> DataFrame:
    """The k largest confusions by share of their true class."""
    cells = df.groupBy(F.col(true).alias("true"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("true"))
    return cells.withColumn("total", total).filter(F.col("true") != F.col("predicted")).withColumn("rate", F.col("n") / F.col("total")).orderBy(F.desc("rate"), "true", "predicted").limit(k)
