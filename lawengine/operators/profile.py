"""Profiles of numeric variables: summary statistics and histograms, and how a target depends on a feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ieee, metrics, ranges
from ..functions.isotonic import blocks as isotonic_blocks
from ..functions.stored import drop, stored
from ..plans.nodes import Expr
from . import delay

EPS = 2.220446049250313e-16
DEFAULT_NEAR_ZERO = (1e-6, 1e-4)


def _column(v) -> Column:
    return v.to_column() if isinstance(v, Expr) else v if isinstance(v, Column) else ieee.number(F.col(f"`{v}`"))


def long(df: DataFrame, variables: dict[str, object], *keep: str) -> DataFrame:
    """(variable, value) rows of several variables or formulas, in one scan."""
    cells = F.array(*[F.struct(F.lit(n).alias("variable"), _column(v).alias("value")) for n, v in variables.items()])
    return df.select(*keep, F.inline(cells))


def summary(df: DataFrame, variables: dict[str, object], *, near_zero: tuple[float, ...] = ()) -> DataFrame:
    """One row for each variable: counts of kinds of numbers, and moments and exact quartiles of the finite ones.

    All variables' moments come from one wide aggregate, a few variables at a time, and quartiles from order statistics.
    """
    spark, levels = df.sparkSession, tuple(dict.fromkeys([*near_zero, *DEFAULT_NEAR_ZERO]))
    rows = df.select(*[_column(c).alias(f"v{i}") for i, c in enumerate(variables.values())])
    names = list(variables)

    def of(i: int) -> list[Column]:
        x = F.col(f"v{i}")
        v = F.when(ieee.finite(x), x)
        n = F.count(v)
        share = lambda c: c / F.when(n > 0, n)
        return [
            F.count("*").alias("n"),
            n.alias("finite"),
            F.count_if(x == ieee.INF).alias("pos_inf"),
            F.count_if(x == -ieee.INF).alias("neg_inf"),
            F.count_if(F.isnan(x)).alias("nan"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.avg(v).alias("mean"),
            F.var_pop(v).alias("variance"),
            F.stddev_pop(v).alias("std"),
            F.count_if(v > 0).alias("positive"),
            F.count_if(v < 0).alias("negative"),
            F.count_if(v == 0).alias("zero"),
            share(F.count_if(v > 0)).alias("positive_ratio"),
            share(F.count_if(v < 0)).alias("negative_ratio"),
            *[F.count_if(F.abs(v) <= t).alias(f"near_zero_{k}") for k, t in enumerate(levels)],
        ]

    found = rows.agg(F.array(*[F.struct(F.lit(n).alias("variable"), *of(i)) for i, n in enumerate(names)]).alias("all")).select(F.inline("all"))
    q = ranges.quantiles(rows, {n: (F.when(ieee.finite(F.col(f"v{i}")), F.col(f"v{i}")), [0.25, 0.5, 0.75]) for i, n in enumerate(names)})
    quartiles = spark.createDataFrame([(n, *q[n]) for n in names], "variable string, q1 double, median double, q3 double")  # a row for each variable
    order = [c for c in found.columns[: found.columns.index("std") + 1]] + ["q1", "median", "q3"] + found.columns[found.columns.index("std") + 1 :]
    return found.join(F.broadcast(quartiles), "variable").select(*order)


def histogram(df: DataFrame, variables: dict[str, object], *, bins: int = 10) -> DataFrame:
    """(variable, bin, low, high, n): equal widths, the last bin closed; one bin where the range is rounding only."""
    x = long(df, variables).filter(ieee.finite(F.col("value")))
    span = x.groupBy("variable").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))  # one row for each variable
    flat = (F.col("hi") - F.col("lo")) <= 32 * EPS * F.greatest(F.abs("lo"), F.abs("hi"), F.lit(1.0))
    span = span.withColumn("width", F.when(flat, F.lit(None).cast("double")).otherwise((F.col("hi") - F.col("lo")) / bins))
    place = F.when(F.col("width").isNull(), 0).otherwise(F.least(F.floor((F.col("value") - F.col("lo")) / F.col("width")), F.lit(bins - 1)))
    counted = x.join(F.broadcast(span), "variable").withColumn("bin", place.cast("int")).groupBy("variable", "bin", "lo", "hi", "width").agg(F.count("*").alias("n"))
    low = F.when(F.col("width").isNull(), F.col("lo")).otherwise(F.col("lo") + F.col("bin") * F.col("width"))
    high = F.when(F.col("width").isNull(), F.col("hi")).when(F.col("bin") == bins - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * F.col("width"))
    return counted.select("variable", "bin", low.alias("low"), high.alias("high"), "n")


def finite_pairs(df: DataFrame, x, y, *keep: str) -> DataFrame:
    return df.select(*keep, _column(x).alias("x"), _column(y).alias("y")).filter(ieee.finite(F.col("x")) & ieee.finite(F.col("y")))


def edges(pairs: DataFrame, bins: int, method: str = "quantile") -> list[float]:
    """Interior edges of bins of x: of equal counts (equal edges are one), or of equal widths."""
    if method == "quantile":
        at = [i / bins for i in range(bins + 1)]
        q = [v for v in ranges.quantiles(pairs, {"x": (F.col("x"), at)})["x"] if v is not None]
    else:
        lo, hi = pairs.agg(F.min("x"), F.max("x")).first()
        q = [] if lo is None else [lo + (hi - lo) * i / bins for i in range(bins + 1)]
    return sorted(set(q))[1:-1]


def binned(pairs: DataFrame, inner: list[float]) -> DataFrame:
    place = F.size(F.filter(F.array(*map(F.lit, inner)), lambda e: e <= F.col("x"))) if inner else F.lit(0)
    return pairs.withColumn("bin", place)


def conditional(df: DataFrame, x, y, *, bins: int = 10, method: str = "quantile") -> DataFrame:
    """For each bin of x: count, mean, spread and range of y, and the range of x."""
    pairs = finite_pairs(df, x, y)
    return binned(pairs, edges(pairs, bins, method)).groupBy("bin").agg(
        F.count("*").alias("n"), F.avg("y").alias("y_mean"), F.stddev_pop("y").alias("y_std"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.min("x").alias("x_min"), F.max("x").alias("x_max")
    )


def collapse(df: DataFrame, x, y, key: str, *, bins: int = 10, folds: int = 5) -> DataFrame:
    """How far y is a function of x: R2 of predicting each row by its bin's mean over the other folds (key mod folds)."""
    pairs = finite_pairs(df, x, y, key)
    at = binned(pairs, edges(pairs, bins)).withColumn("fold", F.pmod(F.col(key), F.lit(folds)))
    own = at.groupBy("bin", "fold").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("ss"))  # bins x folds rows
    bin_total = own.groupBy("bin").agg(F.sum("n").alias("bn"), F.sum("s").alias("bs"))
    fold_total = own.groupBy("fold").agg(F.sum("n").alias("fn"), F.sum("s").alias("fs"))
    total = own.agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("ss").alias("tss"))
    met = own.join(bin_total, "bin").join(fold_total, "fold").crossJoin(F.broadcast(total))
    other = F.col("bn") - F.col("n")
    rest = F.col("tn") - F.col("fn")
    guess = F.when(other > 0, (F.col("bs") - F.col("s")) / F.when(other > 0, other)).otherwise((F.col("ts") - F.col("fs")) / F.when(rest > 0, rest))
    left = F.sum(F.col("ss") - 2 * guess * F.col("s") + F.col("n") * guess * guess)
    spread = F.max("tss") - F.max("ts") * F.max("ts") / F.max("tn")
    return met.agg(F.max("tn").alias("n"), F.when(spread > 0, 1 - left / F.when(spread > 0, spread)).otherwise(float("nan")).alias("cv_r2"))


def correlations(df: DataFrame, target, features: dict[str, object], *, top: int | None = None) -> DataFrame:
    """Pearson correlation of each feature with the target, over jointly finite rows, in one pass; the `top` strongest, if asked."""
    y = _column(target)
    pairs = long(df.withColumn("_y", y), features, "_y").filter(ieee.finite(F.col("value")) & ieee.finite(F.col("_y")))
    found = pairs.groupBy("variable").agg(F.count("*").alias("n"), metrics.pearson(F.col("value"), F.col("_y")).alias("pearson"))
    return found if top is None else found.filter(~F.isnan("pearson")).orderBy(F.desc(F.abs("pearson")), "variable").limit(top)


def folded(df: DataFrame, x, y, key: str, folds: int, *keep: str) -> DataFrame:
    return finite_pairs(df, x, y, key, *keep).withColumn("fold", F.pmod(F.col(key), F.lit(folds)))


def cross_fitted(df: DataFrame, x, y, key: str, *keep: str, model: str = "bins", bins: int = 10, folds: int = 5, knots: int = 30) -> DataFrame:
    """x, y, fold, prediction (and key, keep): each row predicted by a model of y on x that was fitted to the other folds (key mod folds).

    bins: the mean of the row's bin. isotonic: isotonic regression, rising or falling as the ranks of the other folds' rows do, and
    straight lines between its blocks. spline: a cubic smoothing spline on local B-splines, as smooth as generalised cross-validation
    on the other folds has it.
    """
    rows = folded(df, x, y, key, folds, *keep)
    if model == "bins":
        at = binned(rows, edges(rows, bins))
        own = at.groupBy("bin", "fold").agg(F.count("*").alias("n"), F.sum("y").alias("s"))  # bins x folds rows
        in_bin = own.groupBy("bin").agg(F.sum("n").alias("bn"), F.sum("s").alias("bs"))
        in_fold = own.groupBy("fold").agg(F.sum("n").alias("fn"), F.sum("s").alias("fs"))
        total = own.agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"))
        met = own.join(in_bin, "bin").join(in_fold, "fold").crossJoin(F.broadcast(total))
        other, rest = F.col("bn") - F.col("n"), F.col("tn") - F.col("fn")
        guess = F.when(other > 0, (F.col("bs") - F.col("s")) / F.when(other > 0, other)).otherwise((F.col("ts") - F.col("fs")) / F.when(rest > 0, rest))
        return at.join(F.broadcast(met.select("bin", "fold", guess.alias("prediction"))), ["bin", "fold"]).drop("bin")
    if model == "isotonic":
        return _isotonic(rows, folds)
    if model != "spline":
        raise ValueError(f"no model {model!r}")
    return _spline(rows, folds, knots)


def _isotonic(rows: DataFrame, folds: int) -> DataFrame:
    """All folds' fits at once: one row for each x with every fold's count and sum, from which a fit's own fold is taken away."""
    ranked = ranges.ranks(rows.select("fold", "x", "y"), "x", "y")
    sums = ranked.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate((F.col("rank_x"), F.col("rank_y"), F.col("rank_x") * F.col("rank_y")))]).collect()  # a row for each fold
    whole = [sum(r[c] for r in sums) for c in ("n", "s0", "s1", "s2")]
    rising = [True] * folds
    for r in sums:
        n, a, b, ab = (w - r[c] for w, c in zip(whole, ("n", "s0", "s1", "s2"), strict=True))
        rising[r["fold"]] = not n or ab - a * b / n >= 0
    own = rows.groupBy((F.col("x") + 0.0).alias("x")).agg(*[f(F.when(F.col("fold") == k, v)).alias(f"{c}{k}") for k in range(folds) for c, f, v in (("n", F.count, F.col("y")), ("s", F.sum, F.col("y")))])
    n, s = (F.array(*[F.coalesce(F.col(f"{c}{k}"), F.lit(0)).cast("double") for k in range(folds)]) for c in "ns")
    less = lambda c: F.transform(c, lambda v: F.aggregate(c, F.lit(0.0), lambda t, u: t + u) - v)
    weights = F.transform(less(F.col("n")), lambda v: F.round(v))
    held = own.select("x", n.alias("n"), s.alias("s"))
    cells = stored(held.select("x", "n", weights.alias("w"), less(F.col("s")).alias("s")), "isotonic-cells")
    found = isotonic_blocks(cells.select("x", "w", "s"), rising).withColumnRenamed("fit", "fold")
    ends = F.array(F.struct(F.col("lo").alias("_t"), F.col("value").alias("_x")), F.struct(F.col("hi").alias("_t"), F.col("value").alias("_x")))
    knots = stored(found.select("fold", F.explode(ends).alias("k")).select("fold", "k.*").distinct(), "isotonic-knots")
    sides = knots.groupBy("fold").agg(F.min_by("_x", "_t").alias("_first"), F.max_by("_x", "_t").alias("_last"), F.min("_t").alias("_lo"))  # a row for each fold
    asks = cells.select("x", F.posexplode("n").alias("fold", "rows")).filter("rows > 0").select("fold", F.col("x").alias("_t"), F.struct("x").alias("_row"))
    met = delay.interpolated(knots, asks, ["fold"]).join(F.broadcast(sides), "fold", "left")
    guess = F.coalesce("_between", F.when(F.col("_t") < F.col("_lo"), F.col("_first")).otherwise(F.col("_last")))
    guesses = stored(met.select("fold", F.col("_t").alias("x"), guess.alias("prediction")), "isotonic-fits")
    drop(cells, knots)
    return rows.join(guesses, ["fold", "x"])  # an x of a fold has one prediction


#: Smoothing parameters that are tried, as shares of the ratio of both matrices' traces.
SMOOTHING = [0.0, *[10.0**k for k in range(-9, 7)]]


def _spline(rows: DataFrame, folds: int, knots: int, smoothing: float | None = None) -> DataFrame:
    """A row meets the four cubic B-splines that are not zero there; their products are summed by fold. For each fold the driver solves
    banded systems of the other folds' sums with a penalty on curvature; the one of the least cross-validated error counts."""
    import numpy as np

    shares = [i / (knots + 1) for i in range(knots + 2)]
    q = sorted({v for v in ranges.quantiles(rows, {"x": (F.col("x"), shares)})["x"] if v is not None})
    if len(q) < 4:
        return _mean_of_others(rows)
    pieces, n = _cubics(q), len(q) + 2
    flat = F.array(*[F.lit(float(v)) for v in pieces.ravel()])
    here = F.size(F.filter(F.array(*map(F.lit, q[1:-1])), lambda e: e <= F.col("x")))
    at = rows.withColumn("_j", here)
    left, width = F.array(*map(F.lit, q[:-1])), F.array(*[F.lit(z - a) for a, z in zip(q, q[1:], strict=False)])
    at = at.withColumn("_u", (F.col("x") - F.get(left, "_j")) / F.get(width, "_j"))

    def value(m: int) -> Column:
        c = [F.get(flat, F.col("_j") * 16 + 4 * m + d) for d in range(4)]
        return ((c[0] * F.col("_u") + c[1]) * F.col("_u") + c[2]) * F.col("_u") + c[3]

    at = at.withColumn("_b", F.array(*[value(m) for m in range(4)]))
    b = lambda m: F.get("_b", F.lit(m))
    middle = rows.agg(F.avg("y")).first()[0] or 0.0
    y = F.col("y") - F.lit(middle)
    cells = [F.struct((F.col("_j") + m).alias("i"), (F.col("_j") + k).alias("k"), (b(m) * b(k)).alias("v")) for m in range(4) for k in range(m, 4)]
    cells += [F.struct((F.col("_j") + m).alias("i"), F.lit(-1).alias("k"), (b(m) * y).alias("v")) for m in range(4)]
    cells += [F.struct(F.lit(-1).alias("i"), F.lit(k).alias("k"), v.alias("v")) for k, v in ((-1, F.lit(1.0)), (-2, y * y))]
    sums = at.select("fold", F.explode(F.array(*cells)).alias("c")).groupBy("fold", "c.i", "c.k").agg(F.sum("c.v").alias("v")).collect()  # 5 n rows for each fold
    gram, aim, size, squares = np.zeros((folds, n, n)), np.zeros((folds, n)), np.zeros(folds), np.zeros(folds)
    for r in sums:
        if r["i"] < 0:
            (size if r["k"] == -1 else squares)[r["fold"]] = r["v"]
        elif r["k"] < 0:
            aim[r["fold"], r["i"]] = r["v"]
        else:
            gram[r["fold"], r["i"], r["k"]] = gram[r["fold"], r["k"], r["i"]] = r["v"]
    bend = _curvature(pieces, q)
    fits = [smoothed(gram.sum(0) - gram[k], aim.sum(0) - aim[k], squares.sum() - squares[k], size.sum() - size[k], bend, smoothing) + middle for k in range(folds)]
    held = F.array(*[F.lit(float(v)) for c in fits for v in c])  # splines add up to one, so a constant is the same on all of them
    guess = sum((b(m) * F.get(held, F.col("fold").cast("int") * n + F.col("_j") + m) for m in range(1, 4)), b(0) * F.get(held, F.col("fold").cast("int") * n + F.col("_j")))
    return at.withColumn("prediction", guess).drop("_j", "_u", "_b")


def smoothed(gram, aim, squares: float, n: float, bend, smoothing: float | None = None):
    """The coefficients of least squares plus a penalty; its weight is given, or the one of the least n RSS / (n - trace of the hat)^2."""
    import numpy as np

    unit = np.trace(gram) / max(np.trace(bend), 1e-300)
    best = None
    for share in SMOOTHING if smoothing is None else [smoothing]:
        inverse = np.linalg.pinv(gram + share * unit * bend, rcond=1e-12, hermitian=True)
        c = inverse @ aim
        left, free = max(squares - 2 * c @ aim + c @ gram @ c, 0.0), n - np.trace(inverse @ gram)
        score = n * left / free**2 if free > 0 else np.inf
        if best is None or score < best[0]:
            best = (score, c)
    return best[1]


def _curvature(pieces, knots: list[float]):
    """Integrals of products of second derivatives; on a piece the splines are cubics in the share u of the way."""
    import numpy as np

    n = len(knots) + 2
    out = np.zeros((n, n))
    for j, (lo, hi) in enumerate(zip(knots, knots[1:], strict=False)):
        a, b = 6 * pieces[j, :, 0], 2 * pieces[j, :, 1]  # the second derivative is a u + b, over the width squared
        out[j : j + 4, j : j + 4] += (np.outer(a, a) / 3 + (np.outer(a, b) + np.outer(b, a)) / 2 + np.outer(b, b)) / (hi - lo) ** 3
    return out


def _cubics(knots: list[float]):
    """pieces[j, m]: between knots j and j + 1 the cubic of spline j + m in the share of the way, highest power first."""
    import numpy as np

    t = np.array([knots[0]] * 3 + knots + [knots[-1]] * 3)

    def at(v: np.ndarray) -> np.ndarray:
        b = ((t[:-1] <= v[:, None]) & (v[:, None] < t[1:])).astype(float)
        for d in range(1, 4):
            k = len(t) - d - 1
            left, right = t[d : d + k] - t[:k], t[d + 1 : d + 1 + k] - t[1 : 1 + k]
            b = np.where(left > 0, (v[:, None] - t[:k]) / np.where(left > 0, left, 1), 0) * b[:, :k] + np.where(right > 0, (t[d + 1 : d + 1 + k] - v[:, None]) / np.where(right > 0, right, 1), 0) * b[:, 1 : k + 1]
        return b

    spots = np.array([0.1, 0.35, 0.6, 0.85])
    out = np.empty((len(knots) - 1, 4, 4))
    for j, (lo, hi) in enumerate(zip(knots, knots[1:], strict=False)):
        out[j] = np.linalg.solve(np.vander(spots, 4), at(lo + spots * (hi - lo))[:, j : j + 4]).T
    return out


def _mean_of_others(rows: DataFrame) -> DataFrame:
    own = rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    total = own.agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"))
    met = own.crossJoin(F.broadcast(total)).select("fold", ((F.col("ts") - F.col("s")) / F.when(F.col("tn") > F.col("n"), F.col("tn") - F.col("n"))).alias("prediction"))
    return rows.join(F.broadcast(met), "fold")


def collapse_by_fold(df: DataFrame, x, y, key: str, *, model: str = "bins", bins: int = 10, folds: int = 5) -> DataFrame:
    """mean_r2, std_r2 and folds: R2 of each fold's predictions against the mean of the other folds, over folds that have one."""
    rows = cross_fitted(df, x, y, key, model=model, bins=bins, folds=folds)
    base = _mean_of_others(rows.select("fold", "y", F.col("prediction").alias("p")))
    off = base.groupBy("fold").agg(F.sum((F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))).alias("left"), F.sum((F.col("y") - F.col("prediction")) * (F.col("y") - F.col("prediction"))).alias("all"))
    r2 = F.when(F.col("all") > 0, 1 - F.col("left") / F.when(F.col("all") > 0, F.col("all")))
    return off.agg(F.avg(r2).alias("mean_r2"), F.stddev_pop(r2).alias("std_r2"), F.count(r2).alias("folds"))


def residual_association(df: DataFrame, x, y, others: dict[str, object], key: str, *, model: str = "bins", bins: int = 10, folds: int = 5) -> DataFrame:
    """variable, pearson, spearman, strength of the other variable that goes best with what is left of y after x; one row or none."""
    names = list(others)
    wide = df.withColumns({f"_o{i}": _column(v) for i, v in enumerate(others.values())})
    rows = cross_fitted(wide, x, y, key, *[f"_o{i}" for i in range(len(names))], model=model, bins=bins, folds=folds)
    rows = rows.withColumn("left", F.col("y") - F.col("prediction"))
    found = None
    for i, n in enumerate(names):
        own = metrics.spearman(rows, f"_o{i}", "left").select(F.lit(n).alias("variable"), "pearson", "spearman")
        found = own if found is None else found.union(own)
    strength = F.greatest(F.abs(F.nanvl("pearson", F.lit(0.0))), F.abs(F.nanvl("spearman", F.lit(0.0))))
    return found.withColumn("strength", strength).filter("strength > 0").orderBy(F.desc("strength"), "variable").limit(1)


def pairwise(df: DataFrame, variables: dict[str, object]) -> DataFrame:
    """Pearson correlation of each pair of variables: one wide aggregate."""
    names = sorted(variables)
    wide = df.select(*[_column(variables[n]).alias(f"v{i}") for i, n in enumerate(names)])
    out = []
    for i in range(len(names)):
        for j in range(i + 1, len(names)):
            ok = ieee.finite(F.col(f"v{i}")) & ieee.finite(F.col(f"v{j}"))
            out.append(F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), metrics.pearson(F.when(ok, F.col(f"v{i}")), F.when(ok, F.col(f"v{j}"))).alias("pearson")))
    return wide.agg(F.array(*out).alias("all")).select(F.inline("all"))


def isotonic(df: DataFrame, x, y, *, rising: bool = True) -> DataFrame:
    """lo, hi, value: the blocks of the isotonic regression of y on x."""
    cells = finite_pairs(df, x, y).groupBy((F.col("x") + 0.0).alias("x")).agg(F.array(F.count("*").cast("double")).alias("w"), F.array(F.sum("y")).alias("s"))
    return isotonic_blocks(cells, [rising]).drop("fit")


def residuals(df: DataFrame, y, prediction, *, floor: float = 1e-12) -> DataFrame:
    """Profile of prediction minus target: bias, spread, quantiles of its size, and of its relative size."""
    t, p = _column(y), _column(prediction)
    rows = df.select((p - t).alias("r"), t.alias("t"))
    size, known = F.abs("r"), F.abs("t") > floor
    relative = F.when(known, size / F.when(known, F.abs("t")))
    q = ranges.quantiles(rows, {"size": (size, [0.5, 0.9, 0.99])})["size"]
    own = [F.lit(v).cast("double").alias(n) for n, v in zip(("abs_p50", "abs_p90", "abs_p99"), q, strict=True)]
    return rows.agg(F.count("*").alias("n"), F.avg("r").alias("bias"), F.stddev_pop("r").alias("std"), *own, F.max(size).alias("abs_max"), F.avg(relative).alias("relative_mean"))


def worst(df: DataFrame, y, prediction, *keep: str, k: int = 10) -> DataFrame:
    """The k rows of the largest residuals, ties by the kept columns."""
    t, p = _column(y), _column(prediction)
    return df.select(*keep, t.alias("y"), p.alias("prediction"), (p - t).alias("residual")).orderBy(F.desc(F.abs("residual")), *keep).limit(k)


def positive_domain(df: DataFrame, variables: dict[str, object]) -> DataFrame:
    """For each variable how many values are not positive or not finite: a power law applies where none is."""
    x = F.col("value")
    return long(df, variables).groupBy("variable").agg(F.count_if(ieee.finite(x) & (x <= 0)).alias("not_positive"), F.count_if(~ieee.finite(x)).alias("not_finite"))
