import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lawengine.functions import isotonic, metrics, ranges, triangular
from lawengine.operators import arrow, constants, delay, fits, noise, nonlinear, profile, rollout, split, text
from lawengine.plans.dag import compiled
from lawengine.plans.indexed import Graph
from lawengine.plans.parse import parse
from lawengine.sources import dataset


def frame(spark, **cols):
    names = list(cols)
    return spark.createDataFrame(list(zip(*[[float(v) if isinstance(v, (int, float, np.floating)) else v for v in c] for c in cols.values()], strict=True)), ", ".join(f"{n} {'string' if isinstance(cols[n][0], str) else 'double'}" for n in names))


def column(df, e):
    return [r[0] for r in df.select((parse(e) if isinstance(e, str) else e).to_column()).collect()]


@pytest.mark.parametrize("text,plain", [("log(v)", np.log), ("v / w", None), ("sqrt(v)", np.sqrt), ("log10(v - w)", None), ("1 / v ** 2", lambda v: 1 / v**2), ("max(v / w, 3)", None), ("exp(900 * v)", lambda v: np.exp(900 * v)), ("arcsin(v)", np.arcsin), ("v ** 0.5 - w", None)])
def test_scalars_follow_ieee(spark, text, plain):
    v, w = np.array([-3.0, 0.0, 0.25, 9.0]), np.array([0.0, 0.0, -5.0, 2.0])
    with np.errstate(all="ignore"):
        want = plain(v) if plain else {"v / w": v / w, "log10(v - w)": np.log10(v - w), "max(v / w, 3)": np.maximum(v / w, 3), "v ** 0.5 - w": v**0.5 - w}[text]
    assert np.allclose(column(frame(spark, v=v, w=w), text), want, equal_nan=True, rtol=1e-14)


def test_arithmetic(spark):
    rng = np.random.default_rng(31)
    v, w = rng.normal(size=20), rng.uniform(1, 2, 20)
    assert np.allclose(column(frame(spark, v=v, w=w), "3 * cos(v) / w - (v - w) * v + tanh(w) ** 2"), 3 * np.cos(v) / w - (v - w) * v + np.tanh(w) ** 2, rtol=1e-13)


def test_parameters(spark):
    df = frame(spark, v=[3, 5, -1], kind=["u", "w", "u"])
    assert column(df, "grouped_param(kind, name='k', value={'u': 0.5, 'w': -4.0}) - v") == [-2.5, -9, 1.5]
    assert column(df, "grouped_param(kind, name='k', value={'w': 2.0}, default=10.0) * v") == [30, 10, -10]
    assert column(df, "v / param('k', value=0.25)") == [12, 20, -4]
    with pytest.raises(ValueError, match="rate"):
        column(df, "param('rate') + v")
    with pytest.raises(Exception, match="no value"):
        column(df, "v * grouped_param(kind, name='k', value={'u': 1.0})")


def test_statistics(spark):
    v = [0.5, 7.25, -3.0, 2.0, 11.5]
    r = profile.summary(frame(spark, v=v), {"v": "v"}).first()
    assert (r["mean"], r["variance"]) == pytest.approx((np.mean(v), np.var(v)))
    assert (r["q1"], r["median"], r["q3"]) == pytest.approx(tuple(np.quantile(v, [0.25, 0.5, 0.75])))
    odd = spark.createDataFrame([(x,) for x in (math.nan, 4.0, math.inf, math.nan, -math.inf, -2.0, 0.0)], "v double")
    r = profile.summary(odd, {"v": "v"}).first()
    assert (r["n"], r["finite"], r["pos_inf"], r["neg_inf"], r["nan"], r["zero"]) == (7, 3, 1, 1, 2, 1)
    assert profile.summary(odd.filter("isnan(v)"), {"v": "v"}).first()["median"] is None


def test_histogram(spark):
    got = profile.histogram(frame(spark, v=[-2, -1.5, 0.25, 5.9, 6]), {"v": "v"}, bins=4).orderBy("bin").collect()
    assert [(r["bin"], r["low"], r["high"], r["n"]) for r in got] == [(0, -2, 0, 2), (1, 0, 2, 1), (3, 4, 6, 2)]
    flat = frame(spark, a=np.linspace(2, 3, 20), b=7 / np.linspace(2, 3, 20))
    assert profile.histogram(flat, {"v": parse("a * b")}).count() == 1


def test_relationship(spark):
    rng = np.random.default_rng(11)
    x = rng.uniform(-3, 3, 400)
    df = frame(spark, x=x, y=x**3 - 2 * x).withColumn("id", F.monotonically_increasing_id())
    assert profile.conditional(df, "x", "y", bins=8).agg(F.sum("n")).first()[0] == 400
    for model, least in (("bins", 0.9), ("spline", 0.999), ("isotonic", 0.5)):
        assert profile.collapse_by_fold(df, "x", "y", "id", model=model).first()["mean_r2"] > least
    halves = frame(spark, x=[3] * 50 + list(range(10, 60)), y=[1] * 100)  # half of the rows have one value: equal cut points are one
    assert [r["n"] for r in profile.conditional(halves, "x", "y", bins=4).orderBy("bin").collect()] == [50, 25, 25]


def plain_cross_fit(x, y, fold, fit):
    out = np.empty(len(x))
    for k in np.unique(fold):
        out[fold == k] = fit(x[fold != k], y[fold != k], x[fold == k])
    return out


def test_cross_fits_equal_plain_ones(spark):
    rng = np.random.default_rng(12)
    n = 300
    x, z = rng.uniform(0, 10, n), rng.uniform(0, 1, n)
    y = np.sin(x) * 3 + x + 2 * z
    df = frame(spark, x=x, y=y, z=z).withColumn("id", F.monotonically_increasing_id())
    rows = df.toPandas()
    fold = (rows["id"] % 5).to_numpy()
    got = profile.cross_fitted(df, "x", "y", "id", model="isotonic").toPandas().sort_values("id")

    def pooled(a, b, at):
        order = np.argsort(a, kind="stable")
        blocks = []
        for xi, yi in zip(a[order], b[order], strict=True):
            blocks.append([yi, 1, xi, xi])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                last = blocks.pop()
                m = blocks[-1]
                blocks[-1] = [(m[0] * m[1] + last[0] * last[1]) / (m[1] + last[1]), m[1] + last[1], m[2], last[3]]
        knots, values = [p for m in blocks for p in (m[2], m[3])], [m[0] for m in blocks for _ in range(2)]
        return np.interp(at, knots, values)

    want = plain_cross_fit(x, y, fold, pooled)
    assert np.allclose(got["prediction"].to_numpy(), want[np.argsort(rows["id"].to_numpy())], atol=1e-9)
    knots = np.quantile(x, np.linspace(0, 1, 32))

    def spline(a, b, at):
        """The same cubics as truncated powers, the penalty by Gauss's rule on each piece, the weight by generalised cross-validation."""
        lo, hi = knots[0], knots[-1]
        z = (knots - lo) / (hi - lo)
        power = lambda v, d: np.stack([*[np.polyval(np.polyder(np.eye(4)[3 - p], d), v) if p >= d else np.zeros_like(v) for p in range(4)], *[np.maximum(v - k, 0) ** (3 - d) * math.factorial(3) / math.factorial(3 - d) for k in z[1:-1]]], axis=1)
        nodes, weights = np.polynomial.legendre.leggauss(4)
        bend = sum((w * (q - p) / 2) * np.outer(r := power(np.array([(p + q) / 2 + (q - p) / 2 * u]), 2)[0], r) for p, q in zip(z, z[1:], strict=False) for u, w in zip(nodes, weights, strict=True)) / (hi - lo) ** 3
        own = power((a - lo) / (hi - lo), 0)
        local = profile._cubics(knots.tolist())
        unit = np.zeros(len(knots) + 2)
        j = np.clip(np.searchsorted(knots, a, "right") - 1, 0, len(knots) - 2)
        u = (a - knots[j]) / (knots[j + 1] - knots[j])
        size = sum((np.polyval(local[jj, m], uu)) ** 2 for jj, uu in zip(j, u, strict=True) for m in range(4))
        scale = size / np.trace(profile._curvature(local, knots.tolist()))
        best, middle = None, y.mean()
        for share in profile.SMOOTHING[4:]:
            c, *_ = np.linalg.lstsq(np.vstack([own, np.sqrt(share * scale) * np.linalg.cholesky(bend + 1e-13 * np.trace(bend) * np.eye(len(bend))).T]), np.r_[b - middle, np.zeros(len(bend))], rcond=None)
            hat = np.trace(own @ np.linalg.lstsq(own.T @ own + share * scale * bend, own.T, rcond=None)[0])
            score = len(a) * ((b - middle - own @ c) ** 2).sum() / (len(a) - hat) ** 2
            best = (score, c) if best is None or score < best[0] else best
        return power((at - lo) / (hi - lo), 0) @ best[1] + middle

    got = profile.cross_fitted(df, "x", "y", "id", model="spline").toPandas().sort_values("id")
    want = plain_cross_fit(x, y, fold, spline)
    assert np.abs(got["prediction"].to_numpy() - want[np.argsort(rows["id"].to_numpy())]).max() < 2e-2
    best = profile.residual_association(df, "x", "y", {"z": "z", "w": parse("0 * z + x")}, "id", model="spline").first()
    assert best["variable"] == "z" and best["pearson"] > 0.9


def test_splines_are_as_smooth_as_the_data(spark):
    """Noise leads to a smooth fit, a wavy law without noise to a close one; a fixed penalty without end is a straight line."""
    rng = np.random.default_rng(21)
    x = rng.uniform(0, 10, 1500)
    df = frame(spark, x=x, wavy=np.sin(3 * x), noisy=0.3 * x + rng.normal(0, 1, 1500)).withColumn("id", F.monotonically_increasing_id())
    close = profile.cross_fitted(df, "x", "wavy", "id", model="spline").toPandas()
    assert np.abs(close["prediction"] - np.sin(3 * close["x"])).max() < 0.03
    smooth = profile.cross_fitted(df, "x", "noisy", "id", model="spline").toPandas()
    assert np.abs(smooth["prediction"] - 0.3 * smooth["x"]).max() < 0.4
    rows = profile.folded(df, "x", "noisy", "id", 5)
    line = profile._spline(rows, 5, 30, 1e9).toPandas()
    for k in range(5):
        train, own = line[line["fold"] != k], line[line["fold"] == k]
        assert np.allclose(np.polyval(np.polyfit(train["x"], train["y"], 1), own["x"]), own["prediction"], atol=1e-3)


def test_isotonic_blocks_in_parts(spark):
    """Ranges pooled apart and merged in a tree, of three fits of different directions, against one pass; a long rise before a deep fall."""
    rng = np.random.default_rng(22)
    n = 3000
    x = np.sort(rng.uniform(0, 1, n))
    y = np.stack([x + rng.normal(0, 0.3, n), -(x**2) + rng.normal(0, 0.1, n), np.r_[np.arange(n - 1.0), -1e6]], axis=1)
    w = rng.integers(0, 3, (n, 3)).astype(float)
    w[-1] = 1
    cells = spark.createDataFrame([(float(a), b.tolist(), (b * c).tolist()) for a, b, c in zip(x, w, y, strict=True)], "x double, w array<double>, s array<double>").repartition(5)
    rising = [True, False, True]
    for per_task in (40, 10**6):
        got = isotonic.blocks(cells, rising, per_task=per_task).toPandas()
        for k in range(3):
            own = got[got["fit"] == k].sort_values("lo")
            sign = 1 if rising[k] else -1
            stack = []
            for a, b, c in zip(x, w[:, k], sign * w[:, k] * y[:, k], strict=True):
                if b:
                    stack.append([b, c, a, a])
                    while len(stack) > 1 and stack[-2][1] / stack[-2][0] >= stack[-1][1] / stack[-1][0]:
                        t = stack.pop()
                        stack[-1] = [stack[-1][0] + t[0], stack[-1][1] + t[1], stack[-1][2], t[3]]
            assert np.allclose(own["lo"], [s[2] for s in stack]) and np.allclose(own["hi"], [s[3] for s in stack]) and np.allclose(own["value"], [sign * s[1] / s[0] for s in stack])
    assert isotonic.blocks(cells.limit(0), rising).count() == 0
    one = profile.isotonic(frame(spark, a=[1, 2, 2, 3, 4], b=[1, 5, 3, 2, 9]), "a", "b").orderBy("lo").collect()
    assert [tuple(r) for r in one] == [(1.0, 1.0, 1.0), (2.0, 3.0, 10 / 3), (4.0, 4.0, 9.0)]


def test_increasing_times(spark):
    df = spark.createDataFrame([(0, 5.0), (1, 1.0), (2, 3.0), (3, 3.0), (4, 4.0)], "k long, t double")
    assert split.strictly_increasing(df, "t", order="k").first()["violations"] == 2


def test_long_series_are_delayed_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(13)
    t = np.sort(rng.uniform(0, 100, 400))
    x = rng.normal(size=400)
    monkeypatch.setattr(delay, "BLOCKS", 7)
    got = delay.delay(frame(spark, t=t, x=x), "x", 2.5, time="t").orderBy("t").collect()
    want = np.interp(t - 2.5, t, x, left=np.nan)
    assert np.allclose([r["delayed"] for r in got], want, equal_nan=True)


@pytest.mark.parametrize("n,k", [(1, 3), (60, 6), (2500, None)])
def test_orders_equal_plain_ones(spark, n, k):
    """Quantiles, ranks, Kendall's counts and splits, with values that many rows share."""
    import pandas as pd

    rng = np.random.default_rng(n)
    x = rng.integers(0, k, n).astype(float) if k else np.where(rng.random(n) < 0.4, 5.0, rng.normal(size=n) * 100)
    y = np.round(x * 0.5 + rng.normal(size=n) * 3, 1)
    df = spark.createDataFrame(list(zip(range(n), x.tolist(), y.tolist(), strict=True)), "id long, x double, y double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    assert ranges.quantiles(df, {"x": (F.col("x"), shares)})["x"] == pytest.approx(np.quantile(x, shares).tolist())
    got = ranges.ranks(df, "x", "y").orderBy("id").toPandas()
    assert np.allclose(got["rank_x"], pd.Series(x).rank()) and np.allclose(got["rank_y"], pd.Series(y).rank())
    assert ranges.concordance(df) == np.sum(np.sign(x[:, None] - x[None, :]) * np.sign(y[:, None] - y[None, :])) / 2
    held = {r["id"] for r in split.by_quantile(df, "x", 0.3, key="id").filter("split = 'validation'").collect()}
    m = int(round(n * 0.3))
    assert held == set(np.lexsort((np.arange(n), x))[n - m :].tolist() if m else [])


def test_searched_formulas_of_equal_r2_are_in_order(spark):
    """By nine decimals, complexity and text: a target that no candidate explains leaves noise of sums alone. A constant is explained by any."""
    rng = np.random.default_rng(8)
    a, b, y = rng.uniform(1, 9, 300), rng.uniform(1, 9, 300), rng.normal(size=300)
    formulas = nonlinear.enumerate_formulas(["a", "b"], most=30)
    with_all = np.column_stack([np.ones(300), *[np.broadcast_to(compiled(f)({"a": a, "b": b}), 300) for f in formulas]])
    y = y - with_all @ np.linalg.lstsq(with_all, y, rcond=None)[0]
    df = frame(spark, a=a, b=b, y=y, c=np.full(300, 0.1)).repartition(3)
    for target, r2 in (("y", 0.0), ("c", 1.0)):
        got = nonlinear.search(df, ["a", "b"], target, most=30)
        assert len(got) > 20 and all(abs(m["r2"] - r2) < 1e-10 for m in got)
        assert [m["formula"] for m in got] == [f for _, f in sorted((m["complexity"], m["formula"]) for m in got)]


def test_searched_formulas_leave_out_rows_without_a_logarithm(spark):
    """a / log(0) is no zero of the candidate; a / inv(0) is one."""
    a, b = np.arange(1.0, 9.0), np.array([0.0, 0.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0])
    y = np.where(b > 0, 3 * a / np.log(np.where(b > 0, b, 2)) + 1, 50.0)
    got = {m["formula"]: m["r2"] for m in nonlinear.search(frame(spark, a=a, b=b, y=y), ["a", "b"], "y", most=200)}
    assert got["a / log(b)"] == pytest.approx(1)
    assert got["a / inv(b)"] == pytest.approx(np.corrcoef(a * b, y)[0, 1] ** 2)


def test_concordance_of_many_parts_by_joins_that_turn_into_broadcasts(spark, monkeypatch):
    """A subproblem stays in one task, whatever becomes of the join before; what is left for the next round isn't held in hash tables."""
    monkeypatch.setattr(ranges, "SPLIT", 6)
    new = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    rng = np.random.default_rng(3)
    x, y = np.where(rng.random(1500) < 0.2, 0.5, rng.random(1500)), rng.integers(0, 90, 1500).astype(float)
    y = np.where(rng.random(1500) < 0.5, y + x, y)
    try:
        assert ranges.concordance(frame(spark, x=x, y=y).repartition(7), task=200) == np.sum(np.sign(x[:, None] - x[None, :]) * np.sign(y[:, None] - y[None, :])) / 2
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    cells = spark.createDataFrame([("", 1.0, 2.0, 1.0, 1, 3)], "key string, a double, b double, n double, i int, j int")
    plan = ranges._inside(cells)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan


def test_brackets_are_narrowed(spark, monkeypatch):
    monkeypatch.setattr(ranges, "FEW", 3)
    monkeypatch.setattr(ranges, "ACCURACY", 20)
    v = np.random.default_rng(5).normal(size=3000)
    assert ranges.quantiles(frame(spark, v=v), {"v": (F.col("v"), [0.02, 0.37, 0.5])})["v"] == pytest.approx(np.quantile(v, [0.02, 0.37, 0.5]).tolist())


def test_series_are_delayed_in_ranges_of_time_one_by_one(spark, monkeypatch):
    """Long, short, empty ranges, ties, times and keys that are null: each series against a plain interpolation."""
    monkeypatch.setattr(delay, "BLOCKS", 9)
    rng = np.random.default_rng(12)
    rows = [(k, float(t), float(v)) for k, n, hi in (("a", 300, 50.0), ("b", 3, 1000.0), ("c", 1, 10.0), (None, 40, 60.0)) for t, v in zip(rng.uniform(0, hi, n).round(1), rng.normal(size=n), strict=True)]
    rows += [("d", 5.0, 1.0), ("d", 5.0, 3.0), ("d", 5.0, 2.0), ("d", 7.0, 0.0), ("d", None, 9.0), ("d", math.nan, 9.0)]
    df = spark.createDataFrame(rows, "k string, t double, v double").repartition(3)
    got = delay.delay(df, "v", 1.3, time="t", by=("k",)).collect()
    assert len(got) == len(rows)
    for r in got:
        own = sorted((t, v) for k, t, v in rows if k == r["k"] and t is not None and not math.isnan(t))
        want = math.nan
        if r["t"] is not None and not math.isnan(r["t"]):
            q = r["t"] - 1.3
            at = max((i for i, (t, _) in enumerate(own) if t <= q), default=None)
            if at is not None and own[at][0] == q:
                want = own[at][1]
            elif at is not None and at + 1 < len(own):
                (a, x), (b, z) = own[at : at + 2]
                want = x + (z - x) * (q - a) / (b - a)
        assert np.isclose(r["delayed"], want, rtol=1e-12, equal_nan=True), r


def test_delay(spark):
    t, x = np.array([0.0, 2.0, 3.0, 7.0, 7.5]), np.array([1.0, -1.0, 4.0, 0.0, 8.0])
    got, f = delay.attach_delays(frame(spark, t=t, x=x), parse("delay(x, 1.25) + delay(2 * x, 0.5)"), time="t")
    v = [r[0] for r in got.orderBy("t").select(f.to_column()).collect()]
    want = np.interp(t - 1.25, t, x, left=np.nan) + np.interp(t - 0.5, t, 2 * x, left=np.nan)
    assert np.allclose(v, want, equal_nan=True)


def test_exact_and_constant_metrics(spark):
    df = frame(spark, y=[2, 2], p=[2, 2], q=[1, 2])
    r = df.agg(metrics.r2(F.col("y"), F.col("p")).alias("a"), metrics.r2(F.col("y"), F.col("q")).alias("b"), metrics.aic(F.col("y"), F.col("p"), 1).alias("c"), metrics.pearson(F.col("y"), F.col("q")).alias("d")).first()
    assert r["a"] == 1 and r["b"] == -math.inf and r["c"] == -math.inf and math.isnan(r["d"])


def test_polynomial(spark):
    """Coefficients, errors, t and p against plain least squares; what isn't in the law is pruned."""
    rng = np.random.default_rng(20)
    u, v = rng.uniform(-4, 4, 90), rng.uniform(2, 5, 90)
    df = frame(spark, u=u, v=v, y=4 - 3 * u * v + 0.5 * v**2, noisy=4 - 3 * u * v + 0.5 * v**2 + rng.normal(size=90))
    r = fits.polynomial_fit(df, ["u", "v"], "y")
    assert set(r["coefficients"]) == {"1", "u*v", "v**2"} and r["rmse"] < 1e-6 and {m["term"] for m in r["removed"]} == {"u", "v", "u**2"}
    assert not fits.polynomial_fit(df, ["u", "v"], "y", prune=False)["removed"]
    r = fits.polynomial_fit(df, ["u", "v"], "noisy", prune=False)
    a = np.stack([np.ones(90), v, u, v**2, u * v, u**2], axis=1)
    names, own = ["1", "v", "u", "v**2", "u*v", "u**2"], df.toPandas()["noisy"].to_numpy()
    c, left = np.linalg.lstsq(a, own, rcond=None)[:2]
    error = np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * left[0] / 84)
    assert [r["coefficients"][k] for k in names] == pytest.approx(c.tolist(), rel=1e-6)
    assert [r["std_errors"][k] for k in names] == pytest.approx(error.tolist(), rel=1e-6)
    assert r["t"]["u*v"] == pytest.approx(c[4] / error[4], rel=1e-6) and r["p"]["u*v"] < 1e-10 < 0.001 < r["p"]["u**2"]
    assert fits.t_tails(2.0, 10) == pytest.approx(0.0733880348, abs=1e-9)


def test_interactions_that_are_allowed():
    pairs = lambda **k: fits.allowed_pairs(["a", "b", "c"], **k)
    assert pairs() == {("a", "b"), ("a", "c"), ("b", "c")} and pairs(interactions=False) == set()
    assert pairs(only=[("c", "a"), ("a", "z")]) == {("a", "c")} and pairs(never=[("b", "a")]) == {("a", "c"), ("b", "c")}
    three = fits.monomials(["a", "b", "c"], 3, never=[("a", "c")])
    assert (1, 1, 1) not in three and (2, 1, 0) in three and (1, 0, 2) not in three and (0, 0, 3) in three


def test_power_law(spark):
    """Exponents, their intervals against plain leave-one-fold-out pseudo-values, and data where no power law applies."""
    rng = np.random.default_rng(41)
    u, v = rng.uniform(1, 4, 200), rng.uniform(0.2, 2, 200)
    y = 0.4 * u**-3 * v ** (2 / 3)
    df = frame(spark, u=u, v=v, y=y, noisy=y * np.exp(rng.normal(0, 0.1, 200))).withColumn("id", F.monotonically_increasing_id())
    r = fits.power_law_fit(df, ["u", "v"], "y", key="id")
    assert r["exponents"] == pytest.approx({"u": -3, "v": 2 / 3}) and r["snapped"] == {"u": "-3", "v": "2/3"} and r["scale"] == pytest.approx(0.4)
    r, rows = fits.power_law_fit(df, ["u", "v"], "noisy", key="id"), df.toPandas()
    a, b = np.log(rows[["u", "v"]].to_numpy()), np.log(rows["noisy"].to_numpy())
    solve = lambda on: np.linalg.lstsq(np.c_[a[on], np.ones(on.sum())], b[on], rcond=None)[0][:2]
    fold = rows["id"].to_numpy() % 10
    pseudo = np.array([10 * solve(fold >= 0) - 9 * solve(fold != k) for k in range(10)])
    half = fits.t_quantile(0.975, 9) * pseudo.std(0, ddof=1) / np.sqrt(10)
    for i, n in enumerate(("u", "v")):
        assert r["intervals"][n] == pytest.approx((pseudo.mean(0)[i] - half[i], pseudo.mean(0)[i] + half[i]), rel=1e-6)
    assert fits.power_law_fit(frame(spark, u=[2, 0, 1], y=[1, 2, 3]), ["u"], "y")["status"] == "domain_inapplicable"
    assert fits.t_tails(fits.t_quantile(0.95, 4), 4) == pytest.approx(0.1, abs=1e-9)


def test_harmonic(spark):
    rng = np.random.default_rng(42)
    x, t = rng.uniform(0.5, 2, 400), rng.uniform(0, 9, 400)
    df = frame(spark, x=x, t=t, y=2 * x - 0.7 * x**2 + 1.3 * x * np.sin(4.321 * t))
    r = fits.harmonic_fit(df, "x", "t", "y", degree=2, intercept=False)
    assert r["omega"] == pytest.approx(4.321, abs=1e-5) and r["c"] == pytest.approx(1.3, abs=1e-4) and r["powers"] == pytest.approx([2, -0.7], abs=1e-3) and r["a"] == 0


def test_rational(spark):
    x = np.linspace(0.2, 4, 250)
    r = fits.rational_fit(frame(spark, a=x, b=(3 - x) / (1 + 0.8 * x)), "a", "b")
    assert r["rmse"] < 1e-9 and not r["pole"] and r["q"][1] == pytest.approx(0.8) and r["p"] == pytest.approx([3, -1])


def test_nonlinear(spark):
    t = np.linspace(0, 4, 41)
    r = nonlinear.fit("param('h') - param('k') * t", frame(spark, t=t, y=5 - 2 * t), "y")
    assert r.parameters == pytest.approx({"h": 5, "k": 2}) and r.success
    g = nonlinear.fit("grouped_param(kind, name='k') * t", frame(spark, t=[3, 4, 3, 4], kind=["u", "u", "w", "w"], y=[6, 8, -9, -12]), "y")
    assert g.parameters["k"] == pytest.approx({"u": 2, "w": -3})
    held = nonlinear.fit("param('k') * t", frame(spark, t=t, y=3 * t), "y", bounds={"k": (0.0, 2.0)})
    assert held.parameters["k"] == pytest.approx(2.0)


def test_groups_few_and_many_are_one_fit(spark, monkeypatch):
    """Two parameters of a category and two shared ones, nonlinear, with bounds: on the driver, in tables, and as plain parameters."""
    rng = np.random.default_rng(30)
    kinds = [f"k{i}" for i in range(6)]
    own = {k: (1 + 0.3 * i, 2.0 - 0.2 * i) for i, k in enumerate(kinds)}
    rows = [(k, float(t), float(own[k][0] * np.exp(-0.4 * t) + own[k][1] * t + 3.0 + rng.normal(0, 0.01))) for k in kinds for t in rng.uniform(0, 4, 30)]
    df = spark.createDataFrame([*rows, (None, 1.0, 100.0)], "kind string, t double, y double")
    f = "grouped_param(kind, name='a') * exp(-param('r') * t) + grouped_param(kind, name='b') * t + param('c')"
    few = nonlinear.fit(f, df, "y", initial={"r": 0.5, "c": 2.8, "b": 1.5, "a": 2.0})
    flat = nonlinear.fit(f.replace("grouped_param(kind, name='a')", "(" + " + ".join(f"param('a_{k}') * is_{k}" for k in kinds) + ")").replace("grouped_param(kind, name='b')", "(" + " + ".join(f"param('b_{k}') * is_{k}" for k in kinds) + ")"),
                         df.filter("kind is not null").withColumns({f"is_{k}": (F.col("kind") == k).cast("double") for k in kinds}), "y", initial={"r": 0.5, "c": 2.8} | {f"b_{k}": 1.5 for k in kinds} | {f"a_{k}": 2.0 for k in kinds})
    assert few.success and few.loss == pytest.approx(flat.loss, rel=1e-9) and few.parameters["r"] == pytest.approx(flat.parameters["r"], rel=1e-6)
    assert all(few.parameters[n][k] == pytest.approx(flat.parameters[f"{n}_{k}"], rel=1e-5) for n in "ab" for k in kinds)
    monkeypatch.setattr(arrow, "LOCAL", 3)
    many = nonlinear.fit(f, df, "y", initial={"r": 0.5, "c": 2.8, "b": 1.5, "a": 2.0})
    got = {r["category"]: (r["a"], r["b"]) for r in many.groups.collect()}
    assert "a" not in many.parameters and many.loss == pytest.approx(few.loss, rel=1e-9) and set(got) == set(kinds)
    assert all(got[k] == pytest.approx((few.parameters["a"][k], few.parameters["b"][k]), rel=1e-5) for k in kinds)
    held = nonlinear.fit(f, df, "y", bounds={"a": (0.0, 1.5), "r": (0.0, 1.0)}, initial={"a": {"k0": 1.2}, "r": 0.5}, rounds=5)
    assert max(r["a"] for r in held.groups.collect()) <= 1.5


def test_a_hundred_thousand_categories(spark):
    n = 100_000
    df = spark.range(2 * n).select((F.col("id") % n).alias("g"), (1.0 + F.col("id") % 7 + F.floor(F.col("id") / n) * 0.5).alias("x"), (F.col("id") % 5 * 0.25).alias("z"))
    df = df.withColumn("y", (F.col("g") % 11) * F.col("x") + 2.5 * F.col("z"))
    r = nonlinear.fit("grouped_param(g, name='k') * x + param('c') * z", df, "y", rounds=12)
    assert r.parameters["c"] == pytest.approx(2.5, abs=1e-6)
    assert r.groups.filter(F.abs(F.col("k") - F.col("category") % 11) > 1e-4).count() == 0 and r.groups.count() == n


def test_two_groupings(spark):
    rows = [(g, h, float(x), float({"u": 2, "w": -1}[g] * x + {"p": 5, "q": 7, "r": -3}[h])) for g in "uw" for h in "pqr" for x in range(4)]
    r = nonlinear.fit("grouped_param(g, name='k') * x + grouped_param(h, name='b')", spark.createDataFrame(rows, "g string, h string, x double, y double"), "y")
    assert r.parameters["k"] == pytest.approx({"u": 2, "w": -1}) and r.parameters["b"] == pytest.approx({"p": 5, "q": 7, "r": -3})


def test_fits_of_delays(spark):
    t = np.arange(60) / 4
    df = frame(spark, t=t, x=np.sin(t) + t)
    y = df.toPandas()
    before = np.interp(y["t"] - 1.5, y["t"], y["x"], left=np.nan)
    df = frame(spark, t=t, x=np.sin(t) + t, y=2 * np.sin(t) + 2 * t - 0.6 * np.nan_to_num(before)).filter("t >= 1.5 or t < 0")
    full = delay.attach_delays(frame(spark, t=t, x=np.sin(t) + t, y=2 * np.sin(t) + 2 * t - 0.6 * np.nan_to_num(before)), parse("param('a') * x + param('b') * delay(x, 1.5)"), time="t")
    r = nonlinear.fit(full[1], full[0].filter("t >= 1.5"), "y")
    assert r.parameters == pytest.approx({"a": 2, "b": -0.6}, abs=1e-8)
    short = frame(spark, t=t, x=np.ones(60), y=3 * np.ones(60))
    assert nonlinear.fit("param('a') * x + 0 * t", short, "y", time="t").parameters["a"] == pytest.approx(3)


def test_constants(spark):
    """The front of simple constants; on held-out rows, if there are any."""
    x = np.linspace(1, 6, 40)
    df = frame(spark, x=x, y=np.sqrt(3) * x - 5 / 7)
    front = constants.constant_fit("1.7322 * x - 0.7151", df, "y")
    assert front[0]["choices"] == ["sqrt(3)", "5/7"] and front[0]["r2"] == pytest.approx(1, abs=1e-12)
    held = constants.constant_fit("1.7322 * x - 0.7151", df.withColumn("late", F.col("x") > 4), "y", held="late")
    assert held[0]["choices"] == ["sqrt(3)", "5/7"] and held[0]["train_r2"] == pytest.approx(1, abs=1e-12)
    assert constants.nearby_constants(6.2832)[0][0] == "2*pi" and constants.nearby_constants(-1.3591)[0][0] == "-0.5*e"
    assert all(abs(v - 2.49) <= 0.05 * 2.49 for _, v in constants.nearby_constants(2.49)) and len(constants.nearby_constants(2.49)) <= 4
    assert [constants.rationalised(v) for v in (0.75, 2 * math.pi, 1 + math.e, -0.2)] == ["3/4", "2*pi", "e + 1", "-1/5"]


def test_constants_in_a_box(spark):
    x = np.linspace(0, 6, 80)
    r = constants.fit_constants("1.0 * sin(1.9 * x) + 0.1", frame(spark, x=x, y=3 * np.sin(2 * x) - 1), "y")
    assert r.loss < 1e-16 and "param" not in str(r.expression)
    lone = constants.fit_constants("(x - 1.0) ** 2.0", frame(spark, x=x, y=(x - 4) ** 2), "y", starts=2)
    assert lone.loss < 1e-10
    kept = constants.fit_constants("param('k') * x + 1.0", frame(spark, x=x, y=2 * x + 5), "y", global_search=False)
    assert "param('k'" in str(kept.expression) and kept.loss < 1e-18


def test_evolution_finds_the_lowest_of_many_pits():
    pits = lambda p: (p**2).sum(1) / 50 + 2 - np.cos(3 * p).sum(1)
    at = constants.evolve(pits, np.array([-9.0, -9.0]), np.array([9.0, 9.0]), rounds=80, size=10, seed=1)
    assert np.abs(at).max() < 0.2


def test_digits_lost(spark):
    """A difference of close numbers loses digits; a part times zero has no impact; plain products lose none."""
    x = np.linspace(1, 2, 2000)
    df = frame(spark, x=x, z=x * 1.0005)
    rows = noise.noise_amplification("(z * 2 - x * 2) * 5", df, repeats=3)
    told = {m["node"]: m for m in rows}
    gap = told["z * 2 - x * 2"]
    # two products with noise s each, over a gap of 0.0005: sqrt(2) / 0.0005, and the difference's own noise
    assert gap["amplification"] == pytest.approx(math.log10(math.sqrt(2) / 0.0005), abs=0.1) and gap["diagnosis"] == "severe loss, made here"
    assert told["z * 2"]["amplification"] == pytest.approx(0, abs=0.05) and told["z"]["diagnosis"] == "leaf"
    assert rows[0]["formula_amplification"] >= gap["amplification"] - 0.2 and rows[0]["diagnosis"] == "severe loss, from below"
    idle = {m["path"]: m for m in noise.noise_amplification("x + 0 * (z * 2 - x * 2)", df, repeats=1)}
    assert idle["root/1"]["impact"] == 0 and idle["root/1"]["diagnosis"].startswith("no impact") and idle["root"]["impact"] == 1
    assert [noise.Loss(*a).words() for a in ((0.2, 0, 0, 1.0), (0.1, 0, 1.5, 1.0), (0.1, 1.4, 1.4, 1.0), (1.5, 0, 0, 1.0), (0.1, 0, 2, 1e-9))] == ["stable", "damps a sensitive part", "noticeable loss, from below", "noticeable loss, made here", "no impact, hides a sensitive part"]


def test_rollouts(spark):
    """Against closed forms: a stiff relaxation, a driven one with an observed drive, and times that don't rise."""
    t = [0.0, 0.3, 0.35, 2.0, 7.0]
    fast = rollout.rollout("-40 * x", [{"t": s, "x": 2 * math.exp(-40 * s)} for s in t])
    assert fast == pytest.approx([2 * math.exp(-40 * s) for s in t], abs=1e-7)
    driven = rollout.rollout("u - x", [{"t": s, "x": s - 1 + math.exp(-s), "u": s} for s in t])
    assert driven == pytest.approx([s - 1 + math.exp(-s) for s in t], rel=1e-6)
    with pytest.raises(ValueError):
        rollout.rollout("-x", [{"t": 1.0, "x": 1.0}, {"t": 1.0, "x": 1.0}])
    with pytest.raises(RuntimeError):
        rollout.rollout("x ** 2", [{"t": 0.0, "x": 1.0}, {"t": 2.0, "x": 0.0}], steps=2000)


def test_ranking(spark):
    df = split.candidates(spark, [(0, "a", 5, 1.0), (1, "b", 3, 1.0), (2, "c", 2, 4.0), (3, "d", 4, 2.0)])
    assert [r["candidate_id"] for r in split.ranked(df).orderBy("rank").collect()] == [1, 0, 3, 2]
    assert [r["candidate_id"] for r in split.pareto(df).orderBy("rank").collect()] == [1, 2]
    assert {r["candidate_id"] for r in split.dominated(df).collect()} == {0, 3}


def test_splits(spark):
    df = spark.range(10).withColumn("v", F.col("id") % 5)
    got = {r["id"] for r in split.out_of_domain(df, "v", 0.25, key="id").filter("split = 'validation'").collect()}
    assert got == {4, 9}
    held = {r["id"] for r in split.permuted(df, "id", 0.3, seed=3).filter("split = 'validation'").collect()}
    assert held == set(np.random.RandomState(3).permutation(10)[:3].tolist())


@pytest.mark.parametrize("n", [1, 2, 5, 64, 65, 1000, 4097])
def test_exact_folds_and_splits(spark, n):
    """A permutation of 0..n-1 that a seed fixes; parts of equal sizes, or one more; another seed deals otherwise."""
    df = spark.range(n).toDF("row")
    got = {r["row"]: r["place"] for r in split.shuffled(df.repartition(3), "row", n, seed=1).collect()}
    assert sorted(got.values()) == list(range(n)) and got == {r["row"]: r["place"] for r in split.shuffled(df, "row", n, seed=1).collect()}
    sizes = [r["count"] for r in split.exact_folds(df, "row", 5, seed=1).groupBy("fold").count().collect()]
    assert sum(sizes) == n and len(sizes) == min(n, 5) and max(sizes) - min(sizes) <= 1
    assert split.exact_split(df, "row", 0.3, seed=2).filter("split = 'validation'").count() == round(n * 0.3)
    if n >= 64:
        other = {r["row"]: r["place"] for r in split.shuffled(df, "row", n, seed=2).collect()}
        assert sum(got[k] == other[k] for k in got) < n / 5 and sum(got[k] == k for k in got) < n / 5


def test_last_lines_and_labels(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (2, ""), (3, None), (4, "x\n")], "k long, text string")
    for n in (1, 2, 5):
        want = text.tail(text.lines(df, "k"), "k", n)
        assert sorted(map(tuple, text.last_lines(df, "k", n).collect())) == sorted(map(tuple, want.select("k", "n", "line").collect()))
    rows = [(7, "v"), (3, "u"), (9, None), (4, "v"), (5, "w"), (1, None)]
    got = metrics.first_seen(spark.createDataFrame(rows, "at long, label string"), "label", "at").collect()
    assert {r["label"]: r["code"] for r in got} == {None: 0, "u": 1, "v": 2, "w": 3}


def test_search_tree(spark):
    nodes = split.candidates(spark, [(0, "a", 1, 4.0), (1, "b", 2, 3.0), (2, "c", 3, 3.5), (3, "d", 9, 1.0)])
    parents = spark.createDataFrame([(1, 0), (2, 1), (3, 9)], "candidate_id long, parent_id long")
    got = {r["candidate_id"]: (r["parent_metric"], r["gain"]) for r in split.search_tree(nodes, parents).collect()}
    assert got == {0: (None, None), 1: (4.0, 1.0), 2: (3.0, -0.5), 3: (None, None)}


def test_text(spark):
    df = spark.createDataFrame([(1, "a,b,c\nx,,z\nb"), (2, None)], "k long, text string")
    rows = text.lines(df, "k")
    assert [r["line"] for r in text.cut(rows.filter("k = 1"), [3, 1]).orderBy("n").collect()] == ["c,a", "z,x", ",b"]
    assert text.grep(rows, "B", ignore_case=True).count() == 2 and text.grep(rows, ",", fixed=True, invert=True).count() == 2
    assert [(r["n_lines"], r["n_words"]) for r in text.wc(df, "k").orderBy("k").collect()] == [(2, 3), (0, 0)]
    page = spark.createDataFrame([("<p>a &amp; b</p><script>x</script><div>c</div>",)], "h string")
    assert page.select(text.html_text(F.col("h"))).first()[0] == "a & b\nc"


def test_dataset_forgets_splits(spark):
    ds = dataset.Dataset(frame(spark, x=[1, 2], y=[3, 4]).withColumn("id", F.monotonically_increasing_id()), "y", ["x"])
    first = ds.split(split.random, key="id")
    assert ds.split(split.random, key="id") is first
    ds.add_features({"x2": "x ** 2"})
    assert ds.split(split.random, key="id") is not first and ds.features == ["x", "x2"]


def test_demos(spark):
    surface = dataset.demo(spark, "quadratic_surface")
    assert surface.count() == 240 and surface.filter(F.abs(F.col("w") - parse("3 - 0.5*u*v + v**2").to_column()) > 1e-12).count() == 0
    rates = nonlinear.fit("a * exp(-grouped_param(material, name='k') * t)", dataset.demo(spark, "decay_by_material"), "m").parameters["k"]
    assert rates == pytest.approx({"glass": 0.2, "steel": 1.1, "wood": 0.6}, abs=1e-6)
    rows = [r.asDict() for r in dataset.demo(spark, "forced_relaxation").orderBy("t").collect()]
    assert rollout.rollout("0.5 * cos(2 * t) - 0.8 * x", rows) == pytest.approx([r["x"] for r in rows], abs=1e-6)
    states, edges = dataset.demo(spark, "ring_diffusion", 5)
    ring = Graph(12, states, {"R": edges.select("row_id", "target", "source")})
    assert nonlinear.fit("param('d') * sum[j](R[i, j], u[j] - u[i])", ring, "du").parameters["d"] == pytest.approx(0.25)
    with pytest.raises(ValueError):
        dataset.demo(spark, "none")


def test_problem_tables(spark, tmp_path):
    rows = [("p1", ["y", "x"], ["out", "in"], ["O", "V"], "y(t) - y(t) + x(t)^2 * pi"), ("p2", ["y", "x"], ["", ""], ["O", "V"], "x * unknown")]
    spark.createDataFrame(rows, "name string, symbols array<string>, symbol_descs array<string>, symbol_properties array<string>, expression string").write.parquet(str(tmp_path / "data" / "laws-0"))
    x = np.linspace(0, 1, 9)
    (got,) = dataset.load_problems(spark, str(tmp_path), "laws", {"p1": frame(spark, y=math.pi * x**2, x=x)})
    assert got["name"] == "p1" and got["target"] == "y" and got["r2"] == pytest.approx(1)


def test_exports():
    import lawengine

    e = lawengine.sin(lawengine.Symbol("x")) + lawengine.ln(2) * lawengine.param("a")
    assert str(e) == "sin(x) + log(2) * param('a')" and lawengine.render(lawengine.parse("a/b"), latex=True) == r"\frac{a}{b}"
    for name in lawengine.__all__:
        assert getattr(lawengine, name) is not None
    with pytest.raises(AttributeError):
        lawengine.nothing  # noqa: B018


def test_usage(spark):
    from lawengine.functions.usage import Counters

    c = Counters()
    with c.timed("fit", 4):
        pass
    c.add("fit", 1, 2.0)
    (r,) = c.table(spark).collect()
    assert r["count"] == 5 and r["seconds"] >= 2 and r["seconds_per_unit"] == pytest.approx(r["seconds"] / 5)


def test_character_references(spark):
    t = "&lt;b&gt; &copy;&#169;&#xA9; &amp;lt; &nosuch; &#0; & &#1114112; &#x1F600;"
    (got,) = spark.createDataFrame([(t,)], "t string").select(text.entities(F.col("t")).alias("x")).first()
    assert got == "<b> ©©© &lt; &nosuch; &#0; & &#1114112; \U0001F600"


def test_evaluators(spark):
    from lawengine.operators.evaluators import TOOLS, Evaluator, GraphEvaluator, call, evaluate_code, subsample, tool

    x = np.linspace(0, 1, 50)
    data = dataset.Dataset(frame(spark, x=x, y=2 * x + 1).withColumn("id", F.monotonically_increasing_id()), "y", ["x"])
    ev = Evaluator(options={"key": "id"})
    got = ev.evaluate_candidate(data, "a * x + b")
    assert got["eligible"] and got["parameters"] == pytest.approx({"a": 2, "b": 1}) and set(got["metrics"]) == {"train", "validation"}
    assert not ev.evaluate_candidate(data, "y + 0 * x")["eligible"]
    mine = evaluate_code(data, lambda rows: rows.agg(F.avg("y")).first()[0], lambda m, rows: rows.withColumn("prediction", F.lit(m)), ev)
    assert mine["eligible"] and not evaluate_code(data, lambda rows: None, lambda m, rows: rows.withColumn("prediction", F.col("y")), ev)["eligible"]

    nodes = spark.createDataFrame([(s, i, float(s + i), 0.0) for s in range(5) for i in range(3)], "sample long, node long, x double, y double")
    edges = spark.createDataFrame([(0, 0, 1), (1, 1, 2)], "row_id long, i long, j long")
    pull = parse("param('c') * sum[j](A[i, j], x[j] - x[i])")
    g = Graph(3, nodes, {"A": edges})
    truth = parse("-1.75 * sum[j](A[i, j], x[j] - x[i])").evaluate(g).select("sample", F.col("i").alias("node"), F.col("value").alias("y"))
    ge = GraphEvaluator(Graph(3, nodes.drop("y").join(truth, ["sample", "node"]), {"A": edges}), "y", 0.4)
    assert ge.split()[0].nodes.select("sample").distinct().count() == 3
    fitted = ge.fit_linear(pull, "c")
    assert ge.fit(pull).parameters["c"] == pytest.approx(-1.75)
    assert ge.evaluate(fitted)["validation"]["mse"] == pytest.approx(0, abs=1e-20)

    @tool
    def double(v: float, times: int = 2):
        """v, a few times."""
        return v * times

    assert TOOLS["double"]["schema"]["required"] == ["v"] and call("double", v=2.0) == {"ok": True, "result": 4.0}
    assert not call("double")["ok"] and not call("none")["ok"]
    assert subsample(spark.range(100), 7, key="id").count() == 7


# tall-skinny QR


def test_factor_equals_numpys(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (5000, 4)) @ rng.normal(0, 1, (4, 4)) + [0, 1e6, -3, 5]
    y = x @ [1, 2, 3, 4] + rng.normal(0, 0.1, 5000)
    df = frame(spark, **{f"x{i}": x[:, i] for i in range(4)}, y=y).repartition(7)
    g = triangular.factor(df, {c: F.col(c) for c in df.columns})
    c, left = g.solve()
    want, rest, *_ = np.linalg.lstsq(np.column_stack([x, np.ones(5000)]), y, rcond=None)
    assert np.allclose(c[:4], want[:4], rtol=1e-8) and abs(c[4] - want[4]) < 1e-6 * abs(want[4]) and abs(left - rest[0]) < 1e-8 * rest[0] and g.n == 5000 and g.rank == 4
    c, left = g.solve([0, 2], intercept=False)
    want, rest, *_ = np.linalg.lstsq(x[:, [0, 2]], y, rcond=None)
    assert np.allclose(c[:2], want, rtol=1e-10) and abs(left - rest[0]) < 1e-9 * rest[0]
    assert np.allclose(g.inverse([0, 2], intercept=False), np.linalg.inv(x[:, [0, 2]].T @ x[:, [0, 2]]), rtol=1e-9)
    assert np.allclose(g.mean[:4], x.mean(0)) and np.allclose(g.scale[:4], x.std(0))


def test_near_collinear_polynomial_of_degree_four(spark):
    """Powers of values from 10 to 11 are collinear to nine digits; products of them would be singular."""
    rng = np.random.default_rng(6)
    x = rng.uniform(10, 11, 4000)
    y = 3 - 2 * x + 0.5 * x**4 + rng.normal(0, 1e-6, 4000)
    r = fits.polynomial_fit(frame(spark, x=x, y=y).repartition(5), ["x"], "y", degree=4, prune=False)
    z = np.column_stack([x, x * x, x * x * x, x * x * x * x])
    z0, y0 = z - z.mean(0), y - y.mean()
    q, t = np.linalg.qr(z0 / z0.std(0))
    want = np.linalg.solve(t, q.T @ y0) / z0.std(0)
    got = np.array([r["coefficients"][n] for n in ("x", "x**2", "x**3", "x**4")])
    assert np.abs(z0 @ (got - want)).max() < 1e-10 * np.abs(y0).max() and r["rank"] == 4 and not r["deficient"]
    assert abs(r["rmse"] - np.sqrt(np.mean((y0 - z0 @ want) ** 2))) < 1e-6 * r["rmse"]


def test_rank_deficiency_is_told(spark):
    rng = np.random.default_rng(7)
    u, v = rng.normal(size=300), rng.normal(size=300)
    df = frame(spark, u=u, v=v, w=2 * u - 3 * v + 1, k=np.full(300, 7.0), y=u + v)
    r = triangular.factor(df, {c: F.col(c) for c in df.columns})
    c, left = r.solve()
    assert r.rank == 2 and left < 1e-20 and np.allclose(np.column_stack([u, v, 2 * u - 3 * v + 1, np.full(300, 7.0)]) @ c[:4] + c[4], u + v)


def test_factor_of_many_columns_groups_and_odd_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 500))
    y = x @ np.arange(500.0)
    df = spark.createDataFrame([(r.tolist(), float(t)) for r, t in zip(x, y, strict=True)], "x array<double>, y double").repartition(3)
    c, left = triangular.factor(df, {f"x{i}": F.get("x", F.lit(i)) for i in range(500)} | {"y": F.col("y")}).solve()
    assert np.allclose(c[:500], np.arange(500.0), atol=1e-8) and left < 1e-12
    odd = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", math.nan, 1.0), (None, 5.0, 1.0), (None, None, 1.0), ("b", math.inf, 2.0), ("c", 3.0, 3.0)], "g string, x double, y double")
    by = triangular.factor(odd, {"x": F.col("x"), "y": F.col("y")}, by="g")
    assert {k: g.n for k, g in by.items()} == {"a": 2, None: 1, "c": 1} and np.allclose(by["a"].solve()[0], [2, 0])
    whole = triangular.merged([by["a"], by["c"], by[None]])
    assert whole.n == 4 and np.allclose(whole.solve()[0], np.polyfit([1, 2, 3, 5], [2, 4, 3, 1], 1))
    with pytest.raises(ValueError):
        triangular.factor(odd.limit(0), {"x": F.col("x"), "y": F.col("y")})
