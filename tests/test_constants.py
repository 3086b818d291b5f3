"""Graphs of formulas, constants in boxes, noise trees and rollouts in parts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lawengine.functions import ieee, tree
from lawengine.operators import constants, noise, nonlinear, rollout
from lawengine.plans.dag import Dag, compiled
from lawengine.plans.nodes import Number, Symbol
from lawengine.plans.parse import ARITY, parse

VALUES = [-math.inf, -2.5, -1.0, -0.0, 0.0, 0.3, 1.0, 2.0, 700.0, math.inf, math.nan]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(a, b) for a in VALUES for b in VALUES], "a double, b double")


@pytest.mark.parametrize("op", "+ - * / **".split())
def test_operations_of_a_graph_are_those_of_columns(pairs, op):
    e = parse(f"a {op} b")
    rows = pairs.withColumn("v", e.to_column()).toPandas()
    got = compiled(e)({"a": rows["a"].to_numpy(), "b": rows["b"].to_numpy()})
    assert np.allclose(got, rows["v"].to_numpy(), rtol=1e-12, equal_nan=True)


def test_functions_of_a_graph_are_those_of_columns(pairs):
    calls = {n: f"{n}(a)" if k == 1 else f"{n}(a, b)" for n, k in ARITY.items()}
    rows = pairs.select("a", "b", *[parse(t).to_column().alias(f"v_{n}") for n, t in calls.items()]).toPandas()
    for n, t in calls.items():
        got = np.broadcast_to(compiled(parse(t))({"a": rows["a"].to_numpy(), "b": rows["b"].to_numpy()}), len(rows))
        assert np.allclose(got, rows[f"v_{n}"].to_numpy(), rtol=1e-9, equal_nan=True), n


def test_equal_subexpressions_are_one_node():
    dag = Dag()
    roots = [dag.add(parse(f"sin(x * y) ** 2 + {k} * exp(x * y)")) for k in range(50)]
    assert len(set(roots)) == 50 and len(dag.nodes) < 4 * 50
    x, y = np.linspace(0, 1, 5), np.linspace(2, 3, 5)
    for i, v in dag.values({"x": x, "y": y}, roots):
        assert np.allclose(v, np.sin(x * y) ** 2 + roots.index(i) * np.exp(x * y))


def test_all_combinations_are_one_scan(spark, monkeypatch):
    seen = []
    once = tree.gathered
    monkeypatch.setattr(tree, "gathered", lambda *a, **k: seen.append(1) or once(*a, **k))
    x = np.linspace(1, 3, 60)
    df = spark.createDataFrame([(float(v), float(2 * math.pi * v**1.5 - math.sqrt(2) * v + 0.5)) for v in x], "x double, y double")
    front = constants.constant_fit("6.28 * x ** 1.5 - 1.41 * x + 0.5", df, "y")
    assert len(seen) == 1 and front[0]["choices"][:2] == ["2*pi", "3/2"] and front[0]["r2"] == pytest.approx(1, abs=1e-12)
    with pytest.raises(ValueError):
        constants.constant_fit("6.28 * x ** 1.5", df, "y", limit=3)


def test_squared_errors_of_sides_and_of_what_is_not_finite(spark):
    df = spark.createDataFrame([(1.0, 2.0, True), (2.0, 5.0, False), (0.0, 1.0, None)], "x double, y double, on boolean")
    got = constants.squared_errors(df, [parse("2 * x"), parse("1 / x"), Number(3.0)], ieee.number(F.col("y")), {"all": F.lit(True), "on": F.col("on")})
    assert got["all"].tolist()[0] == 2.0 and math.isinf(got["all"][1]) and got["all"][2] == 9.0 and got["on"].tolist() == [0.0, 1.0, 1.0]


def test_literals_have_roles():
    e = parse("2 * (x - 3) ** 4 + (y - x - 5) / 6")
    got = {x.value: (x.role, x.variable) for x in constants.literals_of(e, {"x", "y"})}
    assert got == {2.0: ("free", None), 3.0: ("shift", "x"), 4.0: ("exponent", None), 5.0: ("free", None), 6.0: ("free", None)}


def test_constants_of_categories_are_searched(spark):
    """A frequency for each category, which no local fit from the start finds, and a literal."""
    t = np.linspace(0, 3, 60)
    rows = [(k, float(v), float(1.5 * math.sin(w * v))) for k, w in (("a", 4.0), ("b", -6.5)) for v in t]
    df = spark.createDataFrame(rows, "kind string, t double, y double")
    r = constants.fit_constants("1.0 * sin(grouped_param(kind, name='w', default=3.6, value={'a': 3.6, 'b': -6.1}) * t)", df, "y", starts=1)
    assert r.loss < 1e-12 and r.parameters["w"] == pytest.approx({"a": 4.0, "b": -6.5}, abs=1e-4) and "param('c" not in str(r.expression)


def test_noise_tree(spark):
    df = spark.createDataFrame([(float(v), float(v) * 1.0005) for v in np.linspace(1, 2, 400)], "x double, z double")
    rows = noise.noise_amplification("z * 2 - x * 2", df, repeats=2)
    lines = noise.noise_tree("z * 2 - x * 2", rows).splitlines()
    assert len(lines) == 7 and lines[0].startswith("-: 3.") and "severe loss, made here" in lines[0] and lines[2].startswith("    z: 0.00 digits")
    with pytest.raises(ValueError):
        noise.noise_amplification("x + missing", df)
    assert noise.noise_amplification("x + 1", df.limit(0))[0]["impact"] is None


def test_rollouts_in_parts_go_on_where_they_were(spark, monkeypatch):
    """Trajectories that are longer than a chunk, shorter ones, one of a single row, and one with a drive."""
    def frame():
        rows = [(k, float(s), 2.0 * math.exp(-0.7 * s) if s == 0 else math.nan, float(k)) for k, n in ((1, 50), (2, 1), (3, 7), (4, 400)) for s in np.linspace(0, 5, n)]
        return spark.createDataFrame(rows, "k long, t double, x double, u double")

    for chunk in (16, 65_536):
        monkeypatch.setattr(rollout, "ROWS", chunk)
        got = rollout.rollouts(frame().repartition(3), "-0.7 * x + 0 * u", by="k").collect()
        assert len(got) == 458 and all(abs(r["rolled"] - 2 * math.exp(-0.7 * r["t"])) < 1e-6 for r in got)
    with pytest.raises(Exception, match="rising"):
        rollout.rollouts(spark.createDataFrame([(1, 0.0, 1.0), (1, 0.0, 2.0)], "k long, t double, x double"), "-x", by="k").collect()


def test_rollouts_after_a_join_that_turns_into_a_broadcast(spark):
    """The join's own shuffle by the key is then read where it lies; trajectories must not be cut by that."""
    new = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        rows = spark.createDataFrame([(k, float(s), 2.0 if s == 0 else math.nan) for s in np.linspace(0, 5, 50) for k in range(40)], "k long, t double, x double").repartition(7)
        got = rollout.rollouts(rows.join(spark.range(40).withColumnRenamed("id", "k"), "k", "left"), "-0.7 * x", by="k").collect()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(got) == 2000 and all(abs(r["rolled"] - 2 * math.exp(-0.7 * r["t"])) < 1e-6 for r in got)


def test_fit_of_many_parameters_is_a_scan_a_step(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 25))
    df = spark.createDataFrame([(*map(float, r), float(r @ np.arange(25) + 4)) for r in x], ", ".join([f"x{i} double" for i in range(25)] + ["y double"]))
    r = nonlinear.fit(" + ".join(f"param('a{i}') * x{i}" for i in range(25)) + " + param('c')", df, "y")
    assert r.loss < 1e-18 and r.parameters["a7"] == pytest.approx(7) and r.parameters["c"] == pytest.approx(4)
    assert str(Symbol("x")) == "x"
