"""The evaluation protocol: split, fit, evaluate; formulas and models of one's own against it; a registry of tools."""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ieee, metrics, ranges
from ..functions.chance import digest
from ..plans.indexed import Graph, evaluate
from ..plans.lower import bind_parameters, count_parameters, fold_constants, parameter_values
from ..plans.nodes import Expr, Symbol
from ..plans.parse import parse
from ..sources.dataset import Dataset
from . import nonlinear, split


@dataclass
class Evaluator:
    """Metrics of a formula on each split of a data set. Subclasses change split() or metrics()."""

    fraction: float = 0.2
    method: Callable = split.random
    options: dict = field(default_factory=dict)

    def split(self, data: Dataset) -> DataFrame:
        """The rows with a column `split`; fits see `train` alone."""
        return data.split(self.method, fraction=self.fraction, **self.options)

    def fit(self, data: Dataset, formula: Expr) -> nonlinear.FitResult:
        return nonlinear.fit(formula, self.split(data).filter("split = 'train'"), data.target)

    def metrics(self, y, p, k: int) -> list:
        return metrics.bundle(y, p, k)

    def evaluate(self, data: Dataset, formula: Expr) -> DataFrame:
        """One row for each split: all splits in one pass."""
        y, p = ieee.number(F.col(f"`{data.target}`")), formula.to_column()
        rows = self.split(data).select("split", y.alias("_y"), p.alias("_p"))
        return rows.groupBy("split").agg(*self.metrics(F.col("_y"), F.col("_p"), count_parameters(formula)))

    def fit_candidate(self, data: Dataset, text: str) -> tuple[Expr, nonlinear.FitResult]:
        """Unknown names become parameters, which are fitted on the train rows."""
        e = nonlinear.unknown_as_parameters(fold_constants(parse(text)), set(data.frame.columns))
        got = self.fit(data, e)
        return got.expression, got

    def evaluate_candidate(self, data: Dataset, text: str) -> dict:
        """formula, parameters, complexity, metrics by split, and whether it may stand as a candidate."""
        e, got = self.fit_candidate(data, text)
        by = {r["split"]: {k: v for k, v in r.asDict().items() if k != "split"} for r in self.evaluate(data, e).collect()}
        names = {x.name for x in e.iter_preorder() if isinstance(x, Symbol)}
        finite = all(m["mse"] is not None and math.isfinite(m["mse"]) for m in by.values())
        return {"formula": str(e), "parameters": parameter_values(e), "complexity": len(e), "metrics": by, "eligible": data.target not in names and finite, "fit": got}


@dataclass
class GraphEvaluator:
    """Formulas over a graph's samples: the latest samples are validated on; relations belong to both sides."""

    graph: Graph
    target: str
    fraction: float = 0.2

    def split(self) -> tuple[Graph, Graph]:
        samples = self.graph.nodes.select("sample").distinct()
        n = samples.count()
        bound = n - int(round(n * self.fraction))
        cut = None
        if 0 < bound < n:  # the first sample that is validated on
            share = bound / (n - 1)
            cut = ranges.order_statistics(samples, {"s": (F.col("sample"), [share])})["s"]["at"][share][0]
        keep = lambda early: F.col("sample") < cut if early else F.col("sample") >= cut

        def part(early: bool) -> Graph:
            if cut is None:
                return self.graph
            fields = {k: (r, df.filter(keep(early)) if "sample" in df.columns else df) for k, (r, df) in self.graph.fields.items()}
            return Graph(self.graph.num_nodes, self.graph.nodes.filter(keep(early)), self.graph.relations, fields, self.graph.scalars)

        return part(True), part(False)

    def evaluate(self, formula: Expr, *, parameters: dict | None = None) -> dict[str, dict]:
        out = {}
        for name, g in zip(("train", "validation"), self.split(), strict=True):
            keys = [c for c in evaluate(formula, g, parameters).columns if c != "value"]
            node = next(k for k in keys if k != "sample")
            truth = g.nodes.select(F.col("node").alias(node), *["sample"] * ("sample" in keys), F.col(self.target).cast("double").alias("_y"))
            got = evaluate(formula, g, parameters).join(truth, keys)
            out[name] = got.agg(*metrics.bundle(F.col("_y"), F.col("value"), count_parameters(formula))).first().asDict()
        return out

    def fit(self, formula: Expr, **options) -> nonlinear.FitResult:
        """All parameters of a formula, on the train samples."""
        return nonlinear.fit(formula, self.split()[0], self.target, **options)

    def fit_linear(self, formula: Expr, name: str) -> Expr:
        """One parameter that the formula is proportional to, by least squares on the train samples."""
        train, _ = self.split()
        one = evaluate(bind_parameters(formula, {name: 1.0}), train)
        keys = [c for c in one.columns if c != "value"]
        node = next(k for k in keys if k != "sample")
        truth = train.nodes.select(F.col("node").alias(node), *["sample"] * ("sample" in keys), F.col(self.target).cast("double").alias("_y"))
        r = one.join(truth, keys).agg(F.sum(F.col("value") * F.col("_y")).alias("b"), F.sum(F.col("value") * F.col("value")).alias("a")).first()
        return bind_parameters(formula, {name: r["b"] / r["a"]})


def evaluate_code(data: Dataset, model: Callable[[DataFrame], object], predict: Callable[[object, DataFrame], DataFrame], evaluator: Evaluator | None = None) -> dict:
    """A model of one's own: model(train rows) once, predict(model, rows without the target) for all rows, which must
    come back with `prediction`. A predict that asks for the target fails, and the model is not eligible."""
    rows = (evaluator or Evaluator()).split(data)
    fitted = model(rows.filter("split = 'train'").drop("split"))
    try:
        blind = predict(fitted, rows.withColumnsRenamed({data.target: "_hidden", "split": "_split"}))
        if not {"prediction", "_hidden", "_split"} <= set(blind.columns):
            raise ValueError("predict keeps its rows and adds prediction")
        bundle = metrics.bundle(ieee.number(F.col("_hidden")), ieee.number(F.col("prediction")), 0)
        scored = {r["_split"]: {k: v for k, v in r.asDict().items() if k != "_split"} for r in blind.groupBy("_split").agg(*bundle).collect()}
    except Exception as e:  # whatever a user's function raises is its result
        return {"eligible": False, "error": str(e)}
    return {"eligible": all(m["mse"] is not None and math.isfinite(m["mse"]) for m in scored.values()), "metrics": scored}


TOOLS: dict[str, dict] = {}
_JSON = {int: "integer", float: "number", str: "string", bool: "boolean", list: "array", dict: "object"}


def tool(fn: Callable) -> Callable:
    """Register a callable with a JSON schema read off its signature."""
    given = {n: p for n, p in inspect.signature(fn, eval_str=True).parameters.items()}
    TOOLS[fn.__name__] = {
        "call": fn,
        "description": inspect.getdoc(fn) or "",
        "schema": {"type": "object", "properties": {n: {"type": _JSON.get(p.annotation, "object")} for n, p in given.items()}, "required": [n for n, p in given.items() if p.default is p.empty]},
    }
    return fn


def call(name: str, **arguments) -> dict:
    """{ok, result or error}."""
    if name not in TOOLS:
        return {"ok": False, "error": f"no tool {name!r}"}
    if missing := [n for n in TOOLS[name]["schema"]["required"] if n not in arguments]:
        return {"ok": False, "error": f"missing arguments: {missing}"}
    try:
        return {"ok": True, "result": TOOLS[name]["call"](**arguments)}
    except Exception as e:  # a tool's failure is its result
        return {"ok": False, "error": f"{type(e).__name__}: {e}"}


def subsample(df: DataFrame, n: int, *, seed: int = 42, key: str | None = None) -> DataFrame:
    """n rows without replacement, in a random order that key and seed fix: a top-k, no global sort."""
    order = digest(F.col(key), seed) if key else F.rand(seed)
    return df.withColumn("_order", order).orderBy("_order").limit(n).drop("_order")
