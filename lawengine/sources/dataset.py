"""Data sets in memory: a frame with roles of columns, derived features, splits that are kept until the data change;
readers and writers of tables; generators."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..plans.nodes import Expr, Symbol
from ..plans.parse import parse


@dataclass
class Dataset:
    frame: DataFrame
    target: str
    features: list[str] = field(default_factory=list)
    axes: dict[str, list[str]] = field(default_factory=dict)  # of a variable, the columns that place its values
    revision: int = 0
    _splits: dict = field(default_factory=dict)

    def __post_init__(self):
        self.features = self.features or [c for c in self.frame.columns if c != self.target]
        for c in [self.target, *self.features]:
            if c not in self.frame.columns:
                raise KeyError(f"no column {c!r}")

    @property
    def schema(self):
        return self.selected().schema

    def selected(self) -> DataFrame:
        """Features, target and their axes."""
        own = [*self.features, self.target]
        return self.frame.select(*dict.fromkeys([*own, *(a for v in own for a in self.axes.get(v, ()))]))

    def _changed(self) -> Dataset:
        self.revision += 1
        self._splits.clear()
        return self

    def commit_data(self, frame: DataFrame, target: str, features: list[str] | None = None) -> Dataset:
        self.frame, self.target, self.features = frame, target, features or []
        self.__post_init__()
        return self._changed()

    def add_features(self, formulas: dict[str, Expr | str]) -> Dataset:
        new = {n: (parse(f) if isinstance(f, str) else f).to_column() for n, f in formulas.items()}
        self.frame = self.frame.withColumns(new)
        self.features += [n for n in new if n not in self.features]
        return self._changed()

    def update_selection(self, features: list[str], target: str | None = None) -> Dataset:
        self.target, self.features = target or self.target, list(features)
        self.__post_init__()
        return self._changed()

    def split(self, method, **options) -> DataFrame:
        key = (method.__name__, json.dumps(options, sort_keys=True))
        if key not in self._splits:
            self._splits[key] = method(self.frame, **options)
        return self._splits[key]

    def train_split(self, method, **options) -> DataFrame:
        return self.split(method, **options).filter("split = 'train'").drop("split")

    def validation_split(self, method, **options) -> DataFrame:
        return self.split(method, **options).filter("split = 'validation'").drop("split")

    def semi(self, keys: DataFrame, on: str) -> Dataset:
        """Only rows whose key is among keys."""
        return Dataset(self.frame.join(keys.select(on).distinct(), on, "left_semi"), self.target, list(self.features))

    def anti(self, keys: DataFrame, on: str) -> Dataset:
        return Dataset(self.frame.join(keys.select(on).distinct(), on, "left_anti"), self.target, list(self.features))


def csv_preview(spark: SparkSession, path: str, rows: int = 100) -> dict:
    """Names, whether each column is a number, and the first rows (5 to 1000) of a CSV file or a sheet."""
    if not 5 <= rows <= 1000:
        raise ValueError("a preview has 5 to 1000 rows")
    if path.endswith((".xlsx", ".xls")):
        import pandas as pd

        df = spark.createDataFrame(pd.read_excel(path, nrows=rows + 1))
    else:
        df = spark.read.csv(path, header=True, inferSchema=True).limit(rows + 1)
    got = df.collect()
    if len(df.columns) < 2 or len(set(df.columns)) < len(df.columns) or not got:
        raise ValueError("a table has two columns or more, of different names, and a row")
    return {"columns": df.columns, "numeric": {c: t in ("int", "bigint", "double", "float") for c, t in df.dtypes}, "rows": [r.asDict() for r in got[:rows]], "more": len(got) > rows}


def table_files(folder: str) -> list[str]:
    return sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("*") if p.suffix.lower() in (".csv", ".xlsx", ".xls"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_result(result: dict, path: str) -> None:
    """One result as JSON; numbers that JSON has no form for are null."""

    def plain(v):
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        if isinstance(v, float) and not math.isfinite(v):
            return None
        return v.item() if isinstance(v, np.generic) else v

    Path(path).write_text(json.dumps(plain(result), indent=2))


def synthetic(spark: SparkSession, formula: str, features: dict[str, tuple[float, float]], n: int = 200, *, noise: float = 0.0, seed: int = 0, target: str = "y") -> DataFrame:
    """Uniform features, the formula's value, and noise of a share of its spread."""
    df = spark.range(n).select("id", *[(F.rand(seed + k) * (hi - lo) + lo).alias(f) for k, (f, (lo, hi)) in enumerate(sorted(features.items()))])
    df = df.withColumn(target, parse(formula).to_column())
    if noise:
        spread = df.agg(F.stddev_pop(target)).first()[0] or 0.0
        df = df.withColumn(target, F.col(target) + F.randn(seed + 1000) * float(noise * spread))
    return df


DEMOS = ("quadratic_surface", "decay_by_material", "forced_relaxation", "ring_diffusion")


def demo(spark: SparkSession, kind: str, rows: int = 240):
    """Small data sets of known laws, made by Spark and the same on every run; for ring_diffusion, (states, edges).

    quadratic_surface: w = 3 - u v / 2 + v^2. decay_by_material: m = a exp(-k t), k by material. forced_relaxation: a series of
    dx/dt = cos(2 t) / 2 - 4 x / 5 in closed form. ring_diffusion: du/dt = sum of (neighbour - u) / 4 on a ring of 12 nodes, the
    state being one of its waves, which only fades.
    """
    at = lambda k: F.pmod(F.col("id") * F.lit((math.sqrt(k) % 1.0) + 0.1), F.lit(1.0))
    ids = spark.range(rows)
    if kind == "quadratic_surface":
        return ids.select(*[(4 * at(k) - 2).alias(n) for n, k in (("u", 2), ("v", 3))]).withColumn("w", parse("3 - 0.5 * u * v + v**2").to_column())
    if kind == "decay_by_material":
        names, rates = ["glass", "steel", "wood"], {"glass": 0.2, "steel": 1.1, "wood": 0.6}
        df = ids.select((1 + at(2)).alias("a"), (3 * at(3)).alias("t"), F.get(F.array(*map(F.lit, names)), (F.col("id") % 3).cast("int")).alias("material"))
        k = F.element_at(F.create_map(*[F.lit(v) for n in names for v in (n, rates[n])]), F.col("material"))
        return df.withColumn("m", F.col("a") * F.exp(-k * F.col("t")))
    if kind == "forced_relaxation":
        t = F.col("id") / 20
        wave = (0.8 * F.cos(2 * t) + 2 * F.sin(2 * t)) * (0.5 / (0.8 * 0.8 + 4))
        return ids.select(t.alias("t"), (wave + F.exp(-0.8 * t)).alias("x")).withColumn("dx", parse("0.5 * cos(2 * t) - 0.8 * x").to_column())
    if kind == "ring_diffusion":
        n, turn = 12, 2 * math.pi / 12
        fade = 2 * 0.25 * (1 - math.cos(turn))
        states = ids.select(F.col("id").alias("sample"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("node"))
        states = states.withColumn("u", F.cos(F.col("node") * turn) * F.exp(F.col("sample") / 10 * -fade)).withColumn("du", -fade * F.col("u"))
        edges = spark.range(2 * n).select(F.col("id").alias("row_id"), (F.col("id") % n).alias("target"), F.pmod(F.col("id") % n + F.when(F.col("id") < n, 1).otherwise(n - 1), F.lit(n)).alias("source"))
        return states, edges
    raise ValueError(f"no demo {kind!r}: one of {DEMOS}")


def load_problems(spark: SparkSession, folder: str, split: str, samples: dict[str, DataFrame] | None = None) -> list[dict]:
    """Benchmark problems from the Parquet tables `<folder>/data/<split>-*` (name, symbols, symbol_descs, symbol_properties, expression).

    A row is a problem, and problems are few. Expressions are written in this language: `P(t)` as P, `^` as a power, and pi and e
    as numbers where they aren't symbols. A problem with other names is left out. samples: a frame for each name, with a
    column for each symbol, the target first; then r2 of the true law over it is told, too. HDF5 isn't read.
    """
    rows = spark.read.parquet(f"{folder.rstrip('/')}/data/{split}-*").select("name", "symbols", "symbol_descs", "symbol_properties", "expression").orderBy("name").collect()
    out = []
    for r in rows:
        text = r["expression"]
        for s in r["symbols"]:
            text = re.sub(rf"\b{re.escape(s)}\(t\)", s, text)
        for name, value in (("pi", math.pi), ("e", math.e)):
            if name not in r["symbols"]:
                text = re.sub(rf"\b{name}\b", repr(value), text)
        law = parse(text.replace("^", "**"))
        if {x.name for x in law.iter_preorder() if isinstance(x, Symbol)} - set(r["symbols"]):
            continue
        problem = r.asDict() | {"law": law, "target": r["symbols"][0]}
        if samples and r["name"] in samples:
            df = samples[r["name"]]
            problem["r2"] = df.agg(metrics.r2(F.col(f"`{r['symbols'][0]}`"), law.to_column()).alias("r2")).first()["r2"]
        out.append(problem)
    return out
