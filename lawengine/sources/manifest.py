"""A store of named arrays with a manifest: strict schema, all errors in one report, atomic edits of descriptions.

manifest.json holds `variables` (name -> file, description, axes[, kind, structure]), `axes` (name -> one of values,
file, size[, description]) and, if there are relations, `num_nodes`. A relation is an integer array of (rows, 2 or
3) node numbers; a structured variable has a value for each of a relation's rows along its last axis.
"""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import npy

ROOT_KEYS, VARIABLE_KEYS, AXIS_KEYS = {"variables", "axes", "num_nodes"}, {"file", "description", "axes", "kind", "structure"}, {"values", "file", "size", "description"}


class ManifestError(ValueError):
    pass


def _pairs(pairs):
    out: dict = {}
    for k, v in pairs:
        if k in out:
            raise ManifestError(f"key {k!r} occurs twice")
        out[k] = v
    return out


def inspect(folder: str) -> dict:
    """ok, errors, warnings, variables (shape, dtype, axes, kind, structure), axes (sizes) and num_nodes; never raises."""
    report: dict = {"ok": False, "errors": [], "warnings": [], "variables": {}, "axes": {}, "num_nodes": None}
    say = report["errors"].append
    base = Path(folder)
    try:
        m = json.loads((base / "manifest.json").read_text(), object_pairs_hook=_pairs)
    except (OSError, ValueError) as e:
        say(f"manifest.json: {e}")
        return report
    if not isinstance(m, dict) or not isinstance(m.get("variables"), dict) or not isinstance(m.get("axes", {}), dict):
        say("manifest.json: variables and axes are objects")
        return report
    for k in set(m) - ROOT_KEYS:
        say(f"manifest.json: unknown key {k!r}")
    _axes(base, m.get("axes", {}), report)
    arrays: dict[str, np.ndarray] = {}
    for name, v in m["variables"].items():
        _variable(base, name, v, report, arrays)
    _relations(m, arrays, report)
    used = {a for v in report["variables"].values() for a in v["axes"]}
    for a in report["axes"]:
        if a not in used:
            say(f"axis {a!r}: no variable has it")
    told = {f"{n}.npy" for n in m["variables"]} | {x.get("file") for x in m.get("axes", {}).values() if isinstance(x, dict)}
    report["warnings"] += [f"{p.name}: not in the manifest" for p in sorted(base.glob("*.npy")) if p.name not in told]
    report["ok"] = not report["errors"]
    return report


def _array(path: Path) -> np.ndarray | str:
    try:
        return np.load(path, mmap_mode="r", allow_pickle=False)
    except (OSError, ValueError) as e:
        return str(e)


def _axes(base: Path, axes: dict, report: dict) -> None:
    for name, a in axes.items():
        if not isinstance(a, dict) or set(a) - AXIS_KEYS or sum(k in a for k in ("values", "file", "size")) != 1:
            report["errors"].append(f"axis {name!r}: exactly one of values, file and size")
        elif "size" in a:
            if isinstance(a["size"], bool) or not isinstance(a["size"], int) or a["size"] < 1:
                report["errors"].append(f"axis {name!r}: size is a positive integer")
            else:
                report["axes"][name] = a["size"]
        elif "values" in a:
            if not isinstance(a["values"], list):
                report["errors"].append(f"axis {name!r}: values is a list")
            else:
                report["axes"][name] = len(a["values"])
        elif isinstance(x := _array(base / a["file"]), str) or x.ndim != 1:
            report["errors"].append(f"axis {name!r}: {x if isinstance(x, str) else 'not one-dimensional'}")
        else:
            report["axes"][name] = len(x)


def _variable(base: Path, name: str, v, report: dict, arrays: dict) -> None:
    say = lambda what: report["errors"].append(f"variable {name!r}: {what}")
    if not isinstance(v, dict) or set(v) - VARIABLE_KEYS or not {"file", "description", "axes"} <= set(v):
        return say("has file, description and axes, and may have kind and structure")
    if v["file"] != f"{name}.npy":
        say(f"its file is {name}.npy")
    x = _array(base / f"{name}.npy")
    if isinstance(x, str):
        return say(x)
    arrays[name] = x
    if x.ndim != len(v["axes"]):
        say(f"{x.ndim} dimensions, {len(v['axes'])} axes")
    for n, a in zip(x.shape, v["axes"], strict=False):
        if a not in report["axes"]:
            say(f"unknown axis {a!r}")
        elif report["axes"][a] != n:
            say(f"{n} values along {a!r}, which has {report['axes'][a]}")
    report["variables"][name] = {"shape": list(x.shape), "dtype": str(x.dtype), "axes": list(v["axes"]), "kind": v.get("kind", "variable"), "structure": v.get("structure"), "description": v["description"]}
    return None


def _relations(m: dict, arrays: dict, report: dict) -> None:
    say, own = report["errors"].append, report["variables"]
    relations = {n for n, v in own.items() if v["kind"] == "relation"}
    n = m.get("num_nodes")
    report["num_nodes"] = n
    if bool(relations) != (n is not None):
        say("num_nodes is given if, and only if, there are relations")
    elif n is not None and (isinstance(n, bool) or not isinstance(n, int) or n < 1):
        say("num_nodes is a positive integer")
        return
    for r in relations:
        x = arrays[r]
        if x.ndim != 2 or x.shape[1] not in (2, 3) or x.dtype.kind not in "iu":
            say(f"relation {r!r}: integers of shape (rows, 2) or (rows, 3)")
        elif n is not None and len(x) and (x.min() < 0 or x.max() >= n):
            say(f"relation {r!r}: node numbers are 0 to {n - 1}")
    for name, v in own.items():
        if v["structure"] is not None and (v["structure"] not in relations or not v["shape"] or v["shape"][-1] != len(arrays[v["structure"]])):
            say(f"variable {name!r}: its last axis has a value for each row of relation {v['structure']!r}")


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Each variable as rows of (i0.., value), each relation as (row_id, c0, c1[, c2]); all errors are raised together."""
    report = inspect(folder)
    if not report["ok"]:
        raise ManifestError("; ".join(report["errors"]))
    out = {}
    for name, v in report["variables"].items():
        df = npy.read(spark, str(Path(folder) / f"{name}.npy"))
        if v["kind"] == "relation":
            df = df.groupBy("i0").pivot("i1", list(range(v["shape"][1]))).max("value")
            df = df.toDF("row_id", *[f"c{k}" for k in range(v["shape"][1])])
        out[name] = df
    return out


def axis(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(ordinal, value) of an axis; a size counts from 0."""
    a = json.loads((Path(folder) / "manifest.json").read_text())["axes"][name]
    if "size" in a:
        return spark.range(a["size"]).selectExpr("id as ordinal", "id as value")
    values = a["values"] if "values" in a else np.load(Path(folder) / a["file"], allow_pickle=False).tolist()
    return npy.from_array(spark, np.asarray(values)).withColumnRenamed("i0", "ordinal")


def update_descriptions(folder: str, descriptions: dict[str, str]) -> None:
    """All or nothing: the manifest is replaced at once."""
    path = Path(folder) / "manifest.json"
    m = json.loads(path.read_text(), object_pairs_hook=_pairs)
    if missing := set(descriptions) - set(m["variables"]):
        raise ManifestError(f"no such variables: {sorted(missing)}")
    for name, text in descriptions.items():
        if not isinstance(text, str) or not text.strip():
            raise ManifestError(f"{name}: a description is a text")
        m["variables"][name]["description"] = text
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False) as f:
        json.dump(m, f, indent=2)
    os.replace(f.name, path)
