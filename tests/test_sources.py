import json

import numpy as np
import pytest

from lawengine.sources import dataset, manifest, npy


def store(folder, **changes):
    """Three stations, four pipes between them, pressure by hour, and the flow of each pipe by hour."""
    rng = np.random.default_rng(9)
    arrays = {"pressure": rng.uniform(1, 3, (6, 3)), "pipes": np.array([[0, 1], [1, 2], [2, 0], [0, 2]]), "flow": rng.uniform(0, 1, (6, 4)), "height": np.array([12.5, 3.0, 7.25])}
    for name, a in arrays.items():
        np.save(folder / f"{name}.npy", a)
    variables = {
        "pressure": {"file": "pressure.npy", "description": "bar", "axes": ["hour", "station"]},
        "pipes": {"file": "pipes.npy", "description": "from, to", "axes": ["pipe", "side"], "kind": "relation"},
        "flow": {"file": "flow.npy", "description": "litres", "axes": ["hour", "pipe"], "structure": "pipes"},
        "height": {"file": "height.npy", "description": "metres", "axes": ["station"]},
    }
    m = {"variables": variables, "axes": {"hour": {"values": [1, 2, 4, 8, 16, 32]}, "station": {"values": ["n", "s", "w"]}, "pipe": {"size": 4}, "side": {"size": 2}}, "num_nodes": 3}
    m.update(changes)
    (folder / "manifest.json").write_text(json.dumps(m))
    return arrays


def test_store(spark, tmp_path):
    arrays = store(tmp_path)
    report = manifest.inspect(str(tmp_path))
    assert report["ok"] and {n: v["shape"] for n, v in report["variables"].items()} == {n: list(a.shape) for n, a in arrays.items()}
    data = manifest.load(spark, str(tmp_path))
    assert sorted(tuple(r)[1:] for r in data["pipes"].collect()) == sorted(map(tuple, arrays["pipes"].tolist()))
    for name in ("pressure", "flow"):
        assert {(r["i0"], r["i1"]): r["value"] for r in data[name].collect()} == {i: v for i, v in np.ndenumerate(arrays[name])}
    manifest.update_descriptions(str(tmp_path), {"height": "above the sea"})
    assert manifest.inspect(str(tmp_path))["variables"]["height"]["description"] == "above the sea"
    assert [r["value"] for r in manifest.axis(spark, str(tmp_path), "hour").orderBy("ordinal").collect()] == [1, 2, 4, 8, 16, 32]


_AXES = {"hour": {"size": 6}, "station": {"size": 3}, "pipe": {"size": 4}, "side": {"size": 2}}


@pytest.mark.parametrize("changes,told", [({"num_nodes": 2}, "node numbers"), ({"num_nodes": None}, "num_nodes"), ({"owner": "me"}, "unknown key"), ({"axes": _AXES | {"spare": {"size": 1}}}, "no variable has it")])
def test_refusals(spark, tmp_path, changes, told):
    store(tmp_path, **changes)
    assert any(told in e for e in manifest.inspect(str(tmp_path))["errors"])
    with pytest.raises(manifest.ManifestError):
        manifest.load(spark, str(tmp_path))


def test_arrays(spark, tmp_path):
    a = np.asfortranarray(np.arange(6.0).reshape(2, 3))
    np.save(tmp_path / "a.npy", a)
    assert {(r["i0"], r["i1"]): r["value"] for r in npy.read(spark, str(tmp_path / "a.npy")).collect()} == {(i, j): a[i, j] for i in range(2) for j in range(3)}
    np.savez(tmp_path / "z.npz", x=np.array([1, 2]), s=np.array(["a", "b"]))
    got = npy.read_npz(spark, str(tmp_path / "z.npz"))
    assert [r["value"] for r in got["s"].orderBy("i0").collect()] == ["a", "b"]
    np.save(tmp_path / "o.npy", np.array([{}], dtype=object), allow_pickle=True)
    with pytest.raises(Exception, match="object"):
        npy.read(spark, str(tmp_path / "o.npy")).collect()


def test_columns_are_written_in_order(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "cast(id * id % 97 AS double) AS v", "concat('k', id % 13) AS s", "id % 2 = 0 AS b").repartition(6)
    for c in ("v", "s", "b", "id"):
        npy.write(df, str(tmp_path / f"{c}.npy"), c, "id")
    assert np.array_equal(np.load(tmp_path / "v.npy"), [float(i * i % 97) for i in range(1000)]) and np.load(tmp_path / "s.npy")[14] == "k1"
    assert np.load(tmp_path / "b.npy").dtype == bool and np.load(tmp_path / "id.npy").sum() == 499500


def test_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    p = dataset.csv_preview(spark, str(tmp_path / "t.csv"))
    assert p["numeric"] == {"a": True, "b": False} and len(p["rows"]) == 2 and not p["more"]
    assert dataset.table_files(str(tmp_path)) == ["t.csv"]
    dataset.write_result({"a": float("nan"), "b": np.int64(2)}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": None, "b": 2}
    df = dataset.synthetic(spark, "u / 2 - 4", {"u": (3, 5)}, 64)
    assert df.count() == 64 and df.filter("abs(u / 2 - 4 - y) > 1e-12 or u < 3 or u > 5").count() == 0


def test_npy_is_written_by_tasks(spark, tmp_path):
    """In order, of several partitions, of each kind; a null leaves nothing behind; a path with a scheme is read by Spark."""
    n = 5000
    df = spark.range(n).selectExpr("id * 7919 % 5003 AS k", "cast(id AS double) / 3 AS d", "id % 3 = 0 AS b", "concat('x', id % 17) AS s", "cast(id AS int) AS i").repartition(7)
    want = df.orderBy("k").toPandas()
    for c in "dbsi":
        path = str(tmp_path / f"{c}.npy")
        npy.write(df, path, c, "k")
        assert (np.load(path) == want[c].to_numpy()).all() and len(np.load(path)) == n
    npy.write(df.limit(0), str(tmp_path / "none.npy"), "d", "k")
    assert np.load(tmp_path / "none.npy").shape == (0,)
    with pytest.raises(Exception, match="null"):
        npy.write(df.selectExpr("k", "if(k = 9, null, d) AS d"), str(tmp_path / "null.npy"), "d", "k")
    assert sorted(f.name for f in tmp_path.iterdir()) == ["b.npy", "d.npy", "i.npy", "none.npy", "s.npy"]
    np.save(tmp_path / "m.npy", np.arange(12.0).reshape(3, 4, order="F"))
    own = {(r["i0"], r["i1"]): r["value"] for r in npy.read(spark, f"file://{tmp_path}/m.npy").collect()}
    assert own == {(i, j): float(i + 3 * j) for i in range(3) for j in range(4)}
    assert {(r["i0"], r["i1"]): r["value"] for r in npy._taken_apart(spark, f"file://{tmp_path}/m.npy").collect()} == own
