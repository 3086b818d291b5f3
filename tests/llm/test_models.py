"""Class-based language model, source divergence, centroid clustering: against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lawengine.llm import centroids, class_lm, divergence, queries

LONG = "lorem ipsum dolor " * 20_000
ODD = [(5, None, None, None), (1, "", "en", "a"), (2, "One two THREE four", "en", "a"), (3, "one two three four", "en", "b"), (3, "one two three four", "en", "b"), (None, "no id one", "en", "c"), (7, LONG, "de", "a"), (8, "Ünïcode 日本 \x00 text", "de", "b"), (9, "  \n\t ", "fr", "a"), (10, "123 |", "fr", "b")]


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, held_out string, n long")


def same_as_sql(spark, sf, name, table):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf)
    assert sorted(want.columns) == sorted(got.columns)
    key = lambda rows, names: sorted(tuple(str(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in rows)
    assert key(got.collect(), got.columns) == key(want.fetchall(), want.columns)


# 11


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def plain_base(rows):
    c = Counter(w for k, t in rows if not is_held(k) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return c, n, sorted((str(k), is_held(k), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for k, t in rows)


def flat(df):
    return sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in df.collect())


@pytest.mark.parametrize("frequent", [40, 1000, class_lm.FREQUENT])
def test_base_scores(spark, sf, frequent):
    real = spark.read.parquet(f"{sf}/documents.parquet")
    got = class_lm.score(real, frequent=frequent, rounds=2)
    assert flat(got) == plain_base([(r["doc_id"], r["text"]) for r in real.collect()])[2]
    held = got.filter("held_out")
    assert held.count() and class_lm.perplexity(held) < class_lm.perplexity(held, "base_score")


def test_scores_odd(spark):
    for frequent in (3, 1000):
        got = class_lm.score(docs(spark, ODD), frequent=frequent, classes=4, rounds=2)
        assert flat(got) == plain_base([r[:2] for r in ODD])[2]
        assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got.collect())
    assert class_lm.score(docs(spark, []), classes=4).count() == 0
    ids = [k for k in range(100) if is_held(k)][:3]
    unknown = class_lm.score(docs(spark, [(k, "new words", None, None) for k in ids]), classes=4).collect()
    assert len(unknown) == 3 and all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 and r["score"] == 0 for r in unknown)
    with pytest.raises(ValueError):
        class_lm.score(docs(spark, ODD), classes=127)


def test_exchange_parts_words_by_their_neighbours(spark):
    """Two kinds of words that always take turns end in different classes, and frequent and other words follow one rule."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"{'ab'[k % 2]}{rng.integers(0, 30)}" for k in range(40)), None, None) for i in range(60)]
    df = docs(spark, rows).select("doc_id", "text").withColumn("held_out", F.lit(False))
    known = class_lm.learn_words(df, frequent=40)
    coded = class_lm.encoded(df, known)
    classes, moves = class_lm.learn_classes(coded, 40, k=2, rounds=12)
    of = dict(zip(known.frequent.to_pylist(), classes.tolist(), strict=True))
    assert len({(w[0], c) for w, c in of.items()}) == 2 and len(set(of.values())) == 2
    rest = class_lm.learn_rest(coded, classes, moves).collect()
    assert len(rest) == 60 - 40 and sum(r["n"] for r in rest) + known.counts.sum() == 60 * 40
    assert Counter(r["class"] for r in rest) == Counter(of[f"{'ab'[k]}{next(i for i in range(30) if f'{"ab"[k]}{i}' in of)}"] for k in range(2) for i in range(30) if f"{'ab'[k]}{i}" not in of)


def test_scores_equal_plain_ones(spark, sf):
    """The whole model from its classes, in plain Python: transitions with half words, shares, sums; shares sum to one."""
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60).withColumn("held_out", class_lm.held_out(F.col("doc_id")))
    known, k = class_lm.learn_words(df.filter("not held_out"), frequent=300), 5
    coded = class_lm.encoded(df, known)
    train = coded.filter("not held_out")
    classes, moves = class_lm.learn_classes(train, len(known.frequent), k=k, rounds=2)
    rest = class_lm.learn_rest(train, classes, moves)
    seq = class_lm.as_classes(coded, rest, known, classes, k)
    model = class_lm.learn_transitions(seq.filter("not held_out"), k)
    got = {r["doc_id"]: r["score"] for r in class_lm.scored(seq, model, known).collect()}
    rows = [(r["doc_id"], tokens(r["text"])[:-1], r["held_out"]) for r in df.collect()]
    count = Counter(w for _, t, held in rows if not held for w in t)
    import xxhash

    by_hash = {r["h"]: r["class"] for r in rest.collect()}
    of = dict(zip(known.frequent.to_pylist(), classes.tolist(), strict=True))
    cls = lambda w: "edge" if w is None else "new" if not count[w] else of.get(w, by_hash.get(xxhash.xxh64_intdigest(w) - (1 << 63)))
    parts = lambda w: [(cls(w), 0.5), ("new", 0.5)] if w is not None and count[w] == 1 else [(cls(w), 1.0)]
    n, size = defaultdict(float), defaultdict(float)
    for _, t, held in rows:
        if not held:
            for a, b in zip([None, *t], [*t, None], strict=True):
                for (x, p) in parts(a):
                    for (y, q) in parts(b):
                        n[x, y] += p * q
    # edges between documents stand once, before the first and after the last as well
    for _, t, held in rows:
        if not held:
            for w in t:
                size[cls(w)] += 1.0 if count[w] > 1 else 0.5
    names = [*range(k), "new", "edge"]
    into = {b: sum(n[a, b] for a in names) for b in names}
    all_ = sum(into.values())
    share = {b: (into[b] + 0.5) / (all_ + 0.5 * len(names)) for b in names}
    step = lambda a, b: (n[a, b] + class_lm.STRENGTH * share[b]) / (sum(n[a, c] for c in names) + class_lm.STRENGTH)
    assert all(abs(sum(step(a, b) for b in names) - 1) < 1e-9 for a in names)
    memo = {(a, b): math.log10(step(a, b)) for a in names for b in names}
    for k_, t, _ in rows:
        want = sum(memo[cls(a), cls(b)] for a, b in zip([None, *t], [*t, None], strict=True))
        want += sum(math.log10((count[w] if count[w] > 1 else 0.5) / size[cls(w)]) for w in t if count[w])
        assert abs(got[k_] - want) < 1e-6 * abs(want)


# 12


def test_divergence_equals_sql(spark, sf):
    same_as_sql(spark, sf, "op12_divergence", "documents")


def test_divergence_odd(spark, tmp_path):
    """Null, empty, repeated and long texts, languages without terms and of one source, ties: all as in SQL."""
    more = [(20 + i, f"alpha beta {'gamma ' * i} Δελτα", "en", s) for i, s in enumerate(["a", "b", "c", "a", "b", "c", ""])] + [(40, "solo solo", "it", "x"), (41, "solo", "it", "x"), (42, "SOLO", "it", "x")]
    df = docs(spark, ODD + more)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.oracle_sql()["op12_divergence"])
    got = divergence.audit(df)
    order = lambda rows: sorted(map(str, (tuple(r) for r in rows)))
    assert order(got.select(*want.columns).collect()) == order(want.fetchall())
    assert got.filter("lang = 'fr' and value = 0").count() == 2 and got.filter("lang = 'it' and part = 'pair'").count() == 0
    assert divergence.audit(docs(spark, [])).count() == 0


def test_slices_end_where_terms_do():
    rows = [("en", f"w{i // 7:03d}") for i in range(700)] + [("fr", "w099")] * 50  # sorted by term, then lang
    batches = pa.Table.from_pylist([{"lang": a, "term": b} for a, b in rows]).to_batches(max_chunksize=10)
    parts = [p.to_pylist() for p in divergence.slices(iter(batches), 25)]
    assert [tuple(r.values()) for p in parts for r in p] == rows and len(parts) > 20
    assert all(tuple(a[-1].values()) != tuple(b[0].values()) for a, b in zip(parts, parts[1:], strict=False))


def test_counts_of_a_task_are_of_its_own_documents(spark):
    got = divergence.counts(docs(spark, [(1, "a A b", "en", "s"), (2, "a", "en", "s"), (3, "", "en", "t")]).coalesce(1)).collect()
    assert sorted((r["source"], r["term"], r["n"], r["docs"]) for r in got) == [("s", "", 0, 0), ("s", "a", 3, 2), ("s", "b", 1, 1), ("t", "", 0, 0)]


# 13


def test_centroids_equal_sql(spark, sf):
    same_as_sql(spark, sf, "op13_centroids", "embeddings")


def plain_clusters(rows, clusters, rounds, dim):
    kept = [(i, [min(max(math.floor(64 * x), -centroids.LARGEST), centroids.LARGEST) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()))[:clusters]
    c = [v for _, v in starts]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), k) for k, m in enumerate(c))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        c = [[sum(x) // len(own[k]) for x in zip(*own[k], strict=True)] if own[k] else m for k, m in enumerate(c)]
    at = [(i, *near(v)[::-1]) for i, v in kept]
    total, each = sum(d for _, _, d in at), Counter()
    for _, k, d in at:
        each[k] += d
    return sorted(((i, k, d, each[k], total, hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for i, k, d in at), key=str)


def test_centroids_odd(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, 6).round(2).tolist()) for i in range(300)]
    rows += [(i, [0.5] * 6) for i in range(400, 500)]  # a hot vector
    rows += [(600, None), (601, []), (602, [1.0] * 5), (603, [1.0] * 5 + [None]), (604, [math.nan] * 6), (605, [math.inf] + [0.0] * 5), (606, [1e300] + [0.0] * 5), (None, [9.0] * 6), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<double>, cluster string, v int")
    for clusters in (1, 5, 16):
        got = centroids.clustered(df.repartition(5), clusters=clusters, dim=6)
        names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert sorted(map(tuple, got.select(*names).collect()), key=str) == plain_clusters(rows, clusters, 3, 6)
    assert centroids.clustered(df.limit(0), dim=6).count() == 0
    assert {r["distance"] for r in centroids.clustered(df.limit(4), clusters=16, dim=6).collect()} == {0}


def test_partial_distances_give_the_full_search():
    rng = np.random.default_rng(3)
    for dim in (1, 7, 8, 64):
        rows, cents = rng.integers(-5, 6, (500, dim)), rng.integers(-5, 6, (16, dim))
        cents[3] = cents[9]  # a tie for every row
        number, distance = centroids.nearest(rows, cents, rng.permutation(dim))
        full = ((rows[:, None] - cents[None]) ** 2).sum(2)
        assert (number == full.argmin(1)).all() and (distance == full.min(1)).all()
