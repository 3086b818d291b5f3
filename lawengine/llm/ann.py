"""Nearest neighbours by cosine, with randomly rotated one-bit codes.

Index: each unit vector is rotated by one random orthogonal matrix and kept as the packed signs of its components
and one scalar, its inner product with its own sign vector. The inner product with a query is estimated from bits
and scalar, and is within an error bound that depends on the scalar. Every row is indexed; nothing is fitted.

Search: queries are taken in blocks of bounded size. A bounded sample of rows (`sample` on average) gives each query of a
block a floor: the score of its k-th best row there, which no worse row need beat. Each task walks over its rows,
reranks by the exact cosine those whose upper bound reaches the floor, raises the floor as better rows are met, and
hands on k rows a query at most. Of rows with one and the same vector only the k + 1 smallest ids can be among the
nearest, so of a hot vector only those are scored.

Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part,
nor do rows without an id. Rows of one id are one another's own row; the first of them asks. An empty table gives
no rows. With fewer than k other rows, all of them are returned. Scores are cosines in double precision, summed in NumPy's
order of summation over a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, only_columns, written

#: Standard errors of the estimate that the bound allows for.
EPSILON = 3.0
BLOCK = 8_192
SAMPLE = 8_192


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def encode(vectors: np.ndarray, rotate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs and the correction scalar of each vector."""
    unit = vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))
    turned = unit.astype(np.float32) @ rotate.T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / np.sqrt(vectors.shape[1])


def bounds(bits: np.ndarray, scalar: np.ndarray, turned: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimates (rows x queries) of the cosine and how far above it may be (rows); turned: rotated unit queries."""
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    scalar = np.maximum(scalar, 1e-6).astype(np.float32)
    error = EPSILON * np.sqrt(np.maximum(1 - scalar**2, 0) / scalar**2 / max(dim - 1, 1))
    return (signs @ turned.T) / (np.float32(np.sqrt(dim)) * scalar)[:, None], error + 1e-5


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; the same pair gives the same bits wherever it stands."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    new = np.r_[True, query[1:] != query[:-1]] if len(query) else np.empty(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(query)), 0)) if len(query) else np.empty(0, int)
    keep = np.arange(len(query)) - first < k
    return query[keep], ids[keep], score[keep]


def _distinct(ids: np.ndarray, vectors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different vectors, and for each the smallest ids with it: (vectors, owner, ids), and where each was first."""
    _, first, back = np.unique(np.ascontiguousarray(vectors).view(f"V{vectors.shape[1] * vectors.itemsize}").ravel(), return_index=True, return_inverse=True)
    owner, kept, _ = best(back.ravel(), ids, np.zeros(len(ids)), most)
    return vectors[first], owner, kept, first


#: Pairs that are scored at a time; bounds a task's memory.
PAIRS = 32_768


class _Best:
    """The k best rows of each query so far, and the floor that a row must reach."""

    def __init__(self, qid: np.ndarray, qvec: np.ndarray, floor: np.ndarray, k: int):
        self.qid, self.qvec, self.floor, self.k = qid, qvec, floor.copy(), k
        self.rows = best(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), k)

    def score(self, vectors: np.ndarray, starts: np.ndarray, kept: np.ndarray, row: np.ndarray, query: np.ndarray) -> None:
        """Exact scores of pairs of a vector and a query; kept[starts[row] : starts[row + 1]] are the vector's ids."""
        for lo in range(0, len(row), PAIRS):
            r, q = row[lo : lo + PAIRS], query[lo : lo + PAIRS]
            exact = cosine(vectors[r], self.qvec[q])
            good = exact >= self.floor[q]
            r, q, exact = r[good], q[good], exact[good]
            many = starts[r + 1] - starts[r]
            pair = np.repeat(np.arange(len(r)), many)
            ids = kept[starts[r[pair]] + np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)]
            other = ids != self.qid[q[pair]]
            pair, ids = pair[other], ids[other]
            self.rows = best(np.r_[self.rows[0], q[pair]], np.r_[self.rows[1], ids], np.r_[self.rows[2], exact[pair]], self.k)
            q, _, exact = self.rows
            if len(q):
                last = np.flatnonzero(np.r_[q[1:] != q[:-1], True])
                full = np.bincount(q, minlength=len(self.qid))[q[last]] >= self.k
                self.floor[q[last[full]]] = np.maximum(self.floor[q[last[full]]], exact[last[full]])


def _walk(batches, dim: int, rotate: np.ndarray, qid: np.ndarray, qvec: np.ndarray, floor: np.ndarray, k: int):
    """(query, id, score) of the k best rows of each query. In each step the rows of the best estimates are scored
    first, since they raise the floor; then all others whose upper bound still reaches it."""
    turned = (qvec / np.sqrt((qvec.astype(np.float64) ** 2).sum(1, keepdims=True))).astype(np.float32) @ rotate.T
    found = _Best(qid, qvec, floor, k)
    step = max(16, 1_000_000 // max(1, len(qid)))
    for ids, bits, scalar, vectors in batches:
        own, owner, kept, code = _distinct(ids, vectors, k + 1)
        starts = np.searchsorted(owner, np.arange(len(own) + 1))
        for lo in range(0, len(own), step):
            part = code[lo : lo + step]
            estimate, error = bounds(bits[part], scalar[part], turned, dim)
            top = np.argpartition(-estimate, min(k, len(part) - 1), axis=0)[: k + 1]
            upper = estimate + error[:, None]
            query = np.broadcast_to(np.arange(len(qid)), top.shape)
            ask = upper[top, query] >= found.floor[None, :]
            found.score(own, starts, kept, top[ask] + lo, query[ask])
            upper[top, query] = -np.inf
            row, query = np.nonzero(upper >= found.floor[None, :])
            found.score(own, starts, kept, row + lo, query)
    return found.rows


def _arrays(b: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    def fixed(name: str, kind: str, width: int) -> np.ndarray:
        return np.frombuffer(b"".join(b.column(name).to_pylist()), kind).reshape(-1, width)

    return b.column("vec_id").to_numpy(zero_copy_only=False), fixed("bits", np.uint8, -(-dim // 8)), b.column("scalar").to_numpy(zero_copy_only=False), fixed("vector", np.float64 if b.column("wide")[0].as_py() else np.float32, dim)


def index(rows: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame | None, int]:
    """(vec_id, bits, scalar, vector, wide) of every row that takes part, stored, and the length of the vectors."""
    rows = only_columns(rows, id_column, vector_column).toDF("vec_id", "vector").filter(F.col("vec_id").isNotNull() & (F.size("vector") > 0))
    wide = "double" in dict(rows.dtypes)["vector"]
    common = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    if common is None:
        return None, 0
    dim, kind = common["n"], np.float64 if wide else np.float32
    rotate = rotation(dim)
    fit = rows.filter((F.size("vector") == dim) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0))

    def run(it):
        for b in it:
            if b.num_rows:
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
                bits, scalar = encode(v.astype(np.float64), rotate)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(scalar.astype(np.float32)), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([wide] * len(v))], ["vec_id", "bits", "scalar", "vector", "wide"])

    stored = fit.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").mapInArrow(run, "vec_id long, bits binary, scalar float, vector binary, wide boolean")
    return written(stored, "vector-codes"), dim


def search(rows: DataFrame, asks: Column, *, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of all rows for each row where asks (a condition on vec_id) holds."""
    spark = rows.sparkSession
    out = "query_id long, vec_id long, score double"
    coded, dim = index(rows, id_column=id_column, vector_column=vector_column)
    if coded is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rotate, kind = rotation(dim), None
    n, n_queries = coded.agg(F.count("*"), F.count_if(asks)).first()
    chance = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1 << 30))
    some = coded.filter(chance < int((1 << 30) * min(1.0, sample / max(n, 1)))).toArrow()
    floor_rows = [_arrays(b, dim) for b in some.to_batches() if b.num_rows]
    queries = coded.filter(asks).groupBy("vec_id").agg(F.min("vector").alias("vector"), F.first("wide").alias("wide"))
    blocks = max(1, -(-n_queries // block))
    found = []
    for i in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).toArrow()
        if not own.num_rows:
            continue
        kind = np.float64 if own.column("wide")[0].as_py() else np.float32
        qid = own.column("vec_id").to_numpy()
        qvec = np.frombuffer(b"".join(own.column("vector").to_pylist()), kind).reshape(-1, dim)
        shared = spark.sparkContext.broadcast((qid, qvec, floor_rows))

        def floors(shared=shared):
            qid, qvec, floor_rows = shared.value
            q, _, score = _walk(floor_rows, dim, rotate, qid, qvec, np.full(len(qid), -2.0), k)
            floor, count = np.full(len(qid), -2.0), np.bincount(q, minlength=len(qid))
            worst = np.full(len(qid), 2.0)
            np.minimum.at(worst, q, score)
            floor[count >= k] = worst[count >= k]
            return floor

        def run(it, shared=shared, floors=floors):
            qid, qvec, _ = shared.value
            batches = (_arrays(b, dim) for b in it if b.num_rows)
            q, ids, score = _walk(batches, dim, rotate, qid, qvec, floors(), k)
            yield pa.RecordBatch.from_arrays([pa.array(qid[q], pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], ["query_id", "vec_id", "score"])

        # one block after the other: neither the driver nor the plan holds more than one
        rows_near = written(coded.mapInArrow(run, out).distinct(), "near-rows")
        found.append(written(_ranked(rows_near, k), "nearest"))
        discard(rows_near)
        shared.destroy()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    discard(coded)
    near = found[0]
    for f in found[1:]:
        near = near.unionByName(f)
    return near


def _ranked(near: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
