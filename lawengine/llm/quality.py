"""Quality classifier: ordinal regression with cumulative links on graded ratings.

Grades: 0 for low quality, 1 for good quality but toxic, 2 for good quality and not toxic. One vector of weights
over hashed features of the text is shared by all grades; ordered thresholds cut its score:
P(grade <= k) = sigmoid(threshold_k - score). From them come the expected grade and the probability of the highest
grade, by which documents are chosen. Features: presence of each word (A-Z lower-cased, punctuation aside) that
`min_docs` training documents or more have, and the shape of the text (its length, and shares of capitals, digits,
symbols, bars, lines and repeated words), each in a few steps.

The model is fitted on a bounded sample of labelled rows (`sample` on average, however many rows a doc_id has here or
there); every document is scored on its whole text. Labels with a null in any column are not learned from. Without labels nothing is known, and every
document is of the highest grade. A null text is an empty one. Rows with one doc_id are judged each by its own
text; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, only_columns, place_of, trim, written

BITS = 18
SAMPLE = 8_000
GRADES = 3
_PLAIN = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_CAPITAL, _DIGIT, _SYMBOL, _LETTER = (
    np.array([chr(c) in s for c in range(256)])
    for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!#$%&*|~^<>{}[]\\=@_", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
)
_known: dict[bytes, int] = {}


def _bucket(word: bytes) -> int:
    if word not in _known:
        if len(_known) > 200_000:
            _known.clear()
        _known[word] = 256 + xxhash.xxh32_intdigest(word) % ((1 << BITS) - 256)
    return _known[word]


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers; those under 256 tell the shape of the text."""
    raw = (text or "").encode()
    words = raw.lower().translate(_PLAIN).split()
    out = set(map(_bucket, set(words)))
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, letters = max(1, len(raw)), max(1, int(n[_LETTER].sum()))
    shares = (
        n[_CAPITAL].sum() / letters,
        n[_DIGIT].sum() / size * 4,
        n[_SYMBOL].sum() / size * 4,
        n[ord("|")] / size * 20,
        n[ord("\n")] / size * 20,
        1 - len(set(words)) / max(1, len(words)),
        len(words) / size,
        np.log2(len(words) + 1) / 16,
    )
    out.update(16 * k + min(15, int(float(s) * 16)) for k, s in enumerate(shares))
    return np.array(sorted(out), dtype=np.int32)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k under the highest."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def train(rows: list[np.ndarray], grades: np.ndarray, *, min_docs: int = 4, rounds: int = 250, rate: float = 0.05, decay: float = 3e-4) -> Model:
    """Adam on the mean log likelihood; thresholds stay in order as the first and positive steps beyond it."""
    idx, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    used = np.bincount(idx, minlength=1 << BITS) >= min_docs
    live = used[idx]
    idx, owner = idx[live], owner[live]
    w, n = np.zeros(1 << BITS), len(rows)
    cut = np.array([-1.0] + [0.0] * (GRADES - 2))
    p = np.concatenate([w, cut])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        w, steps = p[: 1 << BITS], np.exp(p[(1 << BITS) + 1 :])
        theta = np.concatenate([[p[1 << BITS]], p[1 << BITS] + np.cumsum(steps)])
        score = np.bincount(owner, weights=w[idx], minlength=n)
        low = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(np.clip(score[:, None] - theta[None, :], -60, 60))), np.ones((n, 1))], axis=1)
        upper, lower = low[np.arange(n), grades + 1], low[np.arange(n), grades]
        chance = np.maximum(upper - lower, 1e-12)
        up, down = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        slope = (down - up) / n
        g_theta = np.array([(up[grades == k].sum() - down[grades == k + 1].sum()) / n for k in range(GRADES - 1)])
        g_cut = np.concatenate([[g_theta.sum()], steps * np.cumsum(g_theta[::-1])[::-1][1:]])
        g = np.concatenate([np.bincount(idx, weights=slope[owner], minlength=1 << BITS) - decay * w, g_cut])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    theta = np.concatenate([[p[1 << BITS]], p[1 << BITS] + np.cumsum(np.exp(p[(1 << BITS) + 1 :]))])
    return Model(np.where(used, p[: 1 << BITS], 0).astype(np.float32), theta)


def fit(documents: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model | None:
    known = only_columns(labels, "doc_id", "quality", "toxic").dropna()
    n = known.count()
    if not n:
        return None
    grade = F.when(F.col("quality") <= 0, 0).when(F.col("toxic") > 0, 1).otherwise(2)

    def dealt(df: DataFrame, rows: int) -> DataFrame:
        """`sample` rows on average, dealt row by row: a doc_id of many rows is no more likely than others."""
        share = int((1 << 30) * min(1.0, sample / max(rows, 1)))
        return df.filter(F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(1 << 30)) < share)

    some = dealt(known, n).select("doc_id", grade.alias("grade"))
    if n > sample:
        some = written(some, "label-sample")  # what is dealt out by place is dealt out once
    docs = only_columns(documents, "doc_id", "text")
    met = docs.join(F.broadcast(some), "doc_id")
    rows = docs.select("doc_id").join(F.broadcast(some), "doc_id").count()  # texts of one doc_id may be many
    met = (met if rows <= 2 * sample else dealt(met, rows)).select("grade", "text")

    def run(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column("grade"), pa.array([features(t.as_py()).tobytes() for t in b.column("text")], pa.binary())], ["grade", "features"])

    # the sample is bounded by its parameter, and so are the rows that come back
    met = met.mapInArrow(run, "grade int, features binary").toArrow()
    if not met.num_rows:
        return None
    return train([np.frombuffer(x, np.int32) for x in met.column("features").to_pylist()], met.column("grade").to_numpy().astype(int))


def _tails(texts, model: Model | None) -> np.ndarray:
    if model is None:
        return np.ones((len(texts), GRADES - 1))
    score = np.array([model.weights[features(t.as_py())].sum(dtype=np.float64) for t in texts])
    return model.tails(score)


def score(documents: DataFrame, model: Model | None, *, least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, p_top (probability of the highest grade) and kept (p_top >= least)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(it):
        for b in it:
            t = _tails(b.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(t.sum(1)), pa.array(t[:, -1]), pa.array(t[:, -1] >= least)], ["doc_id", "expected_grade", "p_top", "kept"])
            trim()

    docs = only_columns(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(run, "doc_id long, expected_grade double, p_top double, kept boolean")


def accepted(documents: DataFrame, model: Model | None, *, least: float = 0.5) -> DataFrame:
    """The rows of documents, all columns, whose probability of the highest grade is `least` or more."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def kept(texts: pa.Array) -> pa.Array:
        out = pa.array(_tails(texts, shared.value)[:, -1] >= least)
        trim()
        return out

    # only the texts go to Python, and a truth value for each comes back
    rows = numbered(documents)
    return rows.filter(kept(F.col(f"`#{place_of(documents, 'text')}`"))).toDF(*documents.columns)
