"""Language identification as inference in a mixture.

Training: from a bounded sample of documents of known language, the counts of n-grams (three bytes of the lower-cased
text, anything but letters taken as a space) give each language a smoothed multinomial over hashed n-grams.
Inference: a document is a mixture of languages; expectation-maximisation finds the proportions that make its
n-grams likeliest. The set of languages is then reduced: the one of the least proportion is left out as long as
the penalised likelihood (log likelihood less half the logarithm of the number of n-grams for each language) gains.
The answer is the language of the largest proportion (of equal ones the first by name); its proportion is the score.

A null text, or one without a letter, is `und` with score 0, as is every text if nothing is known of any language.
Rows with one doc_id are judged each by its own text. An empty table gives no rows. Columns other than doc_id, text
and, for training, lang are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only_columns

BUCKETS = 1 << 15
#: Documents of each language that are learned from, on average, dealt row by row; a language with fewer is learned whole.
SAMPLE = 3_000
UNKNOWN = "und"
_SPACE = np.arange(256, dtype=np.uint8)
_SPACE[[c for c in range(128) if not chr(c).isalpha()]] = 32


def grams(text: bytes) -> np.ndarray:
    """Hashed three-byte grams of a lower-cased text; those of white space and at most one letter's byte are left out."""
    b = _SPACE[np.frombuffer(b" " + text + b" ", np.uint8)]
    if len(b) < 3:
        return np.empty(0, np.int64)
    x = b.astype(np.uint32)
    gap = (b == 32).view(np.uint8)
    keep = gap[:-2] + gap[1:-1] + gap[2:] < 2
    return ((((x[:-2] << 16) | (x[1:-1] << 8) | x[2:]) * np.uint32(2654435761)) >> np.uint32(17))[keep].astype(np.int64)


def learn(documents: DataFrame, *, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, and the probabilities of the n-grams in each (BUCKETS x languages)."""
    known = only_columns(documents, "doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    n = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(n)
    if not langs:
        return [], np.empty((BUCKETS, 0))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, int((1 << 30) * min(1.0, sample / n[lang])))])
    some = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample"), F.monotonically_increasing_id()), F.lit(1 << 30)) < F.element_at(share, F.col("lang")))

    def count(it):
        total: dict[str, np.ndarray] = {}
        for b in it:
            for text, lang in zip(pc.utf8_lower(b.column("text")), b.column("lang"), strict=True):
                g = np.bincount(grams(text.as_buffer().to_pybytes()), minlength=BUCKETS)
                key = lang.as_py()
                total[key] = total[key] + g if key in total else g
        for lang, g in total.items():
            at = np.flatnonzero(g)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(g[at], pa.int64())], ["lang", "gram", "n"])

    counted = some.select("text", "lang").mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    p = np.full((BUCKETS, len(langs)), 0.5)
    place = {lang: i for i, lang in enumerate(langs)}
    np.add.at(p, (counted.column("gram").to_numpy(), np.array([place[x] for x in counted.column("lang").to_pylist()], dtype=int)), counted.column("n").to_numpy())
    return langs, p / p.sum(0)


def proportions(p: np.ndarray, c: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Mixture weights of the columns of p (n-grams x languages) for counts c, and the log likelihood."""
    total, w = c.sum(), np.full(p.shape[1], 1 / p.shape[1])
    if p.shape[1] == 1:
        return w, float(c @ np.log(p[:, 0]))
    for _ in range(rounds):
        mix = p @ w
        new = w * ((c / mix) @ p) / total
        done = np.abs(new - w).max() < 1e-3
        w = new
        if done:
            break
    return w, float(c @ np.log(p @ w))


def infer(text: bytes, p: np.ndarray) -> np.ndarray:
    """Proportions of all languages in a lower-cased text; zero for those left out, and all zero without n-grams."""
    out = np.zeros(p.shape[1])
    seen, c = np.unique(grams(text), return_counts=True)
    if not len(seen) or not p.shape[1]:
        return out
    rows, live = p[seen], np.arange(p.shape[1])
    w, fit = proportions(rows, c)
    penalty = 0.5 * np.log(c.sum() + 1)
    while len(live) > 1:
        less = np.delete(np.arange(len(live)), len(w) - 1 - w[::-1].argmin())  # of equal ones the last by name
        w2, fit2 = proportions(rows[:, live[less]], c)
        if fit2 + penalty < fit:
            break
        live, w, fit = live[less], w2, fit2
    out[live] = w
    return out


def predict(documents: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score and mixture (map of languages to proportions) for each document."""
    langs, p = model
    shared = documents.sparkSession.sparkContext.broadcast(p)

    def run(it):
        for b in it:
            texts = pc.fill_null(b.column("text"), "")
            letters = pc.match_substring_regex(texts, r"\p{L}").to_pylist()
            best, score, parts = [], [], []
            for text, ok in zip(pc.utf8_lower(texts), letters, strict=True):
                w = infer(text.as_buffer().to_pybytes(), shared.value) if ok else np.zeros(len(langs))
                if ok and langs and not w.any():  # letters, but too few for an n-gram
                    w = np.full(len(langs), 1 / len(langs))
                i = int(w.argmax()) if w.any() else -1
                best.append(langs[i] if i >= 0 else UNKNOWN)
                score.append(min(1.0, float(w[i])) if i >= 0 else 0.0)
                parts.append([(langs[j], float(w[j])) for j in np.flatnonzero(w)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(parts, pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "mixture"])

    docs = only_columns(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double, mixture map<string,double>")


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def cross_checked(documents: DataFrame) -> DataFrame:
    """Predictions for all documents, learned from those that are not held out."""
    known = only_columns(documents, "doc_id", "text", "lang")
    model = learn(known.filter(~held_out(F.col("doc_id"))))
    return predict(documents, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "mixture")
