"""Language-model scoring with Brown's class-based bigrams.

A word has one class; a text's probability is the product of class transitions and of words given their classes:
P(w | v) = P(C(w) | C(v)) P(w | C(w)). Classes are found by exchange: a word goes to the class in which the classes met before
and after it are the likeliest.

1. Words of the training documents are counted. The `frequent` most frequent ones, a bounded number, get numbers.
2. All texts are encoded once: numbers of frequent words, 64-bit hashes of all others. No later step reads texts.
3. Exchange. In each of `rounds` rounds the tasks count, for each frequent word, the classes before and after it, over all
   training documents; the counts are added up in blocks of words, and each block moves its words, every other word in
   a round, with the class-to-class counts of all data. Words outside of them are one class there.
4. Every other word gets a class by the same measure, from all of its occurrences, grouped by its hash.
5. Classes and counts of these words go back to the documents that hold them, so each document becomes a sequence of classes.
6. Class transitions are counted over all training documents, and all documents are scored.

Probabilities. The half of every word met once counts as a word never met, a class of its own, so that unseen words have a
share that the data give. A transition has `strength` further counts, dealt out as the classes are. The end of a document is a
class of one token, and what goes before the first word, too.

The base score takes words alone: log10 of (count + 0.5) / (N + 0.5 (V + 1)). Logarithms are decimal; sums are doubles.

Null texts are empty and have the end token alone. A null doc_id isn't held out. Rows of one doc_id, and repeated rows, are scored
and counted each. Without training documents every word is unseen and scores 0. An empty table gives no rows. Two words of one 64-bit
hash beyond the frequent ones would share their count. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, only_columns, portions, trim, written

FREQUENT, CLASSES, ROUNDS, STRENGTH = 131_072, 48, 6, 5.0
#: Words of a block of context counts, tokens that are counted at a time, rows of word counts that a task holds.
BLOCK, TOKENS, HELD = 512, 1 << 20, 300_000


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(the text that each word is of, the words) of texts, with A-Z lower-cased."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, of = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    some = pc.greater(pc.binary_length(flat), 0)
    return of[some.to_numpy(zero_copy_only=False)], flat.filter(some)


def word_counts(documents: DataFrame) -> DataFrame:
    """word, n over all texts; a word is one row of a task, or a few."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def added(held: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
        return t.select(["word", "n_sum"]).rename_columns(["word", "n"]).cast(schema)

    def run(it):
        held: list[pa.Table] = []
        rows = 0
        for b in it:
            for part in portions(b, "text"):
                found = words(part.column("text"))[1].value_counts()
                held.append(pa.table([found.field("values"), found.field("counts")], schema=schema))
                rows += held[-1].num_rows
                if rows > HELD:
                    held = [added(held)]
                    rows = held[0].num_rows
                    if rows > HELD // 2:
                        yield from held[0].to_batches(max_chunksize=65_536)
                        held, rows = [], 0
                        trim()
        if held:
            yield from added(held).to_batches(max_chunksize=65_536)
        trim()

    return documents.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Words:
    """The frequent words of a corpus, most frequent first, and the totals of all words."""

    frequent: pa.Array
    counts: np.ndarray
    tokens: int
    kinds: int
    documents: int

    def base(self, count: np.ndarray) -> np.ndarray:
        """log10 of the share that a word of this count has."""
        return np.log10((np.asarray(count, dtype=float) + 0.5) / (self.tokens + 0.5 * (self.kinds + 1)))


def learn_words(documents: DataFrame, *, frequent: int = FREQUENT) -> Words:
    counts = written(word_counts(documents), "word-counts")
    all_ = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(frequent).toArrow()  # a bounded number of words
    discard(counts)
    n_documents = documents.count()
    return Words(top.column("word").combine_chunks(), top.column("n").to_numpy(), all_["n"] + n_documents, all_["v"] + (n_documents > 0), n_documents)


def encoded(documents: DataFrame, known: Words) -> DataFrame:
    """key, doc_id, held_out, ids (32-bit numbers of frequent words, or their number for any other), rest (64-bit hashes of these)."""
    shared = documents.sparkSession.sparkContext.broadcast(known.frequent)
    other = len(known.frequent)

    def run(it):
        frequent = shared.value
        for b in it:
            for part in portions(b, "text"):
                of, flat = words(part.column("text"))
                coded = flat.dictionary_encode()
                number = pc.fill_null(pc.index_in(coded.dictionary, frequent), other).to_numpy().astype("<i4")
                hashes = np.zeros(len(number), "<i8")
                for k in np.flatnonzero(number == other):
                    hashes[k] = xxhash.xxh64_intdigest(coded.dictionary[k].as_py()) - (1 << 63)
                at = coded.indices.to_numpy()
                ids, ends = number[at], np.searchsorted(of, np.arange(part.num_rows + 1))
                rest = [ids[a:z] == other for a, z in zip(ends, ends[1:], strict=False)]
                cut = list(zip(ends, ends[1:], rest, strict=False))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array([ids[a:z].tobytes() for a, z, _ in cut], pa.binary()), pa.array([hashes[at[a:z][r]].tobytes() for a, z, r in cut], pa.binary())],
                    ["doc_id", "held_out", "ids", "rest"],
                )
        trim()

    rows = documents.mapInArrow(run, "doc_id long, held_out boolean, ids binary, rest binary")
    out = written(rows.withColumn("key", F.monotonically_increasing_id()), "encoded", compression="zstd")  # an id by place, stored
    shared.destroy()
    return out


def _sequences(batches, column: str, kind: str, edge: int):
    """Arrays of about TOKENS numbers: whole sequences, with `edge` before the first, between any two and after the last."""
    held, n = [np.array([edge], kind)], 1
    for b in batches:
        for x in b.column(column):
            own = np.frombuffer(x.as_py(), kind)
            held += [own, np.array([edge], kind)]
            n += len(own) + 1
            if n >= TOKENS:
                yield np.concatenate(held)
                held, n = [np.array([edge], kind)], 1
    if n > 1:
        yield np.concatenate(held)


def contexts(train: DataFrame, classes: np.ndarray, k: int) -> DataFrame:
    """block, data: for each word of a block, how often each class stands before and after it (k classes, any other word, an edge);
    block -1 has the counts of class after class."""
    shared = train.sparkSession.sparkContext.broadcast(classes)
    m, width = len(classes), k + 2

    def run(it):
        of = np.append(shared.value, [k, k + 1]).astype(np.int64)  # number m is any other word, m + 1 an edge
        sums, moves = np.zeros((2, m * width), np.int32), np.zeros(width * width, np.int64)
        for seq in _sequences(it, "ids", "<i4", m + 1):
            c, seq = of[seq], seq.astype(np.int64)
            moves += np.bincount(c[:-1] * width + c[1:], minlength=width * width)
            for side, (w, near) in enumerate(((seq[1:], c[:-1]), (seq[:-1], c[1:]))):
                mine = w < m
                found = np.bincount(w[mine] * width + near[mine], minlength=m * width)
                np.add(sums[side], found, out=sums[side], casting="unsafe")  # a task has fewer than 2^31 tokens
                del found
        put = zstandard.ZstdCompressor(level=1).compress
        sums = sums.reshape(2, m, width)
        for at in range(0, m, BLOCK):
            own = sums[:, at : at + BLOCK]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([at // BLOCK], pa.int32()), pa.array([put(own.astype("<i8").tobytes())], pa.binary())], ["block", "data"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([put(moves.astype("<i8").tobytes())], pa.binary())], ["block", "data"])
        trim()

    def merge(it):
        get, block, total = zstandard.ZstdDecompressor().decompress, None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "data"])
        for b in it:
            for own, data in zip(b.column("block").to_pylist(), b.column("data"), strict=True):
                counts = np.frombuffer(get(data.as_py()), "<i8")
                if own != block:
                    if block is not None:
                        yield row()
                    block, total = own, counts.copy()
                else:
                    total += counts
        if block is not None:
            yield row()

    parts = train.select("ids").mapInArrow(run, "block int, data binary")
    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, data binary")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(before: np.ndarray, after: np.ndarray, now: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best class of each word. before, after: words x classes; now: their classes, or -1; moves: counts of class after class.

    A word that is small beside the classes adds to the logarithm of the likelihood what its neighbours say, in proportion;
    its own class is taken without it. For one that is not, the sums themselves are compared.
    """
    k = moves.shape[0] - 2
    size, count = moves.sum(0)[:k].astype(float), before.sum(1)
    log, near = np.log(moves + 0.5), np.log(size + 0.5)
    gain = after @ log[:k].T + before @ log[:, :k] - 2 * count[:, None] * near
    own = np.flatnonzero(now >= 0)
    a = now[own]
    less = (after[own] * np.log(np.maximum(moves[a] - after[own], 0) + 0.5)).sum(1) + (before[own] * np.log(np.maximum(moves[:, a].T - before[own], 0) + 0.5)).sum(1)
    gain[own, a] = less - 2 * count[own] * np.log(np.maximum(size[a] - count[own], 0) + 0.5)
    for w in np.flatnonzero((count > size.sum() / (100 * k)) & (now >= 0)):  # at most 100 k words
        m, n = moves.astype(float), size.copy()
        m[now[w]] = np.maximum(m[now[w]] - after[w], 0)
        m[:, now[w]] = np.maximum(m[:, now[w]] - before[w], 0)
        n[now[w]] = max(n[now[w]] - count[w], 0)
        gain[w] = (_xlogx(m[:k] + after[w]) - _xlogx(m[:k])).sum(1) + (_xlogx(m[:, :k].T + before[w]) - _xlogx(m[:, :k].T)).sum(1) - 2 * (_xlogx(n + count[w]) - _xlogx(n))
    return gain.argmax(1)


def learn_classes(train: DataFrame, m: int, *, k: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The classes of m frequent words, and the counts of class after class (k classes, any other word, edges)."""
    classes, width = np.arange(m) % k, k + 2
    for turn in range(rounds + 1):
        found = written(contexts(train, classes, k), "contexts")
        whole = found.filter("block = -1").collect()  # one row
        moves = np.frombuffer(whole[0]["data"], "<i8").reshape(width, width) if whole else np.zeros((width, width), np.int64)
        if turn == rounds or not m:
            discard(found)
            return classes, moves
        shared = train.sparkSession.sparkContext.broadcast((classes, moves))

        def run(it, shared=shared, turn=turn):
            classes, moves = shared.value
            for b in it:
                for block, data in zip(b.column("block").to_pylist(), b.column("data"), strict=True):
                    before, after = np.frombuffer(data.as_py(), "<i8").reshape(2, -1, width).astype(float)
                    at = np.arange(block * BLOCK, block * BLOCK + len(before))
                    best = exchange(before, after, classes[at], moves)
                    best = np.where(((at // k + turn) % 2 == 0) & (before.sum(1) > 0), best, classes[at]).astype("<i4")
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([best.tobytes()], pa.binary())], ["block", "best"])

        for r in found.filter("block >= 0").mapInArrow(run, "block int, best binary").collect():  # a number for each frequent word
            own = np.frombuffer(r["best"], "<i4")
            classes[r["block"] * BLOCK : r["block"] * BLOCK + len(own)] = own
        discard(found)
    return classes, moves


def learn_rest(train: DataFrame, classes: np.ndarray, moves: np.ndarray) -> DataFrame:
    """h, n, class of every word that isn't frequent: occurrences are sorted by hash, and what they say is added up."""
    shared = train.sparkSession.sparkContext.broadcast((classes, moves))
    m, k = len(classes), moves.shape[0] - 2

    def found(it):
        of = np.append(shared.value[0], [k, k + 1]).astype(np.int16)
        for b in it:
            hs, before, after = [], [], []
            for ids, rest in zip(b.column("ids"), b.column("rest"), strict=True):
                c = np.concatenate([[k + 1], of[np.frombuffer(ids.as_py(), "<i4")], [k + 1]]).astype(np.int16)
                at = np.flatnonzero(c[1:-1] == k) + 1
                hs.append(np.frombuffer(rest.as_py(), "<i8"))
                before.append(c[at - 1])
                after.append(c[at + 1])
            t = pa.table([pa.array(np.concatenate(x)) for x in (hs, before, after)], ["h", "before", "after"]).group_by(["h", "before", "after"]).aggregate([([], "count_all")])
            yield from t.select(["h", "before", "after", "count_all"]).rename_columns(["h", "before", "after", "n"]).to_batches(max_chunksize=65_536)
        trim()

    def best(it):
        moves = shared.value[1]
        log, near = np.log(moves + 0.5), np.log(moves.sum(0)[:k] + 0.5)
        h0, n0, says0 = None, 0, np.zeros(k)  # the word that the last rows were of
        row = lambda h, n, c: pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int32())], ["h", "n", "class"])
        choice = lambda n, says: (says - 2 * np.asarray(n)[..., None] * near).argmax(-1)
        for whole in it:
            for at in range(0, whole.num_rows, 8192):
                h, before, after, n = (whole.slice(at, 8192).column(c).to_numpy() for c in ("h", "before", "after", "n"))
                says = (log[:k, after].T + log[before, :k]) * n[:, None]
                start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                own, count, says = h[start], np.add.reduceat(n, start), np.add.reduceat(says, start, axis=0)
                if h0 is not None and own[0] == h0:
                    count[0] += n0
                    says[0] += says0
                elif h0 is not None:
                    yield row([h0], [n0], [choice(n0, says0)])
                if len(own) > 1:
                    yield row(own[:-1], count[:-1], choice(count[:-1], says[:-1]).astype(np.int32))
                h0, n0, says0 = int(own[-1]), int(count[-1]), says[-1]
        if h0 is not None:
            yield row([h0], [n0], [choice(n0, says0)])
        trim()

    rows = train.select("ids", "rest").filter(F.length("rest") > 0).mapInArrow(found, "h long, before short, after short, n long")
    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(best, "h long, n long, class int")


SEQUENCE = "doc_id long, held_out boolean, classes binary, n_tokens long, n_known long, base_score double, emitted double"


def as_classes(coded: DataFrame, rest: DataFrame, known: Words, classes: np.ndarray, k: int) -> DataFrame:
    """Each document as bytes: a word's class, k more if it was met once, 2 k if never. base_score, and emitted: the sum of log10
    of what its words count for in their classes."""
    shared = coded.sparkSession.sparkContext.broadcast((classes, known.counts))
    m, end = len(classes), float(known.base(known.documents))
    unseen = float(known.base(0))
    base = known.base

    def hashes(it):
        for b in it:
            own = [np.unique(np.frombuffer(x.as_py(), "<i8")) for x in b.column("rest")]
            key = np.repeat(b.column("key").to_numpy(), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.concatenate(own) if own else np.empty(0, np.int64))], ["key", "h"])

    def run(it):
        classes, counts = shared.value
        code = np.append(classes + np.where(counts == 1, k, 0), 0).astype(np.uint8)
        share = np.append(base(counts), 0.0)
        weight = np.append(np.log10(np.where(counts == 1, 0.5, counts)), 0.0)
        for b in it:
            cols: list[list] = [[] for _ in range(5)]
            for ids, rest, met in zip(b.column("ids"), b.column("rest"), b.column("met"), strict=True):
                ids, rest = np.frombuffer(ids.as_py(), "<i4"), np.frombuffer(rest.as_py(), "<i8")
                own, n_known, base_score, emitted = code[ids], len(ids) - len(rest) + (known.documents > 0), float(share[ids].sum()) + end, float(weight[ids].sum())
                if len(rest):
                    h, n, c = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
                    if met.is_valid and len(met.values):
                        h, n, c = (met.values.field(f).to_numpy() for f in ("h", "n", "class"))
                        order = np.argsort(h)
                        h, n, c = h[order], n[order], c[order]
                    at = np.minimum(np.searchsorted(h, rest), max(len(h) - 1, 0))
                    seen = h[at] == rest if len(h) else np.zeros(len(rest), bool)
                    counts_here = np.where(seen, n[at], 0) if len(h) else np.zeros(len(rest), np.int64)
                    there = np.full(len(rest), 2 * k)
                    if len(h):
                        there = np.where(seen, c[at] + np.where(counts_here == 1, k, 0), there)
                    own[ids == m] = there
                    n_known += int(seen.sum())
                    base_score += float(np.where(seen, base(counts_here), unseen).sum())
                    emitted += float(np.log10(np.where(counts_here > 1, counts_here, 0.5))[seen].sum())
                for x, v in zip(cols, (own.tobytes(), len(ids) + 1, n_known, base_score, emitted), strict=True):
                    x.append(v)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *[pa.array(x, t) for x, t in zip(cols, kinds, strict=True)]], ["doc_id", "held_out", "classes", "n_tokens", "n_known", "base_score", "emitted"])
        trim()

    rows = coded.select("key", "rest").filter(F.length("rest") > 0).mapInArrow(hashes, "key long, h long")
    met = rows.join(rest, "h").groupBy("key").agg(F.collect_list(F.struct("h", "n", "class")).alias("met"))  # the different words of a document
    return coded.join(met, "key", "left").select("doc_id", "held_out", "ids", "rest", "met").mapInArrow(run, SEQUENCE)


@dataclass
class Transitions:
    """log10 of the share of class after class, and of the words' weights in each class; codes are those of as_classes."""

    step: np.ndarray
    size: np.ndarray


def learn_transitions(train: DataFrame, k: int, *, strength: float = STRENGTH) -> Transitions:
    n = 2 * k + 2

    def run(it):
        moves = np.zeros(n * n, np.int64)
        for seq in _sequences(it, "classes", "u1", n - 1):
            moves += np.bincount(seq[:-1].astype(np.int64) * n + seq[1:], minlength=n * n)
        at = np.flatnonzero(moves)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(moves[at], pa.int64())], ["at", "n"])

    moves = np.zeros(n * n)
    for r in train.select("classes").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most n^2 numbers
        moves[r["at"]] = r["n"]
    part = np.zeros((n, k + 2))  # of each code, what counts for each class; class k is the unseen one, k + 1 the edge
    part[np.arange(k), np.arange(k)] = 1
    part[np.arange(k, 2 * k), np.arange(k)] = 0.5
    part[k : 2 * k, k] = 0.5
    part[2 * k, k] = part[2 * k + 1, k + 1] = 1
    own = part.T @ moves.reshape(n, n) @ part
    share = (own.sum(0) + 0.5) / (own.sum() + 0.5 * (k + 2))
    step = np.log10((own + strength * share) / (own.sum(1, keepdims=True) + strength))
    read = np.r_[np.arange(k), np.arange(k), k, k + 1]  # a word met once has its class, when it is read
    size = np.log10(np.maximum(np.append(own.sum(0)[:k], [1.0, 1.0]), 0.5))
    size[k:] = 0.0
    return Transitions(step[np.ix_(read, read)], size[read])


def scored(sequences: DataFrame, model: Transitions, known: Words) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    n = len(model.size)
    step, size = model.step.ravel(), model.size
    silent = not known.documents

    def run(it):
        for b in it:
            score = []
            for classes, emitted in zip(b.column("classes"), b.column("emitted").to_pylist(), strict=True):
                c = np.frombuffer(classes.as_py(), "u1").astype(np.int64)
                seq = np.concatenate([[n - 1], c, [n - 1]])
                score.append(0.0 if silent else float(step[seq[:-1] * n + seq[1:]].sum()) + emitted - float(size[c].sum()))
            held = [b.column(x) for x in ("doc_id", "held_out", "n_tokens", "n_known")]
            yield pa.RecordBatch.from_arrays([*held, pa.array([known.tokens] * b.num_rows, pa.int64()), b.column("base_score"), pa.array(score, pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    known = Words(None, None, known.tokens, known.kinds, known.documents)  # tasks need the totals alone
    return sequences.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(scores: DataFrame, column: str = "score") -> float:
    """10 to the power of minus the mean score of a token."""
    s, n = scores.agg(F.sum(column), F.sum("n_tokens")).first()
    return math.pow(10.0, -s / n) if n else math.nan


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 1, F.lit(False))


def score(documents: DataFrame, *, held: Column | None = None, frequent: int = FREQUENT, classes: int = CLASSES, rounds: int = ROUNDS, strength: float = STRENGTH) -> DataFrame:
    """Scores of all documents by a model of those that aren't held out. held: a condition on doc_id."""
    if not 1 <= classes <= 126:
        raise ValueError("1 to 126 classes")
    docs = only_columns(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    docs = docs.withColumn("held_out", held_out(F.col("doc_id")) if held is None else held)
    known = learn_words(docs.filter("not held_out"), frequent=frequent)
    coded = encoded(docs, known)
    train = coded.filter("not held_out")
    own, moves = learn_classes(train, len(known.frequent), k=classes, rounds=rounds)
    rest = written(learn_rest(train, own, moves), "other-words")
    sequences = written(as_classes(coded, rest, known, own, classes), "class-sequences", compression="zstd")
    discard(coded, rest)
    out = written(scored(sequences, learn_transitions(sequences.filter("not held_out"), classes, strength=strength), known), "scores")
    discard(sequences)
    return out
