"""Repeated passages by sparse suffix arrays and exact windows.

A text's words (A-Z lower-cased, cut at ASCII white space) are numbered, and of each `min_words - BLOCK + 1`
neighbouring blocks of BLOCK words the one with the least hash (the first of equal ones) marks a retained suffix.
Each window of `min_words` words thus belongs to one retained suffix, and equal windows of two texts belong to
suffixes that begin with the same block. Suffixes are sorted by this block and carry the 64-bit hashes of their own
windows (at most `min_words - BLOCK + 1`); a window is repeated if rows of two different doc_ids have its hash,
wherever they stand in the order. Neighbouring repeated windows are spans, which are merged for each document.

Blocks that begin suffixes of one document only are never sorted: their hashes are counted first, and a bit map of the
repeated ones, of at most MAP_BITS bits, lets the others be left out where the texts are read. Where a corpus repeats
more blocks than the map tells apart, more suffixes are sorted, and the result is the same. A task decides the groups
of equal blocks that lie inside its share of the order. Its first and last group may go on in other tasks, and groups
of over GROUP_WINDOWS windows are met in parts: of these, a window that repeats within a part is known by two doc_ids,
one that doesn't is settled by its hash, in Spark, among all parts.

A null text has no words. Rows of one doc_id are one document: what repeats between them alone is not reported. An
empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, only_columns, written
from .near_dup import _mix, word_hashes

MIN_WORDS, BLOCK = 50, 31
MAP_BITS = 1 << 27
ROWS_PER_TASK = 200_000
#: Windows that a task decides at once; a larger group of equal blocks is decided in parts.
GROUP_WINDOWS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_back = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SEED = "doc_id long, start int, n_words int, key long, windows binary"
#: Spans; or windows that other tasks may have, with their hashes.
FOUND = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("n_words", pa.int32()), ("window", pa.int64())])


def _powers(x: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, x, np.uint64)]), dtype=np.uint64)


def blocks(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words."""
    n = len(h) - size + 1
    total = np.concatenate([[np.uint64(0)], np.cumsum(h * _powers(_BASE, len(h)), dtype=np.uint64)])
    return _mix(_mix((total[size:] - total[:-size]) * _powers(_back, n)))


def retained(h: np.ndarray, min_words: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `min_words` words, the position of its retained suffix; and the hashes of all blocks."""
    if len(h) < min_words:
        return np.empty(0, int), np.empty(0, np.uint64)
    g, reach = blocks(h, block), min_words - block + 1
    # the place of the least of 1, 2, 4... neighbouring blocks; two runs that overlap make up `reach`
    at, size = np.arange(len(g)), 1
    while size < reach:
        step = min(size, reach - size)
        x, y = at[:-step], at[step:]
        at = np.where(g[x] <= g[y], x, y)
        size += step
    return at, g


def _hashes(text) -> np.ndarray:
    words = (text or "").encode().lower().split()
    return word_hashes(words) if words else np.empty(0, np.uint64)


def _windows(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place and row of each window that the rows carry."""
    own = rows.column("windows")
    sizes = pc.binary_length(own).to_numpy().astype(np.int64) // 8
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = rows.column("start").to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.frombuffer(b"".join(own.to_pylist()), np.int64), place, row


def _found(doc, start, end, n, window) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((doc, start, end, n, window), FOUND, strict=True)], schema=FOUND)


def _decided(rows: pa.Table, min_words: int, whole: bool):
    """Spans of the windows that repeat in these rows. If other tasks may have more rows of the groups (not whole),
    also two rows of different doc_ids, without a place, for each of these windows, and each other window by itself."""
    key, place, row = _windows(rows)
    doc, n = rows.column("doc_id").to_numpy()[row], rows.column("n_words").to_numpy()[row]
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
    lo, hi = np.minimum.reduceat(doc[order], first), np.maximum.reduceat(doc[order], first)
    hit = np.empty(len(key), bool)
    hit[order] = np.repeat(lo < hi, np.diff(first, append=len(key)))
    at = np.flatnonzero(hit)
    if len(at):
        breaks = np.flatnonzero((np.diff(row[at]) != 0) | (np.diff(place[at]) != 1))
        a, z = at[np.append(0, breaks + 1)], at[np.append(breaks, len(at) - 1)]
        yield _found(doc[a], place[a], place[z] + min_words, n[a], [None] * len(a))
    if not whole:
        met, none = key[order[first]][lo < hi], [None] * (2 * int((lo < hi).sum()))
        yield _found(np.concatenate([lo[lo < hi], hi[lo < hi]]), none, none, none, np.concatenate([met, met]))
        o = ~hit
        yield _found(doc[o], place[o], place[o] + min_words, n[o], key[o])


def _groups(it, min_words: int):
    """Spans, and windows to decide with other tasks, of a task's suffixes in the order of their blocks."""
    held: list[pa.RecordBatch] = []
    n, edge = 0, None  # windows held; the group that may go on elsewhere, at first the one that the task begins with

    def settle():
        nonlocal held, n, edge
        rows = pa.Table.from_batches(held)
        key = rows.column("key").to_numpy()
        edge = key[0] if edge is None else edge
        a, z = int(np.searchsorted(key, edge, "right")), int(np.searchsorted(key, key[-1], "left"))
        if a:
            yield from _decided(rows.slice(0, a), min_words, False)
        if z > a:
            yield from _decided(rows.slice(a, z - a), min_words, True)
        left = rows.slice(max(a, z))
        held = [b for b in left.to_batches() if b.num_rows]
        n = pc.sum(pc.binary_length(left.column("windows"))).as_py() // 8 if left.num_rows else 0
        if n > GROUP_WINDOWS:
            edge = key[-1]
            yield from _decided(left, min_words, False)
            held, n = [], 0

    for b in it:
        if b.num_rows:
            held.append(b)
            n += pc.sum(pc.binary_length(b.column("windows"))).as_py() // 8
            if n > GROUP_WINDOWS:
                yield from settle()
    if held:
        yield from settle()
    if held:
        yield from _decided(pa.Table.from_batches(held), min_words, False)


def repeats(documents: DataFrame, *, min_words: int = MIN_WORDS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, start, end (in words): the merged spans that occur in another document, too."""
    spark = documents.sparkSession
    docs = only_columns(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())

    def keys(it):
        for b in it:
            d, k = [], []
            for doc, t in zip(b.column("doc_id"), b.column("text"), strict=True):
                at, g = retained(_hashes(t.as_py()), min_words, block)
                own = np.unique(g[at[np.diff(at, prepend=-1) > 0]]).view(np.int64)
                k.append(own)
                d.append(np.full(len(own), doc.as_py(), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(k)), pa.array(np.concatenate(d))], ["key", "doc_id"])

    spread = docs.mapInArrow(keys, "key long, doc_id long").groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("key")
    again = written(spread, "repeated-blocks")
    n = again.count()
    bits = 1 << min(int(np.log2(MAP_BITS)), max(16, int(np.ceil(np.log2(max(1, n) * 12)))))
    # one row for each 64 bits of the map at most
    place = F.col("key").bitwiseAND(F.lit(bits - 1))
    words = again.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, int((key & {bits - 1}L) & 63))")).alias("mask")).toArrow()
    bit_map = np.zeros(bits // 64, np.int64)
    bit_map[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    shared = spark.sparkContext.broadcast(bit_map)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        d, start, n, key, sizes, own = (np.concatenate(c) for c in zip(*rows, strict=True))
        ends = np.concatenate([[0], np.cumsum(8 * sizes)]).astype(np.int32)
        windows = pa.BinaryArray.from_buffers(pa.binary(), len(d), [None, pa.py_buffer(ends), pa.py_buffer(own)])
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(key), windows], ["doc_id", "start", "n_words", "key", "windows"])

    def seeds(it):
        marks = shared.value.view(np.uint64)
        for b in it:
            rows: list[tuple] = []
            full = 0
            for doc, t in zip(b.column("doc_id"), b.column("text"), strict=True):
                h = _hashes(t.as_py())
                at, g = retained(h, min_words, block)
                first = np.flatnonzero(np.diff(at, prepend=-1) > 0)
                key = g[at[first]]
                low = key & np.uint64(bits - 1)
                on = (marks[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) > 0
                if on.any():
                    sizes = np.diff(first, append=len(at))
                    rows.append((np.full(on.sum(), doc.as_py(), np.int64), first[on], np.full(on.sum(), len(h)), key[on].view(np.int64), sizes[on], blocks(h, min_words)[np.repeat(on, sizes)]))
                    full += int(sizes[on].sum())
                if full > GROUP_WINDOWS:
                    yield batch(rows)
                    rows, full = [], 0
            if rows:
                yield batch(rows)

    kept = written(docs.mapInArrow(seeds, SEED), "suffixes")
    parts = max(1, -(-kept.count() // ROWS_PER_TASK))
    # by doc_id and start as well, so that a group of any size is dealt out
    dealt = kept.repartitionByRange(parts, "key", "doc_id", "start").sortWithinPartitions("key")
    found = written(dealt.mapInArrow(lambda it: _groups(it, min_words), "doc_id long, start int, end int, n_words int, window long"), "matches")
    discard(again, kept)
    shared.destroy()
    open_ = found.filter("window is not null")
    twice = written(open_.groupBy("window").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("window"), "repeated-windows")
    late = open_.filter("start is not null").join(twice, "window", "left_semi")
    spans = found.filter("window is null").union(late.select(*found.columns)).drop("window")
    return merged(spans)


def merged(spans: DataFrame) -> DataFrame:
    """One row for each document: spans that overlap or touch are one."""
    along = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.distinct().withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    runs = new.withColumn("run", F.sum("new").over(along)).groupBy("doc_id", "run").agg(F.max("n_words").cast("long").alias("n_words"), F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def repeats_digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_spans, n_repeated and spans (start:end, comma-joined) of documents with repeated passages."""
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return repeats(documents).select("doc_id", "n_words", F.size("spans").cast("long").alias("n_spans"), n.alias("n_repeated"), F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"))
