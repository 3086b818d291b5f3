"""Bulk-synchronous best-fit packing of documents into sequences.

Pieces of documents are packed class by class, the longest first: lengths over half of the capacity, over a quarter and
so on; the last class holds all up to `SMALLEST`. A class of greatest length u is packed in supersteps:

1. Gaps. Each sequence with room offers its gap, cut into parts of length u and a last one that has the rest (up to 2 u),
   so that many pieces can be placed in one superstep.
2. Range sort. Pieces and parts are range-sorted together by length, the longest first, parts before pieces of their
   length. Each range is matched by itself: a piece takes the smallest part of its range that holds it, what
   is left of the part can be taken again.
3. Successor sweep. Pieces that found no part in their range look for the nearest untouched part in the ranges of longer
   ones. In the order of the ranges parts open and pieces close, as brackets do: a piece takes the last part before it
   that is still open. Which one this is follows from the ranks of both within their ranges and from sums over the
   ranges before: a piece and a part of one depth, next to each other, belong together. So conflicts are resolved by rank.
4. Gaps are updated, and the next superstep begins.

When a superstep has placed nothing, new sequences are opened for the class's other pieces, in each range by itself, and the
next class follows. Only the numbers of pieces in each class (twelve or so) and of parts and
pieces left in each range (two for each task) reach the driver.

A document longer than the capacity is cut into full pieces and a last, shorter one. Full pieces are sequences of their
own. Null texts are empty; a document always has its end id and so at least one piece. An empty table gives no rows.
Repeated rows are packed once each. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import discard, only_columns, trim, written
from .tokens import encoder

CAPACITY = 4096
SMALLEST = 64
#: Pieces and parts that one task matches.
ROWS_PER_TASK = 200_000
#: Rows of a task's matching. what: 0 placed, 1 a piece left, 2 an untouched part left; id: of the piece, or null.
MATCHED = "what int, id long, sequence_id long, length long, task int, rank long"


def pieces(documents: DataFrame, tokenizer: str, *, kind: str = "word", end_id: int = 1, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece int, start long, length long, ids_crc32 long (and ids binary): each document's ids, cut."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def run(it):
        enc, tail = encoder(tokenizer, kind), array("I", [end_id]).tobytes()
        for b in it:
            cols: list[list] = [[] for _ in names]
            for d, t in zip(b.column(0), b.column(1), strict=True):
                ids = enc.encode(t.as_py()) + tail
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    for c, v in zip(cols, (d.as_py(), k, at // 4, len(own) // 4, zlib.crc32(own), own), strict=False):
                        c.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names)
            trim()

    docs = only_columns(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def best_fit(rows: list[tuple[int, int, int]], opens: int = 0):
    """Match the rows (length, is_piece, id) of a range, which are sorted by falling length with parts first.

    Yields (piece, sequence, length) for each piece that is placed, then (piece, None, length) for each that isn't, and
    (None, sequence, length) for each part that nothing was placed in. With `opens`, a capacity, a piece that no part holds
    opens a new sequence; these are called 0, 1 ... in the order of opening.
    """
    gaps: list[tuple[int, int]] = []  # minus the size, and the number of the part; in order, so that the smallest come last
    owner: list[int] = []
    whole: list[int] = []
    left = []
    opened = 0
    for length, is_piece, i in rows:
        at = bisect_right(gaps, (-length, len(owner))) - 1 if is_piece else -1
        if at < 0:
            if is_piece and not opens:
                left.append((i, None, length))
                continue
            size = opens if is_piece else length
            owner.append(opened if is_piece else i)
            whole.append(size)
            opened += is_piece
            at = bisect_right(gaps, (-size, len(owner) - 1))
            gaps.insert(at, (-size, len(owner) - 1))
        if is_piece:
            size, part = gaps.pop(at)
            whole[part] = 0
            yield i, owner[part], length
            if -size > length:
                insort(gaps, (size + length, part))
    yield from left
    if not opens:
        yield from ((None, s, w) for s, w in zip(owner, whole, strict=True) if w)


def _ranges(events: DataFrame, n: int, opens: int = 0, first: int = 0) -> DataFrame:
    """best_fit in each range of events (length, is_piece, id); opened sequences are numbered from `first` by task."""

    def run(it):
        task = TaskContext.get().partitionId()
        rows: list[tuple] = []
        for b in it:
            rows += zip(*[b.column(c).to_pylist() for c in ("length", "is_piece", "id")], strict=True)
        out: list[list] = [[] for _ in range(6)]
        ranks = [0, 0, 0]
        for piece, sequence, length in best_fit(rows, opens):
            what = 2 if piece is None else 1 if sequence is None else 0
            own = first + (task << 24) + sequence if opens else sequence
            for c, v in zip(out, (what, piece, own, length, task, ranks[what]), strict=True):
                c.append(v)
            ranks[what] += 1
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [f.split()[0] for f in MATCHED.split(", ")])

    by = [F.desc("length"), "is_piece", "id"]
    dealt = events.repartitionByRange(max(1, -(-n // ROWS_PER_TASK)), *by).sortWithinPartitions(*by)
    return dealt.mapInArrow(run, MATCHED)


def sweep(spark: SparkSession, left: DataFrame) -> DataFrame:
    """id, sequence_id, length of the pieces left that have a successor among the untouched parts of earlier ranges."""
    # two numbers for each task of the range sort
    n = {(r["task"], r["what"]): r["n"] for r in left.groupBy("task", "what").agg(F.count("*").alias("n")).collect()}
    rows, open_ = [], 0
    for task in sorted({t for t, _ in n}):  # in a range, what is left are pieces that come before the parts
        rows.append((task, 1, open_))
        open_ -= n.get((task, 1), 0)
        rows.append((task, 2, open_))
        open_ += n.get((task, 2), 0)
    before = spark.createDataFrame(rows, "task int, what int, before long")
    depth = F.when(F.col("what") == 1, F.col("before") - F.col("rank")).otherwise(F.col("before") + F.col("rank") + 1)
    each = left.join(F.broadcast(before), ["task", "what"]).withColumn("depth", depth)
    along = Window.partitionBy("depth").orderBy("task", "what")  # of one depth, a range has one piece and one part at most
    return each.withColumn("part", F.lag("sequence_id").over(along)).filter("what = 1 and part is not null").select("id", F.col("part").alias("sequence_id"), "length")


def _parts(gaps: DataFrame, longest: int) -> DataFrame:
    n = F.greatest(F.lit(1), F.expr(f"gap div {longest}"))
    each = gaps.select("sequence_id", "gap", F.posexplode(F.sequence(F.lit(1), n.cast("int"))).alias("at", "part"))
    length = F.when(F.col("at") > 0, F.lit(longest)).otherwise(F.col("gap") - longest * (n - 1))
    return each.select(length.cast("long").alias("length"), F.lit(0).alias("is_piece"), F.col("sequence_id").alias("id"))


def assign(spark: SparkSession, rows: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """id, sequence_id, length for rows (id, length) that are stored; ids are unique, lengths 1 to capacity."""
    bounds = [capacity]
    while bounds[-1] > SMALLEST:
        bounds.append(bounds[-1] // 2)
    of = F.lit(len(bounds) - 1)
    for k in range(len(bounds) - 2, -1, -1):
        of = F.when(F.col("length") > bounds[k + 1], F.lit(k)).otherwise(of)
    full = rows.filter(F.col("length") == capacity).select("id", F.col("id").alias("sequence_id"), "length")
    rest = rows.filter(F.col("length") < capacity)
    sizes = {r["class"]: r["n"] for r in rest.groupBy(of.alias("class")).agg(F.count("*").alias("n")).collect()}  # a dozen rows
    placed: list[DataFrame] = []
    gaps, steps = None, 0

    def place(found: DataFrame) -> None:
        nonlocal gaps
        used = found.groupBy("sequence_id").agg(F.sum("length").alias("used"))
        left = used.select("sequence_id", (capacity - F.col("used")).alias("gap"))
        if before := gaps:
            left = before.join(used, "sequence_id", "full").select("sequence_id", (F.coalesce("gap", F.lit(capacity)) - F.coalesce("used", F.lit(0))).alias("gap"))
        gaps = written(left.filter("gap > 0"), "gaps")
        placed.append(found)
        if before:
            discard(before)

    for k in sorted(sizes):
        longest, shortest = bounds[k], (bounds[k + 1] if k + 1 < len(bounds) else 0) + 1
        todo, n = rest.filter(of == k).select("id", "length"), sizes[k]
        piece = ("length", F.lit(1).alias("is_piece"), "id")
        while n and gaps:
            fit = gaps.filter(F.col("gap") >= shortest)
            room = fit.count()
            if not room:
                break
            met = written(_ranges(todo.select(*piece).union(_parts(fit, longest)), n + room), "matched")
            late = written(sweep(spark, met.filter("what > 0")), "swept")
            place(written(met.filter("what = 0").select("id", "sequence_id", "length").union(late), "placed"))
            before, had = todo, n
            todo = written(met.filter("what = 1").select("id", "length").join(late.select("id"), "id", "left_anti"), "left")
            n = todo.count()
            discard(met, late, before)
            if n == had:
                break
        if n:
            steps += 1
            place(written(_ranges(todo.select(*piece), n, capacity, -(steps << 48)).select("id", "sequence_id", "length"), "placed"))
        discard(todo)
    for found in placed:
        full = full.union(found)
    out = written(full, "assigned")
    discard(*placed, *[gaps] * bool(gaps))
    return out


def pack(documents: DataFrame, tokenizer: str, *, kind: str = "word", end_id: int = 1, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) for each piece of each document."""
    cut = pieces(documents, tokenizer, kind=kind, end_id=end_id, capacity=capacity, keep_ids=keep_ids)
    cut = written(cut.withColumn("id", F.monotonically_increasing_id()), "pieces")  # stored with the pieces: an id by place is read once
    rows = written(cut.select("id", "length"), "lengths")
    found = assign(documents.sparkSession, rows, capacity=capacity)
    discard(rows)
    # a sequence holds at most `capacity` pieces
    along = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "id").rowsBetween(Window.unboundedPreceding, -1)
    places = found.select("id", "sequence_id", F.coalesce(F.sum("length").over(along), F.lit(0)).alias("offset"))
    out = cut.join(places, "id")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("sequence_id").cast(T.LongType()).alias("sequence_id"), F.col("offset").cast(T.LongType()).alias("offset"), *["ids"] * keep_ids)
