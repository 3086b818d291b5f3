"""Near-duplicates by a chosen-path set similarity join.

A document is the set of its shingles (neighbouring words; A-Z lower-cased, words end at ASCII white space). Minwise
tokens of the set lead it down `TREES` independent random trees. The first step of a tree takes ROOT minwise tokens at
once; below, each step takes one bit of a minwise token, at coordinates that the node chooses (by the hash of its
root), so two sets of similarity s part with probability 1 - s^ROOT at the root and (1 - s) / 2 a step after it. As a
set's path doesn't depend on other sets, all levels are walked at once: rows are sorted by root and path, where
each node is a run, and each set is compared with the REACH sets after it under its root. That compares every node of
up to REACH + 1 sets exhaustively, whatever its level, and larger ones along their order. Sets are compared by
`WIDE` sketch bits, one of a minwise token each, and those that may reach the threshold are joined; of the pairs that
do, as many are kept as join the same sets (a forest for each root).

The sets that are joined, however indirectly, are a group. Links are decided inside groups, on the full sets, taken anew
from the whole texts. A group of at most `LEAF` sets is compared exhaustively. In a larger one, sets are written as their
differences from a centre, the shingles that most of a sample of its sets hold. With p shingles in the centre, and
r of them missing and a others added in a set, its cost is 100 r + q a (q: the per cent asked). Two sets are linked if
and only if their differences have at least (cost + cost' - (100 - q) p) / (100 + q) shingles in common. So all sets
that are cheap enough are linked with the cheapest one; those that aren't, must share a difference with whatever they are
linked with, one of the rarest ones that make up its prefix (as in prefix filters). Only pairs that do are compared.
Any centre gives the same result; a good one makes few pairs of a large group of near copies.

What can be missed is a pair that no tree brings together. For nodes that end at the root this has probability
(1 - 0.8^3)^24, about 3e-8, at the threshold; where a part of the texts is common to very many documents, roots that lie
inside that part are large and count little, which leaves 0.001 at worst (a common part of four fifths), if not both
sets lie among other near sets, which join them, too. Sketches drop a pair at the threshold with probability 3e-5.

Classes are connected components, found by contraction: each set hooks to its least neighbour in a random order.

Documents with equal sets are one set throughout; no copies are paired. An empty set (null text, no words) is linked
with nothing, so is a row without a doc_id. Rows with one doc_id are told apart by their sets: each has the class of
its own set. An empty table gives no rows. Of a class, `deduplicated` keeps one row: the one of its smallest doc_id (of
the smallest text hash, if there are several texts; any one of equal rows). Rows that are linked with nothing for want of
a set or a doc_id stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keyed, only_columns, portions, trim, without, written

TREES, ROOT = 24, 3
WIDE = 512
#: Sets of a group that are compared exhaustively; sets that each one is compared with along the order of a tree.
LEAF = REACH = 32
#: Sketch bits in which sets at the threshold may differ: of the first 128, 12.8 on average, over 28 with probability
#: 3e-5; of all 512, 51.2 on average, over 80 with probability 2e-5.
DIFFER, DIFFER_WIDE = 28, 80
ROWS_PER_TASK = 200_000
#: Sets that a centre is made of, on average, and sets that one task holds against it.
SAMPLE, SHARE = 64, 250
#: Slots in which differences are counted, to tell the rarer ones; more collisions cost time, not results.
SLOTS = 1 << 20
#: Sets whose texts are to be read, up to which the list (four longs a row) is broadcast; a longer one is shuffled.
BROADCAST_ROWS = 400_000
BATCH_BYTES = 4 << 20
_odd = np.random.default_rng(11).integers(1 << 62, 1 << 63, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hashes of words that a worker has met; KEPT bounds its memory only."""

    KEPT = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([*map(_words.__getitem__, words)], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all n neighbouring words; of all words together, if there are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    m = min(n, len(h))
    out = np.full(len(h) - m + 1, m, dtype=np.uint64)
    for k in range(m):
        out = _mix(out * _BASE + h[k : len(h) - m + 1 + k])
    return np.unique(out)


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """WIDE 32-bit minwise values of each (non-empty) set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), WIDE), np.uint32)
    for c, odd in enumerate(_odd):
        out[:, c] = np.minimum.reduceat(flat * odd >> np.uint64(32), starts)
    return out


def _fixed(rows: np.ndarray) -> pa.Array:
    """A binary column of equally long rows."""
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def _array(column, dtype, width: int) -> np.ndarray:
    """The rows of such a column."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def signatures(documents: DataFrame, n: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_hash and (null for an empty set) tokens: TREES x ROOT minwise ones; and bits."""

    def run(it):
        for b in it:
            for part in portions(b, "text"):
                sets = [shingles(t.as_py(), n) for t in part.column("text")]
                full = [s for s in sets if len(s)]
                mw = minwise(full) if full else np.empty((0, WIDE), np.uint32)
                at = np.cumsum([len(s) > 0 for s in sets]) - 1
                there = pa.array([i if len(s) else None for i, s in zip(at, sets, strict=True)], pa.int64())
                tokens, bits = _fixed(mw[:, : TREES * ROOT]), _fixed(np.packbits((mw & 1).astype(np.uint8), axis=1))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text_hash"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        tokens.take(there),
                        bits.take(there),
                    ],
                    ["doc_id", "text_hash", "n_shingles", "set_hash", "tokens", "bits"],
                )
            trim()

    docs = only_columns(documents, "doc_id", "text").withColumns({"doc_id": F.col("doc_id").cast("long"), "text_hash": F.xxhash64("text")})
    return docs.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_hash binary, tokens binary, bits binary")


def _paths(sets: DataFrame) -> DataFrame:
    """node, path, id, bits: one row for each set and tree. The path is 64 of the bits, chosen by the root."""
    step = 2 * np.random.default_rng(12).integers(0, WIDE // 2, TREES) + 1

    def run(it):
        for b in it:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                bits = _array(part.column("bits"), np.uint8, WIDE // 8)
                tokens = _array(part.column("tokens"), np.uint32, TREES * ROOT).reshape(-1, TREES, ROOT).astype(np.uint64)
                root = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), tokens.shape[:2]).copy()
                for k in range(ROOT):
                    root = _mix(root * _BASE + tokens[:, :, k])
                each = np.unpackbits(bits, axis=1)
                path = np.zeros(root.shape, np.uint64)
                for t in range(TREES):
                    first = (root[:, t] & np.uint64(WIDE - 1)).astype(np.int64)
                    at = (first[:, None] + step[t] * np.arange(64)) % WIDE
                    path[:, t] = np.packbits(np.take_along_axis(each, at, 1), axis=1).view(">u8")[:, 0]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(root.view(np.int64).ravel()),
                        pa.array((path ^ np.uint64(1 << 63)).view(np.int64).ravel()),  # signed order is that of the bits
                        pa.array(np.repeat(part.column("id").to_numpy(), TREES)),
                        _fixed(np.repeat(bits, TREES, axis=0)),
                    ],
                    ["node", "path", "id", "bits"],
                )

    return sets.select("id", "tokens", "bits").mapInArrow(run, "node long, path long, id long, bits binary")


def _forest(x: np.ndarray, y: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs of places (x, y) join two parts that no pair before has joined, and the parts after that."""
    kept = []
    at = np.arange(len(x))
    while len(at := at[part[x[at]] != part[y[at]]]):
        a, b = part[x[at]], part[y[at]]
        high, one = np.unique(np.maximum(a, b), return_index=True)
        kept.append(at[one])
        up = np.arange(len(part))
        up[high] = np.minimum(a, b)[one]  # to a smaller number, so there is no circle
        while (up[up] != up).any():
            up = up[up]
        part = up[part]
    return np.concatenate(kept) if kept else at, part


def _pairs_along(node: np.ndarray, ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Rows (a, b): pairs of sets under one root, at most REACH places apart, that may be linked; no more of them than join them."""
    out = []
    part = np.arange(len(node))
    first = np.arange(max(0, len(node) - 1))
    for k in range(1, min(REACH, len(node) - 1) + 1):
        first = first[first + k < len(node)]
        first = first[node[first] == node[first + k]]
        if not len(first):
            break
        x = first[part[first] != part[first + k]]
        for words, most in ((slice(0, 2), DIFFER), (slice(0, None), DIFFER_WIDE)):
            x = x[np.bitwise_count(bits[x, words] ^ bits[x + k, words]).sum(axis=1, dtype=np.int64) <= most]
        kept, part = _forest(x, x + k, part)
        out.append(np.stack([ids[x[kept]], ids[x[kept] + k]], axis=1))
    return np.unique(np.sort(np.concatenate(out), axis=1), axis=0) if out else np.empty((0, 2), np.int64)


def _near(it):
    """Pairs a, b from rows that are sorted by node and path. The last REACH rows of a batch go on to the next one."""
    node, ids, bits = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, WIDE // 64), np.uint64)
    for b in it:
        if b.num_rows:
            node = np.concatenate([node, b.column("node").to_numpy()])
            ids = np.concatenate([ids, b.column("id").to_numpy()])
            bits = np.concatenate([bits, _array(b.column("bits"), np.uint64, WIDE // 64)])
            found = _pairs_along(node, ids, bits)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])
            node, ids, bits = node[-REACH:], ids[-REACH:], bits[-REACH:]


def classes(edges: DataFrame) -> DataFrame:
    """id, root: for each end of an edge (a, b), one and the same root in each connected component.

    Each round hooks every node to the least of its neighbours and itself, by hash, and contracts the edges; the
    number of nodes falls by a constant factor on average. Mappings are composed at the end.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    steps: list[DataFrame] = []
    edges = written(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    while edges.limit(1).count():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(order("b")).alias("least"))
        up = written(least.select(F.col("a").alias("id"), F.least("least", order("a"))["id"].alias("up")), "hooks")
        steps.append(up)
        left = edges.join(up.select(F.col("id").alias("a"), F.col("up").alias("a2")), "a").select(F.col("a2").alias("a"), "b")
        left = left.join(up.select(F.col("id").alias("b"), F.col("up").alias("b2")), "b").select("a", F.col("b2").alias("b"))
        before, edges = edges, written(left.filter("a <> b").distinct(), "edges")
        discard(before)
    if not steps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    out = steps[0].withColumnRenamed("up", "root")
    for up in steps[1:]:
        out = out.join(up.select(F.col("id").alias("root"), "up"), "root", "left").select("id", F.coalesce("up", "root").alias("root"))
    out = written(out, "classes")
    discard(edges, *steps)
    return out


def _items(members: DataFrame, documents: DataFrame, n: int) -> DataFrame:
    """group, size, id, items: the full sets of members (group, size, id, doc_id, text_hash), from their whole texts."""

    def run(it):
        for b in it:
            rows, full = [], 0
            for i, t in enumerate(b.column("text")):
                rows.append((i, shingles(t.as_py(), n).tobytes()))
                full += len(rows[-1][1])
                if full > BATCH_BYTES or i + 1 == b.num_rows:
                    at = pa.array([r[0] for r in rows], pa.int64())
                    yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in ("group", "size", "id")], pa.array([r[1] for r in rows], pa.binary())], ["group", "size", "id", "items"])
                    rows, full = [], 0
            trim()

    few = members.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    docs = only_columns(documents, "doc_id", "text").withColumns({"doc_id": F.col("doc_id").cast("long"), "text_hash": F.xxhash64("text")})
    met = docs.join(F.broadcast(members) if few else members, ["doc_id", "text_hash"])
    return met.select("group", "size", "id", "text").mapInArrow(run, "group long, size long, id long, items binary")


def _runs(it, *by: str):
    """The rows of a sorted stream, as one table for each group; rows that repeat an id are left out."""
    held: list[pa.RecordBatch] = []
    for b in it:
        if not b.num_rows:
            continue
        key = np.stack([b.column(c).to_numpy() for c in by], axis=1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
        if held and any(held[-1].column(c)[-1].as_py() != b.column(c)[0].as_py() for c in by):
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            held.append(b.slice(lo, hi - lo))
            if hi < b.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _sets(rows: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    ids = rows.column("id").to_numpy()
    first = np.unique(ids, return_index=True)[1]
    items = rows.column("items")
    return ids[first], [np.frombuffer(items[int(i)].as_py(), np.uint64) for i in first]


def linked(sets: list[np.ndarray], per_cent: int) -> list[tuple[int, int]]:
    """All pairs of the (few) sets that are linked."""
    token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, often = np.unique(token, return_inverse=True, return_counts=True)
    new = np.cumsum(often > 1) - 1  # a token of one set alone is in no intersection
    shared = often[column] > 1
    both = np.zeros((len(sets), len(sets)), np.int64)
    at, who = new[column[shared]], owner[shared]
    order = np.argsort(at, kind="stable")
    at, who = at[order], who[order]
    for lo in range(0, int(new[-1]) + 1, 1 << 16):
        part = slice(*np.searchsorted(at, [lo, lo + (1 << 16)]))
        m = np.zeros((len(sets), min(1 << 16, int(new[-1]) + 1 - lo)), np.float32)
        m[who[part], at[part] - lo] = 1
        both += (m @ m.T).astype(np.int64)
    size = np.array([len(s) for s in sets])
    good = (both > 0) & (100 * both >= per_cent * (size[:, None] + size[None, :] - both))
    return [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(good, 1)), strict=True)]


def _of_small_groups(items: DataFrame, per_cent: int) -> DataFrame:
    """id, root of the sets of groups that one task compares exhaustively."""

    def run(it):
        for rows in _runs(it, "group"):
            ids, sets = _sets(rows)
            root = list(range(len(ids)))
            for i, j in linked(sets, per_cent) if len(sets) > 1 else ():
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], ["id", "root"])
        trim()

    return items.repartition("group").sortWithinPartitions("group").mapInArrow(run, "id long, root long")


def _centres(items: DataFrame) -> DataFrame:
    """group, size, items: the shingles that more than half of a sample of a group's sets hold."""
    sample = items.filter(F.pmod(F.xxhash64("id"), F.greatest(F.col("size") / SAMPLE, F.lit(1)).cast("long")) == 0)

    def run(it):
        for rows in _runs(it, "group"):
            _, sets = _sets(rows)
            token, n = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([rows.column("group")[:1].combine_chunks(), rows.column("size")[:1].combine_chunks(), pa.array([token[2 * n > len(sets)].tobytes()], pa.binary())], ["group", "size", "items"])

    return sample.repartition("group").sortWithinPartitions("group").mapInArrow(run, "group long, size long, items binary")


def _differences(items: DataFrame, centres: DataFrame, per_cent: int) -> DataFrame:
    """group, id, cost, slack, delta array<long>: each set as its differences from the centre of its group.

    The last bit of a difference tells whether the shingle is missing or added. Each share of a group has a copy of its centre.
    """
    shares = F.ceil(F.col("size") / SHARE)
    own = items.select("group", F.pmod(F.xxhash64("id"), shares).alias("share"), F.lit(1).alias("kind"), "id", "items")
    centre = centres.select("group", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), "items")
    add = np.uint64(1)

    def run(it):
        of, have, middle = None, set(), np.empty(0, np.uint64)
        for b in it:
            out: list[tuple] = []
            for g, s, kind, i, raw in zip(*[b.column(c).to_pylist() for c in ("group", "share", "kind", "id", "items")], strict=True):
                if (g, s) != of:
                    of, have, middle = (g, s), set(), np.empty(0, np.uint64)
                x = np.frombuffer(raw, np.uint64)
                if kind == 0:
                    middle = x
                elif i not in have:
                    have.add(i)
                    gone, more = np.setdiff1d(middle, x, assume_unique=True), np.setdiff1d(x, middle, assume_unique=True)
                    cost = 100 * len(gone) + per_cent * len(more)
                    out.append((g, i, cost, (100 - per_cent) * len(middle), np.concatenate([gone & ~add, more | add]).view(np.int64)))
            if out:
                g, i, c, s, d = zip(*out, strict=True)
                ends = pa.array(np.cumsum([0, *map(len, d)]), pa.int32())
                yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in (g, i, c, s)], pa.ListArray.from_arrays(ends, pa.array(np.concatenate(d)))], ["group", "id", "cost", "slack", "delta"])
            trim()

    dealt = own.union(centre).repartition("group", "share").sortWithinPartitions("group", "share", "kind")
    return dealt.mapInArrow(run, "group long, id long, cost long, slack long, delta array<long>")


def _slots(group: np.ndarray, token: np.ndarray) -> np.ndarray:
    return (_mix((token ^ group).view(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64)


def _prefixes(open_: DataFrame, per_cent: int) -> DataFrame:
    """group, token, id, any, outer: by which differences a set can meet an outer one, and an outer one any set."""
    spark = open_.sparkSession

    def count(it):
        n = np.zeros(SLOTS, np.int64)
        for b in it:
            d = b.column("delta")
            group = np.repeat(b.column("group").to_numpy(), np.diff(d.offsets.to_numpy()))
            n += np.bincount(_slots(group, d.flatten().to_numpy()), minlength=SLOTS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["slot", "n"])

    # at most SLOTS rows, whatever the input
    met = open_.select("group", "delta").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(SLOTS, np.int64)
    often[met.column("slot").to_numpy()] = met.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(often)
    unit = 100 + per_cent

    def run(it):
        for b in it:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                d = part.column("delta")
                sizes, token = np.diff(d.offsets.to_numpy()), d.flatten().to_numpy()
                row = np.repeat(np.arange(len(sizes)), sizes)
                group, cost, slack, least = (part.column(c).to_numpy() for c in ("group", "cost", "slack", "least"))
                order = np.lexsort((token, shared.value[_slots(group[row], token)], row))
                token, place = token[order], np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                outer = cost + least > slack
                # differences that a set must share with an outer one, and an outer one with any
                any_, out = -((least - 1 - cost) // unit), np.maximum(1, -((slack - cost - least) // unit))
                is_any = place < (sizes - any_ + 1)[row]
                is_out = outer[row] & (place < (sizes - out + 1)[row])
                on = is_any | is_out
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group[row][on]), pa.array(token[on]), pa.array(part.column("id").to_numpy()[row][on]), pa.array(is_any[on]), pa.array(is_out[on])],
                    ["group", "token", "id", "any", "outer"],
                )

    out = written(open_.mapInArrow(run, "group long, token long, id long, any boolean, outer boolean"), "prefixes")
    shared.destroy()
    return out


def _neighbours(tokens: DataFrame) -> DataFrame:
    """a, b: sets that stand next to each other among those of one difference; a run that is cut by a range loses one pair."""

    def run(it):
        last = None
        for b in it:
            if not b.num_rows:
                continue
            group, token, ids = (b.column(c).to_numpy() for c in ("group", "token", "id"))
            if last is not None:
                group, token, ids = (np.r_[x, y] for x, y in zip(last, (group, token, ids), strict=True))
            same = (group[1:] == group[:-1]) & (token[1:] == token[:-1]) & (ids[1:] != ids[:-1])
            a, z = ids[:-1][same], ids[1:][same]
            pairs = np.unique(np.stack([np.minimum(a, z), np.maximum(a, z)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])
            last = (group[-1], token[-1], ids[-1])

    parts = max(1, -(-tokens.count() // ROWS_PER_TASK))
    dealt = tokens.select("group", "token", "id").repartitionByRange(parts, "group", "token", "id").sortWithinPartitions("group", "token", "id")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """up_a, up_b of the pairs (a, b) that are linked, by their whole differences."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("cost").alias(f"cost_{c}"), "slack" if c == "a" else F.lit(0).alias("unused"), F.col("up").alias(f"up_{c}"), F.col("delta").alias(f"delta_{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").filter("up_a <> up_b")
    good = met.filter((100 + per_cent) * F.size(F.array_intersect("delta_a", "delta_b")) >= F.col("cost_a") + F.col("cost_b") - F.col("slack"))
    return good.select("up_a", "up_b")


def _across(tokens: DataFrame, sets: DataFrame, of: DataFrame, per_cent: int) -> DataFrame:
    """a, b: pairs of sets of different parts of the forest that share a difference, where the parts may be linked at all.

    Symmetric differences obey the triangle inequality. If those of two parts' first sets are larger than both parts' radii and what a link
    allows for their largest sets, no set of one is linked with one of the other, and no pair of the two is made.
    """
    first = of.groupBy("part").agg(F.min("id").alias("id"))
    reps = written(first.join(sets.select("id", F.col("delta").alias("middle")), "id").select("part", "middle"), "difference-middles")
    apart = lambda x, y: F.size(x) + F.size(y) - 2 * F.size(F.array_intersect(x, y))
    added = F.size(F.filter("delta", lambda x: x.bitwiseAND(F.lit(1)) == 1))
    size = F.col("slack") / (100 - per_cent) + 2 * added - F.size("delta")
    spans = of.join(sets.select("id", "slack", "delta"), "id").join(reps, "part").groupBy("part").agg(F.max(apart("middle", "delta")).alias("radius"), F.max(size).alias("size"))
    spans = written(spans, "difference-spans")
    held = written(tokens.join(of.select("id", "part"), "id"), "difference-tokens")
    x = held.filter("outer").select("group", "token", F.col("part").alias("p")).distinct()
    y = held.filter("any").select("group", "token", F.col("part").alias("q")).distinct()
    both = written(x.join(y, ["group", "token"]).filter("p <> q").select("p", "q").distinct(), "difference-part-pairs")
    told = lambda c: spans.join(reps, "part").select(F.col("part").alias(c), *[F.col(n).alias(f"{n}_{c}") for n in ("radius", "size", "middle")])
    met = both.join(told("p"), "p").join(told("q"), "q")
    room = (F.col("size_p") + F.col("size_q")) * (100 - per_cent) / (100 + per_cent) + F.col("radius_p") + F.col("radius_q")
    maybe = met.filter(apart("middle_p", "middle_q") <= room + 1e-6).select("p", "q")
    mine = maybe.join(held.filter("outer").select(F.col("part").alias("p"), "group", "token", F.col("id").alias("x")), "p")
    pairs = mine.join(held.filter("any").select(F.col("part").alias("q"), "group", "token", F.col("id").alias("y")), ["q", "group", "token"])
    out = written(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "across")
    discard(reps, spans, held, both)
    return out


def _of_large_groups(items: DataFrame, per_cent: int) -> DataFrame:
    """id, root of the sets of larger groups."""
    centres = written(_centres(items), "centres")
    deltas = written(_differences(items, centres, per_cent), "differences")
    least = deltas.groupBy("group").agg(F.min(F.struct("cost", "id")).alias("least"), (F.max("cost") + F.min("cost") > F.max("slack")).alias("open"))
    deltas = written(deltas.join(least, "group").select("group", "id", "cost", "slack", F.col("least.cost").alias("least"), F.col("least.id").alias("least_id"), "open", "delta"), "differences")
    inner = F.col("cost") + F.col("least") <= F.col("slack")
    named = deltas.select("id", F.when(inner, F.col("least_id")).otherwise(F.col("id")).alias("root"))
    open_ = deltas.filter("open")
    if not open_.limit(1).count():
        return named
    tokens = _prefixes(open_, per_cent)
    sets = open_.select("group", "id", "cost", "slack", "delta", F.when(inner, F.col("least_id")).otherwise(F.col("id")).alias("up"))
    # a forest first: neighbours among the sets of a difference
    chain = written(_neighbours(tokens), "difference-neighbours")
    near = classes(_confirmed(chain, sets, per_cent).select(F.col("up_a").alias("a"), F.col("up_b").alias("b")))
    part = F.coalesce("root", "up")
    of = written(sets.select("group", "id", "up").join(near.select(F.col("id").alias("up"), "root"), "up", "left").select("group", "id", part.alias("part")), "difference-parts")
    pairs = written(_across(tokens, sets, of, per_cent), "differing-pairs")
    later = _confirmed(pairs, sets, per_cent).select(F.col("up_a").alias("a"), F.col("up_b").alias("b"))
    up = classes(later.union(near.select(F.col("id").alias("a"), F.col("root").alias("b"))))
    out = written(named.join(up.select(F.col("id").alias("root"), F.col("root").alias("up")), "root", "left").select("id", F.coalesce("up", "root").alias("root")), "large-classes")
    discard(centres, deltas, tokens, chain, near, of, pairs, up)
    return out


def _linked(documents: DataFrame, n: int, per_cent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, root (null in a row without a set or a doc_id) and kept."""
    own = written(signatures(documents, n), "signatures")
    first = F.struct("doc_id", "text_hash")
    sets = (
        own.filter(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("set_hash")
        .agg(F.min(first).alias("first"), F.first("tokens").alias("tokens"), F.first("bits").alias("bits"))
        .select("set_hash", "first.doc_id", "first.text_hash", "tokens", "bits")
    )
    sets = written(sets.withColumn("id", F.monotonically_increasing_id()), "sets")
    parts = max(1, -(-sets.count() * TREES // ROWS_PER_TASK))
    dealt = _paths(sets).repartitionByRange(parts, "node", "path").sortWithinPartitions("node", "path")
    joined = written(dealt.mapInArrow(_near, "a long, b long"), "near")
    groups = classes(joined)
    sizes = written(groups.groupBy("root").agg(F.count("*").alias("size")), "group-sizes")
    members = written(groups.withColumnRenamed("root", "group").join(sizes.withColumnRenamed("root", "group"), "group").join(sets.select("id", "doc_id", "text_hash"), "id"), "members")
    items = written(_items(members, documents, n), "items")
    small = written(_of_small_groups(items.filter(F.col("size") <= LEAF), per_cent), "small-classes")
    large = _of_large_groups(items.filter(F.col("size") > LEAF), per_cent)
    roots = small.union(large)
    named = written(sets.select("set_hash", "id", "doc_id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "named")
    # stored first, so that Spark can split a class of many sets in the join
    least = written(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "class-names")
    of_set = written(named.join(least, "root").select("set_hash", "component_id", "root"), "components")
    discard(joined, groups, sizes, members, items, small, large, sets, named, least)
    out = own.select("doc_id", "text_hash", "n_shingles", "set_hash").join(of_set, "set_hash", "left")
    there = F.col("doc_id").isNotNull()
    component = F.when(there, F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(component == F.col("doc_id"), F.lit(True))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.when(there, F.col("root")).alias("root"), kept.alias("kept"))


def link(documents: DataFrame, *, n: int = 5, per_cent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links lead to) and kept, one row for each document."""
    return _linked(documents, n, per_cent).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicated(documents: DataFrame, *, n: int = 5, per_cent: int = 80) -> DataFrame:
    """The rows of documents, all columns, but one row only of each class."""
    out = written(_linked(documents, n, per_cent).filter("root is not null").select("doc_id", "text_hash", "root"), "decided")
    key = F.struct("doc_id", "text_hash")
    first = written(out.groupBy("root").agg(F.min(key).alias("first")), "first-rows")
    told = out.join(first, "root").withColumn("is_first", key == F.col("first"))
    gone = written(told.filter("not is_first").select("doc_id", "text_hash").distinct(), "gone")
    again = written(told.filter("is_first").groupBy("doc_id", "text_hash").count().filter("count > 1").select("doc_id", "text_hash"), "repeated-rows")
    left = without(documents, gone.union(again))
    if not again.limit(1).count():
        return left
    rows, keys = keyed(documents), again.select(F.col("doc_id").alias("row_id"), F.col("text_hash").alias("row_hash"))
    one = rows.join(keys, ["row_id", "row_hash"], "left_semi").dropDuplicates(["row_id", "row_hash"]).drop("row_id", "row_hash")
    return left.union(one.toDF(*documents.columns))
