"""Token-ID output: bit-plane shuffling.

Ids are cut into blocks of a fixed size, each block is transposed into byte (or bit) planes, and each plane is
compressed with zstandard. A store is a Parquet table, which any store that Spark writes to can hold and whose
commit survives lost tasks. One row is a chunk of whole documents; its columns `sizes` (bytes of each plane),
`doc_ids` and `ends` are the index of the chunk, so that any document can be read without its neighbours.

Null or empty texts are documents of one id, the end id. Rows of one doc_id are next to each other, in the order of their
texts' hashes; null doc_ids come first. An empty table gives an empty store. Columns other than doc_id and text are not
read.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import only_columns, remove, scratch, written
from .tokens import encoder

BLOCK = 65_536
CHUNK_IDS = 262_144
CHUNK = "shard int, chunk int, start long, n_ids long, planes string, block int, sizes array<int>, data binary, doc_ids array<long>, ends array<long>"


def to_planes(ids: np.ndarray, planes: str = "byte") -> list[bytes]:
    """The planes of one block, most significant last (byte) or first in each byte (bit)."""
    rows = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if planes == "byte":
        return [r.tobytes() for r in rows]
    return [np.packbits((ids >> np.uint32(b)) & np.uint32(1)).tobytes() for b in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        rows = np.empty((n, 4), np.uint8)
        for k, p in enumerate(planes):
            rows[:, k] = np.frombuffer(p, np.uint8)
        return rows.reshape(-1).view("<u4")
    out = np.zeros(n, np.uint32)
    for b, p in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype(np.uint32) << np.uint32(b)
    return out


def pack(ids: np.ndarray, planes: str = "byte", block: int = BLOCK, level: int = 1) -> tuple[list[int], bytes]:
    """Sizes of the compressed planes, block by block, and the planes themselves."""
    put = zstandard.ZstdCompressor(level=level).compress
    parts = [put(p) for i in range(0, len(ids), block) for p in to_planes(ids[i : i + block], planes)]
    return [len(p) for p in parts], b"".join(parts)


def unpack(sizes: list[int], data: bytes, n: int, planes: str = "byte", block: int = BLOCK) -> np.ndarray:
    get, each = zstandard.ZstdDecompressor().decompress, 4 if planes == "byte" else 32
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    parts = [get(data[a:b]) for a, b in zip(at, at[1:], strict=False)]
    blocks = [from_planes(parts[k * each : (k + 1) * each], min(block, n - k * block)) for k in range(-(-n // block))]
    return np.concatenate(blocks) if blocks else np.empty(0, np.uint32)


def write_store(documents: DataFrame, path: str, tokenizer: str, *, kind: str = "byte", end_id: int = 0, planes: str = "byte", block: int = BLOCK, docs_per_shard: int = 10_000) -> None:
    """Encode whole texts and write the store at path, documents in ascending doc_id order.

    Rows are range-sorted by doc_id, and rows of one doc_id by their text and their place, so that a doc_id of many rows
    is dealt out, too. A range is a shard; it is encoded where it is sorted.
    """
    schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("planes", pa.string()), ("block", pa.int32()), ("sizes", pa.list_(pa.int32())), ("data", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])

    def chunks(it):
        enc, tail = encoder(tokenizer, kind), array("I", [end_id]).tobytes()
        shard, chunk, start, size = TaskContext.get().partitionId(), 0, 0, 0
        held: list[tuple[int, np.ndarray]] = []

        def row():
            nonlocal chunk, start, size, held
            ids = np.concatenate([x for _, x in held])
            ends = np.cumsum([len(x) for _, x in held])
            sizes, data = pack(ids, planes, block)
            out = {"shard": shard, "chunk": chunk, "start": start, "n_ids": len(ids), "planes": planes, "block": block, "sizes": sizes, "data": data, "doc_ids": [d for d, _ in held], "ends": ends.tolist()}
            chunk, start, size, held = chunk + 1, start + len(ids), 0, []
            return pa.RecordBatch.from_pylist([out], schema=schema)

        for b in it:
            for d, t in zip(b.column("doc_id"), b.column("text"), strict=True):
                held.append((d.as_py(), np.frombuffer(enc.encode(t.as_py()) + tail, "<u4")))
                size += len(held[-1][1])
                if size >= CHUNK_IDS:
                    yield row()
        if held:
            yield row()

    docs = only_columns(documents, "doc_id", "text").withColumns({"doc_id": F.col("doc_id").cast("long"), "h": F.xxhash64("text"), "at": F.monotonically_increasing_id()})
    parts = max(1, -(-documents.count() // docs_per_shard))
    ordered = docs.repartitionByRange(parts, "doc_id", "h", "at").sortWithinPartitions("doc_id", "h", "at").select("doc_id", "text")
    ordered.mapInArrow(chunks, CHUNK).write.option("compression", "uncompressed").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start long (ids of all documents before it), n_tokens long, ids binary (32-bit)."""
    rows = spark.read.schema(CHUNK).parquet(path)
    # one row for each shard: as many as the writer had tasks, each of many documents
    totals = rows.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def docs(it):
        for b in it:
            for k in range(b.num_rows):  # a chunk at a time: its ids are as many as it says, and no more are held
                r = b.slice(k, 1).to_pylist()[0]
                ids = unpack(r["sizes"], r["data"], r["n_ids"], r["planes"], r["block"])
                starts = [0, *r["ends"][:-1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array([r["base"] + r["start"] + s for s in starts], pa.int64()), pa.array([e - s for s, e in zip(starts, r["ends"], strict=True)], pa.int64()), pa.array([ids[s:e].tobytes() for s, e in zip(starts, r["ends"], strict=True)], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return rows.join(before, "shard").mapInArrow(docs, "doc_id long, start long, n_tokens long, ids binary")


def with_crc32(docs: DataFrame, column: str = "ids") -> DataFrame:
    return docs.withColumn("ids_crc32", F.crc32(column)).drop(column)


def store_digest(documents: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the store, read it back, and digest each document's ids."""
    spark = documents.sparkSession
    store = path or scratch(spark, "token-store")
    write_store(documents, store, tokenizer)
    out = written(with_crc32(read_store(spark, store)).select("doc_id", "start", "n_tokens", "ids_crc32"), "token-digest")
    if path is None:
        remove(spark, store)
    return out
