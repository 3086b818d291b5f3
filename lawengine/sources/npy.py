"""NPY and NPZ arrays: a Python data source for Spark, and writers. Pickled objects are never read."""

from __future__ import annotations

import ast
import io
import os
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.deploy import importable
from ..functions.stored import drop, stored

MAGIC = b"\x93NUMPY"
ROWS = 1 << 20


def header(f) -> tuple[np.dtype, tuple[int, ...], bool, int]:
    """(dtype, shape, column-major, offset of the data) of an open NPY file."""
    if f.read(6) != MAGIC:
        raise ValueError("not an NPY file")
    major, _ = f.read(2)
    size = struct.unpack("<H", f.read(2))[0] if major == 1 else struct.unpack("<I", f.read(4))[0]
    told = ast.literal_eval(f.read(size).decode("latin1" if major < 3 else "utf8"))
    dtype = np.dtype(told["descr"])
    if dtype.hasobject:
        raise ValueError("object arrays are not read")
    return dtype, tuple(told["shape"]), bool(told["fortran_order"]), 8 + (2 if major == 1 else 4) + size


def load(path: str) -> np.ndarray:
    return np.load(path, allow_pickle=False)


class NpySource(DataSource):
    """spark.read.format("npy").load(path): one row for each element: i0.. (ordinals of its axes) and value.

    The path is one that Python can open on every executor. Row-major arrays are read in ranges of elements.
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> T.StructType:
        with open(self.options["path"], "rb") as f:
            dtype, shape, _, _ = header(f)
        kind = T.StringType() if dtype.kind in "US" else T.DoubleType() if dtype.kind == "f" else T.BooleanType() if dtype.kind == "b" else T.LongType()
        return T.StructType([*(T.StructField(f"i{k}", T.LongType()) for k in range(len(shape))), T.StructField("value", kind)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return NpyReader(self.options["path"])

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return NpyWriter(self.options["path"], self.options["descr"], int(self.options["rows"]))


class Elements(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class NpyReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        with open(self.path, "rb") as f:
            _, shape, _, _ = header(f)
        n = int(np.prod(shape, dtype=np.int64))
        return [Elements(i, min(i + ROWS, n)) for i in range(0, n, ROWS)] or [Elements(0, 0)]

    def read(self, partition: Elements) -> Iterator[pa.RecordBatch]:
        with open(self.path, "rb") as f:
            dtype, shape, column_major, offset = header(f)
        flat = np.memmap(self.path, dtype, "r", offset, shape=(int(np.prod(shape, dtype=np.int64)),)) if np.prod(shape) else np.empty(0, dtype)
        for lo in range(partition.start, partition.stop, 1 << 16):
            yield elements(flat[lo : min(lo + (1 << 16), partition.stop)], lo, dtype, shape, column_major)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The array's rows. A path with a scheme is read by Spark, as one row of bytes (2 GB at most), which a task takes apart."""
    importable(spark)
    if "://" in path and not path.startswith("file://"):
        return _taken_apart(spark, path)
    path = path.removeprefix("file://")
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("path", path).load()


def _taken_apart(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    start = files.select(F.substring("content", 1, 4096).alias("head")).first()["head"]
    dtype, shape, _, _ = header(io.BytesIO(bytes(start)))
    kind = "string" if dtype.kind in "US" else "double" if dtype.kind == "f" else "boolean" if dtype.kind == "b" else "long"

    def run(it):
        for b in it:
            for content in b.column("content"):
                data = content.as_buffer()
                dtype, shape, column_major, offset = header(io.BytesIO(memoryview(data)[:4096]))
                n = int(np.prod(shape, dtype=np.int64))
                flat = np.frombuffer(data, dtype, n, offset)
                for lo in range(0, n, 1 << 16):
                    yield elements(flat[lo : lo + (1 << 16)], lo, dtype, shape, column_major)

    return files.select("content").mapInArrow(run, "".join(f"i{k} long, " for k in range(len(shape))) + f"value {kind}")


def elements(own: np.ndarray, lo: int, dtype: np.dtype, shape: tuple[int, ...], column_major: bool) -> pa.RecordBatch:
    """Rows of the elements from place lo on."""
    axes = np.unravel_index(np.arange(lo, lo + len(own)), shape, order="F" if column_major else "C") if shape else ()
    value = own.astype(str).tolist() if dtype.kind in "US" else own.astype(float if dtype.kind == "f" else bool if dtype.kind == "b" else np.int64)
    return pa.RecordBatch.from_arrays([*(pa.array(a.astype(np.int64)) for a in axes), pa.array(value)], [*(f"i{k}" for k in range(len(shape))), "value"])


def from_array(spark: SparkSession, a: np.ndarray) -> DataFrame:
    """The same rows as read(), of an array in memory."""
    a = np.asarray(a)
    if a.dtype.hasobject:
        raise ValueError("object arrays are not read")
    axes = np.unravel_index(np.arange(a.size), a.shape) if a.ndim else ()
    value = a.ravel().astype(str).tolist() if a.dtype.kind in "US" else a.ravel().astype(float if a.dtype.kind == "f" else bool if a.dtype.kind == "b" else np.int64)
    return spark.createDataFrame(pa.table([*(pa.array(x.astype(np.int64)) for x in axes), pa.array(value)], [*(f"i{k}" for k in range(a.ndim)), "value"]))


def read_npz(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Each array of an NPZ file, which is read on the driver."""
    with zipfile.ZipFile(path) as z:
        return {n.removesuffix(".npy"): from_array(spark, np.load(io.BytesIO(z.read(n)), allow_pickle=False)) for n in z.namelist() if n.endswith(".npy")}


_KINDS = {"double": "<f8", "float": "<f4", "bigint": "<i8", "int": "<i4", "smallint": "<i2", "tinyint": "|i1", "boolean": "|b1"}


class NpyWriter(DataSourceArrowWriter):
    """Rows (place, value) go to their own bytes of a file that has its whole size from the beginning; the commit gives it its name.

    A task that runs again writes the same bytes at the same places, and readers never see a file that isn't whole.
    """

    def __init__(self, path: str, descr: str, rows: int):
        self.path, self.descr, self.rows = path, descr, rows
        self.part = f"{path}.{uuid.uuid4().hex}.part"
        with open(self.part, "wb") as f:
            np.lib.format.write_array_header_1_0(f, {"descr": descr, "fortran_order": False, "shape": (rows,)})
            self.offset = f.tell()
            f.truncate(self.offset + rows * np.dtype(descr).itemsize)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        dtype, n = np.dtype(self.descr), 0
        with open(self.part, "r+b") as f:
            for b in iterator:
                if b.column(1).null_count:
                    raise ValueError("a null has no place in an NPY file")
                place = b.column(0).to_numpy()
                values = np.array(b.column(1).to_pylist(), dtype) if dtype.kind == "U" else b.column(1).to_numpy(zero_copy_only=False).astype(dtype)
                ends = [0, *(np.flatnonzero(np.diff(place) != 1) + 1).tolist(), len(place)]
                for lo, hi in zip(ends, ends[1:], strict=False):
                    if lo < hi:
                        f.seek(self.offset + int(place[lo]) * dtype.itemsize)
                        f.write(values[lo:hi].tobytes())
                n += len(place)
        return Written(n)

    def commit(self, messages: list) -> None:
        if sum(m.rows for m in messages if m is not None) != self.rows:
            raise RuntimeError("rows are missing")
        os.replace(self.part, self.path)

    def abort(self, messages: list) -> None:
        if os.path.exists(self.part):
            os.remove(self.part)


@dataclass
class Written(WriterCommitMessage):
    rows: int


def write(df: DataFrame, path: str, column: str, *order: str) -> None:
    """A column without nulls as one NPY file, in order, at a path that Python can open on the driver and every executor.

    Spark sorts the column into a stored table, whose rows keep their place within their partition; a count for each partition
    gives all rows their place in the file, and tasks write there. No value passes through the driver.
    """
    spark, kind = df.sparkSession, dict(df.dtypes)[column]
    importable(spark)
    if kind != "string" and kind not in _KINDS:
        raise ValueError(f"no NPY type for {kind}")
    held = stored(df.orderBy(*order).select(F.monotonically_increasing_id().alias("id"), F.col(column).alias("value")), "npy-column")
    try:
        longest = held.agg(F.max(F.char_length("value"))).first()[0] or 1 if kind == "string" else None
        descr = f"<U{longest}" if kind == "string" else _KINDS[kind]
        sizes = held.groupBy(F.shiftright("id", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row for each task
        ends = np.cumsum([0, *[r["n"] for r in sizes]]).tolist()
        before = spark.createDataFrame([(r["part"], int(e)) for r, e in zip(sizes, ends, strict=False)], "part long, before long")
        place = F.col("before") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
        rows = held.join(F.broadcast(before), F.shiftright("id", 33) == F.col("part")).select(place.alias("place"), "value")
        spark.dataSource.register(NpySource)
        rows.write.format("npy").option("path", path).option("descr", descr).option("rows", str(ends[-1])).mode("append").save()
    finally:
        drop(held)
