"""Helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.deploy import importable

_OWN: dict[str, str] = {}
#: Paths made and not removed yet.
_STORED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one on a local master."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="lawengine-")
    return _OWN[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which is removed by `remove`, or else when the driver's Python ends."""
    path = f"{shared_dir(spark)}/lawengine-{name}-{uuid.uuid4().hex}"
    _STORED.add(path)
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    if path not in _STORED:
        return
    _STORED.discard(path)
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the context has ended; the folder is left for the owner of the shared folder
        pass


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    A task that is lost is run again by Spark; readers only see committed files. The table is removed by
    `discard`, or else when the driver's Python ends.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lawengine_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of `written` that no later step reads; other frames are left alone."""
    for t in tables:
        if path := getattr(t, "_lawengine_path", None):
            remove(t.sparkSession, path)


def trim() -> None:
    """Give memory that this worker has freed back: an executor's limit is for its Python workers, too."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def portions(batch, column: str, most: int = 4 << 20):
    """Slices of a batch whose texts have about `most` bytes, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        n = max(1, int((sizes[at : at + 256].cumsum() <= most).sum()))
        yield batch.slice(at, n)
        at += n


#: Bytes of an Arrow batch, for each direction of each Python worker, and rows of a batch that is read from Parquet: whole texts
#: are long, and a task holds a few batches.
ARROW_BYTES, PARQUET_ROWS = 8 << 20, 512


def small_batches(spark: SparkSession) -> None:
    """Bound the session's batches for long rows; settings that are smaller already stay."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", PARQUET_ROWS)):
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or int(now) > most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c):
    """A-Z to a-z and nothing else; Spark's own lower() where the text is ASCII, since it is faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def place_of(df: DataFrame, name: str) -> int:
    """The place of a column: of the exact name first, else of the only one that differs in case."""
    at = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(at) != 1:
        raise ValueError(f"{len(at)} columns are called {name}, among {df.columns}")
    return at[0]


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns called #0, #1 ... by place, so that no name can clash with a helper column."""
    return df.toDF(*[f"#{i}" for i in range(len(df.columns))])


def only_columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, whatever else the table has; names are matched exactly first."""
    at = [place_of(df, n) for n in names]
    return numbered(df).select(*[F.col(f"`#{i}`").alias(n) for i, n in zip(at, names, strict=True)])


#: Rows of keys (a few numbers each) up to which they are broadcast, so that whole texts need not be shuffled to meet them.
KEYS = 500_000


def bounded(df: DataFrame, rows: int = KEYS) -> DataFrame:
    """df to be broadcast, if it has no more rows than that; a larger one is shuffled. It is counted first, so it should be cheap to read."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of documents, all columns, whose (doc_id, text_hash) isn't among keys; nulls are equal to nulls."""
    rows, keys = keyed(documents), keys.select(F.col("doc_id").alias("key_id"), F.col("text_hash").alias("key_hash")).distinct()
    left = rows.join(bounded(keys), rows["row_id"].eqNullSafe(F.col("key_id")) & (F.col("row_hash") == F.col("key_hash")), "left_anti")
    return left.drop("row_id", "row_hash").toDF(*documents.columns)


def keyed(documents: DataFrame) -> DataFrame:
    """`numbered` documents with row_id (doc_id as long) and row_hash (of the text), which tell different rows apart."""
    doc, text = (F.col(f"`#{place_of(documents, n)}`") for n in ("doc_id", "text"))
    return numbered(documents).withColumns({"row_id": doc.cast("long"), "row_hash": F.xxhash64(text)})
