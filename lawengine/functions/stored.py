"""Tables written to the folder that driver and executors share, so that what is read many times is worked out once."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_PATHS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a local master without it, a temporary folder."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir"):
        return found.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="lawengine-")
    return _OWN[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of its own; `drop` removes it, or else the end of the driver's Python."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lawengine-{name}-{uuid.uuid4().hex}"
    _PATHS.add(path)
    atexit.register(_remove, spark, path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables of `stored`; other frames are left alone."""
    for t in tables:
        if path := getattr(t, "_stored_at", None):
            _remove(t.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    if path in _PATHS:
        _PATHS.discard(path)
        with contextlib.suppress(Exception):  # the context has ended; the folder's owner has it
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
