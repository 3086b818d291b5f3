"""Structured Streaming over event tables: windows with watermarks, running profiles, and an event timeline.

Every builder takes a frame, streaming or not; on a batch frame it gives what the stream comes to in the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ieee


def read(spark: SparkSession, path: str, *, streaming: bool = True, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet event table with `ts` as an instant (a watermark needs one)."""
    schema = spark.read.parquet(path).schema
    if streaming:
        r = spark.readStream.schema(schema)
        if files_per_trigger:
            r = r.option("maxFilesPerTrigger", files_per_trigger)
        df = r.parquet(path)
    else:
        df = spark.read.parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def _late(df: DataFrame, delay: str) -> DataFrame:
    return df.withWatermark("ts", delay) if df.isStreaming else df


def tumbling(df: DataFrame, width: str = "1 hour", *, delay: str = "1 hour") -> DataFrame:
    w = _late(df, delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(df: DataFrame, width: str = "2 hours", step: str = "1 hour", *, delay: str = "1 hour") -> DataFrame:
    w = _late(df, delay).groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "n")


def sessions(df: DataFrame, gap: str = "30 minutes", *, delay: str = "1 hour") -> DataFrame:
    w = _late(df, delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def running_profile(df: DataFrame, *, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts and moments of finite values for each window and type: what can be kept up without the rows."""
    v = F.when(ieee.finite(F.col("value")), F.col("value"))
    w = _late(df, delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.count(v).alias("finite"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "finite", "min", "max", "mean", "variance")


def running_histogram(df: DataFrame, low: float, high: float, bins: int, *, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    place = F.least(F.floor((F.col("value") - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    inside = _late(df, delay).filter(F.col("value").between(low, high)).withColumn("bin", place)
    return inside.groupBy(F.window("ts", width), "bin").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "bin", "n")


def running_metrics(df: DataFrame, target: str, prediction: str, *, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """mse, mae and r2 of each window."""
    from ..functions import metrics

    y, p = F.col(target), F.col(prediction)
    w = _late(df, delay).groupBy(F.window("ts", width)).agg(F.count("*").alias("n"), metrics.mse(y, p).alias("mse"), metrics.mae(y, p).alias("mae"), metrics.r2(y, p).alias("r2"))
    return w.select(F.col("window.start").alias("start"), "n", "mse", "mae", "r2")


# the event timeline: (seq, response_id, kind, payload[, ts])


def compacted(df: DataFrame, *, terminal: tuple[str, ...] = ("done", "error")) -> DataFrame:
    """Of each response the newest delta, or, once it has ended, its end alone."""
    ends = F.col("kind").isin(*terminal)
    one = df.groupBy("response_id").agg(
        F.max("seq").alias("seq"), F.max_by(F.struct("kind", "payload"), F.struct(ends.cast("int"), "seq")).alias("last"), F.count_if(ends).alias("ended")
    )
    return one.select("response_id", "seq", F.col("last.kind").alias("kind"), F.col("last.payload").alias("payload"), (F.col("ended") > 0).alias("ended"))


def page(df: DataFrame, cursor: int, *, limit: int = 32, capacity: int = 1000) -> tuple[DataFrame, dict]:
    """Events after a cursor, and whether some that it asks for have left the ring of `capacity` events."""
    r = df.agg(F.max("seq").alias("top")).first()
    top = r["top"] if r["top"] is not None else -1
    oldest = max(top - capacity + 1, 0)
    rows = df.filter((F.col("seq") > cursor) & (F.col("seq") >= oldest)).orderBy("seq").limit(limit)
    return rows, {"truncated": cursor + 1 < oldest, "discarded_through": oldest - 1, "cursor_reset": cursor > top}


def unique(df: DataFrame, key: str = "event_id", *, delay: str = "1 hour") -> DataFrame:
    """Events once each, as far back as the watermark reaches."""
    return df.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key]) if df.isStreaming else df.dropDuplicates([key])


def drained(stream: DataFrame, name: str, *, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all there is now into a table in memory: for small results and tests."""
    w = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    q = w.start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def to_table(stream: DataFrame, path: str, checkpoint: str):
    """Exactly-once append to Parquet."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_records(stream: DataFrame, sink, checkpoint: str, *, order: str = "seq", most: int = 32, poll: str | None = None):
    """Hand the records of a stream to sink(list of dicts), in the order of `order` within a batch, at most `most` at a time.

    No more than `most` records are on the driver at once, and the next ones are fetched when sink returns: a slow sink holds the
    stream back. A batch that fails is handed over again, so a sink that must not see records twice remembers the last one.
    poll: the trigger's interval; without it, all there is now.
    """

    def hand_over(df: DataFrame, batch: int) -> None:
        held: list[dict] = []
        for r in df.orderBy(order).toLocalIterator():
            held.append(r.asDict(recursive=True))
            if len(held) == most:
                sink(held)
                held = []
        if held:
            sink(held)

    w = stream.writeStream.foreachBatch(hand_over).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=poll) if poll else w.trigger(availableNow=True)).start()


class Cursor:
    """A reader's place in a timeline, kept as a table: one row for each move, of which the last counts."""

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name = spark, path, name

    def get(self) -> int:
        from pyspark.errors import AnalysisException

        try:
            rows = self.spark.read.parquet(self.path)
        except AnalysisException:  # no move yet
            return 0
        last = rows.filter(F.col("name") == self.name).agg(F.max_by("seq", "move").alias("seq")).first()["seq"]
        return 0 if last is None else last

    def set(self, seq: int) -> None:
        move = F.unix_micros(F.current_timestamp()).alias("move")
        self.spark.range(1).select(F.lit(self.name).alias("name"), F.lit(int(seq)).cast("long").alias("seq"), move).write.mode("append").parquet(self.path)

    def page(self, df: DataFrame, *, limit: int = 32, capacity: int = 1000) -> tuple[list[dict], dict]:
        """The next records, after which the cursor moves on; a cursor beyond the timeline's end begins anew."""
        at = self.get()
        rows, told = page(df, at, limit=limit, capacity=capacity)
        if told["cursor_reset"]:
            rows, again = page(df, 0, limit=limit, capacity=capacity)
            told = again | {"cursor_reset": True}
        got = [r.asDict() for r in rows.collect()]  # at most `limit`
        if got or told["cursor_reset"]:
            self.set(got[-1]["seq"] if got else 0)
        return got, told
