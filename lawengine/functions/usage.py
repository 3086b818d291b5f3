"""Usage counters: how often named operations ran, for how long, and how fast; on the driver, of rows as Spark counts them, and of streams."""

from __future__ import annotations

import time
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


@dataclass
class Counters:
    """Count and seconds by name: of blocks of the driver's code (`timed`), of frames that Spark runs (`observed`), and of streams
    (`listener`). Rows of frames are counted by the tasks that run them anyway; no further pass is made."""

    unit: str = "iter"
    count: dict[str, float] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)

    def add(self, name: str, n: float = 1, seconds: float = 0.0) -> None:
        self.count[name] = self.count.get(name, 0) + n
        self.seconds[name] = self.seconds.get(name, 0.0) + seconds

    @contextmanager
    def timed(self, name: str, n: float = 1):
        began = time.perf_counter()
        try:
            yield self
        finally:
            self.add(name, n, time.perf_counter() - began)

    @contextmanager
    def observed(self, df: DataFrame, name: str):
        """The frame to run inside of the block, once: its rows and the block's seconds are added when the block ends."""
        seen, began = Observation(), time.perf_counter()
        yield df.observe(seen, F.count(F.lit(1)).alias("rows"))
        took = time.perf_counter() - began
        self.add(name, seen.get["rows"], took)

    def listener(self, spark: SparkSession) -> StreamingQueryListener:
        """Adds the input rows and the seconds of every batch of every named stream, until `spark.streams.removeListener`."""
        found = _Batches(self)
        spark.streams.addListener(found)
        return found

    def pace(self, name: str) -> float | None:
        """Seconds for one unit."""
        return self.seconds[name] / self.count[name] if self.count.get(name) else None

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(n, float(c), self.seconds[n], self.pace(n), self.unit) for n, c in sorted(self.count.items())]
        return spark.createDataFrame(rows, "name string, count double, seconds double, seconds_per_unit double, unit string")


class _Batches(StreamingQueryListener):
    def __init__(self, counters: Counters):
        self.counters = counters

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name:
            self.counters.add(p.name, p.numInputRows, p.batchDuration / 1000)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
