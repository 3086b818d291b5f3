"""Timelines kept as keyed state: a bounded ring of events for each key, with monotone numbers, as a stream goes on and over restarts.

State of a key: the next number and the highest discarded one (value state), the events of the ring (list state) and the ids met (map
state). An event takes the next number of its key. A newer delta of a response takes the place of the older one, and the response's
end takes the place of its delta. Where the ring is full, its oldest event goes and is remembered as discarded. An id counts once. With
a watermark, events older than it are late and dropped, and ids older than it are forgotten by a timer, so no key's state grows.

RocksDB holds the state; `session` sets what that needs. Within a batch a key's events are taken in the order of (ts, event_id).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.deploy import importable

CAPACITY = 1000
EVENT = "seq long, event_id string, kind string, response_id string, payload string"
OUT = "seq long, event_id string, kind string, response_id string, payload string, discarded_through long, held int, oldest long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ring:
    """The rules of a timeline, over plain lists; the processor loads it from state and stores it again."""

    def __init__(self, capacity: int, following: int = 1, discarded: int = 0, events: list[tuple] | None = None, *, delta: str = "delta", terminal: tuple[str, ...] = ("done", "error")):
        self.capacity, self.following, self.discarded, self.events = capacity, following, discarded, list(events or [])
        self.delta, self.terminal = delta, terminal

    def put(self, event_id: str, kind: str, response: str | None, payload: str | None) -> tuple:
        """The event with its number, and what the ring then holds."""
        seq, self.following = self.following, self.following + 1
        if response is not None and (kind == self.delta or kind in self.terminal):
            self.events = [e for e in self.events if not (e[2] == self.delta and e[3] == response)]
        if len(self.events) >= self.capacity:
            self.discarded = max(self.discarded, self.events[0][0])
            self.events = self.events[1:]
        self.events.append((seq, event_id, kind, response, payload))
        return (*self.events[-1], self.discarded, len(self.events), self.events[0][0])


class _Keyed(StatefulProcessor):
    def __init__(self, capacity: int, delta: str, terminal: tuple[str, ...], key_name: str):
        self.capacity, self.delta, self.terminal, self.key_name = capacity, delta, terminal, key_name

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", "following long, discarded long")
        self.ring = handle.getListState("ring", EVENT)
        self.ids = handle.getMapState("ids", "event_id string", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        now = self.counters.get() if self.counters.exists() else (1, 0)
        ring = Ring(self.capacity, now[0], now[1], [tuple(e) for e in self.ring.get()] if self.ring.exists() else [], delta=self.delta, terminal=self.terminal)
        new = pd.concat(list(rows)).sort_values(["at", "event_id"], kind="stable")
        out, latest = [], -1
        for r in new.itertuples(index=False):
            if (mark > 0 and r.at < mark) or self.ids.containsKey((r.event_id,)):
                continue
            self.ids.updateValue((r.event_id,), (int(r.at),))
            latest = max(latest, int(r.at))
            text = lambda v: None if v is None or v != v else str(v)
            out.append(ring.put(r.event_id, r.kind, text(r.response_id), text(r.payload)))
        self.counters.update((ring.following, ring.discarded))
        self.ring.put(ring.events)
        if latest >= 0:
            self.handle.registerTimer(latest + 1)  # by then the watermark is past all that was met so far
        if out:
            told = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
            told.insert(0, self.key_name, key[0])
            yield told

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for own, at in list(self.ids.iterator()):
            if at[0] < mark:
                self.ids.removeKey(own)
        return iter(())


def session(spark: SparkSession) -> None:
    """What keyed state needs, unless it is set already; a batch needs the coordinator of stores, which comes with the stream manager."""
    _ = spark.streams
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def timelines(events: DataFrame, key: str, *, capacity: int = CAPACITY, delay: str = "1 hour", delta: str = "delta", terminal: tuple[str, ...] = ("done", "error")) -> DataFrame:
    """key, seq, event_id, kind, response_id, payload, discarded_through, held, oldest: each event as it enters its key's timeline.

    events: a stream (or a frame, taken as one batch) with the key, event_id, ts, kind, response_id and payload. held and oldest tell
    what the ring holds after the event. Events without an id, a key or a time have no place and are left out.
    """
    importable(events.sparkSession)
    session(events.sparkSession)
    own = events.select(F.col(key), F.col("event_id").cast("string").alias("event_id"), "ts", F.unix_millis("ts").alias("at"), "kind", "response_id", "payload").filter(F.col(key).isNotNull() & F.col("event_id").isNotNull() & F.col("ts").isNotNull())
    kind = dict(own.dtypes)[key]
    processor = _Keyed(capacity, delta, terminal, key)
    timed = own.withWatermark("ts", delay)
    return timed.groupBy(key).transformWithStateInPandas(processor, f"`{key}` {kind}, {OUT}", "append", "EventTime")
