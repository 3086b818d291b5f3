import random
import time
import uuid

from pyspark.sql import functions as F

from lawengine.streaming import events, ring


def test_stream_equals_batch(spark, sf, tmp_path):
    path = f"{sf}/events.parquet"
    batch = {(r["start"], r["event_type"]): r["n"] for r in events.tumbling(events.read(spark, path, streaming=False)).collect()}
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy(path, tmp_path / "in")
    s = events.tumbling(events.read(spark, str(tmp_path / "in")))
    got = events.drained(s, "t" + uuid.uuid4().hex, mode="complete", checkpoint=str(tmp_path / "c"))
    assert {(r["start"], r["event_type"]): r["n"] for r in got.collect()} == batch


def test_timeline(spark):
    df = spark.createDataFrame([(1, "a", "delta", "x"), (2, "a", "delta", "xy"), (3, "b", "delta", "q"), (4, "b", "done", "z"), (5, "b", "delta", "late")], "seq long, response_id string, kind string, payload string")
    got = {r["response_id"]: (r["kind"], r["payload"], r["ended"]) for r in events.compacted(df).collect()}
    assert got == {"a": ("delta", "xy", False), "b": ("done", "z", True)}
    rows, state = events.page(df, 0, limit=2, capacity=3)
    assert [r["seq"] for r in rows.collect()] == [3, 4] and state["truncated"] and state["discarded_through"] == 2


def test_records_are_handed_over_in_order_and_few_at_a_time(spark, tmp_path):
    df = spark.createDataFrame([(i, f"r{i % 3}", "delta", str(i)) for i in range(70)], "seq long, response_id string, kind string, payload string")
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    events.to_records(stream, lambda rows: seen.append([r["seq"] for r in rows]), str(tmp_path / "c")).awaitTermination()
    assert [len(s) for s in seen] == [32, 32, 6] and [x for s in seen for x in s] == list(range(70))


def test_a_cursor_is_kept(spark, tmp_path):
    df = spark.createDataFrame([(i, str(i)) for i in range(1, 51)], "seq long, payload string")
    at = events.Cursor(spark, str(tmp_path / "cursors"), "reader")
    first, _ = at.page(df)
    again, told = events.Cursor(spark, str(tmp_path / "cursors"), "reader").page(df)
    assert [r["seq"] for r in first] == list(range(1, 33)) and [r["seq"] for r in again] == list(range(33, 51)) and not told["truncated"]
    assert at.page(df)[0] == [] and at.get() == 50
    fresh, told = at.page(df.filter("seq < 5"))
    assert told["cursor_reset"] and [r["seq"] for r in fresh] == [1, 2, 3, 4] and at.get() == 4


def replay(batches, capacity, delay_ms):
    """Plain timelines: dictionaries of lists, batch by batch."""
    now, out, top = {}, [], None
    for rows in batches:
        mark = max(0, top - delay_ms) if top is not None else 0
        for key, event_id, at, kind, response, payload in sorted(rows, key=lambda r: (r[2], r[1])):
            state = now.setdefault(key, {"next": 1, "gone": 0, "ring": [], "ids": set()})
            if (mark and at < mark) or event_id in state["ids"]:
                continue
            state["ids"].add(event_id)
            if response is not None and kind in ("delta", "done"):
                state["ring"] = [e for e in state["ring"] if e[1:] != ("delta", response)]
            if len(state["ring"]) == capacity:
                state["gone"] = state["ring"].pop(0)[0]
            state["ring"].append((state["next"], kind, response))
            out.append((key, state["next"], event_id, kind, response, payload, state["gone"], len(state["ring"]), state["ring"][0][0]))
            state["next"] += 1
        top = max([r[2] for r in rows] + ([top] if top is not None else []))
    return out


def test_timelines_go_on_after_a_restart(spark, tmp_path):
    """Deltas, ends, a full ring, repeated and late events, over a stop and a start from the checkpoint, equal a plain replay."""
    rng = random.Random(3)
    batches, n = [], 0
    for b in range(5):
        rows = []
        for _ in range(40):
            n += 1
            at = 1_700_000_000_000 + b * 3_600_000 + rng.randrange(3_600_000)
            rows.append((f"u{rng.randrange(3)}", f"e{n:04d}", at, rng.choice(["delta", "delta", "done", "note"]), rng.choice(["r1", "r2", None]), f"p{n}"))
        if b:
            rows += rng.sample(batches[b - 1], 10)  # repeated
            rows.append(("u0", f"late{b}", 1_700_000_000_000 - 1, "note", None, "late"))
        batches.append(rows)
    src, check, sink = tmp_path / "in", str(tmp_path / "check"), str(tmp_path / "out")
    src.mkdir()
    schema = "user string, event_id string, at long, kind string, response_id string, payload string"

    def run(part):
        for b in part:
            spark.createDataFrame(batches[b], schema).coalesce(1).write.mode("append").parquet(f"{src}/b{b}")
            stream = spark.readStream.schema(schema).parquet(f"{src}/*").withColumn("ts", F.timestamp_millis("at")).drop("at")
            ring.timelines(stream, "user", capacity=6, delay="2 hours").writeStream.format("parquet").option("path", sink).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()

    run([0, 1])
    run([2, 3, 4])  # another query, from the same checkpoint
    got = sorted(tuple(r) for r in spark.read.parquet(sink).collect())
    assert sorted(got, key=str) == sorted(replay(batches, 6, 7_200_000), key=str)
    assert 200 <= len(got) < 204 and max(r[6] for r in got) > 0 and max(r[7] for r in got) == 6


def test_a_batch_of_events_is_one_replay(spark):
    rows = [("k", "b", 5, "delta", "r", "x"), ("k", "a", 5, "delta", "r", "y"), ("k", "c", 9, "done", "r", "z"), ("k", "c", 11, "note", None, "again"), (None, "d", 3, "note", None, ""), ("k", None, 3, "note", None, "")]
    df = spark.createDataFrame(rows, "user string, event_id string, at long, kind string, response_id string, payload string").withColumn("ts", F.timestamp_millis("at")).drop("at")
    got = [tuple(r) for r in ring.timelines(df, "user").orderBy("seq").collect()]
    assert got == [("k", 1, "a", "delta", "r", "y", 0, 1, 1), ("k", 2, "b", "delta", "r", "x", 0, 1, 2), ("k", 3, "c", "done", "r", "z", 0, 1, 3)]
    assert ring.timelines(df.limit(0), "user").count() == 0


def test_usage_counts_rows_and_batches(spark, tmp_path):
    from lawengine.functions.usage import Counters

    used = Counters(unit="row")
    with used.observed(spark.range(1000).filter("id % 3 = 0"), "thirds") as df:
        assert df.selectExpr("sum(id)").first()[0] == 166833
    assert used.count["thirds"] == 334 and used.seconds["thirds"] > 0 and used.pace("thirds") > 0
    spark.range(70).write.parquet(str(tmp_path / "in"))
    heard = used.listener(spark)
    name = "usage" + uuid.uuid4().hex
    events.drained(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), name, checkpoint=str(tmp_path / "c"))
    for _ in range(100):  # progress is told a little later
        if used.count.get(name) == 70:
            break
        time.sleep(0.1)
    spark.streams.removeListener(heard)
    assert used.count[name] == 70 and {r["name"] for r in used.table(spark).collect()} == {"thirds", name}
