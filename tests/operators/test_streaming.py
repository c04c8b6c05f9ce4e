"""Streams against the batch rules, over several files and micro-batches."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import tasks
from tidemark.plans import record_queries
from tidemark.streaming import frames, queries


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", ["stream_dedup", "stream_sessions", "stream_bucket"])
def test_twins(spark, sf, name):
    got = getattr(record_queries, name)(spark, sf)
    if name == "stream_bucket":
        assert rows(got.select("user_id", "allowed", "denied")) == rows(record_queries.token_bucket(spark, sf).select("user_id", "allowed", "denied"))
    elif name == "stream_sessions":
        assert got.agg(F.sum("sessions")).first()[0] == record_queries.sessions(spark, sf).agg(F.sum("sessions")).first()[0]
    else:
        e = spark.read.parquet(f"{sf}/events.parquet")
        assert got.count() == e.select("user_id", "event_type").distinct().count()


def test_sessions_with_a_watermark_close(spark, sf):
    closed = queries.sessions(spark, sf, late="1 day")
    every = queries.sessions(spark, sf)
    assert 0 < closed.count() <= every.count() and set(rows(closed)) <= set(rows(every))


def test_micro_batches(spark, tmp_path):
    base = "2024-01-01 00:00:"
    parts = [[(1, "a", f"{base}00", False), (2, "b", f"{base}01", False)], [(1, "c", f"{base}02", True), (1, "a", f"{base}03", False)], [(1, "d", f"{base}04", False), (2, "b", f"{base}05", False)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, "user long, v string, ts string, ready boolean").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    schema = spark.read.parquet(str(tmp_path / "in/0")).schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = queries.run_to_end(frames.released(stream, "user", "v", "ready"), "released")
    assert sorted(r["v"] for r in out.collect()) == ["a", "a", "c", "d"] and {r["user"] for r in out.collect()} == {1}
    first = queries.run_to_end(frames.once(stream, "v", "ts", "1 hour"), "once")
    assert sorted(r["v"] for r in first.collect()) == ["a", "b", "c", "d"]


def test_frames(spark):
    good = frames.frames(spark, "s", ["one", "two", "three", "four", "five"], "ctx")
    assert [r["at_ms"] for r in good.collect()] == [600, 1200, 1800, 2400, 3000, 3400]
    broken = spark.createDataFrame([("t", 0, 1, "step", '{"label": "x"}'), ("t", 1, 2, "error", "{}"), ("t", 2, 3, "step", '{"label": "late"}'), ("u", 0, 1, "step", "not json")], frames.FRAME)
    got = {r["stream"]: (r["state"], r["steps"], r["context"]) for r in frames.consumed(good.unionByName(broken)).collect()}
    assert got == {"s": ("done", ["one", "two", "three", "four", "five"], "ctx"), "t": ("error", ["x"], None), "u": ("busy", [None], None)}


def test_tasks(spark):
    asked = tasks.enqueue(spark.createDataFrame([("http://v/1.mp4",), ("",), (None,)], "video_url string"))
    assert [r["code"] for r in asked.collect()] == [202, 400, 400]
    assert asked.where("code = 202").first()["payload"] == '{"video_url":"http://v/1.mp4"}'
    payloads = spark.createDataFrame([('{"video_url":"u"}', "video:compress"), ("{bad", "video:compress"), ("{}", "other"), (None, None)], "payload string, type string")
    assert [r["permanent"] for r in tasks.decoded(payloads).collect()] == [False, True, True, True]
    out = tasks.dispatch(payloads, {"video:compress": lambda t: t.select("payload")})
    assert out["video:compress"].count() == 2 and out["unknown"].count() == 2
    name = spark.range(1).select(tasks.output_name(F.lit("clip"), F.to_timestamp(F.lit("2024-05-06 07:08:09")), F.lit("video/mp4; x=y"))).first()[0]
    assert name == "clip-20240506070809.mp4"
