"""Server-sent event frames: a paced source, and the consumer's state machine as an ordered fold or a stateful stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FRAME = "stream string, seq int, at_ms int, event string, data string"


def frames(spark: SparkSession, stream: str, labels: list[str], context: str, every_ms: int = 600, done_ms: int = 3400) -> DataFrame:
    """A step frame for each label, every_ms apart, and one done frame with the context."""
    rows = [(stream, i, (i + 1) * every_ms, "step", json.dumps({"label": x})) for i, x in enumerate(labels)]
    return spark.createDataFrame([*rows, (stream, len(labels), done_ms, "done", json.dumps({"context": context}))], FRAME)


def consumed(found: DataFrame) -> DataFrame:
    """(stream, state, steps, context): steps until done or error; frames after either are ignored."""
    body = F.from_json("data", "struct<label:string,context:string>")
    rows = found.select("stream", F.struct("seq", "event", body.alias("body")).alias("f"))
    ordered = rows.groupBy("stream").agg(F.array_sort(F.collect_list(F.struct(F.col("f.seq").alias("seq"), F.col("f.event").alias("event"), F.col("f.body.label").alias("label"), F.col("f.body.context").alias("context")))).alias("f"))
    start = F.struct(F.lit("busy").alias("state"), F.array().cast("array<string>").alias("steps"), F.lit(None).cast("string").alias("context"))

    def step(s, f):
        busy = s["state"] == "busy"
        return F.struct(
            F.when(busy & (f["event"] == "done"), "done").when(busy & (f["event"] == "error"), "error").otherwise(s["state"]).alias("state"),
            F.when(busy & (f["event"] == "step"), F.concat(s["steps"], F.array(f["label"]))).otherwise(s["steps"]).alias("steps"),
            F.when(busy & (f["event"] == "done"), f["context"]).otherwise(s["context"]).alias("context"),
        )

    return ordered.select("stream", F.aggregate("f", start, step).alias("s")).select("stream", "s.state", "s.steps", "s.context")


def released(events: DataFrame, key: str, value: str, ready: str) -> DataFrame:
    """(key, value) of a stream: values wait in the key's state until a row with ``ready`` true comes, then go out in order."""
    kind = events.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_, held = state.get if state.exists else (False, [])
        held, out = list(held), []
        for pdf in batches:
            for v, r in zip(pdf[value], pdf[ready], strict=True):
                open_ = open_ or bool(r)
                if v is not None:
                    held.append(v)
                if open_:
                    out += held
                    held = []
        state.update((open_, held))
        yield pd.DataFrame({key: [k[0]] * len(out), value: out})

    chosen = events.select(key, F.col(value).cast("string").alias(value), ready)
    return chosen.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {value} string", "open boolean, held array<string>", "append", GroupStateTimeout.NoTimeout)


def once(events: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """The first row of each key within a watermark: state is dropped once rows that late are no longer waited for."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
