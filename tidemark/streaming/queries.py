"""Structured Streaming twins of the event rules, run to the end of the input (availableNow) for a batch result.

Each reads a folder of Parquet files as a stream, keeps state with a watermark or in applyInPandasWithState, and
writes to a sink in the shared folder; checkpoints lie beside it, so a run that is broken off goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources.tables import shared_folder


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """events.parquet as a stream (a file or a folder of files)."""
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(path if "*" in path else f"{sf}/events*.parquet")


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything the stream gives until its present input ends."""
    spark = stream.sparkSession
    folder = shared_folder(spark, f"streams/{name}")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).format("parquet").option("path", f"{folder}/out").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_complete(stream: DataFrame, name: str) -> DataFrame:
    """The whole result table as of the end of the input (complete mode: the sink gets all rows at each trigger)."""
    spark = stream.sparkSession
    folder = shared_folder(spark, f"streams/{name}")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_batches(stream: DataFrame, name: str, keys: list[str], order: str) -> DataFrame:
    """For update-mode results: every micro-batch is kept by foreachBatch, and the latest row of each key read back."""
    from tidemark.operators.pages import upsert_latest

    spark = stream.sparkSession
    folder = shared_folder(spark, f"streams/{name}")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("tm_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    kept = spark.read.parquet(f"{folder}/out").drop("batch")
    key = F.struct(*keys) if len(keys) > 1 else F.col(keys[0])
    return upsert_latest(kept.withColumn("tm_key", key), "tm_key", "tm_batch", order).drop("tm_key", "tm_batch")


def dedup(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, event_type, first_ts): the first event of each user and kind; late events correct it."""
    stream = event_stream(spark, sf).groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts"))
    return run_batches(stream, "dedup", ["user_id", "event_type"], "first_ts")


def sessions(spark: SparkSession, sf: str, gap: str = "1 hour", late: str | None = None) -> DataFrame:
    """(user_id, first_ts, events) of session windows; a gap equal to ``gap`` begins a new one.

    Without late, all sessions up to the end of the input (complete mode). With it, a watermark bounds the state, and
    sessions are given once they are closed for events that late.
    """
    stream = event_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = stream.withWatermark("ts", late) if late else stream
    counted = stream.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    counted = counted.select("user_id", F.col("w.start").alias("first_ts"), "events")
    return run_to_end(counted, "sessions") if late else run_complete(counted, "sessions")


def bucket(spark: SparkSession, sf: str, capacity: int = 3, refill_per_s: float = 0.00001) -> DataFrame:
    """(user_id, allowed, denied) of a token bucket kept as state; the events of a micro-batch are taken in their order."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last, allowed, denied = state.get if state.exists else (capacity, None, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        for t in rows["t"].astype("int64"):
            gained = int((t - last) * refill_per_s) if last is not None else 0
            tokens = min(capacity, tokens + gained)
            if last is None or gained:
                last = int(t)
            if tokens > 0:
                tokens, allowed = tokens - 1, allowed + 1
            else:
                denied += 1
        state.update((tokens, last, allowed, denied))
        yield pd.DataFrame({"user_id": [key[0]], "allowed": [allowed], "denied": [denied]})

    stream = event_stream(spark, sf).select("user_id", "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long").alias("t"))
    out = stream.groupBy("user_id").applyInPandasWithState(step, "user_id long, allowed long, denied long", "tokens int, last long, allowed long, denied long", "update", GroupStateTimeout.NoTimeout)
    return run_batches(out, "bucket", ["user_id"], "allowed")
