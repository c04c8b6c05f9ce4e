"""Contiguous, byte-balanced shards by a global prefix sum. DataFrame functions only, no Python on the executors.

The order of the rows is that of doc_id (nulls first; ties by checksum, size, and place in the input), whatever files
or partitions they come from. Only (doc_id, size, checksum) rows are put in order: they are range-partitioned by it, so
that a hot doc_id is spread over partitions as well, sorted, and staged with their partition and position written down.
Each partition's total comes from one small aggregate; an exclusive prefix sum over the totals in two levels (blocks of
partitions, then partitions in a block) gives each partition its offset, and a running sum inside the partition does
the rest. The row that starts at byte b of the corpus goes to shard ``b * shards div total``: shards are contiguous, and
differ from equal size by one row at most at either end. Texts are read once and never shuffled.

Defined results: a null text has no bytes and CRC 0; null and repeated doc_ids and repeated rows are rows like any
other; a corpus with fewer rows than shards leaves shards empty; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import release, stage

BLOCK = 1024


def prefix_offsets(totals: DataFrame, key: str, *values: str) -> DataFrame:
    """Exclusive prefix sums of values over the long key, in two levels, so that no task sees all keys."""
    block = F.floor(F.col(key) / BLOCK).alias("block")
    blocks = totals.groupBy(block).agg(*[F.sum(v).alias(v) for v in values])
    # one row for each BLOCK partitions of the input
    over = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", *[F.coalesce(F.sum(v).over(over), F.lit(0)).alias(f"block_{v}") for v in values])
    inner = Window.partitionBy("block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    within = totals.withColumn("block", F.floor(F.col(key) / BLOCK)).select(key, "block", *[F.coalesce(F.sum(v).over(inner), F.lit(0)).alias(v) for v in values])
    return within.join(blocks, "block").select(key, *[(F.col(v) + F.col(f"block_{v}")).alias(f"before_{v}") for v in values])


def shard_by_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus overhead), text_crc32, shard (0 to shards - 1), slot (gapless from 0 in a shard)."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text), F.lit(""))
    at = F.monotonically_increasing_id()
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(raw) + overhead).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), at.alias("at"))
    rows = stage(rows, "shard-sizes")  # places are written down, so that sorting sees the same ones again
    order = ["doc_id", "text_crc32", "size", "at"]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "size", "text_crc32", F.monotonically_increasing_id().alias("at"))
    placed = stage(sorted_rows, "shard-order")
    release(spark, rows)
    rows = placed.withColumn("part", F.shiftright("at", 33))
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    offsets = prefix_offsets(totals, "part", "bytes", "rows")
    inner = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("run_bytes", F.coalesce(F.sum("size").over(inner), F.lit(0))).withColumn("run_rows", F.coalesce(F.count("at").over(inner), F.lit(0)))
    total = totals.agg(F.sum("bytes")).first()[0] or 1  # a single number
    start = (F.col("before_bytes") + F.col("run_bytes")) * shards
    placed = placed.join(offsets, "part").select("doc_id", "size", "text_crc32", start.alias("start"), (F.col("before_rows") + F.col("run_rows")).alias("row"))
    placed = placed.withColumn("shard", F.expr(f"cast(start div {total} as int)"))
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # at most one row for each shard
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"))
