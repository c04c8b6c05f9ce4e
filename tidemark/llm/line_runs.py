"""Line deduplication over levelled sorted runs of line hashes. DataFrame functions only, no Python on the executors.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, with A-Z in lower case. One scan of the documents
writes the hashes of their lines, dealt by doc_id into ``BUCKETS`` folders; a *batch* is as many folders as hold about
``batch_lines`` lines. The index is a set of runs, each a table of (two 64-bit hashes of a key, number of documents),
sorted by hash:

* a batch is anti-joined with the *settled* runs, which hold the keys already known to be frequent, before its keys are
  counted (where the settled runs are too large to broadcast, keys are counted first, so that no hot one is shuffled
  line by line, and then merge-anti-joined); what is left becomes a run of its own on level 0. Keys of runs that are
  not settled still need their documents counted, so they cannot be left out;
* when a level has ``fanout`` runs, they are compacted into one run of the next level; keys that reach ``min_docs``
  there go to a settled run instead;
* a key's count is the sum over the levels, so `LineRuns.frequent` is exact whatever the batches were.

Defined results: a null or empty text is one empty line; a key shorter than ``min_chars`` code points (the empty key)
never goes; rows that repeat a doc_id are one document when documents are counted, rows without a doc_id are documents
of their own; rows with equal doc_id and text share their result; all other columns pass through untouched, whatever
they are called (n_lines and n_dropped are replaced). An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import delete, fits, new_path, release, small, stage, text_key

STRIP = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASHES = ["h1", "h2"]
#: Folders that line hashes are dealt into, so at most so many batches; and lines of a batch.
BUCKETS, BATCH_LINES = 16, 1 << 20


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIP)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_hashes(key: Column) -> Column:
    """128 bits: two seeds, so that a frequent key does not take a rare one with it at any corpus size."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


def hashed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 1) -> DataFrame:
    """bucket, tm_id, tm_text (the text's key), tm_lines and tm_keys: each line's hashes in the order of the text, and those of its distinct keys; null for short keys.

    Distinct keys are told apart as strings: Spark compares structs in an array pair by pair, which a text of many lines
    would not survive.
    """
    keys = F.transform(lines_of(F.col(text)), line_key)
    hashes = lambda x: F.transform(x, lambda k: F.when(F.char_length(k) >= min_chars, key_hashes(k)))
    bucket = F.pmod(F.xxhash64(F.col(doc_id), F.when(F.col(doc_id).isNull(), text_key(F.col(text)))), F.lit(BUCKETS)).cast("int")
    rows = docs.select(bucket.alias("bucket"), F.col(doc_id).alias("tm_id"), text_key(F.col(text)).alias("tm_text"), keys.alias("tm_lines"))
    return stage(rows.select("bucket", "tm_id", "tm_text", hashes(F.col("tm_lines")).alias("tm_lines"), hashes(F.array_distinct("tm_lines")).alias("tm_keys")), "line-hashes", "bucket")


class LineRuns:
    """The levelled index. Runs are Parquet folders below ``root`` in the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, fanout: int = 3, root: str | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.root = root or new_path(spark, "line-runs")
        self.levels: list[list[str]] = [[]]
        self.settled: list[str] = []
        self._made = 0

    def _write(self, df: DataFrame) -> str:
        path, self._made = f"{self.root}/run-{self._made}", self._made + 1
        df.sortWithinPartitions(*HASHES).write.parquet(path)
        return path

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("h1 long, h2 long, n long").parquet(*paths)

    def _totals(self, paths: list[str]) -> DataFrame:
        return self._read(paths).groupBy(*HASHES).agg(F.sum("n").alias("n"))

    def add(self, lines: DataFrame) -> None:
        """A batch's (h1, h2, n), keys more than once: those that are not settled become a run of level 0."""
        done = self._read(self.settled).select(*HASHES) if self.settled else None
        first = done is not None and fits(done, 32)
        if first:
            lines = lines.join(F.broadcast(done), HASHES, "left_anti")
        counts = lines.groupBy(*HASHES).agg(F.sum("n").alias("n"))
        if done is not None and not first:
            counts = counts.join(done.hint("merge"), HASHES, "left_anti")
        self.levels[0].append(self._write(counts))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """All runs of a level become one run of the next, less the keys that reach min_docs."""
        if level + 1 == len(self.levels):
            self.levels.append([])
        merged = stage(self._totals(self.levels[level]), "line-merge")
        self.settled.append(self._write(merged.where(F.col("n") >= self.min_docs)))
        self.levels[level + 1].append(self._write(merged.where(F.col("n") < self.min_docs)))
        delete(self.spark, *self.levels[level])
        self.levels[level] = []
        release(self.spark, merged)

    def frequent(self) -> DataFrame:
        """(h1, h2) of every key in at least min_docs documents."""
        open_runs = [p for level in self.levels for p in level]
        found = [self._totals(open_runs).where(F.col("n") >= self.min_docs).select(*HASHES)] if open_runs else []
        found += [self._read(self.settled).select(*HASHES)] if self.settled else []
        return reduce(DataFrame.unionByName, found)


def batches_of(hashed: DataFrame, batch_lines: int) -> list[list[int]]:
    """Buckets of each batch."""
    batches: list[list[int]] = [[]]
    held = 0
    for bucket, n in sorted(hashed.groupBy("bucket").agg(F.sum(F.size("tm_lines"))).collect()):  # one row for each bucket
        if batches[-1] and held + n > batch_lines:
            batches.append([])
            held = 0
        batches[-1].append(bucket)
        held += n
    return batches


def index_lines(hashed: DataFrame, min_docs: int = 10, batch_lines: int = BATCH_LINES, fanout: int = 3) -> LineRuns:
    """The batches of hashed lines enter the index one after another; a document is in one batch."""
    runs = LineRuns(hashed.sparkSession, min_docs, fanout)
    again = hashed.where(F.col("tm_id").isNotNull()).groupBy("tm_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("tm_id").alias("again"))
    again = stage(again, "line-repeated-ids")
    repeated = None if again.isEmpty() else small(again)
    for buckets in batches_of(hashed, batch_lines):
        own = hashed.where(F.col("bucket").isin(buckets))
        keys = lambda rows: rows.select("tm_id", F.explode("tm_keys").alias("k")).where(F.col("k").isNotNull()).select("tm_id", "k.h1", "k.h2")
        if repeated is None:
            lines = keys(own)
        else:
            lines = keys(own.join(repeated, own["tm_id"] == repeated["again"], "left_anti")).unionByName(keys(own.join(repeated, own["tm_id"] == repeated["again"], "left_semi")).distinct())
        runs.add(lines.select(*HASHES, F.lit(1).cast("long").alias("n")))
    return runs


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, batch_lines: int = BATCH_LINES, fanout: int = 3) -> DataFrame:
    """docs with their frequent lines taken out of ``text``, and n_lines, n_dropped (long) added; see the module."""
    spark = docs.sparkSession
    hashed = hashed_lines(docs, doc_id, text, min_chars)
    runs = index_lines(hashed, min_docs, batch_lines, fanout)
    frequent = stage(runs.frequent(), "line-frequent")
    delete(spark, runs.root)
    release(spark)
    lines = hashed.select("tm_id", "tm_text", F.posexplode("tm_lines").alias("tm_at", "k")).where(F.col("k").isNotNull())
    hits = lines.select("tm_id", "tm_text", "tm_at", "k.h1", "k.h2").join(small(frequent), HASHES, "left_semi")
    hits = stage(hits.groupBy("tm_id", "tm_text").agg(F.collect_set("tm_at").alias("tm_hits")), "line-hits")
    release(spark, hashed, frequent)
    hits = small(hits)
    own = docs.join(hits, docs[doc_id].eqNullSafe(hits["tm_id"]) & (text_key(docs[text]) == hits["tm_text"]), "left")
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # split once, as a column: an expression would be split anew for every line that is looked up in it
    split, dropped = (f"tm-{uuid.uuid4().hex}" for _ in range(2))
    own = own.select(*[docs[c] for c in names], lines_of(docs[text]).alias(split), hits["tm_hits"].alias(dropped))
    n = F.size(split)
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col(dropped))
    kept = F.when(F.col(dropped).isNull(), F.col(text)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(split), i)), "\n"))
    return own.select(
        *[kept.alias(c) if c == text else F.col(f"`{c}`") for c in names],
        n.cast("long").alias("n_lines"),
        F.when(F.col(dropped).isNull(), F.lit(0)).otherwise(F.size(dropped)).cast("long").alias("n_dropped"),
    )
