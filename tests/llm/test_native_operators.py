"""Line dedup and sharding against plain Python, with odd rows."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import line_runs, sharding
from tidemark.llm.line_runs import LineRuns, dedup_lines, hashed_lines, index_lines
from tidemark.llm.queries import op3_byte_shards, op5_line_dedup
from tidemark.llm.sharding import shard_by_bytes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute_lines(texts, min_docs):
    texts = [t or "" for t in texts]
    often = {k for k, n in Counter(k for t in texts for k in {key(x) for x in t.split("\n")}).items() if n >= min_docs and k}
    return ["\n".join(x for x in t.split("\n") if key(x) not in often) for t in texts]


@pytest.mark.parametrize(("batch_lines", "fanout", "fit"), [(1 << 20, 2, True), (100, 3, True), (40, 2, False)])
def test_line_dedup(spark, monkeypatch, batch_lines, fanout, fit):
    if not fit:  # settled runs too large to broadcast
        monkeypatch.setattr(line_runs, "fits", lambda *_: False)
    rng = random.Random(batch_lines)
    pool = ["A b", " a B\t", "É", "é", "x\x0b", "", " ", "one\r", "zz", "ONE"]
    texts = ["\n".join(rng.choice(pool + [f"line {rng.randrange(200)}"] * 3) for _ in range(rng.randrange(8))) for _ in range(120)] + [None, "", "\n", "A b\n\n"]
    docs = spark.createDataFrame([(i, t, "kept", "own") for i, t in enumerate(texts)], "doc_id long, text string, n_lines string, tm_hits string").withColumn("tm_text", F.lit("x"))
    out = {r["doc_id"]: r for r in dedup_lines(docs, min_docs=5, batch_lines=batch_lines, fanout=fanout).collect()}
    expected = brute_lines(texts, 5)
    for i, t in enumerate(texts):
        assert (out[i]["text"] or "") == expected[i], (i, t)
        assert out[i]["n_lines"] == (t or "").count("\n") + 1 and out[i]["tm_hits"] == "own" and out[i]["tm_text"] == "x"
        assert out[i]["n_lines"] - out[i]["n_dropped"] == (expected[i].count("\n") + 1 if expected[i] or out[i]["n_dropped"] < out[i]["n_lines"] else 0)
    assert dedup_lines(docs.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "same\nown")] * 6 + [(None, "same\nx"), (None, None), (1, "other")] + [(i, "same") for i in range(2, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = dedup_lines(docs, min_docs=6).collect()  # "same" is in documents 1 to 5 and one without an id; "own" in one
    assert len(out) == 13
    assert Counter(r["text"] for r in out) == Counter({"own": 6, "x": 1, None: 1, "other": 1, "": 4})
    assert Counter(r["text"] for r in dedup_lines(docs, min_docs=7).collect()) == Counter(t for _, t in rows)


def test_very_long_text(spark):
    long = "\n".join(f"line {i}" for i in range(120_000))
    docs = spark.createDataFrame([(i, long if i < 2 else "line 7\nown") for i in range(4)], "doc_id long, text string")
    out = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in dedup_lines(docs, min_docs=2, batch_lines=1000).collect()}
    assert out == {0: (120_000, 120_000), 1: (120_000, 120_000), 2: (2, 2), 3: (2, 2)}


def test_levels_settle_and_compact(spark):
    runs = LineRuns(spark, min_docs=4, fanout=2)
    for b in range(5):
        runs.add(spark.range(10).select(F.col("id").alias("h1"), F.lit(0).cast("long").alias("h2"), F.when(F.col("id") < 3, 2).otherwise(F.when(F.col("id") == b, 4).otherwise(0)).cast("long").alias("n")))
    assert runs.settled and len(runs.levels) > 1 and all(len(level) < 2 for level in runs.levels)
    assert sorted(r["h1"] for r in runs.frequent().collect()) == [0, 1, 2, 3, 4]
    docs = spark.createDataFrame([(i, f"q\nown {i}\npair {i // 2}") for i in range(60)], "doc_id long, text string")
    runs = index_lines(hashed_lines(docs), min_docs=9, batch_lines=20, fanout=2)
    assert runs.settled and len(runs.levels) > 2 and runs.frequent().count() == 1
    # once settled, a key enters no run any more
    counted = runs._read([p for level in runs.levels for p in level])
    assert counted.join(runs._read(runs.settled), ["h1", "h2"], "left_semi").count() == 0
    assert counted.agg(F.sum("n")).first()[0] == 120


def test_line_query_plan_has_no_python(spark, sf):
    out = op5_line_dedup(spark, sf)
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    expected = dict(zip(docs, brute_lines(docs.values(), 10), strict=True))
    assert {r["doc_id"]: r["kept_sha256"] for r in out.collect()} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in expected.items()}


def check_shards(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(shards))
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    sizes = [sum(r["size"] for r in by.get(s, [])) for s in range(shards)]
    total, largest = sum(sizes), max((r["size"] for r in rows), default=0)
    assert all(abs(x - total / shards) <= largest for x in sizes)


def test_shards_of_documents(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op3_byte_shards(spark, sf).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {d: (len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in docs.items()}
    check_shards(rows, 40)
    order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["doc_id"] for r in order] == sorted(docs)  # one file, stored by doc_id: shards are contiguous


def test_shards_follow_doc_id_over_files_of_any_size(spark, tmp_path):
    for i, ids in enumerate([range(0, 20), range(20, 200), range(200, 300)]):  # Spark reads the largest file first
        spark.createDataFrame([(d, "w" * (d % 7)) for d in ids], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / f"t/{i}"))
    docs = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "t")).withColumn("size", F.lit("own")).withColumn("at", F.lit("own"))
    out = shard_by_bytes(docs, shards=9)
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    rows = sorted(out.collect(), key=lambda r: (r["shard"], r["slot"]))
    assert [r["doc_id"] for r in rows] == list(range(300))
    hot = spark.createDataFrame([(7, "x")] * 400 + [(i, "y" * 100_000) for i in range(3)], "doc_id long, text string").repartition(5)
    check_shards(shard_by_bytes(hot, shards=5).collect(), 5)


def test_shards_of_many_partitions_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 3)
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, rng.randrange(50)]), rng.choice([None, "", "é" * rng.randrange(90), "x" * 5000])) for _ in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    found = shard_by_bytes(docs, shards=7).collect()
    assert len(found) == 500 and Counter(r["doc_id"] for r in found) == Counter(x[0] for x in rows)
    check_shards(found, 7)
    few = shard_by_bytes(docs.limit(3), shards=40).collect()
    check_shards(few, 40)
    assert shard_by_bytes(docs.limit(0)).count() == 0
