"""Statistics against plain Python, and the learned list on labelled documents."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.queries import op2_quality_rules
from tidemark.llm.rules import DecisionList, judge, labelled_statistics, learn, learn_quality, statistics


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            duplicates += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(covered)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_statistics(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "\n", "\n\n", "a", "a\na", "a \na\n a", "é é é é", "a b c a b c", "x\x0by\x1cz", "a b\nc a b c\n", "# $ %", "a b c\n\na b c\n\n", "\na", "a" * 70000, "日本 語 日本 語 日本 語"]
    texts += ["".join(rng.choice(["a", "b", "é", " ", " ", "\n", "#", "\t"]) for _ in range(rng.randrange(60))) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in statistics(docs).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_query_statistics_and_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in op2_quality_rules(spark, sf).collect():
        expected = plain(texts[r["doc_id"]])
        assert tuple(r[c] for c in COLUMNS) == expected
        failed = expected[0] < 50 or 100 * expected[4] > 50 * expected[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    big = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    rules = learn_quality(docs, labels.where("doc_id % 4 != 0"))
    held = labelled_statistics(docs, labels.where("doc_id % 4 = 0"), "doc_id", "text", "quality", 10_000).withColumn("kept", rules.column())
    tally = {(r["bad"], r["kept"]): r["n"] for r in held.groupBy("bad", "kept").agg(F.count("*").alias("n")).collect()}
    right = tally.get((True, False), 0) + tally.get((False, True), 0)
    assert right >= 0.95 * sum(tally.values()), (tally, rules)
    assert tally.get((False, False), 0) <= 0.02 * sum(tally.values())


def test_learning_is_ordered_and_prunes():
    rng = np.random.default_rng(3)
    x = {"a": rng.random(900), "b": rng.random(900)}
    bad = (x["a"] >= 0.7) | (x["b"] < 0.1)
    found = learn(x, bad, np.arange(900) % 3 > 0)
    assert 2 <= len(found.rules) <= 4 and (found.rejects(x) == bad).mean() > 0.98
    noise = learn(x, rng.random(900) < 0.1, np.arange(900) % 3 > 0)
    assert noise.rejects(x).mean() < 0.1
    assert DecisionList(()).column() is not None


def test_rules_of_either_class_in_order(spark):
    rng = np.random.default_rng(5)
    x = {"mean_word_chars": rng.random(3000), "digit_rate": rng.random(3000)}
    bad = (x["mean_word_chars"] >= 0.5) & ~((x["digit_rate"] >= 0.4) & (x["digit_rate"] < 0.5))
    found = learn(x, bad, np.arange(3000) % 3 > 0)
    assert {k for _, k in found.rules} == {True, False} and (found.rejects(x) == bad).mean() > 0.98
    turned = DecisionList(found.rules[::-1])
    assert (turned.rejects(x) != found.rejects(x)).any()  # their order matters
    rows = [(float(a), float(b)) for a, b in zip(*(v[:300] for v in x.values()), strict=True)]
    # word_chars / n_words and n_digits / word_chars give the features back
    table = spark.createDataFrame([(i, a * 1e6, a * b * 1e6) for i, (a, b) in enumerate(rows)], "i long, word_chars double, n_digits double").withColumn("n_words", F.lit(1e6))
    table = table.withColumn("n_digits", F.col("n_digits"))
    kept = {r["i"]: r["k"] for r in table.where("word_chars >= 1").select("i", found.column().alias("k")).collect()}
    rejected = found.rejects({k: v[:300] for k, v in x.items()})
    assert all(kept[i] != rejected[i] for i in kept)


def test_a_labelled_id_that_is_repeated_counts_once(spark):
    docs = spark.createDataFrame([(1, "a b")] * 500 + [(1, "a a"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 0), (2, 1)], "doc_id long, quality int")
    rows = labelled_statistics(docs, labels, "doc_id", "text", "quality", 100).collect()
    assert sorted((r["tm_id"], r["bad"]) for r in rows) == [(1, True), (2, False)]


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b", 7), (1, "a b", 7), (None, None, 8), (2, "w " * 60, 9)], "doc_id long, text string, n_words long").withColumn("odd name-of: it", F.lit(1))
    labels = spark.createDataFrame([(1, 0), (None, 1), (2, None), (99, 1), (1, 0)], "doc_id long, quality int")
    out = judge(docs, labels).collect()
    assert len(out) == 4 and sorted(r["n_words"] for r in out) == [0, 2, 2, 60]
    assert all(not r["kept"] for r in out)
    assert judge(docs.limit(0), labels).count() == 0
    assert judge(docs, labels.limit(0)).count() == 4
