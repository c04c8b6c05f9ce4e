"""Corpus pipeline: quality rules, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the
columns of ``documents``, with n_chars brought up to date where a stage changes the text.

Defined results: null texts have no words and are rejected by the first stage (a later stage on its own keeps them as
texts without words); rows that repeat a doc_id are judged one by one, and are one document where documents are counted;
near duplicates that tie in doc_id all stay; other columns than those of documents are not carried; an empty table goes
through all stages and gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import stage
from tidemark.llm.contamination import decontaminate
from tidemark.llm.jaccard import drop_near_duplicates
from tidemark.llm.line_runs import dedup_lines
from tidemark.llm.packing import pack
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.rules import base_failed, learn_quality, statistics

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or that the learned decision list rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = learn_quality(docs, labels)
    kept = statistics(docs.select(*COLUMNS), keep_text=True).where(~base_failed() & rules.column())
    return kept.select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that ten documents or more share out of every document."""
    out = dedup_lines(docs.select(*COLUMNS), min_docs=10, min_chars=1)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles at a similarity of 0.8 or more: the smallest doc_id."""
    return drop_near_duplicates(docs.select(*COLUMNS), k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of ten words of a benchmark item."""
    marked = decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    return marked.where(~F.col("contaminated")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), capacity=2048, separator=0, packed_ids=True)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("best-fit packing", packing)]

#: The learned list and the packing have no SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
