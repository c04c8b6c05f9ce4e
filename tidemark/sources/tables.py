"""Scans: Parquet tables by name, text files whole or by line, delimited logs, JSON reports, settings."""

from __future__ import annotations

import atexit
import contextlib
import json
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt over the cores if it is read in fewer pieces than there are cores; larger tables are read as they lie, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder named in ``spark.checkpoint.dir``; below a temporary one only where that is unset on a single machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, for what several plans read; deleted when the driver's Python ends."""
    spark = df.sparkSession
    path = shared_folder(spark, f"staged/{name}")
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the driver's JVM may be gone
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def source(spark: SparkSession, code_or_path: str) -> DataFrame:
    """(doc_id, text): text with a line end or above 500 characters as it is, else the file of that name if there is one, else the text."""
    inline = "\n" in code_or_path or len(code_or_path) > 500
    if not inline and Path(code_or_path).exists():
        return text_files(spark, code_or_path)
    return spark.createDataFrame([("inline", code_or_path)], "doc_id string, text string")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) with one row for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("text"))


def config_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of environment files below path, a folder that driver and executors see; Spark's own readers leave out names that begin with a dot."""
    found = [(str(p),) for p in sorted(Path(path).rglob("*.env")) if p.is_file()]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in map(Path, batch["path"]):
                own = p.read_text(errors="replace").split("\n")
                own = own[:-1] if own[-1] == "" else own
                yield pd.DataFrame({"file": [p.name] * len(own), "line": [x.removesuffix("\r") for x in own]})

    return spark.createDataFrame(found, "path string").mapInPandas(read, "file string, line string")


def append_log(spark: SparkSession, path: str, schema: str, separator: str = "\n---\n") -> DataFrame:
    """Rows of a log of JSON documents with a separator between them."""
    raw = spark.read.text(path, lineSep=separator).where(F.trim("value") != "")
    return raw.select(F.from_json(F.trim("value"), schema).alias("r")).select("r.*")


def report_rows(spark: SparkSession, path: str) -> DataFrame:
    """(id, query, engine, marks) of a benchmark report with a map of results in each question."""
    schema = "questions array<struct<id:string,query:string,results:map<string,struct<overlapLines:int,marks:double>>>>"
    q = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("questions").alias("q"))
    return q.select("q.id", "q.query", F.explode("q.results").alias("engine", "r")).select("id", "query", "engine", "r.marks")


def write_by_engine(rows: DataFrame, path: str, engine: str = "engine") -> None:
    """One folder of JSON for each engine."""
    rows.write.mode("overwrite").partitionBy(engine).json(path)


def chart_series(rows: DataFrame, engines: list[str]) -> DataFrame:
    """(id, one column for each engine, truth): marks as shares up to 1, missing as 0, beside a constant 1."""
    wide = rows.groupBy("id").pivot("engine", engines).agg(F.max(F.least(F.lit(1.0), F.col("marks") / 10)))
    return wide.select("id", *[F.coalesce(e, F.lit(0.0)).alias(e) for e in engines], F.lit(1.0).alias("truth"))


def settings(stored: dict | str | None, defaults: dict) -> dict:
    """Stored settings over defaults; only known names count."""
    given = json.loads(stored) if isinstance(stored, str) else stored or {}
    return {k: given.get(k, v) for k, v in defaults.items()}
