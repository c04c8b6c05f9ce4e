"""Scoring rankings against labelled ranges: marks, hits at k, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import overlap_lines


def marks(predicted: DataFrame, truth: DataFrame, on: list[str]) -> DataFrame:
    """truth with overlap and marks (0 to 10, the share of the truth covered); no prediction gives 0."""
    p = predicted.select(*on, F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    joined = truth.join(p, on, "left")
    shared = F.coalesce(overlap_lines(F.col("p_start"), F.col("p_end"), F.col("start"), F.col("end")), F.lit(0))
    return joined.withColumn("overlap", shared).withColumn("marks", F.least(F.lit(10.0), F.col("overlap") / (F.col("end") - F.col("start") + 1) * 10))


def step_marks(share: Column) -> Column:
    return F.when(share >= 0.5, 10).when(share >= 0.2, 5).when(share > 0, 1).otherwise(0)


def hits_at(first: DataFrame, by: list[str], ranks: tuple[int, ...] = (1, 3, 5), rank: str = "first_rank") -> DataFrame:
    """Questions, hits and hit rates (percent) at each rank; first has the rank of each question's first hit, null if none."""
    counts = [F.count_if(F.col(rank) <= k).alias(f"hit_{k}") for k in ranks]
    grouped = first.groupBy(*by).agg(F.count("*").alias("questions"), *counts)
    return grouped.select(*by, "questions", *[f"hit_{k}" for k in ranks], *[F.round(F.col(f"hit_{k}") * 100.0 / F.col("questions"), 2).alias(f"rate_{k}") for k in ranks])


def engine_table(scored: DataFrame, engine: str = "engine") -> DataFrame:
    """engine, total, accuracy (percent of the most possible), place."""
    out = scored.groupBy(engine).agg(F.round(F.sum("marks"), 4).alias("total"), F.round(F.sum("marks") * 10.0 / F.count("*"), 2).alias("accuracy"))
    return out.withColumn("place", F.rank().over(Window.orderBy(F.col("total").desc())))  # one row for each engine


def rollup_marks(scored: DataFrame, *levels: str) -> DataFrame:
    """Average marks by each level, and overall, in one pass."""
    return scored.rollup(*levels).agg(F.round(F.avg("marks"), 4).alias("avg_marks"), F.count("*").alias("questions"))


def leads(table: DataFrame, engine: str = "engine") -> DataFrame:
    """An engine table with each engine's lead over the next one (0 for the last)."""
    order = Window.orderBy(F.col("total").desc(), engine)  # one row for each engine
    return table.withColumn("lead", F.round(F.col("total") - F.coalesce(F.lead("total").over(order), F.col("total")), 4))


def best_by_group(table: DataFrame, groups: DataFrame, group: str = "kind", engine: str = "engine") -> DataFrame:
    """(group, best, total): the best engine of each group of engines; groups is (engine, group)."""
    joined = table.join(groups, engine)
    return joined.groupBy(group).agg(F.max_by(engine, F.struct("total", engine)).alias("best"), F.max("total").alias("total"))


def category_table(scored: DataFrame, engines: list[str], category: str = "lang", engine: str = "engine") -> DataFrame:
    """One row for each category, one column of average marks for each engine."""
    return scored.groupBy(category).pivot(engine, engines).agg(F.round(F.avg("marks"), 4))


def markdown(table: DataFrame, title: str, rows: int = 200) -> str:
    """A finished report table as Markdown; for aggregates of a few rows (at most ``rows`` are shown)."""
    lines = [f"## {title}", "", f"| {' | '.join(table.columns)} |", f"|{'-|' * len(table.columns)}"]
    lines += [f"| {' | '.join('' if v is None else str(v) for v in r)} |" for r in table.take(rows)]
    return "\n".join([*lines, ""])
