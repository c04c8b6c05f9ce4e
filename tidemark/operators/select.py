"""Choosing results: overlap suppression by an ordered fold, padding to a fixed number, sub-windows.

Only ranges of one document can overlap, so the fold over a query's candidates in rank order is a fold over each of its
documents, of which the first k that were chosen are kept, and the k best of these. No candidate is left out, and a task
holds the candidates of one query in one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _disjoint(chosen: Column, c: Column) -> Column:
    return ~F.exists(chosen, lambda s: (s["cover_start"] <= c["test_end"]) & (s["cover_end"] >= c["test_start"]))


def _half_free(chosen: Column, c: Column) -> Column:
    shared = lambda s: F.least(s["cover_end"], c["test_end"]) - F.greatest(s["cover_start"], c["test_start"]) + 1
    return ~F.exists(chosen, lambda s: 2 * F.greatest(F.lit(0), shared(s)) > c["test_end"] - c["test_start"] + 1)


def suppress(candidates: DataFrame, query: str, doc: str, k: int, rule: str = "strict", cover: tuple[Column, Column] | None = None, test: tuple[Column, Column] | None = None, score: str = "score") -> DataFrame:
    """(query, doc, start, end, score, rank) of up to k results of each query.

    rule "strict": reject what touches a chosen range of the document; "half": reject if more than half of it is
    covered. test is the range that is tested, cover the range a result takes up (both start, end unless given: padded
    ranges give the padded variants).
    """
    ts, te = test or (F.col("start"), F.col("end"))
    cs, ce = cover or (F.col("start"), F.col("end"))
    row = F.struct((-F.round(score, 6)).alias("order"), "start", "end", F.col(score).cast("double").alias("score"), ts.cast("int").alias("test_start"), te.cast("int").alias("test_end"), cs.cast("int").alias("cover_start"), ce.cast("int").alias("cover_end"))
    gathered = candidates.groupBy(query, doc).agg(F.array_sort(F.collect_list(row)).alias("c"))
    free = _disjoint if rule == "strict" else _half_free
    chosen = F.aggregate("c", F.slice("c", 1, 0), lambda acc, x: F.when((F.size(acc) < k) & free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    out = gathered.select(query, doc, F.explode(chosen).alias("x"))
    order = Window.partitionBy(query).orderBy("x.order", doc, "x.start", "x.end")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select(query, doc, F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.col("x.score").alias("score"), "rank")


def pad_results(results: DataFrame, queries: DataFrame, query: str, k: int = 5) -> DataFrame:
    """Exactly k results a query: missing ranks are filled with lines 1 to 2 and score 0."""
    slots = queries.select(query).distinct().select(query, F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    found = results.select(query, "rank", "start", "end", "score")
    return slots.join(found, [query, "rank"], "left").select(query, "rank", F.coalesce("start", F.lit(1)).alias("start"), F.coalesce("end", F.lit(2)).alias("end"), F.coalesce("score", F.lit(0.0)).alias("score"))


def best_subwindow(hits: DataFrame, key: list[str], width: int) -> DataFrame:
    """(key, start, end, hits): of all windows of ``width`` lines, the one with most hits, the earliest of equals. hits: (key, line_no, hits)."""
    w = Window.partitionBy(*key).orderBy("line_no").rangeBetween(0, width - 1)
    sums = hits.withColumn("total", F.sum("hits").over(w))
    best = sums.groupBy(*key).agg(F.max(F.struct("total", (-F.col("line_no")).alias("at"))).alias("b"))
    return best.select(*key, (-F.col("b.at")).alias("start"), (-F.col("b.at") + width - 1).alias("end"), F.col("b.total").alias("hits"))


def band(hits: DataFrame, key: list[str], reach: int = 3) -> DataFrame:
    """hits with ``band``: the line's hits plus those of lines up to ``reach`` away, weighted 1 / (1 + distance)."""
    total = F.col("hits").cast("double")
    for d in range(1, reach + 1):
        for sign in (-1, 1):
            w = Window.partitionBy(*key).orderBy("line_no").rangeBetween(sign * d, sign * d)
            total = total + F.coalesce(F.sum("hits").over(w), F.lit(0)) / (1 + d)
    return hits.withColumn("band", total)
