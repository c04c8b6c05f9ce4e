"""Feed items: exactly-once admission, micro-batches, classification by a plug-in, hiding."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import truncated


def admit(items: DataFrame, key: str, text: str, chars: int = 250) -> DataFrame:
    """Each key once, text shortened."""
    return items.dropDuplicates([key]).withColumn(text, truncated(F.col(text), chars, ""))


def batches(items: DataFrame, lane: str, order: str, size: int = 25) -> DataFrame:
    """items with batch: runs of ``size`` within each lane (lanes drain in parallel)."""
    return items.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(lane).orderBy(order)) - 1) / size).cast("int"))


def classify(items: DataFrame, key: str, text: str, classifier: Callable | None = None) -> DataFrame:
    """items with hidden (boolean). classifier takes a pandas Series of texts and gives booleans; an error hides nothing."""
    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        try:
            return pd.Series(list(classifier(texts)), dtype=bool)
        except Exception:  # noqa: BLE001  a plug-in that fails must not stop the feed
            return pd.Series([False] * len(texts))

    return items.withColumn("hidden", run(F.col(text)) if classifier else F.lit(False))


def flagged(items: DataFrame, detected: DataFrame, key: str) -> DataFrame:
    """items with hidden: whether their key is among the detected."""
    found = detected.select(key).distinct().withColumn("tm_hit", F.lit(True))
    return items.join(found, key, "left").withColumn("hidden", F.col("tm_hit").isNotNull()).drop("tm_hit")
