"""Joins the corpus operators share, written so that no plan needs a nested loop over two large sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows above which a side is not broadcast.
BROADCAST_ROWS = 1_000_000


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast only if it is counted to have at most ``rows`` rows (the count stops there)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def contained_words(terms: DataFrame, words: DataFrame, term: str = "term", word: str = "word") -> DataFrame:
    """(term, word) for distinct terms of three characters or more that are substrings of distinct words.

    Blocked by trigrams: a term's first three characters must be a trigram of the word, so this is an equi-join with a
    residual test instead of a nested loop over terms and words.
    """
    blocks = terms.select(F.col(term).alias("term")).where(F.length("term") >= 3).distinct().withColumn("block", F.substring("term", 1, 3))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 2), lambda i: F.substr(F.col("word"), i, F.lit(3))))
    spread = words.select(F.col(word).alias("word")).distinct().where(F.length("word") >= 3).select("word", F.explode(grams).alias("block"))
    return spread.join(blocks, "block").where(F.contains("word", "term")).select("term", "word")


def range_join(ranges: DataFrame, points: DataFrame, key: str, start: str, end: str, point: str, bucket: int = 64) -> DataFrame:
    """ranges joined to the points of the same key with start <= point <= end, as an equi-join over buckets of points."""
    wide = ranges.withColumn("tm_bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    deep = points.withColumn("tm_bucket", F.floor(F.col(point) / bucket))
    return wide.join(deep, [key, "tm_bucket"]).where((F.col(point) >= F.col(start)) & (F.col(point) <= F.col(end))).drop("tm_bucket")


def overlap_join(a: DataFrame, b: DataFrame, key: str, s1: str, e1: str, s2: str, e2: str, bucket: int = 64) -> DataFrame:
    """Pairs of intervals of one key that overlap; each pair once, in the bucket where the later one starts."""
    x = a.withColumn("tm_bucket", F.explode(F.sequence(F.floor(F.col(s1) / bucket), F.floor(F.col(e1) / bucket))))
    y = b.withColumn("tm_bucket", F.explode(F.sequence(F.floor(F.col(s2) / bucket), F.floor(F.col(e2) / bucket))))
    meet = (F.col(s1) <= F.col(e2)) & (F.col(s2) <= F.col(e1)) & (F.floor(F.greatest(F.col(s1), F.col(s2)) / bucket) == F.col("tm_bucket"))
    return x.join(y, [key, "tm_bucket"]).where(meet).drop("tm_bucket")


def similar_terms(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim) of distinct terms of three characters or more at or above a Jaro-Winkler threshold; null terms meet nothing.

    Terms with the same first character meet by it. For all others no prefix is equal, so the Jaro similarity itself
    must reach the threshold, which bounds the ratio of lengths: they meet by length, up to the longest term there is.
    Before Python scores a pair, the characters of each term that the other holds bound its similarity from above. The
    blocks and the bound cut no pair at the threshold.
    """
    from tidemark.functions.fuzzy import similarity

    a = left.select(F.col("term").alias("a")).distinct().withColumn("n", F.length("a")).where("n >= 3").withColumn("first", F.substring("a", 1, 1))
    b = right.select(F.col("term").alias("b")).distinct().withColumn("m", F.length("b")).where("m >= 3").withColumn("first_b", F.substring("b", 1, 1))
    same = a.join(b, F.col("first") == F.col("first_b")).select("a", "b", "n", "m")
    ratio = 3 * threshold - 2 - 1e-9  # (s/n + s/m + 1) / 3 with s the shorter length
    longest = b.agg(F.max("m")).first()[0] or 0  # one number
    most = F.least(F.lit(longest), F.floor(F.col("n") / ratio)) if ratio > 0 else F.lit(longest)
    least = F.greatest(F.lit(3), F.ceil(F.col("n") * max(ratio, 0.0)))
    reach = a.withColumn("tm_m", F.explode(F.when(least <= most, F.sequence(least.cast("int"), most.cast("int")))))
    other = reach.join(b, F.col("tm_m") == F.col("m")).where("first <> first_b").select("a", "b", "n", "m")
    pairs = same.unionByName(other)
    held = F.least(F.col("n") - F.length(F.call_function("translate", "a", "b", F.lit(""))), F.col("m") - F.length(F.call_function("translate", "b", "a", F.lit(""))))
    jaro = F.when(held > 0, (held / F.col("n") + held / F.col("m") + 1) / 3).otherwise(0.0)
    equal = lambda k: F.substring("a", 1, k) == F.substring("b", 1, k)
    prefix = F.when(equal(4), 4).when(equal(3), 3).when(equal(2), 2).when(equal(1), 1).otherwise(0)
    pairs = pairs.where(jaro + prefix * 0.1 * (1 - jaro) >= threshold - 1e-9)
    return pairs.select("a", "b", similarity(F.col("a"), F.col("b")).alias("sim")).where(F.col("sim") >= threshold)
