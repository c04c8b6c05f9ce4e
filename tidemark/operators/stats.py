"""Term statistics and BM25 over any table of units (documents, windows, lines)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import is_token, raw_words, tokens
from tidemark.operators.joins import checked_broadcast


def term_frequency(units: DataFrame, *key: str, words: str = "tokens") -> DataFrame:
    """(key, term, tf)."""
    return units.select(*key, F.explode(words).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))


def corpus_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, cf): occurrences of tokens over all texts; words are filtered after they are exploded, which is compiled."""
    words = docs.select(F.explode(raw_words(F.col(text))).alias("term")).where(is_token(F.col("term")))
    return words.groupBy("term").agg(F.count("*").alias("cf"))


def document_frequency(units: DataFrame, words: str = "tokens") -> DataFrame:
    """(term, df): units that hold the term, counted without a shuffle of (unit, term) pairs."""
    return units.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25(tf: Column, length: Column, average: Column, weight: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return weight * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length / average))


def bm25_scores(units: DataFrame, queries: DataFrame, key: list[str], query: str, words: str = "tokens", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, key, score): BM25 summed over a query's terms; queries is (query, term), repeated terms counting again.

    Only query terms leave the scan: units are cut down to them before the first shuffle, and lengths are sizes of
    arrays, so the corpus is shuffled once, as (unit, term) counts of query terms.
    """
    wanted = checked_broadcast(queries.groupBy(query, "term").agg(F.count("*").alias("times")))
    vocabulary = checked_broadcast(queries.select("term").distinct())
    totals = units.agg(F.count("*").alias("n"), F.avg(F.size(words)).alias("average")).first()  # two numbers
    n, average = F.lit(float(totals["n"])), F.lit(float(totals["average"] or 1.0) or 1.0)
    spread = units.select(*key, F.size(words).alias("length"), F.explode(words).alias("term")).join(vocabulary, "term", "left_semi")
    tf = spread.groupBy(*key, "length", "term").agg(F.count("*").alias("tf"))
    return _summed(tf, wanted, key, query, n, average, k1, b)


def _summed(tf: DataFrame, wanted: DataFrame, key: list[str], query: str, n: Column, average: Column, k1: float, b: float) -> DataFrame:
    df = tf.groupBy("term").agg(F.count("*").alias("df"))  # a row for each query term at most
    scored = tf.join(df, "term").withColumn("part", bm25(F.col("tf"), F.col("length"), average, idf(n, F.col("df")), k1, b))
    return scored.join(wanted, "term").groupBy(query, *key).agg(F.sum(F.col("part") * F.col("times")).alias("score"))


def wanted_counts(units: DataFrame, vocabulary: DataFrame, *key: str, text: str = "text") -> DataFrame:
    """(key, term, tf): how often a unit's text holds each term of the vocabulary; one more row, with a null term, counts its other tokens (0 if none).

    Words are never collected into arrays of tokens: they are exploded, met with the vocabulary and counted in one
    compiled stage, and what is shuffled is a row for each unit and found term.
    """
    words = units.select(*key, F.explode(raw_words(F.col(text))).alias("tm_word"))
    known = checked_broadcast(vocabulary.select(F.col("term").alias("tm_term")).where(is_token(F.col("tm_term"))).distinct())
    met = words.join(known, words["tm_word"] == known["tm_term"], "left")
    return met.groupBy(*key, F.col("tm_term").alias("term")).agg(F.sum(is_token(F.col("tm_word")).cast("long")).alias("tf"))


def unit_terms(counts: DataFrame, *key: str) -> DataFrame:
    """(key, length, terms): a row for each unit of `wanted_counts`, with its number of tokens and its wanted terms as (term, tf)."""
    found = F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf")))
    return counts.groupBy(*key).agg(F.sum("tf").alias("length"), found.alias("terms"))


def window_counts(docs: DataFrame, vocabulary: DataFrame, size: int = 80, step: int = 4, min_lines: int = 5) -> DataFrame:
    """(doc_id, start, end, term, tf), as `wanted_counts`, of the windows that `segment.windows` makes.

    Words are counted by blocks of ``step`` lines first; a window is a run of whole blocks, so only the blocks' counts
    are copied into windows. size must be a multiple of step.
    """
    if size % step:
        raise ValueError("size must be a multiple of step")
    split = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    lines = docs.select("doc_id", F.size(split).alias("n"), F.posexplode(split).alias("at", "line")).select("doc_id", "n", F.floor(F.col("at") / step).cast("int").alias("block"), "line")
    blocks = wanted_counts(lines, vocabulary, "doc_id", "n", "block", text="line")
    spread = blocks.select("doc_id", "n", "term", "tf", F.explode(F.sequence(F.greatest(F.lit(0), F.col("block") - (size // step - 1)), F.col("block"))).alias("first"))
    start = F.col("first") * step + 1
    ranged = spread.select("doc_id", start.alias("start"), F.least(F.col("n"), start + size - 1).alias("end"), "term", "tf")
    return ranged.where(F.col("end") - F.col("start") + 1 >= min_lines).groupBy("doc_id", "start", "end", "term").agg(F.sum("tf").alias("tf"))


def bm25_units(units: DataFrame, queries: DataFrame, key: list[str], query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """`bm25_scores` from a staged table of `unit_terms`, whose vocabulary must hold all query terms; nothing is tokenised again."""
    totals = units.agg(F.count("*").alias("n"), F.avg("length").alias("average")).first()  # two numbers
    n, average = F.lit(float(totals["n"])), F.lit(float(totals["average"] or 1.0) or 1.0)
    wanted = checked_broadcast(queries.groupBy(query, "term").agg(F.count("*").alias("times")))
    return _summed(units.select(*key, "length", F.inline("terms")), wanted, key, query, n, average, k1, b)


def top(scored: DataFrame, by: str, k: int, *ties: str, score: str = "score", digits: int = 6) -> DataFrame:
    """The k best of each ``by``, with rank from 1; scores are rounded before ranking so that ties break by ``ties``."""
    order = Window.partitionBy(by).orderBy(F.round(score, digits).desc(), *ties)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def query_terms(queries: DataFrame, key: str = "item_id", text: str = "text", distinct: bool = True) -> DataFrame:
    """(key, term)."""
    words = tokens(F.col(text))
    return queries.select(key, F.explode(F.array_distinct(words) if distinct else words).alias("term"))
