"""Registered queries over documents, passages and lines, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import fuzzy
from tidemark.functions.text import STOP_WORDS, gram_rows, identifier_parts, suffix_stem, tokens, word_runs
from tidemark.operators import evaluate, segment, select, stats
from tidemark.operators.joins import checked_broadcast, contained_words, overlap_join, range_join, similar_terms
from tidemark.sources.tables import spread, stage, table

STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)


def tokens_sql(text: str) -> str:
    """DuckDB for `tokens`."""
    spaced = f"regexp_replace(replace(regexp_replace(coalesce({text}, ''), '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' '), '[^a-zA-Z0-9]', ' ', 'g')"
    return f"list_filter(string_split_regex(lower({spaced}), ' +'), lambda t: length(t) > 2 AND t NOT IN ({STOP_SQL}))"


LINES_SQL = "lines AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"
WINDOWS_SQL = """windows AS MATERIALIZED (
  SELECT * FROM (SELECT doc_id, s AS "start", least(n, s + 79) AS "end" FROM (SELECT doc_id, n, unnest(range(1, n + 1, 4)) AS s FROM (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents)))
  WHERE "end" - "start" + 1 >= 5)"""
QUERY_SQL = f"q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({tokens_sql('text')}) AS term FROM benchmark)"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def tokenized(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", tokens(F.col("text")).alias("tokens"))


def document_terms(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, length, terms) with the passages' terms, from one pass over the corpus; staged, as several scores read it."""
    return stage(stats.unit_terms(stats.wanted_counts(docs(spark, sf), items(spark, sf), "doc_id"), "doc_id"), "document-terms")


def items(spark: SparkSession, sf: str) -> DataFrame:
    return stats.query_terms(table(spark, sf, "benchmark"))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    scored = stats.bm25_units(document_terms(spark, sf), items(spark, sf), ["doc_id"], "item_id")
    return stats.top(scored, "item_id", 5, "doc_id").select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def tokenize_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokenized(spark, sf).select("doc_id", F.size("tokens").alias("n_tokens"), F.size(F.array_distinct("tokens")).alias("n_distinct"))


def corpus_tf(spark: SparkSession, sf: str) -> DataFrame:
    return stats.corpus_frequency(docs(spark, sf))


def doc_freq_idf(spark: SparkSession, sf: str) -> DataFrame:
    units = tokenized(spark, sf)
    n = units.count()
    return stats.document_frequency(units).select("term", "df", F.round(stats.idf(F.lit(n), F.col("df")), 6).alias("idf"))


def idf_corpus_tf(spark: SparkSession, sf: str) -> DataFrame:
    """The variant whose counts are collection frequencies and whose N is the number of lines; negative for frequent terms, null where the logarithm has no value."""
    n = docs(spark, sf).agg(F.sum(segment.line_count(F.col("text")))).first()[0]
    cf = stats.corpus_frequency(docs(spark, sf))
    inner = (n - F.col("cf") + 0.5) / (F.col("cf") + 0.5) + 1
    return cf.select("term", "cf", F.round(F.when(inner > 0, F.log(inner)), 6).alias("idf"))


def split_identifier(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", F.explode(identifier_parts(F.concat(F.col("p_name"), F.lit("_"), F.col("p_type"), F.lit(".XMLParserId")))).alias("part"))
    return parts.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("p_partkey").alias("parts"))


def suffix_stem_counts(spark: SparkSession, sf: str) -> DataFrame:
    cf = stats.corpus_frequency(docs(spark, sf))
    t = F.col("term")
    rows = cf.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rules"), suffix_stem(t, r).alias("stem")) for r in ("plain", "tion", "e")])).alias("s"), "cf")
    return rows.groupBy("s.rules", "s.stem").agg(F.sum("cf").alias("n"), F.count("*").alias("terms"))


def porter_stem_counts(spark: SparkSession, sf: str) -> DataFrame:
    cf = stats.corpus_frequency(docs(spark, sf))
    return cf.select(fuzzy.porter_stem(F.col("term")).alias("stem"), "cf").groupBy("stem").agg(F.sum("cf").alias("n"), F.count("*").alias("terms"))


def ngram_top(spark: SparkSession, sf: str) -> DataFrame:
    """The 100 most frequent bigrams and trigrams of the corpus, each (a report)."""
    counted = gram_rows(tokenized(spark, sf), "tokens").groupBy("n", "gram").agg(F.count("*").alias("score"))
    return stats.top(counted, "n", 100, "gram", digits=0).select("n", "gram", F.col("score").alias("occurrences"))


def phrase_match(spark: SparkSession, sf: str) -> DataFrame:
    """Bigrams (60 each) and trigrams (80 each) of a passage found in a document."""
    q = gram_rows(table(spark, sf, "benchmark").select("item_id", tokens(F.col("text")).alias("tokens")), "tokens", "item_id").distinct()
    d = gram_rows(tokenized(spark, sf), "tokens", "doc_id")
    known = checked_broadcast(q.select("gram").distinct())  # the corpus is cut down to passages' grams before the shuffle
    hits = d.join(known, "gram", "left_semi").select("doc_id", "gram").distinct().join(checked_broadcast(q), "gram")
    three = F.col("n") == 3
    return hits.groupBy("item_id", "doc_id").agg(F.count_if(~three).alias("bigrams"), F.count_if(three).alias("trigrams"), F.sum(F.when(three, 80).otherwise(60)).cast("double").alias("score"))


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return stats.corpus_frequency(docs(spark, sf)).withColumnRenamed("term", "word")


def substring_backoff(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus words that contain a passage term of four letters or more: weight 0.8 for a prefix, else 0.5."""
    terms = items(spark, sf).select("term").where("length(term) >= 4").distinct()
    words = vocabulary(spark, sf).where("length(word) >= 4")
    pairs = contained_words(terms, words).where("term <> word").join(words, "word")
    weight = F.when(F.startswith("word", "term"), 0.8).otherwise(0.5)
    return pairs.groupBy("term").agg(F.count("*").alias("words"), F.sum("cf").alias("occurrences"), F.round(F.sum(F.col("cf") * weight), 4).alias("weight"))


def fuzzy_terms(spark: SparkSession, sf: str) -> DataFrame:
    terms = table(spark, sf, "part").select(F.explode(tokens(F.concat_ws(" ", "p_name", "p_type"))).alias("term"))
    events = table(spark, sf, "events").select(F.explode(tokens(F.col("event_type"))).alias("term"))
    return similar_terms(terms.unionByName(events), terms, 0.80).select("a", "b", F.round("sim", 6).alias("sim"))


def line_windows(spark: SparkSession, sf: str) -> DataFrame:
    return segment.windows(docs(spark, sf))


def line_terms(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, line_no, word, times) of all lines."""
    words = segment.lines(docs(spark, sf)).select("doc_id", "line_no", F.explode(word_runs(F.col("line"))).alias("word"))
    return words.groupBy("doc_id", "line_no", "word").agg(F.count("*").alias("times"))


def line_hits(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, doc_id, line_no, term, whole, inside): whether a passage term is a word of the line, or part of one.

    Terms meet the corpus' distinct words first (blocked by trigrams), so lines join on equal words only.
    """
    found = line_terms(spark, sf)
    q = items(spark, sf)
    pairs = contained_words(q.select("term").distinct(), found.select("word").distinct())
    lines = found.join(pairs, "word")  # a side made from the corpus: adaptive execution picks the join
    lines = lines.groupBy("doc_id", "line_no", "term").agg(F.max(F.when(F.col("word") == F.col("term"), F.col("times")).otherwise(0)).alias("whole"), F.sum(F.when(F.col("word") == F.col("term"), 0).otherwise(F.col("times"))).alias("inside"))
    return lines.join(checked_broadcast(q), "term")


def line_hits_word_boundary(spark: SparkSession, sf: str) -> DataFrame:
    """A passage's five best lines by whole-word hits (2) and words that hold a term (1), with three lines around."""
    scored = line_hits(spark, sf).groupBy("item_id", "doc_id", "line_no").agg(F.sum(2 * F.col("whole") + F.col("inside")).cast("double").alias("score"))
    best = stats.top(scored, "item_id", 5, "doc_id", "line_no")
    n = docs(spark, sf).select("doc_id", segment.line_count(F.col("text")).alias("n"))
    s, e = segment.padded(F.col("line_no"), F.col("line_no"), F.col("n"), 3)
    return best.join(n, "doc_id").select("item_id", "rank", "doc_id", "line_no", s.alias("start"), e.alias("end"), "score")


def _fallback(spark: SparkSession, sf: str, score: F.Column) -> DataFrame:
    scored = line_hits(spark, sf).groupBy("item_id", "doc_id", "line_no").agg(F.sum(score).cast("double").alias("score"))
    return stats.top(scored, "item_id", 15, "doc_id", "line_no").select("item_id", "rank", "doc_id", "line_no", "score")


def line_fallback_a(spark: SparkSession, sf: str) -> DataFrame:
    """2 for each term that the line holds, 1.2 times that on lines with an equals sign or a declaration word."""
    scored = line_hits(spark, sf).groupBy("item_id", "doc_id", "line_no").agg(F.sum(F.lit(2.0)).alias("hits"))
    lines = segment.lines(docs(spark, sf)).select("doc_id", "line_no", F.rlike("line", F.lit("=|function|class")).alias("code")).where("code")
    scored = scored.join(lines, ["doc_id", "line_no"], "left").select("item_id", "doc_id", "line_no", F.when(F.col("code"), F.col("hits") * 1.2).otherwise(F.col("hits")).alias("score"))
    return stats.top(scored, "item_id", 15, "doc_id", "line_no").select("item_id", "rank", "doc_id", "line_no", F.round("score", 4).alias("score"))


def line_fallback_b(spark: SparkSession, sf: str) -> DataFrame:
    """5 for each term that is a word, and 2 for each that the line holds."""
    return _fallback(spark, sf, F.when(F.col("whole") > 0, 7).otherwise(2))


def line_fallback_c(spark: SparkSession, sf: str) -> DataFrame:
    """10 for each term that is a word, else 3 if the line holds it."""
    return _fallback(spark, sf, F.when(F.col("whole") > 0, 10).otherwise(3))


def window_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, doc_id, start, end, found, score): distinct passage terms among a window's words."""
    q = items(spark, sf)
    own = line_terms(spark, sf).join(checked_broadcast(q.select(F.col("term").alias("word")).distinct()), "word", "left_semi")
    inside = range_join(segment.windows(docs(spark, sf)), own, "doc_id", "start", "end", "line_no").select("doc_id", "start", "end", F.col("word").alias("term")).distinct()
    sizes = checked_broadcast(q.groupBy("item_id").agg(F.count("*").alias("n")))
    found = inside.join(checked_broadcast(q), "term").groupBy("item_id", "doc_id", "start", "end").agg(F.count("*").alias("found"))
    return found.join(sizes, "item_id").select("item_id", "doc_id", "start", "end", "found", (F.col("found") / F.col("n") * 0.2).alias("score"))


def coverage_score(spark: SparkSession, sf: str) -> DataFrame:
    return stats.top(window_coverage(spark, sf), "item_id", 20, "doc_id", "start").select("item_id", "rank", "doc_id", "start", "end", "found", F.round("score", 6).alias("score"))


def _suppressed(spark: SparkSession, sf: str, rule: str, pad: int = 0) -> DataFrame:
    candidates = window_coverage(spark, sf)
    cover = None
    if pad:
        n = docs(spark, sf).select("doc_id", segment.line_count(F.col("text")).alias("n"))
        candidates = candidates.join(n, "doc_id")
        cover = segment.padded(F.col("start"), F.col("end"), F.col("n"), pad)
    return select.suppress(candidates, "item_id", "doc_id", 5, rule, cover=cover).withColumn("score", F.round("score", 6))


def nms_strict(spark: SparkSession, sf: str) -> DataFrame:
    return _suppressed(spark, sf, "strict")


def nms_raw_padded(spark: SparkSession, sf: str) -> DataFrame:
    """The raw range is tested against padded ranges, so padded results may overlap."""
    return _suppressed(spark, sf, "strict", 4)


def nms_half(spark: SparkSession, sf: str) -> DataFrame:
    return _suppressed(spark, sf, "half")


def pad_to_five(spark: SparkSession, sf: str) -> DataFrame:
    """Exact matches of whole passages in documents, padded to five results."""
    exact = passages(spark, sf)
    ranked = stats.top(exact.withColumn("score", F.lit(1.0)), "item_id", 5, "doc_id")
    return select.pad_results(ranked, table(spark, sf, "benchmark"), "item_id")


def passages(spark: SparkSession, sf: str, units: DataFrame | None = None) -> DataFrame:
    """(item_id, doc_id, start, end): documents that hold a passage's text, and its lines there. Blocked by the passage's first token run."""
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("passage"), F.try_element_at(tokens(F.col("text")), F.lit(1)).alias("term"))
    units = document_terms(spark, sf) if units is None else units
    candidates = units.select("doc_id", F.inline("terms")).join(checked_broadcast(b), "term")
    found = candidates.select("doc_id", "item_id", "passage").join(docs(spark, sf), "doc_id").where(F.contains("text", "passage"))
    start = F.size(F.split(F.expr("substr(text, 1, instr(text, passage) - 1)"), "\n", -1))
    return found.select("item_id", "doc_id", start.alias("start"), (start + F.size(F.split("passage", "\n", -1)) - 1).alias("end"))


def proximity_score(spark: SparkSession, sf: str) -> DataFrame:
    """Mean gap between consecutive different terms of a passage in a document's token order; nearer scores more, up to 0.15."""
    q = items(spark, sf)
    at = tokenized(spark, sf).select("doc_id", F.posexplode("tokens").alias("pos", "term")).join(checked_broadcast(q), "term")
    from pyspark.sql import Window

    w = Window.partitionBy("item_id", "doc_id").orderBy("pos")
    gaps = at.withColumn("gap", F.when(F.lag("term").over(w) != F.col("term"), F.col("pos") - F.lag("pos").over(w)))
    mean = gaps.groupBy("item_id", "doc_id").agg(F.avg("gap").alias("mean"), F.count("gap").alias("pairs")).where("pairs > 0")
    return mean.select("item_id", "doc_id", "pairs", F.round(F.greatest(F.lit(0.0), 1 - F.col("mean") / 300) * 0.15, 9).alias("score"))


def window_bm25(spark: SparkSession, sf: str) -> DataFrame:
    q, key = items(spark, sf), ["doc_id", "start", "end"]
    units = stage(stats.unit_terms(stats.window_counts(docs(spark, sf), q), *key), "window-terms")
    return stats.bm25_units(units, q, key, "item_id")


def window_bm25_norm(spark: SparkSession, sf: str) -> DataFrame:
    """A passage's ten best windows, scores as shares of its best (at least 1), weighted 0.35."""
    best = stats.top(window_bm25(spark, sf), "item_id", 10, "doc_id", "start")
    most = best.groupBy("item_id").agg(F.greatest(F.lit(1.0), F.max("score")).alias("most"))
    return best.join(most, "item_id").select("item_id", "rank", "doc_id", "start", "end", F.round(F.col("score") / F.col("most") * 0.35, 6).alias("score"))


def range_join_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Characters and words of the lines of every window."""
    lines = segment.lines(docs(spark, sf)).select("doc_id", "line_no", F.length("line").alias("chars"), F.size(word_runs(F.col("line"))).alias("words"))
    joined = range_join(segment.windows(docs(spark, sf)), lines, "doc_id", "start", "end", "line_no")
    return joined.groupBy("doc_id", "start", "end").agg(F.count("*").alias("lines"), F.sum("chars").alias("chars"), F.sum("words").alias("words"))


def smallest_enclosing(spark: SparkSession, sf: str) -> DataFrame:
    """The smallest window of 16 lines (step 4) or 80 (step 4) around each window of 5 lines (step 4)."""
    d = docs(spark, sf)
    blocks = segment.windows(d, size=16).unionByName(segment.windows(d))
    return segment.smallest_enclosing(segment.windows(d, size=5), blocks)


def overlapping_windows(spark: SparkSession, sf: str) -> DataFrame:
    """How many windows of 12 lines (step 4) overlap each window of 80 (step 4)."""
    d = docs(spark, sf)
    a, b = segment.windows(d), segment.windows(d, size=12).select("doc_id", F.col("start").alias("s2"), F.col("end").alias("e2"))
    return overlap_join(a, b, "doc_id", "start", "end", "s2", "e2").groupBy("doc_id", "start", "end").agg(F.count("*").alias("others"))


def line_weights(spark: SparkSession, sf: str) -> DataFrame:
    return segment.lines(docs(spark, sf)).select("doc_id", "line_no", F.size(word_runs(F.col("line"))).alias("hits"))


def best_subwindow(spark: SparkSession, sf: str) -> DataFrame:
    return select.best_subwindow(line_weights(spark, sf), ["doc_id"], 10)


def neighbour_band(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's line with the most words in it and, weighted by distance, in the three lines around."""
    scored = select.band(line_weights(spark, sf), ["doc_id"], 3)
    best = scored.groupBy("doc_id").agg(F.max_by(F.struct("line_no", "band"), F.struct(F.round("band", 6), -F.col("line_no"))).alias("b"))
    return best.select("doc_id", "b.line_no", F.round("b.band", 6).alias("band"))


def engine_results(spark: SparkSession, sf: str, units: DataFrame | None = None) -> DataFrame:
    """(engine, item_id, doc_id, rank): documents ranked by three engines, ten a passage."""
    q, units = items(spark, sf), document_terms(spark, sf) if units is None else units
    bm25 = stats.bm25_units(units, q, ["doc_id"], "item_id")
    counts = units.select("doc_id", F.inline("terms")).join(checked_broadcast(q), "term").groupBy("item_id", "doc_id").agg((F.sum("tf") + 5.0 * F.count("*")).alias("score"))
    phrases = phrase_match(spark, sf).select("item_id", "doc_id", "score")
    out = None
    for name, scored in (("bm25", bm25), ("counts", counts), ("phrases", phrases)):
        one = stats.top(scored, "item_id", 10, "doc_id").select(F.lit(name).alias("engine"), "item_id", "doc_id", "rank")
        out = one if out is None else out.unionByName(one)
    return out


def engine_marks(spark: SparkSession, sf: str) -> DataFrame:
    """(engine, item_id, doc_id, lang, marks): marks of the first result of each engine for each labelled passage."""
    units = document_terms(spark, sf)
    truth = passages(spark, sf, units).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    engines = spark.createDataFrame([("bm25",), ("counts",), ("phrases",)], "engine string")
    results = engine_results(spark, sf, units)
    n = docs(spark, sf).select("doc_id", segment.line_count(F.col("text")).alias("n"))
    first = results.where("rank = 1").join(n, "doc_id").select("engine", "item_id", "doc_id", F.lit(1).alias("start"), F.col("n").alias("end"))
    asked = truth.join(F.broadcast(engines))  # three engines
    return evaluate.marks(first, asked, ["engine", "item_id", "doc_id"]).select("engine", "item_id", "doc_id", "lang", "marks")


def marks_by_engine(spark: SparkSession, sf: str) -> DataFrame:
    return engine_marks(spark, sf).groupBy("engine", "item_id").agg(F.max("marks").alias("marks"))


def marks_by_category(spark: SparkSession, sf: str) -> DataFrame:
    rolled = evaluate.rollup_marks(engine_marks(spark, sf), "engine", "lang")
    return rolled.select(F.coalesce("engine", F.lit("all")).alias("engine"), F.coalesce("lang", F.lit("all")).alias("lang"), "avg_marks", "questions")


def engine_rank(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.engine_table(marks_by_engine(spark, sf))


def hit_at_k(spark: SparkSession, sf: str) -> DataFrame:
    units = document_terms(spark, sf)
    truth = stage(passages(spark, sf, units).select("item_id", "doc_id").distinct(), "truth")  # read twice
    asked = truth.select("item_id").distinct()
    engines = spark.createDataFrame([("bm25",), ("counts",), ("phrases",)], "engine string")
    found = engine_results(spark, sf, units).join(truth, ["item_id", "doc_id"]).groupBy("engine", "item_id").agg(F.min("rank").alias("first_rank"))
    return evaluate.hits_at(asked.join(F.broadcast(engines)).join(found, ["engine", "item_id"], "left"), ["engine"])


def engine_leads(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.leads(engine_rank(spark, sf)).select("engine", "total", "lead")


def category_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.category_table(engine_marks(spark, sf), ["bm25", "counts", "phrases"])
