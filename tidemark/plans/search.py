"""Ranked retrieval of line ranges: engines over tables of documents and queries.

An engine is (docs, queries, config) to results. docs is (doc_id, text), queries is (query_id, query). All terms meet
units (code regions, windows or lines) by equi-joins: partial and fuzzy matches are first resolved between the
distinct terms of queries and corpus, so no plan compares a query with every unit. Engines differ in their tokens,
score and overlap rule; `ENGINES` lists them. Boost rules tuned to particular texts are off unless passed as a table.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import fuzzy
from tidemark.functions.text import SHORT_STOP_WORDS, STOP_WORDS, ngrams, suffix_stem, tokens, word_runs
from tidemark.operators import segment, select, stats
from tidemark.operators.joins import checked_broadcast, contained_words, range_join, similar_terms
from tidemark.sources.tables import source


@dataclass(frozen=True)
class SearchConfig:
    min_lines: int = 10
    max_lines: int = 100
    top_k: int = 5
    smart_expand: bool = False
    window_step: int = 4


@dataclass(frozen=True)
class Weights:
    """Fixed values of the flagship engine's score; pass another instance to change them."""

    k1: float = 1.2
    b: float = 0.3
    direct: float = 35
    synonym: float = 18
    partial: float = 12
    bigram: float = 60
    trigram: float = 80
    fuzzy: float = 25
    name_exact: float = 250
    name_partial: float = 100
    name_fuzzy: float = 70
    coverage: float = 3.0
    function: float = 4.0
    class_: float = 3.5
    top_level: float = 2.5
    property: float = 2.2
    threshold: float = 0.80


@dataclass(frozen=True)
class Spec:
    """Parameters of a region engine."""

    score: str  # weighted, counts or bm25
    stem: str = "none"  # none, porter, plain, tion, e
    stop_words: list[str] = field(default_factory=lambda: STOP_WORDS)
    min_chars: int = 3
    k1: float = 1.2
    b: float = 0.75
    per_match: float = 1.0
    per_term: float = 5.0
    name: tuple[float, float] = (40, 15)
    multipliers: tuple[float, float, float, float] = (2.0, 1.5, 1.5, 1.4)  # function, class, top level, property
    short_penalty: float = 1.0  # for regions of three lines or fewer
    span_curve: bool = False
    backoff: bool = False  # words a unit lacks count where they hold, or are held by, one of its words
    rule: str = "strict"
    pad: int = 0  # lines around a result
    test_padded: bool = False
    fill: bool = True  # up to five results


def stemmed(words: DataFrame, kind: str) -> DataFrame:
    """words with stem, from column term; Porter stems are computed on distinct terms and joined."""
    if kind == "none":
        return words.withColumn("stem", F.col("term"))
    if kind == "porter":
        return words.join(fuzzy.stems_of(words), "term", "left")
    return words.withColumn("stem", suffix_stem(F.col("term"), kind))


def query_words(queries: DataFrame, spec: Spec) -> DataFrame:
    """(query_id, pos, term, stem), repeats kept."""
    words = queries.select("query_id", F.posexplode(tokens(F.col("query"), spec.stop_words, spec.min_chars)).alias("pos", "term"))
    return stemmed(words, spec.stem)


def expand(words: DataFrame, synonyms: DataFrame | None) -> DataFrame:
    """(query_id, stem) of synonyms that are not the query's own words. synonyms: (key, syn), both ways by key, word or stem."""
    own = words.select("query_id", "stem").distinct()
    if synonyms is None:
        return own.limit(0)
    table = synonyms.select("key", "syn")
    table = table.join(fuzzy.stems_of(table.withColumnRenamed("syn", "term")).withColumnRenamed("term", "syn"), "syn").withColumnRenamed("stem", "syn_stem")
    keys = None  # an OR of three conditions, as a union of equi-joins
    for column in ("key", "syn", "syn_stem"):
        hit = own.join(checked_broadcast(table.select("key", F.col(column).alias("stem")).distinct()), "stem").select("query_id", "key")
        keys = hit if keys is None else keys.unionByName(hit)
    found = keys.distinct().join(table, "key").select("query_id", F.explode(F.array("key", "syn", "syn_stem")).alias("stem")).distinct()
    return found.join(own, ["query_id", "stem"], "left_anti")


def region_units(docs: DataFrame, spec: Spec) -> DataFrame:
    """(doc_id, seq, start, end, name, kind flags, tokens) of code regions."""
    found = segment.regions(docs).where("is_function or is_class or kind in ('route', 'property') or (is_top_level and kind = 'statement')")
    text = segment.range_text(F.col("text"), F.col("start"), F.col("end"), " ")
    return found.join(docs, "doc_id").select("doc_id", "seq", "start", "end", "kind", "name", "is_function", "is_class", "is_top_level", tokens(text, spec.stop_words, spec.min_chars).alias("tokens"))


def unit_words(units: DataFrame, kind: str) -> DataFrame:
    return stemmed(units.select("doc_id", "seq", F.posexplode("tokens").alias("pos", "term")), kind)


KEY = ["query_id", "doc_id", "seq"]


def weighted_scores(docs: DataFrame, units: DataFrame, q: DataFrame, extra: DataFrame, spec: Spec, w: Weights) -> DataFrame:
    """(query_id, doc_id, seq, score) before names and structure: BM25 of own words and synonyms, partial, fuzzy and phrase matches, coverage."""
    words = unit_words(units, spec.stem)
    tf = words.groupBy("doc_id", "seq", "stem").agg(F.count("*").alias("tf"), F.min("pos").alias("first"))
    size = units.select("doc_id", "seq", F.size("tokens").alias("length"))
    lines = docs.select("doc_id", segment.line_count(F.col("text")).alias("lines"), tokens(F.col("text"), spec.stop_words, spec.min_chars).alias("t"))
    shape = lines.select("doc_id", "lines", (F.size("t") / F.greatest(F.lit(1.0), F.col("lines") / 20)).alias("average"))
    corpus = stemmed(lines.select("doc_id", F.explode("t").alias("term")), spec.stem).groupBy("doc_id", "stem").agg(F.count("*").alias("cf"))
    weight = F.log((F.col("lines") + 1) / (F.col("cf") + 0.5))  # the idf of collection counts over lines, simplified
    known = tf.join(size, ["doc_id", "seq"]).join(shape, "doc_id").join(corpus, ["doc_id", "stem"])
    known = known.withColumn("bm25", stats.bm25(F.col("tf"), F.col("length"), F.col("average"), weight, w.k1, w.b))
    own = q.groupBy("query_id", "stem").agg(F.count("*").alias("times"))
    direct = known.join(checked_broadcast(own), "stem").select(*KEY, "stem", (F.col("bm25") * F.col("times") * w.direct).alias("part"))
    synonym = known.join(checked_broadcast(extra), "stem").select(*KEY, "stem", (F.col("bm25") * w.synonym).alias("part"))

    # the rest only of words that a unit does not hold as they are
    vocabulary = tf.select(F.col("stem").alias("word")).where("length(word) >= 4").distinct()
    terms = own.select(F.col("stem").alias("term")).where("length(term) >= 4").distinct()
    inside = contained_words(terms, vocabulary).unionByName(contained_words(vocabulary.select(F.col("word").alias("term")), terms.select(F.col("term").alias("word"))).select(F.col("word").alias("term"), F.col("term").alias("word")))
    inside = inside.where("term <> word").distinct()
    near = similar_terms(terms, vocabulary.select(F.col("word").alias("term")), w.threshold).select(F.col("a").alias("term"), F.col("b").alias("word"), "sim")
    asked = own.select("query_id", F.col("stem").alias("term"))
    held = direct.select(*KEY, F.col("stem").alias("term"))
    partial = tf.join(inside, F.col("stem") == F.col("word")).join(checked_broadcast(asked), "term").groupBy(*KEY, "term").agg((F.sum("tf") * w.partial).alias("part")).join(held, [*KEY, "term"], "left_anti")
    close = tf.join(near, F.col("stem") == F.col("word")).join(checked_broadcast(asked), "term").groupBy(*KEY, "term").agg((F.min_by("sim", "first") * w.fuzzy).alias("part"))
    close = close.join(held, [*KEY, "term"], "left_anti").join(partial.select(*KEY, "term"), [*KEY, "term"], "left_anti")
    matched = direct.unionByName(synonym).select(*KEY, F.col("stem").alias("term"), "part").unionByName(partial).unionByName(close)

    phrases = None
    for n, points in ((2, w.bigram), (3, w.trigram)):
        asked_grams = q.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("t")).select("query_id", F.explode(ngrams(F.col("t"), n)).alias("gram")).groupBy("query_id", "gram").agg(F.count("*").alias("times"))
        found = units.select("doc_id", "seq", F.explode(F.array_distinct(ngrams(F.col("tokens"), n))).alias("gram")).join(checked_broadcast(asked_grams), "gram")
        found = found.select(*KEY, F.lit(None).cast("string").alias("term"), (F.col("times") * points).alias("part"))
        phrases = found if phrases is None else phrases.unionByName(found)

    total = q.groupBy("query_id").agg(F.count("*").alias("asked"))
    summed = matched.unionByName(phrases).groupBy(*KEY).agg(F.sum("part").alias("sum"), F.countDistinct("term").alias("matched"))
    return summed.join(checked_broadcast(total), "query_id").select(*KEY, (F.col("sum") * (1 + F.col("matched") / F.col("asked") * w.coverage)).alias("score"))


def counted_scores(units: DataFrame, q: DataFrame, extra: DataFrame, spec: Spec) -> DataFrame:
    """Matches and distinct matches of the query's words and synonyms."""
    wanted = q.select("query_id", "stem").unionByName(extra).distinct()
    hits = unit_words(units, spec.stem).join(checked_broadcast(wanted), "stem")
    return hits.groupBy(*KEY).agg((F.count("*") * spec.per_match + F.countDistinct("stem") * spec.per_term).alias("score"))


def bm25_unit_scores(units: DataFrame, q: DataFrame, extra: DataFrame, spec: Spec) -> DataFrame:
    """BM25 over the regions of all documents."""
    stems = unit_words(units, spec.stem).groupBy("doc_id", "seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "stem"))), lambda x: x["stem"]).alias("tokens"))
    asked = q.select("query_id", F.col("stem").alias("term")).unionByName(extra.withColumnRenamed("stem", "term")).distinct()
    exact = stats.bm25_scores(stems, asked, ["doc_id", "seq"], "query_id", k1=spec.k1, b=spec.b)
    if not spec.backoff:
        return exact
    tf = unit_words(units, spec.stem).groupBy("doc_id", "seq", "stem").agg(F.count("*").alias("tf"))
    terms, words = asked.select("term").distinct(), tf.select(F.col("stem").alias("word")).distinct()
    inside = contained_words(terms, words)
    around = contained_words(words.select(F.col("word").alias("term")), terms.select(F.col("term").alias("word"))).select(F.col("word").alias("term"), F.col("term").alias("word"))
    pairs = inside.unionByName(around).where("term <> word").distinct()
    pairs = pairs.withColumn("prefix", F.startswith("word", "term") | F.startswith("term", "word"))
    held = tf.join(checked_broadcast(asked), F.col("stem") == F.col("term")).select(*KEY, "term")
    shape = units.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("average")).first()  # two numbers
    rare = stats.idf(F.lit(float(shape["n"])), F.lit(1.0))
    near = tf.join(pairs, F.col("stem") == F.col("word")).join(checked_broadcast(asked), "term").groupBy(*KEY, "term").agg(F.sum("tf").alias("tf"), F.bool_or("prefix").alias("prefix"))
    near = near.join(held, [*KEY, "term"], "left_anti").join(units.select("doc_id", "seq", F.size("tokens").alias("length")), ["doc_id", "seq"])
    part = stats.bm25(F.col("tf"), F.col("length"), F.lit(float(shape["average"] or 1)), rare, spec.k1, spec.b) * F.when(F.col("prefix"), 0.8).otherwise(0.5)
    return exact.unionByName(near.select(*KEY, part.alias("score")).select(*exact.columns)).groupBy(*KEY).agg(F.sum("score").alias("score"))


def name_words(units: DataFrame, spec: Spec) -> DataFrame:
    """(doc_id, seq, term, stem) of the words of a region's name."""
    return stemmed(units.select("doc_id", "seq", F.explode(tokens(F.col("name"), spec.stop_words, spec.min_chars)).alias("term")), spec.stem)


def weighted_names(units: DataFrame, q: DataFrame, extra: DataFrame, spec: Spec, w: Weights) -> DataFrame:
    """(query_id, doc_id, seq, bonus): exact, raw, synonym, partial and fuzzy matches of names."""
    names = name_words(units, spec)
    stems, raws = q.select("query_id", "stem").distinct(), q.select("query_id", "term").distinct()
    own = stems.withColumn("own", F.lit(True))
    parts = [
        names.join(checked_broadcast(stems), "stem").select(*KEY, F.lit(w.name_exact).alias("bonus")),
        names.join(checked_broadcast(raws), "term").select(*KEY, F.lit(w.name_exact * 0.5).alias("bonus")),
        names.join(checked_broadcast(extra), "stem").select(*KEY, F.lit(w.name_partial).alias("bonus")),
    ]
    vocabulary, terms = names.select(F.col("stem").alias("word")).where("length(word) >= 4").distinct(), stems.select(F.col("stem").alias("term")).where("length(term) >= 4").distinct()
    inside = contained_words(terms, vocabulary).unionByName(contained_words(vocabulary.select(F.col("word").alias("term")), terms.select(F.col("term").alias("word"))).select(F.col("word").alias("term"), F.col("term").alias("word"))).distinct()
    asked = q.select("query_id", F.col("stem").alias("asked"))
    pairs = names.join(inside.withColumnRenamed("term", "asked"), F.col("stem") == F.col("word")).join(checked_broadcast(asked), "asked")
    parts.append(pairs.select(*KEY, F.lit(w.name_partial).alias("bonus")))
    near = similar_terms(terms, vocabulary.select(F.col("word").alias("term")), w.threshold).select(F.col("a").alias("asked"), F.col("b").alias("word"), "sim")
    close = names.join(near, F.col("stem") == F.col("word")).join(checked_broadcast(asked), "asked").join(checked_broadcast(own), ["query_id", "stem"], "left").where("own is null")
    parts.append(close.select(*KEY, (F.col("sim") * w.name_fuzzy).alias("bonus")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*KEY).agg(F.sum("bonus").alias("bonus"))


def plain_names(units: DataFrame, q: DataFrame, extra: DataFrame, spec: Spec) -> DataFrame:
    """(query_id, doc_id, seq, bonus): a word of the name among the query's words, or its synonyms."""
    names = name_words(units, spec)
    wanted = q.select("query_id", "stem").distinct().withColumn("points", F.lit(float(spec.name[0]))).unionByName(extra.withColumn("points", F.lit(float(spec.name[1]))))
    return names.join(checked_broadcast(wanted), "stem").groupBy(*KEY).agg(F.sum("points").alias("bonus"))


def structure(spec: Spec, exclusive: bool) -> Column:
    """Multipliers of a region's kind; exclusive: the first that fits, else all that fit."""
    f, c, t, p = spec.multipliers
    tests = [(F.col("is_function"), f), (F.col("is_class"), c), (F.col("is_top_level") & F.col("kind").isin("statement", "route"), t), (F.col("kind") == "property", p)]
    if exclusive:
        out = F.lit(1.0)
        for test, value in reversed(tests):
            out = F.when(test, value).otherwise(out)
        return out
    out = F.lit(1.0)
    for test, value in tests:
        out = out * F.when(test, value).otherwise(1.0)
    return out


def span_curve(lines: Column) -> Column:
    return F.when(lines > 120, 0.6).when(lines > 80, 0.75).when(lines > 50, 0.9).when(lines <= 20, 1.3).when(lines <= 40, 1.15).otherwise(1.0)


def boosted(scored: DataFrame, docs: DataFrame, q: DataFrame, rules: DataFrame | None) -> DataFrame:
    """scored with opt-in rules applied: (pattern, query_term, factor, points); a rule fits a region that holds the pattern when its term, if any, is asked."""
    if rules is None:
        return scored
    text = segment.range_text(F.col("text"), F.col("start"), F.col("end"), " ")
    asked = q.groupBy("query_id").agg(F.collect_set("stem").alias("asked"))
    hit = scored.join(docs, "doc_id").join(checked_broadcast(asked), "query_id").withColumn("tm_text", text)
    fit = F.contains("tm_text", "pattern") & (F.col("query_term").isNull() | F.array_contains("asked", F.col("query_term")))
    hit = hit.join(F.broadcast(rules), fit).groupBy(*KEY).agg(F.product("factor").alias("factor"), F.sum("points").alias("points"))  # a rules table is written by hand
    return scored.join(hit, KEY, "left").withColumn("score", F.col("score") * F.coalesce("factor", F.lit(1.0)) + F.coalesce("points", F.lit(0.0))).drop("factor", "points")


def search_regions(docs: DataFrame, queries: DataFrame, spec: Spec, config: SearchConfig, weights: Weights | None = None, synonyms: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    units, q = region_units(docs, spec), query_words(queries, spec)
    extra = expand(q, synonyms)
    w = weights or Weights()
    if spec.score == "weighted":
        scored, names = weighted_scores(docs, units, q, extra, spec, w), weighted_names(units, q, extra, spec, w)
        spec = replace(spec, multipliers=(w.function, w.class_, w.top_level, w.property))
    else:
        scored = (counted_scores if spec.score == "counts" else bm25_unit_scores)(units, q, extra, spec)
        names = plain_names(units, q, extra, spec)
    lines = F.col("end") - F.col("start") + 1
    out = scored.where("score > 0").join(units.drop("tokens"), ["doc_id", "seq"]).join(names, KEY, "left")
    factor = structure(spec, spec.score == "weighted") * F.when(lines <= 3, spec.short_penalty).otherwise(1.0)
    out = out.withColumn("score", (F.col("score") + F.coalesce("bonus", F.lit(0.0))) * factor * (span_curve(lines) if spec.span_curve else 1.0)).drop("bonus")
    return results(docs, queries, boosted(out, docs, q, rules), config, spec)


def results(docs: DataFrame, queries: DataFrame, scored: DataFrame, config: SearchConfig, spec: Spec) -> DataFrame:
    """(query_id, rank, doc_id, start, end, original_start, original_end, lines, score, name, kind, code) after overlap suppression and resizing."""
    n = docs.select("doc_id", segment.line_count(F.col("text")).alias("n"))
    scored = scored.join(n, "doc_id")
    start, end = F.col("start"), F.col("end")
    if config.smart_expand:
        around = segment.smallest_enclosing(scored, segment.regions(docs).where("is_function or is_class"))
        cover = segment.resized(*segment.smart_range(around, config.max_lines), F.col("n"), config.min_lines, config.max_lines)
        scored = around
    elif spec.pad:
        cover = segment.padded(start, end, F.col("n"), spec.pad)
    else:
        cover = segment.resized(start, end, F.col("n"), config.min_lines, config.max_lines)
    scored = scored.withColumn("cover_start", cover[0]).withColumn("cover_end", cover[1])
    wide = (F.col("cover_start"), F.col("cover_end"))
    chosen = select.suppress(scored, "query_id", "doc_id", config.top_k, spec.rule, cover=wide, test=wide if spec.test_padded else None)
    best = Window.partitionBy("query_id", "doc_id", "start", "end").orderBy(F.col("score").desc(), "seq")
    detail = scored.withColumn("tm_first", F.row_number().over(best)).where("tm_first = 1").select("query_id", "doc_id", "start", "end", "cover_start", "cover_end", "name", "kind")
    out = chosen.join(detail, ["query_id", "doc_id", "start", "end"]).join(docs, "doc_id")
    code = segment.range_text(F.col("text"), F.col("cover_start"), F.col("cover_end"))
    return out.select("query_id", "rank", "doc_id", F.col("cover_start").alias("start"), F.col("cover_end").alias("end"), start.alias("original_start"), end.alias("original_end"), (F.col("cover_end") - F.col("cover_start") + 1).alias("lines"), F.round("score", 2).alias("score"), "name", "kind", code.alias("code"))


def search_lines(docs: DataFrame, queries: DataFrame, config: SearchConfig) -> DataFrame:
    """Lines that hold query words, five or fewer a query, with their neighbours: for texts without code regions."""
    q = query_words(queries, Spec("counts")).select("query_id", F.col("stem").alias("term")).distinct()
    words = segment.lines(docs).select("doc_id", "line_no", F.explode(F.array_distinct(word_runs(F.col("line")))).alias("word"))
    pairs = contained_words(q, words)
    hits = words.join(pairs, "word").groupBy("doc_id", "line_no", "term").agg(F.max(F.when(F.col("word") == F.col("term"), 10).otherwise(3)).alias("points"))
    scored = hits.join(checked_broadcast(q), "term").groupBy("query_id", "doc_id", "line_no").agg((F.sum("points") * 10.0).alias("score"))
    n = docs.select("doc_id", segment.line_count(F.col("text")).alias("n"))
    s, e = segment.padded(F.col("line_no"), F.col("line_no"), F.col("n"), config.min_lines // 2)
    top = stats.top(scored, "query_id", config.top_k * 3, "doc_id", "line_no").drop("rank").join(n, "doc_id").withColumn("start", s).withColumn("end", e)
    chosen = select.suppress(top, "query_id", "doc_id", config.top_k)
    return chosen.join(docs, "doc_id").select("query_id", "rank", "doc_id", "start", "end", (F.col("end") - F.col("start") + 1).alias("lines"), "score", segment.range_text(F.col("text"), F.col("start"), F.col("end")).alias("code"))


def search_windows(docs: DataFrame, queries: DataFrame, config: SearchConfig) -> DataFrame:
    """Sliding windows by seven signals: BM25 (as a share of the best), identifiers, comments, structure, proximity, coverage, stem coverage."""
    q = query_words(queries, Spec("bm25", stem="porter")).select("query_id", "term", "stem").dropDuplicates(["query_id", "term"])
    sizes = q.groupBy("query_id").agg(F.count("*").alias("asked"))
    windows = segment.windows(docs, size=config.max_lines, step=config.window_step, min_lines=min(5, config.min_lines))
    words = segment.lines(docs).select("doc_id", "line_no", F.posexplode(tokens(F.col("line"))).alias("pos", "term"))
    words = stemmed(words, "porter")
    inside = range_join(windows, words, "doc_id", "start", "end", "line_no")
    units = inside.groupBy("doc_id", "start", "end").agg(F.collect_list("stem").alias("tokens"))
    w = ["doc_id", "start", "end"]
    bm25 = stats.bm25_scores(units, q.select("query_id", F.col("stem").alias("term")).distinct(), w, "query_id")
    most = bm25.groupBy("query_id").agg(F.greatest(F.lit(1.0), F.max("score")).alias("most"))
    base = bm25.join(most, "query_id").select("query_id", *w, (F.col("score") / F.col("most") * 0.35).alias("part"))
    asked = checked_broadcast(q)
    term_hits = inside.join(asked.select("query_id", F.col("term").alias("asked_term"), "stem"), "stem")
    exact = F.countDistinct(F.when(F.col("term") == F.col("asked_term"), F.col("asked_term")))
    cover = term_hits.groupBy("query_id", *w).agg(exact.alias("found"), F.countDistinct("stem").alias("stems")).join(checked_broadcast(sizes), "query_id")
    cover = cover.select("query_id", *w, (F.col("found") / F.col("asked") * 0.2 + F.col("stems") / F.col("asked") * 0.15).alias("part"))
    order = Window.partitionBy("query_id", *w).orderBy("line_no", "pos")
    gap = F.when(F.lag("asked_term").over(order) != F.col("asked_term"), (F.col("line_no") - F.lag("line_no").over(order)) * 40 + F.abs(F.col("pos") - F.lag("pos").over(order)) * 6)
    close = term_hits.withColumn("gap", gap).groupBy("query_id", *w).agg(F.avg("gap").alias("gap")).where("gap is not null").select("query_id", *w, (F.greatest(F.lit(0.0), 1 - F.col("gap") / 300) * 0.15).alias("part"))
    comments = segment.line_comments(docs).unionByName(segment.block_comments(docs))
    noted = stemmed(comments.select("doc_id", F.col("line").alias("line_no"), F.explode(tokens(F.col("text"))).alias("term")), "porter")
    noted = range_join(windows, noted, "doc_id", "start", "end", "line_no").join(asked.select("query_id", F.col("term").alias("asked_term"), "stem"), "stem")
    noted = noted.groupBy("query_id", *w).agg(F.least(F.lit(0.3), F.sum(F.when(F.col("term") == F.col("asked_term"), 0.15).otherwise(0.05))).alias("part"))
    regions = segment.regions(docs).select("doc_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "name")
    named = stemmed(regions.where("name is not null").select("doc_id", F.col("r_start").alias("line_no"), F.explode(tokens(F.col("name"))).alias("term")), "porter")
    named = range_join(windows, named, "doc_id", "start", "end", "line_no").join(asked.select("query_id", "stem"), "stem").groupBy("query_id", *w).agg(F.least(F.lit(0.85), F.count("*") * 0.27).alias("part"))
    total = base
    for signal in (cover, close, noted, named):
        total = total.unionByName(signal)
    scored = total.groupBy("query_id", *w).agg(F.sum("part").alias("score"))
    return select.suppress(scored, "query_id", "doc_id", config.top_k, "half").withColumn("score", F.round("score", 4))


def search_terms(docs: DataFrame, queries: DataFrame, config: SearchConfig) -> DataFrame:
    """Lines by occurrences of terms (2 as a word, 1 inside one), with three lines around weighted by distance; five results, scores within 0.1 to 100."""
    q = queries.select("query_id", F.explode(F.filter(F.split(F.lower("query"), "[^A-Za-z0-9_]+"), lambda t: F.length(t) > 1)).alias("term"))
    words = segment.lines(docs).select("doc_id", "line_no", F.explode(word_runs(F.col("line"))).alias("word")).groupBy("doc_id", "line_no", "word").agg(F.count("*").alias("times"))
    short = q.where("length(term) < 3").select("term", F.col("term").alias("word")).distinct()
    pairs = contained_words(q, words).unionByName(short)
    # occurrences may overlap: one at every place where the term begins
    places = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("word") - F.length("term") + 1)), lambda i: F.substr(F.col("word"), i, F.length("term")) == F.col("term")))
    points = F.when(F.col("word") == F.col("term"), 2).otherwise(places)
    hits = words.join(pairs.withColumn("points", points), "word").join(checked_broadcast(q), "term").groupBy("query_id", "doc_id", "line_no").agg(F.sum(F.col("points") * F.col("times")).alias("hits"))
    own = select.band(hits, ["query_id", "doc_id"], 3).withColumn("score", F.col("hits") * 10.0 + (F.col("band") - F.col("hits")) * 5)
    top = stats.top(own.withColumn("lead", F.col("hits").cast("double")), "query_id", 10, "doc_id", "line_no", score="lead").drop("rank")
    n = docs.select("doc_id", segment.line_count(F.col("text")).alias("n"))
    s, e = segment.padded(F.col("line_no"), F.col("line_no"), F.col("n"), 3)
    top = top.join(n, "doc_id").withColumn("start", s).withColumn("end", e)
    # a line in the window of a better line is no centre of its own
    chosen = select.suppress(top.withColumn("score", F.col("lead")), "query_id", "doc_id", 10, test=(F.col("line_no"), F.col("line_no")))
    out = chosen.drop("score", "rank").join(top.select("query_id", "doc_id", "start", "end", "score"), ["query_id", "doc_id", "start", "end"])
    out = stats.top(out, "query_id", 5, "doc_id", "start")
    return out.withColumn("score", F.greatest(F.lit(0.1), F.least(F.lit(100.0), F.col("score"))))


SPECS = {
    "final": Spec("weighted", stem="porter", fill=False),
    "pure": Spec("weighted", stem="porter"),
    "counts": Spec("counts"),
    "counts_padded": Spec("counts", short_penalty=0.3, pad=4),
    "stem_counts": Spec("counts", stem="plain", per_match=2, per_term=10, name=(50, 15), pad=4),
    "bm25_stems": Spec("bm25", backoff=True, stem="tion", stop_words=SHORT_STOP_WORDS, min_chars=2, name=(5, 3), multipliers=(1.5, 1.2, 1.1, 1.1), pad=4),
    "bm25_history": Spec("bm25", stem="e", stop_words=SHORT_STOP_WORDS, min_chars=2, name=(5, 3), multipliers=(1.5, 1.2, 1.1, 1.1), pad=4),
    "bm25_spans": Spec("bm25", span_curve=True, pad=4, test_padded=True),
}


def _region_engine(name: str) -> Callable[..., DataFrame]:
    def run(docs: DataFrame, queries: DataFrame, config: SearchConfig = SearchConfig(), **options) -> DataFrame:
        if name == "pure":
            options.setdefault("weights", Weights(k1=0.8, b=0.2))
        return search_regions(docs, queries, SPECS[name], config, **options)

    return run


#: Plug-in contract: (docs, queries, config) to (query_id, rank, doc_id, start, end, score, ...).
ENGINES: dict[str, Callable[..., DataFrame]] = {name: _region_engine(name) for name in SPECS} | {
    "windows": lambda docs, queries, config=SearchConfig(5, 80, 3): search_windows(docs, queries, config),
    "lines": lambda docs, queries, config=SearchConfig(): search_lines(docs, queries, config),
    "terms": lambda docs, queries, config=SearchConfig(): search_terms(docs, queries, config),
}


def search(docs: DataFrame, queries: DataFrame, engine: str = "final", config: SearchConfig | None = None, **options) -> DataFrame:
    """Results of an engine; region engines fall back to lines for documents without regions."""
    run = ENGINES[engine]
    found = run(docs, queries, config, **options) if config else run(docs, queries, **options)
    if engine not in SPECS:
        return found
    bare = docs.join(segment.regions(docs).select("doc_id").distinct(), "doc_id", "left_anti")
    lines = search_lines(bare, queries, config or SearchConfig())
    both = found.unionByName(lines, allowMissingColumns=True)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id", "start")
    k = (config or SearchConfig()).top_k
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def padded_to_five(found: DataFrame, queries: DataFrame) -> DataFrame:
    """Engines that always give five ranges: missing ones are lines 1 to 2 with score 0."""
    return select.pad_results(found, queries, "query_id", 5)


def save(found: DataFrame, queries: DataFrame, config: SearchConfig, path: str) -> None:
    """One JSON envelope for each query: query, timestamp, config, totalResults, results."""
    names = [c for c in found.columns if c != "query_id"]
    grouped = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in names if c != "rank"]))).alias("results"))
    settings = F.struct(*[F.lit(getattr(config, f.name)).alias(f.name) for f in fields(config)])
    out = queries.join(grouped, "query_id", "left").select("query_id", "query", F.current_timestamp().alias("timestamp"), settings.alias("config"), F.coalesce(F.size("results"), F.lit(0)).alias("totalResults"), "results")
    out.coalesce(1).write.mode("overwrite").json(path)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Rank line ranges of a file for a query.")
    parser.add_argument("source")
    parser.add_argument("query")
    parser.add_argument("--engine", default="final", choices=sorted(ENGINES))
    parser.add_argument("--min", type=int, default=10)
    parser.add_argument("--max", type=int, default=100)
    parser.add_argument("--topK", type=int, default=5)
    parser.add_argument("--expand", action="store_true")
    parser.add_argument("--out", default="results")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    config = SearchConfig(a.min, a.max, a.topK, a.expand)
    queries = spark.createDataFrame([("q", a.query)], "query_id string, query string")
    save(search(source(spark, a.source), queries, a.engine, config), queries, config, a.out)


if __name__ == "__main__":
    main()
