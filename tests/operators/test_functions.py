"""Text functions, stems and similarities on inline values."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import fuzzy
from tidemark.functions import text as T
from tidemark.operators import stats
from tidemark.operators.joins import contained_words, overlap_join, range_join, similar_terms


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("fooBar snake_case kebab-case", ["foo", "bar", "snake", "case", "kebab", "case"]), ("XMLParser v2x ab", ["xmlparser", "v2x"]), ("the and OF", []), ("", []), (None, []), ("größe Öl 123", ["123"])],
)
def test_tokens(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(T.tokens(F.col("t"))).first()[0]
    assert got == expected


def test_identifiers_and_grams(spark):
    assert one(spark, T.identifier_parts(F.col("t")), t="getXMLHttp_v2-item.nameX") == ["get", "xml", "http", "v2", "item", "name"]
    assert one(spark, T.ngrams(F.split("t", " "), 2), t="a b c") == ["a_b", "b_c"]
    assert one(spark, T.ngrams(F.split("t", " "), 3), t="a b") == []


@pytest.mark.parametrize(("word", "plain", "tion", "e"), [("queries", "query", "query", "query"), ("boxes", "box", "box", "box"), ("class", "class", "class", "class"), ("cats", "cat", "cat", "cat"), ("running", "runn", "runn", "runn"), ("added", "add", "add", "add"), ("station", "station", "sta", "sta"), ("cache", "cache", "cache", "cach"), ("one", "one", "one", "one")])
def test_suffix_stems(spark, word, plain, tion, e):
    assert [one(spark, T.suffix_stem(F.col("t"), r), t=word) for r in ("plain", "tion", "e")] == [plain, tion, e]


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("digitizer", "digit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("roll", "roll"), ("is", "is")])
def test_porter(word, stem):
    assert fuzzy.porter(word) == stem


def test_jaro_winkler():
    assert fuzzy.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert fuzzy.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert fuzzy.jaro_winkler("abc", "xyz") == 0 and fuzzy.jaro_winkler("same", "same") == 1


def test_similar_terms_block_loses_nothing(spark):
    import random

    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(150)})
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    got = {(r["a"], r["b"]) for r in similar_terms(terms, terms, 0.8).collect()}
    assert got == {(a, b) for a in words for b in words if len(a) > 2 and len(b) > 2 and fuzzy.jaro_winkler(a, b) >= 0.8}
    long = ["x" * 300, "x" * 299 + "y", "y" * 250 + "z" * 50, "z" + "x" * 299, "q" * 210]
    more = spark.createDataFrame([(w,) for w in [*long, None, "", "ab"]], "term string")
    assert {(r["a"], r["b"]) for r in similar_terms(more, more, 0.8).collect()} == {(a, b) for a in long for b in long if fuzzy.jaro_winkler(a, b) >= 0.8}
    for threshold in (0.5, 0.7, 0.92):
        assert {(r["a"], r["b"]) for r in similar_terms(terms, terms, threshold).collect()} == {(a, b) for a in words for b in words if len(a) > 2 and len(b) > 2 and fuzzy.jaro_winkler(a, b) >= threshold}
    assert similar_terms(terms.limit(0), terms.limit(0), 0.8).count() == 0
    inside = {(r["term"], r["word"]) for r in contained_words(terms, terms.withColumnRenamed("term", "word")).collect()}
    assert inside == {(a, b) for a in words for b in words if len(a) > 2 and a in b}


def test_counts_of_wanted_terms(spark):
    docs = spark.createDataFrame([(1, "Alpha beta the alphaBeta ab\nbeta"), (2, None), (3, ""), (4, "gamma " * 5), (5, "beta")], "doc_id long, text string")
    wanted = spark.createDataFrame([("alpha",), ("beta",), ("beta",), ("the",), ("ab",)], "term string")
    counts = stats.wanted_counts(docs, wanted, "doc_id")
    rows = {(r["doc_id"], r["term"]): r["tf"] for r in counts.collect()}
    assert rows == {(1, "alpha"): 2, (1, "beta"): 3, (1, None): 0, (2, None): 0, (3, None): 0, (4, None): 5, (5, "beta"): 1}
    units = {r["doc_id"]: (r["length"], sorted(map(tuple, r["terms"]))) for r in stats.unit_terms(counts, "doc_id").collect()}
    assert units == {1: (5, [("alpha", 2), ("beta", 3)]), 2: (0, []), 3: (0, []), 4: (5, []), 5: (1, [("beta", 1)])}
    empty = docs.limit(0)
    asked = wanted.selectExpr("1 AS q", "term")
    assert stats.bm25_units(stats.unit_terms(stats.wanted_counts(empty, wanted, "doc_id"), "doc_id"), asked, ["doc_id"], "q").count() == 0


def test_window_counts_are_those_of_the_windows_lines(spark):
    rng = random.Random(8)
    rows = [(i, "\n".join(" ".join(rng.choice(["alpha", "beta", "gamma", "the"]) for _ in range(rng.randrange(4))) for _ in range(rng.randrange(1, 60)))) for i in range(12)]
    docs = spark.createDataFrame([*rows, (90, None), (91, "\n" * 4)], "doc_id int, text string")
    wanted = spark.createDataFrame([("alpha",), ("beta",)], "term string")
    got = {(r["doc_id"], r["start"], r["end"]): (r["length"], sorted(map(tuple, r["terms"]))) for r in stats.unit_terms(stats.window_counts(docs, wanted, 12, 4, 5), "doc_id", "start", "end").collect()}
    expected = {}
    for i, text in [*rows, (91, "\n" * 4)]:
        lines = text.split("\n")
        for s in range(1, len(lines) + 1, 4):
            own = " ".join(lines[s - 1 : s + 11]).split()
            if len(lines[s - 1 : s + 11]) >= 5:
                expected[i, s, min(len(lines), s + 11)] = (sum(w != "the" for w in own), sorted((w, own.count(w)) for w in ("alpha", "beta") if w in own))
    assert got == expected
    with pytest.raises(ValueError):
        stats.window_counts(docs, wanted, 10, 4)


def test_gram_rows(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"]), (3, []), (4, None), (5, ["x", "y"])], "k int, t array<string>")
    assert sorted(tuple(r) for r in T.gram_rows(docs, "t", "k").collect()) == [(1, 2, "a_b"), (1, 2, "b_c"), (1, 3, "a_b_c"), (5, 2, "x_y")]


def test_range_and_overlap_joins(spark):
    import random

    rng = random.Random(3)
    spans = [(rng.randrange(3), s := rng.randrange(300), s + rng.randrange(150)) for _ in range(60)]
    a = spark.createDataFrame(spans, "k int, s int, e int")
    points = [(rng.randrange(3), rng.randrange(450)) for _ in range(200)]
    p = spark.createDataFrame(points, "k int, at int")
    assert range_join(a, p, "k", "s", "e", "at").count() == sum(k == q and s <= x <= e for k, s, e in spans for q, x in points)
    b = a.select("k", F.col("s").alias("s2"), F.col("e").alias("e2"))
    assert overlap_join(a, b, "k", "s", "e", "s2", "e2").count() == sum(k == q and s <= f and t <= e for k, s, e in spans for q, t, f in spans)


@pytest.mark.parametrize(("line", "hidden"), [("A=1", "A=***"), ("A=", "A="), ("#A=1", "#A=1"), (" # A=1", " # A=1"), ("A=b=c", "A=***"), ("plain", "plain"), ("A= ", "A= ")])
def test_masks(spark, line, hidden):
    assert one(spark, T.masked(F.col("t")), t=line) == hidden


@pytest.mark.parametrize(("text", "query", "context"), [("ask", "ask", ""), ("ask [CTX_START] a b", "ask", "a b"), ("ask [CTX_START] a [CTX_END] z", "ask", "a"), ("q [CTX_START] a [CTX_START] b [CTX_END]", "q", "a")])
def test_markers(spark, text, query, context):
    assert (one(spark, T.query_before_marker(F.col("t")), t=text), one(spark, T.context_in_markers(F.col("t")), t=text)) == (query, context)


def test_small_scalars(spark):
    assert one(spark, T.extension_of(F.col("t")), t="video/mp4; charset=x") == ".mp4" and one(spark, T.extension_of(F.col("t")), t="text/html") is None
    assert one(spark, T.clean_text(F.col("t")), t="  a  b  See more ") == "a b" and one(spark, T.clean_text(F.col("t")), t=" ") is None
    assert one(spark, T.slug_title(F.col("t")), t="ann-mcKay") == "Ann McKay" and one(spark, T.file_key(F.col("t")), t="A b_C!") == "a-b-c-"
    assert one(spark, T.truncated(F.col("t"), 3), t="abcd") == "abc..."
    assert one(spark, T.overlap_lines(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a=1, b=10, c=8, d=12) == 3
    assert one(spark, T.overlap_lines(F.lit(None).cast("int"), F.col("b"), F.col("c"), F.col("d")), b=10, c=8, d=12) is None
