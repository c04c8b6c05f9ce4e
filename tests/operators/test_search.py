"""Regions, engines, suppression and resizing on small scripts."""

import json

import pytest

from tidemark.operators import segment
from tidemark.operators.select import suppress
from tidemark.plans.search import ENGINES, SearchConfig, main, padded_to_five, save, search

CODE = """// keeps users in memory
const cache = new Map();

/* loads a user
 * by its id */
function loadUser(id) {
  const text = "{ not a block";
  if (cache.has(id)) {
    return cache.get(id); // found
  }
  return fetchRow(`user ${id}`);
}

class SessionStore {
  constructor(limit) {
    this.limit = limit;
  }

  expireSessions(now) {
    const pattern = /[{]/;
    for (const s of this.rows) {
      if (now - s.seen > this.limit) this.drop(s);
    }
  }
}

app.get('/orders', (req, res) => {
  res.json(listOrders());
});

const settings = {
  retries: [
    1,
    2,
    3,
    4,
  ],
  name: "x",
};

const sum = (a, b) => {
  return a + b;
};
"""


def test_regions():
    found = {(r["kind"], r["name"]): (r["start"], r["end"]) for r in segment.scan_regions(CODE)}
    assert found["function", "loadUser"] == (6, 12)
    assert found["class", "SessionStore"] == (14, 25)
    assert found["method", "expireSessions"] == (19, 24)
    assert found["method", "constructor"] == (15, 17)
    assert found["route", "app.get('/orders')"] == (27, 29)
    assert found["property", "retries"] == (32, 37)
    assert found["arrow", "sum"] == (41, 43)
    by = {r["name"]: r for r in segment.scan_regions(CODE)}
    parents = {r["seq"]: r["name"] for r in by.values()}
    assert parents[by["expireSessions"]["parent_seq"]] == "SessionStore" and by["loadUser"]["parent_seq"] is None
    assert segment.scan_regions("") == [] and segment.scan_regions("plain words ( only") == []


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("a.js", CODE), ("b.txt", "the session of a user\nnothing here\norders and orders\n"), ("c", "")], "doc_id string, text string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([("q1", "load user by id"), ("q2", "expire old sessions"), ("q3", "orders route"), ("q4", "the of")], "query_id string, query string")


def test_comments(docs):
    assert {(r["line"], r["text"]) for r in segment.line_comments(docs).collect()} == {(1, "keeps users in memory"), (9, "found")}
    assert [(r["doc_id"], r["line"], r["text"]) for r in segment.block_comments(docs).collect()] == [("a.js", 4, "loads a user by its id")]


@pytest.mark.parametrize("engine", sorted(ENGINES))
def test_engines(docs, queries, engine):
    config = SearchConfig(5, 12, 3)
    rows = search(docs, queries, engine, config).collect()
    assert rows and {r["query_id"] for r in rows} <= {"q1", "q2", "q3"} | ({"q4"} if engine == "terms" else set())  # that one has no stop words
    for q in ("q1", "q2", "q3"):
        own = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
        assert all(a["score"] >= b["score"] for a, b in zip(own, own[1:], strict=False)) or engine == "terms"
        assert all(1 <= r["start"] <= r["end"] for r in own)
    if engine in ("final", "pure", "counts", "bm25_spans"):
        top = {r["query_id"]: r for r in rows if r["rank"] == 1}
        assert "loadUser" in top["q1"]["code"] and "expireSessions" in top["q2"]["code"]


def test_synonyms_rules_and_smart_ranges(spark, docs, queries):
    words = spark.createDataFrame([("fetch", "load"), ("purge", "expire")], "key string, syn string")
    asked = spark.createDataFrame([("q", "purge stale")], "query_id string, query string")
    assert not [r for r in search(docs, asked, "counts").collect() if r["name"]]
    found = search(docs, asked, "counts", synonyms=words).where("rank = 1").first()
    assert "expireSessions" in found["code"]
    rules = spark.createDataFrame([("listOrders", None, 1000.0, 5.0)], "pattern string, query_term string, factor double, points double")
    boosted = search(docs, spark.createDataFrame([("q", "json user cache")], "query_id string, query string"), "counts", rules=rules).where("rank = 1").first()
    assert "listOrders" in boosted["code"]
    wide = search(docs, queries, "final", SearchConfig(2, 30, 5, smart_expand=True)).where("query_id = 'q2' and rank = 1").first()
    assert (wide["start"], wide["end"]) == (14, 25) or "expireSessions" in wide["code"]


def test_backoff_finds_longer_words(spark, docs):
    asked = spark.createDataFrame([("q", "expir")], "query_id string, query string")
    assert "expireSessions" in search(docs, asked, "bm25_stems").where("rank = 1").first()["code"]


def test_save_and_command(spark, docs, queries, tmp_path):
    config = SearchConfig()
    save(search(docs, queries, "final", config), queries, config, str(tmp_path / "out"))
    rows = [json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()]
    assert {r["query_id"]: r["totalResults"] > 0 for r in rows} == {"q1": True, "q2": True, "q3": True, "q4": False}
    assert rows[0]["config"]["top_k"] == 5
    (tmp_path / "file.js").write_text(CODE)
    main([str(tmp_path / "file.js"), "load user", "--topK", "2", "--out", str(tmp_path / "cli")])
    assert list((tmp_path / "cli").glob("*.json"))
    assert padded_to_five(search(docs, queries, "counts"), queries).count() == 20


def test_suppression(spark):
    rows = [("q", "d", 1, 10, 9.0), ("q", "d", 10, 20, 8.0), ("q", "d", 11, 20, 7.0), ("q", "e", 1, 10, 7.0), ("q", "d", 16, 25, 6.0), ("q", "d", 26, 30, 5.0), ("r", "d", 1, 2, 1.0)]
    found = spark.createDataFrame(rows, "query string, doc string, start int, end int, score double")
    got = lambda **k: [(r["doc"], r["start"]) for r in suppress(found, "query", "doc", 5, **k).where("query = 'q'").orderBy("rank").collect()]
    assert got() == [("d", 1), ("d", 11), ("e", 1), ("d", 26)]
    assert got(rule="half") == [("d", 1), ("d", 10), ("e", 1), ("d", 16), ("d", 26)]
    from pyspark.sql import functions as F

    wide = (F.col("start") - 4, F.col("end") + 4)
    assert got(cover=wide) == [("d", 1), ("e", 1), ("d", 16)]
    assert got(cover=wide, test=wide) == [("d", 1), ("e", 1), ("d", 26)]
    assert suppress(found, "query", "doc", 1).count() == 2


@pytest.mark.parametrize("rule", ["strict", "half"])
def test_suppression_goes_on_to_the_last_candidate(spark, rule):
    near = [("q", "d", s, s + 79, 9.0) for s in range(1, 301)]
    far = [("q", "d", s, s + 79, 1.0) for s in (1001, 1041, 2001, 3001)]
    found = spark.createDataFrame(near + far, "query string, doc string, start int, end int, score double")
    got = [(r["rank"], r["start"]) for r in suppress(found, "query", "doc", 20, rule).orderBy("rank").collect()]
    starts = [1, 81, 161, 241, 1001, 2001, 3001] if rule == "strict" else [1, 41, 81, 121, 161, 201, 241, 281, 1001, 1041, 2001, 3001]
    assert got == list(enumerate(starts, 1))


def test_resizing(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(5, 6, 100), (1, 2, 100), (99, 100, 100), (10, 60, 100), (3, 3, 4)], "s int, e int, n int")
    out = rows.select(*segment.resized(F.col("s"), F.col("e"), F.col("n"), 10, 20)).collect()
    assert [tuple(r) for r in out] == [(1, 10), (1, 6), (95, 100), (10, 29), (1, 4)]
