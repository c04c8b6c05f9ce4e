"""Event, page, order, source and streaming operators on inline rows."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import commerce, evaluate, events, feed, pages, select
from tidemark.sources import tables


def at(spark, rows, kinds="event_id long, user_id long, s long, kind string"):
    return spark.createDataFrame(rows, kinds).withColumn("ts", F.timestamp_seconds("s"))


def test_limiters(spark):
    burst = at(spark, [(i, 1, 100, "x") for i in range(5)] + [(9, 1, 125, "x"), (10, 1, 126, "x"), (11, 2, 0, "x")])
    got = {r["user_id"]: (r["allowed"], r["denied"]) for r in events.token_bucket(burst, "user_id", F.col("ts"), capacity=3, refill_per_s=0.1).collect()}
    assert got == {1: (5, 2), 2: (1, 0)}
    edge = at(spark, [(1, 1, 0, "x"), (2, 1, 10, "x"), (3, 1, 60, "x"), (4, 1, 61, "x")])
    assert events.fixed_window(edge, "user_id", F.col("ts"), window_s=60, most=2).first()[1:] == (3, 1)
    assert events.ttl_cache(edge, "user_id", F.col("ts"), ttl_s=60).first()[1:] == (2, 2)


def test_circuit_breaker(spark):
    rows = [(1, 1, 0, "bad"), (2, 1, 1, "bad"), (3, 1, 2, "ok"), (4, 1, 31, "ok"), (5, 1, 32, "bad"), (6, 1, 33, "ok")]
    r = events.circuit_breaker(at(spark, rows), "user_id", F.col("ts"), F.col("kind") == "bad", failures=2, open_s=30).first()
    assert (r["state"], r["rejected"], r["opened"]) == ("CLOSED", 1, 1)
    again = rows[:3] + [(4, 1, 31, "bad")]
    r = events.circuit_breaker(at(spark, again), "user_id", F.col("ts"), F.col("kind") == "bad", failures=2, open_s=30).first()
    assert (r["state"], r["opened"]) == ("OPEN", 2)


def test_sessions_and_order(spark):
    out_of_order = at(spark, [(3, 1, 7201, "x"), (1, 1, 0, "x"), (2, 1, 3600, "x"), (4, 1, 7201, "x")])
    assert sorted(r["events"] for r in events.sessions(out_of_order, "user_id").collect()) == [2, 2]
    assert {(r["event_id"], r["version"]) for r in events.versions(out_of_order, ["user_id"]).collect()} == {(1, 1), (2, 2), (3, 3), (4, 4)}
    assert [r["event_id"] for r in events.last_n(out_of_order, "user_id", 2).orderBy("pos").collect()] == [4, 3]
    assert {r["event_id"]: r["state"] for r in events.buffered_until(out_of_order, "user_id", F.col("event_id") == 2).collect()} == {1: "buffered", 2: "flushed", 3: "direct", 4: "direct"}
    assert events.log_filter(out_of_order, event_id_min=0, kind="", user_id=1).count() == 4


def test_leases_concurrency_health_backoff(spark):
    asks = at(spark, [(1, 1, 0, "a"), (2, 1, 5, "b"), (3, 1, 9, "a"), (4, 1, 19, "b"), (5, 1, 20, "b")])
    assert events.leases(asks, "user_id", "kind", F.col("ts"), "event_id", 10).first()[1:] == (3, 2)
    spans = spark.createDataFrame([("k", 0, 5), ("k", 5, 9), ("k", 1, 6)], "k string, a int, b int")
    assert events.concurrency(spans, "k", "a", "b").first()["peak"] == 2
    checks = spark.createDataFrame([(True, True), (None, False)], "healthy boolean, critical boolean")
    assert events.rollup_health(checks).first()["status"] == "degraded"
    assert [r[0] for r in spark.range(9).select(events.backoff(F.col("id"), 100, 2, 1000)).collect()] == [100, 200, 400, 800, 1000, 1000, 1000, 1000, 1000]
    assert spark.range(1).select(events.backoff(F.lit(1), jitter=F.lit(-1.0))).first()[0] == 150


def test_page_operators(spark, tmp_path):
    html = "<title>T</title><h1> A <b>b</b> see more</h1><dt>Web site</dt><dd>x <i>y</i></dd><a href=\"https://own.example/a\"><a href=\"https://other.example/b\">"
    p = spark.createDataFrame([(1, "https://own.example/en/7/?q", html), (2, "https://own.example/in/p/settings", None)], "page_id long, url string, html string")
    row = pages.page_fields(p).where("page_id = 1").first()
    assert (row["heading"], row["title"], row["name"], row["n_links"]) == ("A b", "T", "A b", 2)
    lang, number = pages.url_route(F.col("url"))
    assert [tuple(r) for r in p.select(lang, number).collect()] == [("en", "7"), (None, None)]
    assert p.select(pages.label_value(F.col("html"), "Web")).first()[0] == "x y"
    assert p.select(pages.external_link(F.col("html"), F.lit("own.example"))).first()[0] == "https://other.example/b"
    assert [r[0] for r in spark.createDataFrame([("9 followers",), ("50 employees",), ("Ulm, DE",), ("Software",)], "t string").select(pages.info_kind(F.col("t"))).collect()] == ["followers", "size", "location", "industry"]
    assert spark.range(1).select(pages.posts(F.array(F.lit("x" * 300), F.lit("short"), F.lit("long enough text")))).first()[0] == ["x" * 200 + "...", "long enough text"]
    records = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "url string, at int")
    assert {tuple(r) for r in pages.upsert_latest(records, "url", "at").collect()} == {("a", 3), ("b", 2)}
    assert pages.new_only(records, records.where("url = 'a'"), "url").count() == 1
    folder = pages.export(records, str(tmp_path))
    assert spark.read.json(folder).count() == 3
    with pytest.raises(ValueError):
        pages.export(records.limit(0), str(tmp_path))
    pages.clear(records, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 0


def test_feed(spark):
    items = spark.createDataFrame([(i % 7, f"text {i}") for i in range(60)], "id long, text string")
    assert feed.admit(items, "id", "text", 4).count() == 7
    out = feed.batches(items.withColumn("lane", F.lit(1)), "lane", "text", 25).groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in out} == {0: 25, 1: 25, 2: 10}
    assert feed.classify(items, "id", "text", lambda t: t.str.endswith("9")).where("hidden").count() == 6
    assert feed.classify(items, "id", "text", lambda t: 1 / 0).where("hidden").count() == 0
    assert feed.flagged(items, spark.createDataFrame([(3,), (3,)], "id long"), "id").where("hidden").count() == 9


def test_tasks_and_orders(spark):
    tasks = spark.createDataFrame([(i, ["low", "default", "critical"][i % 3], i) for i in range(300)], "id long, queue string, n int")
    turn = commerce.weighted_order(tasks, "id", "queue", {"critical": 6, "default": 3, "low": 1})
    first = turn.orderBy("turn").limit(60).groupBy("queue").count().collect()
    counts = {r["queue"]: r["count"] for r in first}
    assert counts["critical"] > counts["default"] > counts.get("low", 0)
    out = {r["id"]: (r["tries"], r["outcome"]) for r in commerce.attempts(tasks.limit(5), "id", F.col("n"), 2, F.col("id") == 4).collect()}
    assert out == {0: (1, "done"), 1: (2, "done"), 2: (3, "done"), 3: (3, "dead"), 4: (1, "skipped")}
    status = commerce.pipeline_status(spark.createDataFrame([(None, True, True), (".mp4", False, True), (".mp4", True, True)], "e string, d boolean, c boolean"), F.col("e"), F.col("d"), F.col("c"))
    assert [r["status"] for r in status.collect()] == ["unsupported type", "download failed", "done"]
    picked = commerce.weighted_pick(spark.createDataFrame([("s", "a", 1), ("s", "b", 3), ("s", "c", 1)], "by string, name string, w int"), "by", "w", "name", F.lit(0.5))
    assert [r["name"] for r in picked.collect()] == ["b"]


def test_marks_and_subwindows(spark):
    truth = spark.createDataFrame([("q", 10, 19), ("r", 1, 4), ("s", 5, 5)], "q string, start int, end int")
    found = spark.createDataFrame([("q", 15, 30), ("r", 1, 90)], "q string, start int, end int")
    assert {r["q"]: r["marks"] for r in evaluate.marks(found, truth, ["q"]).collect()} == {"q": 5.0, "r": 10.0, "s": 0.0}
    assert [r[0] for r in spark.createDataFrame([(0.6,), (0.5,), (0.3,), (0.1,), (0.0,)], "s double").select(evaluate.step_marks(F.col("s"))).collect()] == [10, 10, 5, 1, 0]
    table = spark.createDataFrame([("a", 9.0), ("b", 7.5), ("c", 7.5)], "engine string, total double")
    assert [r["lead"] for r in evaluate.leads(table).orderBy("engine").collect()] == [1.5, 0.0, 0.0]
    assert {tuple(r) for r in evaluate.best_by_group(table, spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y")], "engine string, kind string")).collect()} == {("x", "a", 9.0), ("y", "c", 7.5)}
    assert evaluate.markdown(table, "Engines").splitlines()[2] == "| engine | total |"
    hits = spark.createDataFrame([("d", i, int(i in (3, 4, 9))) for i in range(1, 12)], "doc string, line_no int, hits int")
    r = select.best_subwindow(hits, ["doc"], 3).first()
    assert (r["start"], r["end"], r["hits"]) == (2, 4, 2)


def test_sources(spark, tmp_path):
    assert tables.source(spark, "a\nb").first()["doc_id"] == "inline"
    (tmp_path / "x.js").write_text("code\nline")
    assert tables.source(spark, str(tmp_path / "x.js")).first()["text"] == "code\nline"
    assert tables.source(spark, "no such file").first()["text"] == "no such file"
    (tmp_path / "env").mkdir()
    (tmp_path / "env/.env").write_text("A=1\n")
    (tmp_path / "env/other.txt").write_text("B=1\n")
    (tmp_path / "env/deep").mkdir()
    (tmp_path / "env/deep/prod.env").write_text("C=1\n\nD=2")
    assert sorted((r["file"], r["line"]) for r in tables.config_lines(spark, str(tmp_path / "env")).collect()) == [(".env", "A=1"), ("prod.env", ""), ("prod.env", "C=1"), ("prod.env", "D=2")]
    assert tables.config_lines(spark, str(tmp_path / "log-none")).count() == 0
    (tmp_path / "log").write_text('{"a": 1}\n---\n{"a": 2}\n---\n')
    assert [r["a"] for r in tables.append_log(spark, str(tmp_path / "log"), "a int").collect()] == [1, 2]
    report = {"questions": [{"id": "1", "query": "q", "results": {"x": {"overlapLines": 3, "marks": 12.0}, "y": {"overlapLines": 0, "marks": 0.0}}}]}
    (tmp_path / "report.json").write_text(json.dumps(report))
    rows = tables.report_rows(spark, str(tmp_path / "report.json"))
    tables.write_by_engine(rows, str(tmp_path / "by"))
    assert sorted(p.name for p in (tmp_path / "by").glob("engine=*")) == ["engine=x", "engine=y"]
    r = tables.chart_series(rows, ["x", "y", "z"]).first()
    assert (r["x"], r["y"], r["z"], r["truth"]) == (1.0, 0.0, 0.0, 1.0)
    assert tables.settings('{"a": 5, "b": 1}', {"a": 1, "c": 2}) == {"a": 5, "c": 2}


def test_block_list_and_faulty_window(spark):
    rows = [(1, 1, 0, "x"), (2, 1, 10, "bad"), (3, 1, 20, "x"), (4, 1, 60, "bad"), (5, 1, 119, "x"), (6, 1, 120, "x"), (7, 2, 15, "x"), (8, 2, 16, None)]
    got = {r["user_id"]: (r["passed"], r["refused"]) for r in events.block_list(at(spark, rows), "user_id", F.col("ts"), F.col("kind") == "bad", block_s=60).collect()}
    assert got == {1: (2, 2), 2: (2, 0)}
    burst = at(spark, [(i, 1, s, "x") for i, s in enumerate([0, 1, 2, 61, 62, 63])])
    assert events.fixed_window(burst, "user_id", F.col("ts"), window_s=60, most=2).first()[1:] == (4, 2)
    assert events.fixed_window(burst, "user_id", F.col("ts"), window_s=60, most=2, restart=False).first()[1:] == (5, 1)


def test_services_and_keys(spark):
    checks = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 3, True), ("b", 4, None), ("c", 5, True)], "grp string, id int, critical boolean")
    results = spark.createDataFrame([(1, False), (2, True), (3, True), (4, None)], "id int, healthy boolean")
    got = {r["grp"]: tuple(r)[1:] for r in events.health_of(checks, results, "grp", "id").collect()}
    assert got == {"a": (2, 1, "degraded"), "b": (2, 1, "degraded"), "c": (1, 1, "critical")}
    instances = spark.createDataFrame([("s", 2, True), ("s", 1, False), ("s", 3, True), ("t", 4, None)], "name string, id int, up boolean")
    assert [tuple(r) for r in events.discovered(instances, "name", "id", F.col("up")).collect()] == [("s", 2, 2)]
    asked = spark.createDataFrame([(1, None), (2, "gone"), (3, "old"), (4, "edge"), (5, "free")], "n int, key string")
    keys = spark.createDataFrame([("old", 9), ("edge", 10), ("free", None)], "key string, expires int")
    got = {r["n"]: (r["valid"], r["reason"]) for r in events.key_checked(asked, keys, "key", F.lit(10)).collect()}
    assert got == {1: (False, "missing"), 2: (False, "invalid"), 3: (False, "expired"), 4: (True, None), 5: (True, None)}


def test_validators_and_folders(spark):
    from tidemark.functions import text

    rows = spark.createDataFrame([("a@b.c",), ("a@@b.c",), ("a@b.c\n",), ("ab_1",), ("Abcdefg1",), ("Abcdef\n1",), ("<'\">&",), (None,)], "w string")
    got = {r[0]: tuple(r)[1:] for r in rows.select("w", text.valid_email(F.col("w")), text.valid_user_name(F.col("w")), text.valid_password(F.col("w")), text.html_escaped(F.col("w"))).collect()}
    assert [k for k, v in got.items() if v[0]] == ["a@b.c"]
    assert sorted(k for k, v in got.items() if v[1]) == ["Abcdefg1", "ab_1"]
    assert [k for k, v in got.items() if v[2]] == ["Abcdefg1"]
    assert got["<'\">&"][3] == "&lt;&#x27;&quot;&gt;&" and got[None] == (None, None, None, None)
    calls = spark.createDataFrame([(503, None), (404, "ETIMEDOUT"), (404, None), (None, None)], "status int, code string")
    assert [r[0] for r in calls.select(text.retryable(F.col("status"), F.col("code"))).collect()] == [True, True, False, False]
    files = spark.createDataFrame([("a/b/x", 1), ("a/y", 2), ("z", 4), (None, 8), ("a/n", None)], "path string, size long")
    assert {tuple(r) for r in pages.folder_sizes(files, "path", "size").collect()} == {(".", 4, 7), ("a", 3, 3), ("a/b", 1, 1)}
