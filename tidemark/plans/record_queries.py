"""Registered queries over pages, events, orders and conversations, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import clean_text, context_in_markers, extension_of, has_secret_value, html_escaped, masked, query_before_marker, retryable, truncated, valid_email, valid_password, valid_user_name
from tidemark.operators import commerce, events, feed, pages, segment
from tidemark.sources.tables import table
from tidemark.streaming import queries as streams

def page_fields(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_fields(table(spark, sf, "pages"))


def page_url_route(spark: SparkSession, sf: str) -> DataFrame:
    lang, slug = pages.url_route(F.col("url"))
    return table(spark, sf, "pages").select("page_id", pages.host(F.col("url")).alias("host"), lang.alias("lang"), slug.alias("number"))


def page_clean_truncate(spark: SparkSession, sf: str) -> DataFrame:
    text = clean_text(F.regexp_replace("html", "<[^>]*>", " "))
    return table(spark, sf, "pages").select("page_id", truncated(text, 2500).alias("text"), F.length(text).alias("n_chars"))


def by_host(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").withColumn("host", pages.host(F.col("url")))


def page_upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    return pages.upsert_latest(by_host(spark, sf), "host", "page_id").select("host", "page_id", "url")


def page_store_stats(spark: SparkSession, sf: str) -> DataFrame:
    return pages.store_stats(table(spark, sf, "pages"), pages.host(F.col("url"))).withColumnRenamed("grp", "host")


def page_anti_captured(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose host has no page of an even page_id before (the stored half)."""
    p = by_host(spark, sf)
    return pages.new_only(p, p.where("page_id % 2 = 0"), "host").select("page_id", "host")


def feed_batches(spark: SparkSession, sf: str) -> DataFrame:
    return feed.batches(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "source", "batch")


def feed_flagged_semi(spark: SparkSession, sf: str) -> DataFrame:
    toxic = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return feed.flagged(table(spark, sf, "documents").select("doc_id", "lang"), toxic, "doc_id").groupBy("lang", "hidden").agg(F.count("*").alias("n"))


def marker_split(spark: SparkSession, sf: str) -> DataFrame:
    """User turns as questions with the answer that follows as their context."""
    from pyspark.sql import Window

    c = table(spark, sf, "conversations").withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    marked = F.concat(F.col("text"), F.lit(" [CTX_START] "), F.coalesce("next", F.lit("")), F.lit(" [CTX_END]"))
    return c.where("role = 'user'").select("conv_id", "turn", query_before_marker(marked).alias("query"), context_in_markers(marked).alias("context"))


def mask_values(spark: SparkSession, sf: str) -> DataFrame:
    lines = segment.lines(table(spark, sf, "documents")).where(F.contains("line", F.lit("=")))
    return lines.select("doc_id", "line_no", has_secret_value(F.col("line")).alias("hidden"), masked(F.col("line")).alias("line"))


def content_type_dim(spark: SparkSession, sf: str) -> DataFrame:
    """Event kinds as content types, through the extension map; unknown types are errors."""
    kind = F.when(F.col("event_type") == "click", "video/mp4; codecs=x").when(F.col("event_type") == "view", "video/webm").when(F.col("event_type") == "signup", "video/quicktime;q=1").otherwise("text/html")
    e = table(spark, sf, "events").select(kind.alias("content_type"), extension_of(kind).alias("extension"))
    return e.groupBy("content_type", F.coalesce("extension", F.lit("error")).alias("extension")).agg(F.count("*").alias("n"))


def ev(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def token_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return events.token_bucket(ev(spark, sf), "user_id", F.col("ts"), capacity=3, refill_per_s=0.00001)


def fixed_window_limit(spark: SparkSession, sf: str) -> DataFrame:
    return events.fixed_window(ev(spark, sf), "user_id", F.col("ts"), window_s=86_400, most=2)


def fixed_window_broken(spark: SparkSession, sf: str) -> DataFrame:
    return events.fixed_window(ev(spark, sf), "user_id", F.col("ts"), window_s=86_400, most=2, restart=False)


def block_list(spark: SparkSession, sf: str) -> DataFrame:
    """Errors shut a user out for five days."""
    return events.block_list(ev(spark, sf), "user_id", F.col("ts"), F.col("event_type") == "error", block_s=432_000)


def retryable_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Errors with a status from 400 on; one in nine has a code instead."""
    status = F.when(F.col("event_id") % 9 != 0, (400 + F.col("event_id") % 110).cast("int"))
    code = F.when(F.col("event_id") % 9 == 0, F.when(F.col("user_id") % 2 == 0, "ETIMEDOUT").otherwise("ENOTFOUND"))
    return ev(spark, sf).where("event_type = 'error'").select("event_id", status.alias("status"), code.alias("code"), retryable(status, code).alias("retryable"))


def service_instances(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as services, suppliers in credit as healthy instances."""
    named = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return events.discovered(named, "n_name", "s_suppkey", F.col("s_acctbal") > 0)


def service_health(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as the checks of their regions, healthy if most of their suppliers hold more than 4500; each fifth is critical."""
    checks = table(spark, sf, "nation").select("n_regionkey", "n_nationkey", (F.col("n_nationkey") % 5 == 0).alias("critical"))
    results = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg((F.count_if(F.col("s_acctbal") > 4500) * 2 > F.count("*")).alias("healthy"))
    return events.health_of(checks, results, "n_regionkey", "n_nationkey")


def api_key_check(spark: SparkSession, sf: str) -> DataFrame:
    """Users as keys of customers: each third customer has none, those in debt have one that ran out."""
    asked = ev(spark, sf).select("event_id", "ts", F.when(F.col("event_id") % 10 != 0, F.col("user_id")).cast("long").alias("key"))
    expires = F.when(F.col("c_acctbal") < 0, F.lit("1970-01-02").cast("timestamp"))
    keys = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("long").alias("key"), expires.alias("expires"))
    return events.key_checked(asked, keys, "key", F.col("ts").cast("timestamp")).select("event_id", "valid", "reason")


def validators(spark: SparkSession, sf: str) -> DataFrame:
    """Words of a document that are e-mail addresses, user names or passwords by form, and a digest of its escaped text. Null text: no words, no digest."""
    words = F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")

    def holding(test) -> F.Column:
        return F.size(F.filter(words, test))

    return table(spark, sf, "documents").select("doc_id", holding(valid_email).alias("emails"), holding(valid_user_name).alias("user_names"), holding(valid_password).alias("passwords"), F.md5(html_escaped(F.col("text"))).alias("escaped_md5"))


def folder_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of pages below each part of their addresses."""
    files = table(spark, sf, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    return pages.folder_sizes(files, "path", "size")


def circuit_breaker(spark: SparkSession, sf: str) -> DataFrame:
    return events.circuit_breaker(ev(spark, sf), "user_id", F.col("ts"), F.col("event_type") == "error", failures=2, open_s=86_400)


def ttl_cache(spark: SparkSession, sf: str) -> DataFrame:
    return events.ttl_cache(ev(spark, sf), "user_id", F.col("ts"), ttl_s=86_400)


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    return events.sessions(ev(spark, sf), "user_id").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("events").alias("longest"))


def error_rate(spark: SparkSession, sf: str) -> DataFrame:
    return events.rates(ev(spark, sf), "user_id", F.col("event_type") == "error")


def log_filter(spark: SparkSession, sf: str) -> DataFrame:
    return events.log_filter(ev(spark, sf), event_type="purchase", value_min=50, props_contains="k", user_id=0).select("event_id", "user_id", "value")


def last_n(spark: SparkSession, sf: str) -> DataFrame:
    return events.last_n(ev(spark, sf), "user_id", 10).select("user_id", "pos", "event_id")


def event_history(spark: SparkSession, sf: str) -> DataFrame:
    return events.last_n(ev(spark, sf), "event_type", 100).select("event_type", "pos", "event_id")


def heartbeat_stale(spark: SparkSession, sf: str) -> DataFrame:
    return events.stale(ev(spark, sf), "user_id").select("user_id", "idle_s", "healthy")


def moving_tier(spark: SparkSession, sf: str) -> DataFrame:
    return events.moving_tier(ev(spark, sf), "user_id").groupBy("tier").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return events.round_robin(ev(spark, sf), "event_type", 4).select("event_id", "worker")


def backoff_delay(spark: SparkSession, sf: str) -> DataFrame:
    attempts = F.pmod(F.col("event_id"), F.lit(12))
    return ev(spark, sf).where("event_type = 'error'").select("event_id", attempts.cast("int").alias("attempt"), events.backoff(attempts).alias("delay_ms"))


def key_version(spark: SparkSession, sf: str) -> DataFrame:
    return events.versions(ev(spark, sf), ["user_id", "event_type"]).select("event_id", "version")


def message_routing(spark: SparkSession, sf: str) -> DataFrame:
    return events.routed(ev(spark, sf)).groupBy("event_type", "route").agg(F.count("*").alias("n"))


def buffer_until_ready(spark: SparkSession, sf: str) -> DataFrame:
    return events.buffered_until(ev(spark, sf), "user_id", F.col("event_type") == "signup")


def presence_last(spark: SparkSession, sf: str) -> DataFrame:
    return events.presence(ev(spark, sf), "user_id", F.col("event_type") == "signup", F.col("event_type") == "error")


def stability_islands(spark: SparkSession, sf: str) -> DataFrame:
    return events.stable_islands(ev(spark, sf), "user_id", "event_type", run=3).select("user_id", F.col("island").cast("bigint").alias("island"), "value", "samples")


def dashboard_stats(spark: SparkSession, sf: str) -> DataFrame:
    return commerce.dashboard(table(spark, sf, "orders"))


def order_page(spark: SparkSession, sf: str) -> DataFrame:
    o = commerce.page_of(table(spark, sf, "orders"), "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey")], 2, 5)
    return o.select("o_custkey", "o_orderkey", "pos", "pages")


def order_total(spark: SparkSession, sf: str) -> DataFrame:
    return commerce.order_totals(table(spark, sf, "lineitem"))


def stock_check(spark: SparkSession, sf: str) -> DataFrame:
    return commerce.stock_check(table(spark, sf, "lineitem"), table(spark, sf, "part"), F.col("p_size") * 30.0)


def product_search(spark: SparkSession, sf: str) -> DataFrame:
    return commerce.search(table(spark, sf, "part"), "a").select("p_partkey", "p_name", "p_brand", "p_retailprice")


def priority_queue(spark: SparkSession, sf: str) -> DataFrame:
    level = 5 - F.substring("o_orderpriority", 1, 1).cast("int")
    o = commerce.priority_queue(table(spark, sf, "orders"), "o_custkey", level, ["o_orderdate", "o_orderkey"], 5)
    return o.select("o_orderkey", "place", "accepted")


def task_attempts(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    fails = F.pmod(F.col("o_orderkey"), F.lit(5)).cast("int")
    return commerce.attempts(o, "o_orderkey", fails, 2, F.pmod(F.col("o_custkey"), F.lit(7)) == 0)


def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return streams.dedup(spark, sf)


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return streams.sessions(spark, sf).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("events").alias("longest"))


def stream_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return streams.bucket(spark, sf)


T = "epoch_us(CAST(ts AS TIMESTAMP)) / 1e6"


def fold_sql(start: str, step: str, result: str, extra: str = "") -> str:
    """A recursive fold over each user's events in order."""
    return f"""WITH RECURSIVE o AS MATERIALIZED (SELECT user_id, {T} AS t, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT DISTINCT user_id, 0 AS k, {start} FROM o UNION ALL SELECT f.user_id, f.k + 1, {step} FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT user_id, {result} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS z FROM f) WHERE z = 1"""


G = "coalesce(floor((floor(o.t) - f.last) * 0.00001), 0)"
H = f"least(3, f.tokens + {G})"
NEW = "(f.b IS NULL OR o.t - f.b > 86400)"
N = f"(CASE WHEN {NEW} THEN 1 ELSE f.n + 1 END)"
W = "(f.state = 'OPEN' AND o.t - f.since < 86400)"
R = f"(CASE WHEN {W} THEN f.r WHEN o.event_type = 'error' THEN f.r + 1 ELSE 0 END)"
TRIP = f"(NOT {W} AND o.event_type = 'error' AND (f.state = 'OPEN' OR {R} >= 2))"
HIT = "coalesce(o.t - f.s <= 86400, false)"


def tag_sql(tag: str) -> str:
    return rf"nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1), '<[^>]*>', ' ', 'g'), '(?i)see more|show less', '', 'g'), '[\s\x{{00A0}}]+', ' ', 'g')), '')"


HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
ROUTE = r"^https?://[^/]+/([a-z]{2})/([0-9]+)/?(?:[?#].*)?$"
CLEAN = r"nullif(trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '(?i)see more|show less', '', 'g'), '[\s\x{00A0}]+', ' ', 'g')), '')"
SECRET = "(NOT starts_with(trim(line), '#') AND contains(line, '=') AND length(trim(substr(line, instr(line, '=') + 1))) > 0)"

SQL = {
    "page_fields": f"""SELECT *, CASE WHEN length(heading) > 1 THEN heading WHEN length(title) > 1 THEN title END AS name FROM (SELECT page_id, url, {tag_sql('title')} AS title, {tag_sql('h1')} AS heading,
 len(regexp_extract_all(coalesce(html, ''), '<a ')) AS n_links, len(regexp_extract_all(coalesce(html, ''), '<p>')) AS n_paragraphs, octet_length(encode(coalesce(html, ''))) AS html_bytes FROM pages)""",
    "page_url_route": f"SELECT page_id, {HOST} AS host, CASE WHEN regexp_matches(url, '{ROUTE}') THEN regexp_extract(url, '{ROUTE}', 1) END AS lang, CASE WHEN regexp_matches(url, '{ROUTE}') THEN regexp_extract(url, '{ROUTE}', 2) END AS number FROM pages",
    "page_clean_truncate": f"SELECT page_id, CASE WHEN length(t) > 2500 THEN left(t, 2500) || '...' ELSE t END AS text, length(t) AS n_chars FROM (SELECT page_id, {CLEAN} AS t FROM pages)",
    "page_upsert_latest": f"SELECT host, page_id, url FROM (SELECT {HOST} AS host, page_id, url, row_number() OVER (PARTITION BY {HOST} ORDER BY page_id DESC) AS k FROM pages) WHERE k = 1",
    "page_store_stats": f"SELECT *, round(html_bytes / 1024.0, 1) AS kept_kb FROM (SELECT {HOST} AS host, count(*) AS pages, CAST(sum(octet_length(encode(html))) AS BIGINT) AS html_bytes, max(octet_length(encode(html))) AS largest FROM pages GROUP BY 1)",
    "page_anti_captured": f"SELECT page_id, {HOST} AS host FROM pages WHERE {HOST} NOT IN (SELECT {HOST} FROM pages WHERE page_id % 2 = 0)",
    "feed_batches": "SELECT doc_id, source, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 25 AS INTEGER) AS batch FROM documents",
    "feed_flagged_semi": "SELECT lang, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS hidden, count(*) AS n FROM documents GROUP BY 1, 2",
    "marker_split": """WITH c AS (SELECT *, text || ' [CTX_START] ' || coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') || ' [CTX_END]' AS m FROM conversations)
SELECT conv_id, turn, trim(split_part(m, '[CTX_START]', 1)) AS query, trim(split_part(split_part(m, '[CTX_START]', 2), '[CTX_END]', 1)) AS context FROM c WHERE role = 'user'""",
    "mask_values": f"""WITH l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))
SELECT doc_id, line_no, {SECRET} AS hidden, CASE WHEN {SECRET} THEN left(line, instr(line, '=') - 1) || '=***' ELSE line END AS line FROM l WHERE contains(line, '=')""",
    "content_type_dim": """SELECT content_type, coalesce(extension, 'error') AS extension, count(*) AS n FROM (SELECT CASE event_type WHEN 'click' THEN 'video/mp4; codecs=x' WHEN 'view' THEN 'video/webm' WHEN 'signup' THEN 'video/quicktime;q=1' ELSE 'text/html' END AS content_type FROM events)
LEFT JOIN (VALUES ('video/mp4', '.mp4'), ('video/webm', '.webm'), ('video/quicktime', '.mov')) v(kind, extension) ON kind = trim(split_part(content_type, ';', 1)) GROUP BY 1, 2""",
    "token_bucket": fold_sql("3.0::DOUBLE AS tokens, NULL::DOUBLE AS last, 0::BIGINT AS allowed, 0::BIGINT AS denied", f"CASE WHEN {H} > 0 THEN {H} - 1 ELSE {H} END, CASE WHEN f.last IS NULL OR {G} > 0 THEN floor(o.t) ELSE f.last END, f.allowed + ({H} > 0)::BIGINT, f.denied + ({H} <= 0)::BIGINT", "allowed, denied"),
    "fixed_window_limit": fold_sql("NULL::DOUBLE AS b, 0::BIGINT AS n, 0::BIGINT AS allowed, 0::BIGINT AS denied", f"CASE WHEN {NEW} THEN o.t ELSE f.b END, {N}, f.allowed + ({N} <= 2)::BIGINT, f.denied + ({N} > 2)::BIGINT", "allowed, denied"),
    "circuit_breaker": fold_sql("'CLOSED' AS state, 0::BIGINT AS r, NULL::DOUBLE AS since, 0::BIGINT AS rejected, 0::BIGINT AS opened", f"CASE WHEN {W} THEN f.state WHEN {TRIP} THEN 'OPEN' ELSE 'CLOSED' END, {R}, CASE WHEN {TRIP} THEN o.t ELSE f.since END, f.rejected + {W}::BIGINT, f.opened + {TRIP}::BIGINT", "state, rejected, opened"),
    "ttl_cache": fold_sql("NULL::DOUBLE AS s, 0::BIGINT AS hits, 0::BIGINT AS misses", f"CASE WHEN {HIT} THEN f.s ELSE o.t END, f.hits + {HIT}::BIGINT, f.misses + (NOT {HIT})::BIGINT", "hits, misses"),
    "sessions": f"""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN {T} - lag({T}) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600 THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id""",
    "error_rate": "SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') * 100.0 / count(*), 4) AS error_rate FROM events GROUP BY user_id",
    "log_filter": "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value >= 50 AND contains(props, 'k')",
    "last_n": "SELECT * FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS pos, event_id FROM events) WHERE pos <= 10",
    "event_history": "SELECT * FROM (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS pos, event_id FROM events) WHERE pos <= 100",
    "heartbeat_stale": f"SELECT user_id, round(m - max({T}), 3) AS idle_s, m - max({T}) <= 86400 AS healthy FROM events, (SELECT max({T}) AS m FROM events) GROUP BY user_id, m",
    "moving_tier": """WITH m AS (SELECT user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS mean FROM events)
SELECT CASE WHEN mean > 60 THEN 'high' WHEN mean > 40 THEN 'medium' WHEN mean > 20 THEN 'low' ELSE 'minimal' END AS tier, count(*) AS n, count(DISTINCT user_id) AS users FROM m GROUP BY 1""",
    "round_robin": "SELECT event_id, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) % 4 AS worker FROM events",
    "backoff_delay": "SELECT event_id, CAST(event_id % 12 AS INTEGER) AS attempt, least(30000.0::DOUBLE, 100.0::DOUBLE * pow(2, event_id % 12)) AS delay_ms FROM events WHERE event_type = 'error'",
    "key_version": "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS version FROM events",
    "message_routing": "SELECT event_type, CASE WHEN event_type = 'signup' THEN 'join' WHEN event_type IN ('click', 'view') THEN 'activity' WHEN event_type = 'purchase' THEN 'commerce' WHEN event_type = 'error' THEN 'alert' ELSE 'warn' END AS route, count(*) AS n FROM events GROUP BY 1, 2",
    "buffer_until_ready": """WITH o AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), r AS (SELECT user_id, min(k) AS f FROM o WHERE event_type = 'signup' GROUP BY user_id)
SELECT event_id, user_id, CASE WHEN f IS NULL THEN 'waiting' WHEN k < f THEN 'buffered' WHEN k = f THEN 'flushed' ELSE 'direct' END AS state FROM o LEFT JOIN r USING (user_id)""",
    "presence_last": "SELECT user_id, event_type = 'signup' AS present, n AS changes FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type IN ('signup', 'error')) WHERE k = 1",
    "stability_islands": """WITH c AS (SELECT user_id, ts, event_id, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT user_id, event_type, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM c)
SELECT user_id, CAST(island AS BIGINT) AS island, min(event_type) AS value, count(*) AS samples FROM i GROUP BY user_id, island HAVING count(*) >= 3""",
    "dashboard_stats": "SELECT o_orderstatus, orders, revenue, round(orders * 100.0 / sum(orders) OVER (), 4) AS share FROM (SELECT o_orderstatus, count(*) AS orders, CAST(round(sum(CAST(o_totalprice AS DECIMAL(20, 2))), 2) AS DOUBLE) AS revenue FROM orders GROUP BY 1)",
    "order_page": "SELECT o_custkey, o_orderkey, pos, pages FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS pos, CAST(ceil(count(*) OVER (PARTITION BY o_custkey) / 5) AS BIGINT) AS pages FROM orders) WHERE pos BETWEEN 6 AND 10",
    "order_total": "SELECT l_orderkey, count(*) AS items, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2))) * (1 + CAST(l_tax AS DECIMAL(4, 2)))), 2) AS DOUBLE) AS total FROM lineitem GROUP BY 1",
    "stock_check": "SELECT p_partkey, wanted, p_size * 30.0::DOUBLE AS stock, p_size * 30.0 >= wanted AS enough, greatest(0.0::DOUBLE, p_size * 30.0::DOUBLE - wanted) AS left_over FROM part JOIN (SELECT l_partkey, sum(l_quantity) AS wanted FROM lineitem GROUP BY 1) ON l_partkey = p_partkey",
    "product_search": "SELECT p_partkey, p_name, p_brand, p_retailprice FROM part WHERE contains(p_name, 'a') OR contains(p_type, 'a')",
    "priority_queue": "SELECT o_orderkey, place, place <= 5 AS accepted FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(left(o_orderpriority, 1) AS INTEGER), o_orderdate, o_orderkey) AS place FROM orders)",
    "task_attempts": "SELECT o_orderkey, CAST(CASE WHEN o_custkey % 7 = 0 THEN 1 ELSE least(o_orderkey % 5, 2) + 1 END AS INTEGER) AS tries, CASE WHEN o_custkey % 7 = 0 THEN 'skipped' WHEN o_orderkey % 5 <= 2 THEN 'done' ELSE 'dead' END AS outcome FROM orders",
    "stream_dedup": "SELECT user_id, event_type, min(ts) AS first_ts FROM events GROUP BY 1, 2",
}
SQL["fixed_window_broken"] = SQL["fixed_window_limit"].replace(f"CASE WHEN {NEW} THEN o.t ELSE f.b END", "coalesce(f.b, o.t)")
WORDS = r"string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+')"
SPACE = r"\s\x0B\p{Z}\x{FEFF}"
SQL |= {
    "block_list": f"""SELECT user_id, count(*) FILTER (NOT block AND NOT shut) AS passed, count(*) FILTER (NOT block AND shut) AS refused
FROM (SELECT user_id, block, coalesce(t < last_value(CASE WHEN block THEN t + 432000 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS shut
 FROM (SELECT user_id, event_id, {T} AS t, coalesce(event_type = 'error', false) AS block FROM events)) GROUP BY user_id""",
    "retryable_errors": """SELECT *, coalesce(status IN (408, 429, 500, 502, 503, 504), false) OR coalesce(code IN ('ECONNRESET', 'ETIMEDOUT'), false) AS retryable
FROM (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN CAST(400 + event_id % 110 AS INTEGER) END AS status, CASE WHEN event_id % 9 = 0 THEN CASE WHEN user_id % 2 = 0 THEN 'ETIMEDOUT' ELSE 'ENOTFOUND' END END AS code FROM events WHERE event_type = 'error')""",
    "service_instances": "SELECT n_name, count(*) AS instances, min(s_suppkey) AS first FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0 GROUP BY n_name",
    "service_health": """SELECT n_regionkey, count(*) AS checks, count(*) FILTER (NOT ok) AS failed, CASE WHEN count(*) FILTER (NOT ok AND n_nationkey % 5 = 0) > 0 THEN 'critical' WHEN count(*) FILTER (NOT ok) > 0 THEN 'degraded' ELSE 'healthy' END AS status
FROM (SELECT n_regionkey, n_nationkey, coalesce(healthy, false) AS ok FROM nation LEFT JOIN (SELECT s_nationkey, count(*) FILTER (s_acctbal > 4500) * 2 > count(*) AS healthy FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey) GROUP BY 1""",
    "api_key_check": """SELECT event_id, reason IS NULL AS valid, reason FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 OR user_id IS NULL THEN 'missing' WHEN c_custkey IS NULL THEN 'invalid' WHEN c_acctbal < 0 AND TIMESTAMP '1970-01-02' < ts THEN 'expired' END AS reason
FROM events LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON c_custkey = user_id AND event_id % 10 <> 0)""",
    "validators": rf"""SELECT doc_id, len(list_filter(w, lambda x: regexp_matches(x, '^[^{SPACE}@]+@[^{SPACE}@]+\.[^{SPACE}@]+\z'))) AS emails, len(list_filter(w, lambda x: regexp_matches(x, '^[a-zA-Z0-9_]{{3,20}}\z'))) AS user_names,
 len(list_filter(w, lambda x: length(x) >= 8 AND regexp_matches(x, '[a-z]') AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[0-9]'))) AS passwords,
 md5(replace(replace(replace(replace(text, '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;')) AS escaped_md5 FROM (SELECT doc_id, text, {WORDS} AS w FROM documents)""",
    "folder_sizes": """SELECT folder, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT CASE WHEN i = 0 THEN '.' ELSE array_to_string(parts[1:i], '/') END AS folder, size
 FROM (SELECT parts, size, unnest(range(0, len(parts))) AS i FROM (SELECT string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS parts, octet_length(encode(coalesce(html, ''))) AS size FROM pages))) GROUP BY folder""",
}
# the streaming twins: the same rows as the batch rules, but that a gap of exactly the limit begins a session
SQL["stream_bucket"] = SQL["token_bucket"]
SQL["stream_sessions"] = SQL["sessions"].replace("> 3600", ">= 3600")
