"""Page records: fields from stored HTML, routes, cleaning, a keyed store with statistics and export."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import clean_text, truncated


def tag_text(html: Column, tag: str) -> Column:
    """Text of the first element of a tag, inner tags removed; null if there is none."""
    return clean_text(F.regexp_replace(F.regexp_extract(html, f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", " "))


def first_text(*options: Column) -> Column:
    """The first of the options that is longer than one character."""
    return F.coalesce(*[F.when(F.length(x) > 1, x) for x in options])


def page_fields(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, title, heading, name (heading, else title), n_links, n_paragraphs, html_bytes."""
    h = F.coalesce(F.col(html), F.lit(""))
    out = pages.select(key, url, tag_text(h, "title").alias("title"), tag_text(h, "h1").alias("heading"), F.regexp_count(h, F.lit("<a ")).alias("n_links"), F.regexp_count(h, F.lit("<p>")).alias("n_paragraphs"), F.octet_length(h).cast("long").alias("html_bytes"))
    return out.withColumn("name", first_text(F.col("heading"), F.col("title")))


def url_route(url: Column, pattern: str = r"^https?://[^/]+/([a-z]{2})/([0-9]+)/?(?:[?#].*)?$") -> tuple[Column, Column]:
    """The two captures of a route, null where the url is not of it."""
    ok = F.rlike(url, F.lit(pattern))
    return F.when(ok, F.regexp_extract(url, pattern, 1)), F.when(ok, F.regexp_extract(url, pattern, 2))


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1)


def info_kind(text: Column) -> Column:
    """What an information line is about; the first rule that fits."""
    t = F.lower(text)
    return F.when(F.contains(t, F.lit("follower")), "followers").when(F.contains(t, F.lit("employee")), "size").when(F.contains(t, F.lit(",")), "location").otherwise("industry")


def label_value(html: Column, label: str) -> Column:
    """Text of the element after the <dt> that holds a label."""
    return clean_text(F.regexp_replace(F.regexp_extract(html, f"(?is)<dt[^>]*>[^<]*{label}[^<]*</dt>\\s*<dd[^>]*>(.*?)</dd>", 1), "<[^>]*>", " "))


def external_link(html: Column, own_host: Column) -> Column:
    """The first absolute link that leaves the host."""
    links = F.regexp_extract_all(html, F.lit('href="(https?://[^"]+)"'), 1)
    return F.get(F.filter(links, lambda x: ~F.contains(x, own_host)), 0)


def posts(texts: Column, most: int = 3, chars: int = 200) -> Column:
    """Up to ``most`` texts longer than ten characters, shortened."""
    return F.slice(F.transform(F.filter(texts, lambda t: F.length(t) > 10), lambda t: truncated(t, chars)), 1, most)


def upsert_latest(records: DataFrame, key: str, order: str, *ties: str) -> DataFrame:
    """The latest record of each key."""
    latest = Window.partitionBy(key).orderBy(F.col(order).desc(), *[F.col(t).desc() for t in ties])
    return records.withColumn("tm_rank", F.row_number().over(latest)).where("tm_rank = 1").drop("tm_rank")


def new_only(records: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Records whose key is not stored yet."""
    return records.join(stored.select(key).distinct(), key, "left_anti")


def store_stats(records: DataFrame, group: Column, html: str = "html") -> DataFrame:
    """grp, pages, html_bytes, kept_kb (one digit), largest."""
    size = F.octet_length(F.coalesce(F.col(html), F.lit(""))).cast("long")
    out = records.groupBy(group.alias("grp")).agg(F.count("*").alias("pages"), F.sum(size).alias("html_bytes"), F.max(size).alias("largest"))
    return out.withColumn("kept_kb", F.round(F.col("html_bytes") / 1024.0, 1))


def export(records: DataFrame, folder: str, name: str = "pages") -> str:
    """JSON lines below folder, in a folder named with the time; refuses an empty store."""
    if records.isEmpty():
        raise ValueError("nothing to export")
    path = f"{folder}/{name}-{time.strftime('%Y%m%d%H%M%S')}"
    records.write.json(path)
    return path


def clear(store: DataFrame, path: str) -> None:
    """Overwrite a stored table with no rows."""
    store.limit(0).write.mode("overwrite").parquet(path)


def folder_sizes(files: DataFrame, path: str, size: str) -> DataFrame:
    """(folder, files, bytes): everything below a folder, at any depth; the root is ".". Sums combine before the shuffle, so the root is no hot key."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, ".").otherwise(F.array_join(F.slice(parts, 1, i), "/")))
    rows = files.where(F.col(path).isNotNull()).select(F.explode(above).alias("folder"), F.col(size).alias("tm_size"))
    return rows.groupBy("folder").agg(F.count("*").alias("files"), F.coalesce(F.sum("tm_size"), F.lit(0)).alias("bytes"))
