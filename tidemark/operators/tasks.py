"""Task queue rules as tables: requests to tasks, payload decoding, dispatch to handlers, output names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import extension_of

PAYLOAD = "struct<video_url:string>"
TASK_TYPE = "video:compress"


def enqueue(requests: DataFrame, url: str = "video_url", retries: int = 2, timeout_s: int = 20) -> DataFrame:
    """requests with code (202, or 400 without a url), and for accepted ones type, payload (JSON), max_retry, timeout_s."""
    ok = F.length(F.trim(F.coalesce(F.col(url), F.lit("")))) > 0
    payload = F.to_json(F.struct(F.col(url).alias("video_url")))
    return requests.select("*", F.when(ok, 202).otherwise(400).alias("code"), F.when(ok, TASK_TYPE).alias("type"), F.when(ok, payload).alias("payload"), F.when(ok, retries).alias("max_retry"), F.when(ok, timeout_s).alias("timeout_s"))


def decoded(tasks: DataFrame, payload: str = "payload") -> DataFrame:
    """tasks with video_url and permanent: a payload that does not parse, or has no url, is not tried again."""
    url = F.from_json(payload, PAYLOAD)["video_url"]
    return tasks.withColumn("video_url", url).withColumn("permanent", url.isNull())


def output_name(stem: Column, at: Column, content_type: Column) -> Column:
    """stem-yyyyMMddHHmmss and the type's extension; null for unknown types."""
    return F.concat(stem, F.lit("-"), F.date_format(at, "yyyyMMddHHmmss"), extension_of(content_type))


def dispatch(tasks: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]], kind: str = "type") -> dict[str, DataFrame]:
    """Each handler's result over the tasks of its kind; tasks of other kinds under "unknown"."""
    out = {name: run(tasks.where(F.col(kind) == name)) for name, run in handlers.items()}
    out["unknown"] = tasks.where(~F.coalesce(F.col(kind), F.lit("")).isin(list(handlers) or [""]))
    return out
