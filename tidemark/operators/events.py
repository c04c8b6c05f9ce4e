"""Stateful rules over an event table, keyed so that keys run in parallel.

Rules whose state depends on all events before (limiters, breakers, caches) are ordered folds over a key's events. A
key's events are one task's work: they are reduced to (time, flag) structs first, and the rules that a window function
can express do not fold at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    """Seconds since the epoch; a timestamp without a zone counts in the session's."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def _folded(events: DataFrame, key: str, fields: list[Column], start: Column, step, result) -> DataFrame:
    """One row for each key: result(state) after folding its events in the order of their fields."""
    ordered = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("e"))
    return ordered.select(key, F.aggregate("e", start, step, result).alias("r"))


def token_bucket(events: DataFrame, key: str, ts: Column, event_id: str = "event_id", capacity: int = 10, refill_per_s: float = 0.01) -> DataFrame:
    """(key, allowed, denied): a full bucket at first, whole tokens refilled since the last refill, one spent on each event that finds one."""
    fields = [F.floor(seconds(ts)).cast("long").alias("t"), F.col(event_id).alias("id")]
    state = F.struct(F.lit(capacity).cast("long").alias("tokens"), F.lit(None).cast("long").alias("last"), F.lit(0).cast("long").alias("allowed"), F.lit(0).cast("long").alias("denied"))

    def step(s, e):
        gained = F.coalesce(F.floor((e["t"] - s["last"]) * F.lit(refill_per_s)).cast("long"), F.lit(0).cast("long"))
        have = F.least(F.lit(capacity).cast("long"), s["tokens"] + gained)
        ok = have > 0
        one = F.lit(1).cast("long")
        return F.struct(F.when(ok, have - one).otherwise(have).alias("tokens"), F.when(s["last"].isNull() | (gained > 0), e["t"]).otherwise(s["last"]).alias("last"), F.when(ok, s["allowed"] + one).otherwise(s["allowed"]).alias("allowed"), F.when(ok, s["denied"]).otherwise(s["denied"] + one).alias("denied"))

    return _folded(events, key, fields, state, step, lambda s: s).select(key, "r.allowed", "r.denied")


def fixed_window(events: DataFrame, key: str, ts: Column, event_id: str = "event_id", window_s: int = 86_400, most: int = 3, restart: bool = True) -> DataFrame:
    """(key, allowed, denied): a window begins with a key's first event, and anew with the first event later than window_s after that.

    restart=False is a known faulty variant, for comparison: the count begins anew but the window does not, so every later event counts as the first.
    """
    fields = [seconds(ts).alias("t"), F.col(event_id).alias("id")]
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    state = F.struct(F.lit(None).cast("double").alias("begin"), zero.alias("n"), zero.alias("allowed"), zero.alias("denied"))

    def step(s, e):
        new = s["begin"].isNull() | (e["t"] - s["begin"] > window_s)
        n = F.when(new, one).otherwise(s["n"] + one)
        ok = n <= most
        return F.struct(F.when(new if restart else s["begin"].isNull(), e["t"]).otherwise(s["begin"]).alias("begin"), n.alias("n"), F.when(ok, s["allowed"] + one).otherwise(s["allowed"]).alias("allowed"), F.when(ok, s["denied"]).otherwise(s["denied"] + one).alias("denied"))

    return _folded(events, key, fields, state, step, lambda s: s).select(key, "r.allowed", "r.denied")


def circuit_breaker(events: DataFrame, key: str, ts: Column, failed: Column, event_id: str = "event_id", failures: int = 2, open_s: int = 3_600) -> DataFrame:
    """(key, state, rejected, opened): opens after ``failures`` failures in a row, rejects while open, tries one event after open_s."""
    fields = [seconds(ts).alias("t"), F.col(event_id).alias("id"), failed.alias("bad")]
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    state = F.struct(F.lit("CLOSED").alias("state"), zero.alias("row"), F.lit(None).cast("double").alias("since"), zero.alias("rejected"), zero.alias("opened"))

    def step(s, e):
        waiting = (s["state"] == "OPEN") & (e["t"] - s["since"] < open_s)
        row = F.when(waiting, s["row"]).when(e["bad"], s["row"] + one).otherwise(zero)
        trips = ~waiting & e["bad"] & ((s["state"] == "OPEN") | (row >= failures))
        return F.struct(F.when(waiting, s["state"]).when(trips, F.lit("OPEN")).otherwise(F.lit("CLOSED")).alias("state"), row.alias("row"), F.when(trips, e["t"]).otherwise(s["since"]).alias("since"), F.when(waiting, s["rejected"] + one).otherwise(s["rejected"]).alias("rejected"), F.when(trips, s["opened"] + one).otherwise(s["opened"]).alias("opened"))

    return _folded(events, key, fields, state, step, lambda s: s).select(key, "r.state", "r.rejected", "r.opened")


def ttl_cache(events: DataFrame, key: str, ts: Column, event_id: str = "event_id", ttl_s: int = 86_400) -> DataFrame:
    """(key, hits, misses): a read within ttl_s of the last miss hits; a miss sets the entry."""
    fields = [seconds(ts).alias("t"), F.col(event_id).alias("id")]
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    state = F.struct(F.lit(None).cast("double").alias("set_at"), zero.alias("hits"), zero.alias("misses"))

    def step(s, e):
        hit = F.coalesce(e["t"] - s["set_at"] <= ttl_s, F.lit(False))
        return F.struct(F.when(hit, s["set_at"]).otherwise(e["t"]).alias("set_at"), F.when(hit, s["hits"] + one).otherwise(s["hits"]).alias("hits"), F.when(hit, s["misses"]).otherwise(s["misses"] + one).alias("misses"))

    return _folded(events, key, fields, state, step, lambda s: s).select(key, "r.hits", "r.misses")


def sessions(events: DataFrame, key: str, ts: str = "ts", event_id: str = "event_id", gap_s: int = 3_600) -> DataFrame:
    """(key, session, events, first_ts, last_ts): a gap longer than gap_s begins a session; an equal gap does not."""
    w = Window.partitionBy(key).orderBy(ts, event_id)
    gap = seconds(F.col(ts)) - seconds(F.lag(ts).over(w))
    numbered = events.withColumn("session", F.sum(F.when(gap > gap_s, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.count("*").alias("events"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def last_n(events: DataFrame, key: str, n: int, ts: str = "ts", event_id: str = "event_id") -> DataFrame:
    """The n latest events of each key, with pos from 1."""
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(event_id).desc())
    return events.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)


def log_filter(events: DataFrame, **wanted: object) -> DataFrame:
    """Rows that meet every filter given; a filter that is None, 0 or "" passes all. Suffixes: _min, _contains, else equality."""
    for name, value in wanted.items():
        if not value:
            continue
        if name.endswith("_min"):
            events = events.where(F.col(name[:-4]) >= F.lit(value))
        elif name.endswith("_contains"):
            events = events.where(F.contains(F.col(name[:-9]), F.lit(value)))
        else:
            events = events.where(F.col(name) == F.lit(value))
    return events


def rates(events: DataFrame, by: str, bad: Column) -> DataFrame:
    """(by, total, errors, error_rate in percent)."""
    out = events.groupBy(by).agg(F.count("*").alias("total"), F.count_if(bad).alias("errors"))
    return out.withColumn("error_rate", F.round(F.col("errors") * 100.0 / F.greatest(F.col("total"), F.lit(1)), 4))


def stale(events: DataFrame, key: str, ts: str = "ts", limit_s: int = 86_400) -> DataFrame:
    """(key, last_ts, idle_s, healthy): idle since the key's last event, against the table's latest."""
    last = events.groupBy(key).agg(F.max(ts).alias("last_ts"))
    now = last.agg(F.max("last_ts")).first()[0]  # one value
    idle = seconds(F.lit(now)) - seconds(F.col("last_ts"))
    return last.select(key, "last_ts", F.round(idle, 3).alias("idle_s"), (idle <= limit_s).alias("healthy"))


def moving_tier(events: DataFrame, key: str, value: str = "value", ts: str = "ts", event_id: str = "event_id", rows: int = 10, high: float = 60, medium: float = 40, low: float = 20) -> DataFrame:
    """events with mean (of the last ``rows``) and tier."""
    w = Window.partitionBy(key).orderBy(ts, event_id).rowsBetween(1 - rows, 0)
    mean = F.round(F.avg(value).over(w), 6)
    return events.withColumn("mean", mean).withColumn("tier", F.when(F.col("mean") > high, "high").when(F.col("mean") > medium, "medium").when(F.col("mean") > low, "low").otherwise("minimal"))


def round_robin(events: DataFrame, key: str, workers: int, ts: str = "ts", event_id: str = "event_id") -> DataFrame:
    """events with worker, dealt in turn within each key."""
    w = Window.partitionBy(key).orderBy(ts, event_id)
    return events.withColumn("worker", F.pmod(F.row_number().over(w) - 1, F.lit(workers)))


def backoff(attempt: Column, base: float = 100, factor: float = 2, cap: float = 30_000, jitter: Column | None = None) -> Column:
    """Delay of an attempt (from 0): base * factor**attempt up to cap; jitter in -1 to 1 moves it by a quarter at most."""
    delay = F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(float(factor)), attempt))
    return delay if jitter is None else delay * (1 + 0.25 * jitter)


def versions(events: DataFrame, key: list[str], ts: str = "ts", event_id: str = "event_id") -> DataFrame:
    """events with version: 1 for a key's first event, then counting up."""
    return events.withColumn("version", F.row_number().over(Window.partitionBy(*key).orderBy(ts, event_id)))


def routed(events: DataFrame, kind: str = "event_type") -> DataFrame:
    """events with route: the handler of the event's kind, unknown kinds to "warn"."""
    k = F.col(kind)
    return events.withColumn("route", F.when(k == "signup", "join").when(k.isin("click", "view"), "activity").when(k == "purchase", "commerce").when(k == "error", "alert").otherwise("warn"))


def buffered_until(events: DataFrame, key: str, ready: Column, ts: str = "ts", event_id: str = "event_id") -> DataFrame:
    """(event_id, key, state): "buffered" before the key's first ready event, "flushed" at it, "direct" after; "waiting" if it never is."""
    w = Window.partitionBy(key)
    first = F.min(F.when(ready, F.struct(ts, event_id))).over(w)
    own = F.struct(ts, event_id)
    state = F.when(first.isNull(), "waiting").when(own < first, "buffered").when(own == first, "flushed").otherwise("direct")
    return events.select(event_id, key, state.alias("state"))


def presence(events: DataFrame, key: str, joined: Column, left: Column, ts: str = "ts", event_id: str = "event_id") -> DataFrame:
    """(key, present, changes): whether the last join or leave was a join."""
    moves = events.where(joined | left)
    return moves.groupBy(key).agg(F.max_by(joined, F.struct(ts, event_id)).alias("present"), F.count("*").alias("changes"))


def stable_islands(samples: DataFrame, key: str, value: str, ts: str = "ts", event_id: str = "event_id", run: int = 3) -> DataFrame:
    """(key, island, value, samples): runs of ``run`` equal consecutive samples or more."""
    w = Window.partitionBy(key).orderBy(ts, event_id)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    marked = samples.withColumn("tm_change", change).withColumn("island", F.sum("tm_change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "island").agg(F.first(value).alias("value"), F.count("*").alias("samples")).where(F.col("samples") >= run)


def concurrency(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, peak): most intervals open at once (an end frees before a start at the same time takes)."""
    moves = intervals.select(key, F.col(start).alias("t"), F.lit(1).alias("d")).unionByName(intervals.select(key, F.col(end).alias("t"), F.lit(-1).alias("d")))
    w = Window.partitionBy(key).orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0)
    return moves.withColumn("open", F.sum("d").over(w)).groupBy(key).agg(F.max("open").alias("peak"))


def leases(requests: DataFrame, key: str, owner: str, ts: Column, event_id: str, lease_s: float) -> DataFrame:
    """(key, granted, refused): a lock is granted if free, expired or already the owner's (which renews it)."""
    fields = [seconds(ts).alias("t"), F.col(event_id).alias("id"), F.col(owner).alias("owner")]
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    kind = requests.schema[owner].dataType
    state = F.struct(F.lit(None).cast(kind).alias("holder"), F.lit(None).cast("double").alias("until"), zero.alias("granted"), zero.alias("refused"))

    def step(s, e):
        free = s["until"].isNull() | (e["t"] > s["until"]) | s["holder"].eqNullSafe(e["owner"])
        return F.struct(F.when(free, e["owner"]).otherwise(s["holder"]).alias("holder"), F.when(free, e["t"] + lease_s).otherwise(s["until"]).alias("until"), F.when(free, s["granted"] + one).otherwise(s["granted"]).alias("granted"), F.when(free, s["refused"]).otherwise(s["refused"] + one).alias("refused"))

    return _folded(requests, key, fields, state, step, lambda s: s).select(key, "r.granted", "r.refused")


def rollup_health(checks: DataFrame, healthy: str = "healthy", critical: str = "critical") -> DataFrame:
    """status: critical if a critical check fails, degraded if another does, else healthy; one row."""
    bad = ~F.coalesce(F.col(healthy), F.lit(False))
    status = F.when(F.bool_or(bad & F.col(critical)), "critical").when(F.bool_or(bad), "degraded").otherwise("healthy")
    return checks.agg(status.alias("status"))


def block_list(events: DataFrame, key: str, ts: Column, block: Column, event_id: str = "event_id", block_s: int = 60) -> DataFrame:
    """(key, passed, refused): events where block holds shut their key out for block_s seconds, each anew; the others pass unless shut out. Null block: no block."""
    rows = events.select(F.col(key), seconds(ts).alias("t"), F.col(event_id).alias("id"), F.coalesce(block, F.lit(False)).alias("block"))
    before = Window.partitionBy(key).orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1)
    until = F.last(F.when(F.col("block"), F.col("t") + block_s), ignorenulls=True).over(before)
    marked = rows.withColumn("shut", F.coalesce(F.col("t") < until, F.lit(False)) & ~F.col("block"))
    return marked.groupBy(key).agg(F.count_if(~F.col("shut") & ~F.col("block")).alias("passed"), F.count_if("shut").alias("refused"))


def discovered(instances: DataFrame, service: str, instance: str, healthy: Column) -> DataFrame:
    """(service, instances, first): healthy instances of each service that has any, and the smallest id among them."""
    return instances.where(healthy).groupBy(service).agg(F.count("*").alias("instances"), F.min(instance).alias("first"))


def health_of(checks: DataFrame, results: DataFrame, by: str, check: str) -> DataFrame:
    """(by, checks, failed, status): a check without a healthy result fails; a failed critical check makes its group critical, any other degraded.

    checks has by, check and critical, results has check and healthy, one row a check.
    """
    ok = F.coalesce("healthy", F.lit(False))
    bad = F.count_if(~ok)
    worst = F.count_if(~ok & F.coalesce("critical", F.lit(False)))
    joined = checks.join(results.select(check, "healthy"), check, "left").groupBy(by)
    return joined.agg(F.count("*").alias("checks"), bad.alias("failed"), F.when(worst > 0, "critical").when(bad > 0, "degraded").otherwise("healthy").alias("status"))


def key_checked(requests: DataFrame, keys: DataFrame, key: str, ts: Column, expires: str = "expires") -> DataFrame:
    """requests with valid and reason. keys has key (once each) and expires (null: never); a key is still good at the moment it expires."""
    table = keys.select(key, expires, F.lit(True).alias("tm_known"))
    late = F.coalesce(F.col(expires) < ts, F.lit(False))
    reason = F.when(F.col(key).isNull(), "missing").when(F.col("tm_known").isNull(), "invalid").when(late, "expired")
    return requests.join(table, key, "left").withColumn("reason", reason).withColumn("valid", F.col("reason").isNull()).drop("tm_known", expires)
