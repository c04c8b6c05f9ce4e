"""Orders, stock and queues on relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dashboard(orders: DataFrame, by: str = "o_orderstatus", amount: str = "o_totalprice") -> DataFrame:
    """(by, orders, revenue, share of orders in percent)."""
    out = orders.groupBy(by).agg(F.count("*").alias("orders"), F.round(F.sum(F.col(amount).cast("decimal(20,2)")), 2).cast("double").alias("revenue"))
    whole = F.sum("orders").over(Window.partitionBy())  # over the groups, a handful of rows
    return out.withColumn("share", F.round(F.col("orders") * 100.0 / whole, 4))


def page_of(rows: DataFrame, by: str, order: list[Column], page: int, per_page: int) -> DataFrame:
    """Rows of one page of each group, with pos and pages (the group's number of pages)."""
    w = Window.partitionBy(by)
    out = rows.withColumn("pos", F.row_number().over(w.orderBy(*order))).withColumn("pages", F.ceil(F.count("*").over(w) / per_page))
    return out.where(F.col("pos").between((page - 1) * per_page + 1, page * per_page))


def order_totals(items: DataFrame, order: str = "l_orderkey") -> DataFrame:
    """(order, items, total): quantity times price after discount and tax, in cents' precision."""
    price = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)")) * (1 + F.col("l_tax").cast("decimal(4,2)"))
    return items.groupBy(order).agg(F.count("*").alias("items"), F.round(F.sum(price), 2).cast("double").alias("total"))


def stock_check(items: DataFrame, parts: DataFrame, stock: Column) -> DataFrame:
    """(p_partkey, wanted, stock, enough, left_over): demand of all items against a stock expression over parts."""
    demand = items.groupBy("l_partkey").agg(F.sum("l_quantity").alias("wanted"))
    joined = parts.select("p_partkey", stock.alias("stock")).join(demand, F.col("p_partkey") == F.col("l_partkey"))
    return joined.select("p_partkey", "wanted", "stock", (F.col("stock") >= F.col("wanted")).alias("enough"), F.greatest(F.lit(0.0), F.col("stock") - F.col("wanted")).alias("left_over"))


def search(parts: DataFrame, text: str | None = None, kind: str | None = None) -> DataFrame:
    """Parts whose name or type holds text (case-sensitive), of one brand if given."""
    out = parts
    if text:
        out = out.where(F.contains("p_name", F.lit(text)) | F.contains("p_type", F.lit(text)))
    return out.where(F.col("p_brand") == F.lit(kind)) if kind else out


def priority_queue(tasks: DataFrame, queue: str, priority: Column, seq: list[str], size: int) -> DataFrame:
    """tasks with place (by priority, then arrival) and accepted; what does not fit goes to the dead letters."""
    w = Window.partitionBy(queue).orderBy(priority.desc(), *seq)
    return tasks.withColumn("place", F.row_number().over(w)).withColumn("accepted", F.col("place") <= size)


def attempts(tasks: DataFrame, key: str, fails: Column, retries: int = 2, permanent: Column | None = None) -> DataFrame:
    """(key, tries, outcome): fails is how often a task fails before it would succeed; permanent failures are not tried again."""
    never = permanent if permanent is not None else F.lit(False)
    outcome = F.when(never, "skipped").when(fails <= retries, "done").otherwise("dead")
    return tasks.select(key, F.when(never, 1).otherwise(F.least(fails, F.lit(retries)) + 1).alias("tries"), outcome.alias("outcome"))


def weighted_order(tasks: DataFrame, key: str, queue: str, weights: dict[str, int], seed: int = 7) -> DataFrame:
    """tasks with turn: a seeded exponential draw over the queue's weight, so heavier queues come earlier in proportion."""
    weight = F.try_element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col(queue))
    draw = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1))
    return tasks.withColumn("turn", -F.log(draw) / F.coalesce(weight, F.lit(1)))


def pipeline_status(tasks: DataFrame, extension: Column, downloaded: Column, converted: Column) -> DataFrame:
    """tasks with status: the first step that fails names it."""
    return tasks.withColumn("status", F.when(extension.isNull(), "unsupported type").when(~downloaded, "download failed").when(~converted, "conversion failed").otherwise("done"))


def weighted_pick(rows: DataFrame, by: str, weight: str, order: str, point: Column) -> DataFrame:
    """One row of each group: the first whose cumulative weight passes point (0 to 1) times the group's total."""
    w = Window.partitionBy(by).orderBy(order)
    run = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(weight).over(Window.partitionBy(by))
    marked = rows.withColumn("tm_run", run).withColumn("tm_total", total).where(F.col("tm_run") > point * F.col("tm_total"))
    return marked.withColumn("tm_first", F.row_number().over(w)).where("tm_first = 1").drop("tm_run", "tm_total", "tm_first")
