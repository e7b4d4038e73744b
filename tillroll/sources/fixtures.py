"""Canonical sales views over the driver's parquet tables.

``sales``: one row per order line, joined out to product, category and the
customer's nation.  Revenue stays DECIMAL(18,4) so that sums are exact and do
not depend on task order (oracle comparison hashes values).

``purchases``: purchase events (intraday timestamps, no product/category/
region/quantity) - the fixture for day-floor arithmetic and the
missing-column guards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def line_revenue(price: str = "l_extendedprice", discount: str = "l_discount"):
    # DECIMAL(12,2) * (1 - DECIMAL(4,2)) -> DECIMAL(18,4), exact.
    return F.col(price).cast("decimal(12,2)") * (F.lit(1) - F.col(discount).cast("decimal(4,2)"))


LINES_A_TASK = 1_000_000      # about 0.3 GB in a task that joins, sorts and groups them


def line_tasks(lines: DataFrame) -> int | None:
    """Tasks for the joins of all order lines, so that a task's share does not
    grow with them; None where the session's own number is enough.  Rows are
    counted in the files' footers."""
    tasks = -(-lines.count() // LINES_A_TASK)
    return tasks if tasks > lines.sparkSession.sparkContext.defaultParallelism else None


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = line_tasks(table(spark, sf_dir, "lineitem"))
    spread = lambda df, key: df.repartition(tasks, key) if tasks else df
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), "l_partkey",
        line_revenue().alias("revenue"), F.col("l_quantity").cast("int").alias("quantity"))
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderdate").alias("date"), F.col("o_custkey").alias("customer_id"))
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("product"), F.col("p_type").alias("category"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # nation is a fixed 25-row dimension: broadcasting it is bounded by definition.
    nation = F.broadcast(table(spark, sf_dir, "nation").select(
        "n_nationkey", F.col("n_name").alias("region")))
    cust_region = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        "c_custkey", "region")
    # Join order for scale (no cost-based reordering is assumed): the region
    # travels with the orders, so only two lineitem-sized shuffles remain
    # (by order key, then by part key); AQE turns either into a broadcast
    # join when its other side is measured small, and splits hot keys.
    orders_region = orders.join(cust_region, orders.customer_id == cust_region.c_custkey)
    li, orders_region, part = spread(li, "order_id"), spread(orders_region, "o_orderkey"), spread(part, "p_partkey")
    out = (li.join(orders_region, li.order_id == orders_region.o_orderkey)
             .join(part, li.l_partkey == part.p_partkey))
    return out.select("date", "revenue", "quantity", "customer_id", "product", "category",
                      "region", "order_id")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return (ev.filter(F.col("event_type") == "purchase")
              .select(F.col("ts").alias("date"),
                      F.col("value").cast("decimal(12,2)").alias("revenue"),
                      F.col("user_id").alias("customer_id"),
                      F.col("event_id").alias("order_id")))


# The same two views as DuckDB SQL, used verbatim as CTEs by the oracles.
SALES_SQL = """
SELECT o_orderdate AS date,
       CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS revenue,
       CAST(l_quantity AS INT) AS quantity, o_custkey AS customer_id, p_name AS product,
       p_type AS category, n_name AS region, l_orderkey AS order_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""

PURCHASES_SQL = """
SELECT ts AS date, CAST(value AS DECIMAL(12,2)) AS revenue, user_id AS customer_id,
       event_id AS order_id
FROM events WHERE event_type = 'purchase'
"""
