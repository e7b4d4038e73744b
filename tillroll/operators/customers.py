"""Per-customer aggregates shared by RFM, churn features and LTV.

One ``groupBy(customer_id)`` computes everything the three families need;
the dataset's reference date is a one-row global aggregate attached by a
broadcast of that single row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions import elapsed_days, ratio, round_even
from tillroll.operators._common import non_null, reuse, with_scalars
from tillroll.schema import empty, has


def customer_groups(sales: DataFrame) -> DataFrame:
    """One aggregation of the raw lines per customer_id, the NULL customer
    included (it still counts for the dataset's latest date); persisted,
    since every customer operator reads it more than once."""
    # lines without revenue count as neither orders' lines nor in their mean
    aggs = [F.sum("revenue").alias("revenue_sum"), F.count("revenue").alias("lines")]
    if has(sales, "order_id"):
        aggs.append(F.count_distinct("order_id").alias("orders"))
    if has(sales, "date"):
        aggs += [F.min("date").alias("first_date"), F.max("date").alias("last_date")]
    g = sales.groupBy("customer_id").agg(*aggs)
    if not has(sales, "order_id"):
        g = g.withColumn("orders", F.col("lines"))
    return reuse(g.withColumn(
        "avg_line_revenue", ratio("revenue_sum", "lines")))


def customer_base(sales: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """customer_id, revenue_sum (exact), lines, orders (distinct order_id, or
    lines without one), avg_line_revenue, first_date, last_date."""
    g = customer_groups(sales) if groups is None else groups
    return non_null(g, "customer_id")


def reference_date(sales: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One row: the latest timestamp in the data (from the per-customer
    aggregate when given, so the raw lines are not scanned again)."""
    if groups is not None:
        return groups.agg(F.max("last_date").alias("ref_date"))
    return sales.agg(F.max("date").alias("ref_date"))


def _with_reference(sales: DataFrame) -> DataFrame:
    g = customer_groups(sales)
    return with_scalars(customer_base(sales, g), reference_date(sales, g))


def rfm(sales: DataFrame) -> DataFrame:
    """Recency (whole days from the customer's last purchase to one day after
    the dataset's last one), frequency (distinct orders) and monetary."""
    if not has(sales, "date", "customer_id", "revenue"):
        return empty(sales.sparkSession,
                     "customer_id string, recency bigint, frequency bigint, monetary double")
    b = _with_reference(sales)
    ref = F.col("ref_date") + F.expr("INTERVAL 1 DAY")
    return b.select("customer_id",
                    elapsed_days("last_date", ref).cast("bigint").alias("recency"),
                    F.col("orders").cast("bigint").alias("frequency"),
                    F.col("revenue_sum").cast("double").alias("monetary"))


def rfm_averages(sales: DataFrame) -> DataFrame:
    r = rfm(sales)
    return r.agg(F.avg("recency").alias("avg_recency"), F.avg("frequency").alias("avg_frequency"),
                 F.avg("monetary").alias("avg_monetary"), F.count(F.lit(1)).alias("customers"))


def customer_features(sales: DataFrame) -> DataFrame:
    """Churn features per customer (reference date = the dataset's last date)."""
    schema = ("customer_id string, total_revenue double, avg_order_value double, "
              "total_orders bigint, days_since_last_order bigint, customer_age_days bigint, "
              "order_frequency double")
    if not has(sales, "date", "customer_id", "revenue"):
        return empty(sales.sparkSession, schema)
    b = _with_reference(sales)
    age = F.greatest(elapsed_days("first_date", "ref_date"), F.lit(1))
    return b.select(
        "customer_id",
        F.col("revenue_sum").cast("double").alias("total_revenue"),
        F.col("avg_line_revenue").alias("avg_order_value"),
        F.col("orders").cast("bigint").alias("total_orders"),
        elapsed_days("last_date", "ref_date").cast("bigint").alias("days_since_last_order"),
        age.cast("bigint").alias("customer_age_days"),
        round_even(F.col("orders") / age * F.lit(30.0), 4).alias("order_frequency"))
