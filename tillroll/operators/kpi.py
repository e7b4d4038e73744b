"""Headline KPIs (global aggregates, one row each)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import growth_pct, month_start
from tillroll.operators._common import with_scalars
from tillroll.schema import has


def _totals_exprs(sales: DataFrame) -> list:
    rev = (F.coalesce(F.sum("revenue").cast("double"), F.lit(0.0)) if has(sales, "revenue")
           else F.lit(0.0))
    orders = (F.count_distinct("order_id") if has(sales, "order_id") else F.count(F.lit(1)))
    customers = (F.count_distinct("customer_id") if has(sales, "customer_id")
                 else F.lit(0).cast("bigint"))
    return [rev.alias("total_revenue"), orders.cast("bigint").alias("total_orders"),
            customers.cast("bigint").alias("total_customers")]


def totals(sales: DataFrame) -> DataFrame:
    """total_revenue, total_orders, total_customers, average_order_value."""
    t = sales.agg(*_totals_exprs(sales))
    return t.withColumn(
        "average_order_value",
        F.when(F.col("total_orders") > 0, F.col("total_revenue") / F.col("total_orders"))
         .otherwise(F.lit(0.0)))


def last_step_growth(series: DataFrame, value: str, out: str) -> DataFrame:
    """Growth of the last period present over the one before it.

    ``series`` is already aggregated to one row per month (a few hundred rows
    at most), so the unpartitioned ``lag`` runs over a tiny table."""
    prev = series.withColumn("prev", F.lag(value).over(Window.orderBy("month")))
    return prev.agg(
        F.coalesce(F.max_by(growth_pct(value, "prev"), "month"), F.lit(0.0)).alias(out))


def monthly_totals(sales: DataFrame) -> DataFrame:
    return (sales.filter(F.col("date").isNotNull())
                 .groupBy(month_start("date").alias("month"))
                 .agg(F.sum("revenue").alias("revenue")))


def revenue_growth_rate(sales: DataFrame) -> DataFrame:
    """Month-over-month revenue growth %, last month present vs the one before."""
    spark = sales.sparkSession
    if not has(sales, "date", "revenue"):
        return spark.range(1).select(F.lit(0.0).alias("revenue_growth"))
    return last_step_growth(monthly_totals(sales), "revenue", "revenue_growth")


def new_customers_by_month(sales: DataFrame) -> DataFrame:
    first = (sales.filter(F.col("customer_id").isNotNull() & F.col("date").isNotNull())
                  .groupBy("customer_id").agg(F.min("date").alias("first_date")))
    return first.groupBy(month_start("first_date").alias("month")).agg(
        F.count(F.lit(1)).alias("new_customers"))


def customer_growth_rate(sales: DataFrame) -> DataFrame:
    spark = sales.sparkSession
    if not has(sales, "date", "customer_id"):
        return spark.range(1).select(F.lit(0.0).alias("customer_growth"))
    return last_step_growth(new_customers_by_month(sales), "new_customers", "customer_growth")


def kpi_summary(sales: DataFrame) -> DataFrame:
    """All six KPIs on one row."""
    out = with_scalars(totals(sales), revenue_growth_rate(sales))
    return with_scalars(out, customer_growth_rate(sales))
