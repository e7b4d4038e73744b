"""Distinct counts that roll up: one HLL sketch per day, unions for the rest.

Distinct orders and customers can't be added: a month's count needs all of its
lines again.  ``daily_sketches`` reduces the lines once, combined map-side, to
one row per day with sums and two sketches of a few KB; weeks, months and the
total are unions of days, and days of new lines join an older table.

Counts are exact by default elsewhere; these are estimates with a relative
standard error of 1.04 / sqrt(2^LG_K), 0.8 % here; ``ERROR_BOUND`` is four of
them.  Counts up to a few hundred are exact but for hash collisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions import day, month_start, week_start
from tillroll.operators.timeseries import monthly_revenue
from tillroll.schema import has

LG_K = 14
ERROR_BOUND = 4 * 1.04 / 2 ** (LG_K / 2)
PERIODS = {"day": lambda c: F.col(c), "week": week_start, "month": month_start}


def daily_sketches(sales: DataFrame) -> DataFrame:
    """(day, lines, revenue, orders_hll, customers_hll): lines without a date are
    the row of the NULL day; sketches of missing columns are empty."""
    key = lambda c: F.col(c).cast("string") if has(sales, c) else F.lit(None).cast("string")
    dated = day("date") if has(sales, "date") else F.lit(None).cast("date")
    revenue = F.col("revenue") if has(sales, "revenue") else F.lit(None).cast("double")
    return sales.groupBy(dated.alias("day")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(revenue).alias("revenue"),
        F.hll_sketch_agg(key("order_id"), F.lit(LG_K)).alias("orders_hll"),
        F.hll_sketch_agg(key("customer_id"), F.lit(LG_K)).alias("customers_hll"))


def merge_days(parts: DataFrame) -> DataFrame:
    """Daily sketches of several loads -> one row per day."""
    return parts.groupBy("day").agg(
        F.sum("lines").alias("lines"), F.sum("revenue").alias("revenue"),
        F.hll_union_agg("orders_hll").alias("orders_hll"), F.hll_union_agg("customers_hll").alias("customers_hll"))


def roll_up(days: DataFrame, period: str | None = None) -> DataFrame:
    """(period, lines, revenue, orders, customers) per "day", "week" or "month" of
    the dated lines, or one row over all lines without a period."""
    sums = [F.sum("lines").alias("lines"), F.sum("revenue").cast("double").alias("revenue"),
            F.hll_sketch_estimate(F.hll_union_agg("orders_hll")).alias("orders"),
            F.hll_sketch_estimate(F.hll_union_agg("customers_hll")).alias("customers")]
    if period is None:
        return days.agg(*sums)
    return days.where(F.col("day").isNotNull()).groupBy(PERIODS[period]("day").alias(period)).agg(*sums)


def approximate_months(sales: DataFrame) -> DataFrame:
    """(month, revenue, orders_close, customers_close): monthly revenue from daily
    sketches, and whether the estimates lie within ``ERROR_BOUND`` of the exact
    counts (plus one, for the rounding of small counts)."""
    exact = monthly_revenue(sales).select("month", F.col("orders").alias("_o"), F.col("customers").alias("_c"))
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.col(b) * F.lit(ERROR_BOUND) + 1
    return roll_up(daily_sketches(sales), "month").join(exact, "month").select(
        "month", "revenue", close("orders", "_o").alias("orders_close"), close("customers", "_c").alias("customers_close"))
