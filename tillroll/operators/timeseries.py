"""Revenue time series: daily / weekly / monthly buckets and seasonality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import day, month_start, pct_change, ratio, week_end_label, week_start
from tillroll.schema import empty, has


def _dated(sales: DataFrame) -> DataFrame:
    return sales.filter(F.col("date").isNotNull())


def daily_revenue(sales: DataFrame) -> DataFrame:
    if not has(sales, "date", "revenue"):
        return empty(sales.sparkSession, "date date, revenue double")
    return (_dated(sales).groupBy(day("date").alias("date"))
            .agg(F.sum("revenue").cast("double").alias("revenue")).orderBy("date"))


def weekly_revenue(sales: DataFrame) -> DataFrame:
    """Weeks labelled by their Monday."""
    if not has(sales, "date", "revenue"):
        return empty(sales.sparkSession, "week date, revenue double")
    return (_dated(sales).groupBy(week_start("date").alias("week"))
            .agg(F.sum("revenue").cast("double").alias("revenue")).orderBy("week"))


def monthly_revenue(sales: DataFrame) -> DataFrame:
    """Revenue, distinct orders and distinct customers per calendar month.

    Orders / customers columns appear only when their source column exists."""
    if not has(sales, "date", "revenue"):
        return empty(sales.sparkSession, "month date, revenue double")
    aggs = [F.sum("revenue").cast("double").alias("revenue")]
    if has(sales, "order_id"):
        aggs.append(F.count_distinct("order_id").cast("bigint").alias("orders"))
    if has(sales, "customer_id"):
        aggs.append(F.count_distinct("customer_id").cast("bigint").alias("customers"))
    return _dated(sales).groupBy(month_start("date").alias("month")).agg(*aggs).orderBy("month")


def monthly_growth(sales: DataFrame) -> DataFrame:
    """Monthly revenue plus month-over-month change in % (NULL for the first
    month).  The window runs over the aggregated months only."""
    m = monthly_revenue(sales)
    if "revenue" not in m.columns or not has(sales, "date", "revenue"):
        return empty(sales.sparkSession, "month date, revenue double, mom_growth double")
    prev = F.lag("revenue").over(Window.orderBy("month"))
    return m.withColumn("mom_growth", pct_change(F.col("revenue"), prev)).orderBy("month")


def revenue_series(sales: DataFrame, granularity: str = "monthly") -> DataFrame:
    """Granularity switch: 'daily' | 'weekly' | 'monthly' -> (period, revenue)."""
    g = granularity.lower()
    if g == "daily":
        return daily_revenue(sales).withColumnRenamed("date", "period")
    if g == "weekly":
        return weekly_revenue(sales).withColumnRenamed("week", "period")
    if g == "monthly":
        return monthly_revenue(sales).select(F.col("month").alias("period"), "revenue")
    raise ValueError(f"granularity must be daily, weekly or monthly, not {granularity!r}")


def time_series(sales: DataFrame, freq: str = "D") -> DataFrame:
    """Positive-revenue series for forecasting.

    ``D``: calendar days.  ``W``: Monday-to-Sunday weeks labelled by the
    closing Sunday.  ``M``: calendar months labelled by their last day.
    Periods whose sum is <= 0 are dropped; gaps stay gaps."""
    keys = {"D": day, "W": week_end_label, "M": F.last_day}
    if freq.upper() not in keys:
        raise ValueError(f"freq must be D, W or M, not {freq!r}")
    if not has(sales, "date", "revenue"):
        return empty(sales.sparkSession, "date date, revenue double")
    key = keys[freq.upper()]("date")
    return (_dated(sales).groupBy(key.alias("date"))
            .agg(F.sum("revenue").alias("revenue"))
            .filter(F.col("revenue") > 0)
            .select("date", F.col("revenue").cast("double").alias("revenue"))
            .orderBy("date"))


def seasonality_stats(sales: DataFrame, min_months: int = 3, cv_months: int = 6,
                      cv_threshold: float = 0.3) -> DataFrame:
    """Best / worst month, mean MoM growth and the coefficient of variation.

    Empty when fewer than ``min_months`` months exist; the CV columns are
    NULL below ``cv_months`` months.  Ties pick the earliest month."""
    schema = ("months bigint, best_month date, best_revenue double, worst_month date, "
              "worst_revenue double, avg_mom_growth double, cv double, high_seasonality boolean")
    if not has(sales, "date", "revenue"):
        return empty(sales.sparkSession, schema)
    g = monthly_growth(sales)
    order_key = -F.unix_date("month")
    stats = g.agg(
        F.count(F.lit(1)).alias("months"),
        F.max_by("month", F.struct(F.col("revenue"), order_key)).alias("best_month"),
        F.max("revenue").alias("best_revenue"),
        F.min_by("month", F.struct(F.col("revenue"), F.unix_date("month"))).alias("worst_month"),
        F.min("revenue").alias("worst_revenue"),
        F.avg("mom_growth").alias("avg_mom_growth"),
        ratio(F.stddev_samp("revenue"), F.avg("revenue")).alias("cv"))
    cv_ok = F.col("months") >= cv_months
    return (stats.filter(F.col("months") >= min_months)
                 .withColumn("cv", F.when(cv_ok, F.col("cv")))
                 .withColumn("high_seasonality", F.when(cv_ok, F.col("cv") > cv_threshold))
                 .select("months", "best_month", "best_revenue", "worst_month", "worst_revenue",
                         "avg_mom_growth", "cv", "high_seasonality"))
