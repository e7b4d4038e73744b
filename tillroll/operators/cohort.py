"""Acquisition cohorts and retention.

Cohort assignment needs each customer's first month.  Instead of a window
over all lines of a customer (one task per hot customer) the lines are first
reduced to the set of months each customer bought in - bounded by the
calendar, not by the number of lines - with map-side de-duplication.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import month_diff, month_start
from tillroll.operators._common import band, reuse, with_scalars
from tillroll.schema import empty, has

# Month-1 retention bands.
M1_BANDS = [(30.0, "strong"), (15.0, "moderate")]


def cohort_counts(sales: DataFrame) -> DataFrame:
    """(cohort_month, period, customers): distinct customers active ``period``
    months after their first purchase month."""
    if not has(sales, "date", "customer_id"):
        return empty(sales.sparkSession, "cohort_month date, period int, customers bigint")
    months = (sales.filter(F.col("customer_id").isNotNull() & F.col("date").isNotNull())
                   .groupBy("customer_id")
                   .agg(F.collect_set(month_start("date")).alias("months")))
    active = months.select(F.array_min("months").alias("cohort_month"),
                           F.explode("months").alias("month"))
    cells = (active.groupBy("cohort_month", month_diff("month", "cohort_month").alias("period"))
                   .agg(F.count(F.lit(1)).alias("customers")))
    return reuse(cells).orderBy("cohort_month", "period")


def cohort_retention(sales: DataFrame) -> DataFrame:
    """Long-form retention matrix: customers in the cell / cohort size * 100.
    Cells without any active customer are absent (NULL in a pivot)."""
    c = cohort_counts(sales)
    if not has(sales, "date", "customer_id"):
        return empty(sales.sparkSession, "cohort_month date, period int, customers bigint, "
                                         "cohort_size bigint, retention_pct double")
    size = F.max(F.when(F.col("period") == 0, F.col("customers"))).over(
        Window.partitionBy("cohort_month"))
    return (c.withColumn("cohort_size", size)
             .withColumn("retention_pct",
                         F.col("customers") / F.col("cohort_size") * F.lit(100.0)))


def retention_matrix(sales: DataFrame) -> DataFrame:
    """Wide view of the retention matrix: per cohort an array with one place per
    period from 0 to the last period of any cohort (NULL where absent)."""
    r = cohort_retention(sales)
    last = r.agg(F.max("period").alias("_last"))
    cells = r.groupBy("cohort_month").agg(
        F.map_from_entries(F.collect_list(F.struct("period", "retention_pct"))).alias("_cells"))
    every = F.transform(F.sequence(F.lit(0), F.col("_last")), lambda p: F.try_element_at("_cells", p))
    return (with_scalars(cells, last).select("cohort_month", every.alias("retention_pct"))
            .orderBy("cohort_month"))


def cohort_display(sales: DataFrame, cohorts: int | None = None, periods: int | None = None) -> DataFrame:
    """The retention cells; with ``cohorts`` / ``periods`` only those of the last
    cohorts / of the first periods present anywhere in the matrix."""
    r = cohort_retention(sales)
    if cohorts is None and periods is None:
        return r.select("cohort_month", "period", "retention_pct").orderBy("cohort_month", "period")
    cohort_rank = F.dense_rank().over(Window.orderBy(F.col("cohort_month").desc()))
    period_rank = F.dense_rank().over(Window.orderBy("period"))
    # Both windows run over the aggregated matrix (cohorts x periods cells).
    return (r.withColumn("_cr", cohort_rank).withColumn("_pr", period_rank)
             .filter((F.col("_cr") <= (cohorts or 2 ** 31 - 1)) & (F.col("_pr") <= (periods or 2 ** 31 - 1)))
             .select("cohort_month", "period", "retention_pct")
             .orderBy("cohort_month", "period"))


def retention_curve(sales: DataFrame, cohorts: int | None = None, periods: int | None = None) -> DataFrame:
    """Mean retention per period over all cohorts, or those of ``cohort_display``
    (absent cells skipped)."""
    d = cohort_display(sales, cohorts, periods)
    return (d.groupBy("period").agg(F.avg("retention_pct").alias("retention_pct"),
                                    F.count(F.lit(1)).alias("cohorts"))
             .orderBy("period"))


def cohort_sizes(sales: DataFrame, last: int | None = None) -> DataFrame:
    """New customers per cohort (of the last ``last`` cohorts)."""
    c = cohort_counts(sales).filter(F.col("period") == 0)
    if last is not None:
        c = c.orderBy(F.col("cohort_month").desc()).limit(last)
    return (c.select("cohort_month", F.col("customers").alias("new_customers"))
             .orderBy("cohort_month"))


def cohort_summary(sales: DataFrame, cohorts: int | None = None, periods: int | None = None) -> DataFrame:
    """One row: mean cohort size (truncated), best acquisition month (first
    of ties), mean retention at months 1/3/6 (over ``cohort_display``), the
    month-1 band and the best / worst month-1 cohorts (earliest of ties)."""
    c = cohort_counts(sales).filter(F.col("period") == 0)
    sizes = c.agg(F.avg("customers").cast("bigint").alias("avg_cohort_size"),
                  F.max_by("cohort_month", F.struct(F.col("customers"),
                                                    -F.unix_date("cohort_month")))
                   .alias("best_acquisition_month"))
    d = cohort_display(sales, cohorts, periods)
    m1 = F.when(F.col("period") == 1, F.col("retention_pct"))
    ret = d.agg(
        F.avg(m1).alias("m1_retention"),
        F.avg(F.when(F.col("period") == 3, F.col("retention_pct"))).alias("m3_retention"),
        F.avg(F.when(F.col("period") == 6, F.col("retention_pct"))).alias("m6_retention"),
        F.max_by(F.when(F.col("period") == 1, F.col("cohort_month")),
                 F.when(F.col("period") == 1,
                        F.struct(F.col("retention_pct"), -F.unix_date("cohort_month"))))
         .alias("best_m1_cohort"),
        F.max(m1).alias("best_m1_retention"),
        F.min_by(F.when(F.col("period") == 1, F.col("cohort_month")),
                 F.when(F.col("period") == 1,
                        F.struct(F.col("retention_pct"), F.unix_date("cohort_month"))))
         .alias("worst_m1_cohort"),
        F.min(m1).alias("worst_m1_retention"))
    out = sizes.join(F.broadcast(ret), how="inner")
    level = F.when(F.col("m1_retention").isNotNull(),
                   band(F.col("m1_retention"), M1_BANDS, "low", strict=False))
    return out.withColumn("m1_level", level)
