"""Customer lifetime value: history, projection, percentile segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions import elapsed_days, round_even, share_pct
from tillroll.operators._common import reuse, with_scalars
from tillroll.operators.customers import customer_base, customer_groups, reference_date
from tillroll.operators.stats import quantiles
from tillroll.schema import empty, has

# Fixed values of the LTV model.
CHURN_THRESHOLD_DAYS = 90.0
DAYS_PER_MONTH = 30.44
NO_DATE_AGE_MONTHS = 6.0
NO_DATE_RECENCY_DAYS = 30
SEGMENTS = [(0.90, "Platinum"), (0.70, "Gold"), (0.40, "Silver")]
BOTTOM_SEGMENT = "Bronze"

LTV_SCHEMA = ("customer_id string, historical_ltv double, avg_order_value double, "
              "total_transactions bigint, total_orders bigint, customer_age_days bigint, "
              "recency_days bigint, customer_age_months double, order_rate double, "
              "churn_probability double, expected_active_months double, "
              "predicted_future_ltv double, total_ltv double, untapped_value double")


def customer_ltv_raw(sales: DataFrame, months: int = 12) -> DataFrame:
    """Per-customer LTV without the segment column."""
    if not has(sales, "customer_id", "revenue"):
        return empty(sales.sparkSession, LTV_SCHEMA)
    groups = customer_groups(sales)
    b = customer_base(sales, groups)
    if has(sales, "date"):
        b = with_scalars(b, reference_date(sales, groups))
        age_days = F.greatest(elapsed_days("first_date", "ref_date"), F.lit(1))
        recency = elapsed_days("last_date", "ref_date")
        age_months = age_days / F.lit(DAYS_PER_MONTH)
        rate = F.col("total_orders") / F.greatest(F.col("customer_age_months"), F.lit(1.0))
    else:
        age_days = F.lit(None).cast("bigint")
        recency = F.lit(NO_DATE_RECENCY_DAYS).cast("bigint")
        age_months = F.lit(NO_DATE_AGE_MONTHS)
        rate = F.col("total_orders") / F.lit(NO_DATE_AGE_MONTHS)
    churn = F.least(F.greatest(F.col("recency_days") / F.lit(CHURN_THRESHOLD_DAYS), F.lit(0.0)),
                    F.lit(1.0))
    out = (b.select("customer_id",
                    F.col("revenue_sum").cast("double").alias("historical_ltv"),
                    F.col("avg_line_revenue").alias("avg_order_value"),
                    F.col("lines").cast("bigint").alias("total_transactions"),
                    F.col("orders").cast("bigint").alias("total_orders"),
                    age_days.cast("bigint").alias("customer_age_days"),
                    recency.cast("bigint").alias("recency_days"),
                    age_months.cast("double").alias("customer_age_months"))
             .withColumn("order_rate", rate.cast("double"))
             .withColumn("churn_probability", churn)
             .withColumn("expected_active_months", F.lit(float(months)) *
                         (F.lit(1.0) - F.col("churn_probability")))
             .withColumn("predicted_future_ltv", F.greatest(
                 F.col("avg_order_value") * F.col("order_rate") * F.col("expected_active_months"),
                 F.lit(0.0)))
             .withColumn("total_ltv", F.col("historical_ltv") + F.col("predicted_future_ltv"))
             .withColumn("untapped_value", F.col("predicted_future_ltv")))
    return reuse(out)   # read by the quantile passes and the segment assignment


def ltv_thresholds(ltv: DataFrame) -> DataFrame:
    """One row: the 40th, 70th and 90th percentiles of total_ltv (linear)."""
    return quantiles(ltv, "total_ltv", {"p40": 0.40, "p70": 0.70, "p90": 0.90})


def customer_ltv(sales: DataFrame, months: int = 12) -> DataFrame:
    raw = customer_ltv_raw(sales, months)
    if "customer_id" not in raw.columns or not has(sales, "customer_id", "revenue"):
        return raw.withColumn("ltv_segment", F.lit(None).cast("string"))
    t = ltv_thresholds(raw)
    v = F.col("total_ltv")
    seg = (F.when(v >= F.col("p90"), SEGMENTS[0][1]).when(v >= F.col("p70"), SEGMENTS[1][1])
            .when(v >= F.col("p40"), SEGMENTS[2][1]).otherwise(BOTTOM_SEGMENT))
    return with_scalars(raw, t).withColumn("ltv_segment", seg).drop("p40", "p70", "p90")


def ltv_overview(ltv: DataFrame) -> DataFrame:
    q = quantiles(ltv, "total_ltv", {"median_ltv": 0.5, "p90_ltv": 0.9})
    s = ltv.agg(F.avg("total_ltv").alias("avg_ltv"),
                F.sum("predicted_future_ltv").alias("total_predicted"),
                F.avg("untapped_value").alias("avg_untapped"))
    return with_scalars(s, q)


def ltv_histogram(ltv: DataFrame, bins: int = 50) -> DataFrame:
    """Fixed-width bins between the minimum and maximum total LTV."""
    mm = ltv.agg(F.min("total_ltv").alias("_lo"), F.max("total_ltv").alias("_hi"))
    x = with_scalars(ltv.select("total_ltv"), mm)
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("total_ltv") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
                        * F.lit(float(bins))), F.lit(bins - 1))).cast("int")
    return (x.groupBy(b.alias("bin"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("customers"))
             .select("bin", (F.col("_lo") + F.col("bin") * width).alias("bin_start"),
                     (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_end"), "customers")
             .orderBy("bin"))


def ltv_segment_breakdown(ltv: DataFrame) -> DataFrame:
    g = ltv.groupBy(F.col("ltv_segment").alias("segment")).agg(
        F.count(F.lit(1)).alias("customers"), F.sum("total_ltv").alias("total_ltv"))
    tot = g.agg(F.sum("total_ltv").alias("_all"))
    return (with_scalars(g, tot)
            .withColumn("pct_of_ltv", round_even(share_pct("total_ltv", "_all"), 1))
            .drop("_all"))


def ltv_segment_table(ltv: DataFrame) -> DataFrame:
    return ltv.groupBy(F.col("ltv_segment").alias("segment")).agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg("historical_ltv").alias("avg_historical_ltv"),
        F.avg("predicted_future_ltv").alias("avg_predicted_ltv"),
        F.avg("total_ltv").alias("avg_total_ltv"),
        F.avg("total_orders").alias("avg_orders"),
        F.avg("avg_order_value").alias("avg_aov"),
        F.avg("recency_days").alias("avg_recency"))


def top_ltv_customers(ltv: DataFrame, n: int = 20) -> DataFrame:
    return (ltv.orderBy(F.col("total_ltv").desc(), F.col("customer_id")).limit(n)
               .select("customer_id", "ltv_segment", "historical_ltv", "predicted_future_ltv",
                       "total_ltv", "total_orders", "avg_order_value", "recency_days"))


def ltv_insights(ltv: DataFrame) -> DataFrame:
    top = SEGMENTS[0][1]
    high = [SEGMENTS[0][1], SEGMENTS[1][1]]
    return ltv.agg(
        (F.avg((F.col("ltv_segment") == top).cast("double")) * 100).alias("platinum_pct"),
        share_pct(F.sum(F.when(F.col("ltv_segment") == top, F.col("total_ltv"))), F.sum("total_ltv"))
        .alias("platinum_ltv_pct"),
        F.avg("total_ltv").alias("avg_ltv"),
        F.avg("avg_order_value").alias("avg_aov"),
        F.sum("predicted_future_ltv").alias("predicted_total"),
        F.count_if((F.col("churn_probability") > 0.7) & F.col("ltv_segment").isin(high))
         .alias("high_value_at_risk"))
