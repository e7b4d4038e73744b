"""Rule-based insights as rows: (area, code, severity, subject, value).

Every rule is a one-row aggregate (or empty) computed on Spark; the rows are
unioned in rule order.  Wording is left to the caller.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.operators import kpi, products
from tillroll.operators._common import band, reuse
from tillroll.schema import has

INSIGHT_COLS = ["seq", "area", "code", "severity", "subject", "value"]
INSIGHT_SCHEMA = ("seq int, area string, code string, severity string, subject string, "
                  "value double")
# Fixed values of the rules.
GROWTH_POINTS = [(10, 30), (5, 22), (0, 15), (-5, 8)]
CUSTOMER_POINTS = [(10, 25), (5, 18), (0, 12), (-5, 6)]
DIVERSITY_POINTS = [(50, 20), (20, 15), (10, 10), (0, 5)]
HEALTH_LABELS = [(75, "Excellent"), (55, "Good"), (35, "Needs Attention")]
COMPLETENESS_COLUMNS = ["date", "revenue", "customer_id", "product", "category"]
ALERT_COLUMNS = ["date", "revenue", "customer_id", "product"]
SMALL_DATASET_ROWS = 500


def _row(df: DataFrame, seq: int, area: str, code: Column, severity: Column,
         subject: Column | None, value: Column | None) -> DataFrame:
    return df.select(F.lit(seq).alias("seq"), F.lit(area).alias("area"), code.alias("code"),
                     severity.alias("severity"),
                     (subject if subject is not None else F.lit(None)).cast("string")
                     .alias("subject"),
                     (value if value is not None else F.lit(None)).cast("double").alias("value")
                     ).filter(F.col("code").isNotNull())


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts).orderBy("seq")


def kpi_insights(sales: DataFrame) -> DataFrame:
    """Growth band, best month, top product, customer-growth sign, AOV."""
    parts = []
    g = F.col("revenue_growth")
    monthly = reuse(kpi.monthly_totals(sales)) if has(sales, "date", "revenue") else None
    growth = (kpi.last_step_growth(monthly, "revenue", "revenue_growth") if monthly is not None
              else kpi.revenue_growth_rate(sales))
    parts.append(_row(growth, 1, "revenue",
                      F.when(g > 10, "strong_growth").when(g > 0, "modest_growth")
                       .when(g < -10, "sharp_decline").when(g < 0, "slight_decline"),
                      F.when(g > 0, "positive").otherwise("negative"), None, g))
    if has(sales, "date", "revenue"):
        best = monthly.agg(
            F.max_by("month", F.struct(F.col("revenue"), -F.unix_date("month"))).alias("m"),
            F.max("revenue").alias("r"))
        parts.append(_row(best.filter(F.col("m").isNotNull()), 2, "revenue", F.lit("best_month"),
                          F.lit("info"), F.date_format("m", "MMMM yyyy"), F.col("r")))
    if has(sales, "product", "revenue"):
        top = products.top_products(sales, n=1)
        parts.append(_row(top, 3, "products", F.lit("top_product"), F.lit("info"),
                          F.col("product"), F.col("revenue")))
    c = F.col("customer_growth")
    parts.append(_row(kpi.customer_growth_rate(sales), 4, "customers",
                      F.when(c > 0, "acquisition_up").when(c < 0, "acquisition_down"),
                      F.when(c > 0, "positive").otherwise("negative"), None, c))
    parts.append(_row(kpi.totals(sales), 5, "orders", F.lit("average_order_value"),
                      F.lit("info"), None, F.col("average_order_value")))
    return _union(parts)


def _points(value: Column, cuts: list[tuple[float, int]]) -> Column:
    return band(value, [(t, p) for t, p in cuts], 0)


def health_score(sales: DataFrame) -> DataFrame:
    """Growth, acquisition, product diversity and completeness points, their
    sum and label."""
    present = sum(1 for c in COMPLETENESS_COLUMNS if has(sales, c))
    n_products = (sales.agg(F.count_distinct("product").alias("n_products"))
                  if has(sales, "product") else
                  sales.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("n_products")))
    one = (kpi.revenue_growth_rate(sales).join(F.broadcast(kpi.customer_growth_rate(sales)))
           .join(F.broadcast(n_products)))
    out = one.select(
        _points(F.col("revenue_growth"), GROWTH_POINTS).alias("revenue_growth_points"),
        _points(F.col("customer_growth"), CUSTOMER_POINTS).alias("customer_growth_points"),
        _points(F.col("n_products"), DIVERSITY_POINTS).alias("product_diversity_points"),
        F.lit(int(round(present / len(COMPLETENESS_COLUMNS) * 25))).alias("completeness_points"))
    total = (F.col("revenue_growth_points") + F.col("customer_growth_points")
             + F.col("product_diversity_points") + F.col("completeness_points"))
    out = out.withColumn("health_score", total)
    return out.withColumn("health_label", band(F.col("health_score"), HEALTH_LABELS, "Critical",
                                               strict=False))


def risk_alerts(sales: DataFrame) -> DataFrame:
    """CRITICAL / WARNING revenue drops, customer dependency, INFO rows for
    missing columns and small datasets."""
    g = F.col("revenue_growth")
    parts = [_row(kpi.revenue_growth_rate(sales), 1, "revenue",
                  F.when(g < -15, "revenue_drop").when(g < -5, "revenue_decline"),
                  F.when(g < -15, "CRITICAL").otherwise("WARNING"), None, F.abs(g))]
    if has(sales, "customer_id", "revenue"):
        c = products.customer_concentration(sales)
        parts.append(_row(c, 2, "customers",
                          F.when(F.col("top5_pct") > 50, "customer_dependency"),
                          F.lit("WARNING"), None, F.col("top5_pct")))
    missing = [c for c in ALERT_COLUMNS if not has(sales, c)]
    spark = sales.sparkSession
    if missing:
        parts.append(_row(spark.range(1), 3, "data", F.lit("missing_columns"), F.lit("INFO"),
                          F.lit(", ".join(missing)), F.lit(float(len(missing)))))
    n = sales.agg(F.count(F.lit(1)).alias("n"))
    parts.append(_row(n, 4, "data", F.when(F.col("n") < SMALL_DATASET_ROWS, "small_dataset"),
                      F.lit("INFO"), None, F.col("n")))
    return _union(parts)


def recommendations(sales: DataFrame) -> DataFrame:
    """Ordered actions with a running priority: declining revenue (HIGH),
    declining acquisition (HIGH), promote the top seller (MEDIUM), review the
    weakest category (LOW), retention programme (MEDIUM, always)."""
    spark = sales.sparkSession
    g = F.col("revenue_growth")
    parts = [_row(kpi.revenue_growth_rate(sales), 1, "revenue",
                  F.when(g < 0, "launch_promotion"), F.lit("HIGH"), None, F.abs(g))]
    if has(sales, "customer_id"):
        c = F.col("customer_growth")
        parts.append(_row(kpi.customer_growth_rate(sales), 2, "customers",
                          F.when(c < 0, "improve_acquisition"), F.lit("HIGH"), None, c))
    if has(sales, "product"):
        parts.append(_row(products.top_products(sales, n=1), 3, "products",
                          F.lit("promote_top_seller"), F.lit("MEDIUM"), F.col("product"),
                          F.col("revenue")))
    if has(sales, "category"):
        parts.append(_row(products.weakest_category(sales), 4, "products",
                          F.lit("review_category"), F.lit("LOW"), F.col("category"),
                          F.col("percentage")))
    parts.append(_row(spark.range(1), 5, "customers", F.lit("retention_program"),
                      F.lit("MEDIUM"), None, None))
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    # at most five rows: the unpartitioned window is over the rule rows only
    return (rows.withColumn("priority", F.row_number().over(Window.orderBy("seq")))
                .orderBy("priority"))


def sales_observations(sales: DataFrame) -> DataFrame:
    """Seasonality verdicts: best / weakest month, trend band, seasonality."""
    from tillroll.operators.timeseries import seasonality_stats

    s = reuse(seasonality_stats(sales))   # one row, read by the four rules
    a = F.col("avg_mom_growth")
    parts = [
        _row(s, 1, "revenue", F.lit("best_month"), F.lit("info"),
             F.date_format("best_month", "MMMM yyyy"), F.col("best_revenue")),
        _row(s, 2, "revenue", F.lit("weakest_month"), F.lit("info"),
             F.date_format("worst_month", "MMMM yyyy"), F.col("worst_revenue")),
        _row(s, 3, "revenue", F.when(a > 5, "strong_upward_trend").when(a > 0, "gradual_growth")
             .otherwise("declining_trend"), F.when(a > 0, "positive").otherwise("negative"),
             None, a),
        _row(s, 4, "revenue", F.when(F.col("high_seasonality"), "high_seasonality")
             .when(~F.col("high_seasonality"), "stable_sales"), F.lit("info"), None, F.col("cv")),
    ]
    return _union(parts)
