"""Product performance: revenue, frequency and 30-day trend scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions import ratio, round_even
from tillroll.operators._common import non_null, reuse, with_scalars
from tillroll.schema import empty, has

# Fixed values of the scoring rules.
WEIGHTS = {"revenue_score": 0.50, "frequency_score": 0.30, "trend_score": 0.20}
TREND_DAYS = 30
CLASSES = ["Star", "Steady Performer", "Average", "Declining", "Underperformer"]

PERF_SCHEMA = ("product string, total_revenue double, order_count bigint, avg_price double, "
               "trend_pct double, revenue_score double, frequency_score double, "
               "trend_score double, composite_score double, performance_class string")


def product_stats(sales: DataFrame) -> DataFrame:
    """Per product: revenue, line count, mean line revenue and the trend
    inputs (revenue in the last 30 days vs the 30 days before), all in one
    aggregation."""
    aggs = [F.sum("revenue").alias("_rev"), F.count("revenue").alias("order_count")]
    if has(sales, "date"):
        ref = F.col("_max_date")
        cut = ref - F.expr(f"INTERVAL {TREND_DAYS} DAYS")
        prev_cut = cut - F.expr(f"INTERVAL {TREND_DAYS} DAYS")
        recent = F.col("date") >= cut
        previous = (F.col("date") >= prev_cut) & (F.col("date") < cut)
        aggs += [F.sum(F.when(recent, F.col("revenue"))).alias("_recent"),
                 F.count(F.when(recent, F.lit(1))).alias("_n_recent"),
                 F.sum(F.when(previous, F.col("revenue"))).alias("_previous"),
                 F.count(F.when(previous, F.lit(1))).alias("_n_previous")]
        src = with_scalars(non_null(sales, "product"), sales.agg(F.max("date").alias("_max_date")))
    else:
        src = non_null(sales, "product")
    g = src.groupBy("product").agg(*aggs)
    out = g.select("product", F.col("_rev").cast("double").alias("total_revenue"),
                   F.col("order_count").cast("bigint").alias("order_count"),
                   ratio("_rev", "order_count").alias("avg_price"),
                   _trend(g) if has(sales, "date") else F.lit(0.0).alias("trend_pct"))
    return out


def _trend(g: DataFrame) -> Column:
    prev = F.col("_previous").cast("double")
    pct = ratio(F.col("_recent").cast("double") - prev, prev) * F.lit(100.0)
    ok = (F.col("_n_recent") > 0) & (F.col("_n_previous") > 0) & (prev != 0)
    return round_even(F.when(ok, pct).otherwise(F.lit(0.0)), 1).alias("trend_pct")


def _minmax_score(col: str) -> tuple[list[Column], Column]:
    lo, hi = F.col(f"_lo_{col}"), F.col(f"_hi_{col}")
    aggs = [F.min(col).alias(f"_lo_{col}"), F.max(col).alias(f"_hi_{col}")]
    score = F.when(hi == lo, F.lit(50.0)).otherwise(
        round_even((F.col(col) - lo) / (hi - lo) * F.lit(100.0), 1))
    return aggs, score


def product_performance(sales: DataFrame) -> DataFrame:
    if not has(sales, "product", "revenue"):
        return empty(sales.sparkSession, PERF_SCHEMA)
    stats = reuse(product_stats(sales))   # read for min/max and for the rows
    aggs, scores = [], {}
    for src, name in (("total_revenue", "revenue_score"), ("order_count", "frequency_score"),
                      ("trend_pct", "trend_score")):
        a, s = _minmax_score(src)
        aggs += a
        scores[name] = s
    # min / max over products: a one-row aggregate, broadcast back
    scored = with_scalars(stats, stats.agg(*aggs)).withColumns(scores)
    composite = (F.col("revenue_score") * F.lit(WEIGHTS["revenue_score"])
                 + F.col("frequency_score") * F.lit(WEIGHTS["frequency_score"])
                 + F.col("trend_score") * F.lit(WEIGHTS["trend_score"]))
    scored = scored.withColumn("composite_score", round_even(composite, 1))
    c, t = F.col("composite_score"), F.col("trend_pct")
    klass = (F.when((c >= 70) & (t > 0), CLASSES[0]).when(c >= 70, CLASSES[1])
              .when(c >= 40, CLASSES[2]).when(t < -20, CLASSES[3]).otherwise(CLASSES[4]))
    cols = [x.split()[0] for x in PERF_SCHEMA.split(", ")]
    return (scored.withColumn("performance_class", klass).select(*cols)
                  .orderBy(F.col("composite_score").desc(), "product"))


def performance_class_revenue(perf: DataFrame) -> DataFrame:
    return perf.groupBy("performance_class").agg(
        F.sum("total_revenue").alias("total_revenue"), F.count(F.lit(1)).alias("products"))


def top_products_by_score(perf: DataFrame, performance_class: str | None = None,
                          n: int = 20) -> DataFrame:
    p = perf if performance_class is None else perf.filter(
        F.col("performance_class") == performance_class)
    return p.orderBy(F.col("composite_score").desc(), "product").limit(n)
