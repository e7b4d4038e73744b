"""Product, category and region rankings, concentration and product scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import round_even, share_pct
from tillroll.operators._common import band, non_null, reuse, running_totals, with_scalars
from tillroll.schema import empty, has


def _ranked(df: DataFrame, value: str, key: str) -> Window:
    return Window.orderBy(F.col(value).desc(), F.col(key).asc())


def product_totals(sales: DataFrame) -> DataFrame:
    """Per product: revenue (exact), quantity, distinct orders."""
    aggs = [F.sum("revenue").alias("revenue")]
    if has(sales, "quantity"):
        aggs.append(F.sum("quantity").cast("bigint").alias("quantity"))
    if has(sales, "order_id"):
        aggs.append(F.count_distinct("order_id").cast("bigint").alias("orders"))
    return non_null(sales, "product").groupBy("product").agg(*aggs)


def top_products(sales: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` products by revenue (ties by product name).  ``orderBy +
    limit`` plans as TakeOrderedAndProject: each task keeps only n rows."""
    if not has(sales, "product", "revenue"):
        return empty(sales.sparkSession, "product string, revenue double"
                     + ", quantity bigint" * has(sales, "quantity") + ", orders bigint" * has(sales, "order_id"))
    t = product_totals(sales).orderBy(F.col("revenue").desc(), F.col("product")).limit(n)
    return t.withColumn("revenue", F.col("revenue").cast("double"))


def _share_by(sales: DataFrame, key: str) -> DataFrame:
    if not has(sales, key, "revenue"):
        return empty(sales.sparkSession, f"{key} string, revenue double, percentage double")
    # read for the rows and the total: one pass over the lines for both
    g = reuse(non_null(sales, key).groupBy(key).agg(F.sum("revenue").cast("double").alias("revenue")))
    total = g.agg(F.sum("revenue").alias("_total"))
    out = with_scalars(g, total).withColumn(
        "percentage", round_even(share_pct("revenue", "_total"), 2))
    return out.drop("_total").orderBy(F.col("revenue").desc(), F.col(key))


def revenue_by_category(sales: DataFrame) -> DataFrame:
    return _share_by(sales, "category")


def revenue_by_region(sales: DataFrame) -> DataFrame:
    return _share_by(sales, "region")


def weakest_category(sales: DataFrame) -> DataFrame:
    """Lowest-revenue category when more than one exists (ties: last name)."""
    s = revenue_by_category(sales)
    if "category" not in s.columns or not has(sales, "category", "revenue"):
        return empty(sales.sparkSession, "category string, percentage double")
    n = s.agg(F.count(F.lit(1)).alias("n"))
    last = s.orderBy(F.col("revenue").asc(), F.col("category").desc()).limit(1)
    return with_scalars(last, n).filter(F.col("n") > 1).select("category", "percentage")


def _largest(totals: DataFrame, top: int | None) -> DataFrame:
    return totals if top is None else totals.orderBy(F.col("revenue").desc(), F.col("product")).limit(top)


def product_pareto(sales: DataFrame, top: int | None = None, show: int | None = None) -> DataFrame:
    """Cumulative revenue share by product rank: of all products, or of the
    ``top`` largest; all ranks, or the first ``show``.

    Products are ranked in value ranges cut by approximate quantiles, so no
    task sorts all of them."""
    if not has(sales, "product", "revenue"):
        return empty(sales.sparkSession,
                     "product_rank int, product string, revenue double, cumulative_pct double")
    t = _largest(reuse(product_totals(sales).select("product", "revenue")), top)
    ranked = running_totals(t, "revenue", "product")
    if show is not None:
        ranked = ranked.filter(F.col("rank") <= show)
    return (ranked.select(F.col("rank").cast("int").alias("product_rank"), "product",
                          F.col("revenue").cast("double").alias("revenue"),
                          share_pct("running", "total").alias("cumulative_pct"))
            .orderBy("product_rank"))


def product_concentration(sales: DataFrame, top: int | None = None) -> DataFrame:
    """Share of the top 3 / top 10 products in all revenue, or in that of the
    ``top`` largest products."""
    if not has(sales, "product", "revenue"):
        return empty(sales.sparkSession, "top3_pct double, top10_pct double, level string")
    t = _largest(reuse(product_totals(sales).select("product", "revenue")), top)
    best = t.orderBy(F.col("revenue").desc(), F.col("product")).limit(10)
    r = best.withColumn("rk", F.row_number().over(_ranked(best, "revenue", "product")))
    parts = r.agg(F.sum(F.when(F.col("rk") <= 3, F.col("revenue"))).alias("t3"), F.sum("revenue").alias("t10"))
    s = with_scalars(parts, t.agg(F.sum("revenue").alias("t")))
    s = s.select(share_pct("t3", "t").alias("top3_pct"), share_pct("t10", "t").alias("top10_pct"))
    return s.withColumn("level", band(F.col("top3_pct"), [(60, "HIGH"), (40, "MODERATE")],
                                      "HEALTHY"))


def customer_totals(sales: DataFrame) -> DataFrame:
    return non_null(sales, "customer_id").groupBy("customer_id").agg(
        F.sum("revenue").alias("revenue"))


def customer_concentration(sales: DataFrame) -> DataFrame:
    """Share of all revenue held by the top 5 / 10 / 20 / 100 customers.

    Only the top 100 customers travel (TakeOrderedAndProject); the total is a
    separate one-row aggregate."""
    schema = ("top5_pct double, top10_pct double, top20_pct double, top100_pct double, "
              "level string, top5_alert boolean")
    if not has(sales, "customer_id", "revenue"):
        return empty(sales.sparkSession, schema)
    c = reuse(customer_totals(sales))   # read for the top 100 and for the total
    top = c.orderBy(F.col("revenue").desc(), F.col("customer_id")).limit(100)
    r = top.withColumn("rk", F.row_number().over(_ranked(top, "revenue", "customer_id")))
    parts = r.agg(*[F.coalesce(F.sum(F.when(F.col("rk") <= k, F.col("revenue"))), F.lit(0))
                    .cast("double").alias(f"t{k}") for k in (5, 10, 20, 100)])
    total = c.agg(F.sum("revenue").cast("double").alias("total"))
    s = with_scalars(parts, total)
    s = s.select(*[share_pct(f"t{k}", "total").alias(f"top{k}_pct")
                   for k in (5, 10, 20, 100)])
    return (s.withColumn("level", band(F.col("top10_pct"), [(50, "HIGH"), (30, "MODERATE")],
                                       "HEALTHY"))
             .withColumn("top5_alert", F.col("top5_pct") > 50))
