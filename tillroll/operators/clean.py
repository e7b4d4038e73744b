"""Cleaning of a mapped sales table: projections and filters, one small
aggregate for the unit-price test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions import parse_amount, ratio
from tillroll.operators._common import with_scalars
from tillroll.operators.columns import day_first_share, parse_timestamp


def parsed_date(df: DataFrame, day_first: bool | None = None) -> DataFrame:
    """``df`` with ``date`` as a timestamp without zone, NULL where it does not
    parse.  Date and timestamp columns pass unchanged.  ``day_first`` None: the
    order that more of the column's numeric dates need."""
    kind = df.schema["date"].dataType.typeName()
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return df.withColumn("date", F.col("date").cast("timestamp_ntz"))
    if day_first is not None:
        return df.withColumn("date", parse_timestamp(F.col("date"), day_first))
    flagged = with_scalars(df, day_first_share(df, "date").withColumnRenamed("day_first", "_day_first"))
    return flagged.withColumn("date", parse_timestamp(F.col("date"), F.col("_day_first"))).drop("_day_first")


def clean_date(df: DataFrame, day_first: bool | None = None) -> DataFrame:
    if "date" not in df.columns:
        return df
    return parsed_date(df, day_first).filter(F.col("date").isNotNull())


def date_report(df: DataFrame, day_first: bool | None = None) -> DataFrame:
    """One row: values of ``date``, how many parse, how many ``clean_date`` drops."""
    given = F.count(F.nullif(F.trim(F.col("_given")), F.lit("")))
    out = parsed_date(df.withColumn("_given", F.col("date").cast("string")), day_first)
    return out.agg(given.alias("given"), F.count("date").alias("parsed"), (given - F.count("date")).alias("unparsed"))


def clean_revenue(df: DataFrame, parity: bool = False) -> DataFrame:
    """Money text to double, keep > 0.  See ``parse_amount`` for ``parity``."""
    if "revenue" not in df.columns:
        return df
    return (df.withColumn("revenue", parse_amount(F.col("revenue"), parity=parity))
              .filter(F.col("revenue") > 0))


def parse_quantity(col: Column) -> Column:
    """Numeric or 1 (also for NaN and infinities), truncated to an integer; NULL
    for a number beyond a long."""
    q = F.trim(col.cast("string")).try_cast("double")
    finite = F.when(~F.isnan(q) & (F.abs(q) < float("inf")), q)
    return F.coalesce(finite, F.lit(1.0)).try_cast("bigint")


def clean_quantity(df: DataFrame) -> DataFrame:
    """``parse_quantity``; keep > 0.  A number beyond a long is no quantity: its
    row goes."""
    if "quantity" not in df.columns:
        return df
    return df.withColumn("quantity", parse_quantity(F.col("quantity"))).filter(F.col("quantity") > 0)


def derive_revenue(df: DataFrame) -> DataFrame:
    """Without a revenue column: first column whose name contains "price",
    times quantity; keep > 0."""
    if "revenue" in df.columns or "quantity" not in df.columns:
        return df
    price = next((c for c in df.columns if "price" in c), None)
    if price is None:
        return df
    r = parse_amount(F.col(f"`{price}`")) * F.col("quantity")
    return df.withColumn("revenue", r).filter(F.col("revenue") > 0)


def unit_price_flag(df: DataFrame, share: float = 0.3, std_limit: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (flag), or one per group of ``by``: does ``revenue`` look like a
    unit price?

    Over orders with at least two lines: flat revenue (sample std < 0.5) with
    some quantity above 1; when more than ``share`` of those orders look like
    that, and lines per order are repeated (distinct orders < 80 % of lines),
    revenue is a unit price.  Computed on all rows, deterministic."""
    per_order = (df.filter(F.col("order_id").isNotNull()).groupBy(*by, "order_id")
                   .agg(F.count(F.lit(1)).alias("lines"),
                        F.coalesce(F.stddev_samp("revenue"), F.lit(0.0)).alias("rev_std"),
                        F.max("quantity").alias("qty_max")))
    multi = F.col("lines") >= 2
    hit = multi & (F.col("rev_std") < std_limit) & (F.col("qty_max") > 1)
    g = per_order.groupBy(*by).agg(F.sum("lines").alias("rows"), F.count(F.lit(1)).alias("orders"),
                      F.count_if(multi).alias("multi"), F.count_if(hit).alias("hits"),
                      F.max("qty_max").alias("qty_max"))
    flag = ((F.col("qty_max") > 1) & (F.col("orders") < F.col("rows") * 0.8) &
            (ratio("hits", "multi") > share))
    return g.select(*by, F.coalesce(flag, F.lit(False)).alias("unit_price"))


def fix_unit_price(df: DataFrame, unit_price: bool | None = None) -> DataFrame:
    """revenue *= quantity when revenue is a unit price (``unit_price``
    True/False overrides the test; None runs it)."""
    if "revenue" not in df.columns or "quantity" not in df.columns:
        return df
    if unit_price is not None:
        return df.withColumn("revenue", F.col("revenue") * F.col("quantity")) if unit_price else df
    if "order_id" not in df.columns:
        return df
    flagged = df.join(F.broadcast(unit_price_flag(df)), how="inner")  # one-row decision
    return flagged.withColumn(
        "revenue", F.when(F.col("unit_price"), F.col("revenue") * F.col("quantity"))
                    .otherwise(F.col("revenue"))).drop("unit_price")


def typed_sales(df: DataFrame, parity: bool = False, day_first: bool | None = None) -> DataFrame:
    """Dates, revenue, quantity, derived revenue - in this order."""
    out = clean_date(df, day_first)
    out = clean_revenue(out, parity=parity)
    out = clean_quantity(out)
    return derive_revenue(out)


def clean_sales(df: DataFrame, parity: bool = False, unit_price: bool | None = None,
                day_first: bool | None = None) -> DataFrame:
    """``typed_sales``, then the unit-price fix."""
    return fix_unit_price(typed_sales(df, parity, day_first), unit_price=unit_price)
