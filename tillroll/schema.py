"""Canonical sales-line schema and presence guards.

Every standard column is optional.  An operator whose required columns are
missing returns an empty DataFrame with its declared output schema instead of
raising, so callers can always union / display results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

STANDARD_COLUMNS = (
    "date", "revenue", "quantity", "customer_id", "product", "category", "region", "order_id",
)

SALES_SCHEMA = T.StructType([
    T.StructField("date", T.TimestampNTZType(), True),
    T.StructField("revenue", T.DecimalType(18, 4), True),
    T.StructField("quantity", T.IntegerType(), True),
    T.StructField("customer_id", T.StringType(), True),
    T.StructField("product", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("region", T.StringType(), True),
    T.StructField("order_id", T.StringType(), True),
])


def has(df: DataFrame, *cols: str) -> bool:
    present = set(df.columns)
    return all(c in present for c in cols)


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    """Empty frame with the given DDL schema (lazy, no job)."""
    return spark.createDataFrame([], ddl)
