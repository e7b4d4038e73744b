"""The canonical sales table with a layout for its readers.

``write_canonical`` stores cleaned lines once: months are partitions, so a
filter on ``month`` reads the files of those months only; inside a month rows
are bucketed and sorted by customer, so everything per customer (RFM, features,
cohorts, lifetime value) aggregates without a shuffle of the lines.
``refresh_months`` replaces the months whose lines have changed and leaves the
files of the others alone.

A hot customer stays in one bucket, as in any grouping by customer; its lines
are combined before anything else happens to them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions import month_start
from tillroll.schema import STANDARD_COLUMNS, has
from tillroll.session import checkpoint_dir

BUCKETS = 32


def with_month(sales: DataFrame) -> DataFrame:
    """The standard columns and ``month`` last; lines without a date have the NULL
    month, tables without dates have no other."""
    month = month_start("date").cast("date") if has(sales, "date") else F.lit(None).cast("date")
    return sales.select(*[c for c in STANDARD_COLUMNS if c in sales.columns], month.alias("month"))


def write_canonical(sales: DataFrame, name: str | None = None, buckets: int = BUCKETS) -> str:
    """Store ``sales`` as a table in the shared folder and return its name.

    Rows are dealt by (month, customer) first, so each task writes whole buckets
    and a month has one file per bucket.  Without customers the table has months
    only.  An existing table of that name is replaced."""
    spark = sales.sparkSession
    name = name or f"sales_{uuid.uuid4().hex[:8]}"
    rows = with_month(sales)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:8]}"
    if has(sales, "customer_id"):
        writer = (rows.repartition("month", F.pmod(F.hash("customer_id"), F.lit(buckets))).write.partitionBy("month")
                  .bucketBy(buckets, "customer_id").sortBy("customer_id"))
    else:
        writer = rows.repartition("month").write.partitionBy("month")
    writer.format("parquet").option("path", path).saveAsTable(name)
    return name


def read_canonical(spark: SparkSession, name: str, months: tuple[str, str] | None = None) -> DataFrame:
    """The table, or its months from the first to the last of ``months``."""
    rows = spark.table(name)
    return rows if months is None else rows.where(F.col("month").between(F.lit(months[0]).cast("date"), F.lit(months[1]).cast("date")))


def refresh_months(name: str, sales: DataFrame, months: list[str]) -> None:
    """Replace the given months (first days) by the lines that ``sales`` has of
    them; a month without lines there keeps its old ones.  Only the files of
    these months are written."""
    spark = sales.sparkSession
    rows = with_month(sales).where(F.col("month").isin([F.lit(m).cast("date") for m in months]))
    buckets = int({r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}.get("Num Buckets", 0))
    if buckets:
        rows = rows.repartition("month", F.pmod(F.hash("customer_id"), F.lit(buckets)))
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")              # insertInto reads it from the session
    try:
        rows.select(*spark.table(name).columns).write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(mode, before)
