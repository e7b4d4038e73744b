"""The canonical table: partition filters, no shuffle per customer, refresh."""

import re

import pytest
from pyspark.sql import functions as F

from shared import SF_SMALL, rows
from tillroll.operators import churn, customers, products, timeseries
from tillroll.plans.canonical import read_canonical, refresh_months, write_canonical
from tillroll.sources import fixtures

COLUMNS = ["date", "revenue", "quantity", "customer_id", "product", "category", "region", "order_id"]


@pytest.fixture(scope="module")
def table(spark):
    name = write_canonical(fixtures.sales(spark, SF_SMALL), buckets=4)
    yield name
    spark.sql(f"DROP TABLE {name}")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lines(df):
    return df.select(F.xxhash64(*[F.col(c).cast("string") for c in COLUMNS]).alias("h")).agg(
        F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)"))).first()


def test_same_rows_and_results(spark, table):
    sales, stored = fixtures.sales(spark, SF_SMALL), read_canonical(spark, table)
    assert lines(stored) == lines(sales)
    assert rows(customers.rfm(stored)) == rows(customers.rfm(sales))
    assert rows(timeseries.monthly_revenue(stored)) == rows(timeseries.monthly_revenue(sales))


def test_months_are_partition_filters(spark, table):
    year = read_canonical(spark, table, ("1996-03-01", "1996-05-01"))
    assert re.search(r"PartitionFilters: \[[^\]]*month", plan(products.revenue_by_region(year)))
    assert {r[0].month for r in year.select("month").distinct().collect()} == {3, 4, 5}


def test_customers_are_not_shuffled(spark, table):
    stored = read_canonical(spark, table)
    per = stored.groupBy("customer_id").agg(F.sum("revenue").alias("revenue"), F.max("date").alias("last"))
    assert "Exchange" not in plan(per)
    # the operators shuffle one-row aggregates only, never by customer
    for op in (customers.rfm, lambda s: churn.label_churn(customers.customer_features(s))):
        assert "hashpartitioning(customer_id" not in plan(op(stored))
        assert "hashpartitioning(customer_id" in plan(op(fixtures.sales(spark, SF_SMALL)))


def test_refresh_touches_the_given_months_only(spark):
    sales = fixtures.sales(spark, SF_SMALL)
    name = write_canonical(sales, buckets=4)
    files = lambda: set(read_canonical(spark, name).inputFiles())
    before = files()
    changed = sales.withColumn("revenue", (F.col("revenue") * 2).cast(sales.schema["revenue"].dataType))
    refresh_months(name, changed, ["1996-03-01", "2050-01-01"])
    spark.catalog.refreshTable(name)
    after = files()
    assert all("month=1996-03-01" in f for f in before ^ after) and before & after
    one = lambda df, m: df.where(F.date_trunc("month", "date") == m).agg(F.sum("revenue")).first()[0]
    stored = read_canonical(spark, name)
    assert one(stored, "1996-03-01") == 2 * one(sales, "1996-03-01") and one(stored, "1996-04-01") == one(sales, "1996-04-01")
    assert "Num Buckets" in {r["col_name"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    spark.sql(f"DROP TABLE {name}")


def test_tables_without_customers_or_dates(spark):
    few = spark.createDataFrame([("a", 1.5), (None, 2.5)], "product string, revenue double")
    stored = read_canonical(spark, write_canonical(few))
    assert rows(stored, "revenue", "month") == [(1.5, None), (2.5, None)]
    assert read_canonical(spark, write_canonical(few.limit(0))).collect() == []
