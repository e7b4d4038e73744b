"""Invariants on the fixture tables."""

import pytest
from pyspark.sql import functions as F

from shared import SF_SMALL
from tillroll.operators import (basket, churn, cohort, forecast, ltv, products)
from tillroll.sources import fixtures


@pytest.fixture(scope="module")
def sales(spark):
    return fixtures.sales(spark, SF_SMALL).cache()


def test_cohort_period_zero_is_full(sales):
    r = cohort.cohort_retention(sales).filter(F.col("period") == 0)
    assert {x[0] for x in r.select("retention_pct").distinct().collect()} == {100.0}
    assert cohort.cohort_retention(sales).agg(F.max("retention_pct")).first()[0] <= 100.0


def test_shares_sum_to_100(sales):
    for df in (products.revenue_by_category(sales), products.revenue_by_region(sales)):
        total = df.agg(F.sum("percentage")).first()[0]
        assert total == pytest.approx(100.0, abs=0.01 * df.count())


def test_support_bounded_by_item_support(sales):
    items, pairs, total = basket.cooccurrence(sales)
    n = total.first()["n"]
    counts = dict(items.select("product", "orders").collect())
    for a, b, both in pairs.select("product_a", "product_b", "both").collect():
        assert both <= min(counts[a], counts[b]) <= n
    for r in basket.product_associations(sales, min_support=0.001).collect():
        assert r["support"] <= r["confidence"] + 1e-4 and r["lift"] > 1.1


def test_platinum_is_about_top_decile(sales):
    t = ltv.customer_ltv(sales)
    n = t.count()
    plat = t.filter(F.col("ltv_segment") == "Platinum").count()
    assert abs(plat - 0.1 * n) <= 2
    b = t.groupBy("ltv_segment").agg(F.min("total_ltv").alias("lo"), F.max("total_ltv").alias("hi"))
    rng = {r["ltv_segment"]: (r["lo"], r["hi"]) for r in b.collect()}
    order = ["Bronze", "Silver", "Gold", "Platinum"]
    for lower, upper in zip(order, order[1:]):
        assert rng[lower][1] <= rng[upper][0]


def test_forecast_bounds_bracket_prediction(sales):
    f = forecast.forecast_by_category(sales)
    bad = f.filter((F.col("lower_bound") > F.col("predicted")) |
                   (F.col("predicted") > F.col("upper_bound")) | (F.col("lower_bound") < 0))
    assert f.count() > 0 and bad.count() == 0


def test_risk_levels_partition_customers(sales):
    s = churn.churn_rule(sales)
    n = s.count()
    assert churn.risk_distribution(s).agg(F.sum("customers")).first()[0] == n
    hist = churn.churn_histogram(s)
    assert hist.agg(F.sum("customers")).first()[0] == n
    assert hist.agg(F.max("bin")).first()[0] <= 19
