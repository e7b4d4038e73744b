"""Operators on small hand-made frames: the edge cases of the spec."""

import datetime as dt
import itertools
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from shared import rows
from tillroll.functions import elapsed_days, parse_amount
from tillroll.operators import (basket, cohort, forecast, kpi, ltv, performance, products,
                                segments, stats, timeseries)

SCHEMA = ("date timestamp_ntz, revenue decimal(18,4), quantity int, customer_id string, "
          "product string, category string, region string, order_id string")


def sales_df(spark, recs):
    """recs: dicts with any of the standard keys; missing keys are NULL."""
    keys = [f.split()[0] for f in SCHEMA.split(", ")]
    data = []
    for r in recs:
        r = dict(r)
        if r.get("revenue") is not None:
            r["revenue"] = Decimal(str(r["revenue"]))
        data.append(tuple(r.get(k) for k in keys))
    return spark.createDataFrame(data, SCHEMA)


def d(y, m, day, h=0):
    return dt.datetime(y, m, day, h)


def test_elapsed_days_floor(spark):
    df = spark.createDataFrame([(d(2024, 1, 1, 23), d(2024, 1, 2, 1)),
                                (d(2024, 1, 1, 1), d(2024, 1, 2, 1))],
                               "a timestamp_ntz, b timestamp_ntz")
    got = [r[0] for r in df.select(elapsed_days("a", "b")).collect()]
    assert got == [0, 1]


def test_null_keys_dropped(spark):
    s = sales_df(spark, [dict(date=d(2024, 1, 1), revenue=10, category="a"),
                         dict(date=d(2024, 1, 1), revenue=30, category=None),
                         dict(date=d(2024, 1, 1), revenue=30, category="b")])
    out = rows(products.revenue_by_category(s), "category", "revenue", "percentage")
    assert out == [("a", 10.0, 25.0), ("b", 30.0, 75.0)]


def test_growth_guards(spark):
    one = sales_df(spark, [dict(date=d(2024, 1, 5), revenue=10)])
    assert kpi.revenue_growth_rate(one).first()[0] == 0.0
    zero_prev = sales_df(spark, [dict(date=d(2024, 1, 5), revenue=0),
                                 dict(date=d(2024, 2, 5), revenue=10)])
    assert kpi.revenue_growth_rate(zero_prev).first()[0] == 0.0
    gap = sales_df(spark, [dict(date=d(2024, 1, 5), revenue=10),
                           dict(date=d(2024, 3, 5), revenue=15)])
    assert kpi.revenue_growth_rate(gap).first()[0] == 50.0
    mg = timeseries.monthly_growth(gap).collect()
    assert mg[0]["mom_growth"] is None and mg[1]["mom_growth"] == pytest.approx(50.0)


def test_half_even_rounding(spark):
    s = sales_df(spark, [dict(date=d(2024, 1, 5), revenue=1, category="a"),
                         dict(date=d(2024, 1, 5), revenue=7, category="b")])
    # 1/8 = 12.5 % exactly: half-even keeps 12.5 at 2 places
    assert rows(products.revenue_by_category(s), "percentage") == [(12.5,), (87.5,)]


def _daily(spark, values, start=d(2024, 1, 1)):
    return sales_df(spark, [dict(date=start + dt.timedelta(days=i), revenue=v)
                            for i, v in enumerate(values)])


def test_forecast_gates(spark):
    assert forecast.forecast_revenue(_daily(spark, [5] * 13)).count() == 0
    f14 = forecast.forecast_fit_quality(_daily(spark, list(range(1, 15)))).first()
    assert f14["fit_freq"] == "D"
    # 49 days = 7 full weeks (Mon..Sun) -> daily; 56 days -> 8 weeks -> weekly
    monday = d(2024, 1, 1)
    assert forecast.forecast_fit_quality(_daily(spark, [3] * 49, monday)).first()["fit_freq"] == "D"
    assert forecast.forecast_fit_quality(_daily(spark, [3] * 56, monday)).first()["fit_freq"] == "W"


def test_exact_quadratic(spark):
    ys = [100 + 2 * x + 0.5 * x * x for x in range(20)]
    s = _daily(spark, ys)
    q = forecast.forecast_fit_quality(s).first()
    assert q["model_score"] == 1.0
    f = forecast.forecast_revenue(s).orderBy("date").collect()
    assert len(f) == 30
    for i, r in enumerate(f):
        x = 20 + i
        assert r["predicted"] == pytest.approx(round(100 + 2 * x + 0.5 * x * x, 2), abs=1e-6)
        assert r["upper_bound"] == pytest.approx(r["predicted"], abs=1e-6)


def test_moving_average_windows(spark):
    assert forecast.moving_average_forecast(_daily(spark, [1] * 6)).count() == 0
    vals10 = list(range(1, 11))      # 7 <= n < 14: older = first 7 days
    f = forecast.moving_average_forecast(_daily(spark, vals10)).orderBy("date").collect()
    recent, older = np.mean(vals10[-7:]), np.mean(vals10[:7])
    g = (recent - older) / (7 * older)
    assert f[0]["predicted_revenue"] == pytest.approx(recent * (1 + g))
    vals14 = list(range(1, 15))
    f = forecast.moving_average_forecast(_daily(spark, vals14)).orderBy("date").collect()
    recent, older = np.mean(vals14[-7:]), np.mean(vals14[:7])
    g = (recent - older) / (7 * older)
    assert f[29]["predicted_revenue"] == pytest.approx(recent * (1 + g * 30))


def test_product_scores_constant_and_trend(spark):
    base = d(2024, 3, 31)
    recs = [dict(date=base, revenue=10, product=p) for p in "abc"]
    perf = performance.product_performance(sales_df(spark, recs)).collect()
    assert all(r["composite_score"] == 50.0 for r in perf)
    assert all(r["performance_class"] == "Average" for r in perf)
    recs = [dict(date=base, revenue=10, product="new"),
            dict(date=base - dt.timedelta(days=45), revenue=10, product="gone"),
            dict(date=base, revenue=20, product="both"),
            dict(date=base - dt.timedelta(days=45), revenue=10, product="both")]
    t = dict(rows(performance.product_performance(sales_df(spark, recs)), "product", "trend_pct"))
    assert t == {"new": 0.0, "gone": 0.0, "both": 100.0}


def test_three_orders_rules(spark):
    recs = [dict(order_id="o1", product="A", revenue=1), dict(order_id="o1", product="B", revenue=1),
            dict(order_id="o2", product="A", revenue=1), dict(order_id="o2", product="B", revenue=1),
            dict(order_id="o2", product="C", revenue=1), dict(order_id="o3", product="A", revenue=1)]
    r = basket.product_associations(sales_df(spark, recs), min_support=0.1).collect()
    assert [(x["product_a"], x["product_b"], x["support"], x["confidence"], x["lift"])
            for x in r] == [("B", "C", 0.3333, 0.5, 1.5)]


@pytest.mark.parametrize("n_products", [8, 70])
def test_cooccurrence_matches_brute_force(spark, n_products):
    rnd = random.Random(n_products)
    prods = [f"p{i:02d}" for i in range(n_products)]
    recs, baskets = [], {}
    for o in range(300):
        items = rnd.sample(prods, rnd.randint(1, 6))
        baskets[o] = set(items)
        recs += [dict(order_id=str(o), product=p, revenue=rnd.randint(1, 9)) for p in items]
    items, pairs, total = basket.cooccurrence(sales_df(spark, recs))
    assert total.first()["n"] == 300
    got = {(a, b): n for a, b, n in pairs.select("product_a", "product_b", "both").collect()}
    want = {}
    for s in baskets.values():
        for a, b in itertools.combinations(sorted(s), 2):
            want[(a, b)] = want.get((a, b), 0) + 1
    assert got == want
    counts = dict(items.select("product", "orders").collect())
    assert counts == {p: sum(p in s for s in baskets.values()) for p in prods
                      if any(p in s for s in baskets.values())}


def test_cohort_toy(spark):
    recs = [dict(customer_id="c1", date=d(2024, 1, 3), revenue=1),
            dict(customer_id="c1", date=d(2024, 3, 3), revenue=1),
            dict(customer_id="c2", date=d(2024, 1, 9), revenue=1),
            dict(customer_id="c2", date=d(2024, 2, 9), revenue=1),
            dict(customer_id="c2", date=d(2024, 2, 19), revenue=1)]
    r = rows(cohort.cohort_retention(sales_df(spark, recs)), "cohort_month", "period",
             "customers", "retention_pct")
    jan = dt.date(2024, 1, 1)
    assert r == [(jan, 0, 2, 100.0), (jan, 1, 1, 50.0), (jan, 2, 1, 50.0)]


def test_ltv_edges(spark):
    ref = d(2024, 6, 1)
    recs = [dict(customer_id="r0", date=ref, revenue=10, order_id="a"),
            dict(customer_id="r89", date=ref - dt.timedelta(days=89), revenue=10, order_id="b"),
            dict(customer_id="r90", date=ref - dt.timedelta(days=90), revenue=10, order_id="c"),
            dict(customer_id="r91", date=ref - dt.timedelta(days=91), revenue=10, order_id="d")]
    out = {r["customer_id"]: r for r in ltv.customer_ltv(sales_df(spark, recs)).collect()}
    assert out["r0"]["churn_probability"] == 0.0 and out["r0"]["customer_age_days"] == 1
    assert out["r89"]["churn_probability"] == pytest.approx(89 / 90)
    assert out["r90"]["churn_probability"] == 1.0 and out["r91"]["churn_probability"] == 1.0
    assert out["r90"]["predicted_future_ltv"] == 0.0


@pytest.mark.parametrize("accuracy", [20, 100, 10000])
def test_quantiles_exact(spark, accuracy):
    rnd = np.random.default_rng(7)
    x = np.concatenate([rnd.normal(size=5000), np.repeat([0.25, 1.5], 700)])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    probs = {"p10": 0.1, "p40": 0.4, "p50": 0.5, "p70": 0.7, "p90": 0.9, "p100": 1.0}
    got = stats.quantiles(df, "v", probs, accuracy=accuracy).first()
    for name, p in probs.items():
        assert got[name] == pytest.approx(np.percentile(x, p * 100), rel=1e-12, abs=1e-12)


def test_label_clusters_fixed(spark):
    a = spark.createDataFrame(
        [("a", 5, 10, 1000.0, 0), ("b", 200, 1, 10.0, 1), ("c", 30, 5, 500.0, 2),
         ("d", 100, 2, 100.0, 3)],
        "customer_id string, recency bigint, frequency bigint, monetary double, cluster int")
    got = dict(rows(segments.label_clusters(a, 4), "customer_id", "segment"))
    assert got == {"a": "Champions", "c": "Loyal Customers", "d": "At Risk",
                   "b": "Lost/Inactive"}


@pytest.mark.parametrize("text,want", [
    ("£1,234.50", 1234.5), ("-£5", -5.0), ("(5.00)", -5.0), ("1e-05", 1e-05), ("EUR 5", 5.0),
    ("5 EUR", 5.0), (".5", 0.5), ("12.", 12.0), ("1.2.3", None), ("abc", None), ("", None),
    ("$ 1 234.50", 1234.5)])
def test_parse_amount(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_amount("t")).first()[0] == want


def test_parse_amount_parity(spark):
    df = spark.createDataFrame([("-5",), ("1e-05",), ("£2.50",)], "t string")
    assert [r[0] for r in df.select(parse_amount("t", parity=True)).collect()] == [5.0, 105.0, 2.5]


def test_revenue_series_switch(spark):
    s = _daily(spark, [1, 2, 3], d(2024, 1, 1))
    assert timeseries.revenue_series(s, "daily").count() == 3
    assert rows(timeseries.revenue_series(s, "weekly"), "revenue") == [(6.0,)]
    assert rows(timeseries.revenue_series(s, "monthly"), "revenue") == [(6.0,)]
    with pytest.raises(ValueError):
        timeseries.revenue_series(s, "hourly")


def test_retention_matrix_wide(spark):
    recs = [dict(customer_id="c1", date=d(2024, 1, 3), revenue=1),
            dict(customer_id="c1", date=d(2024, 3, 3), revenue=1)]
    m = cohort.retention_matrix(sales_df(spark, recs)).first()
    assert m["retention_pct"] == [100.0, None, 100.0]


def test_ltv_without_dates(spark):
    s = spark.createDataFrame([("a", 10.0, "o1"), ("a", 20.0, "o2"), ("b", 5.0, "o3")],
                              "customer_id string, revenue double, order_id string")
    out = {r["customer_id"]: r for r in ltv.customer_ltv(s).collect()}
    assert out["a"]["recency_days"] == 30 and out["a"]["customer_age_months"] == 6.0
    assert out["a"]["order_rate"] == pytest.approx(2 / 6)
    # churn 30/90, 12 months ahead: mean 15 x rate 1/3 x 8 months
    assert out["a"]["predicted_future_ltv"] == pytest.approx(15 * (2 / 6) * 12 * (1 - 30 / 90))


def test_missing_columns_give_typed_empty_frames(spark):
    s = spark.createDataFrame([(d(2024, 1, 1), 5.0)], "date timestamp_ntz, revenue double")
    assert products.top_products(s).columns == ["product", "revenue"]
    assert products.top_products(s).count() == 0
    assert basket.product_associations(s).count() == 0
    assert cohort.cohort_counts(s).columns == ["cohort_month", "period", "customers"]
    assert performance.product_performance(s).count() == 0


def test_recommend_for_product(spark):
    rules = spark.createDataFrame(
        [("A", "B", 0.1, 0.5, 2.0), ("B", "C", 0.1, 0.4, 3.0), ("A", "C", 0.1, 0.3, 1.5)],
        "product_a string, product_b string, support double, confidence double, lift double")
    got = [(r["recommended"], r["lift"]) for r in
           basket.recommend_for_product(rules, "C").orderBy("rank").collect()]
    assert got == [("B", 3.0), ("A", 1.5)]
    assert [r[0] for r in basket.rule_products(rules).collect()] == ["A", "B", "C"]


def test_segment_insights_actions(spark):
    summ = spark.createDataFrame([("Champions", 3, 10.0), ("At Risk", 2, 5.0)],
                                 "segment string, customers bigint, avg_monetary double")
    got = dict(rows(segments.segment_insights(summ), "segment", "action"))
    assert got == {"Champions": "reward_loyalty", "At Risk": "win_back_campaign"}
