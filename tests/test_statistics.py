"""Order and rank statistics, distinct counts that roll up, saved models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shared import SF_SMALL, rows
from tillroll.operators import basket, churn, ltv, rollups, segments, stats
from tillroll.operators.timeseries import monthly_revenue
from tillroll.sources import fixtures


def jobs_of(spark, name, action):
    spark.sparkContext.setJobGroup(name, name)
    out = action()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setJobGroup("", "")
    return out, n


@pytest.mark.parametrize("n", [1, 2, 3, 8, 9, 101, 4000])
def test_quantiles_of_every_size(spark, n):
    r = np.random.default_rng(n)
    v = np.round(r.normal(size=n), 1 if n % 2 else 9)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    probs = {f"p{i}": i / 10 for i in range(11)}
    got = stats.quantiles(df, "v", probs, accuracy=100).first()
    assert [got[k] for k in probs] == [float(np.percentile(v, p * 100)) for p in probs.values()]


def test_quantiles_of_hot_and_missing_values(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.col("id") / 7).alias("v"))
    v = [5.0 if i % 3 == 0 else i / 7 for i in range(9000)]
    got = stats.quantiles(df, "v", {"a": 0.01, "b": 0.3, "c": 0.99}, accuracy=50).first()
    assert tuple(got) == tuple(float(np.percentile(v, p)) for p in (1, 30, 99))
    assert tuple(stats.quantiles(df.where("v < 0"), "v", {"a": 0.5}).collect()[0]) == (None,)


def test_segments_start_no_job(spark):
    sales = fixtures.sales(spark, SF_SMALL)
    out, n = jobs_of(spark, "ltv", lambda: ltv.customer_ltv(sales))
    assert n == 0 and out.count() > 0
    scores, n = jobs_of(spark, "churn", lambda: churn.churn_insights(churn.churn_rule(sales)))
    assert n == 0 and scores.count() == 1


@pytest.mark.parametrize("parts", [2, 256])
def test_auc_with_ties_and_groups(spark, parts):
    r = np.random.default_rng(3)
    data = [(g, int(y), float(s)) for g in "ab" for y, s in zip(r.integers(0, 2, 300), r.integers(0, 30, 300))]
    data += [("c", 1, 0.5)] + [("a", None, 1.0), ("a", 1, None)]
    df = spark.createDataFrame(data, "g string, y int, s double")
    got = {r["g"]: r["auc"] for r in stats.auc(df, "y", "s", by=("g",), parts=parts).collect()}
    for g in "ab":
        pos, neg = ([s for h, y, s in data if h == g and y == k and s is not None] for k in (1, 0))
        want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
        assert got[g] == pytest.approx(want, rel=1e-12)
    assert got["c"] is None
    one = stats.auc(df.where("g = 'a'").drop("g"), "y", "s", parts=parts).first()
    assert one["auc"] == got["a"]


def test_days_roll_up(spark):
    sales = fixtures.sales(spark, SF_SMALL)
    days = rollups.daily_sketches(sales)
    halves = rollups.daily_sketches(sales.where("order_id % 2 = 0")).unionByName(rollups.daily_sketches(sales.where("order_id % 2 = 1")))
    exact = {r["month"]: r for r in monthly_revenue(sales).collect()}
    for table in (days, rollups.merge_days(halves)):
        for r in rollups.roll_up(table, "month").collect():
            want = exact[r["month"]]
            assert abs(r["orders"] - want["orders"]) <= 1 + rollups.ERROR_BOUND * want["orders"]
            assert abs(r["customers"] - want["customers"]) <= 1 + rollups.ERROR_BOUND * want["customers"]
            assert r["revenue"] == pytest.approx(want["revenue"], rel=1e-12)
    total = rollups.roll_up(days).first()
    n = sales.select(F.countDistinct("order_id")).first()[0]
    assert total["lines"] == sales.count() and abs(total["orders"] - n) <= 1 + rollups.ERROR_BOUND * n
    none = rollups.roll_up(rollups.daily_sketches(sales.select("revenue")))
    assert none.first()["customers"] == 0


def test_a_model_is_trained_once(spark, monkeypatch):
    from pyspark.ml import Pipeline

    sales = fixtures.sales(spark, SF_SMALL)
    scores, metrics = churn.train_churn(sales, num_trees=5)

    def refuse(self, *args):
        raise AssertionError("trained again")

    monkeypatch.setattr(Pipeline, "fit", refuse)
    again, same = churn.train_churn(sales.repartition(7), num_trees=5)
    assert same == metrics and rows(again, "customer_id", "churn_probability") == rows(scores, "customer_id", "churn_probability")
    assert dict(rows(churn.churn_metrics(sales, num_trees=5), "metric", "value")) == metrics
    with pytest.raises(AssertionError):
        churn.train_churn(sales, num_trees=6)
    few = sales.where("customer_id < 3")
    assert churn.fit_churn(churn.model_features(few)).method == "rule"


def test_pairs_of_long_baskets_are_dealt_out(spark, monkeypatch):
    """Baskets of one and of two hundred items, a third of them alike: the same
    pairs as by loops, however long baskets are cut."""
    r = np.random.default_rng(1)
    orders = {f"o{i}": sorted(set(r.integers(0, 250, 200 if i == 0 else int(r.integers(1, 9))).tolist())) for i in range(80)}
    orders |= {f"x{i}": [3, 7, 9] for i in range(40)}
    sales = spark.createDataFrame([(o, f"p{p:03d}", 1.0) for o, ps in orders.items() for p in ps], "order_id string, product string, revenue double")
    want = {}
    for ps in orders.values():
        for i, a in enumerate(ps):
            for b in ps[i + 1:]:
                want[f"p{a:03d}", f"p{b:03d}"] = want.get((f"p{a:03d}", f"p{b:03d}"), 0) + 1
    for limit in (128, 2):
        monkeypatch.setattr(basket, "LONG_BASKET", limit)
        items, pairs, total = basket.cooccurrence(sales)
        assert {(p["product_a"], p["product_b"]): p["both"] for p in pairs.collect()} == want
        assert total.first()["n"] == 120 and items.count() == len({p for ps in orders.values() for p in ps})
    plan = pairs._jdf.queryExecution().analyzed().toString()
    assert "RepartitionByExpression" in plan


def test_clusters_do_not_depend_on_partitions(spark):
    sales = fixtures.sales(spark, SF_SMALL)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for parts in (3, 300):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got.append(rows(segments.lloyd_segments(sales.repartition(parts)), "customer_id", "cluster", "segment"))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] and len({c for _, c, _ in got[0]}) == 4 and {s for _, _, s in got[0]} == set(segments.SEGMENT_LABELS)


def test_clusters_of_few_and_equal_customers(spark):
    frame = lambda n: spark.createDataFrame([(f"c{i}", 5.0, "2024-01-02", f"o{i}") for i in range(n)],
                                            "customer_id string, revenue double, date string, order_id string").withColumn(
                                                "date", F.col("date").cast("timestamp_ntz"))
    for n in (1, 2, 50):
        out = segments.lloyd_segments(frame(n), label=False).collect()
        assert len(out) == n and len({r["cluster"] for r in out}) == 1
    assert segments.lloyd_segments(frame(1).limit(0), label=False).collect() == []
