"""Ordinary but awkward input: date spellings, null markers, mixed encodings,
zero totals, NULL revenue, rare classes, empty frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shared import rows
from tillroll.operators import _common, churn, clean, cohort, columns, customers, kpi, ltv, performance, products, timeseries
from tillroll.operators.columns import parse_timestamp
from tillroll.plans.ingest import load_currency, load_files, load_sales, preview
from tillroll.session import checkpoint_dir
from tillroll.sources.csv import read_sales_csv

T = dt.datetime
SPELLINGS = {
    "2024-01-02": T(2024, 1, 2), "2024-01-02 10:11:12.123": T(2024, 1, 2, 10, 11, 12, 123000),
    "2024-01-02T10:11:12Z": T(2024, 1, 2, 10, 11, 12), "2024-01-02T10:11:12+02:00": T(2024, 1, 2, 8, 11, 12),
    "12/1/2010 8:26": T(2010, 12, 1, 8, 26), "12/1/2010 8:26 AM": T(2010, 12, 1, 8, 26),
    "12/1/2010 8:26:30 PM": T(2010, 12, 1, 20, 26, 30), "25/12/2010": T(2010, 12, 25), "25.12.2010": T(2010, 12, 25),
    "1/2/24": T(2024, 1, 2), "20240102": T(2024, 1, 2), "December 1, 2010": T(2010, 12, 1), "1 Dec 2010": T(2010, 12, 1),
    "1-Dec-2010": T(2010, 12, 1), "2010/12/1": T(2010, 12, 1),
    "2024": None, "12345678": None, "soon": None, "": None, "2024-13-45": None, "99/99/2010": None, None: None,
}


def test_date_spellings(spark):
    df = spark.createDataFrame([(k,) for k in SPELLINGS], "s string")
    got = {r["s"]: r["t"] for r in df.select("s", parse_timestamp(F.col("s")).alias("t")).collect()}
    assert got == SPELLINGS


def test_day_first_is_chosen_by_the_column(spark):
    days = spark.createDataFrame([("3/4/2024",), ("25/12/2023",), ("26/12/2023",), ("1/13/2024",)], "date string")
    assert sorted(r["date"] for r in clean.clean_date(days).collect()) == [
        T(2023, 12, 25), T(2023, 12, 26), T(2024, 1, 13), T(2024, 4, 3)]
    assert T(2024, 3, 4) in [r["date"] for r in clean.clean_date(days, day_first=False).collect()]
    rep = clean.date_report(days.union(spark.createDataFrame([("?",), (None,)], "date string"))).first()
    assert tuple(rep) == (5, 4, 1)


def test_typed_dates_pass(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-02 03:04:05.678901' AS date UNION ALL SELECT NULL")
    assert [r["date"] for r in clean.clean_date(df).collect()] == [T(2024, 1, 2, 3, 4, 5, 678901)]


def test_quantities_out_of_range(spark):
    df = spark.createDataFrame([(s,) for s in ("99999999999", "NaN", "inf", "1e30", "0", "2.9", None, "x")], "quantity string")
    assert sorted(r["quantity"] for r in clean.clean_quantity(df).collect()) == [1, 1, 1, 1, 2, 99999999999]


def test_profile_with_dots_and_empty_columns(spark):
    df = spark.createDataFrame([("a", None, "1.5"), ("b", None, "2")], "`zz.qq` string, e string, n string")
    got = {r["column_name"]: r for r in columns.profile_columns(df, ["zz.qq", "e", "n"]).collect()}
    assert got["e"]["non_null"] == 0 and got["e"]["date_rate"] is None and got["n"]["numeric_rate"] == 1.0
    assert columns.sniff_pick([r.asDict() for r in got.values()], set()) == {"zz.qq": "category", "n": "revenue"}


HEAD = "InvoiceNo,Description,InvoiceDate,UnitPrice,Quantity,CustomerID,Country\n"


def test_mixed_encodings_null_markers_and_currency(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_bytes((HEAD + "1,Caf\u00e9 \u00a3,12/1/2010 8:26,5,1,NA,France\n").encode("latin-1"))
    (tmp_path / "in/b.csv").write_bytes((HEAD + "2,Caf\u00e9 \u20ac \u20ac,13/1/2010 8:26,6,1,7,n/a\n").encode("utf-8"))
    raw = read_sales_csv(spark, str(tmp_path / "in"))
    assert sorted(r["Description"][:4] for r in raw.collect()) == ["Caf\u00e9", "Caf\u00e9"]
    assert rows(raw, "InvoiceNo", "CustomerID", "Country") == [("1", None, "France"), ("2", "7", None)]
    sales, _ = load_sales(spark, str(tmp_path / "in"))
    assert sales.count() == 2 and preview(sales, 1).count() == 1
    codes = {r["path"].rsplit("/", 1)[1]: r["code"] for r in load_currency(spark, str(tmp_path / "in"), sales).collect()}
    assert codes == {"a.csv": "GBP", "b.csv": "EUR"}


def test_several_files_with_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,amount,cust_id\n2024-01-02,5.5,c1\n")
    (tmp_path / "b.csv").write_text("Order Date,Sales,Product Name\n2/1/2024,$1,bag\n")
    out = load_files(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert rows(out, "revenue", "customer_id", "product") == [(1.0, None, "bag"), (5.5, "c1", None)]


def frame(spark, recs):
    return spark.createDataFrame(recs, "date timestamp_ntz, revenue double, customer_id string, product string, "
                                       "category string, order_id string, quantity int")


def test_zero_totals_and_zero_months(spark):
    s = frame(spark, [(T(2024, m, 3), 0.0, "c", "p", f"k{m % 2}", f"o{m}", 1) for m in range(1, 8)])
    assert [r["mom_growth"] for r in timeseries.monthly_growth(s).collect()] == [None] * 7
    assert timeseries.seasonality_stats(s).first()["cv"] is None
    assert {r["percentage"] for r in products.revenue_by_category(s).collect()} == {None}
    assert products.product_pareto(s).first()["cumulative_pct"] is None
    assert products.product_concentration(s).first()["top3_pct"] is None
    assert products.customer_concentration(s).first()["top5_pct"] is None
    assert ltv.ltv_insights(ltv.customer_ltv(s)).first()["platinum_ltv_pct"] is None
    assert kpi.kpi_summary(s).count() == 1


def test_null_revenue_counts_in_no_mean(spark):
    s = frame(spark, [(T(2024, 1, 3), 10.0, "c", "p", "k", "o", 1), (T(2024, 1, 4), None, "c", "p", "k", "o", 1)])
    assert customers.customer_features(s).first()["avg_order_value"] == 10.0
    r = performance.product_performance(s).first()
    assert (r["order_count"], r["avg_price"]) == (1, 10.0)


def test_empty_input(spark):
    s = frame(spark, [])
    scores = churn.churn_rule(s)
    assert churn.churn_insights(scores).first()["high_risk_pct"] is None
    assert cohort.retention_matrix(s).count() == 0 and products.product_pareto(s).count() == 0


def test_series_frequencies(spark):
    s = frame(spark, [(T(2024, 2, 3), 1.0, "c", "p", "k", "o", 1), (T(2024, 2, 9), 2.0, "c", "p", "k", "o", 1)])
    assert [tuple(r) for r in timeseries.time_series(s, "m").collect()] == [(dt.date(2024, 2, 29), 3.0)]
    with pytest.raises(ValueError):
        timeseries.time_series(s, "Q")


def test_rare_class_is_split_or_falls_back(spark):
    def sales(stale):
        return frame(spark, [(T(2024, 6, 1) - dt.timedelta(days=200 if i < stale else i % 20), 5.0 + i, f"c{i}", "p", "k", f"o{i}", 1)
                             for i in range(40)])
    scores, metrics = churn.train_churn(sales(2), num_trees=3)
    assert set(metrics) == {"auc", "accuracy"} and {r[0] for r in scores.select("method").distinct().collect()} == {"model"}
    scores, metrics = churn.train_churn(sales(1), num_trees=3)
    assert metrics == {} and {r[0] for r in scores.select("method").distinct().collect()} == {"rule"}


@pytest.mark.parametrize("parts", [3, 256])
def test_running_totals(spark, parts):
    data = [(f"p{i:03d}", (i * 37 % 50) * 1.0) for i in range(300)]
    out = _common.running_totals(spark.createDataFrame(data, "k string, v double"), "v", "k", parts)
    run, want = 0.0, []
    for rank, (k, v) in enumerate(sorted(data, key=lambda x: (-x[1], x[0])), 1):
        run += v
        want.append((rank, k, run))
    assert sorted((r["rank"], r["k"], r["running"]) for r in out.collect()) == want


def test_intermediates_belong_to_their_scope(spark):
    s = frame(spark, [(T(2024, 1, 3), 10.0, "c", "p", "k", "o", 1)]).cache()
    with _common.intermediates() as mine:
        first = churn.churn_rule(s)
        first.collect()
    with _common.intermediates() as other:
        products.customer_concentration(s).collect()
    assert mine and other and all(f.is_cached for f in mine)
    _common.release(other)
    assert all(f.is_cached for f in mine) and first.count() == 1
    _common.release(mine)
    assert first.count() == 1


def test_checkpoint_folder_of_the_caller_wins(spark, tmp_path):
    assert checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    assert str(tmp_path) in checkpoint_dir(spark)
    spark.sparkContext.setCheckpointDir(before.rsplit("/", 1)[0])
