"""Reading, mapping and cleaning raw sales files; currency detection."""

import difflib

from pyspark.sql import functions as F

from shared import rows
from tillroll.operators import clean, columns, currency
from tillroll.plans.ingest import load_sales, standardize
from tillroll.sources.csv import LATIN1, UTF8, detect_encodings

UK = ("InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"
      "536365,85123A,WHITE HEART,6,12/1/2010 8:26,£2.55,17850,United Kingdom\n"
      "536365,71053,WHITE LANTERN,6,12/1/2010 8:26,£3.39,17850,United Kingdom\n"
      "536366,22633,HAND WARMER,6,12/1/2010 8:28,£1.85,17850,United Kingdom\n"
      "536366,22632,HAND WARMER RED,6,12/1/2010 8:28,£1.85,17850,United Kingdom\n"
      "536367,84879,BIRD ORNAMENT,32,not a date,£1.69,13047,United Kingdom\n"
      "536368,22960,JAM SET,0,12/1/2010 8:34,£4.25,13047,France\n"
      "536369,21756,BATH BUILDING,,12/1/2010 8:35,£5.95,13047,France\n"
      "536370,21757,BATH TOWEL,0.5,12/1/2010 8:35,£5.95,13047,France\n")


def write(tmp_path, name, text, encoding="utf-8"):
    p = tmp_path / name
    p.write_bytes(text.encode(encoding))
    return str(p)


def test_encoding_detection(spark, tmp_path):
    a = write(tmp_path, "a.csv", UK, "latin-1")
    b = write(tmp_path, "b.csv", UK, "utf-8")
    enc = {k.rsplit("/", 1)[1]: v for k, v in detect_encodings(spark, [a, b]).items()}
    assert enc == {"a.csv": LATIN1, "b.csv": UTF8}


def test_load_uk_file(spark, tmp_path):
    path = write(tmp_path, "uk_retail.csv", UK, "latin-1")
    s, rep = load_sales(spark, path)
    methods = dict(rows(rep, "column_name", "method"))
    assert methods["UnitPrice"] == "exact" and methods["StockCode"] == "unmapped"
    got = rows(s, "product", "quantity", "revenue")
    # bad date, quantity 0 and 0.5 dropped; empty quantity -> 1; unit prices x quantity
    assert [g[0] for g in got] == ["BATH BUILDING", "HAND WARMER", "HAND WARMER RED",
                                   "WHITE HEART", "WHITE LANTERN"]
    by = {g[0]: g for g in got}
    assert by["BATH BUILDING"][1] == 1 and by["BATH BUILDING"][2] == 5.95
    assert abs(by["WHITE HEART"][2] - 2.55 * 6) < 1e-9
    assert {r[0] for r in s.select("region").distinct().collect()} == {"United Kingdom", "France"}


def test_total_price_beats_unit_price(spark):
    raw = spark.createDataFrame([("1", "2", "10.0", "20.0")],
                                "order_id string, quantity string, unit_price string, total_price string")
    df, rep = standardize(raw, sniff=False)
    assert dict(rows(rep.filter(F.col("method") == "exact"), "column_name", "standard")) == {
        "order_id": "order_id", "quantity": "quantity", "total_price": "revenue"}
    assert "unit_price" in df.columns and "revenue" in df.columns


def test_fuzzy_and_suggestions(spark):
    cat = columns.header_catalog(spark, {"f": ["Ordr Date", "custmr", "zzz_q"]})
    exact = columns.match_columns_exact(cat)
    assert exact.count() == 0
    fz = {r["column_name"]: r for r in columns.match_columns_fuzzy(cat, exact).collect()}
    assert fz["Ordr Date"]["standard"] == "date" and fz["Ordr Date"]["method"] == "fuzzy"
    want = difflib.SequenceMatcher(None, "custmr", "customer").ratio()
    assert fz["custmr"]["standard"] == "customer_id"
    assert abs(fz["custmr"]["score"] - want) < 1e-12 or fz["custmr"]["score"] >= want
    assert "zzz_q" not in fz


def test_content_sniffing(spark):
    raw = spark.createDataFrame(
        [(f"2024-01-{i % 28 + 1:02d}", f"{10 + i * 1.37:.2f}", str(i % 5 + 1), f"item {i}",
          ["x", "y", "z"][i % 3]) for i in range(60)],
        "c1 string, c2 string, c3 string, c4 string, c5 string")
    df, rep = standardize(raw)
    sniffed = dict(rows(rep.filter(F.col("method") == "sniffed"), "column_name", "standard"))
    assert sniffed == {"c1": "date", "c2": "revenue", "c3": "quantity", "c4": "product",
                       "c5": "category"}


def test_unit_price_rule(spark):
    unit = spark.createDataFrame(
        [("o1", 2.5, 6), ("o1", 2.5, 3), ("o2", 1.0, 2), ("o2", 1.0, 4), ("o3", 9.0, 1)],
        "order_id string, revenue double, quantity int")
    assert clean.unit_price_flag(unit).first()[0] is True
    totals = spark.createDataFrame(
        [("o1", 12.5, 6), ("o1", 3.0, 3), ("o2", 1.0, 2), ("o2", 40.0, 4), ("o3", 9.0, 1)],
        "order_id string, revenue double, quantity int")
    assert clean.unit_price_flag(totals).first()[0] is False
    fixed = clean.fix_unit_price(unit)
    assert [r[0] for r in rows(fixed, "revenue")] == [2.0, 4.0, 7.5, 9.0, 15.0]
    assert rows(clean.fix_unit_price(totals, unit_price=False), "revenue") == rows(totals, "revenue")


def test_clean_quantity_and_dates(spark):
    raw = spark.createDataFrame([("2024-01-02", "3"), ("bad", "1"), ("1/5/2024 10:00", None),
                                 ("2024-02-01", "0"), ("2024-02-02", "0.5")],
                                "date string, quantity string")
    out = clean.clean_quantity(clean.clean_date(raw)).collect()
    assert [(r["date"].month, r["date"].day, r["quantity"]) for r in out] == [(1, 2, 3), (1, 5, 1)]


def test_currency_from_files(spark, tmp_path):
    uk = write(tmp_path, "uk.csv", UK, "latin-1")
    eu = write(tmp_path, "eu.csv", "date,amount\n2024-01-02,€10\n2024-01-03,€12\n2024-01-04,$3\n")
    au = write(tmp_path, "au.csv", "date,amount\n2024-01-02,A$10\n2024-01-03,A$12\n")
    got = {r["path"].rsplit("/", 1)[1]: r["code"]
           for r in currency.currency_from_files(spark, [uk, eu, au]).collect()}
    assert got == {"uk.csv": "GBP", "eu.csv": "EUR", "au.csv": "AUD"}
    par = {r["path"].rsplit("/", 1)[1]: r["code"]
           for r in currency.currency_from_files(spark, [uk, eu, au], parity=True).collect()}
    assert par == {"uk.csv": "GBP", "eu.csv": "EUR", "au.csv": "USD"}


def test_currency_from_region_and_name(spark):
    regions = spark.createDataFrame([("Australia",), ("Australia",), ("Austria",)], "region string")
    assert currency.currency_from_region(regions).first()[0] == "AUD"
    assert currency.currency_from_region(regions, parity=True).first()[0] == "USD"
    names = spark.createDataFrame([("uk_retail.csv",), ("olist_orders.csv",), ("misc.csv",)],
                                  "source_name string")
    got = dict(rows(currency.currency_from_name(names), "source_name", "code"))
    assert got == {"uk_retail.csv": "GBP", "olist_orders.csv": "BRL", "misc.csv": None}
    d = F.lit(None).cast("string")
    assert spark.range(1).select(currency.detect_currency(d, d, d)).first()[0] == "USD"


def test_availability_and_overview(spark):
    s = spark.createDataFrame([("a", 1.0)], "product string, revenue double")
    av = {r["module"]: r["available"] for r in columns.column_availability(s).collect()}
    assert av["products"] is True and av["basket"] is False and av["sales"] is False
    ov = columns.dataset_overview(s).first()
    assert ov["rows"] == 1 and ov["columns"] == 2


def test_overrides_and_duplicates(spark):
    raw = spark.createDataFrame([("x", "1")], "mystery string, qty string")
    df, rep = standardize(raw, overrides={"mystery": "product"}, sniff=False)
    assert set(df.columns) == {"product", "quantity"}
    assert ("mystery", "manual") in rows(rep, "column_name", "method")
    # a manual choice replaces a wrong automatic one
    df, rep = standardize(raw, overrides={"mystery": "quantity"}, sniff=False)
    assert set(df.columns) == {"quantity", "qty"} and df.first()["quantity"] == "x"
    assert ("qty", "unmapped") in rows(rep, "column_name", "method")


def test_load_sample_latin1_and_empty(spark, tmp_path):
    from tillroll.plans.ingest import load_sample
    import pytest

    path = write(tmp_path, "uk_retail.csv", UK, "latin-1")
    s, _ = load_sample(spark, path)
    assert s.count() == 5
    empty = write(tmp_path, "empty.csv", "date,amount\n")
    with pytest.raises(ValueError):
        load_sample(spark, empty)
