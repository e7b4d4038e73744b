"""Steps whose cost must not grow faster than the tables."""

from pyspark.sql import functions as F

from shared import rows
from tillroll.operators import churn, clean, columns, profiles
from tillroll.operators.currency import symbol_counts
from tillroll.plans import catalog
from tillroll.sources import fixtures

NUMBERS = ["1", " 2.5 ", "-3", "+.5", "1e3", "NaN", "-inf", "Infinity", "0x1p3", "\t7", "", " ", "x1", "n/a", "name", "٣", "--1", "1 2"]
DATES = {"2024-03-05": "2024-03-05 00:00:00", "3/5/2024": "2024-03-05 00:00:00", "13.5.2024 9:05": "2024-05-13 09:05:00",
         "3/5/24 5:30 pm": "2024-03-05 17:30:00", "20240305": "2024-03-05 00:00:00", "2024/003/5": "2024-03-05 00:00:00",
         "5-Mar-2024": "2024-03-05 00:00:00", "5 march 2024": "2024-03-05 00:00:00", "Mar 5, 2024": "2024-03-05 00:00:00",
         "May 5 2024": None, "item, 12": None, "12": None, "32/13/2024": None, "": None}


def test_most_words_meet_no_parser_and_numbers_stay(spark):
    df = spark.createDataFrame([(t,) for t in NUMBERS], "t string")
    assert df.where(~columns.number_of(F.col("t")).eqNullSafe(F.col("t").try_cast("double"))).collect() == []


def test_dates_of_every_shape_are_parsed_outside_the_generated_method(spark):
    df = spark.createDataFrame(list(DATES), "string").select("value", columns.parse_timestamp(F.col("value")).cast("string").alias("d"))
    assert {r["value"]: r["d"] for r in df.collect()} == DATES
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" in plan


def test_symbols_are_counted_without_overlap(spark):
    texts = ["A$1 $2 $$", "R$C$£", "", "€€ ₹¥", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(*[n.alias(c) for c, n in symbol_counts(F.col("t"))])
    assert [r.asDict() for r in df.collect()][0] == {"GBP": 0, "USD": 3, "EUR": 0, "INR": 0, "JPY": 0, "AUD": 1, "CAD": 0, "BRL": 0}
    assert [tuple(r)[:2] for r in df.collect()] == [(0, 3), (1, 0), (0, 0), (0, 0), (None, None)]


def test_a_profile_parses_every_cell_once(spark):
    """No aggregate holds a parser: values, numbers and dates are columns below."""
    values = spark.createDataFrame([("f", 0, "£5"), ("f", 0, "13/2/2024"), ("f", 0, "2/13/2024"), ("f", 0, "7")], "file_id string, position int, value string")
    found = profiles.profile_sketches(values)
    r = found.first()
    assert (r["non_null"], r["numeric"], r["dates"], r["day_first"], r["month_first"], r["symbols"]["GBP"]) == (4, 1, 2, 1, 1, 1)
    for df in (found, columns.profile_columns(values, ["value"])):
        plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert not any("gettimestamp" in line.lower() for line in plan if line.strip(" +-:").startswith("Aggregate"))


def test_typed_rows_are_written_once(spark):
    raw = spark.createDataFrame([("1/2/2024", "$2.50", "3", "o1"), ("1/3/2024", "$2.50", "2", "o1"), ("x", "$1", "1", "o2")],
                                "date string, revenue string, quantity string, order_id string")
    out = catalog._cleaned(raw)
    assert rows(out) == rows(clean.clean_sales(raw))
    assert "gettimestamp" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def tables(spark, folder, lines=400):
    n = spark.range(lines)
    put = lambda df, name: df.write.parquet(f"{folder}/{name}.parquet")
    key = F.when(F.col("id") % 50 != 0, F.col("id") % 90)
    put(n.select(key.alias("l_orderkey"), (F.col("id") % 7).alias("l_partkey"), F.lit(10.0).alias("l_extendedprice"),
                 F.lit(0.1).alias("l_discount"), F.lit(2.0).alias("l_quantity")), "lineitem")
    put(spark.range(90).select(F.col("id").alias("o_orderkey"), F.lit("1997-01-01").cast("timestamp").alias("o_orderdate"),
                               (F.col("id") % 9).alias("o_custkey")), "orders")
    put(spark.range(7).selectExpr("id AS p_partkey", "concat('p', id) AS p_name", "'t' AS p_type"), "part")
    put(spark.range(9).selectExpr("id AS c_custkey", "id % 2 AS c_nationkey"), "customer")
    put(spark.range(2).selectExpr("id AS n_nationkey", "concat('n', id) AS n_name"), "nation")
    return str(folder)


def test_line_joins_get_tasks_by_their_rows(spark, tmp_path, monkeypatch):
    folder = tables(spark, tmp_path)
    before = rows(fixtures.sales(spark, folder))
    monkeypatch.setattr(fixtures, "LINES_A_TASK", 10)
    out = fixtures.sales(spark, folder)
    assert fixtures.line_tasks(fixtures.table(spark, folder, "lineitem")) == 40
    assert rows(out) == before and "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


def test_forest_is_fitted_by_many_tasks(spark, monkeypatch):
    """The rows of many customers are spread before the trees pass over them."""
    kept = []
    monkeypatch.setattr(churn, "CUSTOMERS_A_TASK", 40)
    cut = churn.cut_lineage
    monkeypatch.setattr(churn, "cut_lineage", lambda df: kept.append(cut(df)) or kept[-1])
    f = spark.range(200).selectExpr("id AS customer_id", *[f"CAST(id % {i + 3} AS double) AS {c}" for i, c in enumerate(churn.FEATURES)],
                                    "CAST(id % 2 AS int) AS churned").coalesce(1)
    model = churn.fit_churn(f, num_trees=2, max_depth=2)
    assert model.method == "model" and [k.rdd.getNumPartitions() for k in kept][-1] == 5 and kept[-1].count() == 200
