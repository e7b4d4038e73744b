"""Many files with headers of their own: headers, mapping, profiles, loading."""

import difflib
import itertools

import pytest
from pyspark.sql import functions as F

from shared import rows
from tillroll.operators import clean, columns, profiles
from tillroll.plans.files import load_cells, load_tables
from tillroll.plans.ingest import load_files, load_sales
from tillroll.sources.csv import LATIN1, UTF8, cells_of_files, file_headers, read_sales_csv, split_line


def put(folder, name, text, encoding="utf-8"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(text.encode(encoding))
    return str(folder / name)


@pytest.fixture
def folder(tmp_path):
    """Same lines, other column orders, names and column sets."""
    f = tmp_path / "in"
    put(f, "a.csv", "order_id,total_price,quantity\nA,10.5,2\n")
    put(f, "b.csv", "quantity,order_id,total_price\n3,B,99.5\n")
    put(f, "c.csv", "Qty,\"Order, ID\",Total Price,Café\n4,C,7,x\n", "latin-1")
    put(f, "d.csv", "")
    put(f, "e.csv", "total_price,order_id\n")
    return str(f)


def test_lines_of_cells(spark):
    lines = ["a,b", "", ",", "\"x, y\",z", "\"say \"\"hi\"\"\",", "a,,b", "\"\",\"q\""]
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, line string")
    assert [r[1] for r in df.select("i", split_line(F.col("line"))).orderBy("i").collect()] == \
        [["a", "b"], [""], ["", ""], ["x, y", "z"], ['say "hi"', ""], ["a", "", "b"], ["", "q"]]


def test_headers_and_encodings(spark, folder):
    got = {r["file_id"].rsplit("/", 1)[1]: (r["encoding"], r["header"]) for r in file_headers(spark, folder).collect()}
    assert got == {"a.csv": (UTF8, ["order_id", "total_price", "quantity"]), "b.csv": (UTF8, ["quantity", "order_id", "total_price"]),
                   "c.csv": (LATIN1, ["Qty", "Order, ID", "Total Price", "Café"]), "e.csv": (UTF8, ["total_price", "order_id"])}
    cells = {r["file_id"].rsplit("/", 1)[1]: r["cells"][:4] for r in cells_of_files(spark, file_headers(spark, folder)).collect()}
    assert cells == {"a.csv": ["A", "10.5", "2"], "b.csv": ["3", "B", "99.5"], "c.csv": ["4", "C", "7", "x"]}


def test_folder_is_read_by_names(spark, folder):
    raw = read_sales_csv(spark, folder)
    assert raw.columns == ["order_id", "total_price", "quantity", "Qty", "Order, ID", "Total Price", "Café"]
    assert rows(raw.where("order_id IS NOT NULL"), "order_id", "total_price", "quantity") == [("A", "10.5", "2"), ("B", "99.5", "3")]
    assert rows(raw.where("order_id IS NULL"), "Qty", "Order, ID", "Café") == [("4", "C", "x")]


def test_folder_is_loaded_by_each_header(spark, folder):
    sales, report = load_sales(spark, folder)
    assert rows(sales, "order_id", "revenue", "quantity") == [("A", 10.5, 2), ("B", 99.5, 3), ("C", 7.0, 4)]
    assert {r["method"] for r in report.where("standard = 'order_id'").collect()} == {"exact", "fuzzy"}
    loaded = load_tables(spark, folder, sniff=False)
    assert set(loaded.sales.columns) == {"file_id", "order_id", "revenue", "quantity"}


def test_no_job_and_no_plan_grows_with_the_files(spark, tmp_path):
    """Sixty files with twenty headers: one scan of text and one of cells."""
    f = tmp_path / "many"
    orders = list(itertools.permutations(["date", "amount", "cust_id", "sku"]))[:20]
    for i in range(60):
        names = orders[i % 20]
        value = {"date": "2024-01-02", "amount": str(i + 1), "cust_id": f"c{i}", "sku": "p"}
        put(f, f"{i:02d}.csv", ",".join(names) + "\n" + ",".join(value[n] for n in names) + "\n")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("many", "many files")
    out = load_files(spark, str(f))
    assert rows(out, "revenue", "customer_id", "product") == sorted((float(i + 1), f"c{i}", "p") for i in range(60))
    many = len(jobs.getJobIdsForGroup("many"))
    spark.sparkContext.setJobGroup("few", "one file")
    load_files(spark, str(f / "00.csv")).collect()
    few = len(jobs.getJobIdsForGroup("few"))
    spark.sparkContext.setJobGroup("", "")
    assert many <= few + 6


def greedy(names, taken):
    """Fuzzy choice column by column, written as loops."""
    out = {}
    for name in names:
        norm = name.strip().lower().replace(" ", "_")
        best = None
        for std, group in columns.COLUMN_ALIASES.items():
            if std in taken:
                continue
            ratios = [difflib.SequenceMatcher(None, norm, std).ratio()]
            ratios += [difflib.SequenceMatcher(None, norm.replace("_", ""), a.replace("_", "")).ratio() for a in group]
            if best is None or max(ratios) > best[1]:
                best = (std, max(ratios))
        if best and best[1] >= 0.65:
            out[name] = (best[0], "fuzzy" if best[1] >= 0.82 else "suggestion")
            if best[1] >= 0.82:
                taken = taken | {best[0]}
    return out


def test_fuzzy_choice_against_loops(spark):
    files = {"a": ["Ordr Date", "Dtae", "custmr", "Prodct", "Product Nme", "zzz"], "b": ["Regionn", "Region2", "Catgory", "unit prices", "", "a b"],
             "c": ["Quantty", "Quantitty", "invoise", "Amountt", "Totall"], "d": ["date", "Dates", "datetimes", "cust name", "buyer"]}
    catalog = columns.header_catalog(spark, files)
    exact = columns.exact_matches(catalog)
    taken = {r["file_id"]: {r["standard"]} for r in exact.collect()}
    got = {}
    for r in columns.fuzzy_matches(catalog, exact).collect():
        got.setdefault(r["file_id"], {})[r["column_name"]] = (r["standard"], r["method"])
    for name, heads in files.items():
        given = taken.get(name, set())
        assert got.get(name, {}) == greedy([h for h in heads if not (name == "d" and h == "date")], given), name


def values_of(spark, n=3000):
    day = F.date_add(F.lit("2024-01-01"), (F.col("id") % 300).cast("int"))
    cells = F.array(F.col("id").cast("string"), F.concat(F.lit("v"), F.col("id") % 21 + F.col("id") % 2),
                    F.concat(F.lit("£"), F.col("id") / 4), F.date_format(day, "dd/MM/yyyy"))
    return profiles.cell_values(spark.range(n).select(F.concat(F.lit("f"), F.col("id") % 2).alias("file_id"), cells.alias("cells")))


def test_half_profiles_merge_to_the_whole(spark):
    v = values_of(spark)
    whole = profiles.profile_sketches(v)
    half = F.xxhash64("value") % 2 == 0
    merged = profiles.merge_sketches(profiles.profile_sketches(v.where(half)).unionByName(profiles.profile_sketches(v.where(~half))))
    same = ["file_id", "position", *profiles.COUNTS, "number_sum", "all_integer", "symbols"]
    assert sorted(map(str, whole.select(*same).collect())) == sorted(map(str, merged.select(*same).collect()))
    truth = {(r["file_id"], r["position"]): r["n"] for r in v.groupBy("file_id", "position").agg(F.countDistinct("value").alias("n")).collect()}
    for df in (whole, merged):
        for r in profiles.column_profiles(df).collect():
            assert abs(r["distinct"] - truth[r["file_id"], r["position"]]) <= 0.06 * truth[r["file_id"], r["position"]]
            if r["position"] == 0:
                assert all(abs(q - want) <= 0.04 * 3000 for q, want in zip(r["quartiles"], (750, 1500, 2250)))
    exact = profiles.exact_distinct(v, profiles.column_profiles(whole))
    assert {(r["file_id"], r["position"]): r["distinct"] for r in exact.where("position = 1").collect()} == \
        {k: n for k, n in truth.items() if k[1] == 1}
    orders = whole.where("position = 3").select((F.col("day_first") > F.col("month_first")).alias("d")).collect()
    assert all(r["d"] for r in orders)


def test_contents_prices_orders_and_overrides_per_file(spark):
    """One file names its columns by contents, one has unit prices, one a price
    column only, one is unknown; dates are day first in one of them."""
    heads = {"s": ["x1", "x2", "x3", "x4"], "u": ["order_id", "amount", "qty", "date"], "p": ["list price", "qty", "order_date"],
             "n": ["foo", "bar"], "m": ["mystery", "amount"]}
    data = [("s", [f"2024-01-{i % 28 + 1:02d}", f"{10 + i * 1.37:.2f}", str(i % 5 + 1), f"item {i}"]) for i in range(60)]
    data += [("u", [f"o{i // 2}", "2.5", "3", f"{i % 28 + 1}/2/2024"]) for i in range(40)]
    data += [("p", ["$1,000.50", "2", "1/31/2024"]), ("p", ["5", "0", "1/31/2024"]), ("p", ["-5", "1", "1/31/2024"])]
    data += [("n", [None, ""]), ("m", ["bag", "4"]), ("m", [None, "x"])]
    cells = spark.createDataFrame(data, "file_id string, cells array<string>")
    found = load_cells(cells, columns.header_catalog(spark, heads), overrides={"Mystery": "product"})
    out = found.sales.collect()
    by = lambda f: [r for r in out if r["file_id"] == f]
    assert len(by("s")) == 60 and {r["product"] for r in by("s")} == {f"item {i}" for i in range(60)}
    assert {r["revenue"] for r in by("u")} == {7.5} and {r["date"].month for r in by("u")} == {2}
    assert [(r["revenue"], r["quantity"]) for r in by("p")] == [(2001.0, 2)]
    assert by("n") == [] and [(r["product"], r["revenue"], r["date"]) for r in by("m")] == [("bag", 4.0, None)]
    report = {(r["file_id"], r["column_name"]): r["method"] for r in found.report.collect()}
    assert report["s", "x2"] == "sniffed" and report["m", "mystery"] == "manual" and report["n", "foo"] == "unmapped"
    with pytest.raises(ValueError):
        load_cells(cells, columns.header_catalog(spark, heads), overrides={"a": "product", "b": "product"})


def test_one_file_as_many(spark, tmp_path):
    """The rules per file are those of a single load."""
    text = ("InvoiceNo,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n" +
            "".join(f"{i // 3},item {i % 30},{i % 4},{i % 27 + 1}.2.2024 10:00,£{i % 7 + 0.25},c{i % 9},France\n" for i in range(200)))
    path = put(tmp_path / "one", "x.csv", text, "latin-1")
    alone, report = load_sales(spark, path)
    loaded = load_tables(spark, path)
    names = ["date", "revenue", "quantity", "customer_id", "product", "region", "order_id"]
    assert rows(loaded.sales, *names) == rows(alone, *names)
    assert rows(loaded.report, "column_name", "method") == rows(report, "column_name", "method")
    assert [r["code"] for r in loaded.currencies().collect()] == ["GBP"]


def test_flags_per_file(spark):
    data = [("a", "o1", 2.5, 6), ("a", "o1", 2.5, 3), ("a", "o2", 1.0, 2), ("a", "o2", 1.0, 4), ("a", "o3", 9.0, 1),
            ("b", "o1", 12.5, 6), ("b", "o1", 3.0, 3), ("b", "o2", 1.0, 2), ("b", "o2", 40.0, 4), ("b", "o3", 9.0, 1)]
    df = spark.createDataFrame(data, "file_id string, order_id string, revenue double, quantity int")
    assert rows(clean.unit_price_flag(df, by=("file_id",))) == [("a", True), ("b", False)]


def test_a_header_is_scored_once_however_many_files_have_it(spark):
    """No row of a file runs the Python scores: only distinct headers do."""
    catalog = columns.header_catalog(spark, {"a": ["Ordr Date", "zzz"], "b": ["Ordr Date", "Amount"]})
    plan = columns.match_headers(catalog)._jdf.queryExecution().executedPlan().toString()
    below = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    assert len(below) == 1 and "lower(" not in below[0]
