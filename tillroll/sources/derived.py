"""Text renderings of the driver's tables, for the ingest operators.

The ingest layer works on raw text (money strings, foreign headers, dates as
written by people).  These views derive such text from the parquet tables
with Spark, so the ingest rules run over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.sources.fixtures import sales, table


def amount_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, amount_text): every line's price written
    the way invoices write it - "(1234.50)" for returned lines,
    "$1,234.50", "1234.50 EUR" or "£1234.50" depending on the line status."""
    li = table(spark, sf_dir, "lineitem")
    plain = F.col("l_extendedprice").cast("decimal(12,2)").cast("string")
    text = (F.when(F.col("l_returnflag") == "R", F.concat(F.lit("("), plain, F.lit(")")))
             .when(F.col("l_returnflag") == "A",
                   F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)))
             .when(F.col("l_linestatus") == "O", F.concat(plain, F.lit(" EUR")))
             .otherwise(F.concat(F.lit("£"), plain)))
    return li.select("l_orderkey", "l_linenumber", text.alias("amount_text"))


# Headers of the text rendering, as a spreadsheet export would name them.
TEXT_HEADERS = {
    "date": "Order Date", "revenue": "Sales", "quantity": "Qty",
    "customer_id": "Customer Name", "product": "Product Name", "category": "Sub-Category",
    "region": "Country", "order_id": "Order ID",
}


def sales_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales view with every column as text under foreign headers:
    month-first dates, "$"-prefixed amounts."""
    s = sales(spark, sf_dir)
    cols = {
        "date": F.date_format("date", "M/d/yyyy"),
        "revenue": F.concat(F.lit("$"), F.col("revenue").cast("string")),
    }
    return s.select(*[(cols.get(c, F.col(c).cast("string"))).alias(h)
                      for c, h in TEXT_HEADERS.items()])


# Date spellings of the text rendering, by order number.
DATE_STYLES = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss'Z'", "M/d/yyyy h:mm a", "yyyyMMdd",
               "MMMM d, yyyy", "d MMM yyyy", "M/d/yyyy"]


def order_date_texts(spark: SparkSession, sf_dir: str, styles: list[str] = DATE_STYLES) -> DataFrame:
    """(o_orderkey, date): every order's date as text, in a style that changes
    from order to order."""
    o = table(spark, sf_dir, "orders")
    pick = F.pmod(F.col("o_orderkey"), F.lit(len(styles)))
    text = F.lit(None).cast("string")
    for i, style in enumerate(styles):
        text = F.when(pick == i, F.date_format("o_orderdate", style)).otherwise(text)
    return o.select("o_orderkey", text.alias("date"))


def quantity_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, quantity): quantities as text, with blanks,
    decimals, words, NaN and numbers beyond an int or a long among them."""
    li = table(spark, sf_dir, "lineitem")
    n = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(8))
    odd = {1: "99999999999", 2: "NaN", 3: " 7.9 ", 4: "many", 5: "1e30", 6: "-3"}
    text = F.col("l_quantity").cast("int").cast("string")
    for k, v in odd.items():
        text = F.when(n == k, F.lit(v)).otherwise(text)
    return li.select("l_orderkey", "l_linenumber", F.when(n != 7, text).alias("quantity"))


# Misspelt headers, each within the fuzzy threshold of its standard.
FUZZY_HEADERS = {
    "date": "Ordr Date", "revenue": "Revenuee", "quantity": "Quantty", "customer_id": "Custmer ID",
    "product": "Product Nme", "category": "Catgory", "region": "Regionn", "order_id": "Order Idd",
}


def sales_under(spark: SparkSession, sf_dir: str, headers: dict[str, str]) -> DataFrame:
    """The text rendering of the sales view under other headers."""
    return sales_as_text(spark, sf_dir).withColumnsRenamed({TEXT_HEADERS[k]: v for k, v in headers.items()})


# Country names that stand for the nations of the tables.
COUNTRIES = ["Germany", "United Kingdom", "India", "Brazil"]


def sales_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales view with country names as regions: a nation's number, modulo
    the number of names, chooses the name."""
    s = sales(spark, sf_dir)
    number = F.regexp_extract("region", "([0-9]+)$", 1).cast("int")
    return s.withColumn("region", F.get(F.array(*[F.lit(c) for c in COUNTRIES]), F.pmod(number, F.lit(len(COUNTRIES)))))


def flat_price_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_id, quantity, revenue): lines that carry a unit price, the same on
    every line of an order, where a line total should be."""
    li = table(spark, sf_dir, "lineitem")
    price = li.groupBy("l_orderkey").agg(F.min(F.col("l_extendedprice").cast("decimal(12,2)")).alias("revenue"))
    return li.select("l_orderkey", F.col("l_quantity").cast("int").alias("quantity")).join(price, "l_orderkey") \
        .withColumnRenamed("l_orderkey", "order_id")


def priced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, quantity, list_price): no revenue column, prices
    as text."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("quantity"),
                     F.concat(F.lit("$"), F.col("l_extendedprice").cast("decimal(12,2)").cast("string")).alias("list_price"))


# Headers of three files with the same lines: another order and other names in
# each, a misspelt name, a column that says nothing.
FILE_HEADERS = {
    "orders_a": [("date", "Order Date"), ("revenue", "Sales"), ("quantity", "Qty"), ("customer_id", "Customer Name"),
                 ("product", "Product Name"), ("category", "Sub-Category"), ("region", "Country"), ("order_id", "Order ID")],
    "orders_b": [("order_id", "InvoiceNo"), ("region", "Country"), ("category", "Catgory"), ("product", "Description"),
                 ("customer_id", "CustomerID"), ("quantity", "Quantity"), ("revenue", "Amount"), ("date", "InvoiceDate")],
    "orders_c": [("product", "zz1"), (None, "blank column"), ("quantity", "Quantty"), ("date", "zz2"), ("order_id", "Order Idd"),
                 ("revenue", "Revenuee"), ("region", "Regionn"), ("customer_id", "Custmer ID"), ("category", "Product Line")],
}


def sales_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(cells, catalog) of three files that share the lines of the sales view by
    order number, day-first dates in the second one."""
    s = sales(spark, sf_dir)
    number = F.pmod(F.col("order_id"), F.lit(len(FILE_HEADERS)))
    shown = {c: F.col(c).cast("string") for c in s.columns} | {
        "date": F.date_format("date", "M/d/yyyy"), "revenue": F.concat(F.lit("$"), F.col("revenue").cast("string"))}
    cells = None
    for i, (name, header) in enumerate(FILE_HEADERS.items()):
        own = shown | {"date": F.date_format("date", "dd.MM.yyyy")} if name == "orders_b" else shown
        row = F.struct(F.lit(name).alias("file_id"), F.array(*[own.get(c, F.lit(None).cast("string")) for c, _ in header]).alias("cells"))
        cells = F.when(number == i, row) if cells is None else cells.when(number == i, row)
    rows = [(name, i, h) for name, header in FILE_HEADERS.items() for i, (_, h) in enumerate(header)]
    return s.select(cells.alias("r")).select("r.*"), spark.createDataFrame(rows, "file_id string, position int, column_name string")


# Header spellings of a customer's file, by customer number: exact, doubled,
# misspelt, suggested and unknown names.
HEADER_STYLES = [["Order Date", "Unit Price", "Total", "Qty"], ["order_date", "AMOUNT", "Order_Quantity", "sku"],
                 ["Dtae", "Custmer ID", "Regionn", "nothing"], ["invoice date", "Invoicedate", "Prodct", "Product Nme"],
                 ["colour", "w", "", "Total Price"]]


def customer_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, position, column_name): one file per customer."""
    styles = F.array(*[F.array(*[F.lit(h) for h in style]) for style in HEADER_STYLES])
    c = table(spark, sf_dir, "customer")
    style = F.get(styles, F.pmod(F.col("c_custkey"), F.lit(len(HEADER_STYLES))).cast("int"))
    return c.select(F.col("c_custkey").cast("string").alias("file_id"), F.posexplode(style).alias("position", "column_name"))


# What tells the currency of a nation's file, by nation number:
# symbols in the cells, the regions, the name, nothing.
CURRENCY_FILES = [("lines", "£", "Nowhere"), ("olist", "", "Germany"), ("flipkart", "", "Nowhere"), ("lines", "", "Nowhere")]


def nation_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(cells, catalog): the order lines of each nation as a file (date, amount,
    country), with prices in pounds, a country, or neither."""
    s = sales(spark, sf_dir).withColumn("n", F.regexp_extract("region", "([0-9]+)$", 1).cast("int"))
    kind = F.pmod(F.col("n"), F.lit(len(CURRENCY_FILES)))
    pick = lambda i: F.get(F.array(*[F.lit(f[i]) for f in CURRENCY_FILES]), kind)
    file_id = F.concat(pick(0), F.lit("_"), F.col("n").cast("string"))
    cells = s.select(file_id.alias("file_id"), F.array(
        F.date_format("date", "yyyy-MM-dd"), F.concat(pick(1), F.col("revenue").cast("string")), pick(2)).alias("cells"))
    header = F.array(*[F.lit(h) for h in ("date", "amount", "country")])
    nations = table(spark, sf_dir, "nation").withColumn("n", F.regexp_extract("n_name", "([0-9]+)$", 1).cast("int"))
    return cells, nations.select(file_id.alias("file_id"), F.posexplode(header).alias("position", "column_name"))
