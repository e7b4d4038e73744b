"""Any number of sales files with headers of their own, loaded together.

One plan for all files, whatever their number:

1. headers and encodings of all files in one scan; the header catalog is
   matched as a whole (exact, fuzzy, suggestions);
2. rows of cells, read once by position and written into the shared folder;
3. one pass over the cells profiles every column of every file (also its date
   order and currency symbols); open columns are named by their contents;
4. the cells of a row become the standard columns through one map per file
   (standard -> position), joined by file;
5. typed rows are written once; the unit-price test runs per file on them.

The driver sees paths and the names of the standards found, nothing per row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions import parse_amount
from tillroll.operators import clean, columns, currency, profiles
from tillroll.schema import STANDARD_COLUMNS
from tillroll.sources.csv import cells_of_files, file_headers, header_catalog_of
from tillroll.sources.tables import write_table

MAX_FILES_BROADCAST = 100_000        # one map of at most nine places a file
PRICE = "_price"                     # place of a price column where a file has no revenue


@dataclass
class Loaded:
    """What ``load_cells`` found: ``sales`` (file_id and the standard columns that
    any file has), ``report`` (file_id, column_name, standard, method, score)
    and the ``sketches`` of every column of every file."""

    sales: DataFrame
    report: DataFrame
    sketches: DataFrame

    def currencies(self, name: str = "file_id") -> DataFrame:
        """(file_id, code): the symbols in a file's cells, else its regions, else
        hints in its name, else the default."""
        total = [F.sum(F.col("symbols")[code]).alias(code) for code in currency.CURRENCIES]
        symbols = self.sketches.groupBy("file_id").agg(*total)
        text = symbols.select("file_id", currency.most_frequent([(c, F.col(c)) for c in currency.CURRENCIES]).alias("text_code"))
        region = currency.currency_from_region(self.sales, by="file_id").withColumnRenamed("code", "region_code")
        files = self.report.select("file_id").distinct().join(text, "file_id", "left").join(region, "file_id", "left")
        named = currency.currency_from_name(files, name).withColumnRenamed("code", "name_code")
        return named.select("file_id", currency.detect_currency(F.col("text_code"), F.col("region_code"), F.col("name_code")).alias("code"))


def sniffed_matches(cells: DataFrame, sketches: DataFrame, catalog: DataFrame, matched: DataFrame) -> DataFrame:
    """Standards by content for the columns that headers left open."""
    sure = matched.where(F.col("method") != "suggestion")
    still = (catalog.join(sure.select("file_id", "position"), ["file_id", "position"], "left_anti")
             .where(~columns.normalize_name(F.col("column_name")).isin(list(columns.COLUMN_ALIASES))))
    found = profiles.column_profiles(sketches.join(still, profiles.KEYS, "left_semi"))
    if not found.where(columns.near_limit(F.col("distinct"))).isEmpty():
        found = profiles.exact_distinct(profiles.cell_values(cells), found)
    return columns.sniff_matches(found.join(still, profiles.KEYS), sure.select("file_id", "standard"))


def with_overrides(catalog: DataFrame, matched: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """Manual choices (column name -> standard) replace the automatic mapping of
    their standard and of their column, in every file that has the column."""
    if len(set(overrides.values())) < len(overrides):
        raise ValueError(f"two columns mapped to the same standard: {sorted(overrides.values())}")
    normal = columns.normalize_name
    rows = catalog.sparkSession.createDataFrame(list(overrides.items()), "name string, standard string")
    manual = (catalog.join(F.broadcast(rows), normal(F.col("column_name")) == normal(F.col("name")))
              .groupBy("file_id", "standard").agg(F.max("position").alias("position"), F.max_by("column_name", "position").alias("column_name"))
              .select("file_id", "position", "column_name", "standard", F.lit("manual").alias("method"), F.lit(None).cast("double").alias("score")))
    manual = write_table(manual, "manual")
    rest = (matched.join(manual.select("file_id", "standard"), ["file_id", "standard"], "left_anti")
            .join(manual.select("file_id", "position"), ["file_id", "position"], "left_anti"))
    return rest.unionByName(manual)


def file_places(catalog: DataFrame, mapping: DataFrame, sketches: DataFrame) -> DataFrame:
    """One row per file: ``places`` (standard -> position) and ``day_first``, the
    date order that more of its numeric dates need."""
    has = mapping.groupBy("file_id").agg(F.collect_set("standard").alias("has"))
    price = (catalog.where(columns.normalize_name(F.col("column_name")).contains("price"))
             .join(mapping.select("file_id", "position"), ["file_id", "position"], "left_anti").join(has, "file_id")
             .where(~F.array_contains("has", "revenue") & F.array_contains("has", "quantity"))
             .groupBy("file_id").agg(F.min("position").alias("position")).withColumn("standard", F.lit(PRICE)))
    every = mapping.select("file_id", "standard", "position").unionByName(price)
    places = every.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("standard", "position"))).alias("places"))
    dates = (mapping.where(F.col("standard") == "date").join(sketches, ["file_id", "position"])
             .select("file_id", (F.col("day_first") > F.col("month_first")).alias("day_first")))
    return places.join(dates, "file_id", "left").withColumn("day_first", F.coalesce("day_first", F.lit(False)))


def typed_rows(cells: DataFrame, places: DataFrame, present: list[str], parity: bool = False,
               day_first: bool | None = None) -> DataFrame:
    """Rows of cells -> file_id and typed standard columns, by the same rules as
    ``clean_sales``; a column that a file lacks is NULL there and filters none
    of its rows."""
    few = places.count() <= MAX_FILES_BROADCAST
    rows = cells.join(F.broadcast(places) if few else places, "file_id")
    at = lambda std: F.get(F.col("cells"), F.col("places")[std])
    has = lambda std: F.map_contains_key("places", std)
    order = F.col("day_first") if day_first is None else F.lit(day_first)
    value = {std: at(std) for std in present}
    keep = F.lit(True)
    if "date" in present:
        value["date"] = columns.parse_timestamp(at("date"), order)
        keep &= ~has("date") | F.col("date").isNotNull()
    if "quantity" in present:
        value["quantity"] = F.when(has("quantity"), clean.parse_quantity(at("quantity")))
        keep &= ~has("quantity") | (F.coalesce("quantity", F.lit(0)) > 0)
    names = [std for std in STANDARD_COLUMNS if std in value or std == "revenue"]
    out = rows.select("file_id", "places", F.when(has("revenue"), parse_amount(at("revenue"), parity=parity)).alias("revenue"),
                      F.when(has(PRICE), parse_amount(at(PRICE))).alias(PRICE),
                      *[value[std].alias(std) for std in names if std != "revenue"])
    if "quantity" in present:
        out = out.withColumn("revenue", F.coalesce("revenue", F.col(PRICE) * F.col("quantity")))
    keep &= ~(has("revenue") | has(PRICE)) | (F.coalesce("revenue", F.lit(0.0)) > 0)
    return out.where(keep).select("file_id", *names)


def with_unit_prices(rows: DataFrame, unit_price: bool | None = None) -> DataFrame:
    """revenue *= quantity in the files whose revenue is a unit price."""
    if not {"revenue", "quantity"} <= set(rows.columns):
        return rows
    product = F.col("revenue") * F.col("quantity")
    if unit_price is not None:
        return rows.withColumn("revenue", F.when(F.col("quantity").isNotNull(), product).otherwise(F.col("revenue"))) if unit_price else rows
    if "order_id" not in rows.columns:
        return rows
    flags = clean.unit_price_flag(rows.where("revenue IS NOT NULL AND quantity IS NOT NULL"), by=("file_id",)).where("unit_price")
    return (rows.join(flags, "file_id", "left").withColumn("revenue", F.when(F.col("unit_price"), product).otherwise(F.col("revenue")))
            .drop("unit_price"))


def load_cells(cells: DataFrame, catalog: DataFrame, overrides: dict[str, str] | None = None, sniff: bool = True,
               parity: bool = False, unit_price: bool | None = None, day_first: bool | None = None) -> Loaded:
    """Map, type and clean the rows of many files.

    ``cells``: (file_id, cells); ``catalog``: (file_id, position, column_name).
    A file without any known column gives no sales rows, only report rows.
    Cells are read four times at most: profile, exact sets of columns with
    about twenty values, typed rows; they should be a written table."""
    matched = write_table(columns.match_headers(catalog), "matches")
    sketches = write_table(profiles.profile_sketches(profiles.cell_values(cells)), "sketches")
    if sniff:
        sniffed = write_table(sniffed_matches(cells, sketches, catalog, matched), "sniffed")
        matched = matched.join(sniffed.select("file_id", "position"), ["file_id", "position"], "left_anti").unionByName(sniffed)
    if overrides:
        matched = with_overrides(catalog, matched, overrides)
    mapping = matched.where(F.col("method") != "suggestion")
    unmapped = catalog.join(mapping.select("file_id", "position"), ["file_id", "position"], "left_anti").select(
        "file_id", "column_name", F.lit(None).cast("string").alias("standard"), F.lit("unmapped").alias("method"),
        F.lit(None).cast("double").alias("score"))
    report = matched.drop("position").unionByName(unmapped)
    found = {r["standard"] for r in mapping.select("standard").distinct().collect()}      # at most eight names
    places = write_table(file_places(catalog, mapping, sketches), "places")
    rows = typed_rows(cells, places, [s for s in STANDARD_COLUMNS if s in found], parity, day_first)
    if not found & {"revenue"} and places.where(F.map_contains_key("places", F.lit(PRICE))).isEmpty():
        rows = rows.drop("revenue")
    rows = write_table(rows, "typed")
    return Loaded(with_unit_prices(rows, unit_price), report, sketches)


def load_tables(spark: SparkSession, paths: str | list[str], encoding: str | None = None, multi_line: bool = False, **options) -> Loaded:
    """``load_cells`` over CSV files: folders, globs or lists of paths.  Options as
    for ``load_cells``.  Empty files have no header and are left out."""
    headers = write_table(file_headers(spark, paths, encoding), "headers")
    cells = write_table(cells_of_files(spark, headers, multi_line), "cells")
    return load_cells(cells, header_catalog_of(headers), **options)
