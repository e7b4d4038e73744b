"""CSV sales files: encodings, headers, raw (all-string) reads, rows of cells.

``file_headers`` looks at every file once: its first line and its encoding.
``cells_of_files`` reads the rows of all files by position, one scan per
encoding, whatever the number of files and headers; which cell is which column
is a join with a table of one row per file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.sources.tables import write_table

UTF8 = "UTF-8"
LATIN1 = "ISO-8859-1"

# Cell texts that mean "no value".
NULL_MARKERS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def detect_encodings(spark: SparkSession, paths: str | list[str]) -> dict[str, str]:
    """Per file: UTF-8 when every line is valid UTF-8, else Latin-1.

    One distributed pass; the driver receives one row per file."""
    lines = spark.read.text(paths).select(F.input_file_name().alias("path"),
                                          F.is_valid_utf8("value").alias("ok"))
    rows = lines.groupBy("path").agg(F.bool_and("ok").alias("utf8")).collect()
    return {r["path"]: (UTF8 if r["utf8"] else LATIN1) for r in rows}


def header_groups(spark: SparkSession, paths: str | list[str], encoding: str | None = None) -> tuple[dict[str, list[str]], bool]:
    """({encoding: paths}, do all files have one header?) in one job; the driver
    receives the paths."""
    files = file_headers(spark, paths, encoding)
    rows = files.groupBy("encoding").agg(F.collect_list("file_id").alias("paths"), F.min("header").alias("low"),
                                         F.max("header").alias("high")).collect()
    ends = {tuple(r[e]) for r in rows for e in ("low", "high")}
    return {r["encoding"]: sorted(r["paths"]) for r in rows}, len(ends) <= 1


def read_sales_csv(spark: SparkSession, path: str | list[str], encoding: str | None = None,
                   multi_line: bool = False) -> DataFrame:
    """Header row + all columns as strings (types come from cleaning); null
    markers are NULL.  Files of a folder are read in the encoding of each, and
    by the names in the header of each: columns that a file lacks are NULL.

    Files are split across tasks.  ``multi_line=True`` accepts quoted fields
    that span lines, at the price of one task per file (such files cannot be
    split)."""
    groups, alike = header_groups(spark, path, encoding)
    if not alike:
        return by_names(spark, write_table(file_headers(spark, path, encoding), "headers"), multi_line)
    parts = [spark.read.option("header", True).option("encoding", code)
                  .option("multiLine", multi_line).option("escape", '"').csv(files)
             for code, files in (groups or {encoding or UTF8: path}).items()]
    return nulls_for_markers(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def by_names(spark: SparkSession, headers: DataFrame, multi_line: bool = False) -> DataFrame:
    """Rows of files with headers of their own under the union of their names, in
    the order of the first file that has each; of equal names in one file the
    last counts.  One join with a map per file, whatever the number of headers."""
    catalog = header_catalog_of(headers)
    names = catalog.groupBy("column_name").agg(F.min(F.struct("file_id", "position")).alias("at")).orderBy("at").collect()
    places = (catalog.groupBy("file_id", "column_name").agg(F.max("position").alias("position")).groupBy("file_id")
              .agg(F.map_from_entries(F.collect_list(F.struct("column_name", "position"))).alias("places")))
    rows = cells_of_files(spark, headers, multi_line).join(places, "file_id")
    return rows.select(*[F.get(F.col("cells"), F.col("places")[F.lit(n["column_name"])]).alias(n["column_name"]) for n in names])


def nulls_for_markers(raw: DataFrame) -> DataFrame:
    """Cells that hold a null marker become NULL."""
    cell = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return raw.select(*[F.when(~F.trim(cell(c)).isin(NULL_MARKERS), cell(c)).alias(c) for c in raw.columns])


# A cell after a comma: quoted (with doubled quotes) or plain.
CELL = r',("(?:[^"]|"")*"[^,]*|[^,]*)'


def split_line(line: Column) -> Column:
    """The cells of one CSV line."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CELL), F.lit(1))
    inner = lambda c: F.replace(F.regexp_extract(c, '^"((?:[^"]|"")*)"', 1), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda c: F.when(c.startswith('"'), inner(c)).otherwise(c))


def file_headers(spark: SparkSession, paths: str | list[str], encoding: str | None = None) -> DataFrame:
    """(file_id, encoding, header) per file that has a line: UTF-8 where every
    line is valid UTF-8, else Latin-1 (or the given encoding), and the names in
    its first line.  One scan; the first line of a file is the first row of its
    first block."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("block"), "value",
        F.monotonically_increasing_id().alias("row"))
    files = lines.groupBy("file_id").agg(F.min_by("value", F.struct("block", "row")).alias("first"),
                                         F.bool_and(F.is_valid_utf8("value")).alias("utf8"))
    code = F.lit(encoding) if encoding else F.when(F.col("utf8"), UTF8).otherwise(LATIN1)
    files = files.withColumn("encoding", code)
    text = F.when(F.col("encoding") == UTF8, F.col("first")).otherwise(F.decode(F.col("first").cast("binary"), LATIN1))
    return files.select("file_id", "encoding", split_line(F.regexp_replace(text, "^﻿|\r$", "")).alias("header"))


def header_catalog_of(headers: DataFrame) -> DataFrame:
    """(file_id, position, column_name)."""
    return headers.select("file_id", F.posexplode("header").alias("position", "column_name"))


def cells_of_files(spark: SparkSession, headers: DataFrame, multi_line: bool = False) -> DataFrame:
    """(file_id, cells): every row of every file of ``headers``, without its
    header line; null markers are NULL.  Rows that are shorter than the longest
    header end with NULL.  The driver sees the paths, as for any scan."""
    groups = headers.groupBy("encoding").agg(F.collect_list("file_id").alias("paths"), F.max(F.size("header")).alias("width"))
    parts = []
    for g in groups.collect():
        names = [f"c{i}" for i in range(max(1, g["width"]))]
        rows = (spark.read.schema(", ".join(f"{n} string" for n in names)).option("header", True)
                .option("encoding", g["encoding"]).option("multiLine", multi_line).option("escape", '"').csv(g["paths"]))
        cell = [F.when(~F.trim(F.col(n)).isin(NULL_MARKERS), F.col(n)) for n in names]
        parts.append(rows.select(F.col("_metadata.file_path").alias("file_id"), F.array(*cell).alias("cells")))
    if not parts:
        return spark.createDataFrame([], "file_id string, cells array<string>")
    return reduce(DataFrame.unionByName, parts)
