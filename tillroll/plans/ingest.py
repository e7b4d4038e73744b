"""From a raw sales file to the canonical sales-line table.

read (encoding detected) -> header catalog -> exact / fuzzy / content-sniff
mapping -> rename + user overrides -> cleaning.  Mapping decisions are made
on the column catalog (a few rows per file); the data itself is touched only
by the one profiling pass and by the lazy cleaning projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators import clean, columns, currency
from tillroll.operators._common import with_scalars
from tillroll.plans.files import load_tables
from tillroll.schema import STANDARD_COLUMNS
from tillroll.sources.csv import header_groups, read_sales_csv


def _normalized(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def standardize(raw: DataFrame, file_id: str = "upload", overrides: dict[str, str] | None = None,
                sniff: bool = True) -> tuple[DataFrame, DataFrame]:
    """Returns (renamed DataFrame, mapping report)."""
    spark = raw.sparkSession
    names = raw.columns
    norm = [_normalized(n) for n in names]
    # headers that normalise to the same text: the last one keeps the name
    final = [n if n not in norm[i + 1:] else f"{n}__{i}" for i, n in enumerate(norm)]
    df = raw.toDF(*final)
    catalog = columns.header_catalog(spark, {file_id: names})
    exact = columns.match_columns_exact(catalog)
    fuzzy = columns.match_columns_fuzzy(catalog, exact)
    decided = exact.unionByName(fuzzy).collect()          # one row per header at most
    by_header = dict(zip(names, final))
    rename = {by_header[r["column_name"]]: r["standard"] for r in decided
              if r["method"] in ("exact", "fuzzy")}
    report = [(file_id, r["column_name"], r["standard"], r["method"], r["score"]) for r in decided]
    if sniff:
        taken = set(rename.values())
        open_cols = [c for c in final if c not in rename and c not in columns.COLUMN_ALIASES]
        if open_cols and len(taken) < len(columns.COLUMN_ALIASES):
            prof = [r.asDict() for r in columns.profile_columns(df, open_cols).collect()]
            close = [p["column_name"] for p in prof if columns.near_limit(p["distinct"])]
            if close:                       # few values, by their estimate: counted exactly
                sets = df.agg(*[F.size(F.collect_set(F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")))).alias(f"n{i}")
                                for i, c in enumerate(close)]).first()
                exact_counts = dict(zip(close, sets))
                prof = [p | {"distinct": exact_counts.get(p["column_name"], p["distinct"])} for p in prof]
            picks = columns.sniff_pick(prof, taken)
            rename.update(picks)
            inv = {v: k for k, v in by_header.items()}
            report += [(file_id, inv[c], std, "sniffed", None) for c, std in picks.items()]
    if overrides:
        manual = {_normalized(k) if _normalized(k) in final else k: v for k, v in overrides.items()}
        # a manual choice replaces the automatic mapping of its standard and of its column
        dropped = {k for k, v in rename.items() if v in manual.values() or k in manual}
        rename = {k: v for k, v in rename.items() if k not in dropped} | manual
        report = [r for r in report if by_header.get(r[1]) not in dropped]
        report += [(file_id, k, v, "manual", None) for k, v in overrides.items()]
    targets = list(rename.values())
    dupes = {t for t in targets if targets.count(t) > 1}
    if dupes:
        raise ValueError(f"two columns mapped to the same standard: {sorted(dupes)}")
    mapped = {k for k, _ in rename.items()}
    report += [(file_id, h, None, "unmapped", None) for h in names if by_header[h] not in mapped]
    rep = spark.createDataFrame(report, columns.MAPPING_SCHEMA)
    return df.withColumnsRenamed(rename), rep


def load_sales(spark: SparkSession, path: str, overrides: dict[str, str] | None = None,
               encoding: str | None = None, parity: bool = False,
               unit_price: bool | None = None,
               multi_line: bool = False, day_first: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Read, standardise and clean one sales file, or a folder of them -> (sales,
    mapping report).  Files with headers of their own are mapped by each."""
    groups, alike = header_groups(spark, path, encoding)
    if not alike:
        found = load_tables(spark, path, encoding, multi_line, overrides=overrides, parity=parity, unit_price=unit_price,
                            day_first=day_first)
        return found.sales.drop("file_id"), found.report
    raw = read_sales_csv(spark, path, encoding or (next(iter(groups)) if len(groups) == 1 else None), multi_line=multi_line)
    df, report = standardize(raw, file_id=path, overrides=overrides)
    return clean.clean_sales(df, parity=parity, unit_price=unit_price, day_first=day_first), report


def load_currency(spark: SparkSession, path: str, sales: DataFrame) -> DataFrame:
    """(path, code) for every file of ``path``: the symbols in its text, else the
    regions of the loaded sales, else its name, else the default."""
    files = currency.currency_from_files(spark, path).withColumnRenamed("code", "text_code")
    named = currency.currency_from_name(files, "path").withColumnRenamed("code", "name_code")
    region = currency.currency_from_region(sales).withColumnRenamed("code", "region_code")
    both = with_scalars(named, region)
    return both.select("path", currency.detect_currency(F.col("text_code"), F.col("region_code"),
                                                        F.col("name_code")).alias("code"))


def load_files(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    """Several files with headers of their own: each is mapped by its own header
    and cleaned; the result lacks nothing that any of them has (columns missing
    in a file are NULL).  One plan for all files, see ``plans.files``."""
    sales = load_tables(spark, paths, **options).sales
    return sales.select(*[c for c in STANDARD_COLUMNS if c in sales.columns])


def load_sample(spark: SparkSession, path: str, parity: bool = False) -> tuple[DataFrame, DataFrame]:
    """A named sample file: always Latin-1; an empty file, or one with no row
    left after cleaning, is an error."""
    from tillroll.sources.csv import LATIN1

    raw = read_sales_csv(spark, path, LATIN1)
    if raw.isEmpty():
        raise ValueError(f"{path}: the file has no data rows")
    df, report = standardize(raw, file_id=path)
    sales = clean.clean_sales(df, parity=parity)
    if sales.isEmpty():
        raise ValueError(f"{path}: no valid rows remain after cleaning")
    return sales, report


def union_sales(frames: list[DataFrame]) -> DataFrame:
    """Union of several cleaned files (columns missing in a file are NULL)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    return df.limit(n)
