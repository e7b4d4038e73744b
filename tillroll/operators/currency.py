"""Currency detection: symbols in the raw bytes, region names, file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Currency code -> (symbol, countries / regions).
CURRENCIES = {
    "GBP": ("£", ["united kingdom", "uk", "england", "scotland", "wales", "great britain"]),
    "USD": ("$", ["united states", "usa", "us", "america"]),
    "EUR": ("€", ["france", "germany", "italy", "spain", "netherlands", "belgium",
             "portugal", "austria", "finland", "ireland", "greece", "europe"]),
    "INR": ("₹", ["india"]),
    "JPY": ("¥", ["japan"]),
    "AUD": ("A$", ["australia"]),
    "CAD": ("C$", ["canada"]),
    "BRL": ("R$", ["brazil", "brasil"]),
}
# File-name hints, checked in this order.
SOURCE_HINTS = {
    "GBP": ["uk", "united_kingdom", "britain", "retail"],
    "USD": ["superstore", "us_", "_us", "amazon", "walmart"],
    "EUR": ["eu_", "europe", "french", "german"],
    "INR": ["india", "flipkart", "amazon_in"],
    "BRL": ["brazil", "olist", "brasil"],
}
DEFAULT_CURRENCY = "USD"


def symbol_counts(text: Column, parity: bool = False) -> list[tuple[str, Column]]:
    """(code, count) per registry currency.  Default: a plain ``$`` is only
    counted where it is not part of ``A$``/``C$``/``R$``."""
    out = []
    multi = [sym for sym, _ in CURRENCIES.values() if len(sym) > 1]
    for code, (sym, _) in CURRENCIES.items():
        n = _occurrences(text, sym)
        if not parity and sym == "$":
            for m in multi:
                n = n - _occurrences(text, m)
        out.append((code, n))
    return out


def _occurrences(text: Column, part: str) -> Column:
    """How often ``part`` is in a text, without overlap; by what is left without it."""
    less = F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))
    return F.when(text.contains(part), (less / len(part)).cast("int")).when(text.isNotNull(), 0)


def most_frequent(counts: list[tuple[str, Column]]) -> Column:
    best = F.lit(None).cast("string")
    best_n = F.lit(0)
    for code, n in counts:  # strictly greater: the first registry entry wins ties
        best = F.when(n > best_n, F.lit(code)).otherwise(best)
        best_n = F.greatest(best_n, n)
    return best


def currency_from_texts(texts: DataFrame, key: str, text: Column, parity: bool = False) -> DataFrame:
    """(key, code): the most frequent currency symbol of each key's texts (first
    registry entry on ties; NULL when none).  Counts are combined map-side."""
    counts = symbol_counts(text, parity)
    per_key = texts.groupBy(key).agg(*[F.sum(n).alias(code) for code, n in counts])
    return per_key.select(key, most_frequent([(c, F.col(c)) for c, _ in counts]).alias("code"))


def currency_from_files(spark: SparkSession, paths: str | list[str], parity: bool = False) -> DataFrame:
    """(path, code) by ``currency_from_texts`` over every line of every file,
    read line by line (splittable, so a large file is scanned by many tasks); a
    line that is not valid UTF-8 is read as Latin-1."""
    lines = spark.read.text(paths).select(F.input_file_name().alias("path"), "value")
    text = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(
        F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    return currency_from_texts(lines, "path", text, parity)


def registry_table(spark: SparkSession) -> DataFrame:
    rows = [(code, ci, name, ri) for ci, (code, (_, regions)) in enumerate(CURRENCIES.items())
            for ri, name in enumerate(regions)]
    return spark.createDataFrame(rows, "code string, code_rank int, country string, "
                                       "country_rank int")


def currency_from_region(sales: DataFrame, parity: bool = False, by: str | None = None) -> DataFrame:
    """One row (code), or one per value of ``by`` that has regions: the first of
    the 3 most frequent regions (lower case) that names a registry country.
    Default: whole-word match either way; ``parity``: plain substring either
    way (so "australia" hits "us")."""
    spark = sales.sparkSession
    keys = [by] if by else []
    if "region" not in sales.columns:
        none = F.lit(None).cast("string").alias("code")
        return sales.select(by, none).distinct() if by else spark.range(1).select(none)
    counted = sales.filter(F.col("region").isNotNull()).groupBy(*keys, F.lower("region").alias("region")).agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("n").desc(), F.col("region")]
    if not by:                               # one group: the top 3 without a window over all regions
        counted = counted.orderBy(*order).limit(3)
    ranked = counted.withColumn("region_rank", F.row_number().over(
        Window.partitionBy(*keys).orderBy(*order))).where(F.col("region_rank") <= 3)
    reg = F.broadcast(registry_table(spark))  # fixed registry: a few dozen rows
    r, c = F.col("region"), F.col("country")
    if parity:
        cond = r.contains(c) | c.contains(r)
    else:
        cond = _words(r).contains(_words(c)) | _words(c).contains(_words(r))
    hits = ranked.join(reg, cond)
    pick = F.min_by("code", F.struct("region_rank", "code_rank", "country_rank")).alias("code")
    return hits.groupBy(*keys).agg(pick)


def _words(col: Column) -> Column:
    """' a b ' form: whole-word containment becomes a plain substring test."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(col, "[^a-z0-9]+", " ")), F.lit(" "))


def currency_from_name(names: DataFrame, col: str = "source_name") -> DataFrame:
    """Adds ``code`` from substring hints in a file or dataset name."""
    n = F.lower(F.col(col))
    expr = None
    for code, hints in SOURCE_HINTS.items():
        cond = None
        for h in hints:
            c = n.contains(h)
            cond = c if cond is None else cond | c
        expr = F.when(cond, F.lit(code)) if expr is None else expr.when(cond, F.lit(code))
    return names.withColumn("code", expr)


def detect_currency(text_code: Column, region_code: Column, name_code: Column) -> Column:
    return F.coalesce(text_code, region_code, name_code, F.lit(DEFAULT_CURRENCY))
