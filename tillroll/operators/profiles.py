"""Profiles of the columns of many files: one pass, mergeable.

Rows of cells are laid out as (file, position, value).  ``profile_sketches``
reduces them, combined map-side, to one row per (file, column) that holds sums
and two sketches (distinct values: HLL; numbers: KLL).  Such rows are a table:
``merge_sketches`` adds profiles of new parts of a file without its old rows.
``column_profiles`` reads rates, distinct counts and quartiles from them.

A distinct count near a limit is decided by the exact set of values, which is
small by its estimate (``exact_distinct``); a sketch decides the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions import ratio
from tillroll.operators import columns
from tillroll.operators.currency import CURRENCIES, symbol_counts

KEYS = ["file_id", "position"]
LG_K = 12            # 4,096 registers: about 1.6 % standard error, exact lists for a few hundred values
KLL_K = 200          # about 1.3 % rank error
SYMBOLS = "[" + "".join(sorted({sym[-1] for sym, _ in CURRENCIES.values()})) + "]"     # one of them is in any symbol
COUNTS = ["non_null", "numeric", "dates", "day_first", "month_first"]


def cell_values(cells: DataFrame) -> DataFrame:
    """(file_id, position, value) of every non-empty cell."""
    value = F.nullif(F.trim("value"), F.lit(""))
    return (cells.select("file_id", F.posexplode("cells").alias("position", "value"))
            .select(*KEYS, value.alias("value")).where(F.col("value").isNotNull()))


def _hits(text: Column, pattern: str, number: int) -> Column:
    return F.regexp_extract(text, pattern, number).try_cast("int") > 12


def profile_sketches(values: DataFrame) -> DataFrame:
    """(file_id, position, value) -> one row per (file, column): counts of values,
    numbers, dates and of numeric dates that fit one order only, the sum of the
    numbers, whether all are whole, currency symbols, and the two sketches."""
    v = F.col("value")
    rows = values.withColumn("_n", columns.number_of(v))
    rows = rows.withColumn("_n", F.when(~F.isnan("_n") & (F.abs("_n") < float("inf")), F.col("_n")))
    number = F.col("_n")
    # what few cells need goes to them alone: counts of symbols, orders of dates
    rows = (rows.withColumn("_money", F.when(v.rlike(SYMBOLS), v)).withColumn("_numeric_date", F.when(v.rlike(columns.NUMERIC_DATE), v))
            .withColumn("_date", F.when(F.col("_n").isNull(), columns.parse_timestamp(v))))
    rows = (rows.withColumns({f"_{code}": n for code, n in symbol_counts(F.col("_money"))})
            .withColumns({f"_{at}": _hits(F.col("_numeric_date"), columns.NUMERIC_DATE, at) for at in (1, 2)}))
    symbols = [F.coalesce(F.sum(f"_{code}"), F.lit(0)).alias(code) for code in CURRENCIES]
    return rows.groupBy(*KEYS).agg(
        F.count(v).alias("non_null"), F.count(number).alias("numeric"),
        F.count("_date").alias("dates"),
        F.count_if("_1").alias("day_first"), F.count_if("_2").alias("month_first"),
        F.sum(number).alias("number_sum"), F.coalesce(F.bool_and(number % 1 == 0), F.lit(True)).alias("all_integer"),
        F.hll_sketch_agg(v, F.lit(LG_K)).alias("values_hll"), F.kll_sketch_agg_double(number, F.lit(KLL_K)).alias("numbers_kll"),
        F.struct(*symbols).alias("symbols"))


def merge_sketches(parts: DataFrame) -> DataFrame:
    """Profiles of several parts of the same files -> profiles of the whole."""
    symbols = [F.sum(F.col("symbols")[code]).alias(code) for code in CURRENCIES]
    return parts.groupBy(*KEYS).agg(
        *[F.sum(c).alias(c) for c in COUNTS], F.sum("number_sum").alias("number_sum"), F.bool_and("all_integer").alias("all_integer"),
        F.hll_union_agg("values_hll").alias("values_hll"), F.kll_merge_agg_double("numbers_kll").alias("numbers_kll"),
        F.struct(*symbols).alias("symbols"))


def column_profiles(sketches: DataFrame) -> DataFrame:
    """(file_id, position, non_null, date_rate, numeric_rate, mean, all_integer,
    distinct, quartiles): rates over the non-empty values, the estimated number
    of distinct values, the approximate quartiles of the numbers (NULL without
    any)."""
    quartile = [F.when(F.col("numeric") > 0, F.kll_sketch_get_quantile_double("numbers_kll", F.lit(q))) for q in (0.25, 0.5, 0.75)]
    return sketches.select(
        *KEYS, "non_null", ratio("dates", "non_null").alias("date_rate"), ratio("numeric", "non_null").alias("numeric_rate"),
        ratio("number_sum", "numeric").alias("mean"), "all_integer", F.hll_sketch_estimate("values_hll").alias("distinct"),
        F.array(*quartile).alias("quartiles"))


def exact_distinct(values: DataFrame, profiles: DataFrame, limit: int = columns.CATEGORY_LIMIT) -> DataFrame:
    """``profiles`` with exact distinct counts for the columns whose estimate is
    near the limit.  Their sets have about twice the limit values at most."""
    close = profiles.where(columns.near_limit(F.col("distinct"), limit)).select(*KEYS)
    sets = values.join(close, KEYS, "left_semi").groupBy(*KEYS).agg(F.size(F.collect_set("value")).cast("long").alias("_exact"))
    return profiles.join(sets, KEYS, "left").withColumn("distinct", F.coalesce("_exact", "distinct")).drop("_exact")
