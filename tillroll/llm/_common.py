"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.session import apply_defaults, ship_package
from tillroll.sources.tables import write_table

# Internal columns carry this prefix; input columns must not.
P = "__tr_"

ROWS_PER_BUCKET = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given parquet table; the session gets the library's defaults and the
    executors the package."""
    apply_defaults(spark)
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back, so
    later passes and lost executors restart from the files."""
    ship_package(df.sparkSession)
    return write_table(df, f"llm-{name}")


def discard(table: DataFrame) -> None:
    """Delete the files of a ``written`` table that nothing reads any more: what
    was made of it must be written itself, so that no task can need it again."""
    files = table.inputFiles()
    if files:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        if folder.getName().startswith("llm-"):
            folder.getFileSystem(conf).delete(folder, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns named like an operator's own output columns: the
    operator's column replaces an input column of the same name."""
    return df.drop(*names)


def stratum(col: str) -> Column:
    """A grouping value as non-null text (null and '' stay apart)."""
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit("null"))


def shuffle_key(seed: int, *cols: str) -> Column:
    """Seeded pseudo-random text key of a row; equal on every run and retry."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[stratum(c) for c in cols]))


def unit(key: Column, digits: int = 13) -> Column:
    """The leading hex digits of an ``shuffle_key`` as a number in [0, 1)."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("double") / F.lit(float(16 ** digits))


def buckets_for(n_rows: int) -> int:
    return max(1, math.ceil(n_rows / ROWS_PER_BUCKET))


def positions(df: DataFrame, group: list[str], bucket: str, order: list, out: str,
              total: str | None = None) -> DataFrame:
    """0-based position of every row in its group, with no task holding a group.

    ``bucket`` is a number that never decreases along ``order`` and cuts a
    group into parts of bounded size (a uniform hash, or a scaled rank).  The
    parts are counted, the counts summed up to offsets, and rows are numbered
    inside their part only.  ``group`` columns must not be null."""
    n, before = f"{P}n", f"{P}before"
    cells = df.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias(n))
    part = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    cells = cells.select(*group, bucket, (F.sum(n).over(part.orderBy(bucket)) - F.col(n)).alias(before),
                         *([F.sum(n).over(part).alias(total)] if total else []))
    inside = Window.partitionBy(*group, bucket).orderBy(*order)
    return (df.join(cells, [*group, bucket])
            .withColumn(out, F.col(before) + F.row_number().over(inside) - F.lit(1))
            .drop(before))
