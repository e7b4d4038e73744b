"""Small plan helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach the columns of a global aggregate to every row of ``df``.

    ``scalars`` must be a global ``agg`` (no grouping keys), i.e. exactly one
    row, so broadcasting it is bounded by construction.  This replaces an
    ``over()`` window without partitioning, which would pull the whole input
    into a single task.
    """
    return df.join(F.broadcast(scalars), how="inner")


def non_null(df: DataFrame, *keys: str) -> DataFrame:
    """Group keys that are NULL are dropped before grouping (a pandas
    ``groupby`` skips NaN keys; Spark would keep a NULL group)."""
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df if cond is None else df.filter(cond)


def band(value: Column, cuts: list[tuple[float, object]], default: object,
         strict: bool = True) -> Column:
    """``when`` ladder: first cut with value > (or >=) threshold wins."""
    expr = None
    for threshold, label in cuts:
        cond = value > F.lit(threshold) if strict else value >= F.lit(threshold)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def running_totals(df: DataFrame, value: str, key: str, parts: int = 256) -> DataFrame:
    """``df`` with ``rank`` (from 1), ``running`` and ``total`` of ``value``, largest
    value first, ties by ``key``.

    Rows are cut into value ranges at approximate quantiles; counts and sums
    per range (at most ``parts`` rows) give each range its start, and only the
    rows of one range are ordered in a task."""
    cuts = df.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 10_000).alias("_cuts"))
    ranged = with_scalars(df, cuts).withColumn(
        "_range", F.size(F.filter(F.coalesce("_cuts", F.array()), lambda c: c > F.col(value)))).drop("_cuts")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_sum"))
    starts = starts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"),
                           F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"),
                           F.sum("_sum").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("_range").orderBy(F.col(value).desc(), F.col(key).asc())
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (ranged.join(F.broadcast(starts), "_range")      # at most ``parts`` rows
            .withColumn("rank", F.col("_n") + F.row_number().over(inside))
            .withColumn("running", F.col("_before") + F.sum(value).over(upto))
            .drop("_range", "_n", "_before"))


_SCOPE: ContextVar[list[DataFrame] | None] = ContextVar("tillroll_scope", default=None)


@contextmanager
def intermediates() -> Iterator[list[DataFrame]]:
    """Collects what the operators called in the ``with`` block persist; hand the
    list to ``release`` once their results have been used.  Scopes are per
    thread and context: nobody else's frames are in the list."""
    frames: list[DataFrame] = []
    token = _SCOPE.set(frames)
    try:
        yield frames
    finally:
        _SCOPE.reset(token)


def reuse(df: DataFrame) -> DataFrame:
    """Persist an intermediate that later steps read several times.

    Used for the small aggregates an operator derives from the raw lines (per
    customer, per day and group, per basket): the raw scan and its shuffle run
    once; later passes read the cached blocks (memory, spilling to disk).  A
    lost executor's blocks are recomputed from lineage."""
    from pyspark import StorageLevel

    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    frames = _SCOPE.get()
    if frames is not None:
        frames.append(out)
    return out


def release(frames: list[DataFrame]) -> None:
    """Drop the blocks of ``intermediates()``; a result that is used again
    recomputes them."""
    while frames:
        frames.pop().unpersist(blocking=False)
