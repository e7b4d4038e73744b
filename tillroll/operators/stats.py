"""Exact order and rank statistics as lazy plans with bounded tasks.

``quantiles``: Spark's exact ``percentile`` merges a value->count map of the
whole column in one task.  Here all ranks are found at once, in one plan:

1. a mergeable ``percentile_approx`` sketch (relative rank error 1/accuracy)
   brackets every rank between two values a <= b, ``margin`` errors apart;
2. every value is below, inside or above a bracket; counts below and above and
   the counts of the distinct values inside are combined map-side;
3. running counts over a bracket's distinct values (about 2 margin/accuracy of
   all rows) place the rank exactly.

The sketch's error bound is a guarantee, so no further round is needed; a rank
that missed its bracket would raise.  The interpolation is numpy's linear
method.

``auc``: the area under the ROC curve as a tie-aware rank sum; running counts
are cut at approximate quantiles, so no task orders all scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.operators._common import with_scalars

MARGIN = 4.0
BELOW, INSIDE, ABOVE = 0, 1, 2


def lerp(a: Column, b: Column, t: Column) -> Column:
    """numpy's linear interpolation (the b-side form for t >= 0.5)."""
    d = b - a
    return F.when(t >= 0.5, b - d * (F.lit(1.0) - t)).otherwise(a + d * t)


def _zones(x: Column, marks: Column, i: int) -> Column:
    """(bracket i, zone, value): the values inside a bracket, and the zone alone
    with the value as ``edge`` for the others."""
    a, b = marks[2 * i], marks[2 * i + 1]
    zone = F.when(x < a, BELOW).when(x > b, ABOVE).otherwise(INSIDE)
    return F.struct(F.lit(i).alias("i"), zone.alias("zone"), F.when(zone == INSIDE, x).alias("value"), x.alias("edge"))


def _at(rank: Column) -> Column:
    """The value of a rank among rows with running counts: a bracket's value, or
    the one next to it."""
    here = (F.col("before") <= rank) & (rank < F.col("upto"))
    found = (F.when(F.col("zone") == INSIDE, F.col("value"))
             .when((F.col("zone") == BELOW) & (rank == F.col("upto") - 1), F.col("high"))
             .when((F.col("zone") == ABOVE) & (rank == F.col("before")), F.col("low")))
    return F.max(F.when(here, found))


def quantiles(df: DataFrame, col: str, probs: dict[str, float], accuracy: int = 10000) -> DataFrame:
    """One row, one double column per entry of ``probs`` (name -> probability
    in [0, 1]); NULLs in ``col`` are ignored, an empty input gives NULLs.

    Lazy: two passes over ``df`` when the result is used, none before."""
    names = list(probs)
    eps = MARGIN / accuracy
    x = F.col("x")
    vals = df.select(F.col(col).cast("double").alias("x")).where(x.isNotNull())
    ends = [min(max(float(probs[n]) + side * eps, 0.0), 1.0) for n in names for side in (-1, 1)]
    marks = vals.agg(F.percentile_approx("x", ends, accuracy).alias("_marks"))
    tagged = with_scalars(vals, marks).select(F.inline(F.array(*[_zones(x, F.col("_marks"), i) for i in range(len(names))])))
    cells = tagged.groupBy("i", "zone", "value").agg(F.count(F.lit(1)).alias("n"), F.min("edge").alias("low"), F.max("edge").alias("high"))
    # a bracket's distinct values only: a small fixed share of the rows
    order = Window.partitionBy("i").orderBy("zone", "value")
    placed = (cells.withColumn("upto", F.sum("n").over(order)).withColumn("before", F.col("upto") - F.col("n"))
              .withColumn("total", F.sum("n").over(Window.partitionBy("i"))))
    p = F.element_at(F.array(*[F.lit(float(probs[n])) for n in names]), F.col("i") + 1)
    placed = placed.withColumn("h", (F.col("total") - 1) * p).withColumn("k", F.floor("h"))
    nearby = F.least(F.col("k") + 1, F.col("total") - 1)
    found = placed.groupBy("i").agg(_at(F.col("k")).alias("a"), _at(nearby).alias("b"), F.max(F.col("h") - F.col("k")).alias("t"))
    missed = F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")
    value = lerp(F.coalesce("a", missed), F.coalesce("b", missed), F.col("t"))
    return found.agg(*[F.max(F.when(F.col("i") == i, value)).alias(n) for i, n in enumerate(names)])


def auc(scores: DataFrame, label: str, score: str, by: tuple[str, ...] = (), parts: int = 256) -> DataFrame:
    """(by..., positives, negatives, auc): the share of (positive, negative) pairs
    in which the positive has the higher score, ties counting half.  NULL without
    either class; rows without label or score take no part."""
    s, y = F.col(score).cast("double"), F.col(label).cast("int")
    rows = scores.where(s.isNotNull() & y.isNotNull()).select(*by, s.alias("_s"), y.alias("_y"))
    cells = rows.groupBy(*by, "_s").agg(F.count_if(F.col("_y") == 1).alias("_pos"), F.count_if(F.col("_y") != 1).alias("_neg"))
    cuts = cells.groupBy(*by).agg(F.percentile_approx("_s", [i / parts for i in range(1, parts)], 10_000).alias("_cuts"))
    ranged = cells.join(cuts, list(by)) if by else with_scalars(cells, cuts)
    ranged = ranged.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_s")))).drop("_cuts")
    keys = [*by, "_range"]
    starts = ranged.groupBy(*keys).agg(F.sum("_neg").alias("_n"))
    starts = starts.select(*keys, (F.sum("_n").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_n")).alias("_start"))
    inside = Window.partitionBy(*keys).orderBy("_s")
    below = F.col("_start") + F.sum("_neg").over(inside) - F.col("_neg")
    # twice the pairs won, in whole numbers
    won = ranged.join(starts, keys).withColumn("_won", F.col("_pos").cast("decimal(19,0)") * (below * 2 + F.col("_neg")).cast("decimal(19,0)"))
    total = won.groupBy(*by).agg(F.sum("_won").alias("_won"), F.sum("_pos").alias("positives"), F.sum("_neg").alias("negatives"))
    pairs = F.col("positives").cast("double") * F.col("negatives").cast("double") * 2
    return total.select(*by, "positives", "negatives", F.try_divide(F.col("_won").cast("double"), F.nullif(pairs, F.lit(0.0))).alias("auc"))
