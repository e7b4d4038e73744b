"""Packing into optimal length buckets.

The global histogram of token counts is small (lengths, not documents).  A
dynamic programme over it chooses the bucket boundaries that minimise the
total padding when every document is padded to its bucket's boundary.  Inside
each bucket, documents in seeded-shuffled order form batches whose padded size
stays within the token budget.

Scale: the histogram is one map-side-combined aggregate with one row per
distinct length, so its size is bounded by the lengths that occur, of which few
are long, and not by the number of documents.  Places inside a bucket come from
``positions``: no task holds a whole bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm._common import P, buckets_for, positions, shuffle_key, table, unit, without, written

N_BUCKETS = 16
TOKEN_BUDGET = 32_768
SEED = 4


def word_count(text: str) -> Column:
    """Words between ASCII white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def binned(length: Column) -> Column:
    """Exact up to 4,096; above, rounded up to the edge of one of 4,096 bins
    per power of two.  ``pack`` does not round: its lengths are exact."""
    step = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(length)) - F.lit(13), F.lit(0)))
    return F.when(length <= 4096, length).otherwise((F.ceil(length / step) * step).cast("long"))


def optimal_boundaries(histogram: dict[int, int], n_buckets: int) -> list[int]:
    """The at most ``n_buckets`` upper lengths that minimise total padding.

    best(k, j) = min over i of best(k-1, i) + L[j] * (C[j+1] - C[i]): for fixed
    j the candidates are lines in L[j] with falling slopes -C[i], so each layer
    is answered along a lower hull in linear time."""
    lengths = sorted(histogram)
    if not lengths:
        return []
    cum = [0]
    for length in lengths:
        cum.append(cum[-1] + histogram[length])
    d = len(lengths)
    best = [lengths[j] * cum[j + 1] for j in range(d)]
    cuts: list[list[int]] = [[0] * d]
    for _ in range(1, min(n_buckets, d)):
        hull: list[tuple[int, int, int]] = []     # slope, intercept, first length of the last bucket
        at, now, cut = 0, [0] * d, [0] * d
        for j in range(d):
            m, c = -cum[j], (best[j - 1] if j else 0)
            while len(hull) >= 2:
                (m1, c1, _), (m2, c2, _) = hull[-2], hull[-1]
                if (c - c1) * (m1 - m2) > (c2 - c1) * (m1 - m):
                    break
                hull.pop()
            hull.append((m, c, j))
            at = min(at, len(hull) - 1)
            x = lengths[j]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            now[j] = hull[at][0] * x + hull[at][1] + x * cum[j + 1]
            cut[j] = hull[at][2]
        best = now
        cuts.append(cut)
    edges, j = [], d - 1
    for layer in reversed(cuts):
        edges.append(lengths[j])
        j = layer[j] - 1
        if j < 0:
            break
    return edges[::-1]


def pack(docs: DataFrame, length: Column, n_buckets: int = N_BUCKETS, token_budget: int = TOKEN_BUDGET,
         id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """``docs`` with ``n_tokens``, ``bucket`` (from 0, shortest first),
    ``bucket_len`` (padded length), ``batch`` (gapless from 0 over all buckets)
    and ``place`` (from 0 in the batch).

    A batch holds floor(budget / bucket_len) documents, at least one: a
    document longer than the budget is a batch of its own, never cut.
    Documents without tokens belong to the shortest bucket.  Repeated rows are
    packed each; an empty table gives an empty result; input columns with the
    result's names are replaced."""
    out = ["n_tokens", "bucket", "bucket_len", "batch", "place"]
    measured = docs.withColumn(f"{P}n", length)
    docs = without(measured, *out).withColumnRenamed(f"{P}n", "n_tokens")
    cols = docs.columns
    rows = written(docs.withColumn(f"{P}len", F.col("n_tokens"))
                   .withColumn(f"{P}key", shuffle_key(seed, id_col, "n_tokens")), "pack-rows")
    histogram = {r[0]: r[1] for r in rows.groupBy(f"{P}len").count().collect()}
    edges = optimal_boundaries(histogram, n_buckets)
    parts = buckets_for(sum(histogram.values()))
    bucket, width, per, first = F.lit(0), F.lit(0), F.lit(1), F.lit(0)
    low, n_batches, plan = -1, 0, []
    for b, edge in enumerate(edges):
        size = max(1, token_budget // max(1, edge))
        plan.append((b, edge, size, n_batches))
        n_batches += -(-sum(n for x, n in histogram.items() if low < x <= edge) // size)
        low = edge
    for b, edge, size, start in reversed(plan):
        fits = F.col(f"{P}len") <= edge
        bucket, width = F.when(fits, F.lit(b)).otherwise(bucket), F.when(fits, F.lit(edge)).otherwise(width)
        per, first = F.when(fits, F.lit(size)).otherwise(per), F.when(fits, F.lit(start)).otherwise(first)
    rows = (rows.withColumn("bucket", bucket.cast("int")).withColumn("bucket_len", width.cast("long"))
            .withColumn(f"{P}per", per.cast("long")).withColumn(f"{P}first", first.cast("long"))
            .withColumn(f"{P}part", F.floor(unit(F.col(f"{P}key")) * parts).cast("long")))
    placed = positions(rows, ["bucket"], f"{P}part", [f"{P}key"], f"{P}pos")
    return placed.select(*cols, "bucket", "bucket_len",
                         (F.col(f"{P}first") + F.expr(f"{P}pos div {P}per")).alias("batch"),
                         (F.col(f"{P}pos") % F.col(f"{P}per")).cast("int").alias("place"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(docs.select("doc_id", word_count("text").alias("words")), F.col("words")).drop("words")
