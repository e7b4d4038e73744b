"""RFM k-means segments with pyspark.ml, cluster labels and summaries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import round_even
from tillroll.operators._common import with_scalars
from tillroll.operators.customers import rfm
from tillroll.operators.stats import quantiles
from tillroll.schema import empty, has
from tillroll.sources.tables import write_table

# Segment names by cluster score (best first) and their actions.
SEGMENT_LABELS = ["Champions", "Loyal Customers", "At Risk", "Lost/Inactive"]
SEGMENT_ACTIONS = {
    "Champions": "reward_loyalty",
    "Loyal Customers": "upsell_premium",
    "At Risk": "win_back_campaign",
    "Lost/Inactive": "re_engagement_offer",
}
FEATURES = ["recency", "frequency", "monetary"]
Z_STEPS = 10_000


def _average_rank(col: str) -> F.Column:
    """Average rank (ties share the mean of their positions) over the k
    cluster rows."""
    w = Window.orderBy(col)
    ties = F.count(F.lit(1)).over(Window.partitionBy(col))
    return F.rank().over(w) + (ties - 1) / 2.0


def label_clusters(assigned: DataFrame, k: int, parity: bool = False) -> DataFrame:
    """Adds ``segment``: clusters ordered by rank(M) + rank(F) - rank(R) of
    their mean RFM (average ranks), best first, get the fixed labels; a 5th or
    6th cluster is "Segment 5"/"Segment 6" (NULL with ``parity``)."""
    means = assigned.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in FEATURES])
    # k rows: the unpartitioned windows below are over the cluster table only
    scored = (means.withColumn("_rm", _average_rank("monetary"))
                   .withColumn("_rf", _average_rank("frequency"))
                   .withColumn("_rr", _average_rank("recency"))
                   .withColumn("score", F.col("_rm") + F.col("_rf") - F.col("_rr")))
    order = scored.withColumn("_pos", F.row_number().over(
        Window.orderBy(F.col("score").desc(), F.col("cluster"))))
    names = F.array(*[F.lit(x) for x in SEGMENT_LABELS])
    label = F.when(F.col("_pos") <= len(SEGMENT_LABELS), F.element_at(names, F.col("_pos")))
    if not parity:
        label = F.coalesce(label, F.concat(F.lit("Segment "), F.col("_pos").cast("string")))
    labels = order.select("cluster", label.alias("segment"))
    return assigned.join(F.broadcast(labels), "cluster", "left")  # k rows


def kmeans_segments(sales: DataFrame, k: int = 4, restarts: int = 1, seed: int = 42,
                    parity: bool = False) -> DataFrame:
    """Standardised RFM -> k-means (k-means|| starts; best of
    ``restarts`` seeds by training cost) -> labelled segments.  Fewer customers than k: the RFM table with
    NULL cluster / segment."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    from tillroll.session import cut_lineage

    r = rfm(sales)
    if not has(sales, "date", "customer_id", "revenue"):
        return empty(sales.sparkSession, "customer_id string, recency bigint, frequency bigint, "
                                         "monetary double, cluster int, segment string")
    r = cut_lineage(r)   # k-means iterates over it restarts x iterations times
    if r.limit(k).count() < k:
        return (r.withColumn("cluster", F.lit(None).cast("int"))
                 .withColumn("segment", F.lit(None).cast("string")))
    prep = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="raw"),
                            StandardScaler(inputCol="raw", outputCol="features",
                                           withMean=True, withStd=True)]).fit(r)
    x = cut_lineage(prep.transform(r))
    best = None
    for i in range(restarts):
        model = KMeans(k=k, seed=seed + i, featuresCol="features",
                       predictionCol="cluster").fit(x)
        cost = model.summary.trainingCost
        if best is None or cost < best[0]:
            best = (cost, model)
    assigned = best[1].transform(x).select("customer_id", *FEATURES,
                                           F.col("cluster").cast("int").alias("cluster"))
    return label_clusters(assigned, k, parity=parity)


def standardised(r: DataFrame) -> DataFrame:
    """RFM rows with whole-number features ``z0``, ``z1``, ``z2``: (value - mean) /
    population deviation in steps of 1 / ``Z_STEPS``.  Money counts in steps of
    1 / 10,000, so all sums are exact and no partitioning changes a digit."""
    whole = [F.col("recency").cast("long"), F.col("frequency").cast("long"), F.floor(F.col("monetary") * 10_000 + 0.5).cast("long")]
    r = r.withColumns({f"_x{i}": c for i, c in enumerate(whole)})
    exact = lambda c: F.sum(c.cast("decimal(38,0)")).cast("double")
    x = [F.col(f"_x{i}") for i in range(3)]
    sums = r.agg(F.count(F.lit(1)).cast("double").alias("_n"), *[exact(c).alias(f"_s{i}") for i, c in enumerate(x)],
                 *[exact(c.cast("decimal(19,0)") * c.cast("decimal(19,0)")).alias(f"_q{i}") for i, c in enumerate(x)])
    out = with_scalars(r, sums)
    for i in range(3):
        mean = F.col(f"_s{i}") / F.col("_n")
        sd = F.sqrt(F.greatest(F.col(f"_q{i}") / F.col("_n") - mean * mean, F.lit(0.0)))
        z = F.floor((x[i].cast("double") - mean) / F.when(sd > 0, sd).otherwise(1.0) * Z_STEPS + 0.5)
        out = out.withColumn(f"z{i}", z.cast("long"))
    return out.select(*r.columns, "z0", "z1", "z2").drop("_x0", "_x1", "_x2")


def lloyd_segments(sales: DataFrame, k: int = 4, rounds: int = 20, label: bool = True) -> DataFrame:
    """K-means whose result depends on the rows and k alone: equal on any
    partitioning, run and retry.

    Starts from k groups of equal size by monetary + frequency - recency (in
    deviations, cut at exact quantiles).  Then Lloyd steps in whole numbers:
    exact sums per cluster, centres rounded to a step, rows to the nearest
    centre, ties to the smaller cluster; a cluster that loses its rows keeps its
    centre.  Ends when the centres stay, or after ``rounds``.  The driver sees k
    centres a round."""
    if not has(sales, "date", "customer_id", "revenue"):
        return empty(sales.sparkSession, "customer_id string, recency bigint, frequency bigint, "
                                         "monetary double, cluster int, segment string")
    rows = write_table(standardised(rfm(sales)), "rfm-steps")
    score = F.col("z2") + F.col("z1") - F.col("z0")
    cuts = quantiles(rows.select(score.alias("s")), "s", {f"_c{i}": i / k for i in range(1, k)})
    group = sum(((score.cast("double") >= F.col(f"_c{i}")).cast("int") for i in range(1, k)), F.lit(0))
    current, centres = with_scalars(rows, cuts).withColumn("cluster", group).select(*rows.columns, "cluster"), None
    z = ["z0", "z1", "z2"]
    for _ in range(rounds):
        sums = current.groupBy("cluster").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(c).cast("double").alias(c) for c in z])
        found = {r["cluster"]: tuple(math.floor(r[c] / r["n"] + 0.5) for c in z) for r in sums.collect()}
        new = [found.get(i, centres[i] if centres else (0, 0, 0)) for i in range(k)]
        if new == centres:
            break
        centres = new
        far = [sum(((F.col(c) - F.lit(v)) * (F.col(c) - F.lit(v)) for c, v in zip(z, centre)), F.lit(0)) for centre in centres]
        nearest = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(far)]))["i"]
        current = rows.withColumn("cluster", nearest.cast("int"))
    out = current.select("customer_id", *FEATURES, "cluster")
    return label_clusters(out, k) if label else out


def segment_summary(segmented: DataFrame) -> DataFrame:
    """Per labelled segment: customers, mean R (whole days), mean F (1 dp),
    mean M (2 dp), total M; by total revenue, largest first."""
    s = segmented.filter(F.col("segment").isNotNull()).groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"), F.avg("recency").alias("r"),
        F.avg("frequency").alias("f"), F.avg("monetary").alias("m"),
        F.sum("monetary").alias("total_revenue"))
    return s.select("segment", "customers", round_even("r", 0).cast("bigint").alias("avg_recency"),
                    round_even("f", 1).alias("avg_frequency"),
                    round_even("m", 2).alias("avg_monetary"), "total_revenue") \
            .orderBy(F.col("total_revenue").desc())


def segment_insights(summary: DataFrame) -> DataFrame:
    actions = summary.sparkSession.createDataFrame(list(SEGMENT_ACTIONS.items()),
                                                   "segment string, action string")
    return summary.join(F.broadcast(actions), "segment", "left").select(
        "segment", "customers", "avg_monetary", F.coalesce("action", F.lit("review_segment")).alias("action"))
