"""Churn labels, rule-based and random-forest churn scores, risk reports."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import round_even, share_pct
from tillroll.operators._common import reuse, with_scalars
from tillroll.operators.customers import customer_features
from tillroll.operators.stats import auc, quantiles
from tillroll.session import checkpoint_dir, cut_lineage
from tillroll.sources.tables import path_exists

# Fixed values of the churn rules.
CHURN_DAYS = 90
RISK_BANDS = [(0.75, "High Risk"), (0.45, "Medium Risk"), (0.20, "Low Risk")]
SAFE = "Safe"
FEATURES = ["days_since_last_order", "total_orders", "avg_order_value", "total_revenue",
            "customer_age_days", "order_frequency"]


def risk_level(prob) -> F.Column:
    p = F.col(prob) if isinstance(prob, str) else prob
    expr = None
    for threshold, label in RISK_BANDS:
        cond = p >= F.lit(threshold)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(SAFE))


def label_churn(features: DataFrame, churn_days: int = CHURN_DAYS) -> DataFrame:
    return features.withColumn(
        "churned", (F.col("days_since_last_order") >= churn_days).cast("int"))


def churn_rule(sales: DataFrame) -> DataFrame:
    """Features, label, and the rule score days / max(days) rounded to 3
    (what the model falls back to), with its risk level."""
    f = reuse(label_churn(customer_features(sales)))
    mx = f.agg(F.max("days_since_last_order").alias("_max_days"))
    s = with_scalars(f, mx).withColumn(
        "churn_probability",
        round_even(F.try_divide(F.col("days_since_last_order").cast("double"),
                                F.nullif(F.col("_max_days").cast("double"), F.lit(0.0))), 3))
    return s.drop("_max_days").withColumn("risk_level", risk_level("churn_probability"))


def risk_distribution(scores: DataFrame) -> DataFrame:
    return scores.groupBy("risk_level").agg(F.count(F.lit(1)).alias("customers"))


def top_high_risk(scores: DataFrame, n: int = 10) -> DataFrame:
    return (scores.filter(F.col("risk_level") == RISK_BANDS[0][1])
            .orderBy(F.col("churn_probability").desc(), F.col("customer_id"))
            .limit(n)
            .select("customer_id", "churn_probability", "days_since_last_order", "total_orders",
                    "avg_order_value"))


def churn_histogram(scores: DataFrame, bins: int = 20) -> DataFrame:
    """Fixed-width probability bins over [0, 1]; 1.0 falls in the last bin."""
    b = F.least(F.floor(F.col("churn_probability") * bins), F.lit(bins - 1)).cast("int")
    return (scores.filter(F.col("churn_probability").isNotNull())
            .groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("customers"))
            .select("bin", (F.col("bin") / F.lit(float(bins))).alias("bin_start"),
                    ((F.col("bin") + 1) / F.lit(float(bins))).alias("bin_end"), "customers"))


def churn_insights(scores: DataFrame) -> DataFrame:
    """High / medium risk counts and shares; high-risk customers whose mean
    line revenue is above the median of all customers."""
    med = quantiles(scores, "avg_order_value", {"median_aov": 0.5})
    p = F.col("churn_probability")
    s = with_scalars(scores, med)
    return s.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(p >= 0.75).alias("high_risk"),
        F.count_if((p >= 0.45) & (p < 0.75)).alias("medium_risk"),
        F.count_if((p >= 0.75) & (F.col("avg_order_value") > F.col("median_aov")))
         .alias("high_value_high_risk"),
        F.first("median_aov").alias("median_aov"),
    ).select("customers", "high_risk",
             share_pct("high_risk", "customers").alias("high_risk_pct"),
             "medium_risk",
             share_pct("medium_risk", "customers").alias("medium_risk_pct"),
             "high_value_high_risk", "median_aov")


# --------------------------------------------------------------------------
# Random-forest model (pyspark.ml; distributed training)
# --------------------------------------------------------------------------
CUSTOMERS_A_TASK = 50_000     # of the rows that a hundred trees pass over, level by level

def split_stratified(features: DataFrame, test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: in each class a share ``test_fraction`` of the rows
    (rounded, but at least one row stays on either side of a class of two or
    more), in an order hashed from the customer.

    Rows are numbered in 4,096 hash ranges per class whose counts give each
    range its start, so no task orders a whole class."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("customer_id").cast("string")))
    rows = features.withColumn("_key", key).withColumn("_part", F.substring("_key", 1, 3))
    parts = rows.groupBy("churned", "_part").agg(F.count(F.lit(1)).alias("_n"))
    by_class = Window.partitionBy("churned")                 # at most 4,096 rows each
    starts = parts.select("churned", "_part", (F.sum("_n").over(by_class.orderBy("_part")) - F.col("_n")).alias("_start"),
                          F.sum("_n").over(by_class).alias("_all"))
    place = F.col("_start") + F.row_number().over(Window.partitionBy("churned", "_part").orderBy("_key", "customer_id"))
    size = F.greatest(F.round(F.col("_all") * F.lit(test_fraction)), F.lit(1))
    size = F.least(size, F.col("_all") - 1)
    return (rows.join(F.broadcast(starts), ["churned", "_part"]).withColumn("is_test", place <= size)
            .drop("_key", "_part", "_start", "_all"))


@dataclass(frozen=True)
class ChurnModel:
    """A fitted pipeline in the shared folder and its metrics on the test part;
    without a path, the rule scores stand in for it."""

    path: str | None
    metrics: dict[str, float]

    @property
    def method(self) -> str:
        return "model" if self.path else "rule"


def model_features(sales: DataFrame) -> DataFrame:
    """The labelled features a model is fitted to and scores."""
    return label_churn(customer_features(sales)).na.fill(0, subset=FEATURES)


def model_folder(features: DataFrame, *params: object) -> str:
    """Where the model of these rows and parameters is kept: equal data, in any
    order and partitioning, and equal parameters give the same folder."""
    hashed = features.select(F.xxhash64("customer_id", "churned", *FEATURES).alias("h"))
    stamp = hashed.agg(F.count(F.lit(1)), F.expr("bit_xor(h)"), F.sum(F.col("h").cast("decimal(38,0)")))
    text = "|".join(map(str, [*stamp.first(), *params]))
    name = hashlib.sha256(text.encode()).hexdigest()[:16]
    return f"{checkpoint_dir(features.sparkSession).rstrip('/')}/churn-model-{name}"


def fit_churn(features: DataFrame, num_trees: int = 100, max_depth: int = 6, seed: int = 42,
              test_fraction: float = 0.2, min_customers: int = 10) -> ChurnModel:
    """Fit scaler + random forest on the training part with balanced class
    weights, save the pipeline and its metrics in the shared folder, and return
    where they are.  Rows and parameters that were fitted before are read back:
    nothing is trained twice, in this session or a later one.

    No model with fewer than ``min_customers`` customers, a single class, or a
    class of fewer than two."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    spark = features.sparkSession
    folder = model_folder(features, num_trees, max_depth, seed, test_fraction, min_customers)
    if path_exists(spark, f"{folder}/metrics/_SUCCESS"):
        kept = {r["metric"]: r["value"] for r in spark.read.parquet(f"{folder}/metrics").collect()}
        return ChurnModel(f"{folder}/pipeline" if kept else None, kept)
    f = cut_lineage(features)
    counts = {r["churned"]: r["n"] for r in
              f.groupBy("churned").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    metrics: dict[str, float] = {}
    if len(counts) == 2 and total >= min_customers and min(counts.values()) >= 2:
        weights = spark.createDataFrame(
            [(int(k), float(total) / (2.0 * v)) for k, v in counts.items()], "churned int, w double")
        data = split_stratified(f, test_fraction, seed).join(F.broadcast(weights), "churned")
        tasks = -(-total // CUSTOMERS_A_TASK)
        if tasks > 1:        # a few MB of rows would be one task; the split is made once for all passes
            data = cut_lineage(data.repartition(tasks, "customer_id"))
        train, test = data.filter(~F.col("is_test")), data.filter(F.col("is_test"))
        stages = [VectorAssembler(inputCols=FEATURES, outputCol="raw"),
                  StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
                  RandomForestClassifier(labelCol="churned", featuresCol="features", weightCol="w",
                                         numTrees=num_trees, maxDepth=max_depth, seed=seed)]
        model = Pipeline(stages=stages).fit(train)
        model.write().overwrite().save(f"{folder}/pipeline")
        tested = model.transform(test).withColumn("_p", vector_to_array("probability")[1])
        area = auc(tested, "churned", "_p").first()["auc"]
        acc = MulticlassClassificationEvaluator(labelCol="churned", metricName="accuracy",
                                                predictionCol="prediction").evaluate(tested)
        metrics = {"auc": round(area, 3), "accuracy": round(acc, 3)}
    (spark.createDataFrame(list(metrics.items()), "metric string, value double").coalesce(1)     # two rows
     .write.mode("overwrite").parquet(f"{folder}/metrics"))
    return ChurnModel(f"{folder}/pipeline" if metrics else None, metrics)


def score_churn(features: DataFrame, model: ChurnModel) -> DataFrame:
    """Features, label, the saved model's probability rounded to 3 and its risk
    level; a read and a projection, nothing is fitted."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    out = PipelineModel.load(model.path).transform(features).withColumn(
        "churn_probability", round_even(vector_to_array("probability")[1], 3))
    cols = ["customer_id"] + FEATURES + ["churned", "churn_probability"]
    return out.select(*cols).withColumn("risk_level", risk_level("churn_probability")).withColumn("method", F.lit(model.method))


def train_churn(sales: DataFrame, **options):
    """(scores DataFrame, metrics dict) of ``fit_churn`` and ``score_churn``, or of
    the rule where no model can be fitted.  ``method`` says which of the two
    ("model" or "rule") made the scores."""
    features = reuse(model_features(sales))
    model = fit_churn(features, **options)
    if model.path is None:
        return churn_rule(sales).withColumn("method", F.lit(model.method)), {}
    return score_churn(features, model), model.metrics


def churn_model_scores(sales: DataFrame) -> DataFrame:
    scores, _ = train_churn(sales)
    return scores


def churn_metrics(sales: DataFrame, **options) -> DataFrame:
    """(metric, value): AUC and accuracy on the test part; empty for the rule."""
    metrics = fit_churn(reuse(model_features(sales)), **options).metrics
    return sales.sparkSession.createDataFrame(list(metrics.items()), "metric string, value double")


def feature_auc(sales: DataFrame) -> DataFrame:
    """(feature, positives, negatives, auc): how well each feature alone orders
    churned customers above the others, exactly."""
    f = model_features(sales)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in FEATURES]))
    return auc(f.select("churned", pairs.alias("f")).select("churned", "f.*"), "churned", "value", by=("feature",))


def churn_split_sizes(sales: DataFrame) -> DataFrame:
    """(churned, customers, test): class sizes and their test parts."""
    split = split_stratified(label_churn(customer_features(sales)))
    return split.groupBy("churned").agg(F.count(F.lit(1)).alias("customers"), F.count_if("is_test").alias("test"))
