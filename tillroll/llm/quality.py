"""Quality classifier: naive Bayes support vectors (Wang and Manning, 2012).

Features are indicators of character n-grams (1 to 3 UTF-8 bytes) of the whole
text, and of word n-grams that repeat one word 2 to 9 times.  Each indicator is scaled by its log-count ratio between the classes, the
vector is scaled to unit length, and a linear hinge-loss model is fitted by
dual coordinate descent (Hsieh et al., 2008).  The score is the logistic
function of the margin.

Fitting uses a bounded sample: at most ``MAX_TRAIN`` labelled documents, taken
by hashed id, so the fit is one small task whatever the corpus.  Scoring is one
pass over all documents with the weights (``N_FEATURES`` numbers, a fixed size)
sent to the tasks; there is no shuffle of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tillroll.llm._common import P, table, without
from tillroll.session import ship_package

TRIGRAM_BITS = 18
REPEATS = 8         # word n-grams of one repeated word, n = 2 to 9
N_FEATURES = 256 + 65_536 + (1 << TRIGRAM_BITS) + REPEATS
MAX_TRAIN = 8_000
COST = 10.0         # upper bound of the dual variables
EPOCHS = 20
SMOOTHING = 1.0     # added to every count before the log ratio
STEEPNESS = 4.0     # margin to score
SEED = 6


# --- features ---------------------------------------------------------------

class Grams:
    """Distinct feature numbers of a text: bytes, byte pairs, hashed byte
    triples, and word n-grams that repeat one word."""

    def __init__(self) -> None:
        self.seen = np.zeros(N_FEATURES, dtype=bool)

    def of(self, text: str | None) -> np.ndarray:
        a = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
        pair = (a[:-1] << 8) | a[1:]
        triple = ((pair[:-1] << 8) | a[2:]) * np.uint32(2654435761) >> np.uint32(32 - TRIGRAM_BITS)
        seen = self.seen
        seen[a] = True
        seen[pair + np.uint32(256)] = True
        seen[triple + np.uint32(256 + 65_536)] = True
        longest = run = 0
        words = (text or "").split()
        for same in map(eq, words, islice(words, 1, None)):
            run = run + 1 if same else 0
            longest = max(longest, run)
        seen[N_FEATURES - REPEATS:N_FEATURES - REPEATS + min(longest, REPEATS)] = True
        found = np.flatnonzero(seen).astype(np.int32)
        seen[found] = False
        return found


def gram_features(text: str) -> Column:
    """The distinct feature numbers of a text column, ascending."""
    @pandas_udf("array<int>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grams = Grams()
        for s in texts:
            yield pd.Series([grams.of(t) for t in s])

    return of(F.col(text))


# --- model ------------------------------------------------------------------

def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """log of (smoothed share of a feature in class 1) / (the same in class 0)."""
    counts = [np.full(N_FEATURES, SMOOTHING), np.full(N_FEATURES, SMOOTHING)]
    for row, y in zip(rows, labels):
        counts[int(y)][row] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = COST, epochs: int = EPOCHS,
        seed: int = SEED) -> tuple[np.ndarray, float]:
    """(weight per feature, bias) of margin(x) = weight . (r x) / |r x| + bias.

    Minimises |w|^2 / 2 + cost * sum of hinge losses, one dual variable at a
    time in random order.  Without both classes, the margin is a constant."""
    if len(rows) == 0 or labels.min() == labels.max():
        return np.zeros(N_FEATURES), (1.0 if len(rows) == 0 or labels[0] else -1.0)
    ratio = log_count_ratios(rows, labels)
    scaled = [ratio[row] for row in rows]
    scaled = [x / (np.sqrt(x @ x) or 1.0) for x in scaled]
    y = np.where(labels > 0, 1.0, -1.0)
    w, bias, alpha = np.zeros(N_FEATURES), 0.0, np.zeros(len(rows))
    square = np.array([x @ x + 1.0 for x in scaled])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            row, x = rows[i], scaled[i]
            slope = y[i] * (w[row] @ x + bias) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[row] += step * x
                bias += step
                alpha[i] = new
    return w, bias


def margins(rows: Iterator[np.ndarray], ratio: np.ndarray, w: np.ndarray, bias: float) -> Iterator[float]:
    """The margin of every row of feature numbers; the bias for an empty one."""
    weight, square = ratio * w, ratio * ratio
    for row in rows:
        norm = np.sqrt(square[row].sum())
        yield weight[row].sum() / norm + bias if norm else bias


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", max_train: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray, float]:
    """(ratios, weights, bias) from at most ``max_train`` labelled documents.

    Labels other than 0 and 1 and ids with contradicting labels are left out.
    The sample's ids are broadcast (at most ``max_train`` rows); its feature
    lists meet in one task, which returns the model as ``N_FEATURES`` rows at
    most."""
    known = (labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col)
             .agg(F.min(label_col).alias(f"{P}y"), F.max(label_col).alias(f"{P}z")).where(f"{P}y = {P}z"))
    sample = known.orderBy(F.xxhash64(F.lit(SEED), id_col), id_col).limit(max_train).select(id_col, f"{P}y")
    rows = (docs.select(id_col, text_col).join(F.broadcast(sample), id_col)
            .select(F.col(id_col).alias("id"), F.col(f"{P}y").alias("y"), gram_features(text_col).alias("grams"))
            .groupBy("id", "y").agg(F.min("grams").alias("grams")))

    def fit_one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        grams, y = [np.asarray(g, dtype=np.int32) for g in part["grams"]], part["y"].to_numpy()
        w, bias = fit(grams, y)
        ratio = log_count_ratios(grams, y) if len(set(y)) > 1 else np.zeros(N_FEATURES)
        at = np.concatenate([np.flatnonzero(w), [N_FEATURES]])
        return pd.DataFrame({"at": at, "ratio": np.append(ratio[at[:-1]], 0.0), "weight": np.append(w[at[:-1]], bias)})

    model = (rows.groupBy(F.lit(0).alias("all")).applyInPandas(fit_one, "at long, ratio double, weight double")
             .toPandas())
    w, ratio, bias = np.zeros(N_FEATURES), np.zeros(N_FEATURES), 1.0
    if len(model):
        own = model[model["at"] < N_FEATURES]
        w[own["at"].to_numpy()], ratio[own["at"].to_numpy()] = own["weight"], own["ratio"]
        bias = float(model.loc[model["at"] == N_FEATURES, "weight"].iloc[0])
    return ratio, w, bias


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  train_docs: DataFrame | None = None, **options) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier) and
    ``predicted`` (1 if score >= 0.5).

    Every text is scored whole; a null text is an empty one, and texts without
    features get the score of the bias.  Without labels, or with labels of one
    class, all documents get the same score, on that class's side (class 1
    without labels).  Repeated rows get equal scores; an empty table gives an
    empty result; input columns named score or predicted are replaced."""
    ship_package(docs.sparkSession)
    ratio, w, bias = train(docs if train_docs is None else train_docs, labels, id_col, text_col, **options)
    # what the margin needs per feature, in single precision: fixed size
    model = docs.sparkSession.sparkContext.broadcast((ratio.astype(np.float32), w.astype(np.float32), bias))

    @pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grams = Grams()
        r, v, b = model.value
        for s in texts:
            m = np.fromiter(margins((grams.of(t) for t in s), r, v, b), dtype=float, count=len(s))
            yield pd.Series(1.0 / (1.0 + np.exp(-STEEPNESS * m)))

    docs = without(docs, "score", "predicted")
    return (docs.withColumn("score", score(F.col(text_col)))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def held_out(id_col: str = "doc_id"):
    """Rows kept from training: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def score_corpus(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All documents scored by a model that saw no held-out label."""
    return score_quality(docs, labels.where(~held_out()).select("doc_id", "quality"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return (score_corpus(docs, table(spark, sf_dir, "labels"))
            .select("doc_id", held_out().alias("held_out"), "score", "predicted"))
