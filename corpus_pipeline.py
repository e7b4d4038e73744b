"""Training-corpus pipeline over ``documents``.

quality -> line_dedup -> near_dedup -> mixing -> packing.  Each stage takes
(spark, docs, sf_dir) and returns a DataFrame that ``run`` writes as Parquet
into the shared checkpoint folder and reads again as the next stage's input, so
a lost executor or a failed stage restarts from files.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm._common import table, written
from tillroll.llm.line_dedup import dedup_lines
from tillroll.llm.mixing import attributes, mix
from tillroll.llm.packing import pack, word_count
from tillroll.llm.quality import held_out, score_quality
from tillroll.llm.simhash import drop_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; unlabelled, empty and null
    texts are scored like any other."""
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "quality")
    return score_quality(docs, labels).where(F.col("predicted") == 1).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without lines that an earlier line repeats;
    ``n_chars`` follows the text."""
    out = dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
                             .cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return drop_near_copies(docs).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the target shares of source, language and
    topic."""
    return mix(attributes(docs)).where("sampled").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its length bucket, batch and place in the batch."""
    return pack(docs, word_count("text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus of the tables in ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


# The classifier, the Golay search and the topics can't be written in SQL; the
# stages are tested against brute force in tests/llm.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
