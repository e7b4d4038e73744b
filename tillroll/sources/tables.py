"""Written tables in the shared checkpoint folder.

Writing an intermediate result and reading it back cuts its lineage: after a
lost executor, work restarts from the files, not from the raw scans.  The
folder is the cluster's ``spark.checkpoint.dir`` (see ``session``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tillroll.session import checkpoint_dir


def write_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex[:8]}"
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder, in whatever store the path names?"""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
