"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded key inside each source, the i-th of the n rows
of a source gets the fractional rank (i + u) / n, and all rows are sorted by
it; u is a seeded number from 0 to 1 per source, so that small sources do not
meet in one place.  Every stretch of that order holds the sources in their global
proportions, so cutting it into equal stretches gives shards that all match
the mixture, with row counts at most one apart.

Scale: a source is never sorted in one task.  Both orders are numbered through
``positions``: uniform parts of about 20,000 rows, counted first, numbered
inside the part, so a source with a third of all rows is many parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm._common import P, buckets_for, positions, shuffle_key, stratum, table, unit, without, written

N_SHARDS = 40
SEED = 20


def stratified_shards(rows: DataFrame, n_shards: int = N_SHARDS, by: str = "source",
                      order: tuple[str, ...] = ("doc_id",), seed: int = SEED) -> DataFrame:
    """``rows`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0
    inside the shard).

    ``order`` names the columns that identify a row for the seeded shuffle; a
    null source is a source of its own.  Rows that agree in all of ``order``
    are interchangeable and take neighbouring places.  An empty table gives an
    empty result; input columns named shard or slot are replaced."""
    rows = without(rows, "shard", "slot")
    cols = rows.columns
    keyed = written(rows.withColumn(f"{P}by", stratum(by)).withColumn(f"{P}key", shuffle_key(seed, *order)),
                    "shard-rows")
    n = keyed.count()
    parts = buckets_for(n)
    part = lambda frac: F.least(F.floor(frac * parts), F.lit(parts - 1)).cast("long")
    ranked = positions(keyed.withColumn(f"{P}part", part(unit(F.col(f"{P}key")))),
                       [f"{P}by"], f"{P}part", [f"{P}key"], f"{P}rank", f"{P}size")
    frac = (F.col(f"{P}rank") + unit(shuffle_key(seed, f"{P}by"))) / F.col(f"{P}size")
    placed = positions(ranked.withColumn(f"{P}frac", frac).withColumn(f"{P}part", part(F.col(f"{P}frac"))),
                       [], f"{P}part", [f"{P}frac", f"{P}key", f"{P}by"], f"{P}pos")
    pos = F.col(f"{P}pos")
    shard = F.expr(f"({P}pos * {n_shards}) div {max(n, 1)}")
    start = F.expr(f"({P}shard * {n} + {n_shards - 1}) div {n_shards}")
    return (placed.withColumn(f"{P}shard", shard).withColumn(f"{P}start", start)
            .select(*cols, F.col(f"{P}shard").cast("int").alias("shard"),
                    (pos - F.col(f"{P}start")).cast("long").alias("slot")))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard (``shard=k``), rows in slot order inside each file."""
    (sharded.repartition("shard").sortWithinPartitions("shard", "slot")
     .write.mode("overwrite").partitionBy("shard").parquet(path))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.encode(F.col("text"), "UTF-8")
    rows = docs.select("doc_id", "source",
                       (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(16)).cast("long").alias("size"),
                       F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"))
    out = stratified_shards(rows, N_SHARDS, "source", ("doc_id", "size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "source")


# CRC-32 byte by byte, with its table made from the polynomial; the seeded order
# and the cuts as in stratified_shards, by plain row numbers.
OP3_SQL = """
WITH RECURSIVE bits AS (
  SELECT i AS b, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tbl AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, source, coalesce(strlen(text), 0) + 16 AS size,
             [CAST('0x' || p AS BIGINT) FOR p IN regexp_extract_all(hex(coalesce(text, '')), '..')] AS bytes FROM documents),
c AS (SELECT doc_id, source, CAST(size AS BIGINT) AS size,
             xor(list_reduce(list_prepend(4294967295, bytes), lambda a, b: xor(t[CAST((xor(a, b) & 255) + 1 AS INT)], a >> 8)),
                 4294967295) AS text_crc32 FROM d, tbl),
k AS (SELECT *, coalesce('=' || source, 'null') AS stratum,
             md5('20|' || coalesce('=' || doc_id, 'null') || '|=' || size || '|=' || text_crc32) AS key FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY key) - 1 AS rank, count(*) OVER (PARTITION BY stratum) AS n_s,
             CAST('0x' || substr(md5('20|=' || stratum), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY (rank + u) / n_s, key, stratum) - 1 AS pos, count(*) OVER () AS n FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(pos * 40 // n AS INT) AS shard,
       pos - (pos * 40 // n * n + 39) // 40 AS slot, CAST(NULL AS INT) AS grown_shard, source FROM p
"""
