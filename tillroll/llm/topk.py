"""Exact top-k search by tiled matrix products.

Queries and rows are dealt into blocks of bounded size by hashed id.  Every
(query block, row block) tile is one matrix product; each tile keeps the best k
of each query; the lists are merged in a tree of groups of ``FAN_IN`` lists.

Scale: the work is queries x rows by definition; a tile holds at most about
``BLOCK_QUERIES`` + ``BLOCK_ROWS`` vectors, whatever the table.  A tile's
product is processed in slices of bounded size, and a merge task never holds
more than FAN_IN * k entries of a query.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm._common import P, table, written
from tillroll.session import ship_package

K = 5
SCALE = 256
EVERY = 50
BLOCK_QUERIES = 2_048
BLOCK_ROWS = 16_384
FAN_IN = 32
EXACT = float(1 << 53)   # integers below it are exact in double precision


def usable(vector: str) -> Column:
    """Vectors without null, NaN or infinite components (empty ones take no part)."""
    v = F.col(vector)
    good = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(v) > 0) & good, F.lit(False))


def one_per_id(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): usable vectors of the most frequent length (of equally frequent
    ones, the shortest), as doubles.  Repeated ids count once, with the smallest
    of their vectors; rows without id take no part."""
    v = F.col(vector_col).cast("array<double>")
    rows = (vectors.where(F.col(id_col).isNotNull() & usable(vector_col)).select(F.col(id_col).alias("id"), v.alias("v"))
            .groupBy("id").agg(F.min("v").alias("v")))
    rows = written(rows, "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (sizes["d"] if sizes else 0))


def block(n: int, size: int) -> tuple[int, Column]:
    """(number of blocks, block of an id) for n ids in blocks of about ``size``."""
    parts = max(1, math.ceil(n / size))
    return parts, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of each row, ties to the smaller id.  ``ids`` must
    ascend."""
    if scores.shape[1] > k:
        bound = -np.partition(-scores, k - 1, axis=1)[:, k - 1:k]
        row, col = np.nonzero(scores >= bound)        # ascending ids in a row
    else:
        row, col = np.divmod(np.arange(scores.size), scores.shape[1] or 1)
    value = scores[row, col]
    order = np.lexsort((ids[col], -value, row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(scores.shape[0]))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], col[keep]


def integer_products(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Exact integer inner products as int64: in double precision where every
    partial sum is below 2^53, else in Python integers, limited to the range of
    a long."""
    top = np.abs(q).max(initial=0.0) * np.abs(r).max(initial=0.0) * max(1, q.shape[1])
    if top < EXACT:
        return (q @ r.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in q.tolist()], dtype=object) @ \
        np.array([[int(x) for x in row] for row in r.tolist()], dtype=object).T
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([[min(max(x, low), high) for x in row] for row in exact], dtype=np.int64).reshape(exact.shape)


def tile_top(k: int):
    """One tile: queries (id, v) and rows (id, v) -> the k best of each query."""
    def of(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(queries) and len(rows):
            rows = rows.sort_values("id")
            rid, r = rows["id"].to_numpy(), np.stack(rows["v"].to_numpy())
            for at in range(0, len(queries), 256):
                part = queries.iloc[at:at + 256]
                qid, q = part["id"].to_numpy(), np.stack(part["v"].to_numpy())
                score = integer_products(q, r)
                own = np.searchsorted(rid, qid)
                own = np.where((own < len(rid)) & (rid[np.minimum(own, len(rid) - 1)] == qid), own, -1)
                row, col = best(rid, score, k + 1)       # one more, for the query's own row
                other = col != own[row]
                row, col = row[other], col[other]
                place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(qid)))[row]
                row, col = row[place < k], col[place < k]
                out.append(pd.DataFrame({"query_id": qid[row], "part": np.int64(key[1]), "vec_id": rid[col],
                                         "score": score[row, col]}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in
                                                        ("query_id", "part", "vec_id", "score")})

    return of


def merged(lists: DataFrame, parts: int, k: int) -> DataFrame:
    """Tree merge: the lists of FAN_IN neighbouring parts become one, level by
    level, until each query has one list."""
    entry = F.struct((-F.col("score")).alias("low"), F.col("vec_id"), F.col("score"))
    tops = lists.groupBy("query_id", "part").agg(F.sort_array(F.collect_list(entry)).alias("top"))
    while parts > 1:
        tops = (tops.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("query_id", "part")
                .agg(F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top")))
        parts = math.ceil(parts / FAN_IN)
    return tops.select("query_id", F.posexplode("top").alias("at", "e")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "e.vec_id", "e.score")


def exact_top_k(queries: DataFrame, rows: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query (id, v) the k rows (id,
    v) of highest inner product but its own id, ties to the smaller id; all of
    them where there are fewer.  ``v`` holds integers as doubles.  Both tables
    must hold usable vectors of one length, once per id (``one_per_id`` makes
    them so from any rows); empty tables give no rows."""
    ship_package(rows.sparkSession)
    n_q, n_r = queries.count(), rows.count()
    q_parts, q_block = block(n_q, BLOCK_QUERIES)
    r_parts, r_block = block(n_r, BLOCK_ROWS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(q_block.alias("qb"), every(r_parts).alias("rb"), "id", "v")
    right = rows.select(every(q_parts).alias("qb"), r_block.alias("rb"), "id", "v")
    tiles = q_parts * r_parts
    lists = (left.repartition(tiles, "qb", "rb").groupBy("qb", "rb")
             .cogroup(right.repartition(tiles, "qb", "rb").groupBy("qb", "rb"))
             .applyInPandas(tile_top(k), "query_id long, part long, vec_id long, score long"))
    return merged(lists, r_parts, k)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = one_per_id(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    # a double of 2^52 or more has no fraction; those that leave the range of
    # doubles take no part
    whole = lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)
    rows = vectors.select("id", F.transform("v", lambda x: whole(x * SCALE)).alias("v")).where(usable("v"))
    found = exact_top_k(rows.where(F.col("id") % EVERY == 0), rows, K)
    return found.select("query_id", "rank", "vec_id", "score")


OP5_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
pairs AS (SELECT q.vec_id AS query_id, r.vec_id, list_sum([CAST(q.e[i] * r.e[i] AS HUGEINT) FOR i IN range(1, len(q.e) + 1)]) AS score
          FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM pairs)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 5
"""
