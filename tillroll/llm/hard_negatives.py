"""Hard negatives by slots of scores.

An anchor's positives are its best rows of its own label.  Each positive opens
a window of scores: a negative counts when its score is between ``low`` and
``high`` hundredths of the positive's.  The windows of one anchor overlap, but
their upper limits cut the scores into disjoint slots, and the best rows of a
window are the best of its topmost slot, then of the next slot down, and so on.
So one pass over the rows keeps the best k of every (anchor, slot), and the
suffixes of an anchor's slots, from a positive's own slot downwards, answer all
of its windows; the lower limit then only shortens an answer.

1. positives: tiles of (label, anchor block, row block), best rows per tile,
   lists merged in a tree;
2. limits: the distinct upper limits of each anchor, at most one a positive;
3. slots: tiles of (anchor block, row block); inside a tile a combiner keeps
   the first k of each slot; lists merged in a tree per (anchor, slot);
4. answers: descending suffixes of at most positives x k entries an anchor.

Scale: the work is anchors x rows by definition.  Blocks are dealt by hashed id
and have bounded sizes, a label with a third of all rows is many blocks, and
nothing but numbers of blocks reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm._common import P, table, written
from tillroll.llm.topk import integer_products, merged, tile_top, usable
from tillroll.session import ship_package

POSITIVES = 5
K = 3
LOW, HIGH, WHOLE = 50, 95, 100
EVERY = 50
SCALE = 256
BLOCK_ANCHORS = 2_048
BLOCK_ROWS = 16_384
MAX_TASKS = 20_000
SLICE = 256                      # anchors of a tile whose scores are in memory at once
NO_LIMIT = np.iinfo(np.int64).max
LISTS = "query_id long, part long, vec_id long, score long"
SLOT_LISTS = "anchor_id long, slot int, part long, vec_id long, score long"


def usable_rows(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, v, d): rows with an id, a label and a vector of ``d`` > 0
    finite components.  Repeated ids count once, with the smallest (label,
    vector)."""
    row = F.struct(F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    good = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(vector_col)
    one = vectors.where(good).select(F.col(id_col).cast("long").alias("id"), row.alias("r")).groupBy("id").agg(F.min("r").alias("r"))
    return one.select("id", "r.label", "r.v", F.size("r.v").alias("d"))


def _parts(df: DataFrame, by: list[str], size: int, name: str) -> DataFrame:
    """Number of blocks of about ``size`` rows per group."""
    return df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))


def _tiles(anchors: DataFrame, rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, int, int]:
    """Anchors and rows dealt into the tiles (``by``, qb, rb) of their groups;
    groups that lack either side have none.  With them the number of tiles and
    the most row blocks of a group."""
    parts = written(_parts(anchors, by, BLOCK_ANCHORS, "q_parts").join(_parts(rows, by, BLOCK_ROWS, "r_parts"), by), "tiles")
    total = parts.agg(F.sum(F.col("q_parts").cast("long") * F.col("r_parts")), F.max("r_parts")).first()
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = anchors.join(parts, by).withColumns({"qb": place("q_parts"), "rb": every("r_parts")})
    right = rows.join(parts, by).withColumns({"rb": place("r_parts"), "qb": every("q_parts")})
    keys = ["qb", "rb"]
    own = [F.col(c).alias(c) for c in left.columns if c not in ("q_parts", "r_parts", *keys)]   # apart from the rows' columns
    return left.select(*keys, *own), right.drop("q_parts", "r_parts"), int(total[0] or 0), int(total[1] or 0)


def _per_tile(left: DataFrame, right: DataFrame, keys: list[str], tiles: int, function: Callable, schema: str) -> DataFrame:
    tasks = max(1, min(tiles, MAX_TASKS))
    return (left.repartition(tasks, *keys).groupBy(*keys)
            .cogroup(right.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(function, schema))


def best_positives(anchors: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """(query_id, rank, vec_id, score): an anchor's n best other rows of its own
    label, ties to the smaller id."""
    left, right, tiles, parts = _tiles(anchors, rows, ["label", "d"])
    lists = _per_tile(left, right, ["qb", "rb", "label", "d"], tiles, tile_top(n), LISTS)
    return merged(lists, parts, n)


def limit(score: Column, hundredths: int, rounded: Callable[[Column], Column]) -> Column:
    """``hundredths`` of a score as a whole number, without overflow or rounding
    before ``rounded``."""
    return rounded(score.cast("decimal(20,0)") * F.lit(hundredths) / F.lit(WHOLE)).cast("long")


def first_of_slots(score: np.ndarray, allowed: np.ndarray, limits: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(anchor, slot, column) of the first k allowed scores in each slot of each
    anchor, ties to the smaller id.  ``limits`` are ascending per anchor, padded
    with ``NO_LIMIT``; slot i holds the scores above limit i - 1, up to limit i.
    ``ids`` must ascend."""
    if allowed.sum() > allowed.size // 8:            # full slots: their k-th best score bounds what is sorted
        lower = np.full(len(score), np.iinfo(np.int64).min)
        kept = np.zeros_like(allowed)
        for upper in limits.T:
            inside = allowed & (score > lower[:, None]) & (score <= upper[:, None]) & (upper < NO_LIMIT)[:, None]
            if score.shape[1] > k:
                among = np.where(inside, score, -NO_LIMIT)
                inside &= score >= np.partition(among, score.shape[1] - k, axis=1)[:, [score.shape[1] - k]]
            kept |= inside
            lower = upper
        allowed = kept
    row, col = np.nonzero(allowed)
    value = score[row, col]
    slot = (value[:, None] > limits[row]).sum(axis=1)
    order = np.lexsort((ids[col], -value, slot, row))
    row, col, slot = row[order], col[order], slot[order]
    group = row * (limits.shape[1] + 1) + slot
    keep = np.arange(len(group)) - np.searchsorted(group, group) < k
    return row[keep], slot[keep], col[keep]


def tile_slots(k: int) -> Callable:
    """One tile: anchors (id, v, label, limits, lowest) and rows (id, v, label)
    -> the first k rows of other labels in each slot of each anchor."""
    def of(key: tuple, anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(anchors) and len(rows):
            rows = rows.sort_values("id")
            rid, rlabel, r = rows["id"].to_numpy(), rows["label"].to_numpy(), np.stack(rows["v"].to_numpy())
            for at in range(0, len(anchors), SLICE):
                part = anchors.iloc[at:at + SLICE]
                aid = part["id"].to_numpy()
                limits = np.full((len(part), max(map(len, part["limits"]))), NO_LIMIT)
                for i, own in enumerate(part["limits"]):
                    limits[i, :len(own)] = own
                score = integer_products(np.stack(part["v"].to_numpy()), r)
                top = np.array([own[-1] for own in part["limits"]])
                allowed = ((part["label"].to_numpy()[:, None] != rlabel[None, :]) & (score <= top[:, None])
                           & (score >= part["lowest"].to_numpy()[:, None]))
                row, slot, col = first_of_slots(score, allowed, limits, rid, k)
                out.append(pd.DataFrame({"anchor_id": aid[row], "slot": slot.astype(np.int32), "part": np.int64(key[1]),
                                         "vec_id": rid[col], "score": score[row, col]}))
        columns = {"anchor_id": "int64", "slot": "int32", "part": "int64", "vec_id": "int64", "score": "int64"}
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype=t) for c, t in columns.items()})

    return of


def hard_negatives(anchors: DataFrame, rows: DataFrame, positives: int = POSITIVES, k: int = K,
                   low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score).

    ``anchors`` and ``rows`` are (id, label, v, d) as ``usable_rows`` gives them;
    ``v`` holds whole numbers as doubles, a score is their exact inner product
    (limited to the range of a long).  For each anchor and each of its
    ``positives`` best other rows of the same label: the first ``k`` rows of
    other labels with low / 100 <= negative score / positive score <= high /
    100 (written without division), higher scores first, ties to the smaller
    id; fewer where there are fewer.  Only vectors of one length are compared.
    Empty tables, anchors without positives and positives without negatives
    give no rows."""
    ship_package(rows.sparkSession)
    found = best_positives(anchors, rows, positives)
    found = written(found.select(F.col("query_id").alias("anchor_id"), F.col("vec_id").alias("positive_id"),
                                 F.col("score").alias("positive_score"), limit(F.col("score"), high, F.floor).alias("upper"),
                                 limit(F.col("score"), low, F.ceil).alias("lower")), "positives")
    found = found.where(F.col("lower") <= F.col("upper"))
    limits = found.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_set("upper")).alias("limits"),
                                                              F.min("lower").alias("lowest"))
    asked = written(anchors.join(limits, "id"), "anchors")
    left, right, tiles, parts = _tiles(asked, rows, ["d"])
    lists = _per_tile(left, right, ["qb", "rb", "d"], tiles, tile_slots(k), SLOT_LISTS)
    slots = merged(lists.select(F.struct("anchor_id", "slot").alias("query_id"), "part", "vec_id", "score"), parts, k)
    entry = F.struct((-F.col("query_id.slot")).alias("down"), "rank", "vec_id", "score")
    per_anchor = slots.groupBy(F.col("query_id.anchor_id").alias("anchor_id")).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    own = F.array_position("limits", F.col("upper")) - 1
    suffix = F.slice(F.filter("entries", lambda e: -e["down"] <= F.col("own")), 1, k)
    answers = (found.join(asked.select(F.col("id").alias("anchor_id"), "limits"), "anchor_id").withColumn("own", own)
               .join(per_anchor, "anchor_id")
               .select("anchor_id", "positive_id", "positive_score", "lower", F.posexplode(suffix).alias("at", "e")))
    return answers.where(F.col("e.score") >= F.col("lower")).select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("negative_id"),
        "positive_score", F.col("e.score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all rows whose vec_id is divisible by 50, components
    turned into floor(256 * x), the labels of every seventh vec_id shifted."""
    vectors = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # a double of 2^52 or more has no fraction; those that leave the range of doubles take no part
    whole = lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: whole(x * SCALE))
    rows = written(usable_rows(vectors.select("vec_id", shifted.alias(f"{P}label"), scaled.alias(f"{P}v")),
                               "vec_id", f"{P}label", f"{P}v"), "vectors")
    return hard_negatives(rows.where(F.col("id") % EVERY == 0), rows)


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
             AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
            CAST(list_sum([CAST(a.e[i] * r.e[i] AS HUGEINT) FOR i IN range(1, len(a.e) + 1)]) AS BIGINT) AS score
          FROM v a JOIN v r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INT) AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) <= 3
"""
