"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic).  The cells' token counts
are raked: scaled in turn to the target tokens of every source, language and
topic, until all three marginals hold.  A cell can't give more than it has: one
whose raked tokens exceed its own gives them all, and the others of its values
are raked to what remains.  Raked by present tokens is the probability with
which each document of the cell is sampled.  The draw is a seeded hash of the
row, so it is the same on every run and retry.

Targets are shares of ``fraction`` of all tokens.  A value whose target exceeds
its tokens gets all it has, and the rest is spread over the other values in
proportion, so that the targets can hold.

Topics are trained here, on all documents: hashed word counts as whole numbers
and spherical k-means whose sums are exact, so neither order nor partitions
matter.

Scale: texts are read twice, without a shuffle.  Vectors are 256 bytes a
document; a k-means step and a raking sweep are one small aggregate each.  The
driver sees topic centres and one number per combination of language and topic.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tillroll.llm._common import P, shuffle_key, stratum, table, unit, without, written
from tillroll.session import ship_package

TOPICS = 8
TOPIC_FEATURES = 256
TOPIC_STEPS = 10
UNIT = 127            # length of a document's vector
CENTRE = 1 << 20      # length of a centre
FRACTION = 0.5        # expected share of the tokens
EVENNESS = 0.5        # default targets: observed share to this power, normalised
MAX_SWEEPS = 100
MAX_FILLS = 20
STALLED = 8           # sweeps without a twentieth of progress end a bounded raking
TOLERANCE = 1e-4      # largest relative error of a marginal
SEED = 8

DIMS = ("source", "lang", "topic")


# --- topics -----------------------------------------------------------------

def word_vectors(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, its hashed word counts as a vector of length ``UNIT``
    in whole numbers); one constant word is added, so no vector is zero."""
    n, rows = np.zeros(len(texts), dtype=np.int64), np.zeros((len(texts), TOPIC_FEATURES), dtype=np.uint8)
    for i, text in enumerate(texts):
        words = text.lower().encode("utf-8", "surrogatepass").split() if text else []
        n[i] = len(words)
        codes = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words)) % TOPIC_FEATURES
        counts = np.bincount(codes, minlength=TOPIC_FEATURES).astype(np.float64)
        counts[0] += 1
        rows[i] = np.rint(UNIT * counts / np.sqrt((counts * counts).sum()))
    return n, rows


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre of highest inner product, the first of equal ones.  All numbers
    are whole and below 2^53: the same result in any batch."""
    return np.argmax(rows.astype(np.float64) @ centres.T.astype(np.float64), axis=1)


def centre_sums(centres: np.ndarray):
    """Vectors -> (topic, feature, sum) of the vectors nearest to each centre."""
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(centres.shape, dtype=np.int64)
        for b in batches:
            rows = np.frombuffer(b"".join(b["vector"]), dtype=np.uint8).reshape(len(b), -1)
            topic = nearest(rows, centres)
            for t in range(len(centres)):
                total[t] += rows[topic == t].sum(axis=0, dtype=np.int64)
        at = np.argwhere(total)
        yield pd.DataFrame({"topic": at[:, 0], "feature": at[:, 1], "total": total[at[:, 0], at[:, 1]]})

    return of


def scaled(sums: np.ndarray) -> np.ndarray:
    """Centres of length ``CENTRE`` in whole numbers."""
    size = np.sqrt((sums.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return np.rint(CENTRE * sums / np.where(size > 0, size, 1)).astype(np.int64)


def topic_centres(docs: DataFrame, text_col: str, topics: int) -> np.ndarray:
    """Centres of spherical k-means over all documents, from seeded directions;
    a topic that loses all documents keeps its centre."""
    ship_package(docs.sparkSession)

    @pandas_udf("binary")
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series([r.tobytes() for r in word_vectors(texts)[1]])

    rows = written(docs.select(vector(F.col(text_col).cast("string")).alias("vector")), "mix-vectors")
    centres = scaled(np.random.default_rng(SEED).integers(0, 1000, (topics, TOPIC_FEATURES)))
    for _ in range(TOPIC_STEPS):
        found = (rows.mapInPandas(centre_sums(centres), "topic int, feature int, total long")
                 .groupBy("topic", "feature").agg(F.sum("total").alias("total")).collect())    # topics x features
        sums = np.zeros_like(centres)
        for r in found:
            sums[r["topic"], r["feature"]] = r["total"]
        new = np.where(sums.any(axis=1, keepdims=True), scaled(sums), centres)
        if (new == centres).all():
            break
        centres = new
    return centres


def attributes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topics: int = TOPICS) -> DataFrame:
    """``docs`` with ``n_tokens`` (words of the whole text, 0 for null) and
    ``topic`` (from 0)."""
    docs = without(docs, "n_tokens", "topic")
    centres = topic_centres(docs, text_col, topics)

    @pandas_udf("n_tokens long, topic int")
    def found(texts: pd.Series) -> pd.DataFrame:
        n, rows = word_vectors(texts)
        return pd.DataFrame({"n_tokens": n, "topic": nearest(rows, centres)})

    return docs.withColumn(f"{P}found", found(F.col(text_col).cast("string"))).select(*docs.columns, f"{P}found.*")


# --- raking -----------------------------------------------------------------

def default_targets(cells: DataFrame, dims: list[str], evenness: float = EVENNESS) -> dict[str, DataFrame]:
    """{dim: (dim, share)}: the marginals of the mixture in which every cell has
    its token share to the power ``evenness``.  They stem from one joint
    mixture, so they never contradict each other."""
    even = cells.where("tokens > 0").select(*dims, F.pow("tokens", F.lit(evenness)).alias("even"))
    total = even.agg(F.sum("even").alias("all"))
    return {d: even.groupBy(d).agg(F.sum("even").alias("e")).join(F.broadcast(total))
            .select(d, (F.col("e") / F.col("all")).alias("share")) for d in dims}


def filled(goals: dict, held: dict, total: float) -> dict:
    """Shares of the values that have tokens -> target tokens: their share of
    ``total``, at most what they hold, the rest spread over the others."""
    aims = {v: 0.0 for v in goals}
    full: set = set()
    for _ in range(len(goals)):
        left = total - sum(held[v] for v in full)
        shares = sum(x for v, x in goals.items() if v not in full)
        aims = {v: held[v] if v in full else (x / shares * left if shares else 0.0) for v, x in goals.items()}
        over = {v for v in goals if v not in full and aims[v] > held[v]}
        if not over:
            break
        full |= over
    return aims


def filled_table(values: DataFrame, total: float) -> DataFrame:
    """(value, cells, share, held) -> with ``goal``, as ``filled``, for a dimension
    of any number of values: one aggregate a round, ``MAX_FILLS`` at most."""
    level = 0.0                                      # tokens per share of those that are not full
    for _ in range(MAX_FILLS):
        full = F.col("share") * F.lit(level) >= F.col("held")
        kept, shares = values.agg(F.sum(F.when(full, F.col("held")).otherwise(0.0)), F.sum(F.when(~full, F.col("share")))).first()
        if not shares or (total - (kept or 0.0)) / shares <= level * (1 + 1e-12):
            break
        level = (total - (kept or 0.0)) / shares
    return values.withColumn("goal", F.least("held", F.col("share") * F.lit(level)))


def rake(cells: DataFrame, targets: dict[str, DataFrame], fraction: float = 1.0, max_sweeps: int = MAX_SWEEPS,
         tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (the dimensions and ``tokens``) with ``raked`` tokens, at most
    ``tokens`` where ``fraction`` is below 1, whose marginals have the target
    shares of ``fraction`` of all tokens.

    The first dimension (sources) may have any number of values: each is a row
    with its cells, and its factor is worked out in that row.  The others are
    small vocabularies: their factors, and two token sums per combination of
    their values, are what a sweep exchanges with the driver.

    Shares of values without tokens are spread over the others; values without
    a target get none.  Stops when every marginal is within ``tolerance``, or
    after ``max_sweeps`` or without progress where targets contradict each other
    or what the cells hold; the sources' targets then hold, the others nearly."""
    wide, *small = targets
    cells = cells.where("tokens > 0")
    bounded = fraction < 1
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0) * fraction
    aims: dict[str, dict] = {}
    for d in small:
        held = {r[0]: float(r[1]) for r in cells.groupBy(d).agg(F.sum("tokens")).collect()}
        goal = {r[0]: float(r[1]) for r in targets[d].select(d, "share").collect() if r[0] in held}
        held = held if bounded else dict.fromkeys(held, float("inf"))
        aims[d] = filled(goal, held, total)
    per = cells.groupBy(wide).agg(F.collect_list(F.struct(*small, F.col("tokens").cast("double").alias("tokens"))).alias("cells"),
                                  F.sum(F.col("tokens").cast("double") if bounded else F.lit(float("inf"))).alias("held"))
    aimed = written(filled_table(written(per.join(targets[wide], wide), "mix-values"), total), "mix-sources")
    factors = {d: dict.fromkeys(g, 1.0) for d, g in aims.items()}

    def raked() -> DataFrame:
        tables = {d: F.create_map(*[F.lit(x) for pair in f.items() for x in pair]) for d, f in factors.items() if f}

        def weigh(c: Column) -> Column:
            w = c["tokens"]
            for d, t in tables.items():
                w = w * F.coalesce(t[c[d]], F.lit(0.0))
            return F.struct(*[c[d].alias(d) for d in small], c["tokens"].alias("tokens"), w.alias("w"))

        rows = aimed.select(wide, "goal", F.transform("cells", weigh).alias("cells"))
        if not bounded:
            held = F.aggregate("cells", F.lit(0.0), lambda s, c: s + c["w"])
            rows = rows.withColumn("by", F.try_divide(F.col("goal"), held))
        else:
            # the source's own factor: cells in order of how soon they are full;
            # the first m full ones give all, the others share what remains
            order = F.array_sort(F.filter("cells", lambda c: c["w"] > 0), lambda a, b: F.when(a["tokens"] * b["w"] < b["tokens"] * a["w"], -1)
                                 .when(a["tokens"] * b["w"] > b["tokens"] * a["w"], 1).otherwise(0))
            start = F.struct(F.lit(0.0).alias("full"), F.aggregate("order", F.lit(0.0), lambda s, c: s + c["w"]).alias("free"), F.lit(False).alias("done"))

            def step(acc: Column, c: Column) -> Column:
                over = ~acc["done"] & ((F.col("goal") - acc["full"]) * c["w"] > c["tokens"] * acc["free"])
                return F.struct(F.when(over, acc["full"] + c["tokens"]).otherwise(acc["full"]).alias("full"),
                                F.when(over, acc["free"] - c["w"]).otherwise(acc["free"]).alias("free"), (acc["done"] | ~over).alias("done"))

            last = F.aggregate("order", start, step)
            rows = (rows.withColumn("order", order).withColumn("last", last)
                    .withColumn("by", F.when(F.col("last.done"), F.try_divide(F.col("goal") - F.col("last.full"), F.col("last.free")))
                                .otherwise(F.when(F.size("order") > 0, F.lit(1e300)))))
        x = F.coalesce("by", F.lit(0.0)) * F.col("c.w")
        return (rows.select(wide, "by", F.explode("cells").alias("c"))
                .select(wide, *[F.col(f"c.{d}").alias(d) for d in small], F.col("c.tokens").alias("tokens"),
                        (F.when(F.col("c.w") <= 0, F.lit(0.0)).otherwise(F.least(x, F.col("c.tokens"))) if bounded else x).alias("raked")))

    errors: list[float] = []
    for _ in range(max_sweeps):
        full = (F.col("raked") >= F.col("tokens")) if bounded else F.lit(False)
        sums = raked().groupBy(*small).agg(F.sum(F.when(~full, F.col("raked")).otherwise(0.0)).alias("free"),
                                           F.sum(F.when(full, F.col("raked")).otherwise(0.0)).alias("full")).collect()
        part = [[tuple(r[:-2]), r["free"], r["full"]] for r in sums]
        worst = 0.0
        for at, d in enumerate(small):
            free, held = {}, {}
            for key, x, y in part:
                free[key[at]] = free.get(key[at], 0.0) + x
                held[key[at]] = held.get(key[at], 0.0) + y
            by = {}
            for v, x in free.items():
                goal = aims[d].get(v, 0.0)
                if x + held[v] > 0 and goal > 0:
                    worst = max(worst, abs((x + held[v]) / goal - 1.0))
                by[v] = max(goal - held[v], goal * 1e-3) / x if x > 0 else (1.0 if held[v] <= goal * (1 + tolerance) else goal / held[v])
                by[v] = min(by[v], 1e3)
            part = [[key, x * by[key[at]], y] for key, x, y in part]
            factors[d] = {v: f * by.get(v, 1.0 if aims[d].get(v) else 0.0) for v, f in factors[d].items()}
        errors.append(worst)
        if worst <= tolerance or (bounded and len(errors) > STALLED and worst > 0.95 * errors[-STALLED - 1]):
            break
    return written(raked(), "mix-raked")


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, fraction: float = FRACTION,
        id_col: str = "doc_id", dims: tuple[str, ...] = DIMS, seed: int = SEED) -> DataFrame:
    """Rows with ``n_tokens`` and the dimensions -> the same rows with
    ``probability`` and ``sampled``.

    ``targets``: for each dimension a table (value, share); by default the
    observed shares, evened out.  Null values of a dimension are a value of
    their own (targets name it None).  Rows without tokens have probability 0:
    they weigh nothing in a mixture.  Repeated rows are drawn together; an empty
    table gives an empty result; input columns named probability or sampled are
    replaced."""
    docs = without(docs, "probability", "sampled")
    cols = docs.columns
    cell = {d: f"{P}{d}" for d in dims}
    rows = written(docs.withColumns({c: stratum(d) for d, c in cell.items()}), "mix-rows")
    cells = written(rows.groupBy(*cell.values()).agg(F.sum("n_tokens").alias("tokens")), "mix-tokens")
    goal = default_targets(cells, list(cell.values()))
    goal |= {c: targets[d].select(stratum(d).alias(c), "share") for d, c in cell.items() if targets and d in targets}
    raked = rake(cells, goal, fraction)
    chances = raked.select(*cell.values(), F.least(F.lit(1.0), F.col("raked") / F.col("tokens")).alias("probability"))
    chance = F.when(F.col("n_tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(0.0)
    drawn = unit(shuffle_key(seed, id_col, "n_tokens", *dims))
    return (rows.join(chances, list(cell.values()), "left").withColumn("probability", chance)
            .select(*cols, "probability", (drawn < F.col("probability")).alias("sampled")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return mix(attributes(docs).drop("text"))
