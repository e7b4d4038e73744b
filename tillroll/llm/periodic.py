"""Periodic runs of words, by string synchronising sets.

A run is a stretch of consecutive words with smallest period q, at least two
periods long, that no neighbouring word extends.  All runs of a text are found:

* **names**: every stretch of 2^k words that occurs more than once in its text
  has a name, equal stretches the same one (pairs of shorter names, renumbered).
  They compare any two places exactly, in steps of halving length;
* **scales** t = 2, 4, 8, ...: places are kept whose stretch of t words has the
  smallest hash of its name among the next t places, at either end of them.
  The choice depends on the next 2t words only, so equal contexts are chosen
  alike, and every t places hold a choice unless the text around has a period
  of at most t/3 (such stretches take no part in the choice).  So a run of a
  period p in [3t, 6t) holds two chosen places p apart with equal contexts of 2t
  words: pairs of chosen places at such distances with equal contexts propose p;
* **small periods**: periods up to 5 are found by comparing words directly;
* **highly periodic regions**: a run whose period has itself a period of at
  most t/3 has no chosen place.  It lies across two touching runs of that small
  period, which are known by then: their common root fixes the possible p;
* **verification**: every proposal is extended both ways over equal words; what
  is at least two periods long is a run, and of proposals with the same extent
  the smallest period is its period.

Documents are independent: no shuffle.  A task joins documents up to
``SLICE_WORDS`` words into one array (names differ from document to document),
so the array steps cost little for short texts, and a longer document is a
slice of its own.  Memory is about 4 bytes x (levels + 20) a word of a slice,
where levels end with the longest repeated stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm._common import table, without
from tillroll.session import ship_package

MIN_LENGTH = 12
SLICE_WORDS = 200_000
DIRECT = 5                       # periods compared word by word
RUN = "struct<start: bigint, length: bigint, period: bigint>"
GAP = "[\\x20\\x09-\\x0D]+"


def words_of(text: str | None) -> list[bytes]:
    """Words are what lies between blanks, tabs, line feeds, vertical tabs, form
    feeds and carriage returns."""
    return (text or "").encode().split()


class Names:
    """Names of the stretches of 2^k symbols that occur more than once; -1 for
    the others.  ``level[k][i]`` names the stretch that starts at i."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.level = [self._named(np.arange(self.n), symbols.astype(np.int64))]
        while True:
            last, half = self.level[-1], 1 << (len(self.level) - 1)
            at = np.flatnonzero(last[:max(0, self.n - half)] >= 0)
            at = at[last[at + half] >= 0]
            named = self._named(at, last[at].astype(np.int64) * self.n + last[at + half])
            if not (named >= 0).any():
                break
            self.level.append(named)

    def _named(self, at: np.ndarray, key: np.ndarray) -> np.ndarray:
        out = np.full(self.n, -1, dtype=np.int32)
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(key) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        repeated = np.bincount(group)[group] > 1 if len(key) else new
        out[at[order[repeated]]] = group[repeated]
        return out

    def of(self, k: int) -> np.ndarray:
        return self.level[k] if k < len(self.level) else np.full(self.n, -1, dtype=np.int32)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal symbols from i and from j on (i < j)."""
        length = np.zeros(len(i), dtype=np.int64)
        for k in reversed(range(len(self.level))):
            name = self.level[k]
            while True:                                 # the longest level can hold several times
                a, b = i + length, j + length
                inside = b < self.n
                left = name[np.where(inside, a, 0)]
                same = inside & (left >= 0) & (left == name[np.where(inside, b, 0)])
                if not same.any():
                    break
                length[same] += 1 << k
                if k < len(self.level) - 1:
                    break
        return length

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal symbols before i and before j (i < j)."""
        length = np.zeros(len(i), dtype=np.int64)
        for k in reversed(range(len(self.level))):
            name, size = self.level[k], 1 << k
            while True:
                a, b = i - length - size, j - length - size
                inside = a >= 0
                left = name[np.where(inside, a, 0)]
                same = inside & (left >= 0) & (left == name[np.where(inside, b, 0)])
                if not same.any():
                    break
                length[same] += size
                if k < len(self.level) - 1:
                    break
        return length


def mixed(x: np.ndarray) -> np.ndarray:
    """Pseudo-random 64-bit numbers of whole numbers, different ones for different
    ones."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Marks of the places in any [start, end)."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, np.maximum(start, end), -1)
    return np.cumsum(step[:n]) > 0


def synchronising(names: Names, k: int, runs: np.ndarray) -> np.ndarray:
    """Chosen places of scale t = 2^k whose context of 2t symbols occurs again.
    ``runs`` holds all runs of periods up to t/3 (start, end, period)."""
    n, t = names.n, 1 << k
    own = names.of(k)
    rank = mixed(np.where(own >= 0, own, names.n + np.arange(n)))
    highest = np.uint64(0xFFFFFFFFFFFFFFFF)
    small = runs[(3 * runs[:, 2] <= t) & (runs[:, 1] - runs[:, 0] >= t)]
    periodic = covered(n, small[:, 0], small[:, 1] - t + 1)
    rank[periodic] = highest
    lowest = rank                                       # over 2^m places, doubled k times
    for m in range(k):
        lowest = np.minimum(lowest, np.append(lowest[1 << m:], np.full(1 << m, highest))[:n])
    far = np.append(rank[t:], np.full(min(t, n), highest))[:n]
    lowest = np.minimum(lowest, far)                    # over t + 1 places
    chosen = (lowest < highest) & ((lowest == rank) | (lowest == far))
    return np.flatnonzero(chosen & (names.of(k + 1) >= 0))


def pairs(places: np.ndarray, context: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of chosen places with equal contexts, 3t to 6t - 1 apart.
    A choice of scale t has a bounded number of places within 6t, so the loop
    has a bounded number of steps."""
    found, step = [], 1
    while step < len(places):
        distance = places[step:] - places[:-step]
        if distance.min() >= 6 * t:
            break
        fit = (distance >= 3 * t) & (distance < 6 * t) & (context[places[step:]] == context[places[:-step]])
        found.append((places[:-step][fit], distance[fit]))
        step += 1
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (places[:0], places[:0])


def verified(names: Names, place: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Runs (start, end, period) around proposals of a place and a period."""
    fit = (place >= 0) & (place + period < names.n)
    place, period = place[fit], period[fit]
    start = place - names.behind(place, place + period)
    end = place + period + names.ahead(place, place + period)
    found = np.stack([start, end, period], axis=1)[end - start >= 2 * period]
    return np.unique(found, axis=0)


def direct(symbols: np.ndarray, period: int) -> np.ndarray:
    """All stretches of at least two periods, symbol by symbol."""
    if len(symbols) <= period:
        return np.zeros((0, 3), dtype=np.int64)
    equal = np.concatenate([[False], symbols[period:] == symbols[:-period], [False]])
    change = np.flatnonzero(equal[1:] != equal[:-1])
    start, end = change[::2], change[1::2] + period
    long = end - start >= 2 * period
    return np.stack([start[long], end[long], np.full(long.sum(), period)], axis=1)


def smallest_periods(runs: np.ndarray) -> np.ndarray:
    """Of runs with the same extent, the one of smallest period; by start, then
    period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), dtype=bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def across(names: Names, runs: np.ndarray) -> np.ndarray:
    """Runs across two touching runs of one small period d: with equal roots,
    their periods are the distances of equal places, d apart, that fit into both."""
    runs = runs[np.lexsort((runs[:, 0], runs[:, 2]))]
    a, b = runs[:-1], runs[1:]
    touching = (a[:, 2] == b[:, 2]) & (b[:, 0] <= a[:, 1])
    a, b = a[touching], b[touching]
    if not len(a):
        return np.zeros((0, 3), dtype=np.int64)
    d = a[:, 2]
    pair, turn = np.repeat(np.arange(len(a)), d), np.concatenate([np.arange(x) for x in d])
    same = names.ahead(a[pair, 0] + turn, b[pair, 0]) >= d[pair]
    pair, root = pair[same], (a[pair, 0] + turn)[same]
    # distances b.start - root + m * d between the small periods and what fits in
    far = np.minimum(np.minimum(a[pair, 1] - a[pair, 0], b[pair, 1] - b[pair, 0]), (b[pair, 1] - a[pair, 0]) // 2)
    base = (b[pair, 0] - root) % d[pair]
    count = np.maximum(0, (far - base) // d[pair] + 1)
    which = np.repeat(np.arange(len(pair)), count)
    m = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    period = base[which] + m * d[pair][which]
    which, period = which[period >= 2 * d[pair][which]], period[period >= 2 * d[pair][which]]
    place = np.maximum(a[pair[which], 0], b[pair[which], 0] - period)
    return verified(names, place, period)


def all_runs(symbols: np.ndarray) -> np.ndarray:
    """All runs (start, end, period) of an array of whole numbers, by start, then
    period.  Equal symbols must not lie in different documents."""
    names = Names(symbols)
    found = smallest_periods(np.concatenate([direct(symbols, p) for p in range(1, DIRECT + 1)]))
    found = smallest_periods(np.concatenate([found, across(names, found)]))
    k, upto = 1, DIRECT + 1                             # periods below ``upto`` are known
    while k + 1 < len(names.level):
        t = 1 << k
        places = synchronising(names, k, found)
        new = verified(names, *pairs(places, names.of(k + 1), t))
        found = smallest_periods(np.concatenate([found, new]))
        upto, before = 6 * t, upto
        scale = found[(found[:, 2] >= before) & (found[:, 2] < upto)]
        if len(scale):
            found = smallest_periods(np.concatenate([found, across(names, scale)]))
        k += 1
    return found


def runs_of(texts: list[list[bytes]], min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, runs (start, length, period) counted from its first word, words
    to drop) of documents given as words."""
    sizes = np.array([len(w) for w in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    n = int(sizes.sum())
    if not n:
        return np.zeros(0, np.int64), np.zeros((0, 3), np.int64), np.zeros(0, bool)
    codes = pd.factorize(np.array([x for w in texts for x in w], dtype=object))[0].astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    found = all_runs(doc * (codes.max() + 1) + codes)
    found = found[found[:, 1] - found[:, 0] >= min_length]
    drop = covered(n, found[:, 0] + found[:, 2], found[:, 1])
    of = doc[found[:, 0]]
    first = (ends - sizes)[of]
    return of, np.stack([found[:, 0] - first, found[:, 1] - found[:, 0], found[:, 2]], axis=1), drop


def _slice(texts: list[list[bytes]], min_length: int) -> tuple[pa.Array, pa.Array]:
    doc, runs, drop = runs_of(texts, min_length)
    counts = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    entries = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(runs[:, i])) for i in range(3)], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), entries)
    kept, at = [], 0
    for w in texts:
        gone = drop[at:at + len(w)]
        kept.append(b" ".join([x for x, g in zip(w, gone.tolist()) if not g] if gone.any() else w).decode())
        at += len(w)
    return lists, pa.array(kept, pa.string())


def with_runs(text_column: int, min_length: int):
    """Appends the runs and the collapsed text of the text column."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, at, held, size = batch.column(text_column), 0, [], 0
            for i in range(len(column)):
                held.append(words_of(column[i].as_py()))
                size += len(held[-1])
                if size >= SLICE_WORDS or i + 1 == len(column):
                    lists, kept = _slice(held, min_length)
                    part = batch.slice(at, len(held))
                    yield pa.RecordBatch.from_arrays([*part.columns, lists, kept], [*part.schema.names, "runs", "collapsed"])
                    at, held, size = i + 1, [], 0

    return of


def periodic_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """``docs`` with ``runs``, all runs of at least ``min_length`` words as (start,
    length, period) in words, by start and period, and ``collapsed``, the words
    that stay when every run keeps its first period only, joined by one blank.

    A word is dropped when any run contains it after that run's first period.
    Null and blank texts have no runs and an empty collapsed text.  Every row is
    handled by itself, so repeated rows and null ids are kept; input columns
    named like the new ones are replaced.  An empty table gives none."""
    ship_package(docs.sparkSession)
    docs = without(docs, *({"runs", "collapsed"} - {text}))
    schema = T.StructType([*docs.schema.fields, T.StructField("runs", T.ArrayType(T._parse_datatype_string(RUN))),
                           T.StructField("collapsed", T.StringType())])
    return docs.mapInArrow(with_runs(docs.columns.index(text), min_length), schema)


def repeated_tail(doc_id: Column, text: Column) -> Column:
    """``text``; in one document of ten, by the checksum of its id, the words from
    some place on are replaced by repetitions of the first of them."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    made = F.transform(F.array(F.struct(words.alias("w"), g.alias("g"))), lambda s: F.struct(
        s["w"].alias("w"), F.pmod(s["g"], F.size(s["w"])).alias("a"), F.pmod(s["g"], F.lit(8)).alias("e")))
    made = F.transform(made, lambda s: F.struct(s["w"].alias("w"), s["a"].alias("a"),
                                                (F.floor((F.size(s["w"]) - s["a"]) / (F.lit(3) + s["e"])) + 1).alias("p")))
    tail = F.transform(made, lambda s: F.array_join(F.transform(
        s["w"], lambda w, i: F.when(i < s["a"], w).otherwise(F.get(s["w"], (s["a"] + F.pmod(i - s["a"], s["p"])).cast("int")))), " "))
    return F.when((h % 10 == 0) & F.coalesce(text.rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)), F.get(tail, F.lit(0))).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole document, a tenth of them with a repeated tail."""
    docs = table(spark, sf_dir, "documents").select("doc_id", repeated_tail(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"], r["period"]))), F.lit(0))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.l")).alias("length"),
        F.col("best.period").alias("period"), F.floor(F.lit(-1000) * F.col("best.l") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
