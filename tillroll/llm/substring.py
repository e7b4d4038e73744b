"""Substring dedup by collinear chaining of shared k-mer seeds.

Finds passages of at least ``MIN_WORDS`` words that a document shares, word for
word or with small edits (identity of at least ``MIN_IDENTITY``), with another
document.

1. Seeds: hashes of ``K`` consecutive lower-cased words, thinned by winnowing
   (the smallest of every ``WINDOW`` consecutive ones).  Any run of K + WINDOW - 1
   = 20 equal words shares a seed, and a run of MIN_WORDS shares at least two.
2. Seed join: seeds that only one document has are dropped.  A seed of at most
   ``FEW`` rows links every pair of its documents.  A more frequent one (a stock
   phrase, a passage of very many documents) is joined with every other shared
   seed within ``REACH`` words before or after it: chains need two seeds, so a
   passage that a frequent seed helps to find has such a pair of seeds.  Pairs of
   seeds with at most FEW rows link every pair of documents again.
   The others link each document to the first and to the last one; then
   the rows that no passage found with the first document covers are open: they are
   linked to all rows of other documents there, if those are at most ``WHOLE``.
   Rows of a larger group are parted once more, by the ``GRAMS`` near them that the
   first document does not have there: two that share a passage which neither
   shares with the first have more words in common than with it.  Documents of a
   part with open ones are linked at all seeds they share.  Two documents that share
   a passage are thus paired, unless both were found to share that place with the same first
   document: those are its class, and only such pairs are not spelled out.  Parting
   needs three common words of four in a row besides the group's own phrase: a
   passage of 50 words around a phrase of up to 24 always has them.
3. Chaining, per pair of documents: links on one diagonal merge to segments;
   segments in the same order in both documents are chained for the largest
   number of words less gap costs, with a Fenwick tree of prefix maxima.
4. Alignment: the chained regions of both texts, with a margin, are cut out of
   the documents and aligned word by word: along the segments, by longest common
   subsequence in the gaps, by a drop-off extension at both ends that passes over
   replaced, inserted and deleted words; where a chain fails, its longest segment
   is extended alone.  What reaches MIN_WORDS and MIN_IDENTITY is a passage.

Scale: seeds are about 2 / 17 of the words, 28 bytes each, in one shuffle.  Frequent
seeds alone make further rows, a few for each.  Texts are joined once per alignment
with the regions wanted of them, and only regions travel on.  A stock phrase of very
many documents makes rows for the grams near it, and pairs of those documents only
that have such a gram in common: that part is quadratic, without a cap.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm._common import discard, table, written
from tillroll.session import ship_package

K = 5
WINDOW = 16
MIN_WORDS = 50
MIN_IDENTITY = 0.8
GAP_COST = 0.5        # per word that a gap skips in either document
MARGIN = 1_024        # bytes around a chain that the ends may extend into
DROP = 20.0           # an end stops when its score falls this far
MISMATCH = 4.0        # cost of a differing word: 80 % identity breaks even
SHIFT = 3             # words that an extension can skip at once on either side
LOOK = 5              # words that have to agree after a skip, but one
SEED = 10
FEW = 8               # rows of a seed up to which all pairs are linked at once
REACH = 64            # words within which a frequent seed is joined with others
WHOLE = 64            # rows of a frequent seed up to which open rows are linked to all others
DRIFT = 20            # words by which two rows of a passage can be apart beside their seed: 2 * 20 % of MIN_WORDS
GRAMS = ((1, 2), (1, 3), (2, 3))    # three of four words in a row: the second and third one's places
STRETCH = 18          # words of a seed of a periodic stretch: MIN_WORDS less two periods


# --- words and seeds --------------------------------------------------------

def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words' starts and ends: runs without ASCII white space."""
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def winnowed(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest hash of every window, the first of equal ones; of a
    run of equal hashes (one repeated word) only the first counts."""
    fresh = np.concatenate(([0], np.flatnonzero(hashes[1:] != hashes[:-1]) + 1))
    h = hashes[fresh]
    if len(h) <= window:
        return fresh[[int(np.argmin(h))]]
    least = np.lib.stride_tricks.sliding_window_view(h, window).argmin(axis=1) + np.arange(len(h) - window + 1)
    return fresh[np.unique(least)]


def spelled(text: str | None) -> tuple[memoryview, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased words joined by one space, begin and stop of each word in
    them, byte offset of each word in the text)."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    start, end = word_bounds(np.frombuffer(data, dtype=np.uint8))
    stop = np.cumsum(end - start + 1) - 1
    return memoryview(b" ".join(data.split())), np.concatenate(([0], stop[:-1] + 1)), stop, start


def stretches(hashes: np.ndarray) -> list[tuple[int, int, int]]:
    """(first place, end of the places, period) of the parts of at least MIN_WORDS
    words that repeat with a period of up to ``WINDOW`` words, disjoint in hashes."""
    n, out = len(hashes), []
    if len(np.unique(hashes)) == n:
        return out
    taken = np.zeros(n, dtype=bool)
    for q in range(1, WINDOW + 1):
        same = np.concatenate(([0], ((hashes[q:] == hashes[:-q]) & ~taken[q:]).view(np.int8), [0]))
        edge = np.diff(same)
        for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if e - s + q + K - 1 >= MIN_WORDS:
                out.append((s, e + q, q))
                taken[s:e + q] = True
    return out


def seeds(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, word number, byte offset, words) of the seeds of a text that is long
    enough to hold a passage.

    A stretch of one period has seeds of its own, of ``STRETCH`` words: counted
    from its least hash, one for each MIN_WORDS words or so, numbered, and again
    from the next period on, as another document can begin with more or less of
    one.  Its other seeds count in its first two periods only."""
    from xxhash import xxh64_intdigest

    joined, begin, stop, start = spelled(text)
    if len(start) < MIN_WORDS:
        none = np.array([], dtype=np.int64)
        return none, none, none, none
    n = len(start) - K + 1
    hashes = np.fromiter((xxh64_intdigest(joined[s:e], SEED) for s, e in zip(begin[:n].tolist(), stop[K - 1:].tolist())),
                         dtype=np.uint64, count=n)
    at = winnowed(hashes)
    own, places = [], []
    for s, e, q in stretches(hashes):
        at = at[(at < s + 2 * q) | (at >= e)]
        least = s + int(np.argmin(hashes[s:s + q]))
        step = q * -(-MIN_WORDS // q)
        for place in (least, least + q):
            for no, p in enumerate(range(place, e + K - STRETCH, step)):
                own.append(xxh64_intdigest(f"{hashes[least]} {q} {no}", SEED + 1))
                places.append(p)
    every = np.concatenate((at, np.array(places, dtype=np.int64)))
    return (np.concatenate((hashes[at], np.array(own, dtype=np.uint64))).view(np.int64), every, start[every],
            np.repeat([K, STRETCH], [len(at), len(own)]))


def seed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(seed, doc, at, n): at = word number * 2^32 + byte offset; n words."""
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for low in range(0, len(b), 256):
                part = b.iloc[low:low + 256]
                found = [seeds(t) for t in part["text"]]
                size = [len(f[0]) for f in found]
                yield pd.DataFrame({"seed": np.concatenate([f[0] for f in found]),
                                    "doc": np.repeat(part["doc"].to_numpy(dtype=np.int64), size),
                                    "at": np.concatenate([(f[1].astype(np.int64) << 32) | f[2] for f in found]),
                                    "n": np.concatenate([f[3] for f in found])})

    return (docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
            .where("doc is not null").mapInPandas(emit, "seed long, doc long, at long, n int"))


def shared_rows(rows: DataFrame) -> DataFrame:
    """Rows whose seed several documents have, with its first and last row and
    their number."""
    where = F.struct("doc", "at")
    at_seed = Window.partitionBy("seed")
    return (rows.withColumns({"first": F.min(where).over(at_seed), "last": F.max(where).over(at_seed),
                              "size": F.count(F.lit(1)).over(at_seed)})
            .where("first.doc < last.doc"))


def pair_rows(shared: DataFrame) -> DataFrame:
    """Frequent seeds, once for every other shared seed within ``REACH`` words:
    rows whose seed stands for both and their order."""
    word, block = F.shiftright("at", 32), F.floor(F.shiftright("at", 32) / REACH)
    near = shared.select("doc", F.col("seed").alias("other"), word.alias("there"), block.alias("block"))
    often = (shared.where(F.col("size") > FEW)
             .select("doc", "seed", "at", "n", word.alias("here"), F.explode(F.array(block - 1, block, block + 1)).alias("block")))
    return (often.join(near, ["doc", "block"])
            .where((F.col("here") != F.col("there")) & (F.abs(F.col("here") - F.col("there")) <= REACH))
            .select(F.xxhash64("seed", "other", F.col("here") < F.col("there")).alias("seed"), "doc", "at", "n")
            .repartition("seed").distinct())   # the windows by seed need no further shuffle


def linked(b: str, bt: str, a: str, at: str):
    """A link as a struct: places of the later and of the earlier document."""
    y, x = F.shiftright(bt, 32), F.shiftright(at, 32)
    low = lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    return F.struct(F.col(b).alias("b"), F.col(a).alias("a"), y.cast("int").alias("y"),
                    x.cast("int").alias("x"), F.col("n").alias("n"), low(bt).alias("yo"), low(at).alias("xo"))


def star_links(rows: DataFrame) -> DataFrame:
    """(b, a, y, x, n, yo, xo) for a < b: word numbers and byte offsets of
    n shared words in both, for the first and the last document that has them."""
    ends = F.array(linked("doc", "at", "first.doc", "first.at"), linked("last.doc", "last.at", "doc", "at"))
    return rows.select(F.explode(ends).alias("p")).where("p.a < p.b").select("p.*")


def all_links(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Links of each of ``rows`` to all of ``others`` at its seed."""
    one = rows.select("seed", F.col("doc").alias("one"), F.col("at").alias("one_at"), "n")
    two = others.select("seed", F.col("doc").alias("two"), F.col("at").alias("two_at"))
    p = F.when(F.col("one") > F.col("two"), linked("one", "one_at", "two", "two_at")).otherwise(linked("two", "two_at", "one", "one_at"))
    return one.join(two, "seed").where("one <> two").select(p.alias("p")).select("p.*")


def pair_links(rows: DataFrame) -> DataFrame:
    """Links of all pairs of ``rows`` at a seed: each link comes twice, from either
    side, and is kept where the later document comes first."""
    few = rows.where(F.col("size") <= FEW)
    one = few.select("seed", F.col("doc").alias("one"), F.col("at").alias("one_at"), "n")
    two = few.select("seed", F.col("doc").alias("two"), F.col("at").alias("two_at"))
    return one.join(two, "seed").where("one > two").select(linked("one", "one_at", "two", "two_at").alias("p")).select("p.*")


def uncovered(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` but those that are, or that a passage of ``found`` shares with, the
    first row of their seed."""
    known = found.select(F.col("doc_id").alias("doc"), F.col("other_doc_id").alias("head"), "start_word", "end_word", "other_start", "other_end")
    y, x = F.shiftright("at", 32), F.col("x")
    rows = rows.where("doc > first.doc").select("seed", "doc", "at", "n", F.col("first.doc").alias("head"),
                                                F.shiftright("first.at", 32).cast("int").alias("x"))
    return (rows.join(known, (rows["doc"] == known["doc"]) & (rows["head"] == known["head"]) & (y >= F.col("start_word"))
                      & (y < F.col("end_word")) & (x >= F.col("other_start")) & (x < F.col("other_end")), "left_anti")
            .select("seed", "doc", "at", "n"))


def gram_rows(crowd: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (seed, doc, at, n, open, lead) once for every gram (``GRAMS``) within
    MIN_WORDS words of them, with the gram's distance ``off`` in words."""
    from xxhash import xxh64_intdigest

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids: dict[bytes, int] = {}
            grams, offs = [], []
            for raw, before in zip(b["raw"], b["before"]):
                raw = bytes(raw).lower()
                mid = len(raw[:before].split())
                low = max(0, mid - MIN_WORDS)
                words = raw.split()[low:mid + MIN_WORDS + STRETCH]
                for w in set(words).difference(ids):
                    ids[w] = xxh64_intdigest(w, SEED)
                h = np.fromiter(map(ids.__getitem__, words), dtype=np.uint64, count=len(words))
                mixed = [((h[:-z] * np.uint64(0x9E3779B97F4A7C15) + h[y:len(h) - z + y]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[z:]).view(np.int64)
                         for y, z in GRAMS if len(h) > z]
                grams.append(np.concatenate([*mixed, np.array([], dtype=np.int64)]))
                offs.append(np.concatenate([*[np.arange(len(m)) for m in mixed], np.array([], dtype=np.int64)]) + low - mid)
            size = [len(g) for g in grams]
            if size:
                yield pd.DataFrame({c: np.repeat(b[c].to_numpy(), size) for c in ("seed", "doc", "at", "n", "open", "lead")}
                                   | {"gram": np.concatenate(grams), "off": np.concatenate(offs)})

    raw = docs.select(F.col(id_col).cast("long").alias("doc"), F.encode(F.col(text_col), "UTF-8").alias("raw")).where("raw is not null")
    byte = F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    before = F.least(byte, F.lit(MARGIN))
    return (crowd.join(raw, "doc").select("seed", "doc", "at", "n", "open", "lead", before.alias("before"),
                                          F.substr("raw", byte - before + 1, before + MARGIN).alias("raw"))
            .mapInPandas(emit, "seed long, doc long, at long, n int, open boolean, lead boolean, gram long, off int"))


def parted(grams: DataFrame) -> DataFrame:
    """``gram_rows`` by seed and gram, of groups with an open row: (seed, doc, at, n,
    open, off, first, size), the new seed standing for both.  Grams that the
    seed's leading row has there too do not part the others from it."""
    at_gram = Window.partitionBy("seed", "gram")
    led = F.when(F.col("lead"), F.col("off"))
    where = F.struct("doc", "at")
    own = (grams.withColumn("led", F.collect_set(led).over(at_gram))
           .where(~F.col("lead") & ~F.exists("led", lambda o: F.abs(F.col("off") - o) <= DRIFT)))
    return (own.withColumns({"first": F.min(where).over(at_gram), "last": F.max(where).over(at_gram),
                             "size": F.approx_count_distinct("doc").over(at_gram), "some": F.max("open").over(at_gram)})
            .where("some and first.doc < last.doc")
            .select(F.xxhash64("seed", "gram").alias("seed"), "doc", "at", "n", "open", "off", "first", "size"))


def apart(rows: DataFrame) -> DataFrame:
    """(seed, doc, at, n, open, first, size, opens), size and opens being about the
    documents of the seed and of its open rows, without seeds that have the same rows as another."""
    rows = rows.groupBy("seed", "doc", "at").agg(F.max("n").alias("n"), F.max("open").alias("open"), F.first("first").alias("first"))
    kinds = rows.groupBy("seed").agg(F.count(F.lit(1)).alias("rows"), F.expr("bit_xor(xxhash64(doc, at, open))").alias("mark"),
                                     F.approx_count_distinct("doc").alias("size"),
                                     F.approx_count_distinct(F.when(F.col("open"), F.col("doc"))).alias("opens"))
    kept = kinds.where("opens > 0").groupBy("rows", "mark").agg(F.min(F.struct("seed", "size", "opens")).alias("k")).select("k.*")
    return rows.join(kept, "seed")


def near_pairs(rows: DataFrame) -> DataFrame:
    """(b, a) for a < b: documents of open rows with all others of their seed and gram."""
    rows = rows if "off" in rows.columns else rows.withColumn("off", F.lit(0))
    one = rows.where("open").select("seed", F.col("doc").alias("one"), F.col("off").alias("one_off")).distinct()
    two = rows.select("seed", F.col("doc").alias("two"), F.col("off").alias("two_off")).distinct()
    return (one.join(two, (one["seed"] == two["seed"]) & (F.col("one") != F.col("two"))
                     & (F.abs(F.col("one_off") - F.col("two_off")) <= DRIFT))
            .select(F.greatest("one", "two").alias("b"), F.least("one", "two").alias("a")))


def links_of(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Links of pairs of documents at all seeds that both have in ``rows``."""
    one = rows.select("seed", F.col("doc").alias("b"), F.col("at").alias("one_at"), "n")
    two = rows.select("seed", F.col("doc").alias("a"), F.col("at").alias("two_at"))
    return (pairs.distinct().join(one, "b").join(two, ["a", "seed"])
            .select(linked("b", "one_at", "a", "two_at").alias("p")).select("p.*"))


# --- chaining ---------------------------------------------------------------

class PrefixMax:
    """Fenwick tree of (value, number) maxima over places 0 to n - 1."""

    def __init__(self, n: int) -> None:
        self.best: list[tuple[float, int]] = [(0.0, -1)] * (n + 1)

    def raise_to(self, place: int, value: tuple[float, int]) -> None:
        i = place + 1
        while i < len(self.best):
            if self.best[i][1] < 0 or value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def up_to(self, place: int) -> tuple[float, int]:
        """Largest of the places below ``place``; number -1 if there is none."""
        i, out = place, (0.0, -1)
        while i:
            if self.best[i][1] >= 0 and (out[1] < 0 or self.best[i] > out):
                out = self.best[i]
            i -= i & -i
        return out


def chain(x: list[int], y: list[int], n: list[int]) -> list[list[int]]:
    """Best chains of the segments (x, y, words), disjoint, each in ascending
    order of both coordinates.

    f(j) = n_j + max(0, max over i before j of f(i) - cost * (gap in x + gap in
    y)).  The cost is a difference of end and start coordinates, so the inner
    maximum is a prefix maximum of f(i) + cost * (end coordinates of i)."""
    order = sorted(range(len(x)), key=lambda j: (y[j], x[j]))
    by_end = sorted(range(len(x)), key=lambda j: y[j] + n[j])
    ends = sorted({x[j] + n[j] for j in order})
    tree, waiting = PrefixMax(len(ends)), 0
    score, back = [0.0] * len(x), [-1] * len(x)
    for j in order:
        while waiting < len(by_end) and y[by_end[waiting]] + n[by_end[waiting]] <= y[j]:
            i = by_end[waiting]       # began, and so was scored, before j
            tree.raise_to(bisect_left(ends, x[i] + n[i]), (score[i] + GAP_COST * (x[i] + y[i] + 2 * n[i]), i))
            waiting += 1
        value, i = tree.up_to(bisect_left(ends, x[j] + 1))
        gain = value - GAP_COST * (x[j] + y[j])
        score[j], back[j] = (n[j] + gain, i) if i >= 0 and gain > 0 else (float(n[j]), -1)
    used, out = [False] * len(x), []
    for j in sorted(order, key=lambda j: -score[j]):
        path = []
        while j >= 0 and not used[j]:
            used[j] = True
            path.append(j)
            j = back[j]
        if path:
            out.append(path[::-1])
    return out


def joined(paths: list[list[int]], x: list[int], y: list[int], n: list[int]) -> list[list[int]]:
    """Chains that follow one another within MIN_WORDS words in both documents, as
    one: seeds between two edits can be too few to pay for the gaps."""
    out: list[list[int]] = []
    parts = 0
    for path in sorted(paths, key=lambda p: (y[p[0]], x[p[0]])):
        if out:
            i, j = out[-1][-1], path[0]
            if 0 <= y[j] - y[i] - n[i] <= MIN_WORDS and 0 <= x[j] - x[i] - n[i] <= MIN_WORDS:
                out[-1] = out[-1] + path
                parts += 1
                continue
        out.append(path)
    known = {tuple(p) for p in paths}
    return [p for p in out if tuple(p) not in known] if parts else []


def chained(found: DataFrame) -> DataFrame:
    """Links -> chains: (b, a, xs, ys, ns, yo, xo, yz, xz): segments in word
    numbers, byte offsets of the first and the last seed in both documents."""
    shape = "b long, a long, xs array<int>, ys array<int>, ns array<int>, yo int, xo int, yz int, xz int"

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        b, a, y, x, n, yo, xo = (rows[c].to_numpy() for c in ("b", "a", "y", "x", "n", "yo", "xo"))
        d = x - y
        new_pair = np.concatenate(([True], (b[1:] != b[:-1]) | (a[1:] != a[:-1])))
        fresh = new_pair | np.concatenate(([True], d[1:] != d[:-1]))
        base = np.cumsum(fresh) << 33         # the end so far on the diagonal of a pair
        end = np.maximum.accumulate(base + y + n) - base
        new = fresh | np.concatenate(([True], y[1:] - end[:-1] > WINDOW))
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(b)])) - 1
        length = end[last] - y[first]
        yz, xz = np.maximum.reduceat(yo, first), np.maximum.reduceat(xo, first)
        starts = np.flatnonzero(new_pair[first])
        words = np.add.reduceat(length, starts)
        stops = np.concatenate((starts[1:], [len(first)]))
        out = []
        for s, e in zip(starts[words >= 2 * K].tolist(), stops[words >= 2 * K].tolist()):
            xs, ys, ns = x[first[s:e]].tolist(), y[first[s:e]].tolist(), length[s:e].tolist()
            paths = [[0]] if e - s == 1 else chain(xs, ys, ns)
            for path in paths if len(paths) == 1 else paths + joined(paths, xs, ys, ns):
                if sum(ns[j] for j in path) < 2 * K:
                    continue
                f, z = first[s + path[0]], s + path[-1]
                out.append((b[f], a[f], [xs[j] for j in path], [ys[j] for j in path], [ns[j] for j in path],
                            yo[f], xo[f], yz[z], xz[z]))
        return pd.DataFrame(out, columns=["b", "a", "xs", "ys", "ns", "yo", "xo", "yz", "xz"])

    def whole_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted; a pair that a batch may cut waits for the next one."""
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if len(rows):
                end = rows.iloc[-1]
                cut = int(((rows["b"] == end["b"]) & (rows["a"] == end["a"])).to_numpy().argmax())
                rest = rows.iloc[cut:]
                if cut:
                    yield of(rows.iloc[:cut])
        if rest is not None and len(rest):
            yield of(rest)

    parts = max(8, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return (found.repartition(parts, "b", "a").sortWithinPartitions("b", "a", F.col("x") - F.col("y"), "y")
            .mapInPandas(whole_pairs, shape))


# --- alignment --------------------------------------------------------------

def common(p: np.ndarray, q: np.ndarray) -> int:
    """Length of the longest common subsequence of two gaps."""
    if len(p) == len(q) and (p == q).all():
        return len(p)
    if len(p) > len(q):
        p, q = q, p
    row = np.zeros(len(q) + 1, dtype=np.int64)
    for w in p:
        step = row.copy()
        step[1:] = np.maximum(row[1:], row[:-1] + (q == w))
        row = np.maximum.accumulate(step)
    return int(row[-1])


# Ways on from a mismatch, in words of either side: cheapest first.
STEPS = sorted(((dx, dy) for dx in range(SHIFT + 1) for dy in range(SHIFT + 1) if dx or dy), key=lambda s: (max(s), -min(s)))


def extension(p: np.ndarray, q: np.ndarray) -> list[tuple[int, int, int]]:
    """(words of p, words of q, equal words) by which equal-ish sequences extend:
    runs of equal words, between them up to ``SHIFT`` words replaced, inserted or
    deleted wherever at least ``LOOK`` - 1 of the next ``LOOK`` words agree.  First
    the end of best score, then the ends of later runs before the score has
    dropped by ``DROP``."""
    x = y = same = 0
    score, best = 0.0, (0.0, 0, 0, 0)
    later: list[tuple[int, int, int]] = []
    while True:
        n = min(len(p) - x, len(q) - y)
        differ = np.flatnonzero(p[x:x + n] != q[y:y + n])
        run = int(differ[0]) if len(differ) else n
        x, y, same, score = x + run, y + run, same + run, score + run
        if score > best[0]:
            best, later = (score, x, y, same), []
        elif run:
            later.append((x, y, same))
        if run == n:
            return [best[1:], *later]
        u, v = p[x:x + SHIFT + LOOK].tolist(), q[y:y + SHIFT + LOOK].tolist()
        for step in STEPS:
            dx, dy = step
            n = min(len(u) - dx, len(v) - dy, LOOK)
            if n > 0 and u[dx] == v[dy] and sum(map(eq, u[dx:dx + n], v[dy:dy + n])) >= min(n, LOOK - 1):
                break
        else:
            # nothing agrees near: on along the diagonal, while the score lasts
            step = (1, 1)
        x, y, score = x + step[0], y + step[1], score - MISMATCH * max(step)
        if best[0] - score > DROP:
            return [best[1:], *later]


def numbered(region: bytes, offset: int, seed_at: int, seed_word: int) -> tuple[np.ndarray, int]:
    """(hashes of the words of a region, word number of its first word); the region begins
    at byte ``offset`` of the text, and word ``seed_word`` at byte ``seed_at``."""
    raw = bytes(region).lower()
    words = raw.split()
    return (np.fromiter(map(hash, words), dtype=np.int64, count=len(words)),      # compared inside one process only
            seed_word - len(raw[:seed_at - offset].split()))


def align(p: np.ndarray, q: np.ndarray, xs: list[int], ys: list[int], ns: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(x from, x to, y from, y to, equal words) of the passage along a chain, in
    places of the word sequences p and q: with the ends of best score, then with
    later ends, nearest first."""
    same = 0
    x = y = None
    for sx, sy, n in zip(xs, ys, ns):
        if x is not None:
            same += common(p[x:sx], q[y:sy])
        n = min(n, len(p) - sx, len(q) - sy)
        same += int((p[sx:sx + n] == q[sy:sy + n]).sum())
        x, y = sx + n, sy + n
    right = extension(p[x:], q[y:])
    left = extension(p[:xs[0]][::-1], q[:ys[0]][::-1])
    for r, l in sorted(((r, l) for r in right for l in left), key=lambda e: e[0][0] + e[1][0]):
        yield xs[0] - l[0], x + r[0], ys[0] - l[1], y + r[1], same + r[2] + l[2]


def passage(p: np.ndarray, q: np.ndarray, xs: list[int], ys: list[int], ns: list[int], min_words: int,
            min_identity: float) -> tuple[int, int, int, int, float] | None:
    """The alignment along the chain where it is long and equal enough, else the
    one around the chain's longest segment, else None.  One that ends short of
    ``min_words`` takes later ends while it stays equal enough."""
    longest = ns.index(max(ns))
    for part in (slice(None), slice(longest, longest + 1)):
        for x0, x1, y0, y1, same in align(p, q, xs[part], ys[part], ns[part]):
            identity = same / max(x1 - x0, y1 - y0, 1)
            if min(x1 - x0, y1 - y0) >= min_words and identity >= min_identity:
                return x0, x1, y0, y1, round(identity, 4)
    return None


def aligned(chains: DataFrame, docs: DataFrame, id_col: str, text_col: str, out: str,
            min_words: int, min_identity: float) -> DataFrame:
    """Chains -> passages."""
    raw = docs.select(F.col(id_col).cast("long").alias("doc"), F.encode(F.col(text_col), "UTF-8").alias("raw"))
    side = lambda no, doc, first, last: F.struct(
        F.lit(no).alias("side"), F.col(doc).alias("doc"), F.greatest(F.col(first) - MARGIN, F.lit(0)).alias("from"), F.col(last).alias("last"))
    sides = chains.select(*chains.columns, F.explode(F.array(side(0, "a", "xo", "xz"), side(1, "b", "yo", "yz"))).alias("s")).select(
        *chains.columns, "s.*")
    regions = sides.join(raw, "doc").withColumn("raw", F.substr("raw", F.col("from") + 1, F.col("last") + MARGIN - F.col("from")))
    key = ["b", "a", "xs", "ys", "ns", "xo", "yo"]
    # an id with several texts has several regions: all of them are compared
    both = (regions.groupBy(*key).agg(F.collect_set(F.when(F.col("side") == 0, F.col("raw"))).alias("ra"),
                                      F.collect_set(F.when(F.col("side") == 1, F.col("raw"))).alias("rb"))
            .withColumn("ra", F.explode("ra")).withColumn("rb", F.explode("rb")))

    def passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                p, px = numbered(r.ra, max(r.xo - MARGIN, 0), r.xo, int(r.xs[0]))
                q, qy = numbered(r.rb, max(r.yo - MARGIN, 0), r.yo, int(r.ys[0]))
                found = passage(p, q, [int(v) - px for v in r.xs], [int(v) - qy for v in r.ys], [int(v) for v in r.ns],
                                min_words, min_identity)
                if found:
                    x0, x1, y0, y1, identity = found
                    rows.append((r.b, r.a, y0 + qy, y1 + qy, x0 + px, x1 + px, identity))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in out.split(", ")])

    return both.select("a", "b", "xs", "ys", "ns", "xo", "yo", "ra", "rb").mapInPandas(passages, out)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY) -> DataFrame:
    """(doc_id, other_doc_id, start_word, end_word, other_start, other_end,
    identity): passages of a document, in word numbers from 0 with the end
    exclusive, that it shares with a document of a smaller id.  Of the documents
    that share a passage, each is paired with the first and with the last.

    Null and short texts have no passages; rows without id take no part; rows
    of one id are one document and not compared with each other; copies of a
    whole document are passages.  An empty table gives an empty result; other
    columns are not read."""
    if min_words < MIN_WORDS:
        raise ValueError(f"seeds are thinned for passages of at least {MIN_WORDS} words")
    ship_package(docs.sparkSession)
    out = ("doc_id long, other_doc_id long, start_word long, end_word long, other_start long, other_end long, "
           "identity double")

    def passages(links: DataFrame, name: str) -> DataFrame:
        chains = written(chained(links), f"{name}-chains")
        found = written(aligned(chains, docs, id_col, text_col, out, min_words, min_identity).distinct(), name)
        discard(chains)
        return found

    shared = written(shared_rows(seed_rows(docs, id_col, text_col)), "passage-seeds")
    pairs = written(shared_rows(pair_rows(shared)), "passage-pairs")
    many = pairs.unionByName(shared.where(F.col("n") == STRETCH)).where(F.col("size") > FEW)
    found = passages(pair_links(shared).unionByName(pair_links(pairs)).unionByName(star_links(many)), "passages")
    rest = written(uncovered(many, found), "passage-rest")
    at_seed = Window.partitionBy("seed")
    base = written(many.select("seed", "doc", "at", "n").join(rest.select("seed").distinct(), "seed", "left_semi").distinct()
                   .withColumns({"first": F.min(F.struct("doc", "at")).over(at_seed), "size": F.count(F.lit(1)).over(at_seed)}), "passage-base")
    for t in (shared, pairs):
        discard(t)
    small = base.where(F.col("size") <= WHOLE)
    links = all_links(rest.join(small.select("seed").distinct(), "seed", "left_semi"), small)
    crowd = written(apart(base.where(F.col("size") > WHOLE).join(rest.select("seed", "doc", "at").distinct().withColumn("open", F.lit(True)),
                                                                 ["seed", "doc", "at"], "left")
                          .withColumn("open", F.coalesce("open", F.lit(False)))), "passage-crowd")
    lead = (F.col("doc") == F.col("first.doc")) & (F.col("at") == F.col("first.at"))
    direct = (F.col("opens") <= 2 * FEW) | (F.col("size") <= WHOLE)
    near = written(parted(gram_rows(crowd.where(~direct).withColumn("lead", lead), docs, id_col, text_col)), "passage-near")
    # only documents count from here on: parts of the same ones are one
    parts = apart(near.where(F.col("size") > FEW).withColumn("at", F.lit(0).cast("long")))
    pairs = (near_pairs(crowd.where(direct)).unionByName(near_pairs(near.where(F.col("size") <= FEW))).unionByName(near_pairs(parts)))
    more = passages(links.unionByName(links_of(pairs, base)), "passages-rest")
    for t in (rest, base, crowd, near):
        discard(t)
    return found.unionByName(more).distinct()


def without_passages(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every passage of ``found`` cut out of the later document;
    the earliest document keeps it.  Words that stay are joined by one space."""
    spans = (found.groupBy(F.col("doc_id").alias("__tr_doc"))
             .agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("start_word", F.col("end_word") - 1)))).alias("__tr_gone")))
    both = docs.join(spans, F.col(id_col) == F.col("__tr_doc"), "left")
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    every = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    kept = F.transform(F.array_except(every, F.col("__tr_gone").cast("array<int>")), lambda i: F.get(words, i))
    text = F.when(F.col("__tr_gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, " "))
    return both.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
