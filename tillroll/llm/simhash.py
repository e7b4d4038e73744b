"""SimHash near-dedup with Golay-code fuzzy hashing.

A document's fingerprint has 64 bits, the majority vote of the XXH64 hashes of
its word shingles.  Fingerprints link at ``MAX_BITS`` = 4 or fewer differing
bits; documents of one connected component are near copies.

Candidate search.  The fingerprint is cut into three segments of 22, 21 and 21
bits, read as words of the perfect binary Golay code [23, 12, 7].  The indices
(12 bits) of a word are those of all codewords within distance 4 of it: the
nearest one alone when that is within 2, else the nearest and the five at
distance 4, 5.35 on average.  Two words within distance 2 always share such a
codeword.  Of 4 errors in three segments, either

- a segment has none, and of the other two one has at most 2: the keys are a
  whole segment with an index of another one (six ways, 34 bits), or
- every segment has one or two: the key is an index of all three (36 bits).

A fingerprint has 185 keys on average, selective enough that strangers rarely
meet: rows after the key count stay in proportion to the near copies.

Groups of copies.  Equal fingerprints are one node.  At every key, members link
to the key's smallest fingerprint (verified), which joins dense groups without
their pairs; components of these links are found.  What is left are links
between different components at a key: only members outside the component of
the key's smallest are compared, and only with the rest's members of other
components.  All links that could join two components are thereby checked: the
result is exact.

Python: shingling and the Golay decoding, in Arrow batches.  The search, links
and components are joins and aggregates on (key, fingerprint), 16 bytes a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tillroll.llm._common import P, table, written
from tillroll.llm.components import components
from tillroll.session import ship_package

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))   # first bit and bits

GENERATOR = 0b101011100011                 # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


# --- fingerprints -----------------------------------------------------------

# Row 256 p + v: the bits of byte value v at byte place p, for counting bits
# from byte histograms.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of one text; 0 for a text without words.

    Bytes.lower changes A-Z only, and bytes.split cuts at the ASCII white space
    0x20 and 0x09-0x0D."""
    from xxhash import xxh64_intdigest

    if not text:
        return 0
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = memoryview(b" ".join(parts))
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(parts) > words:
        starts, ends = starts[:len(parts) - words + 1], ends[words - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    n = len(starts)
    hashes = np.fromiter((xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist())),
                         dtype="<u8", count=n)
    places = hashes.view(np.uint8).reshape(n, 8) + (np.arange(8) * 256)
    counts = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    bits = (counts.ravel() * 2 > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(words: int = SHINGLE_WORDS):
    """Column function: text -> fingerprint as a signed long."""
    @pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            f = np.fromiter((fingerprint(t, words) for t in s), dtype=np.uint64, count=len(s))
            yield pd.Series(f.view(np.int64))

    return of


# --- Golay keys -------------------------------------------------------------

def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndrome of each low byte and high part, nearest error, errors of
    weight 4), built from the generator polynomial.

    ``nearest[s]`` is the only error of weight 3 or less with syndrome s;
    ``four[s]`` are the five errors of weight 4 with it when the nearest has
    weight 3, else zeros."""
    power = np.zeros(23, dtype=np.int64)
    rest = 1
    for i in range(23):
        power[i] = rest
        rest <<= 1
        if rest >> 11:
            rest ^= GENERATOR
    nearest = np.zeros(2048, dtype=np.int64)
    four = np.zeros((2048, 5), dtype=np.int64)
    filled = np.zeros(2048, dtype=np.int64)
    weight = np.zeros(2048, dtype=np.int64)
    for w in range(1, 5):
        for bits in combinations(range(23), w):
            s, e = int(np.bitwise_xor.reduce(power[list(bits)])), sum(1 << i for i in bits)
            if w < 4:
                nearest[s], weight[s] = e, w
            elif weight[s] == 3:
                four[s, filled[s]] = e
                filled[s] += 1
    return power, nearest, four


_GOLAY: list[np.ndarray] = []


def codeword_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """23-bit words -> (n, 6) indices of the codewords within distance 4, and
    which of them exist.  The code is systematic: the high 12 bits index it."""
    if not _GOLAY:
        _GOLAY.extend(golay_tables())
    power, nearest, four = _GOLAY
    words = words.astype(np.int64)
    syndrome = np.zeros_like(words)
    for i in range(23):
        syndrome ^= ((words >> i) & 1) * power[i]
    near, others = nearest[syndrome], four[syndrome]
    index = np.concatenate([(words ^ near)[:, None], words[:, None] ^ others], axis=1) >> 11
    real = np.concatenate([np.ones((len(words), 1), dtype=bool), others != 0], axis=1)
    return index, real


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every fingerprint: a segment with an index of another one,
    and indices of all three; the high bits say which."""
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    indexed = [codeword_indices(p) for p in parts]
    rows, keys = [], []
    for no, (i, j) in enumerate(permutations(range(3), 2)):
        index, real = indexed[j]
        rows.append(np.nonzero(real)[0])
        keys.append(((no << 36) | (parts[i][:, None] << 12) | index)[real])
    (ia, ra), (ib, rb), (ic, rc) = indexed
    real = ra[:, :, None, None] & rb[:, None, :, None] & rc[:, None, None, :]
    rows.append(np.nonzero(real)[0])
    keys.append(((6 << 36) | (ia[:, :, None, None] << 24) | (ib[:, None, :, None] << 12) | ic[:, None, None, :])[real])
    return np.concatenate(rows), np.concatenate(keys)


def keyed(prints: DataFrame) -> DataFrame:
    """(print) -> (key, print), several keys each."""
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1024):
                p = b["print"].to_numpy(dtype=np.int64)[at:at + 1024]
                row, key = golay_keys(p.view(np.uint64))
                yield pd.DataFrame({"key": key, "print": p[row]})

    return prints.mapInPandas(emit, "key long, print long")


# --- links ------------------------------------------------------------------

def near(a: str, b: str, bits: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits


def linked(prints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(print, component) of fingerprints that link to another one; prints must
    be distinct."""
    if not 0 <= bits <= 4:
        raise ValueError("the Golay keys find links of at most 4 differing bits")
    # a fingerprint is 8 bytes but has 185 keys: spread them before making keys
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = keyed(prints.repartition(parts, "print"))
    # one shuffle of 16-byte rows; a key holds distinct fingerprints that agree in
    # 34 bits or more, however many documents have them
    at_key = Window.partitionBy("key")
    members = written(keys.withColumns({"head": F.min("print").over(at_key), "last": F.max("print").over(at_key),
                                        "size": F.count(F.lit(1)).over(at_key)})
                      .where("head < last").drop("last"), "simhash-members")
    rest = members.where(F.col("print") != F.col("head"))
    stars = rest.where(near("print", "head", bits))
    found = written(components(stars.select(F.col("print").alias("a"), F.col("head").alias("b"))), "simhash-stars")
    labels = found.select(F.col("node").alias("print"), F.col("component").alias("label"))
    # members far from their head can only meet others of the rest: keys of three
    # or more; which of them are in another component than their head is looked up
    # once for a pair of fingerprints, not at every key
    far = rest.where("size > 2").where(~near("print", "head", bits))
    heads = labels.select(F.col("print").alias("head"), F.col("label").alias("head_label"))
    strangers = (far.select("print", "head").distinct().join(labels, "print", "left").join(heads, "head", "left")
                 .withColumn("label", F.coalesce("label", "print")).where(F.col("label") != F.coalesce("head_label", "head"))
                 .drop("head_label"))
    outside = written(far.join(strangers, ["print", "head"]).select("key", F.col("print").alias("one"), F.col("label").alias("one_label")),
                      "simhash-outside")
    others = (rest.join(outside.select("key").distinct(), "key", "left_semi").join(labels, "print", "left")
              .select("key", F.col("print").alias("two"), F.coalesce("label", "print").alias("two_label")))
    more = (outside.join(others, (outside["key"] == others["key"]) & (F.col("one_label") != F.col("two_label"))
                         & near("one", "two", bits))
            .select(F.col("one_label").alias("a"), F.col("two_label").alias("b")).distinct())
    joined = components(more).select(F.col("node").alias("label"), F.col("component").alias("top"))
    extra = written(joined, "simhash-joined")
    every = labels.unionByName(more_nodes(extra, labels))
    return (every.join(extra, "label", "left")
            .select("print", F.coalesce("top", "label").alias("component")))


def more_nodes(extra: DataFrame, labels: DataFrame) -> DataFrame:
    """Single fingerprints (their own label) that only the second step linked."""
    return (extra.select(F.col("label").alias("print"), "label")
            .join(labels.select("print"), "print", "left_anti"))


def near_prints(hashed: DataFrame, id_col: str = "doc_id", bits: int = MAX_BITS) -> DataFrame:
    """Rows with a fingerprint column ``print`` -> the same rows with
    ``fingerprint`` (16 hex digits) and ``component_id`` in its place."""
    cols = [c for c in hashed.columns if c != "print"]
    hashed = written(hashed, "simhash-rows")
    nodes = written(hashed.groupBy("print").agg(F.min(id_col).alias("first")), "simhash-nodes")
    groups = written(linked(nodes.select("print"), bits), "simhash-groups")
    grouped = written(nodes.join(groups, "print"), "simhash-grouped")
    smallest = written(grouped.groupBy("component").agg(F.min("first").alias("smallest")), "simhash-smallest")
    # two written tables: the component of very many copies is a skewed key that
    # adaptive execution splits
    ids = written(grouped.join(smallest, "component").select("print", "smallest"), "simhash-ids")
    return (hashed.join(nodes, "print").join(ids, "print", "left").withColumn("component_id", F.coalesce("smallest", "first"))
            .select(*cols, F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                words: int = SHINGLE_WORDS, bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` and ``component_id``, the
    smallest id of its near copies, its own included.

    A null or wordless text has fingerprint zero and links like any other.
    Repeated rows are one node and each keep their row; a row without an id
    takes the smallest id of its component (null if none has one).  An empty
    table gives an empty result.  Other columns are not carried."""
    ship_package(docs.sparkSession)
    return near_prints(docs.select(id_col, fingerprints(words)(F.col(text_col)).alias("print")), id_col, bits)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     words: int = SHINGLE_WORDS, bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest
    id.  Rows equal in all columns count as one; a component without any id
    keeps its distinct rows."""
    ship_package(docs.sparkSession)
    text, row = f"{P}text", f"{P}row"
    hashed = docs.select(id_col, F.xxhash64(text_col).alias(text), fingerprints(words)(F.col(text_col)).alias("print"))
    found = near_prints(hashed, id_col, bits).where(F.col(id_col).eqNullSafe(F.col("component_id")))
    kept = found.select(F.col(id_col).alias(f"{P}id"), F.col(text).alias(f"{P}kept")).distinct()
    same = F.col(id_col).eqNullSafe(F.col(f"{P}id")) & (F.xxhash64(text_col) == F.col(f"{P}kept"))
    return (docs.join(kept, same, "left_semi")
            .withColumn(row, F.xxhash64(*docs.columns)).dropDuplicates([id_col, row]).drop(row))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))
