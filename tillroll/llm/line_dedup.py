"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line of a document is removed when an earlier line of the corpus (smaller
document id, then smaller line number) has the same text or a text within edit
distance 1 (one character inserted, deleted or replaced).  Blank lines stay.

1. ``blocks``: two lines within one edit have a common prefix and a common
   suffix that together miss at most one character of the longer one.  So they
   agree in the first two thirds, or in the last two thirds, or in the first
   and the last third.  Lines are keyed by all three (the sizes depend only on
   the line's length class, so partners of different length agree on them), and
   only lines whose key another text shares go on.  This is lossless, and two
   thirds of a line stay selective as the corpus grows.  Remainders still longer
   than ``MAX_REST`` are keyed again the same way; those of just ``MAX_REST``
   both stay and are keyed, as the partner of either length needs.
2. ``variants``: every deletion of one character from the remainder, as a
   hashed key with the deleted place, and the remainder itself as a centre.
3. Equal keys are joined: a variant that equals a centre is an insertion or
   deletion; variants that agree in key and place replace one character.  Rows
   link to the earliest line of their key instead of to each other, so nobody
   emits the pairs of a group.
4. Every link is verified with Levenshtein distance on the remainders, and by
   a second hash of the part that their key covers; lines are told apart by
   128 bits.

Scale: keys and hashes are shuffled for all lines, texts for the lines only that
share a key; counting keys is map-side combined, joins are plain equi-joins that adaptive
execution splits on hot keys.  Candidates and links are written tables in the
shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm._common import P, table, without, written

CLASS = 16        # lengths of one class: 16c to 16c + 15
MAX_REST = 64     # longer remainders are keyed again before variants are made


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per non-blank line: document id, text hash of the document, line
    number from 0, the line and its 128-bit hash."""
    text = F.col(text_col)
    return (docs.where(text.isNotNull())
            .select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("text_hash"),
                    F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
            .where(F.length(F.trim("line")) > 0)
            .withColumn("h", F.xxhash64("line")).withColumn("g", F.xxhash64(F.lit(1), "line")))


SAME = ["key", "check", "h", "g"]
COLUMNS = [*SAME, "pos", "rest"]


def keyed(rows: DataFrame) -> DataFrame:
    """Rows of ``COLUMNS`` -> the same rows keyed by (key, class, side, two thirds
    of ``rest``), ``rest`` being what those do not cover; ``check`` is a second
    hash of the same.

    Of m = 16 class - 1 characters that two partners share at least, a key takes
    the first two thirds, the last two thirds, or the first and last m - 2m/3 + 1:
    if neither prefix nor suffix has two thirds, both are that long.  A
    remainder at the lower end of its length class also joins the class below,
    where the partner that is one character shorter is."""
    size = F.length("rest")
    own = F.floor(size / CLASS).cast("int")
    classes = F.when((size % CLASS == 0) & (own > 1), F.array(own, own - 1)).otherwise(F.array(own))
    common = F.col("cls") * CLASS - 1
    long = F.ceil(common * 2 / 3).cast("int")
    cut = (rows.withColumn("size", size).withColumn("cls", F.explode(classes))
           .withColumns({"long": long, "short": common - long + 1}).withColumn("side", F.explode(F.array(*map(F.lit, range(3))))))
    side = F.col("side")
    kept = F.when(side == 0, F.expr("left(rest, long)")).when(side == 1, F.expr("right(rest, long)")) \
        .otherwise(F.concat(F.expr("left(rest, short)"), F.expr("right(rest, short)")))
    left = F.when(side == 0, F.expr("substring(rest, long + 1)")).when(side == 1, F.expr("left(rest, size - long)")) \
        .otherwise(F.expr("substring(rest, short + 1, size - 2 * short)"))
    return cut.select(F.xxhash64("key", "cls", "side", kept).alias("key"), F.xxhash64(F.lit(1), "check", "cls", "side", kept).alias("check"),
                      "h", "g", "pos", left.alias("rest"))


def blocks(rows: DataFrame) -> DataFrame:
    """Rows of ``keyed`` whose key at least two different lines share, one row
    per key and line with its earliest position.

    Keys and line hashes go first, 16 bytes a key; texts are looked at again only
    for the lines that have a shared key."""
    pairs = written(keyed(rows).select("key", "h"), "line-pairs")
    shared = (pairs.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"))
              .where("low < high").select("key"))
    # written tables, joined by sorting at every size: the key of a line that fills
    # a third of the corpus is a skewed key that adaptive execution splits
    shared = written(shared, "line-keys")
    lines = written(pairs.join(shared.hint("merge"), "key", "left_semi").select("h").distinct(), "line-hashes")
    texts = one_per_line(rows.join(lines.hint("merge"), "h", "left_semi"))
    return one_per_line(keyed(texts).join(shared.hint("merge"), "key", "left_semi"))


def one_per_line(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*SAME).agg(F.min("pos").alias("pos"), F.min("rest").alias("rest")).select(COLUMNS)


def candidates(lines: DataFrame) -> DataFrame:
    """Lines that share all but a remainder with another line."""
    zero = F.lit(0).cast("long")
    start = lines.select(zero.alias("key"), zero.alias("check"), "h", "g", F.struct("doc", "line_no").alias("pos"), F.col("line").alias("rest"))
    size = F.length("rest")
    # lines below one class, and those one longer, are compared as a whole
    short = one_per_line(start.where(size <= CLASS))
    found = written(blocks(start.where(size >= CLASS)).unionByName(short), "line-blocks")
    done = found.where(size <= MAX_REST)
    while (found.agg(F.max(size)).first()[0] or 0) > MAX_REST:
        # remainders of MAX_REST are compared as they are, and also keyed again:
        # the partner that is one character longer is
        found = written(blocks(found.where(size >= MAX_REST)), "line-blocks")
        done = done.unionByName(found.where(size <= MAX_REST))
    return done


def variants(cand: DataFrame) -> DataFrame:
    """Rows of ``COLUMNS`` -> (variant, place, key, h, pos): one row per deleted
    character, and one with place -1 for the remainder itself."""
    def drop(i: Column) -> Column:
        left = F.concat(F.substr("rest", F.lit(1), i - 1), F.substr("rest", i + 1))
        return F.struct(F.xxhash64("key", left).alias("variant"), i.alias("place"))

    whole = F.struct(F.xxhash64("key", "rest").alias("variant"), F.lit(-1).alias("place"))
    deleted = F.when(F.length("rest") > 0, F.transform(F.sequence(F.lit(1), F.length("rest")), drop))
    every = F.concat(F.array(whole), F.coalesce(deleted, F.array().cast("array<struct<variant:bigint,place:int>>")))
    return cand.select(F.explode(every).alias("v"), "key", "h", "pos").select("v.*", "key", "h", "pos")


def near_lines(cand: DataFrame) -> DataFrame:
    """(h, g, near): the earliest position of a line within one edit, for lines
    that have an earlier one."""
    made = variants(cand)
    # most keys belong to one line only: those go before anything else
    shared = (made.groupBy("variant").agg(F.min("h").alias("low"), F.max("h").alias("high"))
              .where("low < high").select("variant"))
    rows = written(made.join(shared, "variant", "left_semi"), "line-variants")
    who = F.struct("pos", "h", "key")
    centre = F.col("place") == -1
    groups = rows.groupBy("variant", "place").agg(F.min(who).alias("who"))
    replaced = (rows.where(~centre).join(groups.where(~centre), ["variant", "place"])
                .select("key", "h", "pos", F.col("who.h").alias("to_h"), F.col("who.pos").alias("to_pos")))
    centres = rows.where(centre).select("variant", F.col("h").alias("c_h"), F.col("pos").alias("c_pos"), "key")
    shorter = (rows.where(~centre).join(centres, ["variant", "key"])
               .select("key", "h", "pos", F.col("c_h").alias("to_h"), F.col("c_pos").alias("to_pos")))
    earliest = (rows.where(~centre).groupBy("variant", "key").agg(F.min(F.struct("pos", "h")).alias("who")))
    longer = (centres.join(earliest, ["variant", "key"])
              .select("key", F.col("c_h").alias("h"), F.col("c_pos").alias("pos"),
                      F.col("who.h").alias("to_h"), F.col("who.pos").alias("to_pos")))
    links = (replaced.unionByName(shorter).unionByName(longer)
             .where((F.col("to_pos") < F.col("pos")) & (F.col("h") != F.col("to_h"))).distinct())
    text = cand.select("key", "check", "h", "g", "rest")
    other = cand.select("key", "check", F.col("h").alias("to_h"), F.col("rest").alias("to_rest"))
    return (links.join(text, ["key", "h"]).join(other, ["key", "check", "to_h"])
            .where(F.levenshtein("rest", "to_rest", 1).between(0, 1))
            .groupBy("h", "g").agg(F.min("to_pos").alias("near")))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text_hash, line_no): the lines to remove."""
    lines = occurrences(docs, id_col, text_col)
    near = written(near_lines(candidates(lines)), "line-near")
    here = lines.select("doc", "text_hash", "line_no", "h", "g")
    pos = F.struct("doc", "line_no")
    first = here.groupBy("h", "g").agg(F.min(pos).alias("first"), F.count(F.lit(1)).alias("n"))
    earliest = (first.join(near, ["h", "g"], "left").where((F.col("n") > 1) | F.col("near").isNotNull())
                .select("h", "g", F.least("first", F.coalesce("near", "first")).alias("first")))
    earliest = written(earliest, "line-first")
    return here.join(earliest, ["h", "g"]).where(F.col("first") < pos).select("doc", "text_hash", "line_no")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated lines removed from the text, and ``n_lines`` and
    ``n_removed``.

    A null text stays null with 0 lines; a text whose lines all go becomes
    empty, and its row stays.  Rows without an id come before all others.
    Positions that are equal (repeated rows of one id) are not earlier than
    each other, so such copies keep their lines.  An empty table gives an empty
    result; input columns named n_lines or n_removed are replaced."""
    docs = without(docs, "n_lines", "n_removed")
    cols = docs.columns
    gone = (repeated_lines(docs, id_col, text_col).groupBy("doc", "text_hash")
            .agg(F.collect_set("line_no").alias(f"{P}gone"))
            .withColumnsRenamed({"doc": f"{P}doc", "text_hash": f"{P}hash"}))
    text = F.col(text_col)
    hashed = docs.withColumn(f"{P}text_hash", F.xxhash64(text))
    # by sorting at every size: a table of removed lines grows with the corpus
    both = hashed.join(gone.hint("merge"), F.col(id_col).eqNullSafe(F.col(f"{P}doc"))
                       & (F.col(f"{P}text_hash") == F.col(f"{P}hash")), "left")
    lines = F.split(text, "\n", -1)
    size = F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(f"{P}gone"))
    cut = F.array_join(F.transform(kept, lambda i: F.get(F.col(f"{P}lines"), i)), "\n")
    return (both.withColumn(f"{P}lines", F.when(F.col(f"{P}gone").isNotNull(), lines))
            .select(*[F.when(F.col(f"{P}gone").isNull(), text).otherwise(cut).alias(c) if c == text_col else F.col(c)
                      for c in cols],
                    size.alias("n_lines"), F.coalesce(F.size(f"{P}gone"), F.lit(0)).alias("n_removed")))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


# Lines within one edit agree in their first or last floor((n-1)/2) characters,
# n being the shorter length.  Candidates are verified by their common prefix
# and suffix, which cover all but one character (DuckDB's levenshtein counts
# bytes).  left(x, i) past the end of the shorter line differs or equals it.
OP1_SQL = """
WITH doc AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
occ AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS line
        FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM doc)
        WHERE length(trim(ls[i])) > 0),
uniq AS (SELECT line, length(line) AS n, min((doc_id, line_no)) AS pos FROM occ GROUP BY line),
keyed AS (SELECT u.line, u.pos, s.side, m.n AS n,
                 CASE WHEN s.side = 0 THEN left(u.line, CAST((m.n - 1) // 2 AS INT)) ELSE right(u.line, CAST((m.n - 1) // 2 AS INT)) END AS half
          FROM uniq u, (VALUES (0), (1)) s(side), LATERAL (SELECT unnest([u.n, u.n - 1]) AS n) m
          WHERE m.n > 0),
near AS (SELECT a.line, min(b.pos) AS pos FROM keyed a JOIN keyed b
           ON a.side = b.side AND a.n = b.n AND a.half = b.half AND b.pos < a.pos
          WHERE a.line <> b.line
           AND len([i FOR i IN range(1, length(a.line) + 1) IF left(a.line, CAST(i AS INT)) = left(b.line, CAST(i AS INT))])
             + len([i FOR i IN range(1, length(a.line) + 1) IF right(a.line, CAST(i AS INT)) = right(b.line, CAST(i AS INT))])
             >= greatest(length(a.line), length(b.line)) - 1
         GROUP BY a.line),
gone AS (SELECT o.doc_id, o.line_no FROM occ o JOIN uniq u USING (line) LEFT JOIN near USING (line)
          WHERE least(u.pos, coalesce(near.pos, u.pos)) < (o.doc_id, o.line_no)),
cut AS (SELECT doc_id, list(line_no) AS nos FROM gone GROUP BY doc_id),
out AS (SELECT d.doc_id, len(ls) AS n_lines, coalesce(len(nos), 0) AS n_removed,
               CASE WHEN nos IS NULL THEN text ELSE array_to_string([ls[i] FOR i IN range(1, len(ls) + 1) IF NOT list_contains(nos, i - 1)], chr(10)) END AS text
        FROM doc d LEFT JOIN cut USING (doc_id))
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, n_removed, length(text) AS n_chars, md5(text) AS text_md5 FROM out
"""
