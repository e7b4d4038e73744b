"""Small frames that hold the awkward cases."""

import duckdb

SMALL = "/root/testdata/sf0.001"
WORDS = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau "
         "upsilon phi chi psi omega").split()


def prose(seed, n):
    """Deterministic words that repeat no long run."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[x % len(WORDS)] + str(x // 64 % 97))
    return " ".join(out)


def odd_docs():
    """(doc_id, text, lang, source, shard, size, score, print): null in every
    column, empty, blank and long texts, repeated rows, clashing names."""
    long = prose(5, 9000)
    rows = [
        (1, prose(1, 80), "en", "a"), (2, prose(1, 80), "en", "a"), (3, "", "en", "a"), (4, "   \n\t ", "de", "b"),
        (5, None, "de", "b"), (6, long, None, "b"), (7, long + " end", "fr", None), (8, "one", "fr", "c"),
        (9, "line one here\nsame line again\nline one here", "en", "c"), (10, "same line again\nother", "en", "c"),
        (10, "same line again\nother", "en", "c"), (None, prose(2, 60), "en", "a"), (None, None, None, None),
        (11, "ünïcödé ☃ \U0001f600 text\nsame line agaim", "en", "a"), (12, prose(3, 70) + " " + prose(1, 80), "en", "c"),
    ]
    return [r + (7, 8.5, "x", 3) for r in rows]


COLUMNS = "doc_id long, text string, lang string, source string, shard int, score double, fingerprint string, n_tokens int"


def odd(spark):
    return spark.createDataFrame(odd_docs(), COLUMNS)


def none(spark):
    return spark.createDataFrame([], COLUMNS)


def small_texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall())


def dicts(df):
    return [r.asDict() for r in df.collect()]
