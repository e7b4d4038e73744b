"""Personal data: patterns propose spans, validators confirm them, context
words adjust their score.

Kinds email, ip, card (Luhn) and phone are the base kinds; iban (ISO 13616,
mod 97) is added by this operator when its score reaches ``MIN_SCORE``.  All of
it is one projection: no shuffle, no Python.

The patterns are the contract's, written with possessive repeats and a start
condition (start of a run of allowed characters, or the end of the previous
match), which finds the same leftmost matches in linear time on any text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm._common import P, table, without

# Kinds in order, their patterns, and a cheap test that any text
# with a valid span passes.
KINDS = ["email", "ip", "card", "phone", "iban"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
HINTS = {
    "email": r"@",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){13}",
    "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
}
# Score of a confirmed span, words that raise it, their weight.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8}
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": r"\bip\b|server|host|address|login",
    "card": r"card|visa|credit|debit|payment|\bpay\b",
    "phone": r"phone|\btel|call|mobile|fax|contact",
    "iban": "iban|bank|account|transfer|swift",
}
CONTEXT_CHARS = 40
CONTEXT_WEIGHT = 0.15
MIN_SCORE = 0.5


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Luhn check of a digit string."""
    figures = F.split(F.reverse(number), "")

    def add(total: Column, i: Column) -> Column:
        d = F.get(figures, i).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """ISO 7064 mod-97 check of a compact IBAN."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def confirmed(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3)
                        & (F.coalesce(F.nullif(F.ltrim(p, F.lit("0")), F.lit("")), F.lit("0")).try_cast("int") <= 255))
    number = digits(m)
    if kind == "card":
        return F.when(F.length(number).between(14, 19), luhn(number)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(number).between(10, 15)
    compact = F.replace(m, F.lit(" "), F.lit(""))
    return F.when(F.length(compact).between(15, 34), mod97(compact)).otherwise(F.lit(False))


def find_pii(docs: DataFrame, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` with ``pii``: an array of (start, kind_no, kind, end, score), in
    code points, end exclusive, by start and then kind.

    Matches of one kind do not overlap; spans of different kinds may.  A null
    text is an empty text and has no spans; an input column named pii is
    replaced."""
    docs = without(docs, "pii")
    cols = docs.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn(f"{P}text", text)
    text = F.col(f"{P}text")
    none = F.array().cast("array<string>")
    df = df.withColumns({f"{P}{k}": F.when(text.rlike(HINTS[k]),
                                           F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))).otherwise(none)
                         for k in KINDS})
    # one walk over the matches and the gaps before them; unconfirmed ones count
    # for the places only
    def spans(no: int, k: str) -> Column:
        info = F.transform(f"{P}{k}", lambda m: F.struct(F.length(m).alias("size"), confirmed(k, m).alias("ok")))
        gaps = F.slice(F.transform(F.split(text, PATTERNS[k], -1), F.length), 1, F.size(f"{P}{k}"))
        pieces = F.zip_with(info, gaps, lambda m, g: F.struct(m["size"].alias("size"), m["ok"].alias("ok"), g.alias("gap")))
        empty = F.array().cast("array<struct<start:int,kind_no:int,kind:string,end:int>>")

        def step(acc: Column, m: Column) -> Column:
            start = acc["at"] + m["gap"]
            span = F.struct(start.alias("start"), F.lit(no).alias("kind_no"), F.lit(k).alias("kind"), (start + m["size"]).alias("end"))
            return F.struct((start + m["size"]).alias("at"), F.when(m["ok"], F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        walked = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
        return F.when(F.size(f"{P}{k}") > 0, walked).otherwise(empty)

    df = df.withColumn(f"{P}spans", F.concat(*[spans(no, k) for no, k in enumerate(KINDS)]))

    def scored(s: Column) -> Column:
        near = F.lower(F.concat(
            F.substr(text, F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT_CHARS))),
            F.lit(" "), F.substr(text, s["end"] + 1, F.lit(CONTEXT_CHARS))))
        base, hit = F.lit(0.0), F.lit(False)
        for k in KINDS:
            base = F.when(s["kind"] == k, F.lit(SCORES[k])).otherwise(base)
            hit = hit | ((s["kind"] == k) & near.rlike(CONTEXT[k]))
        score = F.round(base + F.when(hit, F.lit(CONTEXT_WEIGHT)).otherwise(F.lit(-CONTEXT_WEIGHT / 3)), 2)
        return F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["kind"].alias("kind"),
                        s["end"].alias("end"), score.alias("score"))

    found = F.transform(F.col(f"{P}spans"), scored)
    kept = F.filter(found, lambda s: (s["kind"] != "iban") | (s["score"] >= min_score))
    return df.select(*cols, F.array_sort(kept).alias("pii"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    pii = F.col("pii")
    base = F.filter(pii, lambda s: s["kind"] != "iban")
    count = lambda k: F.size(F.filter(pii, lambda s: s["kind"] == k)).cast("long")
    show = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(show(base), 256).alias("base_sha256"), show(pii).alias("spans"),
        F.array_join(F.transform(pii, lambda s: s["score"].cast("string")), ",").alias("scores"))


def _op9_sql() -> str:
    """The spans by splitting at the matches; the patterns in the plain form of
    the contract.  RE2 has no look-around: word boundaries stand in for it."""
    plain = PATTERNS | {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    }
    matches = " UNION ALL ".join(
        f"SELECT doc_id, t, {no} AS no, '{k}' AS kind, regexp_extract_all(t, '{plain[k]}') AS ms, "
        f"string_split_regex(t, '{plain[k]}') AS gaps FROM d" for no, k in enumerate(KINDS))
    base = "CASE kind " + " ".join(f"WHEN '{k}' THEN {SCORES[k]}" for k in KINDS) + " END"
    near = " OR ".join(f"(kind = '{k}' AND regexp_matches(near, '{CONTEXT[k]}'))" for k in KINDS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({matches}),
e AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m),
s AS (SELECT doc_id, t, no, kind, ms[i] AS x, regexp_replace(ms[i], '[^0-9]', '', 'g') AS ds, replace(ms[i], ' ', '') AS ib,
             CAST(list_sum([length(g) FOR g IN gaps[1:i]]) + coalesce(list_sum([length(g) FOR g IN ms[1:i - 1]]), 0) AS BIGINT) AS a
      FROM e),
v AS (SELECT *, a + length(x) AS z FROM s WHERE CASE kind
        WHEN 'email' THEN true
        WHEN 'ip' THEN len([p FOR p IN string_split(x, '.') IF length(ltrim(p, '0')) > 3
                            OR coalesce(TRY_CAST(nullif(ltrim(p, '0'), '') AS INT), 0) > 255]) = 0
        WHEN 'card' THEN length(ds) BETWEEN 14 AND 19 AND list_sum([
               CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(ds), i, 1) AS INT)
                    ELSE (2 * CAST(substr(reverse(ds), i, 1) AS INT)) // 10 + (2 * CAST(substr(reverse(ds), i, 1) AS INT)) % 10 END
               FOR i IN range(1, length(ds) + 1)]) % 10 = 0
        WHEN 'phone' THEN length(ds) BETWEEN 10 AND 15
        ELSE length(ib) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, [CASE WHEN ascii(c) < 65 THEN ascii(c) - 48
               ELSE ascii(c) - 55 END FOR c IN string_split(ib[5:] || ib[:4], '')]),
               lambda r, c: CASE WHEN c < 10 THEN (r * 10 + c) % 97 ELSE (r * 100 + c) % 97 END) = 1 END),
c AS (SELECT *, lower(substr(t, greatest(a - {CONTEXT_CHARS}, 0) + 1, least(a, {CONTEXT_CHARS})) || ' '
                      || substr(t, z + 1, {CONTEXT_CHARS})) AS near FROM v),
f AS (SELECT doc_id, no, kind, a, z, kind || ':' || a || ':' || z AS span,
             round({base} + CASE WHEN {near} THEN {CONTEXT_WEIGHT} ELSE {-CONTEXT_WEIGHT / 3} END, 2) AS score FROM c),
g AS (SELECT doc_id, COUNT(*) FILTER (kind = 'email') AS n_email, COUNT(*) FILTER (kind = 'ip') AS n_ip,
             COUNT(*) FILTER (kind = 'card') AS n_card, COUNT(*) FILTER (kind = 'phone') AS n_phone,
             coalesce(string_agg(span, ',' ORDER BY a, no) FILTER (kind <> 'iban'), '') AS base,
             string_agg(span, ',' ORDER BY a, no) AS spans,
             string_agg(CAST(CAST(score AS DOUBLE) AS VARCHAR), ',' ORDER BY a, no) AS scores
      FROM f WHERE kind <> 'iban' OR score >= {MIN_SCORE} GROUP BY 1)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(scores, '') AS scores FROM d LEFT JOIN g USING (doc_id)"""


OP9_SQL = _op9_sql()
