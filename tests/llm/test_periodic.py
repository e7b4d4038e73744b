"""Periodic runs against a search of every period, place by place."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from fixtures_llm import SMALL, dicts, none, odd, prose, small_texts

from tillroll.llm import periodic
from tillroll.llm.queries import QUERIES


def brute(s, least=0):
    """{(start, end): smallest period} of all runs of at least ``least`` symbols."""
    out = {}
    for p in range(1, len(s) // 2 + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            if j - i >= p and j + p - i >= least:
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((a, b, p) for (a, b), p in out.items())


def shaped(r):
    """Texts over few symbols: random, repeated, Fibonacci and Thue-Morse words,
    periods inside periods, touching regions of one period."""
    n, kind = r.randint(0, 150), r.randint(0, 7)
    if kind == 0:
        return [r.randint(0, r.randint(1, 3)) for _ in range(n)]
    if kind == 1:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b
    if kind == 2:
        x = [0]
        while len(x) < n:
            x = x + [1 - y for y in x]
        return x
    if kind == 3:
        unit = [r.randint(0, 3) for _ in range(r.randint(1, 40))]
        return (unit * 9)[:n]
    if kind == 4:
        d, out = [r.randint(0, 1) for _ in range(r.randint(1, 5))], []
        for _ in range(3):
            u = d * r.randint(9, 30)
            out += u[:len(u) - r.randint(0, len(d) - 1)] * r.randint(1, 3)
        return out[:600]
    if kind == 5:
        return [0] * r.randint(0, n) + [1] + [0] * r.randint(0, n) + [1] * r.randint(0, 3) + [0] * 9
    u = [0]
    while len(u) < n:
        u = u * r.randint(1, 3) + u[:r.randint(0, len(u))] + [r.randint(0, 1)] * r.randint(0, 1)
    return u[:400]


def test_all_runs_of_shaped_texts():
    r = random.Random(7)
    for _ in range(1500):
        s = shaped(r)
        got = sorted(tuple(x) for x in periodic.all_runs(np.array(s, dtype=np.int64)).tolist()) if s else []
        assert got == brute(s), s


def test_omitted_periods_come_from_touching_regions():
    """A root that has itself a small period: no place of its scale is chosen."""
    s = np.array(([0, 1] * 40 + [0]) * 2, dtype=np.int64)
    whole = [0, len(s), 81]
    assert whole in periodic.all_runs(s).tolist()
    names = periodic.Names(s)
    small = periodic.direct(s, 2)
    assert not len(periodic.synchronising(names, 4, small)) and whole in periodic.across(names, small).tolist()


def test_chosen_places_are_consistent_and_dense():
    r = np.random.default_rng(2)
    s = np.concatenate([r.integers(0, 4, 700)] * 2 + [np.zeros(200, dtype=np.int64), r.integers(0, 4, 300)])
    names, runs = periodic.Names(s), periodic.all_runs(s)
    for k in (1, 2, 3):
        t, chosen = 1 << k, set(periodic.synchronising(names, k, runs).tolist())
        context = {}
        for i in range(len(s) - 2 * t):
            context.setdefault(tuple(s[i:i + 2 * t]), set()).add(i in chosen)
        assert all(len(v) == 1 for v in context.values())
        for i in range(0, 700 - 3 * t):                      # repeated part: every t places hold a choice
            window = s[i:i + 3 * t - 1].tolist()
            p = next(p for p in range(1, 3 * t) if window[p:] == window[:-p])
            assert (p * 3 <= t) or chosen & set(range(i, i + t))


def expected(doc_id, text, planted=True):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if planted and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = sorted((a, b - a, p) for a, b, p in brute(w, periodic.MIN_LENGTH))
    gone = set()
    for a, n, p in runs:
        gone |= set(range(a + p, a + n))
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return runs, kept.decode()


def digest(doc_id, runs, kept):
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    lines = "".join(f"{a},{n},{p}\n" for a, n, p in runs)
    return (doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query_against_brute_force(spark):
    got = QUERIES["op12_periodic_runs"](spark, SMALL).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    short = {d: t for d, t in small_texts().items() if len((t or "").split()) <= 1500}
    want = sorted((digest(d, *expected(d, t)) for d, t in short.items()), key=lambda r: r[0])
    assert sorted((tuple(r) for r in got if r["doc_id"] in short), key=lambda r: r[0]) == want
    assert len(got) == len(small_texts()) and sum(r[1] for r in want) > 10


def test_slices_do_not_matter(spark, monkeypatch):
    texts = ["a b c " * 9, prose(1, 40) + " " + "x y " * 20 + prose(1, 40), "", "one " * 50, prose(2, 300)] * 4
    words = [periodic.words_of(t) for t in texts]
    doc, runs, drop = periodic.runs_of(words, 12)
    at = 0
    for i, w in enumerate(words):
        alone = periodic.runs_of([w], 12)
        assert runs[doc == i].tolist() == alone[1].tolist() and drop[at:at + len(w)].tolist() == alone[2].tolist()
        at += len(w)


def test_awkward_rows(spark, monkeypatch):
    """Nulls, blanks, repeated rows, long texts and clashing columns."""
    monkeypatch.setattr(periodic, "SLICE_WORDS", 100)
    docs = odd(spark).withColumnsRenamed({"shard": "runs", "score": "collapsed"})
    docs = docs.union(spark.createDataFrame([(50, "ab\x0bab\x0c" * 30 + "é x " * 15, "en", "a", 1, 1.0, "p", 2)], docs.schema))
    got = dicts(periodic.periodic_runs(docs))
    assert set(got[0]) == set(docs.columns)
    key = lambda r: (str(r["doc_id"]), str(r["text"]))
    for r in sorted(got, key=key):
        if len(r["text"] or "") < 8000:
            runs, kept = expected(r["doc_id"], r["text"], planted=False)
            assert [(x["start"], x["length"], x["period"]) for x in r["runs"]] == runs and r["collapsed"] == kept
    assert sorted(map(key, got)) == sorted(map(key, dicts(docs)))
    assert periodic.periodic_runs(none(spark)).collect() == []


@pytest.mark.parametrize("text", ["w", "a b", " \t\n", "x y " * 3, " lead em x\x85y  trail "])
def test_repeated_tail(spark, text):
    import pyspark.sql.functions as F
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    df = spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string")
    for r in df.select("doc_id", periodic.repeated_tail(F.col("doc_id"), F.col("text")).alias("t")).collect():
        g, w = zlib.crc32(str(r["doc_id"]).encode()) // 10, text.encode().split()
        a = g % len(w) if w else 0
        p = 1 + (len(w) - a) // (3 + g % 8)
        assert r["t"].encode().split() == [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
