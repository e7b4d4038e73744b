import hashlib
import random
import re

import pytest
from fixtures_llm import SMALL, dicts, none, odd, small_texts

from tillroll.llm import line_dedup, pii
from tillroll.llm.queries import QUERIES


def edit1(a, b):
    """Whether two strings are within one edit, written by hand."""
    if abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    s = 0
    while s < min(len(a), len(b)) - p and a[-1 - s] == b[-1 - s]:
        s += 1
    return p + s >= max(len(a), len(b)) - 1


def brute_dedup(docs):
    """docs: (id, text) -> {row number: text}, by comparing all lines."""
    low = lambda i: (0, 0) if i is None else (1, i)
    lines = [(low(i), no, line) for i, t in docs if t is not None for no, line in enumerate(t.split("\n")) if line.strip(" ")]
    out = []
    for i, t in docs:
        if t is None:
            out.append(None)
            continue
        keep = [line for no, line in enumerate(t.split("\n")) if not line.strip(" ") or not any(
            (j, n) < (low(i), no) and edit1(line, other) for j, n, other in lines)]
        out.append("\n".join(keep))
    return out


def test_lines_match_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away"
    docs = [(1, f"{base}\nab\n\n{'x' * 300}"), (2, f"{base[:-1]}\nac\nshort line here"),
            (3, f"{base.replace('quick', 'quack')}\n{'x' * 301}\nShort line here"), (4, f"q{base}\nfifteen chars..\n{'x' * 303}"),
            (5, "fifteen chars...\nb\nabc\n " + base), (6, f"{'y' * 150}é{'z' * 150}\n{'y' * 150}è{'z' * 150}\n{'y' * 151}{'z' * 150}"),
            (7, base + "\n" + base + "!"), (None, "ab\nzz"), (8, None), (9, ""), (10, "a\n" * 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["text"]) for r in dicts(line_dedup.dedup_lines(df))}
    assert got == set(zip((i for i, _ in docs), brute_dedup(docs)))


def test_insertions_at_every_length_match_brute_force(spark):
    rnd = random.Random(93)
    short = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=n)) for n in range(1, 501)]
    insert = lambda t, i: t[:i] + "#" + t[i:]
    docs = [(1, "\n".join(short)), (2, "\n".join(insert(t, len(t) // 8) for t in short))]
    other = ["".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=n)) for n in range(1, 501)]
    docs += [(3, "\n".join(insert(t, len(t) * 7 // 8) for t in other)), (4, "\n".join(other))]
    got = {r["doc_id"]: r["text"] for r in dicts(line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")))}
    for (i, _), want in zip(docs, brute_dedup(docs)):
        assert sorted(map(len, got[i].split("\n"))) == sorted(map(len, want.split("\n")))
        assert got[i] == want


def test_lines_odd_rows(spark):
    out = line_dedup.dedup_lines(odd(spark).withColumnRenamed("shard", "n_lines"))
    rows = dicts(out)
    assert len(rows) == 15 and sorted(out.columns)[:1] == ["doc_id"] and out.columns.count("n_lines") == 1
    assert sorted(r["text"] for r in rows if r["doc_id"] == 10) == ["other", "other"]      # equal positions tie
    assert next(r for r in rows if r["doc_id"] == 9)["text"] == "line one here\nsame line again"
    assert next(r for r in rows if r["doc_id"] == 11)["n_removed"] == 1
    assert dicts(line_dedup.dedup_lines(none(spark))) == []


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else 0,
            "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def base_spans(text):
    found = [(m.start(), n, kind, m.end()) for n, (kind, p) in enumerate(BASE.items())
             for m in re.finditer(p, text or "") if valid(kind, m.group())]
    return ",".join(f"{k}:{a}:{e}" for a, _, k, e in sorted(found))


TRICKY = ["a@b.c_d@e.f x@y", "x@-.- .@a.b", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112",
          "+1 (555) 123-4567 and +12", "+49 4111 1111 1111 11", "ü☃\U0001f600 mail a.b@c.de 10.0.0.1", "4242424242424242 4242424242424242",
          "card 378282246310005, 6011000990139424", "a" * 3000 + "@", "1" * 3000, "1." * 2000, "a@" + "b." * 3000 + "c", "+1" * 500, "", None,
          "0.0.0.0000000000000000000000000000255", "+1....... 5551234567 5"]


def test_pii_base_spans_match_the_patterns(spark):
    texts = TRICKY + list(small_texts().values())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in dicts(pii.find_pii(df)):
        want = base_spans(r["text"])
        got = ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["pii"] if s["kind"] != "iban")
        assert got == want, r["text"][:80]


def test_pii_iban_and_context(spark):
    good, bad = "GB82 WEST 1234 5698 7654 32", "GB83 WEST 1234 5698 7654 32"
    df = spark.createDataFrame([(1, f"my IBAN is {good}."), (2, bad), (3, good), (4, "DE89370400440532013000")], "doc_id long, text string")
    out = {r["doc_id"]: r["pii"] for r in dicts(pii.find_pii(df))}
    assert [(s["start"], s["end"]) for s in out[1] if s["kind"] == "iban"] == [(11, 11 + len(good))]
    assert not [s for s in out[2] if s["kind"] == "iban"]
    score = lambda i: next(s["score"] for s in out[i] if s["kind"] == "iban")
    assert score(1) > score(3) and score(4) >= pii.MIN_SCORE


def test_pii_query_digest_and_odd_rows(spark):
    texts = small_texts()
    for r in dicts(QUERIES["op9_pii"](spark, SMALL)):
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert r["n_card"] == want.count("card:") and set(filter(None, want.split(","))) <= set(r["spans"].split(","))
    assert pii.find_pii(odd(spark).withColumnRenamed("shard", "pii")).count() == 15
    assert dicts(pii.find_pii(none(spark))) == []


@pytest.mark.parametrize("name", ["op1_line_dedup", "op9_pii"])
def test_native_plans_hold_no_python(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
