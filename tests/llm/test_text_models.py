import zlib
from collections import defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash
from fixtures_llm import SMALL, dicts, none, odd, prose, small_texts

from tillroll.llm import components, quality, simhash, substring
from tillroll.llm.queries import QUERIES


# --- quality ----------------------------------------------------------------

def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in dicts(QUERIES["op6_quality"](spark, sf))}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())
    held = [(rows[i]["predicted"], y) for i, y in labels if rows[i]["held_out"]]
    assert len(held) > 80 and np.mean([p == y for p, y in held]) >= 0.97


def test_quality_margin_matches_a_plain_model(spark):
    texts = [prose(i, 20) for i in range(30)] + ["!!! " + prose(i, 5) + " $$$" for i in range(30)]
    y = [1] * 30 + [0] * 30
    rows = [sorted(set(simple_grams(t))) for t in texts]
    grams = quality.Grams()
    assert [grams.of(t).tolist() for t in texts] == rows
    w, b = quality.fit([np.array(r) for r in rows], np.array(y))
    ratio = quality.log_count_ratios([np.array(r) for r in rows], np.array(y))
    dual = [sum(ratio[f] * w[f] for f in r) / np.sqrt(sum(ratio[f] ** 2 for f in r)) + b for r in rows]
    assert np.allclose(dual, list(quality.margins([np.array(r) for r in rows], ratio, w, b)))
    assert all((m > 0) == bool(c) for m, c in zip(dual, y))


def simple_grams(text):
    a = text.encode()
    for i, x in enumerate(a):
        yield x
        if i + 1 < len(a):
            yield 256 + x * 256 + a[i + 1]
        if i + 2 < len(a):
            n = (x << 16) | (a[i + 1] << 8) | a[i + 2]
            yield 256 + 65_536 + ((n * 2654435761) % (1 << 32) >> (32 - quality.TRIGRAM_BITS))
    words, run, longest = text.split(), 0, 0
    for x, z in zip(words, words[1:]):
        run = run + 1 if x == z else 0
        longest = max(longest, run)
    for i in range(min(longest, quality.REPEATS)):
        yield quality.N_FEATURES - quality.REPEATS + i


def test_quality_odd_rows_and_missing_labels(spark):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 0), (4, 1), (6, None), (None, 1), (12, 1), (12, 1)], "doc_id long, quality int")
    rows = dicts(quality.score_quality(odd(spark), labels))
    assert len(rows) == 15 and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["predicted"] for r in dicts(quality.score_quality(odd(spark), labels.where("quality = 0 AND doc_id = 3")))} == {0}
    assert {r["predicted"] for r in dicts(quality.score_quality(odd(spark), labels.limit(0)))} == {1}
    assert dicts(quality.score_quality(none(spark), labels)) == []


# --- simhash ----------------------------------------------------------------

def test_golay_words_within_two_errors_share_a_codeword():
    words = np.random.default_rng(7).integers(0, 1 << 23, 2000)
    one, real = simhash.codeword_indices(words)
    assert set(real.sum(axis=1)) == {1, 6}
    for e in [0, *(1 << i for i in range(23)), *((1 << i) | (1 << j) for i, j in combinations(range(23), 2))]:
        two, also = simhash.codeword_indices(words ^ e)
        assert ((one[:, :, None] == two[:, None, :]) & real[:, :, None] & also[:, None, :]).any(axis=(1, 2)).all()


def test_keys_meet_within_four_bits():
    r = np.random.default_rng(9)
    prints = r.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)
    flips = np.array([sum(1 << int(b) for b in r.choice(64, r.integers(1, 5), replace=False)) for _ in prints], dtype=np.uint64)
    keys = []
    for p in (prints, prints ^ flips):
        row, key = simhash.golay_keys(p)
        own = defaultdict(set)
        for i, k in zip(row.tolist(), key.tolist()):
            own[i].add(k)
        keys.append(own)
    assert all(keys[0][i] & keys[1][i] for i in range(len(prints)))


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: {id: fingerprint} -> {id: smallest id reachable}, by all pairs."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i in prints}


def test_simhash_query(spark):
    texts = small_texts()
    prints = {i: plain_print(t) for i, t in texts.items()}
    rows = dicts(QUERIES["op7_simhash"](spark, SMALL))
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == plain_components(prints)


def test_dense_and_chained_fingerprints(spark):
    """Groups whose members are far from the group's smallest: chains of links,
    and clusters that touch through few members."""
    r = np.random.default_rng(11)
    prints, p = {}, int(r.integers(0, 1 << 62))
    for i in range(40):                       # a chain: neighbours 4 bits apart
        prints[i] = p
        p ^= sum(1 << int(b) for b in r.choice(64, 4, replace=False))
    for i in range(40, 240):                  # a dense cloud around one centre
        prints[i] = 0x123456789ABCDEF0 ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 4), replace=False))
    for i in range(240, 260):
        prints[i] = int(r.integers(0, 1 << 63))
    rows = [(i, p - (1 << 64) if p >= 1 << 63 else p) for i, p in prints.items()]
    out = simhash.near_prints(spark.createDataFrame(rows, "doc_id long, print long"))
    assert {x["doc_id"]: x["component_id"] for x in dicts(out)} == plain_components(prints)


def test_simhash_odd_rows_and_kept_documents(spark):
    found = dicts(simhash.near_copies(odd(spark)))
    assert len(found) == 15
    assert {r["component_id"] for r in found if r["fingerprint"] == "0" * 16} == {3}
    kept = dicts(simhash.drop_near_copies(odd(spark)))
    ids = [r["doc_id"] for r in kept]
    assert len(ids) == len(set(ids)) and 1 in ids and 2 not in ids and 3 in ids and 4 not in ids and ids.count(10) == 1
    assert dicts(simhash.near_copies(none(spark))) == [] and dicts(simhash.drop_near_copies(none(spark))) == []


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(7, 7), (5, 3), (3, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in dicts(components.components(edges))}
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 5: 3}


# --- substring dedup --------------------------------------------------------

def test_every_shared_run_of_fifty_words_is_found(spark):
    words = {i: (t or "").encode().lower().split() for i, t in small_texts().items()}
    seen = defaultdict(set)
    for i, w in words.items():
        for j in range(len(w) - 49):
            seen[tuple(w[j:j + 50])].add(i)
    need = set().union(*(s for s in seen.values() if len(s) > 1))
    rows = dicts(QUERIES["op10_substring_dedup"](spark, SMALL))
    assert need <= {r["doc_id"] for r in rows} | {r["other_doc_id"] for r in rows}
    for r in rows:
        p, q = words[r["doc_id"]][r["start_word"]:r["end_word"]], words[r["other_doc_id"]][r["other_start"]:r["other_end"]]
        assert r["other_doc_id"] < r["doc_id"] and min(len(p), len(q)) >= 50
        assert plain_lcs(p, q) / max(len(p), len(q)) >= 0.8


def plain_lcs(p, q):
    row = [0] * (len(q) + 1)
    for x in p:
        old = 0
        for j, y in enumerate(q):
            old, row[j + 1] = row[j + 1], old + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_fuzzy_passages(spark):
    passage = prose(50, 120).split()
    edited = passage[:30] + ["new", "words"] + passage[30:70] + passage[73:100] + ["x"] + passage[101:]
    docs = [(1, prose(51, 200) + " " + " ".join(passage) + " " + prose(52, 90)),
            (2, prose(53, 40) + "\n" + " ".join(edited).upper() + " " + prose(54, 300)),
            (3, prose(55, 400)), (4, " ".join(passage[:45]) + " " + prose(56, 100))]
    rows = dicts(substring.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")))
    (r,) = rows
    assert (r["doc_id"], r["other_doc_id"]) == (2, 1) and r["identity"] >= 0.9
    assert abs(r["start_word"] - 40) <= 3 and abs(r["other_start"] - 200) <= 3 and abs(r["other_end"] - 320) <= 3
    df = spark.createDataFrame(docs, "doc_id long, text string")
    cut = {x["doc_id"]: x["text"] for x in dicts(substring.without_passages(df, substring.repeated_passages(df)))}
    assert cut[1] == docs[0][1] and cut[3] == docs[2][1] and len(cut[2].split()) <= 343


def brute_chain(x, y, n):
    best = 0.0
    for size in range(1, len(x) + 1):
        for path in combinations(sorted(range(len(x)), key=lambda j: (y[j], x[j])), size):
            if all(x[i] + n[i] <= x[j] and y[i] + n[i] <= y[j] for i, j in zip(path, path[1:])):
                best = max(best, sum(n[j] for j in path) - sum(substring.GAP_COST * (x[j] - x[i] - n[i] + y[j] - y[i] - n[i])
                                                              for i, j in zip(path, path[1:])))
    return best


@pytest.mark.parametrize("seed", range(25))
def test_chain_is_optimal(seed):
    r = np.random.default_rng(seed)
    m = int(r.integers(1, 9))
    x, y, n = r.integers(0, 60, m).tolist(), r.integers(0, 60, m).tolist(), r.integers(5, 20, m).tolist()
    value = lambda p: sum(n[j] for j in p) - sum(substring.GAP_COST * (x[j] - x[i] - n[i] + y[j] - y[i] - n[i])
                                                 for i, j in zip(p, p[1:]))
    paths = substring.chain(x, y, n)
    assert sorted(j for p in paths for j in p) == list(range(m))
    assert abs(value(paths[0]) - brute_chain(x, y, n)) < 1e-9


def test_stock_sentences_do_not_hide_a_passage(spark):
    # every seed of the passage stands in a piece, and every piece in an earlier and a later document
    passage = prose(600, 60).split()
    stock = [" ".join(passage[i:i + 24]) for i in range(0, 37, 12)]
    docs = [(100, f"{prose(700, 40)} {' '.join(passage)} {prose(701, 40)}"), (200, f"{prose(702, 30)} {' '.join(passage)} {prose(703, 30)}")]
    docs += [(low + i, f"{prose(710 + low + i, 30)} {t} {prose(1310 + low + i, 30)}") for low in (1, 301) for i, t in enumerate(stock)]
    rows = dicts(substring.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")))
    assert any(r["doc_id"] == 200 and r["other_doc_id"] == 100 and r["start_word"] <= 30 and r["end_word"] >= 90 for r in rows)


def hidden(passage, edited, strangers):
    """Documents 1000 and 2000 share an edited passage; every 20 words of it stand in
    so many earlier and later documents too, and in none of them fifty words."""
    docs = [(1000, f"{prose(3000, 40)} {' '.join(passage)} {prose(3001, 40)}"), (2000, f"{prose(3002, 30)} {' '.join(edited)} {prose(3003, 30)}")]
    pieces = [t[i:i + 24] for n in range(strangers) for t in (passage, edited) for i in range(n % 4, len(t) - 20, 13)]
    return docs + [(low + n, f"{prose(10000 + low + n, 30)} {' '.join(t)} {prose(20000 + low + n, 30)}")
                   for low in (1, 2001) for n, t in enumerate(pieces)]


@pytest.mark.parametrize("strangers", [1, 30])
def test_edited_passages_are_not_hidden_by_first_and_last_documents(spark, strangers):
    passage = prose(2900, 100).split()
    edited = passage[:45] + ["another"] + passage[46:72] + ["new"] + passage[72:]
    rows = dicts(substring.repeated_passages(spark.createDataFrame(hidden(passage, edited, strangers), "doc_id long, text string")))
    assert any(r["doc_id"] == 2000 and r["other_doc_id"] == 1000 and r["start_word"] <= 35 and r["end_word"] >= 125 for r in rows)


def test_every_pair_of_few_and_the_class_of_many_edited_passages(spark):
    passage = prose(2901, 120).split()
    texts = []
    for i in range(45):
        p = list(passage)
        p[7 + 2 * i] = f"edit{i}"
        texts.append(f"{prose(5000 + i, 20)} {' '.join(p)} {prose(6000 + i, 20)}")
    found = lambda n: {(r["doc_id"], r["other_doc_id"]) for r in dicts(substring.repeated_passages(
        spark.createDataFrame(list(enumerate(texts[:n])), "doc_id long, text string")))}
    assert found(8) == {(b, a) for b in range(8) for a in range(b)}
    assert {(b, 0) for b in range(1, 45)} <= found(45)


def test_a_stock_phrase_makes_no_pairs_and_hides_none(spark, monkeypatch):
    # 200 documents have a phrase of 20 words; 40 and 150 share an edited passage around it, and the last
    # hundred one of another: more than are linked pair by pair
    phrase, passage, other = prose(2903, 20), prose(2904, 40).split(), prose(2905, 40)
    edited = [*passage[:9], "another", *passage[10:24], *passage[25:]]
    around = {40: (passage[:15], passage[15:]), 150: (edited[:15], edited[15:])} | {
        i: (other.split()[:15], other.split()[15:]) for i in range(100, 200) if i != 150}
    texts = []
    for i in range(200):
        before, after = around.get(i, ([], []))
        texts.append((i, " ".join([prose(30000 + i, 60), *before, phrase, *after, prose(40000 + i, 60)])))
    chains = []
    monkeypatch.setattr(substring, "chained", lambda links, of=substring.chained: chains.append(links.count()) or of(links))
    rows = dicts(substring.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")))
    pairs = {(r["doc_id"], r["other_doc_id"]) for r in rows}
    assert (150, 40) in pairs and {(i, 100) for i in range(101, 200) if i != 150} <= pairs
    assert pairs <= {(150, 40)} | {(b, a) for b in range(100, 200) for a in range(100, b) if 150 not in (a, b)}
    assert sum(chains) < 100 * 200           # 200 * 199 links for each pair of seeds before


@pytest.mark.parametrize("period", [1, 2, 7, 15])
def test_periodic_passages(spark, period):
    words = (prose(2902, 40).split()[:period] * 80)
    docs = [(i, f"{prose(7000 + i, 20 + i)} {' '.join(words[i % 5:n])} {prose(8000 + i, 20)}")
            for i, n in enumerate((55, 80, 60, 80))]
    rows = dicts(substring.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")))
    assert {(r["doc_id"], r["other_doc_id"]) for r in rows} == {(b, a) for b in range(4) for a in range(b)}


def test_substring_odd_rows(spark):
    rows = dicts(substring.repeated_passages(odd(spark)))
    assert {(r["doc_id"], r["other_doc_id"]) for r in rows} == {(2, 1), (7, 6), (12, 1), (12, 2)}
    assert max(r["end_word"] - r["start_word"] for r in rows) == 9000
    assert dicts(substring.repeated_passages(none(spark))) == []
    assert substring.without_passages(odd(spark), substring.repeated_passages(odd(spark))).count() == 15
