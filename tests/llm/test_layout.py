import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures_llm import SMALL, dicts, none, odd, small_texts
from pyspark.sql import functions as F

from tillroll.llm import mixing, packing, sharding
from tillroll.llm import _common as common
from tillroll.llm.queries import QUERIES


# --- sharding ---------------------------------------------------------------

def check_shards(rows, n_shards):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[s]) for s in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(n_shards))
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_shard_query(spark):
    texts = small_texts()
    rows = dicts(QUERIES["op3_sharding"](spark, SMALL))
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    check_shards(rows, 40)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)


@pytest.mark.parametrize("bucket_rows", [7, 20_000])
def test_every_shard_matches_the_mixture(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(common, "ROWS_PER_BUCKET", bucket_rows)
    rows = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(900)]
    out = dicts(sharding.stratified_shards(spark.createDataFrame(rows, "doc_id long, source string"), 10))
    check_shards(out, 10)
    share = Counter(s for _, s in rows)
    for shard in range(10):
        mine = Counter(r["source"] for r in out if r["shard"] == shard)
        assert all(abs(mine[s] - n / 10) <= 4 for s, n in share.items())


def test_sources_of_one_row_spread_over_the_shards(spark):
    rows = [(i, f"s{i}") for i in range(400)] + [(i, "big") for i in range(400, 800)]
    out = dicts(sharding.stratified_shards(spark.createDataFrame(rows, "doc_id long, source string"), 8))
    check_shards(out, 8)
    assert all(30 <= n <= 70 for n in Counter(r["shard"] for r in out if r["source"] == "big").values())


def test_shards_odd_rows(spark):
    out = sharding.stratified_shards(odd(spark), 4)
    assert out.columns.count("shard") == 1 and out.count() == 15
    check_shards(dicts(out), 4)
    assert dicts(sharding.stratified_shards(none(spark), 4)) == []


# --- packing ----------------------------------------------------------------

def padding(hist, edges):
    return sum(n * (min(e for e in edges if e >= x) - x) for x, n in hist.items())


def test_boundaries_are_optimal():
    r = random.Random(4)
    for _ in range(60):
        hist = {r.randrange(0, 60): r.randrange(1, 30) for _ in range(r.randrange(1, 9))}
        top, k = max(hist), r.randrange(1, 5)
        best = min(padding(hist, [*c, top]) for j in range(min(k, len(hist))) for c in itertools.combinations(sorted(hist), j))
        edges = packing.optimal_boundaries(hist, k)
        assert len(edges) <= k and padding(hist, edges) == best
    assert packing.optimal_boundaries({}, 3) == []


def check_packed(rows, budget):
    batches = defaultdict(list)
    for r in rows:
        assert r["n_tokens"] <= r["bucket_len"]
        batches[r["batch"]].append(r)
    assert sorted(batches) == list(range(len(batches)))
    for b in batches.values():
        assert sorted(r["place"] for r in b) == list(range(len(b))) and len({r["bucket"] for r in b}) == 1
        assert len(b) == 1 or len(b) * b[0]["bucket_len"] <= budget
    for bucket in {r["bucket"] for r in rows}:       # only the last batch of a bucket has room
        mine = [b for b in batches.values() if b[0]["bucket"] == bucket]
        per = max(1, budget // max(1, mine[0][0]["bucket_len"]))
        assert sum(len(b) < per for b in mine) <= 1


def test_pack_query(spark):
    texts = small_texts()
    rows = dicts(QUERIES["op4_packing"](spark, SMALL))
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len((t or "").encode().split()) for i, t in texts.items()}
    check_packed(rows, packing.TOKEN_BUDGET)
    hist = Counter(r["n_tokens"] for r in rows)
    assert sum(r["bucket_len"] - r["n_tokens"] for r in rows if r["n_tokens"] <= 4096) <= padding(hist, packing.optimal_boundaries(hist, 16))


def test_pack_odd_rows_and_long_documents(spark):
    out = packing.pack(odd(spark), packing.word_count("text"), n_buckets=3, token_budget=500)
    rows = dicts(out)
    assert len(rows) == 15 and out.columns.count("n_tokens") == 1
    check_packed(rows, 500)
    assert sum(r["n_tokens"] for r in rows if r["doc_id"] in (6, 7)) == 18_001
    assert dicts(packing.pack(none(spark), packing.word_count("text"))) == []


def test_boundaries_over_long_documents_are_optimal(spark):
    lengths = [9001] * 3 + [9002] * 2 + [20_001, 20_003, 20_005, 20_005, 70_001]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, words long")
    rows = dicts(packing.pack(df, F.col("words"), n_buckets=4))
    check_packed(rows, packing.TOKEN_BUDGET)
    best = min(padding(Counter(lengths), [*edges, 70_001]) for edges in itertools.combinations(sorted(set(lengths))[:-1], 3))
    assert sum(r["bucket_len"] - r["n_tokens"] for r in rows) == best
    assert max(r["bucket_len"] for r in rows) == 70_001


def test_length_bins(spark):
    got = spark.range(1, 70_000, 7).select("id", packing.binned(F.col("id")).alias("b")).collect()
    assert all(r["id"] <= r["b"] <= r["id"] * (1 + 1 / 2048) + 1e-9 for r in got)
    assert all(r["id"] == r["b"] for r in got if r["id"] <= 4096)


# --- mixing -----------------------------------------------------------------

def numpy_rake(n, goals, rounds=2000):
    w = n.astype(float).copy()
    for _ in range(rounds):
        for axis, goal in enumerate(goals):
            other = tuple(a for a in range(w.ndim) if a != axis)
            s = w.sum(axis=other)
            shape = [-1 if a == axis else 1 for a in range(w.ndim)]
            w = w * np.divide(goal * n.sum(), s, out=np.zeros_like(s), where=s > 0).reshape(shape)
    return w


def test_rake_matches_numpy(spark):
    r = np.random.default_rng(8)
    n = r.integers(1, 500, (5, 3, 2))
    n[0, 1, 0] = n[3, 2, 1] = 0
    goals = [g / g.sum() for g in (r.random(5) + 0.2, r.random(3) + 0.2, r.random(2) + 0.2)]
    dims = ["source", "lang", "topic"]
    cells = spark.createDataFrame([(f"s{a}", f"l{b}", f"t{c}", int(n[a, b, c])) for a, b, c in np.ndindex(*n.shape)],
                                  "source string, lang string, topic string, tokens long")
    targets = {d: spark.createDataFrame([(f"{d[0]}{i}", float(x)) for i, x in enumerate(g)], f"{d} string, share double")
               for d, g in zip(dims, goals)}
    want = numpy_rake(n, goals)
    got = mixing.rake(cells, targets, tolerance=1e-9).collect()
    assert len(got) == (n > 0).sum()
    for x in got:
        a, b, c = (int(x[d][1:]) for d in dims)
        assert abs(x["raked"] - want[a, b, c]) < 1e-5 * n.sum()


def bounded_rake(n, goals, rounds=40):
    """Probabilities min(1, product of one factor per value) whose tokens meet the
    goals, each factor found by bisection."""
    f = [np.ones(k) for k in n.shape]
    p = lambda: f[0][:, None, None] * f[1][None, :, None] * f[2][None, None, :]
    for _ in range(rounds):
        for axis in (1, 2, 0):
            for i in range(n.shape[axis]):
                at = tuple(i if a == axis else slice(None) for a in range(3))
                low, high = 1e-12, 1e12
                for _ in range(70):
                    mid = np.sqrt(low * high)
                    low, high = (mid, high) if (n[at] * np.minimum(1, p()[at] * mid)).sum() < goals[axis][i] else (low, mid)
                f[axis][i] *= high
    return np.minimum(1, p())


def marginals(x):
    return [x.sum(axis=tuple(a for a in range(3) if a != axis)) for axis in range(3)]


def test_full_cells_leave_the_targets(spark):
    """A hot source, scarce cells that give all they have: expected and drawn
    marginals meet the targets."""
    r = np.random.default_rng(4)
    n = r.integers(200, 900, (6, 3, 2)).astype(float)
    n[0] *= 8                                         # more than half of all tokens
    n[2, 1, :] = 30                                   # scarce
    n = n // 10 * 10
    a, b, c = [0.3, 0.5, 1.9, 0.6, 0.4, 0.9], [0.6, 1.0, 0.8], [0.7, 1.2]
    true = np.minimum(1, np.multiply.outer(np.multiply.outer(a, b), c))
    fraction = float((n * true).sum() / n.sum())
    goals = [g / g.sum() for g in marginals(n * true)]
    dims = ["source", "lang", "topic"]
    docs = [(i * 1000 + j, f"s{a}", f"l{b}", f"t{c}", 10) for i, (a, b, c) in enumerate(np.ndindex(*n.shape)) for j in range(int(n[a, b, c] // 10))]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, topic string, n_tokens long")
    targets = {d: spark.createDataFrame([(f"{d[0]}{i}", float(x)) for i, x in enumerate(g)], f"{d} string, share double")
               for d, g in zip(dims, goals)}
    out = dicts(mixing.mix(df, targets, fraction))
    expected, drawn, held = np.zeros(n.shape), np.zeros(n.shape), np.zeros(n.shape)
    for x in out:
        at = tuple(int(x[d][1:]) for d in dims)
        held[at] += 10
        expected[at] += 10 * x["probability"]
        drawn[at] += 10 * x["sampled"]
    assert (expected >= held * (1 - 1e-9)).any()                     # some cell gives all it has
    for got, have, goal in zip(marginals(expected), marginals(drawn), goals):
        assert (abs(got / (goal * fraction * held.sum()) - 1) < 2e-3).all()
        assert (abs(have - got) < 5 * np.sqrt(10 * got)).all()
    assert abs(expected / held - true).max() < 5e-3


def test_shares_beyond_what_a_value_has(spark):
    assert mixing.filled({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10.0, "b": 100.0, "c": 100.0}, 100.0) == {"a": 10.0, "b": 54.0, "c": 36.0}
    values = spark.createDataFrame([("a", 0.5, 10.0), ("b", 0.3, 100.0), ("c", 0.2, 100.0)], "v string, share double, held double")
    assert [round(r["goal"], 9) for r in mixing.filled_table(values, 100.0).orderBy("v").collect()] == [10.0, 54.0, 36.0]
    assert [r["goal"] for r in mixing.filled_table(values, 1000.0).orderBy("v").collect()] == [10.0, 100.0, 100.0]


def test_mix_probabilities_and_sample(spark):
    rows = dicts(QUERIES["op8_mixing"](spark, SMALL))
    texts = small_texts()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len((t or "").encode().split()) for i, t in texts.items()}
    total = sum(r["n_tokens"] for r in rows)
    assert abs(sum(r["n_tokens"] * r["probability"] for r in rows) / total - mixing.FRACTION) < 1e-3
    dims = ["source", "lang", "topic"]
    values = [sorted({r[d] for r in rows}) for d in dims]
    n = np.zeros([len(v) for v in values])
    for r in rows:
        n[tuple(v.index(r[d]) for v, d in zip(values, dims))] += r["n_tokens"]
    even = marginals(np.sqrt(n) / np.sqrt(n).sum())
    aims = [mixing.filled(dict(enumerate(e)), dict(enumerate(h)), total / 2) for e, h in zip(even, marginals(n))]
    want = bounded_rake(n, [[a[i] for i in range(len(a))] for a in aims])
    for r in rows:
        p = want[tuple(v.index(r[d]) for v, d in zip(values, dims))] if r["n_tokens"] else 0.0
        assert abs(r["probability"] - p) < 0.03
    expected = sum(r["probability"] for r in rows)
    assert abs(sum(r["sampled"] for r in rows) - expected) < 4 * np.sqrt(expected)
    assert all(r["sampled"] for r in rows if r["probability"] == 1.0)


def test_topics_do_not_depend_on_order(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    one = {r["doc_id"]: r["topic"] for r in mixing.attributes(docs.coalesce(1)).collect()}
    many = {r["doc_id"]: r["topic"] for r in mixing.attributes(docs.repartition(13, "text")).collect()}
    assert one == many and len(set(one.values())) > 1


def test_mix_odd_rows(spark):
    attributed = mixing.attributes(odd(spark).withColumnRenamed("shard", "probability"), topics=2)
    out = mixing.mix(attributed)
    rows = dicts(out)
    assert len(rows) == 15 and out.columns.count("probability") == 1 and out.columns.count("n_tokens") == 1
    assert all(r["probability"] == 0 and not r["sampled"] for r in rows if not (r["text"] or "").strip())
    assert len({(r["probability"], r["sampled"]) for r in rows if r["doc_id"] == 10}) == 1
    assert dicts(mixing.mix(mixing.attributes(none(spark)))) == []
