import duckdb
import numpy as np
import pytest
from fixtures_llm import SMALL, dicts

from tillroll.llm import ann, topk
from tillroll.llm.queries import ORACLES, QUERIES


def frame(spark, vectors, start=0):
    return spark.createDataFrame([(start + i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, v array<double>")


def brute(v, ids, queries, k):
    out = {}
    for q in queries:
        s = v @ v[ids.index(q)]
        out[q] = sorted(((-s[i], ids[i]) for i in range(len(ids)) if ids[i] != q))[:k]
    return out


def test_topk_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    want = con.execute(ORACLES["op5_topk"]).fetchall()
    got = QUERIES["op5_topk"](spark, SMALL).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_topk_tiles_ties_and_merge(spark, monkeypatch):
    for name, value in (("BLOCK_QUERIES", 7), ("BLOCK_ROWS", 20), ("FAN_IN", 2)):
        monkeypatch.setattr(topk, name, value)
    v = np.random.default_rng(0).integers(-2, 3, (150, 4)).astype(float)      # many ties
    rows = frame(spark, v)
    got = {}
    for r in topk.exact_top_k(rows.where("id % 5 = 0"), rows, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert got == brute(v, list(range(150)), range(0, 150, 5), 4)


def test_topk_large_integers_and_few_rows(spark):
    rows = spark.createDataFrame([(0, [float(1 << 40), 1.0]), (1, [float(1 << 20), 3.0]), (2, [0.0, 5.0])], "id long, v array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.exact_top_k(rows.where("id = 0"), rows, 5).collect()]
    assert sorted(got) == [(0, 1, 1, (1 << 60) + 3), (0, 2, 2, 5)]


ODD = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
       (7, [0.5, 0.5]), (8, []), (None, [1.0, 1.0]), (20, [1.0, 0.25]), (9, [1.0, 2.0, 3.0])]


def test_unusable_vectors_take_no_part(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<double>")
    assert sorted(r["id"] for r in topk.one_per_id(df, "vec_id", "embedding").collect()) == [1, 3, 7, 20]
    empty = topk.one_per_id(df.limit(0), "vec_id", "embedding")
    assert dicts(topk.exact_top_k(empty, empty)) == [] and dicts(ann.nearest_neighbours(empty, empty)) == []


def test_ann_is_exact_on_few_rows(spark):
    got = {}
    for r in QUERIES["op2_ann"](spark, SMALL).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SMALL}/embeddings.parquet'").fetchall()
    ids, v = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=float)
    assert got == {q: [i for _, i in top] for q, top in brute(v, ids, [i for i in ids if i % 20 == 0], 20).items()}


@pytest.mark.parametrize("repeated", [0, 1500])
def test_ann_recall_and_hot_cells(spark, monkeypatch, repeated):
    """Unit vectors without clusters, and a third of all rows alike; small blocks
    so that cells are split and queries shared out."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 300)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 40)
    v = np.random.default_rng(1).normal(size=(4500, 32))
    v[4500 - repeated:] = v[17]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = frame(spark, v)
    got = {}
    for r in ann.nearest_neighbours(rows, rows.where("id % 50 = 17"), 20).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert abs(r["score"] - v[r["query_id"]] @ v[r["vec_id"]]) < 1e-12
    want = brute(v, list(range(4500)), sorted(got), 20)
    assert len(got) == 90 and all(len(x) == 20 for x in got.values())
    if repeated:
        s = np.mean([len([1 for i in got[q] if v[q] @ v[i] >= -want[q][-1][0] - 1e-12]) for q in got]) / 20
    else:
        s = np.mean([len(got[q] & {i for _, i in want[q]}) for q in got]) / 20
    assert s >= 0.9


def test_cells_are_visited_in_order():
    r = np.random.default_rng(3)
    a, b, q = r.normal(size=(5, 2)), r.normal(size=(6, 2)), r.normal(size=4)
    sizes = r.integers(0, 3, 30)
    cells = ann.visit(q, a, b, sizes, 10 ** 9)
    far = (-(a @ q[:2])[:, None] - (b @ q[2:])[None, :]).ravel()
    assert sorted(cells) == np.flatnonzero(sizes).tolist() and (np.diff(far[cells]) >= 0).all()


MEDIUM = "/root/testdata/sf0.1"


def test_ann_recall_of_the_index_on_given_rows(spark):
    """The indexed path alone, without the least number of candidates."""
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{MEDIUM}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, v = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=float)
    df = topk.one_per_id(spark.read.parquet(f"{MEDIUM}/embeddings.parquet"), "vec_id", "embedding")
    got = {}
    for r in ann.nearest_neighbours(df, df.where("id % 20 = 0"), 20, min_candidates=0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute(v, ids, sorted(got), 20)
    assert len(got) == 100 and np.mean([len(got[q] & {i for _, i in want[q]}) / 20 for q in got]) >= 0.9


def test_ann_ties_go_to_the_smaller_id(spark, monkeypatch):
    """A third of the rows are one vector, dealt over blocks of odd sizes: equal
    scores are equal in every block, and their ids come in order."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 301)
    v = np.random.default_rng(9).normal(size=(3003, 64))
    v[::3] = v[0]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = frame(spark, v, 100)
    out = ann.nearest_neighbours(df, df.where("id % 60 = 40"), 20, fraction=1.0).orderBy("query_id", "rank").collect()
    lists = {}
    for r in out:
        lists.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    hot = set(range(100, 3103, 3))
    for q, got in lists.items():
        exact = (v * v[q - 100]).sum(axis=1)
        want = sorted((-s, i + 100) for i, s in enumerate(exact) if i + 100 != q)[:20]
        assert [i for _, i in got] == [i for _, i in want]
    assert any({i for _, i in got} <= hot for got in lists.values())


def test_rerank_orders_ties_in_blocks_of_any_size():
    import pandas as pd
    r = np.random.default_rng(3)
    for n in (301, 777, 1500):
        v = r.normal(size=(n, 64))
        v[r.random(n) < 0.4] = v[5]
        rows = pd.DataFrame({"id": r.permutation(n), "v": list(v), "cell": 0})
        queries = pd.DataFrame({"id": np.arange(10_000, 10_050), "v": list(np.vstack([v[5:6]] * 50)), "cells": [np.array([0])] * 50})
        out = ann.rerank(20)(queries, rows)
        same = sorted(rows["id"][[bool((x == v[5]).all()) for x in v]])[:20]
        for q, part in out.groupby("query_id"):
            assert part["vec_id"].tolist() == same and part["score"].nunique() == 1
