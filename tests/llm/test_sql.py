"""The registered queries against their DuckDB SQL, whole tables."""

import duckdb
import pytest
from fixtures_llm import SMALL

import corpus_pipeline
from tillroll.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    out = QUERIES[name](spark, SMALL)
    res = con.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(out.columns)
    assert sorted(map(str, ([r[c] for c in names] for r in out.collect()))) == sorted(map(str, map(list, res.fetchall())))


def test_registration():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
    assert list(corpus_pipeline.QUERIES) == ["pipeline"]
