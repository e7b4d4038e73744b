"""The pipeline stage by stage against brute force on its own input, and over
awkward rows."""

import pytest
from fixtures_llm import SMALL, dicts, none, odd
from test_layout import check_packed
from test_lines_and_pii import brute_dedup
from test_text_models import plain_components, plain_print

import corpus_pipeline as pipeline
from tillroll.llm import mixing, packing
from tillroll.llm._common import written
from tillroll.llm.queries import QUERIES


@pytest.fixture(scope="module")
def stages(spark):
    """[(name, input rows, output frame)] over the small tables."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SMALL), f"test-{name}")
        out.append((name, before, docs))
    return {name: (before, after) for name, before, after in out}


def test_columns(stages):
    for name, (before, after) in stages.items():
        assert name == "packing" or after.columns == before.columns
        assert name != "packing" or set(before.columns) < set(after.columns)


def test_quality_keeps_what_the_classifier_accepts(spark, stages):
    before, after = stages["quality"]
    accepted = {r["doc_id"] for r in dicts(QUERIES["op6_quality"](spark, SMALL)) if r["predicted"] == 1}
    assert {r["doc_id"] for r in dicts(after)} == accepted
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in accepted for i in clean) >= 0.98 * len(clean)


def test_lines_go_everywhere_but_first(stages):
    before, after = stages["line_dedup"]
    docs = sorted((r["doc_id"], r["text"]) for r in dicts(before))
    assert {r["doc_id"]: r["text"] for r in dicts(after)} == dict(zip((i for i, _ in docs), brute_dedup(docs)))
    assert all(r["n_chars"] == len(r["text"]) for r in dicts(after))


def test_one_document_of_each_group_stays(stages):
    before, after = stages["near_dedup"]
    groups = plain_components({r["doc_id"]: plain_print(r["text"]) for r in dicts(before)})
    kept = {r["doc_id"]: r for r in dicts(after)}
    assert set(kept) == set(groups.values())
    assert all(kept[r["doc_id"]] == r for r in dicts(before) if r["doc_id"] in kept)


def test_mixing_samples_by_probability(stages):
    before, after = stages["mixing"]
    drawn = {r["doc_id"] for r in dicts(mixing.mix(mixing.attributes(before))) if r["sampled"]}
    assert {r["doc_id"] for r in dicts(after)} == drawn
    assert 0 < len(drawn) < before.count()


def test_packing_holds_every_document(stages):
    before, after = stages["packing"]
    assert sorted(r["doc_id"] for r in dicts(after)) == sorted(r["doc_id"] for r in dicts(before))
    check_packed(dicts(after), packing.TOKEN_BUDGET)


def test_run_is_the_stages_in_turn(spark, stages):
    rows = lambda df: sorted(map(str, dicts(df)))
    assert rows(pipeline.run(spark, SMALL)) == rows(stages["packing"][1])


@pytest.mark.parametrize("make", [odd, none])
def test_awkward_rows_pass_every_stage(spark, make):
    docs = written(make(spark), "test-odd")
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, SMALL), f"test-odd-{name}")
    assert docs.count() <= 15
