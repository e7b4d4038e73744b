"""Token files: exact round trip against the tokenizers library."""

import glob
import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow.orc as orc
import pytest
from fixtures_llm import SMALL, dicts, none, odd, small_texts
from tokenizers import Tokenizer

from tillroll.llm import token_files as tf
from tillroll.llm.queries import QUERIES

BPE = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
WORDS = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
TRICKY = ["", " ", "a", "a  b", "a\n\nb", " lead", "trail ", "a \n b", "x\n y", "don't 's 'll we've", "a's\nb", "tab\there", "é è\nü ß",
          "nb space   x", "1,234.50 (50%) a1b2", "\r\nline\r\n", "snow ☃ \U0001f600 man", " em  ", "foo.\nBar.\n\nBaz",
          "a\x1cb \x85 c", "many     blanks   here  ", "\n\n\n", "x" * 3000, "漢字 仮名\nкириллица слово", "﻿bom a", "á b́"]


def ids_of(tokenizer_json, text):
    return Tokenizer.from_str(tokenizer_json).encode(text, add_special_tokens=False).ids


def test_query_against_library(spark):
    texts, t, start = small_texts(), Tokenizer.from_str(BPE), 0
    want = []
    for doc in sorted(texts):
        ids = t.encode(texts[doc] or "", add_special_tokens=False).ids + [0]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    got = QUERIES["op11_token_files"](spark, SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("name", ["BPE", "WORDS"])
def test_pieces_give_the_ids_of_whole_texts(name):
    tokenizer = globals()[name]
    assert tf.cuttable(tokenizer) == (name == "BPE")
    r = np.random.default_rng(0)
    marks = list("ab'sZ1 .,\n\t-") + ["  ", "é", " ", "\n\n", "ll", "☃"]
    texts = TRICKY + ["".join(r.choice(marks, r.integers(0, 30))) for _ in range(3000)] + list(small_texts().values())[:20]
    texts += ["a <|endoftext|> b"] if name == "BPE" else []
    coded = [x.encode() for x in texts]
    encode, t = tf.Encoder(tokenizer), Tokenizer.from_str(tokenizer)
    for part in (slice(None, -1), slice(-1, None)):          # the last one holds an added token's string
        ids, ends = encode(b"".join(coded[part]), np.cumsum([len(c) for c in coded[part]]))
        got = [x.tolist() for x in np.split(ids, ends)[:-1]]
        assert got == [e.ids for e in t.encode_batch(texts[part], add_special_tokens=False)]


def test_cuttable_refuses_other_kinds():
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}},
                   {"added_tokens": [{"content": "a b"}]}, {"added_tokens": [{"content": "x", "lstrip": True}]},
                   {"model": {"type": "Unigram"}}):
        assert not tf.cuttable(json.dumps(json.loads(BPE) | change))


def test_awkward_rows(spark, tmp_path, monkeypatch):
    """Null and repeated ids, empty and null texts, clashing columns, several files."""
    monkeypatch.setattr(tf, "BATCH_BYTES", 2000)
    folder = str(tmp_path / "t")
    tf.write_tokens(odd(spark), BPE, folder, end_id=7, rows_per_file=4)
    got = dicts(tf.read_tokens(spark, folder).orderBy("start"))
    docs = odd(spark).select("doc_id", "text").collect()
    assert sorted((r["doc_id"] or -1, *r["ids"]) for r in got) == \
        sorted((d or -1, *ids_of(BPE, x or ""), 7) for d, x in docs)
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]))
        at += r["n_tokens"]
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda d: -1 if d is None else d)
    empty = str(tmp_path / "e")
    tf.write_tokens(none(spark), BPE, empty)
    assert tf.read_tokens(spark, empty).collect() == []


def test_layout(spark, tmp_path):
    """Files of ascending ids, several stripes, indexes and Bloom filters; a search
    reads few rows."""
    folder = str(tmp_path / "t")
    docs = spark.range(4000).selectExpr("id * 2 AS doc_id", "repeat(concat('word', id % 13, ' text '), 40) AS text")
    tf.write_tokens(docs, BPE, folder, rows_per_file=1000)
    files = sorted(glob.glob(folder + "/*.orc"))
    ranges = sorted((t["doc_id"][0].as_py(), t["doc_id"][-1].as_py()) for t in (orc.ORCFile(f).read(columns=["doc_id"]) for f in files))
    assert len(files) == 4 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    first = orc.ORCFile(files[0])
    assert first.row_index_stride == tf.INDEX_ROWS and first.compression == "ZSTD"
    jvm, path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(files[0])
    reader = jvm.org.apache.orc.OrcFile.createReader(path, jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    streams = reader.rows().readStripeFooter(reader.getStripes().get(0)).getStreamsList()
    kinds = {str(s.getKind()) for s in streams}
    assert "ROW_INDEX" in kinds and any(k.startswith("BLOOM_FILTER") for k in kinds)
    encodings = reader.rows().readStripeFooter(reader.getStripes().get(0)).getColumnsList()
    assert "DIRECT_V2" in {str(e.getKind()) for e in encodings}                  # run-length encoding, second version
    found = tf.find_documents(spark, folder, [10, 7998, 11])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id, [10,11,7998])]" in plan
    assert sorted(r["doc_id"] for r in found.collect()) == [10, 7998]
