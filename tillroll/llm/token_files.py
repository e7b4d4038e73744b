"""Token ids as binary files: ORC, in document order.

``write_tokens`` encodes whole texts and writes them as ORC files.  Files hold
disjoint, ascending ranges of document ids, rows ascend inside a file, and the
layout serves readers that want a part only:

* ids are an integer list column, so ORC's run-length encoding packs them to
  the bits they need; a document's length and the ids before it in its file
  are columns of their own, so offsets need no ids;
* stripes of ``STRIPE_BYTES`` are read in parallel;
* statistics per file, stripe and row group of ``INDEX_ROWS`` rows and a Bloom
  filter per row group on ``doc_id`` let a search for documents skip the rest.

Tokenizers are given, never trained: the tokenizer's JSON goes to the tasks as
a broadcast variable (a file of a few MB, checked against
``MAX_TOKENIZER_BYTES``), so executors need no copy of it.

Byte-level BPE splits a text into pieces before merging, and some places always
start a piece, whatever surrounds them (``piece_starts``).  Where the tokenizer
is of that kind, texts are cut there and each worker encodes a distinct piece
once; other tokenizers encode whole texts.  Both give the library's ids.

Scale: one shuffle of the texts by ranges of (doc_id, hash of the text), so
rows repeated under one id are many files; encoding is per row; offsets come
from one number per file.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm._common import P, table
from tillroll.session import checkpoint_dir, ship_package

END_ID = 0
ROWS_PER_FILE = 16_384
STRIPE_BYTES = 16 << 20
INDEX_ROWS = 1_000
BLOOM_FPP = 0.01
MAX_TOKENIZER_BYTES = 64 << 20
MAX_FILES_BROADCAST = 1_000_000      # (file, offset) pairs of 16 bytes
CACHE_BYTES = 160 << 20              # per Python worker
ENTRY_BYTES = 170                    # of a kept piece besides its bytes and ids
BATCH_BYTES = 8 << 20                # text whose ids are in memory at once (one text may be longer)
FILE_SCHEMA = "part int, doc_id long, before long, n_tokens int, ids array<int>"


def cuttable(tokenizer_json: str) -> bool:
    """Do the places of ``piece_starts`` always start a piece?  True for byte-level BPE without normaliser, added prefix or dropout whose
    added tokens hold and swallow no blanks."""
    t = json.loads(tokenizer_json)
    pre, model = t.get("pre_tokenizer") or {}, t.get("model") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    bpe = model.get("type", "BPE") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") \
        and not model.get("end_of_word_suffix")
    added = all(not a.get("lstrip") and not a.get("rstrip") and not re.search(r"\s", a["content"]) for a in t.get("added_tokens", []))
    return bool(plain and bpe and added and not t.get("normalizer") and not t.get("truncation") and not t.get("padding"))


def _kinds() -> np.ndarray:
    """Kind of every byte: 1 visible ASCII, 2 blank or line feed, 4 ASCII letter."""
    kind = np.zeros(256, dtype=np.uint8)
    kind[0x21:0x7f] = 1
    kind[[0x20, 0x0a]] = 2
    kind[np.r_[0x41:0x5b, 0x61:0x7b]] |= 4
    return kind


def _letter_leads() -> np.ndarray:
    """First bytes of two-byte characters that are all letters but U+00D7 and
    U+00F7: U+00C0 to U+027F and U+0400 to U+047F."""
    lead = np.zeros(256, dtype=bool)
    lead[np.r_[0xc3:0xca, 0xd0:0xd2]] = True
    return lead


KINDS, LETTER_LEADS = _kinds(), _letter_leads()


def piece_starts(data: np.ndarray) -> np.ndarray:
    """Marks of the UTF-8 bytes where a piece always starts: a blank or line feed
    after a visible character, a visible ASCII character that is no letter after
    a letter, a visible character after a line feed that follows one."""
    kind = KINDS[data]
    lead = np.flatnonzero(LETTER_LEADS[data])
    lead = lead[lead + 1 < len(data)]
    lead = lead[~((data[lead] == 0xc3) & np.isin(data[lead + 1], [0x97, 0xb7]))]
    kind[lead + 1] = 5                                       # the last byte of a letter
    visible, blank, letter = (kind & 1).astype(bool), (kind & 2).astype(bool), (kind & 4).astype(bool)
    plain = visible & ~letter
    starts = np.zeros(len(data) + 1, dtype=bool)
    starts[1:-1] = (visible[:-1] & blank[1:]) | (letter[:-1] & plain[1:])
    starts[2:-1] |= visible[:-2] & (data[1:-1] == 10) & (visible[2:] & (data[2:] < 128))
    return starts


class Encoder:
    """Texts -> ids without special tokens; ids of pieces are kept up to
    ``CACHE_BYTES``."""

    def __init__(self, tokenizer_json: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")     # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_json)
        self.encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        self.cut = cuttable(tokenizer_json)
        self.added = [a["content"].encode() for a in json.loads(tokenizer_json).get("added_tokens", [])]
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def __call__(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie one after the other in ``data``, up to ``ends``,
        and the end of each text's ids.  Where the string of an added token is
        among them, they are encoded whole."""
        cut = self.cut and len(data) > 1 and not any(a in data for a in self.added)
        starts = piece_starts(np.frombuffer(data, dtype=np.uint8)) if cut else np.zeros(len(data) + 1, dtype=bool)
        starts[0] = starts[ends] = True
        cuts = np.flatnonzero(starts).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        if self.held > CACHE_BYTES:
            self.known, self.held = {}, 0
        distinct = pieces.dictionary.to_pylist()
        codes = list(map(self.known.get, distinct))
        missing = [i for i, code in enumerate(codes) if code is None]
        for i, found in zip(missing, self.encode([distinct[i].decode() for i in missing], add_special_tokens=False)):
            codes[i] = self.known[distinct[i]] = struct.pack(f"<{len(found.ids)}I", *found.ids)
            self.held += ENTRY_BYTES + len(distinct[i]) + len(codes[i])
        sizes = np.fromiter(map(len, codes), dtype=np.int32, count=len(codes)) // 4
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                                         pa.array(np.frombuffer(b"".join(codes), dtype="<u4")))
        upto = np.concatenate([[0], np.cumsum(sizes[pieces.indices.to_numpy()], dtype=np.int64)])
        return lists.take(pieces.indices).flatten().to_numpy(), upto[np.searchsorted(cuts, ends)]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(tokenizer_json: str) -> Encoder:
    """One encoder per worker process and tokenizer."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(tokenizer_json)
    return _ENCODERS[key]


def encode_part(tokenizer, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, text, part) of one file in order -> rows of the file, in slices of
    bounded size."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before = _encoder(tokenizer.value), 0
        for batch in batches:
            texts = pa.array(batch.column("text")).cast(pa.large_string())
            data, n = texts.buffers()[2], len(texts)
            offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + n + 1]
            at = 0
            while at < n:
                to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH_BYTES))))
                part = data.slice(offsets[at], offsets[to] - offsets[at]).to_pybytes() if data else b""
                ids, ends = encode(part, offsets[at + 1:to + 1] - offsets[at])
                ids = np.insert(ids, ends, end_id).astype(np.int32)
                ends = ends + np.arange(1, to - at + 1)
                starts = np.concatenate([[0], ends[:-1]])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("part").slice(at, to - at), batch.column("doc_id").slice(at, to - at), pa.array(before + starts),
                     pa.array((ends - starts).astype(np.int32)), lists], ["part", "doc_id", "before", "n_tokens", "ids"])
                before += len(ids)
                at = to

    return of


def write_tokens(docs: DataFrame, tokenizer_json: str, folder: str, end_id: int = END_ID,
                 rows_per_file: int = ROWS_PER_FILE) -> None:
    """Encode the whole ``text`` of every row (null: empty) without adding special
    tokens (their strings in a text are what the tokenizer makes of them), append ``end_id`` and write ORC files into ``folder``, ascending by
    doc_id: null ids first, rows of one id by the hash of their text, then by
    the text.  Every row is written, repeated ones too; other columns are not.
    An empty table gives a folder without rows."""
    spark = docs.sparkSession
    ship_package(spark)
    if len(tokenizer_json.encode()) > MAX_TOKENIZER_BYTES:
        raise ValueError("the tokenizer is too large to broadcast")
    tokenizer = spark.sparkContext.broadcast(tokenizer_json)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn(f"{P}h", F.xxhash64("text"))
    files = max(1, -(-docs.count() // rows_per_file))
    order = ["doc_id", f"{P}h"]
    placed = (rows.repartitionByRange(files, *order).sortWithinPartitions(*order, "text")
              .select("doc_id", "text", F.spark_partition_id().alias("part")))
    (placed.mapInArrow(encode_part(tokenizer, end_id), FILE_SCHEMA).write.mode("overwrite")
     .option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", INDEX_ROWS).option("orc.create.index", "true")
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", BLOOM_FPP)
     .option("orc.encoding.strategy", "SPEED").option("compression", "zstd").orc(folder))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of files that ``write_tokens`` made;
    ``start`` counts the ids of all documents before it.  Offsets are read from
    the files' small columns; ``ids`` is read only where it is used."""
    files = spark.read.schema(FILE_SCHEMA).orc(folder)
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    total = sizes.count()
    # one pair per file: the running sum is over files, not over documents
    offsets = sizes.select("part", F.expr("sum(n) OVER (ORDER BY part) - n").alias("offset"))
    offsets = F.broadcast(offsets) if total <= MAX_FILES_BROADCAST else offsets
    return files.join(offsets, "part").select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids")


def find_documents(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, n_tokens, ids) of some documents: the ids reach the scan, where
    file and stripe statistics, row indexes and Bloom filters skip row groups."""
    return spark.read.schema(FILE_SCHEMA).orc(folder).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Appends the unsigned crc32 of a row's ids as little-endian unsigned
    32-bit integers, instead of the ids; their number is counted anew."""
    for batch in batches:
        lists = batch.column("ids")
        at = lists.offsets.to_numpy()
        values = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
        crc = [zlib.crc32(values[4 * a:4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(at).astype(np.int64)),
                                          pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op11_token_files(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Every document's place, length and checksum, read back from its file.
    ``tokenizer`` names a file of the public tokenizers or is a path to one."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    with open(tokenizer if os.path.sep in tokenizer else public_tokenizers.path(tokenizer), encoding="utf-8") as f:
        content = f.read()
    folder = f"{checkpoint_dir(spark).rstrip('/')}/llm-tokens-{uuid.uuid4().hex[:8]}"
    write_tokens(docs, content, folder)
    return read_tokens(spark, folder).select("doc_id", "start", "ids").mapInArrow(
        checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
