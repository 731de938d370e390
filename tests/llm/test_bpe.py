"""Byte-level BPE against the tiktoken library, and back to the texts."""

import hashlib
import random
import struct

import numpy as np
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers
from siltstone.llm import bpe, registry

from . import cases

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def known():
    return bpe.vocabulary(PATH)


@pytest.fixture(scope="module")
def library(known):
    return tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known.ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def odd_texts():
    rng = random.Random(7)
    parts = ["a", "aa", "ab", "\n", " ", "  ", "'s", "'ll", "é", "漢", "字", "1", "23", "՘", "౜", "\U00011de0", "?!", "\t", "\x1c", "ß", "the", "ing", "　", "<|endoftext|>", "\x00"]
    yield from ("".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000))
    span = [(32, 127), (0, 0x3000), (0xE000, 0x110000)]
    yield from ("".join(chr(rng.randrange(*rng.choice(span))) for _ in range(50)) for _ in range(1000))


def test_ids_of_odd_texts(known, library):
    for text in odd_texts():
        packed = known.encode(text)
        assert ids(packed) == library.encode_ordinary(text), text
        assert known.decode(packed) == text.encode()


@pytest.mark.parametrize("unit", ["a", "ab", "thing", "é", "漢字", "=", "\n"])
def test_long_pieces(known, library, unit):
    for n in (3000, 30_000):
        assert ids(known.encode(unit * n)) == library.encode_ordinary(unit * n)


def test_long_piece_of_random_letters(known, library):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdethingö") for _ in range(60_000))
    assert ids(known.encode(text)) == library.encode_ordinary(text)


def test_texts_beyond_a_run_of_pieces(known, library):
    text = " word 12, and\n" * 150_000
    assert ids(known.encode(text)) == library.encode_ordinary(text)


def test_forgetting_changes_nothing(known, library):
    held = bpe.Pieces(known.merged, most=3)
    for piece in ("qab", "qcd", "qef", "qgh", "qab", "qij", "qkl", "qmn", "qcd", "q" * 90) * 3:
        assert ids(held[piece]) == library.encode_ordinary(piece)
        assert len(held) <= 3


def test_cases(spark, library):
    docs = cases.clashing(cases.table(spark))
    found = bpe.round_trip(docs, PATH)
    assert set(docs.columns) <= set(found.columns)
    rows = found.select("doc_id", "text", "ids", "decoded", bpe.unpacked(F.col("ids")).alias("list")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.list == ids(r.ids) == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded).decode() == (r.text or "")


def test_empty_table_and_bad_ids(spark):
    empty = spark.createDataFrame([], cases.SCHEMA)
    assert bpe.round_trip(empty, PATH).collect() == []
    one = spark.createDataFrame([(None,), (bytearray(b""),)], "ids binary").select(bpe.decoded(F.col("ids"), PATH).alias("d"), bpe.unpacked(F.col("ids")).alias("u")).collect()
    assert [(bytes(r.d), r.u) for r in one] == [(b"", [])] * 2
    with pytest.raises(Exception, match="index out of range"):
        spark.createDataFrame([(bytearray(struct.pack("<I", 1 << 30)),)], "ids binary").select(bpe.decoded(F.col("ids"), PATH)).collect()


def test_op12_rows(spark, library):
    found = sorted(map(tuple, registry.QUERIES["op12_bpe"](spark, SF).collect()))
    want = []
    for doc_id, text in zip(*(pq.read_table(f"{SF}/documents.parquet")[c].to_pylist() for c in ("doc_id", "text")), strict=True):
        own = library.encode_ordinary(text or "")
        want.append((doc_id, len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert found == sorted(want)
