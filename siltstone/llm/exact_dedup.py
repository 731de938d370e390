"""Exact deduplication by Grace hashing.

Rows are partitioned by a hash of their content; a partition that does not fit
is partitioned again into spill files by further bits of the hash, until each
bucket fits an open-addressing table that compares complete contents.

A group of copies can be any share of the corpus, so copies first meet within
their input partition, in the same kind of table: what is exchanged is one row
for each distinct text of each input partition. The way back, from a group to
its rows, is a join on the digest whose many side carries 40 bytes a row and
which Spark may split.
"""

from __future__ import annotations

import hashlib
import marshal
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, fresh, pieces, table

#: (hash, content, smallest id, rows): what is held of one distinct text.
Entry = tuple[int, bytes, int, int]

FAN_BITS = 4
DEEPEST = 8  # partitionings by FAN_BITS each; the tables use the bits above those


class ContentTable:
    """Open addressing with linear probing; equal means equal in every byte."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.entries: list[Entry] = []
        self.held = 0

    def add(self, entry: Entry) -> None:
        h, content, first, rows = entry
        mask = len(self.slots) - 1
        at = (h >> FAN_BITS * DEEPEST) & mask
        while (k := self.slots[at]) >= 0:
            other = self.entries[k]
            if other[0] == h and other[1] == content:
                self.entries[k] = (h, other[1], min(first, other[2]), rows + other[3])
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.entries)
        self.entries.append(entry)
        self.held += len(content) + 64
        if 2 * len(self.entries) > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for k, entry in enumerate(self.entries):
            at = (entry[0] >> FAN_BITS * DEEPEST) & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def grace(rows: Iterable[Entry], limit: int, depth: int = 0) -> Iterator[Entry]:
    """The distinct contents of ``rows``, holding about ``limit`` bytes at a time.

    Beyond the limit, what is held and what is still to come goes to spill
    files, each taken up in turn by the next bits of the hash. At the deepest
    level the table may outgrow the limit; rows get there only when 32 bits of
    their hashes agree.
    """
    rows, held = iter(rows), ContentTable()
    for row in rows:
        held.add(row)
        if held.held > limit and depth < DEEPEST:
            break
    else:
        yield from held.entries
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        paths = [Path(folder, str(k)) for k in range(1 << FAN_BITS)]
        files = [p.open("wb") for p in paths]
        for group in (held.entries, rows):
            for row in group:
                marshal.dump(row, files[(row[0] >> FAN_BITS * depth) & (1 << FAN_BITS) - 1])
        del held
        for f in files:
            f.close()
        for path in paths:
            yield from grace(_spilled(path), limit, depth + 1)
            path.unlink()


def _spilled(path: Path) -> Iterator[Entry]:
    with path.open("rb") as f:
        while True:
            try:
                yield marshal.load(f)
            except EOFError:
                return


def normalised(text: bytes) -> bytes:
    """``text`` with each run of white space as one space."""
    if not text:
        return text
    inner = b" ".join(text.split())
    if not inner:
        return b" "
    return b" " * text[:1].isspace() + inner + b" " * text[-1:].isspace()


def _hash(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little") >> 1


def _local(limit: int):
    """One row for each distinct text of what the task has read since its table was last full."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = ContentTable()
        for batch in pieces(batches):
            for key, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                content = normalised(text)
                held.add((_hash(hashlib.sha256(content).digest()), content, key, 1))
                if held.held > limit:
                    yield from _out(held.entries)
                    held = ContentTable()
        yield from _out(held.entries)

    return distinct


def _out(entries: Iterable[Entry], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    part, size = [], 0
    for entry in entries:
        part.append(entry)
        size += len(entry[1])
        if size > most:
            yield _batch(part)
            part, size = [], 0
    if part:
        yield _batch(part)


def _batch(part: list[Entry]) -> pa.RecordBatch:
    h, content, first, rows = zip(*part, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(h, pa.int64()), pa.array(content, pa.binary()), pa.array(first, pa.int64()), pa.array(rows, pa.int64())],
        ["h", "content", "first", "rows"],
    )


def _across(limit: int):
    """The groups of an exchanged partition: digest, smallest id, number of rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Entry]:
        for batch in pieces(batches):
            yield from zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = []
        for _, content, first, n in grace(rows(batches), limit):
            part.append((hashlib.sha256(content).digest(), first, n))
            if len(part) == 10_000:
                yield _groups_batch(part)
                part = []
        if part:
            yield _groups_batch(part)

    return groups


def _groups_batch(part: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    digest, first, n = zip(*part, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(first, pa.int64()), pa.array(n, pa.int64())], ["digest", "keep_id", "group_size"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        digests = [hashlib.sha256(normalised(x)).digest() for x in as_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary())], ["doc_id", "digest"])


#: Stands for a null id, so that it comes last among its copies.
NO_ID = (1 << 63) - 1


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))


def groups(docs: DataFrame, bucket_bytes: int = 32 << 20) -> DataFrame:
    """One row for each distinct text: digest, keep_id, group_size.

    ``bucket_bytes`` bounds the texts that a task holds at once.
    """
    local = _read(docs).mapInArrow(_local(bucket_bytes), "h long, content binary, first long, rows long")
    return local.repartition("h").mapInArrow(_across(bucket_bytes), "digest binary, keep_id long, group_size long")


def exact_duplicates(docs: DataFrame, bucket_bytes: int = 32 << 20) -> DataFrame:
    """For each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space is replaced
    by one space; a null text counts as empty, so null and empty texts form
    one group. Of equal texts the smallest doc_id stays, a null one only if
    there is no other. Repeated rows count each in ``group_size``; rows that
    repeat the doc_id that stays are all marked kept (they can't be told
    apart). The id 2^63 - 1 stands for a null one within and comes back as null. Texts are
    compared whole, whatever their length. Other columns of ``docs`` are not looked at. An empty table gives
    an empty result.
    """
    marked = _read(docs).mapInArrow(_digests, "doc_id long, digest binary").join(groups(docs, bucket_bytes), "digest")
    return marked.select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"),
        F.nullif("keep_id", F.lit(NO_ID)).alias("keep_id"),
        "group_size",
        F.expr("doc_id = keep_id").alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns, whatever their names; of rows repeated with the same id, one.

    Of equal texts the smallest id stays, a null one only if there is no other;
    null and blank texts are one group. An empty table stays empty.
    """
    doc, digest = fresh(docs, "_doc", "_digest")
    schema = T.StructType([*docs.schema.fields, T.StructField(digest, T.BinaryType())])
    at = docs.columns.index("text")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [hashlib.sha256(normalised(x)).digest() for x in as_bytes(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, digest])

    stay = groups(docs).select(F.col("keep_id").alias(doc), F.col("digest").alias(digest))
    marked = docs.mapInArrow(digests, schema).withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    return marked.join(stay, [doc, digest], "left_semi").dropDuplicates([doc, digest]).select(*docs.columns)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``exact_duplicates`` of all documents: nulls, blanks, ties, repeated rows, long texts and the empty table as there."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
