"""Documents in blocks, and counts of keys exchanged in packed form.

A corpus has more n-grams, or windows, than it has bytes, so they are not
exchanged as rows. A block of documents has its distinct keys, hashes in
ascending order, cut by their leading bits into as many slices as there are
parts of the count table. A part adds up the counts that all blocks report for
each key and answers every block in the order in which it asked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, pieces, written

BLOCKS = "block long, doc_ids array<long>, sizes array<long>, texts binary"


def blocks(docs: DataFrame, block_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` as rows of about ``block_bytes`` of text each, written: whatever reads them sees the same blocks."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in pieces(batches, block_bytes):
            for key, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                if ids and size + len(text) > block_bytes:
                    yield _block(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(key)
                texts.append(text)
                size += len(text) + 8
        if ids:
            yield _block(number, ids, texts)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(read.mapInArrow(gather, BLOCKS), "blocks")


def _block(number: int, ids: list[int | None], texts: list[bytes]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
    values = (number, ids, [len(t) for t in texts], packed_texts(texts))
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["block", "doc_ids", "sizes", "texts"])


def packed_texts(texts: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(texts))


def joined_texts(sizes: list[int], packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(1, sum(sizes))) if packed else b""


def texts_of(sizes: list[int], packed: bytes) -> list[bytes]:
    joined = joined_texts(sizes, packed)
    ends = np.cumsum([0, *sizes]).tolist()
    return [joined[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def planes(x: np.ndarray) -> bytes:
    """Numbers by significance of their bytes, so that leading zeros lie together and compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unplaned(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def requests(number: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[tuple]:
    """The slices of a block's sorted keys, one for each part that has any."""
    bounds = [k * (1 << 64) // parts for k in range(parts)]
    at = np.r_[np.searchsorted(keys, np.array(bounds, np.uint64)), len(keys)].tolist()
    for part, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        if b > a:
            yield part, number, planes(np.diff(keys[a:b], prepend=np.uint64(bounds[part]))), planes(counts[a:b].astype(np.uint32))


REQUESTS = "part int, block long, keys binary, counts binary"
_REQUEST_KINDS = (pa.int32(), pa.int64(), pa.binary(), pa.binary())


def request_batches(rows: Iterator[tuple], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > most:
            yield _request_batch(held)
            held, size = [], 0
    if held:
        yield _request_batch(held)


def _request_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _REQUEST_KINDS, strict=True)], ["part", "block", "keys", "counts"])


def totals(asked: DataFrame, parts: int) -> DataFrame:
    """For each request: block, part, and the totals of its keys over all blocks, in its order.

    A part holds the keys of 1/``parts`` of the hash range: even for any
    corpus, as a block names a key once however often it occurs there.
    """

    def answer(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        base = np.uint64(part * (1 << 64) // parts)
        with np.errstate(over="ignore"):
            keys = [base + np.cumsum(unplaned(k, "<u8"), dtype=np.uint64) for k in group["keys"].to_pylist()]
        counts = [unplaned(c, "<u4") for c in group["counts"].to_pylist()]
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(every), np.uint64)
        np.add.at(total, where, np.concatenate(counts).astype(np.uint64))
        ends = np.cumsum([0, *map(len, keys)]).tolist()
        out = [planes(total[where[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table({"block": group["block"], "part": group["part"], "totals": pa.array(out, pa.binary())})

    return asked.groupBy("part").applyInArrow(answer, "block long, part int, totals binary")


def answers(group: pa.Table) -> np.ndarray:
    """The totals of all keys of one block, in the order of the keys."""
    rows = sorted(zip(group["part"].to_pylist(), group["totals"].to_pylist(), strict=True))
    return np.concatenate([unplaned(t, "<u8") for _, t in rows]) if rows else np.zeros(0, np.uint64)


def by_block(payload: DataFrame, answered: DataFrame, use: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Each block with its answers."""
    return payload.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(use, schema)


def parts_for(docs_blocks: DataFrame, keys_per_byte: float, part_keys: int = 1_500_000) -> tuple[int, int]:
    """How many parts hold about ``part_keys`` requested keys each, and the bytes of all texts."""
    size = docs_blocks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    return int(size * keys_per_byte / part_keys) + 1, size
