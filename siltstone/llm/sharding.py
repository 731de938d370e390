"""Sharding by histogram sort.

Every row has a key; shards are ranges of keys with nearly equal bytes. The
boundaries are found without moving rows: each round counts the exact bytes
and rows below the candidate boundaries over all partitions, and only the bins
that hold a boundary, or too many rows, get finer candidates in the next. When
the splitters meet the tolerance, the rows are exchanged once.

The key begins with a hash of the text and ends with a hash of the id, so
equal texts lie together and even a group of copies that holds a third of all
rows has boundaries within it.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

KEY_BITS = 63
ID_BITS = 20


@dataclass(frozen=True)
class Bin:
    """The keys from ``low`` on that share all but their last ``free`` bits."""

    low: int
    free: int
    size: int
    rows: int


def sort_key(doc_id: Column, text: Column) -> Column:
    by_text = F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 64 - KEY_BITS + ID_BITS)
    return F.shiftleft(by_text, ID_BITS).bitwiseOR(F.xxhash64(doc_id).bitwiseAND((1 << ID_BITS) - 1))


def _counted(keyed: DataFrame, within: list[Bin], free: int, bits: int) -> list[Bin]:
    """Exact bytes and rows of the 2**bits bins into which each of ``within`` falls."""
    finer = free - bits
    if within:
        keyed = keyed.where(F.shiftright("_key", free).isin([b.low >> free for b in within]))
    found = keyed.groupBy(F.shiftright("_key", finer).alias("bin")).agg(F.sum("_size").alias("size"), F.count("*").alias("rows"))
    return [Bin(r["bin"] << finer, finer, r["size"], r["rows"]) for r in found.collect()]


def histogram(keyed: DataFrame, shards: int, tolerance: float, bits: int) -> list[Bin]:
    """Bins in the order of their keys, fine enough where it matters.

    A bin is refined while it holds a shard boundary and more bytes than
    ``tolerance`` times a shard, or more than its share of rows. What the
    driver gets per round is at most 2**bits counts for each refined bin, and
    those are at most as many as boundaries and 2**bits / 4 heavy bins: it
    does not grow with the table.
    """
    bins = sorted(_counted(keyed, [], KEY_BITS, bits), key=lambda b: b.low)
    free = KEY_BITS - bits
    size, rows = sum(b.size for b in bins), sum(b.rows for b in bins)
    while free > 0:
        before, coarse = 0, []
        for b in bins:
            first, last = before * shards // max(1, size), (before + b.size - 1) * shards // max(1, size)
            heavy = 4 * max(rows >> bits, 64)
            if b.free == free and b.rows > 1 and (first != last and b.size * shards > tolerance * size or b.rows > heavy):
                coarse.append(b)
            before += b.size
        if not coarse:
            break
        step = min(bits, free)
        gone = {b.low for b in coarse}
        bins = sorted([b for b in bins if b.low not in gone] + _counted(keyed, coarse, free, step), key=lambda b: b.low)
        free -= step
    return bins


@dataclass(frozen=True)
class Part:
    """A range of keys within one shard: the unit of the exchange."""

    low: int
    shard: int
    before: int


def parts_of(bins: list[Bin], shards: int, wanted: int) -> list[Part]:
    """Shard boundaries at the nearest bin edges, and within shards parts of even weight."""
    size, rows = sum(b.size for b in bins), sum(b.rows for b in bins)
    edges = [0]
    for b in bins:
        edges.append(edges[-1] + b.size)
    cuts = []
    for k in range(1, shards):
        at = bisect.bisect_left(edges, size * k / shards)
        if at and size * k / shards - edges[at - 1] <= edges[min(at, len(edges) - 1)] - size * k / shards:
            at -= 1
        cuts.append(min(at, len(bins)))
    out, shard, before, weight = [], -1, 0, 0.0
    for k, b in enumerate(bins):
        now = bisect.bisect_right(cuts, k)
        if now != shard:
            shard, before, weight = now, 0, float("inf")
        if weight >= 1 / wanted:
            out.append(Part(b.low, shard, before))
            weight = 0.0
        weight += b.size / size / 2 + b.rows / rows / 2
        before += b.rows
    return out


def shard(docs: DataFrame, shards: int = 24, tolerance: float = 0.002, bits: int = 12) -> DataFrame:
    """``docs`` with size, shard and slot.

    Size is the UTF-8 bytes of the text (null: none) plus 8. Shards have
    nearly equal sizes, within the tolerance or one row; slots number a shard
    gaplessly from 0. Repeated rows share a key and stay side by side; which
    of them comes first does not matter, as they are equal. An empty table
    gives an empty result; with fewer rows than shards some shards are empty.
    Columns of ``docs`` pass through unless named size, shard or slot, which
    are replaced.
    """
    docs = docs.drop("size", "shard", "slot")
    key, at, part, before = fresh(docs, "_key", "_at", "_part", "_before")
    keyed = docs.withColumns({key: sort_key(F.col("doc_id"), F.col("text")), "size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8})
    bins = histogram(keyed.select(F.col(key).alias("_key"), F.col("size").alias("_size")), shards, tolerance, bits)
    rows = sum(b.rows for b in bins)
    parts = parts_of(bins, shards, max(16 * shards, min(1 << bits, rows // 50_000))) or [Part(0, 0, 0)]
    lows, shard_of, slots_before = (np.array(x, np.int64) for x in zip(*((p.low, p.shard, p.before) for p in parts), strict=True))

    @F.pandas_udf("part int, shard int, before long")
    def place(keys: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for key in keys:
            k = np.searchsorted(lows, key.to_numpy(), "right") - 1
            yield pd.DataFrame({"part": k.astype(np.int32), "shard": shard_of[k].astype(np.int32), "before": slots_before[k]})

    placed = keyed.withColumn(at, place(key)).withColumns({part: F.col(f"{at}.part"), "shard": F.col(f"{at}.shard"), before: F.col(f"{at}.before")})
    ordered = F.expr(f"row_number() over (partition by {part} order by {key}, doc_id, size)")
    return placed.withColumn("slot", (ordered - 1 + F.col(before)).cast("long")).select(*docs.columns, "size", "shard", "slot")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``bytes``: sizes near equal."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit(""))).cast("long"))).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
