"""Mixing sources to target weights.

The words of a source are one line, its documents end to end, cut into blocks
of one length. Output shards have a fixed number of slots; each shard draws
how many of them every source fills from a multinomial, and the draws of a
source, counted over all shards, run through a pseudorandom permutation of its
block indexes, pass after pass. Slots and blocks are then joined by index.

A multinomial misses its expectation a little. Draws beyond a source's target
are passed on, by their number, to the sources that drew too few, so every
source meets its target to the word and none is passed through more often
than its cap allows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, fresh, pieces, table, written

#: The weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Shards whose draws are summed together, and shards whose slots one task fills.
BUCKET_SHARDS, TASK_SHARDS = 1024, 8


def targets(sizes: list[int], weights: list[int], share: float, cap: float) -> list[float]:
    """Shares of ``share`` times all sizes by weight, none above ``cap`` times its size.

    What is above goes to the others by weight until none is: the level at
    which sum(min(cap * size, weight * level)) is the whole.
    """
    left, weight = share * sum(sizes), sum(weights)
    level = 0.0
    for k in sorted(range(len(sizes)), key=lambda k: (cap * sizes[k] / weights[k], k)):
        level = left / weight
        if cap * sizes[k] > weights[k] * level:
            break
        left, weight = left - cap * sizes[k], weight - weights[k]
    return [min(cap * n, w * level) for n, w in zip(sizes, weights, strict=True)]


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permuted(x: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(n), or its inverse: a Feistel network, walked until within range."""
    half = max(1, math.ceil(math.log2(max(n, 2)) / 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [_mixed(np.array([key * 8 + r + 1], np.uint64))[0] for r in range(4)]
    out = np.asarray(x, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        y = out[todo]
        left, right = y >> shift, y & mask
        for k in reversed(keys) if back else keys:
            if back:
                left, right = right ^ (_mixed(left ^ k) & mask), left
            else:
                left, right = right, left ^ (_mixed(right ^ k) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Source:
    """A source's line of words and how much of it the mix takes."""

    name: str | None
    number: int
    size: int
    target: float
    block: int
    seed: int

    @property
    def blocks(self) -> int:
        return -(-self.size // self.block)

    @property
    def last(self) -> int:
        """Words of the last block."""
        return self.size - (self.blocks - 1) * self.block

    def key(self, turn: int) -> int:
        return (self.seed * 1_000_003 + self.number) * 64 + turn

    def words(self, draws: int) -> int:
        """Words of the first ``draws`` draws."""
        if not self.size:
            return 0
        turns, rest = divmod(draws, self.blocks)
        short = rest and permuted(np.array([self.blocks - 1]), self.blocks, self.key(turns), back=True)[0] < rest
        return turns * self.size + rest * self.block - (self.block - self.last if short else 0)

    @property
    def draws(self) -> int:
        """The fewest draws whose words reach the target."""
        want = round(self.target)
        if not self.size or not want:
            return 0
        turns, rest = divmod(want, self.size)
        draws = turns * self.blocks + -(-rest // self.block)
        return draws + (self.words(draws) < want)


@dataclass
class Mix:
    """A drawn mix: sources, the documents' places on the lines, and the filled slots."""

    sources: list[Source]
    lines: DataFrame
    slots: DataFrame

    def taken_pieces(self) -> DataFrame:
        """Slots joined with the documents' pieces by block index.

        Columns: number, start, row_key (the document), shard, slot, turn,
        from_word, to_word (within the document, the end exclusive).
        """
        block = self.sources[0].block if self.sources else 1
        parts = self.lines.where("size > 0").withColumn("at", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
        joined = parts.join(self.slots.withColumnRenamed("block", "at").hint("merge"), ["number", "at"])
        low, high = F.greatest(F.col("at") * block, F.col("start")), F.least(F.col("at") * block + F.col("take"), F.col("start") + F.col("size"))
        return joined.select(
            "number", "start", "row_key", "shard", "slot", "turn", (low - F.col("start")).alias("from_word"), (high - F.col("start")).alias("to_word")
        ).where("to_word > from_word")

    def taken(self) -> DataFrame:
        """For each document: doc_id, size, source_size, target, taken."""
        summed = self.taken_pieces().groupBy("number", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
        if not self.sources:
            return self.lines.selectExpr("doc_id", "size", "0L as source_size", "0D as target", "0L as taken")
        about = self.lines.sparkSession.createDataFrame([(s.number, s.size, s.target) for s in self.sources], "number int, source_size long, target double")
        lines = self.lines.withColumn("start", F.when(F.col("size") > 0, F.col("start"))).join(F.broadcast(about), "number")
        return lines.join(summed, ["number", "start"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _row_key(*columns: Column) -> Column:
    """Tells rows apart by 128 bits."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, block: int = 1024, shard_blocks: int = 4096, seed: int = 7, most_sources: int = 100_000) -> Mix:
    """The mix of all of ``docs``.

    A document's size is the number of its words, runs that are not white
    space; null and empty texts have none, are part of their source and are
    never taken. A null source is a source of its own, after all others.
    Repeated rows lie on the line once each. An empty table gives an empty
    mix. Other columns are not looked at. The plan rests on a table of one row
    per source, which the driver holds; more than ``most_sources`` raise.
    """
    lines = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        _row_key(F.col("doc_id"), F.col("source"), F.col("text")).alias("row_key"),
    )
    lines = written(lines, "mixing-sizes")
    by_source = lines.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).limit(most_sources + 1).collect()
    if len(by_source) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    by_source.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    weights = [WEIGHTS[k % len(WEIGHTS)] for k in range(len(by_source))]
    wanted = targets([r["size"] for r in by_source], weights, share, cap)
    sources = [Source(r["source"], k, r["size"], w, block, seed) for k, (r, w) in enumerate(zip(by_source, wanted, strict=True))]
    return Mix(sources, _lines(lines, sources, sum(r["rows"] for r in by_source)), _slots(docs.sparkSession, sources, shard_blocks, seed))


def _lines(lines: DataFrame, sources: list[Source], rows: int) -> DataFrame:
    """Each document's start on its source's line.

    A source may hold any share of the rows, so the running sum goes over
    buckets of ids within a source and then over the buckets' totals.
    """
    buckets = max(64, rows // 100_000)
    spark = lines.sparkSession
    numbers = spark.createDataFrame([(s.name, s.number) for s in sources], "source string, number int")
    numbered = lines.join(F.broadcast(numbers), lines["source"].eqNullSafe(numbers["source"])).drop("source")
    numbered = numbered.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    totals = numbered.groupBy("number", "bucket").agg(F.sum("size").alias("total"))
    before = totals.withColumn("before", F.expr("sum(total) over (partition by number order by bucket) - total")).drop("total")
    within = numbered.withColumn("within", F.expr("sum(size) over (partition by number, bucket order by doc_id, row_key, size rows unbounded preceding) - size"))
    return within.join(before, ["number", "bucket"]).select("doc_id", "row_key", "number", "size", (F.col("before") + F.col("within")).alias("start"))


def _slots(spark: SparkSession, sources: list[Source], shard_blocks: int, seed: int) -> DataFrame:
    """All slots of all shards: shard, slot, number, block, turn, take (words of the block)."""
    needed = np.array([s.draws for s in sources], np.int64)
    total = int(needed.sum())
    shards = -(-total // shard_blocks)
    chance = needed / max(1, total)

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                slots = min(shard_blocks, total - shard * shard_blocks)
                counts = np.random.default_rng([seed, int(shard)]).multinomial(slots, chance)
                yield pd.DataFrame({"shard": shard, "number": np.arange(len(counts), dtype=np.int32), "draws": counts, "slot": np.cumsum(counts) - counts}).query("draws > 0")

    counts = spark.range(shards).mapInPandas(drawn, "shard long, number int, draws long, slot long")
    got = np.zeros(len(sources), np.int64)
    for r in counts.groupBy("number").agg(F.sum("draws").alias("n")).collect():
        got[r["number"]] = r["n"]
    over, under = np.maximum(got - needed, 0), np.maximum(needed - got, 0)
    over_before, under_before = np.cumsum(over) - over, np.cumsum(under) - under
    ends = [s.words(int(c)) - round(s.target) if c else 0 for s, c in zip(sources, needed, strict=True)]

    def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                j = r.first + np.arange(r.draws)
                number = np.full(len(j), r.number)
                beyond = j >= needed[r.number]
                passed = over_before[r.number] + j[beyond] - needed[r.number]
                number[beyond] = to = np.searchsorted(np.cumsum(under), passed, "right")
                j[beyond] = got[to] + passed - under_before[to]
                slot = permuted(r.slot + np.arange(r.draws), int(min(shard_blocks, total - r.shard * shard_blocks)), seed * 1_000_003 + r.shard)
                for k in np.unique(number):
                    s, here = sources[k], number == k
                    turn = j[here] // s.blocks
                    block = np.concatenate([permuted(j[here][turn == t] % s.blocks, s.blocks, s.key(int(t))) for t in np.unique(turn)])
                    by_turn = np.argsort(turn, kind="stable")
                    take = np.where(block == s.blocks - 1, s.last, s.block)
                    take[j[here][by_turn] == needed[k] - 1] -= ends[k]
                    yield pd.DataFrame({"shard": r.shard, "slot": slot[here][by_turn], "number": np.int32(k), "block": block, "turn": turn[by_turn].astype(np.int32), "take": take})

    # a source's draws before a shard: those before its bucket of shards and those within
    bucketed = counts.withColumn("bucket", F.expr(f"shard div {BUCKET_SHARDS}"))
    before = bucketed.groupBy("number", "bucket").agg(F.sum("draws").alias("total")).withColumn("before", F.expr("sum(total) over (partition by number order by bucket) - total")).drop("total")
    within = bucketed.withColumn("within", F.expr("sum(draws) over (partition by number, bucket order by shard) - draws"))
    first = within.join(before, ["number", "bucket"]).select("shard", "number", "draws", "slot", (F.col("before") + F.col("within")).alias("first"))
    dealt = first.repartition(max(1, min(10_000, shards // TASK_SHARDS + 1)), "shard", "number")
    return dealt.mapInPandas(filled, "shard long, slot long, number int, block long, turn int, take long")


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix as documents: for each document and pass in which any of it is taken, one row with the words taken.

    Null, empty and blank texts are never taken and so are not in the mix. Of
    rows equal in id, source and text one is taken for each place on the line
    that is drawn; other columns are those of any of them. An empty table
    gives an empty mix.

    A document taken whole keeps its text as it is; of one that a block border
    cuts, the stretches taken are kept as written, joined by a space. The
    columns are those of ``docs``; n_chars, if there, is counted anew. A
    document that no slot takes is not in the mix.
    """
    drawn = mix(docs, **settings)
    key, found = fresh(docs, "_row_key", "_spans")
    taken = drawn.taken_pieces().groupBy("row_key", "number", "start", "turn").agg(F.sort_array(F.collect_list(F.struct("from_word", "to_word"))).alias(found))
    rows = docs.withColumn(key, _row_key(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")))
    rows = rows.dropDuplicates([key]).join(taken.select(F.col("row_key").alias(key), found), key)
    at, spans_at = rows.columns.index("text"), rows.columns.index(found)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [stretch(x, s) for x, s in zip(as_bytes(batch.column(at)), batch.column(spans_at).to_pylist(), strict=True)]
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = rows.mapInArrow(cut, T.StructType([f if f.name != "text" else T.StructField("text", T.StringType()) for f in rows.schema]))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def stretch(text: bytes, spans: list[dict]) -> bytes:
    """The words of ``text`` in the spans, each maximal stretch as it is written."""
    runs: list[list[int]] = []
    for s in spans:
        if runs and runs[-1][1] >= s["from_word"]:
            runs[-1][1] = max(runs[-1][1], s["to_word"])
        else:
            runs.append([s["from_word"], s["to_word"]])
    words = len(text.split())
    if runs == [[0, words]]:
        return text
    out = []
    for low, high in runs:
        rest = text.split(None, low)[low] if low else text.lstrip()
        after = rest.split(None, high - low)
        tail = after[high - low] if len(after) > high - low else b""
        out.append(rest[: len(rest) - len(tail)].rstrip())
    return b" ".join(out)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mix`` of all documents, as what is taken of each."""
    return mix(table(spark, sf_dir, "documents")).taken()
