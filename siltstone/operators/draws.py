"""Sums of values drawn with replacement, many times over, by a hash that counts: what n items of a corpus add up to.

Values are held as how often each occurs. A draw is a number below the count of
all values, taken by a hash of seed, draw and place, and stands for the value at that
place of the sorted values. Every task makes its share of the draws at
once, and passes on a sum for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources.storage import written

#: So many different values are held by every task; more are met by a join.
MOST_HELD = 1 << 18
_TIMES = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15


def drawn(seed: int, n: int, draws: np.ndarray, place: int) -> np.ndarray:
    """64 bits for each draw's item at ``place`` of ``n``: the finisher of a counter, the counters a step apart."""
    with np.errstate(over="ignore"):
        x = (np.uint64(seed) + draws.astype(np.uint64) * np.uint64(n) + np.uint64(place + 1)) * np.uint64(_STEP)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_TIMES[0])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_TIMES[1])
        return x ^ (x >> np.uint64(31))


def drawn_sums(values: DataFrame, value: str, n: int, draws: int = 20_000, seed: int = 42) -> DataFrame:
    """(draw, total): the sum of ``n`` values drawn with replacement from all rows, for each of ``draws`` draws.

    Null values take no part. Without any value there is no draw. The same
    values, n and seed give the same sums, however the rows are partitioned.
    """
    spark = values.sparkSession
    counts = values.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))
    rows = counts.limit(MOST_HELD + 1).collect()
    if not rows:
        return spark.createDataFrame([], "draw long, total double")
    if len(rows) > MOST_HELD:
        return _joined_sums(counts, n, draws, seed)
    rows.sort(key=lambda r: r["value"])
    known, upto = np.array([r["value"] for r in rows]), np.cumsum([r["n"] for r in rows])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            total = np.zeros(len(at))
            for place in range(n):
                total += known[np.searchsorted(upto, (drawn(seed, n, at, place) % np.uint64(upto[-1])).astype(np.int64), "right")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total)], ["draw", "total"])

    return spark.range(draws).mapInArrow(add, "draw long, total double")


def _joined_sums(counts: DataFrame, n: int, draws: int, seed: int, width: int = 1 << 16) -> DataFrame:
    """The same where there are more different values than a task should hold: a row for each item drawn, joined to the stretch of places that its value has."""
    spark = counts.sparkSession
    parts = counts.repartitionByRange("value").sortWithinPartitions("value").withColumn("place", F.monotonically_increasing_id())
    held = written(parts, "values").withColumn("part", F.shiftright("place", 33))
    sizes = held.groupBy("part").agg(F.sum("n").alias("size")).orderBy("part").collect()
    before, offsets = 0, []
    for r in sizes:
        offsets.append((r["part"], before))
        before += r["size"]
    known = F.broadcast(spark.createDataFrame(offsets, "part long, before long"))
    upto = F.expr("sum(n) over (partition by part order by place)")
    stretches = held.join(known, "part").withColumn("high", F.col("before") + upto).withColumn("low", F.col("high") - F.col("n"))
    stretches = stretches.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))
    all_values = before

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            for place in range(n):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((drawn(seed, n, at, place) % np.uint64(all_values)).astype(np.int64))], ["draw", "at"])

    asked = spark.range(draws).mapInArrow(items, "draw long, at long").withColumn("block", F.floor(F.col("at") / width))
    met = asked.join(stretches, (asked["block"] == stretches["block"]) & (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")))
    return met.groupBy("draw").agg(F.sum("value").alias("total"))


def distribution(sums: DataFrame, overhead: float = 0.0) -> DataFrame:
    """(mean, p50, p90, p95, p99, max) of (draw, total), by nearest rank in the sorted totals, halves to even."""
    total = F.col("total") + overhead
    ranked = sums.select(total.alias("total"), F.expr("row_number() over (order by total) - 1").alias("at"), F.expr("count(*) over ()").alias("n"))
    at = lambda q: F.max(F.when(F.col("at") == F.least(F.col("n") - 1, F.bround((F.col("n") - 1) * q).cast("long")), F.col("total")))
    return ranked.agg(F.round(F.avg("total"), 1).alias("mean"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max("total").alias("max"))


def worst_case(values: DataFrame, value: str, n: int, overhead: float = 0.0) -> DataFrame:
    """(worst_case): the sum of the ``n`` largest values."""
    return values.where(F.col(value).isNotNull()).orderBy(F.desc(value)).limit(n).agg((F.sum(F.col(value).cast("double")) + overhead).alias("worst_case"))
