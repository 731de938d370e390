"""Structured Streaming: deduplication, latest state, windows. A stream's results equal those of the same batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.sources.storage import shared_path


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file stream, with an event time that a watermark accepts.

    All files are one batch: their times are in no order, and in a later
    batch the watermark would drop what is older than the first one's latest.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """What the stream gives until its input is used up.

    Each batch replaces its own folder, so a batch that is done again after a
    failure leaves the same files. In update mode the last row of each key
    counts, in complete mode the last batch.
    """
    spark, out = stream.sparkSession, shared_path(stream.sparkSession, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/_batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", shared_path(spark, "stream-state")).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    found = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(out)
    if mode == "complete":
        last = found.agg(F.max("_batch")).first()[0]
        return found.where(F.col("_batch") == (last if last is not None else -1)).drop("_batch")
    if mode == "update":
        rest = [c for c in stream.columns if c not in keys]
        return found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_row")).select(*keys, "_row.*")
    return found.drop("_batch")


def tumbling(stream: DataFrame, length: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums per window and type; the watermark bounds the state."""
    grouped = stream.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sliding(stream: DataFrame, length: str = "2 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    grouped = stream.withWatermark("ts", late).groupBy(F.window("ts", length, slide)).agg(F.count("*").alias("n"), F.max("value").alias("peak"))
    return grouped.select(F.col("window.start").alias("window_start"), "n", "peak")


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Runs of a user's events without a longer gap."""
    grouped = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("session_start"), "n")


def first_seen(stream: DataFrame, *keys: str) -> DataFrame:
    """Each key once, when it is first met. The state is as large as the set of keys; with a time bound use ``first_seen_within``."""
    return stream.select(*keys).dropDuplicates(list(keys))


def first_seen_within(stream: DataFrame, late: str, *keys: str) -> DataFrame:
    """Each key once within the watermark; older state is dropped."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def latest_state(stream: DataFrame, key: str, order: str) -> DataFrame:
    """A changelog's current row per key."""
    rest = [c for c in stream.columns if c != key]
    return stream.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*")
