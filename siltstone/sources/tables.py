"""Typed readers of the tables in a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIMES = {"events": ("ts",), "orders": ("o_orderdate",), "lineitem": ("l_shipdate",)}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; times without a zone are taken as UTC instants, as watermarks need."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c in TIMES.get(name, ())}) if name in TIMES else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer partitions than there are.

    A small file is often one row group, which one task would read and work on
    alone; a table of many files passes through as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
