"""Where intermediate results go, and tables with update and delete."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, which driver and executors share; only where that is unset, a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def upsert(old: DataFrame, new: DataFrame, key: str, required: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new``: of one key the new row, of several new ones any; a null in ``required`` raises."""
    if required:
        new = new.withColumn(required, F.when(F.col(required).isNull(), F.raise_error(F.lit(f"{required} is null"))).otherwise(F.col(required)))
    return old.join(new.select(key), key, "left_anti").unionByName(new.dropDuplicates([key]), allowMissingColumns=True)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def write_partitioned(table: DataFrame, path: str, *by: str) -> None:
    """One folder per value; rows of a value are first brought together, large values over several files."""
    table.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, for what is used more than once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
