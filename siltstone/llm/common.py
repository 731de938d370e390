"""What the training-data operators share: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siltstone.sources.tables import spread

#: The white space that separates words everywhere in these operators.
SPACE = rb"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data directory, through Spark's reader only, over all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset, as
    in tests on one machine, a new folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    This cuts the lineage: what follows reads files that survive a lost
    executor, and a column that it does not need is not read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Names like the given ones that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return tuple(out)


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string or binary column as byte strings, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``most`` bytes (a longer row stays whole)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, min(n, int(n * most / max(1, batch.nbytes))))
        for at in range(0, n, step):
            yield batch.slice(at, step)


#: CRC-32 a bit at a time, as DuckDB has none.
_CRC = """list_reduce(list_transform(range(0, octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::UINTEGER::BIGINT),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))), 4294967295)"""


def crc32_sql(text: str) -> str:
    """DuckDB's SQL for the unsigned CRC-32 of an expression of ASCII or other text."""
    return f"xor(({_CRC.format(text)}), 4294967295)"
