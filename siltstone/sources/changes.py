"""A data source of files that changed: read since a time, or streamed as a folder grows.

Register it once (``register(spark)``), then read with
``spark.read.format("changed_files")`` or ``spark.readStream``. A batch takes
what was modified after ``since``, an ISO time, or all; a stream takes each file
as it comes, in order of modification. Files are listed by the driver, by
name and time alone, and read by tasks, a share of the bytes each.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from siltstone.functions.text import artifact_id
from siltstone.sources.files import EXCLUDED_FOLDERS, MOST_BYTES, classified

SCHEMA = "path string, modified timestamp, length long, content binary"
_ARROW = pa.schema([("path", pa.string()), ("modified", pa.timestamp("us", tz="UTC")), ("length", pa.int64()), ("content", pa.binary())])

#: Bytes of the files that a task reads.
SHARE = 64 << 20
Found = tuple[str, int, int]  # path below the root, time of modification in ns, length


@dataclass
class Share(InputPartition):
    """Files that one task reads."""

    files: list[Found]


class _Folder:
    """The files of a folder of any file system that Arrow opens."""

    def __init__(self, options: dict) -> None:
        self.root, self.share = options["path"], int(options.get("shareBytes", SHARE))

    def _open(self) -> tuple[pa.fs.FileSystem, str]:
        from pyarrow import fs

        known, base = fs.FileSystem.from_uri(self.root if "://" in self.root or self.root.startswith("file:") else f"file://{self.root}")
        return known, base.rstrip("/")

    def listed(self) -> list[Found]:
        """Files outside of hidden folders, by time and then path."""
        from pyarrow import fs

        known, base = self._open()
        found = known.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        rows = [(f.path[len(base) + 1 :], f.mtime_ns, f.size) for f in found if f.type == fs.FileType.File]
        return sorted((r for r in rows if not any(p.startswith(".") for p in r[0].split("/"))), key=lambda r: (r[1], r[0]))

    def shares(self, files: list[Found]) -> list[Share]:
        out, size = [], 0
        for f in files:
            if not out or size + f[2] > self.share:
                out.append(Share([]))
                size = 0
            out[-1].files.append(f)
            size += f[2]
        return out

    def read(self, partition: Share | None) -> Iterator[pa.RecordBatch]:
        """The files of a share, one at a time; one that is gone by now is passed over."""
        known, base = self._open()
        for path, modified, length in partition.files if partition else ():
            try:
                with known.open_input_stream(f"{base}/{path}") as f:
                    content = f.read()
            except FileNotFoundError:
                continue
            yield pa.record_batch([pa.array([path]), pa.array([modified // 1000], _ARROW.field(1).type), pa.array([length], pa.int64()), pa.array([content], pa.binary())], schema=_ARROW)


class _Batch(_Folder, DataSourceReader):
    def __init__(self, options: dict) -> None:
        super().__init__(options)
        since = options.get("since")
        at = datetime.datetime.fromisoformat(since) if since else None
        if at and at.tzinfo is None:
            at = at.replace(tzinfo=datetime.UTC)
        self.since = int(at.timestamp() * 1_000_000) if at else None

    def partitions(self) -> Sequence[Share]:
        return self.shares([f for f in self.listed() if self.since is None or f[1] // 1000 > self.since])


class _Stream(_Folder, DataSourceStreamReader):
    """Offsets name a time and the files of just that time that were seen, as others of the same time may come later."""

    def initialOffset(self) -> dict:
        return {"at": -1, "seen": []}

    def latestOffset(self) -> dict:
        files = self.listed()
        last = files[-1][1] if files else -1
        return {"at": last, "seen": [f[0] for f in files if f[1] == last]}

    def partitions(self, start: dict, end: dict) -> Sequence[Share]:
        seen, upto = set(start["seen"]), set(end["seen"])
        after = lambda f: f[1] > start["at"] or (f[1] == start["at"] and f[0] not in seen)
        before = lambda f: f[1] < end["at"] or (f[1] == end["at"] and f[0] in upto)
        return self.shares([f for f in self.listed() if after(f) and before(f)])

    def commit(self, end: dict) -> None:
        pass


class ChangedFiles(DataSource):
    """Files below ``path``: path, modified, length, content. Options: since (batch only), shareBytes."""

    @classmethod
    def name(cls) -> str:
        return "changed_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChangedFiles)


def load_since(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """The files below ``root`` modified after ``since``, an ISO time (UTC if it names no zone), or all of them.

    A file that was moved in with an older time is not seen. Hidden folders are left out.
    """
    register(spark)
    reader = spark.read.format("changed_files")
    return (reader.option("since", since) if since else reader).load(root)


def arriving(spark: SparkSession, root: str) -> DataFrame:
    """A stream of the files below ``root``, each time they are modified."""
    register(spark)
    return spark.readStream.format("changed_files").load(root)


def artifacts(files: DataFrame, repository: str) -> DataFrame:
    """What a source tree's scan gives of files read or streamed: artifact_id, repository, path, language, artifact_type, text, modified.

    Excluded folders, empty files and those over a mebibyte are left out; bytes
    that are no UTF-8 are replaced.
    """
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    kept = files.where(F.col("length").between(1, MOST_BYTES)).where(~F.arrays_overlap(folders, F.array(*map(F.lit, EXCLUDED_FOLDERS))))
    out = classified(kept.withColumn("text", F.make_valid_utf8(F.col("content").cast("string"))))
    return out.select(artifact_id(F.lit(repository), F.col("path"), F.col("text")).alias("artifact_id"), F.lit(repository).alias("repository"), "path", "language", "artifact_type", "text", "modified")
