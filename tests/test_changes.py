"""Files since a time, and a folder that grows: batch and stream give the same rows."""

import datetime
import os

import pytest

from siltstone.sources import changes
from siltstone.sources.files import source_tree
from siltstone.sources.storage import shared_path


def put(folder, path, text, at):
    (folder / path).parent.mkdir(parents=True, exist_ok=True)
    (folder / path).write_bytes(text if isinstance(text, bytes) else text.encode())
    os.utime(folder / path, (at, at))


def rows(df):
    return sorted((r.path, bytes(r.content), r.length) for r in df.collect())


@pytest.fixture
def folder(tmp_path):
    put(tmp_path, "a.py", "x = 1\n", 1000)
    put(tmp_path, "d/b.md", "# B\n", 2000)
    put(tmp_path, "d/e/c.bin", b"\xff\x00", 2000)
    put(tmp_path, ".git/config", "hidden", 2000)
    put(tmp_path, "empty.txt", "", 3000)
    return tmp_path


def test_since(spark, folder):
    root = f"file://{folder}"
    assert rows(changes.load_since(spark, root)) == [("a.py", b"x = 1\n", 6), ("d/b.md", b"# B\n", 4), ("d/e/c.bin", b"\xff\x00", 2), ("empty.txt", b"", 0)]
    at = lambda s: datetime.datetime.fromtimestamp(s, datetime.UTC).isoformat()
    assert [r[0] for r in rows(changes.load_since(spark, root, at(1000)))] == ["d/b.md", "d/e/c.bin", "empty.txt"]
    assert [r[0] for r in rows(changes.load_since(spark, str(folder), at(1999.5)[:-6]))] == ["d/b.md", "d/e/c.bin", "empty.txt"]
    assert rows(changes.load_since(spark, root, at(3000))) == []
    assert {r.path: r.modified.timestamp() for r in changes.load_since(spark, root).collect()}["a.py"] == 1000
    assert rows(changes.load_since(spark, f"file://{folder}/nothing")) == []


def test_shares(spark, folder):
    changes.register(spark)
    df = spark.read.format("changed_files").option("shareBytes", "6").load(f"file://{folder}")
    assert df.rdd.getNumPartitions() == 2 and len(rows(df)) == 4


def test_growing_folder(spark, folder):
    root, out, state = f"file://{folder}", shared_path(spark, "changes"), shared_path(spark, "changes-state")

    def drain():
        changes.arriving(spark, root).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return rows(spark.read.schema(changes.SCHEMA).parquet(out))

    assert drain() == rows(changes.load_since(spark, root))
    put(folder, "empty2.txt", "same time as the last", 3000)
    put(folder, "z.py", "y = 2\n", 4000)
    assert drain() == rows(changes.load_since(spark, root))
    assert drain() == rows(changes.load_since(spark, root))
    before = drain()
    put(folder, "a.py", "x = 3\n", 5000)
    assert drain() == sorted([*before, ("a.py", b"x = 3\n", 6)])


def test_artifacts_are_those_of_a_scan(spark, folder):
    root = f"file://{folder}"
    columns = ("artifact_id", "repository", "path", "language", "artifact_type", "text")
    scanned = {r.path: tuple(r[c] for c in columns) for r in source_tree(spark, root, "o/r").collect()}
    found = {r.path: tuple(r[c] for c in columns) for r in changes.artifacts(changes.load_since(spark, root), "o/r").collect()}
    assert found.pop("d/e/c.bin")[3] == "unknown" and found == scanned
