"""The registered queries: those with SQL against DuckDB, the others by what must hold of their rows."""

import glob
import os
import zlib

import duckdb
import pytest

from siltstone.llm import registry

SF = "/root/testdata/sf0.001"


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(round(r[k], 5) if isinstance(r[k], float) else r[k] for k in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df, want = registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLES[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_op9_rows(spark, duck):
    found = registry.QUERIES["op9_toxicity"](spark, SF).collect()
    assert sorted(r.doc_id for r in found) == sorted(k for (k,) in duck.sql("select doc_id from documents").fetchall())
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_op10_covers_every_token(spark, duck):
    found = registry.QUERIES["op10_packing"](spark, SF).collect()
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc) == sorted(k for (k,) in duck.sql("select doc_id from documents").fetchall())
    for parts in by_doc.values():
        parts.sort(key=lambda r: r.start)
        assert [r.start for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
        assert sum(r.length for r in parts) == parts[0].doc_tokens
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
        assert sum(r.length for r in parts) <= 1024


def test_op2_reruns_agree(spark):
    one, other = (sorted(map(str, registry.QUERIES["op2_mixing"](spark, SF).collect())) for _ in range(2))
    assert one == other
