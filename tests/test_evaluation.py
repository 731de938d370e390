"""Evaluation, citations and scans where the given tables have no hard case."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siltstone.functions import scalars as X
from siltstone.functions import text as T
from siltstone.operators import evaluation as M
from siltstone.operators import ingest as I
from siltstone.operators import retrieval as R


def test_alternatives_need_one_primary(spark):
    relevant = spark.createDataFrame([(1, "d/a.py"), (1, "d/a_b.py"), (1, "e/a.py")], "query_id long, file string")
    one = spark.createDataFrame([(1, "e/a_x.py")], "query_id long, file string")
    assert [r.primary for r in M.primaries(one, relevant).collect()] == ["e/a.py"]
    for wrong in ("d/a_b_c.py", "f/a_x.py"):
        with pytest.raises(PySparkException):
            M.primaries(spark.createDataFrame([(1, wrong)], "query_id long, file string"), relevant).collect()


def test_file_metrics_close_up_repeats(spark):
    ranked = spark.createDataFrame([(1, 1, "./a.py"), (1, 2, "a.py"), (1, 3, None), (1, 4, "b.py")], "query_id long, rank int, file string")
    relevant = spark.createDataFrame([(1, "b.py"), (2, "c.py")], "query_id long, file string")
    found = {r.query_id: r for r in M.file_metrics(ranked, relevant, None, (1, 3)).collect()}
    assert found[1].mrr == 0.5 and found[1].n_ranked == 2 and found[1].recall_3 == 1.0 and found[2].mrr == 0.0 and found[2].n_ranked == 0


def test_long_line_numbers_leave_no_citation(spark):
    long = "9" * 25
    row = spark.range(1).select(T.line_citations(F.lit(f"[a/b.py:{long}] [a/b.py:3-2]")).alias("l"), T.loose_citations(F.lit(f"a/b.py:{long}")).alias("c")).first()
    assert [(c.path, c.start_line, c.end_line) for c in row.l] == [("a/b.py", 2, 3)]
    assert [(c.path, c.start_line) for c in row.c] == [("a/b.py", None)]


def test_citations_match_by_suffix(spark):
    answers = spark.createDataFrame([(1, "see [app.py:5-9] and [x/src/lib.py] and [no.py]"), (2, "nothing")], "query_id long, answer string")
    chunks = spark.createDataFrame([(1, "src/app.py", 8, 20), (1, "src/lib.py", None, None), (2, "q.py", 1, 2)], "query_id long, path string, start_line long, end_line long")
    found = {r.query_id: r for r in M.grounded(M.citation_counts(answers, chunks)).collect()}
    assert (found[1].n_citations, found[1].n_valid, found[1].line_share, found[1].score, found[1].passed) == (3, 2, 1.0, 0.8, False)
    assert (found[2].n_citations, found[2].score, found[2].passed) == (0, 0.3, False)


def test_deep_sources_give_no_symbols(spark):
    df = spark.createDataFrame([(1, "-" * 30_000 + "1"), (2, "(" * 5_000), (3, "def f(): pass")], "k long, text string")
    assert [(r.k, r.name) for r in I.symbols(df, "k", "text").collect()] == [(3, "f")]


def test_maps_and_persons(spark):
    row = spark.range(1).select(
        X.merged_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))).alias("m"), X.known_fields(F.create_map(F.lit("a"), F.lit(None).cast("int"), F.lit("b"), F.lit(1))).alias("k"),
        X.same_person(F.lit("ada"), F.lit("Ada Lovelace")).alias("one"), X.same_person(F.lit("Ada Byron"), F.lit("Ada Lovelace")).alias("two"), X.canonical_hash(a=F.lit(1), b=F.lit("x")).alias("h"), X.canonical_hash(b=F.lit("x"), a=F.lit(1)).alias("g"),
    ).first()
    assert row.m == {"a": 1, "b": 3} and row.k == {"b": 1} and row.one and not row.two and row.h == row.g


@pytest.mark.parametrize("most", [100_000, 0])
def test_held_and_joined_queries_agree(spark, monkeypatch, most):
    """A small set of queries is held by every task, a large one joined; equal vectors and copies tie by id."""
    monkeypatch.setattr(R, "MOST_HELD", most)
    items = spark.createDataFrame([(k, [float(k % 3), 1.0, 2.0]) for k in range(30)] + [(40, None), (41, [0.0, 0.0, 0.0])], "item_id long, vector array<double>")
    asking = spark.createDataFrame([(0, [0.0, 1.0, 2.0]), (50, [2.0, 1.0, 2.0])], "query_id long, query_vector array<double>")
    found = [(r.query_id, r.rank, r.item_id) for r in R.dense(asking, items, 3, exclude_self=True).collect()]
    assert sorted(found) == [(0, 1, 3), (0, 2, 6), (0, 3, 9), (50, 1, 2), (50, 2, 5), (50, 3, 8)]
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, "gamma"), (4, None)], "doc_id long, text string")
    queries = spark.createDataFrame([("q", "beta beta delta"), ("r", "zeta")], "query_id string, query_text string")
    ranked = R.bm25(queries, docs, T.code_tokens, 3).collect()
    assert [(r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in sorted(ranked, key=lambda r: r.rank)] == [("q", 1, 1, 1.0), ("q", 2, 2, 1.0)]
