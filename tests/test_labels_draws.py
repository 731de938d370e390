"""Labels and borrowed lines, sums of draws, retrieval modes."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import classify as C
from siltstone.operators import draws as D
from siltstone.operators import labels as L
from siltstone.plans import adaptive

EVIDENCE = "task_id string, place int, file_path string, line_start long, line_end long"
SPANS = "task_id string, file string, start_line long, end_line long"


def test_labels_from_json(spark):
    texts = [
        json.dumps({"task_id": "a", "relevant_files": ["x.py"], "required_evidence": [{"file": "x.py", "start_line": 1, "end_line": 3, "chunk_ids": ["c1", "c2"]}, {"file": "x.py", "start_line": 9, "end_line": 9, "chunk_ids": ["c2"]}]}),
        json.dumps({"task_id": "b", "relevant_files": [], "required_evidence": [{"file": "y", "start_line": 2, "end_line": 2}]}),
        json.dumps({"task_id": "c", "relevant_files": ["z"], "alternative_files": ["w"], "required_evidence": []}), "no label", None,
    ]
    got = {r.task_id: (r.relevant_files, r.alternative_files, [tuple(s) for s in r.spans], r.n_relevant_chunks) for r in L.parsed_labels(spark.createDataFrame([(t,) for t in texts], "t string"), F.col("t")).collect()}
    assert got == {"a": (["x.py"], [], [("x.py", 1, 3), ("x.py", 9, 9)], 2), "b": ([], [], [("y", 2, 2)], None), "c": (["z"], ["w"], [], None)}


def test_borrowed_lines(spark):
    cited = spark.createDataFrame([("t", 1, "a.md", 4, None), ("t", 2, "a.md", None, None), ("t", 3, "b.md", 0, 7), ("t", 4, None, 1, 2), ("t", 5, "", None, None), ("u", 1, "a.md", 2, 5)], EVIDENCE)
    spans = spark.createDataFrame([("t", "a.md", 10, 12), ("t", "a.md", 20, 22), ("t", "b.md", 5, 5), ("u", "a.md", 1, 1)], SPANS)
    got = sorted((r.task_id, r.place, r.file, r.start_line, r.end_line, r.from_label) for r in L.borrowed_evidence(cited, spans).collect())
    assert got == [("t", 1, "a.md", 4, 4, False), ("t", 2, "a.md", 10, 12, True), ("t", 2, "a.md", 20, 22, True), ("t", 3, "b.md", 5, 5, True), ("u", 1, "a.md", 2, 5, False)]
    with pytest.raises(Exception, match="t cites b.md without line numbers and no label covers it"):
        L.borrowed_evidence(cited, spans.where("file = 'a.md'")).collect()


def test_one_row_or_none_at_all(spark):
    rows, table = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, L.looked_up(rows, table, "k").collect())) == [("a", 1), ("b", 2)]
    for key, n in (("c", 2), ("d", 0)):
        with pytest.raises(Exception, match=f"not exactly one row of k {key}: {n}"):
            L.looked_up(spark.createDataFrame([(key,)], "k string"), table, "k").collect()


def test_promotion(spark):
    tasks = spark.createDataFrame([("a", "candidate", None), ("b", "candidate", None)], "task_id string, status string, human_approved_by string")
    evidence = spark.createDataFrame([("a", 1), ("a", 2)], "task_id string, n int")
    assert [tuple(r) for r in L.promoted(tasks.where("task_id = 'a'"), evidence, "Ada").collect()] == [("a", "approved", "Ada")]
    with pytest.raises(Exception, match="no evidence to approve b"):
        L.promoted(tasks, evidence, "Ada").collect()


def test_draws(spark, monkeypatch):
    values = [5, 1, 1, None, 8, 2, 2, 2, 13]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    ordered = np.array(sorted(v for v in values if v is not None), float)
    want = sum(ordered[(D.drawn(42, 3, np.arange(500), p) % np.uint64(len(ordered))).astype(int)] for p in range(3))
    held = D.drawn_sums(df, "v", 3, 500)
    assert [r.total for r in held.orderBy("draw").collect()] == want.tolist()
    monkeypatch.setattr(D, "MOST_HELD", 3)
    assert [r.total for r in D.drawn_sums(df.repartition(4), "v", 3, 500).orderBy("draw").collect()] == want.tolist()
    assert D.drawn_sums(df.where("v is null"), "v", 3).collect() == []
    assert D.worst_case(df, "v", 2, 1.0).first()[0] == 22.0
    monkeypatch.undo()
    even = [D.drawn_sums(df, "v", 1, 20_000).agg(F.avg("total")).first()[0]]
    assert abs(even[0] - ordered.mean()) < 0.15


def test_modes(spark):
    q = spark.createDataFrame([(1, "code_generation", "low"), (2, "architecture_qa", "low"), (3, "error_analysis", "critical"), (4, "unheard_of", "low")], "query_id long, task_type string, criticality string")
    got = lambda df: {r.query_id: (r.strategy, r.mode, r.top_k, r.use_graph) for r in df.collect()}
    assert got(adaptive.planned(q, "B")) == {k: ("hybrid", "hybrid", 7, False) for k in range(1, 5)}
    d = got(adaptive.planned(q))
    assert d[3] == ("graph_augmented_reranked", "graph_augmented", 12, True) and d[4][0] == "hybrid" and d[2][3]
    c = got(adaptive.planned(q, "C"))
    assert c[3] == ("graph_augmented_reranked", "hybrid", 12, False) and c[2][1:] == ("hybrid", 7, False)
    names = spark.createDataFrame([(1, "sparse"), (2, "dense")], "query_id long, strategy string")
    config = C.strategies(spark).where("strategy = 'dense_fast'").drop("strategy").select(F.lit(2).cast("long").alias("query_id"), F.lit("dense_esc1").alias("strategy"), "*")
    own = got(adaptive.planned(q, "D", names, config))
    assert own[1][:2] == ("sparse", "sparse") and own[2] == ("dense_esc1", "dense", 3, False)
    assert got(adaptive.planned(q, "B", names, config))[1][0] == "hybrid"
    with pytest.raises(Exception, match="no strategy named nonesuch"):
        adaptive.planned(q, "D", spark.createDataFrame([(1, "nonesuch")], "query_id long, strategy string")).collect()
    with pytest.raises(ValueError, match="no mode A"):
        adaptive.planned(q, "A")
    assert {r.query_id: r.strategy for r in C.route_by_type(q).collect()} == {1: "dense", 2: "graph_augmented", 3: "hybrid", 4: "hybrid"}
    assert {r.strategy for r in C.route_by_type(q, "mine").collect()} == {"mine"}
    with pytest.raises(Exception, match="no strategy named mine"):
        C.route_by_type(q, "mine", ("hybrid",)).collect()
