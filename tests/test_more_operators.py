"""Further hand-computed cases."""

import json

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions.embedding import hashed_embedding
from siltstone.operators import constraints as V
from siltstone.operators import gate as G
from siltstone.operators import graph as K
from siltstone.operators import retrieval as R
from siltstone.plans import adaptive, pipeline_queries
from siltstone.sources import files, storage


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_graph_context_is_bounded_and_new(spark):
    ranked = spark.createDataFrame([("q", 1, "a", 0.9), ("q", 2, "b", 0.8)], "query_id string, rank int, item_id string, score double")
    related = spark.createDataFrame([("a", x, 1, n) for n, x in enumerate("bcdef")] + [("b", x, 1, n) for n, x in enumerate("cghi")], "item_id string, other_id string, hop int, priority int")
    out = adaptive.with_graph_context(ranked, related).orderBy("rank").collect()
    assert [(r.rank, r.item_id, r.score, r.is_graph) for r in out] == [(1, "a", 0.9, False), (2, "b", 0.8, False), (3, "c", 0.0, True), (4, "d", 0.0, True), (5, "g", 0.0, True), (6, "h", 0.0, True)]


def test_rungs_take_only_what_failed(spark):
    plan = spark.createDataFrame([(str(k), "x", "hybrid", 7, 0.6, 0.7, 0.3, 0, 7, 0) for k in range(4)], "query_id string, query_text string, mode string, top_k int, threshold double, dense_weight double, sparse_weight double, rerank_top_n int, max_context int, graph_hops int")
    out = adaptive.until_passed(plan, lambda p, rung: p.select("query_id", "top_k", (F.col("query_id") <= str(rung)).alias("passed")))
    assert sorted((r.query_id, r.rung, r.top_k, r.passed) for r in out.where("passed").collect()) == [("0", 0, 7, True), ("1", 1, 10, True), ("2", 2, 16, True), ("3", 3, 30, True)]
    assert out.count() == 4 + 3 + 2 + 1


def test_scores(spark):
    assert one(spark, G.groundedness(F.lit("x SUPPORTED BY EVIDENCE"), F.lit(True), F.lit(0.5))) == pytest.approx(0.7 * 1.0 + 0.15)
    assert one(spark, G.answer_relevance(F.lit("how does routing work"), F.lit("Routing works"))) == pytest.approx(0.4 + 0.6 * 2 / 4)
    assert one(spark, G.answer_relevance(F.lit("how"), F.lit(" "))) == 0.5
    assert one(spark, G.suite_score(F.lit(0.9), F.lit(None).cast("double"), F.lit(0.6))) == pytest.approx(0.5)
    assert one(spark, G.evidence_consistency(F.lit("It does not contain A.py."), F.array(F.lit("a.py"), F.lit("b.py")))) == pytest.approx(0.6)
    assert one(spark, G.citation_grounding(F.lit("x"), F.lit(3), F.lit(2), F.lit(1), F.lit(0.4))) == pytest.approx(0.55)
    out = spark.createDataFrame([(True, True, 0, None, 0.0, None), (False, True, 2, 0.5, 1.0, True), (False, False, 0, None, None, None)], "refusal boolean, has_label boolean, n_citations int, precision double, recall double, supported boolean")
    assert tuple(G.outcome_rates(out).first()) == (pytest.approx(1 / 3), 0.0, 0.5, 0.5)


def test_text_predicates(spark):
    paths = {"src/app.py": False, "tests/x.py": True, "src/test_a.py": True, "a/b.spec.ts": True, "Spec/readme.md": True}
    assert {p: one(spark, T.is_test_file(F.lit(p))) for p in paths} == paths
    found = one(spark, T.loose_citations(F.lit("see src/a.py:L3-L9, `b.md` ```c.py```")))
    assert [tuple(c) for c in found] == [("src/a.py", 3, 9), ("b.md", None, None)]


def test_graph_tables(spark):
    nodes = spark.createDataFrame([("a", "File", 1), ("b", "File", 1)], "node_id string, label string, version int")
    newer = K.upsert_nodes(nodes, spark.createDataFrame([("b", "Test", 2)], nodes.schema))
    assert sorted((r.node_id, r.label) for r in newer.collect()) == [("a", "File"), ("b", "Test")]
    edges = spark.createDataFrame([("a", "b", "R", 2, "late"), ("a", "b", "R", 1, "early"), ("a", "a", "R", 0, "loop"), ("a", "z", "R", 0, "gone")], "src string, tgt string, rel string, at int, note string")
    assert [tuple(r) for r in K.assemble(edges, nodes, F.col("at")).collect()] == [("a", "b", "R", 1, "early")]
    left, edges_left = K.delete_nodes(nodes, edges, nodes.where("node_id = 'b'"))
    assert [r.node_id for r in left.collect()] == ["a"] and sorted(r.tgt for r in edges_left.collect()) == ["a", "z"]


def test_rules(spark):
    d = spark.createDataFrame([(1, "approve", {"a": True, "b": True, "c": True, "d": True}, None), (2, "approve", {"a": True, "b": False, "c": True, "d": True}, None), (3, "reject", {"a": True, "b": True, "c": True, "d": True}, "why")], "id int, decision string, checks map<string,boolean>, note string")
    assert sorted(map(tuple, V.broken(d, "id", V.decision_rules(F.col("decision"), F.col("checks"), F.col("note"))).collect())) == [(2, "approval_passes_all"), (3, "else_explained")]
    m = spark.createDataFrame([(1, 1.0, "measured", "meter"), (2, None, None, "not_available"), (3, None, "measured", "meter")], "id int, v double, p string, m string")
    assert sorted(map(tuple, V.broken(m, "id", V.metric_rules(F.col("v"), F.col("p"), F.col("m"))).collect())) == [(3, "method_of_missing"), (3, "provenance_iff_value")]
    a, b = spark.createDataFrame([("x", "1"), ("y", "2")], "field string, value string"), spark.createDataFrame([("x", "1"), ("z", "3")], "field string, value string")
    assert sorted(r.field for r in V.drift(a, b).collect()) == ["y", "z"]


def test_rerank_keeps_the_rank_before(spark):
    ranked = spark.createDataFrame([("q", 1, "flask app", "x"), ("q", 2, "route map", "x"), ("q", 3, "url route map", "x")], "query_id string, rank int, content string, query string").withColumn("query", F.lit("url route"))
    relevance = R.lexical_relevance(F.col("query"), F.col("content"), T.code_tokens)
    out = R.rerank(ranked, relevance, 2).orderBy("rank").collect()
    assert [(r.rank, r.rank_before, r.rerank_score) for r in out] == [(1, 3, 1.0), (2, 2, 0.5)]


def test_more_sources(spark, tmp_path):
    (tmp_path / "tasks.json").write_text(json.dumps({"tasks": [{"id": "a", "n": 1}, {"id": "b", "n": 2}]}))
    assert [tuple(r) for r in files.json_items(spark, f"{tmp_path}/tasks.json", "tasks", "id string, n int").collect()] == [("a", 1), ("b", 2)]
    (tmp_path / "sheet.csv").write_text("blind_id,clarity,depth\n1,4,5\n2,,3\n3,1,1\n")
    key = spark.createDataFrame([("1", "sys")], "blind_id string, system_id string")
    assert [tuple(r) for r in files.rating_sheets(spark, f"{tmp_path}/sheet.csv", key, ("clarity", "depth")).collect()] == [("1", 4, 5, "sys")]
    storage.write_partitioned(spark.range(10).withColumn("k", F.col("id") % 2), f"{tmp_path}/out", "k")
    assert spark.read.parquet(f"{tmp_path}/out").where("k = 1").count() == 5
    with pytest.raises(Exception, match="vector is null"):
        new = spark.createDataFrame([(1, None)], "id long, vector string")
        storage.upsert(new.limit(0), new, "id", "vector").collect()


def test_hashed_embeddings_have_length_one(spark):
    rows = spark.createDataFrame([(["a", "b", "a"],), ([],), (None,)], "t array<string>").select(hashed_embedding("t").alias("v")).collect()
    assert sum(x * x for x in rows[0].v) == pytest.approx(1.0, abs=1e-6) and rows[1].v is None and rows[2].v is None


def test_streams_count_rows_of_many_files_in_any_order(spark, tmp_path):
    days = [(7 * k) % 71 for k in range(280)]
    rows = [(k, 1, f"2024-01-01 {k % 24:02d}:00:00", "view", float(day), day) for k, day in enumerate(days)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string, value double, day int")
    df = df.withColumn("ts", F.col("ts").cast("timestamp") + F.make_dt_interval("day")).drop("day")
    for part in df.randomSplit([1.0] * 4, 1):
        part.repartition(70).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    assert len(list((tmp_path / "events.parquet").glob("part-*"))) > 3 * 64
    found = pipeline_queries.QUERIES["stream_tumbling"](spark, str(tmp_path)).collect()
    assert sum(r.n for r in found) == 280
    found = pipeline_queries.QUERIES["stream_sliding"](spark, str(tmp_path)).collect()
    assert sum(r.n for r in found) == 560
