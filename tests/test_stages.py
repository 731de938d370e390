"""Rerankers by type, the context window, filters, blind sheets."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import stages as S

RANKED = "query_id long, rank int, item_id long, length double, age double"


def test_rerankers_by_type(spark):
    rows = [(q, k, 10 * q + k, float(k), float(-k)) for q in range(1, 6) for k in range(1, 4)]
    ranked = spark.createDataFrame(rows, RANKED)
    plan = spark.createDataFrame([(1, "longest", 2), (2, "none", 1), (3, "cohere", 1), (4, "", 1), (1 + 99, "longest", 1)], "query_id long, reranker_type string, keep int")
    found = S.reranked(ranked, plan, {"longest": F.col("length"), "newest": F.col("age")}).orderBy("query_id", "rank").collect()
    assert [(r.item_id, r["rank"], r.rank_before, r.rerank_score) for r in found if r.query_id == 1] == [(13, 1, 3, 3.0), (12, 2, 2, 2.0)]
    for q in (2, 3, 4, 5):
        assert [(r["rank"], r.rank_before, r.applied) for r in found if r.query_id == q] == [(k, k, False) for k in (1, 2, 3)]
    assert {r.query_id: r.error for r in found} == {1: None, 2: None, 3: "no reranker of type cohere", 4: None, 5: None}
    assert {r.query_id for r in found if r.applied} == {1}
    with pytest.raises(Exception, match="no reranker of type cohere"):
        S.reranked(ranked, plan, {"longest": F.col("length")}, strict=True).collect()
    assert S.reranked(ranked, plan.where("query_id != 3"), {"longest": F.col("length")}, strict=True).count() == 14
    assert [r.item_id for r in S.reranked(ranked.where("query_id = 1"), plan.withColumn("keep", F.lit(0)), {"longest": F.col("length")}).collect()] == [13]


def test_context_window(spark):
    prompts = spark.createDataFrame([("m", 100), ("m", None)], "model_id string, prompt_tokens long")
    assert [(r.headroom_tokens, r.checked) for r in S.context_checked(prompts, 28, 128).collect()] == [(0, True), (None, False)]
    with pytest.raises(Exception, match="prompt of 100 tokens and 29 for the answer exceed 128 of m"):
        S.context_checked(prompts, 29, 128).collect()


def test_filters_and_maps(spark):
    tasks = spark.createDataFrame([("a", "r", "x"), ("b", "r", "y"), ("c", "s", "x")], "task_id string, repository string, status string")
    names = lambda df: sorted(r.task_id for r in df.collect())
    assert names(S.filtered(tasks, repository="r", status="x")) == ["a"] and names(S.filtered(tasks, repository=None, status="")) == ["a", "b", "c"]
    assert spark.range(1).select(S.set_only(a=F.lit(1), b=F.lit(None), c=F.lit("x")).alias("m")).first().m == {"a": "1", "c": "x"}


def test_blind_sheets(spark, tmp_path):
    from siltstone.sources.files import rating_sheets

    units = spark.createDataFrame([(f"t{k % 4}", f"s{k % 3}", 0, f'answer "{k}",\nsecond line') for k in range(12)], "task_id string, system_id string, trial_index int, answer string")
    tasks = spark.createDataFrame([(f"t{k}", f"question {k}", "truth") for k in range(4)], "task_id string, query string, ground_truth string")
    blind = S.blinded(units)
    assert sorted(r.blind_id for r in blind.collect()) == [f"H{k:03d}" for k in range(1, 13)]
    assert [r.blind_id for r in blind.orderBy("task_id", "system_id").collect()] == [r.blind_id for r in S.blinded(units.repartition(5)).orderBy("task_id", "system_id").collect()]
    sheet, key = f"file://{tmp_path}/sheet", f"file://{tmp_path}/key"
    S.write_blind_sheet(blind, tasks, sheet, key)
    text = next((tmp_path / "sheet").glob("*.csv")).read_text()
    assert "s0" not in text and text.splitlines()[0].startswith('"blind_id","question"')
    back = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(sheet)
    assert sorted((r.blind_id, r.answer_to_rate) for r in back.collect()) == sorted((r.blind_id, r.answer) for r in blind.collect())
    filled = back.withColumns({d: F.when(F.col("blind_id") != "H003", F.lit(4)) for d in S.RATINGS}).select("blind_id", *S.RATINGS)
    filled.write.option("header", "true").csv(f"file://{tmp_path}/filled")
    keys = spark.read.option("header", "true").csv(key)
    rated = rating_sheets(spark, f"file://{tmp_path}/filled", keys, S.RATINGS).collect()
    assert len(rated) == 11 and {r.blind_id for r in rated} == {f"H{k:03d}" for k in range(1, 13)} - {"H003"}
    assert {(r.task_id, r.system_id) for r in rated} <= {(r.task_id, r.system_id) for r in units.collect()}
