import corpus_pipeline as P
from siltstone.llm.registry import QUERIES

from . import cases


def _tables(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_keep_the_columns(spark, tmp_path):
    docs = cases.clashing(cases.table(spark))
    folder = _tables(spark, tmp_path / "in", docs)
    before = docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == [*cases.table(spark, []).columns, *cases.CLASHING], name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert 0 < docs.count() <= 2 * before
    assert P.STAGES[-1][1](spark, docs, folder).agg({"length": "sum"}).first()[0] > 0


def test_run_on_an_empty_table(spark, tmp_path):
    assert P.run(spark, _tables(spark, tmp_path / "in", cases.table(spark, []))).count() == 0


def test_every_operator_is_registered():
    numbers = [int(n[2:].split("_")[0]) for n in QUERIES if n[:2] == "op" and n[2].isdigit()]
    assert list(dict.fromkeys(numbers)) == list(range(1, 14))
