"""Hand-computed cases of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions import vectors as W
from siltstone.operators import classify as C
from siltstone.operators import constraints as V
from siltstone.operators import gate as G
from siltstone.operators import graph as K
from siltstone.operators import ingest as I
from siltstone.operators import retrieval as R
from siltstone.operators import stats as S
from siltstone.operators import trials as A
from siltstone.sources import files, storage


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_code_tokens(spark):
    assert one(spark, T.code_tokens(F.lit("HTTPServer add_url_rule src/app.py x"))) == ["httpserver", "http", "server", "add_url_rule", *["add", "url", "rule"] * 2, "src/app.py", *["src", "app", "py"] * 2]
    assert one(spark, T.code_tokens(F.lit(None).cast("string"))) == []


def test_normalising_and_citations(spark):
    assert one(spark, T.normalize_text(F.lit("\ufeffa\r\nb\rc\x00"))) == "a\nb\nc"
    answer = F.lit("see [./src/a.py:L12-L9] and [docs/b.md] ```[x/y.py:L1]``` [`c.py:7`]")
    assert [tuple(c) for c in one(spark, T.line_citations(answer))] == [("src/a.py", 9, 12), ("c.py", 7, 7)]
    assert one(spark, T.file_citations(answer)) == ["docs/b.md"]
    assert one(spark, T.module_name(F.lit("src/pkg/__init__.py"))) == "pkg" and one(spark, T.module_name(F.lit("lib/a/b.py"))) == "a.b"


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert one(spark, W.cosine(a, b)) == pytest.approx(0.96) and one(spark, W.euclid(a, b)) == pytest.approx(math.sqrt(2))
    assert one(spark, W.unit(a)) == pytest.approx([0.6, 0.8]) and one(spark, W.unit(F.array(F.lit(0.0)))) is None


def test_ir_metrics_by_hand(spark):
    ranked = spark.createDataFrame([("q", 1, None), ("q", 2, "a"), ("q", 3, None), ("q", 4, "b")], "query_id string, rank int, target string")
    relevant = spark.createDataFrame([("q", 2), ("none", 2), ("nothing", 0)], "query_id string, n_relevant long")
    m = {r.query_id: r for r in R.ir_metrics(ranked, relevant, (1, 3, 5)).collect()}
    q = m["q"]
    assert (q.mrr, q.recall_1, q.recall_3, q.recall_5) == (0.5, 0.0, 0.5, 1.0)
    assert q.precision_3 == pytest.approx(1 / 3) and q.precision_5 == pytest.approx(2 / 5)
    assert q.ndcg_3 == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert m["none"].mrr == m["nothing"].recall_3 == 0.0


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([(1, "def route add_url_rule route"), (2, "class FastAPI get"), (3, "Quickstart Guide minimal Flask application")], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "how does add_url_rule work in route"), (1, "")], "query_id long, query_text string")
    found = R.bm25(queries, docs, T.code_tokens, 3).collect()
    assert [(r.query_id, r.doc_id, r.score) for r in found] == [(0, 1, 1.0)]
    lists = "query_id long, item_id long, rank int, score double"
    a, b = spark.createDataFrame([(0, 1, 1, 0.9), (0, 2, 2, 0.5)], lists), spark.createDataFrame([(0, 2, 1, 1.0), (0, 3, 2, 0.9)], lists)
    fused = R.fuse(a, b, F.lit(0.7), F.lit(0.3), F.lit(0.3), F.lit(5)).orderBy("rank").collect()
    assert [(r.item_id, round(r.score, 4)) for r in fused] == [(2, 0.65), (1, 0.63)]


def test_classification(spark):
    q = spark.createDataFrame([("Diagnose this traceback in production",), ("Why is the sky",), ("cve injection attack",), ("hello",)], "query_text string")
    out = [(r.task_type, r.criticality, r.strategy, r.tier) for r in C.route_tier(C.resolve_strategy(C.classify(q))).collect()]
    assert out == [
        ("error_analysis", "high", "hybrid_reranked", "large"),
        ("code_explanation", "medium", "hybrid", "medium"),
        ("repository_assistance", "critical", "graph_augmented_reranked", "large"),
        ("repository_assistance", "low", "hybrid", "small"),
    ]
    plan = C.strategies(spark).where("strategy = 'hybrid'")
    assert [tuple(C.escalate(plan, k).select("top_k", "max_context", "mode").first()) for k in range(4)] == [(7, 7, "hybrid"), (10, 10, "hybrid"), (13, 13, "graph_augmented"), (30, 20, "graph_augmented")]


def test_gate_cases(spark):
    rows = [("mean", "PASSED", 0.8, 1.0), ("mean", "FAILED", 0.4, 1.0), ("veto", "PASSED", 1.0, 9.0), ("veto", "FAILED", 0.0, 1.0), ("skip", "SKIPPED", 0.1, 1.0), ("skip", "PASSED", 0.9, 1.0), ("null", "ERROR", None, 1.0)]
    out = {r.task_id: (r.gate_score, r.passed) for r in G.gate(spark.createDataFrame(rows, "task_id string, status string, score double, weight double"), F.lit(0.6)).collect()}
    assert out == {"mean": (pytest.approx(0.6), True), "veto": (0.9, False), "skip": (0.9, True), "null": (None, False)}


def test_outcomes(spark):
    answers = spark.createDataFrame([("t", "[src/flask/ctx.py:L370-L372] and [docs/a.md:L1-L3]"), ("none", "nothing"), ("no", "INSUFFICIENT EVIDENCE"), ("unlabelled", "[a.py:L1]")], "task_id string, answer string")
    spans = spark.createDataFrame([(k, "src/flask/ctx.py", a, b) for k in ("t", "none", "no") for a, b in ((367, 394), (396, 431))], "task_id string, file string, span_start long, span_end long")
    out = {r.task_id: r for r in G.outcomes(answers, spans).collect()}
    assert (out["t"].precision, out["t"].recall, out["t"].supported) == (0.5, 0.5, True)
    assert (out["none"].supported, out["no"].supported, out["unlabelled"].recall) == (False, None, None)


def test_token_f1(spark):
    assert one(spark, G.token_f1(F.lit("a b c"), F.lit("b c d"))) == pytest.approx(2 / 3)
    assert one(spark, G.token_f1(F.lit("a"), F.lit(None).cast("string"))) is None and one(spark, G.token_f1(F.lit("a"), F.lit("z"))) == 0.0


def test_statistics_by_hand(spark):
    rows = [("a", "t1", 1.0), ("a", "t1", 0.0), ("a", "t2", None), ("b", "t1", 0.5)]
    means = S.task_means(spark.createDataFrame(rows, "system_id string, task_id string, value double"), "value")
    assert sorted(map(tuple, means.collect())) == [("a", "t1", 0.5), ("b", "t1", 0.5)]
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    flags = [("a", f"t{k}", k < 8) for k in range(10)] + [("b", f"t{k}", k >= 8) for k in range(10)]
    m = S.discordant(spark.createDataFrame(flags, "system_id string, task_id string, passed boolean"), pairs).first()
    assert (m.only_a, m.only_b) == (8, 2) and m.p_value == pytest.approx(0.109375)
    p = spark.createDataFrame([("x", 0.01), ("y", 0.04), ("z", 0.03), ("w", None)], "name string, p_value double").withColumn("family", F.lit(1))
    assert {r.name: r.p_adjusted for r in S.holm(p, "family").collect()} == {"x": pytest.approx(0.03), "y": pytest.approx(0.06), "z": pytest.approx(0.06), "w": None}
    d = [("a", f"t{k}", 0.0) for k in range(2)] + [("b", "t0", 1.0), ("b", "t1", -2.0)]
    r = S.compare(spark.createDataFrame(d, "system_id string, task_id string, value double"), pairs).first()
    assert r.rank_biserial == pytest.approx(-1 / 3)
    assert one(spark, S.min_detectable_effect(F.lit(24), F.lit(0.2))) == pytest.approx(2.801585 * 0.2 / math.sqrt(24 * 0.955))
    interval = S.bootstrap_mean(spark.range(200).select((F.col("id") % 10).cast("double").alias("v"), "id", F.lit("g").alias("g")), "v", "g", draws=200).first()
    assert interval.low < 4.5 < interval.high


def test_costs_by_hand(spark):
    t = spark.createDataFrame([(0.10, True), (0.20, False), (0.30, None), (0.40, True)], "g double, ok boolean")
    r = A.per_success(t.where("ok is not null or g > 0"), F.col("ok"), F.col("g"), extra=A.carbon(F.lit(3600.0), F.lit(713.0))).first()
    assert r.cost_per_success == pytest.approx(1.713 / 2) and r.success_rate == pytest.approx(2 / 3)
    assert A.per_success(t.where("ok = false"), F.col("ok"), F.col("g")).first().cost_per_success is None
    prices = spark.createDataFrame([("gpt-4o", 0, 2.5, 10.0), ("gpt-4o-mini", 1, 0.1, 0.6)], "name string, position int, input_price double, output_price double")
    models = spark.createDataFrame([("gpt-4o-mini-x",), ("gpt-4o-mini",), ("llama",)], "model_id string")
    assert {r.model_id: r.input_price for r in A.price(models, prices).collect()} == {"gpt-4o-mini-x": 2.5, "gpt-4o-mini": 0.1, "llama": 1.0}
    points = spark.createDataFrame([(1, 0.5, 1.0), (2, 0.6, 2.0), (3, 0.6, 3.0), (4, 0.4, 0.5), (5, 0.5, 1.0)], "id int, q double, c double")
    assert sorted(r.id for r in A.pareto(points, "q", "c").collect()) == [1, 2, 4, 5]


def test_graph(spark):
    commits = [(k, f) for k, fs in enumerate((["a", "b"], ["a", "b"], ["a", "c"], ["a", "c"], *[["c"]] * 6)) for f in fs]
    co = K.co_changed(spark.createDataFrame(commits, "group_id long, item string")).where("a = 'a'").orderBy(F.desc("cosine"), F.desc("n"), "b").collect()
    assert [(r.b, r.n) for r in co] == [("b", 2), ("c", 2)]
    nodes = spark.createDataFrame([("x", "File"), ("y", "File"), ("hub", "Repository"), ("z", "File")], "node_id string, label string")
    edges = spark.createDataFrame([("hub", "x", "CONTAINS"), ("hub", "z", "CONTAINS"), ("x", "y", "IMPORTS"), ("x", "gone", "IMPORTS")], "src string, tgt string, rel string")
    assert K.valid_edges(edges, nodes).count() == 3 and K.dangling_edges(edges, nodes).count() == 1
    assert [tuple(r) for r in K.expand(spark.createDataFrame([("x",)], "seed string"), K.valid_edges(edges, nodes), nodes, 3).collect()] == [("x", "y", 1)]
    names = spark.createDataFrame([("pkg.core.Engine",), ("other.x",)], "name string")
    modules = spark.createDataFrame([("pkg", "p.py"), ("pkg.core", "c.py")], "module string, file string")
    assert [tuple(r) for r in K.longest_prefix(names, modules).collect()] == [("pkg.core.Engine", "pkg.core", "c.py")]


def test_chunks_cover_every_line(spark):
    text = "\n".join(f"line {k} " + "word " * (k % 30) for k in range(200)) + "\n\n" + "long " * 700
    chunks = I.chunk(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, text string"), "id", "text", 64).collect()
    lines = text.split("\n")
    assert {c.id for c in chunks} == {1} and max(c.token_count for c in chunks) <= 64
    covered = {n for c in chunks for n in range(c.start_line, c.end_line + 1)}
    assert covered >= {n for n, x in enumerate(lines, 1) if x.strip()}
    assert [c.chunk_index for c in chunks] == list(range(len(chunks)))


def test_symbols(spark):
    source = "import os\nfrom .core import helper as h\nclass A:\n    @d\n    def run(self):\n        return h()\ndef test_x():\n    pass\n"
    found = I.symbols(spark.createDataFrame([(1, source), (2, "def broken(")], "id long, text string"), "id", "text").collect()
    assert {(r.kind, r.name, r.start_line) for r in found if r.kind != "call"} == {("import", "os", 1), ("import", "h", 2), ("class", "A", 3), ("method", "A.run", 4), ("test", "test_x", 7)}
    assert [(r.name, r.target) for r in found if r.kind == "call"] == [("A.run", "h")]


def test_constraints(spark):
    df = spark.createDataFrame([(1, "a.py", 3, 2), (2, "/a.py", None, None), (3, "a.py", 1, None), (4, "b.py", 1, 1)], "id long, path string, a int, b int")
    assert sorted(map(tuple, V.broken(df, "id", V.span_rules(F.col("path"), F.col("a"), F.col("b"))).collect())) == [(1, "lines_in_order"), (2, "relative_path"), (3, "lines_both_or_neither"), (3, "lines_in_order")]
    d = spark.createDataFrame([("i", "r", "approve", 1), ("i", "r", "reject", 2), ("j", "r", "approve", 1)], "item_id string, reviewer string, decision string, seq int")
    assert {r.item_id: r.status for r in V.review_status(d).collect()} == {"i": "rejected", "j": "approved"}


def test_sources(spark, tmp_path):
    for path, text in {"src/a.py": "x = 1", "node_modules/b.js": "no", ".hidden/c.py": "no", "README.md": "# hi", "empty.py": "", "vendor/d.py": "no", "site-packages/e.tsx": "yes", "logo.png": "no"}.items():
        (tmp_path / "tree" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / path).write_text(text)
    (tmp_path / "tree" / "odd.txt").write_bytes(b"caf\xe9")
    found = files.SOURCES.load("tree", spark, f"{tmp_path}/tree", "acme/x")
    assert files.count_sources(spark, f"{tmp_path}/tree") == 4
    assert [r.text for r in found.collect() if r.path == "odd.txt"] == ["caf\ufffd"]
    assert sorted((r.path, r.language) for r in found.collect()) == [("README.md", "other"), ("odd.txt", "other"), ("site-packages/e.tsx", "typescript"), ("src/a.py", "python")]
    (tmp_path / "log").write_text("abc\x1fme\x1f2024\x1ffix\x1fa.py\nb.py\x1ebroken\x1e")
    assert files.commit_log(spark, f"{tmp_path}/log").first().files == ["a.py", "b.py"]
    (tmp_path / "events.jsonl").write_text('{"a": 1}\n{"a": 2}\n{"a": ')
    assert sorted(r.a for r in files.json_log(spark, f"{tmp_path}/events.jsonl", "a long").collect()) == [1, 2]
    with pytest.raises(KeyError):
        files.SOURCES.load("nowhere")
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = storage.upsert(old, spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string"), "id")
    assert sorted(map(tuple, storage.delete(new, old.where("id = 1"), "id").collect())) == [(2, "c"), (3, "d")]
