"""What the findings of the fourth round were: small cases that went wrong before."""

import os

from pyspark.sql import functions as F

import __spark_entry__

QUERIES = __spark_entry__.queries()


def folder(spark, tmp_path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"file://{tmp_path}/{name}.parquet")
    return f"file://{tmp_path}"


def test_passages_within_words(spark, tmp_path):
    documents = [(1, "xalpha  beta\tgammay"), (2, "alpha beta gamma"), (3, "alphabeta"), (4, "one alph abet two"), (5, None), (None, "alpha beta gamma"), (2, "alpha beta gamma"), (6, "alpha\x0bbeta gamma")]
    benchmark = [(10, "alpha beta gamma"), (11, "pha"), (12, "pha beta"), (13, " "), (14, None), (15, "alpha beta gamma"), (15, "alpha beta gamma")]
    sf = folder(spark, tmp_path, documents=(documents, "doc_id long, text string"), benchmark=(benchmark, "item_id long, text string"))
    split = lambda t: " ".join(w for w in t.replace("\t", " ").replace(" ", " ").split(" ") if w)
    want = sorted(((i, d) for i, b in benchmark for d, t in documents if b is not None and t is not None and split(b) in split(t)), key=repr)
    assert sorted(map(tuple, QUERIES["passage_containment"](spark, sf).collect()), key=repr) == want


def test_arriving_files_stay_small(spark, tmp_path, monkeypatch):
    from siltstone.plans import run_queries
    from siltstone.sources import storage

    at = []
    monkeypatch.setattr(storage, "shared_path", lambda s, name, real=storage.shared_path: at.append(real(s, name)) or at[-1])
    n = 4 * run_queries.FILE_ROWS
    spark.range(n, numPartitions=1).selectExpr("id as doc_id", "repeat('x', 10) as text").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert QUERIES["arrived_items"](spark, f"file://{tmp_path}").count() == n
    arriving = next(p for p in at if "/arriving-" in p).removeprefix("file://")
    sizes = [sum(1 for _ in open(f"{d}/{f}")) for d, _, names in os.walk(arriving) for f in names if f.endswith(".json")]
    assert sum(sizes) == n and max(sizes) <= run_queries.FILE_ROWS


def test_term_stats_exchange_no_postings(spark):
    from siltstone.functions.text import code_tokens_of
    from siltstone.operators import retrieval as R

    docs = [(k, " ".join(f"w{(k * j) % 17}" for j in range(k % 30))) for k in range(400)] + [(None, "aa bb"), (None, "bb"), (7, "w1 w1 zz"), (900, None)]
    want = {}
    merged = {}
    for k, text in docs:
        merged.setdefault(k, []).extend(code_tokens_of(text))
    for tokens in merged.values():
        for t in set(tokens):
            n, row = tokens.count(t), want.get(t, (0, 0, 0))
            want[t] = (row[0] + 1, row[1] + n, max(row[2], n))
    found = R.term_stats(spark.createDataFrame(docs, "doc_id long, text string"), code_tokens_of)
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == want
    plain = R.term_stats(spark.createDataFrame([d for d in docs if d[0] not in (None, 7)], "doc_id long, text string"), code_tokens_of)
    assert "Generate" not in plain._jdf.queryExecution().executedPlan().toString() and plain.count() > 0


def test_codes_keep_the_order_of_ids(spark):
    from siltstone.plans import graph_queries as Q

    keys = [0, 1, 9, 10, 11, 100, 19, 2, 20, 119, 12, 120, 999999, 10**14, 10**15 - 1, -1, -10, -9, -100]
    df = spark.createDataFrame([(k, kind) for k in keys for kind in "cops"], "k long, kind string")
    coded = df.withColumn("c", F.coalesce(*(F.when(F.col("kind") == x, Q.code(x, F.col("k"))) for x in "cops"))).withColumn("name", Q.code_name(F.col("c"))).collect()
    assert all(r.name == f"file:{r.kind}:{r.k}" for r in coded) and len({r.c for r in coded}) == len(coded)
    assert [r.name for r in sorted(coded, key=lambda r: r.c)] == sorted(r.name for r in coded)


def test_a_seed_takes_no_more_of_a_large_node_than_it_can_hold(spark):
    from siltstone.operators import graph_context as C

    n = 300
    nodes = spark.createDataFrame([(f"n{k:03}", "File") for k in range(n)], "node_id string, label string")
    edges = spark.createDataFrame([("n000", f"n{k:03}", "HAS") for k in range(1, n)] * 2, "src string, tgt string, rel string")
    found = C.shortest_paths(nodes.where("node_id > 'n289'").select(F.col("node_id").alias("seed")), edges, nodes, 2, 5)
    rows = sorted((r.seed, r.place, r.node_id, len(r.paths)) for r in found.collect())
    assert rows == sorted((f"n{s}", place, node, 1) for s in range(290, 300) for place, node in enumerate(["n000", "n001", "n002", "n003", "n004"], 1))
    assert found.where("place > 1").select(F.max(F.size(F.col("paths")[0])).alias("n")).first().n == 2


def test_sizes_are_those_of_the_subgraphs_and_roots_meet_once(spark):
    from siltstone.operators import graph_context as C
    from siltstone.plans import graph_queries as Q

    nodes = spark.createDataFrame([(k, "File" if k % 5 else "Other") for k in range(40)], "node_id long, label string")
    pairs = [(k % 41, (k * 7 + 3) % 43, "HAS" if k % 2 else "FROM") for k in range(120)] * 2
    edges = spark.createDataFrame(pairs, "src long, tgt long, rel string")
    roots = spark.createDataFrame([(k,) for k in (0, 3, 7, 39, 50)], "root long")
    near, kept = (x.groupBy("root").count().collect() for x in C.subgraph(roots, edges, nodes))
    assert {(r.root, r.n_nodes, r.n_edges) for r in C.subgraph_sizes(roots, edges, nodes).collect()} == {(r.root, r["count"], dict(map(tuple, kept)).get(r.root, 0)) for r in near}
    step = {(a, b) for s, t, _ in pairs for a, b in ((s, t), (t, s)) if a < 40 and b < 40}
    want = {(r, n) for r in (0, 3, 7, 39) for n in range(40) if n != r and n % 5 and ((r, n) in step or any((r, m) in step and (m, n) in step for m in range(40)))}
    found = C.related_files(roots, edges, nodes)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    keys = spark.createDataFrame([(k,) for k in (0, 5, -3, 10**16)], "k long")
    assert all(r.a == f"file:s:{r.k}" for r in keys.select("k", Q.number_name(Q.number("s", F.col("k"))).alias("a")).collect())
