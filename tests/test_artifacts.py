"""Artifacts of several sources and the graph of their history."""

from pyspark.sql import functions as F

from siltstone.operators import artifacts as A
from siltstone.operators import graph_context as C
from siltstone.operators import source_graph as G

REPO = "pallets/flask"


def frames(spark):
    commits = spark.createDataFrame([(REPO, "4aa68d5", "A", "a@x", "2024-01-01", "fix ctx push", ["src/flask/ctx.py", "src/flask/gone.py"]), (REPO, None, None, None, None, None, None)], "repository string, sha string, author string, email string, time string, subject string, files array<string>")
    pulls = spark.createDataFrame([(REPO, 456, "Fix ctx", "Body.", "4aa68d5", ["src/flask/ctx.py"]), (REPO, 457, "Open", None, None, None)], "repository string, number long, title string, body string, merge_sha string, files array<string>")
    issues = spark.createDataFrame([(REPO, 123, "ctx bug", "It breaks.", "4aa68d5", ["456", "999"]), (REPO, 124, "other", None, "", [])], "repository string, number long, title string, body string, resolved_by string, pulls array<string>")
    decisions = spark.createDataFrame([(REPO, "ADR-1", "Contexts", "src/flask/ctx.py"), (REPO, "ADR-2", "None", None)], "repository string, decision_id string, title string, path string")
    incidents = spark.createDataFrame([(REPO, "I-1", "Down", ["4aa68d5"])], "repository string, incident_id string, title string, commits array<string>")
    files = spark.createDataFrame([(REPO, "src/flask/ctx.py", "class AppContext:\n    pass\n")], "repository string, path string, content string")
    return commits, pulls, issues, decisions, incidents, files


def test_history(spark):
    *history, files = frames(spark)
    existing, _ = G.source_graph(files)
    nodes, edges = A.history_edges(*history)
    kept, dropped = A.stored_history(nodes, edges, existing)
    assert {r.node_id for r in nodes.collect()} == {f"commit:{REPO}:4aa68d5", f"pr:{REPO}:456", f"pr:{REPO}:457", f"issue:{REPO}:123", f"issue:{REPO}:124", f"adr:{REPO}:ADR-1", f"adr:{REPO}:ADR-2", f"incident:{REPO}:I-1"}
    assert {(r.src.split(":")[0], r.rel, r.tgt) for r in dropped.collect()} == {("commit", "MODIFIES", f"file:{REPO}:src/flask/gone.py"), ("issue", "LINKED_TO", f"pr:{REPO}:999")}
    file, commit = f"file:{REPO}:src/flask/ctx.py", f"commit:{REPO}:4aa68d5"
    assert {(r.src.split(":")[0], r.rel, r.tgt) for r in kept.where("rel != 'CONTAINS'").collect()} == {
        ("commit", "MODIFIES", file), ("pr", "LINKED_TO", commit), ("pr", "MODIFIES", file), ("issue", "LINKED_TO", f"pr:{REPO}:456"), ("issue", "RESOLVED_BY", commit), ("adr", "AFFECTED", file), ("incident", "LINKED_TO", commit),
    }
    assert kept.where("rel = 'CONTAINS'").count() == 8
    every = existing.select("node_id", "label").union(nodes.select("node_id", "label"))
    root = spark.createDataFrame([(f"issue:{REPO}:123",)], "root string")
    assert [r.node_id for r in C.issue_commits(root, kept, every).collect()] == [commit]
    assert [r.node_id for r in C.modified_files(spark.createDataFrame([(commit,)], "root string"), kept, every).collect()] == [file]


def test_a_commit_alone(spark):
    commits, *_, files = frames(spark)
    existing, _ = G.source_graph(files)
    _, dropped = A.stored_history(*A.history_edges(commits), existing)
    assert dropped.count() == 1


def test_one_table_of_artifacts(spark):
    commits, pulls, issues, _, _, files = frames(spark)
    tree = files.select(F.lit("f1").alias("artifact_id"), F.lit("source_code").alias("artifact_type"), "repository", "path", F.lit("python").alias("language"), F.col("content").alias("text"))
    got = {r.artifact_id: r for r in A.all_artifacts(tree, A.commit_artifacts(commits.where("sha is not null")), A.issue_artifacts(issues), A.pull_artifacts(pulls)).collect()}
    assert set(got) == {"f1", f"{REPO}:commit:4aa68d5", f"{REPO}:issue:123", f"{REPO}:issue:124", f"{REPO}:pr:456", f"{REPO}:pr:457"}
    assert got[f"{REPO}:commit:4aa68d5"].text == "Commit: 4aa68d5\nAuthor: A <a@x>\nDate: 2024-01-01\n\nfix ctx push\n\nFiles changed:\nsrc/flask/ctx.py\nsrc/flask/gone.py"
    assert got[f"{REPO}:issue:124"].text == "Issue #124: other\n\n" and got[f"{REPO}:pr:456"].source_url == f"https://github.com/{REPO}/pull/456"
    assert got["f1"].language == "python" and got[f"{REPO}:pr:456"].language is None


def test_what_must_hold_before_a_graph_is_used(spark):
    *_, files = frames(spark)
    nodes, _ = G.source_graph(files)
    assert A.files_without_node(files, nodes).count() == 0
    more = files.select("repository", "path").union(spark.createDataFrame([(REPO, "new.py")], "repository string, path string"))
    assert [tuple(r) for r in A.files_without_node(more, nodes).collect()] == [(REPO, "new.py")]
    heads = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "4")], "repository string, head string")
    pins = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "9")], "repository string, pin string")
    assert {tuple(r) for r in A.unpinned(heads, pins).collect()} == {("b", "2", "3"), ("c", None, "9"), ("d", "4", None)}
