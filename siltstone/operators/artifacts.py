"""Artifacts of repositories from several sources as one table, and the graph of their history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.source_graph import file_id

_NONE = "cast(null as string)"


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _url(kind: str, last: str) -> Column:
    return F.concat_ws("/", F.lit("https://github.com"), "repository", F.lit(kind), F.col(last).cast("string"))


def commit_artifacts(commits: DataFrame) -> DataFrame:
    """Artifacts of commits (repository, sha, author, email, time, subject, files)."""
    raw = F.concat(F.lit("Commit: "), _text("sha"), F.lit("\nAuthor: "), _text("author"), F.lit(" <"), _text("email"), F.lit(">\nDate: "), _text("time"), F.lit("\n\n"), _text("subject"), F.lit("\n\nFiles changed:\n"), F.array_join(F.coalesce("files", F.array().cast("array<string>")), "\n"))
    return commits.select(F.concat_ws(":", "repository", F.lit("commit"), "sha").alias("artifact_id"), F.lit("commit").alias("artifact_type"), "repository", F.expr(_NONE).alias("path"), raw.alias("text"), _url("commit", "sha").alias("source_url"))


def issue_artifacts(issues: DataFrame) -> DataFrame:
    """Artifacts of issues (repository, number, title, body)."""
    raw = F.concat(F.lit("Issue #"), _text("number"), F.lit(": "), _text("title"), F.lit("\n\n"), _text("body"))
    return issues.select(F.concat_ws(":", "repository", F.lit("issue"), F.col("number").cast("string")).alias("artifact_id"), F.lit("issue").alias("artifact_type"), "repository", F.expr(_NONE).alias("path"), raw.alias("text"), _url("issues", "number").alias("source_url"))


def pull_artifacts(pulls: DataFrame) -> DataFrame:
    """Artifacts of pull requests (repository, number, title, body)."""
    raw = F.concat(F.lit("Pull Request #"), _text("number"), F.lit(": "), _text("title"), F.lit("\n\n"), _text("body"))
    return pulls.select(F.concat_ws(":", "repository", F.lit("pr"), F.col("number").cast("string")).alias("artifact_id"), F.lit("pull_request").alias("artifact_type"), "repository", F.expr(_NONE).alias("path"), raw.alias("text"), _url("pull", "number").alias("source_url"))


def all_artifacts(*parts: DataFrame) -> DataFrame:
    """Files, commits, issues and pull requests as one table; a column that a part doesn't have is null in it."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _node(df: DataFrame, kind: str, key: str, label: str, name: Column) -> DataFrame:
    return df.where(F.col(key).isNotNull()).select(F.concat_ws(":", F.lit(kind), "repository", F.col(key).cast("string")).alias("node_id"), F.lit(label).alias("label"), "repository", name.alias("name"))


def _edges(df: DataFrame, kind: str, key: str, to: Column, rel: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).select(F.concat_ws(":", F.lit(kind), "repository", F.col(key).cast("string")).alias("src"), to.alias("tgt"), F.lit(rel).alias("rel")).where("tgt is not null")


def _linked(kind: str, key: Column) -> Column:
    return F.when(key.isNotNull() & (key.cast("string") != ""), F.concat_ws(":", F.lit(kind), F.col("repository"), key.cast("string")))


def history_edges(commits: DataFrame | None = None, pulls: DataFrame | None = None, issues: DataFrame | None = None, decisions: DataFrame | None = None, incidents: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, label, repository, name) and edges (src, tgt, rel) of a history, whether or not their ends exist.

    commits (repository, sha, subject, files), pulls (repository, number,
    title, merge_sha, files), issues (repository, number, title, resolved_by,
    pulls), decisions (repository, decision_id, title, path), incidents
    (repository, incident_id, title, commits). The repository CONTAINS each;
    commits and pulls MODIFY files; pulls are LINKED_TO their merge, issues to
    pulls, incidents to commits; issues are RESOLVED_BY commits, and
    decisions AFFECTED files. Rows without a key are left out.
    """
    nodes, edges = [], []
    if commits is not None:
        nodes.append(_node(commits, "commit", "sha", "Commit", F.left(_text("subject"), F.lit(200))))
        edges.append(_edges(commits.withColumn("_f", F.explode("files")), "commit", "sha", file_id(F.col("repository"), F.col("_f")), "MODIFIES"))
    if pulls is not None:
        nodes.append(_node(pulls, "pr", "number", "PullRequest", F.col("title")))
        edges.append(_edges(pulls, "pr", "number", _linked("commit", F.col("merge_sha")), "LINKED_TO"))
        edges.append(_edges(pulls.withColumn("_f", F.explode("files")), "pr", "number", file_id(F.col("repository"), F.col("_f")), "MODIFIES"))
    if issues is not None:
        nodes.append(_node(issues, "issue", "number", "Issue", F.col("title")))
        edges.append(_edges(issues.withColumn("_p", F.explode("pulls")), "issue", "number", _linked("pr", F.col("_p")), "LINKED_TO"))
        edges.append(_edges(issues, "issue", "number", _linked("commit", F.col("resolved_by")), "RESOLVED_BY"))
    if decisions is not None:
        nodes.append(_node(decisions, "adr", "decision_id", "ArchitectureDecision", F.col("title")))
        edges.append(_edges(decisions.where("path != ''"), "adr", "decision_id", file_id(F.col("repository"), F.col("path")), "AFFECTED"))
    if incidents is not None:
        nodes.append(_node(incidents, "incident", "incident_id", "Incident", F.col("title")))
        edges.append(_edges(incidents.withColumn("_c", F.explode("commits")), "incident", "incident_id", _linked("commit", F.col("_c")), "LINKED_TO"))
    found = reduce(DataFrame.unionByName, nodes)
    contains = found.select(F.concat(F.lit("repo:"), "repository").alias("src"), F.col("node_id").alias("tgt"), F.lit("CONTAINS").alias("rel"))
    return found.dropDuplicates(["node_id"]), reduce(DataFrame.unionByName, [contains, *edges])


def stored_history(nodes: DataFrame, edges: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``history_edges``, those both of whose ends are among ``nodes`` or ``existing`` (node_id), and those that are dropped, as often as they were given."""
    ids = nodes.select("node_id").union(existing.select("node_id")).distinct()
    known = lambda end: ids.select(F.col("node_id").alias(end), F.lit(True).alias(f"_{end}"))
    both = edges.join(known("src"), "src", "left").join(known("tgt"), "tgt", "left").withColumn("_kept", F.coalesce(F.col("_src") & F.col("_tgt"), F.lit(False)))
    kept = both.where("_kept").select("src", "tgt", "rel").distinct()
    return kept, both.where("not _kept").select("src", "tgt", "rel")


def files_without_node(indexed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repository, path): indexed files that the graph doesn't have; there must be none before it is used."""
    files = indexed.select("repository", "path").distinct().withColumn("node_id", file_id(F.col("repository"), F.col("path")))
    return files.join(nodes.select("node_id"), "node_id", "left_anti").select("repository", "path")


def unpinned(heads: DataFrame, pins: DataFrame) -> DataFrame:
    """(repository, head, pin): repositories whose checkout is not at its pin, or that have none."""
    both = heads.join(pins, "repository", "left")
    return both.where(~F.coalesce(F.col("head") == F.col("pin"), F.lit(False))).select("repository", "head", "pin")
