"""Constraints as queries that return the rows which break them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scalars import is_author, name_key


def broken(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule: key, rule. A rule that is neither true nor false counts as broken."""
    names = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return df.select(key, F.explode(names).alias("rule"))


def implies(a: Column, b: Column) -> Column:
    return ~F.coalesce(a, F.lit(False)) | b


def same_nullness(*columns: Column) -> Column:
    return reduce(lambda x, y: x & y, (c.isNull() == columns[0].isNull() for c in columns[1:]))


def gapless(df: DataFrame, group: str, rank: str, first: int = 1) -> DataFrame:
    """Groups whose ranks are not first, first + 1, … each once."""
    s = df.groupBy(group).agg(F.count("*").alias("n"), F.countDistinct(rank).alias("d"), F.min(rank).alias("low"), F.max(rank).alias("high"))
    return s.where((F.col("low") != first) | (F.col("high") != F.col("n") + first - 1) | (F.col("d") != F.col("n"))).select(group, "n", "low", "high")


def metric_rules(value: Column, provenance: Column, method: Column) -> dict[str, Column]:
    return {"provenance_iff_value": same_nullness(value, provenance), "method_of_missing": implies(value.isNull(), method == "not_available")}


def span_rules(path: Column, start: Column, end: Column) -> dict[str, Column]:
    return {"relative_path": ~path.rlike(r"^/|\\|(^|/)\.\.(/|$)"), "lines_both_or_neither": same_nullness(start, end), "lines_in_order": start.isNull() | (end >= start), "lines_from_one": start.isNull() | (start >= 1)}


def trial_rules(latency: Column, tokens: Column, quality: Column) -> dict[str, Column]:
    return {"latency": latency.between(0, 60_000), "tokens": tokens >= 0, "quality": quality.isNull() | quality.between(0, 1)}


def decision_rules(decision: Column, checks: Column, note: Column) -> dict[str, Column]:
    """Four checks; an approval passes all of them, anything else fails one and says why."""
    values = F.map_values(checks)
    return {"four_checks": F.size(checks) == 4, "approval_passes_all": implies(decision == "approve", F.forall(values, lambda v: v)), "else_explained": (decision == "approve") | ((F.length(F.trim(note)) > 0) & F.exists(values, lambda v: ~v))}


def review_status(decisions: DataFrame, needed: int = 1) -> DataFrame:
    """Per item: reject before fix before approved by enough reviewers before partial."""
    latest = decisions.groupBy("item_id", "reviewer").agg(F.max_by("decision", "seq").alias("decision"))
    n = latest.groupBy("item_id").agg(*(F.count_if(F.col("decision") == d).alias(d) for d in ("reject", "fix", "approve")))
    return n.select("item_id", _status(F.lit(needed)).alias("status"))


def drift(one: DataFrame, other: DataFrame) -> DataFrame:
    """Fields (field, value) that differ between two manifests."""
    return one.withColumnRenamed("value", "a").join(other.withColumnRenamed("value", "b"), "field", "full").where(~F.col("a").eqNullSafe(F.col("b")))


def evidence_rules(mode: Column, is_evidence: Column, cached_from: Column) -> dict[str, Column]:
    """A mock is no evidence; a cached run, and only one, names where it comes from."""
    return {"mock_is_no_evidence": implies(mode == "mock", ~is_evidence), "cached_iff_source": (mode == "cached_run") == cached_from.isNotNull()}


def score_rules(score: Column, provenance: Column, executed: Column, passed: Column, threshold: Column) -> dict[str, Column]:
    """A score and its provenance are both there or neither; a gate that ran says whether it passed, and of what."""
    return {"score_iff_provenance": same_nullness(score, provenance), "gate_reports": implies(executed, passed.isNotNull() & threshold.isNotNull())}


def attempt_violations(attempts: DataFrame, runs: DataFrame) -> DataFrame:
    """Rules that a run breaks: run_id, rule.

    ``attempts`` (run_id, attempt, has_retrieval, gate_ran, passed), ``runs``
    (run_id, system, steps, max_steps, exhausted, verdict). There is an attempt;
    attempts are numbered from 0 without gaps and one more than the escalation
    steps, which keep to their bound. System A retrieves nothing, the others in
    every attempt. The gate runs in every attempt of system E and nowhere else, and the
    systems without it make one attempt. Verified needs a gate that passed last,
    insufficient_evidence one that failed last when nothing was left to try, and
    unverified a system without a gate.
    """
    n = attempts.groupBy("run_id").agg(
        F.count("*").alias("n"), F.countDistinct("attempt").alias("d"), F.min("attempt").alias("low"), F.max("attempt").alias("high"),
        F.count_if("has_retrieval").alias("r"), F.count_if("gate_ran").alias("g"), F.max_by("passed", "attempt").alias("passed"),
    )
    both = runs.join(n, "run_id", "left").fillna(0, ["n", "d", "r", "g"])
    gated, verdict, passed = F.col("system") == "E", F.col("verdict"), F.coalesce("passed", F.lit(False))
    rules = {
        "attempts_gapless": (F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("d") == F.col("n")),
        "steps_match": F.col("steps") == F.col("n") - 1,
        "steps_bounded": F.col("n") - 1 <= F.col("max_steps"),
        "retrieval_by_system": F.when(F.col("system") == "A", F.col("r") == 0).otherwise(F.col("r") == F.col("n")),
        "gate_iff_system_e": F.when(gated, F.col("g") == F.col("n")).otherwise(F.col("g") == 0),
        "one_attempt_without_gate": gated | (F.col("n") == 1),
        "verified_by_gate": implies(verdict == "verified", gated & passed),
        "insufficient_when_exhausted": implies(verdict == "insufficient_evidence", gated & F.coalesce(~F.col("passed"), F.lit(False)) & F.coalesce("exhausted", F.lit(False))),
        "unverified_without_gate": implies(verdict == "unverified", ~gated),
    }
    return broken(both, "run_id", rules)


def label_rules(status: Column, split: Column, evidence: Column, relevant: Column, notes: Column, verified_by: Column) -> dict[str, Column]:
    """A flagged label says why, any other has evidence; a verified one names who verified it; evidence lies in relevant files; none is of the test split."""
    said = lambda c: F.coalesce(c, F.lit("")) != ""
    return {
        "flagged_needs_notes": implies(status == "flagged", said(notes)),
        "else_needs_evidence": (status == "flagged") | (F.size(evidence) > 0),
        "verified_needs_name": implies(status == "verified", said(verified_by)),
        "evidence_is_relevant": F.size(F.array_except(evidence, relevant)) == 0,
        "no_test_split": split != "test",
    }


def binding_decisions(decisions: DataFrame, items: DataFrame) -> DataFrame:
    """The decisions that count: on an item's present content, by somebody who may decide on it and is no author of it.

    ``decisions`` (item_id, item_sha, reviewer, decision, seq), ``items``
    (item_id, item_sha, drafted_by, requested_by, assigned: an array of
    reviewers). Without an assignment, null or empty, anybody may decide. A null
    author is nobody.
    """
    held = decisions.join(items, ["item_id", "item_sha"])
    open_to = (F.coalesce(F.size("assigned"), F.lit(0)) <= 0) | F.array_contains("assigned", F.col("reviewer"))
    return held.where(~is_author(F.col("reviewer"), F.col("drafted_by"), F.col("requested_by")) & F.coalesce(open_to, F.lit(False))).select("item_id", "reviewer", "decision", "seq")


def review_states(decisions: DataFrame, items: DataFrame) -> DataFrame:
    """Per item (also undecided ones): its status by each reviewer's latest binding decision; held-out items need two approvals."""
    latest = binding_decisions(decisions, items).groupBy("item_id", "reviewer").agg(F.max_by("decision", "seq").alias("decision"))
    n = latest.groupBy("item_id").agg(*(F.count_if(F.col("decision") == d).alias(d) for d in ("reject", "fix", "approve")))
    both = items.select("item_id", F.when(F.col("held_out"), 2).otherwise(1).alias("needed")).join(n, "item_id", "left").fillna(0, ["reject", "fix", "approve"])
    return both.select("item_id", _status(F.col("needed")).alias("status"))


def _status(needed: Column) -> Column:
    return F.when(F.col("reject") > 0, "rejected").when(F.col("fix") > 0, "needs_fix").when(F.col("approve") >= needed, "approved").when(F.col("approve") > 0, "partially_approved").otherwise("pending")


def resolved_reviewers(names: DataFrame, roster: DataFrame) -> DataFrame:
    """``names`` (name) with the one reviewer of ``roster`` (reviewer) whose full or first name it is; none or several raise, and the error names it."""
    known = roster.select("reviewer", F.explode(F.array_distinct(F.array(name_key(F.col("reviewer")), F.split(name_key(F.col("reviewer")), " ")[0]))).alias("_key"))
    hits = names.select("name").distinct().withColumn("_key", name_key(F.col("name"))).join(known, "_key", "left").groupBy("name").agg(F.count("reviewer").alias("_n"), F.min("reviewer").alias("reviewer"))
    one = F.when(F.col("_n") == 1, F.col("reviewer")).otherwise(F.raise_error(F.concat(F.lit("not exactly one reviewer: "), F.coalesce("name", F.lit("null")))))
    return names.join(hits.select("name", one.alias("reviewer")), "name", "left")


def queue_clashes(queue: DataFrame, others: DataFrame) -> DataFrame:
    """Items of a queue that another one holds already."""
    return queue.join(others.select("item_id"), "item_id", "left_semi")


def held_out_violations(runs: DataFrame) -> DataFrame:
    """Runs (run_id, split, final, at) on the test split that are not marked final, or not the first that is."""
    test = runs.where("split = 'test'").withColumn("turn", F.expr("row_number() over (partition by final order by at, run_id)"))
    return test.where("not final or turn > 1").select("run_id", F.when(F.col("final"), "repeated").otherwise("not_final").alias("rule"))
