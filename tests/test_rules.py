"""Rules of runs, labels and reviews, case by case."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions import scalars as X
from siltstone.operators import constraints as V

ATTEMPTS = "run_id string, attempt int, has_retrieval boolean, gate_ran boolean, passed boolean"
RUNS = "run_id string, system string, steps int, max_steps int, exhausted boolean, verdict string"

CASES = {
    "fine a": (("A", 0, 2, False, "unverified"), [(0, False, False, None)], set()),
    "fine c": (("C", 0, 2, False, "unverified"), [(0, True, False, None)], set()),
    "fine e": (("E", 1, 2, False, "verified"), [(0, True, True, False), (1, True, True, True)], set()),
    "fine refusal": (("E", 2, 2, True, "insufficient_evidence"), [(k, True, True, False) for k in range(3)], set()),
    "unverified though gated": (("E", 0, 2, False, "unverified"), [(0, True, True, False)], {"unverified_without_gate"}),
    "two attempts in c": (("C", 1, 2, False, "unverified"), [(0, True, False, None), (1, True, False, None)], {"one_attempt_without_gate"}),
    "verified without gate": (("B", 0, 2, False, "verified"), [(0, True, False, True)], {"verified_by_gate"}),
    "verified but failed last": (("E", 1, 2, False, "verified"), [(0, True, True, True), (1, True, True, False)], {"verified_by_gate"}),
    "not exhausted": (("E", 0, 2, False, "insufficient_evidence"), [(0, True, True, False)], {"insufficient_when_exhausted"}),
    "exhausted unknown": (("E", 0, 2, None, "insufficient_evidence"), [(0, True, True, False)], {"insufficient_when_exhausted"}),
    "outcome unknown": (("E", 0, 2, True, "insufficient_evidence"), [(0, True, True, None)], {"insufficient_when_exhausted"}),
    "a retrieves": (("A", 0, 2, False, "unverified"), [(0, True, False, None)], {"retrieval_by_system"}),
    "d retrieves once of two": (("E", 1, 2, False, "verified"), [(0, True, True, False), (1, False, True, True)], {"retrieval_by_system"}),
    "gate in b": (("B", 0, 2, False, "unverified"), [(0, True, True, True)], {"gate_iff_system_e"}),
    "gap": (("E", 1, 2, False, "verified"), [(0, True, True, False), (2, True, True, True)], {"attempts_gapless"}),
    "steps": (("E", 0, 0, False, "verified"), [(0, True, True, False), (1, True, True, True)], {"steps_match", "steps_bounded"}),
    "no attempt": (("E", -1, 2, False, "other"), [], {"attempts_gapless"}),
}


def test_runs(spark):
    runs = spark.createDataFrame([(k, *run) for k, (run, _, _) in CASES.items()], RUNS)
    attempts = spark.createDataFrame([(k, *a) for k, (_, rows, _) in CASES.items() for a in rows], ATTEMPTS)
    got = {}
    for r in V.attempt_violations(attempts, runs).collect():
        got.setdefault(r.run_id, set()).add(r.rule)
    assert {k: got.get(k, set()) for k in CASES} == {k: want for k, (_, _, want) in CASES.items()}


@pytest.mark.parametrize(
    ("row", "want"),
    [
        (("draft", "dev", ["a"], ["a"], None, None), set()), (("flagged", "dev", [], [], "why", None), set()), (("flagged", "dev", [], ["a"], "", None), {"flagged_needs_notes"}), (("flagged", "dev", [], [], None, None), {"flagged_needs_notes"}),
        (("draft", "val", [], ["a"], None, None), {"else_needs_evidence"}), (("verified", "dev", ["a"], ["a"], None, None), {"verified_needs_name"}), (("verified", "dev", ["a"], ["a"], None, "Ada"), set()),
        (("draft", "dev", ["b"], ["a"], None, None), {"evidence_is_relevant"}), (("draft", "test", ["a"], ["a"], None, None), {"no_test_split"}),
    ],
)
def test_labels(spark, row, want):
    df = spark.createDataFrame([(1, *row)], "id int, status string, split string, evidence array<string>, relevant array<string>, notes string, verified_by string")
    assert {r.rule for r in V.broken(df, "id", V.label_rules(*(F.col(c) for c in df.columns[1:]))).collect()} == want


def test_reviews(spark):
    items = spark.createDataFrame(
        [
            ("open", "v2", None, None, [], False), ("null", "v2", None, None, None, False), ("own", "v2", "ada", None, [], False), ("asked", "v2", "llm", "ADA  Byron", [], False), ("other", "v2", None, None, ["Grace Hopper"], False),
            ("two", "v2", None, None, [], True), ("both", "v2", None, None, [], True), ("stale", "v2", None, None, [], False), ("changed", "v2", None, None, [], False), ("none", "v2", None, None, [], False),
        ],
        "item_id string, item_sha string, drafted_by string, requested_by string, assigned array<string>, held_out boolean",
    )
    ada, grace = "Ada Lovelace", "Grace Hopper"
    rows = [(k, "v2", ada, "approve", 1) for k in ("open", "null", "own", "asked", "other", "two", "both", "changed")] + [("stale", "v1", ada, "approve", 1), ("both", "v2", grace, "approve", 2), ("changed", "v2", ada, "fix", 2), ("changed", "v2", None, "reject", 3)]
    decisions = spark.createDataFrame(rows, "item_id string, item_sha string, reviewer string, decision string, seq int")
    got = {r.item_id: r.status for r in V.review_states(decisions.where("reviewer is not null"), items).collect()}
    assert got == {"open": "approved", "null": "approved", "own": "pending", "asked": "pending", "other": "pending", "two": "partially_approved", "both": "approved", "stale": "pending", "changed": "needs_fix", "none": "pending"}


def test_authors_and_reviewers(spark):
    rows = [("Ada Lovelace", "ada"), ("Ada Lovelace", "Ada Byron"), ("Ada", None), ("Grace", "ada"), ("", ""), (None, "ada"), (" ADA  x", "ada lovelace")]
    df = spark.createDataFrame(rows, "r string, a string").select(X.is_author(F.col("r"), F.col("a"), F.lit(None).cast("string")).alias("x"))
    assert [r.x for r in df.collect()] == [True, True, False, False, False, False, True]
    roster = spark.createDataFrame([("Ada Lovelace",), ("Grace Hopper",), ("Grace Kelly",)], "reviewer string")
    names = spark.createDataFrame([("ada",), ("GRACE  hopper",), ("ada",)], "name string")
    assert sorted((r.name, r.reviewer) for r in V.resolved_reviewers(names, roster).collect()) == [("GRACE  hopper", "Grace Hopper"), ("ada", "Ada Lovelace"), ("ada", "Ada Lovelace")]
    for name in ("grace", "nobody"):
        with pytest.raises(Exception, match=f"not exactly one reviewer: {name}"):
            V.resolved_reviewers(spark.createDataFrame([(name,)], "name string"), roster).collect()
