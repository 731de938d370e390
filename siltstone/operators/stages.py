"""Stages around retrieval and rating: rerankers by type, the context window's check, filters of tasks, blind sheets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.retrieval import top

RATINGS = ("correctness", "completeness", "groundedness", "citation_quality", "clarity")


def reranked(ranked: DataFrame, plan: DataFrame, relevance: Mapping[str, Column], strict: bool = False) -> DataFrame:
    """``ranked`` by the reranker that each query asks for: with rank_before, rerank_score, applied and error.

    ``plan`` (query_id, reranker_type, keep) may name a type of ``relevance``,
    whose column is then a row's new score; of such a query the ``keep`` best
    stay, at least one. "none", empty and null mean that nothing is reranked, which is no error. A type that
    isn't there leaves a query as it was and says so in ``error``, or with ``strict`` fails and names the type.
    """
    kind = F.coalesce(F.nullif(F.col("reranker_type"), F.lit("")), F.lit("none"))
    both = ranked.join(plan.select("query_id", kind.alias("_kind"), "keep"), "query_id", "left").withColumn("_kind", F.coalesce("_kind", F.lit("none")))
    known = F.col("_kind").isin(*relevance) if relevance else F.lit(False)
    missing = F.concat(F.lit("no reranker of type "), F.col("_kind"))
    score = F.lit(None).cast("double")
    for name, column in relevance.items():
        score = F.when(F.col("_kind") == name, column).otherwise(score)
    if strict:
        score = F.when(~known & (F.col("_kind") != "none"), F.raise_error(missing).cast("double")).otherwise(score)
    scored = both.withColumnRenamed("rank", "rank_before").withColumns({"rerank_score": score, "applied": known, "error": F.when(~known & (F.col("_kind") != "none"), missing)})
    placed = top(scored, 1 << 30, "query_id", F.desc_nulls_last("rerank_score"), F.col("rank_before"))
    return placed.where(~F.col("applied") | (F.col("rank") <= F.greatest("keep", F.lit(1)))).drop("_kind", "keep")


def context_checked(prompts: DataFrame, budget: int, num_ctx: int) -> DataFrame:
    """``prompts`` (model_id, prompt_tokens, …) with checked and headroom_tokens; one that doesn't fit fails the query and says by how much.

    Where the tokens aren't known nothing is checked.
    """
    said = F.concat(F.lit("prompt of "), F.col("prompt_tokens").cast("string"), F.lit(f" tokens and {budget} for the answer exceed {num_ctx} of "), F.col("model_id"))
    left = F.lit(num_ctx) - F.col("prompt_tokens") - budget
    headroom = F.when(F.col("prompt_tokens").isNull(), F.lit(None).cast("long")).when(left < 0, F.raise_error(said).cast("long")).otherwise(left.cast("long"))
    return prompts.withColumns({"headroom_tokens": headroom, "checked": F.col("prompt_tokens").isNotNull()})


def filtered(tasks: DataFrame, **wanted: str | None) -> DataFrame:
    """The tasks that have every value that is asked for; what is None or empty isn't asked for."""
    for name, value in wanted.items():
        if value:
            tasks = tasks.where(F.col(name) == value)
    return tasks


def set_only(**values: Column) -> Column:
    """A map of the values that are not null, as strings."""
    entries = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items())), lambda e: e["value"].isNotNull())
    return F.map_from_entries(entries)


def blinded(units: DataFrame, seed: int = 42) -> DataFrame:
    """``units`` (task_id, system_id, trial_index, …) with blind ids H001, H002, … in an order that a hash of seed and unit gives. A sheet is for people to fill in, so it is one partition."""
    order = F.xxhash64(F.lit(seed), "task_id", "system_id", "trial_index")
    place = F.expr("row_number() over (order by _order, task_id, system_id, trial_index)")
    width = F.greatest(F.length(place.cast("string")), F.lit(3))
    return units.withColumn("_order", order).withColumn("blind_id", F.concat(F.lit("H"), F.lpad(place.cast("string"), width, F.lit("0")))).drop("_order")


def write_blind_sheet(units: DataFrame, tasks: DataFrame, sheet: str, key: str, dimensions: tuple[str, ...] = RATINGS) -> None:
    """Writes the sheet that raters fill in, which names no system, and the key to its blind ids, each one CSV file.

    ``units`` (blind_id, task_id, system_id, trial_index, answer), ``tasks`` (task_id, query, ground_truth).
    """
    empty = F.lit(None).cast("string")
    rows = units.join(tasks.select("task_id", "query", "ground_truth"), "task_id")
    rows = rows.select("blind_id", F.col("query").alias("question"), F.col("ground_truth").alias("reference_answer"), F.col("answer").alias("answer_to_rate"), *(empty.alias(d) for d in dimensions), empty.alias("rater"), empty.alias("notes"))
    options = {"header": "true", "quoteAll": "true", "escape": '"', "emptyValue": "", "nullValue": ""}
    rows.coalesce(1).sortWithinPartitions("blind_id").write.mode("overwrite").options(**options).csv(sheet)
    units.select("blind_id", "task_id", "system_id", "trial_index").coalesce(1).sortWithinPartitions("blind_id").write.mode("overwrite").options(**options).csv(key)
