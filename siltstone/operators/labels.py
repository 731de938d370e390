"""Labels of retrieval: read from JSON, lent to items without lines, and promotion of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABEL = "task_id string, relevant_files array<string>, alternative_files array<string>, required_evidence array<struct<file:string,start_line:bigint,end_line:bigint,chunk_ids:array<string>>>"


def parsed_labels(documents: DataFrame, text: Column) -> DataFrame:
    """(task_id, relevant_files, alternative_files, spans, n_relevant_chunks) of labels written as JSON, one for each row.

    spans are (file, start_line, end_line); n_relevant_chunks counts the
    different chunks of all evidence and is null where no chunk is known. Text that is no
    label is left out.
    """
    read = documents.select(F.from_json(text, LABEL).alias("l")).where("l.task_id is not null").select("l.*")
    evidence = F.coalesce("required_evidence", F.array().cast("array<struct<file:string,start_line:bigint,end_line:bigint,chunk_ids:array<string>>>"))
    chunks = F.array_distinct(F.flatten(F.transform(evidence, lambda e: F.coalesce(e["chunk_ids"], F.array().cast("array<string>")))))
    spans = F.transform(evidence, lambda e: F.struct(e["file"].alias("file"), e["start_line"].alias("start_line"), e["end_line"].alias("end_line")))
    none = F.array().cast("array<string>")
    return read.select("task_id", F.coalesce("relevant_files", none).alias("relevant_files"), F.coalesce("alternative_files", none).alias("alternative_files"), spans.alias("spans"), F.nullif(F.size(chunks).cast("long"), F.lit(0).cast("long")).alias("n_relevant_chunks"))


def borrowed_evidence(evidence: DataFrame, spans: DataFrame) -> DataFrame:
    """``evidence`` (task_id, place, file_path, line_start, line_end) with lines for every row: task_id, place, file, start_line, end_line, from_label.

    A row without a first line takes all ``spans`` (task_id, file, start_line,
    end_line) that the task's label has for its file; if there are none the
    query fails and names task and file. A row without a last line is one line; a row without a file is
    left out.
    """
    cited = evidence.where(F.coalesce("file_path", F.lit("")) != "").withColumnRenamed("file_path", "file")
    own = F.coalesce("line_start", F.lit(0)) != 0
    whole = cited.where(own).select("task_id", "place", "file", F.col("line_start").cast("long").alias("start_line"), F.when(F.coalesce("line_end", F.lit(0)) != 0, F.col("line_end")).otherwise(F.col("line_start")).cast("long").alias("end_line"), F.lit(False).alias("from_label"))
    lent = cited.where(~own).join(spans.select("task_id", "file", "start_line", "end_line"), ["task_id", "file"], "left")
    said = F.concat(F.col("task_id").cast("string"), F.lit(" cites "), F.col("file"), F.lit(" without line numbers and no label covers it"))
    checked = F.when(F.col("start_line").isNull(), F.raise_error(said)).otherwise(F.col("start_line")).cast("long")
    return whole.unionByName(lent.select("task_id", "place", "file", checked.alias("start_line"), F.col("end_line").cast("long"), F.lit(True).alias("from_label")))


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with the one row of ``table`` that has their key; none or several fail the query and name the key."""
    rest = [c for c in table.columns if c != key]
    one = table.groupBy(key).agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_row"))
    said = F.concat(F.lit(f"not exactly one row of {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(": "), F.coalesce("_n", F.lit(0)).cast("string"))
    checked = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(said))
    return rows.join(one, key, "left").withColumn("_row", checked).select(*rows.columns, *(F.col(f"_row.{c}").alias(c) for c in rest))


def promoted(tasks: DataFrame, evidence: DataFrame, reviewer: str) -> DataFrame:
    """``tasks`` (task_id, status, human_approved_by, …) approved by ``reviewer``; a task without evidence fails the query and is named."""
    has = evidence.select("task_id").distinct().withColumn("_has", F.lit(True))
    said = F.concat(F.lit("no evidence to approve "), F.col("task_id").cast("string"))
    status = F.when(F.col("_has"), F.lit("approved")).otherwise(F.raise_error(said))
    return tasks.join(has, "task_id", "left").withColumns({"status": status, "human_approved_by": F.lit(reviewer)}).select(*tasks.columns)
