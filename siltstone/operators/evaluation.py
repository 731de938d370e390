"""Measuring ranked results against labels: by file, by line span, and citations against retrieved chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import loose_citations, normalize_path
from siltstone.operators.gate import refused
from siltstone.operators.retrieval import ir_metrics


def primaries(alternatives: DataFrame, relevant: DataFrame) -> DataFrame:
    """The relevant file that each alternative stands for: query_id, file, primary.

    That is the one of the same folder whose stem and an underscore the
    alternative's name begins with. An alternative of none or several raises.
    """
    parts = lambda c: (F.regexp_extract(c, r"^((?:.*/)?)", 1), F.regexp_replace(F.regexp_extract(c, r"([^/]*)$", 1), r"\.[^.]*$", ""))
    a_folder, a_stem = parts(F.col("file"))
    r_folder, r_stem = parts(F.col("file"))
    a = alternatives.select("query_id", "file", a_folder.alias("folder"), a_stem.alias("stem"))
    r = relevant.select("query_id", F.col("file").alias("primary"), r_folder.alias("folder"), r_stem.alias("primary_stem"))
    hits = a.join(r, ["query_id", "folder"], "left").groupBy("query_id", "file").agg(F.collect_list(F.when(F.startswith("stem", F.concat("primary_stem", F.lit("_"))), F.col("primary"))).alias("hits"))
    wrong = F.raise_error(F.concat(F.lit("an alternative of "), F.size("hits"), F.lit(" relevant files: "), F.col("file")))
    return hits.select("query_id", "file", F.when(F.size("hits") == 1, F.get("hits", F.lit(0))).otherwise(wrong).alias("primary"))


def file_metrics(ranked: DataFrame, relevant: DataFrame, alternatives: DataFrame | None = None, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Per query: mrr, recall, precision and nDCG over the ranked list of distinct files, and its length.

    ``ranked`` (query_id, rank, file; null files are passed over), ``relevant``
    (query_id, file), ``alternatives`` likewise: a found alternative counts as
    its primary. A file keeps its first place, and the places are closed up.
    """
    files = ranked.withColumn("file", normalize_path(F.col("file"))).where(F.coalesce(F.col("file"), F.lit("")) != "")
    first = files.groupBy("query_id", "file").agg(F.min("rank").alias("rank")).withColumn("rank", F.expr("row_number() over (partition by query_id order by rank, file)"))
    wanted = relevant.select("query_id", "file").distinct()
    if alternatives is not None:
        first = first.join(primaries(alternatives.distinct(), wanted), ["query_id", "file"], "left").withColumn("file", F.coalesce("primary", "file")).drop("primary")
    hits = first.join(wanted.withColumn("target", F.col("file")), ["query_id", "file"], "left")
    n = wanted.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    lengths = first.groupBy("query_id").agg(F.count("*").alias("n_ranked"))
    return ir_metrics(hits.select("query_id", "rank", "target"), n, ks).join(lengths, "query_id", "left").fillna(0, ["n_ranked"])


def span_metrics(ranked: DataFrame, spans: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), with_graph: bool = False) -> DataFrame:
    """Per query the same over ranked chunks against labelled line spans.

    ``ranked`` (query_id, rank, file, start_line, end_line, is_graph), ``spans``
    (query_id, file, span_start, span_end, n_chunks: how many chunks the label
    names, null if none). Recall is the share of spans covered; the ideal of
    nDCG has n_chunks, else the number of spans. Graph rows take part only
    ``with_graph``.
    """
    rows = ranked if with_graph else ranked.where("not is_graph")
    rows = rows.withColumn("rank", F.expr("row_number() over (partition by query_id order by rank)"))
    marked = spans.withColumn("span", F.struct("file", "span_start", "span_end"))
    overlap = (F.col("start_line") <= F.col("span_end")) & (F.col("span_start") <= F.col("end_line"))
    hits = rows.withColumn("file", normalize_path(F.col("file"))).join(marked.drop("n_chunks"), ["query_id", "file"]).where(overlap)
    found = hits.select("query_id", "rank").distinct().withColumn("target", F.col("rank"))
    wanted = marked.groupBy("query_id").agg(F.countDistinct("span").alias("n_spans"), F.max("n_chunks").alias("n_chunks"))
    n = wanted.select("query_id", F.coalesce(F.nullif("n_chunks", F.lit(0)), F.col("n_spans")).alias("n_relevant"))
    out = ir_metrics(found, n, ks)
    covered = hits.groupBy("query_id").agg(*(F.countDistinct(F.when(F.col("rank") <= k, F.col("span"))).alias(f"c{k}") for k in ks))
    both = out.join(wanted, "query_id").join(covered, "query_id", "left")
    recalls = {f"recall_{k}": F.coalesce(F.col(f"c{k}"), F.lit(0)) / F.col("n_spans") for k in ks}
    return both.select("query_id", *(recalls.get(c, F.col(c)).alias(c) for c in out.columns if c != "query_id"))


def mean_metrics(metrics: DataFrame, *by: str) -> DataFrame:
    """The mean of every measure per group, over its queries."""
    names = [c for c in metrics.columns if c not in (*by, "query_id")]
    return metrics.groupBy(*by).agg(F.count("*").alias("n_queries"), *(F.avg(c).alias(c) for c in names))


def citation_counts(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per answer: n_chunks, n_citations, n_valid, and the share of cited line ranges that a matching chunk holds.

    ``answers`` (query_id, answer), ``chunks`` (query_id, path, start_line,
    end_line). A citation matches a chunk whose path is equal, or of which one
    is the other's end after a slash; so both share their last name, by which
    they are joined. A chunk without lines holds any.
    """
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    cited = answers.select("query_id", F.posexplode(loose_citations(F.col("answer"))).alias("n", "c")).select("query_id", "n", "c.*").withColumn("name", name(F.col("path")))
    held = chunks.select("query_id", F.col("path").alias("chunk_path"), F.col("start_line").alias("low"), F.col("end_line").alias("high")).withColumn("name", name(F.col("chunk_path")))
    fits = (F.col("path") == F.col("chunk_path")) | F.endswith("path", F.concat(F.lit("/"), "chunk_path")) | F.endswith("chunk_path", F.concat(F.lit("/"), "path"))
    inside = F.when(F.col("start_line").isNotNull(), F.col("low").isNull() | F.col("high").isNull() | (F.greatest("start_line", "low") <= F.least("end_line", "high")))
    matched = cited.join(held, ["query_id", "name"]).where(fits).groupBy("query_id", "n").agg(F.bool_or(inside).alias("lines_held"))
    per = cited.select("query_id", "n").join(matched.withColumn("valid", F.lit(True)), ["query_id", "n"], "left").groupBy("query_id").agg(
        F.count("*").alias("n_citations"), F.count_if("valid").alias("n_valid"), F.avg(F.col("lines_held").cast("int")).alias("line_share")
    )
    n = chunks.groupBy("query_id").agg(F.count("*").alias("n_chunks"))
    return answers.select("query_id", "answer").join(n, "query_id", "left").join(per, "query_id", "left").fillna(0, ["n_chunks", "n_citations", "n_valid"])


def grounded(counts: DataFrame) -> DataFrame:
    """``citation_counts`` with the signal's score and whether it passes."""
    share = 0.4 + 0.6 * F.col("n_valid") / F.col("n_citations") - F.when(F.col("line_share") < 0.5, 0.15).otherwise(0.0)
    refusal, none = refused(F.col("answer")), F.col("n_citations") == 0
    score = F.when(refusal, 0.5).when(none, F.when(F.col("n_chunks") > 0, 0.3).otherwise(0.5)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)), 4))
    passed = F.when(refusal | none, F.col("n_chunks") == 0).otherwise((score >= 0.70) & (F.col("n_valid") == F.col("n_citations")))
    return counts.withColumn("score", score).withColumn("passed", passed)
