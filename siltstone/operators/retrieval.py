"""Retrieval of ranked rows for batches of queries: dense, BM25, hybrid fusion, rerank.

Results are flat: one row per query and rank. What is shared by several
strategies, the scores, is computed once and then cut by each strategy's
numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import vectors
from siltstone.operators import batches
from siltstone.sources.storage import written
from siltstone.sources.tables import spread

K1, B, DELTA = 1.5, 0.75, 1.0
#: So many query rows (vectors, or terms of queries) and so many bytes of vectors are held by every task; more are joined.
MOST_HELD, MOST_BYTES = 100_000, 128 << 20
#: So many terms are added up by a task before it passes them on.
MOST_TERMS = 200_000


def small(df: DataFrame, most_rows: int = 50_000) -> DataFrame:
    """``df`` hinted for broadcast only if a count proves it small; else left to the planner."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def top(df: DataFrame, k: int | Column, by: str, *order: Column) -> DataFrame:
    """The first ``k`` rows per ``by`` with their rank from 1. The order must be total."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def dense(queries: DataFrame, items: DataFrame, k: int, threshold: float = 0.0, metric: str = "cosine", exclude_self: bool = False) -> DataFrame:
    """Exact nearest items of each query: query_id, rank, item_id, score.

    ``queries`` (query_id, query_vector) is a stated set, held against all
    ``items`` (item_id, vector). Scores below a positive threshold are cut.
    Null vectors take no part. Ties go to the smaller item_id.
    """
    if metric in ("cosine", "dot"):
        asked_rows = queries.where("query_vector is not null").limit(MOST_HELD + 1).collect()
        if len(asked_rows) <= MOST_HELD and len({len(r["query_vector"]) for r in asked_rows}) == 1 and 8 * len(asked_rows) * len(asked_rows[0]["query_vector"]) <= MOST_BYTES:
            same = items.where(F.size("vector") == len(asked_rows[0]["query_vector"]))
            found = batches.dense_best(asked_rows, queries.schema["query_id"].dataType, same.where(~F.exists("vector", lambda x: x.isNull())), k, threshold, metric == "cosine", exclude_self)
            return top(found, k, "query_id", F.desc("score"), F.asc("item_id"))
    length = lambda c: vectors.norm(F.col(c)) if metric == "cosine" else F.lit(1.0)
    held, asked = items.where("vector is not null"), queries.where("query_vector is not null")
    held, asked = held.withColumn("_length", length("vector")), asked.withColumn("_query_length", length("query_vector"))
    score = vectors.METRICS["dot" if metric == "cosine" else metric](F.col("query_vector"), F.col("vector"))
    scored = held.join(small(asked), how="cross").withColumn("score", score / F.nullif(F.col("_length") * F.col("_query_length"), F.lit(0.0)))
    if exclude_self:
        scored = scored.where("item_id != query_id")
    if threshold > 0:
        scored = scored.where(F.col("score") >= threshold)
    return top(scored.select("query_id", "item_id", "score"), k, "query_id", F.desc("score"), F.asc("item_id"))


def postings(docs: DataFrame, tokens: Column) -> DataFrame:
    """term, doc_id, tf, and the document's length on each row, so that no join brings it back."""
    read = docs.select("doc_id", tokens.alias("tokens")).withColumn("length", F.size("tokens").cast("long"))
    return read.select("doc_id", "length", F.explode("tokens").alias("term")).groupBy("term", "doc_id", "length").agg(F.count("*").alias("tf"))


def term_stats(docs: DataFrame, tokens: Callable[[str | None], list[str]]) -> DataFrame:
    """term, df (documents that have it), cf (its occurrences), max_tf (the most in one document).

    ``docs`` has doc_id and text, ``tokens`` makes the tokens of one text. Tasks add up what
    they read and exchange a row a term, no postings. The texts of one doc_id are one document.
    """
    parts = "term string, df long, cf long, max_tf long"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}
        for batch in batches:
            for text in batch.column("text"):
                for term, tf in Counter(tokens(text.as_py())).items():
                    row = found.setdefault(term, [0, 0, 0])
                    row[0] += 1
                    row[1] += tf
                    row[2] = max(row[2], tf)
                if len(found) > MOST_TERMS:
                    yield _term_rows(found)
                    found = {}
        yield _term_rows(found)

    repeated = written(docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id")), "repeated")
    if not repeated.limit(1).count():
        per = spread(docs.select("text")).mapInArrow(counted, parts)
    else:
        again = F.col("doc_id").eqNullSafe(F.col("_id"))
        per = spread(docs.join(repeated, again, "left_anti").select("text")).mapInArrow(counted, parts)
        many = docs.join(repeated, again, "left_semi").select("doc_id", "text").mapInArrow(lambda batches: (x for b in batches for x in _posted(b, tokens)), f"doc_id {dict(docs.dtypes)['doc_id']}, term string, tf long")
        many = many.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))
        per = per.unionByName(many.select("term", F.lit(1).cast("long").alias("df"), F.col("tf").alias("cf"), F.col("tf").alias("max_tf")))
    return per.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.max("max_tf").alias("max_tf"))


def _term_rows(found: dict[str, list[int]]) -> pa.RecordBatch:
    numbers = [pa.array([row[k] for row in found.values()], pa.int64()) for k in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *numbers], ["term", "df", "cf", "max_tf"])


def _posted(batch: pa.RecordBatch, tokens: Callable[[str | None], list[str]]) -> Iterator[pa.RecordBatch]:
    for key, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
        tf = Counter(tokens(text.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(tf), batch.column("doc_id").type), pa.array(list(tf), pa.string()), pa.array(list(tf.values()), pa.int64())], ["doc_id", "term", "tf"])


def bm25(queries: DataFrame, docs: DataFrame, tokens, k: int, threshold: float = 0.0) -> DataFrame:
    """BM25+ over whole texts: query_id, rank, doc_id, raw_score, score (the raw one over the query's largest).

    ``queries`` has query_id and query_text, ``docs`` doc_id and text;
    ``tokens`` makes a token array of a text column. With df the documents
    that have a term, a repeated query term counts each time, idf is
    ln((N + 1) / df), and every document has the floor delta * idf of each
    known query term, so the floor is a constant of the query and only
    matching documents need to be joined. Documents without any query term
    are therefore not listed. Ties go to the smaller doc_id.
    """
    # texts are tokenized once, for lengths and postings; what is read twice is written
    read = written(spread(docs.select("doc_id", "text")).select("doc_id", tokens(F.col("text")).alias("tokens")), "tokens")
    stats = read.select(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avg_length"))
    asked = queries.select("query_id", F.explode(tokens(F.col("query_text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    asked = written(asked, "asked")
    asked_rows = asked.limit(MOST_HELD + 1).collect()
    if len(asked_rows) <= MOST_HELD:
        n, mean = stats.first()
        scored = batches.bm25_best(batches.Asked(asked_rows), queries.schema["query_id"].dataType, read, n, mean or 1.0, k, K1, B, DELTA)
        return _scaled(scored, k, threshold)
    found = written(postings(read, F.col("tokens")).join(asked.select("term").distinct(), "term", "left_semi"), "postings")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    weighted = asked.join(df, "term").join(F.broadcast(stats)).withColumn("idf", F.log((F.col("n") + 1) / F.col("df")) * F.col("times"))
    floor = weighted.groupBy("query_id").agg(F.sum(F.col("idf") * DELTA).alias("floor"))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    scored = found.join(weighted, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("idf") * part).alias("matched"))
    scored = scored.join(floor, "query_id").select("query_id", "doc_id", (F.col("matched") + F.col("floor")).alias("raw_score")).where("raw_score > 0")
    return _scaled(scored, k, threshold)


def _scaled(scored: DataFrame, k: int, threshold: float) -> DataFrame:
    """The ``k`` best of each query, with the score as a share of its largest."""
    best = F.max("raw_score").over(Window.partitionBy("query_id"))
    ranked = top(scored, k, "query_id", F.desc(F.round("raw_score", 9)), F.asc("doc_id"))
    return ranked.withColumn("score", F.col("raw_score") / best).where(F.col("score") >= threshold)


def fuse(one: DataFrame, other: DataFrame, one_weight: Column, other_weight: Column, threshold: Column, pool: Column) -> DataFrame:
    """Weighted linear fusion of two ranked lists (query_id, item_id, rank, score).

    An item of one list only scores 0 in the other. Ties keep the order of the
    first list, then of the second. Returns query_id, item_id, dense_score,
    sparse_score, score and rank.
    """
    a = one.select("query_id", "item_id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    b = other.select("query_id", "item_id", F.col("score").alias("sparse_score"), F.col("rank").alias("sparse_rank"))
    both = a.join(b, ["query_id", "item_id"], "full").fillna(0.0, ["dense_score", "sparse_score"])
    both = both.withColumn("score", one_weight * F.col("dense_score") + other_weight * F.col("sparse_score")).where(F.col("score") >= threshold)
    return top(both, pool, "query_id", F.desc(F.round("score", 9)), F.asc_nulls_last("dense_rank"), F.col("sparse_rank"), F.col("item_id")).drop("dense_rank", "sparse_rank")


def rerank(ranked: DataFrame, relevance: Column, keep: int) -> DataFrame:
    """``ranked`` in the order of ``relevance``, at least one row per query, with the rank it had."""
    scored = ranked.withColumnRenamed("rank", "rank_before").withColumn("rerank_score", relevance)
    return top(scored, max(1, keep), "query_id", F.desc("rerank_score"), F.col("rank_before"))


def lexical_relevance(query: Column, content: Column, tokens) -> Column:
    """A stand-in where no cross-encoder is at hand: the share of query tokens found in the content."""
    asked = tokens(query)
    return F.size(F.array_intersect(asked, tokens(content))) / F.greatest(F.size(F.array_distinct(asked)), F.lit(1))


def ir_metrics(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Per query: mrr and recall, precision and nDCG at each k.

    ``ranked`` has query_id, rank, target (null: irrelevant) with targets that
    may repeat; only a target's first row gains. ``relevant`` has query_id and
    n_relevant for every query, also those without results.
    """
    first = F.expr("row_number() over (partition by query_id, target order by rank) = 1")
    gained = ranked.withColumn("hit", F.col("target").isNotNull()).withColumn("gain", F.when(F.col("hit") & first, 1).otherwise(0))
    discount = 1 / F.log2(F.col("rank") + 1)
    sums = [F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_hit")]
    for k in ks:
        here = F.col("rank") <= k
        sums += [F.sum(F.when(here, F.col("gain"))).alias(f"g{k}"), F.sum(F.when(here & F.col("hit"), 1)).alias(f"h{k}"), F.sum(F.when(here & (F.col("gain") == 1), discount)).alias(f"d{k}")]
    out = relevant.join(gained.groupBy("query_id").agg(*sums), "query_id", "left")

    def ideal(k: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.lit(k), F.col("n_relevant").cast("int")), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))

    none = F.col("n_relevant") == 0
    columns = [F.coalesce(1 / F.col("first_hit"), F.lit(0.0)).alias("mrr")]
    for k in ks:
        columns += [
            F.when(none, 0.0).otherwise(F.coalesce(f"g{k}", F.lit(0)) / F.col("n_relevant")).alias(f"recall_{k}"),
            (F.coalesce(f"h{k}", F.lit(0)) / k).alias(f"precision_{k}"),
            F.when(none, 0.0).otherwise(F.coalesce(f"d{k}", F.lit(0.0)) / ideal(k)).alias(f"ndcg_{k}"),
        ]
    return out.select("query_id", *columns)


def span_hits(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """Chunks joined to the labelled line spans that they overlap: same file, closed intervals."""
    overlap = (F.col("c.start_line") <= F.col("s.span_end")) & (F.col("s.span_start") <= F.col("c.end_line"))
    return chunks.alias("c").join(spans.alias("s"), (F.col("c.file") == F.col("s.file")) & overlap).drop(F.col("s.file"))
