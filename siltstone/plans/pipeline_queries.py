"""Queries on ingestion, constraints, logs and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions.embedding import hashed_embedding
from siltstone.operators import constraints as V
from siltstone.operators import gate as G
from siltstone.operators import ingest as I
from siltstone.operators import retrieval as R
from siltstone.operators import stats as S
from siltstone.plans import adaptive
from siltstone.sources import storage
from siltstone.sources.files import json_log
from siltstone.sources.tables import read
from siltstone.streaming import streams


def document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The line-packed chunks of all documents, at most 512 tokens each."""
    return I.chunk(read(spark, sf, "documents"), "doc_id", "text", 512).select("doc_id", "chunk_index", "start_line", "end_line", "token_count", F.sha2("content", 256).alias("content_hash"))


def chunk_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks over the limit or with lines out of order: none."""
    chunks = I.chunk(read(spark, sf, "documents"), "doc_id", "text", 512)
    rules = {"size": F.col("token_count") <= 512, "order": F.col("end_line") >= F.col("start_line")}
    return V.broken(chunks, "doc_id", rules)


def trial_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Events as trials: how many break which rule."""
    t = read(spark, sf, "events").withColumns({"latency": F.col("value") * 300, "quality": F.col("value") / 400})
    return V.broken(t, "event_id", V.trial_rules(F.col("latency"), F.length("props"), F.col("quality"))).groupBy("rule").agg(F.count("*").alias("n"))


def gapless_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations whose turns are not numbered without gaps from 0."""
    return V.gapless(read(spark, sf, "conversations"), "conv_id", "turn", 0)


def hysteresis(spark: SparkSession, sf: str) -> DataFrame:
    """Per user, events that fall in a hot phase: from a value over 200 until one of at most 100."""
    flag = F.when(F.col("value") > 200, True).when(F.col("value") <= 100, False)
    e = read(spark, sf, "events").withColumn("flag", flag)
    hot = e.withColumn("hot", F.expr("coalesce(last(flag, true) over (partition by user_id order by event_id rows unbounded preceding), false)"))
    return hot.groupBy("user_id").agg(F.count_if("hot").alias("n_hot"), F.count("*").alias("n"))


def stable_state(spark: SparkSession, sf: str) -> DataFrame:
    """Per user, events at which the last six values all stayed under 250."""
    e = read(spark, sf, "events").withColumn("ok", F.expr("min(int(value < 250)) over (partition by user_id order by event_id rows between 5 preceding and current row)"))
    return e.groupBy("user_id").agg(F.sum("ok").alias("n_stable"))


def nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest-rank percentiles of order totals per priority, half to even, by position in the order."""
    o = read(spark, sf, "orders").withColumn("pos", F.expr("row_number() over (partition by o_orderpriority order by o_totalprice, o_orderkey) - 1"))
    n = o.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    at = lambda q: F.bround((F.col("n") - 1) * q).cast("long")
    j = o.join(n, "o_orderpriority")
    return j.groupBy("o_orderpriority").agg(*(F.max(F.when(F.col("pos") == at(q), F.col("o_totalprice"))).alias(f"p{int(q * 100)}") for q in (0.5, 0.95)))


def round_robin_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A sample of a thousand orders that takes turns over the strata."""
    o = read(spark, sf, "orders").withColumn("h", S.hash_order(F.col("o_orderkey"), "7"))
    o = o.withColumn("turn", F.expr("row_number() over (partition by o_orderpriority, o_orderstatus order by h)"))
    return o.orderBy("turn", "o_orderpriority", "o_orderstatus").limit(1000).select("o_orderkey", "o_orderpriority", "o_orderstatus", "turn")


def log_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as a log of JSON lines and read back with a schema: counts by type."""
    path = storage.shared_path(spark, "event-log")
    read(spark, sf, "events").select("event_id", "event_type", "value").write.json(path)
    return json_log(spark, path, "event_id long, event_type string, value double").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def upserted(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings with every label-0 row replaced by its double and label 1 deleted: what is left per label."""
    e = read(spark, sf, "embeddings")
    new = e.where("label = 0").withColumn("embedding", F.transform("embedding", lambda x: (x * 2).cast("float")))
    out = storage.delete(storage.upsert(e, new, "vec_id", "embedding"), e.where("label = 1"), "vec_id")
    norm2 = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return out.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(norm2), 5).alias("norm2"))


def adaptive_rungs(spark: SparkSession, sf: str) -> DataFrame:
    """User turns asked of all documents by their own strategies; the answer is the best document's words, judged by how many of the question's it has."""
    docs = read(spark, sf, "documents")
    turns = read(spark, sf, "conversations").where("role = 'user'")
    queries = turns.select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), F.col("text").alias("query_text"))
    tokens = lambda c: F.array_distinct(T.words(F.lower(c)))
    items = docs.select(F.col("doc_id").alias("item_id"), hashed_embedding(tokens(F.col("text"))).alias("vector"))
    asking = queries.select("query_id", hashed_embedding(tokens(F.col("query_text"))).alias("query_vector"))
    paths = {leg: storage.shared_path(spark, leg) for leg in ("dense", "sparse")}
    R.dense(asking, items, adaptive.WIDEST).write.parquet(paths["dense"])
    R.bm25(queries, docs, tokens, adaptive.WIDEST).withColumnRenamed("doc_id", "item_id").write.parquet(paths["sparse"])
    dense, sparse = spark.read.parquet(paths["dense"]), spark.read.parquet(paths["sparse"])

    def attempt(plan: DataFrame, rung: int) -> DataFrame:
        ranked = adaptive.retrieve(plan, dense, sparse)
        best = ranked.where("rank = 1").join(docs.select(F.col("doc_id").alias("item_id"), F.col("text").alias("answer")), "item_id").select("query_id", "item_id", "answer", "score")
        out = plan.select("query_id", "query_text", "strategy", "quality_threshold").join(best, "query_id", "left")
        quality = F.when(F.col("answer").isNotNull(), G.query_relevance(F.col("query_text"), F.col("answer")))
        return out.select("query_id", "strategy", "item_id", quality.alias("quality"), F.coalesce(quality >= F.col("quality_threshold"), F.lit(False)).alias("passed"))

    tried = adaptive.until_passed(adaptive.initial_plan(queries), attempt)
    return tried.groupBy("rung", "strategy").agg(F.count("*").alias("n"), F.count_if(F.col("passed")).alias("n_passed"), F.count("item_id").alias("n_answered"))


def unit_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Every event type on every user three times, in a seeded order within each round."""
    e = read(spark, sf, "events")
    units = e.select("event_type", "user_id").distinct().withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(2))))
    units = units.withColumn("unit_id", F.concat_ws("-", "event_type", "user_id", "trial"))
    return units.withColumn("position", F.row_number().over(Window.partitionBy("trial").orderBy(F.md5(F.concat_ws(":", F.lit("42"), "trial", "unit_id"))))).select("unit_id", "trial", "position")


def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return streams.drained(streams.first_seen(streams.events(spark, sf), "user_id", "event_type"), "append")


def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    out = streams.drained(streams.tumbling(streams.events(spark, sf)), "update", ("window_start", "event_type"))
    return out.withColumn("total", F.round("total", 4))


def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return streams.drained(streams.sliding(streams.events(spark, sf)), "update", ("window_start",)).withColumn("peak", F.round("peak", 6))


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return streams.drained(streams.sessions(streams.events(spark, sf)), "complete")


def stream_latest(spark: SparkSession, sf: str) -> DataFrame:
    log = streams.events(spark, sf).select("user_id", "event_id", "event_type")
    return streams.drained(streams.latest_state(log, "user_id", "event_id"), "update", ("user_id",))


QUERIES = {
    f.__name__: f
    for f in (
        document_chunks, chunk_violations, adaptive_rungs, unit_plan, trial_audit, gapless_violations, hysteresis, stable_state, nearest_rank, round_robin_sample, log_round_trip, upserted, stream_dedup, stream_tumbling, stream_sliding, stream_sessions, stream_latest,
    )
}

ORACLES = {
    "chunk_violations": "SELECT doc_id, '' AS rule FROM documents WHERE false",
    "trial_audit": """SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN NOT coalesce(value * 300 BETWEEN 0 AND 60000, false) THEN 'latency' END, CASE WHEN NOT coalesce(length(props) >= 0, false) THEN 'tokens' END,
  CASE WHEN NOT (value IS NULL OR value / 400 BETWEEN 0 AND 1) THEN 'quality' END], lambda x: x IS NOT NULL)) AS rule FROM events) GROUP BY rule""",
    "gapless_violations": "SELECT conv_id, count(*) AS n, min(turn) AS low, max(turn) AS high FROM conversations GROUP BY conv_id HAVING min(turn) <> 0 OR max(turn) <> count(*) - 1 OR count(DISTINCT turn) <> count(*)",
    "hysteresis": """SELECT user_id, count(*) FILTER (WHERE hot) AS n_hot, count(*) AS n FROM (SELECT user_id, coalesce(last_value(CASE WHEN value > 200 THEN true WHEN value <= 100 THEN false END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), false) AS hot FROM events) GROUP BY user_id""",
    "stable_state": "SELECT user_id, sum(ok)::BIGINT AS n_stable FROM (SELECT user_id, min((value < 250)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS ok FROM events) GROUP BY user_id",
    "nearest_rank": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority, max(o_totalprice) FILTER (WHERE pos = round_even((n - 1) * 0.5, 0)) AS p50, max(o_totalprice) FILTER (WHERE pos = round_even((n - 1) * 0.95, 0)) AS p95 FROM o GROUP BY 1""",
    "round_robin_sample": """WITH o AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY md5('7:' || o_orderkey)) AS turn FROM orders)
SELECT * FROM o ORDER BY turn, o_orderpriority, o_orderstatus LIMIT 1000""",
    "log_round_trip": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1",
    "upserted": """SELECT label, count(*) AS n, round(avg(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) * CASE WHEN label = 0 THEN 4 ELSE 1 END), 5) AS norm2 FROM embeddings WHERE label <> 1 GROUP BY label""",
    "unit_plan": """WITH u AS (SELECT DISTINCT event_type, user_id FROM events), t AS (SELECT event_type || '-' || user_id || '-' || trial AS unit_id, trial FROM u, (SELECT unnest([0, 1, 2]) AS trial))
SELECT unit_id, trial, row_number() OVER (PARTITION BY trial ORDER BY md5('42:' || trial || ':' || unit_id)) AS position FROM t""",
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_tumbling": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_sliding": """SELECT w AS window_start, count(*) AS n, round(max(value), 6) AS peak FROM (SELECT value, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS w FROM events
  ) GROUP BY w""",
    "stream_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM g GROUP BY user_id, k""",
    "stream_latest": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
}
