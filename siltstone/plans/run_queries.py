"""Queries on measured runs as streams, ledgers, labels, draws, and retrieval modes, each with the SQL that gives the same rows."""

from __future__ import annotations

import json
import logging

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import classify as C
from siltstone.operators import draws as D
from siltstone.operators import labels as L
from siltstone.operators import stages as S
from siltstone.plans import adaptive
from siltstone.sources import changes, storage
from siltstone.sources.tables import read
from siltstone.streaming import runs


def stream_thermal(spark: SparkSession, sf: str) -> DataFrame:
    """Events as attempts of users' machines, views as readings, in files of no order: what the thermal rule says of each attempt."""
    e = read(spark, sf, "events")
    rows = e.select(F.col("user_id").cast("string").alias("machine"), "ts", F.col("event_id").alias("seq"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("unit_id"), F.lit("ok").alias("status"), F.col("value").alias("temp"))
    folder = storage.shared_path(spark, "attempts")
    rows.repartition(4, F.xxhash64("seq")).write.parquet(folder)
    # Rows are judged once nothing earlier can come: a row long after the last one tells.
    last, days = e.agg(F.max("ts"), F.datediff(F.max("ts"), F.min("ts")) + 1).first()
    if last is None:
        return spark.createDataFrame([], runs.JUDGED)
    closing = spark.range(1).select(F.lit("end").alias("machine"), (F.lit(last) + F.expr(f"interval {2 * days + 1} days")).alias("ts"), F.lit(-1).cast("long").alias("seq"), F.lit(None).cast("string").alias("unit_id"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("double").alias("temp"))
    out, state = storage.shared_path(spark, "judged"), storage.shared_path(spark, "judged-state")
    stream = runs.thermal_rule(spark.readStream.schema(runs.ATTEMPTS).parquet(folder), f"{days} days", 200.0, 100.0)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/_batch={number}")

    def drain() -> None:
        stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()

    drain()
    closing.coalesce(1).write.mode("append").parquet(folder)
    drain()
    found = spark.read.schema(f"{runs.JUDGED}, _batch int").parquet(out)
    return found.select(F.col("machine").cast("long").alias("machine"), "seq", "unit_id", "status", "attempt", "counted", "cooling")


def ledger_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as units of a run that is stopped in its second batch, taken up again, and retried once: rows and units by status."""
    orders = read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("unit_id"), (F.col("o_orderpriority") == "5-LOW").alias("fails"), F.col("o_custkey").alias("task"))
    book = runs.Ledger(spark, storage.shared_path(spark, "ledger"), "unit_id string, status string")
    book.open(orders)
    folder = storage.shared_path(spark, "units")
    for part in range(3):
        orders.where(F.pmod(F.xxhash64("unit_id"), F.lit(3)) == part).write.mode("append").parquet(folder)
    units = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", "1").parquet(folder)
    left = [2]

    def execute(batch: DataFrame) -> DataFrame:
        left[0] -= 1
        if left[0] == 0:
            raise InterruptedError("the run is stopped here")
        return batch.select("unit_id", F.when(F.col("fails"), "error").otherwise("ok").alias("status"))

    try:
        book.run(units, execute)
    except StreamingQueryException:
        logging.getLogger(__name__).info("the run was stopped and is taken up again")
    book.run(units, execute)
    book.retry(orders, lambda todo: todo.select("unit_id", F.when(F.col("task") % 2 == 0, "ok").otherwise("error").alias("status")))
    rows = book.rows().join(book.latest().select("unit_id", F.col("status").alias("ends")), "unit_id")
    return rows.groupBy("ends").agg(F.countDistinct("unit_id").alias("n_units"), F.count("*").alias("n_rows"))


def drawn_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """What 5 and 20 documents' characters add up to in 20,000 draws, and at most."""
    d = read(spark, sf, "documents").select(F.length("text").alias("size"))
    parts = [D.distribution(D.drawn_sums(d, "size", n), 100.0).withColumn("n", F.lit(n)).join(F.broadcast(D.worst_case(d, "size", n, 100.0))) for n in (5, 20)]
    return parts[0].unionByName(parts[1])


def borrowed_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of orders as evidence, of which some have no line numbers and borrow those of their file from the order's label, as parsed from JSON."""
    li, k = read(spark, sf, "lineitem"), F.col("l_partkey")
    file = F.concat(F.lit("m"), k % 9, F.lit(".py"))
    span = F.struct(file.alias("file"), F.col("l_quantity").cast("long").alias("start_line"), (F.col("l_quantity").cast("long") + k % 7).alias("end_line"), F.array(F.concat_ws(":", file, (k % 4).cast("string"))).alias("chunk_ids"))
    label = li.groupBy("l_orderkey").agg(F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("task_id"), F.collect_set(file).alias("relevant_files"), F.collect_list(span).alias("required_evidence"))).alias("text"))
    labels = L.parsed_labels(label, F.col("text"))
    evidence = li.select(F.col("l_orderkey").cast("string").alias("task_id"), F.col("l_linenumber").alias("place"), F.when(F.col("l_suppkey") % 11 != 0, file).alias("file_path"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_quantity").cast("long")).alias("line_start"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_quantity").cast("long") + 3).alias("line_end"))
    lent = L.borrowed_evidence(evidence, labels.select("task_id", F.inline("spans")))
    per = lent.groupBy("task_id").agg(F.count("*").alias("n"), F.count_if("from_label").alias("n_borrowed"), F.sum("start_line").alias("starts"), F.sum("end_line").alias("ends"))
    return labels.select("task_id", "n_relevant_chunks").join(per, "task_id", "left")


#: Documents in a file that arrives. A file's content is one value, so files are many rather than large.
FILE_ROWS = 100
#: Bytes of whole files that Parquet's writer and reader hold at once.
GROUP_BYTES = 16 << 20


def arrived_items(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as files of JSON in two goes, read as they arrive by the source of changed files: the hash of each text."""
    d, folder = read(spark, sf, "documents").select("doc_id", "text"), storage.shared_path(spark, "arriving")
    out, state = storage.shared_path(spark, "arrived"), storage.shared_path(spark, "arrived-state")
    for go in range(2):
        d.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == go).write.options(ignoreNullFields="false", maxRecordsPerFile=FILE_ROWS).json(f"{folder}/part{go}")
        stream = changes.arriving(spark, folder).where(F.col("path").endswith(".json"))
        stream.writeStream.format("parquet").option("parquet.block.size", str(GROUP_BYTES)).option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    lines = spark.read.schema(changes.SCHEMA).parquet(out).select(F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line")).where("line != ''")
    return lines.select(F.from_json("line", "doc_id long, text string").alias("r")).select("r.doc_id", F.sha2("r.text", 256).alias("text_sha256"))


TYPES = tuple(sorted(C.STRATEGY_OF_TYPE))
LEVELS = ("low", "medium", "high", "critical")


def mode_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as classified queries, some with a strategy of their own by name, some with numbers of their own: what each mode runs."""
    k = F.col("o_orderkey")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), n.cast("int"))
    q = read(spark, sf, "orders").select(k.alias("query_id"), pick(TYPES, k % len(TYPES)).alias("task_type"), pick(LEVELS, F.floor(k / 7) % 4).alias("criticality"))
    names = q.where("query_id % 5 = 0").select("query_id", pick(("dense", "graph_augmented", "sparse"), F.col("query_id") % 3).alias("strategy"))
    numbers = C.strategies(spark).where("strategy = 'graph_augmented'").drop("strategy", "top_k")
    configs = q.where("query_id % 15 = 0").select("query_id", F.lit("graph_augmented_esc1").alias("strategy"), F.lit(10).alias("top_k")).join(F.broadcast(numbers))
    parts = [adaptive.planned(q, mode, names, configs).groupBy("strategy", "mode", "top_k", "use_graph").agg(F.count("*").alias("n")).withColumn("run_as", F.lit(mode)) for mode in "BCD"]
    older = C.route_by_type(q, known=tuple(C.STRATEGIES)).groupBy("strategy").agg(F.count("*").alias("n")).select("strategy", F.lit(None).cast("string").alias("mode"), F.lit(None).cast("int").alias("top_k"), F.lit(None).cast("boolean").alias("use_graph"), "n", F.lit("older").alias("run_as"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(older)


def reranked_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of orders as retrieved rows, reranked by price, by quantity, not at all, or by a reranker that isn't there, as each order asks."""
    li, k = read(spark, sf, "lineitem"), F.col("query_id")
    place = F.expr("row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)")
    ranked = li.select(F.col("l_orderkey").alias("query_id"), place.alias("rank"), F.col("l_partkey").alias("item_id"), "l_extendedprice", "l_quantity")
    kind = F.when(k % 4 == 0, "price").when(k % 4 == 1, "quantity").when(k % 4 == 2, "none").otherwise("hosted")
    plan = ranked.select("query_id").distinct().select("query_id", kind.alias("reranker_type"), (k % 3).cast("int").alias("keep"))
    found = S.reranked(ranked, plan, {"price": F.col("l_extendedprice"), "quantity": F.col("l_quantity")})
    return found.select("query_id", "rank", "rank_before", "item_id", F.col("rerank_score"), "applied", "error")


QUERIES = {f.__name__: f for f in (stream_thermal, ledger_resumed, drawn_sizes, borrowed_spans, mode_plans, arrived_items, reranked_lines)}


def _mixed(x: str, shift: int, times: int | None) -> str:
    out = f"xor({x}, {x} >> {shift})"
    return f"(({out})::UHUGEINT * {times}::UHUGEINT % 18446744073709551616)::UBIGINT" if times else out


_SIZES = "v AS (SELECT length(text) AS size, row_number() OVER (ORDER BY length(text)) - 1 AS pos FROM documents), c AS (SELECT count(*) AS n FROM v)"


def _drawn_sql(n: int) -> str:
    return f"""
SELECT {n} AS n, round(avg(total), 1) AS mean, {", ".join(f"max(total) FILTER (WHERE pos = CAST(round_even(19999 * {q}, 0) AS BIGINT)) AS {name}" for q, name in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99")))}, max(total) AS max,
  (SELECT sum(size) + 100.0::DOUBLE FROM (SELECT size FROM v ORDER BY size DESC LIMIT {n})) AS worst_case
FROM (
  SELECT total, row_number() OVER (ORDER BY total) - 1 AS pos FROM (
    SELECT draw, 100.0::DOUBLE + sum(size) AS total FROM (
      SELECT draw, ({_mixed("z", 31, None)} % (SELECT n FROM c)::UBIGINT)::BIGINT AS pos FROM (
        SELECT draw, {_mixed("y", 27, D._TIMES[1])} AS z FROM (
          SELECT draw, {_mixed("x", 30, D._TIMES[0])} AS y FROM (
            SELECT draw, ((42 + draw * {n} + place + 1)::UHUGEINT * {D._STEP}::UHUGEINT % 18446744073709551616)::UBIGINT AS x FROM range(20000) AS r(draw), range({n}) AS p(place))))
    ) JOIN v USING (pos) GROUP BY draw))"""


def _case(values: dict[str, str], of: str) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


_NUMBERS = ", ".join(f"('{name}', '{row[0]}', {row[1]}, {row[7]})" for name, row in C.STRATEGIES.items())

ORACLES = {
    "stream_thermal": """
WITH e AS (SELECT user_id AS machine, event_id AS seq, CASE WHEN event_type <> 'view' THEN event_type END AS unit_id, value > 200 AS hot, ts, CASE WHEN value > 200 THEN true WHEN value <= 100 OR value IS NULL THEN false END AS flag FROM events),
c AS (SELECT *, coalesce(last_value(flag IGNORE NULLS) OVER (PARTITION BY machine ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS cooling FROM e),
g AS (SELECT *, coalesce(sum((NOT coalesce(hot, false))::INT) OVER (PARTITION BY machine, unit_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS kept FROM c WHERE unit_id IS NOT NULL),
a AS (SELECT *, ((row_number() OVER (PARTITION BY machine, unit_id, kept ORDER BY ts, seq) - 1) % 3)::INT AS attempt FROM g)
SELECT machine, seq, unit_id, CASE WHEN hot AND attempt = 2 THEN 'thermal_fail' ELSE 'ok' END AS status, attempt, NOT coalesce(hot, false) AS counted, cooling FROM a
""",
    "ledger_resumed": """
SELECT CASE WHEN o_orderpriority = '5-LOW' AND o_custkey % 2 <> 0 THEN 'error' ELSE 'ok' END AS ends, count(*) AS n_units, count(*) + count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS n_rows FROM orders GROUP BY 1
""",
    "reranked_lines": """
WITH l AS (SELECT l_orderkey AS k, l_partkey AS item_id, l_extendedprice AS p, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS before FROM lineitem),
s AS (SELECT *, CASE k % 4 WHEN 0 THEN p WHEN 1 THEN q END AS score FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC NULLS LAST, before) AS rank FROM s)
SELECT k AS query_id, rank::INT AS rank, before::INT AS rank_before, item_id, score AS rerank_score, k % 4 < 2 AS applied, CASE WHEN k % 4 = 3 THEN 'no reranker of type hosted' END AS error FROM r WHERE k % 4 >= 2 OR rank <= greatest(k % 3, 1)
""",
    "arrived_items": "SELECT doc_id, sha256(text) AS text_sha256 FROM documents",
    "drawn_sizes": f"WITH {_SIZES} {_drawn_sql(5)} UNION ALL {_drawn_sql(20)}",
    "borrowed_spans": """
WITH l AS (SELECT l_orderkey AS k, 'm' || l_partkey % 9 || '.py' AS file, l_quantity::BIGINT AS a, l_partkey % 7 AS d, l_partkey % 4 AS c, l_suppkey AS s FROM lineitem),
e AS (
  SELECT k, a, CASE WHEN s % 2 = 0 THEN a + 3 ELSE a END AS b, false AS lent FROM l WHERE s % 11 <> 0 AND s % 3 <> 0
  UNION ALL SELECT x.k, y.a, y.a + y.d, true FROM l x JOIN l y ON x.k = y.k AND x.file = y.file WHERE x.s % 11 <> 0 AND x.s % 3 = 0
),
p AS (SELECT k, count(*) AS n, count(*) FILTER (WHERE lent) AS n_borrowed, sum(a)::BIGINT AS starts, sum(b)::BIGINT AS ends FROM e GROUP BY 1)
SELECT k::VARCHAR AS task_id, count(DISTINCT file || ':' || c) AS n_relevant_chunks, any_value(n) AS n, any_value(n_borrowed) AS n_borrowed, any_value(starts) AS starts, any_value(ends) AS ends FROM l LEFT JOIN p USING (k) GROUP BY 1
""",
    "mode_plans": f"""
WITH s(strategy, mode, top_k, hops) AS (VALUES {_NUMBERS}),
q AS (SELECT o_orderkey AS k, {json.dumps(TYPES).replace('"', "'")}[o_orderkey % {len(TYPES)} + 1] AS t, ['low', 'medium', 'high', 'critical'][o_orderkey // 7 % 4 + 1] AS c FROM orders),
n AS (SELECT *, CASE WHEN k % 15 = 0 THEN 'graph_augmented_esc1' WHEN k % 5 = 0 THEN ['dense', 'graph_augmented', 'sparse'][k % 3 + 1] ELSE coalesce({_case(C.STRATEGY_OF_CRITICALITY, "c")}, {_case(C.STRATEGY_OF_TYPE, "t")}, 'hybrid') END AS strategy FROM q),
x AS (SELECT n.strategy, s.mode, CASE WHEN k % 15 = 0 THEN 10 ELSE s.top_k END AS top_k, s.hops > 0 AS graph FROM n JOIN s ON s.strategy = CASE WHEN k % 15 = 0 THEN 'graph_augmented' ELSE n.strategy END)
SELECT 'hybrid' AS strategy, 'hybrid' AS mode, 7 AS top_k, false AS use_graph, count(*) AS n, 'B' AS run_as FROM q
UNION ALL SELECT strategy, CASE mode WHEN 'graph_augmented' THEN 'hybrid' ELSE mode END, top_k, false, count(*), 'C' FROM x GROUP BY 1, 2, 3
UNION ALL SELECT strategy, mode, top_k, graph, count(*), 'D' FROM x GROUP BY 1, 2, 3, 4
UNION ALL SELECT coalesce({_case(C.ROUTES, "t")}, 'hybrid'), NULL, NULL, NULL, count(*), 'older' FROM q GROUP BY 1
""",
}
