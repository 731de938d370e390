"""Further operators of the inventory on the given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import gate as G
from siltstone.operators import graph as K
from siltstone.operators import trials as A
from siltstone.sources.tables import read


def token_budget_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Per source the documents, in order, that fit a budget of 20,000 characters."""
    run = F.expr("sum(n_chars) over (partition by source order by doc_id rows unbounded preceding)")
    d = read(spark, sf, "documents").select("doc_id", "source", "n_chars").withColumn("filled", run)
    return d.where("filled <= 20000").groupBy("source").agg(F.count("*").alias("n"), F.max("filled").alias("filled"))


def set_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Customers who ordered urgently and those who ordered at low priority: in both, in one only."""
    o = read(spark, sf, "orders")
    side = lambda p, name: o.where(F.col("o_orderpriority") == p).select("o_custkey").distinct().withColumn(name, F.lit(True))
    both = side("1-URGENT", "a").join(side("5-LOW", "b"), "o_custkey", "full")
    return both.agg(F.count_if(F.col("a") & F.col("b")).alias("n_both"), F.count_if(F.col("b").isNull()).alias("n_only_a"), F.count_if(F.col("a").isNull()).alias("n_only_b"))


def progress_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Per day the events of each type side by side, and whether the share of errors is over 30 %."""
    e = read(spark, sf, "events").withColumn("day", F.to_date("ts"))
    types = ("click", "purchase", "view", "error")
    p = e.groupBy("day").agg(F.count("*").alias("n"), *(F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in types), F.round(F.greatest(F.lit(0.1), F.avg("value")), 6).alias("mean_value"))
    return p.withColumn("alert", F.col("n_error") / F.col("n") > 0.30)


def span_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """The digest of lines 2 to 4 of each document that has them."""
    d = read(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("l")).where(F.size("l") >= 4)
    return d.select("doc_id", F.sha2(F.array_join(F.slice("l", 2, 3), "\n"), 256).alias("span_sha256"))


def history_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as commits that modify parts; those of more than five parts are left out; counted by number of parts."""
    members = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct().join(read(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")
    per = members.groupBy("l_orderkey").agg(F.count("*").alias("n_parts")).where("n_parts <= 5")
    return per.groupBy("n_parts").agg(F.count("*").alias("n_commits"))


def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Part names that occur more than once."""
    return read(spark, sf, "part").groupBy("p_name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).where("n > 1")


def neighbours_two_hops(spark: SparkSession, sf: str) -> DataFrame:
    """Edges walked from each region in up to two hops outward, by relation."""
    r, n, c = (read(spark, sf, t) for t in ("region", "nation", "customer"))
    edges = n.select(F.concat(F.lit("r:"), "n_regionkey").alias("src"), F.concat(F.lit("n:"), "n_nationkey").alias("tgt"), F.lit("CONTAINS").alias("rel"))
    edges = edges.union(c.select(F.concat(F.lit("n:"), "c_nationkey"), F.concat(F.lit("c:"), "c_custkey"), F.lit("HAS")))
    start = r.select(F.concat(F.lit("r:"), "r_regionkey").alias("node_id"))
    return K.neighbours(start, edges, None, "out", 2).groupBy("rel", "hop").agg(F.count("*").alias("n"))


def calibration_winner(spark: SparkSession, sf: str) -> DataFrame:
    """Per segment the customer with the best balance, then the fewest orders, then the smallest key."""
    n = read(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = read(spark, sf, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").fillna(0, ["n"])
    return c.groupBy("c_mktsegment").agg(F.max_by(F.struct("c_custkey", "n"), F.struct("c_acctbal", -F.col("n"), -F.col("c_custkey"))).alias("w")).select("c_mktsegment", "w.c_custkey", "w.n")


def success_types(spark: SparkSession, sf: str) -> DataFrame:
    """Events as trials with made scores, counted by kind of success; a missing score is no failure."""
    e = F.col("event_id")
    scores = {"correctness": F.when(e % 8 != 0, (e % 10) / 10), "citation": (e % 7) / 7, "relevance": (e % 5) / 5, "coverage": (e % 3) / 3, "consistency": F.lit(1.0)}
    quality = G.composite(**scores)
    kind = G.success_type(e % 9 == 0, e % 2 == 0, quality, scores["correctness"], scores["citation"], F.lit(0.5))
    t = read(spark, sf, "events").select(kind.alias("success_type"), quality.alias("quality"), (quality / F.greatest(F.lit(0.001), F.col("value"))).alias("per_joule"))
    return t.groupBy("success_type").agg(F.count("*").alias("n"), F.count("quality").alias("n_scored"), F.round(F.avg("quality"), 8).alias("mean_quality"), F.round(F.avg("per_joule"), 8).alias("mean_per_joule"))


def carbon_by_system(spark: SparkSession, sf: str) -> DataFrame:
    """Energy, carbon and token cost per type of event, with a regional intensity by user; unknown regions take the default."""
    grams = F.when(F.col("user_id") % 3 == 0, 56.0).when(F.col("user_id") % 3 == 1, 385.0).otherwise(475.0)
    e = read(spark, sf, "events").withColumns({"g": A.carbon(F.col("value") * 1000, grams), "usd": A.token_cost(F.length("props"), F.lit(4.0))})
    return e.groupBy("event_type").agg(F.round(F.sum("g"), 5).alias("grams"), F.round(F.sum("usd"), 8).alias("usd"), F.round(F.sum("g") / F.count_if(F.col("value") > 100), 7).alias("grams_per_success"))


def deltas_between_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds between a user's events: count, mean, extremes, and the distinct types in order."""
    e = read(spark, sf, "events").withColumn("d", F.expr("(unix_micros(ts) - lag(unix_micros(ts)) over (partition by user_id order by event_id)) / 1e6"))
    return e.groupBy("user_id").agg(F.count("d").alias("n"), F.round(F.avg("d"), 4).alias("mean"), F.round(F.min("d"), 4).alias("low"), F.round(F.max("d"), 4).alias("high"), F.array_join(F.sort_array(F.collect_set("event_type")), "|").alias("types"))


QUERIES = {
    f.__name__: f
    for f in (token_budget_fill, set_differences, progress_pivot, span_hashes, history_edges, duplicate_keys, neighbours_two_hops, calibration_winner, success_types, carbon_by_system, deltas_between_samples)
}

ORACLES = {
    "token_budget_fill": "SELECT source, count(*) AS n, max(f)::BIGINT AS filled FROM (SELECT source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS f FROM documents) WHERE f <= 20000 GROUP BY 1",
    "set_differences": """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '5-LOW')
SELECT count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS n_both, count(*) FILTER (WHERE b.k IS NULL) AS n_only_a, count(*) FILTER (WHERE a.k IS NULL) AS n_only_b FROM a FULL JOIN b ON a.k = b.k""",
    "progress_pivot": """SELECT ts::DATE AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE event_type = 'purchase') AS n_purchase, count(*) FILTER (WHERE event_type = 'view') AS n_view,
  count(*) FILTER (WHERE event_type = 'error') AS n_error, round(greatest(0.1, avg(value)), 6) AS mean_value, count(*) FILTER (WHERE event_type = 'error') / count(*) > 0.3 AS alert FROM events GROUP BY 1""",
    "span_hashes": "SELECT doc_id, sha256(array_to_string(l[2:4], chr(10))) AS span_sha256 FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) WHERE len(l) >= 4",
    "history_edges": """SELECT n_parts, count(*) AS n_commits FROM (SELECT l_orderkey, count(*) AS n_parts FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part)) GROUP BY 1 HAVING count(*) <= 5) GROUP BY 1""",
    "duplicate_keys": "SELECT p_name, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1 HAVING count(*) > 1",
    "neighbours_two_hops": "SELECT 'CONTAINS' AS rel, 1 AS hop, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'HAS', 2, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "calibration_winner": """SELECT c_mktsegment, c_custkey, n FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, n, c_custkey) AS r FROM (
  SELECT c_mktsegment, c_custkey, c_acctbal, coalesce(o.n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey)) WHERE r = 1""",
    "success_types": """WITH s AS (SELECT event_id AS e, value, CASE WHEN event_id % 8 <> 0 THEN (event_id % 10) / 10 END AS cor, (event_id % 7) / 7 AS cit, (event_id % 5) / 5 AS rel, (event_id % 3) / 3 AS cov FROM events),
q AS (SELECT *, 0.40::DOUBLE * cor + 0.25::DOUBLE * cit + 0.15::DOUBLE * rel + 0.10::DOUBLE * cov + 0.10::DOUBLE AS quality FROM s),
t AS (SELECT *, CASE WHEN e % 9 = 0 AND e % 2 = 0 THEN 'UNFOUNDED_REFUSAL' WHEN e % 9 = 0 THEN 'VALID_REFUSAL' WHEN quality IS NULL THEN 'MISSING_SCORES' WHEN quality >= 0.5 AND cor >= 0.5 THEN 'QUALITY_PASS' WHEN cit < 0.5 THEN 'CITATION_FAILURE' ELSE 'QUALITY_FAILURE' END AS success_type FROM q)
SELECT success_type, count(*) AS n, count(quality) AS n_scored, round(avg(quality), 8) AS mean_quality, round(avg(quality / greatest(0.001, value)), 8) AS mean_per_joule FROM t GROUP BY 1""",
    "carbon_by_system": """WITH e AS (SELECT event_type, value, value * 1000 / 3.6e6 * CASE user_id % 3 WHEN 0 THEN 56 WHEN 1 THEN 385 ELSE 475 END AS g, length(props) / 1e6 * 4 AS usd FROM events)
SELECT event_type, round(sum(g), 5) AS grams, round(sum(usd), 8) AS usd, round(sum(g) / count(*) FILTER (WHERE value > 100), 7) AS grams_per_success FROM e GROUP BY 1""",
    "deltas_between_samples": """WITH d AS (SELECT user_id, event_type, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id)) / 1e6 AS d FROM events)
SELECT user_id, count(d) AS n, round(avg(d), 4) AS mean, round(min(d), 4) AS low, round(max(d), 4) AS high, array_to_string(list_sort(list_distinct(list(event_type))), '|') AS types FROM d GROUP BY 1""",
}
