"""Queries on graphs, trials, statistics and page texts, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import gate as G
from siltstone.operators import graph as K
from siltstone.operators import stats as S
from siltstone.operators import trials as A
from siltstone.sources.tables import read




def _trials(spark: SparkSession, sf: str) -> DataFrame:
    """Events as trials: the system is the type, the task the user, the quality the value; every seventh event is unscored."""
    quality = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    return read(spark, sf, "events").select(F.col("event_type").alias("system_id"), F.col("user_id").alias("task_id"), "event_id", "ts", quality.alias("quality"), F.length("props").cast("double").alias("cost"))


SQL_TRIALS = "trials AS (SELECT event_type AS system_id, user_id AS task_id, event_id, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS quality, length(props)::DOUBLE AS cost FROM events)"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All ordered pairs of the few systems there are."""
    names = read(spark, sf, "events").select(F.col("event_type").alias("a")).distinct()
    return names.join(names.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))


def trial_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    return A.per_task(_trials(spark, sf), ("quality", "cost"))


def system_summary(spark: SparkSession, sf: str) -> DataFrame:
    return A.per_system(A.per_task(_trials(spark, sf), ("quality", "cost")), ("quality", "cost"))


_TASK = f"""{SQL_TRIALS}, task AS (SELECT system_id, task_id, count(*) AS n_trials, count(quality) AS n_scored,
  avg(quality) AS mean_quality, CASE WHEN count(quality) > 1 THEN stddev_samp(quality) WHEN count(quality) = 1 THEN 0 END AS std_quality, median(quality) AS median_quality,
  avg(cost) AS mean_cost, CASE WHEN count(cost) > 1 THEN stddev_samp(cost) WHEN count(cost) = 1 THEN 0 END AS std_cost, median(cost) AS median_cost FROM trials GROUP BY system_id, task_id)"""
_SYSTEM = f"""{_TASK}, sys AS (SELECT system_id, count(*) AS n_tasks, count(*) FILTER (WHERE n_scored = 0) AS n_unscored, avg(mean_quality) AS mean_quality,
  CASE WHEN count(mean_quality) > 1 THEN stddev_samp(mean_quality) WHEN count(mean_quality) = 1 THEN 0 END AS std_quality, avg(mean_cost) AS mean_cost,
  CASE WHEN count(mean_cost) > 1 THEN stddev_samp(mean_cost) WHEN count(mean_cost) = 1 THEN 0 END AS std_cost FROM task GROUP BY system_id)"""


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes))


def ablation_deltas(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _pairs(spark, sf).select(F.col("a").alias("from_system"), F.col("b").alias("to_system"))
    return _rounded(A.deltas(system_summary(spark, sf), pairs, ("mean_quality", "mean_cost")))


def pareto_frontier(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers by balance against the mean price of what they ship."""
    cost = read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_extendedprice"), 2).alias("cost"))
    points = read(spark, sf, "supplier").join(cost, F.col("s_suppkey") == F.col("l_suppkey")).select("s_suppkey", F.col("s_acctbal").alias("quality"), "cost")
    return A.pareto(points, "quality", "cost").select("s_suppkey", "quality", "cost")


def cost_per_success(spark: SparkSession, sf: str) -> DataFrame:
    """Finished orders as successes; open ones are unknown."""
    status = F.col("o_orderstatus")
    success = F.when(status != "O", status == "F")
    out = A.per_success(read(spark, sf, "orders"), success, F.col("o_totalprice"), "o_orderpriority")
    return _rounded(out, 4)


def paired_holm(spark: SparkSession, sf: str) -> DataFrame:
    means = S.task_means(_trials(spark, sf).withColumn("quality", F.round("quality", 6)), "quality")
    out = S.compare(means.withColumn("value", F.round("value", 6)), _pairs(spark, sf))
    tested = S.holm(out.withColumns({"name": F.concat_ws("-", "a", "b"), "family": F.lit("all")}), "family")
    return _rounded(tested.select("a", "b", "n", "mean_diff", "median_diff", "w_plus", "w_minus", "rank_biserial", "p_value", "p_adjusted"), 5)


_TAIL = "exp(-z * z / 2) / sqrt(2 * pi()) * (t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))"
SQL_HOLM = f"""WITH {SQL_TRIALS},
means AS (SELECT system_id, task_id, round(avg(round(quality, 6)), 6) AS v FROM trials WHERE quality IS NOT NULL GROUP BY ALL),
r AS (SELECT x.system_id AS a, y.system_id AS b, y.v - x.v AS diff FROM means x JOIN means y ON x.task_id = y.task_id AND x.system_id < y.system_id),
k AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY size) + (count(*) OVER (PARTITION BY a, b, size) - 1) / 2.0 AS rk FROM (SELECT a, b, diff, round(abs(diff), 12) AS size FROM r WHERE diff <> 0)),
t AS (SELECT a, b, sum(c * c * c - c) AS ties FROM (SELECT a, b, size, count(*) AS c FROM k GROUP BY ALL) GROUP BY ALL),
w AS (SELECT a, b, count(*)::DOUBLE AS m, sum(CASE WHEN diff > 0 THEN rk ELSE 0 END) AS w_plus, sum(CASE WHEN diff < 0 THEN rk ELSE 0 END) AS w_minus FROM k GROUP BY ALL),
g AS (SELECT a, b, count(*) AS n, avg(diff) AS mean_diff, median(diff) AS median_diff FROM r GROUP BY ALL),
z AS (SELECT *, abs((least(w_plus, w_minus) - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48)) AS z FROM g JOIN w USING (a, b) JOIN t USING (a, b)),
p AS (SELECT *, 2 * {_TAIL} AS p_value FROM (SELECT *, 1 / (1 + 0.2316419 * z) AS t FROM z)),
h AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p_value, a || '-' || b) + 1) * p_value) AS raw FROM p)
SELECT a, b, n, round(mean_diff, 5) AS mean_diff, round(median_diff, 5) AS median_diff, round(w_plus, 5)::DOUBLE AS w_plus, round(w_minus, 5)::DOUBLE AS w_minus,
  round((w_plus - w_minus) / (w_plus + w_minus), 5)::DOUBLE AS rank_biserial, round(p_value, 5) AS p_value,
  round(max(raw) OVER (ORDER BY p_value, a || '-' || b ROWS UNBOUNDED PRECEDING), 5) AS p_adjusted FROM h"""


def mcnemar_counts(spark: SparkSession, sf: str) -> DataFrame:
    passed = _trials(spark, sf).groupBy("system_id", "task_id").agg((F.max("quality") >= 150).alias("passed"))
    return S.discordant(passed.where("passed is not null"), _pairs(spark, sf)).withColumn("p_value", F.round("p_value", 6))


def cohen_kappa(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(S.cohen_kappa(read(spark, sf, "labels"), "quality", "toxic"), 9)


def agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Quadratic kappa and rank correlation of two ratings of line items."""
    li = read(spark, sf, "lineitem").select((F.col("l_discount") * 100).cast("int").alias("x"), (F.col("l_tax") * 100).cast("int").alias("y"))
    return _rounded(S.quadratic_kappa(li, "x", "y").join(F.broadcast(S.spearman(li, "x", "y").drop("n"))), 8)


def co_change(spark: SparkSession, sf: str) -> DataFrame:
    members = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_partkey").alias("item"))
    return _rounded(K.co_changed(members), 9)


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Regions, nations, customers, suppliers and orders as a graph; the region is the hub."""
    r, n, c, s, o = (read(spark, sf, t) for t in ("region", "nation", "customer", "supplier", "orders"))
    node = lambda df, kind, key, label: df.select(K.node_id(kind, F.col(key).cast("string")).alias("node_id"), F.lit(label).alias("label"))
    nodes = node(r, "r", "r_regionkey", "Repository").union(node(n, "n", "n_nationkey", "Nation")).union(node(c, "c", "c_custkey", "Customer")).union(node(s, "s", "s_suppkey", "Supplier")).union(node(o, "o", "o_orderkey", "Order"))

    def edge(df: DataFrame, a: tuple[str, str], b: tuple[str, str], rel: str) -> DataFrame:
        side = lambda x: K.node_id(x[0], F.col(x[1]).cast("string"))
        return df.select(side(a).alias("src"), side(b).alias("tgt"), F.lit(rel).alias("rel"))

    edges = edge(n, ("r", "n_regionkey"), ("n", "n_nationkey"), "CONTAINS").union(edge(c, ("n", "c_nationkey"), ("c", "c_custkey"), "HAS")).union(edge(s, ("n", "s_nationkey"), ("s", "s_suppkey"), "HAS")).union(edge(o, ("c", "o_custkey"), ("o", "o_orderkey"), "PLACED"))
    return nodes, edges


SQL_GRAPH = """nodes AS (SELECT 'r:' || r_regionkey AS node_id, 'Repository' AS label FROM region UNION ALL SELECT 'n:' || n_nationkey, 'Nation' FROM nation UNION ALL SELECT 'c:' || c_custkey, 'Customer' FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'Supplier' FROM supplier UNION ALL SELECT 'o:' || o_orderkey, 'Order' FROM orders),
edges AS (SELECT 'r:' || n_regionkey AS src, 'n:' || n_nationkey AS tgt, 'CONTAINS' AS rel FROM nation UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey, 'HAS' FROM customer
  UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey, 'HAS' FROM supplier UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey, 'PLACED' FROM orders)"""


def graph_expand_hops(spark: SparkSession, sf: str) -> DataFrame:
    """From every nation two hops out, never through its region."""
    nodes, edges = _graph(spark, sf)
    seeds = nodes.where("label = 'Nation'").select(F.col("node_id").alias("seed"))
    found = K.expand(seeds, edges, nodes, 2).join(nodes, "node_id")
    return found.groupBy("seed", "hop", "label").agg(F.count("*").alias("n"))


def graph_counts(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _graph(spark, sf)
    return K.counts(nodes, K.valid_edges(edges, nodes))


def orphan_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as edges from orders to parts, where only finished orders exist: kept and dropped per return flag."""
    orders = read(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("o:"), "o_orderkey").alias("node_id"))
    nodes = orders.union(read(spark, sf, "part").select(F.concat(F.lit("p:"), "p_partkey")))
    edges = read(spark, sf, "lineitem").select(F.concat(F.lit("o:"), "l_orderkey").alias("src"), F.concat(F.lit("p:"), "l_partkey").alias("tgt"), F.col("l_returnflag").alias("rel")).distinct()
    kept = K.valid_edges(edges, nodes).groupBy("rel").agg(F.count("*").alias("n_kept"))
    return kept.join(K.dangling_edges(edges, nodes).groupBy("rel").agg(F.count("*").alias("n_dropped")), "rel", "full").fillna(0)


def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    log = read(spark, sf, "events").select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))
    return A.latest(log, "user_id", F.col("event_id"))


def power_trapezoid(spark: SparkSession, sf: str) -> DataFrame:
    samples = read(spark, sf, "events").select("user_id", (F.unix_micros("ts") / 1e6).alias("t"), "value", "event_id")
    return _rounded(A.trapezoid(samples.groupBy("user_id", "t").agg(F.max("value").alias("value")), "user_id", "t", "value"), 3)


def interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as spans of thirty days from shipping, orders as spans of thirty days from ordering: overlaps within an order."""
    from siltstone.operators.retrieval import span_hits

    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("long")
    chunks = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), "l_linenumber", day("l_shipdate").alias("start_line"), (day("l_shipdate") + 30).alias("end_line"))
    spans = read(spark, sf, "orders").select(F.col("o_orderkey").alias("file"), "o_orderpriority", day("o_orderdate").alias("span_start"), (day("o_orderdate") + 30).alias("span_end"))
    return span_hits(chunks, spans).groupBy("o_orderpriority").agg(F.count("*").alias("n_overlaps"), F.countDistinct("file").alias("n_orders"))


def strata_split(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return S.stratified_split(orders, "o_orderkey", ("o_orderpriority", "o_orderstatus"))


def grouping_sets_stats(spark: SparkSession, sf: str) -> DataFrame:
    read(spark, sf, "documents").createOrReplaceTempView("grouping_documents")
    return spark.sql("SELECT lang, source, count(*) AS n, sum(n_chars) AS n_chars FROM grouping_documents GROUP BY GROUPING SETS ((lang), (source), ())")


def failure_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    """Events as trials with made measures, counted by system and primary failure."""
    c = F.col
    trials = read(spark, sf, "events").select(
        F.when(c("event_type") == "click", "system_e").when(c("event_type") == "view", "baseline_a").otherwise("system_d").alias("system_id"),
        F.concat(F.when(c("user_id") % 2 == 0, "arch-").otherwise("code-"), "user_id").alias("task_id"),
        F.when(c("event_id") % 11 == 0, "INSUFFICIENT EVIDENCE").otherwise("x").alias("answer"),
        (c("event_id") % 5).alias("n_chunks"), (c("event_id") % 3).alias("n_graph_chunks"),
        F.when(c("event_id") % 4 != 0, (c("event_id") % 100) / 100).alias("citation"), ((c("event_id") % 90) / 90).alias("consistency"), ((c("event_id") % 70) / 70).alias("relevance"),
        ((c("event_id") % 60) / 60).alias("correctness"), (c("event_id") % 2 == 0).alias("passed_gate"), ((c("event_id") % 6000) * 1.0).cast("double").alias("latency_ms"),
        F.lit(1.0).alias("energy_joules"), F.lit(0.0).alias("cost_usd"),
    )
    return G.failures(trials).groupBy("system_id", "primary_failure").agg(F.count("*").alias("n"), F.sum(F.size("secondary_failures")).alias("n_secondary"))


def quality_labels_left(spark: SparkSession, sf: str) -> DataFrame:
    """Rates over what is labelled; what isn't is counted, not taken as zero."""
    d, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    j = d.select("doc_id", "source").join(labels, "doc_id", "left")
    known = F.col("quality").isNotNull()
    return _rounded(j.groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("n_labelled"), A.rate(F.col("quality") == 1, known).alias("quality_rate"), A.rate(F.col("toxic") == 1, known).alias("toxic_rate")), 9)


def page_text_extract(spark: SparkSession, sf: str) -> DataFrame:
    pages = read(spark, sf, "pages")
    grab = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return pages.select("page_id", grab(F.col("url"), r"^[a-z]+://([^/]+)").alias("host"), grab(F.col("html"), r"(?s)<title>(.*?)</title>").alias("title"), F.regexp_count("html", F.lit("<a ")).cast("long").alias("n_links"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("n_paragraphs"))


def citation_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Line citations as an answer would carry them, made from the conversations' own numbers, with swapped lines put in order."""
    t = read(spark, sf, "conversations")
    answer = F.concat(F.col("text"), F.lit(" [./src/app"), F.col("conv_id") % 7, F.lit(".py:L"), 1 + F.col("turn") * 3, F.lit("-L"), 10 - F.col("turn"), F.lit("] [docs/a.md]"))
    cited = t.select("conv_id", "turn", F.explode(T.line_citations(answer)).alias("c"), F.size(T.file_citations(answer)).alias("n_files"))
    return cited.groupBy("c.path", "c.start_line", "c.end_line").agg(F.count("*").alias("n"), F.sum("n_files").alias("n_files"))


def gate_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Events as quality signals of users' tasks: weighted mean without the unscored, veto by a failed zero."""
    s = read(spark, sf, "events").select(
        F.col("user_id").alias("task_id"), F.when(F.col("event_type") == "click", "FAILED").when(F.col("event_type") == "view", "SKIPPED").otherwise("PASSED").alias("status"),
        F.when(F.col("event_id") % 9 != 0, F.least(F.lit(1.0), F.round(F.col("value") / 300, 6))).alias("score"), (1 + F.col("event_id") % 3).cast("double").alias("weight"),
    )
    return _rounded(G.gate(s, F.lit(0.25)), 9)


def pending_units(spark: SparkSession, sf: str) -> DataFrame:
    """Customers planned, orders done: how many customers of each segment have no finished order."""
    plan = read(spark, sf, "customer").select(F.col("c_custkey").alias("unit_id"), "c_mktsegment")
    ledger = read(spark, sf, "orders").select(F.col("o_custkey").alias("unit_id"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("error").alias("status"))
    return A.pending(plan, ledger, retry_errors=True).groupBy("c_mktsegment").agg(F.count("*").alias("n_pending"))


def price_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Parts priced by the longest listed beginning of their type: brands as models, a dimension from the parts themselves."""
    parts = read(spark, sf, "part").select("p_partkey", F.col("p_type").alias("model_id"))
    first = F.split("model_id", " ")[0]
    prices = parts.groupBy(first.alias("name")).agg(F.min("p_partkey").alias("position")).select("name", "position", (F.length("name") * 1.0).cast("double").alias("input_price"), (F.length("name") * 2.0).cast("double").alias("output_price"))
    return A.price(parts, prices.where("length(name) > 5")).groupBy("model_id").agg(F.max("input_price").alias("input_price"), F.max("output_price").alias("output_price"), F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        trial_aggregates, system_summary, ablation_deltas, pareto_frontier, cost_per_success, paired_holm, mcnemar_counts, cohen_kappa, agreement, co_change, graph_expand_hops, graph_counts, orphan_edges, latest_per_key,
        power_trapezoid, interval_overlap, strata_split, grouping_sets_stats, failure_taxonomy, quality_labels_left, page_text_extract, citation_parse, gate_signals, pending_units, price_lookup,
    )
}

ORACLES = {
    "trial_aggregates": f"WITH {_TASK} SELECT * FROM task",
    "system_summary": f"WITH {_SYSTEM} SELECT * FROM sys",
    "ablation_deltas": f"WITH {_SYSTEM} SELECT a.system_id AS from_system, b.system_id AS to_system, round(b.mean_quality - a.mean_quality, 6) AS delta_mean_quality, round(b.mean_cost - a.mean_cost, 6) AS delta_mean_cost FROM sys a JOIN sys b ON a.system_id < b.system_id",
    "pareto_frontier": """WITH p AS (SELECT s_suppkey, s_acctbal AS quality, cost FROM supplier JOIN (SELECT l_suppkey, round(avg(l_extendedprice), 2) AS cost FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey)
SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.quality >= p.quality AND q.cost <= p.cost AND (q.quality > p.quality OR q.cost < p.cost))""",
    "cost_per_success": """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_success, count(*) FILTER (WHERE o_orderstatus <> 'O') AS n_known,
  round(sum(o_totalprice) / nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0), 4) AS cost_per_success, round(avg((o_orderstatus = 'F')::INT::DOUBLE) FILTER (WHERE o_orderstatus <> 'O'), 4) AS success_rate FROM orders GROUP BY 1""",
    "paired_holm": SQL_HOLM,
    "mcnemar_counts": f"""WITH {SQL_TRIALS}, f AS (SELECT system_id, task_id, max(quality) >= 150 AS passed FROM trials GROUP BY ALL HAVING max(quality) IS NOT NULL),
c AS (SELECT x.system_id AS a, y.system_id AS b, count(*) AS n, count(*) FILTER (WHERE x.passed AND NOT y.passed) AS only_a, count(*) FILTER (WHERE y.passed AND NOT x.passed) AS only_b
  FROM f x JOIN f y ON x.task_id = y.task_id AND x.system_id < y.system_id GROUP BY ALL)
SELECT *, CASE WHEN only_a + only_b = 0 THEN 1 ELSE round(least(1, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1), lambda k: exp(lgamma(only_a + only_b + 1) - lgamma(k + 1) - lgamma(only_a + only_b - k + 1) - (only_a + only_b) * ln(2))))), 6) END::DOUBLE AS p_value FROM c""",
    "cohen_kappa": """WITH p AS (SELECT quality AS x, toxic AS y FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), n AS (SELECT count(*)::DOUBLE AS n, avg((x = y)::INT) AS o FROM p),
e AS (SELECT sum(r * k) AS rk FROM (SELECT x AS v, count(*)::DOUBLE AS r FROM p GROUP BY 1) JOIN (SELECT y AS v, count(*)::DOUBLE AS k FROM p GROUP BY 1) USING (v))
SELECT n::BIGINT AS n, round(o, 9) AS observed, round(rk / (n * n), 9) AS expected, round((o - rk / (n * n)) / (1 - rk / (n * n)), 9) AS kappa FROM n, e""",
    "agreement": """WITH l AS (SELECT trunc(l_discount * 100)::INT AS x, trunc(l_tax * 100)::INT AS y FROM lineitem),
r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM l)
SELECT count(*) AS n, round(1 - avg((x - y) * (x - y)) / (var_pop(x) + var_pop(y) + (avg(x) - avg(y)) * (avg(x) - avg(y))), 8) AS weighted_kappa, round(corr(rx, ry), 8) AS rho FROM r""",
    "co_change": """WITH m AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS i FROM lineitem), c AS (SELECT i, count(*) AS n FROM m GROUP BY 1),
p AS (SELECT x.i AS a, y.i AS b, count(*) AS n FROM m x JOIN m y ON x.g = y.g AND x.i <> y.i GROUP BY ALL HAVING count(*) >= 2)
SELECT a, b, p.n, round(p.n / sqrt(ca.n * cb.n), 9) AS cosine FROM p JOIN c ca ON ca.i = a JOIN c cb ON cb.i = b""",
    "graph_expand_hops": f"""WITH RECURSIVE {SQL_GRAPH}, s AS (SELECT src AS f, tgt AS t FROM edges UNION ALL SELECT tgt, src FROM edges),
w AS (SELECT node_id AS seed, node_id, 0 AS hop FROM nodes WHERE label = 'Nation' UNION SELECT w.seed, s.t, w.hop + 1 FROM w JOIN s ON s.f = w.node_id JOIN nodes n ON n.node_id = s.t WHERE w.hop < 2 AND n.label <> 'Repository')
SELECT seed, hop, label, count(*) AS n FROM (SELECT seed, node_id, min(hop) AS hop FROM w GROUP BY ALL) JOIN nodes USING (node_id) WHERE hop > 0 GROUP BY ALL""",
    "graph_counts": f"""WITH {SQL_GRAPH} SELECT 'node' AS kind, label AS name, count(DISTINCT node_id) AS n FROM nodes GROUP BY ALL
UNION ALL SELECT 'edge', rel, count(DISTINCT (src, tgt)) FROM edges WHERE src IN (SELECT node_id FROM nodes) AND tgt IN (SELECT node_id FROM nodes) GROUP BY ALL""",
    "orphan_edges": """WITH e AS (SELECT DISTINCT l_orderkey, l_partkey, l_returnflag AS rel FROM lineitem), k AS (SELECT *, l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_partkey IN (SELECT p_partkey FROM part) AS good FROM e)
SELECT rel, count(*) FILTER (WHERE good) AS n_kept, count(*) FILTER (WHERE NOT good) AS n_dropped FROM k GROUP BY rel""",
    "latest_per_key": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY user_id",
    "power_trapezoid": """WITH s AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, max(value) AS value FROM events GROUP BY ALL), a AS (SELECT *, (t - lag(t) OVER w) * (value + lag(value) OVER w) / 2 AS area FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, count(*) AS n_samples, round(sum(area), 3) AS integral, round(max(value), 3) AS peak, round(avg(value), 3) AS mean FROM a GROUP BY user_id""",
    "interval_overlap": """SELECT o_orderpriority, count(*) AS n_overlaps, count(DISTINCT l_orderkey) AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_shipdate::DATE <= o_orderdate::DATE + 30 AND o_orderdate::DATE <= l_shipdate::DATE + 30 GROUP BY 1""",
    "strata_split": """WITH o AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY md5('42:' || o_orderkey), o_orderkey) AS n, count(*) OVER (PARTITION BY o_orderpriority, o_orderstatus) AS k FROM orders)
SELECT o_orderkey, o_orderpriority, o_orderstatus, CASE WHEN n <= floor(k * 0.4 + 0.5) THEN 'dev' WHEN n <= floor(k * 0.4 + 0.5) + floor(k * 0.2 + 0.5) THEN 'val' ELSE 'test' END AS split FROM o""",
    "grouping_sets_stats": "SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY GROUPING SETS ((lang), (source), ())",
    "failure_taxonomy": """WITH t AS (SELECT CASE event_type WHEN 'click' THEN 'system_e' WHEN 'view' THEN 'baseline_a' ELSE 'system_d' END AS s, user_id % 2 = 0 AS arch, event_id AS e FROM events),
f AS (SELECT s, list_filter([CASE WHEN s <> 'baseline_a' AND e % 5 = 0 THEN 'retrieval_miss' END, CASE WHEN s IN ('system_d', 'system_e') AND e % 3 = 0 AND arch THEN 'graph_miss' END,
  CASE WHEN e % 11 <> 0 AND (e % 4 = 0 OR (e % 100) / 100.0 < 0.70) THEN 'unsupported_citation' END, CASE WHEN (e % 90) / 90.0 < 0.70 THEN 'hallucination' END, CASE WHEN (e % 70) / 70.0 < 0.50 THEN 'irrelevant_evidence' END,
  CASE WHEN e % 6000 > 5000 THEN 'excessive_latency' END, CASE WHEN s = 'system_e' AND e % 2 <> 0 AND (e % 60) / 60.0 >= 0.85 THEN 'quality_gate_false_negative' END,
  CASE WHEN s = 'system_e' AND e % 2 = 0 AND (e % 60) / 60.0 < 0.50 THEN 'quality_gate_false_positive' END], lambda x: x IS NOT NULL) AS fs FROM t)
SELECT s AS system_id, coalesce(fs[1], 'no_failure') AS primary_failure, count(*) AS n, sum(greatest(len(fs) - 1, 0))::BIGINT AS n_secondary FROM f GROUP BY ALL""",
    "quality_labels_left": "SELECT source, count(*) AS n, count(quality) AS n_labelled, round(avg((quality = 1)::INT::DOUBLE), 9) AS quality_rate, round(avg((toxic = 1)::INT::DOUBLE), 9) AS toxic_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
    "page_text_extract": r"""SELECT page_id, nullif(regexp_extract(url, '^[a-z]+://([^/]+)', 1), '') AS host, nullif(regexp_extract(html, '<title>((?s:.*?))</title>', 1), '') AS title,
  len(regexp_extract_all(html, '<a ')) AS n_links, len(regexp_extract_all(html, '<p>')) AS n_paragraphs FROM pages""",
    "citation_parse": "SELECT 'src/app' || conv_id % 7 || '.py' AS path, least(1 + turn * 3, 10 - turn) AS start_line, greatest(1 + turn * 3, 10 - turn) AS end_line, count(*) AS n, count(*) AS n_files FROM conversations GROUP BY ALL",
    "gate_signals": """WITH s AS (SELECT user_id AS task_id, CASE event_type WHEN 'click' THEN 'FAILED' WHEN 'view' THEN 'SKIPPED' ELSE 'PASSED' END AS status, CASE WHEN event_id % 9 <> 0 THEN least(1.0::DOUBLE, round(value / 300, 6)) END AS score, (1 + event_id % 3)::DOUBLE AS weight FROM events),
g AS (SELECT task_id, sum(score * weight) FILTER (WHERE status <> 'SKIPPED') / nullif(sum(weight) FILTER (WHERE status <> 'SKIPPED' AND score IS NOT NULL), 0) AS gate_score, count(*) AS n_signals, bool_or(status = 'FAILED' AND coalesce(score, 1) = 0) AS vetoed FROM s GROUP BY task_id)
SELECT task_id, round(gate_score, 9) AS gate_score, n_signals, vetoed, 0.25::DOUBLE AS threshold, coalesce(gate_score >= 0.25 AND NOT vetoed, false) AS passed FROM g""",
    "pending_units": "SELECT c_mktsegment, count(*) AS n_pending FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1",
    "price_lookup": """WITH t AS (SELECT p_type AS model_id, p_partkey, string_split(p_type, ' ')[1] AS w FROM part), k AS (SELECT w, min(p_partkey) AS pos FROM t WHERE length(w) > 5 GROUP BY 1),
m AS (SELECT DISTINCT model_id FROM t), j AS (SELECT model_id, arg_min(k.w, (CASE WHEN k.w = model_id THEN 0 ELSE 1 END) * 1000000000 + pos) AS w FROM m JOIN k ON starts_with(model_id, k.w) GROUP BY 1)
SELECT t.model_id, coalesce(length(j.w) * 1.0, 1.0)::DOUBLE AS input_price, coalesce(length(j.w) * 2.0, 4.0)::DOUBLE AS output_price, count(*) AS n FROM t LEFT JOIN j USING (model_id) GROUP BY ALL""",
}
