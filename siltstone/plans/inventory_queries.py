"""Queries on evaluation by file and span, citations, run contracts, reviews, energy, agreement and small scalars, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import scalars as X
from siltstone.functions import text as T
from siltstone.operators import constraints as V
from siltstone.operators import energy as J
from siltstone.operators import evaluation as M
from siltstone.operators import stats as S
from siltstone.operators import trials as A
from siltstone.operators.text_index import TextIndex
from siltstone.plans.retrieval_queries import SQL_BM25
from siltstone.sources import storage
from siltstone.sources.tables import read

RANKED = """SELECT l_orderkey AS query_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS rank,
  concat(CASE WHEN l_suppkey % 4 = 0 THEN './' ELSE '' END, 'src/m', CAST(l_partkey % 6 AS STRING), CASE WHEN l_suppkey % 3 = 0 THEN '_old' ELSE '' END, '.py') AS file,
  CAST(l_quantity AS BIGINT) AS start_line, CAST(l_quantity AS BIGINT) + 10 AS end_line, l_returnflag = 'R' AS is_graph FROM {lineitem}"""
RANKED_SQL = RANKED.replace("STRING", "VARCHAR").format(lineitem="lineitem")


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of orders as ranked chunks of six files and their older variants."""
    return spark.sql(RANKED, lineitem=read(spark, sf, "lineitem"))


def _files(spark: SparkSession, sf: str, suffix: str = "") -> DataFrame:
    """Two relevant files per order."""
    number = F.explode(F.array(F.col("o_orderkey") % 6, (F.col("o_orderkey") + 1) % 6))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), number.alias("k")).select("query_id", F.concat(F.lit("src/m"), "k", F.lit(f"{suffix}.py")).alias("file"))


def _by_priority(spark: SparkSession, sf: str, metrics: DataFrame) -> DataFrame:
    system = read(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("system"))
    mean = M.mean_metrics(metrics.join(system, "query_id"), "system")
    return mean.select("system", "n_queries", *(F.round(c, 8).alias(c) for c in mean.columns if c not in ("system", "n_queries")))


def file_metrics_by_system(spark: SparkSession, sf: str) -> DataFrame:
    """Ranking quality by distinct file, an older variant counting as its file, averaged over each priority's orders."""
    return _by_priority(spark, sf, M.file_metrics(_ranked(spark, sf), _files(spark, sf), _files(spark, sf, "_old"), (1, 3)))


def span_metrics_by_system(spark: SparkSession, sf: str) -> DataFrame:
    """Ranking quality by labelled line span: one span in each of two files; every third label names a single chunk."""
    spans = _files(spark, sf).select("query_id", "file", F.lit(5).cast("long").alias("span_start"), F.lit(25).cast("long").alias("span_end"), F.when(F.col("query_id") % 3 == 0, 1).alias("n_chunks"))
    return _by_priority(spark, sf, M.span_metrics(_ranked(spark, sf), spans, (1, 3)))


def citations_grounded(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as answers that cite files with lines, their lines as retrieved chunks: the signal's score, counted."""
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    k = F.col("o_orderkey")
    cited = F.concat(F.lit("see ["), F.when(k % 2 == 0, "src/").otherwise("").cast("string"), F.lit("m"), k % 6, F.lit(".py:"), k % 40 + 1, F.lit("-"), k % 40 + 9, F.lit("] and [lib/n"), k % 5, F.lit(".py]"))
    answer = F.when(F.col("o_orderstatus") == "P", F.lit("INSUFFICIENT EVIDENCE")).when(k % 7 == 0, F.lit("nothing cited")).otherwise(cited)
    chunks = _ranked(spark, sf).select("query_id", T.normalize_path(F.col("file")).alias("path"), "start_line", "end_line")
    found = M.grounded(M.citation_counts(o.select(k.alias("query_id"), answer.alias("answer")), chunks))
    return found.groupBy("n_citations", "n_valid", "score", "passed").agg(F.count("*").alias("n"))


def run_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as runs and their user turns as attempts: how many break which rule."""
    c = read(spark, sf, "conversations")
    k = F.col("conv_id")
    attempts = c.where("role = 'user' and (conv_id % 3 = 2 or turn < 2 or conv_id % 17 = 0 and turn < 4) and not (conv_id % 19 = 5 and turn = 2)").select(k.alias("run_id"), F.floor(F.col("turn") / 2).alias("attempt"), ((k % 3 != 0) | (k % 7 == 0)).alias("has_retrieval"), ((k % 3 == 2) | (k % 11 == 0)).alias("gate_ran"), ((k + F.col("turn")) % 4 != 0).alias("passed"))
    runs = c.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("asked")).select(
        k.alias("run_id"), F.when(k % 3 == 0, "A").when(k % 3 == 1, "C").otherwise("E").alias("system"), F.when(k % 13 == 0, 2).when(k % 3 == 2, F.col("asked") - 1).otherwise(0).alias("steps"), F.lit(2).alias("max_steps"), (k % 5 != 0).alias("exhausted"),
        F.when(k % 4 == 1, "insufficient_evidence").when(k % 4 == 2, "unverified").otherwise("verified").alias("verdict"),
    )
    return V.attempt_violations(attempts, runs).groupBy("rule").agg(F.count("*").alias("n"))


def score_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Events as scored runs: mocks, cached runs, provenance and gates; how many break which rule."""
    e, k = read(spark, sf, "events"), F.col("event_id")
    mode = F.when(k % 4 == 0, "mock").when(k % 4 == 1, "cached_run").otherwise("live")
    one = V.broken(e, "event_id", V.evidence_rules(mode, k % 8 != 0, F.when(k % 5 == 1, "run")))
    other = V.broken(e, "event_id", V.score_rules(F.when(k % 3 != 0, F.col("value")), F.when(k % 6 != 0, "p"), k % 2 == 0, F.when(k % 10 != 0, True), F.when(k % 7 != 0, 0.5)))
    return one.union(other).groupBy("rule").agg(F.count("*").alias("n"))


def label_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as labels whose evidence are their parts' groups: how many break which rule."""
    groups = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 5).alias("evidence"), F.collect_set(F.col("l_suppkey") % 5).alias("relevant"))
    o, k = read(spark, sf, "orders").join(groups, F.col("o_orderkey") == F.col("l_orderkey"), "left"), F.col("o_orderkey")
    none = F.array().cast("array<bigint>")
    status = F.when(F.col("o_orderstatus") == "F", "flagged").when(F.col("o_orderstatus") == "O", "draft").otherwise("verified")
    split = F.when(k % 10 == 0, "test").otherwise("dev")
    rules = V.label_rules(status, split, F.coalesce("evidence", none), F.coalesce("relevant", none), F.when(k % 3 == 0, "").when(k % 3 == 1, "no source says so"), F.when(k % 4 != 0, "Ada Lovelace"))
    return V.broken(o, "o_orderkey", rules).groupBy("rule").agg(F.count("*").alias("n"))


def review_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as items and their lines as decisions by five reviewers, some on older content, on their own items, or on items of others."""
    k = F.col("l_orderkey")
    person = lambda c: F.concat(F.lit("Reviewer"), c % 5, F.lit(" Of The Shop"))
    decision = F.when(F.col("l_returnflag") == "R", F.when(k % 9 == 0, "reject").otherwise("fix")).otherwise("approve")
    d = read(spark, sf, "lineitem").select(k.alias("item_id"), F.when(F.col("l_tax") > 0.06, "old").otherwise("new").alias("item_sha"), person(F.col("l_suppkey")).alias("reviewer"), decision.alias("decision"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"))
    n = F.col("o_orderkey")
    items = read(spark, sf, "orders").select(
        n.alias("item_id"), F.lit("new").alias("item_sha"), F.when(n % 6 != 0, F.concat(F.lit("reviewer"), n % 5)).alias("drafted_by"), F.when(n % 7 == 0, F.concat(F.lit("REVIEWER"), (n + 1) % 5, F.lit("  Someone"))).alias("requested_by"),
        F.when(n % 3 == 0, F.array(person(n), person(n + 1), person(n + 2))).when(n % 3 == 1, F.array().cast("array<string>")).alias("assigned"), (n % 4 == 0).alias("held_out"),
    )
    return V.review_states(d, items).groupBy("status").agg(F.count("*").alias("n"))


def held_out_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as runs, a fiftieth of them on the test split: those not marked final, and repeated ones."""
    e, k = read(spark, sf, "events"), F.col("event_id")
    runs = e.select(k.alias("run_id"), F.when(k % 50 == 0, "test").otherwise("dev").alias("split"), (k % 100 == 0).alias("final"), F.col("ts").alias("at"))
    return V.held_out_violations(runs).groupBy("rule").agg(F.count("*").alias("n"))


def energy_accounts(spark: SparkSession, sf: str) -> DataFrame:
    """Per type of event the energy, measured or estimated, its weakest tier, and what a failure costs."""
    e, k = read(spark, sf, "events"), F.col("event_id")
    busy = J.utilisation(k, k * 2, k + k % 7, k * 2 + k % 11)
    e = e.withColumns({"measured_joules": F.when(k % 3 != 0, F.col("value")), "estimated_joules": J.facility(J.cpu_joules(F.lit(65.0), busy, F.col("value") / 100), F.lit(1.2)), "net": J.net_joules(F.col("value"), F.lit(4.26), F.when(k % 5 != 0, F.lit(2.0)))})
    totals = J.accounted(e, "event_type")
    more = e.groupBy("event_type").agg(F.round(F.sum("net"), 4).alias("net_joules"), F.count_if(J.rework_joules(F.col("value") < 100, F.col("value")) == float("inf")).alias("n_unbounded"), F.round(F.avg(busy), 8).alias("mean_busy"))
    return totals.join(more, "event_type").select("event_type", F.round("joules", 4).alias("joules"), "tier", "net_joules", "n_unbounded", "mean_busy")


def component_energy(spark: SparkSession, sf: str) -> DataFrame:
    """Net energy per query by component, and what errors take above views."""
    m = read(spark, sf, "events").groupBy(F.col("event_type").alias("component")).agg(F.sum("value").alias("gross_joules"), F.count("*").cast("double").alias("seconds"), F.countDistinct("user_id").alias("queries"))
    per = J.per_query(m, F.lit(4.26))
    return per.crossJoin(F.broadcast(J.increment(per, "error", "view"))).select("component", F.round("net_per_query", 4).alias("net_per_query"), F.round("increment", 4).alias("increment"))  # one row


def fleiss_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as raters, parts as items, return flags as categories."""
    found = S.fleiss_kappa(read(spark, sf, "lineitem"), "l_partkey", "l_suppkey", "l_returnflag")
    return found.select("n_items", *(F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")))


def kendall_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Line numbers against quantities in tens."""
    found = S.kendall_tau(read(spark, sf, "lineitem").withColumn("tens", F.floor(F.col("l_quantity") / 10)), "l_linenumber", "tens")
    return found.select("n", "concordant", "discordant", F.round("tau", 9).alias("tau"))


def ledger_status(spark: SparkSession, sf: str) -> DataFrame:
    """Users' events as a ledger of their units: how many stand where."""
    e = read(spark, sf, "events")
    plan = read(spark, sf, "customer").select(F.col("c_custkey").alias("unit_id"))
    return A.status_counts(plan, e.select(F.col("user_id").alias("unit_id"), F.col("event_type").alias("status"), F.col("event_id").alias("seq")))


def language_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by language, those without by source, most common first."""
    d = read(spark, sf, "documents")
    mix = d.groupBy(F.coalesce("lang", F.concat(F.lit("doc:"), F.coalesce("source", F.lit("unknown")))).alias("language")).agg(F.count("*").alias("n"))
    return mix.withColumn("place", F.expr("row_number() over (order by n desc, language)"))  # one row for each language


def first_seen_types(spark: SparkSession, sf: str) -> DataFrame:
    """The types of each user's events in the order in which they first occur."""
    return A.first_seen(read(spark, sf, "events"), "user_id", "event_type", "event_id")


def cheapest_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Per nation as tier the supplier of the lowest balance; balances above 9,000 are unknown costs."""
    s = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("tier"), F.col("s_suppkey").alias("model_id"), F.when(F.col("s_acctbal") <= 9000, F.col("s_acctbal")).alias("cost"))
    return A.cheapest_per_tier(s)


def bm25_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 of short passages over documents of one language; the best score of all documents stays the scale, and nothing is cut before the filter."""
    d = read(spark, sf, "documents").withColumn("artifact_type", F.col("lang"))
    q = read(spark, sf, "benchmark").where("item_id % 10 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    index = TextIndex(spark, storage.shared_path(spark, "index"), T.code_tokens_in_batches)
    index.refresh(d)
    return index.search(q, 5, artifact_types=("en",)).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def kept_index(spark: SparkSession, sf: str) -> DataFrame:
    """An index of other texts brought up to the documents in two refreshes: what every benchmark passage finds, as over the documents themselves."""
    d, k = read(spark, sf, "documents").select("doc_id", "text"), F.col("doc_id")
    index = TextIndex(spark, storage.shared_path(spark, "index"), T.code_tokens_in_batches)
    older = d.where(k % 7 != 0).withColumn("text", F.when(k % 5 == 0, F.concat(F.lit("formerly "), "text")).otherwise(F.col("text")))
    index.refresh(older.unionByName(d.where(k % 11 == 0).select((-k - 1).alias("doc_id"), "text")))
    index.refresh(d)
    q = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return index.search(q, 10).select("query_id", "rank", "doc_id", F.round("raw_score", 6).alias("raw_score"), F.round("score", 6).alias("score"))


def valid_items(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items that pass validation: enough text, and evidence where they are approved."""
    b, k = read(spark, sf, "benchmark"), F.col("item_id")
    evidence = read(spark, sf, "documents").select(F.col("doc_id").alias("item_id")).where("doc_id % 3 != 0").withColumn("has", F.lit(True))
    ok = (F.length(F.trim("text")) >= 10) & V.implies(k % 2 == 0, F.coalesce("has", F.lit(False))) & (k % 11 / 10).between(0, 1)
    return b.join(evidence, "item_id", "left").groupBy(ok.alias("valid")).agg(F.count("*").alias("n"), F.min("item_id").alias("first"))


def study_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """Events as study runs by user: errors, extremes of the peak, saturation."""
    e = read(spark, sf, "events")
    return A.study_summary(e.select("user_id", F.when(F.col("event_type") == "error", F.concat(F.lit("e"), F.col("event_id") % 3)).alias("error"), F.col("value").alias("peak"), F.lit(250.0).alias("total")), "user_id")


def split_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items of the development and validation splits only, by split; those of the test split are never read on."""
    o = read(spark, sf, "orders")
    splits = S.stratified_split(o.select("o_orderkey", "o_orderstatus"), "o_orderkey", ("o_orderstatus",)).where("split != 'test'").select("o_orderkey", "split")
    return o.join(splits, "o_orderkey").groupBy("split", "o_orderstatus").agg(F.count("*").alias("n"))


def indexed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of each file in order, unknown lines as 1 and 10^9: how many chunks, and where the file's last one begins."""
    k = F.col("l_linenumber")
    chunks = read(spark, sf, "lineitem").select(F.concat(F.lit("m"), F.col("l_partkey") % 50).alias("file"), F.coalesce(F.when(k % 3 != 0, F.col("l_quantity").cast("long")), F.lit(1)).alias("start_line"), F.coalesce(F.when(k % 4 != 0, F.col("l_quantity").cast("long") + 5), F.lit(10**9)).alias("end_line"))
    return chunks.groupBy("file").agg(F.count("*").alias("n"), F.max(F.struct("start_line", "end_line")).alias("last")).select("file", "n", "last.start_line", "last.end_line")


def history_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as issues, orders as commits that mention them, parts as files: edges by relation."""
    o, li = read(spark, sf, "orders"), read(spark, sf, "lineitem")
    fixes = o.select(F.concat(F.lit("commit:"), "o_orderkey").alias("src"), F.concat(F.lit("issue:"), "o_custkey").alias("tgt"), F.lit("RESOLVES").alias("rel"))
    touches = li.select(F.concat(F.lit("commit:"), "l_orderkey").alias("src"), F.concat(F.lit("file:"), "l_partkey").alias("tgt"), F.lit("MODIFIES").alias("rel"))
    affects = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("issue:"), "o_custkey").alias("src"), F.concat(F.lit("file:"), "l_partkey").alias("tgt"), F.lit("AFFECTS").alias("rel"))
    return fixes.union(touches).union(affects).distinct().groupBy("rel").agg(F.count("*").alias("n"), F.countDistinct("src").alias("n_src"), F.countDistinct("tgt").alias("n_tgt"))


def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Ids, names, masks, token counts and labels of suppliers and documents, counted."""
    s, k = read(spark, sf, "supplier"), F.col("s_suppkey")
    rows = s.select(
        X.short_node(F.concat(F.lit("sym:repo:a/b.py:"), k % 3)).alias("node"), X.chunk_id(F.lit("r:p"), k % 2).alias("chunk"), F.array_join(X.throttle_reasons(k % 16), "|").alias("reasons"),
        X.safe_label(F.when(k % 2 == 0, F.lit("Class_1")).otherwise(F.lit("no label"))).alias("label"), X.same_person(F.lit("Ada  Lovelace"), F.when(k % 3 == 0, F.lit("ada")).otherwise(F.lit("grace"))).alias("same"), X.rough_token_count(F.col("s_name")).alias("tokens"),
    )
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


def evidence_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Per order the prompt of its first three lines as numbered evidence: its digest."""
    r = _ranked(spark, sf).where("rank <= 3")
    block = X.evidence_block(F.col("rank").cast("string"), T.normalize_path(F.col("file")), F.when(F.col("query_id") % 2 == 0, F.col("start_line")), F.col("end_line"), F.when(F.col("rank") == 1, F.lit("f")), F.lit("text"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"])
    return r.groupBy("query_id").agg(F.sha2(F.array_join(ordered, "\n\n"), 256).alias("prompt_sha256"))


def strata_holm(spark: SparkSession, sf: str) -> DataFrame:
    """Event types as systems on users as tasks, compared rung by rung within two strata: n and mean difference."""
    e = read(spark, sf, "events")
    means = S.task_means(e.select(F.col("event_type").alias("system_id"), F.col("user_id").alias("task_id"), "value"), "value")
    strata = e.select(F.col("user_id").alias("task_id"), F.concat(F.lit("s"), F.col("user_id") % 2).alias("stratum")).distinct()
    pairs = spark.createDataFrame(S.ladder(("click", "error", "purchase", "view")), "a string, b string")
    found = S.compare_by_stratum(means, strata, pairs)
    return found.select("stratum", "a", "b", "n", F.round("mean_diff", 8).alias("mean_diff"), F.col("p_adjusted").between(F.col("p_value"), F.lit(1.0)).alias("adjusted"))


QUERIES = {
    f.__name__: f
    for f in (
        file_metrics_by_system, span_metrics_by_system, citations_grounded, run_contract, score_contract, label_contract, review_outcome, held_out_runs, energy_accounts, component_energy, fleiss_agreement, kendall_agreement, ledger_status,
        language_mix, first_seen_types, cheapest_profiles, bm25_filtered, kept_index, valid_items, study_outcome, split_items, indexed_files, history_artifacts, scalar_functions, evidence_prompts, strata_holm,
    )
}


def _sql_means(ranked: str, n: str, recall: str | None = None) -> str:
    """Of ranked (query_id, rank, hit, gain) and n (query_id, n_relevant): the means of the measures at 1 and 3 by priority."""
    ideal = {1: "1.0", 3: "(1.0 + CASE WHEN n_relevant > 1 THEN 1 / log2(3) ELSE 0 END + CASE WHEN n_relevant > 2 THEN 0.5 ELSE 0 END)"}
    per, names = ["coalesce(1.0 / min(rank) FILTER (WHERE hit), 0) AS mrr"], ["mrr"]
    for k in (1, 3):
        per += [
            (recall or "coalesce(sum(gain) FILTER (WHERE rank <= {k}), 0) / any_value(n_relevant)::DOUBLE").format(k=k) + f" AS recall_{k}",
            f"count(*) FILTER (WHERE hit AND rank <= {k}) / {k}::DOUBLE AS precision_{k}",
            f"coalesce(sum(gain / log2(rank + 1)) FILTER (WHERE rank <= {k}), 0) / any_value({ideal[k]}) AS ndcg_{k}",
        ]
        names += [f"recall_{k}", f"precision_{k}", f"ndcg_{k}"]
    means = ", ".join(f"round(avg({c}), 8) AS {c}" for c in names)
    return f"""ranked AS ({ranked}), n AS ({n}),
q AS (SELECT n.query_id, {", ".join(per)}, count(rank) AS n_ranked FROM n LEFT JOIN ranked USING (query_id) GROUP BY n.query_id)
SELECT o_orderpriority AS system, count(*) AS n_queries, {means}{{more}} FROM q JOIN orders ON o_orderkey = query_id GROUP BY 1"""


FILES = "SELECT o_orderkey AS query_id, unnest([o_orderkey % 6, (o_orderkey + 1) % 6]) AS k FROM orders"

ORACLES = {
    "file_metrics_by_system": f"WITH c AS ({RANKED_SQL}), "
    + _sql_means(
        f"""SELECT query_id, rank, hit, CASE WHEN hit AND row_number() OVER (PARTITION BY query_id, hit, target ORDER BY rank) = 1 THEN 1 ELSE 0 END AS gain FROM (
  SELECT r.query_id, r.rank, l.k IS NOT NULL AS hit, l.k AS target FROM (
    SELECT query_id, file, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), file) AS rank FROM (SELECT query_id, rank, replace(file, './', '') AS file FROM c) GROUP BY query_id, file) r
  LEFT JOIN ({FILES}) l ON l.query_id = r.query_id AND regexp_extract(r.file, 'm([0-9])', 1)::INT = l.k)""",
        "SELECT o_orderkey AS query_id, 2 AS n_relevant FROM orders",
    ).format(more=", round(avg(n_ranked), 8) AS n_ranked"),
    "span_metrics_by_system": f"WITH c AS ({RANKED_SQL}), "
    + _sql_means(
        f"""SELECT r.query_id, r.rank, l.k IS NOT NULL AS hit, (l.k IS NOT NULL)::INT AS gain, l.k AS span FROM (
  SELECT query_id, replace(file, './', '') AS file, start_line, end_line, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM c WHERE NOT is_graph) r
  LEFT JOIN ({FILES}) l ON l.query_id = r.query_id AND r.file = 'src/m' || l.k || '.py' AND r.start_line <= 25 AND r.end_line >= 5""",
        "SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS n_relevant FROM orders",
        "count(DISTINCT span) FILTER (WHERE rank <= {k}) / 2.0",
    ).format(more=""),
    "citations_grounded": f"""WITH c AS (SELECT query_id, replace(file, './', '') AS path, start_line, end_line FROM ({RANKED_SQL})),
a AS (SELECT o_orderkey AS k, o_orderstatus = 'P' AS refusal, o_orderstatus <> 'P' AND o_orderkey % 7 <> 0 AS cites FROM orders),
m AS (SELECT a.k, count(c.path) AS n, max((start_line <= k % 40 + 9 AND end_line >= k % 40 + 1)::INT) AS held FROM a LEFT JOIN c ON c.query_id = a.k AND c.path = 'src/m' || a.k % 6 || '.py' GROUP BY a.k),
h AS (SELECT query_id AS k, count(*) AS chunks FROM c GROUP BY 1),
r AS (SELECT a.k, refusal, CASE WHEN cites THEN 2 ELSE 0 END AS n_citations, CASE WHEN cites AND m.n > 0 THEN 1 ELSE 0 END AS n_valid, coalesce(chunks, 0) AS chunks, CASE WHEN cites AND m.n > 0 THEN held END AS held FROM a JOIN m USING (k) LEFT JOIN h USING (k)),
t AS (SELECT n_citations, n_valid, CASE WHEN refusal THEN 0.5 WHEN n_citations = 0 THEN CASE WHEN chunks > 0 THEN 0.3 ELSE 0.5 END ELSE round(0.4 + 0.6 * n_valid / 2 - CASE WHEN held < 0.5 THEN 0.15 ELSE 0 END, 4) END::DOUBLE AS score,
  CASE WHEN refusal OR n_citations = 0 THEN chunks = 0 ELSE false END AS passed FROM r)
SELECT n_citations::BIGINT AS n_citations, n_valid::BIGINT AS n_valid, score, passed, count(*) AS n FROM t GROUP BY 1, 2, 3, 4""",
    "run_contract": """WITH a AS (SELECT conv_id AS k, turn // 2 AS i, conv_id % 3 <> 0 OR conv_id % 7 = 0 AS r, conv_id % 3 = 2 OR conv_id % 11 = 0 AS g, (conv_id + turn) % 4 <> 0 AS passed FROM conversations WHERE role = 'user' AND (conv_id % 3 = 2 OR turn < 2 OR conv_id % 17 = 0 AND turn < 4) AND NOT (conv_id % 19 = 5 AND turn = 2)),
t AS (SELECT conv_id AS k, count(*) FILTER (WHERE role = 'user') AS asked FROM conversations GROUP BY 1),
n AS (SELECT k, count(a.k) AS n, list(i ORDER BY i) FILTER (WHERE i IS NOT NULL) AS indices, coalesce(bool_or(r), false) AS some_r, coalesce(bool_and(r), true) AS all_r, coalesce(bool_or(g), false) AS some_g, coalesce(bool_and(g), true) AS all_g, arg_max(passed, i) AS last,
  any_value(asked) AS asked FROM t LEFT JOIN a USING (k) GROUP BY k),
b AS (SELECT *, ['A', 'C', 'E'][k % 3 + 1] AS s, CASE WHEN k % 13 = 0 THEN 2 WHEN k % 3 = 2 THEN asked - 1 ELSE 0 END AS steps,
  CASE k % 4 WHEN 1 THEN 'insufficient_evidence' WHEN 2 THEN 'unverified' ELSE 'verified' END AS v FROM n),
x AS (SELECT unnest([
  CASE WHEN n = 0 OR indices <> range(n) THEN 'attempts_gapless' END, CASE WHEN steps <> n - 1 THEN 'steps_match' END, CASE WHEN n - 1 > 2 THEN 'steps_bounded' END,
  CASE WHEN s = 'A' AND some_r OR s <> 'A' AND NOT all_r THEN 'retrieval_by_system' END, CASE WHEN s = 'E' AND NOT all_g OR s <> 'E' AND some_g THEN 'gate_iff_system_e' END,
  CASE WHEN s <> 'E' AND n <> 1 THEN 'one_attempt_without_gate' END, CASE WHEN v = 'verified' AND NOT (s = 'E' AND coalesce(last, false)) THEN 'verified_by_gate' END,
  CASE WHEN v = 'insufficient_evidence' AND NOT (s = 'E' AND last IS NOT NULL AND NOT last AND k % 5 <> 0) THEN 'insufficient_when_exhausted' END, CASE WHEN v = 'unverified' AND s = 'E' THEN 'unverified_without_gate' END]) AS rule FROM b)
SELECT rule, count(*) AS n FROM x WHERE rule IS NOT NULL GROUP BY 1""",
    "score_contract": """SELECT rule, count(*) AS n FROM (SELECT unnest([
  CASE WHEN k % 4 = 0 AND k % 8 <> 0 THEN 'mock_is_no_evidence' END, CASE WHEN (k % 4 = 1) <> (k % 5 = 1) THEN 'cached_iff_source' END,
  CASE WHEN (k % 3 <> 0) <> (k % 6 <> 0) THEN 'score_iff_provenance' END, CASE WHEN k % 2 = 0 AND (k % 10 = 0 OR k % 7 = 0) THEN 'gate_reports' END]) AS rule FROM (SELECT event_id AS k FROM events)) WHERE rule IS NOT NULL GROUP BY 1""",
    "label_contract": """WITH g AS (SELECT l_orderkey AS k, list(DISTINCT l_partkey % 5) AS e, list(DISTINCT l_suppkey % 5) AS r FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey AS k, o_orderstatus AS s, coalesce(e, []) AS e, coalesce(r, []) AS r FROM orders LEFT JOIN g ON g.k = o_orderkey)
SELECT rule, count(*) AS n FROM (SELECT unnest([CASE WHEN s = 'F' AND k % 3 <> 1 THEN 'flagged_needs_notes' END, CASE WHEN s <> 'F' AND len(e) = 0 THEN 'else_needs_evidence' END,
  CASE WHEN s NOT IN ('F', 'O') AND k % 4 = 0 THEN 'verified_needs_name' END, CASE WHEN NOT list_has_all(r, e) THEN 'evidence_is_relevant' END, CASE WHEN k % 10 = 0 THEN 'no_test_split' END]) AS rule FROM b) WHERE rule IS NOT NULL GROUP BY 1""",
    "review_outcome": """WITH d AS (SELECT l_orderkey AS k, l_suppkey % 5 AS p, CASE WHEN l_returnflag <> 'R' THEN 'approve' WHEN l_orderkey % 9 = 0 THEN 'reject' ELSE 'fix' END AS d,
  row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 5 ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS r FROM lineitem
  WHERE l_tax <= 0.06 AND NOT (l_orderkey % 6 <> 0 AND l_suppkey % 5 = l_orderkey % 5) AND NOT (l_orderkey % 7 = 0 AND l_suppkey % 5 = (l_orderkey + 1) % 5)
    AND (l_orderkey % 3 <> 0 OR l_suppkey % 5 IN (l_orderkey % 5, (l_orderkey + 1) % 5, (l_orderkey + 2) % 5))),
n AS (SELECT k, count(*) FILTER (WHERE d = 'reject') AS x, count(*) FILTER (WHERE d = 'fix') AS f, count(*) FILTER (WHERE d = 'approve') AS a FROM d WHERE r = 1 GROUP BY k)
SELECT CASE WHEN x > 0 THEN 'rejected' WHEN f > 0 THEN 'needs_fix' WHEN a >= CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END THEN 'approved' WHEN a > 0 THEN 'partially_approved' ELSE 'pending' END AS status, count(*) AS n
FROM orders LEFT JOIN n ON k = o_orderkey GROUP BY 1""",
    "held_out_runs": """SELECT CASE WHEN event_id % 100 = 0 THEN 'repeated' ELSE 'not_final' END AS rule, count(*) AS n FROM events WHERE event_id % 50 = 0
  AND event_id <> (SELECT arg_min(event_id, (ts, event_id)) FROM events WHERE event_id % 100 = 0) GROUP BY 1""",
    "energy_accounts": """WITH e AS (SELECT *, event_id AS k, CASE WHEN event_id % 11 > 0 THEN least(1, greatest(0, 1 - (event_id % 7) / (event_id % 11))) END AS busy FROM events),
j AS (SELECT *, CASE WHEN k % 3 <> 0 THEN value ELSE 65 * coalesce(busy, 1) * value / 100 * 1.2 END AS joules FROM e)
SELECT event_type, round(sum(joules), 4) AS joules, CASE WHEN bool_or(k % 3 = 0) THEN 'estimated' ELSE 'measured' END AS tier, round(sum(CASE WHEN k % 5 <> 0 THEN value - 4.26 * 2 END), 4) AS net_joules,
  count(*) FILTER (WHERE value >= 100) AS n_unbounded, round(avg(busy), 8) AS mean_busy FROM j GROUP BY 1""",
    "component_energy": """WITH m AS (SELECT event_type AS component, (sum(value) - 4.26 * count(*)) / count(DISTINCT user_id) AS p FROM events GROUP BY 1)
SELECT component, round(p, 4) AS net_per_query, round((SELECT max(p) FILTER (WHERE component = 'error') - max(p) FILTER (WHERE component = 'view') FROM m), 4) AS increment FROM m""",
    "fleiss_agreement": """WITH l AS (SELECT l_partkey AS i, max(l_returnflag) AS c FROM lineitem GROUP BY l_partkey, l_suppkey), k AS (SELECT i, c, count(*) AS k FROM l GROUP BY 1, 2),
i AS (SELECT i, sum(k) AS m, sum(k * k) AS kk FROM k GROUP BY 1 HAVING sum(k) > 1), p AS (SELECT c, sum(k) AS k FROM k WHERE i IN (SELECT i FROM i) GROUP BY 1),
s AS (SELECT count(*) AS n_items, avg((kk - m) / (m * (m - 1))) AS o, sum(m)::DOUBLE AS total FROM i), x AS (SELECT n_items, o, (SELECT sum(k * k) FROM p) / (total * total) AS e FROM s)
SELECT n_items, round(o, 9) AS observed, round(e, 9) AS expected, round((o - e) / (1 - e), 9) AS kappa FROM x""",
    "kendall_agreement": """WITH c AS (SELECT l_linenumber AS x, floor(l_quantity / 10) AS y, count(*) AS c FROM lineitem GROUP BY 1, 2),
p AS (SELECT sum(a.c * b.c) FILTER (WHERE a.y < b.y) AS k, sum(a.c * b.c) FILTER (WHERE a.y > b.y) AS d FROM c a JOIN c b ON a.x < b.x),
t AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(c) AS n FROM c GROUP BY x)) AS tx, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(c) AS n FROM c GROUP BY y)) AS ty, (SELECT sum(c) FROM c) AS n)
SELECT n::BIGINT AS n, k::BIGINT AS concordant, d::BIGINT AS discordant, round((k - d) / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)), 9) AS tau FROM p, t""",
    "ledger_status": """SELECT coalesce(s, 'pending') AS status, count(*) AS n FROM customer LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS s FROM events GROUP BY 1) ON user_id = c_custkey GROUP BY 1""",
    "language_mix": "SELECT *, row_number() OVER (ORDER BY n DESC, language) AS place FROM (SELECT coalesce(lang, 'doc:' || coalesce(source, 'unknown')) AS language, count(*) AS n FROM documents GROUP BY 1)",
    "first_seen_types": "SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS position FROM events GROUP BY 1, 2",
    "cheapest_profiles": """SELECT s_nationkey AS tier, s_suppkey AS model_id, CASE WHEN s_acctbal <= 9000 THEN s_acctbal END AS cost FROM supplier
  QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_acctbal <= 9000 THEN s_acctbal END NULLS LAST, s_suppkey) = 1""",
    "kept_index": f"WITH {SQL_BM25} SELECT query_id, rank, doc_id, round(raw_score, 6) AS raw_score, round(score, 6) AS score FROM sparse WHERE rank <= 10",
    "bm25_filtered": f"""WITH {SQL_BM25}
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (SELECT s.query_id, s.doc_id, s.score, row_number() OVER (PARTITION BY s.query_id ORDER BY round(s.raw_score, 9) DESC, s.doc_id) AS rank
  FROM sparse s JOIN documents d USING (doc_id) WHERE d.lang = 'en' AND s.query_id % 10 = 0) WHERE rank <= 5""",
    "valid_items": """SELECT length(trim(text)) >= 10 AND (item_id % 2 <> 0 OR item_id IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)) AS valid, count(*) AS n, min(item_id) AS first FROM benchmark GROUP BY 1""",
    "study_outcome": """SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS n_ok, count(*) FILTER (WHERE event_type = 'error') AS n_error,
  coalesce(string_agg(DISTINCT CASE WHEN event_type = 'error' THEN 'e' || event_id % 3 END, '|' ORDER BY CASE WHEN event_type = 'error' THEN 'e' || event_id % 3 END), '') AS errors, min(value) AS low, max(value) AS high, max(value) >= 122 AS saturated FROM events GROUP BY 1""",
    "split_items": """WITH o AS (SELECT o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42:' || o_orderkey), o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders),
s AS (SELECT *, CASE WHEN r <= floor(n * 0.4 + 0.5) THEN 'dev' WHEN r <= floor(n * 0.4 + 0.5) + floor(n * 0.2 + 0.5) THEN 'val' END AS split FROM o)
SELECT split, o_orderstatus, count(*) AS n FROM s WHERE split IS NOT NULL GROUP BY 1, 2""",
    "indexed_files": """WITH c AS (SELECT 'm' || l_partkey % 50 AS file, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity::BIGINT ELSE 1 END AS a, CASE WHEN l_linenumber % 4 <> 0 THEN l_quantity::BIGINT + 5 ELSE 1000000000 END AS b FROM lineitem)
SELECT file, count(*) AS n, max((a, b))[1] AS start_line, max((a, b))[2] AS end_line FROM c GROUP BY 1""",
    "history_artifacts": """SELECT 'RESOLVES' AS rel, count(*) AS n, count(DISTINCT o_orderkey) AS n_src, count(DISTINCT o_custkey) AS n_tgt FROM orders
UNION ALL SELECT 'MODIFIES', count(*), count(DISTINCT a), count(DISTINCT b) FROM (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem)
UNION ALL SELECT 'AFFECTS', count(*), count(DISTINCT a), count(DISTINCT b) FROM (SELECT DISTINCT o_custkey AS a, l_partkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey)""",
    "scalar_functions": """SELECT 'a/b.py:' || k % 3 AS node, 'r:p:chunk:' || k % 2 AS chunk, array_to_string(list_filter([CASE WHEN k & 1 > 0 THEN 'gpu_idle' END, CASE WHEN k & 2 > 0 THEN 'applications_clocks_setting' END, CASE WHEN k & 4 > 0 THEN 'sw_power_cap' END,
  CASE WHEN k & 8 > 0 THEN 'hw_slowdown' END], lambda x: x IS NOT NULL), '|') AS reasons, CASE WHEN k % 2 = 0 THEN 'Class_1' ELSE 'Entity' END AS label, k % 3 = 0 AS same, length(s_name) // 4 AS tokens, count(*) AS n
FROM (SELECT s_suppkey AS k, s_name FROM supplier) GROUP BY ALL""",
    "evidence_prompts": f"""SELECT query_id, sha256(string_agg('[' || rank || '] ' || replace(file, './', '') || CASE WHEN query_id % 2 = 0 THEN ' (Lines ' || start_line || '-' || end_line || ')' ELSE '' END || CASE WHEN rank = 1 THEN ' [f]' ELSE '' END
  || chr(10) || 'text', chr(10) || chr(10) ORDER BY rank)) AS prompt_sha256 FROM ({RANKED_SQL}) WHERE rank <= 3 GROUP BY 1""",
    "strata_holm": """WITH m AS (SELECT event_type AS s, user_id AS t, avg(value) AS v FROM events GROUP BY 1, 2), p AS (SELECT * FROM (VALUES ('click', 'error'), ('error', 'purchase'), ('purchase', 'view')) x(a, b))
SELECT 's' || x.t % 2 AS stratum, a, b, count(*) AS n, round(avg(y.v - x.v), 8) AS mean_diff, true AS adjusted FROM p JOIN m x ON x.s = a JOIN m y ON y.s = b AND y.t = x.t GROUP BY 1, 2, 3""",
}
