"""SQL of operators, and queries of those parts of the others that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.retrieval import dense

from .common import table
from .mixing import op2_mixing
from .neighbours import DECIMALS, op4_neighbours
from .secrets import op7_secret_scan
from .sharding import op6_sharding


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base kinds of ``op7_secret_scan``; what decoding confirms SQL can't express."""
    return op7_secret_scan(spark, sf_dir).drop("spans")


def sharding_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ``op6_sharding``: rows, bytes, shards, and whether slots are gapless and sizes even to one row."""
    found = op6_sharding(spark, sf_dir)
    per = found.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.max("size").alias("largest"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.countDistinct("slot").alias("slots"))
    whole = per.agg(
        F.sum("n").alias("n_rows"), F.sum("size").alias("n_bytes"), F.count("*").alias("n_shards"), F.bool_and(F.expr("low = 0 and high = n - 1 and slots = n")).alias("gapless"),
        F.max("size").alias("most"), F.min("size").alias("least"), F.max("largest").alias("largest"),
    )
    even = F.col("most") - F.col("least") <= 2 * F.col("largest") + 0.004 * F.col("n_bytes") / 24
    return whole.select("n_rows", "n_bytes", "n_shards", "gapless", even.alias("even"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ``op2_mixing``, per source: its size, its target, its documents, and whether the words taken meet target and cap."""
    found = op2_mixing(spark, sf_dir)
    per = found.groupBy("source_size", F.round("target", 4).alias("target")).agg(F.count("*").alias("n_docs"), F.sum("size").alias("sum_size"), F.sum("taken").alias("taken"), F.bool_and(F.expr("taken <= 2 * size")).alias("within_cap"))
    return per.select("source_size", "target", "n_docs", (F.abs(F.col("taken") - F.col("target") * F.col("sum_size") / F.greatest("source_size", F.lit(1))) <= 1).alias("met"), "within_cap")


def neighbours_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each query's 5 exact neighbours ``op4_neighbours`` finds; one that is as near as the fifth is as good."""
    e = table(spark, sf_dir, "embeddings")
    asking = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    exact = dense(asking, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), 5, exclude_self=True)
    fifth = exact.groupBy("query_id").agg(F.min("score").alias("least"))
    hits = op4_neighbours(spark, sf_dir).join(fifth, "query_id").where(F.col("score") >= F.col("least") - 10.0**-DECIMALS)
    return hits.groupBy("query_id").agg(F.count("*").alias("n_found"))


WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWER)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
t AS (SELECT s.*, n.n FROM s JOIN n USING (doc_id)),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n + b.n) AS n, count(*) AS c FROM t a JOIN t b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM x WHERE 100 * c >= 80 * (n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS root FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

REPEATS_ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT r, low, substr(h, 2 * low + 1, 1398) AS part FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199, 500)) AS low FROM d WHERE length(h) >= 400)),
w AS (SELECT r, low + i AS i, md5(substr(part, 2 * i + 1, 400)) AS m FROM (SELECT *, unnest(range(0, least(500, length(part) // 2 - 199))) AS i FROM b)),
o AS (SELECT r, i FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
g AS (SELECT r, i, sum(CASE WHEN i - before <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT *, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM o)),
s AS (SELECT r, run, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY r, run),
k AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS since FROM s),
p AS (
  SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept FROM k JOIN d USING (r) GROUP BY r
)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN p USING (r)
"""

MIXING_ORACLE = f"""
WITH d AS (SELECT source, len({WORDS.format("coalesce(text, '')")}) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size, count(*) AS n FROM d GROUP BY 1),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
o AS (
  SELECT *, 1.5::DOUBLE * sum(size) OVER () - coalesce(sum(2 * size) OVER u, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER u, 0) AS weights, row_number() OVER (ORDER BY 2 * size / weight, source NULLS LAST) AS k
  FROM w WINDOW u AS (ORDER BY 2 * size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
v AS (SELECT coalesce(min_by(rest / weights, k) FILTER (WHERE 2 * size > weight * rest / weights), max_by(rest / weights, k)) AS level FROM o)
SELECT size AS source_size, round(least(2 * size, weight * level), 4) AS target, sum(n)::BIGINT AS n_docs, true AS met, true AS within_cap FROM w, v GROUP BY 1, 2
"""

#: Each pattern's matches are set between two marks that no text has; what stands between the marks gives their places.
SECRETS_ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT r, 0 AS kind, 'assign' AS name, regexp_replace(text, '(?i)((?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?)([A-Za-z0-9+/_.=-]+)', chr(1) || '\1' || chr(2) || '\2' || chr(1), 'g') AS t FROM d
  UNION ALL SELECT r, 1, 'access', regexp_replace(text, '(AKIA[A-Z0-9]+)', chr(1) || chr(2) || '\1' || chr(1), 'g') FROM d
  UNION ALL SELECT r, 2, 'hex', regexp_replace(text, '([0-9a-f]+)', chr(1) || chr(2) || '\1' || chr(1), 'g') FROM d
),
p AS (SELECT r, kind, name, string_split(t, chr(1)) AS parts FROM m WHERE contains(t, chr(1))),
u AS (SELECT r, kind, name, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM p),
n AS (SELECT *, length(replace(part, chr(2), '')) AS len FROM u),
s AS (SELECT *, sum(len) OVER (PARTITION BY r, kind ORDER BY k) AS upto FROM n),
f AS (
  SELECT r, kind, name, (upto - len)::BIGINT AS a, upto::BIGINT AS b FROM s
  WHERE k % 2 = 0 AND length(string_split(part, chr(2))[2]) >= CASE kind WHEN 0 THEN 12 WHEN 1 THEN 18 ELSE 16 END
),
g AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind) AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(spans, '')) AS base_sha256
FROM d LEFT JOIN g USING (r)
"""

QUERIES = {f.__name__: f for f in (secret_base_spans, sharding_invariants, mixing_targets, neighbours_recall)}

ORACLES = {
    "op3_near_dedup": NEAR_ORACLE,
    "op8_repeats": REPEATS_ORACLE,
    "secret_base_spans": SECRETS_ORACLE,
    "mixing_targets": MIXING_ORACLE,
    "sharding_invariants": "SELECT count(*) AS n_rows, (coalesce(sum(octet_length(encode(text))), 0) + 8 * count(*))::BIGINT AS n_bytes, least(24, count(*)) AS n_shards, true AS gapless, true AS even FROM documents",
    "neighbours_recall": "SELECT vec_id AS query_id, least(5, (SELECT count(*) - 1 FROM embeddings)) AS n_found FROM embeddings WHERE vec_id % 50 = 0",
}
