"""Queries on the structure of files: chunks of sources and texts, outlines of Markdown and reStructuredText."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import chunking, outline
from siltstone.plans.graph_queries import _FILES, source_files
from siltstone.sources.tables import read


def source_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks of each part's file, at most 40 tokens each, so that its class is cut into header and methods."""
    files = source_files(spark, sf)
    kind = F.when(F.col("path").endswith(".py"), "source_code").otherwise("markdown")
    found = chunking.chunks(files.select(F.col("path").alias("artifact_id"), kind.alias("artifact_type"), "path", F.lit(None).cast("string").alias("language"), "content"), 40)
    return found.select("chunk_id", "total_chunks", "start_line", "end_line", "token_count", "part", "parts", "symbol_name", "section_title", "chunk_type", F.sha2("content", 256).alias("content_sha256"))


def document_units(spark: SparkSession, sf: str) -> DataFrame:
    """Of each document, cut at headings and paragraphs into at most 512 tokens: chunks, lines covered, tokens, and whether any is too large."""
    d = read(spark, sf, "documents")
    found = chunking.chunks(d.select(F.col("doc_id").cast("string").alias("artifact_id"), F.lit("plain_text").alias("artifact_type"), F.lit("").alias("path"), F.lit(None).cast("string").alias("language"), F.col("text").alias("content")))
    lines = found.select("artifact_id", F.explode(F.sequence("start_line", "end_line")).alias("n")).distinct().groupBy("artifact_id").agg(F.count("*").alias("_n"))
    blank = F.filter(F.split("text", "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: F.trim(F.regexp_replace(x, r"\s", "")) != "")
    said = d.select(F.col("doc_id").cast("string").alias("artifact_id"), "doc_id", F.size(blank).alias("_full"), F.regexp_count("text", F.lit(r"(?U)\w+|[^\w\s]")).alias("n_tokens"))
    sizes = found.groupBy("artifact_id").agg(F.sum(F.col("token_count") - chunking.KEPT_BACK).alias("_tokens"), F.max("token_count").alias("_largest"))
    both = said.join(sizes, "artifact_id", "left").join(lines, "artifact_id", "left")
    return both.select("doc_id", (F.coalesce("_largest", F.lit(0)) <= 512).alias("fits"), (F.coalesce("_n", F.lit(0)) >= F.col("_full")).alias("covered"), (F.coalesce("_tokens", F.lit(0)) == F.col("n_tokens")).alias("each_token_once"))


def outlined_files(spark: SparkSession, sf: str) -> DataFrame:
    """A file for each order, of Markdown with fences or of titles over and under lines: its lines are those of the order."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    name = F.concat(F.lit("Part "), p)
    markdown = F.concat(F.repeat(F.lit("#"), (p % 3 + 1).cast("int")), F.lit(" "), name, F.when(s % 5 == 0, F.lit(" ##\n")).otherwise(F.lit("\n")), F.when(s % 4 == 0, F.lit("```\n# No heading\n```\n")).otherwise(F.lit("Text.\n")), F.when(s % 3 == 0, F.lit("\n")).otherwise(F.lit("")))
    sign = F.when(p % 3 == 0, F.lit("=")).when(p % 3 == 1, F.lit("-")).otherwise(F.lit("~"))
    rest = F.concat(F.when(s % 3 == 0, F.concat(F.repeat(sign, 12), F.lit("\n"))).otherwise(F.lit("")), name, F.lit("\n"), F.repeat(sign, 12), F.lit("\nText.\n\n"), F.when(s % 4 == 0, F.concat(F.lit(".. _part"), p, F.lit(":\n"))).otherwise(F.lit("")))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.when(F.col("l_orderkey") % 2 == 0, markdown).otherwise(rest).alias("text"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["text"]), "")
    return read(spark, sf, "lineitem").groupBy("l_orderkey").agg(text.alias("content")).withColumn("path", F.concat("l_orderkey", F.when(F.col("l_orderkey") % 2 == 0, ".md").otherwise(".rst")))


def outline_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Every heading of the orders' files with its rank and the lines of its section."""
    files = outlined_files(spark, sf)
    return outline.outline(outline.text_lines(files, "l_orderkey", F.col("path"), F.col("content")))


QUERIES = {f.__name__: f for f in (source_chunks, document_units, outline_sections)}

_TOKENS = r"len(regexp_extract_all({}, '[\pL\pN_]+|[^\pL\pN_\s]'))"

ORACLES = {
    "source_chunks": f"""
WITH {_FILES},
c AS (
  SELECT path, p, kind, fn, ['from .m' || (p + 7) || ' import f' || (p + 7) || ' as g, missing', 'import pkg' || (p + 1) % 7 || '.m' || (p + 1) || ' as c', 'from pkg' || (p + 3) % 7 || ' import m' || (p + 3) || ', other',
    'from pkg' || (p + 4) % 7 || '.m' || (p + 4) || ' import K' || (p + 4), '', '', 'def ' || fn || '(x):', '    return g(x)', '', '', 'class K' || p || ':', '    def a(self):', '        return c.f' || (p + 1) || '(1)', '', '    @property',
    '    def b(self):', '        self.a()', '        m' || (p + 3) || '.f' || (p + 3) || '(2)', '        K' || (p + 4) || '()', '        return f' || p || '(3)'] AS lines
  FROM py
),
u AS (
  SELECT path, lines, a AS start_line, b AS end_line, replace(replace(s, '?f', fn), '?', 'K' || p) AS symbol_name, NULL AS section_title, t AS chunk_type, row_number() OVER (PARTITION BY path ORDER BY a) - 1 AS k, 5 AS total
  FROM c, (VALUES (1, 4, '<module_preamble>', 'module_header'), (7, 8, '?f', 'function'), (11, 11, '?.<header>', 'class_header'), (12, 13, '?.a', 'method'), (15, 20, '?.b', 'method')) AS v(a, b, s, t)
  UNION ALL SELECT f.path, ['# ' || p_name, '', 'Text.'], 1, 3, NULL, p_name, 'doc_section', 0, 1 FROM f JOIN part ON p_partkey = p WHERE kind = 'text'
),
x AS (SELECT *, trim(array_to_string(lines[start_line:end_line], chr(10)), ' ' || chr(10)) AS content FROM u)
SELECT path || ':chunk:' || k AS chunk_id, total AS total_chunks, start_line, end_line, {_TOKENS.format("content")} + 2 AS token_count, NULL::INT AS part, NULL::INT AS parts, symbol_name, section_title, chunk_type, sha256(content) AS content_sha256 FROM x
""",
    "document_units": "SELECT doc_id, true AS fits, true AS covered, true AS each_token_once FROM documents",
    "outline_sections": r"""
WITH i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r, l_partkey AS p, l_suppkey AS s FROM lineitem),
t AS (SELECT l_orderkey AS key, r, p, s, CASE WHEN l_orderkey % 2 = 0
    THEN list_concat([repeat('#', (p % 3 + 1)::INT) || ' Part ' || p || CASE WHEN s % 5 = 0 THEN ' ##' ELSE '' END], CASE WHEN s % 4 = 0 THEN ['```', '# No heading', '```'] ELSE ['Text.'] END, CASE WHEN s % 3 = 0 THEN [''] ELSE [] END)
    ELSE list_concat(CASE WHEN s % 3 = 0 THEN [repeat(['=', '-', '~'][p % 3 + 1], 12)] ELSE [] END, ['Part ' || p, repeat(['=', '-', '~'][p % 3 + 1], 12), 'Text.', ''], CASE WHEN s % 4 = 0 THEN ['.. _part' || p || ':'] ELSE [] END) END AS lines FROM i),
o AS (SELECT *, coalesce(sum(len(lines)) OVER (PARTITION BY key ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(len(lines)) OVER (PARTITION BY key) + 1 AS last FROM t),
h AS (SELECT key, before + 1 AS n, 'Part ' || p AS title, p % 3 AS sign, s % 3 = 0 AS above, last FROM o),
f AS (SELECT key, sign, above, min(n) AS first FROM h GROUP BY ALL),
k AS (SELECT key, sign, above, row_number() OVER (PARTITION BY key ORDER BY first) - 1 AS style FROM f),
g AS (SELECT h.*, CASE WHEN key % 2 = 0 THEN sign + 1 ELSE style END AS rank FROM h JOIN k USING (key, sign, above)),
e AS (SELECT a.key, a.rank, a.title, a.n, coalesce(min(b.n) - 1, any_value(a.last)) AS upto FROM g a LEFT JOIN g b ON a.key = b.key AND b.n > a.n AND b.rank <= a.rank GROUP BY 1, 2, 3, 4),
l AS (SELECT key, before + generate_subscripts(lines, 1) AS m, unnest(lines) AS line FROM o)
SELECT e.key, e.rank::INT AS rank, title, n::BIGINT AS start_line, max(m)::BIGINT AS end_line FROM e JOIN l ON l.key = e.key AND m BETWEEN n AND upto AND line <> '' AND NOT starts_with(line, '.. _') GROUP BY 1, 2, 3, 4
""",
}
