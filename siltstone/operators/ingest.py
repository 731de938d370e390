"""From files to chunks: lines, sections, paragraphs, deduplication, packing of lines."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from siltstone.functions.text import content_hash
from siltstone.sources.tables import spread


def first_by_content(artifacts: DataFrame, text: Column, order: Column) -> DataFrame:
    """Of artifacts with the same normalised text the first in ``order``, with its content_hash.

    The first is found by aggregation of hash and order alone, so a text that
    is very common meets nowhere; the rows come back by a semi join.
    """
    hashed = artifacts.withColumn("content_hash", content_hash(text)).withColumn("_order", order)
    first = hashed.groupBy("content_hash").agg(F.min("_order").alias("_order"))
    return hashed.join(first, ["content_hash", "_order"], "left_semi").drop("_order")


def lines(df: DataFrame, key: str, text: Column) -> DataFrame:
    """key, n (from 1), line."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line")).withColumn("n", (F.col("n") + 1).cast("long"))


def sections(numbered: DataFrame, key: str, is_heading: Column, title: Column) -> DataFrame:
    """key, title, start_line, end_line: each heading up to the line before the next; what stands before the first is the introduction."""
    marked = numbered.withColumn("_head", is_heading)
    ends = numbered.groupBy(key).agg(F.max("n").alias("_last"))
    starts = marked.where("_head or n = 1").select(key, "n", F.when(F.col("_head"), title).otherwise("Introduction").alias("title"))
    following = F.expr(f"lead(n) over (partition by {key} order by n) - 1")
    return starts.withColumn("_next", following).join(ends, key).select(key, "title", F.col("n").alias("start_line"), F.coalesce("_next", "_last").alias("end_line"))


def paragraphs(numbered: DataFrame, key: str) -> DataFrame:
    """key, start_line, end_line of the runs of lines that are not blank."""
    blank = F.trim(F.col("line"), F.lit(" \t\r")) == ""
    islands = numbered.withColumn("_blank", blank).withColumn("_island", F.expr(f"sum(int(_blank)) over (partition by {key} order by n)"))
    return islands.where("not _blank").groupBy(key, "_island").agg(F.min("n").alias("start_line"), F.max("n").alias("end_line")).drop("_island")


_UNIT = re.compile(r"\w+|[^\w\s]")


def rough_tokens(line: str) -> int:
    """A stand-in for a model's tokenizer: words and single signs."""
    return len(_UNIT.findall(line))


def packed_lines(text: str, most: int, overlap: int = 0) -> Iterator[tuple[int, int, str, int]]:
    """Runs of whole lines of at most ``most`` tokens (two are kept back); a longer line is cut by words."""
    budget, rows = max(1, most - 2), text.split("\n")
    costs = [rough_tokens(x) for x in rows]
    at = 0
    while at < len(rows):
        end, used = at, 0
        while end < len(rows) and used + costs[end] <= budget:
            used += costs[end]
            end += 1
        if end == at:
            part, n = [], 0
            for word in rows[at].split(" "):
                cost = rough_tokens(word)
                if part and n + cost > budget:
                    yield at + 1, at + 1, " ".join(part), n + 2
                    part, n = [], 0
                part.append(word)
                n += cost
            yield at + 1, at + 1, " ".join(part), n + 2
            at += 1
            continue
        if any(x.strip() for x in rows[at:end]):
            yield at + 1, end, "\n".join(rows[at:end]), used + 2
        if end == len(rows):
            break
        at = max(at + 1, end - overlap)


@udtf(returnType="start_line bigint, end_line bigint, content string, token_count int")
class LineChunks:
    """Table function over one text: its line-packed chunks."""

    def eval(self, text: str, most: int, overlap: int):
        if text and text.strip():
            yield from packed_lines(text, most, overlap)


@udtf(returnType="kind string, name string, start_line bigint, end_line bigint, target string")
class PythonSymbols:
    """Table function over one source text: its classes, functions, methods, tests, imports and calls; nothing if it doesn't parse."""

    def eval(self, source: str):
        try:
            tree = ast.parse(source or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):  # the parser gives up on deep nesting by one of the last two
            return
        todo = [(tree, "", False)]
        while todo:
            node, outer, in_class = todo.pop()
            for child in ast.iter_child_nodes(node):
                if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                    name = f"{outer}.{child.name}" if outer else child.name
                    klass = isinstance(child, ast.ClassDef)
                    kind = "class" if klass else "test" if child.name.startswith("test_") else "method" if in_class else "function"
                    first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                    yield kind, name, first, child.end_lineno, None
                    todo.append((child, name, klass))
                    continue
                if isinstance(child, ast.Import):
                    for alias in child.names:
                        yield "import", alias.asname or alias.name, child.lineno, child.end_lineno, alias.name
                elif isinstance(child, ast.ImportFrom):
                    for alias in child.names:
                        yield "import", alias.asname or alias.name, child.lineno, child.end_lineno, "." * child.level + ".".join(filter(None, (child.module, alias.name)))
                elif isinstance(child, ast.Call):
                    yield "call", outer, child.lineno, child.end_lineno, ast.unparse(child.func)
                todo.append((child, outer, in_class))


def chunk(artifacts: DataFrame, key: str, text: str, most_tokens: int = 512, overlap: int = 0) -> DataFrame:
    """The chunks of each artifact with their index: key, chunk_index, start_line, end_line, content, token_count."""
    found = spread(artifacts.select(key, text)).lateralJoin(LineChunks(F.col(text).outer(), F.lit(most_tokens), F.lit(overlap)))
    index = F.expr(f"row_number() over (partition by {key} order by start_line, end_line, content) - 1")
    return found.select(key, index.alias("chunk_index"), "start_line", "end_line", "content", "token_count")


def symbols(sources: DataFrame, key: str, text: str) -> DataFrame:
    """Definitions, imports and calls of Python sources, by lateral join."""
    return sources.select(key, text).lateralJoin(PythonSymbols(F.col(text).outer())).drop(text)
