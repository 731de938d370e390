"""Outlines of Markdown and reStructuredText: headings with ranks, and the lines of the section under each.

Files are rows of lines (key, markdown, n, line), n from 1, markdown saying which
of the two a file is. A file's lines meet in one window, so a file is
taken to fit a task; there may be any number of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What underlines a title, what ends a block of data, how a link target is written.
ADORNMENT = r"^([=\-~^\"'`#*+])\1{2,}\s*$"
BLOCK_END = r"^([=\-~^])\1{2,}\s*$"
TARGET = r"^\.\. _[^:]+:\s*$"
MARKDOWN = r"^(#{1,6})\s+(.*?)\s*#*\s*$"

#: Ranks that there can be: six depths of Markdown, or ten signs with and without a line above.
RANKS = 20

_BLANK = r"^\s*$"


def _trimmed(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def text_lines(files: DataFrame, key: str, path: Column, content: Column) -> DataFrame:
    """(key, markdown, n, line) of each file."""
    return files.select(F.col(key).alias("key"), path.endswith(".md").alias("markdown"), F.posexplode(F.split(content, "\r\n|\n|\r")).alias("n", "line")).withColumn("n", (F.col("n") + 1).cast("long"))


def headings(lines: DataFrame) -> DataFrame:
    """(key, rank, title, n) of each heading.

    In Markdown outside of fenced code, ranked by depth from 1; a fence opens and
    closes by turns. Elsewhere a title is underlined at least as far as it
    reaches; its rank from 0 is the order in which its file first uses that sign, with or without a
    line above, and n is the line above if there is one.
    """
    by = Window.partitionBy("key").orderBy("n")
    fence = F.ltrim(_trimmed(F.col("line"), r"^\s+")).rlike(r"^(```|~~~)")
    seen = lines.withColumns({"_fence": fence, "_title": F.lag("line", 1).over(by), "_over": F.lag("line", 2).over(by)})
    seen = seen.withColumn("_open", F.sum(F.col("_fence").cast("int")).over(by) % 2 == 1)
    sharp = F.col("markdown") & ~F.col("_fence") & ~F.col("_open") & F.col("line").rlike(MARKDOWN)
    end = lambda c: _trimmed(c, r"\s+$")
    under = ~F.col("markdown") & F.col("line").rlike(ADORNMENT) & ~F.col("_title").rlike(_BLANK) & ~F.col("_title").rlike(ADORNMENT) & ~F.col("_title").rlike(r"^( |\t|\.\.)") & (F.length(end(F.col("line"))) >= F.length(end(F.col("_title"))))
    above = F.coalesce(_trimmed(F.trim(end(F.col("_over"))), r"^\s+") == _trimmed(end(F.col("line")), r"^\s+"), F.lit(False))
    found = seen.where(sharp | F.coalesce(under, F.lit(False))).withColumn("_above", ~F.col("markdown") & above)
    style = Window.partitionBy("key", "markdown", F.left("line", F.lit(1)), "_above")
    found = found.withColumn("_first", F.when(~F.col("markdown"), F.min("n").over(style)))
    rank = F.when(F.col("markdown"), F.length(F.regexp_extract("line", MARKDOWN, 1))).otherwise(F.dense_rank().over(Window.partitionBy("key", "markdown").orderBy("_first")) - 1)
    title = F.when(F.col("markdown"), F.regexp_extract("line", MARKDOWN, 2)).otherwise(F.col("_title"))
    place = F.when(F.col("markdown"), F.col("n")).when(F.col("_above"), F.col("n") - 2).otherwise(F.col("n") - 1)
    return found.select("key", rank.cast("int").alias("rank"), _trimmed(_trimmed(title, r"^\s+"), r"\s+$").alias("title"), place.alias("n"))


def outline(lines: DataFrame) -> DataFrame:
    """(key, rank, title, start_line, end_line): each heading with the lines up to the next of equal or higher rank.

    Blank lines and link targets at its end belong to the next section. What
    follows at each rank is a running minimum from the end of the file, so a
    file's headings are sorted once and no two of them are compared.
    """
    later = Window.partitionBy("key").orderBy("n").rowsBetween(1, Window.unboundedFollowing)
    ends = F.array(*(F.min(F.when(F.col("rank") <= r, F.col("n"))).over(later) for r in range(RANKS)))
    found = headings(lines).withColumn("_next", F.get(ends, F.col("rank")))
    upto = Window.partitionBy("key").orderBy("n")
    empty = F.col("line").rlike(_BLANK) | F.col("line").rlike(TARGET)
    full = lines.select("key", F.col("n").alias("_end"), F.max(F.when(~empty, F.col("n"))).over(upto).alias("_full"))
    last = lines.groupBy("key").agg(F.max("n").alias("_last"))
    bounded = found.join(last, "key").withColumn("_end", F.coalesce(F.col("_next") - 1, F.col("_last"))).join(full, ["key", "_end"], "left")
    return bounded.select("key", "rank", "title", F.col("n").alias("start_line"), F.greatest("n", F.coalesce("_full", "n")).alias("end_line"))


def _only(asked: DataFrame, found: DataFrame, what: str) -> DataFrame:
    """Each asked (key, name) with the one row found of that name; none or several raise, and the error names both."""
    n = found.groupBy("key", "name").agg(F.count("*").alias("_n"), F.min(F.struct("start_line", "end_line")).alias("_s"))
    both = asked.join(n, ["key", "name"], "left")
    said = F.concat(F.col("key").cast("string"), F.lit(f": {what} "), F.col("name"), F.lit(" found "), F.coalesce("_n", F.lit(0)).cast("string"), F.lit(" times"))
    one = F.when(F.col("_n") == 1, F.col("_s")).otherwise(F.raise_error(said))
    return both.withColumn("_s", one).select(*asked.columns, "_s.start_line", "_s.end_line")


def sections_of(asked: DataFrame, lines: DataFrame) -> DataFrame:
    """``asked`` (key, name) with the lines of the section of that heading, of which a file must have exactly one."""
    return _only(asked, outline(lines).withColumnRenamed("title", "name"), "heading")


def data_blocks(lines: DataFrame) -> DataFrame:
    """(key, name, start_line, end_line): each py:data directive up to the next directive or title, without blank lines at its end."""
    by = Window.partitionBy("key").orderBy("n")
    after = by.rowsBetween(1, Window.unboundedFollowing)
    stop = F.col("line").startswith(".. ") | F.coalesce(F.lead("line", 1).over(by).rlike(BLOCK_END), F.lit(False))
    name = F.regexp_extract(F.trim(_trimmed(_trimmed(F.col("line"), r"^\s+"), r"\s+$")), r"^\.\. py:data:: (.+)$", 1)
    seen = lines.withColumns({"_stop": stop, "name": name, "_last": F.max("n").over(Window.partitionBy("key")), "_full": F.max(F.when(~F.col("line").rlike(_BLANK), F.col("n"))).over(by)})
    seen = seen.withColumn("_next", F.min(F.when(F.col("_stop"), F.col("n"))).over(after)).withColumn("_end", F.coalesce(F.col("_next") - 1, F.col("_last")))
    full = seen.select("key", F.col("n").alias("_end"), F.col("_full").alias("_upto"))
    found = seen.where("name != ''").drop("_full").join(full, ["key", "_end"])
    return found.select("key", "name", F.col("n").alias("start_line"), F.greatest("n", F.coalesce("_upto", "n")).alias("end_line"))


def data_blocks_of(asked: DataFrame, lines: DataFrame) -> DataFrame:
    """``asked`` (key, name) with the lines of that py:data block, of which a file must have exactly one."""
    return _only(asked, data_blocks(lines), "py:data")
