"""Spelling variants: words one code point apart, and the common form each goes back to.

The words of all texts are counted. Those that count are numbered in two tries,
of the words and of the words reversed, so that a word cut at any place is a
pair of integers: the node of what stands before and the node of what stands
after. Two words that differ by a replaced code point share the pair around the
place left out; a word with one code point more shares, around it, the pair
that the shorter word has at a cut. At most one word has a given cut, and
what is left out has as many values as the alphabet, so a pair joins few words
however common they are, and no near words are missed.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, crc32_sql, table, written

#: A node is the number of the first word that passes through it and, in the low bits, its depth.
_DEPTH = 28
_RUN = re.compile("[a-zÀ-ÿ]+")


def word_counts(docs: DataFrame, every: int = 199, least: int = 6, often: int = 5) -> DataFrame:
    """(word, n): the words of ``docs`` (doc_id, text) of at least ``least`` code points with at least ``often`` occurrences.

    Words are runs of letters of which only A to Z are lower-cased. A run whose
    CRC-32 with its document's id is a multiple of ``every`` loses a code point.
    Null texts have no words, a null id counts as an empty one, repeated rows
    count each, and texts are read whole. An empty table has no words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[str] = Counter()
            for doc_id, text in zip(as_bytes(batch.column(0)), as_bytes(batch.column(1)), strict=True):
                seed = crc32(doc_id + b":")
                for word, n in Counter(_RUN.findall(text.lower().decode("utf-8", "replace"))).items():
                    h = crc32(word.encode(), seed)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= least:
                        found[word] += n
            yield pa.record_batch([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

    counted = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def trie_nodes(words: DataFrame, name: str) -> DataFrame:
    """(word, number, nodes): each different word's place in their order, from 0, and its trie nodes from the root down.

    Words are sorted over all partitions. A partition numbers its own nodes; a
    node that reaches back over its first word is named by the partition in which it began, which the
    first and last words of the partitions before tell (one row a partition).
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, last, starts = TaskContext.get().partitionId(), 0, "", []
        for batch in batches:
            texts, every, n = batch.column(0).to_pylist(), [], batch.num_rows
            for word in texts:
                shared = len(commonprefix((last, word)))
                starts = starts[:shared] + [at] * (len(word) - shared)
                every.append(starts)
                last, at = word, at + 1
            yield pa.record_batch([batch.column(0), pa.array([part] * n, pa.int32()), pa.array(range(at - n, at), pa.int64()), pa.array(every, pa.list_(pa.int64()))], ["word", "part", "at", "starts"])

    placed = written(words.select("word").repartitionByRange("word").sortWithinPartitions("word").mapInArrow(number, "word string, part int, at long, starts array<long>"), name)
    ends = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("word").alias("first"), F.max(F.struct("at", "word", "starts")).alias("last")).orderBy("part").collect()
    parts, offset, last, global_starts = [], 0, "", []
    for end in ends:
        carried = global_starts[: len(commonprefix((last, end.first)))]
        parts.append((end.part, offset, carried))
        global_starts = [carried[k] if s == 0 and k < len(carried) else offset + s for k, s in enumerate(end.last.starts)]
        last, offset = end.last.word, offset + end.n
    known = F.broadcast(words.sparkSession.createDataFrame(parts, "part int, before long, carried array<long>"))
    start = lambda s, k: F.when((s == 0) & (k < F.size("carried")), F.get("carried", k)).otherwise(F.col("before") + s)
    node = lambda s, k: F.shiftleft(start(s, k), _DEPTH).bitwiseOR((k + 1).cast("long"))
    return placed.join(known, "part").select("word", (F.col("before") + F.col("at")).alias("number"), F.concat(F.array(F.lit(0).cast("long")), F.transform("starts", node)).alias("nodes"))


def word_nodes(counts: DataFrame) -> DataFrame:
    """``counts`` (word, n) with each word's number and its nodes in the tries of words and of words reversed (``after``)."""
    after = trie_nodes(counts.select(F.reverse("word").alias("word")), "suffixes").select(F.reverse("word").alias("word"), F.col("nodes").alias("after"))
    return trie_nodes(counts, "prefixes").join(counts, "word").join(after, "word")


def node_pairs(words: DataFrame) -> DataFrame:
    """(p, s, number, n, kind): the pairs of trie nodes of ``words`` (word, n, number, nodes, after).

    ``kind`` is 0 where nothing is left out between the two, 2 where one code
    point is, and 1 where it equals the one before it, so that leaving out either
    gives the same word.
    """
    pair = lambda k, skipped, kind: F.struct(F.get("nodes", k).alias("p"), F.get("after", F.length("word") - k - skipped).alias("s"), kind.cast("byte").alias("kind"))
    letters = F.col("letters")
    holes = F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda k: pair(k, 1, F.when((k > 0) & (F.get(letters, k) == F.get(letters, k - 1)), 1).otherwise(2)))
    cuts = F.transform(F.sequence(F.lit(0), F.length("word")), lambda k: pair(k, 0, F.lit(0)))
    return words.withColumn("letters", F.split("word", "")).select("number", "n", F.inline(F.concat(holes, cuts)))


def near_words(pairs: DataFrame) -> DataFrame:
    """(number, n_near, best): how many words are one code point from each that has any, and the commonest of them.

    ``best`` holds its n and its number made negative, so that of equal ones the
    first word is the greatest. A pair of nodes has one word at a cut at most and
    one for each letter of the alphabet around a hole; no pairs of words are made.
    """
    words = pairs.groupBy("p", "s").agg(F.collect_list(F.struct("n", (-F.col("number")).alias("minus"), "kind")).alias("words")).where(F.size("words") > 1)
    kinds = words.select(
        "words",
        F.sort_array(F.filter("words", lambda w: w.kind > 0), asc=False).alias("holes"),
        F.array_max(F.filter("words", lambda w: w.kind == 2)).alias("longer"),
        F.size(F.filter("words", lambda w: w.kind == 2)).alias("n_longer"),
        F.array_max(F.filter("words", lambda w: w.kind == 0)).alias("cut"),
    )
    other = lambda w: F.when(w.minus == F.get("holes", F.lit(0)).minus, F.get("holes", F.lit(1))).otherwise(F.get("holes", F.lit(0)))
    own = lambda w: F.when(w.kind == 2, F.col("cut"))
    found = lambda w: F.struct(
        (-w.minus).alias("number"),
        F.when(w.kind == 0, F.col("n_longer")).otherwise(F.size("holes") - 1 + F.when(own(w).isNull(), 0).otherwise(1)).cast("long").alias("n_near"),
        F.when(w.kind == 0, F.col("longer")).otherwise(F.array_max(F.array(other(w), own(w)))).alias("best"),
    )
    each = kinds.select(F.inline(F.transform("words", found))).where("n_near > 0")
    return each.groupBy("number").agg(F.sum("n_near").alias("n_near"), F.max(F.struct("best.n", "best.minus")).alias("best"))


def followed(forms: DataFrame, links: int) -> DataFrame:
    """(number, root) of ``forms`` (number, form), by doubling the steps until chains of ``links`` links are followed to their end."""
    roots = forms.select("number", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, links))))):
        then = roots.select(F.col("number").alias("root"), F.col("root").alias("next"))
        roots = roots.join(then, "root", "left").select("number", F.coalesce("next", "root").alias("root"))
    return roots


def spelling_variants(docs: DataFrame, every: int = 199, least: int = 6, often: int = 5, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of all texts of ``docs`` (doc_id, text) and the forms they are variants of.

    A word's form is the commonest of its near words (of equal ones the first by
    code points), if it has at least ``ratio`` times the word's occurrences, else
    null; its root is where following forms ends. Nulls, repeated rows, very long
    texts and the empty table are as in ``word_counts``; columns other than these
    two are not read, whatever their names.
    """
    counts = written(word_counts(docs, every, least, often), "words")
    words = written(word_nodes(counts), "nodes")
    words = words.join(near_words(node_pairs(words)), "number", "left")
    form = F.when(F.col("best.n") >= ratio * F.col("n"), -F.col("best.minus"))
    words = written(words.select("word", "number", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form.alias("form"), F.when(form.isNotNull(), F.col("best.n")).alias("form_n")), "variants")
    most = words.agg(F.max("n")).first()[0] or often
    roots = followed(words.where("form is not null").select("number", "form"), math.floor(math.log(max(1, most / often), ratio) + 1e-9) + 1)
    named = lambda number, word: words.select(F.col("number").alias(number), F.col("word").alias(word))
    linked = words.where("form is not null").join(roots, "number").withColumnRenamed("form", "form_number").withColumnRenamed("root", "root_number")
    linked = linked.join(named("form_number", "form"), "form_number").join(named("root_number", "root"), "root_number")
    names = ("word", "form", "root", "n", "n_near", "form_n")
    alone = words.where("form is null").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return linked.select(*names).unionByName(alone.select(*names))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling variants of the words of ``documents``: see ``spelling_variants``.

    A row for each word of at least 6 code points with at least 5 occurrences;
    none for an empty table or one of null texts.
    """
    return spelling_variants(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
t AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY 1, 2),
h AS (SELECT run, n, {crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM t),
k AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM k WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
v AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
o AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM v),
e AS (
  SELECT a.word AS a, b.word AS b FROM o a JOIN o b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT o.word, w.word FROM o JOIN w ON o.rest = w.word
  UNION SELECT w.word, o.word FROM o JOIN w ON o.rest = w.word
),
b AS (SELECT e.a AS word, count(*) AS n_near, max(w.n) AS most FROM e JOIN w ON e.b = w.word GROUP BY 1),
f AS (SELECT b.word, min(e.b) AS form, any_value(b.most) AS form_n FROM b JOIN w USING (word) JOIN e ON e.a = b.word JOIN w x ON x.word = e.b AND x.n = b.most WHERE b.most >= 5 * w.n GROUP BY 1),
g AS (SELECT word, form AS root, 1 AS far FROM f UNION ALL SELECT g.word, f.form, far + 1 FROM g JOIN f ON f.word = g.root)
SELECT w.word, f.form, coalesce(q.root, w.word) AS root, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, f.form_n
FROM w LEFT JOIN b USING (word) LEFT JOIN f USING (word) LEFT JOIN (SELECT word, arg_max(root, far) AS root FROM g GROUP BY 1) q USING (word)
"""
