"""Language-model scoring: stupid backoff from the corpus's own n-gram counts.

The count tables are partitioned by hash, joined to the n-grams of every block
of documents, and the scores are summed per document. A document's own counts
are left out, so it is judged by what all others say, and an n-gram that only
it has is backed off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import BLOCKS, REQUESTS, blocks, by_block, parts_for, request_batches, requests, texts_of, totals
from .blocks import answers as answers_of
from .common import table
from .shingles import mixed, word_hashes

BACKOFF = 0.4


def ngrams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Document of each word, its place there, and for each order the hash of the n-gram that ends at it (0: too early)."""
    words, at = [], [0]
    for low in range(0, len(texts), 256):
        w, a = word_hashes(texts[low : low + 256])
        at += (a[1:] + at[-1]).tolist()
        words.append(w)
    word, at = np.concatenate(words) if words else np.zeros(0, np.uint64), np.array(at)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    place = np.arange(len(word)) - at[doc] if len(word) else np.zeros(0, np.int64)
    grams = [mixed(word + np.uint64(1))]
    with np.errstate(over="ignore"):
        for n in range(2, order + 1):
            longer = np.zeros_like(word)
            longer[1:] = mixed(grams[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:] + np.uint64(n))
            longer[place < n - 1] = 0
            grams.append(longer)
    return doc, place, grams


def block_keys(grams: list[np.ndarray], place: np.ndarray) -> np.ndarray:
    """All n-grams of a block, of all orders."""
    return np.concatenate([g[place >= n] for n, g in enumerate(grams)])


def scores_of(texts: list[bytes], totals_of: np.ndarray, every: int, order: int, backoff: float) -> tuple[np.ndarray, np.ndarray]:
    """For each document its words and its summed log score.

    ``totals_of`` are the corpus counts of the block's distinct keys in
    ascending order, ``every`` the words of the corpus.
    """
    doc, place, grams = ngrams(texts, order)
    n_words = np.bincount(doc, minlength=len(texts))
    keys, where = np.unique(block_keys(grams, place), return_inverse=True)
    if len(keys) != len(totals_of):
        raise ValueError("a block's keys and their counts don't match")
    began, total, others = 0, [], []
    for n in range(order):
        here = place >= n
        at = where[began : began + int(here.sum())]
        began += len(at)
        pair = doc[here].astype(np.uint64) << np.uint64(32) | at.astype(np.uint64)
        _, which, own = np.unique(pair, return_inverse=True, return_counts=True)
        count = np.zeros(len(doc))
        count[here] = totals_of[at].astype(np.float64) - own[which]
        others.append(count)
        total.append(here)
    rest = np.maximum(every - n_words[doc], 0).astype(np.float64)
    single = others[0]
    score = np.where(single > 0, single / np.maximum(rest, 1), 1 / (rest + 1))
    for n in range(1, order):
        before = np.r_[0.0, others[n - 1][:-1]]
        seen = others[n] > 0
        score = np.where(seen, others[n] / np.maximum(before, 1), np.where(total[n], backoff * score, score))
    return n_words, np.bincount(doc, np.log(score), len(texts))


def score_documents(docs: DataFrame, order: int = 3, backoff: float = BACKOFF, part_keys: int = 1_500_000) -> DataFrame:
    """For each row of ``docs``: doc_id, n_words, score (mean log stupid-backoff score of its words).

    Words are runs that are not white space, A-Z as a-z. With c the counts
    over all other rows and N their words, a word w after h scores
    c(hw) / c(h) if c(hw) > 0, else ``backoff`` times its score after the
    history without its first word; alone it scores c(w) / N, or 1 / (N + 1)
    if no other row has it. A row's first words have shorter histories. Null,
    empty and blank texts have no words and a null score. Repeated rows are
    rows like any other, so each is known from its copies. Other columns are
    not looked at.
    """
    cut = blocks(docs)
    parts, _ = parts_for(cut, 0.19 * order, part_keys)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for number, sizes, packed in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    _, place, grams = ngrams(texts_of(sizes, packed), order)
                    yield from requests(number, *np.unique(block_keys(grams, place), return_counts=True), parts)

        return request_batches(rows())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [sum(len(t.split()) for t in texts_of(s, p)) for s, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n"])

    every = cut.select("sizes", "texts").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
    asked = cut.select("block", "sizes", "texts").mapInArrow(ask, REQUESTS)

    def use(block: pa.Table, answered: pa.Table) -> pa.Table:
        ids, n, score = [], [], []
        for k in range(block.num_rows):
            row = {c: block[c][k].as_py() for c in ("doc_ids", "sizes", "texts")}
            words, summed = scores_of(texts_of(row["sizes"], row["texts"]), answers_of(answered), every, order, backoff)
            ids += row["doc_ids"]
            n += words.tolist()
            score += [s / w if w else None for s, w in zip(summed.tolist(), words.tolist(), strict=True)]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n, pa.int64()), "score": pa.array(score, pa.float64())})

    return by_block(cut.select(*(c.split()[0] for c in BLOCKS.split(", "))), totals(asked, parts), use, "doc_id long, n_words long, score double")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigrams, as its SQL has them; ``op5_lm_scoring_trigrams`` is the whole of it."""
    return score_documents(table(spark, sf_dir, "documents"), order=2).withColumn("score", F.round("score", 6))


def op5_lm_scoring_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the operator's own order, three."""
    return score_documents(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), t AS (
  SELECT r, p, ws[p] AS w, CASE WHEN p > 1 THEN ws[p - 1] END AS v FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS p FROM d)
), c1 AS (SELECT w, count(*) AS c FROM t GROUP BY w),
o1 AS (SELECT r, w, count(*) AS c FROM t GROUP BY r, w),
c2 AS (SELECT v, w, count(*) AS c FROM t WHERE p > 1 GROUP BY v, w),
o2 AS (SELECT r, v, w, count(*) AS c FROM t WHERE p > 1 GROUP BY r, v, w),
n AS (SELECT count(*) AS words FROM t),
s AS (
  SELECT t.r,
    CASE WHEN c2.c - o2.c > 0 THEN (c2.c - o2.c) / (cv.c - ov.c)::DOUBLE
         ELSE (CASE WHEN t.p > 1 THEN 0.4::DOUBLE ELSE 1::DOUBLE END)
              * (CASE WHEN c1.c - o1.c > 0 THEN (c1.c - o1.c) / (n.words - len(d.ws))::DOUBLE ELSE 1 / (n.words - len(d.ws) + 1)::DOUBLE END) END AS score
  FROM t JOIN d USING (r) CROSS JOIN n
  JOIN c1 ON c1.w = t.w JOIN o1 ON o1.r = t.r AND o1.w = t.w
  LEFT JOIN c2 ON c2.v = t.v AND c2.w = t.w LEFT JOIN o2 ON o2.r = t.r AND o2.v = t.v AND o2.w = t.w
  LEFT JOIN c1 cv ON cv.w = t.v LEFT JOIN o1 ov ON ov.r = t.r AND ov.w = t.v
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, round(avg(ln(s.score)), 6) AS score
FROM d LEFT JOIN s USING (r) GROUP BY d.r, d.doc_id, len(d.ws)
"""
