"""Packing documents into training windows by lexical retrieval.

Documents are tokenized once and dealt to index shards of bounded size by the
range of a min-hash of their terms, so documents that share terms tend to share
a shard, while ties are broken by a hash of the id and no group of copies can
outgrow a shard. A shard is a BM25 inverted index over words, read from the ids. It is asked, for the
document that begins a window and with all of its words, for its best unused
neighbours in the shard; these fill the window greedily, and the one that is
cut at its end begins the next window.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table, written
from .shingles import mixed

END = 0
_ODD = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


#: A space that does not begin a piece. Before any other space a text can be cut and its parts encoded alone.
_RUN = re.compile(r" (?:\s|\Z)")
_NO_TERM = 1 << 32


class Tokenizer:
    """Ids of a byte-level vocabulary, given as ranks, and of the end-of-text mark, whose string in a text is that one id.

    They are the ids that the same vocabulary's merges give in other libraries.
    Also tells where words begin in them: ``opens`` are the ids that begin with
    white space, ``sort`` is 0 for white space, 1 for signs, 2 for letters and
    digits, and ``hashes`` those of the ids without a leading space, where they
    have one.
    """

    MARK = "<|endoftext|>"

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.mark = max(ranks.values()) + 1
        self.kind = "<u2" if self.mark < 1 << 16 else "<u4"
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = encoding.encode_to_numpy
        self.bytes = np.zeros(self.mark + 1, np.int64)
        self.opens, self.sort, bare = np.zeros(self.mark + 1, bool), np.zeros(self.mark + 1, np.uint8), np.arange(self.mark + 1, dtype=np.uint64)
        for token, rank in ranks.items():
            body = token.lstrip()
            self.bytes[rank] = len(token)
            self.opens[rank] = len(body) < len(token)
            self.sort[rank] = 0 if not body else 2 if body[:1].isalnum() or body[0] >= 0x80 else 1
            bare[rank] = ranks.get(body, rank)
        self.hashes = mixed(bare + np.uint64(1))

    def _ids(self, text: str) -> np.ndarray:
        return self.encode(text, disallowed_special=()).astype(self.kind)

    def ids(self, text: str) -> np.ndarray:
        parts = [self._ids(part) for part in text.split(self.MARK)]
        if len(parts) == 1:
            return parts[0]
        mark = np.array([self.mark], self.kind)
        return np.concatenate([x for part in parts for x in (mark, part)][1:])

    def _words(self, ids: np.ndarray, starts: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin in the ids of texts, of which each begins at one of ``starts``, and the hash of each."""
        if not len(ids):
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        sort = self.sort[ids]
        begins = self.opens[ids]
        begins[starts] = True
        begins[1:] |= sort[1:] != sort[:-1]
        first = np.flatnonzero(begins)
        place = np.arange(len(ids)) - np.repeat(first, np.diff(first, append=len(ids)))
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(self.hashes[ids] * _ODD[place & 63], first)
        stays = sort[first] == 2
        return first[stays], (mixed(sums[stays]) >> np.uint64(32)).astype(np.uint32)

    def terms(self, ids: np.ndarray) -> np.ndarray:
        """A 32-bit hash of each word: the ids from where one begins, or where letters and signs meet, to the next."""
        return self._words(ids)[1]

    def _least(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The smallest term of each text in ids, whose texts end at ``ends``, or more than any if it has none."""
        starts = np.r_[0, ends[:-1]]
        at, terms = self._words(ids, starts[starts < len(ids)])
        out = np.full(len(ends), _NO_TERM, np.int64)
        np.minimum.at(out, np.searchsorted(ends, at, "right"), terms.astype(np.int64))
        return out

    def of_batch(self, texts: list[str]) -> tuple[list[np.ndarray], list[int]]:
        """The ids of each text and its smallest term.

        What stands between the spaces of all texts is encoded once for each
        different string, with the space before it, and dealt out again. Texts
        with a run of white space that holds or follows a space, or with the
        mark, are encoded as a whole.
        """
        if not texts:
            return [], []
        ids, tails, of = [], [], []
        for k, text in enumerate(texts):
            whole = _RUN.search(text) is not None or self.MARK in text
            head, space, tail = (text, "", "") if whole else text.partition(" ")
            ids.append(self.ids(head))
            if space:
                tails.append(tail)
                of.append(k)
        least = self._least(np.concatenate(ids), np.cumsum([len(x) for x in ids])).tolist()
        if not tails:
            return ids, least
        split = pc.split_pattern(pa.array(tails, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        word, words = coded.indices.to_numpy(), coded.dictionary
        once = self._ids(" " + pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), pa.scalar(" ", words.type))[0].as_py())
        ends = np.cumsum(1 + pc.binary_length(words).to_numpy())  # in bytes
        ends = np.searchsorted(np.cumsum(self.bytes[once]), ends) + 1  # in ids
        starts = np.r_[0, ends[:-1]]
        smallest = self._least(once, ends)
        n = (ends - starts)[word]
        upto = np.cumsum(n)
        every = once[np.repeat(starts[word] - upto + n, n) + np.arange(upto[-1])]
        offsets = split.offsets.to_numpy()
        of_tail = np.minimum.reduceat(smallest[word], offsets[:-1]).tolist()
        bounds = np.r_[0, upto][offsets].tolist()
        for k, low, high, term in zip(of, bounds[:-1], bounds[1:], of_tail, strict=True):
            ids[k] = np.concatenate((ids[k], every[low:high]))
            least[k] = min(least[k], term)
        return ids, least


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One per worker."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


class Index:
    """BM25 over one shard's documents, each given by its terms, and their lengths.

    A term that no two documents share can't find anything and is not kept.
    The postings of the commonest terms are rows of a matrix of at most
    ``dense`` weights, which are summed at once, for all queries by one product
    if its result is no larger; those of the others are lists.
    """

    def __init__(self, docs: list[np.ndarray], sizes: list[int], k1: float = 1.2, b: float = 0.75, dense: int = 16 << 20) -> None:
        self.n = n = len(docs)
        lengths = np.array(sizes, np.float32)
        number = np.repeat(np.arange(n, dtype=np.uint64), [len(d) for d in docs])
        keys = (np.concatenate([*docs, np.zeros(0, np.uint32)]).astype(np.uint64) << np.uint64(32)) | number
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        tf = np.diff(np.r_[first, len(keys)]).astype(np.float32)
        keys = keys[first]
        term, doc = (keys >> np.uint64(32)).astype(np.uint32), keys.astype(np.uint32).astype(np.int32)
        start = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        df = np.diff(np.r_[start, len(term)])
        stays = np.repeat(df > 1, df)
        tf, doc, df = tf[stays], doc[stays], df[df > 1]
        idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
        weight = np.repeat(idf, df) * tf * np.float32(k1 + 1) / (tf + np.float32(k1) * (1 - b + b * lengths[doc] / max(1.0, float(lengths.mean()) if n else 1.0)).astype(np.float32))
        common = np.argsort(-df, kind="stable")[: dense // max(1, n)]
        common = common[16 * df[common] > n]
        number = np.full(len(df), -1, np.int32)
        number[common] = np.arange(len(common))
        row = np.repeat(number, df)
        self.rows = np.zeros((len(common), n), np.float32)
        self.rows[row[row >= 0], doc[row >= 0]] = weight[row >= 0]
        self.of_rows, self.rows_at = self._by_doc(row[row >= 0], doc[row >= 0])
        self.product = (self.rows.T > 0).astype(np.float32) @ self.rows if n * n <= dense else None
        self.doc, self.weight = doc[row < 0], weight[row < 0]
        self.df = df[number < 0]
        self.start = np.cumsum(self.df) - self.df
        self.terms, self.terms_at = self._by_doc(np.repeat(np.arange(len(self.df), dtype=np.int32), self.df), self.doc)

    def _by_doc(self, values: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.argsort(doc, kind="stable")
        return values[by], np.searchsorted(doc[by], np.arange(self.n + 1))

    def scores(self, doc: int) -> np.ndarray:
        """Of all documents for the terms of one."""
        if self.product is not None:
            score = self.product[doc].astype(np.float64)
        else:
            score = self.rows[self.of_rows[self.rows_at[doc] : self.rows_at[doc + 1]]].sum(0, dtype=np.float32).astype(np.float64)
        asked = self.terms[self.terms_at[doc] : self.terms_at[doc + 1]]
        sizes = self.df[asked]
        if sizes.sum():
            ends = np.cumsum(sizes)
            at = np.repeat(self.start[asked] - ends + sizes, sizes) + np.arange(ends[-1])
            score += np.bincount(self.doc[at], self.weight[at], self.n)
        return score

    def neighbours(self, doc: int, unused: np.ndarray, at_once: int = 32) -> Iterator[int]:
        """The unused documents that share any term, best first."""
        score = np.where(unused, self.scores(doc), 0.0)
        least = np.partition(score, -at_once)[-at_once] if self.n > at_once else 0.0
        best = np.flatnonzero((score >= least) & (score > 0))
        yield from best[np.argsort(-score[best], kind="stable")].tolist()
        rest = np.flatnonzero((score < least) & (score > 0))
        yield from rest[np.argsort(-score[rest], kind="stable")].tolist()

    def drop_used(self, unused: np.ndarray) -> None:
        """Leaves the listed postings of unused documents only; no answer changes."""
        stays = unused[self.doc]
        before = np.r_[0, np.cumsum(stays)]
        self.start, self.df = before[self.start], before[self.start + self.df] - before[self.start]
        self.doc, self.weight = self.doc[stays], self.weight[stays]


def arranged(docs: list[np.ndarray], sizes: list[int], window: int) -> list[int]:
    """The documents, given by terms and sizes, in packing order: each window filled with the unused neighbours of the one that begins it."""
    index = Index(docs, sizes)
    unused, order, filled = np.ones(len(docs), bool), [], 0
    seed, following, kept = -1, 0, len(docs)
    while len(order) < len(docs):
        if len(docs) - len(order) < kept * 3 // 4:
            kept = len(docs) - len(order)
            index.drop_used(unused)
        if seed < 0:
            while not unused[following]:
                following += 1
            seed = following
            unused[seed] = False
            order.append(seed)
            filled += sizes[seed]
        if filled % window:
            end = filled + window - filled % window
            for near in index.neighbours(seed, unused):
                unused[near] = False
                order.append(near)
                filled += sizes[near]
                if filled >= end:
                    break
            seed = order[-1] if filled > end else -1
        else:
            seed = -1
    return order


def cuts(total: int, window: int) -> list[int]:
    """Where sequences begin: full windows, then the rest in falling powers of two, which need no padding."""
    out = list(range(0, total - total % window, window))
    at, rest = total - total % window, total % window
    while rest:
        out.append(at)
        step = 1 << rest.bit_length() - 1
        at, rest = at + step, rest - step
    return out


def _tokenized(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for batch in pieces(batches, 8 << 20):
            ids, least = coder.of_batch([text or "" for text in batch.column(1).to_pylist()])
            n, route = [len(x) + 1 for x in ids], [0 if x == _NO_TERM else x for x in least]
            ids = [np.append(x, np.array([END], coder.kind)).tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(route, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n", "route", "ids"])

    return run


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packed(path: str, window: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        doc_ids: list[int | None] = []
        docs: list[np.ndarray] = []
        for batch in batches:
            doc_ids += batch.column(0).to_pylist()
            docs += [np.frombuffer(x, coder.kind) for x in batch.column(1).to_pylist()]
        if not docs:
            return
        shard = TaskContext.get().partitionId() << 40
        begins = np.array(cuts(sum(map(len, docs)), window))
        at, rows = 0, []
        for k in arranged([coder.terms(d[:-1]) for d in docs], [len(d) for d in docs], window):
            end = at + len(docs[k])
            inner = begins[np.searchsorted(begins, at, "right") : np.searchsorted(begins, end, "left")].tolist()
            for low, high in zip([at, *inner], [*inner, end], strict=True):
                sequence = int(np.searchsorted(begins, low, "right")) - 1
                ids = docs[k][low - at : high - at].astype("<u4").tobytes()
                rows.append((doc_ids[k], low - at, high - low, zlib.crc32(ids), len(docs[k]), shard + sequence, low - int(begins[sequence]), *[ids] * with_ids))
            at = end
            if len(rows) >= 10_000 or with_ids and len(rows) >= 1000:
                yield _rows(rows)
                rows = []
        if rows:
            yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    names = [x.split()[0] for x in PIECES.split(", ")]
    arrays = [pa.array(x, pa.int64()) for x in columns[: len(names)]]
    if len(columns) > len(names):
        arrays, names = [*arrays, pa.array(columns[-1], pa.binary())], [*names, "ids"]
    return pa.RecordBatch.from_arrays(arrays, names)


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = 1024, shard_tokens: int = 4_000_000, with_ids: bool = False) -> DataFrame:
    """The pieces of all of ``docs``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its tokens and a closing id 0; a null or empty text is that
    id alone. Each id lies in exactly one piece. Every sequence but the last
    few of a shard is a full window, and those are powers of two, so nothing
    is padded. Repeated rows, and rows without an id, are packed like any
    other; an empty table gives no pieces. Other columns are not looked at.
    ``with_ids`` adds the pieces' ids as little-endian unsigned 32-bit numbers.

    A query is all of a document's terms. An index shard holds about
    ``shard_tokens``, so a task's memory is bounded and the number of shards
    follows the input.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coded = written(read.mapInArrow(_tokenized(tokenizer_path), "doc_id long, n long, route long, ids binary"), "packing-ids")
    total = coded.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    dealt = coded.withColumn("salt", F.xxhash64("doc_id", "n")).repartitionByRange(shards, "route", "salt").sortWithinPartitions("route", "salt", "doc_id", "n")
    return dealt.select("doc_id", "ids").mapInArrow(_packed(tokenizer_path, window, with_ids), PIECES + (", ids binary" if with_ids else ""))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pack`` of all documents into sequences of at most 1,024 tokens; nulls, empty texts, repeated rows and the empty table as there."""
    return pack(table(spark, sf_dir, "documents"))
