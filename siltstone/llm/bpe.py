"""Byte-level BPE: texts to the ids of a ranked vocabulary, and back.

A text is cut by the vocabulary's pattern; each piece that is no token itself
is merged by a queue of ranks. The queue has a bucket of positions for each
rank, a bitmap over the buckets and another over the words of that bitmap, so
the lowest rank that waits is the first set bit of two words, however long the
piece is. Parts of a piece are a linked list; an entry whose pair has since
changed is skipped. Each text is encoded where it is read: nothing is shuffled.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, fresh, table

#: Bits of a word of the bitmap over ranks; a second word has a bit for each word.
_SHIFT = 8
_WIDE = 1 << _SHIFT

class Pieces(dict):
    """The ids of pieces, as little-endian unsigned 32-bit integers.

    Short pieces are remembered in two generations of at most ``most`` each:
    when the younger is full it becomes the older, from which what is asked for
    again moves on. Forgetting costs time and changes no result.
    """

    def __init__(self, merge, most: int = 1 << 19) -> None:
        self.merge, self.most, self.older = merge, most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = np.array(self.merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Vocabulary:
    """A file of ranks: encoding by its merges and decoding by its tokens.

    Ids equal those of the tiktoken library, which knows letters and numbers by
    a version of Unicode of its own; where the pattern library here differs, the
    differing characters are found once and set apart in the pattern.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.single = [self.ranks[bytes([k])] for k in range(256)]
        self.bits = [1 << k for k in range(max(_WIDE, len(self.tokens) // _WIDE + 1))]
        self.pieces = Pieces(self.merged)
        self.plain = regex.compile(public_tokenizers.PATTERN)
        pattern, odd = public_tokenizers.PATTERN, set()
        for kind in (r"\p{L}", r"\p{N}"):
            more, less = differing(kind)
            odd |= more | less
            own = f"[[{kind}--[{''.join(map(_escaped, sorted(less)))}]]||[{''.join(map(_escaped, sorted(more)))}]]" if more and less else f"[{kind}--[{''.join(map(_escaped, sorted(less)))}]]" if less else f"[{kind}||[{''.join(map(_escaped, sorted(more)))}]]" if more else kind
            pattern = pattern.replace(kind, own)
        self.careful = regex.compile(pattern, regex.V1) if odd else self.plain
        self.rare = re.compile(f"[{min(odd)}-\U0010ffff]") if odd else re.compile(r"(?!)")

    def merged(self, piece: bytes) -> Sequence[int]:
        """The ids of one piece: always the lowest rank of two neighbours is merged, of equal ones the leftmost."""
        get, bits, n = self.ranks.get, self.bits, len(piece)
        if (whole := get(piece)) is not None:
            return [whole]
        held = list if n < 4096 else _compact
        ids = held(map(self.single.__getitem__, piece))
        following, before = held(range(1, n + 1)), held(range(-1, n - 1))
        waits = held(get(piece[k : k + 2], -1) for k in range(n - 1))  # the rank of the pair that begins here, or -1
        waits.append(-1)
        words, top, buckets = [0] * (len(self.tokens) // _WIDE + 1), 0, {}
        for k, rank in enumerate(waits):
            if rank < 0:
                continue
            if rank in buckets:
                buckets[rank].append(k)
                continue
            buckets[rank] = [k]
            at = rank >> _SHIFT
            top |= bits[at]
            words[at] |= bits[rank & _WIDE - 1]
        while top:
            lowest = top & -top
            at = lowest.bit_length() - 1
            word = words[at]
            first = word & -word
            rank = at << _SHIFT | first.bit_length() - 1
            bucket = buckets[rank]
            k = heappop(bucket)
            if not bucket:
                del buckets[rank]
                words[at] = word = word ^ first
                if not word:
                    top ^= lowest
            if waits[k] != rank:
                continue
            ids[k] = rank
            gone = following[k]
            following[k] = after = following[gone]
            waits[gone] = waits[k] = -1
            if after < n:
                before[after] = k
                if (rank := get(piece[k : following[after]], -1)) >= 0:
                    waits[k] = rank
                    if rank in buckets:
                        heappush(buckets[rank], k)
                    else:
                        buckets[rank] = [k]
                        at = rank >> _SHIFT
                        top |= bits[at]
                        words[at] |= bits[rank & _WIDE - 1]
            if k:
                k = before[k]
                waits[k] = rank = get(piece[k:after], -1)
                if rank >= 0:
                    if rank in buckets:
                        heappush(buckets[rank], k)
                    else:
                        buckets[rank] = [k]
                        at = rank >> _SHIFT
                        top |= bits[at]
                        words[at] |= bits[rank & _WIDE - 1]
        out, k = [], 0
        while k < n:
            out.append(ids[k])
            k = following[k]
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text, packed; long texts are cut a run of pieces at a time."""
        cut = self.careful if self.rare.search(text) else self.plain
        if len(text) < 1 << 20:
            return b"".join(map(self.pieces.__getitem__, cut.findall(text)))
        found, parts = cut.finditer(text), []
        while part := b"".join(self.pieces[m.group()] for m in islice(found, 1 << 16)):
            parts.append(part)
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _compact(values: Iterable[int]) -> array:
    return array("q", values)


def _escaped(c: str) -> str:
    return f"\\U{ord(c):08x}"


_DIFFERING: dict[str, tuple[set[str], set[str]]] = {}


def differing(kind: str) -> tuple[set[str], set[str]]:
    """The characters that only tiktoken takes for ``kind``, and those that only the pattern library does."""
    if kind not in _DIFFERING:
        import regex
        import tiktoken

        every = "".join(chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000)
        alone = tiktoken.Encoding("bytes", pat_str=kind, mergeable_ranks={bytes([k]): k for k in range(256)}, special_tokens={})
        theirs, ours = set(bytes(alone.encode_ordinary(every)).decode()), set(regex.findall(kind, every))
        _DIFFERING[kind] = theirs - ours, ours - theirs
    return _DIFFERING[kind]


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One per worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def multilingual() -> str:
    """The place of the vocabulary that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encoded(text: Column, path: str) -> Column:
    """The ids of ``text`` by the ranks in ``path``, packed as little-endian unsigned 32-bit integers.

    Null counts as empty, and an empty text has no ids. Texts are encoded whole,
    whatever their length; a special token's string is ordinary text.
    """

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = vocabulary(path)
        for column in columns:
            yield pa.array((known.encode(x.decode("utf-8", "replace")) for x in as_bytes(column)), pa.binary())

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary")(text)


def decoded(ids: Column, path: str) -> Column:
    """The bytes that packed ``ids`` stand for; null counts as no ids, an id beyond the vocabulary raises.

    They are bytes and not text, as ids may be cut within a character.
    """

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = vocabulary(path)
        for column in columns:
            yield pa.array(map(known.decode, as_bytes(column)), pa.binary())

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary")(ids)


def unpacked(ids: Column) -> Column:
    """Packed ids as an array of long; null as an empty one."""

    def run(column: pa.Array) -> pa.Array:
        parts = as_bytes(column)
        return pa.ListArray.from_arrays(np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int32), pa.array(np.frombuffer(b"".join(parts), "<u4").astype(np.int64)))

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<long>")(ids)


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", back: str = "decoded") -> DataFrame:
    """``docs`` with the packed ids of ``text`` and the bytes they decode to, in one pass through Python.

    Rows, their order within a partition and all columns stay, repeated rows and
    null ids included; a null text counts as empty; an empty table stays empty.
    Columns of the names ``ids`` and ``back`` are replaced; no other name matters.
    """

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = vocabulary(path)
        for column in columns:
            packed = [known.encode(x.decode("utf-8", "replace")) for x in as_bytes(column)]
            yield pa.StructArray.from_arrays([pa.array(packed, pa.binary()), pa.array(map(known.decode, packed), pa.binary())], ["ids", "decoded"])

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    (both,) = fresh(docs, "both")
    coded = docs.withColumn(both, F.arrow_udf(run, "ids binary, decoded binary")(F.col(text)))
    return coded.withColumns({ids: F.col(both)["ids"], back: F.col(both)["decoded"]}).drop(both)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of ids, and the SHA-256 of its ids and of the bytes they decode to.

    A row for each row of ``documents``, repeated ones too; a null text counts as
    empty, whose hashes are the empty string's.
    """
    docs = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), multilingual())
    return docs.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
