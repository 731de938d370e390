"""Removal of byte strings that occur elsewhere in the corpus.

A byte goes if a string of ``length`` bytes that covers it starts anywhere
else too. Documents are cut into blocks; what the blocks exchange are packed
counts of hashes (see ``blocks``), in two rounds.

Round one: anchors. Of the places in a window where a short gram fits, the
anchor is the one whose first bytes have the least hash. It is chosen by
content alone: equal windows have equal anchors. A window whose anchor gram
occurs once in the corpus can't repeat. Also counted are stretches, from one
anchor to a window's length past the next, and from and to a document's ends:
where a stretch repeats, so does each window within it.

Round two: the windows that this leaves open, mostly at the ends of repeats,
are counted themselves.

A block's documents are worked on together, in pieces that stay in the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import REQUESTS, answers, blocks, by_block, joined_texts, packed_texts, parts_for, planes, request_batches, requests, totals, unplaned
from .common import table, written
from .shingles import eights, mixed

GRAM_SHARE = 5  # a gram is a fifth of a window
_PIECE = 1 << 15  # window starts worked on at once
_ODD = mixed(np.arange(1, 1025, dtype=np.uint64)) | np.uint64(1)


def _sections(lengths: np.ndarray) -> np.ndarray:
    """0 up to each of the lengths, one after the other."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _hashes_at(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` bytes at each start.

    They are taken as groups of eight bytes, the last one reaching back where
    the width is no multiple; each is mixed before they are summed with odd
    factors, so no contents are equal by construction.
    """
    rows, edge, parts = np.lib.stride_tricks.sliding_window_view(data, width) if len(starts) else data, width - width % 8, -(-width // 8)
    factors, places = _ODD[np.arange(parts) % len(_ODD)], np.arange(parts, dtype=np.uint64)
    out, step = np.empty(len(starts), np.uint64), max(1, _PIECE // parts)
    for low in range(0, len(starts), step):
        held = rows[starts[low : low + step]]
        if width < 8:
            held = np.pad(held, ((0, 0), (0, 8 - width)))
        elif edge < width:
            held = np.concatenate([held[:, :edge], held[:, -8:]], axis=1)
        groups = mixed(np.ascontiguousarray(held).view("<u8"))
        groups *= factors
        groups += places
        out[low : low + step] = mixed(groups.sum(axis=1, dtype=np.uint64))
    return out


def _hashes_along(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` bytes of ``data``: of groups of eight bytes, mixed, then of twice as many as long as they fit, the last one of two that overlap."""
    n, out, step = len(data) - width + 1, [], max(_PIECE, width)
    for low in range(0, n, step):
        piece = data[low : low + step + width - 1]
        groups, has = eights(piece)[: len(piece) - min(width, 8) + 1], 8
        if width < 8:
            groups <<= np.uint64(64 - 8 * width)
        h, k = mixed(groups), 0
        with np.errstate(over="ignore"):
            while has < width:
                ahead = min(has, width - has)
                x = h[:-ahead] * _ODD[k]
                x ^= h[ahead:]
                x ^= x >> np.uint64(32)
                h, has, k = x, has + ahead, k + 1
        out.append(h)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: the first window's start and the anchor, which is the first of several with one hash."""
    n, width = len(data) - length + 1, length - gram + 1
    starts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(_PIECE, length)
    places = np.arange(step + width, dtype=np.uint64)
    place = np.uint64((1 << len(places).bit_length()) - 1)
    for low in range(0, n, step):
        many = min(step, n - low)
        least = eights(data[low : low + many + length - 1])[: many + width - 1]
        if gram < 8:
            least <<= np.uint64(64 - 8 * gram)
        with np.errstate(over="ignore"):
            least ^= least >> np.uint64(31)
            least *= _ODD[0]
            least ^= least >> np.uint64(32)
            least *= _ODD[1]
        least &= ~place
        least |= places[: len(least)]
        has = 1
        while has < width:
            ahead = min(has, width - has)
            least, has = np.minimum(least[:-ahead], least[ahead:]), has + ahead
        at = (least & place).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        starts.append(first + low)
        found.append(at[first] + low)
    start, anchor = np.concatenate(starts), np.concatenate(found)
    new = np.r_[True, anchor[1:] != anchor[:-1]][: len(anchor)]
    return start[new], anchor[new]


class Anchored:
    """The anchors and stretches of a block, whose documents of the given ``sizes`` lie end to end in ``data``."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, length: int) -> None:
        gram = max(1, length // GRAM_SHARE)
        ends = np.cumsum(sizes, dtype=np.int64)
        whole = sizes >= length
        begin, last = (ends - sizes)[whole], ends[whole] - length
        runs, anchors = _anchors(data, length, gram)
        first = np.unique(np.concatenate([runs, begin, last + 1]))
        doc = np.searchsorted(begin, first, "right") - 1
        inside = (doc >= 0) & (first <= last[doc]) if len(begin) else np.zeros(len(first), bool)
        self.start, doc, self.beyond = first[inside], doc[inside], last + 1
        at = anchors[np.searchsorted(runs, self.start, "right") - 1]
        self.grams = _hashes_at(data, at, gram)

        fit = at <= last[doc]
        every = np.arange(len(begin))
        owner, points = np.concatenate([every, doc[fit], every]), np.concatenate([begin, at[fit], last])
        order = np.lexsort((points, owner))
        owner, points = owner[order], points[order]
        head = np.r_[True, owner[1:] != owner[:-1]][: len(owner)]
        hashes = _hashes_at(data, points, length)
        low, high, head = np.arange(len(points) - 1), np.arange(1, len(points)), head[:-1]
        begins = points[low] + 1 - head
        some = (owner[low] == owner[high]) & (begins <= points[high])
        low, high, head, self.decided = low[some], high[some], head[some], begins[some]
        with np.errstate(over="ignore"):
            gap = (points[high] - points[low]).astype(np.uint64) * np.uint64(2) + head
            self.stretches = mixed(mixed(hashes[low] + gap) * _ODD[0] + hashes[high])

    def keys(self) -> np.ndarray:
        return np.concatenate([self.grams, self.stretches])

    def sorted_out(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of runs of window starts, by the counts of ``keys``: first, end, whether they are known to repeat, whether they are to be counted.

        A known window need not be counted only where every occurrence of its
        anchor lies in the same stretch, as then it is known at each of them.
        A stretch from a document's begin counts by itself, as it alone
        decides its first window.
        """
        first = np.unique(np.concatenate([self.start, self.decided]))
        anchored = counts[: len(self.grams)][np.searchsorted(self.start, first, "right") - 1]
        often = counts[len(self.grams) :][np.searchsorted(self.decided, first, "right") - 1]
        edge = np.searchsorted(self.beyond, first, "right")
        end = np.minimum(np.append(first[1:], self.beyond[-1:]), self.beyond[edge])
        return first, end, often > 1, (anchored > 1) & (often != anchored)


def _anchored(sizes: list[int], text: bytes, length: int) -> Anchored:
    return Anchored(np.frombuffer(text, np.uint8), np.array(sizes, np.int64), length)


def _covered(first: np.ndarray, end: np.ndarray, begins: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal runs of bytes within a document that windows from ``first`` up to ``end`` cover: their documents, starts and ends."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], end[order] - 1 + length
    doc = np.searchsorted(begins, first, "right") - 1
    new = np.r_[True, (doc[1:] != doc[:-1]) | (first[1:] > np.maximum.accumulate(end)[:-1])][: len(first)]
    heads = np.flatnonzero(new)
    return doc[heads], first[heads], np.maximum.reduceat(end, heads) if len(heads) else end


def _each(sizes: list[int], text: bytes, runs: tuple[np.ndarray, np.ndarray], length: int) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """Each document's bytes and its spans, from the block's repeated windows."""
    ends = np.cumsum(sizes, dtype=np.int64)
    doc, low, high = _covered(*runs, ends - np.array(sizes, np.int64), length)
    at = np.searchsorted(doc, np.arange(len(sizes) + 1)).tolist()
    low, high = low.tolist(), high.tolist()
    for k, (size, end) in enumerate(zip(sizes, ends.tolist(), strict=True)):
        begin, spans = end - size, range(at[k], at[k + 1])
        yield text[begin:end], [(low[i] - begin, high[i] - begin) for i in spans]


RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
OPEN = "block long, n_open long, doc_ids array<long>, sizes array<long>, runs array<binary>, texts binary"


def _results(rows: list[tuple], with_text: bool) -> dict[str, pa.Array]:
    """Of (doc_id, text, spans): the columns of RESULT."""
    out: dict[str, list] = {c.split()[0]: [] for c in ("doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept")}
    for key, text, spans in rows:
        kept = _without(text, spans)
        values = (key, len(text), len(text) - len(kept), [{"start": a, "end": b} for a, b in spans], hashlib.sha256(kept).hexdigest(), kept if with_text else None)
        for c, v in zip(out, values, strict=True):
            out[c].append(v)
    kinds = (pa.int64(), pa.int64(), pa.int64(), _SPANS, pa.string(), pa.binary())
    return {c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds, strict=True)}


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    if not spans:
        return text
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def _packed_run(ascending: np.ndarray) -> bytes:
    return planes(np.diff(ascending, prepend=0).astype("<i8")) if len(ascending) else b""


def _run(packed: bytes) -> np.ndarray:
    return np.cumsum(unplaned(packed, "<i8")) if packed else np.zeros(0, np.int64)


def _opened(ids: list, sizes: list[int], text: bytes, found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, list]:
    """Which documents have open windows; those as one row: number of windows, ids, sizes, runs (known and open, as first and end in the joined texts), texts."""
    first, end, known, unsure = found
    ends = np.cumsum(sizes, dtype=np.int64)
    begins, owner = ends - np.array(sizes, np.int64), np.searchsorted(ends, first, "right")
    some = np.zeros(len(sizes), bool)
    some[owner[unsure]] = True
    moved = np.cumsum(np.where(some, sizes, 0)) - ends
    runs = [x[which] + moved[owner[which]] for which in (known & some[owner], unsure) for x in (first, end)]
    picked = np.flatnonzero(some).tolist()
    texts = packed_texts([text[begins[k] : ends[k]] for k in picked])
    return some, [int((runs[3] - runs[2]).sum()), [ids[k] for k in picked], [sizes[k] for k in picked], [_packed_run(x) for x in runs], texts]


def _open_windows(runs: list[bytes], text: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The open windows of a block, and their hashes."""
    first, end = (_run(x) for x in runs[2:])
    new = np.r_[True, first[1:] > end[:-1]][: len(first)]
    low, high = first[new], end[np.r_[new[1:], True][: len(end)]]
    cut = np.frombuffer(b"".join(text[a : b + length - 1] for a, b in zip(low.tolist(), high.tolist(), strict=True)), np.uint8)
    many = high - low
    places = _sections(many)
    at = np.cumsum(many + length - 1) - (many + length - 1)
    return places + np.repeat(low, many), _hashes_along(cut, length)[places + np.repeat(at, many)]


def repeated_spans(docs: DataFrame, length: int = 200, with_text: bool = True, part_keys: int = 1_500_000) -> DataFrame:
    """For each row of ``docs``: doc_id, n_bytes, n_removed, spans (start, end: the bytes that repeat), kept_sha256 and kept (the other bytes; null unless ``with_text``).

    Texts are UTF-8 bytes, null as empty; strings never cross documents and
    are judged on the input. A string that repeats within one text, even
    overlapping itself, repeats. Repeated rows repeat each other. Other
    columns are not looked at; an empty table gives an empty result. Strings
    are compared by 64-bit hashes of their whole content.
    """
    cut = blocks(docs)
    parts, _ = parts_for(cut, 0.035, part_keys)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for number, sizes, packed in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    yield from requests(number, *np.unique(_anchored(sizes, joined_texts(sizes, packed), length).keys(), return_counts=True), parts)

        return request_batches(rows())

    def sift(block: pa.Table, answered: pa.Table) -> pa.Table:
        """Documents without open windows are done; a block's others are one row."""
        done, opened, counts = [], [], answers(answered)
        for k in range(block.num_rows):
            ids, sizes, packed = (block[c][k].as_py() for c in ("doc_ids", "sizes", "texts"))
            text = joined_texts(sizes, packed)
            anchored = _anchored(sizes, text, length)
            keys, where = np.unique(anchored.keys(), return_inverse=True)
            if len(keys) != len(counts):
                raise ValueError("a block's keys and their counts don't match")
            first, end, known, unsure = found = anchored.sorted_out(counts[where])
            some, row = _opened(ids, sizes, text, found)
            for key, left, (one, spans) in zip(ids, some.tolist(), _each(sizes, text, (first[known], end[known]), length), strict=True):
                if not left:
                    done.append((key, one, spans))
            if some.any():
                opened.append([block["block"][k].as_py(), *row])
        columns = {c: pa.concat_arrays([x, pa.nulls(len(opened), x.type)]) for c, x in _results(done, with_text).items()}
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary())
        for k, (c, kind) in enumerate(zip(("block", "n_open", "doc_ids", "sizes", "runs", "texts"), kinds, strict=True)):
            columns[c] = pa.array([None] * len(done) + [row[k] for row in opened], kind)
        return pa.table(columns)

    first = totals(cut.select("block", "sizes", "texts").mapInArrow(ask, REQUESTS), parts)
    half = written(by_block(cut, first, sift, f"{RESULT}, {OPEN}"), "repeats-half")
    opened = half.where("block is not null").select("block", "doc_ids", "sizes", "runs", "texts")
    left = half.agg(F.sum("n_open")).first()[0] or 0
    more = int(left / part_keys) + 1

    def ask_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for number, sizes, runs, packed in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    yield from requests(number, *np.unique(_open_windows(runs, joined_texts(sizes, packed), length)[1], return_counts=True), more)

        return request_batches(rows())

    def settle(block: pa.Table, answered: pa.Table) -> pa.Table:
        rows, counts = [], answers(answered)
        for k in range(block.num_rows):
            ids, sizes, runs, packed = (block[c][k].as_py() for c in ("doc_ids", "sizes", "runs", "texts"))
            text = joined_texts(sizes, packed)
            starts, hashes = _open_windows(runs, text, length)
            hit = starts[counts[np.unique(hashes, return_inverse=True)[1]] > 1]
            first, end = (_run(x) for x in runs[:2])
            spans = _each(sizes, text, (np.r_[first, hit], np.r_[end, hit + 1]), length)
            rows += [(key, *found) for key, found in zip(ids, spans, strict=True)]
        return pa.table(_results(rows, with_text))

    second = totals(opened.select("block", "sizes", "runs", "texts").mapInArrow(ask_again, REQUESTS), more)
    settled = by_block(opened, second, settle, RESULT)
    return half.where("block is null").select(*settled.columns).union(settled)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repeated_spans`` of all documents, for strings of 200 bytes: what is removed and the hash of what is kept; nulls, repeated rows and the empty table as there."""
    return repeated_spans(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
