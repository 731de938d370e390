"""Word hashes and shingle sets of many texts at once, by numpy."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def eights(data: np.ndarray) -> np.ndarray:
    """At each place of ``data`` its next eight bytes as a number, zeros beyond the end."""
    held = np.zeros(len(data) + 8, np.uint8)
    held[: len(data)] = data
    return np.array(np.ndarray((len(data),), "<u8", held, 0, (1,)))


def stretch_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of ``data``.

    Its groups of eight bytes are mixed with their place in the stretch before
    they are summed, so no two contents are equal by construction.
    """
    groups = (lengths + 7) >> 3
    first = np.cumsum(groups) - groups
    place = np.arange(int(groups.sum())) - np.repeat(first, groups)
    at = np.repeat(starts, groups) + 8 * place
    held = np.zeros(len(data) + 8, np.uint8)
    held[: len(data)] = data
    values = held[at[:, None] + np.arange(8)].view("<u8").ravel() if len(at) else np.zeros(0, np.uint64)
    beyond = (64 - 8 * np.minimum(np.repeat(lengths, groups) - 8 * place, 8)).astype(np.uint64)
    with np.errstate(over="ignore"):
        values = (values << beyond) >> beyond
        parts = mixed(values ^ mixed(place.astype(np.uint64) + np.uint64(1)))
        sums = np.r_[np.uint64(0), np.cumsum(parts, dtype=np.uint64)]
        return mixed(sums[first + groups] - sums[first] + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the texts, A-Z as a-z, and where each text's words begin (one more at the end).

    Words are the runs that are not white space.
    """
    joined = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
    space = _SPACE[joined]
    edge = np.flatnonzero(np.diff(np.r_[True, space, True].view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    return stretch_hashes(joined, starts, ends - starts), np.searchsorted(starts, begin)


def shingle_sets(texts: list[bytes], width: int = 2) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``width`` words.

    With fewer words the whole sequence is one shingle; without words the set
    is empty.
    """
    words, at = word_hashes(texts)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            rolled = mixed(rolled + np.uint64(k + 1)) + words[k : k + len(rolled)]
        rolled = mixed(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for w in words[a:b]:
                h = mixed(np.array([h ^ w]))[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
