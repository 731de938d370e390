"""The trie of conversations against one built turn by turn."""

import hashlib
import random
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from siltstone.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_trie(paths):
    """``paths``: conversation id to its turns (role, text)."""
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        saved = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(sums[x][1] for x in below)
        sums[node] = (sum(sums[x][0] for x in below) or 1, saved)
    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(paths[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(own), len(node), parent, len(own), len(children.get(node, [])), *sums[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def own_paths(rows):
    paths = {}
    for c, turn, role, text in rows:
        if c is not None:
            paths.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in paths.items()}


def rebuilt_paths(rows):
    own = own_paths(rows)
    out = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def some_rows(seed, n=150):
    rng = random.Random(seed)
    ids = rng.sample(range(-150, 600), n) + [2**62]
    rows = []
    for c in ids:
        length = rng.choice([1, 1, 2, 3, 4, 5, 7])
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["yes", "no", "ümläut", "", None])) for t in range(length)]
    rows += [(c, None, "system", "first") for c in ids[:20]] + [(ids[3], 1, "user", "yes")] * 3 + [(None, 1, "user", "nobody"), (None, None, None, None)]
    # Long ones that agree for more than a block, one within a block of another's end, and a copy.
    long = [(t, "user", f"turn {t}") for t in range(300)]
    for c, upto in ((700, 300), (701, 300), (702, 190), (703, 64), (704, 128), (705, 65)):
        rows += [(c, *turn) for turn in long[:upto]]
    rows += [(706, t, "user", f"turn {t}" if t != 130 else "else") for t in range(200)]
    rng.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("x").alias(c) for c in ("a", "b", "depth", "shard", "part", "n", "h1", "block", "place"))).repartition(4)


def found(df):
    return sorted(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()))


@pytest.fixture(params=[8192, 16])
def shard(request, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD", request.param)


@pytest.mark.parametrize("seed", [1, 2])
def test_rebuilt_against_brute_force(spark, shard, seed):
    rows = some_rows(seed)
    assert found(prefix_trie.trie(prefix_trie.rebuilt_turns(table(spark, rows)))) == brute_trie(rebuilt_paths(rows))


def test_own_against_brute_force(spark, shard):
    rows = some_rows(3)
    assert found(prefix_trie.trie(prefix_trie.own_turns(table(spark, rows)))) == brute_trie(own_paths(rows))


def test_one_conversation_over_all_parts(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD", 64)
    rows = [(5, t, "user", str(t % 7)) for t in range(3000)] + [(6, t, "user", str(t % 7)) for t in range(2500)] + [(c, 0, "user", "0") for c in range(10, 40)]
    assert found(prefix_trie.trie(prefix_trie.own_turns(table(spark, rows)))) == brute_trie(own_paths(rows))


def test_ties_and_nulls(spark):
    rows = [(1, 1, "b", "x"), (1, 1, "a", "y"), (1, None, None, None), (1, 1, "a", "x"), (2, None, "", ""), (2, 0, "a", "x"), (2, 0, "a", "y"), (2, 7, "b", "x")]
    assert found(prefix_trie.trie(prefix_trie.own_turns(table(spark, rows)))) == brute_trie(own_paths(rows))


def test_nothing(spark):
    for rows in ([], [(None, 1, "user", "x")]):
        assert found(prefix_trie.trie(prefix_trie.rebuilt_turns(table(spark, rows)))) == []
