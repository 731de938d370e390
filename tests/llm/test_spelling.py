"""Spelling variants against brute force."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from siltstone.llm import spelling

from . import cases


def brute_counts(rows, every=199, least=6, often=5):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= least:
                found[word] += 1
    return {w: n for w, n in found.items() if n >= often}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts, ratio=5):
    forms, n_near = {}, {}
    for w, n in counts.items():
        around = [x for x in counts if near(w, x)]
        n_near[w] = len(around)
        best = min(around, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best and counts[best] >= ratio * n else None
    out = []
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, n_near[w], counts[forms[w]] if forms[w] else None))
    return sorted(out)


def variants(seed, words=60):
    """Texts of few words and their misspellings, some of them much commoner than others, and chains of forms."""
    rng = random.Random(seed)
    letters = "aabcé÷ÿ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(words)]
    for w in list(base):
        for _ in range(3):
            k = rng.randrange(len(w))
            base.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]]))
    chain = ["chainaa", "chainab", "chainbb", "chainbbb", "chaibbb", "haibbb"]
    texts = [" ".join([w.upper() if rng.random() < 0.2 else w] * rng.choice([1, 4, 5, 30, 200])) for w in base]
    texts += [" ".join([w] * 5 ** (k + 1)) for k, w in enumerate(chain)]
    texts += ["aaaaaa " * 7, "aaaaaaa " * 60, "x" * 5000 + " " + ("x" * 5001 + ".") * 5 + ("x" * 5000 + " ") * 30]
    rows = [(k, t, "en", "s0", 1) for k, t in enumerate(texts)]
    return rows + rows[:20] + [(None, texts[0], None, None, None), (None, None, None, None, None), (7, "", "en", "s1", 0), (8, "12 !? \n", "en", None, 3)]


def found(spark, rows, **options):
    return sorted((tuple(r) for r in spelling.spelling_variants(cases.clashing(cases.table(spark, rows)), **options).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = variants(seed)
    want = brute(brute_counts([r[:2] for r in rows], every=7))
    assert any(w[1] and w[1] != w[2] for w in want) and any(w[4] > 1 for w in want)
    assert found(spark, rows, every=7) == sorted(want, key=str)


def test_cases(spark):
    rows = cases.rows() * 3
    want = brute(brute_counts([r[:2] for r in rows], every=11))
    assert found(spark, rows, every=11) == sorted(want, key=str)


def test_nodes_reach_over_partitions(spark):
    words = sorted({"".join(random.Random(k).choice("ab") for _ in range(k % 9 + 1)) for k in range(400)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.word: r for r in spelling.trie_nodes(df.repartition(5), "t").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [got[w].number for w in words] == list(range(len(words)))
    nodes = {}
    for w in words:
        assert len(got[w].nodes) == len(w) + 1
        for k, node in enumerate(got[w].nodes):
            assert nodes.setdefault(w[:k], node) == node
    assert len(set(nodes.values())) == len(nodes)


def test_nothing(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, None, None, None), (2, "", None, None, None), (3, "short words only", "en", "s", 1)]) == []
