import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siltstone.llm import exact_dedup as E
from siltstone.llm import near_dedup as N

from . import cases


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("limit", [32 << 20, 400])
def test_exact_duplicates_match_grouping(spark, limit):
    data = cases.rows()
    found = E.exact_duplicates(cases.clashing(cases.table(spark)), bucket_bytes=limit).collect()
    groups = defaultdict(list)
    for key, text, *_ in data:
        groups[plain(text)].append(key)
    want = sorted(
        (str(k), str(min((x for x in g if x is not None), default=None)), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for k in g
    )
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in found) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in found if r.doc_id is not None)


def test_grace_spills_and_recurses():
    rows = [(k * 2654435761 % (1 << 62), f"text {k % 500}".encode(), k, 1) for k in range(500)] * 3
    found = {c: (first, n) for _, c, first, n in E.grace(rows, limit=1000)}
    assert found == {f"text {k}".encode(): (k, 3) for k in range(500)}


def test_drop_exact_keeps_columns_and_one_row(spark):
    docs = cases.clashing(cases.table(spark))
    kept = E.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(plain(r.text) for r in kept.collect()) == sorted({plain(t) for _, t, *_ in cases.rows()})


def brute(data, width, percent):
    sets = defaultdict(list)
    for key, text, *_ in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        s = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
        sets[key].append(s)
    up = {k: k for k in sets if k is not None}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a in up:
        for b in up:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {k: root(k) for k in up}, sets


@pytest.mark.parametrize(("width", "chunk"), [(2, 512), (2, 3), (5, 512)])
def test_near_components_match_brute_force(spark, monkeypatch, width, chunk):
    monkeypatch.setattr(N, "CHUNK", chunk)
    found = N.near_components(cases.clashing(cases.table(spark)), width, 80).collect()
    want, sets = brute(cases.rows(), width, 80)
    assert len(found) == len(cases.rows())
    for r in found:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
        assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
        assert r.kept == (None if r.doc_id is None else r.doc_id == r.component_id)


@pytest.mark.parametrize("by_band", [False, True])
def test_large_clusters_match_brute_force(spark, monkeypatch, by_band):
    """A template that all texts share, few true links: what is apart is settled by the cluster or by its bands."""
    rng = random.Random(3)
    template = cases.words(rng, 60)
    data = [(k, f"{template} {cases.words(rng, rng.choice((3, 20, 30)))}", "en", "s", 1) for k in range(160)]
    monkeypatch.setattr(N, "CHUNK", 10)
    if not by_band:  # with every group of bands twenty times, the cluster as a whole is cheaper
        whole = N._groups_apart
        monkeypatch.setattr(N, "_groups_apart", lambda members, bands: whole(members, bands.crossJoin(bands.sparkSession.range(20)).select("node", F.expr("transform(bands, band -> xxhash64(band, id))").alias("bands"))))
    found = N.near_components(cases.table(spark, data), 2, 80).collect()
    want, _ = brute(data, 2, 80)
    assert {r.doc_id: r.component_id for r in found} == want


def test_words_of_one_polynomial_hash_are_apart(spark):
    text = "a"
    while len(text) < 2048:
        text += text.translate({97: 98, 98: 97})
    other = text.translate({97: 98, 98: 97})
    found = N.near_components(cases.table(spark, [(1, text, "", "", 1), (2, other, "", "", 1)]), 2, 80).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 2}


def test_registers_and_estimate():
    import numpy as np

    from siltstone.llm.shingles import mixed

    x = mixed(np.arange(4000, dtype=np.uint64))
    a, b = np.unique(x[:3000]), np.unique(x[500:3500])
    guess, on = N.estimate(N.sketch(a)[0][None], N.sketch(b)[0][None])
    assert on[0] == N.BUCKETS and abs(guess[0] - 2500 / 3500) < 0.15
    assert N.register_values(np.array([1, 2, 3, (1 << 56) - 1], np.uint64)).tolist() == [(55 + 1) << 10, (54 + 1) << 10, (54 + 1) << 10 | 512, 1 << 10 | 1023]


def test_empty_tables(spark):
    docs = cases.table(spark, [])
    assert E.exact_duplicates(docs).count() == 0 and E.drop_exact_duplicates(docs).count() == 0
    assert N.near_components(docs).count() == 0 and N.drop_near_duplicates(docs).count() == 0


def test_drop_near_keeps_one_of_each(spark):
    docs = cases.clashing(E.drop_exact_duplicates(cases.table(spark)))
    kept = N.drop_near_duplicates(docs, 5, 80)
    assert kept.columns == docs.columns
    want, _ = brute([tuple(r)[:5] for r in docs.collect()], 5, 80)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))
