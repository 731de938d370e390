import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siltstone.llm import mixing as M
from siltstone.llm import packing as P
from siltstone.llm import sharding as S

from . import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets_fill_to_one_level():
    assert M.targets([100, 100, 100], [5, 2, 1], 1.5, 2.0) == pytest.approx([200, 500 / 3, 250 / 3])
    assert M.targets([0, 10], [5, 2], 1.5, 2.0) == pytest.approx([0, 15])
    assert M.targets([], [], 1.5, 2.0) == []


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000])
def test_permutation_and_its_inverse(n):
    p = M.permuted(np.arange(n), n, 42)
    assert sorted(p.tolist()) == list(range(n))
    assert M.permuted(p, n, 42, back=True).tolist() == list(range(n))


def test_mix_meets_targets_and_reruns(spark):
    docs = cases.clashing(cases.table(spark))
    settings = {"block": 16, "shard_blocks": 64}
    found = M.mix(docs, **settings).taken().collect()
    again = M.mix(docs.repartition(5), **settings).taken().collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    data = cases.rows()
    assert sorted((str(r.doc_id), r.size) for r in found) == sorted((str(k), len(WORD.findall(t or ""))) for k, t, *_ in data)
    totals, taken = defaultdict(int), defaultdict(int)
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        totals[r.source_size, r.target] += r.size
        taken[r.source_size, r.target] += r.taken
    for (size, target), words in taken.items():
        assert totals[size, target] == size and words == round(target)
    assert sum(taken.values()) == pytest.approx(1.5 * sum(totals.values()), abs=len(totals))


def test_mixed_documents_hold_the_taken_words(spark):
    docs = cases.clashing(cases.table(spark))
    found = M.mixed_documents(docs, block=16, shard_blocks=64)
    assert found.columns == docs.columns
    taken, words, texts = defaultdict(int), defaultdict(int), defaultdict(set)
    for r in M.mix(docs, block=16, shard_blocks=64).taken().collect():
        taken[r.doc_id] += r.taken
    for k, t, *_ in cases.rows():
        texts[k].add(t)
    for r in found.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert words == {k: n for k, n in taken.items() if n}


def test_stretch_cuts_at_words():
    spans = lambda *s: [{"from_word": a, "to_word": b} for a, b in s]
    assert M.stretch(b" a  b\nc d ", spans((0, 4))) == b" a  b\nc d "
    assert M.stretch(b" a  b\nc d ", spans((1, 3))) == b"b\nc"
    assert M.stretch(b"a b c d", spans((0, 1), (2, 4))) == b"a c d"


def test_packing_round_trip(spark):
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    data = [*cases.rows(), (90, "hello <|endoftext|> x", "en", "s0", 21), (91, "<|endoftext|><|endoftext|>", "en", "s0", 26)]
    assert coder.encode(data[-2][1], add_special_tokens=False).ids == [31373, 220, 50256, 2124]
    want = defaultdict(int)
    for k, t, *_ in data:
        ids = coder.encode(t or "", add_special_tokens=False).ids + [0]
        want[k, tuple(ids)] += 1
    rows = P.pack(cases.clashing(cases.table(spark, data)), window=64, shard_tokens=3000, with_ids=True).collect()
    sequences, docs = defaultdict(list), defaultdict(lambda: defaultdict(list))
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id][r.doc_tokens].append((r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()))
    for parts in sequences.values():
        parts.sort()
        ends = np.cumsum([n for _, n in parts])
        assert [a for a, _ in parts] == [0, *ends[:-1].tolist()]
        assert ends[-1] <= 64 and ends[-1] & (ends[-1] - 1) == 0
    for (k, ids), n in want.items():
        got = sorted(docs[k][len(ids)])
        assert sum(len(x) for _, x in got) == n * len(ids) or sum(1 for (kk, i) in want if kk == k and len(i) == len(ids)) > 1
        assert all(tuple(x) == ids[s : s + len(x)] for s, x in got) or n == 1
    assert sum(r.length for r in rows) == sum(len(ids) * n for (_, ids), n in want.items())


def test_ids_of_any_text():
    """Texts on their own, and as a batch whose words are encoded once, get the library's ids."""
    coder, own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), P.tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(8)
    signs = ["a", "Z", "é", "ß", "ÿ", "ª", "µ", "²", "¼", "×", "'", "'s", "'ll", "'Ll", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "0", "12", "_", "-", "<|endoftext|>", "漢", "😀", "ſ", "don't", "...", " ,"]
    for k in range(3000):
        text = "".join(rng.choice(signs[:27] if k % 2 else signs) for _ in range(rng.randint(0, 14)))
        assert own.ids(text).tolist() == coder.encode(text, add_special_tokens=False).ids, text
    texts = ["", " ", "one", " one", "one two  three", "one two", "two one\n", "two\n one\n two", "!! ?", "one <|endoftext|> two", "x" * 3000 + " y"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    for some in ([], [""], ["one"], texts):
        ids, least = own.of_batch(some)
        assert [x.tolist() for x in ids] == [coder.encode(text, add_special_tokens=False).ids for text in some]
        assert least == [min([*own.terms(x).tolist(), P._NO_TERM]) for x in ids]


def test_terms_are_words():
    own = P.tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    at = lambda text: own.terms(own.ids(text)).tolist()
    assert at("") == at(" \n , . ") == [] and len(at("Überwältigend, unimaginably 42!")) == 3
    assert at("word word, (word)\nword") == at("word") * 4 and at("word") != at("sword")


def test_neighbours_share_terms():
    docs = [np.array(x, np.uint32) for x in ([1, 2, 3], [9, 8], [1, 2, 5], [9, 6])]
    index = P.Index(docs, [4, 3, 4, 3])
    assert list(index.neighbours(0, np.array([False, True, True, True]))) == [2]
    assert P.arranged(docs, [4, 3, 4, 3], 9)[:2] == [0, 2]
    assert P.cuts(2 * 64 + 21, 64) == [0, 64, 128, 144, 148]


def test_packing_scores_all_shared_terms():
    common, rare = list(range(1, 60)), list(range(1000, 1030))
    docs = [[*common, *rare], *([x, 2000 + x] for x in rare), *([*common, 3000 + k] for k in range(3))]
    assert P.arranged([np.array(d, np.uint32) for d in docs], [len(d) + 1 for d in docs], 1024)[1] in {31, 32, 33}


@pytest.mark.parametrize("dense", [0, 150 * 7, 16 << 20])
def test_packing_order_matches_brute_force(monkeypatch, dense):
    """Whether the postings are lists or rows of weights."""
    monkeypatch.setattr(P.Index.__init__, "__defaults__", (1.2, 0.75, dense))
    rng = np.random.default_rng(4)
    docs = [(rng.zipf(1.5, rng.integers(0, 60)) % 400 + 1).astype(np.uint32) for _ in range(150)]
    sizes = [len(d) + int(rng.integers(1, 9)) for d in docs]
    df = defaultdict(int)
    for d in docs:
        for x in set(d.tolist()):
            df[x] += 1
    mean = sum(sizes) / len(docs)

    def score(a, b):
        shared = set(docs[a].tolist()) & set(docs[b].tolist())
        parts = [(np.log1p((150 - df[x] + 0.5) / (df[x] + 0.5)), docs[b].tolist().count(x)) for x in shared]
        return round(sum(i * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * sizes[b] / mean)) for i, n in parts), 9)

    want, unused, filled, seed = [], set(range(150)), 0, None
    while unused:
        if seed is None:
            seed = min(unused)
            unused.remove(seed)
            want.append(seed)
            filled += sizes[seed]
        end, cut = -(-filled // 64) * 64, None
        ranked = sorted((-score(seed, b), b) for b in unused) if filled < end else []
        for s, b in ranked:
            if s == 0:
                break
            unused.remove(b)
            want.append(b)
            filled += sizes[b]
            if filled >= end:
                cut = b if filled > end else None
                break
        seed = cut
    assert P.arranged(docs, sizes, 64) == want


def test_empty_tables(spark):
    docs = cases.table(spark, [])
    assert M.mix(docs).taken().count() == 0 and M.mixed_documents(docs).count() == 0
    assert P.pack(docs).count() == 0 and S.shard(docs).count() == 0


def test_sharding_is_even_and_gapless(spark):
    data = cases.rows() + [(1000 + k, "copy", "en", "s0", 4) for k in range(400)]
    found = S.shard(cases.clashing(cases.table(spark, data)), shards=6).collect()
    assert len(found) == len(data)
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((str(r.doc_id), r.size) for r in found) == sorted((str(k), size(t)) for k, t, *_ in data)
    shards = defaultdict(list)
    for r in found:
        shards[r.shard].append((r.slot, r.size))
    total, largest = sum(size(t) for _, t, *_ in data), max(size(t) for _, t, *_ in data)
    for parts in shards.values():
        assert sorted(s for s, _ in parts) == list(range(len(parts)))
        assert abs(sum(n for _, n in parts) - total / 6) <= largest + 8
