import base64
import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import blocks as B
from siltstone.llm import lm_scoring as L
from siltstone.llm import neighbours as K
from siltstone.llm import repeats as R
from siltstone.llm import secrets as X
from siltstone.llm import toxicity as T
from siltstone.llm.registry import QUERIES
from siltstone.llm.shingles import mixed, word_hashes

from . import cases


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    head = bytes([n]) if n < 128 else bytes([0x80 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + head + body


KEY = der(0x30, der(0x02, b"\0"), der(0x30, der(0x06, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01"), der(0x05)), der(0x04, der(0x30, der(0x02, bytes(range(1, 100))))))


def b64url(x):
    return base64.urlsafe_b64encode(x).rstrip(b"=").decode()


def test_secrets_need_structure():
    token = ".".join([b64url(json.dumps({"alg": "HS256"}).encode()), b64url(b'{"sub":"1"}'), b64url(b"x" * 20)])
    good = base64.b64encode(KEY).decode()
    assert X.is_key_structure(KEY) and not X.is_key_structure(KEY[:-1]) and not X.is_key_structure(KEY[:5] + b"\xff" + KEY[6:])
    kinds = lambda text: [s[0] for s in X.confirmed_spans(text)]
    assert kinds(f"see {token} now") == ["token"]
    assert kinds(f"see {good} now") == ["key64"] and kinds("see " + good[4:] + " now") == []
    assert kinds("x " + KEY.hex() + " y") == ["key16"]
    assert "pem" in kinds(f"-----BEGIN PRIVATE KEY-----\n{good}\n-----END PRIVATE KEY-----")
    assert kinds("a" * 200) == []


def test_base_secrets(spark):
    texts = ["Password: short TOKEN='abcdefghijkl' é api_key=abcdefghijklm", "password: token: abcdefghijklmnop", "AKIA0123456789ABCD AKIA012", "ff" * 8 + " " + "0" * 15, None, "paſſword=abcdefghijklmnop"]
    data = [(k, t, None, None, None) for k, t in enumerate(texts)]
    found = {r.doc_id: r for r in X.secret_spans(cases.clashing(cases.table(spark, data))).collect()}
    assert [found[k].n_assign for k in range(6)] == [2, 0, 0, 0, 0, 0]
    assert [found[k].n_access for k in range(6)] == [0, 0, 1, 0, 0, 0]
    assert [found[k].n_hex for k in range(6)] == [0, 0, 0, 1, 0, 0]
    assert found[2].spans == "access:0:18" and found[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert found[0].spans == "assign:16:35,assign:39:60"


def test_word_hashes_tell_words_apart():
    texts = [b"The the  x", b"", b" x\ty", b"abc"]
    words, at = word_hashes(texts)
    assert at.tolist() == [0, 3, 3, 5, 6]
    assert words[0] == words[1] and words[2] == words[3] and len(set(words.tolist())) == 4


def test_packed_numbers_come_back():
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (B.unplaned(B.planes(x), "<u8") == x).all()
    parts = list(B.requests(3, x, np.ones(1000, np.int64), 7))
    assert [p[0] for p in parts] == sorted({p[0] for p in parts}) and len(B.unplaned(parts[0][3], "<u4")) > 0


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_scores_match_brute_force(spark, order):
    data = cases.rows()
    grams, own = Counter(), []
    for _, t, *_ in data:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        c = Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
        grams += c
        own.append((w, c))
    every = sum(n for g, n in grams.items() if len(g) == 1)
    want = []
    for (key, *_), (w, c) in zip(data, own, strict=True):
        total = 0.0
        for i in range(len(w)):
            factor = 1.0
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                seen = grams[g] - c[g]
                if n == 1:
                    total += math.log(factor * (seen / (every - len(w)) if seen else 1 / (every - len(w) + 1)))
                elif seen:
                    total += math.log(factor * seen / (grams[g[:-1]] - c[g[:-1]]))
                    break
                else:
                    factor *= 0.4
        want.append((str(key), len(w), round(total / len(w), 9) if w else None))
    found = L.score_documents(cases.clashing(cases.table(spark)), order, part_keys=500).collect()
    got = sorted(((str(r.doc_id), r.n_words, r.score if r.score is None else round(r.score, 9)) for r in found), key=str)
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want, key=str)]
    assert [g[2] for g in got] == [pytest.approx(w[2], abs=1e-8) if w[2] is not None else None for w in sorted(want, key=str)]


def test_registered_trigrams_count(spark, tmp_path):
    cases.table(spark, [(k, t, "en", "s", 1) for k, t in enumerate(["a b c", "a b c", "x b", "x b c"])]).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r.score for r in QUERIES["op5_lm_scoring_trigrams"](spark, str(tmp_path)).collect()}
    first, second, third = 1 / 8, 1 / 1, 1 / 1
    assert found[0] == pytest.approx(math.log(first * second * third) / 3, abs=1e-6)
    bigram = {r.doc_id: r.score for r in QUERIES["op5_lm_scoring"](spark, str(tmp_path)).collect()}
    assert bigram[0] == pytest.approx(math.log(first * second * 2 / 3) / 3, abs=1e-6)


@pytest.mark.parametrize("length", [20, 200])
def test_repeats_match_brute_force(spark, length):
    data = cases.rows() + [(200, "ab" * 300, None, None, None), (201, "xyz" * 90, None, None, None), (202, "abc" * 80 + "q" * 230, None, None, None)]
    data = [r for r in data if len(r[1] or "") < 50_000]
    count = Counter()
    for _, t, *_ in data:
        b = (t or "").encode()
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    want = []
    for key, t, *_ in data:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        want.append((str(key), len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    found = R.repeated_spans(cases.clashing(cases.table(spark, data)), length, part_keys=300).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in found) == sorted(want)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in found)


@pytest.mark.parametrize("length", [1, 3, 8, 9, 30, 41, 200])
def test_repeats_in_two_rounds_without_spark(length):
    """Blocks of tiny alphabets, copies, shared ends, periods and texts of just a window: what is known and what is counted give all windows that repeat."""
    rng = np.random.default_rng(length)
    for trial in range(12):
        pool = bytes(rng.integers(0, (2, 3, 90)[trial % 3], 9 * length, np.uint8) + 32)
        texts = [b"", pool[:length], pool[: length - 1], pool, pool, b"ab" * length, b"c" * (2 * length)]
        for _ in range(30):
            a, b = sorted(rng.integers(0, len(pool), 2).tolist())
            own = [bytes(rng.integers(32, 122, int(n), np.uint8)) for n in rng.integers(0, 2 * length, 2)]
            texts += [own[0] + pool[a:b] + own[1], pool[a:b], pool[:b]]
        order = rng.permutation(len(texts)).tolist()
        texts = [texts[k] for k in order]
        blocks = [(list(range(a, b)), [len(t) for t in texts[a:b]], b"".join(texts[a:b])) for a, b in ((0, 40), (40, len(texts)))]
        found = [R._anchored(sizes, text, length) for _, sizes, text in blocks]
        total, answer = Counter(np.concatenate([x.keys() for x in found]).tolist()), {}
        opened = []
        for (ids, sizes, text), x in zip(blocks, found, strict=True):
            first, end, known, unsure = out = x.sorted_out(np.array([total[k] for k in x.keys().tolist()], np.uint64))
            answer |= {k: s for k, (_, s) in zip(ids, R._each(sizes, text, (first[known], end[known]), length), strict=True)}
            opened.append(R._opened(ids, sizes, text, out)[1])
        left = [R._open_windows(o[3], B.joined_texts(o[2], o[4]), length) for o in opened]
        total = Counter(np.concatenate([h for _, h in left]).tolist())
        for o, (starts, hashes) in zip(opened, left, strict=True):
            first, end = (R._run(x) for x in o[3][:2])
            hit = starts[[total[h] > 1 for h in hashes.tolist()]] if len(starts) else starts
            answer |= {k: s for k, (_, s) in zip(o[1], R._each(o[2], B.joined_texts(o[2], o[4]), (np.r_[first, hit], np.r_[end, hit + 1]), length), strict=True)}
        count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        for k, t in enumerate(texts):
            gone = bytearray(len(t))
            for i in range(len(t) - length + 1):
                if count[t[i : i + length]] > 1:
                    gone[i : i + length] = b"\1" * length
            assert answer[k] == [m.span() for m in re.finditer(b"\1+", bytes(gone))]


def test_whole_copies_need_no_second_round(spark, monkeypatch):
    import random

    rng, kept = random.Random(8), {}
    texts = [cases.words(rng, 120) for _ in range(20)]
    write = R.written
    monkeypatch.setattr(R, "written", lambda df, name: kept.setdefault(name, write(df, name)))
    found = R.repeated_spans(cases.table(spark, [(k, texts[k % 20], None, None, None) for k in range(50)])).collect()
    assert len(found) == 50 and all(r.n_removed == r.n_bytes > 200 for r in found)
    assert not kept["repeats-half"].agg(F.sum("n_open")).first()[0]


def test_cost_of_anchors_in_a_block_of_small_documents():
    """In CPU time, as a multiple of one mixing of as many numbers as there are bytes: measured 0.9 to 1.5, and 10 to 13 when each document was hashed on its own."""
    import random
    import time

    rng = random.Random(9)
    texts = [cases.words(rng, 400).encode() for _ in range(1500)]
    sizes, text = [len(t) for t in texts], b"".join(texts)

    def cost(work):
        took = []
        for _ in range(5):
            begin = time.process_time()
            work()
            took.append(time.process_time() - begin)
        return min(took)

    unit = cost(lambda: mixed(np.arange(len(text), dtype=np.uint64)))
    assert cost(lambda: R._anchored(sizes, text, 200)) < 5 * unit


def test_empty_tables(spark):
    docs = cases.table(spark, [])
    assert L.score_documents(docs).count() == 0 and R.repeated_spans(docs).count() == 0 and X.secret_spans(docs).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert T.scores(docs, T.learn(docs, labels)).count() == 0


def test_grammar_composes_five_machines():
    g = T.Grammar({"idiot": 3.0, "lowei*": 2.0})

    def arcs(text):
        return {a: x for a, x in zip(T.ARCS, g.features(text)[3:], strict=True) if x}

    assert arcs("You are an idiot.") == {("insult", "aimed"): 3.0} and arcs("not an idiot") == {("insult", "denied"): 3.0}
    assert arcs("she said he is an idiot") == {("insult", "reported"): 3.0} and arcs("what an idiot") == {("insult", "plain"): 3.0}
    assert arcs("not now. an idiot") == {("insult", "plain"): 3.0} and arcs("loweisch") == {("insult", "plain"): 2.0}
    assert arcs("you idiot, loweisch idiot") == {("insult", "aimed"): 3.0, ("insult", "plain"): 2.0, ("stacked", "plain"): 3.0}
    assert arcs("I will kill you") == {("threat", "aimed"): 1.0} and arcs("they will not kill you") == {("threat", "denied"): 1.0}
    assert arcs("kill you") == {("threat", "aimed"): 1.0} and arcs("I don't want to burn it") == {} and arcs("burn the house down") == {}
    assert arcs("they will kill the process") == {} and arcs("ich werde dich töten") == {("threat", "aimed"): 1.0} and arcs("you kill time") == {}
    assert arcs("he wrote: I will kill you") == {("threat", "reported"): 1.0} and arcs("he wrote that he will kill them") == {("threat", "reported"): 1.0}
    assert arcs("note: I will kill you") == {("threat", "aimed"): 1.0} and arcs("he wrote. I will kill you") == {("threat", "aimed"): 1.0}
    assert g.features("")[1:] == [0.0] * (2 + len(T.ARCS))
    assert T.entries_of("don't Don't")[1] == ["don'*", "don't"]


def test_toxicity_of_repeated_and_long_texts(spark):
    weights = (-5.0, 0.5, 0.0, *T.PRIOR[3:])
    g = T.Grammar({"idiot": 6.0}, weights)
    long = "word " * 1_000_000
    found = T.scores(spark.createDataFrame([(1, "you idiot idiot"), (1, "you idiot idiot"), (2, long), (3, long + "I will kill you")], "doc_id long, text string"), g).collect()
    assert sorted((r.doc_id, r.predicted) for r in found) == [(1, 1), (1, 1), (2, 0), (3, 1)]


def test_toxicity_learns_and_holds_out(spark):
    import random

    rng = random.Random(3)
    data, labels = [], []
    for k in range(600):
        text, toxic = cases.words(rng, 60), int(k % 4 == 0)
        if toxic:
            text += f" you {rng.choice(['zonk', 'blarg', 'frump'])} " + cases.words(rng, 5)
        data.append((k, text, "en", "s", 1))
        labels.append((k, 1, toxic if k % 50 else None))
    data += [(900, None, None, None, None), (None, "zonk", None, None, None), (901, "", None, None, None)]
    docs = cases.clashing(cases.table(spark, data))
    grammar = T.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {r.doc_id: r for r in T.scores(docs, grammar).collect()}
    assert len(found) == len(data)
    for key, r in found.items():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (key is not None and zlib.crc32(str(key).encode()) % 5 == 0)
    wrong = sum(found[k].predicted != int(k % 4 == 0) for k in range(600))
    assert wrong <= 3 and found[900].predicted == 0
    clean = T.drop_toxic(docs, grammar)
    assert clean.columns == docs.columns and clean.count() == sum(r.predicted == 0 for r in found.values())


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((1500, 16))
    v[700:900] = v[0]
    rows = [(k, [float(np.float32(x)) for x in r]) for k, r in enumerate(v)]
    rows += [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [1.0, None] + [0.0] * 14), (5200, [1.0, 2.0]), (None, [1.0] * 16), (5250, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("label", "score", "rank", "key", "ids", "name", "unit")})
    found = defaultdict(list)
    for r in K.nearest(df, unit_rows=100, unit_most=60).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r)
    f = v.astype(np.float32).astype(np.float64)
    f /= np.linalg.norm(f, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 50):
        s = f @ f[q]
        s[q] = -9
        best = np.lexsort((np.arange(1500), -np.round(s, 12)))[:5]
        assert [r.rank for r in found[q]] == [1, 2, 3, 4, 5]
        assert all(abs(s[r.vec_id] - r.score) < 1e-9 for r in found[q])
        hits += len({r.vec_id for r in found[q]} & set(best.tolist()))
        if 700 <= q < 900 or q == 0:
            assert [r.vec_id for r in found[q]] == best.tolist()
    assert hits / (5 * 30) >= 0.9 and set(found) == set(range(0, 1500, 50))


def test_recall_is_held_where_buckets_are_narrow(spark):
    v = np.random.default_rng(8).standard_normal((3000, 16)).astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(v)], "vec_id long, embedding array<double>")
    found = defaultdict(set)
    for r in K.nearest(df, tables=4, probes=6).collect():
        found[r.query_id].add(r.vec_id)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    hits = [len(found[q] & set(np.argsort(-(v @ v[q]))[1:6].tolist())) for q in range(0, 3000, 50)]
    assert sum(hits) / (5 * len(hits)) >= 0.9


def test_neighbours_are_exact(spark):
    v = np.random.default_rng(9).standard_normal((3000, 16)).astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(v)], "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in K.nearest(df, tables=4, probes=6, unit_most=700).orderBy("rank").collect():
        found[r.query_id].append(r.vec_id)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert dict(found) == {q: np.argsort(-(v @ v[q]))[1:6].tolist() for q in range(0, 3000, 50)}


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, round(r.score, 6)) for r in K.nearest(df).orderBy("rank").collect()] == [(2, 0.707107), (1, 0.0)]
    assert K.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("base", [[3.0, 1.0, 2.0], [0.1, 0.7, -0.3]])
def test_parallel_vectors_are_ties(spark, base):
    rng = np.random.default_rng(3)
    rows = [(0, [1.0, 2.0, 3.0])] + [(k, [x * scale for x in base]) for k, scale in zip(range(1, 41), (rng.permutation(40) + 1.0).tolist(), strict=True)] + [(100 + k, [-1.0, -float(k + 1), 0.5]) for k in range(60) if (100 + k) % 50]
    found = K.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).where("query_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in found] == [1, 2, 3, 4, 5]
    want = np.dot(base, [1, 2, 3]) / np.linalg.norm(base) / np.sqrt(14)
    assert all(abs(r.score - want) < 1e-12 for r in found)


def test_perturbations_come_in_order():
    sets = K.perturbations(np.array([0.1, 0.5, 0.9]), 1.0, 12)
    cost = [sum((x if s < 0 else 1 - x) ** 2 for f, s in p for x in [[0.1, 0.5, 0.9][f]]) for p in sets]
    assert sets[0] == () and cost == sorted(cost) and len(set(sets)) == len(sets)


def test_deeply_nested_header_is_no_token(spark):
    nested = b64url(b'{"a":' * 60_000 + b"1" + b"}" * 60_000)
    found = X.secret_spans(spark.createDataFrame([(1, f"ey {nested}.{b64url(b'{}')}.x"), (2, "ey" + "." * 9 + "x" * 3_000_000)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_assign, r.spans.count("token")) for r in found) == [(1, 0, 0), (2, 0, 0)]


def test_fit_settles_where_labels_are_told_apart():
    rng = np.random.default_rng(2)
    toxic = (np.arange(400) % 8 == 0).astype(float)
    sums = np.where(toxic > 0, rng.integers(5, 400, 400), 0).astype(float)
    x = np.c_[np.ones(400), sums, np.log1p(sums > 0), sums, rng.standard_normal(400)]
    w = np.array(T.fit(x, toxic, np.zeros(5)))
    assert np.isfinite(w).all() and ((x @ w >= 0) == (toxic > 0)).all()


HARMLESS = (
    "These paths lead home.", "Pathology is a branch of medicine.", "The worth of these paths is clear.", "A disguise and a pathway to stupendous cloth.", "The kernel will kill the process; you must attack the problem.",
    "We should burn the disc and shoot the film.", "They will beat the eggs and crush the grapes.", "You must smash the atoms: the beam will hurt nobody.", "The clover and the trasimene lake.", "Note: the moratorium ends.",
)


def test_harmless_prose_is_left_alone(spark):
    grammar = T.learn(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    assert {t: round(grammar.score(t), 3) for t in HARMLESS if grammar.score(t) >= 0.1} == {}
    assert min(map(grammar.score, ("You are pathetic and worthless.", "what a stupid idiot you are", "Such scum! Such trash!"))) > 0.9
    plain = grammar.score("I will kill you.")
    assert plain > 0.5
    for told in ("He said: I will kill you", "She wrote :: I will kill you.", "The sheet says he will kill you", "They will never kill you."):
        assert grammar.score(told) < 0.1 < plain, told
    kept = T.drop_toxic(spark.createDataFrame([(k, t) for k, t in enumerate((*HARMLESS, "You stupid idiot."))], "doc_id long, text string"), grammar).collect()
    assert sorted(r.doc_id for r in kept) == list(range(len(HARMLESS)))


def test_beginnings_need_many_words(spark):
    rows = [(k, f"vexo{chr(97 + k % 9)}rt zz{k}a one", 1) for k in range(40)] + [(100 + k, f"plain{k} words pathetically", 0) for k in range(60)] + [(200 + k, f"pathetic yy{k}b", 1) for k in range(20)]
    df = spark.createDataFrame([(k, t, y) for k, t, y in rows], "doc_id long, text string, toxic int")
    entries = T._lexicon(df, 3, 1.0)
    assert "vexo*" in entries and "pathetic" in entries and not [e for e in entries if e.startswith("path") and e.endswith("*")]
