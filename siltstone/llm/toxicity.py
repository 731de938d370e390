"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read the words of a clause as symbols. Those of insult and
threat say what is done: an insult, one stacked upon another, a threat, which
takes a victim beside its verb. Those of target, negation and
reported speech say how: aimed at somebody, denied, or only told. Their
composition is one machine; each of its arcs that matches carries a kind, a
frame and a weight. A clause's score is what its path gathers, a document's
what its matched clauses give.

The entries of the insult lexicon, words and word beginnings, and the weights
of the arcs are learned from labelled rows that are not held out.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table, written

# Closed word classes of the four languages of the corpus.
NEGATION = (
    "not", "no", "never", "neither", "nor", "isn't", "aren't", "don't", "doesn't", "nicht", "kein", "keine", "keinen", "nie", "niemals",
    "ne", "pas", "jamais", "aucun", "nunca", "jamás", "ningún", "ninguna",
)
REPORTED = (
    "said", "says", "wrote", "quoted", "reported", "claimed", "called", "sagte", "sagt", "schrieb", "zitierte",
    "dit", "écrit", "cité", "dijo", "dice", "escribió", "citó",
)
TARGET = (
    "you", "your", "yours", "they", "them", "he", "him", "she", "her", "du", "dich", "dein", "ihr", "euch",
    "tu", "te", "vous", "votre", "toi", "tú", "usted", "ustedes", "vosotros",
)
#: Who suffers, also where they are named before the verb.
OBJECT = ("him", "them", "dich", "euch", "te", "toi", "os")
INTENT = (
    "will", "shall", "gonna", "going", "must", "should", "i'll", "we'll", "werde", "werden", "wirst", "sollte", "muss",
    "vais", "va", "allons", "dois", "doit", "voy", "vas", "vamos", "debe", "debo",
)
THREAT = (
    "kill", "hurt", "destroy", "burn", "punish", "murder", "beat", "crush", "smash", "stab", "shoot", "harm", "ruin", "attack",
    "töten", "töte", "umbringen", "vernichten", "verletzen", "schlagen", "erschießen", "zerstören", "verprügeln", "zertreten",
    "tuer", "tue", "frapper", "brûler", "détruire", "blesser", "écraser", "battre", "égorger",
    "matar", "mataré", "golpear", "quemar", "destruir", "herir", "aplastar", "pegar", "apuñalar",
)

CLAUSE = re.compile(r"[.,;!?\n\r]+")
#: Within a clause, what a reporting verb reports follows after a colon; without one a colon ends a clause too.
COLON = re.compile(r":+")
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
STEMS = (4, 5)
HELD_OUT_OF = 5

#: How many different words that only toxic texts have must share a beginning for it to be an entry.
SHARED = 5

#: What a word may be to the machines; of several the first. Which words are insults is learned.
SYMBOLS = ("insult", "threat", "object", "target", "negation", "reported", "intent", "other")
CODE = {s: n for n, s in enumerate(SYMBOLS)}
CLOSED = {w: CODE[s] for s, words in reversed((("threat", THREAT), ("object", OBJECT), ("target", TARGET), ("negation", NEGATION), ("reported", REPORTED), ("intent", INTENT))) for w in words}


@dataclass(frozen=True)
class Transducer:
    """A deterministic machine over symbols: (state, symbol) -> (state, mark)."""

    states: int
    step: Callable[[int, str], tuple[int, str]]


def _insult(reach: int) -> Transducer:
    """Says what an insult is: the first, or one within ``reach`` words of another."""
    return Transducer(reach + 1, lambda q, x: (reach, "stacked" if q else "insult") if x == "insult" else (max(q - 1, 0), ""))


def _threat(reach: int) -> Transducer:
    """Says threat where a victim comes within ``reach`` words after its verb, or the verb within two after a victim in the case of one who suffers.

    States: 0, the words left after such a victim (1 and 2), and beyond them those after a verb.
    A verb without a victim is none: one kills a process, burns a disc, beats eggs.
    """

    def step(q: int, x: str) -> tuple[int, str]:
        struck = q > 2
        if x == "threat":
            return (0, "threat") if 0 < q <= 2 else (reach + 2, "")
        if x in ("target", "object") and struck:
            return 0, "threat"
        if x == "object":
            return 2, ""
        return (0 if q in (0, 1, 3) else q - 1), ""

    return Transducer(reach + 3, step)


def _window(symbols: tuple[str, ...], reach: int, mark: str) -> Transducer:
    """Says ``mark`` for ``reach`` words after one of ``symbols``, and at it."""
    return Transducer(reach + 1, lambda q, x: (reach, mark) if x in symbols else (max(q - 1, 0), mark if q else ""))


def _latch(symbol: str, mark: str) -> Transducer:
    """Says ``mark`` from ``symbol`` to the end of the clause."""
    return Transducer(2, lambda q, x: (1, mark) if q or x == symbol else (0, ""))


KINDS = ("threat", "stacked", "insult")
#: How an offence is framed where it is said; the order in which a frame prevails.
FRAMES = ("reported", "denied", "aimed", "plain")
ARCS = tuple(itertools.product(KINDS, FRAMES))


def compose(*machines: Transducer) -> tuple[list[list[int]], list[list[int]]]:
    """The product machine as tables: next state, and which of ARCS is matched (-1: none)."""
    states = list(itertools.product(*(range(m.states) for m in machines)))
    number = {q: n for n, q in enumerate(states)}
    then, matched = [], []
    for state in states:
        row, arcs = [], []
        for symbol in SYMBOLS:
            moved = [m.step(q, symbol) for m, q in zip(machines, state, strict=True)]
            row.append(number[tuple(q for q, _ in moved)])
            marks = {mark for _, mark in moved}
            kind, frame = next((k for k in KINDS if k in marks), None), next((f for f in FRAMES if f in marks), "plain")
            arcs.append(ARCS.index((kind, frame)) if kind else -1)
        then.append(row)
        matched.append(arcs)
    return then, matched


THEN, MATCHED = compose(_insult(3), _threat(2), _window(("target", "object"), 4, "aimed"), _window(("negation",), 3, "denied"), _latch("reported", "reported"))
#: Where labels say nothing of an arc it keeps this. No labelled text threatens anybody, so the weight of a threat is set, not
#: learned: against the base rate it makes one threat that has its victim toxic where the labels leave room, and denied and reported offences don't count.
PRIOR = (0.0, 0.0, 0.0, *(8.0 if (k == "threat" and f in ("aimed", "plain")) else 0.2 if f in ("aimed", "plain") else 0.0 for k, f in ARCS))
#: Where the machine stands when somebody has just been said to say something.
TELLS = THEN[0][CODE["reported"]]
#: What a threat weighs on its arc; an insult weighs what its entry does.
THREAT_WEIGHT = 1.0


@dataclass(frozen=True)
class Grammar:
    """What has been learned: entry -> weight, and the weights of the clause features and arcs."""

    lexicon: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = ()
    known: dict[str, tuple[int, float]] = field(default_factory=dict, repr=False, compare=False)

    def weight_of(self, word: str) -> float:
        """The weight of a word, or of its longest known beginning."""
        found = self.lexicon.get(word, 0.0)
        for n in STEMS:
            if len(word) > n:
                found = max(found, self.lexicon.get(word[:n] + "*", 0.0))
        return found

    def read(self, word: str) -> tuple[int, float]:
        """A word's symbol and weight, remembered for a bounded number of words."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 500_000:
                self.known.clear()
            weight = self.weight_of(word)
            symbol = CODE["insult"] if weight else CLOSED.get(word, CODE["other"])
            found = self.known[word] = symbol, weight or THREAT_WEIGHT
        return found

    def path(self, words: list[str], state: int = 0) -> tuple[dict[int, float], bool]:
        """What one clause's path through the composed machine gathers, by arc (empty if it matches nothing), and whether it has a reporting verb."""
        gathered, reports = {}, False
        for word in words:
            symbol, weight = self.read(word)
            arc = MATCHED[state][symbol]
            if arc >= 0:
                gathered[arc] = gathered.get(arc, 0.0) + weight
            reports |= symbol == CODE["reported"]
            state = THEN[state][symbol]
        return gathered, reports

    def clauses(self, text: str, offences: set[str]) -> Iterator[dict[int, float]]:
        """What each clause with an offence gathers; after a colon, what a reporting verb before it reports."""
        for sentence in CLAUSE.split(text):
            state, found = 0, offences
            for clause in COLON.split(sentence):
                words = WORD.findall(clause)
                if not found.isdisjoint(words) or ":" in sentence:
                    gathered, reports = self.path(words, state)
                    state = TELLS if reports or (state == TELLS and not words) else 0
                    yield gathered

    def features(self, text: str) -> list[float]:
        """One, the heaviest matched clause, the number of them, and what each arc gathers over all."""
        low = text.lower()
        offences = {w for w in set(WORD.findall(low)) if self.read(w)[0] <= CODE["threat"]}
        heaviest, clauses, arcs = 0.0, 0, [0.0] * len(ARCS)
        if offences:
            for gathered in self.clauses(low, offences):
                if gathered:
                    clauses += 1
                    heaviest = max(heaviest, sum(x for arc, x in gathered.items() if ARCS[arc][1] in ("aimed", "plain")))
                    for arc, x in gathered.items():
                        arcs[arc] += x
        return [1.0, heaviest, math.log1p(clauses), *arcs]

    def score(self, text: str) -> float:
        if not self.weights:
            return 0.0
        z = sum(a * b for a, b in zip(self.weights, self.features(text), strict=True))
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT_OF == 0, F.lit(False))


def fit(features: np.ndarray, toxic: np.ndarray, prior: np.ndarray, rounds: int = 100, ridge: float = 1e-2) -> tuple[float, ...]:
    """Logistic regression by Newton's method, drawn towards ``prior``; the first weight, of one, is nearly free.

    A step is halved until it lowers the loss, so the weights settle also
    where the labels can be told apart without error.
    """
    pull = np.full(features.shape[1], ridge)
    pull[0] = 1e-3
    sign = 1 - 2 * toxic

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, sign * (features @ w)).sum() + (pull * (w - prior) ** 2).sum() / 2)

    w = np.zeros(features.shape[1])
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        slope = features.T @ (p - toxic) + pull * (w - prior)
        step = np.linalg.solve((features * (p * (1 - p))[:, None]).T @ features + np.diag(pull), slope)
        while (then := loss(w - step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        if then > now or now - then < 1e-9 * (1 + now):
            break
        w, now = w - step, then
    return tuple(map(float, w))


def entries_of(text: str) -> tuple[int, list[str]]:
    """A text's smallest word hash, and its distinct words and their beginnings, by the words that scoring reads."""
    words = {w for w in WORD.findall(text.lower()) if len(w) > 1}
    family = min((zlib.crc32(w.encode()) for w in words), default=0)
    return family, sorted(words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n})


def _lexicon(train: DataFrame, least_sources: int, least_weight: float) -> dict[str, float]:
    """Words and beginnings that mark toxic rows.

    Near copies of one text would lend each other's words support, so a word
    counts once for each smallest word hash among the documents that have it,
    which near copies share.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2 << 20):
            family, entries = zip(*map(entries_of, batch.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(family, pa.int64()), pa.array(entries, pa.list_(pa.string()))], ["toxic", "family", "entries"])

    seen = written(train.select("toxic", "text").mapInArrow(read, "toxic int, family long, entries array<string>").where(F.size("entries") > 0), "toxicity-entries")
    total = {r["toxic"]: r["n"] for r in seen.groupBy("toxic").agg(F.countDistinct("family").alias("n")).collect()}
    if set(total) != {0, 1}:
        return {}
    by_family = seen.select("toxic", "family", F.explode("entries").alias("entry")).distinct()
    counted = by_family.groupBy("entry").agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (total[1] + 1)) - F.log((F.col("good") + 0.5) / (total[0] + 1))
    counted = written(counted, "toxicity-entries-counted")
    # A beginning says more than its words only where many of them say the same: path- is not an insult because pathetic is one.
    word = F.col("entry")
    telling = counted.where((F.col("good") == 0) & ~word.endswith("*")).select(F.explode(F.array(*(F.when(F.length(word) > n, F.concat(F.left(word, F.lit(n)), F.lit("*"))) for n in STEMS))).alias("entry"))
    shared = telling.where("entry is not null").groupBy("entry").agg(F.count("*").alias("shared")).where(F.col("shared") >= SHARED).select("entry")
    counted = counted.where(~word.endswith("*")).unionByName(counted.join(shared, "entry", "left_semi"))
    best = counted.where(F.col("bad") >= least_sources).withColumn("weight", odds).where(F.col("weight") >= least_weight)
    return {r["entry"]: r["weight"] for r in best.select("entry", "weight").collect()}


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Grammar:
    """The grammar, from at most about ``max_rows`` labelled rows that are not held out.

    The bound holds for the labelled sample only; it is drawn by a hash of the
    id. Rows with a null id, text or label take no part; of an id with several
    labels the largest counts. Without rows of both labels nothing is learned
    and every score is 0. Each entry of the lexicon has at least three toxic
    texts of the sample and one in 2,000 of its rows, so the sample's bound is
    the lexicon's too.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.expr("int(toxic = 1)")).alias("toxic"))
    share = min(1.0, max_rows / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    train = written(docs.select("doc_id", "text").where("text is not null").join(sample, "doc_id"), "toxicity-sample")
    n = train.count()
    lexicon = _lexicon(train, max(3, n // 2000), 2.0)
    if not lexicon:
        return Grammar()
    grammar = Grammar(lexicon)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = [grammar.features(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "toxic", "features"])

    rows = train.select("doc_id", "text", "toxic").mapInArrow(features, "doc_id long, toxic int, features array<double>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["toxic"], r["features"]))
    return Grammar(lexicon, fit(np.array([r["features"] for r in rows]), np.array([r["toxic"] for r in rows], float), np.array(PRIOR)))


def scores(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """For each row of ``docs``: doc_id, held_out, score (0 to 1), predicted.

    Only the text decides, the whole of it; null and empty texts get the score
    of no match. Each row is scored alone, so repeated rows give repeated
    results. A null doc_id is not held out. Other columns are not looked at;
    an empty table gives an empty result.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [grammar.score(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(scored, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.expr("int(score >= 0.5)").alias("predicted")
    )


def drop_toxic(docs: DataFrame, grammar: Grammar, reject_from: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``reject_from``, with all their columns.

    Null and empty texts match nothing and stay, whatever their id; repeated rows
    stay or go together; texts are read whole. An empty table stays empty.
    """
    at = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            stays = pa.array([grammar.score(x or "") < reject_from for x in batch.column(at).to_pylist()], pa.bool_())
            yield batch.filter(stays)

    return docs.mapInArrow(clean, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scores`` of all documents by the grammar learned from ``labels``."""
    docs = table(spark, sf_dir, "documents")
    return scores(docs, learn(docs, table(spark, sf_dir, "labels")))
