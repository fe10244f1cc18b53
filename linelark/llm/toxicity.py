"""Toxicity by a weighted finite-state pattern grammar.

A lexicon turns the words of a clause into symbols: insult I, threat verb T, target P (who is addressed), target as an object
Q, which may come before its verb, copula C, intent M (modal words), negation N, reported speech R, other O. Four
transducers read a clause one after another: threats (intent, threat verb, target), insults (target, copula, insult),
negation and reported speech. Each rewrites what it matches and passes on the rest; they are composed into one machine. A
clause's score is the weighted sum of the patterns that it ends up with, by kind; words that take part in no pattern score
nothing, but for bare insults, which are the weakest pattern. A document's score is a logistic
function of its clauses' scores: their sum, the highest one, and the sum against what clean text of that length has by
chance. Labels fit the lexicon, the weights of the kinds and those of the sums.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import roots
from .scratch import labelled_sample, map_rows, remainder
from .shingles import shingle_set

#: Labelled documents of each class, and characters of one, used for fitting at most.
SAMPLE_PER_CLASS, SAMPLE_CHARS = 2000, 40_000
STEM_SHORTEST, STEM_LONGEST = 4, 12
#: A lexicon entry occurs in this many toxic documents at least, and its rate there is this many times that in others.
LEAST, RATIO = 3, 4.0
CACHE = 200_000

# Closed-class words of the grammar in English, German, French and Spanish.
TARGETS = "you your yours yourself u ur they them he him she her these those du dein deine ihr sie tu toi ton ta tes votre vos ils elles tú ti usted ustedes vosotros ellos ellas".split()
OBJECTS = "dich dir euch te vous os les los".split()
COPULAS = "are is was were be being been am re bist ist seid sind war waren es êtes est sont étais eres son sois fue fueron".split()
INTENTS = "will ll shall gonna going must should would can want werde werden wird will muss soll sollte vais va vont veux doit faut voy va van quiero debe".split()
NEGATIONS = "not no never none nobody isn aren wasn weren don won nicht kein keine nie niemals pas jamais aucun ne nunca jamás ningún tampoco".split()
REPORTS = "said says say told called wrote quoted claimed according alleged sagte sagt nannte schrieb laut zitiert dit disait selon appelé écrit dijo dice llamó según escribió".split()
THREATS = "kill killed killing hurt murder shoot stab destroy burn hang töten umbringen erschießen sterben tuer frapper brûler mourir matar golpear quemar morir".split()
INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting".split()

_TOKEN = re.compile(r"\w+|[.!?;:\n]+|[\"“”«»„]")
_WORD = re.compile(r"\w+")

INPUTS = "ITPQCMNRO"
#: Kinds of patterns: a bare insult i, one with its target in reach J, one said of its target K, a threat verb with its
#: target W, the same announced U, any of these negated n or reported r.
KINDS = "iJKWUnr"
#: How many words later a target, a predicate, an intent, a threat verb or a negation still counts.
REACH = {"P": 4, "Q": 4, "C": 5, "M": 4, "T": 3, "N": 4}


def _fading(marks: str) -> dict:
    """For each mark and symbol of no effect, the mark one word weaker: states are '' or a mark and how many words it lasts."""
    out = {}
    for mark in marks:
        for k in range(1, REACH[mark.upper()] + 1):
            for symbol in INPUTS + KINDS:
                out[f"{mark}{k}", symbol] = (f"{mark}{k - 1}" if k > 1 else "", symbol)
    return out


def _states(mark: str) -> list[str]:
    return [f"{mark}{k}" for k in range(1, REACH[mark.upper()] + 1)]


#: Transducers: {(state, symbol): (next state, output)}; a symbol without an entry passes and keeps the state.
THREAT = _fading("MqtT") | {("", "M"): (f"M{REACH['M']}", "M"), ("", "T"): (f"t{REACH['T']}", "O")}
THREAT |= {(s, "M"): (f"M{REACH['M']}", "M") for s in _states("M")} | {(s, "T"): (f"T{REACH['T']}", "O") for s in _states("M") + _states("T")}
THREAT |= {(s, "T"): (f"t{REACH['T']}", "O") for s in _states("t")} | {(s, x): ("", "W") for s in _states("t") for x in "PQ"} | {(s, x): ("", "U") for s in _states("T") for x in "PQ"}
THREAT |= {(s, "Q"): (f"q{REACH['Q']}", "Q") for s in _states("M") + _states("q")} | {(s, "T"): ("", "U") for s in _states("q")} | {(s, "M"): (f"M{REACH['M']}", "M") for s in _states("q")}

INSULT = _fading("PC") | {("", "I"): ("", "i")}
INSULT |= {(s, x): (f"P{REACH['P']}", x if x in "WU" else "O") for s in ("", *_states("P"), *_states("C")) for x in "PQWU"}
INSULT |= {(s, "C"): (f"C{REACH['C']}", "O") for s in _states("P")}
INSULT |= {(s, "I"): (s, "J") for s in _states("P")} | {(s, "I"): (s, "K") for s in _states("C")}

NEGATION = _fading("N") | {(s, "N"): (f"N{REACH['N']}", "O") for s in ("", *_states("N"))} | {(s, x): (s, "n") for s in _states("N") for x in "iJKWU"}
REPORT = {("", "R"): ("R", "O")} | {("R", x): ("R", "r") for x in "iJKWU"}


def compose(*machines: dict) -> dict:
    """One machine over state tuples, {(state, symbol): (next state, output)} with every reachable state and input symbol."""
    begin = ("",) * len(machines)
    table, todo, known = {}, [begin], {begin}
    while todo:
        state = todo.pop()
        for symbol in INPUTS:
            x, after = symbol, []
            for machine, s in zip(machines, state):
                s, x = machine.get((s, x), (s, x))
                after.append(s)
            after = tuple(after)
            table[state, symbol] = (after, x)
            if after not in known:
                known.add(after)
                todo.append(after)
    return table


GRAMMAR = compose(THREAT, INSULT, NEGATION, REPORT)
_BEGIN = ("",) * 4


class Lexicon:
    """word -> (symbol, weight); learned stems first, the longest that fits, then the closed-class words."""

    def __init__(self, stems: dict[str, float]) -> None:
        fixed = [("T", THREATS), ("P", TARGETS), ("Q", OBJECTS), ("N", NEGATIONS), ("R", REPORTS), ("C", COPULAS), ("M", INTENTS)]
        closed = {w: (s, 1.0) for s, words in reversed(fixed) for w in words}
        stems = {**{w: 1.0 for w in INSULTS if not stems}, **stems}

        class Words(dict):
            def __missing__(words, word: str) -> tuple[str, float]:
                if len(words) >= CACHE:
                    words.clear()
                value = closed.get(word)
                if value is None:
                    weight = next((stems[word[:n]] for n in range(min(STEM_LONGEST, len(word)), STEM_SHORTEST - 1, -1) if word[:n] in stems), 0.0)
                    value = ("I", weight) if weight else ("O", 0.0)
                words[word] = value
                return value

        self.words = Words()

    def clauses(self, text: str | None) -> tuple[list[dict[str, float]], int]:
        """(for each clause with a pattern the summed weight of each kind, words of the text); a clause ends at a stop or a line's end."""
        if not text:
            return [], 0
        text, lookup = text.lower(), self.words
        words = _WORD.findall(text)
        if not any(lookup[w][0] in "IT" for w in set(words)):
            return [], len(words)
        found, state, clause = [], _BEGIN, {}
        for token in _TOKEN.findall(text):
            if token[0] in ".!?;:\n":
                if clause:
                    found.append(clause)
                state, clause = _BEGIN, {}
                continue
            symbol, weight = ("R", 1.0) if token in "\"“”«»„" else lookup[token]
            state, made = GRAMMAR[state, symbol]
            if made in KINDS:
                clause[made] = clause.get(made, 0.0) + weight
        return found + [clause] * bool(clause), len(words)


def distinct(sample: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The first row of each family of near copies with one label: else a copied text's rare words would look typical of its label.

    Two texts are of a family if 6 of the 16 smallest hashes of their five-word shingles agree.
    """
    holders: dict[int, list[int]] = {}
    pairs = []
    for i, (text, y) in enumerate(sample):
        low = shingle_set(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), 5)[:16].tolist()
        agree = Counter(j for h in low for j in holders.get(h, ()) if sample[j][1] == y)
        pairs += [(j, i) for j, n in agree.items() if n >= min(6, len(low))]
        for h in low:
            holders.setdefault(h, []).append(i)
    return [sample[i] for i, r in enumerate(roots(len(sample), pairs)) if i == r]


def learn(sample: list[tuple[str, int]]) -> dict[str, float]:
    """Stems (beginnings of words, or whole ones) with the log of their rate in toxic texts over that in others.

    A stem must come once, twice or three times in more toxic documents than chance among so many gives; of stems that begin
    alike the one with the strongest proof stays, of equal ones the longest.
    """
    n = [sum(y == c for _, y in sample) for c in (0, 1)]
    if not all(n):
        return {}
    times = (1, 2, 3)
    holds, tokens, sizes = [(Counter(), Counter()) for _ in times], (Counter(), Counter()), [1, 1]
    for text, y in sample:
        words = Counter(_WORD.findall(text.lower()))
        sizes[y] += sum(words.values())
        own: Counter = Counter()
        for w, k in words.items():
            for size in range(STEM_SHORTEST, min(STEM_LONGEST, len(w)) + 1):
                own[w[:size]] += k
        for k, held in zip(times, holds):
            held[y].update([w for w, c in own.items() if c >= k])
        tokens[y].update(own)
    share, chance = n[1] / sum(n), math.log(len(tokens[0] | tokens[1]) + 1) + 4

    def proof(a: int, b: int) -> float:
        """Log-likelihood ratio of the share of toxic ones among documents with a stem (a toxic, b others) and that of all; 0 if it is less."""
        if a < LEAST or a * n[0] <= b * n[1]:
            return 0.0
        return a * math.log(a / (a + b) / share) + (b * math.log(b / (a + b) / (1 - share)) if b else 0.0)

    proofs = []
    for w in holds[0][1]:
        rate = math.log((tokens[1][w] + 0.5) / sizes[1]) - math.log((tokens[0][w] + 0.5) / sizes[0])
        best = max(proof(held[1][w], held[0][w]) for held in holds)
        if best >= chance and rate >= math.log(RATIO):
            proofs.append((best, len(w), w, rate))
    kept: dict[str, float] = {}
    taken: set[str] = set()
    for _, _, w, rate in sorted(proofs, reverse=True):
        beginnings = {w[:k] for k in range(STEM_SHORTEST, len(w) + 1)}
        if w not in taken and not beginnings & kept.keys():
            kept[w] = round(min(rate, 5.0), 4)
            taken |= beginnings
    return kept


class Scorer:
    """Logit of a document from its clauses.

    ``kinds``: logarithms of steps that make the weights of i, J, K, W and U, so that a directed insult never weighs less than
    a bare one, nor an announced threat less than another; and the logits of the share of a bare insult's weight that a
    negated or reported pattern keeps. ``sums``: weights of the clauses' sum, the highest clause and the sum a word, and the bias.
    """

    KINDS = [0.0, -0.7, -1.0, 0.4, 0.0, -2.2, -1.4]
    SUMS = [1.2, 0.6, 0.3, -4.0]

    def __init__(self, kinds: list[float], sums: list[float], clean: float = 0.0) -> None:
        bare, directed, said, threat, announced = (math.exp(x) for x in kinds[:5])
        negated, reported = (bare / (1 + math.exp(-x)) for x in kinds[5:])
        self.weights = np.array([bare, bare + directed, bare + directed + said, threat, threat + announced, negated, reported])
        self.sums, self.clean = sums, clean

    def inputs(self, clauses: np.ndarray, first: np.ndarray, words: np.ndarray) -> np.ndarray:
        """For each document, whose clauses (one row each, a column a kind) begin at ``first``: sum less what ``words`` of clean text have, highest, sum a hundred words."""
        scores = np.append(clauses @ self.weights, 0.0)
        none = np.diff(np.append(first, len(clauses))) == 0
        total = np.where(none, 0.0, np.add.reduceat(scores, np.minimum(first, len(clauses))))
        highest = np.where(none, 0.0, np.maximum.reduceat(scores, np.minimum(first, len(clauses))))
        above = np.maximum(total - self.clean * self.weights[0] * words, 0.0)
        return np.stack([np.log1p(above), np.log1p(highest), np.log1p(100 * total / (words + 20))], 1)

    def __call__(self, clauses: np.ndarray, first: np.ndarray, words: np.ndarray) -> np.ndarray:
        return self.inputs(clauses, first, words) @ np.array(self.sums[:3]) + self.sums[3]

    def one(self, found: list[dict[str, float]], words: int) -> float:
        if not found:
            return self.sums[3]
        return float(self(rows_of(found), np.array([0]), np.array([words]))[0])


def rows_of(found: list[dict[str, float]]) -> np.ndarray:
    return np.array([[c.get(k, 0.0) for k in KINDS] for c in found], float).reshape(-1, len(KINDS))


def fit(sample: list[tuple[str, int]], prior: float = 0.0, rounds: int = 150, held: float = 0.02) -> tuple[dict[str, float], list[float], list[float], float]:
    """(stems, kinds, sums, clean) of a Scorer and its lexicon; ``prior`` is added to the bias.

    The weights come from the half of the sample that did not make the lexicon, so that a word met once is no proof; they are
    held near the stated ones by ``held``, so that kinds which the sample lacks keep their order. ``clean``: the summed bare
    insults a word of texts that aren't toxic.
    """
    sample = distinct(sample)
    if len({y for _, y in sample}) < 2:
        return {}, Scorer.KINDS, [*Scorer.SUMS[:3], Scorer.SUMS[3] + prior], 0.0
    lexicon = Lexicon(learn(sample[::2]))
    found = [lexicon.clauses(t) for t, _ in sample[1::2]]
    y = np.array([y for _, y in sample[1::2]], float)
    clauses = rows_of([c for f, _ in found for c in f])
    first = np.cumsum([0] + [len(f) for f, _ in found])[:-1]
    words = np.array([n for _, n in found], float)
    owner = np.repeat(np.arange(len(found)), [len(f) for f, _ in found])
    clean = float(clauses[y[owner] == 0].sum() / max(1.0, words[y == 0].sum()))
    begin = np.array(Scorer.KINDS + Scorer.SUMS)
    x, seen = begin.copy(), np.full(len(begin), 1e-8)
    each = np.where(y == 1, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))

    def loss(p: np.ndarray) -> float:
        z = np.clip(Scorer(p[:7].tolist(), p[7:].tolist(), clean)(clauses, first, words), -30, 30)
        return float((each * np.logaddexp(0, np.where(y == 1, -z, z))).sum() + held * ((p[:10] - begin[:10]) ** 2).sum() / 10)

    for _ in range(rounds):
        now = loss(x)
        g = np.array([(loss(x + step) - now) / 1e-4 for step in np.eye(len(x)) * 1e-4])
        seen += g**2
        x -= 0.3 * g / np.sqrt(seen)
        x[7:10] = np.maximum(x[7:10], 0.0)
    return learn(sample), x[:7].tolist(), [*x[7:10].tolist(), float(x[10]) + prior], clean


def toxicity_scores(documents: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, per_class: int = SAMPLE_PER_CLASS, max_chars: int = SAMPLE_CHARS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= 0.5) for each row of ``documents``.

    Labels (doc_id, toxic) are learned only from rows with crc32(doc_id as text) mod ``folds`` other than ``held_out``,
    at most ``per_class`` of each class with texts of up to ``max_chars`` characters. Null, empty and clean texts get the
    bias alone; with rows of one class or none the fixed words and weights stand. Repeated rows repeat; other columns are
    ignored; an empty table gives no rows.
    """
    train = remainder("doc_id", folds) != held_out
    sample = labelled_sample(documents, labels, "toxic", train, per_class, max_chars)
    shared = documents.sparkSession.sparkContext.broadcast(fit(sample, balance(labels, train, sample)))

    def start():
        stems, *weights = shared.value
        lexicon, scorer = Lexicon(stems), Scorer(*weights)

        def one(doc_id, text, out):
            score = 1 / (1 + math.exp(-max(-60.0, min(60.0, scorer.one(*lexicon.clauses(text))))))
            return doc_id, out, score, int(score >= 0.5)

        return one

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (remainder("doc_id", folds) == held_out).alias("held_out"))
    return map_rows(rows, start, "doc_id long, held_out boolean, score double, predicted int")


def balance(labels: DataFrame, train, sample: list[tuple[str, int]]) -> float:
    """The log-odds of label 1 among all training labels: classes weigh alike in ``fit``."""
    counts = {r["toxic"]: r["n"] for r in labels.where(train & F.col("toxic").isin(0, 1)).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    return math.log(counts[1] / counts[0]) if counts.get(0) and counts.get(1) and len({y for _, y in sample}) == 2 else 0.0
