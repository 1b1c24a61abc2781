"""Toxicity by a weighted finite-state pattern grammar.

Words of a clause become symbols (insult, threat, target, negation, report,
quote, other). Five deterministic transducers, composed into one machine, read the symbols:
negation marks insults and threats within its reach, reported speech marks what
follows a verb of saying or stands in quotes, threats need a target after them, insults are
asserted, and aimed if the clause has a target, and the last maps what is left to
events. A clause's score is the weight of its events and insults; a text's score
is a logistic function of the weighted event sums, fitted on labelled rows.

Fixed are the small seed lists below. Further insults, as whole words or as stems of
longer words, and all weights are learned from a bounded sample (``SAMPLE`` labelled rows at most, lowest hash of the id first)
outside the held-out fold; of rows that repeat a doc_id and label, one text is learned from. Labels, lang, source and doc_id are no inputs of a score.
Texts of any length are read whole, in time linear in their length.

Null, empty and wordless texts get the score of a text without events. With no
labels, or of one kind only, the fixed prior weights hold. Repeated rows repeat;
rows with a null label and other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, held_out, map_rows

SAMPLE, THRESHOLD = 8000, 0.3
#: A learned term: so many toxic texts at least that no other term explains, so high a share of toxic ones among all texts with it.
MIN_SUPPORT, MIN_PRECISION = 4, 0.5
#: Shortest and longest stem.
STEM = (3, 10)

# The seed lists of the grammar.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown clowns dumb fool fools jerk imbecile dimwit vermin filth garbage lowlife bastard bitch asshole idiota estúpido basura imbécil crétin ordure dummkopf abschaum trottel"
THREATS = "kill murder hurt destroy stab shoot beat strangle burn hunt matar töten tuer"
TARGETS = "you your yours yourself u ya he she they them him her those these people everyone tu toi vous du dich ihr euch usted ustedes"
NEGATIONS = "not no never nor neither isn't aren't wasn't weren't don't doesn't won't cannot can't nicht kein keine pas jamais nunca"
REPORTS = "said says say told called calls wrote writes quoted claimed reported sagte dit dijo schrieb"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = "wihtnrq"
EVENTS = ("asserted", "aimed", "negated", "reported", "threat")
#: What a text is scored by: events of words, asserted stems (their number, and whether there are two), a constant.
FEATURES = (*EVENTS, "stems", "two stems", "one")
_CLAUSE = re.compile(r"[.!?;\n]+")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”„«»]")


class Transducer:
    """Deterministic and complete: arcs give (state, symbol) to (state, output); other symbols pass and keep the state."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, str]], start: int = 0):
        self.arcs, self.start = arcs, start

    def step(self, state, symbol: str):
        return self.arcs.get((state, symbol), (state, symbol))

    def __call__(self, symbols: str) -> str:
        state, out = self.start, []
        for s in symbols:
            state, made = self.step(state, s)
            out.append(made)
        return "".join(out)


class Composition(Transducer):
    """The first's output is the second's input; pair states are made on first use."""

    def __init__(self, first: Transducer, second: Transducer):
        super().__init__({}, (first.start, second.start))
        self.first, self.second = first, second

    def step(self, state, symbol: str):
        if (state, symbol) not in self.arcs:
            a, middle = self.first.step(state[0], symbol)
            b, made = self.second.step(state[1], middle)
            self.arcs[state, symbol] = (a, b), made
        return self.arcs[state, symbol]


def negation(reach: int = 3) -> Transducer:
    """n and up to ``reach`` words: i, h become N."""
    arcs = {(s, NEGATION): (reach, NEGATION) for s in range(reach + 1)}
    for s in range(1, reach + 1):
        arcs |= {(s, x): (s - 1, x) for x in (OTHER, TARGET, REPORT)}
        arcs |= {(s, x): (0, "N") for x in (INSULT, THREAT)}
    return Transducer(arcs)


def reported() -> Transducer:
    """After a verb of saying to the clause's end, and within quotes: i, h become R. Its state: 2 * said + quoted."""
    arcs = {}
    for s in range(4):
        arcs[s, REPORT] = (s | 2, REPORT)
        arcs[s, QUOTE] = (s ^ 1, QUOTE)
        if s:
            arcs |= {(s, x): (s, "R") for x in (INSULT, THREAT)}
    return Transducer(arcs)


def threats(reach: int = 3) -> Transducer:
    """h is inert until a target within reach: that t becomes K."""
    arcs = {(s, THREAT): (reach, OTHER) for s in range(reach + 1)}
    for s in range(1, reach + 1):
        arcs |= {(s, x): (s - 1, x) for x in (OTHER, INSULT)}
        arcs[s, TARGET] = (0, "K")
    return Transducer(arcs)


def aiming() -> Transducer:
    """An insult after a target is aimed (A), else bare (B); a target after a bare insult adds the aim (a)."""
    arcs = {(0, INSULT): (2, "B"), (2, INSULT): (2, "B"), (1, INSULT): (1, "A"), (0, TARGET): (1, OTHER), (1, TARGET): (1, OTHER), (2, TARGET): (1, "a"), (0, "K"): (1, "K"), (2, "K"): (1, "K")}
    return Transducer(arcs)


def events() -> Transducer:
    return Transducer({(0, x): (0, OTHER) for x in (TARGET, NEGATION, REPORT, QUOTE, THREAT)})


def grammar() -> Transducer:
    machine: Transducer = negation()
    for further in (reported(), threats(), aiming(), events()):
        machine = Composition(machine, further)
    return machine


#: Which events an output symbol counts for.
_COUNTS = {"B": (0,), "A": (0, 1), "a": (1,), "N": (2,), "R": (3,), "K": (4,)}


@dataclass
class Model:
    insults: dict[str, float] = field(default_factory=lambda: {w: 1.0 for w in INSULTS.split()})
    #: By feature.
    weights: tuple[float, ...] = (5.0, 1.0, 0.5, 1.0, 4.0, 0.5, 2.0, -3.0)
    stems: list[str] = field(default_factory=list)

    def __post_init__(self):
        kinds = ((REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET), (THREATS, THREAT))
        self.symbols = {w: s for ws, s in kinds for w in ws.split()} | {w: INSULT for w in self.insults} | dict.fromkeys('"“”„«»', QUOTE)
        words, stems = ("|".join(sorted(map(re.escape, x), key=len, reverse=True)) for x in ({*self.insults, *THREATS.split()}, self.stems))
        self.trigger = re.compile(rf"\b(?:(?:{words})\b" + (f"|(?:{stems})[^\\W\\d_]" if stems else "") + ")")
        self.machine, self.begins = grammar(), tuple(self.stems)

    def symbol(self, token: str) -> str:
        known = self.symbols.get(token)
        return known or (INSULT if token.startswith(self.begins) and token not in self.stems else OTHER)

    def features(self, text: str | None) -> list[float]:
        """Weighted sums of events over the clauses with a trigger."""
        text = (text or "").lower()
        sums, stems, at = [0.0] * len(EVENTS), 0, 0
        while found := self.trigger.search(text, at):
            start = max(at, *(text.rfind(c, at, found.start()) + 1 for c in ".!?;\n"))
            stop = _CLAUSE.search(text, found.end())
            at = stop.end() if stop else len(text)
            tokens = _TOKEN.findall(text, start, at)
            made = self.machine("".join(map(self.symbol, tokens)))
            for token, symbol in zip(tokens, made, strict=True):
                if symbol in "AB" and token not in self.insults:
                    stems += 1
                    continue
                for k in _COUNTS.get(symbol, ()):
                    sums[k] += self.insults.get(token, 1.0)
        return [*(math.log1p(x) for x in (*sums, stems)), float(stems > 1), 1.0]

    def score(self, text: str | None) -> float:
        z = sum(w * x for w, x in zip(self.weights, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _terms(text: str, possible: Callable[[str], bool]) -> set[str]:
    """The words themselves, and (with a * behind) the stems that begin two longer words of the text."""
    low, high = STEM
    tokens = [w for w in _TOKEN.findall(text) if w.isalpha()]
    stems = Counter(x for w in tokens for k in range(low, min(high, len(w) - 1) + 1) if possible(x := w[:k] + "*"))
    return {w for w in {*tokens} if possible(w)} | {x for x, n in stems.items() if n > 1}


def learn_terms(rows: list[tuple[str | None, int]], known: set[str]) -> tuple[dict[str, float], list[str]]:
    """Words and stems that mark toxic texts, by greedy cover: again and again the term that explains most of the
    toxic texts without one yet, among those precise enough; of equal ones the longer. Each different text counts once.

    Texts are read again for every count, and only terms that hash to a slot counted often enough are told apart, so memory is that of the texts and of frequent terms."""
    bags = {(t or "").lower(): label for t, label in rows}
    toxic = [t for t, label in bags.items() if label and known.isdisjoint(_TOKEN.findall(t))]
    others = [t for t, label in bags.items() if not label]
    slots = np.zeros(1 << 22, np.uint16)
    for t in toxic:
        at = np.fromiter((hash(x) for x in _terms(t, lambda _: True)), np.int64) & (len(slots) - 1)
        slots[np.unique(at)] += 1
    often = lambda x: slots[hash(x) & (len(slots) - 1)] >= MIN_SUPPORT
    support = Counter(x for t in toxic for x in _terms(t, often))
    possible = {x for x, k in support.items() if k >= MIN_SUPPORT}
    open_bags = {t: _terms(t, possible.__contains__) for t in toxic}
    against = Counter(x for t in others for x in _terms(t, possible.__contains__))
    precise = {x for x in possible if support[x] / (support[x] + against[x]) >= MIN_PRECISION}
    insults, stems = {}, []
    while precise:
        gain = Counter(x for terms in open_bags.values() for x in terms if x in precise)
        best = max(gain, key=lambda x: (gain[x] - against[x], len(x.rstrip("*")), x.rstrip("*"), x[-1] == "*"), default=None)
        if best is None or gain[best] < MIN_SUPPORT:
            break
        if best[-1] == "*":
            stems.append(best[:-1])
        else:
            odds = math.log((support[best] + 0.5) / (sum(bags.values()) + 1)) - math.log((against[best] + 0.5) / (len(others) + 1))
            insults[best] = max(0.25, min(2.0, odds / 4))
        precise.discard(best)
        open_bags = {t: terms for t, terms in open_bags.items() if best not in terms}
    return insults, stems


def fit(rows: list[tuple[str | None, int]], rounds: int = 30, ridge: float = 0.05) -> Model:
    """rows: text, label. Insult terms, then logistic regression by Newton steps, with non-negative weights for what is asserted."""
    if len({label for _, label in rows}) < 2:
        return Model()
    seeds = {w: 1.0 for w in INSULTS.split()}
    learned, stems = learn_terms(rows, {*seeds})
    model = Model(seeds | learned, stems=stems)
    x = np.array([model.features(t) for t, _ in rows])
    y = np.array([float(label) for _, label in rows])
    prior = np.array([2.0, 0.5, 0.5, 0.5, 2.0, 0.5, 2.0, math.log(y.mean() / (1 - y.mean()))])
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    w[[0, 1, 4, 5, 6]] = np.maximum(w[[0, 1, 4, 5, 6]], 0)
    return Model(model.insults, tuple(float(v) for v in w), stems)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    return fit([(r.text, int(r.toxic > 0)) for r in sorted(rows, key=lambda r: (r.doc_id, r.toxic))])


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast((model.insults, model.weights, model.stems))

    def make():
        own = Model(*sent.value)

        def one(doc_id, out, text):
            s = own.score(text)
            return doc_id, out, s, int(s >= threshold)

        return one

    return map_rows(docs.withColumn("held_out", held_out()), ["doc_id", "held_out", "text"], OUT, make)


def keep_civil(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score under the threshold, columns unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast((model.insults, model.weights, model.stems))

    def make():
        own = Model(*sent.value)
        return lambda text: own.score(text) < threshold

    return filter_rows(docs, "text", make)
