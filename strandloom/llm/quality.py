"""Quality as a generalised additive model with pairwise interactions.

A text is ``FEATURES`` numbers: sizes, shares of kinds of characters, the worst of them in any line, repetition.
Each feature is cut at quantiles into ``BINS`` bins at most. Cyclic boosting goes round the features again and again; every
visit fits a shallow tree (three leaves) to the logistic gradients summed by bin and adds a share of its leaves
to that feature's lookup table. With those fixed, pairs of features are ranked by what a tree over both could still gain on a coarse
grid, and the best ``PAIRS`` get tables of their own from trees of four leaves. A score is the logistic function of the sum of
table entries, looked up for a batch of texts at once.

Learned from a bounded sample (``SAMPLE`` labelled rows at most, lowest hash of the id first) of rows outside the
held-out fold; their features are made on the executors and only those numbers are gathered. Labels, lang,
source and doc_id are no inputs of a score. Texts of any length are read whole, in time linear in their length.

Null, empty and wordless texts have the features of a text without characters and the score that those get. With no
labels, or of one kind only, every text scores 1/2, 0.99 or 0.01. Repeated rows repeat; rows with a null label and
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PORTION, arrow_ddl

SAMPLE, THRESHOLD, FOLDS, HELD_OUT = 20_000, 0.3, 5, 0
BINS, ROUNDS, RATE, RIDGE = 32, 150, 0.15, 1.0
PAIRS, PAIR_ROUNDS, COARSE = 8, 40, 8

FEATURES = (
    "log characters", "log words", "mean word", "letters", "capitals", "digits", "marks", "symbols", "line breaks", "most capitals of a line",
    "most symbols of a line", "most marks of a line", "different words", "commonest word", "words that repeat the one before", "longest repetition", "repeated lines", "words that end in a symbol", "long words",
)

#: Classes of characters: blank, letter, capital, digit, punctuation mark, symbol, line break.
_BLANK, _LETTER, _CAPITAL, _DIGIT, _MARK, _SYMBOL, _BREAK = range(7)


def _class_of(code: int) -> int:
    c = chr(code)
    if c == "\n":
        return _BREAK
    if c.isspace():
        return _BLANK
    if c.isalpha():
        return _CAPITAL if c.isupper() else _LETTER
    return _DIGIT if c.isdigit() else _MARK if c in ".,;:'\"-()?¿¡«»“”„’" else _SYMBOL


#: By code point; those beyond the table count as letters.
_CLASSES = np.array([_class_of(c) for c in range(0x3000)], np.uint8)


def features(text: str | None) -> tuple[float, ...]:
    """In the order of FEATURES."""
    text = text or ""
    words = text.split()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.where(codes < len(_CLASSES), _CLASSES[np.minimum(codes, len(_CLASSES) - 1)], np.uint8(_LETTER))
    n, k = len(codes), len(words)
    if not k:
        return (math.log1p(n), *[0.0] * (len(FEATURES) - 1))
    letters, capitals, digits, marks, symbols, breaks = (int(x) for x in np.bincount(kinds, minlength=7)[1:])
    starts = np.concatenate(([0], np.flatnonzero(kinds[:-1] == _BREAK) + 1))
    sizes = np.add.reduceat((kinds != _BLANK).astype(np.int32), starts) + 4  # so that the shortest lines do not decide
    worst = [float((np.add.reduceat((kinds == x).astype(np.int32), starts) / sizes).max()) for x in (_CAPITAL, _SYMBOL, _MARK)]
    often = Counter(words)
    same = list(map(eq, words, words[1:]))
    longest = max((len(x) for x in "".join("x" if s else " " for s in same).split()), default=0) if any(same) else 0
    lines = text.split("\n")
    ends = sum(1 for w, c in often.items() for _ in range(c) if _CLASSES[min(ord(w[-1]), len(_CLASSES) - 1)] == _SYMBOL)
    return (
        math.log1p(n), math.log1p(k), sum(map(len, words)) / k, (letters + capitals) / n, capitals / max(letters + capitals, 1), digits / n, marks / n, symbols / n, breaks / n, *worst,
        len(often) / k, max(often.values()) / k, sum(same) / k, math.log1p(longest), 1 - len({*lines}) / len(lines), ends / k, sum(1 for w in words if len(w) > 18) / k,
    )


@dataclass
class Model:
    base: float = 0.0
    #: By feature: upper edges of all bins but the last, and the bins' values.
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    #: Two features, what coarse bin each of their bins is in, and the values by coarse bins.
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        z, at = np.full(len(x), self.base), self.bins(x)
        for table, own in zip(self.tables, at, strict=True):
            z += table[own]
        for i, j, of_i, of_j, table in self.pairs:
            z += table[of_i[at[i]], of_j[at[j]]]
        return _logistic(z)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Leaf values by bin: the bins are cut in two, and then the part whose cut gains most, up to so many leaves."""
    sums = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))

    def cut(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, lo
        at = np.arange(lo + 1, hi)
        left, right = (_gain(sums[0][b] - sums[0][a], sums[1][b] - sums[1][a]) for a, b in ((lo, at), (at, hi)))
        gains = left + right - _gain(sums[0][hi] - sums[0][lo], sums[1][hi] - sums[1][lo])
        best = int(np.argmax(gains))
        return float(gains[best]), int(at[best])

    parts = [(0, len(g))]
    while len(parts) < leaves:
        found = [(*cut(*p), p) for p in parts]
        gain, at, (lo, hi) = max(found, key=lambda x: (x[0], -x[2][0]))
        if gain <= 1e-9:
            break
        parts.remove((lo, hi))
        parts += [(lo, at), (at, hi)]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = -(sums[0][hi] - sums[0][lo]) / (sums[1][hi] - sums[1][lo] + RIDGE)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values over a grid: cut by rows, and each part by columns where that gains most."""

    def halves(lo: int, hi: int) -> tuple[float, np.ndarray]:
        values = _tree(g[lo:hi].sum(0), h[lo:hi].sum(0), 2)
        first = int(np.argmax(values != values[0])) or len(values)
        return sum(float(_gain(g[lo:hi, a:b].sum(), h[lo:hi, a:b].sum())) for a, b in ((0, first), (first, len(values))) if a < b), values

    whole, best = float(_gain(g.sum(), h.sum())), (0.0, np.zeros(g.shape))
    for at in range(1, len(g)):
        (up, above), (low, below) = halves(0, at), halves(at, len(g))
        if up + low - whole > best[0]:
            best = up + low - whole, np.vstack((np.tile(above, (at, 1)), np.tile(below, (len(g) - at, 1))))
    return best


def _coarse(own: np.ndarray, n_bins: int) -> np.ndarray:
    """Coarse bin of each bin, of about equal numbers of rows."""
    below = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=n_bins))[:-1])) / max(len(own), 1)
    return np.minimum((below * COARSE).astype(np.int64), COARSE - 1)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, n_pairs: int = PAIRS, pair_rounds: int = PAIR_ROUNDS) -> Model:
    """x: rows by features; y: 0 or 1."""
    if not len(y) or y.min() == y.max():
        return Model(0.0 if not len(y) else math.log(99) * (1 if y[0] else -1), [np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES))
    edges = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS, method="lower")) for c in x.T]
    edges = [e[e < c.max()] for e, c in zip(edges, x.T, strict=True)]
    model = Model(float(np.log(y.mean() / (1 - y.mean()))), edges, [np.zeros(len(e) + 1) for e in edges])
    at, z = model.bins(x), np.full(len(y), model.base)
    for _ in range(rounds):
        for i, own in enumerate(at):
            p = _logistic(z)
            values = RATE * _tree(*(np.bincount(own, v, len(edges[i]) + 1) for v in (p - y, p * (1 - p))))
            model.tables[i] += values
            z += values[own]
    p = _logistic(z)
    coarse = [_coarse(own, len(e) + 1) for own, e in zip(at, edges, strict=True)]
    cell = lambda i, j: coarse[i][at[i]] * COARSE + coarse[j][at[j]]
    grid = lambda c, v: np.bincount(c, v, COARSE * COARSE).reshape(COARSE, COARSE)
    ranked = sorted(combinations(range(len(edges)), 2), key=lambda ij: -_pair_tree(grid(c := cell(*ij), p - y), grid(c, p * (1 - p)))[0])[:n_pairs]
    cells, tables = [cell(*ij) for ij in ranked], [np.zeros((COARSE, COARSE)) for _ in ranked]
    for _ in range(pair_rounds):
        for c, table in zip(cells, tables, strict=True):
            p = _logistic(z)
            values = RATE * _pair_tree(grid(c, p - y), grid(c, p * (1 - p)))[1]
            table += values
            z += values.ravel()[c]
    model.pairs = [(i, j, coarse[i], coarse[j], t) for (i, j), t in zip(ranked, tables, strict=True)]
    return model


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _portions(batches: Iterator[pa.RecordBatch], of: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, PORTION):
            part = batch.slice(start, PORTION)
            yield part, np.array([features(t) for t in part.column(of).to_pylist()])


_ROW = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("x", pa.list_(pa.float64()))])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("int").alias("label")).distinct()
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _portions(batches, 2):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], schema=_ROW)

    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    rows = joined.mapInArrow(run, "doc_id bigint, label int, x array<double>").groupBy("doc_id", "label").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.label))
    return fit(np.array([r.x for r in rows]).reshape(-1, len(FEATURES)), np.array([float(r.label > 0) for r in rows]))


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _portions(batches, 2):
            s = sent.value.score(x)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], schema=OUT)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, arrow_ddl(OUT))


def terms(spark: SparkSession, model: Model) -> DataFrame:
    """What the model adds to the log-odds: feature, second (null for a feature alone), low, high (open bounds null; of a pair's coarse bins the numbers), value."""
    rows = []
    for name, edges, table in zip(FEATURES, model.edges, model.tables, strict=True):
        bounds = [None, *map(float, edges), None]
        rows += [(name, None, bounds[i], bounds[i + 1], float(v)) for i, v in enumerate(table)]
    rows += [(FEATURES[i], FEATURES[j], float(a), float(b), float(t[a, b])) for i, j, _, _, t in model.pairs for a in range(COARSE) for b in range(COARSE)]
    return spark.createDataFrame(rows, "feature string, second string, low double, high double, value double")
