"""Benchmark decontamination: BM25 with block-max WAND over an inverted index of the test items.

The test items are the indexed side; every passage of every training document
is a query. Items fall into classes by length (``STEP`` words, then twice as many, and so on); for each class a passage is two
neighbouring steps of as many words, so an item that a document contains lies whole in one of them and a long item
makes no short one's passages longer. BM25 weights are divided by the item's own full score, so that one threshold
holds for all items and 1 is a complete match. Items of like length stand in blocks; each term keeps its largest weight in the
class and in every block.

Retrieval: passages drop out whose terms' largest weights sum to less than the threshold, then those of
which no block's do (both for a text at once, with numpy). In the others cursors walk the terms' postings in item order: the pivot is
the first item at which the largest weights of the lists up to it reach the threshold, it is scored if the maxima of its
block reach it too, and all lists up to the pivot are moved past what cannot reach it. Nothing above the
threshold is missed. What is found is verified: the shares of the question's and of the answer's
five-word shingles that occur in the passage. An item's answer is its last
sentence if there are two or more, else it has only a question. Of passages with equal scores the first counts.

The items are read in shards of about ``SHARD`` items, one pass over the
documents each, so what is sent to the executors is bounded. Numbers of items by term, number and mean length of
items are those of the whole benchmark, so a score does not depend on the shard. Null or empty
texts and items without a word match nothing; items without an item_id are matched like others; equal items each get their row; texts of any
length are read whole, in time linear in their length; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PORTION, arrow_ddl, cut, filter_rows

K1, B, THRESHOLD, OVERLAP, WORDS = 1.2, 0.75, 0.5, 0.8, 5
SHARD, BLOCK, STEP = 10_000, 4, 48
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
TERMS = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("length", pa.int64())])


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(ids: list[int], n: int = WORDS) -> set[tuple[int, ...]]:
    return {tuple(ids[i : i + n]) for i in range(len(ids) - n + 1)} if len(ids) >= n else {tuple(ids)} if ids else set()


def shingles_of(seen: list, n: int) -> set[tuple]:
    """All shingles of n words."""
    return {tuple(seen[i : i + n]) for i in range(len(seen) - n + 1)}


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    parts = [p for p in _SENTENCE.split((text or "").strip()) if _WORD.search(p)]
    return (words(" ".join(parts[:-1])), words(parts[-1])) if len(parts) > 1 else (words(text), [])


class Postings:
    """Items of one class of lengths: per term the items and weights in item order, and the largest weights of all and by block."""

    def __init__(self, step: int, n_terms: int, rows: list[tuple[int, int, float]], block: int = BLOCK):
        """rows: term, item (numbered from 0 in order of length), weight."""
        rows = sorted(rows)
        self.step, self.block = step, block
        self.items, self.weights = [r[1] for r in rows], [r[2] for r in rows]
        ends = np.cumsum(np.bincount([r[0] for r in rows], minlength=n_terms)).tolist()
        self.at = list(zip([0, *ends[:-1]], ends, strict=True))
        largest: dict[tuple[int, int], float] = {}
        for t, k, w in rows:
            largest[t, k // block] = max(w, largest.get((t, k // block), 0.0))
        self.largest = largest
        keys = np.array(sorted(largest), np.int64).reshape(-1, 2)
        self.block_of, self.block_most = keys[:, 1], np.array([largest[t, j] for t, j in keys.tolist()])
        self.block_end = np.cumsum(np.bincount(keys[:, 0], minlength=n_terms))
        self.n_blocks = int(self.block_of.max(initial=-1)) + 1
        self.most = np.zeros(n_terms)
        np.maximum.at(self.most, keys[:, 0], self.block_most)

    def worth(self, passages: np.ndarray, terms: np.ndarray, threshold: float) -> np.ndarray:
        """Which of the passages have a block whose largest weights reach the threshold. passages, terms: pairs, by passage."""
        own, row = np.unique(passages, return_inverse=True)
        out = []
        for lo in range(0, len(own), 128):  # so many passages' sums by block at once
            part = slice(*np.searchsorted(row, (lo, lo + 128)))
            t, p = terms[part], row[part] - lo
            stop, start = self.block_end[t], np.where(t > 0, self.block_end[t - 1], 0)
            n = stop - start
            at = np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)
            sums = np.bincount(np.repeat(p, n) * self.n_blocks + self.block_of[at], self.block_most[at], 128 * self.n_blocks)
            out.append(np.flatnonzero((sums >= threshold).reshape(128, -1).any(axis=1)) + lo)
        return own[np.concatenate(out)] if out else own

    def retrieve(self, terms: list[int], threshold: float) -> Iterator[tuple[int, float]]:
        """Every item whose score for the distinct terms reaches the threshold, and its score, by block-max WAND."""
        least = threshold - 1e-9  # sums of bounds are rounded
        cursors = [[self.items[a], a, b, float(self.most[t]), t] for t in terms for a, b in (self.at[t],) if a < b]
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, 0
            for pivot, c in enumerate(cursors):
                bound += c[3]
                if bound >= least:
                    break
            else:
                return
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            upto, block = cursors[: pivot + 1], item // self.block
            if sum(self.largest.get((c[4], block), 0.0) for c in upto) < least:
                to = min([(block + 1) * self.block, *(c[0] for c in cursors[pivot + 1 : pivot + 2])])
            elif cursors[0][0] == item:
                score, to = math.fsum(self.weights[c[1]] for c in upto), item + 1
                if score >= threshold:
                    yield item, score
            else:
                to = item
            for c in upto:
                if c[0] < to:
                    c[1] = bisect_left(self.items, to, c[1], c[2])
                    c[0] = self.items[c[1]] if c[1] < c[2] else -1
            cursors = [c for c in cursors if c[0] >= 0]


class BlockMaxIndex:
    """Of some items. whole: number of items, sum of their lengths, items by term, if the benchmark has more than these."""

    def __init__(self, items: list[tuple[int | None, str | None]], k1: float = K1, b: float = B, block: int = BLOCK, whole: tuple[int, int, dict[str, int]] | None = None):
        parted = sorted(((i, *question_and_answer(t)) for i, t in items if words(t)), key=lambda x: (len(x[1]) + len(x[2]), x[0] is None, x[0] or 0, x[1:]))
        bags = [Counter(q + a) for _, q, a in parted]
        lengths = [sum(x.values()) for x in bags]
        n, total, df = whole or (len(bags), sum(lengths), Counter(t for x in bags for t in x))
        mean = total / max(n, 1)
        self.terms = {t: k for k, t in enumerate(sorted({t for x in bags for t in x}))}
        rows: dict[int, list] = defaultdict(list)
        self.items: dict[int, list] = defaultdict(list)
        for (i, q, a), bag, length in zip(parted, bags, lengths, strict=True):
            step = STEP << max(0, (length - 1) // STEP).bit_length()
            weight = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)) for t, tf in bag.items()}
            full = math.fsum(weight.values())
            rows[step] += [(self.terms[t], len(self.items[step]), w / full) for t, w in weight.items()]
            self.items[step].append((i, *(shingles([self.terms[w] for w in ws]) for ws in (q, a))))
        self.classes = [Postings(step, len(self.terms), x, block) for step, x in sorted(rows.items())]

    def matches(self, text: str | None, threshold: float, overlap: float) -> Iterator[tuple[int | None, float, float, float]]:
        """item_id, score, overlaps of each verified item, by its best passage."""
        seen = words(text)
        if not seen or not self.terms:
            return
        ids = np.fromiter(map(self.terms.get, seen, repeat(-1)), dtype=np.int64, count=len(seen))
        at = np.flatnonzero(ids >= 0)
        if len(at):
            for own in self.classes:
                yield from self._matches(own, ids, at, threshold, overlap)

    def _matches(self, own: Postings, ids: np.ndarray, at: np.ndarray, threshold: float, overlap: float) -> Iterator[tuple[int | None, float, float, float]]:
        v, step, least = len(self.terms), own.step, threshold - 1e-9
        keys = at // step * v + ids[at]
        keys = np.unique(np.concatenate((keys, keys[keys >= v] - v)))  # the distinct terms of each passage, which begins with a step
        passages, terms = keys // v, keys % v
        live = np.bincount(passages, own.most[terms])[passages] >= least
        passages, terms = passages[live], terms[live]
        best: dict[int, tuple[float, float, float]] = {}
        for p in own.worth(passages, terms, least).tolist():
            have = terms[slice(*np.searchsorted(passages, (p, p + 1)))]
            here, found = ids[p * step : (p + 2) * step], None
            for k, score in own.retrieve(have.tolist(), threshold):
                if score > best.get(k, (0.0,))[0]:
                    found = found or shingles_of(here.tolist(), WORDS) | {()}
                    q, a = (self.share(x, found, here) for x in self.items[step][k][1:])
                    if q >= overlap and a >= overlap:
                        best[k] = score, q, a
        for k, x in sorted(best.items()):
            yield self.items[step][k][0], *x

    @staticmethod
    def share(wanted: set, found: set, ids: np.ndarray) -> float:
        """Share of the shingles that occur; shorter ones are sought as they are."""
        if not wanted:
            return 1.0
        n = len(next(iter(wanted)))
        return len(wanted & (found if n == WORDS else shingles_of(ids.tolist(), n))) / len(wanted)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different terms of each item, and its length with the first of them."""
    for batch in batches:
        rows = []
        for shard, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            bag = Counter(x for part in question_and_answer(text) for x in part)
            rows += [(shard, t, 0 if k else sum(bag.values())) for k, t in enumerate(bag)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(TERMS.types)], schema=TERMS)


def _shards(benchmark: DataFrame) -> Iterator[BlockMaxIndex]:
    items = benchmark.select("item_id", "text")
    n = -(-max(items.count(), 1) // SHARD)
    of = F.pmod(F.xxhash64("item_id"), F.lit(n))
    whole = None
    if n > 1:
        terms = items.select(of.alias("shard"), "text").mapInArrow(_terms, arrow_ddl(TERMS))
        firsts = F.col("length") > 0
        by_term = cut(terms.groupBy("term").agg(F.count("*").alias("df"), F.collect_set("shard").alias("shards"), F.count_if(firsts).alias("n"), F.sum("length").alias("total")))
        whole = by_term.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    for shard in range(n):
        own = whole and (*whole, dict(by_term.where(F.array_contains("shards", F.lit(shard).cast("bigint"))).select("term", "df").collect()))
        yield BlockMaxIndex([tuple(r) for r in items.where(of == shard).orderBy("item_id", "text").collect()], whole=own)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap for every verified match."""
    out = []
    for index in _shards(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            own = sent.value
            for part in (b.slice(at, PORTION) for b in batches for at in range(0, b.num_rows, PORTION)):
                rows = [(d, *m) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for m in own.matches(t, threshold, overlap)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(OUT.types)], schema=OUT)

        out.append(docs.select("doc_id", "text").mapInArrow(run, arrow_ddl(OUT)))
    return reduce(DataFrame.unionByName, out)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The documents that match no test item, columns unchanged."""
    for index in _shards(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)
        docs = filter_rows(docs, "text", lambda sent=sent: lambda text: next(sent.value.matches(text, threshold, overlap), None) is None)
    return docs
