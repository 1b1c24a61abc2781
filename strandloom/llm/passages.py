"""Passages of more than 50 words that stand in another document too, counted in words.

Texts are parsed as in ``pfp``, over words in place of bytes: the trigger of ``WORDS`` words in a row is their run of ``GRAM`` words of the least hash, and
the windows in a row with one trigger are a phrase. Triggers that occur once go first, by their hashes only; so what is kept is the phrases of repeated stretches.
A phrase whose whole stretch stands in two documents is shared; where a trigger has phrases of several kinds, the windows of those that are not shared are compared
one by one. Words are what stands between blanks, known by 64 bits of hash; a phrase or window by 128. Rows with the same doc_id and text are one document here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pfp
from .pfp import STRETCH, Hashed, mix, sliding_least

WORDS, GRAM = 51, 8
_PLACE = np.uint64((1 << 24) - 1)
#: Longer words are hashed by themselves, as strings of Thue and Morse collide modulo 2^64 from some 1,000 letters on.
_LONG = 512
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def word_hashes(data: np.ndarray, hashed: Hashed | None = None) -> np.ndarray:
    """A hash of each word. data: UTF-8; hashed: its hashes, if at hand."""
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = _BLANK[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    start, stop = edges[::2], edges[1::2]
    if hashed is None and len(data) <= STRETCH:
        hashed = Hashed(data)
    if hashed is not None:
        out = hashed(start, stop, 0)
    else:
        out, i = np.zeros(len(start), np.uint64), 0
        while i < len(start):
            at = int(start[i])
            end = max(i + 1, int(np.searchsorted(stop, at + STRETCH, "right")))
            if stop[end - 1] - at <= STRETCH:
                out[i:end] = Hashed(data[at : stop[end - 1]])(start[i:end] - at, stop[i:end] - at, 0)
            i = end
    for i in np.flatnonzero(stop - start > _LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(data[start[i] : stop[i]].tobytes())
    return out


class WordHashes:
    """Hashes of any stretch of the words, of less than 100 or so."""

    def __init__(self, data: np.ndarray, hashed: Hashed | None = None):
        x = word_hashes(data, hashed)
        self.n = len(x)
        pfp._grow(self.n)
        self.sums = []
        for i in range(2):
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum((mix(x) if i else x) * pfp._powers[i][: self.n], out=s[1:])
            self.sums.append(s)

    def __call__(self, start: np.ndarray, stop: np.ndarray, which: int) -> np.ndarray:
        return mix((self.sums[which][stop] - self.sums[which][start]) * pfp._inverse[which][start])

    def phrases(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Trigger, first and last window start of each phrase, by stretches of the text that overlap by a window."""
        for start in range(0, self.n - WORDS + 1, STRETCH):
            p = np.arange(min(self.n - start, STRETCH + WORDS - 1) - GRAM + 1)
            keys = (self(start + p, start + p + GRAM, 0) & ~_PLACE) | p.astype(np.uint64)
            at = start + (sliding_least(keys, WORDS - GRAM + 1) & _PLACE).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            yield at[first], start + first, start + np.concatenate((first[1:] - 1, [len(at) - 1]))


def word_phrases(data: np.ndarray, hashed: Hashed | None = None) -> Iterator[tuple]:
    """g (of the trigger), f (of the whole stretch), trigger, first and last start of each phrase of a text."""
    if len(data) < 2 * WORDS - 1:
        return
    hashed = WordHashes(data, hashed)
    for trigger, lo, hi in hashed.phrases():
        stretch = hashed(lo, hi + WORDS, 1) ^ mix((trigger - lo).astype(np.uint64) << np.uint64(20) | (hi - lo).astype(np.uint64))
        yield hashed(trigger, trigger + GRAM, 0).view(np.int64), stretch.view(np.int64), trigger, lo, hi


def kinds_of(phrases: DataFrame) -> DataFrame:
    """g, f, a and b (its first and last document), shared (in two documents at least), one (a phrase of it)."""
    found = phrases.groupBy("g", "f").agg(F.min("rid").alias("a"), F.max("rid").alias("b"), F.min(F.struct("rid", "at")).alias("one"))
    return found.withColumn("shared", F.col("a") != F.col("b"))


def mixed_keys(kinds: DataFrame) -> DataFrame:
    """g of triggers in two documents with a kind that is not shared."""
    by = kinds.groupBy("g").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("shared").alias("all_shared"))
    return by.where("a != b and not all_shared").select("g")


def covered(lo: np.ndarray, hi: np.ndarray) -> int:
    """Words in any of the windows from first (lo) to last (hi) starts."""
    n, at = 0, 0
    for lo, hi in sorted(zip(lo.tolist(), hi.tolist(), strict=True)):
        n += max(0, hi + WORDS - max(lo, at))
        at = max(at, hi + WORDS)
    return n
