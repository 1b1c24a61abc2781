"""Exact removal of every byte covered by a ``length``-byte string that starts anywhere else too.

Texts are parsed at rolling-hash triggers (see ``pfp``); the shares of the triggers are the phrases,
and the parse places them. Corpus order is needed only down to ``length`` bytes, and only as far
as equality goes, so suffixes are not sorted: equal prefixes of that order are found
by classes of hashes, coarse to fine.

1. Phrases whose trigger occurs once hold no repeat. Of the others, those whose whole
   stretch equals another's are repeats as they are.
2. What is left are the borders of repeats. One phrase of each class is taken, with its bytes, and
   cut into blocks of ``FINE`` window starts by the distance to the trigger. A block
   is done if it equals another; it goes if the bytes that all its windows share occur once.
3. The windows of blocks still left are compared one by one.

Beside that, passages of more than 50 words that stand in another document, which may have fewer bytes and then are not removed, are counted in words (see ``passages``).

Every step groups by 128 bits of hash (a row is known by 78), with partial sums before the shuffle, so a passage
that a third of the corpus holds is one row a task. No step gathers a group.

Null or empty text: no bytes, no spans. Texts under ``length`` bytes keep all. Rows
that repeat a doc_id and its text count as texts of their own. Empty table: empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import passages
from .common import PORTION, arrow_ddl, cut, release
from .pfp import STRETCH, Hashed, blocks, mix, shares

LENGTH, FINE = 400, 8
_NODES = pa.schema([("g", pa.int64()), ("f", pa.int64()), ("rid", pa.int64()), ("at", pa.int64()), ("words", pa.bool_())])
_CONTEXT = pa.schema([("rid", pa.int64()), ("at", pa.int64()), ("done", pa.bool_()), ("bytes", pa.binary()), ("g", pa.int64()), ("f", pa.int64())])
_FINE = pa.schema([("g", pa.int64()), ("f", pa.int64()), ("rid", pa.int64()), ("at", pa.int64()), ("done", pa.bool_()), ("node", pa.int64())])
_WINDOWS = pa.schema([("g", pa.int64()), ("f", pa.int64()), ("rid", pa.int64()), ("at", pa.int64()), ("done", pa.bool_())])
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_passage_words", pa.int64())])

# A run of window starts in one integer: 14 bits of the row's second hash, 31 bits of the first start (no string is
# longer), 9 bits of (last - first), 9 bits of (trigger - first). A row is known by its 64-bit rid and these 14 bits.
_TAG, _START = 49, (1 << 31) - 1


def _pack(tag: int, trigger: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return tag << _TAG | lo << 18 | (hi - lo) << 9 | (trigger - lo)


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lo = at >> 18 & _START
    return lo + (at & 511), lo, lo + (at >> 9 & 511)


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _emit(parts: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [np.concatenate(c) if len(parts) else np.zeros(0, np.int64) for c in (zip(*parts, strict=True) if parts else [()] * len(schema))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _mapped(df: DataFrame, schema: pa.Schema, one: Callable[..., Iterator[tuple]]) -> DataFrame:
    """``one`` makes tuples of arrays from a row's values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PORTION):
                rows = zip(*(c.to_pylist() for c in batch.slice(start, PORTION).columns), strict=True)
                yield _emit([p for row in rows for p in one(*row)], schema)

    return df.mapInArrow(run, arrow_ddl(schema))


def _hash_with(core: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    return mix(core ^ (near.astype(np.uint64) << np.uint64(20) | far.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))


def _phrases(rid: int, tag: int, text: str | None, length: int) -> Iterator[tuple]:
    """Phrases of bytes, and those of words."""
    data, hashed = np.frombuffer((text or "").encode(), np.uint8), None
    for start in range(0, len(data) - length + 1, STRETCH):
        part = data[start : start + STRETCH + length - 1]
        hashed = Hashed(part)
        trigger, lo, hi = shares(hashed, len(part), length)
        key = hashed(trigger, trigger + 64, 0)
        whole = _hash_with(hashed(lo, hi + length, 1), trigger - lo, hi - lo)
        yield _as_long(key), _as_long(whole), np.full(len(lo), rid), _pack(tag, trigger + start, lo + start, hi + start), np.zeros(len(lo), bool)
    for g, f, trigger, lo, hi in passages.word_phrases(data, hashed if len(data) < STRETCH + length else None):
        yield g, f, np.full(len(lo), rid), _pack(tag, trigger, lo, hi), np.ones(len(lo), bool)


def _contexts(text: str | None, rid: int, wanted: list, length: int) -> Iterator[tuple]:
    """The bytes of each wanted phrase's stretch; of phrases of words each window, by its hashes."""
    at, done, words = (np.array([w[k] for w in wanted], t) for k, t in (("at", np.int64), ("done", bool), ("words", bool)))
    _, lo, hi = _unpack(at)
    if not words.all():
        data, of = (text or "").encode(), np.flatnonzero(~words)
        none = np.zeros(len(of), np.int64)
        yield np.full(len(of), rid), at[of], done[of], np.array([data[lo[i] : hi[i] + length] for i in of.tolist()], object), none, none
    if words.any():
        hashed, of = passages.WordHashes(np.frombuffer(text.encode(), np.uint8)), np.flatnonzero(words)
        p = np.concatenate([np.arange(lo[i], hi[i] + 1) for i in of.tolist()])
        times, stop = (hi - lo + 1)[of], p + passages.WORDS
        yield np.full(len(p), rid), _pack(int(at[0]) >> _TAG, p, p, p), np.repeat(done[of], times), np.full(len(p), None, object), _as_long(hashed(p, stop, 0)), _as_long(hashed(p, stop, 1))


def _fine_blocks(rid: int, at: int, done: bool, data: bytes, length: int) -> Iterator[tuple]:
    """Blocks of one phrase: key (the bytes that all windows of the uncut block share), class (its whole stretch)."""
    trigger, lo, hi = _unpack(np.array([at], np.int64))
    first, tag = int(lo[0]), at >> _TAG
    hashed = Hashed(np.frombuffer(data, np.uint8))
    t, a, b, j = blocks(trigger - first, lo - first, hi - first, FINE)
    key = _hash_with(hashed(t - j * FINE, t - (j + 1) * FINE + 1 + length, 0), j, j)
    whole = _hash_with(hashed(a, b + length, 1), t - a, b - a)
    yield _as_long(key), _as_long(whole), np.full(len(t), rid), _pack(tag, t + first, a + first, b + first), np.full(len(t), done), np.full(len(t), at)


def _windows(rid: int, at: int, data: bytes, wanted: list, length: int) -> Iterator[tuple]:
    first = at >> 18 & _START
    hashed = Hashed(np.frombuffer(data, np.uint8))
    for w in wanted:
        _, lo, hi = _unpack(np.array([w["at"]], np.int64))
        p = np.arange(lo[0], hi[0] + 1) - first
        alone = _pack(at >> _TAG, p + first, p + first, p + first)
        yield _as_long(hashed(p, p + length, 0)), _as_long(hashed(p, p + length, 1)), np.full(len(p), rid), alone, np.full(len(p), w["done"])


def _classes(rows: DataFrame, *kept: str) -> DataFrame:
    """A row a class (g, f): how many rows, whether one is done, one of them."""
    done = F.max("done") if "done" in rows.columns else F.lit(False)
    return rows.groupBy("g", "f").agg(F.count("*").alias("n"), done.alias("had"), F.min(F.struct("rid", "at", *kept)).alias("one"))


def _left(classes: DataFrame) -> DataFrame:
    """One row of each class whose key has several classes, one of them still undecided."""
    mixed = classes.groupBy("g").agg(F.count("*").alias("k"), F.max((F.col("n") == 1) & ~F.col("had")).alias("open")).where("k > 1 and open")
    mixed = cut(mixed.select("g"))
    return classes.join(mixed, "g", "left_semi").select("one.*", ((F.col("n") > 1) | F.col("had")).alias("done"))


def _shared_words(phrases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Phrases of words that another document has too (rid, at), and those whose windows are to be compared (rid, at, done)."""
    kinds = cut(passages.kinds_of(phrases))
    whole = phrases.join(kinds.where("shared").select("g", "f"), ["g", "f"], "left_semi").select("rid", "at")
    mixed = kinds.join(cut(passages.mixed_keys(kinds)), "g", "left_semi")
    alone = phrases.join(mixed.where("not shared").select("g", "f"), ["g", "f"], "left_semi").select("rid", "at", F.lit(False).alias("done"))
    return whole, alone.unionByName(mixed.where("shared").select("one.*", F.lit(True).alias("done")))


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """rid, tag, spans (packed runs of windows of bytes that occur elsewhere too), passages (those of windows of words that another document has). docs: rid, tag, text."""
    nodes = cut(_mapped(docs.select("rid", "tag", "text"), _NODES, lambda *row: _phrases(*row, length)))
    often = cut(nodes.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"))  # written, so that the join may split a frequent trigger's rows
    shared = cut(nodes.join(often, "g", "left_semi"))
    release(nodes, often)
    in_two, words_asked = _shared_words(shared.where("words").drop("words"))
    shared = shared.where("not words").drop("words")
    classes = cut(_classes(shared))
    whole = shared.join(classes.where("n > 1").select("g", "f"), ["g", "f"], "left_semi").select("rid", "at")

    asked = _left(classes).withColumn("words", F.lit(False)).unionByName(words_asked.withColumn("words", F.lit(True)))
    asked = asked.groupBy("rid", F.shiftright("at", _TAG).alias("tag")).agg(F.collect_list(F.struct("at", "done", "words")).alias("wanted"))
    contexts = cut(_mapped(docs.join(asked, ["rid", "tag"]).select("text", "rid", "wanted"), _CONTEXT, lambda text, rid, wanted: _contexts(text, rid, wanted, length)))
    of_bytes = contexts.where("bytes is not null").select("rid", "at", "done", "bytes")
    fine = cut(_mapped(of_bytes, _FINE, lambda *row: _fine_blocks(*row, length)))
    fine_classes = cut(_classes(fine, "node"))
    equal = fine.where("not done").join(fine_classes.where("n > 1").select("g", "f"), ["g", "f"], "left_semi").select("rid", "at")

    asked = _left(fine_classes).groupBy("rid", F.col("node").alias("at")).agg(F.collect_list(F.struct("at", "done")).alias("wanted"))
    single = cut(_mapped(of_bytes.join(asked, ["rid", "at"]).select("rid", "at", "bytes", "wanted"), _WINDOWS, lambda *row: _windows(*row, length)))
    again = cut(single.groupBy("g", "f").agg(F.count("*").alias("n")).where("n > 1").select("g", "f"))
    ones = single.where("not done").join(again, ["g", "f"], "left_semi").select("rid", "at")

    windows = contexts.where("bytes is null")
    elsewhere = cut(windows.groupBy("g", "f").agg(F.min("rid").alias("a"), F.max("rid").alias("b"), F.max("done").alias("had")).where("a != b or had").select("g", "f"))  # what had been shared is in some other document
    told = cut(windows.where("not done").join(elsewhere, ["g", "f"], "left_semi").select("rid", "at"))
    release(contexts, elsewhere)
    removed = whole.unionByName(equal).unionByName(ones).select("rid", "at", F.lit(False).alias("words"))
    found = removed.unionByName(in_two.unionByName(told).select("rid", "at", F.lit(True).alias("words")))
    lists = (F.collect_list(F.when(F.col("words") == words, F.col("at"))).alias(name) for name, words in (("spans", False), ("passages", True)))
    return found.groupBy("rid", F.shiftright("at", _TAG).alias("tag")).agg(*lists)


def _kept(data: bytes, spans: list, length: int) -> tuple[bytes, int]:
    """The bytes outside all spans, and the number of maximal removed runs."""
    out, n, at = [], 0, 0
    _, first, last = _unpack(np.array(spans, np.int64))
    for lo, hi in sorted(zip(first.tolist(), (last + length).tolist(), strict=True)):
        if lo > at or not n:
            out.append(data[at:lo])
            n += 1
        at = max(at, hi)
    return b"".join([*out, data[at:]]), n


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"), F.pmod(F.hash("text", "doc_id"), F.lit(1 << 14)).cast("bigint").alias("tag"))


def _applied(docs: DataFrame, schema: pa.Schema, one: Callable[..., tuple], length: int) -> DataFrame:
    own = _numbered(docs)
    found = repeats(own, length)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, PORTION):
                rows = []
                for doc_id, text, spans, words in zip(*(c.to_pylist() for c in batch.slice(start, PORTION).columns), strict=True):
                    data = (text or "").encode()
                    kept = _kept(data, spans, length) if spans else (data, 0)
                    rows.append(one(doc_id, data, *kept, passages.covered(*_unpack(np.array(words, np.int64))[1:]) if words else 0))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return own.join(found, ["rid", "tag"], "left").select("doc_id", "text", "spans", "passages").mapInArrow(run, arrow_ddl(schema))


def dedup_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words (words in passages of more than 50 words that another document has too)."""
    return _applied(docs, OUT, lambda d, data, kept, n, words: (d, len(data), len(data) - len(kept), n, sha256(kept).hexdigest(), words), length)


def dedup_texts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, text without the repeats; bytes of a character cut in two become U+FFFD."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    return _applied(docs, schema, lambda d, data, kept, n, words: (d, kept.decode("utf-8", "replace")), length)
