"""Words that stand in one entry or group only, and those that stand in several: told by tables over all words of up to ``LETTERS`` letters, without a row a place.

A task notes of each word whose it was first and whether it was another's too; the tables of the tasks are put together block by block, and what a word is
can then be sent around as a bit. Only words of A, C, G and T count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kmers import _codes, _spelt, far_pieces

#: The longest words that a task keeps tables of (4^LETTERS cells), and words of a block of the tables that are put together.
LETTERS, BLOCK = 12, 1 << 17


def one_row_each(sequences: DataFrame) -> bool:
    """Whether every entry is one row, so that all of it is read by one task."""
    return sequences.groupBy("entry_id").count().where("count > 1").isEmpty()


def _noted(first: np.ndarray, again: np.ndarray, code: np.ndarray, whose: np.ndarray) -> None:
    """first: whose each word was first, -1 of none; again: whether it was another's too."""
    fresh = first[code] < 0
    if fresh.any():
        first[code[fresh][::-1]] = whose[fresh][::-1]  # the first of them is written last
    again[code[first[code] != whose]] = True


def owners(sequences: DataFrame, m: int) -> tuple[np.ndarray, np.ndarray]:
    """seen, again: of all words of m letters, by number, whether they stand in the sequences, and in two entries at least. With a column group (numbers from 0): in two groups.

    Without groups every entry must be one row (``one_row_each``).
    """
    grouped = "group" in sequences.columns
    cells, block = 4**m, min(4**m, BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, again = np.full(cells, -1, np.int32), np.zeros(cells, bool)
        n = 0
        for batch in batches:
            if grouped:
                whose = batch.column("entry_id").to_numpy().astype(np.int32)
            else:  # an entry's pieces follow each other; its first begins at 0
                whose = n + np.cumsum(batch.column("far").to_numpy() == 0).astype(np.int32)
                n = int(whose[-1]) if len(whose) else n
            for row, _, code in _codes(batch, m):
                _noted(first, again, code, whose[row])
        for i in range(0, cells, block):
            own, more = first[i : i + block], again[i : i + block]
            if (own >= 0).any():
                shown = own.tobytes() if grouped else np.packbits(own >= 0).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([i // block], pa.int64()), pa.array([shown], pa.binary()), pa.array([np.packbits(more).tobytes()], pa.binary())], names=["block", "first", "again"])

    def together(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, again, first = np.zeros(block, bool), np.zeros(block, bool), np.full(block, -1, np.int32)
        for batch in batches:
            for shown, more in zip(batch.column("first").to_pylist(), batch.column("again").to_pylist(), strict=True):
                again |= np.unpackbits(np.frombuffer(more, np.uint8), count=block).view(bool)
                if grouped:
                    own = np.frombuffer(shown, np.int32)
                    again |= (first >= 0) & (own >= 0) & (own != first)
                    first = np.where(first < 0, own, first)
                else:
                    own = np.unpackbits(np.frombuffer(shown, np.uint8), count=block).view(bool)
                    again |= seen & own
                    seen |= own
        bits = [pa.array([np.packbits(x).tobytes()], pa.binary()) for x in (first >= 0 if grouped else seen, again)]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), *bits], names=["block", "seen", "again"])

    pieces = far_pieces(sequences.select(F.col("group").alias("entry_id"), "seq") if grouped else sequences, m - 1)
    found = pieces.mapInArrow(run, "block bigint, first binary, again binary").groupBy("block").applyInArrow(together, "block bigint, seen binary, again binary")
    seen, again = np.zeros(cells, bool), np.zeros(cells, bool)
    for r in found.collect():
        for table, bits in ((seen, r.seen), (again, r.again)):
            table[r.block * block : (r.block + 1) * block] = np.unpackbits(np.frombuffer(bits, np.uint8), count=block).view(bool)
    return seen, again


def _sent(sequences: DataFrame, bits: np.ndarray):
    return sequences.sparkSession.sparkContext.broadcast(np.packbits(bits))


def places(sequences: DataFrame, m: int, bits: np.ndarray, marked: np.ndarray | None = None) -> DataFrame:
    """entry_id, pos of the words whose bit is set; if others are marked, also kmer and whether it is (marked)."""
    sent, also, cells = _sent(sequences, bits), None if marked is None else _sent(sequences, marked), 4**m
    names = ["entry_id", "pos"] + (["kmer", "marked"] if also else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, named = (x and np.unpackbits(x.value, count=cells).view(bool) for x in (sent, also))
        for batch in batches:
            far = batch.column("far").to_numpy()
            for row, place, code in _codes(batch, m):
                at = np.flatnonzero(chosen[code])
                if len(at):
                    columns = [batch.column("entry_id").take(pa.array(row[at])), pa.array(far[row[at]] + place[at])]
                    yield pa.RecordBatch.from_arrays(columns + ([_spelt(code[at], m), pa.array(named[code[at]])] if also else []), names=names)

    kinds = dict(sequences.dtypes)["entry_id"], "bigint", "string", "boolean"
    return far_pieces(sequences, m - 1).mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def counts(sequences: DataFrame, m: int, bits: np.ndarray) -> DataFrame:
    """entry_id, n: how many places of each entry have such a word, of entries with any."""
    sent, cells = _sent(sequences, bits), 4**m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = np.unpackbits(sent.value, count=cells).view(bool)
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for row, _, code in _codes(batch, m):
                n += np.bincount(row[chosen[code]], minlength=len(n))
            held = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([batch.column("entry_id").take(pa.array(held)), pa.array(n[held])], names=["entry_id", "n"])

    found = far_pieces(sequences, m - 1).mapInArrow(run, f"entry_id {dict(sequences.dtypes)['entry_id']}, n bigint")
    return found.groupBy("entry_id").agg(F.sum("n").alias("n"))


def turned(bits: np.ndarray, m: int) -> np.ndarray:
    """The bit of each word's reverse complement."""
    return bits.reshape((4,) * m)[(slice(None, None, -1),) * m].transpose(range(m)[::-1]).reshape(-1)


def near(bits: np.ndarray, m: int, k: int, left: int, right: int) -> np.ndarray:
    """Words that differ from a chosen one in at most k places (0 or 1), none of the first ``left`` and last ``right``."""
    out = bits.reshape((4,) * m).copy()
    for o in range(left, m - right) if k else ():
        out |= bits.reshape((4,) * m).any(axis=o, keepdims=True)
    return out.reshape(-1)
