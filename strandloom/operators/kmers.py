"""Words of fixed length: listing, counting, annotation, spaced templates, pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq as S
from ..plans.lineage import cut


#: A table of words up to so many bytes, as counted, is broadcast; what lists places never is.
BROADCAST_BYTES = 16 << 20


def sized(table: DataFrame, width: int) -> DataFrame:
    """The table, written and counted, to be broadcast up to ``BROADCAST_BYTES`` and to be merged beyond. width: bytes of a row's keys. A few words for many places then need no exchange of the places."""
    own = cut(table)
    return own.hint("broadcast" if fits(own, width) else "merge")


def fits(table: DataFrame, width: int) -> bool:
    return table.count() * (width + 64) <= BROADCAST_BYTES


#: Starts in a piece, on two levels: a substring costs what lies before it, so long texts are cut twice.
LONG, SHORT = 1 << 15, 1 << 7


def chunks(sequences: DataFrame, span: int) -> DataFrame:
    """entry_id, base, piece: entries cut into pieces that overlap by span - 1 letters.

    A stretch of ``span`` letters lies whole in the one piece that owns its start, so per-piece results need no clean-up,
    and the work is linear in the length of an entry.
    """

    def starts(text: str, size: int) -> Column:
        last = F.length(text) - span
        return F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(size))).otherwise(F.array().cast("array<int>"))

    rows = sequences.select("entry_id", "seq", F.explode(starts("seq", LONG)).alias("far")).select("entry_id", "far", F.expr(f"substring(seq, far + 1, {LONG + span - 1})").alias("part"))
    rows = rows.select("entry_id", "far", "part", F.explode(starts("part", SHORT)).alias("near"))
    return rows.select("entry_id", (F.col("far") + F.col("near")).alias("base"), F.expr(f"substring(part, near + 1, {SHORT + span - 1})").alias("piece"))


#: Stands beyond both ends of an entry in windows; no pattern has it.
BEYOND = "\0"


def windows(sequences: DataFrame, left: int, right: int, only: str | None = None) -> DataFrame:
    """entry_id, pos, window: of every place the letters from ``left`` before it to ``right`` behind it, BEYOND where the entry has none.

    What is looked up by the letters at a place takes its surroundings along, so no hit is joined with its entry again.
    only: a regular expression; places of pieces in which it is not found are left out.
    """
    padded = sequences.select("entry_id", F.concat(F.lit(BEYOND * left), "seq", F.lit(BEYOND * (right - 1))).alias("seq"))
    pieces = chunks(padded, left + right)
    rows = (pieces if only is None else pieces.where(F.col("piece").rlike(only))).select("entry_id", "base", "piece", F.explode(S.positions("piece", left + right)).alias("p"))
    return rows.select("entry_id", (F.col("base") + F.col("p")).alias("pos"), F.expr(f"substring(piece, p + 1, {left + right})").alias("window"))


def with_offsets(rows: DataFrame, parts: Column, follow: int = 0) -> DataFrame:
    """The rows' columns, i, offset, own: for each text of an array its place, how many letters lie before it, and it with the ``follow`` texts behind it.

    Sums run over blocks of SHORT texts and then inside a block, so the work is linear in the array and needs no shuffle.
    """
    size = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda n, x: n + F.length(x))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<b:int,at:bigint>>").alias("out"))
    firsts = F.when(F.size("_parts") > 0, F.sequence(F.lit(0), F.size("_parts") - 1, F.lit(SHORT))).otherwise(F.array().cast("array<int>"))

    def add(acc: Column, b: Column) -> Column:
        more = F.array(F.struct(b.alias("b"), acc["at"].alias("at")))
        return F.struct((acc["at"] + size(F.slice("_parts", b + 1, F.lit(SHORT)))).alias("at"), F.concat(acc["out"], more).alias("out"))

    blocks = rows.withColumn("_parts", parts).withColumn("_block", F.explode(F.aggregate(firsts, start, add, lambda acc: acc["out"])))
    blocks = blocks.withColumn("_n", F.least(F.lit(SHORT), F.size("_parts") - F.col("_block.b"))).withColumn("_own", F.slice("_parts", F.col("_block.b") + 1, F.lit(SHORT + follow))).drop("_parts")
    laid = blocks.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    laid = laid.withColumn("i", F.col("_block.b") + F.col("_i")).withColumn("offset", F.col("_block.at") + size(F.slice("_own", F.lit(1), F.col("_i"))))
    return laid.withColumn("own", F.slice("_own", F.col("_i") + 1, F.lit(follow + 1))).drop("_block", "_n", "_own", "_i")


def far_pieces(sequences: DataFrame, span: int) -> DataFrame:
    """entry_id, far, part: entries in pieces of LONG starts and ``span`` letters more, for looking up stretches of up to so many letters by (entry_id, far)."""
    last = F.length("seq") - 1
    cut = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(LONG))).otherwise(F.array().cast("array<int>"))
    return sequences.select("entry_id", "seq", F.explode(cut).alias("far")).select("entry_id", F.col("far").cast("bigint").alias("far"), F.expr(f"substring(seq, far + 1, {LONG + span})").alias("part"))


def words(sequences: DataFrame, k: int) -> DataFrame:
    """entry_id, pos, kmer of every stretch of k letters."""
    rows = chunks(sequences, k).select("entry_id", "base", "piece", F.explode(S.positions("piece", k)).alias("p"))
    return rows.select("entry_id", (F.col("base") + F.col("p")).alias("pos"), F.expr(f"substring(piece, p + 1, {k})").alias("kmer"))


def words_with_neighbours(sequences: DataFrame, k: int) -> DataFrame:
    """entry_id, pos, kmer, l, r: the letters on both sides, $ beyond an end."""
    padded = sequences.select("entry_id", F.concat(F.lit("$"), "seq", F.lit("$")).alias("seq"))
    return words(padded, k + 2).select("entry_id", "pos", F.expr(f"substring(kmer, 2, {k})").alias("kmer"), F.expr("left(kmer, 1)").alias("l"), F.expr("right(kmer, 1)").alias("r"))


def dna_words(sequences: DataFrame, k: int) -> DataFrame:
    """Only words of A, C, G and T: other letters reset the window. Words are looked at one by one only in pieces that have others."""
    pieces = chunks(sequences, k).withColumn("sound", ~F.col("piece").rlike("[^ACGT]"))
    rows = pieces.select("entry_id", "base", "piece", "sound", F.explode(S.positions("piece", k)).alias("p"))
    rows = rows.select("entry_id", (F.col("base") + F.col("p")).alias("pos"), F.expr(f"substring(piece, p + 1, {k})").alias("kmer"), "sound")
    return rows.where(F.col("sound") | ~F.col("kmer").rlike("[^ACGT]")).drop("sound")


#: Letters that a task turns into codes at once, and the longest words that are (a code is a long).
_LETTERS, CODED = 1 << 20, 15
_DIGITS = np.full(128, 255, np.uint8)
_DIGITS[[ord(c) for c in "ACGT"]] = range(4)


def _codes(batch: pa.RecordBatch, k: int, strange_too: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """row, place, code of every word of A, C, G and T in a batch's ``part``, some ``_LETTERS`` at a time: the row's number in the batch, the word's place in its text, and its number to the base 4.

    strange_too: words with other letters come as well, as -1.
    """
    texts = batch.column("part").to_pylist()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    block = (np.cumsum(sizes) - sizes) // _LETTERS
    for low, high in zip(*(f(block, np.unique(block), side) for f, side in ((np.searchsorted, "left"), (np.searchsorted, "right"))), strict=True):
        digits = _DIGITS[np.minimum(np.frombuffer("\0".join(texts[low:high]).encode("utf-32-le"), np.uint32), 127)]
        n = len(digits) - k + 1
        if n <= 0:
            continue
        code, strange = np.zeros(n, np.int32 if k < CODED else np.int64), np.concatenate(([0], np.cumsum(digits > 3, dtype=np.int32)))
        for i in range(k):
            code = code * 4 + (digits[i : i + n] & 3)
        sound, held = strange[k:] == strange[:-k], sizes[low:high] + 1
        row, first = np.repeat(np.arange(high - low), held)[:n], np.cumsum(held) - held
        at = np.flatnonzero(np.arange(n) + k < (first + held)[row] if strange_too else sound)
        row = row[at]
        yield row + low, at - first[row], np.where(sound[at], code[at], -1) if strange_too else code[at]


def coded_words(sequences: DataFrame, k: int, only: list[int] | None = None) -> DataFrame:
    """entry_id, pos, code: ``dna_words`` by their numbers (``kmer_code``), k at most ``CODED``. only: the numbers of the words that are listed, if not all are."""
    chosen = None if only is None else np.unique(np.array(only, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = batch.column("far").to_numpy()
            for row, place, code in _codes(batch, k):
                if chosen is not None:
                    held = np.flatnonzero(np.isin(code, chosen))
                    row, place, code = row[held], place[held], code[held]
                yield pa.RecordBatch.from_arrays([batch.column("entry_id").take(pa.array(row)), pa.array(far[row] + place), pa.array(code.astype(np.int64))], names=["entry_id", "pos", "code"])

    return far_pieces(sequences, k - 1).mapInArrow(run, f"entry_id {dict(sequences.dtypes)['entry_id']}, pos bigint, code bigint")


#: Counts that a task keeps in a table; of longer words each block's are listed.
_CELLS = 1 << 22


def _spelt(codes: np.ndarray, k: int) -> pa.Array:
    letters = np.frombuffer(b"ACGT", np.uint8)[(codes[:, None] >> np.arange(2 * k - 2, -2, -2)) & 3]
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer((np.arange(len(codes) + 1) * k).astype(np.int32).tobytes()), pa.py_buffer(letters.tobytes()))


def dna_counts(sequences: DataFrame, k: int, by_entry: bool = False, both_strands: bool = False) -> DataFrame:
    """``count`` of ``dna_words``, k at most ``CODED``: what a task reads is counted by numbers of words before any row is made, and its counts are then added up."""
    size = 4**k

    def counted(key: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
        if cells > _CELLS:
            return np.unique(key, return_counts=True)
        n = np.bincount(key, minlength=cells)
        found = np.flatnonzero(n)
        return found, n[found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size if size <= _CELLS else 0, np.int64)
        for batch in batches:
            for row, _, code in _codes(batch, k):
                if not len(code):
                    continue
                if by_entry:
                    low = row[0]
                    key, n = counted((row - low) * size + code, int(row[-1] - low + 1) * size)
                    yield pa.RecordBatch.from_arrays([batch.column("entry_id").take(pa.array(key // size + low)), _spelt(key % size, k), pa.array(n, pa.int64())], names=["entry_id", "kmer", "n"])
                elif len(total):
                    total += np.bincount(code, minlength=size)
                else:
                    key, n = counted(code, size)
                    yield pa.RecordBatch.from_arrays([_spelt(key, k), pa.array(n, pa.int64())], names=["kmer", "n"])
        key = np.flatnonzero(total)
        if len(key):
            yield pa.RecordBatch.from_arrays([_spelt(key, k), pa.array(total[key])], names=["kmer", "n"])

    entry = f"entry_id {dict(sequences.dtypes)['entry_id']}, " if by_entry else ""
    found = far_pieces(sequences, k - 1).mapInArrow(run, f"{entry}kmer string, n bigint")
    if both_strands:
        found = found.withColumn("kmer", F.explode(F.array("kmer", S.reverse_complement("kmer"))))
    return found.groupBy(*(["entry_id"] if by_entry else []), "kmer").agg(F.sum("n").alias("n"))


def value_runs(sequences: DataFrame, k: int, codes: list[int], values: list[int], other: int, least: int | None = None) -> DataFrame:
    """entry_id, start, stop, value: maximal stretches of places whose words of k letters have one value; other: the value of words that are not named; least: only values from it.

    Stretches end within a piece of an entry, where they are found at once; of entries of several pieces those that touch a border are put together.
    """
    known, by_code = np.array(codes, np.int64), np.array(values, np.int64)
    order = np.argsort(known)
    known, by_code, long = known[order], by_code[order], LONG

    def run(open_ones: bool):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                far = batch.column("far").to_numpy()
                for row, place, code in _codes(batch, k, strange_too=True):
                    if not len(row):
                        continue
                    at = np.minimum(np.searchsorted(known, code), max(0, len(known) - 1))
                    value = np.where(known[at] == code, by_code[at], other) if len(known) else np.full(len(code), other, np.int64)
                    begin = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (row[1:] != row[:-1]))))
                    end = np.append(begin[1:], len(value)) - 1
                    touches = (place[begin] == 0) & (far[row[begin]] > 0) | (place[end] == long - 1)
                    kept = np.flatnonzero((touches == open_ones) & (True if least is None else value[begin] >= least))
                    begin, end = begin[kept], end[kept]
                    yield pa.RecordBatch.from_arrays([batch.column("entry_id").take(pa.array(row[begin])), pa.array(far[row[begin]] + place[begin]), pa.array(far[row[end]] + place[end] + 1), pa.array(value[begin])], names=["entry_id", "start", "stop", "value"])

        return of

    ddl = f"entry_id {dict(sequences.dtypes)['entry_id']}, start bigint, stop bigint, value bigint"
    closed = far_pieces(sequences, k - 1).mapInArrow(run(False), ddl)
    touching = far_pieces(sequences.where(F.length("seq") >= long + k - 1), k - 1).mapInArrow(run(True), ddl)
    order = Window.partitionBy("entry_id").orderBy("start")
    goes_on = (F.lag("stop").over(order) == F.col("start")) & (F.lag("value").over(order) == F.col("value"))
    marked = touching.withColumn("run", F.sum(F.when(goes_on, 0).otherwise(1)).over(order))
    return closed.unionByName(marked.groupBy("entry_id", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("value").alias("value")).drop("run"))


def count(found: DataFrame, by_entry: bool = False, both_strands: bool = False) -> DataFrame:
    """[entry_id,] kmer, n. Both strands: the reverse complement of each word counts too, so palindromes count twice."""
    if both_strands:
        found = found.withColumn("kmer", F.explode(F.array("kmer", S.reverse_complement("kmer"))))
    return found.groupBy(*(["entry_id"] if by_entry else []), "kmer").agg(F.count("*").alias("n"))


def top(counted: DataFrame, m: int) -> DataFrame:
    """The m most frequent words of each entry, larger words first among equals."""
    if m < 1:
        raise ValueError("m must be 1 or more")
    order = Window.partitionBy("entry_id").orderBy(F.desc("n"), F.desc("kmer"))
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= m)


def annotate(sequences: DataFrame, counted: DataFrame, k: int) -> DataFrame:
    """entry_id, pos, n: count of the word at each place on both strands; 0 where the table has none or the word isn't DNA."""
    n = counted.select("kmer", "n")
    both = n.select("kmer", "n").unionByName(n.select(S.reverse_complement("kmer").alias("kmer"), "n")).groupBy("kmer").agg(F.sum("n").alias("n"))
    return words(sequences, k).join(sized(both, k + 8), "kmer", "left").select("entry_id", "pos", F.coalesce("n", F.lit(0)).alias("n"))


def spaced(sequences: DataFrame, templates: list[str]) -> DataFrame:
    """entry_id, tag (the template's place in the list), pos, word."""
    parts = []
    for tag, template in enumerate(templates):
        rows = words(sequences, len(template))
        parts.append(rows.select("entry_id", F.lit(tag).alias("tag"), "pos", S.template_word("kmer", F.lit(0), template).alias("word")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def neighbours(sequences: DataFrame, k: int) -> DataFrame:
    """kmer, n, and how many different letters (ends count as one) stand left and right of it, two at most."""
    rows = words_with_neighbours(sequences, k)
    return rows.groupBy("kmer").agg(
        F.count("*").alias("n"),
        F.least(F.count_distinct("l"), F.lit(2)).alias("n_left"),
        F.least(F.count_distinct("r"), F.lit(2)).alias("n_right"),
        F.max(((F.col("l") == "$") | (F.col("r") == "$")).cast("int")).alias("at_end"),
    )


def pair_codes(sequences: DataFrame, m: int, gap: int) -> DataFrame:
    """mer1, mer2, n: two words of m letters with a gap between, on both strands."""
    rows = words(sequences, 2 * m + gap)
    pairs = rows.select(F.expr(f"left(kmer, {m})").alias("a"), F.expr(f"right(kmer, {m})").alias("b")).where("a rlike '^[ACGT]+$' and b rlike '^[ACGT]+$'")
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("mer1"), F.col("b").alias("mer2")), F.struct(S.reverse_complement("b").alias("mer1"), S.reverse_complement("a").alias("mer2")))).alias("x"))
    return both.select("x.*").groupBy("mer1", "mer2").agg(F.count("*").alias("n"))


def seen(pairs: DataFrame, m: int) -> DataFrame:
    """One row: pairs seen once, seen again, and never (of 16^m)."""
    return pairs.agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") > 1).alias("again"), (F.lit(16**m) - F.count("*")).alias("unseen"))


#: Pair codes that a task counts at once, a byte each.
_CODES = 1 << 24


def seen_by_gap(sequences: DataFrame, m: int, most: int, least: int = 0) -> DataFrame:
    """gap, once, again, unseen of pairs of words of m letters, on both strands, for every gap from ``least`` to ``most``.

    A task keeps what it saw of each gap's pairs, up to twice, and counts a gap at all places of a piece at once; a gap's bitmaps of the tasks, 16^m bits each,
    are then put together (what two tasks saw was seen again). The other strand is the same table turned, so it is added once at the end. A gap all of whose pairs a task has seen twice
    can't change any more and isn't counted further there. Gaps are worked off in groups, so that a task's tables stay within ``_CODES`` bytes; m is at most 6.
    """
    if not 1 <= m <= 6:
        raise ValueError("words of 1 to 6 letters")
    side, size = 4**m, 16**m
    gaps_at_once = max(1, _CODES // size)
    groups = -(-(most - least + 1) // gaps_at_once)
    digits = np.full(128, 255, np.uint8)
    digits[[ord(c) for c in "ACGT"]] = range(4)
    turned = np.arange(side)
    turned = sum(((3 - (turned // 4**i) % 4) * 4 ** (m - 1 - i) for i in range(m)), np.zeros(side, np.int64))  # code of the reverse complement
    own_letters, look_again = 1 << 13, max(8, size >> 10)

    def both(n_of: np.ndarray) -> np.ndarray:
        table = n_of.reshape(side, side)
        return (table + table[np.ix_(turned, turned)].T).reshape(size)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, np.ndarray] = {}
        done: set[int] = set()
        pieces = 0
        for batch in batches:
            for group, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                letters = digits[np.minimum(np.frombuffer(piece.encode("utf-32-le"), np.uint32), 127)]
                if len(letters) < 2 * m:
                    continue
                n = len(letters) - m + 1
                code, sound = np.zeros(n, np.int64), np.ones(n, bool)
                for i in range(m):
                    code, sound = code * 4 + (letters[i : i + n] & 3), sound & (letters[i : i + n] < 4)
                first, whole = code * side, bool(sound.all())
                pieces += 1
                low = least + group * gaps_at_once
                for gap in range(low, min(low + gaps_at_once, most + 1)):
                    held = min(own_letters, n - m - gap)
                    if held <= 0:
                        break
                    if gap in done:
                        continue
                    pair = first[:held] + code[m + gap : m + gap + held]
                    if not whole:
                        pair = pair[sound[:held] & sound[m + gap : m + gap + held]]
                    own = state.setdefault(gap, np.zeros(size, np.uint8))
                    np.minimum(own + np.minimum(np.bincount(pair, minlength=size), 2).astype(np.uint8), 2, out=own)
                    if pieces % look_again == 0 and both(own).min() > 1:
                        done.add(gap)
        for gap, own in state.items():
            own = both(own)
            yield pa.RecordBatch.from_arrays([pa.array([gap], pa.int64()), pa.array([np.packbits(own > 0).tobytes()], pa.binary()), pa.array([np.packbits(own > 1).tobytes()], pa.binary())], names=["gap", "any", "again"])

    def together(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, more = np.zeros(size // 8 or 1, np.uint8), np.zeros(size // 8 or 1, np.uint8)
        for batch in batches:
            for x, y in zip(batch.column("any").to_pylist(), batch.column("again").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                more |= y | some & x
                some |= x
        seen, again = int(np.unpackbits(some).sum()), int(np.unpackbits(more).sum())
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (key[0].as_py(), seen - again, again, size - seen)], names=["gap", "once", "again", "unseen"])

    last = F.length("seq") - 1
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(LONG))).otherwise(F.array().cast("array<int>"))
    far = sequences.select("seq", F.explode(starts).alias("far")).select(F.expr(f"substring(seq, far + 1, {LONG + 2 * m + most})").alias("part"))
    near = far.select("part", F.explode(F.sequence(F.lit(0), F.least(F.length("part") - 1, F.lit(LONG - 1)), F.lit(own_letters))).alias("near")).select(F.expr(f"substring(part, near + 1, {own_letters + 2 * m + most})").alias("piece"))
    work = near.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "piece")
    if groups > 1:
        work = work.repartition("group", F.pmod(F.xxhash64("piece"), F.lit(64)))  # a task has few groups' bitmaps
    found = work.mapInArrow(one, "gap bigint, any binary, again binary")
    return found.groupBy("gap").applyInArrow(together, "gap bigint, once bigint, again bigint, unseen bigint")
