"""Finding patterns in sequences: exact, with ambiguity letters, substitutions, or edits.

patterns: pattern_id, pattern. Hits: entry_id, pattern_id, start_pos, end_pos, edits.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq as S
from .kmers import BEYOND, BROADCAST_BYTES, LONG, SHORT, windows

HITS = "entry_id bigint, pattern_id bigint, start_pos bigint, end_pos bigint, edits int"


def both_strands(patterns: DataFrame, protein: bool = False) -> DataFrame:
    """pattern_id, base_id, strand, pattern: forward, and the reverse complement (proteins: the reverse) under id + n."""
    n = patterns.agg(F.max("pattern_id")).first()[0] or 0
    turned = F.reverse("pattern") if protein else S.reverse_complement("pattern")
    forward = patterns.select("pattern_id", F.col("pattern_id").alias("base_id"), F.lit("F").alias("strand"), "pattern")
    return forward.unionByName(patterns.select((F.col("pattern_id") + n).alias("pattern_id"), F.col("pattern_id").alias("base_id"), F.lit("R").alias("strand"), turned.alias("pattern")))


@dataclass(frozen=True)
class Facts:
    """What the pattern table (not the sequences) was read for: how many patterns there are of each length."""

    by_length: dict[int, int]

    @property
    def lengths(self) -> list[int]:
        return sorted(self.by_length)


def facts(patterns: DataFrame) -> Facts:
    return Facts({r["n"]: r["count"] for r in patterns.groupBy(F.length("pattern").alias("n")).count().collect() if r["n"]})


#: Beyond ``BROADCAST_BYTES``: buckets of word hashes that the scan is thinned by (a table of so many numbers at most), and parts that the rows of a word are dealt to.
BUCKETS, SALTS = 1 << 20, 8


def looked_up(places: DataFrame, wanted: DataFrame, keys: list[str], n_wanted: int, width: int) -> DataFrame:
    """Places joined with pattern words. n_wanted, width: how many rows ``wanted`` has, as counted, and of how many letters at most.

    Few pattern words are broadcast. Of many, the hashes thin the places out where that can leave most of them, and the rest is merged,
    every word's rows in ``SALTS`` parts, so that a frequent word isn't one task.
    """
    if n_wanted * (width + 64) <= BROADCAST_BYTES:
        return places.join(F.broadcast(wanted), keys)
    if n_wanted <= BUCKETS // 2:
        bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket")
        places = places.withColumn("_bucket", bucket).join(F.broadcast(wanted.select(bucket).distinct()), "_bucket", "left_semi").drop("_bucket")
    dealt = places.withColumn("_salt", F.pmod(F.xxhash64("entry_id", "pos"), F.lit(SALTS)).cast("int"))
    spread = wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.hint("merge").join(spread, [*keys, "_salt"]).drop("_salt")


#: Up to so many different words are looked for in a piece by one expression before its places are listed.
FILTER_WORDS = 1000


def piece_filter(words: DataFrame, known: Facts, piece: int) -> str | None:
    """A regular expression for pieces that hold any of the words; none if there are many words, or if most pieces hold one anyway (of four letters, at random)."""
    if sum(known.by_length.values()) > FILTER_WORDS or piece * sum(c * 4.0**-n for n, c in known.by_length.items()) > 0.5:
        return None
    return S.any_of(sorted({r[0] for r in words.collect()}))


def _union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    if not parts:
        return empty
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _no_hits(sequences: DataFrame) -> DataFrame:
    return sequences.sparkSession.createDataFrame([], HITS)


def exact(sequences: DataFrame, patterns: DataFrame) -> DataFrame:
    """Equal stretches, in one pass over the sequences for all pattern lengths.

    A pattern is looked up by its first letters, as many as the largest power of two in its length, and then compared with what
    stands at the place; each place has one row for each such power. Of few patterns, pieces that hold none are dropped before their places are listed.
    """
    known = facts(patterns)
    ns = known.lengths
    if not ns:
        return _no_hits(sequences)
    firsts = sorted({1 << (n.bit_length() - 1) for n in ns})
    first = F.lit(firsts[0])
    for n in firsts[1:]:
        first = F.when(F.length("pattern") >= n, F.lit(n)).otherwise(first)
    real = patterns.where(F.length("pattern") > 0)
    wanted = real.select("pattern_id", "pattern", F.substring("pattern", F.lit(1), first).alias("mer"))
    rows = windows(sequences, 0, ns[-1], piece_filter(real.select("pattern"), known, SHORT))
    found = rows.withColumn("mer", F.explode(F.array(*(F.substring("window", 1, n) for n in firsts))))
    hit = looked_up(found, wanted, ["mer"], sum(known.by_length.values()), 2 * ns[-1]).where(F.startswith("window", "pattern"))
    start = F.col("pos").cast("bigint")
    return hit.select("entry_id", "pattern_id", start.alias("start_pos"), (start + F.length("pattern")).alias("end_pos"), F.lit(0).alias("edits"))


def scan(sequences: DataFrame, patterns: list[tuple[int, str]], wildcards: bool = True, text_n: bool = False, lite: bool = False) -> DataFrame:
    """Patterns with ambiguity letters or lite regular expressions, as one compiled overlapping search a pattern over Arrow batches."""
    compiled = [(i, len(p), S.to_regex(p, wildcards, text_n, lite)) for i, p in patterns]
    schema = pa.schema([("entry_id", pa.int64()), ("pattern_id", pa.int64()), ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("edits", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = [(i, n, re.compile(f"(?={x})")) for i, n, x in compiled]
        for part in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            rows = [(e, i, m.start(), m.start() + n, 0) for e, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if s for i, n, r in machines for m in r.finditer(s)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)

    return sequences.select("entry_id", "seq").mapInArrow(run, HITS)


def expanded(patterns: DataFrame, limit: int = 4096) -> DataFrame:
    """pattern_id and every ACGT word that a pattern with ambiguity letters stands for, so that the exact join can be used."""
    table = {c: "".join(x for x in letters if x in "ACGT") for c, letters in S.compatible_letters().items()}
    rows = []
    for r in patterns.select("pattern_id", "pattern").collect():
        spelt = [""]
        for c in r.pattern:
            spelt = [w + x for w in spelt for x in table.get(c, c)]
            if len(spelt) > limit:
                raise ValueError(f"{r.pattern} stands for more than {limit} words: use scan")
        rows += [(r.pattern_id, w) for w in spelt]
    return patterns.sparkSession.createDataFrame(rows, "pattern_id bigint, pattern string")


def pieces(n: int, k: int) -> list[tuple[int, int]]:
    """Offset and length of k + 1 pieces of a pattern: with k errors at most, one of them is whole."""
    if n <= k:
        raise ValueError("more errors than inexact letters")
    cuts = [i * n // (k + 1) for i in range(k + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _seeds(sequences: DataFrame, patterns: DataFrame, k: int, word: int | None, slack: int, read: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """entry_id, pattern_id, pattern, at, around: places where a piece (or any word of that size) of the pattern stands exactly.

    at: start of the pattern if it had no indel. around: the text from ``slack`` * 2 letters before that to ``slack`` letters behind
    the pattern, cut from the window that the place's row brings along. Each place has one row for each size of the pieces.
    read: turns a text's letters to those of the patterns, one for one.
    """
    known = facts(patterns)
    cut: dict[int, list[tuple[int, int]]] = {n: pieces(n, k) if word is None else [(i, word) for i in range(n - word + 1)] for n in known.lengths}
    if not any(cut.values()):
        none = _no_hits(sequences).select("pattern_id", F.lit("").alias("pattern"), F.lit(0).cast("bigint").alias("at"), F.lit("").alias("around"))
        return sequences.select("entry_id").limit(0).join(none.limit(0))
    left = max((o for own in cut.values() for o, _ in own), default=0) + 2 * slack
    right = max(n - o for n, own in cut.items() for o, _ in own) + slack
    at_length = F.create_map(*(F.lit(x) for n, own in cut.items() for x in (n, [o * 1_000 + m for o, m in own])))
    code = F.explode(F.element_at(at_length, F.length("pattern")))
    wanted = patterns.where(F.length("pattern").isin(list(cut))).select("pattern_id", "pattern", code.alias("code"))
    wanted = wanted.select("pattern_id", "pattern", F.floor(F.col("code") / 1_000).cast("int").alias("offset"), (F.col("code") % 1_000).alias("size"))
    wanted = wanted.select("pattern_id", "pattern", "offset", F.substring("pattern", F.col("offset") + 1, F.col("size")).alias("mer"))
    sizes = sorted({m for own in cut.values() for _, m in own})
    rows = windows(sequences, left, right).withColumn("mer", F.explode(F.array(*(read(F.substring("window", left + 1, m)) for m in sizes))))
    hit = looked_up(rows, wanted, ["mer"], sum(c * len(cut[n]) for n, c in known.by_length.items()), 2 * known.lengths[-1])
    begin = F.lit(left - 2 * slack) - F.col("offset") + 1
    around = F.substring("window", begin, F.length("pattern") + 3 * slack)
    return hit.select("entry_id", "pattern_id", "pattern", (F.col("pos") - F.col("offset")).cast("bigint").alias("at"), around.alias("around"))


#: Patterns of so many letters in all, none longer than LONGEST, are compared with all places of a batch at once; of more, words are looked up.
DIRECT_LETTERS, LONGEST = 1 << 11, 200
#: Places that a piece owns, and places that are compared at once.
OWN, AT_ONCE = 1 << 12, 1 << 17


def _few(patterns: DataFrame) -> bool:
    known = facts(patterns)
    return sum(n * c for n, c in known.by_length.items()) <= min(DIRECT_LETTERS, BROADCAST_BYTES) and max(known.lengths, default=0) <= LONGEST and dict(patterns.dtypes)["pattern_id"] in ("int", "bigint")


def _compared(sequences: DataFrame, patterns: DataFrame, parts: dict[int, list[tuple[int, int]]], k: int, before: int, behind: int, early: int = 0, read: Callable[[Column], Column] | None = None) -> DataFrame:
    """entry_id, pattern_id, pattern, at, edits, around: places where one of a pattern's parts (offset and length, by the pattern's length) differs in k letters at most from what stands there.

    edits: in how many letters that part, the nearest of them. around: the text from ``before`` letters before the pattern's start to ``behind`` letters behind its end, BEYOND outside of the entry.
    A pattern may start ``early`` letters before the entry. The sequences come in pieces; differences of a letter of a pattern are added up over all places of many pieces at once.
    read: turns a text's letters to those of the patterns, one for one.
    """
    wanted = sorted({(r["pattern_id"], r["pattern"]) for r in patterns.where(F.length("pattern").isin([n for n, own in parts.items() if own] or [0])).select("pattern_id", "pattern").collect()})
    longest = max((len(p) for _, p in wanted), default=0)
    span, lead = before + longest + behind, before + early
    kinds = dict(sequences.dtypes)["entry_id"], dict(patterns.dtypes)["pattern_id"]
    number = pa.int64() if kinds[1] == "bigint" else pa.int32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("piece").to_pylist()
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            ends = np.cumsum(sizes)
            shown = "".join(texts)
            plain = shown.isascii()
            code = lambda x: np.frombuffer(x.encode("ascii"), np.uint8) if plain else np.frombuffer(x.encode("utf-32-le"), np.uint32)
            text = code(shown)
            looked = "".join(batch.column("looked").to_pylist()) if "looked" in batch.schema.names else shown
            other = text if looked is shown else np.frombuffer(looked.encode("utf-32-le"), np.uint32)
            base = batch.column("base").to_numpy(zero_copy_only=False)
            for lo in range(0, len(other), AT_ONCE):
                held = other[lo : lo + AT_ONCE + longest]
                differs = {c: (held != ord(c)).view(np.uint8) for c in {c for _, p in wanted for c in p}}
                out = []
                for i, p in wanted:
                    room = min(len(held) - len(p) + 1, AT_ONCE)
                    if room <= 0:
                        continue
                    least = None
                    for offset, n in parts[len(p)]:
                        total = differs[p[offset]][offset : offset + room].copy()
                        for j in range(offset + 1, offset + n):
                            total += differs[p[j]][j : j + room]
                        least = total if least is None else np.minimum(least, total, out=least)
                    at = np.flatnonzero(least <= k)
                    first = at + (lo - before)  # of what is around
                    row = np.searchsorted(ends, first, "right")
                    fits = first >= 0
                    row, first, at = row[fits], first[fits], at[fits]
                    place = first - (ends[row] - sizes[row])
                    fits = (place < OWN) & (place + span <= sizes[row])
                    row, first, at, place = row[fits], first[fits], at[fits], place[fits]
                    if not len(at):
                        continue
                    width = before + len(p) + behind
                    if plain:
                        letters = text[first[:, None] + np.arange(width)]
                        around = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.arange(0, (len(at) + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(letters)))
                    else:
                        around = pa.array([shown[x : x + width] for x in first.tolist()], pa.string())
                    n = len(at)
                    out.append([batch.column("entry_id").take(pa.array(row)), pa.repeat(pa.scalar(i, number), n), pa.repeat(pa.scalar(p), n), pa.array(base[row] + place - early), pa.array(least[at].astype(np.int32)), around])
                if out:
                    columns = [pa.concat_arrays([o[c] for o in out]) for c in range(6)]
                    yield pa.RecordBatch.from_arrays(columns, names=["entry_id", "pattern_id", "pattern", "at", "edits", "around"])

    ddl = f"entry_id {kinds[0]}, pattern_id {kinds[1]}, pattern string, at bigint, edits int, around string"
    if not wanted:
        return sequences.sparkSession.createDataFrame([], ddl)
    padded = sequences.where("seq is not null").select("entry_id", F.concat(F.lit(BEYOND * lead), "seq", F.lit(BEYOND * (longest - 1 + behind))).alias("seq"))
    far = padded.select("entry_id", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - 1, F.lit(LONG))).alias("far")).select("entry_id", "far", F.expr(f"substring(seq, far + 1, {LONG + span - 1})").alias("part"))
    near = far.select("entry_id", "far", "part", F.explode(F.sequence(F.lit(0), F.least(F.length("part") - 1, F.lit(LONG - 1)), F.lit(OWN))).alias("near"))
    piece = F.expr(f"substring(part, near + 1, {OWN + span - 1})")
    pieces = near.select("entry_id", (F.col("far") + F.col("near")).cast("bigint").alias("base"), piece.alias("piece")).where(F.length("piece") >= span)
    return (pieces if read is None else pieces.withColumn("looked", read(F.col("piece")))).mapInArrow(run, ddl)


def seeds(sequences: DataFrame, patterns: DataFrame, k: int, word: int | None = None) -> DataFrame:
    """entry_id, pattern_id, pattern, at: the places alone, once each."""
    return _seeds(sequences, patterns, k, word, 0).drop("around").distinct()


def found(sequences: DataFrame, patterns: DataFrame, k: int, word: int | None = None, context: int = 0, read: Callable[[Column], Column] | None = None) -> DataFrame:
    """entry_id, pattern_id, pattern, start_pos, end_pos, edits, text, before, after: every hit with up to k substitutions, its letters and the ``context`` letters on both sides (BEYOND outside of the entry).

    Few patterns are compared with every place, many are found by seeds. read: turns a text's letters to those of the patterns, one for one; text, before and after have those of the text.
    """
    n, as_read = F.length("pattern"), read or (lambda x: x)
    if few := _few(patterns):
        parts = {m: [(0, m)] for m in facts(patterns).lengths if (pieces(m, k) if word is None else m >= word)}
        around = _compared(sequences, patterns, parts, k, context, context, read=read)
        skip = context
    else:
        around = _seeds(sequences, patterns, k, word, context, as_read).where(F.length("around") == n + 3 * context)
        skip = 2 * context
    whole = around.withColumn("text", F.substring("around", F.lit(skip + 1), n)).where(~F.contains("text", F.lit(BEYOND)))
    sides = F.substring("around", F.lit(skip - context + 1), F.lit(context)).alias("before"), F.substring("around", F.lit(skip + 1) + n, F.lit(context)).alias("after")
    if few:
        near = whole
        if word is not None and word > 1:  # a word of the pattern stands where it should
            shown = as_read(F.col("text"))
            near = near.where(F.exists(F.sequence(F.lit(1), n - word + 1), lambda i: F.substring(shown, i, F.lit(word)) == F.substring(F.col("pattern"), i, F.lit(word))))
    else:
        shown = as_read(F.col("text"))
        near = whole.withColumn("edits", S.hamming(shown, F.col("pattern")) if k else F.when(shown == F.col("pattern"), 0)).where(F.col("edits") <= k)
    out = near.select("entry_id", "pattern_id", "pattern", F.col("at").alias("start_pos"), (F.col("at") + n).alias("end_pos"), "edits", "text", *sides)
    return out if few else out.distinct()


def mismatches(sequences: DataFrame, patterns: DataFrame, k: int, word: int | None = None, left: int = 0, right: int = 0) -> DataFrame:
    """Up to k substitutions: seeds, then the distance. left, right: so many letters there must be equal."""
    if k == 0:
        return exact(sequences, patterns)
    near = found(sequences, patterns, k, word)
    if left:
        near = near.where(F.substring("text", 1, left) == F.substring("pattern", 1, left))
    if right:
        near = near.where(F.expr(f"right(text, {right}) = right(pattern, {right})"))
    return near.select("entry_id", "pattern_id", "start_pos", "end_pos", "edits")


def edit_ends(sequences: DataFrame, patterns: DataFrame, k: int, word: int | None = None, with_text: bool = False) -> DataFrame:
    """entry_id, pattern_id, end_pos, edits: every end at which a stretch is within k edits of a pattern, with the least number.

    with_text: also pattern and tail, the letters before the end, as many as the pattern has and k more (BEYOND outside of the entry).
    """
    n = F.length("pattern")
    if _few(patterns):
        parts = {m: pieces(m, k) if word is None else [(i, word) for i in range(m - word + 1)] for m in facts(patterns).lengths}
        placed = _compared(sequences, patterns, parts, 0, 2 * k, k, early=k)
    else:
        placed = _seeds(sequences, patterns, k, word, k)
    found = placed.withColumn("shift", F.explode(F.sequence(F.lit(-k), F.lit(k))))
    tail = F.substring("around", F.lit(1), n + 2 * k + F.col("shift"))  # all that ends there; the last k * 2 + n letters of it are looked at
    tries = F.transform(F.sequence(F.greatest(n - k, F.lit(1)), n + k), lambda m: F.struct(m.alias("m"), F.right(F.col("tail"), m).alias("text")))
    costs = F.transform(F.filter(tries, lambda x: (F.length(x["text"]) == x["m"]) & ~F.contains(x["text"], F.lit(BEYOND))), lambda x: F.levenshtein(F.col("pattern"), x["text"], k))
    own = ["pattern", "tail"] if with_text else []
    ends = found.withColumn("tail", tail).select("entry_id", "pattern_id", (F.col("at") + n + F.col("shift")).alias("end_pos"), F.array_min(F.filter(costs, lambda d: d >= 0)).alias("edits"), *own)
    ends = ends.where("edits is not null")
    if with_text:
        ends = ends.withColumn("tail", F.right("tail", F.length("pattern") + k))
    return ends.groupBy("entry_id", "pattern_id", "end_pos", *own).agg(F.min("edits").alias("edits"))


def clusters(ends: DataFrame, k: int) -> DataFrame:
    """entry_id, pattern_id, first_end, last_end, edits: ends of one pattern less than 2k + 2 apart are one hit.

    Of ends with text: also pattern and text, the letters of the entry from length(pattern) + k before the first end to the last end, put
    together from the ends' tails, so the entry is not read again.
    """
    order = Window.partitionBy("entry_id", "pattern_id").orderBy("end_pos")
    ahead = F.col("end_pos") - F.lag("end_pos").over(order)
    new = (ahead > 2 * k + 1).cast("int")
    marked = ends.withColumn("ahead", ahead).withColumn("cluster", F.sum(F.coalesce(new, F.lit(1))).over(order))
    about = [F.min("end_pos").alias("first_end"), F.max("end_pos").alias("last_end"), F.min("edits").alias("edits")]
    if "tail" not in ends.columns:
        return marked.groupBy("entry_id", "pattern_id", "cluster").agg(*about).drop("cluster")
    added = F.when(F.col("ahead") <= 2 * k + 1, F.expr("right(tail, int(ahead))")).otherwise(F.col("tail"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("end_pos", "added"))), lambda x: x["added"]), "")
    made = marked.withColumn("added", added).groupBy("entry_id", "pattern_id", "pattern", "cluster").agg(*about, F.replace(texts, F.lit(BEYOND), F.lit("")).alias("text"))
    return made.drop("cluster")


def counts(hits: DataFrame, patterns: DataFrame, k: int = 0, cap: int | None = None) -> DataFrame:
    """pattern_id, n_0 .. n_k (hits by edits), n, capped: patterns without a hit count 0."""
    by = hits.groupBy("pattern_id").agg(*(F.count_if(F.col("edits") == i).alias(f"n_{i}") for i in range(k + 1)), F.count("*").alias("n"))
    out = patterns.select("pattern_id").hint("merge").join(by, "pattern_id", "left").fillna(0)  # what is made of the sequences is never broadcast
    return out.withColumn("capped", F.lit(False) if cap is None else F.col("n") >= cap).withColumn("n", F.col("n") if cap is None else F.least("n", F.lit(cap)))
