"""Duplicates, containment and uniqueness.

Tables made of listed words have no size that Spark knows beforehand, so they are merged, never broadcast.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S
from ..plans.lineage import cut
from . import held, shared
from .kmers import dna_words, fits, sized, words


def non_redundant(sequences: DataFrame) -> DataFrame:
    """entry_id (the smallest), deflines joined by ; in order of entry, n, seq: one row for each different sequence. Pre-aggregated by hash; sequences: entry_id, defline, seq."""
    rows = sequences.groupBy("seq").agg(F.min("entry_id").alias("entry_id"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("entry_id", "defline"))).alias("all"))
    return rows.select("entry_id", F.array_join(F.transform("all", lambda x: x["defline"]), ";").alias("deflines"), "n", "seq")


#: Letters that a part is looked up by; shorter parts are looked up whole.
SEED = 32
#: Places are thinned out by so many hashes, 64 a row of the table that is sent around.
HASHES = 1 << 24
#: Up to so many letters in all, parts are looked up by joins.
FEW_LETTERS = 1 << 20


def _contained_by_words(sequences: DataFrame, seed: int, skip_short: bool) -> DataFrame:
    """``contained`` for few letters, by joins alone: candidates take rows of their own, which large tables have no room for.

    Equal sequences are compared once, by the first of them, and their pairs put in at the end. A part of ``SEED`` letters and more is looked up by its first ones among all words of that
    size, which the hashes of those looked for thin out before any place is exchanged. At a place that is left the digests of its first 32, 64, 128 and so on letters are looked up, among
    them as many as the part has to the last power of two; then the digest of the whole part is compared, so no candidate takes a text along.
    Shorter ones are matched as patterns are. Sequences under ``seed`` letters are compared by their own whole text, or skipped.
    """
    from . import match

    every = cut(sequences.select("entry_id", F.length("seq").alias("n"), F.md5(F.col("seq").cast("binary")).alias("key")).where("n > 0"))
    first = cut(every.groupBy("key", "n").agg(F.min("entry_id").alias("entry_id")))
    own = sequences.select("entry_id", "seq").join(first.select("entry_id"), "entry_id", "left_semi")
    parts = own.select(F.col("entry_id").alias("part"), "seq", F.length("seq").alias("n"))

    brief = cut(parts.where((F.col("n") >= seed) & (F.col("n") < SEED)).select(F.col("part").alias("pattern_id"), F.col("seq").alias("pattern")))
    found = match.exact(own, brief).select(F.col("pattern_id").alias("part"), F.col("entry_id").alias("whole")).where("part != whole").distinct()

    wanted = cut(parts.where(F.col("n") >= max(seed, SEED)).select("part", "n", F.md5(F.col("seq").cast("binary")).alias("key"), F.expr(f"left(seq, {SEED})").alias("mer"), F.floor(F.log2("n") + 1e-9).cast("int").alias("level"), F.expr("md5(cast(left(seq, cast(shiftleft(1, cast(floor(log2(n) + 1e-9) as int)) as int)) as binary))").alias("digest")))
    code = F.pmod(F.xxhash64("mer"), F.lit(HASHES))
    bits = wanted.select(code.alias("_code")).select(F.shiftright("_code", 6).alias("_high"), F.expr("shiftleft(1L, cast(_code & 63 as int))").alias("_bit")).groupBy("_high").agg(F.expr("bit_or(_bit)").alias("_bits"))
    places = words(own, SEED).select(F.col("entry_id").alias("whole"), F.col("pos").alias("p"), F.col("kmer").alias("mer")).withColumn("_code", code).withColumn("_high", F.shiftright("_code", 6))
    near = places.join(F.broadcast(bits), "_high").where("bit_get(_bits, cast(_code & 63 as int)) = 1").select("whole", "p", "mer")
    near = near.hint("merge").join(wanted.select("mer").distinct(), "mer", "left_semi").select("whole", "p")
    texts = own.withColumnRenamed("entry_id", "whole")
    levels = F.expr(f"transform(filter(sequence({SEED.bit_length() - 1}, 30), j -> shiftleft(1, j) <= length(seq) - p), j -> struct(j as level, md5(cast(substring(seq, p + 1, shiftleft(1, j)) as binary)) as digest))")
    begun = near.hint("merge").join(texts, "whole").select("whole", "p", F.explode(levels).alias("x")).select("whole", "p", "x.*")
    tries = begun.hint("merge").join(wanted, ["level", "digest"]).where("part != whole").select("part", "whole", "p", "n", "key")
    held = tries.join(texts, "whole").where("p + n <= length(seq)").where(F.md5(F.expr("substring(seq, p + 1, n)").cast("binary")) == F.col("key"))
    found = found.unionByName(held.select("part", "whole").distinct())

    for n in [] if skip_short else range(1, seed):
        tiny = cut(parts.where(F.col("n") == n).select("part", F.col("seq").alias("kmer")))
        at = words(own, n).join(F.broadcast(tiny.select("kmer")), "kmer", "left_semi").select(F.col("entry_id").alias("whole"), "kmer").distinct()
        found = found.unionByName(at.join(tiny, "kmer").where("part != whole").select("part", "whole"))
    same = every.join(first.withColumnRenamed("entry_id", "first"), ["key", "n"])
    of = lambda role: same.select(F.col("first").alias(role), F.col("entry_id").alias(f"_{role}"))
    return found.join(of("part"), "part").join(of("whole"), "whole").select(F.col("_part").alias("part"), F.col("_whole").alias("whole"))


def contained(sequences: DataFrame, seed: int = 6, skip_short: bool = False) -> DataFrame:
    """part, whole: pairs of different sequences one of which contains the other.

    Equal sequences are looked for once, and their pairs put in at the end. All texts are read once for every ``held.PARTS`` different ones, and what stands in them is found
    there, so neither places nor texts are exchanged; of ``FEW_LETTERS`` in all, words are merged instead. skip_short: sequences under ``seed`` letters are no parts.
    """
    every, first = held.parted(sequences)
    if (every.agg(F.sum("n")).first()[0] or 0) <= FEW_LETTERS:
        return _contained_by_words(sequences, seed, skip_short)
    found = held.holders(sequences, first.where(F.col("n") >= seed) if skip_short else first)
    parts = every.select("key", F.col("entry_id").alias("part"))
    return found.join(sized(parts, 24), "key").where("part != whole").select("part", "whole")


def non_redundant_with_containment(sequences: DataFrame) -> DataFrame:
    """The sequences that no longer one contains, with the number of entries that each stands for. Who holds whom is told by keys; the texts are put in at the end."""
    every, first = held.parted(sequences)
    inside = cut(held.holders(sequences, first).select("key", "whole_key").distinct())
    n_held = inside.join(sized(first.select("key", "copies"), 24), "key").groupBy(F.col("whole_key").alias("key")).agg(F.sum("copies").alias("n_held"))
    kept = first.hint("merge").join(inside.select("key").distinct(), "key", "left_anti").hint("merge").join(n_held, "key", "left")
    kept = kept.select("entry_id", F.lower(F.hex("key")).alias("_key"), (F.col("copies") + F.coalesce("n_held", F.lit(0))).alias("n"))
    texts = sequences.select("entry_id", "seq").withColumn("_key", F.md5(F.col("seq").cast("binary")))
    out = texts.where("seq != ''").hint("merge").join(kept, ["entry_id", "_key"]).dropDuplicates(["entry_id", "_key"]).select("entry_id", "seq", "n")
    empty = sequences.where("seq = ''").groupBy("seq").agg(F.min("entry_id").alias("entry_id"), F.count("*").alias("n"))
    return out.unionByName(empty.select("entry_id", "seq", "n"))


#: Words of A, C, G and T of up to so many letters are looked up as bits, 64 words a row of the table that is sent around (2^18 rows at most).
BIT_LETTERS = 12


def of_words(places: DataFrame, chosen: DataFrame, m: int, rest: DataFrame | None = None) -> DataFrame:
    """The places whose word (kmer, of m letters, ACGT) is one of the chosen ones (kmer, once each). rest: all other words of the places, if they are known.

    The fewer of both are sent around; if they are too many and have up to ``BIT_LETTERS`` letters, then a bit for each, so no place is exchanged.
    """
    chosen = cut(chosen)
    if fits(chosen, m):
        return places.join(F.broadcast(chosen), "kmer", "left_semi").select(*places.columns)
    if rest is not None and fits(rest := cut(rest), m):
        return places.join(F.broadcast(rest), "kmer", "left_anti").select(*places.columns)
    if m > BIT_LETTERS:
        return places.join(chosen.hint("merge"), "kmer", "left_semi").select(*places.columns)
    coded = chosen.select(S.kmer_code("kmer").alias("_code")).select(F.shiftright("_code", 6).alias("_high"), F.expr("shiftleft(1L, cast(_code & 63 as int))").alias("_bit"))
    bits = coded.groupBy("_high").agg(F.expr("bit_or(_bit)").alias("_bits"))
    found = places.withColumn("_code", S.kmer_code("kmer")).withColumn("_high", F.shiftright("_code", 6)).join(F.broadcast(bits), "_high")
    return found.where("bit_get(_bits, cast(_code & 63 as int)) = 1").select(*places.columns)


def unique_words(sequences: DataFrame, m: int, both_strands: bool = True) -> DataFrame:
    """entry_id, pos, kmer of the ACGT words of m letters that occur at one place only, of both strands if asked."""
    own = dna_words(sequences, m)
    counted = own.groupBy("kmer").agg(F.count("*").alias("n"))
    if both_strands:
        counted = cut(counted)
        counted = counted.unionByName(counted.select(S.reverse_complement("kmer").alias("kmer"), "n")).groupBy("kmer").agg(F.sum("n").alias("n"))
    return of_words(own, counted.where("n = 1").select("kmer"), m)


def near_words(queries: DataFrame, others: DataFrame, m: int, k: int, left: int = 0, right: int = 0) -> DataFrame:
    """kmer, b_kmer: all pairs of ACGT words of m letters (queries: kmer; others: b_kmer; each word once) with at most k substitutions, none in the first ``left`` and last ``right`` letters.

    By masked words: two such words are equal in all but some k places. A word has a row for each choice of k places, and of the words that agree in the rest there are
    at most 4^k, so the work is linear in the words.
    """
    groups = others.select("b_kmer", _masks("b_kmer", m, k, left, right)).groupBy("x.mask", "x.rest").agg(F.collect_list("b_kmer").alias("words"))
    pairs = queries.select("kmer", _masks("kmer", m, k, left, right)).select("kmer", "x.*").hint("merge").join(groups, ["mask", "rest"])
    return pairs.select("kmer", F.explode("words").alias("b_kmer")).distinct()


def near_lengths(queries: DataFrame, shorter: DataFrame, longer: DataFrame, m: int, left: int = 0, right: int = 0) -> DataFrame:
    """kmer, b_kmer: pairs of a word of m letters and one of a letter less or more that one deletion or insertion makes equal. queries: kmer; shorter, longer: b_kmer; each word once.

    By deletion neighbourhoods: a word's m shortened forms are looked up among the shorter words, and the shortened forms of the longer words among the queries.
    """

    def shortened(word: str, first: int, last: int) -> Column:
        forms = [F.concat(F.expr(f"left({word}, {i})"), F.expr(f"substring({word}, {i + 2})")) for i in range(first, last)]
        return F.explode(F.array_distinct(F.array(*forms))) if forms else F.explode(F.array().cast("array<string>"))

    less = queries.select("kmer", shortened("kmer", left, m - right).alias("b_kmer")).hint("merge").join(shorter, "b_kmer").select("kmer", "b_kmer")
    # an extra letter may stand before, between and behind those that may be missed, not inside of exact ends
    more = longer.select("b_kmer", shortened("b_kmer", left, m + 1 - right).alias("kmer")).hint("merge").join(queries, "kmer").select("kmer", "b_kmer")
    return less.unionByName(more).distinct()


#: Of places, the least and greatest entry and position: where the entries differ, a place of another entry is among them; where not, the positions are all of that entry.
def _widest() -> list[Column]:
    return [F.min("e0").alias("e0"), F.max("e1").alias("e1"), F.min("p0").alias("p0"), F.max("p1").alias("p1")]


def _spans(places: DataFrame, both_strands: bool = False) -> DataFrame:
    """kmer, e0, e1, p0, p1: numbers alone, so that they are put together by hash where they are read. places: entry_id, pos, kmer; both strands: words are turned when they are counted, not place by place."""
    found = places.groupBy("kmer").agg(F.min("entry_id").alias("e0"), F.max("entry_id").alias("e1"), F.min("pos").alias("p0"), F.max("pos").alias("p1"))
    if not both_strands:
        return found
    found = cut(found)
    return found.unionByName(found.withColumn("kmer", S.reverse_complement("kmer"))).groupBy("kmer").agg(*_widest())


def _masks(word: str, m: int, k: int, left: int, right: int) -> Column:
    """x.mask, x.rest: the word without each choice of k places, none in the first ``left`` and last ``right`` letters."""
    places = list(combinations(range(left, m - right), min(k, m - right - left))) if k and m > left + right else [()]
    shown = lambda chosen: F.concat(*(F.substring(word, a + 2, b - a - 1) for a, b in zip((-1, *chosen), (*chosen, m), strict=True)))
    return F.explode(F.array(*(F.struct(F.lit(i).alias("mask"), shown(x).alias("rest")) for i, x in enumerate(places)))).alias("x")


def _around(spans: DataFrame, m: int, k: int, left: int, right: int) -> DataFrame:
    """kmer, e0, e1, p0, p1 of all places of words with at most k substitutions, for each word of the spans. Words that agree but for k places share a masked word, so no pairs are listed."""
    if not k:
        return spans
    masked = cut(spans).select("kmer", _masks("kmer", m, k, left, right), "e0", "e1", "p0", "p1").select("kmer", "x.*", "e0", "e1", "p0", "p1")
    return masked.select("kmer", "mask", "rest").hint("merge").join(masked.groupBy("mask", "rest").agg(*_widest()), ["mask", "rest"]).groupBy("kmer").agg(*_widest())


def _away(places: DataFrame, around: DataFrame, m: int, own: bool) -> DataFrame:
    """entry_id, pos of the places of which one of those around lies in another entry or m places away at least. around: see ``_spans``, of each word of the places; own: they are among them.

    A word with places in two entries has them all; only of words in one entry, m places apart, are the places looked at.
    """
    everywhere = of_words(places, around.where("e0 != e1").select("kmer"), m, around.where("e0 = e1").select("kmer") if own else None).select("entry_id", "pos")
    alone = cut(around.where(f"e0 = e1 and p1 - p0 >= {m}" if own else "e0 = e1"))
    near = of_words(places, alone.select("kmer"), m)
    return everywhere.unionByName(near.hint("merge").join(alone, "kmer").where(f"e0 != entry_id or abs(p0 - pos) >= {m} or abs(p1 - pos) >= {m}").select("entry_id", "pos"))


def _elsewhere(sequences: DataFrame, m: int, k: int, both_strands: bool, left: int, right: int) -> tuple[np.ndarray, DataFrame | None]:
    """Of ``matched_elsewhere`` over one table: the words all of whose places are matched, as near one that stands in two entries, and entry_id, pos of the other places, if there are any.

    Only those of the others are listed, and what is near them; there the least and greatest places are compared.
    """
    seen, again = shared.owners(sequences.select("entry_id", "seq"), m)
    strands = seen | shared.turned(seen, m) if both_strands else seen
    sure = shared.near(again | shared.turned(again, m) if both_strands else again, m, k, left, right)
    unsure = seen & ~sure
    if not unsure.any():
        return sure, None
    close = shared.near(unsure, m, k, left, right) & strands
    listed = cut(shared.places(sequences, m, seen & (close | shared.turned(close, m)) if both_strands else close, unsure))
    around = cut(_around(_spans(listed, both_strands), m, k, left, right))
    return sure, _away(listed.where("marked").select("entry_id", "pos", "kmer"), around, m, own=True)


def n_matched_elsewhere(sequences: DataFrame, m: int, k: int = 0, both_strands: bool = False, left: int = 0, right: int = 0) -> DataFrame:
    """entry_id, n: how many places ``matched_elsewhere`` of a table with itself has in each entry, of entries with any."""
    if m > shared.LETTERS or k > 1 or not shared.one_row_each(sequences):
        found = matched_elsewhere(sequences, sequences, m, k, same=True, both_strands=both_strands, left=left, right=right)
        return found.groupBy("entry_id").agg(F.count("*").alias("n"))
    sure, others = _elsewhere(sequences, m, k, both_strands, left, right)
    found = shared.counts(sequences, m, sure)
    if others is not None:
        found = found.unionByName(others.groupBy("entry_id").agg(F.count("*").alias("n"))).groupBy("entry_id").agg(F.sum("n").alias("n"))
    return found


def matched_elsewhere(queries: DataFrame, background: DataFrame, m: int, k: int = 0, same: bool = False, inexact_only: bool = False, both_strands: bool = False, edits: bool = False, left: int = 0, right: int = 0) -> DataFrame:
    """entry_id, pos of the query words of m letters that occur in the background with at most k substitutions (with edits, k of 1: or one letter more or less).

    same: the background is the queries' own table, and a word doesn't match at places nearer than m in its entry. both_strands: the background is read on both.
    inexact_only: only what differs from the word counts. left, right: so many letters at the ends must be equal. Different words are compared once.
    """
    if edits and k != 1:
        raise ValueError("with edits k is 1")

    if same and not edits and not inexact_only and m <= shared.LETTERS and k <= 1 and shared.one_row_each(queries):
        sure, others = _elsewhere(queries, m, k, both_strands, left, right)
        found = shared.places(queries, m, sure)
        return found if others is None else found.unionByName(others)

    def stretches(n: int) -> DataFrame:
        return dna_words(background, n)

    q, b = dna_words(queries, m), stretches(m)
    if same and not edits and not inexact_only:
        return _away(q, cut(_around(_spans(b, both_strands), m, k, left, right)), m, own=True)

    def different(places: DataFrame) -> DataFrame:
        found = places.select("kmer").distinct()
        return (found.unionByName(found.select(S.reverse_complement("kmer").alias("kmer"))).distinct() if both_strands else found).withColumnRenamed("kmer", "b_kmer")

    words_q = q.select("kmer").distinct()
    close = near_words(words_q, different(b), m, k, left, right)
    if edits:
        shorter, longer = stretches(m - 1), stretches(m + 1)
        close = close.unionByName(near_lengths(words_q, different(shorter), different(longer), m, left, right))
        b = b.unionByName(shorter).unionByName(longer)
    if inexact_only:
        close = close.where("kmer != b_kmer")
    if not same:
        return of_words(q, close.select("kmer").distinct(), m).select("entry_id", "pos")
    around = close.hint("merge").join(_spans(b, both_strands).withColumnRenamed("kmer", "b_kmer"), "b_kmer").groupBy("kmer").agg(*_widest())
    return _away(q, cut(around), m, own=False)


#: Groups whose numbers are sent around.
GROUPS = 1 << 15


def _owned(sequences: DataFrame, m: int) -> tuple[np.ndarray, np.ndarray] | None:
    """``shared.owners`` of the groups, if each is one entry or if there are few of them, and if tables of the words are kept."""
    if m > shared.LETTERS:
        return None
    kinds = dict(sequences.dtypes)
    if kinds["group"] == kinds["entry_id"] and sequences.where("not (group <=> entry_id)").isEmpty() and shared.one_row_each(sequences):
        return shared.owners(sequences.select("entry_id", "seq"), m)
    groups = [r[0] for r in sequences.select("group").where("group is not null").distinct().limit(GROUPS + 1).collect()]
    if len(groups) > GROUPS:
        return None
    numbers = sequences.sparkSession.createDataFrame(list(enumerate(groups)), f"number int, group {kinds['group']}")
    return shared.owners(sequences.join(F.broadcast(numbers), "group").select("entry_id", "seq", F.col("number").alias("group")), m)


def n_matched_in_others(sequences: DataFrame, m: int) -> DataFrame:
    """entry_id, n: how many places ``matched_in_others`` has in each entry, of entries with any."""
    if (owned := _owned(sequences, m)) is None:
        return matched_in_others(sequences, m).groupBy("entry_id").agg(F.count("*").alias("n"))
    return shared.counts(sequences, m, owned[1])


def matched_in_others(sequences: DataFrame, m: int) -> DataFrame:
    """entry_id, pos of the ACGT words of m letters that stand in an entry of another group too. sequences: entry_id, seq, group (the last word of the defline, say).

    Of each word the least and the greatest group are enough, so a frequent word is one row.
    """
    if owned := _owned(sequences, m):
        return shared.places(sequences, m, owned[1])
    spans, own = cut(_groups(sequences, m)), dna_words(sequences, m)
    return of_words(own, spans.where("g0 != g1").select("kmer"), m, spans.where("g0 = g1").select("kmer")).select("entry_id", "pos")


def in_one_group(sequences: DataFrame, m: int) -> DataFrame:
    """entry_id, pos of the other ACGT words: those that stand in entries of one group only."""
    if owned := _owned(sequences, m):
        return shared.places(sequences, m, owned[0] & ~owned[1])
    spans = cut(_groups(sequences, m))
    return of_words(dna_words(sequences, m), spans.where("g0 = g1").select("kmer"), m, spans.where("g0 != g1").select("kmer")).select("entry_id", "pos")


def _groups(sequences: DataFrame, m: int) -> DataFrame:
    """kmer, g0, g1: of each ACGT word the least and the greatest group. Groups are numbers, or are numbered, so that they are put together by hash where the words are read."""
    if dict(sequences.dtypes)["group"] != "bigint":
        numbers = cut(sequences.select("group").distinct().withColumn("number", F.monotonically_increasing_id()))
        sequences = sequences.join(numbers, "group").withColumn("group", F.col("number"))
    grouped = dna_words(sequences.select(F.col("group").alias("entry_id"), "seq"), m)
    return grouped.groupBy("kmer").agg(F.min("entry_id").alias("g0"), F.max("entry_id").alias("g1"))
