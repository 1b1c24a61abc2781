"""Runs, islands, intervals and position sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq as S
from ..plans.lineage import cut
from . import match
from .kmers import BEYOND, LONG, chunks, far_pieces
from .shared import one_row_each

#: Pieces that a task looks through at once.
AT_ONCE = 32


def runs(sequences: DataFrame, shortest: int = 20, only_n: bool | None = False, any_as_n: bool = False) -> DataFrame:
    """entry_id, symbol, start, len of maximal runs of one letter.

    only_n: False other letters than N, True N alone, None both. any_as_n: whatever is not A, C, G or T counts as N, and only that is looked for.
    """
    letters = F.regexp_replace("piece", "[^ACGT]", "N") if any_as_n else F.col("piece")
    only_n = True if any_as_n else only_n
    pieces = chunks(sequences, 1).select("entry_id", "base", letters.alias("piece"), F.length("piece").alias("n"))
    starts = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: (i == 1) | (F.substring("piece", i, F.lit(1)) != F.substring("piece", i - 1, F.lit(1))))
    laid = pieces.select("entry_id", "base", "piece", "n", starts.alias("starts"))
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.col("n") + 1))
    found = F.zip_with("starts", ends, lambda a, b: F.struct(a.alias("at"), (b - a).alias("len")))
    # What is too short goes at once, unless it touches the border of a piece: it may go on behind it.
    kept = F.filter(found, lambda x: (x["len"] >= shortest) | (x["at"] == 1) | (x["at"] + x["len"] > F.col("n")))
    own = laid.select("entry_id", "base", "piece", F.explode(kept).alias("x"))
    own = own.select("entry_id", F.substring("piece", F.col("x.at"), F.lit(1)).alias("symbol"), (F.col("base") + F.col("x.at") - 1).cast("bigint").alias("start"), F.col("x.len").cast("bigint").alias("len"))
    order = Window.partitionBy("entry_id").orderBy("start")
    goes_on = (F.lag("symbol").over(order) == F.col("symbol")) & (F.lag(F.col("start") + F.col("len")).over(order) == F.col("start"))
    marked = own.withColumn("fresh", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(order))
    out = marked.groupBy("entry_id", "run").agg(F.min("symbol").alias("symbol"), F.min("start").alias("start"), F.sum("len").alias("len")).drop("run").where(F.col("len") >= shortest)
    return out if only_n is None else out.where((F.col("symbol") == "N") == F.lit(only_n))


def islands(points: DataFrame, key: str = "entry_id", at: str = "pos") -> DataFrame:
    """key, start, len of maximal runs of neighbouring integers."""
    order = Window.partitionBy(key).orderBy(at)
    marked = points.select(key, at).distinct().withColumn("island", F.col(at) - F.row_number().over(order))
    return marked.groupBy(key, "island").agg(F.min(at).alias("start"), F.count("*").alias("len")).drop("island")


def complement(found: DataFrame, spans: DataFrame, key: str = "entry_id") -> DataFrame:
    """key, start, len of what the runs leave of each span. spans: key, size."""
    order = Window.partitionBy(key).orderBy("start")
    ends = found.select(key, "start", (F.col("start") + F.col("len")).alias("end"))
    edge = spans.select(key, F.col("size").cast("bigint").alias("start"), F.col("size").cast("bigint").alias("end"))
    gaps = ends.unionByName(edge).select(key, F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("from"), "start")
    return gaps.where("start > `from`").select(key, F.col("from").alias("start"), (F.col("start") - F.col("from")).alias("len"))


def to_points(found: DataFrame, key: str = "entry_id") -> DataFrame:
    """Every integer of the runs, once."""
    return found.where("len > 0").select(key, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("pos")).distinct()


def counters(points: DataFrame, spans: DataFrame, key: str = "entry_id") -> DataFrame:
    """key, n_set, n_unset, n_runs. spans: key, size."""
    sets = islands(points, key).groupBy(key).agg(F.sum("len").alias("n_set"), F.count("*").alias("n_runs"))
    return spans.join(sets, key, "left").select(key, F.coalesce("n_set", F.lit(0)).alias("n_set"), (F.col("size") - F.coalesce("n_set", F.lit(0))).alias("n_unset"), F.coalesce("n_runs", F.lit(0)).alias("n_runs"))


def merged(intervals: DataFrame) -> DataFrame:
    """entry_id, start, length, ids (joined by :, in order) of intervals that overlap. intervals: id, entry_id, start, length."""
    order = Window.partitionBy("entry_id").orderBy("start", "length", "id")
    before = F.max(F.col("start") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0)
    marked = intervals.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order))
    grouped = marked.groupBy("entry_id", "island").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"), F.array_sort(F.collect_list(F.struct("start", "length", "id"))).alias("all"))
    return grouped.select("entry_id", "start", (F.col("end") - F.col("start")).alias("length"), F.array_join(F.transform("all", lambda x: x["id"]), ":").alias("ids"))


def between(intervals: DataFrame, entries: DataFrame, ends: bool = False) -> DataFrame:
    """entry_id, start, length of the stretches between intervals; with the first and last of an entry if asked. entries: entry_id, size."""
    order = Window.partitionBy("entry_id").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    rows = intervals.select("entry_id", "start", "length", F.max(F.col("start") + F.col("length")).over(order).alias("from"))
    gaps = rows.select("entry_id", F.coalesce("from", F.lit(0)).alias("from") if ends else F.col("from"), F.col("start").alias("to"))
    if ends:
        last = intervals.groupBy("entry_id").agg(F.max(F.col("start") + F.col("length")).alias("from"))
        gaps = gaps.unionByName(last.join(entries, "entry_id").select("entry_id", "from", F.col("size").cast("bigint").alias("to")))
    return gaps.where("`to` > `from`").select("entry_id", F.col("from").alias("start"), (F.col("to") - F.col("from")).alias("length"))


def extract(sequences: DataFrame, places: DataFrame) -> DataFrame:
    """The places' columns and their letters; those that leave their entry drop. places: entry_id, start, length.

    A negative entry_id means that start is absolute: counted in the stream of all entries, each behind one terminator.
    """
    own = places.where("entry_id >= 0")
    if "abs_start" in sequences.columns:
        # Absolute places find their entry by bins of the stream, so the range join is an equi-join.
        stream = places.where("entry_id < 0").withColumnRenamed("start", "abs_pos").drop("entry_id").withColumn("bin", F.floor(F.col("abs_pos") / LONG))
        at = sequences.select("entry_id", "abs_start", F.length("seq").alias("n")).where("n > 0")
        at = at.withColumn("bin", F.explode(F.sequence(F.floor(F.col("abs_start") / LONG), F.floor((F.col("abs_start") + F.col("n") - 1) / LONG))))
        found = stream.join(at, "bin").where("abs_pos >= abs_start and abs_pos < abs_start + n").withColumn("start", F.col("abs_pos") - F.col("abs_start"))
        own = own.unionByName(found.select(own.columns))
    longest = own.agg(F.coalesce(F.max("length"), F.lit(0))).first()[0]
    sizes = sequences.select("entry_id", F.length("seq").alias("size"))
    held = own.join(sizes, "entry_id").where("start >= 0 and length >= 0 and start + length <= size").withColumn("far", (F.floor(F.col("start") / LONG) * LONG).cast("bigint"))
    out = held.join(far_pieces(sequences, longest), ["entry_id", "far"], "left")
    return out.withColumn("text", F.coalesce(S.subsequence("part", F.col("start") - F.col("far"), "length"), F.lit(""))).drop("part", "far", "size")


def annotated(sequences: DataFrame, places: DataFrame) -> DataFrame:
    """Extraction with header, strand and N statistics. places: id, entry_id, start, length, sense_seq, sense_comp (0 or 1)."""
    out = extract(sequences, places)
    out = out.withColumn("text", F.when((F.col("sense_seq") == 1) & (F.col("sense_comp") == 1), S.reverse_complement("text")).otherwise(F.col("text")))
    n, longest = S.n_count("text"), S.longest_n_run("text")
    stats = F.when(n > 0, F.concat(F.lit(" /Ns="), n.cast("string"), F.lit(" /nonNs="), (F.col("length") - n).cast("string"), F.lit(" /maxContigN="), longest.cast("string"))).otherwise(F.lit(""))
    header = F.concat("id", F.lit(" /start="), F.col("start").cast("string"), F.lit(" /end="), (F.col("start") + F.col("length")).cast("string"), F.lit(" /length="), F.col("length").cast("string"), stats)
    return out.select("id", "entry_id", "start", "length", header.alias("header"), "text")


def tandems(hits: DataFrame, motif_length: str, min_copies: int = 2, min_length: int = 0) -> DataFrame:
    """entry_id, pattern_id, start, copies, length of chains of hits exactly one motif apart. motif_length: a column of the hits."""
    n = F.col(motif_length)
    phase = Window.partitionBy("entry_id", "pattern_id", F.col("start_pos") % n).orderBy("start_pos")
    marked = hits.withColumn("chain", F.col("start_pos") - n * F.row_number().over(phase))
    grouped = marked.groupBy("entry_id", "pattern_id", F.col(motif_length).alias("m"), "chain").agg(F.min("start_pos").alias("start"), F.count("*").alias("copies"))
    return grouped.select("entry_id", "pattern_id", "start", "copies", (F.col("copies") * F.col("m")).cast("bigint").alias("length")).where((F.col("copies") >= min_copies) & (F.col("length") >= min_length))


def tandem_motifs(sequences: DataFrame, motifs: DataFrame, min_copies: int = 2) -> DataFrame:
    """entry_id, pattern_id, start, copies, length: ``tandems`` of all places of few motifs (pattern_id, pattern), without a row a hit.

    Chains are followed where a piece of an entry is read; those that touch a piece's border are put together with what lies behind it. Entries of several rows are left to ``tandems``.
    """
    wanted = sorted((r["pattern_id"], r["pattern"]) for r in motifs.select("pattern_id", "pattern").distinct().collect() if r["pattern"])
    if not wanted or not one_row_each(sequences):
        return tandems(match.exact(sequences, motifs).withColumn("m", F.col("end_pos") - F.col("start_pos")), "m", min_copies)
    longest, long = max(len(p) for _, p in wanted), LONG

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, far = batch.column("part").to_pylist(), batch.column("far").to_numpy()
            for low in range(0, len(texts), AT_ONCE):
                own, base = texts[low : low + AT_ONCE], far[low : low + AT_ONCE]
                held = np.fromiter(map(len, own), np.int64, len(own)) + 1  # a letter that no motif has stands between
                begin = np.cumsum(held) - held
                text = np.frombuffer((BEYOND.join(own) + BEYOND).encode("utf-32-le"), np.uint32)
                for i, p in wanted:
                    m, n = len(p), len(text) - len(p) + 1
                    stands = np.ones(max(0, n), bool)
                    for j, c in enumerate(p):
                        stands &= text[j : j + n] == ord(c)
                    at = np.flatnonzero(stands)
                    row = np.searchsorted(begin, at, "right") - 1
                    place = at - begin[row]
                    at, row, place = (x[place < long] for x in (at, row, place))
                    order = np.argsort(at % m, kind="stable")
                    at, row, place = at[order], row[order], place[order]
                    fresh = np.flatnonzero(np.diff(at, prepend=-m - 1) != m) if len(at) else at
                    copies = np.diff(fresh, append=len(at))
                    last = place[fresh] + copies * m
                    open_ = (place[fresh] < m) & (base[row[fresh]] > 0) | (last >= long)
                    kept = np.flatnonzero(open_ | (copies >= min_copies))
                    row, place = row[fresh[kept]], place[fresh[kept]]
                    columns = [batch.column("entry_id").take(pa.array(row + low)), pa.repeat(pa.scalar(i, pa.int64()), len(kept)), pa.repeat(pa.scalar(m, pa.int64()), len(kept)), pa.array(base[row] + place), pa.array(copies[kept]), pa.array(open_[kept])]
                    yield pa.RecordBatch.from_arrays(columns, names=["entry_id", "pattern_id", "m", "start", "copies", "open"])

    ddl = f"entry_id {dict(sequences.dtypes)['entry_id']}, pattern_id bigint, m bigint, start bigint, copies bigint, open boolean"
    found = cut(far_pieces(sequences, longest - 1).mapInArrow(run, ddl))
    phase = Window.partitionBy("entry_id", "pattern_id", F.col("start") % F.col("m")).orderBy("start")
    goes_on = F.lag(F.col("start") + F.col("copies") * F.col("m")).over(phase) == F.col("start")
    marked = found.where("open").withColumn("chain", F.sum(F.when(goes_on, 0).otherwise(1)).over(phase)).withColumn("phase", F.col("start") % F.col("m"))
    joined = marked.groupBy("entry_id", "pattern_id", "m", "phase", "chain").agg(F.min("start").alias("start"), F.sum("copies").alias("copies")).where(F.col("copies") >= min_copies)
    names = ["entry_id", "pattern_id", "start", "copies", (F.col("copies") * F.col("m")).alias("length")]
    return found.where("not open").select(*names).unionByName(joined.select(*names))


def last_at_most(queries: DataFrame, keys: DataFrame, by: str, query: str, key: str) -> DataFrame:
    """As-of lookup: each query row with the largest key of its group at or before it, null if there is none.

    One union and one running window; no range join, so no query meets more than one row.
    """
    a = queries.select(by, F.col(query).alias("at"), F.lit(1).alias("side"), F.lit(None).cast("bigint").alias("found"))
    b = keys.select(by, F.col(key).alias("at"), F.lit(0).alias("side"), F.col(key).cast("bigint").alias("found"))
    order = Window.partitionBy(by).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("found", F.last("found", ignorenulls=True).over(order)).where("side = 1").select(by, F.col("at").alias(query), "found")


def first_at_least(queries: DataFrame, keys: DataFrame, by: str, query: str, key: str) -> DataFrame:
    """The smallest key of its group at or after each query row."""
    flipped = last_at_most(queries.select(by, (-F.col(query)).alias(query)), keys.select(by, (-F.col(key)).alias(key)), by, query, key)
    return flipped.select(by, (-F.col(query)).alias(query), (-F.col("found")).alias("found"))
