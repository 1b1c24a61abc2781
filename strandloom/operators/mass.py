"""Masses of proteins and peptides."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S
from .kmers import chunks, with_offsets

WATER = {"mono": 18.01056, "average": 18.0153}  # fixed values


def protein_masses(proteins: DataFrame, table: dict[str, float] | None = None, n_term: float = 0.0, c_term: float = 0.0) -> DataFrame:
    """entry_id, mw: sum of residue masses and of the terminal ones; null if a letter has no mass."""
    return proteins.select("entry_id", (S.residue_mass("seq", table) + F.lit(n_term + c_term)).alias("mw"))


def digest(proteins: DataFrame, missed: int = 1, met: bool = True) -> DataFrame:
    """entry_id, start, peptide, missed: tryptic peptides (cut after K or R, not before P) with up to ``missed`` cuts left out.

    met: peptides from the start of a protein that begins with M come also without it.
    """
    parts = F.filter(F.split("seq", "(?<=[KR])(?!P)"), lambda x: x != "")
    laid = with_offsets(proteins.select("entry_id", "seq"), parts, missed).drop("seq")
    rows = laid.select("entry_id", F.col("offset").cast("int").alias("start"), "own", F.explode(F.sequence(F.lit(0), F.size("own") - 1)).alias("missed"))
    rows = rows.select("entry_id", "start", F.array_join(F.slice("own", F.lit(1), F.col("missed") + 1), "").alias("peptide"), "missed")
    if met:
        short = rows.where("start = 0 and peptide like 'M_%'").select("entry_id", F.lit(1).alias("start"), F.expr("substring(peptide, 2)").alias("peptide"), "missed")
        rows = rows.unionByName(short)
    return rows


def different_peptides(proteins: DataFrame, missed: int = 1, met: bool = True, only: Column | None = None) -> DataFrame:
    """peptide: those of ``digest``, once each, without their places. only: a condition on them; the others are left out before any is exchanged."""
    own = proteins.select(F.filter(F.split("seq", "(?<=[KR])(?!P)"), lambda x: x != "").alias("parts")).withColumn("n", F.size("parts"))
    levels = [F.col("parts")]
    for j in range(1, missed + 1):
        held = F.greatest(F.col("n") - j, F.lit(0))
        levels.append(F.zip_with(F.slice(levels[-1], F.lit(1), held), F.slice("parts", F.lit(j + 1), held), lambda a, b: F.concat(a, b)))
    if met:
        first = F.filter(F.array(*(F.get(x, F.lit(0)) for x in levels)), lambda x: x.like("M_%"))
        levels.append(F.transform(first, lambda x: F.substring(x, F.lit(2), F.length(x))))
    rows = own.select(F.explode(F.concat(*levels)).alias("peptide"))
    return (rows if only is None else rows.where(only)).distinct()


def in_reach(queries: DataFrame, tolerance: float, table: dict[str, float] | None = None) -> Column:
    """Whether a peptide (column peptide) has only letters of the table, and neither more nor fewer than a mass near that of any query can have."""
    table = table or S.MONO
    low, high = queries.agg(F.min(F.col("mw").cast("double")), F.max(F.col("mw").cast("double"))).first()
    if low is None or not math.isfinite(low) or not math.isfinite(high):
        low, high = (0.0, -1.0) if low is None else (-math.inf, math.inf)
    n, least, most = F.length("peptide"), min(table.values()), max(table.values())
    fits = F.lit(low is not None and low <= high)
    if math.isfinite(low):
        fits = fits & (n * F.lit(most) >= low - 2 * tolerance - 1) & (n * F.lit(least) <= high + 2 * tolerance + 1)
    return fits & F.col("peptide").rlike(f"^[{''.join(sorted(table))}]*$")


def wildcard_masses(peptides: DataFrame, table: dict[str, float] | None = None) -> DataFrame:
    """Each peptide with exactly one X, B or Z, once for every letter it may stand for: peptide, reading."""
    stands = {"X": "ACDEFGHIKLMNPQRSTVWY", "B": "DN", "Z": "EQ"}
    one = peptides.where(F.length(F.regexp_replace("peptide", "[^XBZ]", "")) == 1)
    letters = F.when(F.col("peptide").contains("X"), F.lit(stands["X"])).when(F.col("peptide").contains("B"), F.lit(stands["B"])).otherwise(F.lit(stands["Z"]))
    read = one.withColumn("letter", F.explode(F.split(letters, ""))).where("letter != ''")
    return read.withColumn("reading", F.expr("translate(peptide, 'XBZ', concat(letter, letter, letter))")).withColumn("mass", S.residue_mass("reading", table))


def near(queries: DataFrame, index: DataFrame, tolerance: float, by: list[str] | None = None) -> DataFrame:
    """All index rows within the tolerance of a query's mass (column mw; index column mass).

    Both sides carry a bin as wide as the tolerance, a query three of them, so the range join is an equi-join.
    """
    by = by or []
    own = F.floor(F.col("mw") / tolerance)
    asked = queries.withColumn("bin", F.explode(F.array(own - 1, own, own + 1)))
    kept = index.withColumn("bin", F.floor(F.col("mass") / tolerance))
    return asked.join(kept, [*by, "bin"]).where(F.abs(F.col("mw") - F.col("mass")) <= tolerance).drop("bin")


def multiplicity(queries: DataFrame, peptides: DataFrame, tolerance: float, by: list[str] | None = None) -> DataFrame:
    """The queries' columns and n: how many peptides have their mass; 0 is kept. queries: query, mw [, by].

    Different masses are counted, and of different queries a bin at a time, by running sums over its masses; no pairs are listed.
    """
    by = by or []
    width = 16 * tolerance
    mw = F.col("mw").cast("double")
    asked = queries.select(*by, mw.alias("mw")).where(F.abs("mw") < 1e15).distinct()  # neither null, infinite nor no number
    asked = asked.withColumn("bin", F.explode(F.sequence(F.floor((F.col("mw") - 1.5 * tolerance) / width), F.floor((F.col("mw") + 1.5 * tolerance) / width))))
    kept = peptides.where(F.abs("mass") < 1e15).groupBy(*by, F.col("mass").cast("double").alias("mass")).agg(F.count("*").alias("n")).withColumn("bin", F.floor(F.col("mass") / width))

    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        asked_for, masses, n = left.column("mw").to_numpy(), right.column("mass").to_numpy(), right.column("n").to_numpy()
        order = np.argsort(masses)
        masses, until = masses[order], np.concatenate(([0], np.cumsum(n[order])))
        held = lambda i: np.abs(asked_for - masses[np.clip(i, 0, len(masses) - 1)]) <= tolerance if len(masses) else np.zeros(len(asked_for), bool)
        low, high = np.searchsorted(masses, asked_for - tolerance, "left"), np.searchsorted(masses, asked_for + tolerance, "right")
        # the bounds are rounded: they are moved until they tell just what the difference tells
        while (more := (low > 0) & held(low - 1)).any():
            low = low - more
        while (less := (low < high) & ~held(low)).any():
            low = low + less
        while (more := (high < len(masses)) & held(high)).any():
            high = high + more
        while (less := (high > low) & ~held(high - 1)).any():
            high = high - less
        return left.select([*by, "mw"]).append_column("n", pa.array(until[high] - until[low], pa.int64()))

    kinds = dict(asked.dtypes)
    ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in [*by, "mw"]), "n bigint"])
    n = asked.groupBy(*by, "bin").cogroup(kept.groupBy(*by, "bin")).applyInArrow(found, ddl).groupBy(*by, "mw").agg(F.sum("n").alias("n"))
    own = queries.withColumn("_mw", mw).join(n.withColumnRenamed("mw", "_mw"), [*by, "_mw"], "left")
    return own.select(*queries.columns, F.coalesce("n", F.lit(0)).alias("n"))


def near_relative(queries: DataFrame, index: DataFrame, share: float) -> DataFrame:
    """Within a share of the query's mass: bins on the logarithm."""
    width = -F.log(F.lit(1 - share))
    own = F.floor(F.log("mw") / width)
    asked = queries.where("mw > 0").withColumn("bin", F.explode(F.array(own - 1, own, own + 1)))
    kept = index.where("mass > 0").withColumn("bin", F.floor(F.log("mass") / width))
    return asked.join(kept, "bin").where(F.abs(F.col("mw") - F.col("mass")) <= F.col("mw") * share).drop("bin")


#: Masses are first compared as whole multiples of this.
UNIT = 1e-6


def _stretches(pieces: DataFrame, low: float, high: float, most: int, table: dict[str, float]) -> DataFrame:
    """entry_id, start, length, piece of every stretch of known letters whose mass in units, each letter's rounded, is in the range widened by a unit a letter: differences of running sums over an Arrow batch."""
    weight, unknown = np.zeros(256, np.int64), np.ones(256, np.int64)
    for letter, value in table.items():
        weight[ord(letter)], unknown[ord(letter)] = round(value / UNIT), 0
    least, greatest = math.floor(low / UNIT) - most, math.ceil(high / UNIT) + most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("piece").to_pylist()
            text, sizes = "".join(texts), np.fromiter(map(len, texts), np.int64, len(texts))
            codes = np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 255)
            begins = np.cumsum(sizes) - sizes
            row = np.repeat(np.arange(len(texts)), sizes - most + 1)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(sizes - most + 1) - (sizes - most + 1), sizes - most + 1)
            first = begins[row] + inner
            sums, strange = (np.concatenate(([0], np.cumsum(x[codes]))) for x in (weight, unknown))
            start = np.asarray(batch.column("base").to_numpy(zero_copy_only=False))[row] + inner
            for n in range(1, most + 1):
                total = sums[first + n] - sums[first]
                at = np.flatnonzero((strange[first + n] == strange[first]) & (total >= least) & (total <= greatest))
                if len(at):
                    own = [text[i : i + n] for i in first[at].tolist()]
                    yield pa.RecordBatch.from_arrays([batch.column("entry_id").take(pa.array(row[at])), pa.array(start[at].astype(np.int32)), pa.array(np.full(len(at), n, np.int32)), pa.array(own, pa.string())], names=["entry_id", "start", "length", "piece"])

    return pieces.select("entry_id", "base", "piece").mapInArrow(run, f"entry_id {dict(pieces.dtypes)['entry_id']}, start int, length int, piece string")


def substring_masses(proteins: DataFrame, low: float, high: float, table: dict[str, float] | None = None) -> DataFrame:
    """entry_id, start, length, mass of every stretch with a mass in [low, high] and at most high / 50 letters."""
    table = table or S.MONO
    most = int(high / 50)
    padded = proteins.select("entry_id", F.concat("seq", F.lit("$" * (most - 1))).alias("seq"))
    found = _stretches(chunks(padded, most), low, high, most, table)
    return found.withColumn("mass", S.residue_mass("piece", table)).where(F.col("mass").between(low, high)).drop("piece")
