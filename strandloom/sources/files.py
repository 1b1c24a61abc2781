"""FASTA, patterns, STS, mass, position, word-count, run and edge files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import seq as S
from ..plans.lineage import cut

MASSES = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("mass", T.DoubleType())])


def read_fasta(spark: SparkSession, path: str, clean: bool = True) -> DataFrame:
    """entry_id (from 1), defline, name, seq, len. Records are split by Spark's line reader, so a file is read in parallel; gzip by suffix.

    Lines that begin with # and blank lines count for nothing. Entries are numbered in file order without gathering them in one task.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    body = F.regexp_replace(F.regexp_replace("value", "\r", ""), "(?m)^#.*$", "")
    rows = raw.select("file", "at", F.regexp_replace(body, r"^\s*>?", "").alias("record")).where(F.length(F.trim("record")) > 0)
    defline = F.regexp_extract("record", r"^([^\n]*)", 1)
    text = F.regexp_replace(F.expr("substring(record, length(regexp_extract(record, '^([^\\n]*)', 1)) + 1)"), r"[\n ]", "")
    rows = rows.select("file", "at", defline.alias("defline"), (S.clean(text) if clean else text).alias("seq"))
    return _numbered(rows, "file", "at").select("entry_id", "defline", S.first_word("defline").alias("name"), "seq", F.length("seq").cast("bigint").alias("len"))


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """entry_id from 1 in the order of the columns: positions within partitions plus the sizes of the partitions before (one number each)."""
    placed = rows.withColumn("part", F.shiftrightunsigned("at", 33))
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect())
    at, offsets = 0, []
    for part, n in sizes:
        offsets.append((part, at))
        at += n
    starts = rows.sparkSession.createDataFrame(offsets, "part bigint, offset bigint")
    return placed.join(F.broadcast(starts), "part").withColumn("entry_id", F.col("offset") + F.row_number().over(Window.partitionBy("part").orderBy(*order)))


def with_absolute_starts(sequences: DataFrame) -> DataFrame:
    """abs_start of each entry in the stream of all entries, each behind one terminator: the first entry begins at 1.

    Running sums on three levels: entries in bins, bins in groups, groups; so no task sees more than 10,000 entries or bins, and the last level is one row for 10^8 entries.
    """
    size = 10_000
    binned = sequences.withColumn("bin", F.floor(F.col("entry_id") / size)).withColumn("group", F.floor(F.col("bin") / size))
    before = lambda w: F.coalesce(F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = binned.groupBy("group", "bin").agg(F.sum(F.length("seq") + 1).alias("total"))
    groups = totals.groupBy("group").agg(F.sum("total").alias("total")).select("group", before(Window.orderBy("group")).alias("group_offset"))
    bins = totals.select("group", "bin", before(Window.partitionBy("group").orderBy("bin")).alias("bin_offset")).join(groups, "group").select("bin", (F.col("group_offset") + F.col("bin_offset")).alias("offset"))
    own = binned.withColumn("total", F.length("seq") + 1).join(bins, "bin")
    return own.withColumn("abs_start", 1 + F.col("offset") + before(Window.partitionBy("bin").orderBy("entry_id"))).drop("bin", "group", "offset", "total")


def write_fasta(sequences: DataFrame, path: str, width: int = 60, mode: str = "errorifexists") -> None:
    sequences.select(S.fasta_record("defline", "seq", width)).write.mode(mode).text(path)


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Patterns apart by white space, numbered from 1 in file order."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("i", "pattern")).where("pattern != ''")
    return _numbered(rows, "at", "i").select(F.col("entry_id").alias("pattern_id"), "pattern")


def patterns_of(spark: SparkSession, text: str) -> DataFrame:
    """The same of an inline string."""
    return spark.createDataFrame(list(enumerate(text.split(), 1)), "pattern_id bigint, pattern string")


def read_sts(spark: SparkSession, path: str) -> DataFrame:
    """id, fwd, rev, size_lb, size_ub, accession, chrom, altacc, species of tab-separated lines; a size is a number or two with - between."""
    names = "id fwd rev size accession chrom altacc species".split()
    rows = spark.read.option("sep", "\t").schema(", ".join(f"{n} string" for n in names)).csv(path)
    parts = F.split("size", "-")
    return rows.select("id", "fwd", "rev", parts[0].cast("bigint").alias("size_lb"), F.element_at(parts, -1).cast("bigint").alias("size_ub"), "accession", "chrom", "altacc", "species")


def sts_patterns(sts: DataFrame) -> DataFrame:
    """Two patterns a pair: 2p - 1 forward, 2p reverse, p by order of id."""
    laid = cut(sts.repartitionByRange("id").sortWithinPartitions("id").withColumn("at", F.monotonically_increasing_id()))
    both = _numbered(laid, "at").withColumnRenamed("entry_id", "pair_id")
    return both.select("pair_id", F.explode(F.array(F.struct((F.col("pair_id") * 2 - 1).alias("pattern_id"), F.col("fwd").alias("pattern")), F.struct((F.col("pair_id") * 2).alias("pattern_id"), F.col("rev").alias("pattern")))).alias("x")).select("pair_id", "x.*")


def read_masses(spark: SparkSession, path: str) -> DataFrame:
    """symbol, mass of lines of two words; n and c are the terminal masses."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) != '' and value not like '#%'").select(parts[0].alias("symbol"), parts[1].cast("double").alias("mass"))


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """entry_id, start, length of lines of numbers."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) != ''").select(*(parts[i].cast("bigint").alias(n) for i, n in enumerate(("entry_id", "start", "length"))))


def write_counts(counted: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Word counts as text lines."""
    counted.select(F.concat_ws("\t", "kmer", F.col("n").cast("string"))).write.mode(mode).text(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema("kmer string, n bigint").csv(path)


def bitmap_lines(found: DataFrame, spans: DataFrame, key: str = "entry_id") -> DataFrame:
    """key, line: BEGIN, span, run lengths (unset first) and END of each entry's position set. found: key, start, len; spans: key, size."""
    before = Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    laid = found.select(key, "start", "len", F.coalesce(F.max(end).over(before), F.lit(0).cast("bigint")).alias("from"))
    rows = laid.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "len", "from"))).alias("all"), F.max(end).alias("end"))
    own = spans.join(rows, key, "left").withColumn("_size", F.col("size").cast("bigint"))
    text = lambda n: n.cast("string")

    def unset(x: Column) -> Column:
        """What lies before a run: nothing, one length, or two where the span ends in between."""
        one = F.concat(text(x["start"] - x["from"]), F.lit(" "))
        two = F.concat(text(F.col("_size") - x["from"]), F.lit(" "), text(x["start"] - F.col("_size")), F.lit(" "))
        return F.when(x["start"] <= x["from"], F.lit("")).when((x["from"] < F.col("_size")) & (F.col("_size") < x["start"]), two).otherwise(one)

    none = F.array().cast("array<string>")
    rest = F.col("_size") - F.coalesce("end", F.lit(0))
    lengths = F.concat(F.coalesce(F.transform("all", lambda x: F.concat(unset(x), text(x["len"]))), none), F.when(rest > 0, F.array(text(rest))).otherwise(none))
    lead = F.when(F.get("all", F.lit(0))["start"] <= 0, F.lit("0 ")).otherwise(F.lit(""))
    return own.select(key, F.concat(F.lit("BEGIN "), text(F.col("size")), F.lit(" "), lead, F.array_join(lengths, " "), F.lit(" END")).alias("line"))


def read_bitmap_lines(lines: DataFrame, key: str = "entry_id") -> DataFrame:
    """key, start, len of the set runs of such lines."""
    parts = F.split(F.regexp_extract("line", r"^BEGIN \d+ (.*) END$", 1), " ")
    sizes = F.transform(F.filter(parts, lambda x: x != ""), lambda x: x.cast("bigint"))
    rows = lines.select(key, F.posexplode(sizes).alias("i", "len"))
    order = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("len").over(order), F.lit(0))).where("i % 2 = 1 and len > 0").select(key, "start", "len")


def write_edges(edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tagged edge lines: E, source, target, start, end, count."""
    edges.select(F.concat_ws(" ", F.lit("E"), *(F.col(c).cast("string") for c in ("src", "dst", "start", "end", "n")))).write.mode(mode).text(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, start, end, n of tagged lines, or of untagged ones of five numbers, or of seven (source and target with a range each)."""
    words = F.split(F.trim(F.regexp_replace("value", "^[Ee] ", "")), r"\s+")
    rows = spark.read.text(path).where("trim(value) != ''").select(words.alias("w"))
    at = lambda i: F.get("w", F.lit(i)).cast("bigint")
    seven = F.size("w") >= 7
    return rows.select(at(0).alias("src"), at(1).alias("dst"), F.when(seven, at(3)).otherwise(at(2)).alias("start"), F.when(seven, at(5)).otherwise(at(3)).alias("end"), F.when(seven, at(6)).otherwise(at(4)).alias("n"))


def _draw(*parts: Column) -> Column:
    """A number below 2^32 from the md5 of the parts, joined by colons: the same in any system and however rows are partitioned."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary")), 1, 8), 16, 10).cast("bigint")


def random_genome(spark: SparkSession, n_entries: int, length: int, seed: int) -> DataFrame:
    """entry_id, seq of uniform random letters: letter i is that of the draw of seed, entry and i, modulo 4."""
    letter = lambda i: F.substring(F.lit("ACGT"), (_draw(F.lit(seed), F.col("entry_id"), i) % 4 + 1).cast("int"), F.lit(1))
    return spark.range(1, n_entries + 1).withColumnRenamed("id", "entry_id").select("entry_id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), letter), "").alias("seq"))


def with_random_errors(reads: DataFrame, rate: float, seed: int) -> DataFrame:
    """Each letter of seq replaced by one of the other three with the given probability, by draws of seed, entry and place (from 0)."""
    other = lambda c, i: F.substring(F.lit("ACGTACGT"), (F.instr(F.lit("ACGT"), c) + 1 + _draw(F.lit(seed + 1), F.col("entry_id"), i) % 3).cast("int"), F.lit(1))
    letter = F.transform(F.split("seq", ""), lambda c, i: F.when(_draw(F.lit(seed), F.col("entry_id"), i) < int(rate * (1 << 32)), other(c, i)).otherwise(c))
    return reads.withColumn("seq", F.array_join(letter, ""))


#: Forms of a database, the best first: normalised (checked letters), a table, text.
FORMS = (("normalised", ".normalised.parquet"), ("table", ".parquet"), ("text", ""))


def forms(spark: SparkSession, base: str) -> dict[str, tuple[str, int]]:
    """Which forms of a database exist: path and time of the last change."""
    out = {}
    for name, suffix in FORMS:
        at = spark._jvm.org.apache.hadoop.fs.Path(base + suffix)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(at):
            out[name] = base + suffix, files.getFileStatus(at).getModificationTime()
    return out


def read_best(spark: SparkSession, base: str) -> DataFrame:
    """The database in the best of its forms that is no older than its text."""
    found = forms(spark, base)
    text = found.get("text", ("", 0))[1]
    for name, _ in FORMS:
        if name in found and found[name][1] >= text:
            return read_fasta(spark, found[name][0]) if name == "text" else spark.read.parquet(found[name][0])
    raise FileNotFoundError(base)


def compress(spark: SparkSession, base: str, letters: str | None = None, force: bool = False, check: bool = False) -> bool:
    """Builds the table of a FASTA file if it is missing or older, or if forced; with letters, the normalised one: other letters become N. Whether it was, or with check would be, built."""
    from ..functions.seq import canonical

    target = "normalised" if letters else "table"
    found = forms(spark, base)
    stale = force or target not in found or found[target][1] < found["text"][1]
    if stale and not check:
        rows = read_fasta(spark, base)
        (rows.withColumn("seq", canonical("seq", letters)) if letters else rows).write.mode("overwrite").parquet(base + dict(FORMS)[target])
    return stale


def write_mass_index(masses: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A table of masses in order of mass, in ranges, so that a lookup's filter skips files and row groups."""
    masses.repartitionByRange("mass").sortWithinPartitions("mass").write.mode(mode).parquet(path)


def read_mass_index(spark: SparkSession, path: str, low: float | None = None, high: float | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if low is None else rows.where(F.col("mass").between(low, high))
