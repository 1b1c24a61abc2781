"""All registered queries of the sequence operators, and the SQL that each must equal.

Sequences are derived from the whole tables: ``dna`` (64 letters of hashes of each document's id), ``letters`` (all letters of a
document's text, as a protein would be) and ``text_dna`` (those letters mapped to A, C, G and T). Keys are the operator's
number in the inventory and a name.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import seq as S
from .operators import align, frames, graph, kmers, mass, match, pairs, repair, runs, uniq
from .plans import chooser, formats
from .plans.lineage import cut, dealt, shared_dir
from .sources import files
from .streaming import per_entry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Example primers, and an expected size.
PRIMERS = "AGAAGCGAGTTCT CGCCAGCAGAGTT TTTTCTGAGAATCAAG CTATTGATAAGGGAGTGC ATGGCGGTTTTGTCGAA AAGAAAAGGGGGAAA TCATGAAGTAAAC TTGGCTGCTGCCCCCAG AGAAAAGGGGGAAA CTATTGATAAGGGAGTG"
_HEX = ("0123456789abcdef", "ACGTACGTACGTACGT")
_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC")

VIEWS = f"""
dna as (select doc_id as entry_id, translate(md5('a' || cast(doc_id as varchar)) || md5('b' || cast(doc_id as varchar)), '{_HEX[0]}', '{_HEX[1]}') as seq from documents),
letters as (select doc_id as entry_id, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) as seq from documents),
text_dna as (select entry_id, translate(seq, '{_AZ[0]}', '{_AZ[1]}') as seq from letters),
patterns as (select cast(n_nationkey + 1 as bigint) as pattern_id, substr(translate(md5(n_name), '{_HEX[0]}', '{_HEX[1]}'), 1, cast(8 + n_nationkey % 3 as integer)) as pattern from nation)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = lambda x: F.md5(F.concat(F.lit(x), F.col("doc_id").cast("string")).cast("binary"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), F.translate(F.concat(half("a"), half("b")), *_HEX).alias("seq"))


def letters(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", "")).alias("seq"), *more)


def text_dna(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    return letters(spark, sf_dir, *more).withColumn("seq", F.translate("seq", *_AZ))


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select((n + 1).cast("bigint").alias("pattern_id"), F.substring(F.translate(F.md5(F.col("n_name").cast("binary")), *_HEX), F.lit(1), (F.lit(8) + n % 3).cast("int")).alias("pattern"))


def query(sql: str | None = None, views: bool = True, whole: bool = False):
    """Registers a function under its own name; integers become long so that both sides have one type. views: the SQL reads VIEWS; whole: and names them itself."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.select(*(F.col(f"`{c}`").cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, t in out.dtypes))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = f"with {VIEWS.strip()}{',' if not sql.lstrip().startswith('select') else ''} {sql.strip()}" if views and not whole else sql.strip()
        return f

    return register


# --- Projections and scalar functions ---------------------------------------


@query("select entry_id, reverse(translate(seq, 'ACGTMRWSYKVHDB', 'TGCAKYWSRMBDHV')) as rc from text_dna")
def x3_reverse_complement(spark, sf_dir):
    return text_dna(spark, sf_dir).select("entry_id", S.reverse_complement("seq").alias("rc"))


@query("select entry_id, translate(seq, 'IK', 'LQ') as mapped, reverse(seq) as turned from letters")
def x5_remap(spark, sf_dir):
    return letters(spark, sf_dir).select("entry_id", S.remap("seq", lysine=True).alias("mapped"), F.reverse("seq").alias("turned"))


_CODONS = "map([" + ",".join(f"'{a}{b}{c}'" for a in "TCAG" for b in "TCAG" for c in "TCAG") + "], [" + ",".join(f"'{x}'" for x in S.CODE) + "])"


@query(f"""
frames as (select entry_id, f, case when f >= 3 then reverse(translate(seq, 'ACGT', 'TGCA')) else seq end as s from dna, unnest(range(0, 6)) t(f))
select entry_id, f::bigint as frame, array_to_string(list_transform(range(0, (length(s) - f % 3) // 3), lambda i: coalesce({_CODONS}[substr(s, i * 3 + f % 3 + 1, 3)], 'X')), '') as protein from frames
""")
def x6_six_frames(spark, sf_dir, source=dna):
    rows = source(spark, sf_dir).select("entry_id", "seq", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("frame"))
    return rows.select("entry_id", "frame", S.translation("seq", F.col("frame")).alias("protein"))


def _mass_sql(column: str, masses: dict[str, float]) -> str:
    known = "".join(sorted(masses))
    total = " + ".join(f"(length({column}) - length(replace({column}, '{c}', ''))) * {m!r}e0" for c, m in sorted(masses.items()))
    return f"case when length(translate({column}, '{known}', '')) = 0 then 0e0 + {total} end"


@query(f"clean as (select entry_id, regexp_replace(seq, '[BJOUXZ]', '', 'g') as s from letters) select entry_id, round(({_mass_sql('s', S.MONO)}) * 1000)::bigint as mono, round(({_mass_sql('s', S.AVERAGE)}) * 1000)::bigint as average from clean")
def a7_protein_masses(spark, sf_dir):
    own = letters(spark, sf_dir).select("entry_id", F.regexp_replace("seq", "[BJOUXZ]", "").alias("seq"))
    both = mass.protein_masses(own).select("entry_id", F.round(F.col("mw") * 1000).cast("bigint").alias("mono"))
    return both.join(mass.protein_masses(own, S.AVERAGE).select("entry_id", F.round(F.col("mw") * 1000).cast("bigint").alias("average")), "entry_id")


@query("select entry_id, regexp_extract(defline, '^[^ \\t]*') as name, upper(regexp_replace(raw, '[^!-~]', '', 'g')) as seq from (select doc_id as entry_id, 'doc' || cast(doc_id as varchar) || ' ' || lang as defline, coalesce(text, '') as raw from documents)", views=False)
def p1_clean(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(" "), "lang").alias("defline"), F.coalesce("text", F.lit("")).alias("raw"))
    return d.select("entry_id", S.first_word("defline").alias("name"), S.clean("raw").alias("seq"))


_PLACES = "select l_partkey as entry_id, cast(l_suppkey * 7 % 70 as bigint) as start, cast(l_quantity as bigint) % 20 as length, cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) as id, cast(l_orderkey % 2 as bigint) as sense_seq, cast(l_linenumber % 2 as bigint) as sense_comp from lineitem"


def places(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("l_partkey as entry_id", "cast(l_suppkey * 7 % 70 as bigint) as start", "cast(l_quantity as bigint) % 20 as length", "concat(l_orderkey, '-', l_linenumber) as id", "cast(l_orderkey % 2 as bigint) as sense_seq", "cast(l_linenumber % 2 as bigint) as sense_comp")


@query(f"places as ({_PLACES}) select id, p.entry_id, start, length, substr(seq, start + 1, length) as text from places p join dna using (entry_id) where start + length <= length(seq)")
def p3_extract(spark, sf_dir, source=dna):
    return runs.extract(source(spark, sf_dir), places(spark, sf_dir).select("id", "entry_id", "start", "length"))


@query(f"""
places as ({_PLACES}), cut as (select id, p.entry_id, start, length, substr(translate(seq, 'A', 'N'), start + 1, length) as t, sense_seq, sense_comp from places p join dna using (entry_id) where start + length <= length(seq)),
own as (select *, case when sense_seq = 1 and sense_comp = 1 then reverse(translate(t, 'ACGT', 'TGCA')) else t end as text from cut)
select id, entry_id, start, length, id || ' /start=' || start || ' /end=' || (start + length) || ' /length=' || length
    || case when contains(text, 'N') then ' /Ns=' || (length - length(replace(text, 'N', ''))) || ' /nonNs=' || length(replace(text, 'N', '')) || ' /maxContigN=' || list_max(list_transform(regexp_extract_all(text, 'N+'), lambda x: length(x))) else '' end as header, text from own
""")
def p4_annotated(spark, sf_dir, source=dna):
    return runs.annotated(source(spark, sf_dir).withColumn("seq", F.translate("seq", "A", "N")), places(spark, sf_dir))


_INTERVALS = "select l_orderkey * 10 + l_linenumber as k, cast(l_orderkey * 10 + l_linenumber as varchar) as id, l_suppkey as entry_id, cast(l_orderkey * 3 + l_partkey % 40 as bigint) as start, cast(l_quantity as bigint) as length from lineitem"


def intervals(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("cast(l_orderkey * 10 + l_linenumber as string) as id", "l_suppkey as entry_id", "cast(l_orderkey * 3 + l_partkey % 40 as bigint) as start", "cast(l_quantity as bigint) as length")


@query(f"""
iv as ({_INTERVALS}), a as (select *, max(start + length) over (partition by entry_id order by start, length, id rows between unbounded preceding and 1 preceding) as b from iv),
i as (select *, sum(case when b is null or start >= b then 1 else 0 end) over (partition by entry_id order by start, length, id rows unbounded preceding) as island from a)
select entry_id, min(start) as start, (max(start + length) - min(start))::bigint as length, string_agg(id, ':' order by start, length, id) as ids from i group by entry_id, island
""")
def p6_merged_intervals(spark, sf_dir):
    return runs.merged(intervals(spark, sf_dir))


@query(f"iv as ({_INTERVALS}), a as (select *, max(start + length) over (partition by entry_id order by start, length rows between unbounded preceding and 1 preceding) as b from iv) select entry_id, b as start, start - b as length from a where start > b")
def p5_between_intervals(spark, sf_dir):
    own = intervals(spark, sf_dir)
    return runs.between(own, own.select("entry_id").distinct().withColumn("size", F.lit(0)))


@query("select pattern_id, pattern_id as base_id, 'F' as strand, pattern from patterns union all select pattern_id + 25, pattern_id, 'R', reverse(translate(pattern, 'ACGT', 'TGCA')) from patterns")
def p7_both_strands(spark, sf_dir):
    return match.both_strands(patterns(spark, sf_dir))


@query("select pattern_id, greatest(2, length(pattern) - 5)::bigint as lconst, greatest(3, 0)::bigint as rconst from patterns")
def p9_constraints(spark, sf_dir):
    left, right = S.constraints(F.length("pattern"), five=2, three=3, end_inexact=5)
    return patterns(spark, sf_dir).select("pattern_id", left.alias("lconst"), right.alias("rconst"))


@query("c as (select entry_id, 'G' || seq as s from dna) select entry_id, 'G' || array_to_string(list_transform(range(1, length(s)), lambda i: cast(xor(instr('ACGT', substr(s, i, 1)) - 1, instr('ACGT', substr(s, i + 1, 1)) - 1) as varchar)), '') as colours from c")
def p13_colour_space(spark, sf_dir, source=dna):
    return source(spark, sf_dir).select("entry_id", S.colour_space("seq").alias("colours"))


@query("select entry_id, regexp_replace(seq, '[^ACGT]', 'N', 'g') as fwd, reverse(translate(regexp_replace(seq, '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')) as rev from letters")
def p14_canonical(spark, sf_dir):
    own = letters(spark, sf_dir).select("entry_id", S.canonical("seq").alias("fwd"))
    return own.withColumn("rev", S.reverse_complement("fwd"))


@query("w as (select distinct substr(seq, i::bigint, 6) as kmer from dna, unnest(range(1, length(seq) - 4)) t(i)) select kmer, list_sum(list_transform(range(1, 7), lambda i: (instr('ACGT', substr(kmer, i, 1)) - 1) * 4 ** (6 - i)))::bigint as code, kmer as word from w")
def x10_kmer_codes(spark, sf_dir, source=dna):
    w = kmers.words(source(spark, sf_dir), 6).select("kmer").distinct().withColumn("code", S.kmer_code("kmer"))
    return w.withColumn("word", S.kmer_word("code", 6))


@query("n as (select entry_id, translate(seq, 'A', 'N') as s from dna) select entry_id, (length(s) - length(replace(s, 'N', '')))::bigint as n_count, coalesce(list_max(list_transform(regexp_extract_all(s, 'N+'), lambda x: length(x))), 0)::bigint as longest from n")
def a9_n_statistics(spark, sf_dir, source=dna):
    own = source(spark, sf_dir).withColumn("seq", F.translate("seq", "A", "N"))
    return own.select("entry_id", S.n_count("seq").alias("n_count"), S.longest_n_run("seq").alias("longest"))


@query("select l_orderkey, l_linenumber::bigint as l_linenumber, greatest(q - 30, 20 - q, 0)::bigint as deviance, (floor(log2(q::double) + 0.001e0) + 1)::bigint as logged, least(q, 2)::bigint as two from (select *, cast(l_quantity as bigint) as q from lineitem)", views=False)
def x17_x18_number_functions(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("bigint"))
    return q.select("l_orderkey", "l_linenumber", S.deviance("q", F.lit(20), F.lit(30)).cast("bigint").alias("deviance"), S.count_transform("q", 1).cast("bigint").alias("logged"), S.count_transform("q", 2).cast("bigint").alias("two"))


@query("""
p as (select pattern_id, pattern, list_transform(range(1, length(pattern)), lambda i: substr(pattern, i, 2)) as pairs from patterns)
select pattern_id, round((h * 1000 / (s + 0.368e0 * (length(pattern) - 1) * ln(0.05e0) + 1.987e0 * ln(2.5e-7 / 4)) - 273.15e0), 6) as tm from (
  select *, list_sum(list_transform(pairs, lambda x: hm[x])) + eh[substr(pattern, 1, 1)] + eh[right(pattern, 1)] as h, list_sum(list_transform(pairs, lambda x: sm[x])) + es[substr(pattern, 1, 1)] + es[right(pattern, 1)] as s from (
    select *, map([%s], [%s]) as hm, map([%s], [%s]) as sm, map([%s], [%s]) as eh, map([%s], [%s]) as es from p))
""" % tuple(x for t, i in ((S.STACKS, 0), (S.STACKS, 1), (S.ENDS, 0), (S.ENDS, 1)) for x in (",".join(f"'{k}'" for k in sorted(t)), ",".join(f"{t[k][i]!r}e0" for k in sorted(t)))))
def f7_melting_temperature(spark, sf_dir):
    return patterns(spark, sf_dir).select("pattern_id", F.round(S.melting_temperature("pattern"), 6).alias("tm"))


# --- Words --------------------------------------------------------------------


def _words_sql(source: str, k: int) -> str:
    return f"w as (select entry_id, i as pos, substr(seq, i + 1, {k}) as kmer from {source}, unnest(range(0, length(seq) - {k} + 1)) t(i))"


@query(f"{_words_sql('text_dna', 5)} select entry_id, kmer, count(*) as n from w group by all")
def a4_kmers_by_entry(spark, sf_dir):
    return kmers.dna_counts(text_dna(spark, sf_dir), 5, by_entry=True)


@query(f"{_words_sql('text_dna', 8)} select kmer, count(*) as n from w group by all")
def a5_kmers(spark, sf_dir):
    return kmers.dna_counts(text_dna(spark, sf_dir), 8)


@query(f"{_words_sql('letters', 4)}, d as (select kmer from w where regexp_full_match(kmer, '[ACGT]+')) select kmer, count(*) as n from (select kmer from d union all select reverse(translate(kmer, 'ACGT', 'TGCA')) from d) group by all")
def a6_kmers_of_both_strands(spark, sf_dir):
    return kmers.dna_counts(letters(spark, sf_dir), 4, both_strands=True)


@query(f"{_words_sql('text_dna', 4)}, c as (select entry_id, kmer, count(*) as n from w group by all) select entry_id, kmer, n, rank from (select *, row_number() over (partition by entry_id order by n desc, kmer desc) as rank from c) where rank <= 3")
def o2_top_kmers(spark, sf_dir):
    return kmers.top(kmers.dna_counts(text_dna(spark, sf_dir), 4, by_entry=True), 3)


@query(f"{_words_sql('dna', 6)}, c as (select kmer, count(*) as n from w group by all) select w.entry_id, w.pos, (coalesce(a.n, 0) + coalesce(b.n, 0))::bigint as n from w left join c a on a.kmer = w.kmer left join c b on b.kmer = reverse(translate(w.kmer, 'ACGT', 'TGCA'))")
def j18_annotate_kmers(spark, sf_dir, source=dna):
    own = source(spark, sf_dir)
    return kmers.annotate(own, kmers.dna_counts(own, 6), 6)


@query("select entry_id, 0::bigint as tag, i as pos, substr(seq, i + 1, 2) || substr(seq, i + 4, 2) as word from dna, unnest(range(0, length(seq) - 4)) t(i) union all select entry_id, 1, i, substr(seq, i + 1, 1) || substr(seq, i + 3, 1) || substr(seq, i + 4, 1) from dna, unnest(range(0, length(seq) - 3)) t(i)")
def w11_spaced_words(spark, sf_dir):
    return kmers.spaced(dna(spark, sf_dir), ["11011", "1011"])


@query("r as (select substr(seq, i + 1, 6) as kmer, case when i = 0 then '$' else substr(seq, i, 1) end as l, case when i + 6 = length(seq) then '$' else substr(seq, i + 7, 1) end as r from dna, unnest(range(0, length(seq) - 5)) t(i)) select kmer, count(*) as n, least(count(distinct l), 2)::bigint as n_left, least(count(distinct r), 2)::bigint as n_right, max(case when l = '$' or r = '$' then 1 else 0 end)::bigint as at_end from r group by kmer")
def a15_neighbours(spark, sf_dir, source=dna):
    return kmers.neighbours(source(spark, sf_dir), 6)


@query("""
p as (select substr(seq, i + 1, 3) as a, substr(seq, i + 9, 3) as b from text_dna, unnest(range(0, length(seq) - 10)) t(i)),
q as (select a, b from p union all select reverse(translate(b, 'ACGT', 'TGCA')), reverse(translate(a, 'ACGT', 'TGCA')) from p), c as (select a, b, count(*) as n from q group by all)
select count(*) filter (n = 1) as once, count(*) filter (n > 1) as again, (4096 - count(*))::bigint as unseen from c
""")
def q15_pairs_seen(spark, sf_dir):
    one_gap = kmers.seen_by_gap(text_dna(spark, sf_dir), 3, 5, least=5)
    total = lambda c, none: F.coalesce(F.sum(c), F.lit(none)).cast("bigint").alias(c)
    return one_gap.agg(total("once", 0), total("again", 0), total("unseen", 16**3))


# --- Matching ------------------------------------------------------------------

_EXACT = "hits as (select entry_id, pattern_id, i as start_pos, i + n as end_pos, 0::bigint as edits from (select entry_id, i, n, substr(seq, i + 1, n) as mer from text_dna, unnest([8, 9, 10]) s(n), unnest(range(0, length(seq) - n + 1)) t(i)) w join patterns on pattern = mer)"


@query(f"{_EXACT} select * from hits")
def j1_exact_match(spark, sf_dir):
    return match.exact(text_dna(spark, sf_dir), patterns(spark, sf_dir))


@query("select entry_id, 1::bigint as pattern_id, i as start_pos, i + 8 as end_pos, 0::bigint as edits from text_dna, unnest(range(0, length(seq) - 7)) t(i) where regexp_full_match(substr(seq, i + 1, 8), 'A[ACGT]G[AG]T[CT][AT]C') union all select entry_id, 2, i, i + 6, 0 from text_dna, unnest(range(0, length(seq) - 5)) t(i) where regexp_full_match(substr(seq, i + 1, 6), '[CG][AC]TT[GT]A')")
def j4_wildcard_match(spark, sf_dir):
    return match.scan(text_dna(spark, sf_dir), [(1, "ANGRTYWC"), (2, "SMTTKA")])


@query("select entry_id, 1::bigint as pattern_id, i as start_pos, i + 4 as end_pos, 0::bigint as edits from letters, unnest(range(0, length(seq) - 3)) t(i) where regexp_full_match(substr(seq, i + 1, 4), 'T.[^ACGT]S') union all select entry_id, 2, i, i + 3, 0 from letters, unnest(range(0, length(seq) - 2)) t(i) where regexp_full_match(substr(seq, i + 1, 3), 'H[^ACDEFGHIKLMNPQRSTVWY]E')")
def j5_regex_lite_match(spark, sf_dir):
    return match.scan(letters(spark, sf_dir), [(1, "T.;S"), (2, "H:E")], wildcards=False, lite=True)


_SUBS = "tries as (select entry_id, pattern_id, i as start_pos, pattern, substr(seq, i + 1, length(pattern)) as t from dna, unnest(range(0, length(seq) - 7)) t(i), patterns), near as (select entry_id, pattern_id, start_pos, start_pos + length(pattern) as end_pos, hamming(u, pattern)::bigint as edits from (select *, case when length(t) = length(pattern) then t else repeat('.', length(pattern)) end as u from tries) where hamming(u, pattern) <= 2)"


@query(f"{_SUBS} select * from near")
def j6_mismatches(spark, sf_dir, source=dna):
    return match.mismatches(source(spark, sf_dir), patterns(spark, sf_dir), 2)


@query(f"{_SUBS} select near.* from near join dna using (entry_id) join patterns using (pattern_id) where substr(seq, start_pos + 1, 4) = substr(pattern, 1, 4) and substr(seq, end_pos, 1) = right(pattern, 1)")
def j8_anchored_mismatches(spark, sf_dir, source=dna):
    return match.mismatches(source(spark, sf_dir), patterns(spark, sf_dir), 2, left=4, right=1)


@query(f"{_SUBS} select distinct near.* from near join dna using (entry_id) join patterns using (pattern_id), unnest(range(0, length(pattern) - 3)) t(o) where substr(seq, start_pos + o + 1, 4) = substr(pattern, o + 1, 4)")
def j10_seeded_mismatches(spark, sf_dir, source=dna):
    return match.mismatches(source(spark, sf_dir), patterns(spark, sf_dir), 2, word=4)


_ENDS = "ends as (select entry_id, pattern_id, e as end_pos, min(levenshtein(substr(seq, e - l + 1, l), pattern))::bigint as edits from dna, patterns, unnest(range(1, length(seq) + 1)) t(e), unnest(range(length(pattern) - 1, length(pattern) + 2)) u(l) where l <= e group by all having min(levenshtein(substr(seq, e - l + 1, l), pattern)) <= 1)"


@query(f"{_ENDS} select * from ends")
def j7_edit_ends(spark, sf_dir, source=dna):
    return match.edit_ends(source(spark, sf_dir), patterns(spark, sf_dir), 1)


_CLUSTERS = f"{_ENDS}, a as (select *, case when end_pos - lag(end_pos) over (partition by entry_id, pattern_id order by end_pos) <= 3 then 0 else 1 end as fresh from ends), c as (select *, sum(fresh) over (partition by entry_id, pattern_id order by end_pos) as cluster from a), cl as (select entry_id, pattern_id, min(end_pos) as first_end, max(end_pos) as last_end, min(edits) as edits from c group by entry_id, pattern_id, cluster)"


@query(f"{_CLUSTERS} select * from cl")
def w5_clustered_hits(spark, sf_dir, source=dna):
    return match.clusters(match.edit_ends(source(spark, sf_dir), patterns(spark, sf_dir), 1), 1)


@query()
def u1_alignments(spark, sf_dir, source=dna):
    """Clustered hits with their alignment; tested against brute force and worked examples."""
    hits = chooser.find(source(spark, sf_dir), patterns(spark, sf_dir), k=1)
    return hits.select("entry_id", "pattern_id", align.aligned("text", "pattern", "first_end", "last_end", 1).alias("a")).select("entry_id", "pattern_id", "a.start", "a.end", "a.edits", "a.text", "a.ops", F.col("a.pattern").alias("aligned"))


_AMINO = S.amino_distance_map()
_AMINO_SQL = "map([" + ",".join(f"'{k}'" for k in sorted(_AMINO)) + "], [" + ",".join(str(_AMINO[k]) for k in sorted(_AMINO)) + "])"


@query(f"""
m as (select {_AMINO_SQL} as cost), w as (select distinct substr(seq, i + 1, 4) as peptide from letters, unnest(range(0, length(seq) - 3)) t(i))
select peptide, list_sum(list_transform(range(1, 5), lambda i: case when substr(peptide, i, 1) = substr('THEN', i, 1) then 0 else coalesce(cost[substr(peptide, i, 1) || substr('THEN', i, 1)], 3) end))::bigint as cost from w, m
""")
def j13_mutation_cost(spark, sf_dir):
    """Of every different window."""
    w = kmers.words(letters(spark, sf_dir), 4).select(F.col("kmer").alias("peptide")).distinct()
    return w.withColumn("cost", S.mutation_cost(F.col("peptide"), F.lit("THEN")))


def _in_frames_sql(source: str, peptides: str, k: int) -> str:
    """Every place of both strands where as many amino acids as a peptide has differ from it in at most k, as the places of all texts are tried one by one."""
    return f"""
code as (select unnest(map_keys(c)) as codon, unnest(map_values(c)) as aa from (select {_CODONS} as c)),
own as (select entry_id, 0 as strand, length(seq) as n, seq from {source} union all select entry_id, 1, length(seq), reverse(translate(seq, 'ACGT', 'TGCA')) from {source}),
aas as materialized (select entry_id, strand, n, i, coalesce(aa, 'X') as aa, codon from (select entry_id, strand, n, i, substr(seq, i + 1, 3) as codon from own, unnest(range(0, n - 2)) t(i)) left join code using (codon)),
win as (select entry_id, strand, n, i, aa || coalesce(lead(aa, 3) over w, '') || coalesce(lead(aa, 6) over w, '') || coalesce(lead(aa, 9) over w, '') || coalesce(lead(aa, 12) over w, '') as win,
    codon || coalesce(lead(codon, 3) over w, '') || coalesce(lead(codon, 6) over w, '') || coalesce(lead(codon, 9) over w, '') || coalesce(lead(codon, 12) over w, '') as codons from aas window w as (partition by entry_id, strand order by i)),
p as (select pattern_id::bigint as pattern_id, pattern from (values {peptides}) v(pattern_id, pattern)),
found as (select entry_id, pattern_id, pattern, left(win, length(pattern)) as text, left(codons, 3 * length(pattern)) as codons, (3 * strand + i % 3)::bigint as frame, (i // 3)::bigint as aa_start, (case strand when 0 then i else n - i - 3 * length(pattern) end)::bigint as dna_start
    from win, p where length(win) >= length(pattern) and hamming(left(win, length(pattern)), pattern) <= {k})"""


@query(f"{_in_frames_sql('dna', "(1, 'LK')", 0)} select entry_id, frame, aa_start, dna_start from found")
def j14_peptides_in_frames(spark, sf_dir, source=dna):
    peptide = spark.createDataFrame([(1, "LK")], "pattern_id bigint, pattern string")
    return frames.peptides_in_frames(source(spark, sf_dir), peptide).select("entry_id", "frame", "aa_start", "dna_start")


@query(_in_frames_sql("text_dna", "(1, 'LK')", 0) + " select entry_id, frame, aa_start, dna_start from found")
def j14_peptides_in_frames_whole(spark, sf_dir):
    """The same over whole texts."""
    return j14_peptides_in_frames(spark, sf_dir, text_dna)


_PAIRS = f"""
strands as (select pattern_id, substr(pattern, 1, 5) as pattern from patterns union all select pattern_id + 25, reverse(translate(substr(pattern, 1, 5), 'ACGT', 'TGCA')) from patterns),
hits as (select entry_id, pattern_id, i as start_pos, i + 5 as end_pos from (select entry_id, i, substr(seq, i + 1, 5) as mer from dna, unnest(range(0, length(seq) - 4)) t(i)) join strands on mer = pattern),
roles as (select p as pair_id, 2 * p - 1 as left_id, 2 * p as right_id from unnest(range(1, 13)) t(p) union all select p, 2 * p + 25, 2 * p - 1 + 25 from unnest(range(1, 13)) t(p)),
amp as (select a.entry_id, pair_id, left_id, right_id, a.start_pos, b.end_pos, b.end_pos - a.start_pos as length, a.end_pos as left_end, b.start_pos as right_start, 0::bigint as left_edits, 0::bigint as right_edits from roles join hits a on a.pattern_id = left_id join hits b on b.pattern_id = right_id and b.entry_id = a.entry_id where b.end_pos - a.start_pos between 8 and 40 and b.start_pos >= a.start_pos)
"""


def _amplicons(spark, sf_dir):
    short = patterns(spark, sf_dir).withColumn("pattern", F.substring("pattern", 1, 5))
    hits = match.exact(dna(spark, sf_dir), match.both_strands(short))
    roles = spark.createDataFrame(pairs.roles(25), "pair_id bigint, left_id bigint, right_id bigint")
    return pairs.amplicons(hits, roles, 8, 40)


@query(f"{_PAIRS} select * from amp")
def j15_primer_pairs(spark, sf_dir):
    return _amplicons(spark, sf_dir)


@query(f"{_PAIRS} select a.* , substr(seq, start_pos + 1, length) as amplicon, 0::bigint as n_count, greatest(length - 30, 20 - length, 0)::bigint as deviance from amp a join dna using (entry_id) where greatest(length - 30, 20 - length, 0) <= 5")
def q2_pcr_match(spark, sf_dir):
    sized = _amplicons(spark, sf_dir).withColumn("size_lb", F.lit(20)).withColumn("size_ub", F.lit(30)).withColumn("deviance", S.deviance("length", "size_lb", "size_ub")).where("deviance <= 5").drop("size_lb", "size_ub")
    return pairs.with_sequence(sized, dna(spark, sf_dir))


@query(f"{_EXACT} select p.pattern_id, count(h.pattern_id) as n_0, least(count(h.pattern_id), 50) as n, count(h.pattern_id) >= 50 as capped from patterns p left join hits h using (pattern_id) group by all")
def a3_capped_counts(spark, sf_dir):
    pats = patterns(spark, sf_dir)
    return match.counts(match.exact(text_dna(spark, sf_dir), pats), pats, 0, cap=50)


@query(f"{_SUBS} select p.pattern_id, count(*) filter (edits = 0) as n_0, count(*) filter (edits = 1) as n_1, count(*) filter (edits = 2) as n_2, count(edits) as n, false as capped from patterns p left join near using (pattern_id) group by all")
def a1_counts_by_edits(spark, sf_dir, source=dna):
    pats = patterns(spark, sf_dir)
    return match.counts(match.mismatches(source(spark, sf_dir), pats, 2), pats, 2)


_PRIMER_VALUES = ", ".join(f"({i}, '{p}')" for i, p in enumerate(PRIMERS.split(), 1))
_STRANDS = f"primers as (select base_id::bigint as base_id, pattern from (values {_PRIMER_VALUES}) v(base_id, pattern)), strands as (select base_id, base_id as pattern_id, 'F' as strand, pattern from primers union all select base_id, base_id + 10, 'R', reverse(translate(pattern, 'ACGT', 'TGCA')) from primers)"


#: All hits of whole primers of both strands with up to two substitutions, as the places of all texts are tried one by one.
_HITS = f"""{_STRANDS},
win as materialized (select entry_id, i as start, substr(seq, i + 1, 18) as win from text_dna, unnest(range(0, length(seq))) t(i)),
hits as (select * from (select entry_id, s.*, start, left(win, length(pattern)) as text, start + length(pattern) as "end", hamming(left(win, length(pattern)), pattern)::bigint as edits from win join strands s on length(win) >= length(pattern)) where edits <= 2)"""
@query(f"{_HITS} select strands.base_id, strands.strand, strands.pattern, count(edits) as n from strands left join (select pattern_id, edits from hits where edits = 0) h using (pattern_id) group by all")
def q1_primer_match_counts(spark, sf_dir):
    """Exact hits of every whole example primer in the whole texts, by strand; primers without a hit count 0."""
    strands = match.both_strands(files.patterns_of(spark, PRIMERS))
    counted = match.counts(match.exact(text_dna(spark, sf_dir), strands), strands)
    return strands.join(counted, "pattern_id").select("base_id", "strand", "pattern", "n")


def _whole_amplicons(spark, sf_dir):
    """Pairs of the whole patterns, of up to 2,000 letters as in the original."""
    hits = match.exact(text_dna(spark, sf_dir), match.both_strands(patterns(spark, sf_dir)))
    roles = spark.createDataFrame(pairs.roles(25), "pair_id bigint, left_id bigint, right_id bigint")
    return pairs.amplicons(hits, roles, 0, 2000)


@query()
def j15_primer_pairs_whole(spark, sf_dir):
    """Tested by brute force."""
    return _whole_amplicons(spark, sf_dir)


@query()
def q2_pcr_match_whole(spark, sf_dir):
    """All amplicons with their letters and their deviance from the expected size, none left out by it."""
    sized = _whole_amplicons(spark, sf_dir).withColumn("deviance", S.deviance("length", F.lit(20), F.lit(30)))
    return pairs.with_sequence(sized, text_dna(spark, sf_dir))


@query(f"{_EXACT} select pattern_id, count(*) as n, count(*) > 0 as found, min(entry_id * 1000000 + start_pos) as first from hits group by all")
def j25_point_queries(spark, sf_dir):
    h = match.exact(text_dna(spark, sf_dir), patterns(spark, sf_dir))
    return h.groupBy("pattern_id").agg(F.count("*").alias("n"), (F.count("*") > 0).alias("found"), F.min(F.col("entry_id") * 1000000 + F.col("start_pos")).alias("first"))


@query("select count(*) as n, min(length(pattern))::bigint as shortest, avg(length(pattern)) as mean, count(*) filter (regexp_matches(pattern, '[^ACGT]')) as ambiguous from patterns")
def a17_pattern_statistics(spark, sf_dir):
    s = chooser.statistics(patterns(spark, sf_dir))
    return spark.createDataFrame([(s.n, s.shortest, s.mean, s.ambiguous)], "n bigint, shortest bigint, mean double, ambiguous bigint")


# --- Runs, intervals, sets ---------------------------------------------------

_RUNS = "ch as (select entry_id, i as pos, substr(seq, i + 1, 1) as symbol from {source}, unnest(range(0, length(seq))) t(i)), isl as (select *, pos - row_number() over (partition by entry_id, symbol order by pos) as island from ch), runs as (select entry_id, symbol, min(pos) as start, count(*) as len from isl group by entry_id, symbol, island)"


@query(f"{_RUNS.format(source='text_dna')} select * from runs where len >= 4")
def w1_runs(spark, sf_dir):
    return runs.runs(text_dna(spark, sf_dir), 4)


@query(f"n as (select entry_id, regexp_replace(seq, '[^ACGT]', 'N', 'g') as seq from letters), {_RUNS.format(source='n')} select * from runs where len >= 20 and symbol = 'N'")
def q13_ambiguous_runs(spark, sf_dir):
    return runs.runs(letters(spark, sf_dir), 20, any_as_n=True)


_POINTS = "points as (select distinct l_suppkey as entry_id, l_partkey as pos from lineitem)"
_ISLANDS = f"{_POINTS}, isl as (select entry_id, min(pos) as start, count(*) as len from (select *, pos - row_number() over (partition by entry_id order by pos) as island from points) group by entry_id, island)"


def points(spark, sf_dir):
    return dealt(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entry_id"), F.col("l_partkey").alias("pos")), "entry_id").distinct()


def both_points(spark, sf_dir):
    """entry_id, pos, own: the points of the suppliers, and the same of the suppliers before them under the next number, in one pass."""
    sides = F.explode(F.array(F.struct(F.col("l_suppkey").alias("entry_id"), F.lit(True).alias("own")), F.struct((F.col("l_suppkey") + 1).alias("entry_id"), F.lit(False).alias("own")))).alias("x")
    return table(spark, sf_dir, "lineitem").select(sides, F.col("l_partkey").alias("pos")).select("x.entry_id", "pos", "x.own")


@query(f"{_ISLANDS} select * from isl")
def w2_islands(spark, sf_dir):
    return runs.islands(points(spark, sf_dir))


@query(f"{_ISLANDS}, s as (select distinct entry_id, 20001 as size from points) select s.entry_id, coalesce(sum(len), 0)::bigint as n_set, (20001 - coalesce(sum(len), 0))::bigint as n_unset, count(len) as n_runs from s left join isl using (entry_id) group by all")
def a12_set_counters(spark, sf_dir):
    own = points(spark, sf_dir)
    return runs.counters(own, own.select("entry_id").distinct().withColumn("size", F.lit(20001)))


@query(f"{_ISLANDS}, x as (select entry_id, start, start + len as e from isl union all select distinct entry_id, 20001, 20001 from points), g as (select entry_id, coalesce(max(e) over (partition by entry_id order by start rows between unbounded preceding and 1 preceding), 0) as f, start as t from x) select entry_id, f as start, t - f as len from g where t > f")
def t3_complement(spark, sf_dir):
    own = points(spark, sf_dir)
    return runs.complement(runs.islands(own), own.select("entry_id").distinct().withColumn("size", F.lit(20001)))


@query(f"{_ISLANDS} select entry_id, pos from points")
def w4_points_of_runs(spark, sf_dir):
    return runs.to_points(runs.islands(points(spark, sf_dir)))


@query(f"{_POINTS} select entry_id, pos from points union select entry_id + 1, pos from points")
def t1_union(spark, sf_dir):
    return dealt(both_points(spark, sf_dir).drop("own"), "entry_id", "pos").distinct()


@query(f"{_POINTS} select entry_id, pos from points intersect select entry_id + 1, pos from points")
def t2_intersection(spark, sf_dir):
    found = dealt(both_points(spark, sf_dir), "entry_id", "pos").groupBy("entry_id", "pos").agg(F.max("own").alias("own"), F.max(~F.col("own")).alias("shifted"))
    return found.where("own and shifted").select("entry_id", "pos")


@query("h as (select entry_id, n_nationkey as pattern_id, i as start_pos, 2 as m, i // 1 as p from text_dna, unnest(range(0, length(seq) - 1)) t(i), (select n_nationkey, substr('ACGTAGCTCA', n_nationkey + 1, 2) as motif from nation where n_nationkey < 5) where substr(seq, i + 1, 2) = motif), c as (select *, start_pos - 2 * row_number() over (partition by entry_id, pattern_id, start_pos % 2 order by start_pos) as chain from h) select entry_id, pattern_id::bigint as pattern_id, min(start_pos) as start, count(*) as copies, (count(*) * 2)::bigint as length from c group by entry_id, pattern_id, start_pos % 2, chain having count(*) >= 3")
def w7_tandem_repeats(spark, sf_dir):
    motifs = spark.createDataFrame([(i, "ACGTAGCTCA"[i : i + 2]) for i in range(5)], "pattern_id bigint, pattern string")
    return runs.tandem_motifs(text_dna(spark, sf_dir), motifs, min_copies=3)


_ASOF = "q as (select l_suppkey as k, l_orderkey as place from lineitem), keys as (select distinct l_suppkey as k, l_partkey as key from lineitem)"


def _asof(spark, sf_dir):
    """Orders as places in their supplier's lineitems, and every part of a lineitem as a key."""
    own = table(spark, sf_dir, "lineitem")
    return own.select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("place")), own.select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("key"))


@query(f"{_ASOF} select q.k, q.place, (select max(key) from keys where keys.k = q.k and key <= q.place) as found from q")
def j22_last_at_most(spark, sf_dir):
    return runs.last_at_most(*_asof(spark, sf_dir), "k", "place", "key")


@query(f"{_ASOF} select q.k, q.place, (select min(key) from keys where keys.k = q.k and key >= q.place) as found from q")
def j23_first_at_least(spark, sf_dir):
    return runs.first_at_least(*_asof(spark, sf_dir), "k", "place", "key")


# --- Masses ---------------------------------------------------------------------


_DIGEST = r"""
marked as (select entry_id, regexp_replace(regexp_replace(seq, '([KR])', '\1|', 'g'), '\|P', 'P', 'g') as s from letters), parts as (select entry_id, list_filter(string_split(s, '|'), lambda x: x != '') as p from marked),
frag as (select entry_id, p, i, j, array_to_string(p[i:j], '') as peptide, length(array_to_string(p[1:i - 1], '')) as start from parts, unnest(range(1, len(p) + 1)) t(i), unnest(range(i, least(i + 1, len(p)) + 1)) u(j)),
f as (select entry_id, start::bigint as start, peptide, (j - i)::bigint as missed from frag),
digest as (select * from f union all select entry_id, 1, substr(peptide, 2), missed from f where start = 0 and length(peptide) > 1 and peptide like 'M%')
"""


@query(f"""
{_DIGEST}, w as (select distinct peptide as pep from digest), x as (select {_mass_sql('pep', S.MONO)} as mass from w), y as (select mass from x where mass is not null), q as (select p_partkey as query, p_retailprice as mw from part)
select query, mw, count(mass) as n from q left join y on mass between mw - 0.1000001e0 and mw + 0.1000001e0 and abs(mw - mass) <= 0.1e0 group by query, mw
""")
def a8_peptide_multiplicity(spark, sf_dir):
    """Over the different tryptic peptides of all letters."""
    q = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query"), F.col("p_retailprice").alias("mw"))
    w = mass.different_peptides(letters(spark, sf_dir), only=mass.in_reach(q, 0.1))
    return mass.multiplicity(q, w.withColumn("mass", S.residue_mass("peptide")), 0.1)


@query("""
q as (select c_custkey as query, abs(c_acctbal) + 100 as mw from customer), x as (select distinct o_totalprice / 20 as mass from orders)
select query, mw, mass from q join x on abs(mw - mass) <= 0.5e0
""", views=True)
def j16_mass_lookup(spark, sf_dir):
    q = table(spark, sf_dir, "customer").selectExpr("c_custkey as query", "abs(c_acctbal) + 100 as mw")
    return mass.near(q, table(spark, sf_dir, "orders").selectExpr("o_totalprice / 20 as mass").distinct(), 0.5)


@query("""
q as (select c_custkey as query, abs(c_acctbal) + 100 as mw from customer), x as (select distinct o_totalprice / 20 as mass from orders)
select query, mw, mass from q join x on abs(mw - mass) <= mw * 0.0001e0
""")
def j17_relative_mass_window(spark, sf_dir):
    q = table(spark, sf_dir, "customer").selectExpr("c_custkey as query", "abs(c_acctbal) + 100 as mw")
    return mass.near_relative(q, table(spark, sf_dir, "orders").selectExpr("o_totalprice / 20 as mass").distinct(), 0.0001)


@query(f"""
s as (select entry_id, i as start, substr(seq, i + 1, 8) as rest from letters, unnest(range(0, length(seq))) t(i)), c as (select entry_id, start, l as length, substr(rest, 1, l) as piece from s, unnest(range(1, length(rest) + 1)) t(l)),
m as (select entry_id, start, length, {_mass_sql('piece', S.MONO)} as mass from c) select entry_id, start, length, round(mass, 3) as mass from m where mass between 398.5e0 and 400.5e0
""")
def w13_substring_masses(spark, sf_dir):
    return mass.substring_masses(letters(spark, sf_dir), 398.5, 400.5).withColumn("mass", F.round("mass", 3))


@query(f"{_DIGEST} select * from digest")
def w14_digest(spark, sf_dir):
    return mass.digest(letters(spark, sf_dir))


# --- Duplicates and uniqueness ------------------------------------------------


@query("s as (select doc_id as entry_id, 'd' || cast(doc_id as varchar) as defline, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) as seq from documents) select min(entry_id) as entry_id, string_agg(defline, ';' order by entry_id) as deflines, count(*) as n, seq from s group by seq")
def t4_non_redundant(spark, sf_dir):
    own = letters(spark, sf_dir).withColumn("defline", F.concat(F.lit("d"), F.col("entry_id").cast("string")))
    return uniq.non_redundant(own)


_CONTAINED = "own as (select distinct seq, min(entry_id) over (partition by seq) as entry_id, count(*) over (partition by seq) as n from letters), held as (select a.entry_id as part, b.entry_id as whole, a.n as n_part from own a join own b on length(a.seq) < length(b.seq) and contains(b.seq, a.seq) where a.seq != '')"


@query("select a.entry_id as part, b.entry_id as whole from letters a join letters b on a.entry_id != b.entry_id and length(a.seq) < length(b.seq) and contains(b.seq, a.seq) where a.seq != ''")
def j20_containment(spark, sf_dir):
    """Over the letters of all documents."""
    return uniq.contained(letters(spark, sf_dir))


@query(f"{_CONTAINED} select o.entry_id, seq, (n + coalesce((select sum(n_part) from held where whole = o.entry_id), 0))::bigint as n from own o where entry_id not in (select part from held)")
def t4_non_redundant_with_containment(spark, sf_dir):
    """Over the letters of all documents."""
    return uniq.non_redundant_with_containment(letters(spark, sf_dir).withColumn("defline", F.concat(F.lit("d"), F.col("entry_id").cast("string"))))


@query(f"{_words_sql('dna', 9)}, al as (select kmer from w union all select reverse(translate(kmer, 'ACGT', 'TGCA')) from w), o as (select kmer from al group by kmer having count(*) = 1) select entry_id, pos, kmer from w where kmer in (select kmer from o)")
def q18_unique_words(spark, sf_dir, source=dna):
    return uniq.unique_words(source(spark, sf_dir), 9)


@query(f"{_words_sql('dna', 12)} select a.entry_id, a.pos from w a where exists (select 1 from w b where b.kmer = a.kmer and (b.entry_id != a.entry_id or abs(b.pos - a.pos) >= 12))")
def j19_matched_elsewhere(spark, sf_dir, source=dna):
    own = source(spark, sf_dir)
    return uniq.matched_elsewhere(own, own, 12, 0, same=True)


@query(f"{_words_sql('dna', 8)}, p as (select distinct substr(pattern, 1, 8) as kmer from patterns) select entry_id, pos from w where exists (select 1 from p where hamming(p.kmer, w.kmer) <= 1)")
def a16_inexact_words(spark, sf_dir, source=dna):
    pats = patterns(spark, sf_dir).select(F.col("pattern_id").alias("entry_id"), F.substring("pattern", 1, 8).alias("seq"))
    return uniq.matched_elsewhere(source(spark, sf_dir), pats, 8, 1)


# --- Graphs ------------------------------------------------------------------------

_SPACES = "r as (select entry_id, i as pos, substr(seq, i + 1, 5) as kmer, case when i = 0 then null else substr(seq, i, 1) end as l, case when i + 5 = length(seq) then null else substr(seq, i + 6, 1) end as r from dna, unnest(range(0, length(seq) - 4)) t(i)), b as (select kmer from r group by kmer having count(*) > 1 and (count(l) < count(*) or count(r) < count(*) or count(distinct l) > 1 or count(distinct r) > 1)), sp as (select entry_id, pos, kmer from r where kmer in (select kmer from b))"
_GRAPH = f"{_SPACES}, st as (select entry_id, pos, kmer as src, lead(kmer) over (partition by entry_id order by pos) as dst, lead(pos) over (partition by entry_id order by pos) as nx from sp), ed as (select src, dst, substr(seq, pos + 6, nx - pos) as label, entry_id, pos from st join dna using (entry_id) where dst is not null), e as (select src, dst, label, count(*) as n, (min((entry_id, pos))) as f from ed group by src, dst, label)"


def _spaces(spark, sf_dir, source=dna):
    return graph.x_spaces(source(spark, sf_dir), 5)


def _word_graph(spark, sf_dir, source=dna):
    return graph.text_graph(source(spark, sf_dir), 5)


@query(f"{_SPACES} select * from sp")
def g1_x_spaces(spark, sf_dir, source=dna):
    return _spaces(spark, sf_dir, source)


@query(f"{_GRAPH}, g as (select src, dst, label, count(*) as n, min(entry_id * 1000000 + pos) as fp from ed group by all) select src, dst, label, n, fp // 1000000 as first_entry, fp % 1000000 as first_pos from g")
def g2_word_graph(spark, sf_dir, source=dna):
    return _word_graph(spark, sf_dir, source)


@query(f"{_GRAPH}, x as (select src as node, 0 as i, n as o from e union all select dst, n, 0 from e) select node, sum(i)::bigint as n_in, sum(o)::bigint as n_out, (sum(o) - sum(i))::bigint as surplus from x group by node")
def a14_degrees(spark, sf_dir, source=dna):
    return graph.degrees(_word_graph(spark, sf_dir, source))


@query(f"""{_GRAPH}, x as (select src as node, 0 as i, n as o from e union all select dst, n, 0 from e), d as (select node, sum(i)::bigint as i, sum(o)::bigint as o from x group by node)
select count(*) as n_nodes, count(*) filter (i = o) as n_balanced, count(*) filter (o > i) as n_surplus, count(*) filter (o < i) as n_deficit, sum(greatest(o - i, 0))::bigint as units, count(*) filter (i = 0) as n_sources, count(*) filter (o = 0) as n_sinks, count(*) filter (i = 1 and o = 1) as n_trivial, (select count(*) from e) as n_edges, (select sum(n)::bigint from e) as multiplicity from d
""")
def g5_graph_statistics(spark, sf_dir, source=dna):
    return graph.statistics(_word_graph(spark, sf_dir, source))


@query(f"{_GRAPH} select src, substr(label, 1, 1) as first, count(*) as n from e group by all having count(*) > 1")
def g13_ambiguous_edges(spark, sf_dir, source=dna):
    return graph.ambiguous_edges(_word_graph(spark, sf_dir, source))


@query(f"{_GRAPH} select src, dst, label, n from e where n > 1")
def f10_count_filter(spark, sf_dir, source=dna):
    return graph.count_filtered(_word_graph(spark, sf_dir, source), ">", 1).select("src", "dst", "label", "n")


@query("select * from (select o_orderkey * 2 as node, min(least(o_orderkey * 2, o_custkey * 2 + 1)) over (partition by o_custkey) as component from orders) union all select o_custkey * 2 + 1, min(least(o_orderkey * 2, o_custkey * 2 + 1)) from orders group by o_custkey", views=False)
def g4_components(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return graph.components(o.select((F.col("o_orderkey") * 2).alias("a"), (F.col("o_custkey") * 2 + 1).alias("b")))


def _path_edges(own):
    return kmers.dna_counts(own, 6).select(F.substring("kmer", 1, 5).alias("src"), F.expr("substring(kmer, 6, 1)").alias("label"), "n")


@query(f"{_words_sql('dna', 6)}, e as (select kmer, count(*) as n from w group by kmer) select entry_id, pos, n from w join e using (kmer)")
def g8_path_counts(spark, sf_dir, source=dna):
    own = source(spark, sf_dir)
    return graph.path_counts(own, _path_edges(own), 5)


@query(f"{_GRAPH} select ed.entry_id, ed.pos as start, src, dst, label, e.n from ed join e using (src, dst, label)")
def j24_threads(spark, sf_dir, source=dna):
    """The edges that each document takes whole through the word graph of all documents, found as a read is."""
    own = source(spark, sf_dir)
    found = graph.threaded(own, graph.text_graph(own, 5), 5)
    return found.where("first = 0 and last = length(label) - 1").select("entry_id", "start", "src", "dst", "label", "n")


@query(f"{_GRAPH} select ed.entry_id, ed.pos as start, src, dst, label, e.n from ed join e using (src, dst, label)")
def j24_edge_passages(spark, sf_dir, source=dna):
    """The same edges, without their threads."""
    own = source(spark, sf_dir)
    found = graph.edge_passages(own, graph.text_graph(own, 5), 5)
    return found.where("first = 0 and last = length(label) - 1").select("entry_id", "start", "src", "dst", "label", "n")


@query(f"""{_GRAPH}, w as (select src || label as path, length(label) as k from e) select distinct substr(path, i + 1, 6) as word from w, unnest(range(0, k)) t(i)""")
def q25_assembled_words(spark, sf_dir, source=dna):
    """Reads to contracted, resolved edges as one query: the different words of six letters along them, which no repair adds to or takes from."""
    texts = repair.assembled(source(spark, sf_dir), 5).select(F.monotonically_increasing_id().alias("entry_id"), F.col("text").alias("seq"))
    return kmers.words(texts, 6).select(F.col("kmer").alias("word")).distinct()


@query("""
c as (select o_custkey, o_orderkey, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as nx, count(*) over (partition by o_custkey) as k from orders)
select min(o_orderkey) as head, max(o_orderkey) as tail, string_agg(cast(o_orderkey as varchar) || '>', '' order by o_orderkey) filter (nx is not null) as label, count(*) - 1 as steps from c group by o_custkey having count(*) > 1
""")
def g9_unitigs(spark, sf_dir):
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").withColumn("nx", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("nx is not null")
    return graph.unitigs(o.select(F.col("o_orderkey").alias("src"), F.col("nx").alias("dst"), F.concat(F.col("o_orderkey").cast("string"), F.lit(">")).alias("label")))


@query()
def g7_balance(spark, sf_dir, source=dna):
    """Restart edges; that they balance the graph is tested."""
    return graph.balance(graph.numbered_graph(_word_graph(spark, sf_dir, source)))


@query(f"{_GRAPH} select src, dst, label, n, 0::bigint as breaks from e")
def g10_tours_visit_all(spark, sf_dir, source=dna):
    """How often the tours, none of them walked in one task, take each edge of the graph; breaks: how many steps of all tours begin elsewhere than where the step before ended."""
    edges = cut(graph.numbered_graph(_word_graph(spark, sf_dir, source)))
    tours = cut(graph.euler_tours(edges, in_one_task=0))
    after = tours.select("component", (F.col("step") - 1).alias("step"), F.col("src").alias("next"))
    breaks = tours.join(after, ["component", "step"]).where("dst != next").count()
    names = edges.select("src", "dst", "src_seq", "dst_seq").distinct()
    taken = tours.where("label is not null").groupBy("src", "dst", "label").agg(F.count("*").alias("n")).join(names, ["src", "dst"])
    return taken.select(F.col("src_seq").alias("src"), F.col("dst_seq").alias("dst"), "label", "n", F.lit(breaks).cast("bigint").alias("breaks"))


@query()
def g10_euler_tours(spark, sf_dir, source=dna):
    """Tours; that each uses every edge once is tested."""
    return graph.euler_tours(graph.numbered_graph(_word_graph(spark, sf_dir, source)))


@query()
def g12_transport(spark, sf_dir, source=dna):
    """Ways from deficit to surplus nodes along jumpers by Vogel's method, which is near the cheapest; the default method of ``graph.transported`` is the cheapest and tested against all assignments."""
    edges = graph.numbered_graph(_word_graph(spark, sf_dir, source))
    d = graph.degrees(edges).join(graph.components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))), "node")
    nodes = edges.select(F.col("src").alias("node"), F.col("src_seq").alias("seq")).unionByName(edges.select(F.col("dst").alias("node"), F.col("dst_seq").alias("seq"))).distinct()
    own = d.join(nodes, "node")
    ways = graph.jumpers(own.where("surplus < 0").select(F.col("node").alias("a"), "seq"), own.where("surplus > 0").select(F.col("node").alias("b"), "seq"), 5, shortest=2)
    tied = ways.join(d.select(F.col("node").alias("a"), "component"), "a").select("component", F.col("a").alias("src"), F.col("b").alias("dst"), F.col("cost").cast("bigint").alias("cost"))
    return graph.transported(d.select("component", "node", "surplus").where("surplus != 0"), tied, "vogel")


@query(f"{_SPACES} select row_number() over (order by kmer) as id, kmer as seq from (select distinct kmer from sp)")
def g16_numbered_nodes(spark, sf_dir, source=dna):
    return graph.numbered(graph.branching(source(spark, sf_dir), 5))


@query("n as (select n_nationkey::bigint as id, substr(n_name, 1, 1) as seq from nation), k as (select seq, min(id) as kept from n group by seq), ed as (select n_nationkey::bigint as src, (n_regionkey * 5)::bigint as dst, 'x' as label from nation) select distinct ks.kept as src, kd.kept as dst, label from ed join n a on a.id = src join k ks on ks.seq = a.seq join n b on b.id = dst join k kd on kd.seq = b.seq")
def g14_merged_nodes(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    nodes = nation.select(F.col("n_nationkey").cast("bigint").alias("id"), F.substring("n_name", 1, 1).alias("seq"))
    edges = nation.select(F.col("n_nationkey").cast("bigint").alias("src"), (F.col("n_regionkey") * 5).cast("bigint").alias("dst"), F.lit("x").alias("label"))
    return graph.merged_nodes(nodes, edges).select("src", "dst", "label")


@query("x as (select a.pattern_id as a, b.pattern_id as b, n from patterns a, patterns b, unnest(range(2, 8)) t(n) where a.pattern_id != b.pattern_id and n <= length(a.pattern) and n <= length(b.pattern) and right(a.pattern, n::integer) = left(b.pattern, n::integer)) select a, b, max(n) as overlap from x group by a, b")
def j21_overlaps(spark, sf_dir):
    pats = patterns(spark, sf_dir)
    return graph.overlaps(pats.select(F.col("pattern_id").alias("a"), F.col("pattern").alias("seq")), pats.select(F.col("pattern_id").alias("b"), F.col("pattern").alias("seq")), 2, 7)


@query("""
k as (select entry_id, i, substr(seq, i + 1, 6) as kmer from dna, unnest(range(0, length(seq) - 5)) t(i)), c as (select kmer, count(*) as n from k group by kmer),
v as (select entry_id, i + 5 as place, floor(log2(n::double) + 0.001)::bigint + 1 as value from k join c using (kmer)), w as (select *, place - row_number() over (partition by entry_id, value order by place) as island from v where value > 1)
select 'd' || entry_id || ' ' || min(place) || ' ' || (max(place) + 1) || ' ' || value as line from w group by entry_id, value, island
""")
def g8_path_tracks(spark, sf_dir, source=dna):
    own = source(spark, sf_dir)
    tracks = repair.text_tracks(own, _path_edges(own), 5, "log2")
    return tracks.withColumn("name", F.concat(F.lit("d"), F.col("entry_id").cast("string"))).select(formats.wig_bar().alias("line"))


@query()
def g6_resolved_repeats(spark, sf_dir, source=dna):
    own = source(spark, sf_dir)
    edges = kmers.count(kmers.words(own, 8)).select(F.substring("kmer", 1, 7).alias("src"), F.substring("kmer", 2, 7).alias("dst"), F.substring("kmer", 8, 1).alias("label"), "n")
    return repair.resolved_by_reads(edges, own)


@query("""
k as (select substr(seq, i + 1, 10) as kmer, count(*) as n from (select substr(seq, 1, 32) || '$' || substr(seq, 33) as seq from dna), unnest(range(0, length(seq) - 9)) t(i) group by 1),
p as (select unnest(string_split(kmer, '$')) as piece, n from k)
select left(piece, 6) as src, right(piece, 6) as dst, substr(piece, 7) as label, sum(n)::bigint as n from p where length(piece) > 6 group by all
""")
def g17_terminators_removed(spark, sf_dir, source=dna):
    own = source(spark, sf_dir).select("entry_id", F.expr("substring(seq, 1, 32) || '$' || substring(seq, 33)").alias("seq"))
    edges = kmers.count(kmers.words(own, 10))
    return repair.without_terminators(edges.select(F.substring("kmer", 1, 6).alias("src"), F.substring("kmer", 5, 6).alias("dst"), F.expr("substring(kmer, 7)").alias("label"), "n"), 6)


@query("""
o as (select o_custkey, o_orderkey, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as nx from orders),
e as (select min(o_orderkey) as first, max(o_orderkey) as last from o group by o_custkey having count(nx) > 0)
select last as src, nx as dst, '$' || nx as label from (select *, lead(first) over (order by first) as nx from e) where nx is not null
""")
def g18_joined_components(spark, sf_dir):
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").withColumn("nx", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("nx is not null")
    return repair.joined_components(o.select(F.col("o_orderkey").alias("src"), F.col("nx").alias("dst"), F.lit(1).cast("bigint").alias("n")))


# --- Sources, formats, streams ----------------------------------------------


@query("select 'doc' || entry_id as name, 'doc' || entry_id || ' derived' as defline, seq, length(seq)::bigint as len from text_dna")
def s1_fasta_round_trip(spark, sf_dir):
    """Written as FASTA of 60 columns, read back."""
    path = f"{shared_dir(spark)}/fasta-{uuid4().hex}"
    files.write_fasta(text_dna(spark, sf_dir).select(F.concat(F.lit("doc"), F.col("entry_id").cast("string"), F.lit(" derived")).alias("defline"), "seq"), path)
    return files.read_fasta(spark, path).select("name", "defline", "seq", "len")


@query("a as (select entry_id, 1 + coalesce(sum(length(seq) + 1) over (order by entry_id rows between unbounded preceding and 1 preceding), 0) as abs_start from text_dna) select entry_id, abs_start::bigint as abs_start from a")
def d2_absolute_starts(spark, sf_dir):
    return files.with_absolute_starts(text_dna(spark, sf_dir)).select("entry_id", "abs_start")


@query(f"{_ISLANDS}, x as (select entry_id, start, len, 1 as st from isl union all select entry_id, f, t - f, 0 from (select entry_id, coalesce(max(e) over (partition by entry_id order by start rows between unbounded preceding and 1 preceding), 0) as f, start as t from (select entry_id, start, start + len as e from isl union all select distinct entry_id, 20001, 20001 from points)) where t > f) select entry_id, 'BEGIN 20001 ' || case when min_by(st, start) = 1 then '0 ' else '' end || string_agg(cast(len as varchar), ' ' order by start) || ' END' as line from x group by entry_id")
def s19_bitmap_lines(spark, sf_dir):
    spans = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entry_id"), F.lit(20001).alias("size")).distinct()
    return files.bitmap_lines(runs.islands(points(spark, sf_dir)), spans)


@query(f"{_EXACT} select entry_id || ':' || start_pos || '-' || end_pos || chr(9) || pattern || ' (' || (end_pos - start_pos) || ') 100%' as line from hits join patterns using (pattern_id)")
def r1_hit_lines(spark, sf_dir):
    pats = patterns(spark, sf_dir)
    hits = match.exact(text_dna(spark, sf_dir), pats).join(pats, "pattern_id").select("entry_id", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), (F.col("end_pos") - F.col("start_pos")).alias("length"), "pattern")
    return hits.select(formats.compile_format("%f:%s-%e\\t%q (%l) 100%%", formats.ALIGNMENT).alias("line"))


@query(f"{_PAIRS} select entry_id || ' ' || start_pos || '..' || right_start || ' ' || length || repeat(' ', length(cast(length as varchar))) || '|' as line from amp")
def r3_pair_lines(spark, sf_dir):
    a = _amplicons(spark, sf_dir).select("entry_id", "length", F.col("start_pos").alias("left_start"), F.col("right_start").alias("right_start"))
    return a.select(formats.compile_format("%f %>s..%<s %l%!l|", formats.PAIR | {"!": "length"}, sides=True).alias("line"))


@query()
def r3_pair_lines_whole(spark, sf_dir):
    """Lines of the pairs of whole patterns."""
    a = _whole_amplicons(spark, sf_dir).select("entry_id", "length", F.col("start_pos").alias("left_start"), F.col("right_start").alias("right_start"))
    return a.select(formats.compile_format("%f %>s..%<s %l%!l|", formats.PAIR | {"!": "length"}, sides=True).alias("line"))


@query(f"{_RUNS.format(source='text_dna')} select entry_id || ' ' || symbol || ' ' || start || '+' || len as line from runs where len >= 5")
def r5_run_lines(spark, sf_dir):
    return runs.runs(text_dna(spark, sf_dir), 5).select(formats.compile_format("%f %t %s+%l", formats.RUN).alias("line"))


@query("select '>d' || entry_id || chr(10) || rtrim(regexp_replace(seq, '(.{60})', '\\1' || chr(10), 'g'), chr(10)) as record from dna")
def s24_fasta_records(spark, sf_dir, source=dna):
    return source(spark, sf_dir).select(S.fasta_record(F.concat(F.lit("d"), F.col("entry_id").cast("string")), "seq").alias("record"))


_DRAW = "('0x' || substr(md5(concat_ws(':', {}, cast(entry_id as varchar), cast(i as varchar))), 1, 8))::bigint"


@query(f"g as (select entry_id, i, substr('ACGT', ({_DRAW.format(repr('7'))} % 4 + 1)::integer, 1) as c from unnest(range(1, 21)) e(entry_id), unnest(range(1, 501)) t(i)) select entry_id, string_agg(c, '' order by i) as seq from g group by entry_id")
def s26_random_genome(spark, sf_dir):
    """Seeded random entries; the same however they are partitioned."""
    return files.random_genome(spark, 20, 500, 7)


@query(f"""
l as (select entry_id, i, substr(seq, i + 1, 1) as c from dna, unnest(range(0, length(seq))) t(i)),
m as (select entry_id, i, case when {_DRAW.format(repr('11'))} < {int(0.02 * (1 << 32))} then substr('ACGTACGT', (instr('ACGT', c) + 1 + {_DRAW.format(repr('12'))} % 3)::integer, 1) else c end as c from l),
r as (select entry_id, 'G' || string_agg(c, '' order by i) as s from m group by entry_id)
select entry_id, 'G' || array_to_string(list_transform(range(1, length(s)), lambda i: cast(xor(instr('ACGT', substr(s, i, 1)) - 1, instr('ACGT', substr(s, i + 1, 1)) - 1) as varchar)), '') as read from r
""")
def q27_simulated_reads(spark, sf_dir):
    """Colour-space reads with random errors."""
    reads = files.with_random_errors(dna(spark, sf_dir), 0.02, 11)
    return reads.select("entry_id", S.colour_space("seq").alias("read"))


@query(f"{_EXACT} select * from hits")
def stream_exact_match(spark, sf_dir):
    """The exact match over a stream of documents, drained to a table."""
    base = f"{shared_dir(spark)}/stream-{uuid4().hex}"
    own = table(spark, sf_dir, "documents")
    own.write.parquet(f"{base}/in")
    docs = per_entry.read_entries(spark, f"{base}/in", own.select("*").schema.simpleString()[7:-1].replace(":", " "))
    entries = docs.select(F.col("doc_id").alias("entry_id"), F.translate(F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")), *_AZ).alias("seq"))
    per_entry.drain(per_entry.exact_hits(entries, patterns(spark, sf_dir)), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out")


# --- The same over whole texts ------------------------------------------------

#: Each of these reads ``dna``; it is registered again over all letters of the texts, with the same SQL over those.
WHOLE = (j6_mismatches, j8_anchored_mismatches, j10_seeded_mismatches, a1_counts_by_edits, q18_unique_words, j19_matched_elsewhere, a16_inexact_words, g1_x_spaces, g2_word_graph, a14_degrees, g5_graph_statistics, g13_ambiguous_edges, g16_numbered_nodes, g8_path_counts, j24_edge_passages,
         x6_six_frames, p3_extract, p4_annotated, p13_colour_space, x10_kmer_codes, a9_n_statistics, j18_annotate_kmers, a15_neighbours, g8_path_tracks, g17_terminators_removed, s24_fasta_records, f10_count_filter)
#: The same without SQL: alignments have ties that SQL does not tell, and tours, restart edges, transports and repairs are one of many right ones; tested by brute force and by what they must keep.
WHOLE_WITHOUT_SQL = (u1_alignments, g7_balance, g10_euler_tours, g12_transport, g6_resolved_repeats)


def _over_texts(f):
    def run(spark, sf_dir):
        return f(spark, sf_dir, text_dna)

    run.__name__, run.__doc__ = f"{f.__name__}_whole", f"{f.__name__} over whole texts."
    return run


#: The hits of _SUBS, over whole texts; the windows are made once.
_SUBS_OF_TEXTS = "win as materialized (select entry_id, i, substr(seq, i + 1, 10) as win from text_dna, unnest(range(0, length(seq) - 7)) t(i)), near as (select entry_id, pattern_id, i as start_pos, i + length(pattern) as end_pos, hamming(left(win, length(pattern)), pattern)::bigint as edits from win join patterns on length(win) >= length(pattern) where hamming(left(win, length(pattern)), pattern) <= 2)"


def _texts_sql(name: str) -> str:
    """The SQL of a query of ``dna`` over ``text_dna``."""
    return re.sub(r"\b(from|join) dna\b", r"\1 text_dna", ORACLE_SQL[name].replace(_SUBS, _SUBS_OF_TEXTS))


for _f in WHOLE:
    query(_texts_sql(_f.__name__), whole=True)(_over_texts(_f))
for _f in WHOLE_WITHOUT_SQL:
    query()(_over_texts(_f))


#: Ends of stretches within one edit of a pattern, over whole texts: one half of the pattern stands there exactly.
_ENDS_BY_HALVES = """
halves as (select pattern_id, pattern, 0 as o, left(pattern, length(pattern) // 2) as mer from patterns union all select pattern_id, pattern, length(pattern) // 2, substr(pattern, length(pattern) // 2 + 1) from patterns),
mers as (select entry_id, i, substr(seq, i + 1, n) as mer from text_dna, unnest([4, 5]) s(n), unnest(range(0, length(seq) - n + 1)) t(i)),
seeds as (select distinct entry_id, pattern_id, pattern, i - o as place from mers join halves using (mer)),
around as (select pattern_id, pattern, entry_id, place, length(seq) as n, substr(seq, greatest(place - 3, 0) + 1, 20) as win, greatest(place - 3, 0) as base from seeds join text_dna using (entry_id)),
tries as (select entry_id, pattern_id, pattern, place + length(pattern) + d as e, length(pattern) + l as l, win, base, n from around, unnest([-1, 0, 1]) u(d), unnest([-1, 0, 1]) v(l)),
ends as (select entry_id, pattern_id, e as end_pos, min(levenshtein(substr(win, e - l - base + 1, l), pattern))::bigint as edits from tries where l <= e and e <= n group by all having min(levenshtein(substr(win, e - l - base + 1, l), pattern)) <= 1)"""

query(f"{_ENDS_BY_HALVES} select * from ends")(_over_texts(j7_edit_ends))
query(f"{_ENDS_BY_HALVES}{_CLUSTERS.removeprefix(_ENDS)} select * from cl")(_over_texts(w5_clustered_hits))


@query(f"x as ({re.sub(r'from dna', 'from text_dna', ORACLE_SQL['w11_spaced_words'].removeprefix(f'with {VIEWS.strip()} '))}) select tag, word, count(*) as n from x group by all")
def w11_spaced_words_whole(spark, sf_dir):
    """How often each spaced word stands in the whole texts."""
    return kmers.spaced(text_dna(spark, sf_dir), ["11011", "1011"]).groupBy("tag", "word").agg(F.count("*").alias("n"))


from . import compositions  # noqa: E402, F401  (registers its queries here)
