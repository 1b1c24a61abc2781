"""Scalar functions on sequences as Column expressions; no UDF anywhere.

Coordinates are space-based: 0-based start, end exclusive.
"""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

# Complements, letter by letter, both cases.
COMPLEMENT = ("acgtumrwsykvhdbACGTUMRWSYKVHDB", "tgcaakywsrmbdhvTGCAAKYWSRMBDHV")
# Which text letters an ambiguity letter is compatible with, as listed, before closing the relation symmetrically.
COMPATIBLE = "A:ARMWDHVN B:GTUCYKSBN C:CYMSBHVN D:GATURWKDN G:GRKSBDVN H:ACTUMYWHN K:GTKBDN M:ACMHVN N:ACGTURYKMSWVDHVN R:GARDVN S:GCSBVN T:TUYKWVDHN U:UTYKWVDHN V:GCARSMVN W:ATUWDHN X:MRWSYKVHDBXN Y:TUCYBHN"
# The standard code in the order T, C, A, G of each of the three letters.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
# Monoisotopic and average residue masses.
MONO = {"A": 71.03711, "R": 156.10111, "N": 114.04293, "D": 115.02694, "C": 103.00919, "E": 129.04259, "Q": 128.05858, "G": 57.02146, "H": 137.05891, "I": 113.08406, "L": 113.08406, "K": 128.09496, "M": 131.04049, "F": 147.06841, "P": 97.05276, "S": 87.03203, "T": 101.04768, "W": 186.07931, "Y": 163.06333, "V": 99.06841}
AVERAGE = {"A": 71.0788, "R": 156.1875, "N": 114.1038, "D": 115.0886, "C": 103.1388, "E": 129.1155, "Q": 128.1307, "G": 57.0519, "H": 137.1411, "I": 113.1594, "L": 113.1594, "K": 128.1741, "M": 131.1926, "F": 147.1766, "P": 97.1167, "S": 87.0782, "T": 101.1051, "W": 186.2132, "Y": 163.1760, "V": 99.1326}


def column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(seq: Column | str) -> Column:
    """Printable letters only, upper case."""
    return F.upper(F.regexp_replace(column(seq), "[^!-~]", ""))


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(column(seq), *COMPLEMENT))


def remap(seq: Column | str, lysine: bool = False) -> Column:
    """I as L, and K as Q if asked."""
    return F.translate(column(seq), *(("IiKk", "LlQq") if lysine else ("Ii", "Ll")))


def first_word(defline: Column | str) -> Column:
    return F.regexp_extract(column(defline), r"^[^ \t]*", 0)


def subsequence(seq: Column | str, start: Column | str, length: Column | str) -> Column:
    return F.substring(column(seq), (column(start) + 1).cast("int"), column(length).cast("int"))


def positions(seq: Column | str, span: Column | int) -> Column:
    """All 0-based starts of stretches of that span; none if the sequence is shorter."""
    span = F.lit(span) if isinstance(span, int) else span
    last = F.length(column(seq)) - span
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def codon_map() -> Column:
    letters = "TCAG"
    pairs = [(a + b + c, CODE[16 * i + 4 * j + k]) for i, a in enumerate(letters) for j, b in enumerate(letters) for k, c in enumerate(letters)]
    return F.create_map(*(F.lit(x) for pair in pairs for x in pair))


def translation(seq: Column | str, frame: Column | int = 0) -> Column:
    """Amino acids of whole codons from offset frame % 3; frames 3 to 5 read the reverse complement. Unknown codons: X."""
    seq, frame = column(seq), F.lit(frame) if isinstance(frame, int) else frame
    strand = F.when(frame >= 3, reverse_complement(seq)).otherwise(seq)
    # cut once from left to right, as a substring by number would be sought from the start of the text
    codons = F.regexp_extract_all(F.substring(strand, frame % 3 + 1, F.length(strand)), F.lit("(?s).{3}"), F.lit(0))
    table = codon_map()
    return F.array_join(F.transform(F.coalesce(codons, F.array().cast("array<string>")), lambda c: F.coalesce(F.element_at(table, c), F.lit("X"))), "")


def codon_to_dna(aa_start: Column | str, aa_length: Column | str, frame: Column | str, dna_length: Column | str) -> tuple[Column, Column]:
    """Start and end on the forward strand of a stretch of a translated frame."""
    off = column(aa_start) * 3 + column(frame) % 3
    back = column(dna_length) - off - column(aa_length) * 3
    start = F.when(column(frame) >= 3, back).otherwise(off)
    return start, start + column(aa_length) * 3


def compatible_letters(strict: bool = False) -> dict[str, str]:
    """Letters that match each letter; symmetric unless strict."""
    listed = {x: set(y) for x, y in (e.split(":") for e in COMPATIBLE.split())}
    if not strict:
        for a in list(listed):
            for b in listed[a] | {a}:
                listed.setdefault(b, set()).add(a)
    return {a: "".join(sorted(b | {a})) for a, b in listed.items()}


def stands_for(letter: str) -> set[str]:
    """The bases A, C, G and T that an ambiguity letter may be; U is T."""
    listed = {x: y for x, y in (e.split(":") for e in COMPATIBLE.split())}
    return {"T" if x == "U" else x for x in listed.get(letter, letter) if x in "ACGTU"}


def contains_letter(wide: str, narrow: str) -> bool:
    """Whether all that the second letter may be the first may be, too."""
    return bool(stands_for(narrow)) and stands_for(narrow) <= stands_for(wide)


def contained_letter(narrow: str, wide: str) -> bool:
    return contains_letter(wide, narrow)


def compatible(text: Column | str, pattern: Column | str, relation: str = "compatible") -> Column:
    """Whether two letters are compatible, or the pattern's contains the text's, or is contained in it."""
    table = compatible_letters()
    tests = {"compatible": lambda p, t: t in table.get(p, p), "contains": contains_letter, "contained": contained_letter}
    letters = sorted(table)
    true = [p + t for p in letters for t in letters if tests[relation](p, t)]
    return F.concat(column(pattern), column(text)).isin(true)


def gcd(a: Column | str, b: Column | str) -> Column:
    """Greatest common divisor of two integers, by Euclid's steps (92 are enough for 64 bits)."""
    start = F.struct(F.abs(column(a)).cast("bigint").alias("x"), F.abs(column(b)).cast("bigint").alias("y"))
    step = lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, s["y"]).otherwise(s["x"] % s["y"]).alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["x"])


def lcm(a: Column | str, b: Column | str) -> Column:
    """Least common multiple; 0 if both are 0, null beyond 64 bits."""
    g = gcd(a, b)
    whole = F.call_function("div", F.abs(column(a)).cast("bigint"), F.when(g != 0, g))
    return F.when(g == 0, F.lit(0).cast("bigint")).otherwise(F.try_multiply(whole, F.abs(column(b)).cast("bigint")))


def codon_distance(codon: Column | str, amino: Column | str) -> Column:
    """Fewest nucleotide changes from a codon to any codon of an amino acid; null for what is neither."""
    letters = "TCAG"
    codons = [x + y + z for x in letters for y in letters for z in letters]
    table = {c + a: codon_amino_distance(c, a) for c in codons for a in sorted(set(CODE))}
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), F.concat(column(codon), column(amino)))


def to_regex(pattern: str, wildcards: bool = True, text_n: bool = False, lite: bool = False) -> str:
    """A pattern as a regular expression of one class a letter.

    wildcards: ambiguity letters match what they are compatible with, text N only if text_n.
    lite: . any letter, : a letter that is no amino acid, ; a letter that is not A, C, G or T.
    """
    table, out = compatible_letters(), []
    for c in pattern:
        if lite and c in ".:;":
            out.append({".": ".", ":": "[^ACDEFGHIKLMNPQRSTVWY]", ";": "[^ACGT]"}[c])
        elif wildcards and c in table:
            letters = table[c] if text_n else table[c].replace("N", "")  # a pattern's N, too, meets no text N then
            out.append(f"[{letters}]" if letters else "(?!)")
        else:
            out.append(f"[{c}]" if c.isalnum() else "\\" + c)
    return "".join(out)


def any_of(words: list[str]) -> str:
    """A regular expression that finds any of the words, branching letter by letter; words that begin with another of them are not needed."""
    shortest: list[str] = []
    for w in sorted(words):
        if not shortest or not w.startswith(shortest[-1]):
            shortest.append(w)

    def branch(rest: list[str]) -> str:
        if len(rest) == 1:
            return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in rest[0])
        tails = {c: [w[1:] for w in rest if w[0] == c] for c in sorted({w[0] for w in rest})}
        parts = [branch([c]) + (branch(t) if t[0] else "") for c, t in tails.items()]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return branch(shortest)


def kmer_code(kmer: Column | str) -> Column:
    """Base-4 number of an ACGT word (up to 31 letters)."""
    return F.conv(F.translate(column(kmer), "ACGT", "0123"), 4, 10).cast("bigint")


def kmer_word(code: Column | str, k: int) -> Column:
    return F.translate(F.lpad(F.conv(column(code).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def template_word(seq: Column | str, at: Column, template: str) -> Column:
    """The letters at the 1-positions of a spaced template that starts at a 0-based place."""
    return F.concat(*(F.substring(column(seq), at + i + 1, F.lit(1)) for i, x in enumerate(template) if x == "1"))


def template_facts(template: str) -> dict[str, object]:
    """Span, weight, period, runs, reverse, and whether it is symmetric."""
    n = len(template)
    period = next((p for p in range(1, n + 1) if all(template[i] == template[i - p] for i in range(p, n))), n)
    runs = [len(r) for r in template.replace("0", " ").split()]
    return {"span": n, "weight": template.count("1"), "period": period, "runs": runs, "reverse": template[::-1], "symmetric": template == template[::-1]}


def n_count(seq: Column | str) -> Column:
    return F.length(column(seq)) - F.length(F.replace(column(seq), F.lit("N"), F.lit("")))


def longest_n_run(seq: Column | str) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(column(seq), F.lit("N+"), F.lit(0)), F.length)), F.lit(0))


def mass_map(table: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for pair in sorted(table.items()) for x in pair))


def residue_mass(seq: Column | str, table: dict[str, float] | None = None) -> Column:
    """Sum of residue masses by counts of letters (so the order of the letters doesn't matter); null if a letter has none."""
    seq, table = column(seq), table or MONO
    count = lambda c: F.length(seq) - F.length(F.replace(seq, F.lit(c), F.lit("")))
    total = sum((count(c) * m for c, m in sorted(table.items())), F.lit(0.0))
    known = "".join(sorted(table))
    return F.when(F.length(F.translate(seq, known, "")) == 0, total)


def colour_space(seq: Column | str, primer: str = "G") -> Column:
    """Primer letter, then a digit for every pair of neighbours, the primer's pair first: the exclusive or of the letters' codes."""
    letters = F.filter(F.split(F.concat(F.lit(primer), column(seq)), ""), lambda c: c != "")
    codes = F.transform(letters, lambda c: F.instr(F.lit("ACGT"), c) - 1)
    steps = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: a.bitwiseXOR(b).cast("string"))
    return F.concat(F.lit(primer), F.array_join(F.coalesce(steps, F.array().cast("array<string>")), ""))


def canonical(seq: Column | str, alphabet: str = "ACGT", other: str = "N") -> Column:
    return F.regexp_replace(F.upper(column(seq)), f"[^{alphabet}]", other)


def deviance(length: Column | str, low: Column | str, high: Column | str) -> Column:
    return F.greatest(column(length) - column(high), column(low) - column(length), F.lit(0))


def count_transform(count: Column | str, kind: int) -> Column:
    """0 as it is, 1 floor(log2(c) + 0.001) + 1, 2 at most two."""
    c = column(count)
    return [c, F.when(c > 0, F.floor(F.log2(c.cast("double")) + 0.001) + 1).otherwise(F.lit(0)), F.least(c, F.lit(2))][kind]


def hamming(a: Column, b: Column) -> Column:
    """Substitutions between texts of one length."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)


def fasta_record(defline: Column | str, seq: Column | str, width: int = 60) -> Column:
    return F.concat(F.lit(">"), column(defline), F.lit("\n"), F.regexp_replace(column(seq), f"(.{{{width}}})(?=.)", "$1\n"))


def constraints(pattern_length: Column | str, five: int = 0, three: int = 0, start: int = 0, end: int = 0, five_inexact: int | None = None, three_inexact: int | None = None, start_inexact: int | None = None, end_inexact: int | None = None) -> tuple[Column, Column]:
    """Exact letters at the left and right of a forward pattern; an inexact value says how many letters alone may differ."""
    n = column(pattern_length)
    rest = lambda x: n - x if x is not None else F.lit(0)
    left = F.greatest(F.lit(start), F.lit(five), rest(end_inexact), rest(three_inexact))
    right = F.greatest(F.lit(end), F.lit(three), rest(start_inexact), rest(five_inexact))
    return left, right


def amino_distance_map() -> dict[str, int]:
    """Fewest nucleotide changes between codons of two amino acids, by their two letters."""
    letters = "TCAG"
    codons: dict[str, list[str]] = {}
    for i, a in enumerate(letters):
        for j, b in enumerate(letters):
            for k, c in enumerate(letters):
                codons.setdefault(CODE[16 * i + 4 * j + k], []).append(a + b + c)
    return {x + y: min(sum(p != q for p, q in zip(s, t, strict=True)) for s in codons[x] for t in codons[y]) for x in codons for y in codons}


def codon_amino_distance(codon: str, amino: str) -> int:
    """Fewest changes from one codon to any codon of an amino acid."""
    letters = "TCAG"
    return min(sum(p != q for p, q in zip(codon, x + y + z, strict=True)) for i, x in enumerate(letters) for j, y in enumerate(letters) for k, z in enumerate(letters) if CODE[16 * i + 4 * j + k] == amino)


def mutation_cost(a: Column, b: Column) -> Column:
    """Sum of nucleotide changes between two peptides of one length; letters without a codon cost 3 unless equal."""
    table = F.create_map(*(F.lit(x) for pair in sorted(amino_distance_map().items()) for x in pair))
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(F.coalesce(F.element_at(table, F.concat(x, y)), F.lit(3)))), F.lit(0), lambda s, x: s + x)


# Nearest-neighbour enthalpy (kcal/mol) and entropy (cal/mol K) of DNA pairs, SantaLucia 1998, and of the ends.
STACKS = {"AA": (-7.9, -22.2), "TT": (-7.9, -22.2), "AT": (-7.2, -20.4), "TA": (-7.2, -21.3), "CA": (-8.5, -22.7), "TG": (-8.5, -22.7), "GT": (-8.4, -22.4), "AC": (-8.4, -22.4), "CT": (-7.8, -21.0), "AG": (-7.8, -21.0), "GA": (-8.2, -22.2), "TC": (-8.2, -22.2), "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.9), "CC": (-8.0, -19.9)}
ENDS = {"A": (2.3, 4.1), "T": (2.3, 4.1), "C": (0.1, -2.8), "G": (0.1, -2.8)}


def melting_temperature(seq: Column | str, strand_molar: float = 2.5e-7, salt_molar: float = 0.05) -> Column:
    """Celsius, of an ACGT word with its complement; null for other letters or fewer than two."""
    seq = column(seq)
    tables = [F.create_map(*(F.lit(x) for k, v in sorted(STACKS.items()) for x in (k, v[i]))) for i in (0, 1)]
    ends = [F.create_map(*(F.lit(x) for k, v in sorted(ENDS.items()) for x in (k, v[i]))) for i in (0, 1)]
    pairs = F.sequence(F.lit(1), F.length(seq) - 1)

    def total_of(n: int) -> Column:
        stacked = F.aggregate(pairs, F.lit(0.0), lambda s, i: s + F.element_at(tables[n], F.substring(seq, i, F.lit(2))))
        return stacked + F.element_at(ends[n], F.substring(seq, 1, 1)) + F.element_at(ends[n], F.substring(seq, -1, 1))

    total = [total_of(0), total_of(1)]
    entropy = total[1] + 0.368 * (F.length(seq) - 1) * F.log(F.lit(salt_molar))
    return F.when(seq.rlike("^[ACGT]{2,}$"), total[0] * 1000 / (entropy + 1.987 * F.log(F.lit(strand_molar / 4))) - 273.15)


def truth(text: str) -> bool:
    """Accepted spellings of true and false."""
    low = text.strip().lower()
    if low in ("true", "t", "yes", "y", "1", "on"):
        return True
    if low in ("false", "f", "no", "n", "0", "off"):
        return False
    raise ValueError(f"neither true nor false: {text!r}")


