"""Format strings compiled to Column expressions: %x codes are looked up among the given columns, other text is literal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each code of an alignment line stands for.
ALIGNMENT = {
    "s": "start", "e": "end", "l": "length", "5": "five", "3": "three", "S": "abs_start", "E": "abs_end", "i": "pattern_id", "d": "edits", "D": "length_difference",
    "p": "forward_pattern", "P": "pattern_defline", "q": "pattern", "Q": "pattern_gaps", "r": "strand", "R": "strand_word", "t": "text", "T": "text_gaps", "U": "text_forward", "A": "ops",
    "h": "defline", "H": "name", "f": "entry_id", "I": "sts_id", "L": "size", "a": "accession", "O": "species", "&": "altacc", "X": "chrom", "F": "frame", "n": "dna", "M": "mass_difference", "m": "tm", "G": "dg",
    "|": "n_equal", "^": "n_extra", "v": "n_missing", "*": "n_sub", "+": "n_wild", "=": "block",
}
COUNT = {"i": "pattern_id", "p": "forward_pattern", "P": "pattern_defline", "q": "pattern", "r": "strand", "R": "strand_word", "c": "n", "C": "counts", "+": "capped_mark", "I": "sts_id", "L": "size", "a": "accession", "O": "species", "&": "altacc", "X": "chrom"}
RUN = {"s": "start", "e": "end", "l": "len", "S": "abs_start", "E": "abs_end", "t": "symbol", "h": "defline", "H": "name", "f": "entry_id"}
TANDEM = {"i": "pattern_id", "q": "motif", "s": "start", "e": "end", "l": "length", "c": "copies", "m": "motif_length", "h": "defline", "H": "name", "f": "entry_id"}
#: Codes of a pair that belong to the amplicon; the others take > (left) or < (right).
PAIR = {"l": "length", "@": "amplicon", "*": "amplicon_forward", "N": "n_count", "D": "deviance", "0": "epcr", "h": "defline", "H": "name", "f": "entry_id", "I": "sts_id", "L": "size", "a": "accession", "O": "species", "&": "altacc", "X": "chrom"}


def compile_format(text: str, codes: dict[str, str], sides: bool = False) -> Column:
    """One string Column. %% is a percent sign, \\n and \\t as usual, unknown codes print themselves.

    sides: a code may have > or < (the columns left_ and right_) and ! (as many blanks as the value is wide) between it and %.
    """
    parts: list[Column] = []
    literal, i = "", 0

    def flush() -> None:
        nonlocal literal
        if literal:
            parts.append(F.lit(literal))
            literal = ""

    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            literal += {"n": "\n", "t": "\t", "\\": "\\"}.get(text[i + 1], text[i + 1])
            i += 2
            continue
        if c != "%" or i + 1 == len(text):
            literal += c
            i += 1
            continue
        i += 1
        side, blank = "", False
        while sides and text[i] in "<>!" and i + 1 < len(text):
            if text[i] == "!":
                blank = True
            else:
                side = "left_" if text[i] == ">" else "right_"
            i += 1
        code = text[i]
        i += 1
        if code == "%":
            literal += "%"
        elif side and code in ALIGNMENT or code in codes:
            flush()
            name = side + ALIGNMENT[code] if side else codes[code]
            value = F.coalesce(F.col(name).cast("string"), F.lit(""))
            parts.append(F.repeat(F.lit(" "), F.length(value)) if blank else value)
        else:
            literal += code
    flush()
    return F.concat(*parts) if parts else F.lit("")


def peptide_line(peptide: str = "text", left: str = "left_context", right: str = "right_context", subs: str = "edits", delta: str = "mass_difference") -> Column:
    """A peptide with its neighbours, and the substitutions and mass change if there are any."""
    extra = F.when(F.col(subs) > 0, F.concat(F.lit(" /sub"), F.col(subs).cast("string"), F.lit("= /delta="), F.format_number(delta, 4))).otherwise(F.lit(""))
    return F.concat(F.col(left), F.lit("."), F.col(peptide), F.lit("."), F.col(right), extra)


def wig(start: str = "start", span: str = "len", value: str = "n") -> Column:
    """A variableStep line."""
    return F.concat(F.lit("variableStep span="), F.col(span).cast("string"), F.lit("\n"), (F.col(start) + 1).cast("string"), F.lit(" "), F.col(value).cast("string"))


def wig_header(mer: int | None) -> str:
    """The first line of a track of counts of ``mer``-letter words; None where words are of different lengths, which no number names."""
    return f"track type=wiggle_0 name={f'{mer}-' if mer else ''}mer-cnt priority=10 graphType=bar autoScale=off viewLimits=1:20"  # fixed value: the format of the line


def wig_bar(name: str = "name", start: str = "start", stop: str = "stop", value: str = "value") -> Column:
    """A line of such a track: name, start, stop, value."""
    return F.concat_ws(" ", name, F.col(start).cast("string"), F.col(stop).cast("string"), F.col(value).cast("string"))
