"""Alignments of patterns to stretches of text, with the operations column by column.

Marks: | equal, + wildcard equal, * substitution (. : x for 1, 2, 3 nucleotide changes), ^ extra text letter, v missing text letter.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import seq as S

INF = 1 << 29
#: Letters that changes of nucleotides are counted between.
_AMINO = "".join(sorted(set(S.CODE)))


@lru_cache(1)
def _compatible() -> dict[str, set[str]]:
    return {k: set(v) for k, v in S.compatible_letters().items()}


@lru_cache(1)
def _amino() -> dict[str, int]:
    return S.amino_distance_map()


def align(seq: str, pattern: str, first_end: int, last_end: int, k: int, wildcards: bool = False, text_n: bool = False, indels: bool = True, mutations: bool = False, left: int = 0, right: int = 0) -> tuple | None:
    """Best alignment that ends within [first_end, last_end], its start free: start, end, edits, text, ops, pattern with gaps; None beyond k.

    The first ``left`` and last ``right`` pattern letters take no error. Suffix costs are filled from the right; of the cheapest starts the
    later one is taken unless an earlier begins with a match; going right, the diagonal is preferred unless the gap before goes on.
    """
    m = len(pattern)
    low = max(0, first_end - m - k)
    text = seq[low:last_end]
    n = len(text)
    gap = 3 if mutations else 1

    def pair(i: int, j: int) -> tuple[int, str]:
        p, t = pattern[i], text[j]
        if p == t:
            return 0, "|"
        if wildcards and (t != "N" or text_n) and t in _compatible().get(p, ()):
            return 0, "+"
        if i < left or i >= m - right:
            return INF, "!"
        if mutations:
            c = _amino().get(p + t, 3)
            return c, {1: ".", 2: ":"}.get(c, "x")
        return 1, "*"

    def missing(i: int) -> int:
        return INF if not indels or i < left or i >= m - right else gap

    def extra(i: int) -> int:
        return INF if not indels or 0 < i < left or i > m - right and i < m or i == 0 else gap

    cost = [[INF] * (n + 1) for _ in range(m + 1)]
    for j in range(n, -1, -1):
        cost[m][j] = 0 if j >= first_end - low else min(cost[m][j + 1] + extra(m), INF)
    for i in range(m - 1, -1, -1):
        row, below = cost[i], cost[i + 1]
        skip, more = missing(i), extra(i)
        for j in range(n, -1, -1):
            best = below[j] + skip
            if j < n:
                best = min(best, below[j + 1] + pair(i, j)[0], row[j + 1] + more)
            row[j] = min(best, INF)
    least = min(cost[0])
    if least > k:
        return None
    starts = [j for j in range(n + 1) if cost[0][j] == least]
    start = starts[-1]
    for j in reversed(starts[:-1]):
        if j < n and cost[1][j + 1] + pair(0, j)[0] == least:
            start = j
    i, j, ops, t, p = 0, start, [], [], []
    while i < m or cost[m][j]:
        here, last = cost[i][j], ops[-1] if ops else ""
        c, mark = pair(i, j) if i < m and j < n else (INF, "!")
        diagonal = i < m and j < n and cost[i + 1][j + 1] + c == here
        down = i < m and cost[i + 1][j] + missing(i) == here
        over = j < n and cost[i][j + 1] + extra(i) == here
        if diagonal and not (last == "v" and down) and not (last == "^" and over) and not (last == "+" and (down or over)):
            ops.append(mark)
            t.append(text[j])
            p.append(pattern[i])
            i, j = i + 1, j + 1
        elif down and (last != "^" or not over):
            ops.append("v")
            t.append("-")
            p.append(pattern[i])
            i += 1
        else:
            ops.append("^")
            t.append(text[j])
            p.append("-")
            j += 1
    return low + start, low + j, least, "".join(t), "".join(ops), "".join(p)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def aligned(text: Column | str, pattern: Column | str, first_end: Column | str, last_end: Column | str, k: int, wildcards: bool = False, text_n: bool = False, indels: bool = True, mutations: bool = False, left: Column | int = 0, right: Column | int = 0) -> Column:
    """What ``align`` gives, as a struct (start, end, edits, text, ops, pattern; null beyond k) of built-in functions.

    text: the letters from greatest(first_end - length(pattern) - k, 0) to last_end of the entry, which is all that an alignment can use. Rows of
    costs are made for the pattern's letters from the last to the first; in a row the cheapest run of at most k extra letters is looked for ahead, so rows need no loop of their own.
    """
    text, pattern, first_end = S.column(text), S.column(pattern), S.column(first_end).cast("int")
    gap, far = 3 if mutations else 1, F.lit(1 << 20)
    left, right = (F.lit(x) if isinstance(x, int) else x for x in (left, right))
    m, n = F.length(pattern), F.length(text)
    low = F.greatest(first_end - m - k, F.lit(0))
    exact = lambda i: (i < left) | (i >= m - right)
    skip = lambda i: F.when(exact(i), far).otherwise(gap) if indels else far
    more = lambda i: F.when((i == 0) | ((i > 0) & (i < left)) | ((i > m - right) & (i < m)), far).otherwise(gap) if indels else far
    at = lambda a, i: F.coalesce(F.get(a, i), far)
    amino = F.lit([S.amino_distance_map().get(x + y, 3) for x in _AMINO for y in _AMINO]) if mutations else None
    change = lambda p, t: F.when((F.instr(F.lit(_AMINO), p) > 0) & (F.instr(F.lit(_AMINO), t) > 0), F.get(amino, (F.instr(F.lit(_AMINO), p) - 1) * len(_AMINO) + F.instr(F.lit(_AMINO), t) - 1)).otherwise(3)
    like = lambda p, t: S.compatible(t, p) & (F.lit(text_n) | (t != "N")) if wildcards else F.lit(False)
    instead = change if mutations else lambda p, t: F.lit(1)
    pair = lambda i, p, t: F.when(p == t, 0).when(like(p, t), 0).when(exact(i), far).otherwise(instead(p, t))
    mark = lambda p, t: F.when(p == t, "|").when(like(p, t), "+").otherwise(F.element_at(F.array(*map(F.lit, ".:x")), instead(p, t)) if mutations else F.lit("*"))

    def solved(T: Column) -> Column:
        places = F.sequence(F.lit(0), n)

        def row(below: Column, i: Column) -> Column:
            p = F.substring(pattern, i + 1, F.lit(1))
            base = F.transform(places, lambda j: F.least(at(below, j) + skip(i), at(below, j + 1) + F.coalesce(pair(i, p, F.get(T, j)), far)))
            return _let(base, lambda b: _let(more(i), lambda c: F.transform(places, lambda j: F.least(far, *(at(b, j + d) + c * d for d in range(k + 1))))))

        last = F.transform(places, lambda j: F.when(j >= first_end - low, 0).otherwise(F.least(far, (first_end - low - j) * (gap if indels else far))))
        back = F.when(m > 0, F.sequence(m - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(back, F.array(last), lambda rows, i: F.concat(rows, F.array(row(F.element_at(rows, -1), i))))

    def traced(rows: Column, T: Column) -> Column:
        cell = lambda i, j: F.coalesce(F.get(F.get(rows, m - i), j), far)
        letter = lambda i: F.substring(pattern, i + 1, F.lit(1))

        def begin(least: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), n), lambda j: cell(F.lit(0), j) == least)
            matching = F.filter(F.slice(starts, F.lit(1), F.size(starts) - 1), lambda j: (j < n) & (cell(F.lit(1), j + 1) + F.coalesce(pair(F.lit(0), letter(F.lit(0)), F.get(T, j)), far) == least))
            return F.coalesce(F.get(matching, F.lit(0)), F.element_at(starts, -1))

        def step(s: Column, _: Column) -> Column:
            i, j, p, t = s["i"], s["j"], letter(s["i"]), F.get(T, s["j"])
            here, last = cell(i, j), F.right(s["ops"], F.lit(1))
            inside = (i < m) & (j < n)
            diagonal = inside & (cell(i + 1, j + 1) + F.coalesce(pair(i, p, t), far) == here)
            down = (i < m) & (cell(i + 1, j) + skip(i) == here)
            over = (j < n) & (cell(i, j + 1) + more(i) == here)
            kept = ((last == "v") & down) | ((last == "^") & over) | ((last == "+") & (down | over))
            move = F.when((i >= m) & (cell(m, j) == 0), "done").when(diagonal & ~kept, "both").when(down & ((last != "^") | ~over), "down").otherwise("over")

            def made(x: Column) -> Column:
                both, d, o = x == "both", x == "down", x == "over"
                return F.struct(
                    (i + (both | d).cast("int")).alias("i"), (j + (both | o).cast("int")).alias("j"),
                    F.concat(s["ops"], F.when(both, mark(p, t)).when(d, "v").when(o, "^").otherwise("")).alias("ops"),
                    F.concat(s["text"], F.when(both | o, t).when(d, "-").otherwise("")).alias("text"),
                    F.concat(s["pattern"], F.when(both | d, p).when(o, "-").otherwise("")).alias("pattern"),
                )

            return _let(move, made)

        def walked(start: Column, least: Column) -> Column:
            none = F.lit("")
            first = F.struct(F.lit(0).alias("i"), start.alias("j"), none.alias("ops"), none.alias("text"), none.alias("pattern"))
            done = lambda s: F.struct((low + start).cast("bigint").alias("start"), (low + s["j"]).cast("bigint").alias("end"), least.alias("edits"), s["text"].alias("text"), s["ops"].alias("ops"), s["pattern"].alias("pattern"))
            return F.aggregate(F.sequence(F.lit(1), m + n + 1), first, step, done)

        return _let(F.array_min(F.element_at(rows, -1)), lambda least: F.when(least <= k, _let(begin(least), lambda start: walked(start, least))))

    return _let(F.split(text, ""), lambda T: _let(solved(T), lambda rows: traced(rows, T)))


def anchored(seq: str, left: str, right: str, k: int, left_end: int | None = None, right_end: int | None = None, **parameters) -> tuple | None:
    """A pattern in two pieces, one of them in its place without errors, the other aligned from there with up to k: left piece by its end, or right piece by its end. As ``align``; the constraints count on the whole pattern."""
    own = {"left": parameters.pop("left", 0), "right": parameters.pop("right", 0)}
    marks = lambda t, p: "".join("|" if a == b else "+" for a, b in zip(t, p, strict=True))
    if right_end is not None:
        edge = right_end - len(right)
        if edge < 0:
            return None
        inner = align(seq, left, edge, edge, k, left=own["left"], right=max(own["right"] - len(right), 0), **parameters)
        if inner is None:
            return None
        start, _, edits, text, ops, pattern = inner
        fixed = seq[edge:right_end]
        return start, right_end, edits, text + fixed, ops + marks(fixed, right), pattern + right
    window = seq[left_end : left_end + len(right) + k][::-1]  # read backward, the fixed place is the end
    inner = align(window, right[::-1], len(window), len(window), k, left=own["right"], right=max(own["left"] - len(left), 0), **parameters)
    if inner is None:
        return None
    start, end, edits, text, ops, pattern = inner
    fixed = seq[left_end - len(left) : left_end]
    return left_end - len(left), left_end + end - start, edits, fixed + text[::-1], marks(fixed, left) + ops[::-1], left + pattern[::-1]


def _piece_marks(text: Column, pattern: Column, wildcards: bool, text_n: bool) -> Column:
    """A mark a letter, for texts of one length."""
    other = lambda t, p: F.when(S.compatible(t, p) & (F.lit(text_n) | (t != "N")), "+").otherwise("*") if wildcards else F.lit("*")
    return F.array_join(F.zip_with(F.split(text, ""), F.split(pattern, ""), lambda t, p: F.when(t == p, "|").otherwise(other(t, p))), "")


def two_piece(seq: Column | str, left: Column | str, right: Column | str, left_end: Column | str, right_end: Column | str, wildcards: bool = False, text_n: bool = False, left_exact: int = 0, right_exact: int = 0) -> Column:
    """The alignment of two pieces whose ends are known, as a struct (start, end, edits, text, ops, pattern), by built-in functions.

    Between the pieces one text letter may be too many or be missing; letters within a piece are equal, compatible or substituted. The missing
    letter is the right piece's first, unless the text letter at the border rather fits there than at the left piece's last. Null where the
    pieces lie otherwise, leave the text, or where the gap falls into the letters that must be exact.
    """
    seq, left, right, a, b = map(S.column, (seq, left, right, left_end, right_end))
    n, m = F.length(left), F.length(right)
    gap = b - m - a
    start = a - n
    cut = lambda x, at, size: F.substring(x, (at + 1).cast("int"), size.cast("int"))
    text = cut(seq, start, b - start)
    marks = lambda t, p: F.when(F.length(p) > 0, _piece_marks(t, p, wildcards, text_n)).otherwise("")
    zero, one = F.lit(0), F.lit(1)
    border, last, first = cut(text, n - 1, one), cut(left, n - 1, one), cut(right, zero, one)
    fits = lambda p: (S.compatible(border, p) & (F.lit(text_n) | (border != "N"))) if wildcards else F.lit(False)
    of_right = F.when(border == last, True).when(border == first, False).otherwise(fits(last) | ~fits(first))
    head, tail = cut(text, zero, n), cut(text, n + F.greatest(gap, zero), m)
    flush = F.concat(marks(head, left), F.when(gap == 1, "^").otherwise(""), marks(tail, right))
    drops_right = F.concat(marks(head, left), F.lit("v"), marks(cut(text, n, m - 1), cut(right, one, m - 1)))
    drops_left = F.concat(marks(cut(text, zero, n - 1), cut(left, zero, n - 1)), F.lit("v"), marks(cut(text, n - 1, m), right))
    ops = F.when(gap >= 0, flush).when(of_right, drops_right).otherwise(drops_left)
    hole = F.when(of_right, n).otherwise(n - 1)
    shown = F.when(gap >= 0, text).otherwise(F.concat(cut(text, zero, hole), F.lit("-"), cut(text, hole, F.length(text))))
    wanted = F.when(gap == 1, F.concat(left, F.lit("-"), right)).otherwise(F.concat(left, right))
    edits = F.length(F.regexp_replace(ops, "[|+]", ""))
    allowed = (F.abs(gap) <= 1) & (start >= 0) & (b <= F.length(seq)) & ((gap == 0) | ((F.lit(left_exact) < n) & (F.lit(right_exact) < m)))
    return F.when(allowed, F.struct(start.cast("bigint").alias("start"), b.cast("bigint").alias("end"), edits.alias("edits"), shown.alias("text"), ops.alias("ops"), wanted.alias("pattern")))


def wrapped(text: str, ops: str, pattern: str, width: int = 50) -> str:
    """The three rows of an alignment in blocks of ``width`` columns."""
    return "\n\n".join("\n".join(row[i : i + width] for row in (text, ops, pattern)) for i in range(0, max(len(ops), 1), width))
