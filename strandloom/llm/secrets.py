"""Secret scan with DataFrame functions only.

Base kinds are regular expressions (below); the method adds ``random`` spans. A
candidate is a maximal run of ``[A-Za-z0-9+/_-]`` of ``MIN_LENGTH`` characters or more with a
letter and a digit. Two first-order character Markov models, of random strings and of
ordinary identifiers, are counted from labelled samples; a candidate whose
log-likelihood ratio by transition reaches ``THRESHOLD`` is a span, unless a base
span overlaps it. All of it is one projection: no join, no shuffle.

Positions are code points, end exclusive, found by summing the lengths of matches and of
the texts between. The work on a run of characters is linear in its length. Null text: empty, no spans. An empty table gives an empty result; repeated rows repeat.
Other columns, whatever their names, are ignored by ``scan`` and come back unchanged from ``redact``.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_LENGTH, THRESHOLD = 20, 0.35
# The base kinds, in their order. Group 2 of the first is the value.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
#: These only skip texts without a match sooner; what they let through is matched by the kinds above.
_MAY = {"assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{12}", "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}"}
_RUN = "A-Za-z0-9+/_-"
CANDIDATE = rf"(?<![{_RUN}])(?=[{_RUN}]*[0-9])(?=[{_RUN}]*[A-Za-z])[{_RUN}]{{{MIN_LENGTH},}}"
_MAY["random"] = CANDIDATE
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
# Words of which ordinary identifiers are made.
_WORDS = "user name value index count list table column batch config default error event file format group handler header image input item key label length level limit line local main message model node object offset option order output page parent path pattern point process query range record request response result return row sample schema server session size source start state status string system target test text time token type update version view width write read open close build data date number client service version test release linux windows python java update section chapter figure"


def labelled_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """token, label (1 random, 0 ordinary): hashes in several alphabets against words joined as identifiers are."""
    words = F.split(F.lit(_WORDS), " ")
    pick = lambda seed: F.element_at(words, (F.pmod(F.xxhash64(F.lit(seed), "id"), F.size(words)) + 1).cast("int"))
    digest = F.sha2(F.concat(F.lit("random-"), F.col("id").cast("string")), 256)
    base64 = F.translate(F.base64(F.unhex(digest)), "=", "")
    random = F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 40)).when(F.col("id") % 4 == 1, base64).when(F.col("id") % 4 == 2, F.translate(base64, "+/", "")).otherwise(F.upper(F.translate(base64, "+/", "")))
    number = F.pmod(F.xxhash64(F.lit("number"), "id"), F.lit(2100)).cast("string")
    joined = [F.concat_ws("_", pick(1), pick(2), pick(3), number), F.concat(pick(1), F.initcap(pick(2)), F.initcap(pick(3)), number), F.upper(F.concat_ws("_", pick(1), pick(2), number)), F.concat_ws("-", pick(1), pick(2), number, pick(3)), F.concat_ws("/", pick(1), pick(2), pick(3), number)]
    ordinary = joined[0]
    for i, x in enumerate(joined[1:], 1):
        ordinary = F.when(F.col("id") % len(joined) == i, x).otherwise(ordinary)
    ids = spark.range(n)
    return ids.select(random.alias("token"), F.lit(1).alias("label")).unionByName(ids.select(ordinary.alias("token"), F.lit(0).alias("label")))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of transitions, by code of the first times size plus code of the second; add-one smoothing. Size: one more than the alphabet."""
    size = len(ALPHABET) + 1
    pairs = samples.where(F.length("token") > 1).select("label", "token", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("i"))
    counted = pairs.select("label", F.expr("substring(token, i, 1)").alias("a"), F.expr("substring(token, i + 1, 1)").alias("b")).groupBy("label", "a", "b").count().collect()
    n: dict = defaultdict(float)
    for r in counted:  # (size of the alphabet squared, twice, at most)
        a, b = ALPHABET.find(r.a) + 1, ALPHABET.find(r.b) + 1
        n[r.label, a, b] += r["count"]
        n[r.label, a] += r["count"]
    logs = lambda label, a, b: math.log((n[label, a, b] + 1) / (n[label, a] + size))
    return [round(logs(1, a, b) - logs(0, a, b), 4) for a in range(size) for b in range(size)]


def llr(token: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's transitions: one pass over its characters, each looked up in a table that is folded to a constant."""
    size = len(ALPHABET) + 1
    ratios = F.split(F.lit(" ".join(map(str, table))), " ").cast("array<double>")
    start = F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("total"))

    def add(acc, ch):
        code = F.instr(F.lit(ALPHABET), ch)
        ratio = F.when(acc["before"] >= 0, F.element_at(ratios, acc["before"] * size + code + 1)).otherwise(0.0)
        return F.struct(code.alias("before"), (acc["total"] + ratio).alias("total"))

    return F.aggregate(F.split(token, ""), start, add, lambda acc: acc["total"]) / (F.length(token) - 1)


_SPAN = "array<struct<s:int,k:int,e:int,m:string,v:string>>"


def _spans(text: Column, kind: int, pattern: str, group: int | None = None) -> Column:
    """Start, kind, end, match and the group's text of every match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.split(text, pattern, -1)
    rows = F.arrays_zip(found.alias("m"), value.alias("v"), F.slice(between, 1, F.size(found)).alias("g"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def add(acc, x):
        s = acc["at"] + F.length(x["g"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e"), x["m"].alias("m"), x["v"].alias("v")))).cast(_SPAN).alias("out"))

    return F.when(text.rlike(_MAY[KINDS[kind]]), F.aggregate(rows, start, add, lambda acc: acc["out"])).otherwise(F.array().cast(_SPAN))


def scan(docs: DataFrame, table: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, ``base`` and ``added``: arrays of (s, k, e, m, v) by start, then kind."""
    return _with_spans(docs.select("doc_id", "text"), table, threshold, "base", "added").select("doc_id", "base", "added")


def _with_spans(docs: DataFrame, table: list[float], threshold: float, b: str, a: str) -> DataFrame:
    """All columns, and the spans as columns b (base kinds) and a (added)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(
        F.filter(_spans(text, 0, ASSIGN, 2), lambda x: F.length(x["v"]) >= 12),
        F.filter(_spans(text, 1, ACCESS), lambda x: F.length(x["m"]) >= 18),
        F.filter(_spans(text, 2, HEX.replace("+", "{16,}")), lambda x: F.length(x["m"]) >= 16),
    )
    added = _spans(text, 3, CANDIDATE)
    out = docs.withColumn(b, F.array_sort(base)).withColumn(a, added)
    fresh = F.filter(a, lambda x: ~F.exists(b, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))
    return out.withColumn(a, F.filter(fresh, lambda x: llr(x["m"], table) >= threshold))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, hash of the base spans, all spans."""
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("bigint").alias("n_random"),
    )


def redact(docs: DataFrame, table: list[float], threshold: float = THRESHOLD, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by the mark; n_chars, if there, follows. Null texts stay null."""
    b, a = (next(x for x in (name + "_" * i for i in range(1, 999)) if x.lower() not in {c.lower() for c in docs.columns}) for name in ("base", "added"))
    spans, some = F.array_sort(F.concat(b, a)), F.size(b) + F.size(a) > 0
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc, x):
        text = F.col("text")
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0))), F.when(x["s"] >= acc["at"], F.lit(mark)).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), more.alias("out"))

    whole = F.aggregate(spans, start, add, lambda acc: F.concat(acc["out"], F.expr("substring(text, 1)").substr(acc["at"] + 1, F.length("text"))))
    out = _with_spans(docs, table, threshold, b, a).withColumn("text", F.when(some, whole).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
