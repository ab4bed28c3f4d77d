"""Secrets in texts: fixed patterns, and tokens that pass a battery of randomness tests. Built-in functions only.

A candidate token is a run of 16 or more encoding characters that is not a plain number. Its encoding is inferred (hex,
base 32, upper or lower base 36, base 64), and three tests ask whether it may be uniform over that alphabet: chi-squared
of the symbol counts, runs of character classes, and lag-one serial correlation. Tokens that no test rejects are measured
against ordinary writing, whose symbols repeat more and whose classes change seldom, with tail bounds that depend on the
token's length; the two bounds are combined by Fisher's rule. Within each band of lengths the Benjamini-Hochberg rule then
holds the share of false finds below ``level``. All candidates of the table are counted, in bins of log p: the driver
gets one row per band and bin.

Positions are code points from 0, ends exclusive. Defined results: null and empty texts have no spans; repeated rows are
scanned each; a random token that the patterns' spans cover is not reported twice, one that reaches beyond them is reported
whole; added columns replace columns of their names, others pass through.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, whole

# The patterns, their least lengths and their order.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a run is taken whole, so asking for 18 characters drops exactly the shorter matches
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGNED = 12
#: Every assignment holds one of these signs, and one of these words in lower case.
ASSIGN_SIGNS = (":", "=")
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")

#: A look ahead for a blank ends the search at most places before the wider class is tried sixteen times.
TOKEN = r"(?=[A-Za-z0-9+/_=-][^ \n]{15})[A-Za-z0-9+/_=-]{16,}"
#: Encodings: pattern, alphabet, and the chance that two symbols of ordinary writing in it are equal.
ENCODINGS = {
    "hex": (r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.12),
    "base32": (r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.065),
    "upper": (r"^[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.065),
    "lower": (r"^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 0.065),
    "base64": (r"^.*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.06),
}
#: Chance that the class of a character differs from that of the one before, in ordinary writing.
CHANGE = 0.08
REJECT = 1e-4
LEVEL = 1e-3
BANDS = (16, 20, 28, 40, 64, 128)
BIN, BINS = 0.25, 200

_SPANS = "array<struct<start:int,end:int>>"


def matches(text: Column, pattern: str, keep: Column | None = None) -> Column:
    """Spans of the leftmost non-overlapping matches. What lies between them comes from splitting by the same pattern.

    ``keep``: an array beside the matches; spans are kept where it is true.
    """
    first = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        span = F.struct(start.alias("start"), (start + p["long"]).alias("end"))
        return F.struct((start + p["long"]).alias("at"),
                        F.when(p["keep"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def spans(hits: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), F.transform(hits, lambda h: F.length(h)).alias("long"),
                             (F.transform(hits, lambda h: F.lit(True)) if keep is None else keep).alias("keep"))
        return F.when(F.size(hits) > 0, F.aggregate(pairs, first, step, lambda acc: acc["spans"])).otherwise(_none())

    # an array step names the hits, so that the text is searched for them once
    return F.element_at(F.transform(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), spans), 1)


def _none() -> Column:
    return F.array().cast(_SPANS)


def base_spans(text: Column, tokens: Column) -> dict[str, Column]:
    """Spans by pattern. ``tokens``, the matches of ``TOKEN``, hold all matches of ``ACCESS`` and ``HEX``: without any, there are none."""
    small = F.lower(text)
    worded = reduce(or_, [text.contains(x) for x in ASSIGN_SIGNS]) & reduce(or_, [small.contains(w) for w in ASSIGN_WORDS])
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1)), lambda v: F.length(v) >= LEAST_ASSIGNED)
    return {"assign": F.when(worded, matches(text, ASSIGN, long_enough)).otherwise(_none()),
            **{name: F.when(F.size(tokens) > 0, matches(text, pattern)).otherwise(_none())
               for name, pattern in (("access", ACCESS), ("hex", HEX))}}


def _tail(z: Column) -> Column:
    """Bound of a normal tail beyond z."""
    return F.when(z > 0, F.exp(-z * z / 2)).otherwise(1.0)


def _by_encoding(token: Column, value) -> Column:
    out = None
    for name, (pattern, alphabet, equal) in ENCODINGS.items():
        hit = token.rlike(pattern)
        out = F.when(hit, value(name, alphabet, equal)) if out is None else out.when(hit, value(name, alphabet, equal))
    return out


def p_ordinary(token: Column) -> Column:
    """Bound of the chance that ordinary writing looks as random as this token; 1 where a test rejects randomness."""

    def tests(name: str, alphabet: str, equal: float) -> Column:
        symbols = F.rtrim(F.translate(token, "-_=", "+/ "))
        symbols = F.lower(symbols) if name == "hex" else symbols
        symbols = F.translate(symbols, " ", "")
        k = len(alphabet)
        base = F.struct(symbols.alias("s"), F.length(symbols).cast("double").alias("n"))

        def counted(t: Column) -> Column:
            s, n = t["s"], t["n"]
            squares = F.aggregate(F.split(F.lit(alphabet), ""), F.lit(0.0), lambda acc, c: acc + F.pow(
                n - F.length(F.replace(s, c, F.lit(""))), F.lit(2.0)))
            values = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(alphabet), c).cast("double"))
            classes = F.regexp_replace(F.regexp_replace(s, "[A-Z](?=[a-z])", "a"), "[+/]", "")
            classes = F.translate(F.translate(F.translate(classes, "0123456789", "0" * 10),
                                              "abcdefghijklmnopqrstuvwxyz", "a" * 26),
                                  "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A" * 26)
            return F.struct(n.alias("n"), squares.alias("squares"), values.alias("values"), classes.alias("classes"))

        def centred(t: Column) -> Column:
            n, values = t["n"], t["values"]
            mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n
            runs = F.length(F.regexp_replace(t["classes"], r"(.)\1*", "$1")).cast("double")
            return F.struct(n.alias("n"), t["squares"].alias("squares"), values.alias("values"), mean.alias("mean"), runs.alias("runs"),
                            F.greatest(F.length(t["classes"]).cast("double") - 1, F.lit(1.0)).alias("steps"))

        classed = sum(c.isalnum() for c in alphabet)
        d, u, l = (sum(f(c) for c in alphabet) / classed for f in (str.isdigit, str.isupper, str.islower))
        # chance that the class changes from one character to the next, where a capital before a small letter counts as small
        switch = d * (1 - d) + l * (d + u * (1 - l)) + u * (d + u * l)

        def measured(x: Column) -> Column:
            n, values, mean, steps = x["n"], x["values"], x["mean"], x["steps"]
            pairs = (x["squares"] - n) / 2
            chi = (F.lit(float(k)) / n * x["squares"] - n - (k - 1)) / F.sqrt(2.0 * (k - 1) * (1 - 1 / n))
            runs = (x["runs"] - 1 - steps * switch) / F.sqrt(steps * switch * (1 - switch))
            moved = F.zip_with(F.slice(values, F.lit(1), F.size(values) - 1), F.slice(values, F.lit(2), F.size(values) - 1),
                               lambda a, b: (a - mean) * (b - mean))
            spread = F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
            serial = (F.aggregate(moved, F.lit(0.0), lambda a, v: a + v) / F.greatest(spread, F.lit(1e-9)) + 1 / n) * F.sqrt(n)
            # ordinary writing: more equal pairs, fewer changes of class
            usual = n * (n - 1) / 2 * equal
            share = (x["runs"] - 1) / steps
            return F.struct(
                steps.alias("steps"), F.abs(chi).alias("chi"), F.abs(runs).alias("runs"), F.abs(serial).alias("serial"),
                ((usual - pairs) / F.sqrt(usual + n * n * n * 0.0016)).alias("pairs"),
                F.least(F.greatest(share, F.lit(CHANGE)), F.lit(1 - 1e-9)).alias("inside"))

        def bounded(x: Column) -> Column:
            least = 3 * F.least(_tail(x["chi"]), _tail(x["runs"]), _tail(x["serial"]))
            inside = x["inside"]
            p_runs = F.exp(-x["steps"] * (inside * F.ln(inside / CHANGE) + (1 - inside) * F.ln((1 - inside) / (1 - CHANGE))))
            return F.struct(least.alias("least"), F.greatest(_tail(x["pairs"]) * p_runs, F.lit(1e-300)).alias("both"))

        def judged(x: Column) -> Column:
            both = x["both"]
            return F.when(x["least"] >= REJECT, both * (1 - F.ln(both))).otherwise(1.0)

        # each array step names the values that the next one uses more than once, so that they are computed once
        steps = F.array(base)
        for step in (counted, centred, measured, bounded, judged):
            steps = F.transform(steps, step)
        return F.when(F.length(symbols) >= 8, F.element_at(steps, 1)).otherwise(1.0)

    return _by_encoding(token, tests)


def _cut(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def candidates(text: Column, spans: Column) -> Column:
    """Tokens to test, of those at ``spans``, as (start, end, p)."""
    tokens = F.transform(spans, lambda s: F.struct(s["start"], s["end"], _cut(text, s).alias("token")))
    tokens = F.filter(tokens, lambda s: ~s["token"].rlike(r"^[0-9/+_=-]*$"))
    return F.transform(tokens, lambda s: F.struct(s["start"], s["end"], p_ordinary(s["token"]).alias("p")))


def _band(n: Column) -> Column:
    return sum(((n >= b).cast("int") for b in BANDS[1:]), F.lit(0))


def searched(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of the patterns, and as ``_tested`` the candidate tokens with their p."""
    text, tokens = F.col("_whole"), F.col("_tokens")
    found = docs.withColumn("_whole", whole()).withColumn("_tokens", matches(text, TOKEN))
    return found.withColumns({**base_spans(text, tokens), "_tested": candidates(text, tokens)}).drop("_whole", "_tokens")


def _long(c: Column) -> Column:
    return c["end"] - c["start"]


def cutoffs(found: DataFrame, level: float = LEVEL) -> list[float]:
    """Per band of lengths the largest p that the Benjamini-Hochberg rule accepts, to a bin; -1 where none is. ``found``: as ``searched``."""
    # for a plain explode Spark filters empty arrays first, and searches twice for it where nothing is stored
    tokens = found.select(F.explode_outer("_tested").alias("c")).where("c IS NOT NULL")
    rank = F.least(F.floor(-F.log10("c.p") / BIN), F.lit(BINS - 1)).cast("int")
    rows = tokens.groupBy(_band(_long(F.col("c"))).alias("band"), rank.alias("bin")).count().collect()
    out = []
    for band in range(len(BANDS)):
        counts = {r.bin: r["count"] for r in rows if r.band == band}
        total, seen, best = sum(counts.values()), 0, -1.0
        for b in sorted(counts, reverse=True):
            seen += counts[b]
            if 10 ** (-b * BIN) <= level * seen / total:
                best = 10 ** (-b * BIN)
        out.append(best)
    return out


def scan(docs: DataFrame, limits: list[float] | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with the arrays of spans ``assign``, ``access``, ``hex`` and ``random``. Nothing is shuffled.

    ``keep``: the columns of ``docs`` that are wanted beside them, all by default. Where they are named, and ``limits`` are not, texts are
    searched once: what is found is stored for the second look. Otherwise the search runs twice, and nothing is written.
    """
    found = searched(docs)
    if keep is not None:
        found = found.select(*keep, *KINDS[:3], "_tested")
    if limits is None:
        found = found if keep is None else stored(found)
        limits = cutoffs(found)
    allowed = F.array(*[F.lit(x) for x in limits])
    based = F.array_sort(F.concat("assign", "access", "hex"))
    tested = F.filter("_tested", lambda c: c["p"] <= F.element_at(allowed, _band(_long(c)) + 1))
    # how far the spans, by start, cover the token without a gap
    free = F.filter(tested, lambda c: F.aggregate(F.col("_based"), c["start"], lambda at, b: F.when(
        b["start"] <= at, F.greatest(at, b["end"])).otherwise(at)) < c["end"])
    random = F.transform(free, lambda c: F.struct(c["start"], c["end"]))
    return found.withColumn("_based", based).withColumn("random", random).drop("_based", "_tested")


def listed(kinds: tuple[str, ...]) -> Column:
    """The spans of some kinds as kind:start:end, by start, then by the order of kinds, joined by commas."""
    def numbered(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"], F.lit(KINDS.index(kind)).alias("kind"), s["end"]))

    rows = F.concat(*[numbered(k) for k in kinds])
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(rows), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", limits: list[float] | None = None) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mark``; overlapping spans become one mark."""
    columns = docs.columns
    found = scan(docs.select("*", F.struct(*[F.col(c) for c in columns]).alias("_row")), limits)
    spans = F.array_sort(F.concat(*[F.col(k) for k in KINDS]))
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        text = F.col("_row.text")
        new = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(new, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
            .otherwise(acc["out"]).alias("out"))

    whole_text = F.col("_row.text")
    cleaned = F.aggregate(spans, first, step, lambda acc: F.concat(
        acc["out"], F.substring(whole_text, acc["at"] + 1, F.length(whole_text))))
    text = F.when(F.size(spans) > 0, cleaned).otherwise(whole_text)
    return found.select(*[text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in columns])
