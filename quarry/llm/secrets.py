"""Secret scans, in DataFrame functions only.

Three kinds come from fixed patterns (``assign``, ``access``, ``hex``). The fourth,
``entropy``, is found by the method of this operator: candidate strings are long
runs of base64 or hex characters; over each of them a window slides, and its
Shannon entropy is kept up by incremental counts (a step adds one character and
drops one). The entropy is taken per character class: the thresholds of hex and
of base64 alphabets differ. A candidate is reported, whole, when its best window
reaches its class's threshold, unless the allow-list suppresses it: strings without
digits (words of prose, paths), words with a short number, repeated short periods,
filler such as "example", and candidates that overlap a span of a base kind.

Positions are code points. Matches are placed without Python: the text between
matches (``split``) and the matches (``regexp_extract_all``) alternate, so running
sums of their lengths are the offsets.

Defined cases: a null or empty text has no spans; equal rows give equal rows; very
long candidates are scanned whole; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import prepare

# The base patterns and the least lengths of what they match.
ASSIGN = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
          r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Least entropy, in bits a character, of a candidate's best window, by its class.
LEAST_ENTROPY = {"hex": 2.95, "base64": 3.65}
#: Candidates that look random but are not: no digit, words with a short number, short periods, filler.
ALLOWED = (r"^[A-Za-z+/_=-]+$", r"^[A-Za-z/_=-]+[0-9]{1,4}[/_=-]*$", r"^(.{1,8}?)\1+.{0,7}$",
           r"([Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Ss][Aa][Mm][Pp][Ll][Ee]|[Dd][Uu][Mm][Mm][Yy])")
PLACED = "array<struct<start:int,m:string>>"


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _placed(text: Column, pattern: str, found: Column) -> Column:
    """array of (start, m) of the matches ``found``."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("m"))
    place = F.aggregate(
        pairs, F.struct(F.lit(0).alias("at"), F.array().cast(PLACED).alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + p["gap"] + F.length(p["m"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + p["gap"]).alias("start"), p["m"].alias("m")))).alias("out")),
        lambda acc: acc["out"])
    return F.when(F.size(found) > 0, place).otherwise(F.array().cast(PLACED))


def window_entropy(m: Column, width: int = WINDOW) -> Column:
    """Highest Shannon entropy of a window of ``width`` characters of the alphabet.

    The state holds the count of each character and the sum of n * log2(n); a step
    counts the entering character up and the leaving one down."""
    code = F.transform(F.split(m, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    steps = F.slice(F.arrays_zip(code.alias("into"), F.concat(F.array_repeat(F.lit(0), width), code).alias("out")), F.lit(1), F.length(m))
    terms = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(width + 2)])

    def term(n):
        return F.element_at(terms, n + 1)

    def step(acc, z):
        into, out = z["into"], z["out"]
        counts = F.transform(acc["n"], lambda v, k: v + (k + 1 == into).cast("int") - (k + 1 == out).cast("int"))
        up, down = F.element_at(acc["n"], into), F.element_at(acc["n"], F.greatest(out, F.lit(1)))
        total = acc["s"] + F.when(into == out, 0.0).otherwise(
            term(up + 1) - term(up) + F.when(out > 0, term(down - 1) - term(down)).otherwise(0.0))
        now = F.lit(math.log2(width)) - total / F.lit(float(width))
        return F.struct(counts.alias("n"), total.alias("s"), (acc["i"] + 1).alias("i"),
                        F.when(acc["i"] + 1 >= width, F.greatest(acc["best"], now)).otherwise(acc["best"]).alias("best"))

    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("i"),
                     F.lit(0.0).alias("best"))
    return F.aggregate(steps, start, step, lambda acc: acc["best"])


def _is_secret(m: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | m.rlike(pattern)
    least = F.when(m.rlike("^[0-9a-fA-F]+$"), LEAST_ENTROPY["hex"]).otherwise(LEAST_ENTROPY["base64"])
    return ~allowed & (window_entropy(m) >= least)


def _spans(column: str, kind: int) -> Column:
    return F.transform(column, lambda p: F.struct(
        p["start"].alias("start"), F.lit(kind).alias("kind"), (p["start"] + F.length(p["m"])).alias("end")))


def find_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with ``secret_spans``: array of (start, kind, end), kind an index
    into KINDS, by start and kind. Existing columns of working names are kept."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "entropy": CANDIDATE}
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "secret_spans"])
    out = docs.select(row.alias("row"), text.alias("text"))
    out = out.select("*", *[_found(F.col("text"), p).alias(f"f_{k}") for k, p in patterns.items()])
    out = out.select("row", *[_placed(F.col("text"), p, F.col(f"f_{k}")).alias(k) for k, p in patterns.items()])
    out = out.withColumn("assign", F.filter("assign", lambda p: F.length(
        F.regexp_extract(p["m"], ASSIGN, 2)) >= LEAST_VALUE))
    base = F.concat(*[_spans(k, i) for i, k in enumerate(KINDS[:3])])
    out = out.withColumn("base", base)
    more = F.filter("entropy", lambda p: ~F.exists("base", lambda b: (b["start"] < p["start"] + F.length(p["m"]))
                                                   & (p["start"] < b["end"])) & _is_secret(p["m"]))
    out = out.withColumn("entropy", more)
    return out.select("row.*", F.array_sort(F.concat("base", _spans("entropy", 3))).alias("secret_spans"))


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(found: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """Texts with their secret spans (overlapping ones once) replaced by ``mark``."""
    text = F.col(text_col)
    pieces = F.aggregate(
        "secret_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
            s["end"].alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(
                F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).alias("out"))),
        lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size("secret_spans") > 0, pieces).otherwise(text)).drop("secret_spans")
