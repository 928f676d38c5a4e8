"""Secrets in texts: fixed patterns, and strings of high sliding-window entropy.

Native: everything is a Column expression on the text of one row, so there is no shuffle and no Python code on the
executors. A pattern is only cut out of texts that ``rlike`` finds it in.

The entropy method takes candidate strings (runs of key characters with letters and digits), gives each a character
class (hexadecimal or base-64), and moves a window of the class's length over it. The counts of the window's characters
change by one character in and one out a step, and with them the sum of c * log2(c), so no window is counted anew.
A candidate whose best window reaches the class's entropy is a secret, unless an allow-list pattern matches it or a
fixed pattern already covers it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let

# The patterns that the contract names, with the least length of the part that counts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"  # a run of hexadecimal digits is a match of its own, so shorter ones need not be cut out
LEAST = {"assign": 8, "access": 16, "hex": 32}

_KEY = "[A-Za-z0-9+/_=-]"
#: Runs of at least 20 key characters with a digit and a letter.
CANDIDATE = rf"(?<!{_KEY})(?={_KEY}{{20}})(?={_KEY}*[0-9])(?={_KEY}*[A-Za-z]){_KEY}++"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Window length and least entropy in bits a character, by character class.
CLASSES = {"entropy_hex": (20, 3.0), "entropy_base64": (20, 3.75)}
#: A candidate that one of these matches is no secret.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
    r"^sha(1|256|384|512)-",  # integrity digests
    r"(?i)example|sample|dummy|placeholder|changeme",
    r"^[A-Za-z]+([-_/=+][A-Za-z]+)*[-_/=+]?[0-9]{1,4}$",  # words with a trailing number
    r"^[0-9]+([-/=+_][0-9A-Za-z]{1,4})+$",  # dates and numbered parts
    r"^(/[A-Za-z0-9_-]+)+/?$",  # paths
)

_SPAN = "array<struct<s:int,o:int,kind:string,e:int,m:string>>"
#: Entries of an array that one fold takes: arrays are built by chunks, so that work grows with their length alone.
CHUNK = 256


def _chunks(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda c: F.slice(items, c * CHUNK + 1, CHUNK))).otherwise(F.array(items))


def _found(text: Column, pattern: str, kind: str, order: int, least: int, group: int = 0) -> Column:
    """Spans of all matches, in order; a match whose group is shorter than ``least`` is dropped."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("gap"), F.length(m).alias("n")))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["n"]
        span = F.struct(begin.alias("s"), F.lit(order).alias("o"), F.lit(kind).alias("kind"), end.alias("e"), x["m"].alias("m"))
        size = F.length(F.regexp_extract(x["m"], pattern, group)) if group else x["n"]
        return F.struct(end.alias("at"), F.when(size >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def placed(chunks: Column) -> Column:
        length = lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + x["gap"] + x["n"])
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(chunks, start, lambda acc, c: F.struct((acc["at"] + length(c)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        return F.flatten(F.zip_with(chunks, starts, lambda c, a: F.aggregate(c, F.struct(a.alias("at"), F.array().cast(_SPAN).alias("spans")), step)["spans"]))

    return F.when(text.rlike(pattern), let(let(pairs, _chunks), placed)).otherwise(F.array().cast(_SPAN))


def window_entropy(text: Column, width: int) -> Column:
    """The largest Shannon entropy of ``width`` consecutive characters of a string of key characters.

    The counts are a string with one place for each character of the alphabet; a step overlays two places of it.
    """
    zero = 32  # the code that stands for a count of none
    weigh = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 2)])
    codes = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(_ALPHABET), c))
    count = lambda n, code: F.ascii(F.substr(n, code, F.lit(1))) - zero
    put = lambda n, code, c: F.overlay(n, F.char(c + zero), code, F.lit(1))
    start = F.struct(F.repeat(F.lit(chr(zero)), F.lit(len(_ALPHABET))).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.lit(0).alias("i"))

    def moved(acc: Column, code: Column, by: int) -> Column:
        """Counts and sum after one character came in (1) or went out (-1)."""
        step = lambda c: F.struct(put(acc["n"], code, c + by).alias("n"), (acc["sum"] + F.get(weigh, c + by) - F.get(weigh, c)).alias("sum"))
        return let(count(acc["n"], code), step)

    def step(acc: Column, x: Column) -> Column:
        left = F.when(x["old"] > 0, moved(acc, x["old"], -1)).otherwise(F.struct(acc["n"].alias("n"), acc["sum"].alias("sum")))

        def taken(new: Column) -> Column:
            bits = F.when(acc["i"] >= width - 1, F.lit(math.log2(width)) - new["sum"] / width).otherwise(0.0)
            return F.struct(new["n"].alias("n"), new["sum"].alias("sum"), F.greatest(acc["best"], bits).alias("best"), (acc["i"] + 1).alias("i"))

        return let(let(left, lambda out: moved(out, x["new"], 1)), taken)

    def slid(c: Column) -> Column:
        behind = F.slice(F.concat(F.array_repeat(F.lit(0), width), c), F.lit(1), F.size(c))
        return F.aggregate(F.zip_with(c, behind, lambda new, old: F.struct(new.alias("new"), old.alias("old"))), start, step)["best"]

    return let(codes, slid)


def _entropy(text: Column, allowed: tuple[str, ...]) -> Column:
    candidates = _found(text, CANDIDATE, "entropy", 3, 20)
    passed = F.filter(candidates, lambda x: ~F.lit(False) if not allowed else ~_any(x["m"], allowed))
    classed = F.transform(passed, lambda x: x.withField("kind", F.when(x["m"].rlike("^([0-9a-f]+|[0-9A-F]+)$"), "entropy_hex").otherwise("entropy_base64")))
    high = lambda x: F.when(x["kind"] == "entropy_hex", window_entropy(x["m"], CLASSES["entropy_hex"][0]) >= CLASSES["entropy_hex"][1]).otherwise(window_entropy(x["m"], CLASSES["entropy_base64"][0]) >= CLASSES["entropy_base64"][1])
    return F.filter(classed, high)


def _any(c: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def _apart(spans: Column, base: Column) -> Column:
    """The spans that overlap none of ``base`` (sorted); whole chunks of it are passed over by their ends."""
    overlap = lambda x, y: (y["s"] < x["e"]) & (y["e"] > x["s"])
    bounds = lambda c: F.struct(F.array_min(F.transform(c, lambda y: y["s"])).alias("s"), F.array_max(F.transform(c, lambda y: y["e"])).alias("e"), c.alias("items"))
    return let(F.transform(_chunks(base), bounds), lambda chunks: F.filter(spans, lambda x: ~F.exists(chunks, lambda c: overlap(x, c) & F.exists(c["items"], lambda y: overlap(x, y)))))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Secrets of every whole text (null: empty).

    Returns one row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256 (of the spans of the fixed
    patterns), spans (those and the added entropy_hex and entropy_base64 spans) and n_entropy. A span is written
    kind:start:end, in code points, the end exclusive, of the whole match, by start and then in the order of the
    kinds. Matches are leftmost and do not overlap within a kind. Repeated rows and null ids come back as they are;
    other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = F.col("text")
    rows = rows.select(
        "doc_id",
        _found(t, ASSIGN, "assign", 0, LEAST["assign"], 2).alias("assign"),
        _found(t, ACCESS, "access", 1, LEAST["access"]).alias("access"),
        _found(t, HEX, "hex", 2, LEAST["hex"]).alias("hex"),
        _entropy(t, allowed).alias("entropy"),
    )
    base = F.array_sort(F.concat("assign", "access", "hex"))
    rows = rows.withColumn("base", base)
    rows = rows.withColumn("entropy", F.when(F.size("base") == 0, F.col("entropy")).otherwise(_apart(F.col("entropy"), F.col("base"))))
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", "entropy"))).alias("spans"),
        F.size("entropy").cast("long").alias("n_entropy"),
    )
