"""Removal of lines that another place of the corpus holds already, with an edit bound (deletion neighbourhood).

Native: DataFrame functions only. A line's words are compared in lower case. Two lines are alike when their words are
equal, or when both have at least ``LEAST`` words (the shorter one) and one word inserted, deleted or replaced turns one
into the other. Every word-deletion variant of a line is emitted as a hashed key; a bucket of equal keys holds lines
with the same words around a replaced one (same length and place), or a line and those one word longer. Buckets are
aggregated to their earliest line, so a bucket of any size costs one row a line and no pairs; what a bucket claims is
confirmed on the words.

Lines within one edit share their first or their last words: those whose leading and trailing words occur in no other
line have no neighbour, and are not expanded; those that meet others by their leading words alone are expanded behind
these only, and by their trailing words alone before these only. Exact repeats are joined before that by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import as_table, let

LEAST = 8
#: Rows of keys, places or verdicts that are broadcast at most (some 40 bytes each); beyond it they are joined by shuffle.
BROADCAST_ROWS = 1_000_000


_BLANK = " \t\x0b\f\r"


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANK))


def _plain(bare: Column) -> Column:
    """A line without outer blanks in lower case, its words parted by one space."""
    odd = bare.contains("  ")
    for c in _BLANK[1:]:
        odd = odd | bare.contains(c)
    return F.when(odd, F.regexp_replace(F.lower(bare), r"[ \t\x0B\f\r]+", " ")).otherwise(F.lower(bare))


def _ends(n: Column) -> Column:
    """How many leading or trailing words two lines share at least, when the shorter has n words: by doubling classes of n."""
    return F.when(n < 12, 4).otherwise(F.lit(6) * F.pow(F.lit(2), F.floor(F.log2(n / 12)))).cast("int")


def _lines(docs: DataFrame) -> DataFrame:
    """One row per line with words: doc, pos, n, two hashes of its words, and hashes of its leading and its trailing words."""
    rows = docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.select("doc", "pos", _bare(F.col("line")).alias("line")).where("line <> ''")
    rows = rows.select("doc", "pos", _plain(F.col("line")).alias("s"))
    rows = rows.withColumn("w", F.split("s", " ")).withColumn("n", F.size("w"))
    rows = rows.withColumns({"e": _ends(F.col("n")), "f": _ends(F.col("n") - 1)})
    n = F.col("n")

    def ends(side: int) -> Column:
        end = lambda e: F.xxhash64(F.lit(side), F.col(e), F.slice("w", -F.col(e) if side else F.lit(1), F.col(e)))
        keys = F.when(n < LEAST, F.array().cast("array<bigint>"))
        return keys.when((n == LEAST) | (F.col("e") == F.col("f")), F.array(end("e"))).otherwise(F.array(end("e"), end("f")))

    return rows.select("doc", "pos", "n", F.xxhash64("s").alias("h"), F.hash("s").alias("h2"), ends(0).alias("heads"), ends(1).alias("tails"))


def _variants(words: Column) -> Column:
    """Hashes of a word array: entry 0 of the whole, entry i of the array without word i (from 1)."""
    here = F.transform(words, lambda w, i: F.struct(F.xxhash64(w, i).alias("a"), F.xxhash64(w, i - 1).alias("b")))

    def step(acc: Column, w: Column) -> Column:
        rest = acc["y"].bitwiseXOR(w["b"])
        return F.struct(acc["x"].bitwiseXOR(w["a"]).alias("x"), rest.alias("y"), F.concat(acc["out"], F.array(acc["x"].bitwiseXOR(rest))).alias("out"))

    def folded(x: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
        whole = F.aggregate(x, zero, lambda s, y: F.struct(s["a"].bitwiseXOR(y["a"]).alias("a"), s["b"].bitwiseXOR(y["b"]).alias("b")))
        start = lambda t: F.struct(F.lit(0).cast("long").alias("x"), t["b"].alias("y"), F.array(t["a"]).alias("out"))
        return let(whole, lambda t: F.aggregate(x, start(t), step)["out"])

    return let(here, folded)


def within_one_edit(a: Column, b: Column) -> Column:
    """True where one inserted, deleted or replaced entry, or none, turns one array into the other."""
    replaced = F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda d: d)) <= 1
    long, short = F.when(F.size(a) > F.size(b), a).otherwise(b), F.when(F.size(a) > F.size(b), b).otherwise(a)
    first = F.array_position(F.zip_with(short, F.slice(long, F.lit(1), F.size(short)), lambda x, y: ~x.eqNullSafe(y)), True)
    tail = F.slice(long, first.cast("int") + 1, F.size(long)) == F.slice(short, F.greatest(first.cast("int"), F.lit(1)), F.size(short))
    return F.when(F.size(a) == F.size(b), replaced).when(F.abs(F.size(a) - F.size(b)) == 1, (first == 0) | tail).otherwise(False)


def _small(table: DataFrame, weight: str = "1") -> DataFrame:
    """A written table, marked for broadcast if the sum of ``weight`` over its rows is at most ``BROADCAST_ROWS``."""
    heavy = table.agg(F.sum(F.expr(weight).cast("long"))).first()[0] or 0
    return F.broadcast(table) if heavy <= BROADCAST_ROWS else table


def _near(docs: DataFrame, lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """(h, h2) of the distinct lines that have an earlier line within one edit."""
    ends = lines.where(F.col("n") >= LEAST).select("h", F.size("heads").alias("heads"), F.posexplode(F.concat("heads", "tails")).alias("i", "e"))
    met = as_table(ends.groupBy("e").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("e"), "met")
    # Lines that meet another one, by their leading words, their trailing words or both.
    head = F.col("i") < F.col("heads")
    meeting = as_table(ends.join(_small(met), "e", "left_semi").groupBy("h").agg(F.bool_or(head).alias("head"), F.bool_or(~head).alias("tail")), "meeting")
    chosen = firsts.where(F.col("n") >= LEAST).join(_small(meeting), "h").select("h", "h2", F.col("first.doc").alias("doc"), F.col("first.pos").alias("pos"), "head", "tail")
    chosen = as_table(chosen.groupBy("doc").agg(F.collect_list(F.struct("h", "h2", "pos", "head", "tail")).alias("chosen")), "chosen")
    placed = docs.select(F.col("doc_id").alias("doc"), F.split("text", "\n").alias("lines")).join(_small(chosen, "size(chosen)"), "doc")
    here = F.transform("chosen", lambda c: F.struct(*[c[x].alias(x) for x in ("h", "h2", "pos", "head", "tail")], F.get("lines", c["pos"]).alias("line")))
    cand = placed.select("doc", F.explode(here).alias("c")).select("doc", "c.*").where("line is not null").dropDuplicates(["h", "h2"])
    cand = as_table(cand.select("h", "h2", F.struct("doc", "pos").alias("at"), F.split(_plain(_bare(F.col("line"))), " ").alias("w"), "head", "tail"), "candidates")

    # Behind common leading words the edit is in the words after them, before common trailing words in those before.
    n, common = F.size("w"), _ends(F.size("w") - 1)
    keyed = cand.select("at", n.alias("n"), common.alias("common"), "head", "tail", F.posexplode(_variants(F.col("w"))).alias("i", "v"))
    keyed = keyed.where("i = 0 or head and i > common or tail and i <= n - common")
    keyed = keyed.select(F.xxhash64(F.when(F.col("i") == 0, F.col("n")).otherwise(F.col("n") - 1), "v").alias("k"), "i", "at")
    keyed = as_table(keyed, "keyed")
    several = as_table(keyed.groupBy("k").count().where("count > 1").select("k"), "several")
    keyed = as_table(keyed.join(_small(several), "k", "left_semi"), "shared")
    by_place = keyed.groupBy("k", "i").agg(F.min("at").alias("same"))
    by_key = by_place.groupBy("k").agg(F.min(F.when(F.col("i") == 0, F.col("same"))).alias("whole"), F.min(F.when(F.col("i") > 0, F.col("same"))).alias("cut"))
    first = by_place.join(by_key, "k").select("k", "i", F.when(F.col("i") == 0, F.col("cut")).otherwise(F.least("same", "whole")).alias("witness"))
    claims = keyed.join(first.where("witness is not null"), ["k", "i"]).where("witness < at").groupBy("at").agg(F.min("witness").alias("witness"))
    words = cand.select(F.col("at").alias("witness"), F.col("w").alias("w2"))
    sure = claims.join(cand.select("at", "h", "h2", "w"), "at").join(words, "witness")
    sure = sure.where((F.least(F.size("w"), F.size("w2")) >= LEAST) & within_one_edit(F.col("w"), F.col("w2")))
    return sure.select("h", "h2", F.lit(True).alias("near"))


def _without(lines: Column, gone: Column) -> Column:
    """The entries of ``lines`` whose places (from 0) are not in the sorted array ``gone``: the runs between them."""
    runs = F.zip_with(F.concat(F.array(F.lit(-1)), gone), F.concat(gone, F.array(F.size(lines))), lambda a, b: F.slice(lines, a + 2, b - a - 1))
    return F.array_join(F.flatten(runs), "\n")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Drop every line that an earlier line of the corpus is alike to; the earliest (by doc_id, then place) stays.

    Adds to the columns of ``docs`` n_lines (with blank ones) and n_removed, and replaces ``text`` by the lines that
    stay, joined by a line break. Lines are cut at line feeds and judged on the input, so a line goes if any earlier
    one is alike, whether or not that one stays. Blank lines always stay. A null text stays null, with no lines. Rows
    with a null doc_id come back unchanged. Repeated rows of one doc_id count as one place and are changed alike.
    Columns named n_lines or n_removed are replaced; other columns may have any name. An empty table stays empty.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    lines = as_table(_lines(own), "lines")
    firsts = as_table(lines.groupBy("h", "h2").agg(F.min(F.struct("doc", "pos")).alias("first"), F.first("n").alias("n"), F.count("*").alias("c")), "firsts")
    near = as_table(_near(own, lines, firsts), "near")
    # Only lines that occur again or have a near one before them are looked up: a very common line is one row here.
    verdict = firsts.join(_small(near), ["h", "h2"], "left").where("c > 1 or near").select("h", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = lines.select("doc", "pos", "h", "h2").join(_small(as_table(verdict, "verdict")), ["h", "h2"]).where(F.col("near") | (F.struct("doc", "pos") > F.col("first")))
    gone = as_table(gone.groupBy("doc").agg(F.sort_array(F.collect_set("pos")).alias("gone")), "gone")

    # Nested, so that no column of docs can clash with what is added.
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*kept).alias("row"), F.col("doc_id").cast("long").alias("doc"), text.alias("text"))
    out = rows.join(_small(gone, "2 + size(gone)"), "doc", "left").select("row", "text", F.split("text", "\n").alias("lines"), "gone")
    return out.select(
        *[F.when(F.col("gone").isNull(), F.col("text")).otherwise(_without(F.col("lines"), F.col("gone"))).alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in kept],
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )
