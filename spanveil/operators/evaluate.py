"""Accuracy of detections against a ground truth (A-4 to A-13, J1, J2, F14 to F16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import value_key, weight, wilson_lower
from ..tables import written
from .intervals import cut_out, merged, overlapping


def line_index(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, start, end and the white-space normalised line."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0))
    return rows.select("doc_id", "line_no", start.cast("int").alias("start"), (start + F.length("line")).cast("int").alias("end"), F.trim(F.regexp_replace("line", r"(?U)\s+", " ")).alias("line"))


def boilerplate_lines(docs: DataFrame, threshold: int = 20, least: int = 12) -> DataFrame:
    """A-4: (doc_id, line, n): normalised lines of at least ``least`` characters that occur ``threshold`` times in a document."""
    rows = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim(F.regexp_replace("line", r"(?U)\s+", " ")).alias("line"))
    return rows.where(F.length("line") >= least).groupBy("doc_id", "line").agg(F.count("*").alias("n")).where(F.col("n") >= threshold)


def covered(gold: DataFrame, detections: DataFrame, docs: DataFrame) -> DataFrame:
    """A-8, J1: gold (doc_id, type, start, end) with value and covered: every letter and digit of it lies in some detection.

    Detections are united to disjoint spans; an item is covered where the letters and digits of its overlaps with them
    add up to its own.
    """
    items = cut_out(gold, docs)
    parts = overlapping(items, merged(detections.select("doc_id", "start", "end")))
    from_, to = F.greatest("a", "start"), F.least("b", "end")
    held = parts.select("doc_id", "type", "start", "end", weight(F.substr("value", from_ - F.col("start") + 1, to - from_)).alias("w"))
    own = held.groupBy("doc_id", "type", "start", "end").agg(F.sum("w").alias("__w"))
    # Equal items meet their parts as often as they are there.
    times = gold.groupBy("doc_id", "type", "start", "end").agg(F.count("*").alias("__n"))
    own = own.join(times, ["doc_id", "type", "start", "end"]).withColumn("__w", F.col("__w") / F.col("__n"))
    out = items.join(own.drop("__n"), ["doc_id", "type", "start", "end"], "left")
    return out.withColumn("covered", F.coalesce("__w", F.lit(0)) == weight(F.col("value"))).drop("__w")


def judged(docs: DataFrame, gold: DataFrame, detections: DataFrame, threshold: int = 20) -> DataFrame:
    """Gold items with covered and boilerplate (the item begins on a boilerplate line)."""
    lines = line_index(docs)
    common = boilerplate_lines(docs, threshold).select("doc_id", "line", F.lit(True).alias("boilerplate"))
    marked = lines.join(common, ["doc_id", "line"]).select("doc_id", "start", "end")
    items = covered(gold, detections, docs)
    # From the gold itself: from the items, the detections would be made once more.
    first = gold.select("doc_id", "type", F.col("start").alias("__s"), F.col("end").alias("__e")).distinct().withColumns({"start": F.col("__s"), "end": F.col("__s") + 1})
    on = overlapping(first, marked).select("doc_id", "type", F.col("__s").alias("start"), F.col("__e").alias("end"), F.lit(True).alias("boilerplate")).distinct()
    return items.join(on, ["doc_id", "type", "start", "end"], "left").withColumn("boilerplate", F.coalesce("boilerplate", F.lit(False)))


def evaluate(docs: DataFrame, gold: DataFrame, detections: DataFrame, threshold: int = 20) -> DataFrame:
    """A-5 to A-7: per type occurrences, hits, recall with its lower bound, protected unique values and boilerplate recall.

    A value is protected in a document where all its occurrences outside boilerplate are covered.
    """
    items = written(judged(docs, gold, detections, threshold).withColumn("key", value_key(F.col("value"))), "judged")
    by_type = items.groupBy("type").agg(
        F.count_if(~F.col("boilerplate")).alias("occurrences"), F.count_if(~F.col("boilerplate") & F.col("covered")).alias("hits"),
        F.count_if("boilerplate").alias("boilerplate"), F.count_if(F.col("boilerplate") & F.col("covered")).alias("boilerplate_hits"),
    )
    values = items.where("not boilerplate").groupBy("type", "doc_id", "key").agg(F.bool_and("covered").alias("ok")).groupBy("type").agg(F.count("*").alias("unique_values"), F.count_if("ok").alias("protected"))
    out = by_type.join(values, "type", "left").fillna(0, ["unique_values", "protected"])
    return out.withColumn("recall", F.when(F.col("occurrences") > 0, F.col("hits") / F.col("occurrences"))).withColumn("recall_lower", wilson_lower(F.col("hits"), F.col("occurrences")))


def leaks(items: DataFrame, docs: DataFrame, limit: int = 12, width: int = 110) -> DataFrame:
    """A-9, F14: the first ``limit`` uncovered items of each type with the line around them, and how many there are."""
    missed = items.where("not covered")
    total = missed.groupBy("type").agg(F.count("*").alias("total"))
    # The rank's limit goes to the partial side of the window: a task hands on ``limit`` items of a type at most.
    order = Window.partitionBy("type").orderBy("doc_id", "start")
    missed = missed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).join(F.broadcast(total), "type")  # one row a type
    rows = missed.join(docs.select("doc_id", "text"), "doc_id")
    line = F.concat(F.substring_index(F.substr("text", F.lit(1), F.col("start")), "\n", -1), F.substring_index(F.substr("text", F.col("start") + 1), "\n", 1))
    return rows.select("type", "rank", "doc_id", "start", "end", F.substring(F.trim(F.regexp_replace(line, r"(?U)\s+", " ")), 1, width).alias("context"), (F.col("total") - limit).alias("more"))


def consolidate(runs: DataFrame) -> DataFrame:
    """A-10: (type, occurrences, hits, unique_values, protected) of many runs summed by type, and in all (type null)."""
    sums = [F.sum(c).alias(c) for c in ("occurrences", "hits", "unique_values", "protected")]
    out = runs.rollup("type").agg(*sums)
    return out.withColumn("recall_lower", wilson_lower(F.col("hits"), F.col("occurrences"))).withColumn("protection_lower", wilson_lower(F.col("protected"), F.col("unique_values")))


def compare_runs(new: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A-11, J9: entities (type, text) of two runs: counts by type on both sides, and unique PERSON values by side."""
    count = lambda df, c: df.groupBy("type").agg(F.count("*").alias(c))
    counts = count(new, "new").join(count(old, "old"), "type", "full_outer").select("type", F.coalesce("new", F.lit(0)).alias("new"), F.coalesce("old", F.lit(0)).alias("old"))
    people = lambda df: df.where("type = 'PERSON'").select(value_key(F.col("text")).alias("value")).distinct()
    a, b = people(new), people(old)
    side = lambda df, s: df.select("value", F.lit(s).alias("side"))
    values = side(a.subtract(b), "only_new").unionByName(side(b.subtract(a), "only_old")).unionByName(side(a.intersect(b), "both"))
    return counts, values


def min_n_for_99(spark: SparkSession, misses: DataFrame, most: int = 100_000) -> DataFrame:
    """F16: (k, n): the fewest trials with k misses whose lower bound is 0.99, up to ``most``; found by bisection on the bound."""
    lo, hi = F.col("k") + 1, F.lit(most)
    bound = lambda n: wilson_lower(n - F.col("k"), n.cast("double"))
    out = misses.withColumn("__lo", lo.cast("long")).withColumn("__hi", hi.cast("long"))
    for _ in range(most.bit_length()):
        mid = F.floor((F.col("__lo") + F.col("__hi")) / 2)
        good = bound(mid) >= 0.99
        out = out.select("k", F.when(good, F.col("__lo")).otherwise(F.least(mid + 1, F.col("__hi"))).alias("__lo"), F.when(good, mid).otherwise(F.col("__hi")).alias("__hi"))
    return out.select("k", F.when(bound(F.col("__lo")) >= 0.99, F.col("__lo")).alias("n"))


def text_quality(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """A-12, J10, F17: per document the words of at least four letters, how many are in ``lexicon`` (word), the rate, and characters."""
    words = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?U)[\p{L}]{4,}"), F.lit(0))).alias("w")).select("doc_id", F.lower("w").alias("word"))
    known = lexicon.select(F.lower("word").alias("word")).distinct().withColumn("hit", F.lit(1))
    found = words.join(known, "word", "left").groupBy("doc_id").agg(F.count("*").alias("words"), F.count("hit").alias("hits"))
    out = docs.select("doc_id", F.length("text").alias("chars")).join(found, "doc_id", "left").fillna(0, ["words", "hits"])
    return out.withColumn("rate", F.when(F.col("words") > 0, F.col("hits") / F.col("words")))


def summarise_quality(measured: DataFrame) -> DataFrame:
    """A-13: sums by configuration: words, hits, seconds, errors; the rate is of the sums."""
    out = measured.groupBy("config").agg(F.sum("words").alias("words"), F.sum("hits").alias("hits"), F.sum("seconds").alias("seconds"), F.count("error").alias("errors"))
    return out.withColumn("rate", F.when(F.col("words") > 0, F.col("hits") / F.col("words")))


def run_payload(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """SNK4: what a run leaves for comparison with another one: per document its characters, its entities in order, and counts by type.

    ``docs`` is (doc_id, text), ``entities`` (doc_id, type, text, start, end, score). Documents without entities have
    an empty list and an empty map.
    """
    item = F.struct("start", "end", "type", "text", "score")
    counts = entities.groupBy("doc_id", "type").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("counts"))
    rows = entities.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("entities"))
    out = docs.select("doc_id", F.length("text").alias("chars")).join(rows, "doc_id", "left").join(counts, "doc_id", "left")
    return out.withColumns({"entities": F.coalesce("entities", F.array().cast(rows.schema["entities"].dataType)), "counts": F.coalesce("counts", F.create_map().cast("map<string,bigint>"))})


def count_by_type(entities: DataFrame, *by: str) -> DataFrame:
    """A-1."""
    return entities.groupBy(*by, "type").agg(F.count("*").alias("n"))


def distinct_values(entities: DataFrame, *by: str, approx: bool = False) -> DataFrame:
    """A-2: distinct values by type; ``approx`` for very large corpora."""
    count: Column = F.approx_count_distinct("__v") if approx else F.count_distinct("__v")
    return entities.withColumn("__v", value_key(F.col("text"))).groupBy(*by, "type").agg(count.alias("n_values"))
