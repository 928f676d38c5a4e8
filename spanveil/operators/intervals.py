"""Windows of long texts, and joins of spans by position, without all pairs of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import merged_in

#: Characters of a bucket of positions.
BUCKET = 4096


def windows(docs: DataFrame, size: int = 1200, overlap: int = 300) -> DataFrame:
    """Overlapping windows of each text: doc_id, win, start, end, core_start, core_end, text.

    Windows begin every ``size - overlap`` characters; a text of at most ``size`` is one window. The cores lie beside
    each other and cover the text, with half an overlap before and behind: what begins in a core belongs to its window,
    so nothing counts twice. Texts are first cut into blocks of many windows, so a long one costs no scan a window, and
    its windows can be spread over tasks. Null texts have none; an empty text has one.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap has to be smaller than a window")
    step, many = size - overlap, 64
    n = F.length("text")
    count = F.when(n <= size, 1).otherwise(F.ceil((n - overlap) / step)).cast("int")
    blocks = docs.where("text is not null").select("doc_id", n.alias("__n"), count.alias("__w"), "text")
    blocks = blocks.select("doc_id", "__n", "__w", F.explode(F.sequence(F.lit(0), F.floor((F.col("__w") - 1) / many).cast("int"))).alias("__b"), "text")
    at = F.col("__b") * (many * step)
    blocks = blocks.select("doc_id", "__n", "__w", "__b", F.substr("text", at + 1, F.lit(many * step + overlap)).alias("__t"))
    last = F.least(F.lit(many), F.col("__w") - F.col("__b") * many) - 1
    rows = blocks.select("doc_id", "__n", "__w", "__b", "__t", F.explode(F.sequence(F.lit(0), last)).alias("__i")).withColumn("win", F.col("__b") * many + F.col("__i"))
    start = F.col("win") * step
    end = F.least(start + size, F.col("__n"))
    half = overlap // 2
    core_start = F.when(F.col("win") == 0, F.lit(0)).otherwise(start + half)
    core_end = F.when(F.col("win") + 1 == F.col("__w"), F.col("__n")).otherwise(start + step + half)
    cut = F.substr("__t", F.col("__i") * step + 1, F.lit(size))
    return rows.select("doc_id", "win", start.cast("int").alias("start"), end.cast("int").alias("end"), core_start.cast("int").alias("core_start"), core_end.cast("int").alias("core_end"), cut.alias("text"))


def owned(spans: Column) -> Column:
    """The spans of a window that begin in its core, at their places in the whole text."""
    start, core_start, core_end = F.col("start"), F.col("core_start"), F.col("core_end")
    inside = F.filter(spans, lambda s: (s["start"] + start >= core_start) & (s["start"] + start < core_end))
    return F.transform(inside, lambda s: F.struct((s["start"] + start).alias("start"), (s["end"] + start).alias("end"), s["type"].alias("type"), s["score"].alias("score")))


def merged(spans: DataFrame, by: str = "doc_id") -> DataFrame:
    """The union of the spans (a key, start, end) as disjoint spans: gaps and islands by the running maximum of the ends."""
    order = Window.partitionBy(by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.where("start < end").select(by, "start", "end").withColumn("__new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    rows = rows.withColumn("__i", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(by, "__i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__i")


def overlapping(left: DataFrame, right: DataFrame, by: str = "doc_id") -> DataFrame:
    """Pairs of spans of a key that share a character: columns of ``left``, and ``a`` and ``b`` of ``right`` (its start and end).

    Both sides are put into the buckets of positions that they reach; a pair that meets in several counts in the first.
    """
    bucket = lambda c: F.floor(F.col(c) / BUCKET)
    reach = lambda a, b: F.explode(F.sequence(bucket(a), F.floor((F.col(b) - 1) / BUCKET))).alias("__k")
    one = left.where("start < end").select("*", reach("start", "end"))
    two = right.where("start < end").select(by, F.col("start").alias("a"), F.col("end").alias("b"), reach("start", "end"))
    met = one.join(two, [by, "__k"]).where("a < end and start < b")
    return met.where(F.col("__k") == F.greatest(bucket("start"), bucket("a"))).drop("__k")


def cut_out(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans (doc_id, start, end) with ``value``, the characters that they cover.

    Values of at most a bucket come from blocks of the text, so many spans of a long text cost no scan of it each.
    """
    short = (F.col("end") - F.col("start")) <= BUCKET
    pieces = windows(docs.select("doc_id", "text"), 2 * BUCKET, BUCKET).select("doc_id", F.col("win").alias("__w"), F.col("start").alias("__s"), F.col("text").alias("__t"))
    # The window that begins with a span's bucket holds it; the last window reaches to the end of the text.
    last = docs.select("doc_id", F.greatest(F.when(F.length("text") <= 2 * BUCKET, 1).otherwise(F.ceil((F.length("text") - BUCKET) / BUCKET)), F.lit(1)).cast("int").alias("__l"))
    own = spans.where(short).join(merged_in(last), "doc_id").withColumn("__w", F.least(F.floor(F.col("start") / BUCKET).cast("int"), F.col("__l") - 1))
    near = own.join(merged_in(pieces), ["doc_id", "__w"]).withColumn("value", F.substr("__t", F.col("start") - F.col("__s") + 1, F.col("end") - F.col("start")))
    far = spans.where(~short).join(merged_in(docs.select("doc_id", "text")), "doc_id").withColumn("value", F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")))
    return near.select(*spans.columns, "value").unionByName(far.select(*spans.columns, "value"))
