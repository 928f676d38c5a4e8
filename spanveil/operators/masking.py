"""Numbering and application of masks, re-masking, rejection and review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.masks import check_policy, mask
from ..functions.text import label_of, let, value_key
from .fuse import ENTITIES


def fenced(docs: DataFrame, column: str) -> DataFrame:
    """``docs`` with a fence behind ``column``: filters on it are not written into the expression that makes it.

    The column leaves through a generator of one row, which the optimiser moves no filter through. Row-local and
    deterministic.
    """
    others = [c for c in docs.columns if c != column]
    return docs.select(*others, F.explode(F.array(column)).alias(column)).select(*docs.columns)


def _firsts(keys: Column) -> Column:
    """Of sorted (k, v, i) structs the first of each (k, v)."""
    return let(F.array_sort(keys), lambda o: F.filter(o, lambda x, j: (j == 0) | (F.get(o, j - 1)["k"] != x["k"]) | (F.get(o, j - 1)["v"] != x["v"])))


def numbers(entities: Column) -> Column:
    """For each entity of a document its number: first appearance of its value among those of its label.

    Values are sorted once and looked up in a map, so a document with many entities needs no comparison of all with all.
    """
    key = lambda x: F.concat_ws("\x01", x["k"], x["v"])

    def numbered(keys: Column) -> Column:
        appearing = F.array_sort(F.transform(_firsts(keys), lambda x: F.struct(x["k"].alias("k"), x["i"].alias("i"), x["v"].alias("v"))))

        def places(f: Column) -> Column:
            labels = F.transform(f, lambda x: x["k"])
            begin = let(labels, lambda ls: let(F.array_distinct(ls), lambda kinds: F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.array_position(ls, k).cast("int")))))
            return let(begin, lambda m: F.map_from_entries(F.transform(f, lambda x, j: F.struct(key(x), j + 2 - F.element_at(m, x["k"])))))

        return let(let(appearing, places), lambda m: F.transform(keys, lambda x: F.element_at(m, key(x))))

    return let(F.transform(entities, lambda e, i: F.struct(F.coalesce(label_of(e["type"]), F.lit("")).alias("k"), F.coalesce(value_key(e["text"]), F.lit("")).alias("v"), i.alias("i"))), numbered)


def masks_of(entities: Column, policy: str) -> Column:
    if check_policy(policy) != "placeholder":
        return F.transform(entities, lambda e: mask(e["type"], e["text"], policy))
    return F.zip_with(entities, numbers(entities), lambda e, n: F.concat(F.lit("["), label_of(e["type"]), F.lit("_"), n.cast("string"), F.lit("]")))


def replaced(text: Column, spans: Column, texts: Column) -> Column:
    """A text with disjoint spans, in order, replaced."""
    paired = F.zip_with(spans, texts, lambda s, t: F.struct(s["start"].alias("start"), s["end"].alias("end"), t.alias("t")))

    def written(p: Column) -> Column:
        end = lambda i: F.when(i > 0, F.get(p, i - 1)["end"]).otherwise(0)
        parts = F.transform(p, lambda x, i: F.concat(F.substr(text, end(i) + 1, x["start"] - end(i)), x["t"]))
        return F.when(F.size(p) > 0, F.concat(F.array_join(parts, ""), F.substr(text, F.element_at(p, -1)["end"] + 1))).otherwise(text)

    return let(paired, written)


def distinct_values(entities: Column) -> Column:
    """Distinct values by type: map."""
    keys = F.transform(entities, lambda e: F.struct(e["type"].alias("k"), F.coalesce(value_key(e["text"]), F.lit("")).alias("v"), F.lit(0).alias("i")))

    def counted(types: Column) -> Column:
        return let(F.array_distinct(types), lambda kinds: F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(types, lambda t: t == k)))))

    return let(F.transform(_firsts(keys), lambda x: x["k"]), counted)


def apply_masks(docs: DataFrame, policy: str = "placeholder") -> DataFrame:
    """Add anonymized_text, politica_mascara and valores_distintos to (text, entities)."""
    text, e = F.col("text"), F.col("entities")
    return docs.withColumns({"anonymized_text": replaced(text, e, masks_of(e, policy)), "politica_mascara": F.lit(policy), "valores_distintos": distinct_values(e)})


def remask(docs: DataFrame, policy: str = "placeholder") -> tuple[DataFrame, DataFrame]:
    """Apply masks to given entities without detection: (masked, refused with a reason).

    Entities are sorted; overlapping or out-of-range ones, or a declared text that is not in its place, refuse the
    document. The reason never holds a value. Numbers begin anew at 1.
    """
    check_policy(policy)
    text = F.col("text")
    given = F.array_sort(F.transform("entities", lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["type"].alias("type"), x["text"].alias("text"), F.coalesce(x["score"], F.lit(1.0)).alias("score"))))
    given = F.coalesce(given, F.array().cast("array<struct<start:int,end:int,type:string,text:string,score:double>>"))

    def judged(e: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(e, i - 1)["end"]).otherwise(0)
        bad = F.exists(F.transform(e, lambda x, i: (x["end"] <= x["start"]) | (x["start"] < before(i)) | (x["end"] > F.length(text)) | x["start"].isNull() | x["end"].isNull()), lambda b: F.coalesce(b, F.lit(True)))
        other = F.get(F.filter(e, lambda x: x["text"].isNotNull() & (F.substr(text, x["start"] + 1, x["end"] - x["start"]) != x["text"])), F.lit(0))["type"]
        reason = F.when(text.isNull(), "no text").when(bad, "entities have to be disjoint and inside the text")
        reason = reason.when(other.isNotNull(), F.concat(F.lit("an entity declares another text than the one in its place: "), other))
        own = F.transform(e, lambda x: F.struct(x["type"].alias("type"), F.substr(text, x["start"] + 1, x["end"] - x["start"]).alias("text"), x["start"].alias("start"), x["end"].alias("end"), F.round(x["score"], 2).alias("score")))
        return F.struct(reason.alias("reason"), own.alias("own"))

    docs = fenced(docs.withColumn("__judged", let(given, judged)), "__judged")
    good = apply_masks(docs.where("__judged.reason is null").withColumn("entities", F.col("__judged.own")), policy)
    return good.drop("__judged"), docs.where("__judged.reason is not null").withColumn("reason", F.col("__judged.reason")).drop("__judged")


def reject(entities: DataFrame, rejected: DataFrame) -> DataFrame:
    """Entities (doc_id, type, text, ...) without those that a reviewer rejected by (type, term), compared as values."""
    gone = rejected.select("type", value_key(F.col("term")).alias("__v")).distinct()
    return entities.withColumn("__v", value_key(F.col("text"))).join(gone, ["type", "__v"], "left_anti").drop("__v")


def collected(entities: DataFrame) -> DataFrame:
    """Entities of a document as one array, by start."""
    e = F.struct(F.col("start").cast("int"), F.col("end").cast("int"), "type", "text", "score")
    rows = entities.groupBy("doc_id").agg(F.sort_array(F.collect_list(e)).alias("e"))
    return rows.select("doc_id", F.transform("e", lambda x: F.struct(x["type"].alias("type"), x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score"))).cast(ENTITIES).alias("entities"))


def segments(docs: DataFrame) -> DataFrame:
    """The text cut at its entities: doc_id, pos, kind (text or entity), text, type, idx (place in the given list).

    Invalid entities and those that overlap an earlier one are left out.
    """
    text = F.col("text")
    given = F.transform("entities", lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["type"].alias("type"), i.alias("idx")))
    valid = F.array_sort(F.filter(given, lambda x: (x["start"] >= 0) & (x["start"] < x["end"]) & (x["end"] <= F.length(text))))
    kind = "array<struct<start:int,end:int,type:string,idx:int>>"
    kept = F.aggregate(valid.cast(kind), F.array().cast(kind), lambda acc, x: F.when((F.size(acc) == 0) | (x["start"] >= F.element_at(acc, -1)["end"]), F.concat(acc, F.array(x))).otherwise(acc))
    docs = docs.withColumn("__k", kept)
    k = F.col("__k")
    end = lambda i: F.when(i > 0, F.get(k, i - 1)["end"]).otherwise(0)
    piece = lambda a, b, kind, t, i: F.struct(a.alias("a"), F.lit(kind).alias("kind"), F.substr(text, a + 1, b - a).alias("text"), t.alias("type"), i.alias("idx"))
    none, no_index = F.lit(None).cast("string"), F.lit(None).cast("int")
    cut = F.flatten(F.transform(k, lambda x, i: F.array(piece(end(i), x["start"], "text", none, no_index), piece(x["start"], x["end"], "entity", x["type"], x["idx"]))))
    last = F.when(F.size(k) > 0, F.element_at(k, -1)["end"]).otherwise(0)
    cut = F.filter(F.concat(cut, F.array(piece(last, F.length(text), "text", none, no_index))), lambda p: p["text"] != "")
    rows = docs.select("doc_id", F.posexplode(cut).alias("pos", "p"))
    return rows.select("doc_id", "pos", "p.kind", "p.text", "p.type", "p.idx")


def review_order(entities: DataFrame, weakest_first: bool = False) -> DataFrame:
    """O1: entities with group_size and place: types by number of entities, then by text order or weakest score."""
    group = Window.partitionBy("doc_id", "type")
    inner = ["score", "start"] if weakest_first else ["start", "end"]
    sized = entities.withColumn("group_size", F.count("*").over(group))
    return sized.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("group_size"), "type", *inner)))
