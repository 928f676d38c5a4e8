"""Fusion of overlapping spans into disjoint entities (D11), row by row and as a sweep over sorted borders."""

from __future__ import annotations

import re
from bisect import bisect_left
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

# Types from the weakest to the strongest.
PRIORITY = (
    "DATE_TIME", "LAW", "CASE_LAW", "ORGANIZATION", "DATE_OF_BIRTH", "LOCATION", "PERSON", "ENDERECO_BR", "CEP_BR", "EMAIL_ADDRESS",
    "PHONE_NUMBER", "PHONE_NUMBER_BR", "CONTA_BANCARIA", "OAB_BR", "NIT_PIS_PASEP", "RG_BR", "CNPJ_BR", "NUMERO_PROCESSO_CNJ", "CPF_BR",
)
ENTITIES = "array<struct<type:string,text:string,start:int,end:int,score:double>>"


def rank_of(kind: Column, priority=PRIORITY) -> Column:
    """Place of a type in the order; a type outside of it is below all."""
    return F.coalesce(F.array_position(F.array(*[F.lit(p) for p in priority]), kind), F.lit(0)).cast("int")


def fuse_spans(docs: DataFrame, text: Column, spans: str = "spans", priority=PRIORITY, apart: tuple[str, ...] = ()) -> DataFrame:
    """Add ``entities``, the disjoint entities of each row: the stronger type takes the characters, touching pieces of a type are one.

    Entities end at line breaks; those of one character go. The score is the best of the spans of the same type that
    overlap the entity. Types outside the order are below all, and their names decide among them. Spans of a type that is
    ``apart`` begin an entity where they begin, so touching ones stay two. Each step is a column of its own, so that no expression holds another one twice.
    """
    at = lambda a, b, t: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), t.alias("t"))
    clipped = lambda s: F.struct(F.greatest(s["start"], F.lit(0)).alias("start"), F.least(s["end"], F.length(text)).alias("end"), s["type"].alias("type"), s["score"].alias("score"))
    out = docs.withColumn("__in", F.filter(F.transform(spans, clipped), lambda s: s["start"] < s["end"]))
    # Spans that are the same place and type or lie apart are entities as they stand; only the others are cut into cells.
    out = out.withColumn("__own", F.sort_array(F.array_distinct(F.transform(F.filter("__in", lambda s: s["type"].isNotNull()), lambda s: at(s["start"], s["end"], s["type"])))))
    own = F.col("__own")
    out = out.withColumn("__apart", ~F.exists(F.zip_with(own, F.slice(own, F.lit(2), F.size(own)), lambda x, y: F.coalesce(y["a"] <= x["b"], F.lit(False))), lambda x: x))
    mixed = F.when(F.col("__apart"), F.array().cast("array<int>")).otherwise(F.concat(F.transform("__in", lambda s: s["start"]), F.transform("__in", lambda s: s["end"])))
    out = out.withColumn("__bounds", F.sort_array(F.array_distinct(mixed)))
    inside, bounds = F.col("__in"), F.col("__bounds")
    out = out.withColumn("__cells", F.zip_with(bounds, F.slice(bounds, F.lit(2), F.size(bounds)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))

    def painted(c: Column) -> Column:
        over = F.filter(inside, lambda s: (s["start"] <= c["a"]) & (s["end"] >= c["b"]))
        best = F.array_max(F.transform(over, lambda s: F.struct(rank_of(s["type"], priority).alias("r"), s["type"].alias("t"))))
        return at(c["a"], c["b"], best["t"])

    out = out.withColumn("__cells", F.filter(F.transform(F.filter("__cells", lambda c: c["b"].isNotNull()), painted), lambda c: c["t"].isNotNull()))

    def join(acc: Column, c: Column) -> Column:
        last = F.element_at(acc, -1)
        touches = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["b"] == c["a"]) & (F.try_element_at(acc, F.lit(-1))["t"] == c["t"])
        if apart:
            touches = touches & ~(c["t"].isin(*apart) & F.exists(inside, lambda s: (s["type"] == c["t"]) & (s["start"] == c["a"])))
        return F.when(touches, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(at(last["a"], c["b"], c["t"])))).otherwise(F.concat(acc, F.array(c)))

    out = out.withColumn("__runs", F.when(F.col("__apart"), own).otherwise(F.aggregate("__cells", F.array().cast("array<struct<a:int,b:int,t:string>>"), join)))

    def lines(r: Column) -> Column:
        return let(F.substr(text, r["a"] + 1, r["b"] - r["a"]), lambda t: F.when(t.contains("\n"), broken(r, F.split(t, "\n"))).otherwise(F.array(at(r["a"], r["b"], r["t"]))))

    def broken(r: Column, parts: Column) -> Column:
        return F.aggregate(
            parts,
            F.struct(r["a"].alias("at"), F.array().cast("array<struct<a:int,b:int,t:string>>").alias("out")),
            lambda acc, p: F.struct((acc["at"] + F.length(p) + 1).alias("at"), F.concat(acc["out"], F.array(at(acc["at"], acc["at"] + F.length(p), r["t"]))).alias("out")),
        )["out"]

    out = out.withColumn("__runs", F.filter(F.flatten(F.transform("__runs", lines)), lambda r: r["b"] - r["a"] >= 2))

    def entity(r: Column) -> Column:
        own = F.filter(inside, lambda s: (s["type"] == r["t"]) & (s["start"] < r["b"]) & (s["end"] > r["a"]))
        return F.struct(r["t"].alias("type"), F.substr(text, r["a"] + 1, r["b"] - r["a"]).alias("text"), r["a"].alias("start"), r["b"].alias("end"), F.round(F.array_max(F.transform(own, lambda s: s["score"])), 2).alias("score"))

    return out.withColumn("entities", F.transform("__runs", entity)).drop("__in", "__own", "__apart", "__bounds", "__cells", "__runs")


def sweep(spans: list[tuple[int, int, int, float]], breaks: list[int], apart: frozenset[int] = frozenset()) -> list[tuple[int, int, int, float]]:
    """Disjoint runs (start, end, rank, score) of spans (start, end, rank, score) by one pass over their sorted borders.

    The active set is a heap by rank; spans that have ended leave it when they come to its top. So a text costs n log n
    in its spans, however they overlap. Runs end at ``breaks`` (places of line breaks, ascending), and where a span of a rank
    in ``apart`` begins.
    """
    order = sorted(spans)
    begins = {(s[2], s[0]) for s in order if s[2] in apart}
    points = sorted({p for s in order for p in s[:2]})
    active: list[tuple[int, int]] = []
    runs: list[list[int]] = []
    i = 0
    for a, b in zip(points, points[1:]):
        while i < len(order) and order[i][0] <= a:
            heappush(active, (-order[i][2], -order[i][1]))
            i += 1
        while active and -active[0][1] <= a:
            heappop(active)
        if active:
            rank = -active[0][0]
            if runs and runs[-1][1] == a and runs[-1][2] == rank and (rank, a) not in begins:
                runs[-1][1] = b
            else:
                runs.append([a, b, rank])
    pieces = []
    for a, b, rank in runs:
        for k in range(bisect_left(breaks, a), bisect_left(breaks, b)):
            pieces.append((a, breaks[k], rank))
            a = breaks[k] + 1
        pieces.append((a, b, rank))
    # The best score of the spans of its own rank that a run overlaps: a heap a rank, by score.
    own: dict[int, list] = {}
    for s in order:
        own.setdefault(s[2], []).append(s)
    heaps: dict[int, list] = {r: [] for r in own}
    place = dict.fromkeys(own, 0)
    out = []
    for a, b, rank in pieces:
        if b - a < 2:
            continue
        heap, line = heaps[rank], own[rank]
        while place[rank] < len(line) and line[place[rank]][0] < b:
            heappush(heap, (-line[place[rank]][3], line[place[rank]][1]))
            place[rank] += 1
        while heap[0][1] <= a:
            heappop(heap)
        out.append((a, b, rank, -heap[0][0]))
    return out


def fuse(spans: DataFrame, docs: DataFrame, priority=PRIORITY, apart: tuple[str, ...] = ()) -> DataFrame:
    """The same on exploded spans (doc_id, start, end, type, score), for documents with more spans than a row should hold.

    Spans meet their text by doc_id, and a task sweeps over one document's borders at a time; its work is linear in them
    but for the sort. ``fuse_spans`` compares each cell with each span, so a caller hands documents with more than
    ``MANY_SPANS`` over to this form (see ``fuse_any``). Null scores count as 0.
    """
    known = {t: i for i, t in enumerate(priority, 1)}

    def swept(key, left, right):
        import pyarrow as pa

        shape = pa.schema([("doc_id", right.schema.field("doc_id").type), ("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows or right.column("text")[0].as_py() is None:
            return shape.empty_table()
        text = right.column("text")[0].as_py()
        # Types outside of the order are below all, and their names decide among them.
        kinds = sorted(set(left.column("type").to_pylist()), key=lambda t: (known.get(t, 0), t))
        rank = {t: i for i, t in enumerate(kinds)}
        rows = zip(*(left.column(c).to_pylist() for c in ("start", "end", "type", "score")))
        inside = [(max(a, 0), min(b, len(text)), rank[t], s or 0.0) for a, b, t, s in rows]
        found = sweep([s for s in inside if s[0] < s[1]], [m.start() for m in re.finditer("\n", text)], frozenset(rank[t] for t in apart if t in rank))
        a, b, r, s = zip(*found) if found else ((), (), (), ())
        return pa.table([pa.array([key[0].as_py()] * len(a), shape.field(0).type), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array([kinds[i] for i in r], pa.string()), pa.array(s, pa.float64())], schema=shape)

    kind = docs.schema["doc_id"].dataType.simpleString()
    own = spans.where("type is not null").select(F.col("doc_id").alias("of"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "type", F.col("score").cast("double").alias("score"))
    texts = docs.join(spans.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text")
    out = own.groupBy("of").cogroup(texts.groupBy("doc_id")).applyInArrow(swept, f"doc_id {kind}, start int, end int, type string, score double")
    return out.select("doc_id", "type", "start", "end", F.round("score", 2).alias("score"))


#: Spans of a document from which on it is fused by the sweep.
MANY_SPANS = 400


def fuse_any(docs: DataFrame, spans: str = "spans", priority=PRIORITY, many: int = MANY_SPANS) -> DataFrame:
    """``fuse_spans`` for documents (doc_id, text, an array of spans) with up to ``many`` spans, the sweep for the others.

    Both add the same ``entities``; a document takes one way, whatever the others are. doc_id is unique.
    """
    few = fuse_spans(docs.where(F.coalesce(F.size(spans), F.lit(0)) <= many), F.col("text"), spans, priority)
    crowd = docs.where(F.size(spans) > many)
    rows = crowd.select("doc_id", F.explode(spans).alias("s")).select("doc_id", "s.start", "s.end", "s.type", "s.score")
    runs = fuse(rows, crowd, priority).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "type", "score"))).alias("__r"))
    entity = F.transform("__r", lambda r: F.struct(r["type"].alias("type"), F.substr("text", r["start"] + 1, r["end"] - r["start"]).alias("text"), r["start"].alias("start"), r["end"].alias("end"), r["score"].alias("score")))
    swept = crowd.join(runs, "doc_id", "left").withColumn("entities", F.coalesce(entity, F.array().cast(ENTITIES))).drop("__r")
    return few.unionByName(swept.select(*few.columns))
