"""Assignment of documents to shards of near-equal bytes by a k-d tree.

Documents with equal texts are one group and stay together, so the tree splits groups. Its dimensions are metadata
of a group: its first doc_id, and the places of its smallest source and lang in the order of their bytes (the six bytes
behind what all values begin with; values that these do not part are one value, and a node of one value is cut along
another dimension or by hash). (Length is no
dimension: a leaf of long documents only could not be filled evenly.) A node that stands for m shards is cut along its widest dimension at the weighted quantile m // 2 over m.
The quantile is found by histograms of all nodes at once: each round counts bytes by (node, bin) on the executors and
narrows the range to the bin that holds the quantile, until that bin is lighter than the tolerance or holds one
value; groups of one value are then cut by a hash in the same way. Only histograms (bins times nodes) reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import as_table, shuffle_width

BINS = 1024
#: Rows of a group from which it is looked up by broadcast; and how many such groups are broadcast at most.
HOT_ROWS, BROADCAST_ROWS = 100_000, 1_000_000
#: A cut may be off by this share of a leaf's bytes.
TOLERANCE = 0.002
_DIMS = ("x0", "x1", "x2")
#: A hash of the group, in which groups of one value are cut.
_TIE = "x3"
_SPAN = 1 << 40


def _spans(nodes: dict, groups: DataFrame) -> tuple[dict[int, dict[str, tuple[int, int]]], dict[int, int]]:
    """For each splitting node the least and greatest value of each dimension, and its bytes."""
    aggs = [f(d).alias(f"{n}_{d}") for d in _DIMS for n, f in (("lo", F.min), ("hi", F.max))]
    rows = groups.where(F.col("node").isin(sorted(nodes))).groupBy("node").agg(F.sum("bytes").alias("w"), *aggs).collect()
    return {r["node"]: {d: (r[f"lo_{d}"], r[f"hi_{d}"]) for d in _DIMS} for r in rows}, {r["node"]: r["w"] for r in rows}


def _lookup(values: dict[int, object], kind: str) -> Column:
    """The value of a row's node."""
    return F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*[F.lit(v).cast(kind) for v in values.values()]))[F.col("node")]


def _cuts(groups: DataFrame, ranges: dict[int, tuple[str, int, int]], goals: dict[int, float], slack: dict[int, float]) -> dict[int, int]:
    """For each node the value v with about the goal's bytes among the groups whose coordinate is at most v."""
    coordinate = F.lit(None).cast("long")
    for d in (*_DIMS, _TIE):
        own = [n for n, (x, _, _) in ranges.items() if x == d]
        if own:
            coordinate = F.when(F.col("node").isin(own), F.col(d)).otherwise(coordinate)
    todo = {n: [lo, hi, 0.0] for n, (_, lo, hi) in ranges.items()}  # range still open, bytes below it
    cut: dict[int, int] = {}
    while todo:
        low, width = {n: t[0] for n, t in todo.items()}, {n: max(1, -(-(t[1] - t[0] + 1) // BINS)) for n, t in todo.items()}
        high = {n: t[1] for n, t in todo.items()}
        at = groups.where(F.col("node").isin(sorted(todo))).select("node", coordinate.alias("v"), "bytes")
        at = at.where((F.col("v") >= _lookup(low, "long")) & (F.col("v") <= _lookup(high, "long")))
        at = at.select("node", "v", "bytes", _lookup(low, "long").alias("low"), _lookup(width, "long").alias("width"))
        rows = at.groupBy("node", F.expr("(v - low) div width").alias("bin")).agg(F.sum("bytes").alias("w")).collect()
        for n in list(todo):
            lo, hi, below = todo[n]
            for b, w in sorted((r["bin"], r["w"]) for r in rows if r["node"] == n):
                end = min(hi, lo + (b + 1) * width[n] - 1)
                if below + w >= goals[n]:
                    if width[n] == 1 or w <= slack[n]:
                        cut[n] = end if below + w - goals[n] <= goals[n] - below else lo + b * width[n] - 1
                        del todo[n]
                    else:
                        todo[n] = [lo + b * width[n], end, below]
                    break
                below += w
            else:
                cut[n] = hi
                todo.pop(n, None)
    return cut


def _shared_start(values: list) -> int:
    """The number of characters that the least and the greatest value, and so all between them, begin with."""
    low, high = (v or "" for v in values)
    same = 0
    while same < min(len(low), len(high)) and low[same] == high[same]:
        same += 1
    return same


def _place(c: str, start: int) -> Column:
    """The six bytes behind the first ``start`` characters as a number; 0 for null."""
    digits = F.rpad(F.substring(F.hex(F.encode(F.substr(F.coalesce(F.col(c), F.lit("")), F.lit(start + 1)), "UTF-8")), 1, 12), 12, "0")
    return F.coalesce(F.conv(digits, 16, 10).cast("long"), F.lit(0))


def shard_by_tree(docs: DataFrame, shards: int = 40, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Assign every row of ``docs`` to one of ``shards`` shards of near-equal bytes (law ``bytes``).

    Returns one row per row of ``docs``: doc_id, size (UTF-8 bytes of the text, none where it is null, plus 16),
    text_crc32, law, shard, slot (gapless from 0 in a shard, by hash cell and doc_id) and grown_shard (null under this
    law). Equal texts share a shard; null and empty texts are two groups of their own. A group heavier than a shard's
    share cannot be cut and makes its shard heavier. ``source`` and ``lang`` may be null or absent. Rows with equal
    or null doc_id are kept, in any order among themselves. Other columns are ignored; an empty table gives no rows.
    """
    text = F.col("text").cast("string")
    extra = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("source", "lang")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("g"), *extra)
    rows = as_table(rows, "rows")

    groups = rows.groupBy("g").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("doc_id").alias("first"), F.min("source").alias("source"), F.min("lang").alias("lang"))
    ends = rows.agg(*[f(c) for c in ("source", "lang") for f in (F.min, F.max)]).first()
    tie = F.conv(F.substring(F.md5("g"), 1, 10), 16, 10).cast("long")
    groups = groups.select("g", "bytes", "n", F.coalesce("first", F.lit(-1)).alias("x0"), _place("source", _shared_start(ends[:2])).alias("x1"), _place("lang", _shared_start(ends[2:])).alias("x2"), tie.alias("x3"))
    groups = as_table(groups, "groups")

    total = groups.agg(F.sum("bytes")).first()[0] or 0
    nodes: dict[int, tuple[int, int]] = {0: (0, shards)}  # node: its first shard, its number of shards
    placed = groups.withColumn("node", F.lit(0))
    root, serial = None, 0
    while total and any(m > 1 for _, m in nodes.values()):
        placed = as_table(placed, "placed")
        split = {n: x for n, x in nodes.items() if x[1] > 1}
        spans, sums = _spans(split, placed)
        root = root or {d: max(1, hi - lo) for d, (lo, hi) in spans[0].items()}
        split = {n: x for n, x in split.items() if n in sums}
        goals = {n: sums[n] * (m // 2) / m for n, (_, m) in split.items()}
        slack = {n: TOLERANCE * sums[n] / m for n, (_, m) in split.items()}
        widest = {n: max(_DIMS, key=lambda d: (spans[n][d][1] - spans[n][d][0]) / root[d]) for n in split}  # noqa: B023
        cut = _cuts(placed, {n: (widest[n], *spans[n][widest[n]]) for n in split}, goals, slack)
        side = F.lit(False)
        for n in split:
            side = F.when(F.col("node") == n, F.col(widest[n]) <= F.lit(cut[n])).otherwise(side)
        # Groups that share the value at the cut go to one side; where that is too uneven, they are cut by their hash.
        got = {r["node"]: r["w"] for r in placed.where(F.col("node").isin(sorted(split))).where(side).groupBy("node").agg(F.sum("bytes").alias("w")).collect()}
        uneven = {n: cut[n] + (0 if got.get(n, 0) >= goals[n] else 1) for n in split if abs(got.get(n, 0) - goals[n]) > max(slack[n], 1)}
        if uneven:
            edge = F.lit(False)
            for n, v in uneven.items():
                edge = F.when(F.col("node") == n, F.col(widest[n]) == F.lit(v)).otherwise(edge)
            ties = placed.where(F.col("node").isin(sorted(uneven))).where(edge)
            under = {r["node"]: r["w"] for r in placed.where(F.col("node").isin(sorted(uneven))).where(_below(widest, uneven)).groupBy("node").agg(F.sum("bytes").alias("w")).collect()}
            on = {r["node"] for r in ties.select("node").distinct().collect()}
            uneven = {n: v for n, v in uneven.items() if n in on}
            fine = _cuts(ties, {n: (_TIE, 0, _SPAN - 1) for n in uneven}, {n: goals[n] - under.get(n, 0) for n in uneven}, slack) if uneven else {}
            for n, v in uneven.items():
                side = F.when((F.col("node") == n), (F.col(widest[n]) < v) | ((F.col(widest[n]) == v) & (F.col(_TIE) <= F.lit(fine[n])))).otherwise(side)
        kids, left, right = {}, {}, {}
        for n, (first, m) in nodes.items():
            if n in split:
                left[n], right[n] = serial + 1, serial + 2
                serial += 2
                kids[left[n]], kids[right[n]] = (first, m // 2), (first + m // 2, m - m // 2)
            else:
                kids[n] = (first, 1)
        moved = F.when(side, _lookup(left, "int")).otherwise(_lookup(right, "int"))
        placed = placed.withColumn("node", F.when(F.col("node").isin(sorted(split)), moved).otherwise(F.col("node")))
        nodes = kids
    shard = _lookup({n: first for n, (first, _) in nodes.items()}, "int")
    assigned = placed.select("g", shard.alias("shard"), "n")
    # Groups of very many rows are looked up where the rows are; there are at most the rows over ``hot_rows`` of them.
    hot = as_table(assigned.where(F.col("n") > hot_rows).select("g", F.col("shard").alias("hot")), "hot")
    dealt = rows.withColumn("hot", F.lit(None).cast("int"))
    if not hot.isEmpty():
        dealt = rows.join(F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot, "g", "left")
    cold = dealt.where("hot is null").drop("hot").join(assigned.where(F.col("n") <= hot_rows).select("g", "shard"), "g")
    out = cold.unionByName(dealt.where("hot is not null").withColumnRenamed("hot", "shard")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard")
    return _numbered(out).withColumn("grown_shard", F.lit(None).cast("int"))


def _below(dims: dict[int, str], values: dict[int, int]) -> Column:
    out = F.lit(False)
    for n, v in values.items():
        out = F.when(F.col("node") == n, F.col(dims[n]) < F.lit(v)).otherwise(out)
    return out


def _numbered(rows: DataFrame) -> DataFrame:
    """Add ``slot``: 0, 1, ... in each shard. Cells of a shard are numbered apart and then shifted by the cells before."""
    from pyspark.sql import Window

    cells = shuffle_width(rows.sparkSession) * 2
    rows = as_table(rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(cells)).cast("int")), "cells")
    counts = rows.groupBy("shard", "cell").count()
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("shard", "cell", F.coalesce("before", F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32"))
    out = rows.withColumn("rn", inside).join(before, ["shard", "cell"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("rn") - 1 + F.col("before")).cast("long").alias("slot"))
