"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_table


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the ends of ``edges`` (a, b): nodes have equal labels exactly where they are connected.

    Each pass moves every node to the neighbour (or itself) that comes first in the order of the pass, and renames the
    edges. Every second order is drawn anew, which shrinks any graph by a constant factor, so the number of passes grows
    with the logarithm of the nodes; the others begin with the nodes of most edges, which finishes stars at once. Labels are names of nodes, not the smallest of them. Self-loops
    and repeated edges do no harm; an empty edge table gives an empty result; edges with a null end are left out.
    """
    edges = as_table(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "edges")
    labels = None
    turn = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if turn % 2:
            both = both.withColumns({"da": F.lit(0).cast("long"), "db": F.lit(0).cast("long")})
        else:
            degree = as_table(both.groupBy("a").agg((-F.count("*")).alias("d")), "degrees")
            both = both.join(degree.select("a", F.col("d").alias("da")), "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("db")), "b")
        rank = lambda c: F.struct(F.col(f"d{c}").alias("d"), F.xxhash64(c, F.lit(turn)).alias("o"), F.col(c).alias("n"))  # noqa: E731, B023
        moved = both.groupBy("a", "da").agg(F.min(rank("b")).alias("best")).select("a", F.least("best", rank("a"))["n"].alias("to"))
        moved = as_table(moved, "moved")
        if labels is None:
            labels = moved.select(F.col("a").alias("node"), F.col("to").alias("label"))
        else:
            step = moved.withColumnRenamed("a", "label")
            labels = as_table(labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        edges = edges.join(moved, "a").select(F.col("to").alias("u"), "b")
        edges = edges.join(moved.select(F.col("a").alias("b"), "to"), "b").select(F.col("u").alias("a"), F.col("to").alias("b"))
        edges = as_table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        turn += 1
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
