"""Counts of distinct values and comparisons of runs by sketches that can be kept and united (A-2, A-11).

A sketch is a few kilobytes, however many values it has seen. Those of parts, such as days and sessions, united are the
sketch of the whole, so a table of sketches answers for any set of days without reading an entity again. With the
sizes below a count is off by 1.6 % (HLL) and a comparison by 0.8 % of the union (theta), one standard error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import value_key

#: Binary logarithms of the sizes of both kinds of sketch.
HLL_SIZE, THETA_SIZE = 12, 14


def value_sketches(entities: DataFrame, *by: str) -> DataFrame:
    """Per ``by`` columns and type: n (entities), hll and theta (sketches of the distinct values); entities have type and text."""
    value = entities.where("text is not null").withColumn("__v", value_key(F.col("text")))
    return value.groupBy(*by, "type").agg(F.count("*").alias("n"), F.hll_sketch_agg("__v", F.lit(HLL_SIZE)).alias("hll"), F.theta_sketch_agg("__v", F.lit(THETA_SIZE)).alias("theta"))


def united(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches of parts as those of the ``by`` columns and type."""
    theta = F.theta_union_agg("theta", F.lit(THETA_SIZE)).alias("theta")
    return sketches.groupBy(*by, "type").agg(F.sum("n").alias("n"), F.hll_union_agg("hll").alias("hll"), theta)


def distinct_estimates(sketches: DataFrame, *by: str) -> DataFrame:
    """A-2: the ``by`` columns, type, n, n_values: the distinct values of all parts together."""
    return united(sketches, *by).select(*by, "type", "n", F.hll_sketch_estimate("hll").alias("n_values"))


def compared_estimates(new: DataFrame, old: DataFrame) -> DataFrame:
    """A-11: per type how many distinct values only the new run has, only the old one, and both, from the sketches of two runs."""
    a = united(new).select("type", F.col("theta").alias("a"))
    b = united(old).select("type", F.col("theta").alias("b"))
    count = lambda c: F.coalesce(F.theta_sketch_estimate(c), F.lit(0))
    both = a.join(b, "type", "full_outer")
    one = lambda x, y: F.when(F.col(y).isNull(), F.theta_sketch_estimate(F.col(x))).otherwise(count(F.theta_difference(F.col(x), F.col(y))))
    only = lambda x, y: F.when(F.col(x).isNull(), F.lit(0)).otherwise(one(x, y)).cast("long")
    shared = F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(0)).otherwise(count(F.theta_intersection("a", "b"))).cast("long")
    return both.select("type", only("a", "b").alias("only_new"), only("b", "a").alias("only_old"), shared.alias("both"))
