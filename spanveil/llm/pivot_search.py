"""Exact top-k inner products by pivot-table elimination.

Vectors are integers, floor(scale * x). Of every vector the distances to a few pivots are computed once (the pivot
table). For a query q and a row x every pivot p gives |d(q, p) - d(x, p)| <= d(q, x), and the largest of these bounds
gives an upper bound of the inner product, (|q|^2 + |x|^2 - bound^2) / 2. Candidates are scored exactly in the order of
that bound until the k-th best score so far is above the bound of all that are left; ties keep going.

The pivot table is written once, beside the vectors. Before any block is searched, every query is scored against the
sample that the pivots were chosen from: its k-th best score there is a lower bound of its k-th best of all, so a block
in which no row's upper bound reaches it costs no scoring at all.

Queries and rows are dealt into blocks; a task scores one block of queries against one block of rows, so every query
meets every row once and no task holds more than two blocks. The best k of each block are merged by rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import as_table

#: Vectors of a block of rows and of a block of queries.
ROW_BLOCK, QUERY_BLOCK = 8192, 2048
#: Pivots: the vectors with the smallest hash, taken farthest first from this bounded sample.
PIVOTS, PIVOT_SAMPLE = 32, 2000
#: Rows scored between two looks at the stopping rule.
STEP = 256


def _pivots(sample: np.ndarray, many: int) -> np.ndarray:
    """Farthest-first choice."""
    if not len(sample):
        return sample
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(many, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to the pivots; x and pivots hold integers that float64 holds exactly."""
    square = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def best_of_block(qid, q, q_to_pivots, floor, xid, x, x_to_pivots, k: int) -> tuple[list, list, list]:
    """For each query its k best rows of the block (score, then smaller id), itself excluded; none below its floor."""
    order = np.argsort(xid, kind="stable")
    xid, x, x_to_pivots = xid[order], x[order], x_to_pivots[order]
    square = (x**2).sum(1)
    out_q, out_x, out_s = [], [], []
    for one, v, pd_, low in zip(qid, q, q_to_pivots, floor):
        bound = np.abs(x_to_pivots - pd_).max(1)
        # A hair above the rounding error of the square roots keeps the bound safe.
        upper = (square + (v**2).sum() - np.maximum(bound * (1 - 1e-9) - 1e-6, 0) ** 2) / 2 + 1e-3
        live = np.flatnonzero(upper >= low)
        rank = live[np.argsort(-upper[live], kind="stable")]
        best_s, best_i = np.zeros(0, np.float64), np.zeros(0, np.int64)
        for a in range(0, len(rank), STEP):
            part = rank[a : a + STEP]
            if len(best_s) == k and best_s[-1] > upper[part[0]]:
                break
            part = part[xid[part] != one]
            s, i = np.r_[best_s, x[part] @ v], np.r_[best_i, xid[part]]
            top = np.lexsort((i, -s))[:k]
            best_s, best_i = s[top], i[top]
        out_q += [one] * len(best_s)
        out_x += best_i.tolist()
        out_s += best_s.astype(np.int64).tolist()
    return out_q, out_x, out_s


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _measured(pivots: np.ndarray):
    def measured(frames):
        for f in frames:
            if len(f):
                yield f.assign(d=list(_distances(_matrix(f["v"]), pivots)))

    return measured


def _floors(ids: np.ndarray, sample: np.ndarray, k: int):
    """Add to queries the k-th best score among the sample's rows but the query's own; minus infinity with fewer."""

    def floors(frames):
        for f in frames:
            if len(f):
                scores = _matrix(f["v"]) @ sample.T
                scores[f["vec_id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
                low = np.partition(scores, -k, 1)[:, -k] if scores.shape[1] >= k else np.full(len(f), -np.inf)
                yield f.assign(floor=low)

    return floors


def _search(k: int):
    def search(left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        a, b, s = best_of_block(left["vec_id"].to_numpy(), _matrix(left["v"]), _matrix(left["d"]), left["floor"].to_numpy(), right["vec_id"].to_numpy(), _matrix(right["v"]), _matrix(right["d"]), k)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    return search


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """The k rows with the largest integer inner product for each query row.

    Queries are rows whose vec_id is divisible by ``every``; candidates are all other rows. A component x counts as
    floor(scale * x). Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id; fewer than k
    candidates give fewer rows. Vectors that are null, or hold a null or non-finite component, and rows without
    vec_id take no part; vectors of another length than the query's are no candidates. Repeated rows of a vec_id are
    candidates each, and each query once. Scores are exact while they stay below 2**53.
    """
    spark = vectors.sparkSession
    wide = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), wide.alias("v")).where("vec_id is not null and v is not null and size(v) > 0").where(fine)
    rows = as_table(rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"), F.size("v").alias("dim")), "vectors")
    found = None
    for dim, n in sorted((r["dim"], r["count"]) for r in rows.groupBy("dim").count().collect()):
        own = rows.where(F.col("dim") == dim)
        sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("vec_id", "v").collect()
        ids, points = np.array([r["vec_id"] for r in sample]), np.array([r["v"] for r in sample], np.float64)
        table = "vec_id long, v array<double>, d array<double>"
        own = as_table(own.select("vec_id", "v").mapInPandas(_measured(_pivots(points, PIVOTS)), table), "pivot_table")
        row_blocks, query_blocks = n // ROW_BLOCK + 1, n // every // QUERY_BLOCK + 1
        in_block = lambda m, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(m)).cast("int")
        pair = lambda q, x: (q.cast("long") * row_blocks + x).alias("pair")  # noqa: E731, B023
        queries = own.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).mapInPandas(_floors(ids, points, k), f"{table}, floor double")
        copies = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        left = queries.select("*", in_block(query_blocks, 1).alias("q"), copies(row_blocks).alias("x")).select(pair(F.col("q"), F.col("x")), "vec_id", "v", "d", "floor")
        right = own.select("*", in_block(row_blocks, 2).alias("x"), copies(query_blocks).alias("q")).select(pair(F.col("q"), F.col("x")), "vec_id", "v", "d")
        part = left.groupBy("pair").cogroup(right.groupBy("pair")).applyInPandas(_search(k), "query_id long, vec_id long, score long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
