"""Approximate nearest neighbours by randomly rotated one-bit codes with error bounds.

Vectors are brought to length 1. Each is coded against the nearest centre of its cell: the difference, turned by a random
rotation into at least as many dimensions, leaves one bit a dimension, its length, and the share of it that the bits
point at. From these an inner product with any query follows up to an error whose size is known, so a query's cosine
with a row lies between two bounds, but for rare cases (``ERRORS`` standard errors).

Centres are fitted on a bounded sample; every row is indexed. Rows are dealt into blocks by cell, and cells with many
rows into several blocks, so no task holds more than a block of rows and a block of queries. A query begins with its k-th
best cosine in the sample and visits only the blocks whose distances from the centre can reach it. In a block, rows whose
upper bound reaches the k-th greatest lower bound are compared with the original vectors, in the order of the upper
bounds, until the k-th best is above all that are left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import as_table

#: Bits of a code, at least; more where vectors are longer.
BITS = 256
#: Standard errors that an estimate may be off.
ERRORS = 3.0
#: Rows that the centres are fitted on (the smallest hashes), rows a centre at least, and centres at most.
SAMPLE, ROWS_A_CENTRE, CENTRES = 4096, 16, 256
#: Rows of a cell, on average, while there are fewer than the most centres; rows and queries of a block.
CELL_ROWS, ROW_BLOCK, QUERY_BLOCK = 4096, 8192, 4096
#: Queries estimated at one time, and rows compared between two looks at the stopping rule.
TILE, STEP = 256, 128

_ROTATIONS: dict[tuple[int, int], np.ndarray] = {}


def rotation(dim: int, seed: int) -> np.ndarray:
    """Orthonormal columns: the random rotation of vectors of ``dim`` components into the dimensions of a code."""
    if (dim, seed) not in _ROTATIONS:
        bits = 64 * -(-max(BITS, dim) // 64)
        _ROTATIONS[dim, seed] = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(bits, dim)))[0]
    return _ROTATIONS[dim, seed]


def encode(units: np.ndarray, centre: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(packed bits, length of the difference, share that the bits point at, inner product with the centre) of unit vectors."""
    apart = units - centre
    length = np.sqrt((apart**2).sum(1))
    turned = apart @ rotation(units.shape[1], seed).T / np.where(length > 0, length, 1)[:, None]
    share = np.where(length > 0, np.abs(turned).sum(1) / np.sqrt(turned.shape[1]), 1.0)
    return np.packbits(turned >= 0, axis=1), length, share, (units * centre).sum(1)


def estimates(queries: np.ndarray, centre: np.ndarray, bits: np.ndarray, length: np.ndarray, share: np.ndarray, along: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of unit queries (rows) with coded vectors (columns), and what one standard error of each is."""
    apart = queries - centre
    turned = (apart @ rotation(queries.shape[1], seed).T).astype(np.float32)
    n = turned.shape[1]
    signs = np.unpackbits(bits, axis=1)[:, :n].astype(np.float32) * 2 - 1
    inner = turned @ signs.T * (length / share / np.sqrt(n)).astype(np.float32)
    spread = length * np.sqrt(np.maximum(1 - share**2, 0) / (n - 1)) / share
    base = (queries * centre).sum(1)[:, None] + (along - (centre**2).sum())[None, :]
    # Beside the code's error, that of single precision.
    return inner + base, np.sqrt((apart**2).sum(1))[:, None] * spread[None, :] + 1e-6


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _units(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled by a power of two before, so that squares stay finite."""
    x = scaled(x)
    return x / np.sqrt((x**2).sum(1))[:, None]


def scaled(x: np.ndarray) -> np.ndarray:
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of the rows of ``x`` with ``q``, both scaled; a row's sum does not depend on the rows beside it."""
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def _fit(units: np.ndarray, many: int, seed: int) -> np.ndarray:
    """Centres by a few rounds of k-means, in a chain of near ones."""
    centres = units[np.random.default_rng(seed).permutation(len(units))[:many]]
    for _ in range(8):
        near = (units @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        centres = np.stack([units[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
    order, left = [0], set(range(1, len(centres)))
    while left:
        order.append(min(left, key=lambda c: (((centres[c] - centres[order[-1]]) ** 2).sum(), c)))  # noqa: B023
        left.discard(order[-1])
    return centres[order]


class _Model:
    """Centres by length of vectors; a length that is not in the sample has one centre at the origin."""

    def __init__(self, ids: np.ndarray, sample: list[np.ndarray], rows: int, seed: int):
        self.seed, self.ids, self.vectors, self.centres = seed, {}, {}, {}
        for dim in sorted({len(v) for v in sample}):
            own = [i for i, v in enumerate(sample) if len(v) == dim]
            units = _units(np.stack([sample[i] for i in own]))
            many = max(1, min(CENTRES, len(own) // ROWS_A_CENTRE, 1 + rows // CELL_ROWS))
            self.ids[dim], self.vectors[dim], self.centres[dim] = ids[own], units, _fit(units, many, seed)

    def of(self, dim: int) -> np.ndarray:
        return self.centres.get(dim, np.zeros((1, dim)))

    def near(self, units: np.ndarray) -> np.ndarray:
        centres = self.of(units.shape[1])
        return (units @ centres.T - (centres**2).sum(1) / 2).argmax(1)

    def floors(self, ids: np.ndarray, units: np.ndarray, k: int) -> np.ndarray:
        """The k-th best cosine in the sample, the query's own rows left out."""
        dim = units.shape[1]
        if len(self.ids.get(dim, ())) < k:
            return np.full(len(units), -np.inf)
        cos = units @ self.vectors[dim].T
        cos[ids[:, None] == self.ids[dim][None, :]] = -np.inf
        return np.partition(cos, -k, 1)[:, -k] - 1e-9


_INDEX = "vec_id long, v array<double>, dim int, cell int, bits binary, length double, share double, along double"


def _index(model: _Model):
    def index(frames):
        for f in frames:
            for dim, own in f.groupby(f["v"].map(len)):
                x = _matrix(own["v"])
                units = _units(x)
                cell = model.near(units)
                bits, length, share, along = [None] * len(own), np.zeros(len(own)), np.zeros(len(own)), np.zeros(len(own))
                for c in np.unique(cell):
                    at = np.flatnonzero(cell == c)
                    packed, length[at], share[at], along[at] = encode(units[at], model.of(dim)[c], model.seed)
                    for i, row in zip(at, packed):
                        bits[i] = row.tobytes()
                yield pd.DataFrame({"vec_id": own["vec_id"], "v": list(x), "dim": dim, "cell": cell, "bits": bits, "length": length, "share": share, "along": along})

    return index


def _ask(model: _Model, cells: dict[tuple, tuple], k: int):
    """Queries with their block, their floor, and the cells that can hold one of their k best."""

    def ask(frames):
        for f in frames:
            for dim, own in f.groupby(f["v"].map(len)):
                units, ids = _units(_matrix(own["v"])), own["vec_id"].to_numpy()
                centres, floor, near = model.of(dim), model.floors(ids, units, k), model.near(units)
                apart = np.sqrt(np.maximum(((units[:, None, :] - centres[None, :, :]) ** 2).sum(2), 0))
                known = [cells.get((dim if dim in model.centres else -1, c), (0, 0.0, 0.0)) for c in range(len(centres))]
                least, most = np.array([x[1] for x in known]), np.array([x[2] for x in known])
                gap = np.maximum(0, np.maximum(apart - most - 1e-9, least - apart - 1e-9))
                reach = (1 - gap**2 / 2 >= floor[:, None] - 1e-9) & (np.array([x[0] for x in known]) > 0)
                yield pd.DataFrame({"vec_id": ids, "v": own["v"], "dim": dim, "near": near, "floor": floor, "cells": [np.flatnonzero(r).astype(np.int32) for r in reach]})

    return ask


def search_block(ids, vectors, floors, rows: pd.DataFrame, centre: np.ndarray, seed: int, k: int, errors: float) -> tuple[list, list, list]:
    """For each query its k best rows of a block (cosine, then smaller id); rows with the query's own id take no part."""
    rows = rows.sort_values("vec_id", kind="stable")
    own, x = rows["vec_id"].to_numpy(), scaled(_matrix(rows["v"]))
    bits = np.frombuffer(b"".join(rows["bits"]), np.uint8).reshape(len(rows), -1)
    length, share, along = (rows[c].to_numpy() for c in ("length", "share", "along"))
    q, units = scaled(vectors), _units(vectors)
    out_q, out_x, out_s = [], [], []
    for a in range(0, len(ids), TILE):
        about, error = estimates(units[a : a + TILE], centre, bits, length, share, along, seed)
        high, low = about + errors * error, about - errors * error
        same = ids[a : a + TILE, None] == own[None, :]
        high[same], low[same] = -np.inf, -np.inf
        least = np.partition(low, -k, 1)[:, -k] if low.shape[1] >= k else np.full(len(low), -np.inf)
        least = np.maximum(np.maximum(least, floors[a : a + TILE]), -2)
        for i in range(len(high)):
            live = np.flatnonzero(high[i] >= least[i])
            live = live[np.argsort(-high[i][live], kind="stable")]
            best_s, best_i = np.zeros(0), np.zeros(0, np.int64)
            for b in range(0, len(live), STEP):
                part = live[b : b + STEP]
                if len(best_s) == k and best_s[-1] > high[i][part[0]]:
                    break
                s, j = np.r_[best_s, cosines(x[part], q[a + i])], np.r_[best_i, own[part]]
                top = np.lexsort((j, -s))[:k]
                best_s, best_i = s[top], j[top]
            out_q += [ids[a + i]] * len(best_s)
            out_x += best_i.tolist()
            out_s += best_s.tolist()
    return out_q, out_x, out_s


def _search(model: _Model, k: int, errors: float):
    def search(key, left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        centre = model.of(int(key[1]))[int(key[2])]
        a, b, s = search_block(left["vec_id"].to_numpy(), _matrix(left["v"]), left["floor"].to_numpy(), right, centre, model.seed, k, errors)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    return search


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, errors: float = ERRORS, seed: int = 7) -> DataFrame:
    """The k rows found nearest to each query row by cosine: query_id, rank (from 1), vec_id, score.

    Queries are rows whose vec_id is divisible by ``every``; candidates are all rows with another vec_id. Scores are
    cosines in double precision on the original vectors; ties go to the smaller vec_id; fewer than k candidates give
    fewer rows. Vectors that are null or zero, or hold a null or non-finite component, and rows without vec_id take no
    part; vectors of another length than the query's are no candidates. Repeated rows of a vec_id are candidates each;
    a vec_id with several vectors asks with the least of them. Other columns are ignored; an empty table gives an
    empty result.
    """
    spark = vectors.sparkSession
    wide = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), wide.alias("v")).where("vec_id is not null and v is not null and size(v) > 0").where(fine)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()
    model = _Model(np.array([r["vec_id"] for r in sample], np.int64), [np.array(r["v"], np.float64) for r in sample], rows.count(), seed)
    index = as_table(rows.mapInPandas(_index(model), _INDEX), "rotated_codes")

    # Of each cell its rows, its queries, and how far rows are from the centre; lengths outside of the sample are one entry.
    known = F.when(F.col("dim").isin(*model.centres), F.col("dim")).otherwise(-1).alias("dim") if model.centres else F.lit(-1).alias("dim")
    asks = F.col("vec_id") % every == 0
    counted = index.groupBy(known, "cell").agg(F.count("*").alias("n"), F.count_if(asks).alias("q"), F.min("length").alias("least"), F.max("length").alias("most")).collect()
    cells = {(r["dim"], r["cell"]): (r["n"] // ROW_BLOCK + 1, r["least"], r["most"]) for r in counted}
    # Neighbouring cells share a block of queries, and cells with many queries have several.
    blocks, taken, first = {}, 0, 0
    for r in sorted(counted, key=lambda r: (r["dim"], r["cell"])):
        if taken + r["q"] > QUERY_BLOCK:
            first, taken = first + 1, 0
        many = r["q"] // QUERY_BLOCK + 1
        blocks[r["dim"], r["cell"]] = (first, many)
        first, taken = (first + many, 0) if many > 1 else (first, taken + r["q"])

    def looked_up(table: dict, part: int, cell: str):
        """An entry of a cell, for rows with ``dim`` and ``cell``."""
        entries = [x for key, v in table.items() for x in (F.lit(f"{key[0]},{key[1]}"), F.lit(int(v[part])))]
        name = lambda d: F.concat(d, F.lit(","), F.col(cell).cast("string"))
        if not entries:
            return F.lit(1)
        held = F.create_map(*entries)
        return F.coalesce(F.element_at(held, name(F.col("dim").cast("string"))), F.element_at(held, name(F.lit("-1"))), F.lit(1))

    into = lambda many, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), many).cast("int")
    asked = "vec_id long, v array<double>, dim int, near int, floor double, cells array<int>"
    queries = index.where(asks).groupBy("vec_id").agg(F.min("v").alias("v")).mapInPandas(_ask(model, cells, k), asked)
    queries = queries.withColumn("block", looked_up(blocks, 0, "near") + into(looked_up(blocks, 1, "near"), 1))
    queries = as_table(queries, "rotated_queries")
    pairs = as_table(queries.select("block", "dim", F.explode("cells").alias("cell")).distinct(), "rotated_pairs")
    left = queries.select("block", "dim", "vec_id", "v", "floor", F.explode("cells").alias("cell"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), looked_up(cells, 0, "cell") - 1)))
    right = index.withColumn("part", into(looked_up(cells, 0, "cell"), 2)).join(pairs, ["dim", "cell"])
    key = ["block", "dim", "cell", "part"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_search(model, k, errors), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
