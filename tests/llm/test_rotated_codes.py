"""Rotated one-bit codes: found neighbours against all cosines, estimates against their error bounds, defined results."""

import numpy as np
import pytest

from spanveil.llm import rotated_codes

SHAPE = "vec_id long, embedding array<double>, cell int, bits string"


def frame(spark, rows):
    return spark.createDataFrame([(int(i), None if v is None else [None if x is None else float(x) for x in v], 1, "b") for i, v in rows], SHAPE)


def brute(rows, k=5, every=50):
    """Each query's k greatest cosines by comparing it with every row."""
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = lambda v: v / abs(v).max() / np.sqrt(((v / abs(v).max()) ** 2).sum())
    out = {}
    for i, q in rows:
        if i % every == 0:
            near = sorted((-float(unit(q) @ unit(v)), j) for j, v in rows if j != i and len(v) == len(q))[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def found(df, **options):
    out = {}
    for r in sorted(rotated_codes.nearest(df, **options).collect(), key=lambda r: (r["query_id"], r["rank"])):
        own = out.setdefault(r["query_id"], [])
        assert r["rank"] == len(own) + 1
        own.append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("kind", ["plain", "clusters", "one_cluster"])
def test_recall(spark, kind):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(1500, 48))
    if kind == "clusters":
        x = 0.3 * x + draw.normal(size=(12, 48))[draw.integers(0, 12, 1500)]
    if kind == "one_cluster":
        x[500:] = 0.02 * x[500:] + x[0]
    rows = list(enumerate(x))
    got, want = found(frame(spark, rows)), brute(rows)
    assert set(got) == set(want)
    hits = sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want)
    assert hits >= 0.97 * sum(map(len, want.values()))
    for i in got:
        exact = dict(brute([rows[i], *[rows[j] for j, _ in got[i]]])[i])
        assert all(abs(s - exact[j]) < 1e-12 for j, s in got[i])
        assert [s for _, s in got[i]] == sorted((s for _, s in got[i]), reverse=True)


def test_few_cells_and_blocks_are_pruned_without_loss(spark, monkeypatch):
    for name, value in (("CELL_ROWS", 40), ("ROW_BLOCK", 50), ("QUERY_BLOCK", 4)):
        monkeypatch.setattr(rotated_codes, name, value)
    draw = np.random.default_rng(9)
    x = 0.1 * draw.normal(size=(900, 16)) + draw.normal(size=(9, 16))[draw.integers(0, 9, 900)]
    rows = list(enumerate(x))
    got, want = found(frame(spark, rows), every=10), brute(rows, every=10)
    hits = sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want)
    assert set(got) == set(want) and hits >= 0.97 * 5 * len(want)


def test_errors_of_estimates():
    draw = np.random.default_rng(1)
    x, q, centre = (rotated_codes._units(draw.normal(size=(n, 64))) for n in (4000, 50, 1))
    about, error = rotated_codes.estimates(q, centre[0] / 3, *rotated_codes.encode(x, centre[0] / 3, 7), 7)
    off = (about - q @ x.T) / error
    assert abs(off.mean()) < 0.05 and 0.8 < off.std() < 1.2 and (abs(off) > 3).mean() < 0.01


def test_defined_results(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0, 0]), (1, [0.5, 0, 0]), (2, [2, 0, 0]), (3, [0, 0, 0]), (4, None), (5, [1, None, 0]), (6, [nan, 1, 0]), (7, [inf, 0, 0]), (8, [1, 0]), (9, []), (0, [1, 0, 0]), (10, [-1e200, 1e200, 0]), (50, [1, 0]), (100, [0, 0, 0]), (11, [1e-200, 1e-200, 0])]
    got = found(frame(spark, rows))
    assert set(got) == {0, 50}
    # Equal cosines by the smaller id; the query's own rows, other lengths, nulls and zeros take no part.
    assert [j for j, _ in got[0]] == [1, 2, 11, 10] and got[50] == [(8, 1.0)]
    assert abs(got[0][2][1] - 0.5**0.5) < 1e-15 and abs(got[0][3][1] + 0.5**0.5) < 1e-15
    assert found(frame(spark, rows[3:4])) == {} and found(frame(spark, rows).limit(0)) == {}
