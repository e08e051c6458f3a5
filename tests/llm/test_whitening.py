"""Whitening against plain numpy over whole vectors, and odd rows."""

import math

import numpy as np
import pytest

from leadloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string"


def brute(vectors):
    """(distinct x, S, eigenvalues, eigenvectors) of rows of floats."""
    x = sorted({tuple(math.floor(256 * float(np.float32(c))) for c in v) for v in vectors})
    a = np.array(x, float)
    c = a - a.mean(axis=0)
    values, axes = np.linalg.eigh(c.T @ c / len(a))
    return x, [sum(col) for col in zip(*x, strict=True)], values[::-1], axes[:, ::-1]


def test_against_numpy(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(300, 8)) * np.array([3, 2, 1.5, 1, 0.5, 0.4, 0.3, 0.2]) + 0.7
    vectors = [[float(c) for c in v] for v in base] + [[float(c) for c in base[0]]] * 200
    rows = [(i, v, "clash") for i, v in enumerate(vectors)]
    rows += [(9001, None, "x"), (9002, [1.0, None] + [0.0] * 6, "x"), (9003, [float("nan")] * 8, "x"), (9004, [float("inf")] * 8, "x"), (None, vectors[5], "x"), (7, vectors[7], "x")]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    x, s, values, axes = brute(vectors)
    n = len(x)
    assert n == 300 and len(got) == (500 + 2) * 4
    assert {r["vec_id"] for r in got} == {*range(500), None}
    by_id = {}
    for row in got:
        by_id.setdefault((row["vec_id"], row["component"]), set()).add(tuple(row))
    assert all(len(v) == 1 for v in by_id.values())
    signs = {}
    for (i, k), found in by_id.items():
        row = dict(zip(got[0].__fields__, next(iter(found)), strict=True))
        v = vectors[5] if i is None else vectors[i]
        w = [math.floor(256 * float(np.float32(c))) for c in v]
        assert row["n"] == n and row["deviation"] == sum((n * a - b) ** 2 for a, b in zip(w, s, strict=True))
        want = float(np.dot(np.array(w) - np.array(s) / n, axes[:, k - 1]) / np.sqrt(values[k - 1]))
        if abs(want) > 1e-6:
            signs.setdefault(k, np.sign(row["whitened"] * want))
            assert row["whitened"] == pytest.approx(signs[k] * want, rel=1e-8, abs=1e-9)
        assert row["explained"] == pytest.approx(values[k - 1] / values.sum(), rel=1e-9)
        assert row["identity_error"] < 1e-8


def test_odd_tables(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert make([]) == [] and make([(1, None, "")]) == [] and make([(1, [], ""), (2, [], "")]) == []
    # one distinct vector: nothing varies
    one = make([(1, [1.0, 2.0], ""), (2, [1.0, 2.0], "")])
    assert len(one) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 and r["n"] == 1 for r in one)
    # one direction varies; the short vector ends in zeros
    two = {(r["vec_id"], r["component"]): r for r in make([(1, [1.0], ""), (2, [3.0, 0.0], "")])}
    assert two[1, 1]["whitened"] == pytest.approx(-two[2, 1]["whitened"]) and abs(two[1, 1]["whitened"]) == pytest.approx(1)
    assert two[1, 2]["whitened"] is None and two[1, 2]["explained"] == pytest.approx(0) and two[1, 1]["explained"] == pytest.approx(1)


def test_large_entries_stay_exact(spark):
    rows = [(1, [1e12, -1e12], ""), (2, [3e12, 5.0], ""), (3, [-2e12, 1e12], "")]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string")).collect()
    assert len(got) == 6 and all(r["deviation"] is None and math.isfinite(r["whitened"]) for r in got)
    small = whitening.whiten(spark.createDataFrame([(1, [2.0**20], ""), (2, [0.0], "")], SCHEMA)).collect()
    assert {r["deviation"] for r in small} == {(2**28) ** 2}
