"""Hard negatives against all pairs, with blocks far smaller than the tables, and rigorous bounds."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, rank string"
DATA = os.environ.get("LEADLOOM_TEST_DATA", "/root/testdata/sf0.001")


def brute(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    seen = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        key = (label, [math.floor(256 * c) for c in v])
        seen[i] = min(seen.get(i, key), key)
    out = set()
    for a, (label, x) in seen.items():
        if not is_anchor(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=False)), j, l) for j, (l, y) in seen.items() if j != a)
        for sp, p, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [s for s in scored if s[2] != label and low * -sp <= 100 * -s[0] <= high * -sp][:negatives]
            out |= {(a, p, k, n, -sp, -sn) for k, (sn, n, _) in enumerate(fit, 1)}
    return out


def rows_of(seed, n, dims, copies=0):
    r = np.random.default_rng(seed)
    base = r.normal(size=(6, dims))
    out = [(i, [float(c) for c in base[i % 6] * r.uniform(0.2, 1) + r.normal(size=dims) * 0.4], int(r.integers(0, 4)), "clash") for i in range(n)]
    out += [(n + i, out[3][1], i % 3, "copy") for i in range(copies)]
    return out


@pytest.mark.parametrize("seed,dims,width,block", [(1, 6, 2, 7), (2, 5, 2, 16), (3, 8, 4, 2048)])
def test_equals_all_pairs(spark, seed, dims, width, block):
    rows = rows_of(seed, 150, dims, copies=60)
    rows += [(900, None, 1, ""), (901, [1.0] * dims, None, ""), (902, [float("nan")] * dims, 1, ""), (903, [1.0, None], 1, ""), (None, [1.0] * dims, 1, "")]
    rows += [(910, [1.0, 2.0], 1, ""), (911, [], 2, ""), (5, rows[5][1], rows[5][2], "repeated"), (6, [9.0] * dims, 3, "shares an id")]
    settings = hn.Settings(width=width, block=block, centroids=8, sample=40)
    got = hn.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, settings).collect()
    want = brute(rows, lambda i: i % 10 == 0)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 50


def test_bounds_hold_and_prune():
    r = np.random.default_rng(0)
    x = np.floor(r.normal(size=(500, 12)) * 40).astype(np.int64)
    book = hn.codebook(x[:200], 2, 64, 8)
    codes, norms = hn.encode(x, book)
    least, greatest = hn.bounds(x[:50], codes, norms, book)
    true = x[:50] @ x.T
    assert (least <= true).all() and (true <= greatest).all()
    assert (greatest - least).mean() / 2 < 0.5 * true.std()


def test_windows():
    for p in range(-30, 60):
        lo, hi = hn.window(p, 50, 95)
        assert [s for s in range(-80, 80) if lo <= s <= hi] == [s for s in range(-80, 80) if 50 * p <= 100 * s <= 95 * p]


def test_odd_tables(spark):
    make = lambda rows: hn.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0).collect()
    assert make([]) == [] and make([(10, [1.0], 1, "")]) == [] and make([(1, [1.0], 1, ""), (2, [1.0], 1, "")]) == []
    # zero scores: the window is zero alone
    got = make([(10, [0.0, 0.0], 1, ""), (11, [1.0, 0.0], 1, ""), (12, [2.0, 0.0], 2, "")])
    assert [tuple(r) for r in got] == [(10, 11, 1, 12, 0, 0)]
    with pytest.raises(ValueError):
        make([(10, [1e9], 1, ""), (11, [1.0], 1, "")])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_contract_on_the_tables(spark):
    rows = [(r["vec_id"], [float(c) for c in r["embedding"]], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = hn.contract(spark.read.parquet(f"{DATA}/embeddings.parquet")).collect()
    assert {tuple(r) for r in got} == brute(rows, lambda i: i % 50 == 0) and got
