"""Exact top-k search against all comparisons, pruning, ties and odd vectors."""

import collections
import math

import numpy as np
import pytest

from hearthlens.llm import topk_search as ts


def brute(rows, every, k, scale=256):
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = collections.Counter()
    for a, (i, v) in enumerate(whole):
        if i is None or i % every:
            continue
        hits = sorted((-sum(x * y for x, y in zip(v, w)), j is None, j or 0, j) for b, (j, w) in enumerate(whole) if b != a)[:k]
        out.update((i, r, h[3], -h[0]) for r, h in enumerate(hits, 1))
    return out


def frame(spark, rows, parts=3):
    data = [(i, None if v is None else [None if x is None else float(x) for x in v], 7, 1) for i, v in rows]
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, block long, score int").repartition(parts)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_top_k_against_all_comparisons(spark, block):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=8) + 3 * np.eye(8)[i % 3]).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[4][1]) for i in range(70)]  # copies: ties by id
    rows += [(1000, rows[5][1]), (20, rows[20][1]), (None, rows[20][1]), (None, rows[4][1])]  # repeated and missing ids
    rows += [(40, []), (2020, [1.0]), (2040, [0.5] * 11), (-20, [-1.0] * 8), (60, None), (80, [1.0, None]), (100, [float("nan")] * 8), (120, [float("inf")]), (140, [-float("inf"), 0.0]), (2060, [0.0] * 8)]
    got = collections.Counter(tuple(r) for r in ts.top_k(frame(spark, rows), every=20, block=block).collect())
    assert got == brute(rows, 20, 5)


def test_queries_in_several_groups(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(200)]
    got = collections.Counter(tuple(r) for r in ts.top_k(frame(spark, rows), every=3, k=2, query_bytes=500).collect())
    assert got == brute(rows, 3, 2)


def test_few_rows_and_none(spark):
    assert ts.top_k(frame(spark, [])).collect() == []
    assert ts.top_k(frame(spark, [(50, [1.0])])).collect() == []
    assert [tuple(r) for r in ts.top_k(frame(spark, [(50, [1.0]), (51, [-2.0])])).collect()] == [(50, 1, 51, -2 * 256 * 256)]


def test_blocks_are_pruned_and_bounds_hold():
    rng = np.random.default_rng(7)
    centres = 40 * rng.normal(size=(16, 12))
    docs = np.floor(centres[:, None, :] + rng.normal(size=(16, 64, 12))).astype(np.int64)
    b = ts.Blocks.__new__(ts.Blocks)
    b.number, b.docs = np.arange(16), list(docs)
    b.ids = [np.arange(64) + 64 * i for i in range(16)]
    b.high, b.low, b.first = docs.max(1), docs.min(1), np.arange(16) * 64
    q = docs[:, 5]
    most = np.stack([ts.products(q, d).max(1) for d in docs], axis=1)
    assert (ts.bounds(q, b.high, b.low) >= most).all()
    best = ts.Best(16, 5)
    scored = ts.search(q, np.arange(16), np.full(16, 5), b, best)
    assert scored <= 2 * 16  # of 256 pairs
    for i in range(16):
        s = np.concatenate([ts.products(q[i:i + 1], d)[0] for d in docs])
        s[64 * i + 5] = ts.LOW + 1
        order = np.lexsort((np.arange(1024), -s))[:5]
        assert best.id[i].tolist() == order.tolist() and best.score[i].tolist() == s[order].tolist()


def test_large_weights_stay_exact():
    q = np.array([[2**30, 3]])
    assert ts.products(q, np.array([[2**31, 1]])).tolist() == [[2**61 + 3]]
    with pytest.raises(OverflowError):
        ts.products(np.array([[2**40]]), np.array([[2**40]]))
