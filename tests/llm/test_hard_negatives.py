"""Hard negatives against brute force: trees, bounds, small tables with ties, nulls and copies."""

import math

import numpy as np
import pytest

from sigsieve.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<double>, label int, row string, score int"


def _brute(rows, every, positives=5, negatives=10):
    good = {(i, label, tuple(math.floor(256 * x) for x in e)) for i, e, label in rows if label is not None and e and all(x is not None and math.isfinite(x) for x in e)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    result = []
    for i, label, e in good:
        if i is None or i % every:
            continue
        same = sorted(((dot(e, f), j) for j, k, f in good if k == label and j != i and len(e) == len(f)), key=order)[:positives]
        other = sorted(((dot(e, f), j) for j, k, f in good if k != label and len(e) == len(f)), key=order)
        for score, p in same:
            fits = [(s, j) for s, j in other if 30 * score <= 100 * s <= 90 * score][:negatives]
            result += [(i, p, n + 1, j, score, s) for n, (s, j) in enumerate(fits)]
    return sorted(map(repr, result))


def _mine(spark, rows, every, **sizes):
    df = spark.createDataFrame([(*x, "r", 1) for x in rows], SCHEMA)
    got = hn.hard_negatives(df, f"vec_id % {every} = 0", **sizes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(repr(tuple(x)) for x in got.collect())


def _clusters(n, dim, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (12, dim))
    x = centres[rng.integers(0, 12, n)] + rng.normal(0, 0.25, (n, dim))
    return [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, rng.integers(0, labels, n), strict=True))]


@pytest.mark.parametrize(("n", "dim"), [(1, 3), (40, 2), (900, 8), (700, 48)])
def test_tree_covers_and_bounds(n, dim):
    rng = np.random.default_rng(n)
    x = np.floor(256 * rng.normal(0, 1, (n, dim)) * rng.uniform(0.2, 3, (n, 1)))
    x[n // 2 :: 3] = x[0]
    shard = hn.Shard(x, np.arange(n), np.ones(n, bool), np.zeros(n, np.int64), np.arange(n))
    t = shard.tree
    assert sorted(t.order) == list(range(n)) and t.low[0] == 0 and t.high[0] == n
    assert np.ptp((shard.points**2).sum(axis=1)) <= 1e-6 * shard.norm2 + 1e-6
    q = np.floor(256 * rng.normal(0, 1, dim))
    low, high = shard.bounds(q, np.arange(len(t.low)))
    dots = shard.x @ q
    for v in range(len(t.low)):
        span = slice(t.low[v], t.high[v])
        assert np.sqrt(((shard.points[span] - shard.points[t.low[v]]) ** 2).sum(axis=1)).max() <= t.radius[v]
        assert low[v] <= dots[span].min() and dots[span].max() <= high[v]
        kids = range(t.child[v], t.child[v + 1])
        assert not kids or (t.low[kids[0]] == t.low[v] and t.high[kids[-1]] == t.high[v])


def test_descent_skips_far_subtrees():
    rows = _clusters(6000, 4, 1)
    x = np.floor(256 * np.array([e for _, e, _ in rows]))
    shard = hn.Shard(x, np.arange(len(x)), np.ones(len(x), bool), np.array([k for *_, k in rows]), np.arange(len(x)))
    seen = []
    shard.descend(x[0], lambda nodes, low, high: high >= 0.9 * (x @ x[0]).max(), lambda: 0.9 * (x @ x[0]).max(), lambda places, scores: seen.append(len(places)))
    assert 0 < sum(seen) < len(x) / 2


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 64, "block_rows": 3}])
def test_small_tables(spark, sizes):
    rows = _clusters(300, 6, 2)
    rows += [(400, None, 1), (410, [1.0] * 6, None), (420, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (430, [float("nan")] * 6, 1), (440, [float("inf")] * 6, 1), (450, [], 1)]
    rows += [(None, rows[0][1], 0), (None, rows[3][1], 2), (500, [0.0] * 6, 2), (501, [-0.0] * 6, 3)]
    rows += [(600 + i, rows[10][1], i % 3) for i in range(60)]  # copies of an anchor: ties
    rows += [rows[20], rows[20], (20, rows[21][1], 3)]  # a repeated row, and its id again with other content
    rows += [(700 + i, [0.5 * i, 1.0, -2.0], i % 2) for i in range(21)]  # another length
    assert _mine(spark, rows, 10, **sizes) == _brute(rows, 10)


def test_other_sizes_and_wide_components(spark):
    rows = [(i, [x * 1e6 for x in e], k) for i, e, k in _clusters(80, 4, 3)]
    assert _mine(spark, rows, 8, positives=2, negatives=3) == _brute(rows, 8, 2, 3)
    with pytest.raises(Exception, match="OverflowError"):
        _mine(spark, [(i, [1e30, 1.0], i % 2) for i in range(20)], 5)


def test_exact_products():
    for size in (2**20, 2**29, 2**31 - 1):
        x, y = np.array([[size, -size], [1, size]], float), np.array([size - 1, 3.0])
        assert hn.exact(x, y, 2.0 * size * size).tolist() == [size * (size - 1) - 3 * size, size - 1 + 3 * size]
    with pytest.raises(OverflowError):
        hn.exact(np.array([[2.0**40]]), np.array([2.0**40]), 2.0**80)


def test_empty_tables(spark):
    assert _mine(spark, [], 10) == [] and _mine(spark, [(1, None, 1)], 10) == [] and _mine(spark, [(0, [1.0], 1)], 10) == []
