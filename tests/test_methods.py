"""MICE, Butterworth and the isolation forest against row-wise brute force and planted cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigsieve.operators import mice
from sigsieve.operators.isoforest import isolation_forest_mask
from sigsieve.operators.spectral import butterworth, lowpass_taps
from sigsieve.signal import make_signal


def _correlated(spark, n=300):
    rng = np.random.default_rng(5)
    a = rng.normal(50, 8, n)
    full = np.stack([a, 2 * a + rng.normal(0, 1, n), 30 - a + rng.normal(0, 2, n)], axis=1)
    x = full.copy()
    x[rng.random(n) < 0.2, 0] = np.nan
    x[rng.random(n) < 0.1, 2] = np.nan
    rows = [("s", i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    rows += [("empty", i, float(i), None, float(i % 3)) for i in range(10)]
    return full, x, spark.createDataFrame(rows, "k string, t long, a double, b double, c double")


def test_mice_equals_row_wise_rounds(spark):
    full, x, df = _correlated(spark)
    out = mice.mice_impute(make_signal(df, ["k"], ["t"], ["a", "b", "c"]), max_iter=4).df
    got = out.where("k = 's'").orderBy("t").select("a", "b", "c").toPandas().to_numpy()
    miss = np.isnan(x)
    y = np.where(miss, np.nanmean(x, axis=0), x)
    for _ in range(4):
        for j in (2, 0):  # fewest gaps first; channel 1 has none
            others = [k for k in range(3) if k != j]
            fx, fy = y[~miss[:, j]][:, others], y[~miss[:, j], j]
            cx, cy = fx - fx.mean(0), fy - fy.mean()
            coef = mice.bayesian_ridge(len(fy), cx.T @ cx, cx.T @ cy, cy @ cy)
            y[miss[:, j], j] = fy.mean() + (y[miss[:, j]][:, others] - fx.mean(0)) @ coef
    assert np.allclose(got, y, atol=1e-6)
    rmse = lambda z: np.sqrt(((z - full)[miss] ** 2).mean())
    assert rmse(got) < 0.3 * rmse(np.where(miss, np.nanmean(x, axis=0), x))
    e = out.where("k = 'empty'").select("b").collect()
    assert len(e) == 10 and all(r["b"] is None for r in e)


def _two_passes(x, cutoff, order=3):
    """The same filter as a plain recursion over one whole series."""
    k = np.arange(1, order + 1)
    p = 4 * np.tan(np.pi * cutoff / 2) * np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    a = np.real(np.poly((4 + p) / (4 - p)))
    b = np.array([1, 3, 3, 1]) * a.sum() / 8
    pad = 3 * (order + 1)
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2:-pad - 2:-1]])
    for _ in range(2):
        u, v = [y[0]] * order + list(y), [y[0]] * order
        for t in range(order, len(u)):
            v.append(sum(b[i] * u[t - i] for i in range(order + 1)) - sum(a[i] * v[t - i] for i in range(1, order + 1)))
        y = np.array(v[order:])[::-1]
    return y[pad:pad + len(x)]


@pytest.mark.parametrize("block_rows", [1, 200, 1 << 17])
def test_butterworth_is_the_recursion_for_any_block_length(spark, block_rows):
    rng = np.random.default_rng(2)
    x = np.sin(np.arange(700) / 20) + rng.normal(0, 0.3, 700)
    rows = [("a", i, float(v)) for i, v in enumerate(x)] + [("short", i, float(i * i)) for i in range(12)]
    rows += [("none", i, None) for i in range(30)]
    sig = make_signal(spark.createDataFrame(rows, "k string, t long, v double"), ["k"], ["t"], ["v"])
    got = butterworth(sig, 30.0, 250.0, 3, block_rows).df.orderBy("k", "t").select("k", "v").toPandas()
    assert np.allclose(got[got.k == "a"]["v"], _two_passes(x, 0.24), atol=1e-9)
    assert list(got[got.k == "short"]["v"]) == [float(i * i) for i in range(12)]
    assert got[got.k == "none"]["v"].isna().all() and len(got) == 742


def test_butterworth_gain_is_one_at_zero_frequency():
    assert abs(lowpass_taps(0.24, 3).sum() - 1) < 1e-12


def test_isolation_forest_masks_the_planted_share(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(0, 1, 2000)
    v[::50] = 40 + rng.random(40)
    rows = [("a", i, None if i % 97 == 3 else float(x), 1.0) for i, x in enumerate(v)]
    rows += [("tiny", i, float(x), 1.0) for i, x in enumerate([1, 1, 1, 90])]
    sig = make_signal(spark.createDataFrame(rows, "k string, t long, v double, flat double"), ["k"], ["t"], ["v", "flat"])
    out = isolation_forest_mask(sig, contamination=0.05)
    a = out.df.where("k = 'a'").select("t", "v", "flat").toPandas().set_index("t").sort_index()
    assert a["v"][[i for i in range(0, 2000, 50)]].isna().all()  # every planted outlier
    masked = sum(1 for i in range(2000) if i % 97 != 3 and np.isnan(a["v"][i]))  # cells that had a value
    assert 80 <= masked <= 100 and not a["flat"].isna().any()
    assert out.df.where("k = 'tiny'").count() == 4
    again = isolation_forest_mask(sig, contamination=0.05).df.where("v IS NULL").count()
    assert again == out.df.where(F.col("v").isNull()).count()


def test_forest_of_whole_series_equals_the_drawn_and_joined_one(spark, monkeypatch):
    from sigsieve.operators import isoforest

    rng = np.random.default_rng(8)
    rows = [(k, i, None if i % 11 == 0 else float(rng.normal()), float(rng.integers(0, 6)), 1.0) for k, n in (("a", 700), ("b", 90), ("c", 1)) for i in range(n)]
    sig = make_signal(spark.createDataFrame(rows, "k string, t long, x double, y double, flat double"), ["k"], ["t"], ["x", "y", "flat"])
    found = {}
    for limit in (1 << 16, 300, 0):  # all series whole, some, none
        monkeypatch.setattr(isoforest, "ROWS_WHOLE", limit)
        found[limit] = sorted(map(tuple, isolation_forest_mask(sig, trees=30, sample=64).df.select("k", "pos", "x", "y", "flat").collect()), key=repr)
    assert found[1 << 16] == found[300] == found[0] and sum(r[2] is None for r in found[0]) > 64 + 9
