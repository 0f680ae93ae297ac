"""Smoothing (S0-S3).  S0 closes gaps (linear both ways, then hold); S2 is a
Savitzky-Golay FIR filter evaluated with sliding-window arrays over halo
blocks, so no series is collected into one task.  Butterworth is in
``spectral.py``, Fourier in ``fourier.py``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..signal import Signal
from . import blocks as B
from .sequence import carry_valid, halo_blocks
from .transform import _finish


def close_gaps(sig: Signal) -> Signal:
    """Linear interpolation by position, both ends held (all-NULL stays NULL)."""
    if sig.plan is not None:
        return B.then(sig, B.close)
    feats = list(sig.features)
    df = carry_valid(sig.df, list(sig.keys), feats)
    new = {}
    for i, c in enumerate(feats):
        p0, v0 = F.col(f"_pv{i}.p"), F.col(f"_pv{i}.v")
        p1, v1 = F.col(f"_nv{i}.p"), F.col(f"_nv{i}.v")
        lin = F.when(v0.isNotNull() & v1.isNotNull(), v0 + (v1 - v0) * (F.col("pos") - p0) / (p1 - p0))
        new[c] = F.coalesce(F.col(c), lin, v0, v1)
    return _finish(sig, df, new)


def savgol_matrix(window: int, poly: int) -> np.ndarray:
    """Least-squares projection (hat) matrix of a degree-``poly`` polynomial on
    ``window`` equally spaced points; row h is the interior smoothing kernel,
    rows 0..h-1 / h+1.. are the fitted values at the edges."""
    t = np.arange(window, dtype=float)
    a = np.vander(t - t.mean(), poly + 1, increasing=True)
    return a @ np.linalg.pinv(a)


def _fitted(cells, x, feats, w: int, poly: int) -> dict:
    """The filter over whole series (a step of ``blocks``)."""
    hm, h, out = savgol_matrix(w, poly), w // 2, {}
    for f in feats:
        y = x[f].copy()
        for start, n in zip(cells.first.tolist(), cells.size.tolist()):
            v = x[f][start:start + n]
            if n < w or np.isnan(v[0]):  # gaps are closed: empty only where all is
                continue
            at = np.arange(n)
            left = np.clip(at - h, 0, n - w)
            total = np.zeros(n)
            for j in range(w):
                total += hm[at - left, j] * v[left + j]
            y[start:start + n] = total
        out[f] = y
    return out


def savgol(sig: Signal, window: int = 11, poly: int = 2, block_rows: int = 1 << 17) -> Signal:
    """Savitzky-Golay smoothing (polynomial fit at the edges).  Series
    shorter than the window, or with gaps left, are returned unchanged."""
    w = int(window)
    if w % 2 == 0:
        w += 1
    if w <= poly:
        return sig
    h = w // 2
    sig0 = close_gaps(sig)
    if sig0.plan is not None:
        return B.then(sig0, _fitted, w, poly)
    feats = list(sig.features)
    keys = list(sig.keys)
    hm = savgol_matrix(w, poly)
    H = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in hm])
    d = halo_blocks(sig0.df, keys, w - 1, block_rows)
    ws = Window.partitionBy(*keys, "_hb").orderBy("pos").rowsBetween(-(w - 1), w - 1)
    p0 = F.col("pos") - 1  # 0-based position
    n = F.col("_n")
    start = F.when(p0 < h, F.lit(0)).when(p0 > n - 1 - h, n - w).otherwise(p0 - h)
    r = F.when(p0 < h, p0).when(p0 > n - 1 - h, p0 - (n - w)).otherwise(F.lit(h))
    arr_start = F.greatest(F.lit(0), p0 - (w - 1))
    cols = {}
    d = d.select("*", *[F.collect_list(F.col(c)).over(ws).alias(f"_a{i}") for i, c in enumerate(feats)])
    d = d.where(F.col("_own"))
    new = {}
    for i, c in enumerate(feats):
        off = (start - arr_start).cast("int")
        rr = r.cast("int")
        y = F.aggregate(F.sequence(F.lit(0), F.lit(w - 1)), F.lit(0.0),
                        lambda acc, j: acc + F.element_at(F.element_at(H, rr + 1), j + 1)
                        * F.element_at(F.col(f"_a{i}"), off + j + 1))
        new[c] = F.when((n >= w) & F.col(c).isNotNull(), y).otherwise(F.col(c))  # no gaps are left, or nothing is
    out = d.select(*[new[c].alias(c) if c in new else F.col(c) for c in sig0.df.columns])
    return sig.with_df(out)
