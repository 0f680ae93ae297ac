"""Butterworth smoothing (S1) on halo blocks.

The impulse response of the filter fades geometrically, so both passes of the
zero-phase filter are convolutions with its first taps (cut where it is below
1e-16 of the input).  A block therefore needs only that many rows of its
neighbours, and no series is one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..signal import Signal
from . import blocks as B
from .sequence import halo_blocks
from .smooth import close_gaps


def lowpass_taps(cutoff: float, order: int) -> np.ndarray:
    """Impulse response of a Butterworth low-pass (bilinear transform); ``cutoff``
    is a share of the Nyquist frequency."""
    k = np.arange(1, order + 1)
    analog = 4.0 * np.tan(np.pi * cutoff / 2) * np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    poles = (4.0 + analog) / (4.0 - analog)
    a = np.real(np.poly(poles))
    b = np.poly(-np.ones(order)) * a.sum() / 2.0 ** order  # unit gain at frequency 0
    n = int(np.ceil(np.log(1e-16) / np.log(np.abs(poles).max()))) + order
    h = np.zeros(n)
    for t in range(n):
        past = h[max(0, t - order):t][::-1]
        h[t] = (b[t] if t <= order else 0.0) - a[1:len(past) + 1] @ past
    return h


def zero_phase(x: np.ndarray, h: np.ndarray, pad: int, starts: bool, ends: bool) -> np.ndarray:
    """Filter forward, then backward.  Where the series starts or ends it is
    continued by ``pad`` samples mirrored through its end point, then held."""
    left = 2 * x[0] - x[pad:0:-1] if starts else x[:0]
    right = 2 * x[-1] - x[-2:-pad - 2:-1] if ends else x[:0]
    y = np.concatenate([left, x, right])
    for _ in range(2):
        y = np.convolve(np.concatenate([np.full(len(h) - 1, y[0]), y]), h, mode="valid")[::-1]
    return y[len(left):len(left) + len(x)]


def _filtered(cells, x, feats, share: float, order: int) -> dict:
    """The filter over whole series (a step of ``blocks``)."""
    h, pad, out = lowpass_taps(share, order), 3 * (order + 1), {}
    for f in feats:
        y = x[f].copy()
        for start, n in zip(cells.first.tolist(), cells.size.tolist()):
            if n > pad and not np.isnan(y[start]):  # gaps are closed: empty only where all is
                y[start:start + n] = zero_phase(y[start:start + n], h, pad, True, True)
        out[f] = y
    return out


def butterworth(sig: Signal, cutoff: float = 30.0, fs: float = 250.0, order: int = 3, block_rows: int = 1 << 17) -> Signal:
    """Zero-phase low-pass of every channel after its gaps are closed.  Series
    too short for the padding, and cutoffs outside (0, Nyquist), keep the closed series."""
    closed = close_gaps(sig)
    share = cutoff / (0.5 * fs) if fs > 0 else 0.0
    if not 0 < share < 1:
        return closed
    h = lowpass_taps(share, order)
    pad = 3 * (order + 1)
    if closed.plan is not None and sig.max_series_rows <= block_rows:
        return B.then(closed, _filtered, share, order)
    keys, feats = list(sig.keys), list(sig.features)
    schema = closed.df.schema
    names = schema.names

    def block(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        pos, n = t["pos"].to_numpy(), t["_n"][0].as_py()
        own = t["_own"]
        out = t.select(names)
        for c in feats:
            if n > pad and t[c].null_count == 0:  # gaps are closed: NULLs only where all are
                y = zero_phase(t[c].to_numpy(), h, pad, pos[0] == 1, pos[-1] == n)
                out = out.set_column(names.index(c), c, pa.array(y, pa.float64()))
        return out.filter(own)

    d = halo_blocks(closed.df, keys, max(len(h), pad + 1), block_rows)
    return sig.with_df(d.groupBy(*keys, "_hb").applyInArrow(block, schema).select(*[F.col(c) for c in names]))
