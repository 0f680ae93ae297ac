"""Fourier low-pass (S3) by a distributed four-step transform.

Keeping the bins up to K of a series of n samples is a circular convolution with
the Dirichlet kernel of K.  A series of at most ``block_rows`` samples is
transformed whole, in one group.  A longer one is padded to m = n1 * n2 >= 2n - 1
places, so that any n, prime or not, is a plain convolution, and transformed in
four steps:

1. columns (places equal modulo n2): transforms of length n1, times the twiddle
   factors; the kernel's column is generated beside the data, not read;
2. rows (bins equal modulo n1): transforms of length n2, the product with the
   kernel's, the inverse transform, the inverse twiddle factors;
3. columns again: inverse transforms of length n1, and rows of the table.

Short series (see ``short``) are transformed in groups of whole series, with all
columns of their rows, so nothing is joined back.

Groups hold as many columns or rows as ``block_rows`` elements allow, at least
one, which is about sqrt(2n) elements; between the steps travel tiles of the
matrix as binary values, not elements.  No group holds a long series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..signal import Signal
from . import blocks as B
from . import short
from .smooth import close_gaps


def kept_bins(n: int, ratio: float) -> int:
    """The largest bin k <= n / 2 whose frequency k * (1 / n) is at most ``ratio``; -1 if none is."""
    if ratio < 0:
        return -1
    k = min(n // 2, int(ratio * n) + 2)
    while k > 0 and k * (1.0 / n) > ratio:
        k -= 1
    return k


def dirichlet(j: np.ndarray, n: int, bins: int) -> np.ndarray:
    """(1 / n) * sum of exp(2 pi i k j / n) over |k| <= bins, for whole numbers j."""
    j = np.abs(np.asarray(j, np.int64))
    at_zero = j % n == 0
    low = np.sin(np.pi * np.where(at_zero, 1, j % (2 * n)) / n)
    top = np.sin(np.pi * ((2 * bins + 1) * j % (2 * n)) / n)  # whole periods are taken off as integers
    return np.where(at_zero, (2 * bins + 1) / n, top / low / n)


def shape(n: int, block_rows: int) -> tuple[int, int, int, int]:
    """(n1, n2, columns a group, rows a group) of the padded matrix of a series of n samples."""
    n2 = 1 << ((2 * n - 1).bit_length() + 1) // 2
    n1 = -(-(2 * n - 1) // n2)
    return n1, n2, max(1, min(n2, block_rows // n1)), max(1, min(n1, block_rows // n2))


def _twiddle(a: np.ndarray, b: np.ndarray, m: int, sign: int) -> np.ndarray:
    return np.exp(sign * 2j * np.pi * (np.outer(a, b) % m) / m)


def _columns(t: pd.DataFrame, feats: list[str], ratio: float, block_rows: int) -> list[tuple[int, list[bytes | None]]]:
    """Step 1 of one group: (row block, tile per channel and, last, of the kernel)."""
    n, block = int(t["_n"].iloc[0]), int(t["_cb"].iloc[0])
    n1, n2, wide, tall = shape(n, block_rows)
    cols = np.arange(block * wide, min(n2, (block + 1) * wide))
    place = t["pos"].to_numpy() - 1
    row, col = place // n2, place % n2 - cols[0]
    lag = np.arange(n1)[:, None] * n2 + cols[None]
    back = lag - n1 * n2
    bins = kept_bins(n, ratio)
    kernel = np.where(lag < n, dirichlet(lag, n, bins), np.where(back > -n, dirichlet(back, n, bins), 0.0))
    parts = []
    for c in feats:
        x = np.zeros((n1, len(cols)))
        x[row, col] = t[c].to_numpy(float)
        parts.append(x)
    turn = _twiddle(np.arange(n1), cols, n1 * n2, -1)
    spectra = [np.fft.fft(x, axis=0) * turn for x in [*parts, kernel]]
    return [(r // tall, [np.ascontiguousarray(s[r:r + tall]).tobytes() for s in spectra]) for r in range(0, n1, tall)]


def _matrix(t: pd.DataFrame, name: str, by: str, n_rows: int, n_cols: int, across: bool) -> np.ndarray:
    """Tiles of one group put side by side (``across``) or one below the other, in the order of ``by``."""
    tiles = t.sort_values(by)[name]
    if across:
        return np.concatenate([np.frombuffer(x, complex).reshape(n_rows, -1) for x in tiles], axis=1)
    return np.concatenate([np.frombuffer(x, complex).reshape(-1, n_cols) for x in tiles], axis=0)


def fourier_lowpass(sig: Signal, ratio: float = 0.08, block_rows: int = 1 << 20) -> Signal:
    """S3: zero every bin whose absolute frequency (of the sampling rate) is above ``ratio``, after gaps are closed.

    A channel without any value stays NULL; a ratio that keeps all bins, and a series of one sample, gives the closed
    series; a negative one removes everything."""
    closed = close_gaps(sig)
    keys, feats = list(sig.keys), list(sig.features)
    n_feats = len(feats)
    if n_feats and short.is_short(sig) and sig.max_series_rows <= block_rows:
        if closed.plan is not None:
            return B.then(closed, _kept, ratio)
        return sig.with_df(_in_groups(closed, ratio))
    fields = {f.name: f.dataType for f in closed.df.schema.fields}
    key_fields = [T.StructField(k, fields[k]) for k in keys]
    src = closed.df.select(*keys, "pos", "_n", *feats)
    whole = T.StructType([*key_fields, T.StructField("pos", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in feats]])
    names = [f.name for f in whole.fields]

    def direct(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        n = t.num_rows
        bins = kept_bins(n, ratio)
        for c in feats:
            if t[c].null_count == 0 and n:
                spectrum = np.fft.rfft(t[c].to_numpy())
                spectrum[bins + 1:] = 0
                t = t.set_column(t.column_names.index(c), c, pa.array(np.fft.irfft(spectrum, n)))
        return t.select(names)

    longest = sig.max_series_rows
    whole_rows = src if longest is not None and longest <= block_rows else src.where(F.col("_n") <= block_rows)
    done = whole_rows.groupBy(*keys).applyInArrow(direct, whole)
    if longest is None or longest > block_rows:
        done = done.unionByName(_four_steps(src.where(F.col("_n") > block_rows), keys, key_fields, feats, whole, ratio, block_rows))
    new = done.select(*keys, "pos", *[F.col(c).alias(f"_y{i}") for i, c in enumerate(feats)])
    joined = closed.df.join(new, on=[*keys, "pos"], how="inner")
    out = [F.col(f"_y{feats.index(c)}").alias(c) if c in feats else F.col(c) for c in closed.df.columns]
    return sig.with_df(joined.select(*out)) if n_feats else closed


def _kept(cells, x, feats, ratio: float) -> dict:
    """The transform of whole series (a step of ``blocks``)."""
    out = {}
    for f in feats:
        y = x[f].copy()
        for start, n in zip(cells.first.tolist(), cells.size.tolist()):
            part = y[start:start + n]
            if not np.isnan(part).any():
                spectrum = np.fft.rfft(part)
                spectrum[kept_bins(n, ratio) + 1:] = 0
                y[start:start + n] = np.fft.irfft(spectrum, n)
        out[f] = y
    return out


def _in_groups(closed: Signal, ratio: float):
    """The rows of short series with every channel transformed, several whole series to a group."""
    keys, feats = list(closed.keys), list(closed.features)

    def group(t: pa.Table) -> pa.Table:
        t = t.drop_columns(["_g"])
        series, _ = short._codes(t, keys)
        order = np.lexsort((t["pos"].to_numpy(), series))
        t, ends = t.take(pa.array(order)), np.cumsum(np.bincount(series))
        for c in feats:
            y = t[c].to_numpy().astype(float)  # a copy; NULL is NaN
            for start, end in zip(np.concatenate([[0], ends[:-1]]), ends):
                x = y[start:end]
                if len(x) and not np.isnan(x).any():
                    spectrum = np.fft.rfft(x)
                    spectrum[kept_bins(len(x), ratio) + 1:] = 0
                    y[start:end] = np.fft.irfft(spectrum, len(x))
            t = t.set_column(t.column_names.index(c), c, pa.array(y, from_pandas=True))
        return t

    return short.in_groups(closed.df, keys, closed.meta.get("n_rows") or 0, group, closed.df.schema)


def _four_steps(src, keys, key_fields, feats, whole, ratio, block_rows):
    tiles = [f"_t{i}" for i in range(len(feats) + 1)]
    tile_schema = T.StructType([*key_fields, T.StructField("_n", T.LongType()), T.StructField("_cb", T.LongType()), T.StructField("_rb", T.LongType()),
                                *[T.StructField(c, T.BinaryType()) for c in tiles]])

    def framed(t: pd.DataFrame, rows: list[tuple[int, int, list]]) -> pd.DataFrame:
        first = t.iloc[0]
        return pd.DataFrame({**{k: [first[k]] * len(rows) for k in keys}, "_n": [int(first["_n"])] * len(rows), "_cb": [r[0] for r in rows],
                             "_rb": [r[1] for r in rows], **{c: [r[2][i] for r in rows] for i, c in enumerate(tiles)}})

    def step1(t: pd.DataFrame) -> pd.DataFrame:
        block = int(t["_cb"].iloc[0])
        empty = [bool(t[c].isna().any()) for c in feats] + [False]  # gaps are closed: NULLs only where all are
        rows = _columns(t.fillna({c: 0.0 for c in feats}), feats, ratio, block_rows)
        return framed(t, [(block, r, [None if e else x for e, x in zip(empty, parts)]) for r, parts in rows])

    def step2(t: pd.DataFrame) -> pd.DataFrame:
        n, block = int(t["_n"].iloc[0]), int(t["_rb"].iloc[0])
        n1, n2, wide, tall = shape(n, block_rows)
        own = np.arange(block * tall, min(n1, (block + 1) * tall))
        kernel = np.fft.fft(_matrix(t, tiles[-1], "_cb", len(own), n2, True), axis=1)
        turn = _twiddle(own, np.arange(n2), n1 * n2, 1)
        held = [None if t[c].isna().any() else np.fft.ifft(np.fft.fft(_matrix(t, c, "_cb", len(own), n2, True), axis=1) * kernel, axis=1) * turn
                for c in tiles[:-1]]
        return framed(t, [(c // wide, block, [None if x is None else np.ascontiguousarray(x[:, c:c + wide]).tobytes() for x in held] + [None])
                          for c in range(0, n2, wide)])

    def step3(t: pd.DataFrame) -> pd.DataFrame:
        n, block = int(t["_n"].iloc[0]), int(t["_cb"].iloc[0])
        n1, n2, wide, _ = shape(n, block_rows)
        cols = np.arange(block * wide, min(n2, (block + 1) * wide))
        place = (np.arange(n1)[:, None] * n2 + cols[None]).ravel()
        real = place < n
        out = {k: [t[k].iloc[0]] * int(real.sum()) for k in keys} | {"pos": place[real] + 1}
        for i, c in enumerate(feats):
            if t[tiles[i]].isna().any():
                out[c] = np.full(int(real.sum()), np.nan)
            else:
                out[c] = np.fft.ifft(_matrix(t, tiles[i], "_rb", n1, len(cols), False), axis=0).real.ravel()[real]
        return pd.DataFrame(out)

    # a place's column block, by the whole-number rules of shape()
    n2 = F.expr("shiftleft(1L, (length(bin(2 * _n - 1)) + 1) div 2)")
    dealt = src.withColumn("_n2", n2).withColumn("_n1", F.expr("(2 * _n - 2 + _n2) div _n2"))
    dealt = dealt.withColumn("_cb", F.expr(f"((pos - 1) % _n2) div greatest(1L, least(_n2, {int(block_rows)}L div _n1))")).drop("_n1", "_n2")
    columns = dealt.groupBy(*keys, "_cb").applyInPandas(step1, tile_schema)
    rows = columns.groupBy(*keys, "_rb").applyInPandas(step2, tile_schema)
    return rows.groupBy(*keys, "_cb").applyInPandas(step3, whole)
