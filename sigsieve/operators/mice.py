"""MICE (M6): round-robin Bayesian-ridge imputation from sufficient statistics.

Without posterior sampling every imputed value is a linear function of the
observed values of its row, with the same coefficients for all rows of a series
that miss the same channels.  So the rounds need no rows: one aggregate gives the
second moments per (series, missing pattern); the rounds then run on those small
matrices, one task per series; one join brings the coefficients back to the rows.
Means are subtracted first, so the moments keep their digits.

A group holds one row per missing pattern of a series (at most 2^channels, and
never more than the data show).  All rounds are run: a stop by row-wise change
isn't visible in second moments, and further rounds only approach the fixed point.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.stats import attach
from ..signal import Signal

MAX_CHANNELS = 62  # bits of the pattern number


def bayesian_ridge(n: float, sxx: np.ndarray, sxy: np.ndarray, syy: float, rounds: int = 300, tol: float = 1e-3) -> np.ndarray:
    """Coefficients of a Bayesian ridge regression from centred second moments
    (evidence maximisation of noise and weight precision, hyperpriors 1e-6)."""
    prior = 1e-6
    e, v = np.linalg.eigh(sxx)
    e = np.clip(e, 0.0, None)
    b = v.T @ sxy
    alpha, lam = 1.0 / (syy / n + np.finfo(float).eps), 1.0
    old = None
    for _ in range(rounds):
        c = b / (e + lam / alpha)
        if old is not None and np.abs(v @ (c - old)).sum() < tol:
            break
        old = c
        rss = max(syy - 2 * c @ b + (e * c * c).sum(), 0.0)
        gamma = (alpha * e / (lam + alpha * e)).sum()
        lam = (gamma + 2 * prior) / (c @ c + 2 * prior)
        alpha = (n - gamma + 2 * prior) / (rss + 2 * prior)
    return v @ (b / (e + lam / alpha))


def pattern_maps(masks: np.ndarray, grams: np.ndarray, d: int, max_iter: int) -> np.ndarray:
    """Per pattern a (d, d+1) map from [1, centred observed values] to the filled row."""
    missing = (masks[:, None] >> np.arange(d)) & 1 == 1
    maps = np.zeros((len(masks), d + 1, d + 1))
    maps[:, 0, 0] = 1.0
    for j in range(d):
        maps[~missing[:, j], j + 1, j + 1] = 1.0
    n_rows = grams[:, 0, 0]
    n_miss = n_rows @ missing
    active = [j for j in range(d) if n_miss[j] < n_rows.sum()]
    order = sorted((j for j in active if n_miss[j] > 0), key=lambda j: (n_miss[j], j))
    for _ in range(max_iter if len(active) > 1 else 0):
        for j in order:
            fit = ~missing[:, j]
            m = maps[fit]
            g = (m @ grams[fit] @ m.transpose(0, 2, 1)).sum(axis=0)
            n, mean = g[0, 0], g[0] / g[0, 0]
            s = g - n * np.outer(mean, mean)
            x = [k + 1 for k in active if k != j]
            coef = bayesian_ridge(n, s[np.ix_(x, x)], s[x, j + 1], s[j + 1, j + 1])
            row = np.zeros(d + 1)
            row[0], row[x] = mean[j + 1] - coef @ mean[x], coef
            maps[~fit, j + 1] = row @ maps[~fit]
    return maps[:, 1:]


def ridge_of_all(n: np.ndarray, sxx: np.ndarray, sxy: np.ndarray, syy: np.ndarray, rounds: int = 300, tol: float = 1e-3) -> np.ndarray:
    """``bayesian_ridge`` of many regressions at once: the leading axis."""
    prior = 1e-6
    e, v = np.linalg.eigh(sxx)
    e = np.clip(e, 0.0, None)
    b = np.einsum("sij,si->sj", v, sxy)
    alpha, lam = 1.0 / (syy / n + np.finfo(float).eps), np.ones(len(n))
    old, on = None, np.ones(len(n), dtype=bool)
    for _ in range(rounds):
        c = b / (e + (lam / alpha)[:, None])
        if old is not None:
            on &= ~(np.abs(np.einsum("sij,sj->si", v, c - old)).sum(axis=1) < tol)
        if not on.any():
            break
        old = c
        rss = np.maximum(syy - 2 * (c * b).sum(axis=1) + (e * c * c).sum(axis=1), 0.0)
        gamma = (alpha[:, None] * e / (lam[:, None] + alpha[:, None] * e)).sum(axis=1)
        lam = np.where(on, (gamma + 2 * prior) / ((c * c).sum(axis=1) + 2 * prior), lam)
        alpha = np.where(on, (n - gamma + 2 * prior) / (rss + 2 * prior), alpha)
    return np.einsum("sij,sj->si", v, b / (e + (lam / alpha)[:, None]))


def maps_of_all(masks: np.ndarray, grams: np.ndarray, d: int, max_iter: int) -> np.ndarray:
    """``pattern_maps`` of many series at once: grams (series, pattern, d + 1, d + 1), zero where a series lacks a pattern.
    A channel without any value in a series has zero moments there, so its coefficient is zero."""
    missing = (masks[:, None] >> np.arange(d)) & 1 == 1
    start = np.zeros((len(masks), d + 1, d + 1))
    start[:, 0, 0] = 1.0
    for j in range(d):
        start[~missing[:, j], j + 1, j + 1] = 1.0
    maps = np.repeat(start[None], len(grams), axis=0)
    n_rows = grams[:, :, 0, 0]
    n_miss = n_rows @ missing
    active = n_miss < n_rows.sum(axis=1)[:, None]
    turn = active & (n_miss > 0) & (active.sum(axis=1) > 1)[:, None]
    order = np.argsort(np.where(turn, n_miss, np.inf), axis=1, kind="stable")  # ties by channel
    own = [[np.flatnonzero((order[:, t] == j) & turn[:, j]) for j in range(d)] for t in range(d)]
    for _ in range(max_iter):
        for t in range(d):
            for j in range(d):
                some = own[t][j]
                if not len(some):
                    continue
                fit, gap = np.flatnonzero(~missing[:, j]), np.flatnonzero(missing[:, j])
                m = maps[np.ix_(some, fit)]
                g = (m @ grams[np.ix_(some, fit)] @ m.transpose(0, 1, 3, 2)).sum(axis=1)
                n, mean = g[:, 0, 0], g[:, 0] / g[:, 0, :1]
                s = g - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
                x = [k + 1 for k in range(d) if k != j]
                coef = ridge_of_all(n, s[:, x][:, :, x], s[:, x, j + 1], s[:, j + 1, j + 1])
                row = np.zeros((len(some), d + 1))
                row[:, x] = coef
                row[:, 0] = mean[:, j + 1] - (coef * mean[:, x]).sum(axis=1)
                maps[some[:, None], gap[None], j + 1] = np.einsum("sd,spde->spe", row, maps[np.ix_(some, gap)])
    return maps[:, :, 1:]


def fill_block(cells, x, feats, max_iter: int) -> dict:
    """M6 over the whole series of a block (a step of ``blocks``)."""
    d, g = len(feats), cells.g
    if d > MAX_CHANNELS:
        raise ValueError(f"MICE takes up to {MAX_CHANNELS} channels")
    gaps = [np.isnan(x[f]) for f in feats]
    mask = sum((v.astype(np.int64) << i for i, v in enumerate(gaps)), np.zeros(len(g), dtype=np.int64))
    means = [cells.moments(x[f])["_mean"] for f in feats]
    z = np.column_stack([np.ones(len(g)), *[np.where(v, 0.0, x[f] - mean[g]) for f, v, mean in zip(feats, gaps, means)]])
    masks, pattern = np.unique(mask, return_inverse=True)
    cell = g * len(masks) + pattern
    grams = np.zeros((cells.n, len(masks), d + 1, d + 1))
    for a in range(d + 1):
        for b in range(a, d + 1):
            grams[:, :, a, b] = grams[:, :, b, a] = np.bincount(cell, z[:, a] * z[:, b], cells.n * len(masks)).reshape(cells.n, -1)
    maps = maps_of_all(masks, grams, d, max_iter)
    out = {}
    for i, f in enumerate(feats):
        at = np.flatnonzero(gaps[i])
        if len(at):
            y = x[f].copy()
            y[at] = means[i][g[at]] + np.einsum("rk,rk->r", maps[g[at], pattern[at], i], z[at])
            out[f] = y
    return out


def mice_impute(sig: Signal, max_iter: int = 10) -> Signal:
    """M6.  A channel without any value in a series stays NULL there; a single channel gets its mean."""
    from . import blocks
    from .transform import series_stats
    if sig.plan is not None:
        return blocks.then(sig, fill_block, max_iter, heavy=True)
    keys, feats = list(sig.keys), list(sig.features)
    d = len(feats)
    if d > MAX_CHANNELS:
        raise ValueError(f"MICE takes up to {MAX_CHANNELS} channels")
    st = series_stats(sig, moments=True).select(*keys, *[F.col(f"_mean__{i}") for i in range(d)])
    rows = attach(sig.df, st, keys, bound=sig.n_series + 1)
    mask = F.lit(0).cast("long")
    for i, c in enumerate(feats):
        mask = mask.bitwiseOR(F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    rows = rows.select("*", F.lit(0).alias("_g"), mask.alias("_mask"),
                       *[F.coalesce(F.col(c) - F.col(f"_mean__{i}"), F.lit(0.0)).alias(f"_z{i}") for i, c in enumerate(feats)])
    z = [F.lit(1.0)] + [F.col(f"_z{i}") for i in range(d)]
    at = [(a, b) for a in range(d + 1) for b in range(a, d + 1)]
    by = keys + ["_g", "_mask"]
    grams = rows.groupBy(*by).agg(F.array(*[F.sum(z[a] * z[b]) for a, b in at]).alias("_s"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_mask")
        g = np.zeros((len(pdf), d + 1, d + 1))
        for (a, b), v in zip(at, np.stack(pdf["_s"].to_numpy()).T):
            g[:, a, b] = g[:, b, a] = v
        maps = pattern_maps(pdf["_mask"].to_numpy(), g, d, max_iter)
        return pdf[by].assign(_a=list(maps.reshape(len(pdf), -1)))

    kschema = [f"`{f.name}` {f.dataType.simpleString()}" for f in sig.df.schema.fields if f.name in keys]
    maps = grams.groupBy(*keys, "_g").applyInPandas(solve, ", ".join(kschema + ["_g int", "_mask long", "_a array<double>"]))
    out = attach(rows, maps, by)
    new = {}
    for i, c in enumerate(feats):
        dot = F.col("_a")[i * (d + 1)]
        for k in range(d):
            dot = dot + F.col("_a")[i * (d + 1) + k + 1] * F.col(f"_z{k}")
        new[c] = F.coalesce(F.col(c), F.col(f"_mean__{i}") + dot)
    return sig.with_df(out.select(*[new[c].alias(c) if c in new else F.col(c) for c in sig.df.columns]))
