"""Feature-wise recommended pipeline, methods chosen as data.

Each (series, feature) gets its rule codes from its evaluation profile; the
codes are pivoted to one row per series and joined to the rows, and every
branch is a ``when`` over shared statistics, so all features of all series
are handled in one pass per step:
  missing: LOCF_or_Mean -> forward, backward, then mean; KNN codes -> deferred
  outlier: ZScore -> z-score; MAD codes -> 3*MAD; IQR codes and IsolationForest -> IQR
  remaining gaps -> one exact KNN pass over all features
  scaling: rule on the re-profiled feature (standard / robust / min-max, after a mean fill)
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.stats import attach
from ..operators import blocks as B
from ..operators import profile as P
from ..operators import recommend as R
from ..operators import transform as X
from ..operators.knn import knn_impute
from ..operators.sequence import carry_valid
from ..signal import Signal


def _codes(sig: Signal, which: str):
    keys = list(sig.keys)
    rec = R.recommend_rules(P.profile_ev(sig))
    aggs = [F.max(F.when(F.col("feature") == f, F.col(which))).alias(f"_code{i}") for i, f in enumerate(sig.features)]
    return (rec.groupBy(*keys) if keys else rec.groupBy()).agg(*aggs)


def _coded(sig: Signal, which: str, fn) -> Signal | None:
    """A plan with the step ``fn`` by the rule codes ``which`` of its series; None where it can't be one."""
    name = f"_{which.split('_')[-1]}"
    codes = _codes(sig, which).withColumnsRenamed({f"_code{i}": f"{name}{i}" for i in range(len(sig.features))})
    with_codes = B.attached(sig, codes)
    return None if with_codes is None else B.then(with_codes, fn, name)


def _by_code(cells, x, feats, name, choices) -> dict:
    """Every channel as the first choice (rule of the code, how) that fits its series' code gives it."""
    out = {}
    for i, f in enumerate(feats):
        codes = B.of_series(cells, f"{name}{i}")
        y, left = x[f], np.ones(cells.n, dtype=bool)
        for fits, how in choices:
            mine = np.array([bool(fits(c)) for c in codes], dtype=bool) & left
            left &= ~mine
            if mine.any():
                y = np.where(mine[cells.g], how(f), y)
        out[f] = y
    return out


def _fill_step(cells, x, feats, name) -> dict:
    return _by_code(cells, x, feats, name, [(lambda c: c == "LOCF_or_Mean", lambda f: B.fill(cells, x, (f,), "LOCF", "ev").get(f, x[f]))])


def _mask_step(cells, x, feats, name) -> dict:
    masked = lambda method: lambda f: np.where(B.odd(cells, x[f], method, 3, 1.5, 3, "ev"), np.nan, x[f])
    return _by_code(cells, x, feats, name, [(lambda c: c == "ZScore", masked("Z-Score")), (lambda c: c is not None and "MAD" in c, masked("MAD")), (lambda c: True, masked("IQR"))])


def _scale_step(cells, x, feats, name) -> dict:
    scaled = lambda method: lambda f: B.scaled(cells, x[f], method)
    return _by_code(cells, x, feats, name, [(lambda c: c == "StandardScaler", scaled("StandardScaler")), (lambda c: c == "RobustScaler", scaled("RobustScaler")),
                                            (lambda c: True, scaled("MinMaxScaler"))])


def _on_blocks(sig: Signal) -> Signal | None:
    """The same stages as steps of a plan."""
    cur = _coded(sig, "recommended_missing", _fill_step)
    if cur is None:
        return None
    cur = _coded(cur, "recommended_outlier", _mask_step)
    cur = knn_impute(cur, k=5).materialize()
    codes = _codes(cur, "recommended_normalization")
    cur = B.attached(cur, codes.withColumnsRenamed({f"_code{i}": f"_scaling{i}" for i in range(len(cur.features))}))
    return B.then(X.filled(cur, "ev"), _scale_step, "_scaling")


def featurewise_recommended(sig: Signal) -> Signal:
    if sig.plan is not None and not sig.plan.labels:
        done = _on_blocks(sig)
        return featurewise_recommended(sig.with_df(sig.df)) if done is None else done
    keys, feats = list(sig.keys), list(sig.features)
    bound = sig.n_series + 1
    # missing values by code
    mv = _codes(sig, "recommended_missing").persist()
    st = X.series_stats(sig, moments=True)
    d = attach(carry_valid(sig.df, keys, feats), mv, keys, bound=bound)
    d = attach(d, st, keys, bound=bound)
    new = {}
    for i, f in enumerate(feats):
        locf = F.coalesce(F.col(f), F.col(f"_pv{i}.v"), F.col(f"_nv{i}.v"), F.col(f"_mean__{i}"))
        new[f] = F.when(F.col(f"_code{i}") == "LOCF_or_Mean", locf).otherwise(F.col(f))
    s1 = sig.with_df(d.select(*[new[c].alias(c) if c in new else F.col(c) for c in sig.df.columns])).materialize()
    # outliers by code (evaluation variants, m >= 5)
    oc = _codes(sig, "recommended_outlier").persist()
    st1 = X.series_stats(s1, moments=True, quantiles={"_q1": 0.25, "_q3": 0.75}, mad=True)
    d = attach(attach(s1.df, oc, keys, bound=bound), st1, keys, bound=bound)
    new = {}
    for i, f in enumerate(feats):
        x, s = F.col(f), (lambda n: F.col(f"{n}__{i}"))
        en = s("_m") >= 5
        z = en & (s("_sd") > 0) & (F.abs((x - s("_mean")) / s("_sd")) > 3)
        mad = en & (s("_mad") > 0) & (F.abs(x - s("_med")) > 3 * s("_mad"))
        iqr = s("_q3") - s("_q1")
        iq = en & (iqr > 0) & ((x < s("_q1") - 1.5 * iqr) | (x > s("_q3") + 1.5 * iqr))
        code = F.col(f"_code{i}")
        bad = F.when(code == "ZScore", z).when(code.contains("MAD"), mad).otherwise(iq)
        new[f] = F.when(F.coalesce(bad, F.lit(False)), F.lit(None).cast("double")).otherwise(x)
    s2 = s1.with_df(d.select(*[new[c].alias(c) if c in new else F.col(c) for c in s1.df.columns])).materialize()
    # one KNN pass for whatever is still missing
    s3 = knn_impute(s2, k=5).materialize()
    # scaling by the rule on the re-profiled feature
    nc = _codes(s3, "recommended_normalization").persist()
    st3 = X.series_stats(s3, moments=True)
    filled = s3.with_df(attach(s3.df, st3, keys, bound=bound).select(
        *[F.coalesce(F.col(c), F.col(f"_mean__{feats.index(c)}"), F.lit(0.0)).alias(c) if c in feats else F.col(c)
          for c in s3.df.columns])).materialize()
    st4 = X.series_stats(filled, moments=True, quantiles={"_q1": 0.25, "_med": 0.5, "_q3": 0.75})
    d = attach(attach(filled.df, nc, keys, bound=bound), st4, keys, bound=bound)
    new = {}
    for i, f in enumerate(feats):
        x, s = F.col(f), (lambda n: F.col(f"{n}__{i}"))
        std = F.when(s("_sdp") > 0, (x - s("_mean")) / s("_sdp")).otherwise(x - s("_mean"))
        iqr = s("_q3") - s("_q1")
        rob = F.when(iqr > 0, (x - s("_med")) / iqr).otherwise(x - s("_med"))
        rng = s("_max") - s("_min")
        mm = F.when(rng > 0, (x - s("_min")) / rng).otherwise(x - s("_min"))
        code = F.col(f"_code{i}")
        new[f] = F.when(code == "StandardScaler", std).when(code == "RobustScaler", rob).otherwise(mm)
    return filled.with_df(d.select(*[new[c].alias(c) if c in new else F.col(c) for c in filled.df.columns]))
