"""Exact KNN imputation (M5) without pair rows.

Donors of a receiver are the rows of the same series that have the target
feature.  Receivers (rows with a gap) and donors are dealt by hash into bounded
chunks; each group holds one chunk of receivers and one of donors, computes
NaN-aware Euclidean distances (scaled by the share of shared coordinates) in
NumPy and emits only its k best donors per (receiver, feature).  A second step
merges those short lists: k smallest by (distance, donor position), mean of
their values.  Receivers with no defined distance get the series mean.  Nothing
passes the driver.  Short series (see ``short``) are filled in groups of whole
series instead.  Exact KNN stays receivers x donors work inside a series:
every donor chunk is sent once per receiver chunk of its series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.stats import attach
from ..signal import Signal
from . import blocks as B
from . import short

# rows of a group: at most about 1,024 x 8,192 distances (64 MB) per array
RECEIVER_ROWS = 1024
DONOR_ROWS = 8192


def _k_best(keys, feats, k):
    """(receivers, donors) of one group -> the k best donors per receiver and feature."""
    names = keys + ["pos", "_f", "_d", "_dp", "_v"]

    def fn(rec: pd.DataFrame, don: pd.DataFrame) -> pd.DataFrame:
        if rec.empty or don.empty:
            return rec.assign(_f=0, _d=0.0, _dp=0, _v=0.0)[names].iloc[:0]
        don = don.sort_values("pos")  # ties go to the first position
        r, d = rec[feats].to_numpy(dtype=float), don[feats].to_numpy(dtype=float)
        has_r, has_d = ~np.isnan(r), ~np.isnan(d)
        r, d = np.where(has_r, r, 0.0), np.where(has_d, d, 0.0)
        shared = has_r.astype(float) @ has_d.T.astype(float)
        sq = np.zeros(shared.shape)
        for j in range(len(feats)):
            sq += ((r[:, None, j] - d[None, :, j]) * (has_r[:, None, j] & has_d[None, :, j])) ** 2
        with np.errstate(divide="ignore", invalid="ignore"):
            dist = np.where(shared > 0, np.sqrt(len(feats) / shared * sq), np.inf)
        rpos, dpos = rec["pos"].to_numpy(), don["pos"].to_numpy()
        outs = []
        for j in range(len(feats)):
            ri, di = np.flatnonzero(~has_r[:, j]), np.flatnonzero(has_d[:, j])
            sub = dist[np.ix_(ri, di)]
            best = np.argsort(sub, axis=1, kind="stable")[:, :k]
            dv = np.take_along_axis(sub, best, axis=1)
            row, col = np.nonzero(np.isfinite(dv))
            sel = di[best[row, col]]
            outs.append(pd.DataFrame({"pos": rpos[ri[row]], "_f": j, "_d": dv[row, col], "_dp": dpos[sel], "_v": d[sel, j]}))
        out = pd.concat(outs, ignore_index=True)
        return out.assign(**{c: rec[c].iloc[0] for c in keys})[names]
    return fn


def knn_impute(sig: Signal, k: int = 5, receiver_rows: int = RECEIVER_ROWS, donor_rows: int = DONOR_ROWS) -> Signal:
    keys, feats = list(sig.keys), list(sig.features)
    if sig.plan is not None:
        return B.then(sig, B.knn, k, heavy=True)
    if short.is_short(sig):
        return sig.with_df(short.knn_rows(sig, k))
    gap = F.lit(False)
    for f in feats:
        gap = gap | F.col(f).isNull()
    sizes = sig.df.groupBy(*keys).agg(F.count_if(gap).alias("_nr"), F.count(F.lit(1)).alias("_nd"))
    sizes = sizes.select(*keys, F.ceil(F.col("_nr") / receiver_rows).cast("int").alias("_rc"),
                         F.ceil(F.col("_nd") / donor_rows).cast("int").alias("_dc")).where("_rc > 0")
    rows = attach(sig.df.select(*keys, "pos", *feats), sizes, keys, how="inner", bound=sig.n_series + 1)
    h = F.xxhash64("pos")
    cols = [*keys, "pos", *feats]
    rec = rows.where(gap).select(*cols, F.pmod(h, F.col("_rc")).cast("int").alias("_c"),
                                 F.explode(F.sequence(F.lit(0), F.col("_dc") - 1)).alias("_b"))
    # new names for the columns, so that the two sides of one table stay apart
    don = rows.select(*[F.col(c).alias(c) for c in cols], F.pmod(h, F.col("_dc")).cast("int").alias("_b"),
                      F.explode(F.sequence(F.lit(0), F.col("_rc") - 1)).alias("_c"))
    kschema = [f"`{f.name}` {f.dataType.simpleString()}" for f in sig.df.schema.fields if f.name in keys]
    part = keys + ["_c", "_b"]
    cands = rec.groupBy(*part).cogroup(don.groupBy(*part)).applyInPandas(
        _k_best(keys, feats, k), ", ".join(kschema + ["pos long", "_f int", "_d double", "_dp long", "_v double"]))
    # merge per (receiver, feature): at most donor chunks x k candidates
    w = Window.partitionBy(*keys, "pos", "_f").orderBy("_d", "_dp")
    top = cands.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k)
    fill = top.groupBy(*keys, "pos").agg(*[F.avg(F.when(F.col("_f") == j, F.col("_v"))).alias(f"_knn{j}")
                                           for j in range(len(feats))])
    from .transform import series_stats
    st = series_stats(sig, moments=True)
    d = sig.df.join(fill, on=keys + ["pos"], how="left")
    d = attach(d, st.select(*keys, *[f"_mean__{j}" for j in range(len(feats))]) if keys
               else st.select(*[f"_mean__{j}" for j in range(len(feats))]), keys, bound=sig.n_series + 1)
    new = {f: F.coalesce(F.col(f), F.col(f"_knn{j}"), F.col(f"_mean__{j}")) for j, f in enumerate(feats)}
    out = d.select(*[new[c].alias(c) if c in new else F.col(c) for c in sig.df.columns])
    return sig.with_df(out)
