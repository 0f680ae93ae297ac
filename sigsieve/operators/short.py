"""Statistics of short series: whole series in bounded groups, one shuffle of the rows.

Where no series has more than ``SHORT_ROWS`` rows, Spark deals whole series by hash
into groups of about ``GROUP_ROWS`` rows and NumPy works on all series of a group at
once: rows are sorted by (series, position) and by (series, value), and every
statistic is a sum or a pick by series.  So a profile needs no unpivoted copy of the
rows, no value map and no join by row.  Longer series take the windows and the
bracketed quantiles of ``profile``, ``audit`` and ``transform``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..signal import Signal

SHORT_ROWS = 65_536
#: Rows of a group on average; a group holds at least one whole series.
GROUP_ROWS = 16_384
#: Distances that KNN holds at once.
DISTANCES = 1 << 22

COUNTS = ("_n", "_m", "_gmax", "_gruns", "_lastp", "_nd", "_iqr_n", "_mad_n", "_o")
REALS = ("_sd", "_min", "_max", "_g1", "_g2", "_q1", "_q3", "_med", "_mad", "_dsd", "_rrange", "_ent", "corr_mean_abs", "_draw", "_imputed", "_dprev")


def is_short(sig: Signal) -> bool:
    return bool(sig.keys) and sig.max_series_rows is not None and sig.max_series_rows <= SHORT_ROWS


def in_groups(df: DataFrame, keys: Sequence[str], rows: int, fn: Callable[[pa.Table], pa.Table], schema) -> DataFrame:
    """fn over groups of whole series (rows of equal ``keys``); ``rows``: about how many there are."""
    n = max(1, -(-int(rows) // GROUP_ROWS))
    return df.withColumn("_g", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")).groupBy("_g").applyInArrow(fn, schema)


def _ddl(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for k in keys for f in df.schema.fields if f.name == k]


def _codes(t: pa.Table, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number from 0 for the series of every row, and a row of each series."""
    code = np.zeros(t.num_rows, dtype=np.int64)
    for k in keys:
        d = pa.concat_arrays(t[k].chunks).dictionary_encode(null_encoding="encode")
        code = code * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False)
    _, first, series = np.unique(code, return_index=True, return_inverse=True)
    return series, first


def _values(t: pa.Table, c: str) -> np.ndarray:
    return t[c].to_numpy().astype(float)  # NULL is NaN


class _Sorted:
    """The values of one channel, by series and size."""

    def __init__(self, g: np.ndarray, x: np.ndarray, n_series: int):
        self.m = np.bincount(g, minlength=n_series)
        self.start = np.cumsum(self.m) - self.m
        if (g[1:] >= g[:-1]).all():  # series by series already: each is sorted by itself
            self.g, self.x = g, x.copy()
            for a, b in zip(self.start.tolist(), (self.start + self.m).tolist()):
                self.x[a:b].sort()
        else:
            order = np.lexsort((x, g))
            self.g, self.x = g[order], x[order]

    def at(self, rank: np.ndarray) -> np.ndarray:
        """The value of that rank from 0 in each series; NaN without any."""
        out = np.full(len(self.m), np.nan)
        some = self.m > 0
        out[some] = self.x[(self.start + rank.astype(np.int64))[some]]
        return out

    def quantile(self, p: float) -> np.ndarray:
        """By linear interpolation, in the terms of Spark's ``percentile``."""
        place = p * (self.m - 1)
        low, high = np.floor(place), np.ceil(place)
        a, b = self.at(np.maximum(low, 0)), self.at(np.maximum(high, 0))
        return np.where((low == high) | (a == b), a, (high - place) * a + (place - low) * b)

    def deviations(self, mid: np.ndarray) -> "_Sorted":
        return _Sorted(self.g, np.abs(self.x - mid[self.g]), len(self.m))

    def distinct(self) -> np.ndarray:
        new = np.ones(len(self.x), dtype=bool)
        new[1:] = (self.x[1:] != self.x[:-1]) | (self.g[1:] != self.g[:-1])
        return np.bincount(self.g[new], minlength=len(self.m))


def _sum(g: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(g, weights=x, minlength=n)


def _centred(g: np.ndarray, x: np.ndarray, m: np.ndarray, constant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean of each series and x less it; exactly 0 in a constant series."""
    mean = _sum(g, x, len(m)) / m
    y = x - mean[g]
    y -= (_sum(g, y, len(m)) / m)[g]
    y[constant[g]] = 0.0
    return mean, y


def _spread(g: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Sample deviation by series; NaN for fewer than two values."""
    s = _Sorted(g, x, n)
    _, y = _centred(g, x, s.m, s.at(np.zeros(n)) == s.at(np.maximum(s.m - 1, 0)))
    return np.where(s.m > 1, np.sqrt(_sum(g, y * y, n) / (s.m - 1)), np.nan)


def _moments(g: np.ndarray, x: np.ndarray, s: _Sorted) -> dict[str, np.ndarray]:
    n, m = len(s.m), s.m
    low, high = s.at(np.zeros(n)), s.at(np.maximum(m - 1, 0))
    mean, y = _centred(g, x, m, low == high)
    m2, m3, m4 = (_sum(g, y ** k, n) for k in (2, 3, 4))
    flat = m2 == 0
    return {"_m": m, "_mean": mean, "_sd": np.where(m > 1, np.sqrt(m2 / (m - 1)), np.nan), "_sdp": np.sqrt(m2 / m), "_min": low, "_max": high,
            "_g1": np.where(flat, np.nan, np.sqrt(m) * m3 / m2 ** 1.5), "_g2": np.where(flat, np.nan, m * m4 / (m2 * m2) - 3), "_y": y}


def _runs(g: np.ndarray, x: np.ndarray, pos: np.ndarray, m: np.ndarray) -> dict[str, np.ndarray]:
    """Gaps before a value, the last value's place, and the spread of the steps from value to value."""
    n, some = len(m), m > 0
    head = np.ones(len(x), dtype=bool)
    head[1:] = g[1:] != g[:-1]
    gap = pos - np.where(head, 0, np.roll(pos, 1)) - 1
    widest, last = np.full(n, np.nan), np.full(n, np.nan)
    if len(x):
        widest[some] = np.maximum.reduceat(gap, np.flatnonzero(head))
        last[some] = pos[(np.cumsum(m) - 1)[some]]
    step = (x - np.roll(x, 1))[~head]
    return {"_gmax": widest, "_gruns": np.bincount(g[gap > 0], minlength=n), "_lastp": last, "_dsd": _spread(g[~head], step, n)}


def _drift(g: np.ndarray, y: np.ndarray, m: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Range of the trailing rolling mean over the valid values; in units of the deviation until the end, so that
    prefix sums over series of other sizes lose no digits."""
    start = np.cumsum(m) - m
    unit = np.where(sd > 0, sd, 1.0)
    total = np.concatenate([[0.0], np.cumsum(y / unit[g])])
    at = np.arange(len(y))
    rank = at - start[g] + 1
    w = np.maximum(10, np.floor(m * 0.08).astype(np.int64))[g]
    least = np.maximum(5, w // 3)
    roll = np.where(rank >= w, (total[at + 1] - total[np.maximum(at + 1 - w, 0)]) / w, (total[at + 1] - total[start[g]]) / rank)
    kept = rank >= least
    out = np.full(len(m), np.nan)
    if kept.any():
        gk, rk = g[kept], roll[kept]
        heads = np.flatnonzero(np.concatenate([[True], gk[1:] != gk[:-1]]))
        out[gk[heads]] = np.maximum.reduceat(rk, heads) - np.minimum.reduceat(rk, heads)
    return out * unit


def _entropy(g: np.ndarray, x: np.ndarray, m: np.ndarray, nd: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Normalised entropy of an equal-width histogram."""
    ok = (m >= 10) & (nd > 1)
    bins = np.minimum(30, np.maximum(5, np.floor(np.sqrt(m)).astype(np.int64)))
    k = ok[g]
    g, x = g[k], x[k]
    b = np.minimum(bins[g] - 1, np.floor((x - low[g]) / (high[g] - low[g]) * bins[g]).astype(np.int64))
    c = np.bincount(g * 30 + b, minlength=30 * len(m)).reshape(-1, 30)
    p = c / np.maximum(m, 1)[:, None]
    h = -(p * np.log(np.where(c > 0, p, 1.0))).sum(axis=1)
    used = (c > 0).sum(axis=1)
    return np.where(ok, np.where(used > 1, h / np.log(np.maximum(used, 2)), 1.0), np.nan)


def _correlations(g: np.ndarray, x: list[np.ndarray], n: int) -> list[np.ndarray]:
    """Mean |Pearson r| of each channel with the others over rows that have both; 0 without any."""
    total, count = [np.zeros(n) for _ in x], [np.zeros(n) for _ in x]
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            both = ~np.isnan(x[i]) & ~np.isnan(x[j])
            gb = g[both]
            a, b = (_moments(gb, v, _Sorted(gb, v, n)) for v in (x[i][both], x[j][both]))
            r = np.abs(_sum(gb, a["_y"] * b["_y"], n) / a["_m"] / (a["_sdp"] * b["_sdp"]))
            there = (a["_sdp"] * b["_sdp"] > 0) & ~np.isnan(r)
            for k in (i, j):
                total[k] += np.where(there, r, 0.0)
                count[k] += there
    return [np.where(c > 0, t / np.maximum(c, 1), 0.0) for t, c in zip(total, count)]


def _channel(g: np.ndarray, pos: np.ndarray, x: np.ndarray, rows: np.ndarray, plain: bool, iqr_factor: float, mad_thresh: float, s: _Sorted | None = None) -> dict[str, np.ndarray]:
    """What a profile is made of, for one channel of all series; ``plain``: what the evaluation profile needs."""
    n, there = len(rows), ~np.isnan(x)
    gv, v = g[there], x[there]
    s = s or _Sorted(gv, v, n)
    out = {"_n": rows, **_moments(gv, v, s)}
    y, m = out.pop("_y"), s.m
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    iqr = q3 - q1
    odd = (iqr > 0)[s.g] & ((s.x < (q1 - iqr_factor * iqr)[s.g]) | (s.x > (q3 + iqr_factor * iqr)[s.g]))
    out |= {"_q1": q1, "_q3": q3, "_o": np.bincount(s.g[odd], minlength=n)}
    if plain:
        return out
    med = s.quantile(0.5)
    mad = s.deviations(med).quantile(0.5)
    far = (mad > 0)[s.g] & (np.abs(0.6745 * (s.x - med[s.g]) / mad[s.g]) > mad_thresh)
    enough, nd = m >= 4, s.distinct()
    out |= {"_med": med, "_mad": mad, "_iqr_n": np.where(enough, out["_o"], 0), "_mad_n": np.where(enough, np.bincount(s.g[far], minlength=n), 0), "_nd": nd}
    out |= _runs(gv, v, pos[there], m)
    return out | {"_rrange": _drift(gv, y, m, out["_sd"]), "_ent": _entropy(gv, v, m, nd, out["_min"], out["_max"])}


def _changes(g: np.ndarray, x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    both = ~np.isnan(x) & ~np.isnan(y)
    count = np.bincount(g[both], minlength=n)
    return np.where(count > 0, _sum(g[both], np.abs(x[both] - y[both]), n) / np.maximum(count, 1), 0.0)


def _table(keys: pa.Table, per_feature: list[dict[str, np.ndarray]]) -> pa.Table:
    """One row per series and channel; a statistic that wasn't computed is NULL."""
    parts = []
    for i, st in enumerate(per_feature):
        t = keys.append_column("_f", pa.array(np.full(keys.num_rows, i, dtype=np.int32)))
        for names, kind in ((COUNTS, pa.int64()), (REALS, pa.float64())):
            for c in names:
                t = t.append_column(c, pa.array(st[c].astype(float), from_pandas=True).cast(kind) if c in st else pa.nulls(keys.num_rows, kind))
        parts.append(t)
    return pa.concat_tables(parts)


def profile_rows(sig: Signal, plain: bool = False, with_correlation: bool = False, iqr_factor: float = 1.5, mad_thresh: float = 3.5,
                 raw: Signal | None = None, lag: str | None = None) -> DataFrame:
    """(keys, _f, statistics) per series and channel, one group holding whole series.

    ``raw``: the signal that the labelled one came from, for the changes against it (``_draw``, ``_imputed``); ``lag``: the
    integer label whose predecessor the change ``_dprev`` is against."""
    keys, feats = list(sig.keys), list(sig.features)
    schema = ", ".join([*_ddl(sig.df, keys), "_f int", *[f"`{c}` bigint" for c in COUNTS], *[f"`{c}` double" for c in REALS]])
    if sig.plan is not None and (raw is None or _beside(sig, raw)):
        return _profile_blocks(sig, plain, with_correlation, iqr_factor, mad_thresh, raw, lag, schema)
    base, against = list(raw.keys) if raw is not None else keys, raw is not None
    rows = sig.df.select(*keys, "pos", *[F.col(f).cast("double").alias(f) for f in feats], F.lit(False).alias("_ref"))
    count = sig.meta.get("n_rows") or 0
    if raw is not None:
        kinds = dict(sig.df.dtypes)
        ref = raw.df.select(*base, *[F.lit(None).cast(kinds[k]).alias(k) for k in keys if k not in base], "pos",
                            *[F.col(f).cast("double").alias(f) for f in feats], F.lit(True).alias("_ref"))
        rows, count = rows.unionByName(ref), count + (raw.meta.get("n_rows") or 0)

    def group(t: pa.Table) -> pa.Table:
        with np.errstate(all="ignore"):
            is_ref = t["_ref"].to_numpy()
            pos = t["pos"].to_numpy()
            x = [_values(t, f) for f in feats]
            of_base, _ = _codes(t, base)
            mine = np.flatnonzero(~is_ref)
            own = t.take(pa.array(mine))
            g, first = _codes(own, keys)
            n = len(first)
            if not n:
                return _table(own.select(keys), [{}] * len(feats))
            order = np.lexsort((pos[mine], g))
            at, g = mine[order], g[order]
            size = np.bincount(g, minlength=n)
            start = np.cumsum(size) - size
            xs, p = [v[at] for v in x], pos[at]
            out = [_channel(g, p, v, size, plain, iqr_factor, mad_thresh) for v in xs]
            for i, r in enumerate(_correlations(g, xs, n) if with_correlation and len(xs) > 1 else [np.zeros(n)] * len(xs)):
                out[i]["corr_mean_abs"] = r
            if against:
                refs = np.flatnonzero(is_ref)
                refs = refs[np.lexsort((pos[refs], of_base[refs]))]
                held = np.bincount(of_base[refs], minlength=int(of_base.max()) + 1)
                there = refs[(np.cumsum(held) - held)[of_base[at]] + p - 1]  # positions are 1, 2, ... in each series
                if not ((pos[there] == p) & (of_base[there] == of_base[at])).all():
                    raise ValueError("rows that the raw signal lacks")
                for i, v in enumerate(xs):
                    y = x[i][there]
                    out[i]["_draw"] = _changes(g, v, y, n)
                    out[i]["_imputed"] = _sum(g, (np.isnan(y) & ~np.isnan(v)).astype(float), n) / size * 100
            if lag:
                no = own[lag].to_numpy()[first].astype(np.int64)
                name = of_base[mine][first] * (int(no.max()) + 2) + no
                by_name = np.argsort(name)
                found = np.minimum(np.searchsorted(name[by_name], name - 1), n - 1)
                before = by_name[found]
                known = (name[before] == name - 1) & (no > 0)
                there = np.where(known[g], start[before][g] + p - 1, 0)
                for i, v in enumerate(xs):
                    out[i]["_dprev"] = _changes(g, v, np.where(known[g], v[there], np.nan), n)
            return _table(own.select(keys).take(pa.array(first)), out)

    return in_groups(rows, base, count, group, schema)


def _beside(sig: Signal, raw: Signal) -> bool:
    """Whether raw is one variant of the blocks of sig, with the same channels."""
    from . import blocks as B
    return B.shared(sig, raw) and len(raw.plan.variants) == 1 and raw.features == sig.features


def _profile_blocks(sig: Signal, plain: bool, with_correlation: bool, iqr_factor: float, mad_thresh: float, raw: Signal | None, lag: str | None, schema) -> DataFrame:
    """``profile_rows`` of a plan: all variants of a block together, nothing shuffled."""
    from . import blocks as B
    keys, feats, labels = list(sig.keys), list(sig.features), sig.plan.labels
    before = raw.plan.variants if raw is not None else ()

    def profiles(cells, variants):
        raws = [x for _, x in cells.variants(before)]
        by_no = {values[labels.index(lag)]: x for values, x in variants} if lag else {}

        def channel(v):
            return cells.once(("profile", plain), v, lambda: _channel(cells.g, cells.pos, v, cells.size, plain, iqr_factor, mad_thresh, cells.sorted(v)))

        for values, x in variants:
            out = [dict(channel(x[f])) for f in feats]
            for i, r in enumerate(_correlations(cells.g, [x[f] for f in feats], cells.n) if with_correlation and len(feats) > 1 else [np.zeros(cells.n)] * len(feats)):
                out[i]["corr_mean_abs"] = r
            for i, f in enumerate(feats):
                for r in raws:
                    out[i]["_draw"] = _changes(cells.g, x[f], r[f], cells.n)
                    out[i]["_imputed"] = _sum(cells.g, (np.isnan(r[f]) & ~np.isnan(x[f])).astype(float), cells.n) / cells.size * 100
                if lag:
                    prev = by_no.get(values[labels.index(lag)] - 1)
                    out[i]["_dprev"] = np.zeros(cells.n) if prev is None else _changes(cells.g, x[f], prev[f], cells.n)
            yield _table(B.with_keys(cells, keys, dict(zip(labels, values))), out)

    return B.over_plan(sig, profiles, schema)


def stats_rows(sig: Signal, moments: bool, probs: dict[str, float], mad: bool) -> DataFrame:
    """One row per series: ``{stat}__{i}`` as ``transform.series_stats`` names them."""
    keys, feats = list(sig.keys), list(sig.features)
    own = ["_m", "_mean", "_sd", "_sdp", "_min", "_max"] if moments else []
    names = [*own, *probs, *(["_mad"] if mad else [])]

    def table(out: pa.Table, g: np.ndarray, xs: list[np.ndarray]) -> pa.Table:
        for i, x in enumerate(xs):
            there = ~np.isnan(x)
            gv, v = g[there], x[there]
            s = _Sorted(gv, v, out.num_rows)
            st = {k: s.quantile(p) for k, p in probs.items()}
            if moments:
                st |= _moments(gv, v, s)
            if mad:
                st["_mad"] = s.deviations(st["_med"]).quantile(0.5)
            for c in names:
                out = out.append_column(f"{c}__{i}", pa.array(st[c].astype(float), from_pandas=True).cast(pa.int64() if c == "_m" else pa.float64()))
        return out

    def group(t: pa.Table) -> pa.Table:
        with np.errstate(all="ignore"):
            g, first = _codes(t, keys)
            return table(t.select(keys).take(pa.array(first)), g, [_values(t, f) for f in feats])

    schema = [*_ddl(sig.df, keys), *[f"`{c}__{i}` {'bigint' if c == '_m' else 'double'}" for i in range(len(feats)) for c in names]]
    if sig.plan is not None:
        from . import blocks as B
        labels = sig.plan.labels
        return B.over_plan(sig, lambda cells, variants: (table(B.with_keys(cells, keys, dict(zip(labels, values))), cells.g, [x[f] for f in feats])
                                                         for values, x in variants), ", ".join(schema))
    rows = sig.df.select(*keys, *[F.col(f).cast("double").alias(f) for f in feats])
    return in_groups(rows, keys, sig.meta.get("n_rows") or 0, group, ", ".join(schema))


def _nearest(x: np.ndarray, k: int) -> np.ndarray:
    """x (rows by position, channels; NaN: gap) with gaps set to the mean of the k nearest rows that have the channel, by
    NaN-aware distance, ties by position; the channel's mean where no distance is defined."""
    out, has = x.copy(), ~np.isnan(x)
    filled, held = np.where(has, x, 0.0), has.astype(float)
    width = x.shape[1]
    for j in range(width):
        empty, donors = np.flatnonzero(~has[:, j]), np.flatnonzero(has[:, j])
        if not len(empty) or not len(donors):
            continue
        mean, step = x[donors, j].mean(), max(1, DISTANCES // len(donors))
        for at in range(0, len(empty), step):
            some = empty[at:at + step]
            shared = held[some] @ held[donors].T
            sq = np.zeros(shared.shape)
            for c in range(width):
                sq += ((filled[some, c][:, None] - filled[donors, c][None, :]) * (has[some, c][:, None] & has[donors, c][None, :])) ** 2
            dist = np.where(shared > 0, np.sqrt(width / shared * sq), np.inf)
            most = min(k, len(donors))
            bound = np.partition(dist, most - 1, axis=1)[:, most - 1]
            row, col = np.nonzero((dist <= bound[:, None]) & np.isfinite(dist))
            order = np.lexsort((col, dist[row, col], row))  # donors are in order of position
            row, col = row[order], col[order]
            sizes = np.bincount(row, minlength=len(some))
            best = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row] < k
            total, n = _sum(row[best], x[donors[col[best]], j], len(some)), np.bincount(row[best], minlength=len(some))
            out[some, j] = np.where(n > 0, total / np.maximum(n, 1), mean)
    return out


def knn_rows(sig: Signal, k: int) -> DataFrame:
    """The rows of the signal with gaps filled by ``_nearest``."""
    keys, feats, columns = list(sig.keys), list(sig.features), sig.df.columns

    def group(t: pa.Table) -> pa.Table:
        with np.errstate(all="ignore"):
            g, _ = _codes(t, keys)
            order = np.lexsort((t["pos"].to_numpy(), g))
            t = t.select(columns).take(pa.array(order))
            x = np.column_stack([_values(t, f) for f in feats])
            cuts = np.flatnonzero(np.diff(g[order])) + 1
            x = np.concatenate([_nearest(part, k) for part in np.split(x, cuts)])
            for i, f in enumerate(feats):
                t = t.set_column(columns.index(f), f, pa.array(x[:, i], from_pandas=True))
        return t

    return in_groups(sig.df, keys, sig.meta.get("n_rows") or 0, group, sig.df.schema)


def _share_entropy(c: np.ndarray, total: np.ndarray) -> np.ndarray:
    p = c / total
    return -p * np.log2(np.where(c > 0, p, 1.0))


def spatial_rows(sig: Signal, x: str, y: str, bins: int) -> DataFrame:
    """(keys, gaze-space metrics) per series, as ``spatial.spatial_metrics`` defines them, and ``_ns``, the valid pairs."""
    keys, cells = list(sig.keys), bins * bins
    names = ("spatial_entropy", "spatial_kl", "spatial_gini", "transition_entropy", "path_length", "velocity_mean", "velocity_std")

    def table(out: pa.Table, g: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
        with np.errstate(all="ignore"):
            n = out.num_rows
            both = ~np.isnan(a) & ~np.isnan(b)
            head = np.concatenate([[True], g[1:] != g[:-1]])
            run = np.cumsum(head | ~both) - 1  # an incomplete row begins a new run
            longest = np.zeros(n)
            np.maximum.at(longest, g[np.flatnonzero(head | ~both)], _sum(run, both.astype(float), run[-1] + 1))
            g = g[both]
            ns = np.bincount(g, minlength=n)

            def scaled(v):
                s = _Sorted(g, v, n)
                low, high = s.at(np.zeros(n))[g], s.at(np.maximum(s.m - 1, 0))[g]
                return np.where(high > low, (v - low) / (high - low), 0.0)

            u, w = scaled(a[both]), scaled(b[both])
            cell = lambda v: np.clip(np.floor(v * bins), 0, bins - 1).astype(np.int64)
            symbol = cell(u) * bins + cell(w)
            c = np.bincount(g * cells + symbol, minlength=n * cells).reshape(n, cells)
            p = c / ns[:, None]
            rank = 2 * np.arange(cells) - cells + 1  # empty cells take the lowest ranks
            later = np.concatenate([[False], g[1:] == g[:-1]])[:len(g)]
            gt, at = g[later], np.flatnonzero(later)
            pair, times = np.unique((gt * cells + symbol[at - 1]) * cells + symbol[at], return_counts=True)
            of, steps = pair // (cells * cells), np.bincount(gt, minlength=n)
            step = np.sqrt((u[at] - u[at - 1]) ** 2 + (w[at] - w[at - 1]) ** 2)
            path = _sum(gt, step, n)
            mean = path / steps
            values = (_share_entropy(c, ns[:, None]).sum(axis=1), (p * np.log2(np.where(c > 0, p * cells, 1.0))).sum(axis=1),
                      (np.sort(p, axis=1) * rank).sum(axis=1) * 2 / (2.0 * cells), _sum(of, _share_entropy(times, steps[of]), n), path, mean,
                      np.sqrt(_sum(gt, (step - mean[gt]) ** 2, n) / steps))
            out = out.append_column("_ns", pa.array(ns, pa.int64())).append_column("effective_samples", pa.array(longest.astype(np.int64)))
            for name, v in zip(names, values):
                out = out.append_column(name, pa.array(v, from_pandas=True))
        return out

    def group(t: pa.Table) -> pa.Table:
        g, first = _codes(t, keys)
        order = np.lexsort((t["pos"].to_numpy(), g))
        return table(t.select(keys).take(pa.array(first)), g[order], _values(t, "_x")[order], _values(t, "_y")[order])

    rows = sig.df.select(*keys, "pos", F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    schema = [*_ddl(sig.df, keys), "_ns bigint", "effective_samples bigint", *[f"{c} double" for c in names]]
    if sig.plan is not None:
        from . import blocks as B
        labels = sig.plan.labels
        return B.over_plan(sig, lambda cells, variants: (table(B.with_keys(cells, keys, dict(zip(labels, values))), cells.g, v[x], v[y])
                                                         for values, v in variants), ", ".join(schema))
    return in_groups(rows, keys, sig.meta.get("n_rows") or 0, group, ", ".join(schema))
