"""Isolation forest per series and channel.

Each tree sees ``sample`` values, as the method defines, drawn by a hash of the
row.  A series of up to ROWS_WHOLE rows is one group; of a longer one no group
holds more than one tree's sample.  In one dimension a tree is a
step function of the value; the mean of all trees is one too, with at most
trees x sample steps.  Every row is scored by looking its value up in those steps,
in bounded groups of rows.  The share ``contamination`` with the shortest mean path
is masked (exact quantile over all rows).
"""

from __future__ import annotations

import math
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.stats import attach, exact_quantiles
from ..session import materialize
from ..signal import Signal

ROWS_PER_LOOKUP = 1 << 16
#: Series of up to so many rows are one group from the draw to the mask; longer ones are drawn, looked up and joined.
ROWS_WHOLE = 1 << 16
_SLACK = 1.3  # hash draws vary around their mean; drawing 1.3 samples leaves a whole one


@lru_cache(maxsize=4096)
def mean_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a random binary tree of n values."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def tree_steps(values: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[list, list]:
    """One random tree on sorted values: edges and the path length right of each."""
    v, draws = values.tolist(), iter(rng.random(2 * len(values)).tolist())  # a node takes one draw at most
    edges, depths = [], []
    todo = [(0, len(v), 0, -math.inf)]  # the left child is taken first, so leaves come in order
    while todo:
        lo, hi, depth, edge = todo.pop()
        a, b = v[lo], v[hi - 1]
        if depth < limit and b > a:
            cut = a + (b - a) * next(draws)
            if a <= cut < b:
                mid = bisect_right(v, cut, lo, hi)
                todo += ((mid, hi, depth + 1, cut), (lo, mid, depth + 1, edge))
                continue
        edges.append(edge)
        depths.append(depth + mean_path(hi - lo))
    return edges, depths


def forest_paths(x: np.ndarray, h: np.ndarray, n: int, trees: int, sample: int, seed: int) -> np.ndarray:
    """Mean path of every value of a whole channel: the trees' samples, their steps and the lookup, as for long series."""
    want = _SLACK * trees * sample
    copies = min(trees, math.ceil(want / n))
    drawn = np.flatnonzero((h & 0x7FFFFFFF) / float(1 << 31) < want / (n * copies))
    drawn = drawn[np.lexsort((x[drawn], h[drawn]))]
    first = (h[drawn].view(np.uint64) >> np.uint64(32)).astype(np.int64) % trees
    edges, jumps = [], []
    for t in range(trees):
        own = drawn[(t - first) % trees < copies][:sample]
        if len(own):
            rng = np.random.default_rng([seed, t, int(h[own[0]]) & 0x7FFFFFFFFFFFFFFF])
            e, d = tree_steps(np.sort(x[own]), rng, int(np.ceil(np.log2(sample))))
            edges += e
            jumps.append(np.diff(d, prepend=0.0))
    if not edges:
        return np.full(len(x), np.nan)
    at, place = np.unique(edges, return_inverse=True)
    path = np.cumsum(np.bincount(place, np.concatenate(jumps))) / trees
    return np.round(path[np.searchsorted(at, x, side="left") - 1], 9)


def quantile(values: np.ndarray, q: float) -> float:
    """Linear quantile, rounded as Spark's ``percentile`` rounds."""
    v, at = np.sort(values), (len(values) - 1) * q
    lo, hi = math.floor(at), math.ceil(at)
    return v[lo] if v[lo] == v[hi] else (hi - at) * v[lo] + (at - lo) * v[hi]


def _mask_whole(sig: Signal, df, st, contamination: float, trees: int, sample: int, seed: int):
    """The mask of series of up to ROWS_WHOLE rows, a group each: no sample, step or score leaves its group."""
    keys, feats, names = list(sig.keys), list(sig.features), sig.df.columns
    x = attach(df, st, keys, bound=sig.n_series + 1)
    x = x.select(*names, F.lit(0).alias("_g"), *[F.xxhash64(F.lit(seed), *keys, F.lit(i), "pos").alias(f"_h{i}") for i in range(len(feats))],
                 *[F.when(F.col(f"_max__{i}") > F.col(f"_min__{i}"), F.col(f"_med__{i}")).alias(f"_fill{i}") for i in range(len(feats))])

    def mask(t: pa.Table) -> pa.Table:
        out = t.select(names)
        for i, c in enumerate(feats):
            fill = t[f"_fill{i}"][0].as_py()
            if fill is None:  # a channel of one value, or of none
                continue
            p = forest_paths(t[c].cast(pa.float64()).fill_null(fill).to_numpy(), t[f"_h{i}"].to_numpy(), t["_n"][0].as_py(), trees, sample, seed)
            odd = pa.array(p < quantile(p, contamination))
            out = out.set_column(names.index(c), c, pc.if_else(odd, pa.scalar(None, pa.float64()), t[c].cast(pa.float64())))
        return out

    return x.groupBy(*keys, "_g").applyInArrow(mask, df.select(*names).schema)


def _mask_block(cells, x, feats, contamination: float, trees: int, sample: int, seed: int) -> dict:
    """The mask of the whole series of a block (a step of ``blocks``)."""
    from . import blocks
    out = {}
    for i, f in enumerate(feats):
        y, h = x[f].copy(), blocks.row_hashes(cells, i)
        st, med = cells.moments(x[f]), cells.quantile(x[f], 0.5)
        for k in np.flatnonzero(st["_max"] > st["_min"]).tolist():  # not a channel of one value, or of none
            part = slice(int(cells.first[k]), int(cells.first[k] + cells.size[k]))
            v = x[f][part]
            p = forest_paths(np.where(np.isnan(v), med[k], v), h[part], int(cells.size[k]), trees, sample, seed)
            y[part] = np.where(p < quantile(p, contamination), np.nan, v)
        out[f] = y
    return out


def isolation_forest_mask(sig: Signal, contamination: float = 0.05, trees: int = 100, sample: int = 256,
                          seed: int = 42) -> Signal:
    """Gaps count as the median while fitting; channels of one value are left alone."""
    from . import blocks
    from .transform import series_stats
    if sig.plan is not None and not sig.plan.labels and seed == blocks.HASH_SEED and sig.max_series_rows <= ROWS_WHOLE:
        return blocks.then(sig, _mask_block, contamination, trees, sample, seed, heavy=True)
    st = series_stats(sig, moments=True, quantiles={"_med": 0.5})
    how = (st, contamination, trees, sample, seed)
    longest = sig.max_series_rows
    if longest is not None and longest <= ROWS_WHOLE:
        return sig.with_df(_mask_whole(sig, sig.df, *how))
    short = _mask_whole(sig, sig.df.where(F.col("_n") <= ROWS_WHOLE), *how)
    return sig.with_df(_mask_long(sig.with_df(sig.df.where(F.col("_n") > ROWS_WHOLE)), *how).df.unionByName(short))


def _mask_long(sig: Signal, st, contamination: float, trees: int, sample: int, seed: int) -> Signal:
    """The mask of long series: no group holds more than one tree's sample, or ROWS_PER_LOOKUP rows."""
    keys, feats = list(sig.keys), list(sig.features)
    by = keys + ["_f"]
    cells = [F.struct(F.lit(i).alias("_f"), F.coalesce(F.col(c), F.col(f"_med__{i}")).alias("_x"),
                      (F.col(f"_max__{i}") > F.col(f"_min__{i}")).alias("_varies")) for i, c in enumerate(feats)]
    rows = attach(sig.df, st, keys, bound=sig.n_series + 1).select(*keys, "pos", "_n", F.inline(F.array(*cells)))
    rows = rows.where("_varies").withColumn("_h", F.xxhash64(F.lit(seed), *by, "pos")).drop("_varies")

    want = _SLACK * trees * sample
    copies = F.least(F.lit(trees), F.ceil(F.lit(want) / F.col("_n"))).cast("int")
    drawn = rows.where(F.col("_h").bitwiseAND(F.lit(0x7FFFFFFF)) / F.lit(float(1 << 31)) < want / (F.col("_n") * copies))
    tree = F.pmod(F.shiftrightunsigned("_h", 32) + F.col("_c"), F.lit(trees)).cast("int")
    drawn = drawn.select(*by, "_x", "_h", F.explode(F.sequence(F.lit(0), copies - 1)).alias("_c")).withColumn("_t", tree)
    w = Window.partitionBy(*by, "_t").orderBy("_h", "_x")
    drawn = drawn.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= sample).select(*by, "_t", "_x", "_h")
    limit = int(np.ceil(np.log2(sample)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(pdf["_t"].iloc[0]), int(pdf["_h"].min()) & 0x7FFFFFFFFFFFFFFF])
        edges, depths = tree_steps(np.sort(pdf["_x"].to_numpy()), rng, limit)
        out = pd.DataFrame({"_e": edges, "_d": np.diff(depths, prepend=0.0)})
        return out.assign(**{k: pdf[k].iloc[0] for k in by})[by + ["_e", "_d"]]

    ks = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in sig.df.schema.fields if f.name in keys] + ["_f int"])
    steps = drawn.groupBy(*by, "_t").applyInPandas(grow, ks + ", _e double, _d double")
    # the mean path right of each edge; at most trees x sample edges per series and channel
    steps = steps.groupBy(*by, "_e").agg(F.sum("_d").alias("_d"))
    run = Window.partitionBy(*by).orderBy("_e").rowsBetween(Window.unboundedPreceding, 0)
    steps = materialize(steps.select(*by, "_e", (F.sum("_d").over(run) / trees).alias("_p")))

    parts = F.ceil(F.col("_n") / ROWS_PER_LOOKUP).cast("int")
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("pos"), parts).cast("int"))
    need = rows.groupBy(*by).agg(F.max(parts).alias("_parts"))
    steps = steps.join(need, on=by).select(*by, "_e", "_p", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_b"))

    def look_up(r: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if r.empty:
            return r.assign(_p=0.0)[by + ["pos", "_p"]]
        s = s.sort_values("_e")
        at = np.searchsorted(s["_e"].to_numpy(), r["_x"].to_numpy(), side="left") - 1
        return r.assign(_p=np.round(s["_p"].to_numpy()[at], 9))[by + ["pos", "_p"]]

    part = by + ["_b"]
    scored = materialize(rows.select(*part, "pos", "_x").groupBy(*part).cogroup(steps.groupBy(*part)).applyInPandas(
        look_up, ks + ", pos long, _p double"))
    cut = exact_quantiles(scored, by, "_p", {"_q": contamination}, bound=sig.group_bound, max_group_rows=sig.max_series_rows)
    odd = attach(scored, cut, by, how="inner", bound=sig.group_bound).where(F.col("_p") < F.col("_q"))
    odd = odd.groupBy(*keys, "pos").agg(*[F.max(F.col("_f") == i).alias(f"_o{i}") for i in range(len(feats))])
    out = sig.df.join(odd, on=keys + ["pos"], how="left")
    new = {c: F.when(F.coalesce(F.col(f"_o{i}"), F.lit(False)), F.lit(None).cast("double")).otherwise(F.col(c))
           for i, c in enumerate(feats)}
    return sig.with_df(out.select(*[new[c].alias(c) if c in new else F.col(c) for c in sig.df.columns]))
