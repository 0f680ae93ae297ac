"""Validation and evaluation.

Degradations pick exactly int(rate * m) valid cells per series and feature:
the cells with the smallest seeded integer hash.  The k-th smallest hash per
group is found without ranking a whole series in one task: hashes are
uniform, so a +-8 sigma band around k/m of the hash range brackets it; rows
below the band are counted, only rows inside the band are ranked (about
16*sqrt(k) rows per group).  Rows are compared with that one value per series.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import div
from ..functions.stats import attach
from ..session import materialize
from ..signal import Signal
from . import profile as P
from .audit import union_labelled

HASH_MOD = 16**13  # range of the row hash: 13 leading hex digits, exact in a double


def row_hash(row_id, seed: int, salt: int = 0, feature: str = "", keys: Sequence[str] = ()):
    """Mixing hash of a cell: the leading hex digits of md5(seed|salt|feature|series|row id), which SQL evaluates alike.

    Uniform over [0, HASH_MOD), independent between features, series and seeds, and without arithmetic on the id."""
    rid = F.col(row_id) if isinstance(row_id, str) else row_id
    series = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    cell = F.concat_ws("|", F.lit(f"{seed}|{salt}|{feature}"), *series, rid.cast("string"))
    return F.conv(F.substring(F.md5(cell), 1, 13), 16, 10).cast("long")


def smallest_k(df: DataFrame, keys: Sequence[str], cells: Sequence[tuple[Column, Column]], bound: int) -> tuple[DataFrame, list[Column]]:
    """df with helper columns, and for each (hash, k) of ``cells`` whether a row is among the k smallest hashes (ties by pos)
    of its series.  The hash is NULL where a row takes no part; k is an expression of ``_m``, the rows that do.

    All cells share three passes: counts, rows below and inside the bands, and the ranks inside the bands, which give the
    k-th smallest (hash, pos) of each series; rows are compared with that, not joined."""
    keys, n = list(keys), len(cells)
    own = list(df.columns)
    group = lambda d: d.groupBy(*keys) if keys else d.groupBy()
    h = [c for c, _ in cells]
    sizes = group(df).agg(*[F.count(c).alias(f"_m{j}") for j, c in enumerate(h)])
    st = sizes
    for j, (_, k) in enumerate(cells):
        m = F.greatest(F.col("_m"), F.lit(1))
        p = F.col(f"_k{j}") / m
        sigma = F.sqrt(p * (1 - p) / m)
        st = st.withColumn("_m", F.col(f"_m{j}")).withColumn(f"_k{j}", k)
        st = st.withColumn(f"_lo{j}", F.greatest(F.lit(0.0), (p - 8 * sigma) * HASH_MOD - 8)).withColumn(
            f"_hi{j}", F.least(F.lit(float(HASH_MOD)), (p + 8 * sigma) * HASH_MOD + 8))
    st = st.drop("_m")
    x = attach(df, st, keys, bound=bound)
    below = group(x).agg(*[a for j, c in enumerate(h) for a in (
        F.count_if(c < F.col(f"_lo{j}")).alias(f"_cb{j}"), F.count_if((c >= F.col(f"_lo{j}")) & (c <= F.col(f"_hi{j}"))).alias(f"_ci{j}"))])
    st = attach(below, st, keys, how="inner", bound=bound)
    lims = [*keys]
    for j in range(n):
        # a band that misses the k-th value widens to the whole series (exact either way)
        k, cb = F.col(f"_k{j}"), F.col(f"_cb{j}")
        ok = (cb < k) & (cb + F.col(f"_ci{j}") >= k)
        lims += [k.alias(f"_k{j}"), F.when(ok, F.col(f"_lo{j}")).otherwise(F.lit(-1.0)).alias(f"_lo{j}"),
                 F.when(ok, F.col(f"_hi{j}")).otherwise(F.lit(float(HASH_MOD) + 1)).alias(f"_hi{j}"), F.when(ok, cb).otherwise(F.lit(0)).alias(f"_cb{j}")]
    st = materialize(st.select(*lims))
    x = attach(df, st, keys, bound=bound)
    band = F.array(*[F.when((F.col(f"_k{j}") > 0) & (c >= F.col(f"_lo{j}")) & (c <= F.col(f"_hi{j}")),
                            F.struct(F.lit(j).alias("_j"), c.alias("_h"), (F.col(f"_k{j}") - F.col(f"_cb{j}")).alias("_want"))) for j, c in enumerate(h)])
    band = x.select(*keys, "pos", F.inline(F.filter(band, lambda e: e.isNotNull())))
    rank = F.row_number().over(Window.partitionBy(*keys, "_j").orderBy("_h", "pos"))
    last = band.withColumn("_rk", rank).where(F.col("_rk") == F.col("_want"))
    last = group(last).agg(*[F.max(F.when(F.col("_j") == j, F.struct("_h", "pos"))).alias(f"_last{j}") for j in range(n)])
    last = materialize(last)
    out = attach(df, last, keys, bound=bound)
    chosen = [F.coalesce((c < F.col(f"_last{j}._h")) | ((c == F.col(f"_last{j}._h")) & (F.col("pos") <= F.col(f"_last{j}.pos"))), F.lit(False))
              for j, c in enumerate(h)]
    return out.select(*own, *[f"_last{j}" for j in range(n)]), chosen


def _one_feature(sig: Signal) -> str:
    if len(sig.features) != 1:
        raise ValueError("degradations act on one feature at a time")
    return sig.features[0]


def blanked(sig: Signal, plan: dict[str, tuple[str, float, int]], row_id: str = "pos") -> tuple[DataFrame, dict[str, Column]]:
    """For each name of ``plan`` (channel, rate, seed), a column with exactly int(rate * m) valid cells of the channel blank in
    every series; and the table from which they are taken."""
    cells = [(F.when(F.col(f).isNotNull(), row_hash(row_id, seed, 0, f, sig.keys)), F.floor(F.col("_m") * F.lit(rate)).cast("long"))
             for f, rate, seed in plan.values()]
    d, chosen = smallest_k(sig.df, sig.keys, cells, sig.n_series + 1)
    return d, {name: F.when(hit, F.lit(None).cast("double")).otherwise(F.col(f)) for (name, (f, _, _)), hit in zip(plan.items(), chosen)}


def _blank(cells, x, feats, at: int, rate: float) -> dict:
    """Exactly int(rate * m) valid cells of every channel blank in every series: those of the smallest hashes ``_h{at}_{i}``,
    ties by position."""
    out = {}
    for i, f in enumerate(feats):
        there = np.flatnonzero(~np.isnan(x[f]))
        g = cells.g[there]
        order = np.lexsort((cells.t[f"_h{at}_{i}"].to_numpy()[there], g))
        m = np.bincount(g, minlength=cells.n)
        place = np.arange(len(there)) - (np.cumsum(m) - m)[g]
        y = x[f].copy()
        y[there[order[place < np.floor(m * rate)[g]]]] = np.nan
        out[f] = y
    return out


def masked_errors(clean: Signal, rates: Sequence[float], methods: dict[str, str], seed: int = 42) -> DataFrame:
    """V14 of short series: (keys, missing_rate_inserted, method, squared error and cells that the method filled, blanked
    cells).  The cells to blank are hashed beside the rows; every rate is blanked once and filled by every method, whole
    series together."""
    from . import blocks as B
    from .mice import fill_block
    keys, feats = list(clean.keys), tuple(clean.features)
    hashes = [F.when(F.col(f).isNotNull(), row_hash("pos", seed + 7 * ri + fi, 0, f, keys)).alias(f"_h{ri}_{fi}")
              for ri in range(len(rates)) for fi, f in enumerate(feats)]
    fills = {"KNN Imputation": B.Step(B.knn, feats, (5,)), "MICE": B.Step(fill_block, feats, (10,))}
    variants = []
    for ri, rate in enumerate(rates):
        blank = B.Step(_blank, feats, (ri, rate))
        variants += [((rate, None), (blank,)), *[((rate, m), (blank, fills.get(v) or B.Step(B.fill, feats, (v, "ev")))) for m, v in methods.items()]]

    def errors(t: pa.Table) -> pa.Table:
        cells, parts, masked = B.Cells(t), [], None
        whole = B.Channels(t, {})
        for (rate, m), x in cells.variants(variants):
            if m is None:
                masked = x
                continue
            sq, ok, n = np.zeros(cells.n), np.zeros(cells.n, dtype=np.int64), np.zeros(cells.n, dtype=np.int64)
            for f in feats:
                hit = np.isnan(masked[f]) & ~np.isnan(whole[f])
                filled = hit & ~np.isnan(x[f])
                g = cells.g[filled]
                sq += np.bincount(g, (x[f][filled] - whole[f][filled]) ** 2, cells.n)
                ok += np.bincount(g, minlength=cells.n)
                n += np.bincount(cells.g[hit], minlength=cells.n)
            out = cells.keys(keys).append_column("missing_rate_inserted", B.constant(rate, cells.n)).append_column("method", B.constant(m, cells.n))
            parts.append(out.append_column("_sq", pa.array(sq)).append_column("_ok", pa.array(ok)).append_column("n_masked", pa.array(n)))
        return pa.concat_tables(parts)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for k in keys for f in clean.df.schema.fields if f.name == k)
    return B.over_series(clean.df.select(*keys, "pos", "_n", *feats, *hashes), errors,
                         f"{kinds}, missing_rate_inserted double, method string, _sq double, _ok bigint, n_masked bigint")


def inject_missing(sig: Signal, rate: float, seed: int = 42, row_id: str = "pos") -> Signal:
    """V9: blank exactly int(rate * m) valid cells per series."""
    f = _one_feature(sig)
    d, new = blanked(sig, {f: (f, rate, seed)}, row_id)
    return sig.with_df(d.select(*[new[c].alias(c) if c in new else F.col(c) for c in sig.df.columns]))


def inject_outliers(sig: Signal, rate: float, magnitude: float = 8.0, seed: int = 42,
                    row_id: str = "pos") -> Signal:
    """Shift exactly int(rate * m) valid cells by +-magnitude * sample std (m >= 5)."""
    f = _one_feature(sig)
    keys = list(sig.keys)
    st = (sig.df.groupBy(*keys) if keys else sig.df.groupBy()).agg(F.stddev_samp(f).alias("_sd"))
    st = st.withColumn("_sd", F.when((F.col("_sd") > 0), F.col("_sd")).otherwise(F.lit(1.0)))
    h = F.when(F.col(f).isNotNull(), row_hash(row_id, seed, 1, f, keys))
    k = F.when(F.col("_m") >= 5, F.floor(F.col("_m") * F.lit(rate))).otherwise(0).cast("long")
    d, (hit,) = smallest_k(sig.df, keys, [(h, k)], sig.n_series + 1)
    out = attach(d, st, keys, bound=sig.n_series + 1)
    sign = F.when(row_hash(row_id, seed, 2, f, keys) % 2 == 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    out = out.withColumn(f, F.when(hit, F.col(f) + sign * magnitude * F.col("_sd")).otherwise(F.col(f)))
    return sig.with_df(out.select(*sig.df.columns))


def inject_skew(sig: Signal, strength: float) -> Signal:
    """(x - min + 1e-6) ** (1 + strength) when the series has >= 5 values."""
    f = _one_feature(sig)
    keys = list(sig.keys)
    st = (sig.df.groupBy(*keys) if keys else sig.df.groupBy()).agg(F.count(f).alias("_m"), F.min(f).alias("_mn"))
    d = attach(sig.df, st, keys, bound=sig.n_series + 1)
    d = d.withColumn(f, F.when(F.col("_m") >= 5, F.pow(F.col(f) - F.col("_mn") + 1e-6, 1 + strength))
                     .otherwise(F.col(f)))
    return sig.with_df(d.select(*sig.df.columns))


# The twelve degradation scenarios of the evaluation.
SCENARIOS = (
    ("original", None),
    ("missing_5", ("m", 0.05)), ("missing_10", ("m", 0.10)), ("missing_20", ("m", 0.20)), ("missing_40", ("m", 0.40)),
    ("outliers_5", ("o", 0.05)), ("outliers_10", ("o", 0.10)), ("outliers_20", ("o", 0.20)),
    ("skew_strength_0.5", ("s", 0.5)), ("skew_strength_1.0", ("s", 1.0)), ("skew_strength_2.0", ("s", 2.0)),
    ("mixed_missing20_outlier10_skew", ("x", None)),
)


def degrade(sig: Signal, spec, seed: int = 42, row_id: str = "pos") -> Signal:
    if spec is None:
        return sig
    kind, v = spec
    if kind == "m":
        return inject_missing(sig, v, seed, row_id)
    if kind == "o":
        return inject_outliers(sig, v, seed=seed, row_id=row_id)
    if kind == "s":
        return inject_skew(sig, v)
    return inject_skew(inject_outliers(inject_missing(sig, 0.20, seed, row_id).materialize(), 0.10, seed=seed,
                                       row_id=row_id).materialize(),
                       1.0)


def degradation_matrix(sig: Signal, seed: int = 42, row_id: str = "event_id") -> DataFrame:
    """Profile + rule recommendation of every scenario (scenario = key)."""
    from .recommend import recommend_rules
    parts = [({"scenario": name}, degrade(sig, spec, seed, row_id)) for name, spec in SCENARIOS]
    u = union_labelled(parts).materialize()  # written once
    return recommend_rules(P.profile_ev(u))


# ---------------------------------------------------------------------------
# Before / after, ground truth, task detection
# ---------------------------------------------------------------------------
BA_COLS = ["quality_index", "missing_rate", "outlier_iqr_rate", "skewness", "kurtosis_excess"]


def before_after(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """V1: inner join of two profiles on (keys, feature) and the QI gain."""
    on = list(keys) + ["feature"]
    b = before.select(*on, *[F.col(c).alias(f"{c}_before") for c in BA_COLS])
    a = after.select(*on, *[F.col(c).alias(f"{c}_after") for c in BA_COLS])
    j = b.join(a, on=on, how="inner")
    return j.withColumn("qi_gain", F.col("quality_index_after") - F.col("quality_index_before"))


def run_summary(before: Signal, masked: Signal, after: Signal, keys: Sequence[str]) -> DataFrame:
    """V2: mean, std (sample before, population after), missing % before and after a run, and the share of rows that
    outlier masking removed net of what imputation filled (below zero where filling outweighs it)."""
    keys = list(keys)

    def agg(sig: Signal, *aggs) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in sig.features])
        return sig.df.select(*keys, F.inline(cells)).groupBy(*keys, "feature").agg(*aggs)

    gaps = F.count_if(F.col("x").isNull()) * 100.0 / F.count(F.lit(1))
    b = agg(before, F.avg("x").alias("mean_before"), F.stddev_samp("x").alias("std_before"), gaps.alias("missing_before"),
            F.count("x").alias("_valid"), F.count(F.lit(1)).alias("_rows"))
    m = agg(masked, F.count("x").alias("_masked"))
    a = agg(after, F.avg("x").alias("mean_after"), F.stddev_pop("x").alias("std_after"), gaps.alias("missing_after"))
    j = b.join(m, keys + ["feature"]).join(a, keys + ["feature"])
    return j.withColumn("outliers_removed", (F.col("_valid") - F.col("_masked")) * 100.0 / F.col("_rows")).drop("_valid", "_masked", "_rows")


def _side_by_side(clean: Signal, processed: Signal, raw: Signal, align: Sequence[str]) -> bool:
    """Whether the join of the three is one of rows of the same block that follow each other."""
    from . import blocks as B
    own = {*processed.keys, "pos"}, {*processed.keys, *processed.order}
    return B.shared(clean, processed, raw) and not processed.plan.labels and set(align) in own


def _aligned(clean: Signal, processed: Signal, raw: Signal, align: Sequence[str], feats: Sequence[str]) -> DataFrame:
    """The join of the three on ``align`` (c0, p0, r0, ...), made inside the blocks."""
    from . import blocks as B
    by_pos = "pos" in align
    sig = B.planned(clean, replace(clean.plan, labels=("_side",), variants=tuple(B.sides(clean, {"p": processed, "r": raw}))))

    def rows(cells, variants):
        at = (slice(None),) * 3 if by_pos else B.tuples(cells, align, 3)
        yield pa.table({f"{name}{i}": pa.array(x[f][k], from_pandas=True) for name, k, (_, x) in zip("cpr", at, variants) for i, f in enumerate(feats)})

    return B.over_plan(sig, rows, ", ".join(f"{name}{i} double" for name in "cpr" for i in range(len(feats))))


def ground_truth(clean: Signal, processed: Signal, raw: Signal, align: Sequence[str]) -> DataFrame:
    """V3/V4: MAE / RMSE / Pearson of processed and raw against clean, per feature.
    ``align`` = key columns (sample id, or series + pos for row order)."""
    al = list(align)
    feats = [f for f in processed.features if f in clean.features]

    def wide(sig, name):
        return sig.df.select(*al, *[F.col(f).cast("double").alias(f"{name}{i}") for i, f in enumerate(feats)])

    if _side_by_side(clean, processed, raw, al):
        j = _aligned(clean, processed, raw, al, feats)
    else:
        j = wide(clean, "c").join(wide(processed, "p"), on=al, how="inner").join(wide(raw, "r"), on=al, how="inner")
    j = j.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), *[F.col(f"{n}{i}").alias(n) for n in "cpr"]) for i, f in enumerate(feats)])))

    def metrics(pred: str, tag: str):
        both = F.col("c").isNotNull() & F.col(pred).isNotNull()
        cc, pp = F.when(both, F.col("c")), F.when(both, F.col(pred))
        n = F.count_if(both)
        err = pp - cc
        mae = F.when(n >= 3, F.avg(F.abs(err)))
        rmse = F.when(n >= 3, F.sqrt(F.avg(err * err)))
        corr = F.when((n >= 3) & (F.stddev_pop(cc) > 0) & (F.stddev_pop(pp) > 0),
                      div(F.covar_pop(cc, pp), F.stddev_pop(cc) * F.stddev_pop(pp)))
        return [mae.alias(f"{tag}_mae"), rmse.alias(f"{tag}_rmse"), corr.alias(f"{tag}_corr"), n.alias(f"_{tag}_n")]

    g = j.groupBy("feature").agg(*metrics("r", "raw"), *metrics("p", "processed"))

    def gain(tag):
        return F.when(F.col(f"raw_{tag}").isNotNull() & (F.col(f"raw_{tag}") != 0),
                      (F.col(f"raw_{tag}") - F.col(f"processed_{tag}")) / F.col(f"raw_{tag}") * 100)

    return g.select("feature", "raw_mae", "processed_mae", gain("mae").alias("mae_gain"), "raw_rmse",
                    "processed_rmse", gain("rmse").alias("rmse_gain"), "raw_corr", "processed_corr",
                    F.col("_processed_n").alias("compared_rows"))


def task_detect(df: DataFrame, target: str, numeric: bool) -> DataFrame:
    """V6: classification if non-numeric or few distinct values; needs >= 30
    labelled rows and >= 2 classes."""
    n = F.count(target)
    nd = F.count_distinct(target)
    limit = F.least(F.lit(20), F.greatest(F.lit(2), F.floor(n * 0.05)))
    cls = F.lit(not numeric) | (nd <= limit)
    task = (F.when(n < 30, "insufficient").when(cls & (nd < 2), "insufficient")
            .when(cls, "classification").otherwise("regression"))
    return df.agg(F.lit(target).alias("target"), n.alias("n_labelled"), nd.alias("n_distinct"), task.alias("task"))


def file_vectors(sig: Signal) -> DataFrame:
    """Per series (file) mean, std, median, missing %, IQR %, skew of each
    feature, one column per (sanitised feature, statistic)."""
    from .transform import series_stats
    keys = list(sig.keys)
    ev = P.profile_ev(sig)
    med = series_stats(sig, moments=True, quantiles={"_med": 0.5})
    cols = []
    for i, f in enumerate(sig.features):
        import re
        nm = re.sub(r"[^A-Za-z0-9]+", "_", f).strip("_")[:60]
        cols += [F.col(f"_mean__{i}").alias(f"{nm}__mean"), F.col(f"_sd__{i}").alias(f"{nm}__std"),
                 F.col(f"_med__{i}").alias(f"{nm}__median")]
    base = med.select(*keys, *cols)
    agg = []
    for f in sig.features:
        import re
        nm = re.sub(r"[^A-Za-z0-9]+", "_", f).strip("_")[:60]
        agg += [F.max(F.when(F.col("feature") == f, F.col("missing_rate"))).alias(f"{nm}__missing"),
                F.max(F.when(F.col("feature") == f, F.col("outlier_rate_iqr"))).alias(f"{nm}__outlier_iqr"),
                F.max(F.when(F.col("feature") == f, F.col("skewness"))).alias(f"{nm}__skew")]
    pv = ev.groupBy(*keys).agg(*agg)
    return base.join(pv, on=keys, how="inner")
