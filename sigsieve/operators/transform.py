"""Cleaning transforms on the wide signal: impute, mask outliers, scale, clip.

Each method needs per-(series, feature) statistics; they are computed in one
aggregate (plus the exact-quantile helper where quantiles are needed), pivoted
to one row per series and joined back with a checked broadcast.  Order-aware
fills use the block-carry kernel.  Every operator returns a new Signal with
the same columns; ``variant`` selects the first app ("v1"), the second app
("v2", default) or the evaluation notebook ("ev") where they differ.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip_keep_null
from ..functions.stats import attach, exact_quantiles
from ..signal import Signal
from . import blocks as B
from . import short
from .sequence import carry_valid

def _null():
    return F.lit(None).cast("double")


def _long(sig: Signal) -> DataFrame:
    structs = [F.struct(F.lit(i).alias("_f"), F.col(c).cast("double").alias("_x")) for i, c in enumerate(sig.features)]
    return sig.df.select(*sig.keys, F.inline(F.array(*structs)))


def _pivot(long_stats: DataFrame, keys: Sequence[str], names: Sequence[str], n: int) -> DataFrame:
    aggs = [F.max(F.when(F.col("_f") == i, F.col(nm))).alias(f"{nm}__{i}") for i in range(n) for nm in names]
    return long_stats.groupBy(*keys).agg(*aggs)


def series_stats(sig: Signal, moments: bool = True, quantiles: dict | None = None, mad: bool = False) -> DataFrame:
    """One row per series: ``{stat}__{i}`` for every feature index i.

    moments: _m (count), _mean, _sd (sample), _sdp (population), _min, _max
    quantiles: name -> probability (exact, NumPy-linear); mad: needs "_med"
    """
    keys, feats = list(sig.keys), list(sig.features)
    out = None
    if (quantiles or mad or sig.plan is not None) and short.is_short(sig):
        out = short.stats_rows(sig, moments, {**(quantiles or {}), **({"_med": 0.5} if mad else {})}, mad).persist()
        out.count()
        return out
    if moments:
        aggs = []
        for i, c in enumerate(feats):
            x = F.col(c)
            aggs += [F.count(x).alias(f"_m__{i}"), F.avg(x).alias(f"_mean__{i}"),
                     F.stddev_samp(x).alias(f"_sd__{i}"), F.stddev_pop(x).alias(f"_sdp__{i}"),
                     F.min(x).alias(f"_min__{i}"), F.max(x).alias(f"_max__{i}")]
        out = sig.df.groupBy(*keys).agg(*aggs) if keys else sig.df.agg(*aggs)
    if quantiles or mad:
        probs = dict(quantiles or {})
        if mad:
            probs.setdefault("_med", 0.5)
        lng = _long(sig)
        by = keys + ["_f"]
        q = exact_quantiles(lng, by, "_x", probs, bound=sig.group_bound, max_group_rows=sig.max_series_rows)
        names = list(probs)
        if mad:
            dev = attach(lng.where(F.col("_x").isNotNull()), q.select(*by, "_med"), by, how="inner",
                         bound=sig.group_bound)
            dev = dev.select(*by, F.abs(F.col("_x") - F.col("_med")).alias("_ad"))
            md = exact_quantiles(dev, by, "_ad", {"_mad": 0.5}, bound=sig.group_bound,
                                 max_group_rows=sig.max_series_rows)
            q = q.join(md, on=by, how="left")
            names.append("_mad")
        wq = _pivot(q, keys, names, len(feats)) if keys else q.groupBy().agg(
            *[F.max(F.when(F.col("_f") == i, F.col(nm))).alias(f"{nm}__{i}") for i in range(len(feats)) for nm in names])
        out = wq if out is None else (out.join(wq, on=keys, how="left") if keys else _join_global(out, wq))
    # fit step: materialise the small table now, so the row job downstream
    # reads its input once instead of once per consumer
    out = out.persist()
    out.count()
    return out


def _join_global(a: DataFrame, b: DataFrame) -> DataFrame:
    one = F.lit(1).alias("_one")
    return a.select("*", one).join(b.select("*", one), on="_one").drop("_one")


def _finish(sig: Signal, df: DataFrame, new_cols: dict[str, Column]) -> Signal:
    keep = [c for c in sig.df.columns]
    out = df.select(*[new_cols[c].alias(c) if c in new_cols else F.col(c) for c in keep])
    return sig.with_df(out)


def s(stat: str, i: int) -> Column:
    return F.col(f"{stat}__{i}")


# ---------------------------------------------------------------------------
# Missing values (M1-M4, M7, M8)
# ---------------------------------------------------------------------------
MV_ALIASES = {"mean": "Mean Imputation", "locf": "LOCF", "linear": "Linear Interpolation",
              "knn": "KNN Imputation", "mice": "MICE", "none": "None"}


def impute(sig: Signal, method: str, variant: str = "v2") -> Signal:
    """Fill gaps.  Mean / LOCF / linear (by row position) / safe temporal.

    KNN and MICE use the other channels (``knn.py``, ``mice.py``), the rest fill
    each channel by itself.
    """
    method = MV_ALIASES.get(method, method)
    if method == "None":
        return sig
    if method == "KNN Imputation":
        from .knn import knn_impute
        return knn_impute(sig)
    if method == "MICE":
        from .mice import mice_impute
        return mice_impute(sig)
    if sig.plan is not None:
        return B.then(sig, B.fill, method, variant)
    feats = list(sig.features)
    need_carry = method in ("LOCF", "Linear Interpolation")
    need_mean = method == "Mean Imputation" or (variant == "ev" and need_carry)
    df = sig.df
    if need_carry:
        df = carry_valid(df, list(sig.keys), feats)
    if need_mean:
        df = attach(df, series_stats(sig), list(sig.keys), how="left", bound=sig.n_series + 1)
    return _finish(sig, df, {c: fill_expr(c, i, method, variant) for i, c in enumerate(feats)})


def fills(sig: Signal, methods: Sequence[str], variant: str = "v2") -> tuple[DataFrame, list[dict[str, Column]]]:
    """The rows with all that the fills by ``methods`` need, and for each channel its fills by method: several fills of a
    signal by one pass."""
    keys, df = list(sig.keys), sig.df
    carried = {"LOCF", "Linear Interpolation"} & set(methods)
    if carried:
        df = carry_valid(df, keys, sig.features)
    if "Mean Imputation" in methods or (variant == "ev" and bool(carried)):
        df = attach(df, series_stats(sig), keys, bound=sig.n_series + 1)
    return df, [{m: fill_expr(c, i, m, variant) for m in methods} for i, c in enumerate(sig.features)]


def fill_expr(c: str, i: int, method: str, variant: str = "v2") -> Column:
    """Channel c (number i) with gaps filled, from ``carry_valid`` and ``series_stats`` columns."""
    x = F.col(c)
    if method == "Mean Imputation":
        return F.coalesce(x, s("_mean", i))
    if method == "LOCF":
        if variant == "v1":
            return F.coalesce(x, F.col(f"_pv{i}.v"))
        if variant == "ev":
            return F.coalesce(x, F.col(f"_pv{i}.v"), F.col(f"_nv{i}.v"), s("_mean", i))
        return F.coalesce(x, F.col(f"_pv{i}.v"), F.col(f"_nv{i}.v"))
    if method != "Linear Interpolation":
        raise ValueError(method)
    p0, v0 = F.col(f"_pv{i}.p"), F.col(f"_pv{i}.v")  # by row position
    p1, v1 = F.col(f"_nv{i}.p"), F.col(f"_nv{i}.v")
    inner = v0 + (v1 - v0) * (F.col("pos") - p0) / (p1 - p0)
    lin = F.when(v0.isNotNull() & v1.isNotNull(), inner)
    if variant == "v1":
        return F.coalesce(x, lin, v0)  # leading gap stays empty
    if variant == "ev":
        return F.coalesce(x, lin, v0, v1, s("_mean", i))
    # the median comes before 0 by the rule, but where neither side has a value the series has none, so no median either
    return F.coalesce(x, lin, v0, v1, F.lit(0.0))


# ---------------------------------------------------------------------------
# Outliers (O1-O4): value -> _null(), or clip (winsorise)
# ---------------------------------------------------------------------------
OUT_ALIASES = {"zscore": "Z-Score", "iqr": "IQR", "mad": "MAD", "winsor": "Winsorization",
               "isolation_forest": "Isolation Forest", "none": "None"}


def mask_outliers(sig: Signal, method: str, z_thresh: float = 3.0, iqr_factor: float = 1.5,
                  mad_thresh: float = 3.5, winsor_q: float = 0.02, variant: str = "v2", contamination: float = 0.05) -> Signal:
    method = OUT_ALIASES.get(method, method)
    if method == "None":
        return sig
    if method == "Isolation Forest":
        from .isoforest import isolation_forest_mask
        return isolation_forest_mask(sig, contamination)
    if sig.plan is not None:
        return B.then(sig, B.winsor, winsor_q) if method == "Winsorization" else B.then(sig, B.mask, method, z_thresh, iqr_factor, mad_thresh, variant)
    feats = list(sig.features)
    q = None
    if method == "IQR":
        q = {"_q1": 0.25, "_q3": 0.75}
    elif method == "Winsorization":
        q = {"_wlo": winsor_q, "_whi": 1 - winsor_q}
    st = series_stats(sig, moments=True, quantiles=q, mad=(method == "MAD"))
    df = attach(sig.df, st, list(sig.keys), how="left", bound=sig.n_series + 1)
    if method == "Winsorization":
        return _finish(sig, df, {c: clip_keep_null(F.col(c), s("_wlo", i), s("_whi", i)) for i, c in enumerate(feats)})
    odd = {c: outlier_expr(c, i, method, F.lit(z_thresh), F.lit(iqr_factor), F.lit(mad_thresh), variant) for i, c in enumerate(feats)}
    return _finish(sig, df, {c: F.when(F.coalesce(bad, F.lit(False)), _null()).otherwise(F.col(c)) for c, bad in odd.items()})


def outlier_expr(c: str, i: int, method: str, z_thresh: Column, iqr_factor: Column, mad_thresh: Column, variant: str = "v2") -> Column:
    """Whether a value of channel c (number i) is an outlier, from ``series_stats`` columns."""
    x = F.col(c)
    min_m = {"ev": 5, "v1": 1}.get(variant, 4 if method in ("IQR", "MAD") else 0)
    enough = s("_m", i) >= min_m
    if method == "Z-Score":
        # v1 fills with the mean first: the same squares over all rows
        sd = s("_sdp", i) * F.sqrt(s("_m", i) / F.col("_n")) if variant == "v1" else s("_sd", i)
        return enough & (sd > 0) & (F.abs((x - s("_mean", i)) / sd) > z_thresh)
    if method == "IQR":
        iqr = s("_q3", i) - s("_q1", i)
        guard = enough if variant == "v1" else enough & (iqr > 0)
        return guard & ((x < s("_q1", i) - iqr_factor * iqr) | (x > s("_q3", i) + iqr_factor * iqr))
    if method != "MAD":
        raise ValueError(method)
    med, mad = s("_med", i), s("_mad", i)
    if variant in ("v1", "ev"):
        guard = enough if variant == "v1" else enough & (mad > 0)
        return guard & (F.abs(x - med) > 3 * mad)
    return enough & (mad > 0) & (F.abs(F.lit(0.6745) * (x - med) / mad) > mad_thresh)


def clip(sig: Signal, lo: float | None, hi: float | None) -> Signal:
    """Clip to manual limits, keeping gaps as gaps."""
    if sig.plan is not None:
        return B.then(sig, B.clip, lo, hi)
    new = {c: clip_keep_null(F.col(c), F.lit(lo) if lo is not None else _null(),
                             F.lit(hi) if hi is not None else _null()) for c in sig.features}
    return _finish(sig, sig.df, new)


# ---------------------------------------------------------------------------
# Normalisation
# ---------------------------------------------------------------------------
NORM_ALIASES = {"standard": "StandardScaler", "robust": "RobustScaler", "minmax": "MinMaxScaler", "none": "None",
                "StandardScaler (Z-Score)": "StandardScaler"}


def scale(sig: Signal, method: str, variant: str = "v2") -> Signal:
    """Fill (v2: median then 0; ev: mean then 0), then scale per series and
    feature with statistics of the filled data.  Zero spread -> centre only."""
    method = NORM_ALIASES.get(method, method)
    return sig if method == "None" else scale_filled(filled(sig, variant), method)


def filled(sig: Signal, variant: str = "v2") -> Signal:
    """Gaps filled as before scaling, written once; a signal without gaps is returned as it is."""
    if sig.plan is not None:
        return B.then(sig, B.fill_middle, variant)
    feats = list(sig.features)
    keys = list(sig.keys)
    if variant == "v2" and feats and not sig.df.agg(*[F.count_if(F.col(c).isNull()).alias(f"_g{i}") for i, c in enumerate(feats)]) \
            .where(" + ".join(f"_g{i}" for i in range(len(feats))) + " > 0").count():
        return sig
    if variant == "ev":
        st0 = series_stats(sig, moments=True)
        df0 = attach(sig.df, st0, keys, how="left", bound=sig.n_series + 1)
        fill = {c: F.coalesce(F.col(c), s("_mean", i), F.lit(0.0)) for i, c in enumerate(feats)}
    else:
        st0 = series_stats(sig, moments=False, quantiles={"_med": 0.5})
        df0 = attach(sig.df, st0, keys, how="left", bound=sig.n_series + 1)
        fill = {c: F.coalesce(F.col(c), s("_med", i), F.lit(0.0)) for i, c in enumerate(feats)}
    return _finish(sig, df0, fill).materialize()


def scale_filled(filled: Signal, method: str) -> Signal:
    """A filled signal scaled per series and feature."""
    if filled.plan is not None:
        return B.then(filled, B.scale, method)
    feats, keys = list(filled.features), list(filled.keys)
    q = {"_q1": 0.25, "_med": 0.5, "_q3": 0.75} if method == "RobustScaler" else None
    st = series_stats(filled, moments=True, quantiles=q)
    df = attach(filled.df, st, keys, how="left", bound=filled.n_series + 1)
    return _finish(filled, df, {c: scale_expr(c, i, method) for i, c in enumerate(feats)})


def scale_expr(c: str, i: int, method: str) -> Column:
    """Channel c (number i), already filled, scaled by ``series_stats`` columns of the filled data."""
    x = F.col(c)
    if method == "StandardScaler":
        sd = s("_sdp", i)
        return F.when(sd > 0, (x - s("_mean", i)) / sd).otherwise(x - s("_mean", i))
    if method == "RobustScaler":
        iqr = s("_q3", i) - s("_q1", i)
        return F.when(iqr > 0, (x - s("_med", i)) / iqr).otherwise(x - s("_med", i))
    if method != "MinMaxScaler":
        raise ValueError(method)
    rng = s("_max", i) - s("_min", i)
    return F.when(rng > 0, (x - s("_min", i)) / rng).otherwise(x - s("_min", i))
