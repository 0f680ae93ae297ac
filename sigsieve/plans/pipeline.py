"""Pipelines (C1-C9): compositions of the cleaning operators.

Each stage is a DataFrame transform on the Signal; Catalyst sees one plan.
Long chains can be cut with ``sigsieve.session.materialize`` (a reliable
checkpoint in the cluster's checkpoint folder).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from ..operators import transform as X
from ..operators.smooth import savgol
from ..signal import Signal

MV_FIRST = "Missing → Outlier"
OUT_FIRST = "Outlier → Missing"


@dataclass(frozen=True)
class Settings:
    """The reference's 13 method parameters, as one frozen value."""
    z_thresh: float = 3.0
    iqr_factor: float = 1.5
    mad_thresh: float = 3.5
    if_contamination: float = 0.05
    winsor_q: float = 0.02
    knn_neighbors: int = 5
    mice_iter: int = 10
    sampling_rate: float = 250.0
    filter_cutoff: float = 30.0
    sg_window: int = 11
    sg_poly: int = 2
    fourier_keep_ratio: float = 0.08
    operation_order: str = MV_FIRST


DEFAULT = Settings()


def _step(sig: Signal) -> Signal:
    """Pipeline stage boundary: reliable checkpoint (short plans, cheap recovery)."""
    return sig.materialize()


def _out(sig: Signal, method: str, st: Settings) -> Signal:
    if method == "None":
        return sig
    return _step(_out0(sig, method, st))


def _out0(sig: Signal, method: str, st: Settings) -> Signal:
    return X.mask_outliers(sig, method, z_thresh=st.z_thresh, iqr_factor=st.iqr_factor, mad_thresh=st.mad_thresh,
                           winsor_q=st.winsor_q, contamination=st.if_contamination)


def _mv(sig: Signal, method: str, st: Settings) -> Signal:
    if method == "None":
        return sig
    return _step(_mv0(sig, method, st))


def _mv0(sig: Signal, method: str, st: Settings) -> Signal:
    if method in ("KNN Imputation", "knn"):
        from ..operators.knn import knn_impute
        return knn_impute(sig, k=st.knn_neighbors)
    if method in ("MICE", "mice"):
        from ..operators.mice import mice_impute
        return mice_impute(sig, max_iter=st.mice_iter)
    return X.impute(sig, method)


def refill_method(mv: str) -> str:
    return mv if mv != "None" else "Linear Interpolation"


def cleaning_stage(sig: Signal, mv: str, out: str, st: Settings = DEFAULT) -> Signal:
    """Missing + outlier handling on the original scale."""
    if st.operation_order == OUT_FIRST:
        return _mv(_out(sig, out, st), refill_method(mv), st)
    cur = _mv(sig, mv, st)
    cur = _out(cur, out, st)
    return _mv(cur, refill_method(mv), st)


def smooth(sig: Signal, method: str, st: Settings = DEFAULT) -> Signal:
    if method == "None":
        return sig
    if method == "Savitzky-Golay":
        return savgol(sig, st.sg_window, st.sg_poly)
    if method == "Butterworth":
        from ..operators.spectral import butterworth
        return butterworth(sig, cutoff=st.filter_cutoff, fs=st.sampling_rate, order=3)
    if method == "Fourier":
        from ..operators.fourier import fourier_lowpass
        return fourier_lowpass(sig, st.fourier_keep_ratio)
    raise ValueError(method)


def run_pipeline(sig: Signal, mv: str, out: str, norm: str, smooth_method: str = "None",
                 st: Settings = DEFAULT) -> Signal:
    """Cleaning -> normalisation -> smoothing, one method set for all features."""
    cur = cleaning_stage(sig, mv, out, st)
    cur = X.scale(cur, norm)
    if smooth_method != "None":
        cur = smooth(_step(cur), smooth_method, st)
    return cur


def first_app(sig: Signal, mv: str, feature: str, out: str, norm: str) -> Signal:
    """The first app's run: fill all channels, then mask, hold forward and
    scale the chosen one (its 5 % winsor and 10 % forest shares)."""
    cur = _step(X.impute(sig, mv, variant="v1"))
    one = cur.select_features([feature])
    one = X.mask_outliers(one, out, variant="v1", winsor_q=0.05, contamination=0.10)
    one = X.scale(_step(X.impute(one, "LOCF", variant="v1")), norm)
    return one.select_features(sig.features)


def stages(sig: Signal, mv: str, out: str, norm: str, smooth_method: str = "None",
           st: Settings = DEFAULT) -> list[tuple[int, str, Signal]]:
    """C4: named intermediate stages (Raw, 1, 2, [2b], 3, 4)."""
    res = [(0, "Raw", sig)]
    if st.operation_order == OUT_FIRST:
        cur = _out(sig, out, st)
        res.append((1, f"1 Outlier: {out}", cur))
        mv_eff = refill_method(mv)
        cur = _mv(cur, mv_eff, st)
        res.append((2, f"2 Missing: {mv_eff}", cur))
    else:
        cur = _mv(sig, mv, st)
        res.append((1, f"1 Missing: {mv}", cur))
        cur = _out(cur, out, st)
        res.append((2, f"2 Outlier: {out}", cur))
        rf = refill_method(mv)
        cur = _mv(cur, rf, st)
        res.append((3, f"2b Re-fill after outlier: {rf}", cur))
    cur = _step(X.scale(cur, norm)) if norm != "None" else cur
    res.append((len(res), f"3 Normalization: {norm}", cur))
    cur = _step(smooth(cur, smooth_method, st)) if smooth_method != "None" else cur
    res.append((len(res), f"4 Smoothing: {smooth_method}", cur))
    return res


# ---------------------------------------------------------------------------
# Evaluation presets (C6-C8) on the "ev" operator variants
# ---------------------------------------------------------------------------
def preset(sig: Signal, name: str) -> Signal:
    if name == "raw_aggregate":
        return sig
    if name == "simple_default":
        cur = _step(X.impute(sig, "Mean Imputation", variant="ev"))
        cur = _step(X.mask_outliers(cur, "IQR", variant="ev"))
        cur = _step(X.impute(cur, "Mean Imputation", variant="ev"))
        return X.scale(cur, "StandardScaler", variant="ev")
    if name == "robust_default":
        from ..operators.knn import knn_impute
        cur = _step(knn_impute(sig, k=5))
        cur = _step(X.mask_outliers(cur, "MAD", variant="ev"))
        cur = _step(X.impute(cur, "Mean Imputation", variant="ev"))
        return X.scale(cur, "RobustScaler", variant="ev")
    if name == "feature_wise":
        from .featurewise import featurewise_recommended
        return featurewise_recommended(sig)
    raise ValueError(name)
