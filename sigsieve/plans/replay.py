"""Replay of a stored pipeline definition (IO7): methods and settings as data.

A definition is a table with one row per (series, feature): four methods and the
settings.  All series and features go through the same stages:

1. missing values, where the definition starts with them;
2. outliers;
3. missing values again (linear interpolation where stage 1 is "None");
4. scaling (after the median fill);
5. smoothing.

In a stage, methods that need only statistics of their own channel (mean, LOCF,
linear; z-score, IQR, MAD; the scalers) share one aggregate and one row pass, a
``when`` per channel choosing among them, with thresholds read from the definition.
KNN, MICE, winsorising, the forest and the smoothers run once for each combination
of their settings in use, on the series that ask for them, and are joined by row.
A method that reads other channels sees all channels as the stage before left them.
"""

from __future__ import annotations

import json
from dataclasses import asdict, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import attach
from ..operators import blocks as B
from ..operators import transform as X
from ..operators.fourier import _kept
from ..operators.isoforest import _mask_block
from ..operators.mice import fill_block
from ..operators.smooth import _fitted
from ..operators.spectral import _filtered
from ..signal import Signal
from .pipeline import DEFAULT, MV_FIRST, OUT_FIRST, Settings, _mv0, _out0, smooth

MISSING = ("None", "Mean Imputation", "LOCF", "Linear Interpolation", "KNN Imputation", "MICE")
OUTLIER = ("None", "Z-Score", "IQR", "MAD", "Winsorization", "Isolation Forest")
SCALING = ("None", "StandardScaler", "RobustScaler", "MinMaxScaler")
SMOOTHING = ("None", "Savitzky-Golay", "Butterworth", "Fourier")
METHODS = {"missing_method": MISSING, "outlier_method": OUTLIER, "normalization_method": SCALING, "smoothing_method": SMOOTHING}
#: Settings that a method run on its own reads.
OWN_SETTINGS = {"KNN Imputation": ("knn_neighbors",), "MICE": ("mice_iter",), "Winsorization": ("winsor_q",), "Isolation Forest": ("if_contamination",),
                "Savitzky-Golay": ("sg_window", "sg_poly"), "Butterworth": ("filter_cutoff", "sampling_rate"), "Fourier": ("fourier_keep_ratio",)}
#: Combinations of methods and settings that are run on their own in one stage.
MAX_RUNS = 64
#: Methods that need only statistics of their own channel.
LIGHT = ("Mean Imputation", "LOCF", "Linear Interpolation", "Z-Score", "IQR", "MAD", *SCALING[1:])
#: Different definitions that the steps of a plan carry along; with more, the stages run row by row.
MAX_DEFINITIONS = 4096


def read_definition(spark: SparkSession, path: str, keys) -> DataFrame:
    """The table that ``sinks.pipeline_definition`` and ``sinks.write_json`` wrote."""
    df = spark.read.json(path)
    kinds = dict(df.dtypes)
    missing = [c for c in [*keys, "feature", "pipeline", "settings"] if c not in kinds]
    if missing:
        raise ValueError(f"definition without {missing}")
    return df.select(*keys, "feature", "pipeline", "settings")


def parsed(definition: DataFrame, keys) -> DataFrame:
    """(keys, feature, four methods, one column per setting).  A setting that isn't stored has its default."""
    methods = F.from_json("pipeline", ", ".join(f"{m} string" for m in METHODS))
    kinds = {int: "bigint", float: "double", str: "string"}
    own = asdict(DEFAULT)
    settings = F.from_json("settings", ", ".join(f"{f.name} {kinds[type(own[f.name])]}" for f in fields(Settings)))
    x = definition.select(*keys, "feature", methods.alias("_m"), settings.alias("_s"))
    return x.select(*keys, "feature", *[F.coalesce(F.col(f"_m.{m}"), F.lit("None")).alias(m) for m in METHODS],
                    *[F.coalesce(F.col(f"_s.{k}"), F.lit(v)).alias(k) for k, v in own.items()])


def _checked(rows: DataFrame, keys, feats) -> None:
    odd = None
    for m, known in METHODS.items():
        bad = F.when(~F.col(m).isin(*known), F.concat(F.lit(f"{m} "), F.col(m)))
        odd = bad if odd is None else F.coalesce(odd, bad)
    order = F.when(~F.col("operation_order").isin(MV_FIRST, OUT_FIRST), F.concat(F.lit("operation_order "), F.col("operation_order")))
    odd = F.coalesce(odd, order, F.when(~F.col("feature").isin(*feats), F.concat(F.lit("feature "), F.col("feature"))))
    found = rows.select(odd.alias("odd")).where("odd is not null").distinct().limit(5).collect()
    if found:
        raise ValueError("unknown " + ", ".join(r.odd for r in found))
    if rows.groupBy(*keys, "feature").count().where("count > 1").head(1):
        raise ValueError("more than one definition of a series and feature")


def _by_series(rows: DataFrame, keys, feats) -> DataFrame:
    """One row per series: a struct of methods and settings per feature (``_d0``, ``_d1``, ...)."""
    names = [*METHODS, *asdict(DEFAULT)]
    one = F.struct(*names)
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col("feature") == f, one)).alias(f"_d{i}") for i, f in enumerate(feats)])


def _select(sig: Signal, df: DataFrame, new: dict) -> Signal:
    return sig.with_df(df.select(*[new[c].alias(c) if c in new else F.col(c) for c in sig.df.columns])).materialize()


def _stage(sig: Signal, rows: DataFrame, per_series: DataFrame, method: str, light, light_methods, heavy) -> Signal:
    """One stage.  ``method``: SQL of the stage's method, {} standing before each column of a definition row;
    ``light(sig, df, used)`` adds what its expressions need and returns (df, expressions by feature number and method);
    ``heavy(sig, method, settings)`` runs a method on its own."""
    keys, feats = list(sig.keys), list(sig.features)
    rows = rows.withColumn("_method", F.expr(method.replace("{}", "")))
    used = {r._method for r in rows.select("_method").distinct().collect()} - {"None"}  # a few names
    if not used:
        return sig
    df, exprs = sig.df, {}
    quick = [m for m in light_methods if m in used]
    if quick:
        df, exprs = light(sig, df, quick)
    df = attach(df, per_series, keys, bound=sig.n_series + 1)
    code = lambda i: F.expr(method.replace("{}", f"_d{i}."))
    chosen = {c: F.col(c) for c in feats}
    for i, c in enumerate(feats):
        for m in quick:
            chosen[c] = F.when(code(i) == m, exprs[i][m]).otherwise(chosen[c])
    run = 0
    for m in sorted(used - set(quick)):
        own = OWN_SETTINGS[m]
        asked = rows.where(F.col("_method") == m)
        combos = asked.select(*own).distinct().limit(MAX_RUNS + 1).collect()
        if run + len(combos) > MAX_RUNS:
            raise ValueError(f"more than {MAX_RUNS} combinations of methods and settings in one stage")
        for values in combos:
            fits = F.lit(True)
            for k in own:
                fits = fits & (F.col(k) == F.lit(values[k]))
            part = sig
            if keys:
                series = asked.where(fits).select(*keys).distinct()
                part = sig.with_df(attach(sig.df, series, keys, how="left_semi", bound=sig.n_series + 1))
            done = heavy(part, m, Settings(**{**asdict(DEFAULT), **{k: values[k] for k in own}}))
            names = [f"_r{run}_{i}" for i in range(len(feats))]
            done = done.df.select(*keys, "pos", F.lit(True).alias(f"_hit{run}"), *[F.col(c).alias(n) for c, n in zip(feats, names)])
            df = df.join(done, [*keys, "pos"], "left")
            for i, c in enumerate(feats):
                mine = F.col(f"_hit{run}") & (code(i) == m)
                for k in own:
                    mine = mine & (F.col(f"_d{i}.{k}") == F.lit(values[k]))
                chosen[c] = F.when(mine, F.col(names[i])).otherwise(chosen[c])
            run += 1
    return _select(sig, df, chosen)


def _fills(sig: Signal, df: DataFrame, used):
    return X.fills(sig, used)


def _masks(sig: Signal, df: DataFrame, used):
    st = X.series_stats(sig, quantiles={"_q1": 0.25, "_q3": 0.75} if "IQR" in used else None, mad="MAD" in used)
    df = attach(df, st, list(sig.keys), bound=sig.n_series + 1)

    def masked(c, i, m):
        bad = X.outlier_expr(c, i, m, F.col(f"_d{i}.z_thresh"), F.col(f"_d{i}.iqr_factor"), F.col(f"_d{i}.mad_thresh"))
        return F.when(F.coalesce(bad, F.lit(False)), F.lit(None).cast("double")).otherwise(F.col(c))

    return df, [{m: masked(c, i, m) for m in used} for i, c in enumerate(sig.features)]


def _scales(sig: Signal, df: DataFrame, used):
    st = X.series_stats(sig, quantiles={"_q1": 0.25, "_med": 0.5, "_q3": 0.75} if "RobustScaler" in used else None)
    df = attach(df, st, list(sig.keys), bound=sig.n_series + 1)
    return df, [{m: X.scale_expr(c, i, m) for m in used} for i, c in enumerate(sig.features)]


def _median_filled(sig: Signal, per_series: DataFrame) -> Signal:
    """Channels that will be scaled, with gaps set to the median (0 without any value)."""
    df = attach(sig.df, X.series_stats(sig, moments=False, quantiles={"_med": 0.5}), list(sig.keys), bound=sig.n_series + 1)
    df = attach(df, per_series, list(sig.keys), bound=sig.n_series + 1)
    return _select(sig, df, {c: F.when(F.coalesce(F.col(f"_d{i}.normalization_method"), F.lit("None")) != "None",
                                       F.coalesce(F.col(c), X.s("_med", i), F.lit(0.0))).otherwise(F.col(c)) for i, c in enumerate(sig.features)})


def _coded(sig: Signal, rows: DataFrame) -> tuple[Signal, tuple] | None:
    """The plan of sig with the number of every series' definition of channel i beside its rows (``_def{i}``), and the
    definitions, each a tuple in the order of METHODS and the settings; None where they can't be: too many, or no plan."""
    if sig.plan is None or sig.plan.labels:
        return None
    names = [*METHODS, *asdict(DEFAULT)]
    found = rows.select(*names).distinct().limit(MAX_DEFINITIONS + 1).collect()
    if len(found) > MAX_DEFINITIONS:
        return None
    defs = tuple(sorted(tuple(r) for r in found))
    numbers = rows.sparkSession.createDataFrame([(*d, i) for i, d in enumerate(defs)], rows.select(*names).schema.add("_no", "integer"))
    numbered = rows.join(F.broadcast(numbers), names)
    per_series = numbered.groupBy(*sig.keys).agg(*[F.max(F.when(F.col("feature") == f, F.col("_no"))).alias(f"_def{i}") for i, f in enumerate(sig.features)])
    coded = B.attached(sig, per_series)
    return None if coded is None else (coded, defs)


def _smoothed(cells, closed, names, method: str, st: Settings) -> dict:
    """``pipeline.smooth`` over whole series whose gaps are closed."""
    if method == "Savitzky-Golay":
        return _fitted(cells, closed, names, st.sg_window + (st.sg_window % 2 == 0), st.sg_poly)
    if method == "Butterworth":
        share = st.filter_cutoff / (0.5 * st.sampling_rate) if st.sampling_rate > 0 else 0.0
        return _filtered(cells, closed, names, share, 3) if 0 < share < 1 else {}
    return _kept(cells, closed, names, st.fourier_keep_ratio)


def _run(cells, x, names, method: str, values) -> dict:
    """A method with its own settings over the whole series of a block."""
    if method == "KNN Imputation":
        return B.knn(cells, x, names, values["knn_neighbors"])
    if method == "MICE":
        return fill_block(cells, x, names, values["mice_iter"])
    if method == "Winsorization":
        return B.winsor(cells, x, names, values["winsor_q"])
    if method == "Isolation Forest":
        return _mask_block(cells, x, names, values["if_contamination"], 100, 256, B.HASH_SEED)
    st = Settings(**values)
    if method == "Savitzky-Golay" and st.sg_window + (st.sg_window % 2 == 0) <= st.sg_poly:
        return {}  # not smoothed, and its gaps stay
    closed = x.but(B.close(cells, x, names))
    return {**{f: closed[f] for f in names}, **_smoothed(cells, closed, names, method, st)}


def _block_stage(cells, x, feats, stage: str, defs) -> dict:
    """One stage of ``replay`` (a step of ``operators.blocks``): every channel of every series by its own definition."""
    names = [*METHODS, *asdict(DEFAULT)]
    at = {n: k for k, n in enumerate(names)}

    def method_of(d):
        if stage == "first":
            return d[at["missing_method"]] if d[at["operation_order"]] == MV_FIRST else "None"
        if stage == "again":
            return "Linear Interpolation" if d[at["missing_method"]] == "None" else d[at["missing_method"]]
        return d[at[stage]]

    numbers = [[-1 if v is None else v for v in B.of_series(cells, f"_def{i}")] for i in range(len(feats))]
    numbers = [np.array(v, dtype=np.int64) for v in numbers]
    used = sorted({v for n in numbers for v in n.tolist()} - {-1})
    out = dict.fromkeys(feats)
    for i, f in enumerate(feats):
        y = x[f]
        per = lambda name, kind=float: np.array([defs[v][at[name]] if v >= 0 else 0 for v in numbers[i]], dtype=kind)  # noqa: B023,E731
        for m in sorted({method_of(defs[v]) for v in used} - {"None"}):
            asks = np.array([v >= 0 and method_of(defs[v]) == m for v in numbers[i]], dtype=bool)
            if not asks.any() or m not in LIGHT:
                continue
            if stage in ("first", "again"):
                new = B.fill(cells, x, (f,), m, "v2").get(f, x[f])
            elif stage == "outlier_method":
                new = np.where(B.odd(cells, x[f], m, per("z_thresh"), per("iqr_factor"), per("mad_thresh"), "v2"), np.nan, x[f])
            else:
                new = B.scaled(cells, x[f], m)
            y = np.where(asks[cells.g], new, y)
        out[f] = y
    runs = {}
    for v in used:
        m = method_of(defs[v])
        if m != "None" and m not in LIGHT:
            runs.setdefault((m, tuple(defs[v][at[k]] for k in OWN_SETTINGS[m])), set()).add(v)
    for (m, values), of in sorted(runs.items(), key=repr):
        asks = [np.isin(n, list(of)) for n in numbers]
        some = np.any(asks, axis=0)
        if not some.any():
            continue
        rows = some[cells.g]
        part = B.Cells(cells.t.filter(pa.array(rows)), cells.names.items())
        px = B.Channels(part.t, part.names, {f: x[f][rows] for f in feats})
        done = _run(part, px, feats, m, {**asdict(DEFAULT), **dict(zip(OWN_SETTINGS[m], values))})
        for i, f in enumerate(feats):
            if f in done:
                mine = asks[i][cells.g]
                y = out[f].copy()
                y[mine] = done[f][mine[rows]]
                out[f] = y
    return out


def _block_middle(cells, x, feats, defs) -> dict:
    """``_median_filled`` as a step: the channels that will be scaled."""
    at = list(METHODS).index("normalization_method")
    new, out = B.fill_middle(cells, x, feats, "v2"), {}
    for i, f in enumerate(feats):
        if f in new:
            asks = np.array([v is not None and defs[v][at] != "None" for v in B.of_series(cells, f"_def{i}")], dtype=bool)
            out[f] = np.where(asks[cells.g], new[f], x[f])
    return out


def _on_blocks(sig: Signal, defs) -> Signal:
    heavy = any({"KNN Imputation", "MICE", "Isolation Forest"} & set(d[:len(METHODS)]) for d in defs)
    cur = sig
    for stage in ("first", "outlier_method", "again"):
        cur = B.then(cur, _block_stage, stage, defs, heavy=heavy)
    if any(d[list(METHODS).index("normalization_method")] != "None" for d in defs):
        cur = B.then(B.then(cur, _block_middle, defs), _block_stage, "normalization_method", defs)
    return B.then(cur, _block_stage, "smoothing_method", defs)


def replay(sig: Signal, definition: DataFrame) -> Signal:
    """Run the definition on the signal.  Series and features without a definition stay as they are; an unknown method or
    feature and a repeated definition are errors."""
    keys, feats = list(sig.keys), list(sig.features)
    rows = parsed(definition, keys).persist()
    _checked(rows, keys, feats)
    coded = _coded(sig, rows)
    if coded is not None:
        return _on_blocks(*coded)
    sig = sig.with_df(sig.df)  # row by row from here
    per_series = _by_series(rows, keys, feats)
    first = f"if({{}}operation_order = '{MV_FIRST}', {{}}missing_method, 'None')"
    again = "if({}missing_method = 'None', 'Linear Interpolation', {}missing_method)"

    def stage(cur, *how):
        return _stage(cur, rows, per_series, *how)

    quick_fills = ("Mean Imputation", "LOCF", "Linear Interpolation")
    cur = stage(sig, first, _fills, quick_fills, _mv0)
    cur = stage(cur, "{}outlier_method", _masks, ("Z-Score", "IQR", "MAD"), _out0)
    cur = stage(cur, again, _fills, quick_fills, _mv0)
    if rows.where("normalization_method <> 'None'").head(1):
        cur = _median_filled(cur, per_series)
        cur = stage(cur, "{}normalization_method", _scales, SCALING[1:], None)
    return stage(cur, "{}smoothing_method", None, (), smooth)

