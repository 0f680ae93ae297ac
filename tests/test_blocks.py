"""Signals in blocks: the same rows as written signals, and no row written behind the blocks."""

import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigsieve import session
from sigsieve.operators import audit as AU
from sigsieve.operators import blocks as B
from sigsieve.operators import profile as P
from sigsieve.operators import short
from sigsieve.operators import spatial as SP
from sigsieve.operators import transform as X
from sigsieve.operators.knn import knn_impute
from sigsieve.plans import grid as G
from sigsieve.plans import pipeline as PL
from sigsieve.signal import make_signal

FEATS = ["Gaze_X", "Gaze_Y", "z"]


def _table(spark):
    rows = []
    for k, n in (("a", 90), ("b", 400), ("one", 1), ("two", 2), ("flat", 40), ("empty", 30)):
        for t in range(n):
            h = (t * 7919 + n) % 101
            x = {"flat": 0.1, "empty": None}.get(k, float(h) * (9 if h == 50 else 1) if t % 13 else None)
            rows.append((k, t, x, 1e3 + math.sin(t) if h % 7 else None, float(t % 3)))
    return spark.createDataFrame(rows, "k string, t long, Gaze_X double, Gaze_Y double, z double")


@pytest.fixture(scope="module")
def written(spark):
    return make_signal(_table(spark), ["k"], ["t"], FEATS)


@pytest.fixture(scope="module")
def sig(spark):
    s = make_signal(_table(spark), ["k"], ["t"], FEATS, checkpoint=False).in_blocks()
    assert s.plan is not None
    return s


def _rows(df):
    names = sorted(df.columns)
    plain = lambda v: None if v is None else round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


OPERATORS = {
    **{f"{m} {v}": lambda s, m=m, v=v: X.impute(s, m, v) for m in ("Mean Imputation", "LOCF", "Linear Interpolation") for v in ("v1", "v2", "ev")},
    **{f"{m} {v}": lambda s, m=m, v=v: X.mask_outliers(s, m, z_thresh=1.5, variant=v) for m in ("Z-Score", "IQR", "MAD") for v in ("v1", "v2", "ev")},
    "winsor": lambda s: X.mask_outliers(s, "Winsorization"), "clip": lambda s: X.clip(s, 2.0, 1000.5), "knn": lambda s: knn_impute(s, 3),
    **{f"{m} {v}": lambda s, m=m, v=v: X.scale(s, m, v) for m in ("StandardScaler", "RobustScaler", "MinMaxScaler") for v in ("v2", "ev")},
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_blocks_equals_rows(sig, written, name):
    got = OPERATORS[name](sig)
    assert got.plan is not None
    assert _rows(got.df) == _rows(OPERATORS[name](written).df)


@pytest.mark.parametrize("make", [lambda s: P.profile(s, extras=True), P.profile_ev, lambda s: X.series_stats(s, quantiles={"_q": 0.3}, mad=True),
                                  lambda s: SP.spatial_metrics(s, "Gaze_X", "Gaze_Y"), lambda s: AU.stage_audit(s, PL.stages(s, "LOCF", "IQR", "RobustScaler", "None")),
                                  lambda s: AU.stage_audit_spatial(r := AU.with_raw(s), PL.stages(r, "LOCF", "IQR", "RobustScaler", "None"))],
                         ids=["profile", "profile_ev", "stats", "spatial", "audit", "audit_spatial"])
def test_reader_of_blocks_equals_rows(sig, written, make):
    got = make(sig)
    assert _rows(got) == _rows(make(written))


def test_grid_on_blocks_writes_nothing(sig, written, monkeypatch):
    want = _rows(G.mv_outlier_grid(written))
    with monkeypatch.context() as m:
        m.setattr(session, "materialize", lambda df: pytest.fail("rows written"))
        m.setattr(B, "materialize", lambda df: pytest.fail("blocks written"))
        got = G.mv_outlier_grid(sig)
        assert "Exchange" not in AU.audit(G.cleaned_combos(sig), sig, None)._jdf.queryExecution().optimizedPlan().toString()
        assert _rows(got) == want


def test_renamed(sig):
    got = sig.renamed({"z": "w"})
    assert got.features == ("Gaze_X", "Gaze_Y", "w")
    assert _rows(X.impute(got, "LOCF").df.withColumnRenamed("w", "z")) == _rows(X.impute(sig, "LOCF").df)


def test_series_are_cut_whole(spark, monkeypatch):
    monkeypatch.setattr(short, "GROUP_ROWS", 7)
    s = make_signal(_table(spark), ["k"], ["t"], FEATS, checkpoint=False).in_blocks()
    assert s.plan.blocks.count() > 2
    assert s.df.count() == 563 and P.profile(s).where("n = 400").count() == 3


def test_parted_series_are_refused():
    t = pa.table({"pos": [1, 2, 1], "_n": [3, 3, 1]})
    with pytest.raises(ValueError):
        B.Cells(t)
    assert [x.num_rows for x in B.whole_series(pa.table({"pos": [1, 1, 2, 1], "_n": [1, 2, 2, 1]}).to_batches(max_chunksize=1), 2)] == [3, 1]


def test_heavy_steps_are_written_once(sig, written):
    done = knn_impute(sig, 3).materialize()
    assert not any(steps for _, steps in done.plan.variants)
    assert _rows(X.scale(done, "StandardScaler").df) == _rows(X.scale(knn_impute(written, 3).materialize(), "StandardScaler").df)


def test_labels_keep_their_types(sig):
    u = AU.union_labelled([({"no": 1, "rate": 0.5, "name": "x"}, sig), ({"no": 2, "rate": 0.25, "name": "y"}, sig)])
    assert dict(u.df.dtypes)["no"] == "int" and dict(u.df.dtypes)["rate"] == "double" and u.df.where(F.col("no") == 2).count() == 563


def test_benchmark_has_all_five_imputers(spark, monkeypatch):
    """KNN and MICE beside mean, LOCF and linear; the same errors by the ways of long series."""
    from sigsieve.plans import queries as Q

    rows = [(k, t, float((t * 7919 + n) % 101), math.sin(t) * 50 + n, float(t % 7)) for k, n in (("a", 90), ("b", 200), ("c", 1), ("d", 33)) for t in range(n)]
    df = spark.createDataFrame(rows, "k string, t long, x double, y double, z double")
    got = _rows(Q._masked_benchmark(make_signal(df, ["k"], ["t"], ["x", "y", "z"], checkpoint=False).in_blocks(), Q.IMPUTERS))
    assert {r[1] for r in got} == {"mean", "locf", "linear", "knn", "mice"} and len(got) == 3 * 3 * 5
    monkeypatch.setattr(short, "SHORT_ROWS", -1)
    assert got == _rows(Q._masked_benchmark(make_signal(df, ["k"], ["t"], ["x", "y", "z"]), Q.IMPUTERS))


def test_mice_on_blocks_equals_rows(sig, written):
    got, want = X.impute(sig, "MICE"), X.impute(written, "MICE")
    assert got.plan is not None and _rows(got.df) == _rows(want.df)


@pytest.mark.parametrize("make", [lambda s: X.mask_outliers(s, "Isolation Forest"), lambda s: PL.smooth(s, "Butterworth"), lambda s: PL.smooth(s, "Fourier"),
                                  lambda s: PL.smooth(s, "Savitzky-Golay"), lambda s: PL.preset(s, "feature_wise"), lambda s: PL.preset(s, "robust_default")],
                         ids=["forest", "butterworth", "fourier", "savgol", "feature_wise", "robust"])
def test_method_on_blocks_equals_rows(sig, written, make):
    got = make(sig)
    assert got.plan is not None and _rows(got.df.select("k", "t", *FEATS)) == _rows(make(written).df.select("k", "t", *FEATS))


def test_replay_on_blocks_equals_rows(spark, sig, written, monkeypatch):
    """Every method, with settings of its own, by series and channel; a series without a definition stays as it is."""
    import json

    from sigsieve.plans import replay as RE

    per = {"a": (("KNN Imputation", "Isolation Forest", "StandardScaler", "None", {"knn_neighbors": 3}), ("MICE", "Winsorization", "None", "Fourier", {"winsor_q": 0.1}),
                 ("None", "None", "None", "None", {})),
           "b": (("Mean Imputation", "Z-Score", "MinMaxScaler", "Savitzky-Golay", {"z_thresh": 1.5, "sg_window": 6}), ("LOCF", "MAD", "None", "Butterworth", {"operation_order": PL.OUT_FIRST}),
                 ("Linear Interpolation", "IQR", "RobustScaler", "None", {"iqr_factor": 1.0})),
           "flat": (("MICE", "Isolation Forest", "RobustScaler", "None", {}), ("None", "Winsorization", "StandardScaler", "Savitzky-Golay", {"sg_window": 2, "sg_poly": 3})),
           "empty": (("KNN Imputation", "IQR", "StandardScaler", "Fourier", {}),)}
    rows = [(k, f, json.dumps(dict(zip(RE.METHODS, m[:4]))), json.dumps(m[4])) for k, ms in per.items() for f, m in zip(FEATS, ms)]
    definition = spark.createDataFrame(rows, "k string, feature string, pipeline string, settings string")
    got = RE.replay(sig, definition)
    assert got.plan is not None
    want = _rows(RE.replay(written, definition).df)
    assert _rows(got.df) == want
    monkeypatch.setattr(RE, "MAX_DEFINITIONS", 2)  # too many: row by row
    assert _rows(RE.replay(sig, definition).df) == want


def test_joins_inside_blocks_equal_joins(spark):
    """Repeated and NULL keys pair as in a join of the tables."""
    from sigsieve.operators import evaluate as EV
    from sigsieve.sources.sinks import processed_table

    rows = [(1, 5, 1.0), (1, 5, 2.0), (1, 6, None), (1, None, 4.0), (1, 9, 5.0), (2, 5, 1.5), (2, 7, 3.0), (2, 7, 3.5), (2, 7, None), (2, 8, 1.0)]
    df = spark.createDataFrame(rows, "k long, t long, x double")
    ways = []
    for s in (make_signal(df, ["k"], ["t"], ["x"], checkpoint=False).in_blocks(), make_signal(df, ["k"], ["t"], ["x"])):
        done = X.scale(X.impute(s, "LOCF"), "StandardScaler")
        if s.plan is not None:
            pt = processed_table(s, done, ["k", "t"], ["k", "t", "x"])
            both = B.paired(s, s, ["k", "t"], {"k": ("l", "k"), "t": ("l", "t"), "x": ("l", "x"), "y": ("r", "x")})
        else:
            pt = processed_table(s.df.select("k", "t", "x"), done, ["k", "t"])
            both = s.df.select("k", "t", "x").join(s.df.select("k", "t", F.col("x").alias("y")), ["k", "t"])
        ways.append([_rows(pt), _rows(both), _rows(EV.ground_truth(s, done, X.clip(s, None, 3.0), ["k", "t"])), _rows(EV.ground_truth(s, done, X.clip(s, None, 3.0), ["k", "pos"]))])
    assert ways[0] == ways[1] and len(ways[0][0]) == 5 + 1 + 1 + 1 + 9 + 1


def test_ridge_rows_are_not_written(spark, sig, monkeypatch):
    """Rows that are quick to read again aren't written for ridge; the scores are those of written rows."""
    from sigsieve.operators import validate as VA

    rows = sig.df.where("k in ('a', 'b')").select("k", "t", *FEATS)
    want = VA.regression_check(rows, rows, ["k", "t"], ["Gaze_X", "z"], "Gaze_Y", ["Ridge"])
    monkeypatch.setattr(VA, "materialize", lambda df: pytest.fail("rows written"))
    got = VA.regression_check(rows, rows, ["k", "t"], ["Gaze_X", "z"], "Gaze_Y", ["Ridge"], cheap=True)
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want])


def test_rows_for_fits_are_written_once(spark, sig, monkeypatch):
    """One write a table for the forest's fits: the vectors, folds and targets."""
    from sigsieve.operators import validate as VA

    rows = sig.df.where("k in ('a', 'b')").select("k", "t", *FEATS)
    written, plain = [], VA.materialize
    monkeypatch.setattr(VA, "materialize", lambda df: written.append(df.columns) or plain(df))
    monkeypatch.setattr(VA, "forest_r2", lambda df, features, target, k: [float(VA._for_model(df, features, target).count())] * k)
    got = VA.regression_check(rows, rows, ["k", "t"], ["Gaze_X", "Gaze_Y"], "z", ["RandomForestReg"], cheap=True)
    assert written == [["features", "fold", "y"]] * 2 and [r[3] for r in got] == [490.0, 490.0]
