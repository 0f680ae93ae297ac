"""Replay of stored definitions: uniform ones equal run_pipeline, mixed ones each series' and channel's own pipeline."""

import json
from dataclasses import asdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigsieve.plans import pipeline as PL
from sigsieve.plans import replay as RE
from sigsieve.signal import make_signal
from sigsieve.sources import sinks as SK

MIXED = {
    "a": {f: ("KNN Imputation", "Isolation Forest", "StandardScaler", "None", {"knn_neighbors": 3, "if_contamination": 0.1}) for f in "xyz"},
    "b": {"x": ("Mean Imputation", "Z-Score", "MinMaxScaler", "Savitzky-Golay", {"z_thresh": 2.0, "sg_window": 7}),
          "y": ("LOCF", "MAD", "None", "Fourier", {"mad_thresh": 2.5, "operation_order": PL.OUT_FIRST}),
          "z": ("None", "Winsorization", "RobustScaler", "None", {"winsor_q": 0.1})},
    "c": {"x": ("Linear Interpolation", "None", "None", "Butterworth", {"filter_cutoff": 20.0}),
          "z": ("None", "IQR", "None", "None", {"iqr_factor": 1.0, "operation_order": PL.OUT_FIRST})},
}


@pytest.fixture(scope="module")
def sig(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in "abcd":
        x = rng.normal(size=(90, 3)).cumsum(axis=0)
        x[rng.random((90, 3)) < 0.04] *= 6
        gone = rng.random((90, 3)) < 0.15
        rows += [(s, i, *[None if g else float(v) for v, g in zip(x[i], gone[i])]) for i in range(90)]
    return make_signal(spark.createDataFrame(rows, "s string, t long, x double, y double, z double"), ["s"], ["t"], ["x", "y", "z"])


def _definition(spark, mixed):
    rows = [(s, f, json.dumps(dict(zip(RE.METHODS, m[:4]))), json.dumps(m[4])) for s, per in mixed.items() for f, m in per.items()]
    return spark.createDataFrame(rows, "s string, feature string, pipeline string, settings string")


def _values(sig):
    return {(r.s, r.t): (r.x, r.y, r.z) for r in sig.df.select("s", "t", "x", "y", "z").collect()}


def test_mixed_definition(spark, sig, tmp_path):
    path = str(tmp_path / "definition")
    SK.write_json(_definition(spark, MIXED), path)
    got, raw = _values(RE.replay(sig, RE.read_definition(spark, path, ["s"]))), _values(sig)
    for s, per in MIXED.items():
        for i, f in enumerate("xyz"):
            if f not in per:
                assert all(got[k][i] == raw[k][i] for k in got if k[0] == s)
                continue
            *methods, own = per[f]
            want = _values(PL.run_pipeline(sig.with_df(sig.df.where(F.col("s") == s)), *methods, PL.Settings(**{**asdict(PL.DEFAULT), **own})))
            for k, w in want.items():
                assert got[k][i] == w[i] or abs(got[k][i] - w[i]) < 1e-9, (s, f, k)
    assert all(got[k] == raw[k] for k in got if k[0] == "d")


def test_whole_definition_of_one_series_table(spark):
    df = spark.createDataFrame([(i, float(i % 7) if i % 5 else None) for i in range(60)], "t long, x double")
    one = make_signal(df, [], ["t"], ["x"])
    rows = [("x", json.dumps(dict(zip(RE.METHODS, ("LOCF", "IQR", "StandardScaler", "Savitzky-Golay")))), "{}")]
    got = RE.replay(one, spark.createDataFrame(rows, "feature string, pipeline string, settings string")).df.orderBy("t").collect()
    want = PL.run_pipeline(one, "LOCF", "IQR", "StandardScaler", "Savitzky-Golay").df.orderBy("t").collect()
    assert np.allclose([r.x for r in got], [r.x for r in want], atol=1e-12)


def test_errors_are_named(spark, sig):
    bad = {"a": {"x": ("Guess", "None", "None", "None", {})}}
    with pytest.raises(ValueError, match="unknown missing_method Guess"):
        RE.replay(sig, _definition(spark, bad))
    with pytest.raises(ValueError, match="unknown feature q"):
        RE.replay(sig, _definition(spark, {"a": {"q": ("None", "None", "None", "None", {})}}))
    twice = _definition(spark, MIXED)
    with pytest.raises(ValueError, match="more than one definition"):
        RE.replay(sig, twice.unionByName(twice))
