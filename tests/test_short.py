"""Short series in groups: the same rows as the windows and quantiles for long series, without a copy of the rows."""

import math

import pytest

from sigsieve.operators import audit as AU
from sigsieve.operators import profile as P
from sigsieve.operators import short
from sigsieve.operators import spatial as SP
from sigsieve.operators import transform as X
from sigsieve.operators import validate as VA
from sigsieve.operators.knn import knn_impute
from sigsieve.plans import pipeline as PL
from sigsieve.signal import make_signal


@pytest.fixture(scope="module")
def sig(spark):
    rows = []
    for k, n in (("a", 90), ("b", 400), ("one", 1), ("two", 2), ("flat", 40), ("empty", 30)):
        for t in range(n):
            h = (t * 7919 + n) % 101
            x = {"flat": 0.1, "empty": None}.get(k, float(h) * (9 if h == 50 else 1) if t % 13 else None)
            rows.append((k, t, x, 1e9 + math.sin(t) if h % 7 else None, float(t % 3)))
    return make_signal(spark.createDataFrame(rows, "k string, t long, Gaze_X double, Gaze_Y double, z double"), ["k"], ["t"], ["Gaze_X", "Gaze_Y", "z"])


def _rows(df):
    names = sorted(df.columns)
    plain = lambda v: None if v is None else round(v, 5) if isinstance(v, float) else v
    return sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def _both_ways(monkeypatch, make):
    got = make()
    assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().toString()
    got = _rows(got)
    with monkeypatch.context() as m:
        m.setattr(short, "SHORT_ROWS", -1)
        assert got == _rows(make())


@pytest.mark.parametrize("make", [lambda s: P.profile(s, extras=True), P.profile_ev, lambda s: knn_impute(s, 3).df.drop("_n"), lambda s: SP.spatial_metrics(s, "Gaze_X", "Gaze_Y")],
                         ids=["profile", "profile_ev", "knn", "spatial"])
def test_short_equals_long(sig, monkeypatch, make):
    _both_ways(monkeypatch, lambda: make(sig))


def test_stage_audit_short_equals_long(sig, monkeypatch):
    st = PL.stages(sig, "LOCF", "IQR", "RobustScaler", "None")
    _both_ways(monkeypatch, lambda: AU.stage_audit(sig, st))


def test_series_stats_short_equals_long(sig, monkeypatch):
    make = lambda: X.series_stats(sig, quantiles={"_q1": 0.25, "_q3": 0.75}, mad=True)
    got = _rows(make())
    with monkeypatch.context() as m:
        m.setattr(short, "SHORT_ROWS", -1)
        assert got == _rows(make())


def test_profile_of_short_series_keeps_no_copy_of_the_rows(sig):
    assert "InMemoryRelation" not in P.profile(sig)._jdf.queryExecution().toString()


def test_fits_take_parts_by_rows(spark):
    df = spark.range(60_000).selectExpr("id", "id % 5 as fold").coalesce(1)
    assert VA.for_fits(df, ["id"]).rdd.getNumPartitions() == 3


def test_no_statistics_where_nothing_needs_them(sig, monkeypatch):
    refuse = lambda *a, **k: pytest.fail("statistics computed that nothing uses")
    want = _rows(X.impute(sig, "Linear Interpolation").df)
    with monkeypatch.context() as m:
        m.setattr(X, "series_stats", refuse)
        full = X.impute(sig, "Linear Interpolation").materialize()  # channels without any value are 0 by rule
        assert X.filled(full) is full and _rows(full.df) == want
        empty = [r for r in full.df.where("k = 'empty'").collect()]
        assert len(empty) == 30 and {r.Gaze_X for r in empty} == {0.0}
    assert X.filled(sig).df.where("Gaze_X is null").count() == 0


def test_profile_of_long_series_takes_its_quantiles_from_counted_values(sig, monkeypatch):
    want = _rows(P.profile(sig, extras=True))
    plain = P.exact_quantiles
    monkeypatch.setattr(short, "SHORT_ROWS", -1)
    monkeypatch.setattr(P, "exact_quantiles", lambda *a, **k: pytest.fail("quantiles of the rows, not of their values"))
    assert _rows(P.profile(sig, extras=True)) == want
    monkeypatch.setattr(P, "exact_quantiles", plain)
    monkeypatch.setattr(P, "DIRECT_PERCENTILE_ROWS", 3)  # too many values for one map: the rows' quantiles
    assert _rows(P.profile(sig, extras=True)) == want
