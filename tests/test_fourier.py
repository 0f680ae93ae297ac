"""Fourier low-pass against numpy.fft: any length, three block sizes, one long series among short ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigsieve.operators import fourier
from sigsieve.plans import pipeline as PL
from sigsieve.signal import make_signal


def _reference(x, ratio):
    spectrum = np.fft.fft(x)
    spectrum[np.abs(np.fft.fftfreq(len(x))) > ratio] = 0
    return np.real(np.fft.ifft(spectrum))


@pytest.mark.parametrize("ratio", [0.0, 0.08, 0.1, 0.25, 0.499, 0.5])
def test_kept_bins_are_those_of_fftfreq(ratio):
    for n in [*range(1, 60), 125, 250, 1000, 1001]:
        assert fourier.kept_bins(n, ratio) == np.flatnonzero(np.abs(np.fft.fftfreq(n))[: n // 2 + 1] <= ratio).max()


def test_shape_holds_every_place():
    for n in [2, 3, 5, 64, 97, 1000, 1021, 65_537, 10**9 + 7]:
        n1, n2, wide, tall = fourier.shape(n, 1 << 20)
        assert n1 * n2 >= 2 * n - 1 and n2 & (n2 - 1) == 0
        assert max(wide * n1, tall * n2) <= max(1 << 20, 2 * int((2 * n) ** 0.5) + 2)


@pytest.mark.parametrize("block_rows", [32, 200, 1 << 20])
def test_any_length_and_block_size(spark, block_rows):
    rng = np.random.default_rng(3)
    lengths = [1, 2, 7, 33, 97, 210, 509]
    series = {n: np.column_stack([rng.normal(size=n).cumsum(), 1e6 + rng.normal(size=n)]) for n in lengths}
    rows = [(n, i, float(a), float(b), None, str(i)) for n, x in series.items() for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "s long, t long, x double, y double, void double, note string")
    sig = make_signal(df, ["s"], ["t"], ["x", "y", "void"])
    got = fourier.fourier_lowpass(sig, 0.08, block_rows).df.orderBy("s", "t").collect()
    assert len(got) == len(rows) and all(r.void is None and r.note == str(r.t) for r in got)
    for n, x in series.items():
        for c, name in enumerate(("x", "y")):
            mine = np.array([r[name] for r in got if r.s == n])
            want = _reference(x[:, c], 0.08)
            assert np.abs(mine - want).max() <= 1e-9 * max(1.0, np.abs(x[:, c]).max())


def test_gaps_are_closed_first_and_pipeline_runs_it(spark):
    rows = [(i, None if i % 9 in (4, 5) else float(np.sin(i / 5))) for i in range(120)]
    sig = make_signal(spark.createDataFrame(rows, "t long, x double"), [], ["t"], ["x"])
    got = [r.x for r in PL.smooth(sig, "Fourier").df.orderBy("t").collect()]
    known = [i for i, v in rows if v is not None]
    closed = np.interp(range(120), known, [rows[i][1] for i in known])
    assert np.allclose(got, _reference(closed, 0.08), atol=1e-9)
    empty = sig.with_df(sig.df.where(F.lit(False)))
    assert fourier.fourier_lowpass(empty).df.count() == 0


def test_short_series_are_transformed_in_groups_without_a_join(spark, monkeypatch):
    lengths = {"a": 1, "b": 40, "c": 97, "empty": 12}
    rows = [(k, t, None if k == "empty" or t % 7 == 3 else float((t * 37) % 11), str(t)) for k, n in lengths.items() for t in range(n)]
    sig = make_signal(spark.createDataFrame(rows, "s string, t long, x double, note string"), ["s"], ["t"], ["x"])
    read = lambda d: {(r.s, r.t): (r.x, r.note, r.pos) for r in d.collect()}
    done = fourier.fourier_lowpass(sig, 0.08).df
    assert "Join" not in done._jdf.queryExecution().optimizedPlan().toString()
    got = read(done)
    monkeypatch.setattr(fourier.short, "SHORT_ROWS", -1)
    want = read(fourier.fourier_lowpass(sig, 0.08).df)
    assert set(got) == set(want) and len(got) == len(rows) and got["empty", 3][0] is None
    assert all(got[k][1:] == want[k][1:] and got[k][0] == pytest.approx(want[k][0], abs=1e-9) for k in got if k[0] != "empty")
