"""Operator tests on small fixtures: brute force and metamorphic checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigsieve.operators import evaluate as EV
from sigsieve.operators.knn import knn_impute
from sigsieve.operators.smooth import savgol
from sigsieve.signal import make_signal

SF = "/root/testdata/sf0.001"


def _wide(spark, n_blocks=None):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax")
    li = li.withColumn("l_quantity", F.when(F.col("l_orderkey") % 7 == 0, None).otherwise(F.col("l_quantity")))
    li = li.withColumn("l_tax", F.when(F.col("l_partkey") % 5 == 0, None).otherwise(F.col("l_tax")))
    return make_signal(li, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
                       ["l_quantity", "l_extendedprice", "l_tax"], n_blocks=n_blocks, checkpoint=False)


def _brute_knn(pdf, feats, k):
    out = pdf.copy()
    for _, g in pdf.groupby("l_suppkey"):
        X = g[feats].to_numpy(float)
        pos = g["pos"].to_numpy()
        for a in range(len(g)):
            for j in range(len(feats)):
                if not np.isnan(X[a, j]):
                    continue
                cands = []
                for b in range(len(g)):
                    if np.isnan(X[b, j]):
                        continue
                    both = ~np.isnan(X[a]) & ~np.isnan(X[b])
                    if not both.any():
                        continue
                    d = np.sqrt(len(feats) / both.sum() * np.sum((X[a, both] - X[b, both]) ** 2))
                    cands.append((d, pos[b], X[b, j]))
                cands.sort()
                val = np.mean([c[2] for c in cands[:k]]) if cands else np.nanmean(X[:, j])
                out.loc[g.index[a], feats[j]] = val
    return out


def test_knn_chunks_match_brute_force(spark):
    sig = _wide(spark)
    feats = list(sig.features)
    pdf = sig.df.select("l_suppkey", "pos", *feats).toPandas().sort_values(["l_suppkey", "pos"]).reset_index(drop=True)
    exp = _brute_knn(pdf, feats, 5)
    got = knn_impute(sig, k=5, receiver_rows=150, donor_rows=400).df.select("l_suppkey", "pos", *feats).toPandas() \
        .sort_values(["l_suppkey", "pos"]).reset_index(drop=True)
    assert np.allclose(got[feats].to_numpy(float), exp[feats].to_numpy(float))


def test_injected_missing_count_is_exact(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet").select("event_type", "event_id", "value")
    sig = make_signal(ev, ["event_type"], ["event_id"], ["value"], checkpoint=False)
    for rate in (0.05, 0.2, 0.4):
        out = EV.inject_missing(sig, rate, seed=7, row_id="event_id").df
        got = {r["event_type"]: r["n"] for r in out.groupBy("event_type").agg(F.count_if(F.col("value").isNull()).alias("n")).collect()}
        m = {r["event_type"]: r["m"] for r in ev.groupBy("event_type").agg(F.count("value").alias("m")).collect()}
        for k, v in m.items():
            assert got[k] == int(v * rate)


def test_savgol_blocks_equal_and_interior_is_convolution(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet").select("event_type", "event_id", "value")
    outs = []
    for blocks, rows in ((1, 1 << 17), (7, 3), (64, 25)):
        sig = make_signal(ev, ["event_type"], ["event_id"], ["value"], n_blocks=blocks, checkpoint=False)
        outs.append(savgol(sig, 11, 2, block_rows=rows).df.select("event_type", "pos", "value").toPandas()
                    .sort_values(["event_type", "pos"]).reset_index(drop=True))
    assert np.allclose(outs[0]["value"], outs[1]["value"]) and np.allclose(outs[0]["value"], outs[2]["value"])
    raw = ev.toPandas().sort_values(["event_type", "event_id"])
    g = raw[raw.event_type == raw.event_type.iloc[0]]["value"].to_numpy()
    from sigsieve.operators.smooth import savgol_matrix
    kern = savgol_matrix(11, 2)[5]
    interior = np.convolve(g, kern[::-1], mode="valid")
    got = outs[0][outs[0].event_type == raw.event_type.iloc[0]]["value"].to_numpy()
    assert np.allclose(got[5:-5], interior)


def test_injected_cells_spread_and_differ_between_channels(spark):
    rows = spark.range(4000).selectExpr("id AS t", "cast(id % 2 AS string) AS k", "cast(id AS double) AS a", "cast(id AS double) AS b")
    hit = {}
    for f in ("a", "b"):
        sig = make_signal(rows, ["k"], ["t"], [f], checkpoint=False)
        out = EV.inject_missing(sig, 0.1, seed=42, row_id="pos").df
        hit[f] = {(r.k, r.pos) for r in out.where(F.col(f).isNull()).collect()}
        assert len(hit[f]) == 400
        first_half = sum(p <= 1000 for _, p in hit[f])
        assert 160 < first_half < 240  # 200 expected, 4 sigma
    assert 15 < len(hit["a"] & hit["b"]) < 70  # 40 expected if independent
    big = spark.createDataFrame([(2**62 + i, "x", float(i)) for i in range(50)], "t long, k string, a double")
    sig = make_signal(big, ["k"], ["t"], ["a"], checkpoint=False)
    assert EV.inject_missing(sig, 0.2, row_id="t").df.where("a IS NULL").count() == 10


def test_null_series_keys_are_refused(spark):
    df = spark.createDataFrame([("x", 1, 1.0), (None, 2, 2.0)], "k string, t long, v double")
    with pytest.raises(ValueError, match="NULL"):
        make_signal(df, ["k"], ["t"], ["v"], checkpoint=False)


def test_processed_table_keeps_masked_cells_masked(spark):
    from sigsieve.sources.sinks import processed_table
    raw = spark.createDataFrame([("x", 1, 1.0), ("x", 2, 1000.0), ("y", 1, 3.0)], "k string, t long, v double")
    sig = make_signal(raw.where("k = 'x'"), ["k"], ["t"], ["v"], checkpoint=False)
    masked = sig.with_df(sig.df.withColumn("v", F.when(F.col("v") < 100, F.col("v") * 2)))
    got = {(r.k, r.t): r.v for r in processed_table(raw, masked, ["k", "t"]).collect()}
    assert got == {("x", 1): 2.0, ("x", 2): None, ("y", 1): 3.0}


def test_no_fill_is_replaced_by_another(spark):
    from sigsieve.operators import transform as X
    from sigsieve.plans.pipeline import smooth
    rows = [("x", t, None if t == 7 else float(t % 5) * 100, float(t % 5) * 200 + 1) for t in range(40)]  # t = 7: 200 by w
    sig = make_signal(spark.createDataFrame(rows, "k string, t long, v double, w double"), ["k"], ["t"], ["v", "w"])

    def at7(method):
        return X.impute(sig, method).df.where("t = 7").first()["v"]
    assert abs(at7("MICE") - 200) < 1 and at7("KNN Imputation") == 200.0
    # row 7's neighbours hold 100 and 300: the temporal fill meets 200 by chance, so ask a row where it doesn't
    late = sig.with_df(sig.df.withColumn("v", F.when(F.col("t") != 9, F.coalesce("v", F.lit(200.0)))))
    fills = {m: X.impute(late, m).df.where("t = 9").first()["v"] for m in ("MICE", "KNN Imputation", "Linear Interpolation")}
    assert fills["Linear Interpolation"] == 150.0 and abs(fills["MICE"] - 400) < 1 and fills["KNN Imputation"] == 400.0
    with pytest.raises(ValueError):
        X.impute(sig, "no such method")
    with pytest.raises(ValueError):
        smooth(sig, "no such method")
    smoothed = {m: [r.w for r in smooth(sig, m).df.orderBy("t").collect()] for m in ("Savitzky-Golay", "Butterworth", "Fourier")}
    assert len({tuple(v) for v in smoothed.values()}) == 3  # each runs as itself


def test_plain_coercion_and_catalogue_flags(spark):
    from sigsieve.sources import csv_ingest as CI
    cells = [("1,5", 1.5), (" 2.5 ", 2.5), ("1 234", None), ("12mm", None), ("-", None), ("", None), ("nan", None), ("1e3", 1000.0), ("1,2,3", None), (None, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cells)], "i int, t string")
    got = [r.v for r in df.select("i", CI.numeric_text_plain("t").alias("v")).orderBy("i").collect()]
    assert got == [v for _, v in cells]
    wide = spark.createDataFrame([tuple(str(i + j) for j in range(45)) for i in range(20)], ", ".join(f"`Pupil {j}` string" for j in range(45)))
    cat = CI.column_catalogue(wide).collect()
    assert len(cat) == 45 and all(r.relevant and r.eligible for r in cat)
    assert CI.column_catalogue(wide.limit(0)).where("eligible").count() == 0



def test_partner_columns(spark):
    from sigsieve.operators.spatial import partners

    names = ["Gaze_X", "gaze_y", "Left X", "Left Y", "LEFT x", "left y", "eye_X", "EYE_y", "Pupil", "XY", "YX", "GAZE_Y"]
    got = dict(map(tuple, partners(spark.createDataFrame(list(zip(names, range(len(names)))), "column string, ordinal int")).collect()))

    def plain(f):  # rules in order, exact before lower case, the last of equal lower-case names
        pairs = [("Gaze_X", "Gaze_Y"), ("Gaze_Y", "Gaze_X"), ("Gaze X", "Gaze Y"), ("Gaze Y", "Gaze X"), ("gaze_x", "gaze_y"), ("gaze_y", "gaze_x"),
                 ("_X", "_Y"), ("_Y", "_X"), (" x", " y"), (" y", " x"), ("X", "Y"), ("Y", "X")]
        low = {c.lower(): c for c in names}
        for a, b in pairs:
            if a in f:
                c = f.replace(a, b)
                if c in names:
                    return c
                if c.lower() in low:
                    return low[c.lower()]
        return None

    assert got == {f: plain(f) for f in names if plain(f)} and got["Gaze_X"] == "GAZE_Y" and "Pupil" not in got


@pytest.mark.parametrize("n_blocks", [1, 5])
def test_drift_of_a_small_wave_on_a_large_level(spark, n_blocks):
    from sigsieve.operators import profile as P
    from sigsieve.signal import make_signal

    rng = np.random.default_rng(7)
    wave = 1e-3 * (np.sin(np.arange(20_000) / 3000) + 0.2 * rng.normal(size=20_000))
    x = 1e9 + np.where(rng.random(20_000) < 0.1, np.nan, wave)
    df = spark.createDataFrame([(i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "t long, x double")
    sig = make_signal(df, [], ["t"], ["x"], n_blocks=n_blocks)
    got = P.profile(sig).first().drift_score
    v = x[~np.isnan(x)] - 1e9  # exact: the level is a whole number of steps
    w = max(10, int(len(v) * 0.08))
    low = max(5, w // 3)
    sums = np.concatenate([[0], np.cumsum(v)])
    rolling = [(sums[i] - sums[max(0, i - w)]) / min(i, w) for i in range(low, len(v) + 1)]
    want = (max(rolling) - min(rolling)) / (4 * v.std(ddof=1))
    assert abs(got - want) < 1e-6
    plan = P.drift_table(P.long_carry(sig, prefix_sum=True), ["_f"])._jdf.queryExecution().optimizedPlan().toString()
    assert n_blocks > 1 or " Join LeftOuter" not in plan.replace("Join Cross", "")


def test_rates_blanked_together_equal_one_at_a_time(spark):
    rows = spark.range(900).selectExpr("id AS t", "cast(id % 3 AS string) AS k", "IF(id % 7 = 0, NULL, cast(id AS double)) AS a", "IF(id < 850, NULL, 1.0D) AS b")
    sig = make_signal(rows, ["k"], ["t"], ["a", "b"], checkpoint=False)
    plan = {"a5": ("a", 0.05, 1), "a40": ("a", 0.4, 2), "b20": ("b", 0.2, 1), "all": ("a", 1.0, 3), "few": ("b", 0.001, 4)}
    df, new = EV.blanked(sig, plan)
    got = {(r.k, r.pos): r for r in df.select("k", "pos", *[c.alias(n) for n, c in new.items()]).collect()}
    assert len(got) == 900
    for name, (f, rate, seed) in plan.items():
        one = EV.inject_missing(sig.select_features([f]), rate, seed).df.select("k", "pos", f).collect()
        assert {(r.k, r.pos): r[f] for r in one} == {at: r[name] for at, r in got.items()}
        m = {r.k: r.m for r in sig.df.groupBy("k").agg(F.count(f).alias("m")).collect()}
        for k, n in m.items():
            assert sum(r[name] is not None for r in got.values() if r.k == k) == n - int(n * rate)
