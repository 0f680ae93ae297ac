"""Kernel tests: block-carry equals plain windows; exact quantiles; golden rules."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigsieve.functions.stats import exact_quantiles
from sigsieve.operators import recommend as R
from sigsieve.operators import transform as X
from sigsieve.signal import make_signal


def _series(spark, n=500, gaps=(3, 4, 5, 40, 41, 200, 499), keys=True):
    rows = []
    for k in (["a", "b"] if keys else ["a"]):
        for i in range(n):
            v = None if i in gaps else float(np.sin(i / 7.0) * 10 + (i % 13))
            rows.append((k, i * 3 + (1 if k == "b" else 0), v))
    return spark.createDataFrame(rows, "k string, t long, v double")


@pytest.mark.parametrize("blocks", [1, 7, 64])
def test_block_carry_matches_pandas(spark, blocks):
    df = _series(spark)
    sig = make_signal(df, ["k"], ["t"], ["v"], n_blocks=blocks)
    got = X.impute(sig, "LOCF").df.select("k", "t", "pos", "v").toPandas().sort_values(["k", "t"])
    lin = X.impute(sig, "Linear Interpolation").df.select("k", "t", "v").toPandas().sort_values(["k", "t"])
    pdf = df.toPandas().sort_values(["k", "t"])
    for k, g in pdf.groupby("k"):
        exp = g["v"].ffill().bfill().to_numpy()
        assert np.allclose(got[got.k == k]["v"].to_numpy(), exp)
        assert list(got[got.k == k]["pos"]) == list(range(1, len(g) + 1))
        exp_lin = g["v"].reset_index(drop=True).interpolate(limit_direction="both").to_numpy()
        assert np.allclose(lin[lin.k == k]["v"].to_numpy(), exp_lin)


def test_exact_quantiles_bracket_path(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 5, 4000), "x": rng.normal(size=4000).round(2)})
    df = spark.createDataFrame(pdf)
    probs = {"a": 0.0, "b": 0.1, "c": 0.25, "d": 0.5, "e": 0.9, "f": 1.0}
    # force the bracket-and-refine path with a coarse sketch
    got = exact_quantiles(df, ["g"], "x", probs, accuracy=50).toPandas().set_index("g").sort_index()
    exp = pdf.groupby("g")["x"].quantile(list(probs.values())).unstack()
    exp.columns = list(probs)
    assert np.allclose(got[list(probs)].to_numpy(), exp.to_numpy())


# 12 degraded profiles of one pupil channel and the rule
# recommendation published for each (missing %, IQR outlier %, skewness).
GOLDEN = [
    ("original", 0.060641062662431425, 0.02600479644023231, 0.2601482614468812, "LOCF_or_Mean + ZScore + StandardScaler"),
    ("missing_5", 5.056309558186543, 0.030414550320873507, 0.25799795067615044, "KNN + ZScore + StandardScaler"),
    ("missing_10", 10.051978053710656, 0.022472631545153936, 0.26199998298245236, "KNN_or_MICE + ZScore + StandardScaler"),
    ("missing_20", 20.04620271440947, 0.025281710488298182, 0.25902460516604875, "KNN_or_MICE_critical + ZScore + StandardScaler"),
    ("missing_40", 40.034652035807106, 0.02407781951266493, 0.24712101290395014, "KNN_or_MICE_critical + ZScore + StandardScaler"),
    ("outliers_5", 0.060641062662431425, 5.024704556618221, -0.041814516090057555, "LOCF_or_Mean + IQR_or_IsolationForest + StandardScaler"),
    ("outliers_10", 0.060641062662431425, 10.017625473142825, -0.05059378543647014, "LOCF_or_Mean + IQR_or_IsolationForest + MinMaxScaler"),
    ("outliers_20", 0.060641062662431425, 20.012135571672108, -0.013593239980089994, "LOCF_or_Mean + IsolationForest + RobustScaler"),
    ("skew_strength_0.5", 0.060641062662431425, 1.1095379814499118, 0.5342542924603635, "LOCF_or_Mean + IQR_or_IsolationForest + MinMaxScaler"),
    ("skew_strength_1.0", 0.060641062662431425, 1.2251148545176112, 0.8144165589426727, "LOCF_or_Mean + IQR_or_IsolationForest + MinMaxScaler"),
    ("skew_strength_2.0", 0.060641062662431425, 2.05148949695166, 1.439833711065098, "LOCF_or_Mean + MAD_or_IsolationForest + RobustScaler"),
    ("mixed_missing20_outlier10_skew", 20.04620271440947, 10.01155735336608, 2.2088003350726835, "KNN_or_MICE_critical + MAD_or_IsolationForest + RobustScaler"),
]


def test_rule_golden_table(spark):
    df = spark.createDataFrame(GOLDEN, "scenario string, missing_rate double, outlier_rate_iqr double, "
                                       "skewness double, expected string")
    out = R.recommend_rules(df).select("scenario", "expected", "recommended_pipeline").collect()
    assert len(out) == 12
    for r in out:
        assert r["expected"] == r["recommended_pipeline"], r["scenario"]


def test_no_single_partition_exchange_on_rows(spark):
    df = _series(spark, keys=False)
    sig = make_signal(df.drop("k"), [], ["t"], ["v"], n_blocks=4, checkpoint=False)
    plan = X.impute(sig, "LOCF").df._jdf.queryExecution().executedPlan().toString()
    assert "_blk" in sig.df.columns
    # a single-partition exchange may only gather per-block aggregates, never rows
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "SinglePartition" in line:
            assert any("Aggregate(key=[_blk" in x or "Aggregate(keys=[_blk" in x for x in lines[i + 1 : i + 5]), "\n".join(lines[i : i + 6])


def test_scan_prunes_unused_columns(spark):
    from sigsieve.operators.sequence import with_pos
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_suppkey", "l_quantity")
    d = with_pos(li.where(F.col("l_quantity") > 1), ["l_suppkey"], ["l_orderkey"], n_blocks=1)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "l_shipdate" not in plan and "l_comment" not in plan
    assert "GreaterThan(l_quantity,1.0)" in plan  # filter pushed into the parquet scan
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_quantity:double>" in plan


def test_only_long_series_are_cut(spark, monkeypatch):
    import sigsieve.signal as S
    monkeypatch.setattr(S, "ROWS_PER_BLOCK", 100)
    df = _series(spark).union(spark.range(40).selectExpr("'short'", "id * 37", "if(id % 4 = 1, NULL, double(id))"))
    sig = make_signal(df, ["k"], ["t"], ["v"])
    blocks = {r["k"]: r["b"] for r in sig.df.groupBy("k").agg(F.countDistinct("_blk").alias("b")).collect()}
    assert blocks["short"] == 1 and blocks["a"] > 4 and blocks["b"] > 4
    got = X.impute(sig, "LOCF").df.select("k", "t", "pos", "v").toPandas().sort_values(["k", "t"])
    for k, g in df.toPandas().sort_values(["k", "t"]).groupby("k"):
        assert np.allclose(got[got.k == k]["v"].to_numpy(), g["v"].ffill().bfill().to_numpy())
        assert list(got[got.k == k]["pos"]) == list(range(1, len(g) + 1))
