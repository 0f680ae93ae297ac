"""Sinks: a nested report read back as it was, evaluation tables that are complete or those of the run before."""

import pytest
from pyspark.sql import functions as F

from sigsieve.operators import profile as P
from sigsieve.plans.pipeline import DEFAULT
from sigsieve.signal import make_signal
from sigsieve.sources import sinks as SK


def test_report_round_trip(spark, tmp_path):
    rows = [(s, i, float(i * i % 17) if i % 6 else None, float(i)) for s in "ab" for i in range(40)]
    sig = make_signal(spark.createDataFrame(rows, "s string, t long, x double, y double"), ["s"], ["t"], ["x", "y"])
    prof = P.profile(sig)
    rec = prof.where("s = 'a'").select("s", "feature", *[F.lit(m).alias(m) for m in ("missing_method", "outlier_method", "normalization_method", "smoothing_method")])
    report = SK.full_report(prof, prof, rec, ["s"], "Clinical / diagnostic pupil data", DEFAULT)
    SK.write_json(report, str(tmp_path / "r"))
    back = {r.s: r for r in SK.read_report(spark, str(tmp_path / "r"), report.schema).collect()}
    assert back == {r.s: r for r in report.collect()} and set(back) == {"a", "b"}
    a = back["a"]
    assert [c.feature for c in a.comparison] == [m.feature for m in a.pipeline.methods] == ["x", "y"] and a.pipeline.settings.z_thresh == 3.0
    assert a.domain_profile.outlier_priority[0] == "Z-Score" and a.before_profile[0].missing_rate > 0 and back["b"].pipeline.methods is None


def test_evaluation_tables_are_whole_or_absent(spark, tmp_path):
    path = str(tmp_path / "e")
    good = {n: spark.range(k).withColumn("v", F.col("id") / 2).withColumn("t", F.lit("x")) for n, k in (("a", 3), ("b", 0))}
    SK.write_evaluation(good, path)
    broken = {"a": spark.range(9), "b": spark.range(5).select(F.raise_error(F.lit("no")).cast("long").alias("id"))}
    with pytest.raises(Exception, match="no"):
        SK.write_evaluation(broken, path)
    got = SK.read_evaluation(spark, path)
    assert {n: sorted(df.collect()) for n, df in got.items()} == {n: sorted(df.collect()) for n, df in good.items()}
    SK.write_evaluation({"a": spark.range(9)}, path)
    assert {n: df.count() for n, df in SK.read_evaluation(spark, path).items()} == {"a": 9}
    with pytest.raises(Exception, match="(?i)path.*not.*exist"):
        SK.read_evaluation(spark, str(tmp_path / "nothing"))
