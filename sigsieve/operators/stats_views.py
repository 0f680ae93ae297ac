"""Descriptive views of a signal: histograms and evenly spaced samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import attach
from ..signal import Signal


def histogram(sig: Signal, bins: int = 60, by_series: bool = False) -> DataFrame:
    """Equal-width histogram per feature (and series) over [min, max]; the
    maximum falls in the last bin.  Output: [keys], feature, bin, lo, hi, count."""
    keys = list(sig.keys) if by_series else []
    structs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in sig.features]
    lng = sig.df.select(*keys, F.inline(F.array(*structs))).where(F.col("x").isNotNull())
    by = keys + ["feature"]
    mm = lng.groupBy(*by).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    j = attach(lng, mm, by, how="inner", bound=(sig.n_series + 1) * len(sig.features))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(F.col("_hi") > F.col("_lo"),
               F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)))\
        .otherwise(F.lit(0)).cast("long")
    h = j.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.first("_lo").alias("_lo"),
                                            F.first("_hi").alias("_hi"))
    w = (F.col("_hi") - F.col("_lo")) / bins
    return h.select(*by, "bin", (F.col("_lo") + F.col("bin") * w).alias("lo"),
                    (F.col("_lo") + (F.col("bin") + 1) * w).alias("hi"), "count")


def even_sample(sig: Signal, max_n: int, valid_cols=None) -> DataFrame:
    """Keep ``max_n`` evenly spaced rows per series (positions
    floor(i*(m-1)/(max_n-1)), the last one exactly m-1), over the rows where
    all ``valid_cols`` are present.  Series with m <= max_n keep every row.
    The position table has at most max_n rows per series and is joined on
    (series, rank), so no series is gathered in one task."""
    from .sequence import carry_valid
    keys = list(sig.keys)
    cols = list(valid_cols or sig.features)
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    d = sig.df.withColumn("_ok", F.when(ok, F.lit(1.0)))
    d = carry_valid(d, keys, ["_ok"])
    rows = d.where(F.col("_ok").isNotNull()).select(*sig.df.columns, (F.col("_vr0") - 1).alias("_r"),
                                                     F.col("_m0").alias("_mv"))
    ser = rows.groupBy(*keys).agg(F.max("_mv").alias("_mv")) if keys else rows.agg(F.max("_mv").alias("_mv"))
    step = (F.col("_mv") - 1).cast("double") / F.lit(float(max_n - 1))
    picks = ser.where(F.col("_mv") > max_n).select(*keys, "_mv", F.explode(F.sequence(F.lit(0), F.lit(max_n - 1))).alias("_i"))
    picks = picks.select(*keys, F.when(F.col("_i") == max_n - 1, F.col("_mv") - 1)
                         .otherwise(F.floor(F.col("_i") * step)).cast("long").alias("_r"), F.lit(True).alias("_pick"))
    j = rows.join(picks, on=keys + ["_r"], how="left")
    keep = (F.col("_mv") <= max_n) | F.col("_pick").isNotNull()
    return j.where(keep).drop("_pick", "_mv").withColumnRenamed("_r", "sample_rank")
