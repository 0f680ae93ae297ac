"""Sinks (IO6-IO9): processed table, pipeline definition, quality report,
evaluation tables.  Every writer takes an explicit output path (a shared
location on a cluster); the builders return DataFrames so callers can also
inspect them."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import blocks as B
from ..operators.evaluate import before_after
from ..operators.recommend import DOMAINS
from ..signal import Signal


def processed_table(original: DataFrame | Signal, processed: Signal, on, columns=None) -> DataFrame:
    """IO6: all original columns, the selected channels replaced (join on key).  A row that was processed takes the
    processed value also where that is NULL; a row that wasn't keeps its own.  ``original`` may be a signal over the blocks of
    ``processed``, of which ``columns`` are taken and ``on`` are the keys and the order: then they are joined inside the blocks."""
    on = list(on)
    if isinstance(original, Signal):
        return B.paired(original, processed, on, {c: ("r" if c in processed.features else "l", c) for c in columns}, outer=True)
    repl = processed.df.select(*on, F.lit(True).alias("_hit"), *[F.col(f).alias(f"_new_{f}") for f in processed.features])
    j = original.join(repl, on=on, how="left")
    return j.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in processed.features else F.col(c)
                      for c in original.columns])


def pipeline_definition(rec: DataFrame, keys, settings, domain: str) -> DataFrame:
    """IO7: one row per (series, feature): methods, settings and domain as JSON."""
    s = asdict(settings)
    st = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in s.items()]))
    return rec.select(*keys, "feature", F.to_json(F.struct(
        F.col("missing_method"), F.col("outlier_method"), F.col("normalization_method"), F.col("smoothing_method"),
        F.lit(domain).alias("domain"))).alias("pipeline"), st.alias("settings"))


def quality_report(before: DataFrame, after: DataFrame, keys, domain: str) -> DataFrame:
    """IO8: one report row per series: before/after profiles and their comparison.
    Each series gathers one struct per feature (bounded by the feature count)."""
    keys = list(keys)
    b = before.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*before.columns))).alias("before_profile"))
    a = after.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*after.columns))).alias("after_profile"))
    j = b.join(a, on=keys, how="inner")
    return j.select(*keys, F.lit(domain).alias("domain"),
                    F.to_json(F.struct("before_profile", "after_profile")).alias("report"))


def full_report(before: DataFrame, after: DataFrame, rec: DataFrame, keys, domain: str, settings) -> DataFrame:
    """IO8 whole: one row per series with domain, domain profile, pipeline (methods of every feature, and the settings),
    before and after profiles and their comparison, as nested columns.  A series gathers one struct per feature."""
    keys = list(keys)
    d = DOMAINS[domain]
    names = ("completeness", "continuity", "plausibility", "distribution", "stability", "correlation")
    texts = lambda v: F.array(*[F.lit(x) for x in v])
    profile = F.struct(F.struct(*[F.lit(w).alias(n) for n, w in zip(names, d["weights"])]).alias("weights"), texts(d["mv"]).alias("missing_priority"),
                       texts(d["out"]).alias("outlier_priority"), texts(d["norm"]).alias("normalization_priority"), F.lit(d["smooth"]).alias("smoothing"))

    def gathered(df: DataFrame, name: str) -> DataFrame:
        inner = [c for c in df.columns if c not in keys]
        first = ["feature", *[c for c in inner if c != "feature"]]
        return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*first))).alias(name))

    methods = rec.select(*keys, "feature", "missing_method", "outlier_method", "normalization_method", "smoothing_method")
    j = gathered(before, "before_profile").join(gathered(after, "after_profile"), keys)
    j = j.join(gathered(methods, "methods"), keys, "left").join(gathered(before_after(before, after, keys), "comparison"), keys)
    stored = F.struct(*[F.lit(v).alias(k) for k, v in asdict(settings).items()])
    return j.select(*keys, F.lit(domain).alias("domain"), profile.alias("domain_profile"), F.struct("methods", stored.alias("settings")).alias("pipeline"),
                    "before_profile", "after_profile", "comparison")


def read_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A report that ``write_json`` wrote, with the schema of ``full_report``."""
    return spark.read.schema(schema).json(path)


def write_evaluation(tables: dict[str, DataFrame], path: str) -> str:
    """IO9: all tables as header CSV, or none: they go into a folder of this run, and a manifest that names it is written
    last.  A run that fails leaves the tables of the run before as they were.  Returns the run's name."""
    spark = next(iter(tables.values())).sparkSession
    run = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    rows = []
    for name, df in tables.items():
        df.write.option("header", True).csv(f"{path}/runs/{run}/{name}")
        rows.append((run, name, df.schema.json()))
    spark.createDataFrame(rows, "run string, name string, columns string").coalesce(1).write.json(f"{path}/manifests/{run}")
    return run


def read_evaluation(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the last complete run, by name."""
    manifests = spark.read.schema("run string, name string, columns string").json(f"{path}/manifests/*")
    last = manifests.agg(F.max("run").alias("run"))
    rows = manifests.join(F.broadcast(last), "run").collect()  # one row per table
    schema = lambda r: T.StructType.fromJson(json.loads(r.columns))
    return {r.name: spark.read.schema(schema(r)).option("header", True).csv(f"{path}/runs/{r.run}/{r.name}") for r in rows}


def write_csv(df: DataFrame, path: str) -> None:
    """IO9 (and IO6): header CSV."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """IO7/IO8: JSON lines."""
    df.write.mode("overwrite").json(path)
