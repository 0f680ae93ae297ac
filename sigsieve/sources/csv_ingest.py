"""CSV sources and text cleaning (IO1-IO5, T1-T8, T11, T12).

Typing is a two-step Spark job: one aggregate over every text column (how
many non-missing cells parse as numbers) decides the schema, one projection
applies it.  Name rules for the column catalogue are ``rlike`` expressions
on a small DataFrame of column names, not driver loops over data.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

# Cell texts that mean "missing" (matched after trimming).
MISSING_TOKENS = ("", " ", "NA", "N/A", "na", "n/a", "null", "NULL", "None", "none", "-", "--", "---", "?",
                  "nan", "NaN", "#VALUE!", "Inf", "-Inf", "infinity", "Infinity")
# Identifier-like column name patterns (case-insensitive).
ID_PATTERNS = (r"^Unnamed", r"^id$", r"participant", r"subject", r"trial", r"session", r"timestamp",
               r"recordingtime", r"export", r"^row$", r"^index$", r"^sample$", r"^sample_?id$", r"^frame$")
# Relevance words of the evaluation (exclude first, then include).
RELEVANCE_EXCLUDE = ("unnamed", "row", "index", "participant", "trial", "recordingtime", "export start",
                     "export end", "timestamp", "duration")
RELEVANCE_INCLUDE = ("gaze", "pupil", "fixation", "saccade", "distance", "point of regard", "eye position",
                     "pupil position", "vector")

NUMERIC_RE = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


#: Files that one task writes, about: a file costs its task more than its rows do, so tasks are dealt by files, not by bytes.
FILES_PER_TASK = 256


def by_file(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df dealt to tasks by the file (values of ``keys``) its rows go to, each file to one task, about ``FILES_PER_TASK`` to each."""
    files = df.select(*keys).distinct().count()
    return df.repartition(max(1, -(-files // FILES_PER_TASK)), *keys)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's (shared) checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def read_csv(spark: SparkSession, path: str | Sequence[str], sep: str = ",", encoding: str = "UTF-8",
             with_file: bool = False) -> DataFrame:
    """IO1/IO2/IO5: header CSV, every column as text; optional source file column."""
    df = (spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
          .option("inferSchema", False).option("mode", "PERMISSIVE").csv(path))
    if with_file:
        df = df.withColumn("file", F.col("_metadata.file_path"))
    return df


def is_missing_token(c) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return x.isNull() | F.trim(x).isin(*MISSING_TOKENS)


def clean_tokens(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing tokens -> NULL on the given text columns (others untouched)."""
    return df.select(*[F.when(is_missing_token(c), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def numeric_text(c, strip_units: bool = True, decimal_comma: bool = True) -> Column:
    """Text -> DOUBLE or NULL: trim, drop NBSP and spaces, ',' -> '.',
    drop a trailing unit after a digit, parse only plain decimal numbers."""
    x = F.col(c) if isinstance(c, str) else c
    s = F.regexp_replace(F.regexp_replace(F.trim(x), " ", ""), " ", "")
    if decimal_comma:
        s = F.regexp_replace(s, ",", ".")
    if strip_units:
        s = F.regexp_replace(s, r"(?<=\d)([a-zA-Z%]+)$", "")
    ok = s.rlike(NUMERIC_RE)
    return F.when(~is_missing_token(x) & ok, s.cast("double"))


def numeric_text_plain(c) -> Column:
    """Text -> DOUBLE or NULL: trim, ',' -> '.', "-", "", "nan" and "None" are missing; a blank or a unit inside
    leaves no number."""
    x = F.col(c) if isinstance(c, str) else c
    s = F.regexp_replace(F.trim(x), ",", ".")
    ok = s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(~s.isin("-", "", "nan", "None") & ok, s.cast("double"))


def coerce_numeric(df: DataFrame, threshold: float = 0.80, cols: Sequence[str] | None = None):
    """Convert a text column when >= threshold of its non-missing cells parse.
    Returns (typed DataFrame, decisions DataFrame)."""
    text_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)
                 and (cols is None or f.name in cols)]
    aggs = []
    for i, c in enumerate(text_cols):
        aggs += [F.count_if(~is_missing_token(c)).alias(f"_nm{i}"),
                 F.count(numeric_text(c)).alias(f"_np{i}")]
    row = df.agg(*aggs).first() if aggs else None
    convert, rows = [], []
    for i, c in enumerate(text_cols):
        nm, np_ = int(row[f"_nm{i}"]), int(row[f"_np{i}"])
        ratio = np_ / nm if nm else None
        conv = nm > 0 and ratio >= threshold
        rows.append((c, nm, np_, ratio, conv))
        if conv:
            convert.append(c)
    typed = df.select(*[numeric_text(c).alias(c) if c in convert else F.col(c) for c in df.columns])
    spark = df.sparkSession
    dec = spark.createDataFrame(rows, "column string, n_present long, n_numeric long, numeric_ratio double, "
                                      "converted boolean")
    return typed, dec


def column_catalogue(df: DataFrame, min_numeric_ratio: float = 0.15, min_observed: float = 0.02,
                     include_ids: bool = True) -> DataFrame:
    """T4-T8 (+T5, T6): one row per column with its typing and selection flags.

    Names that look like ids are only marked, unless ``include_ids`` is off.
    numeric_ratio uses all rows as denominator (T4); id_like by the pattern
    list (T6); relevant by the word lists (T7, with fall-back to every numeric
    column when none is relevant); eligible = numeric and an observed share of
    2 % or more (T8)."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        dt = df.schema[c].dataType
        num = F.col(c).cast("double") if isinstance(dt, T.NumericType) else numeric_text_plain(c)
        aggs += [F.count(num).alias(f"_p{i}")]
    r = df.agg(*aggs).first()
    n = int(r["_n"])
    spark = df.sparkSession
    rows = [(c, i, (int(r[f"_p{i}"]) / n) if n else 0.0) for i, c in enumerate(cols)]
    cat = spark.createDataFrame(rows, "column string, ordinal int, numeric_ratio double")
    idl = F.lit(False)
    for p in ID_PATTERNS:
        idl = idl | F.col("column").rlike("(?i)" + p)
    low = F.lower(F.col("column"))
    excl = F.lit(False)
    for w in RELEVANCE_EXCLUDE:
        excl = excl | F.contains(low, F.lit(w))
    incl = F.lit(False)
    for w in RELEVANCE_INCLUDE:
        incl = incl | F.contains(low, F.lit(w))
    cat = cat.withColumn("is_numeric", F.col("numeric_ratio") >= min_numeric_ratio) \
        .withColumn("id_like", idl).withColumn("relevant", ~excl & incl)
    any_rel = cat.where(F.col("is_numeric") & F.col("relevant")).count() > 0
    cand = F.col("is_numeric") & (F.col("relevant") if any_rel else F.lit(True)) & \
        (F.lit(True) if include_ids else ~F.col("id_like"))
    cat = cat.withColumn("candidate", cand)
    cat = cat.withColumn("observed_ok", F.col("numeric_ratio") >= min_observed)
    return cat.withColumn("eligible", F.col("candidate") & F.col("observed_ok"))


def write_dirty_events_csv(spark: SparkSession, sf_dir: str) -> str:
    """A messy CSV export derived from the events table (every row): decimal
    commas, units, padding, NBSP thousands and missing tokens by fixed rules
    on event_id.  Written once under the checkpoint folder."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "user_id", "value")
    v = F.col("value").cast("string")
    k = F.col("event_id") % 11
    txt = (F.when(k == 0, F.lit("NA")).when(k == 1, F.lit("-")).when(k == 2, F.lit(" "))
           .when(k == 3, F.regexp_replace(v, r"\.", ",")).when(k == 4, F.concat(v, F.lit("mm")))
           .when(k == 5, F.concat(v, F.lit("%"))).when(k == 6, F.concat(F.lit(" "), v, F.lit(" ")))
           .when(k == 7, F.lit("#VALUE!")).when(k == 8, F.lit("Inf")).otherwise(v))
    out = ev.select("event_id", "event_type", "user_id", txt.alias("value_txt"))
    path = scratch_path(spark, "dirty-events-csv")
    out.write.option("header", True).csv(path)
    return path


def write_cohort_csv_dirs(spark: SparkSession, sf_dir: str) -> str:
    """One CSV folder per recording (user) under two cohort directories, derived
    from the events table (cohort by user parity).  Written under the
    checkpoint folder."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    cohort = F.when(F.col("user_id") % 2 == 1, F.lit("cheating")).otherwise(F.lit("non_cheating"))
    path = scratch_path(spark, "cohort-csv")
    # a recording is written by one task, so the number of files doesn't grow with that of the tasks
    by_file(ev.withColumn("cohort", cohort), ["cohort", "user_id"]).write.partitionBy("cohort", "user_id").option("header", True).csv(path)
    return path


def write_recording_csv_dirs(spark: SparkSession, sf_dir: str) -> str:
    """One CSV folder per (event type, user), derived from every row of the events table."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "user_id", "event_id", "value")
    path = scratch_path(spark, "recordings-csv")
    by_file(ev, ["event_type", "user_id"]).write.partitionBy("event_type", "user_id").option("header", True).csv(path)
    return path


def write_mixed_files(spark: SparkSession, sf_dir: str) -> str:
    """One CSV file per recording (user) under two cohort directories, derived from every row of the events table, in
    five shapes by user: UTF-8 or Latin-1, comma or semicolon (with decimal commas), columns in different orders, a
    repeated name, a quoted note; every fifth file has one column only, which no dialect reads."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
    v = F.when(F.col("event_id") % 7 == 0, F.lit("-")).otherwise(F.col("value").cast("decimal(18,4)").cast("string"))
    half = (F.col("event_id") * 5).cast("decimal(18,1)").cast("string")
    size = F.col("event_id").cast("string")
    again = (F.col("event_id") + 1).cast("string")
    comma = lambda c: F.replace(c, F.lit("."), F.lit(","))
    shape = F.col("user_id") % 5
    headers = ["event_id,value,größe,value", "größe;event_id;value", 'event_id,größe,"a ""note""",value', "value;event_id;größe", "value"]
    row = (F.when(shape == 0, F.concat_ws(",", size, v, half, again))
           .when(shape == 1, F.concat_ws(";", comma(half), size, comma(v)))
           .when(shape == 2, F.concat_ws(",", size, half, F.lit('"x, ""y"""'), v))
           .when(shape == 3, F.concat_ws(";", comma(v), size, comma(half))).otherwise(v))
    head = F.element_at(F.array(*[F.lit(h) for h in headers]), (shape + 1).cast("int"))
    cohort = F.when(F.col("user_id") % 2 == 1, F.lit("cheating")).otherwise(F.lit("non_cheating"))
    lines = ev.select("user_id", "event_id", row.alias("text")).unionByName(
        ev.select("user_id").distinct().select("user_id", F.lit(None).cast("bigint").alias("event_id"), head.alias("text")))
    raw = F.when(shape.isin(2, 3), F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    path = scratch_path(spark, "mixed-csv")
    out = lines.select(cohort.alias("cohort"), F.col("user_id").alias("rec"), "event_id", raw.cast("string").alias("text"))
    out = by_file(out, ["cohort", "rec"]).sortWithinPartitions("cohort", "rec", F.asc_nulls_first("event_id"))
    out.select("cohort", "rec", "text").write.partitionBy("cohort", "rec").text(path)
    return path
