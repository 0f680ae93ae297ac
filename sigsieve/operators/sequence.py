"""Order-dependent work without one task per long series: the block-carry kernel.

A series of up to ``ROWS_PER_BLOCK`` rows is one block: a window keyed by the
series, with no summary and no join.  A longer series (one may hold a third of
all rows) is cut by literal boundaries of the first order column
(``approxQuantile`` once over the long series, so a recompute after a lost
executor gives the same blocks); a row finds its block by binary search.  All
windows then run per ``(series, block)``; what crosses a block edge (row offset,
last/first valid value, valid count, prefix sum) comes from a per-block summary,
windowed over blocks and joined back on ``(series, block)``, the partitioning
the row data already has, so the big side is shuffled once.

Signals carry ``pos`` (1-based row position in its series), ``_n`` (series
length), ``_blk`` (block, only where a series was cut) and the user's columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import attach

ROWS_PER_BLOCK = 4_000_000
_UNB = Window.unboundedPreceding
_UNF = Window.unboundedFollowing


def _order_key(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(c).cast("timestamp")).cast("double")
    if isinstance(dt, T.DateType):
        return F.unix_date(F.col(c)).cast("double")
    if isinstance(dt, T.StringType):
        raise TypeError(f"first order column {c!r} must be numeric or temporal")
    return F.col(c).cast("double")


def block_splits(df: DataFrame, order_col: str, n_blocks: int) -> list[float]:
    """Literal block boundaries of the first order column (sorted, unique)."""
    if n_blocks <= 1:
        return []
    k = df.select(_order_key(df, order_col).alias("_k"))
    qs = k.approxQuantile("_k", [i / n_blocks for i in range(1, n_blocks)], 1.0 / (4 * n_blocks))
    return sorted({q for q in qs if q is not None and not math.isnan(q)})


def add_blocks(df: DataFrame, order_col: str, splits: Sequence[float], keys: Sequence[str],
               long_series: DataFrame | None = None, bound: int = 0) -> DataFrame:
    """Add ``_blk`` = number of boundaries <= the order key, by binary search in
    the JVM.  With ``long_series`` (one row per series to cut, at most ``bound``)
    all other series stay in block 0.  A NULL key sorts first, NaN last."""
    inf = float("inf")
    key = F.coalesce(_order_key(df, order_col), F.lit(-inf))
    cut = Bucketizer(splits=[-inf, *splits, inf], inputCol="_ok", outputCol="_blk", handleInvalid="keep")
    x = cut.transform(df.withColumn("_ok", key)).drop("_ok").withColumn("_blk", F.col("_blk").cast("int"))
    if long_series is None or not keys:
        return x
    flagged = attach(x, long_series.select(*keys, F.lit(True).alias("_long")), keys, how="left", bound=bound)
    return flagged.withColumn("_blk", F.when(F.col("_long"), F.col("_blk")).otherwise(0)).drop("_long")


def with_pos(df: DataFrame, keys: Sequence[str], order: Sequence[str], n_blocks: int = 1,
             long_series: DataFrame | None = None, bound: int = 0) -> DataFrame:
    """Add ``pos`` (1-based, dense per series), ``_n`` and, if series are cut, ``_blk``.

    ``order`` must be unique within a series (as in the reference, where row
    order is the file order).  ``n_blocks`` > 1 cuts the series named in
    ``long_series`` (all of them without it).
    """
    keys, order = list(keys), list(order)
    cut = df if long_series is None or not keys else attach(df, long_series, keys, how="left_semi", bound=bound)
    splits = block_splits(cut, order[0], n_blocks)
    if not splits:
        w = Window.partitionBy(*keys)
        return df.select("*", F.row_number().over(w.orderBy(*order)).cast("long").alias("pos"),
                         F.count(F.lit(1)).over(w).alias("_n"))
    x = add_blocks(df, order[0], splits, keys, long_series, bound)
    part = keys + ["_blk"]
    w = Window.partitionBy(*part).orderBy(*order)
    local = x.withColumn("_rn", F.row_number().over(w))
    summ = x.groupBy(*part).agg(F.count(F.lit(1)).alias("_cnt"))
    wb = Window.partitionBy(*keys).orderBy("_blk")
    summ = summ.select(
        *part,
        F.coalesce(F.sum("_cnt").over(wb.rowsBetween(_UNB, -1)), F.lit(0)).alias("_off"),
        F.sum("_cnt").over(wb.rowsBetween(_UNB, _UNF)).alias("_n"),
    )
    out = local.join(summ, on=part, how="inner")
    return out.withColumn("pos", (F.col("_rn") + F.col("_off")).cast("long")).drop("_rn", "_off")


def carry_valid(df: DataFrame, keys: Sequence[str], features: Sequence[str],
                prefix_sum: bool = False, centre: Sequence[str] | None = None) -> DataFrame:
    """Per row and feature i, add the state that crosses block edges.

    ``_pv{i}``  struct(p, v) of the last valid row strictly before this row
    ``_nv{i}``  struct(p, v) of the first valid row strictly after this row
    ``_vr{i}``  valid rows at or before this row (rank in the compacted series)
    ``_m{i}``   valid rows in the series
    ``_ps{i}``  (optional) prefix sum of valid values at or before this row, less the
                column ``centre[i]`` each, where given
    Needs ``pos`` and, where series were cut, ``_blk`` (see ``with_pos``).
    """
    keys = list(keys)
    blocked = "_blk" in df.columns
    part = keys + (["_blk"] if blocked else [])
    w = Window.partitionBy(*part).orderBy("pos")
    # "next valid" uses a descending order with an unbounded-preceding frame:
    # Spark re-aggregates unbounded-following frames per row (O(n^2)).
    wd = Window.partitionBy(*part).orderBy(F.col("pos").desc())
    w_prev, w_next, w_cum = w.rowsBetween(_UNB, -1), wd.rowsBetween(_UNB, -1), w.rowsBetween(_UNB, 0)

    def pv(c):
        return F.when(F.col(c).isNotNull(), F.struct(F.col("pos").alias("p"), F.col(c).cast("double").alias("v")))

    def summand(i, c):
        return F.col(c).cast("double") - F.col(centre[i]) if centre else F.col(c).cast("double")

    local_cols, summ_aggs = [], []
    for i, c in enumerate(features):
        local_cols += [F.last(pv(c), True).over(w_prev).alias(f"_lp{i}"),
                       F.last(pv(c), True).over(w_next).alias(f"_ln{i}"),
                       F.count(c).over(w_cum).alias(f"_lc{i}")]
        summ_aggs += [F.max(pv(c)).alias(f"_bl{i}"), F.min(pv(c)).alias(f"_bf{i}"), F.count(c).alias(f"_bc{i}")]
        if prefix_sum:
            local_cols.append(F.sum(summand(i, c)).over(w_cum).alias(f"_ls{i}"))
            summ_aggs.append(F.sum(summand(i, c)).alias(f"_bs{i}"))
    local = df.select("*", *local_cols)
    if not blocked:
        return _whole_series(local, keys, features, prefix_sum)
    summ = df.groupBy(*part).agg(*summ_aggs)
    wb = Window.partitionBy(*keys).orderBy("_blk")
    wbd = Window.partitionBy(*keys).orderBy(F.col("_blk").desc())
    bprev, bnext, ball = wb.rowsBetween(_UNB, -1), wbd.rowsBetween(_UNB, -1), wb.rowsBetween(_UNB, _UNF)
    carry_cols = []
    for i in range(len(features)):
        carry_cols += [F.last(f"_bl{i}", True).over(bprev).alias(f"_cp{i}"),
                       F.last(f"_bf{i}", True).over(bnext).alias(f"_cn{i}"),
                       F.coalesce(F.sum(f"_bc{i}").over(bprev), F.lit(0)).alias(f"_cc{i}"),
                       F.sum(f"_bc{i}").over(ball).alias(f"_m{i}")]
        if prefix_sum:
            carry_cols.append(F.coalesce(F.sum(f"_bs{i}").over(bprev), F.lit(0.0)).alias(f"_cs{i}"))
    carry = summ.select(*part, *carry_cols)
    j = local.join(carry, on=part, how="inner")
    out_cols = []
    drop = []
    for i in range(len(features)):
        out_cols += [F.coalesce(f"_lp{i}", f"_cp{i}").alias(f"_pv{i}"),
                     F.coalesce(f"_ln{i}", f"_cn{i}").alias(f"_nv{i}"),
                     (F.col(f"_lc{i}") + F.col(f"_cc{i}")).alias(f"_vr{i}")]
        drop += [f"_lp{i}", f"_cp{i}", f"_ln{i}", f"_cn{i}", f"_lc{i}", f"_cc{i}"]
        if prefix_sum:
            out_cols.append((F.coalesce(F.col(f"_ls{i}"), F.lit(0.0)) + F.col(f"_cs{i}")).alias(f"_ps{i}"))
            drop += [f"_ls{i}", f"_cs{i}"]
    return j.select("*", *out_cols).drop(*drop)


def _whole_series(local: DataFrame, keys: list[str], features: Sequence[str], prefix_sum: bool) -> DataFrame:
    """``carry_valid`` where a series is one block: the local state is all there is."""
    ws = Window.partitionBy(*keys)
    out, drop = [], []
    for i, c in enumerate(features):
        out += [F.col(f"_lp{i}").alias(f"_pv{i}"), F.col(f"_ln{i}").alias(f"_nv{i}"),
                F.col(f"_lc{i}").alias(f"_vr{i}"), F.count(c).over(ws).alias(f"_m{i}")]
        drop += [f"_lp{i}", f"_ln{i}", f"_lc{i}"]
        if prefix_sum:
            out.append(F.coalesce(F.col(f"_ls{i}"), F.lit(0.0)).alias(f"_ps{i}"))
            drop.append(f"_ls{i}")
    return local.select("*", *out).drop(*drop)


def halo_blocks(df: DataFrame, keys: Sequence[str], radius: int, block_rows: int = 1 << 17) -> DataFrame:
    """Deal a series into blocks of positions and copy the rows within ``radius``
    of an edge into the neighbouring block (``_hb`` = block of the copy, ``_own``
    marks the original).  Blocks are at least ``radius`` long, so one neighbour on
    each side is enough and every original sees its whole neighbourhood, whatever
    ``_blk`` is.  Needs ``pos`` (1, 2, ... in each series).
    """
    size = max(int(block_rows), int(radius), 1)
    blk = F.expr(f"div(pos - 1, {size})")
    at = (F.col("pos") - 1) % size
    targets = F.array(
        F.struct(blk.alias("b"), F.lit(True).alias("own")),
        F.when((at < radius) & (blk > 0), F.struct((blk - 1).alias("b"), F.lit(False).alias("own"))),
        F.when(size - 1 - at < radius, F.struct((blk + 1).alias("b"), F.lit(False).alias("own"))),
    )
    out = df.select("*", F.inline(F.filter(targets, lambda t: t.isNotNull())))
    return out.withColumnRenamed("b", "_hb").withColumnRenamed("own", "_own")
