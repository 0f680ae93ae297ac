"""Group statistics that stay distributed when one group is huge.

* ``attach``: join a per-group statistics table onto row data.  The table is
  broadcast only after its row count was checked against a limit; beyond it
  the join is a plain shuffle join (AQE's skew-join splits hot keys).
* ``exact_quantiles``: NumPy-linear quantiles per group, exact, without
  Spark's ``percentile`` (whose value->count map grows with one hot group).
  Pass 1 brackets every requested quantile with ``percentile_approx``; pass 2
  counts the rows below the bracket and ranks only the rows inside it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows a statistics table may have to be broadcast (checked by count()).
BROADCAST_ROW_LIMIT = 2_000_000
# Groups up to this many rows use Spark's exact ``percentile`` directly (its
# value->count map is bounded by the group size); larger groups use the
# bracket-and-refine path below.
DIRECT_PERCENTILE_ROWS = 2_000_000
# Relative rank error of the bracketing sketch; the exact pass ranks about
# 6/ACCURACY of a group's rows, so a group of 3e11 rows ranks 1.8e7 rows.
QUANTILE_ACCURACY = 100_000


def attach(big: DataFrame, stats: DataFrame, on: Sequence[str], how: str = "left",
           row_limit: int = BROADCAST_ROW_LIMIT, bound: int | None = None) -> DataFrame:
    """Join ``stats`` (one row per key) onto ``big``; broadcast only if small.

    ``bound`` is a proven upper limit of the rows of ``stats`` (e.g. series x
    features of a signal); without it the rows are counted first.
    """
    on = list(on)
    if not on:
        # one global statistics row (size 1): broadcast on a constant key
        one = F.lit(1).alias("_one")
        return big.select("*", one).join(F.broadcast(stats.select("*", one)), on="_one", how=how).drop("_one")
    if bound is None:
        stats = stats.persist()
        bound = stats.count()
    side = F.broadcast(stats) if bound <= row_limit else stats
    return big.join(side, on=on, how=how)


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float],
                    accuracy: int = QUANTILE_ACCURACY, bound: int | None = None,
                    max_group_rows: int | None = None) -> DataFrame:
    """Per-group quantiles (linear interpolation, as numpy.percentile).

    Returns ``by + list(probs)`` columns; groups with no non-null value give
    NULLs.  Deterministic and exact: the bracket only limits which rows are
    ranked, the values come from the rows themselves.
    """
    by = list(by)
    names = list(probs)
    if max_group_rows is not None and max_group_rows <= DIRECT_PERCENTILE_ROWS:
        pc = F.percentile(F.col(value).cast("double"), F.array(*[F.lit(probs[k]) for k in names]))
        g = df.where(F.col(value).isNotNull()).groupBy(*by).agg(pc.alias("_p"))
        return g.select(*by, *[F.col("_p")[i].alias(nm) for i, nm in enumerate(names)]).persist()
    margin = 3.0 / accuracy
    lo_p = [max(0.0, probs[k] - margin) for k in names]
    hi_p = [min(1.0, probs[k] + margin) for k in names]
    x = df.select(*by, F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull())

    # pass 1: group size and brackets
    pa = F.percentile_approx("_x", F.array(*[F.lit(p) for p in lo_p + hi_p]), accuracy)
    b = x.groupBy(*by).agg(F.count(F.lit(1)).alias("_m"), pa.alias("_b"))
    k = len(names)
    brk = b.select(
        *by, "_m",
        *[F.col("_b")[i].alias(f"_lo{i}") for i in range(k)],
        *[F.col("_b")[k + i].alias(f"_hi{i}") for i in range(k)],
    ).persist()
    xb = attach(x, brk, by, how="inner", bound=bound)

    # pass 2a: per bracket, rows below / inside and the nearest value on
    # each side (a sketch rank may sit one row off the interpolation pair)
    aggs = [F.first("_m").alias("_m")]
    for i in range(k):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        aggs += [F.count_if(F.col("_x") < lo).alias(f"_cb{i}"),
                 F.count_if((F.col("_x") >= lo) & (F.col("_x") <= hi)).alias(f"_ci{i}"),
                 F.max(F.when(F.col("_x") < lo, F.col("_x"))).alias(f"_pv{i}"),
                 F.min(F.when(F.col("_x") > hi, F.col("_x"))).alias(f"_nx{i}")]
    below = xb.groupBy(*by).agg(*aggs)
    # pass 2b: rows inside each bracket, ranked within (group, quantile)
    inside = F.filter(
        F.array(*[F.when((F.col("_x") >= F.col(f"_lo{i}")) & (F.col("_x") <= F.col(f"_hi{i}")), F.lit(i))
                  for i in range(k)]),
        lambda e: e.isNotNull(),
    )
    rows = xb.select(*by, "_x", F.explode(inside).alias("_q"))
    # equal values are counted before they meet in one window, so a channel of few values ranks few rows
    vals = rows.groupBy(*by, "_q", "_x").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by, "_q").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = vals.select(*by, "_q", "_x", F.sum("_c").over(w).alias("_r"), "_c")

    # target order statistics: t = p*(m-1); need v[floor(t)] and v[floor(t)+1]
    tg_structs = []
    for i, nm in enumerate(names):
        t = F.lit(probs[nm]) * (F.col("_m") - 1)
        tg_structs.append(F.struct(F.lit(i).alias("_q"), F.floor(t).cast("long").alias("_k"),
                                   (t - F.floor(t)).alias("_fr"), F.col(f"_cb{i}").alias("_cb"),
                                   F.col(f"_ci{i}").alias("_ci"), F.col(f"_pv{i}").alias("_pv"),
                                   F.col(f"_nx{i}").alias("_nx")))
    tg = below.select(*by, "_m", F.inline(F.array(*tg_structs))).persist()
    idx0 = F.col("_k") - F.col("_cb") + 1  # 1-based bracket index of v[k]
    j = ranked.join(tg.select(*by, "_q", "_k", "_cb"), on=by + ["_q"], how="inner")
    # a value takes the ranks (_r - _c, _r]
    at0, at1 = ((F.col("_r") >= i) & (F.col("_r") - F.col("_c") < i) for i in (idx0, idx0 + 1))
    inb = j.where(at0 | at1).groupBy(*by, "_q").agg(
        F.max(F.when(at0, F.col("_x"))).alias("_b0"), F.max(F.when(at1, F.col("_x"))).alias("_b1"))
    t2 = tg.join(inb, on=by + ["_q"], how="left")

    def pick(idx, inside_v):
        return (F.when((idx >= 1) & (idx <= F.col("_ci")), inside_v)
                .when(idx == 0, F.col("_pv"))
                .when(idx == F.col("_ci") + 1, F.col("_nx"))
                .otherwise(F.raise_error(F.lit("quantile bracket missed; raise accuracy")).cast("double")))

    v0 = pick(idx0, F.col("_b0"))
    v1 = pick(idx0 + 1, F.col("_b1"))
    val = F.when(F.col("_fr") == 0, v0).otherwise(v0 + F.col("_fr") * (v1 - v0))
    per_q = t2.select(*by, "_q", val.alias("_val"))
    wide = per_q.groupBy(*by).agg(*[F.max(F.when(F.col("_q") == i, F.col("_val"))).alias(nm)
                                    for i, nm in enumerate(names)]).persist()
    # keep groups that have values; groups without values are absent (caller left-joins)
    return wide


def feature_name_col(features: Sequence[str], idx: Column | str = "_f") -> Column:
    """Map feature index -> name with a literal array (features is a short list)."""
    i = F.col(idx) if isinstance(idx, str) else idx
    return F.element_at(F.array(*[F.lit(f) for f in features]), i + 1)
