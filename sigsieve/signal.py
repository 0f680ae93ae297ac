"""The engine's data model: a wide table of ordered, keyed, numeric channels.

One row = one sample.  ``keys`` name the series (file, participant, ...; empty
= the whole table is one series, as in the reference), ``order`` the unique
sample order inside a series, ``features`` the DOUBLE channels.  Missing is
SQL NULL only: NaN and +-inf become NULL when the signal is built.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.exprs import finite_or_null
from .operators.sequence import ROWS_PER_BLOCK, with_pos


@dataclass(frozen=True)
class Signal:
    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    features: tuple[str, ...]
    meta: dict = field(default_factory=dict, compare=False)
    #: Short series as blocks, with the steps that wait (``operators.blocks``); ``df`` runs them.
    plan: object = field(default=None, compare=False, repr=False)

    def with_df(self, df: DataFrame, features: Sequence[str] | None = None) -> "Signal":
        return replace(self, df=df, features=tuple(features) if features is not None else self.features, plan=None)

    @property
    def key_cols(self) -> list[str]:
        return list(self.keys)

    @property
    def n_series(self) -> int:
        return int(self.meta.get("n_series", 0)) or 1

    @property
    def group_bound(self) -> int:
        """Proven upper bound of rows of any per-(series, feature) table."""
        return (self.n_series + 1) * max(1, len(self.features))  # +1: a NULL key group

    @property
    def max_series_rows(self) -> int | None:
        return self.meta.get("max_series_rows")

    def materialize(self) -> "Signal":
        """Cut lineage: reliable checkpoint in the session's checkpoint folder.  Of a plan, only heavy steps are written."""
        if self.plan is not None:
            from .operators.blocks import settled
            return settled(self)
        from .session import materialize
        return self.with_df(materialize(self.df))

    def in_blocks(self) -> "Signal":
        """``materialize`` for rows that come series by series, as behind the window that numbers them: short series are
        written as blocks (``operators.blocks``)."""
        from .operators.blocks import in_blocks
        return in_blocks(self)

    def select_features(self, features: Sequence[str]) -> "Signal":
        return replace(self, features=tuple(features))

    def renamed(self, names: dict[str, str]) -> "Signal":
        """Channels under other names."""
        if self.plan is not None:
            from .operators.blocks import renamed
            return renamed(self, names)
        return self.with_df(self.df.withColumnsRenamed(names), [names.get(f, f) for f in self.features])

    def table(self) -> DataFrame:
        """User-facing table: keys, order, pos and all channels (engine columns dropped)."""
        eng = {"_blk", "_n"}
        return self.df.select(*[c for c in self.df.columns if c not in eng and not c.startswith("_")])


def make_signal(df: DataFrame, keys: Sequence[str], order: Sequence[str], features: Sequence[str],
                n_blocks: int | None = None, checkpoint: bool = True) -> Signal:
    """Build a signal: cast channels to DOUBLE, NaN/inf -> NULL, add pos/blocks.

    With ``checkpoint`` the positioned table is written once to the session's
    checkpoint folder: later stages start from a short plan, and a lost
    executor costs a re-read instead of a re-shuffle.
    """
    keys, order, features = list(keys), list(order), list(features)
    cols = []
    for c in df.columns:
        cols.append(finite_or_null(c).alias(c) if c in features else F.col(c))
    src = df.select(*cols)
    # one small job: rows, number of series (size bound of every per-series
    # statistics table, used for checked broadcasts) and the longest series
    # (chooses the exact-quantile path)
    per_series = src.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    if keys:
        row = per_series.agg(
            F.sum("c").alias("n"), F.count(F.lit(1)).alias("s"), F.max("c").alias("mx"),
            F.count_if(F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) > 0).alias("nulls")).first()
        if row["nulls"]:
            raise ValueError(f"series keys {keys} hold NULL; name or drop those rows first")
    else:
        row = src.agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("s"), F.count(F.lit(1)).alias("mx")).first()
    total, n_series, longest = int(row["n"] or 0), int(row["s"] or 0), int(row["mx"] or 0)
    long_series = None
    if n_blocks is None:
        # only series beyond one block are cut; there are fewer than rows / block of them
        n_blocks = 1 if longest <= ROWS_PER_BLOCK else -(-total // ROWS_PER_BLOCK)
        long_series = per_series.where(F.col("c") > ROWS_PER_BLOCK).select(*keys) if keys and n_blocks > 1 else None
    d = with_pos(src, keys, order, n_blocks, long_series, bound=total // ROWS_PER_BLOCK + 1)
    if checkpoint:
        from .session import materialize
        d = materialize(d)
    return Signal(d, tuple(keys), tuple(order), tuple(features), meta={"n_series": n_series, "n_rows": total, "max_series_rows": longest})
