"""Short series as blocks: a signal that is written once, and operators that wait.

Where no series is longer than ``short.SHORT_ROWS``, the rows behind the window that
numbers them come series by series, so whole series are cut out of the stream without
another shuffle.  About ``short.GROUP_ROWS`` rows are one block, a compressed Arrow
table in one binary cell.  Blocks are written once; they take a fraction of the rows'
place.

An operator on such a signal adds a ``Step`` (a NumPy function over all series of a
block) and writes nothing.  What reads the signal runs the steps block by block, without
a shuffle or a join by row.  Labelled unions are several lists of steps over the same
blocks; steps that lists share from the start are run once.  ``heavy`` steps (KNN, MICE)
are written at the next stage boundary, as blocks again.

A series that isn't whole in its block is an error, never a wrong result.  Long series
have no plan and take the operators' other ways.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import BROADCAST_ROW_LIMIT
from ..session import materialize
from ..signal import Signal
from . import short


class Step(NamedTuple):
    """``fn(cells, channels, features, *args)`` -> the channels that it sets."""
    fn: Callable
    feats: tuple[str, ...]
    args: tuple


@dataclass(frozen=True)
class Plan:
    """Blocks, and the steps of every variant: (label values, steps).  ``schema``: the rows; ``names``: (name, column of
    the blocks) where a channel was renamed."""
    blocks: DataFrame
    schema: T.StructType
    labels: tuple[str, ...] = ()
    variants: tuple[tuple[tuple, tuple[Step, ...]], ...] = (((), ()),)
    names: tuple[tuple[str, str], ...] = ()
    heavy: bool = False


class Channels(dict):
    """Channels by name; one that no step has set is read from the block, NULL as NaN."""

    def __init__(self, t: pa.Table, names: dict[str, str], known: dict | None = None):
        super().__init__(known or {})
        self.t, self.names = t, names

    def __missing__(self, name: str) -> np.ndarray:
        self[name] = self.t[self.names.get(name, name)].to_numpy().astype(float)
        return self[name]

    def but(self, new: dict[str, np.ndarray]) -> "Channels":
        return Channels(self.t, self.names, {**self, **new})


class Cells:
    """A block: whole series, one after the other, their rows by position."""

    def __init__(self, t: pa.Table, plan_names: Sequence[tuple[str, str]] = ()):
        self.t, self.names = t, dict(plan_names)
        self.pos = t["pos"].to_numpy()
        self.first = np.flatnonzero(self.pos == 1)
        self.n = len(self.first)
        self.size = np.diff(np.append(self.first, len(self.pos)))
        self.g = np.repeat(np.arange(self.n), self.size)
        whole = len(self.g) == len(self.pos) and (self.pos == np.arange(len(self.pos)) - self.first[self.g] + 1).all()
        if not whole or not (t["_n"].to_numpy()[self.first] == self.size).all():
            raise ValueError("a series isn't whole in its block")
        self.kept: dict = {}

    def once(self, name, x: np.ndarray, make):
        """make(), once for each name and array."""
        key = (name, id(x))
        if key not in self.kept:
            self.kept[key] = (x, make())  # the array is held, so its id stays its own
        return self.kept[key][1]

    def valid(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(series, value) of the valid cells."""
        def make():
            there = ~np.isnan(x)
            return (self.g, x) if there.all() else (self.g[there], x[there])
        return self.once("valid", x, make)

    def sorted(self, x: np.ndarray) -> short._Sorted:
        return self.once("sorted", x, lambda: short._Sorted(*self.valid(x), self.n))

    def moments(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return self.once("moments", x, lambda: short._moments(*self.valid(x), self.sorted(x)))

    def quantile(self, x: np.ndarray, p: float) -> np.ndarray:
        return self.once(("quantile", p), x, lambda: self.sorted(x).quantile(p))

    def mad(self, x: np.ndarray) -> np.ndarray:
        return self.once("mad", x, lambda: self.sorted(x).deviations(self.quantile(x, 0.5)).quantile(0.5))

    def variants(self, variants) -> Iterator[tuple[tuple, Channels]]:
        """(labels, channels) of every variant; what variants share from the start is run once."""
        known = {(): Channels(self.t, self.names)}
        for labels, steps in variants:
            at = next(i for i in range(len(steps), -1, -1) if steps[:i] in known)
            x = known[steps[:at]]
            for i in range(at, len(steps)):
                s = steps[i]
                with np.errstate(all="ignore"):
                    x = x.but(s.fn(self, x, s.feats, *s.args))
                known[steps[:i + 1]] = x
            yield labels, x

    def keys(self, keys: Sequence[str]) -> pa.Table:
        return self.t.select(list(keys)).take(pa.array(self.first))


# ---------------------------------------------------------------------------
# Rows to blocks and back
# ---------------------------------------------------------------------------
def whole_series(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows, cut where a series ends."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        while n >= rows:
            t = pa.Table.from_batches(held)
            ends = np.flatnonzero(t["pos"].to_numpy() == t["_n"].to_numpy()) + 1
            far = np.searchsorted(ends, rows)
            if far == len(ends):
                break  # the last series goes on
            yield t.slice(0, ends[far]).combine_chunks()
            rest = t.slice(ends[far])
            held, n = rest.to_batches(), rest.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _coded(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def tables(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    for b in batches:
        for cell in b.column(0):
            yield pa.ipc.open_stream(cell.as_buffer()).read_all()


def over_series(df: DataFrame, fn: Callable[[pa.Table], pa.Table], schema) -> DataFrame:
    """fn over tables of whole series.  The rows of df must come series by series, by ``pos``, as behind the window that made
    ``pos``; ``Cells`` refuses others."""
    rows = short.GROUP_ROWS

    def run(batches):
        for t in whole_series(batches, rows):
            yield from fn(t).to_batches()

    return df.mapInArrow(run, schema)


def _packed(df: DataFrame) -> DataFrame:
    def pack(t: pa.Table) -> pa.Table:
        Cells(t)  # whole, or an error
        return pa.table({"_block": pa.array([_coded(t)], pa.binary())})

    return over_series(df, pack, "_block binary")


#: Column of the blocks that isn't one of the rows: Spark's hash of HASH_SEED and the keys, one value a series.
SERIES_HASH, HASH_SEED = "_hk", 42


def in_blocks(sig: Signal) -> Signal:
    """A short signal whose rows come series by series, written as blocks; any other is written as rows."""
    if not short.is_short(sig) or "_blk" in sig.df.columns:
        return sig.materialize()
    rows = sig.df.withColumn(SERIES_HASH, F.xxhash64(F.lit(HASH_SEED), *sig.keys))
    return planned(sig, Plan(materialize(_packed(rows)), sig.df.schema))


def planned(sig: Signal, plan: Plan) -> Signal:
    return replace(sig, df=_rows(plan), plan=plan)


def _rows(plan: Plan) -> DataFrame:
    """The rows of all variants, those of a block together."""
    fields, variants, labels, names = plan.schema.fields, plan.variants, plan.labels, plan.names
    if not any(steps for _, steps in variants) and len(variants) == 1 and not labels:
        def plain(batches):
            for t in tables(batches):
                yield from table_of(Cells(t, names), Channels(t, dict(names)), fields, {}).to_batches()
        return plan.blocks.mapInArrow(plain, plan.schema)

    def run(batches):
        for t in tables(batches):
            cells = Cells(t, names)
            for values, x in cells.variants(variants):
                yield from table_of(cells, x, fields, dict(zip(labels, values))).to_batches()

    return plan.blocks.mapInArrow(run, plan.schema)


def table_of(cells: Cells, x: Channels, fields, labels: dict) -> pa.Table:
    columns = []
    for f in fields:
        if f.name in labels:
            columns.append(constant(labels[f.name], len(cells.pos)))
        elif f.name in x:
            columns.append(pa.array(x[f.name], from_pandas=True))
        else:
            columns.append(cells.t[cells.names.get(f.name, f.name)])
    return pa.table(columns, names=[f.name for f in fields])


def settled(sig: Signal) -> Signal:
    """The stage boundary: heavy steps are run and written as blocks; the others go on waiting."""
    return rewritten(sig) if sig.plan.heavy and not sig.plan.labels else sig


def rewritten(sig: Signal) -> Signal:
    """sig, which has no labels, with its steps run and written as blocks."""
    plan = sig.plan
    fields, (_, steps), names = plan.schema.fields, plan.variants[0], plan.names

    def run(batches):
        for t in tables(batches):
            cells = Cells(t, names)
            for _, x in cells.variants((((), steps),)):
                out = table_of(cells, x, fields, {})
                for c in t.column_names:  # what is beside the rows stays there
                    if c not in out.column_names and c not in dict(names).values():
                        out = out.append_column(c, t[c])
                yield pa.record_batch([pa.array([_coded(out.combine_chunks())], pa.binary())], ["_block"])

    return planned(sig, Plan(materialize(plan.blocks.mapInArrow(run, "_block binary")), plan.schema))


# ---------------------------------------------------------------------------
# What operators do to a plan
# ---------------------------------------------------------------------------
def then(sig: Signal, fn: Callable, *args, heavy: bool = False, extra: Sequence[str] = ()) -> Signal:
    """sig with one more step, ``extra``: channels that it adds to the rows."""
    step = Step(fn, tuple(sig.features), args)
    schema = sig.plan.schema
    for name in extra:
        schema = T.StructType([f for f in schema.fields if f.name != name] + [T.StructField(name, T.DoubleType())])
    variants = tuple((labels, (*steps, step)) for labels, steps in sig.plan.variants)
    return planned(sig, replace(sig.plan, variants=variants, schema=schema, heavy=sig.plan.heavy or heavy))


def shared(*sigs: Signal) -> bool:
    """Whether the signals have plans over the same blocks, with the same columns under the same names."""
    plans = [s.plan for s in sigs]
    return all(p is not None and p.blocks is plans[0].blocks and p.names == plans[0].names for p in plans)


def union(parts: Sequence[tuple[dict, Signal]], meta: dict) -> Signal | None:
    """The labelled union as a plan; None where the parts don't share their blocks."""
    first = parts[0][1]
    if not shared(*(s for _, s in parts)) or any(s.plan.schema != first.plan.schema for _, s in parts):
        return None
    new = list(parts[0][0])
    variants = tuple(((*lab.values(), *values), steps) for lab, s in parts for values, steps in s.plan.variants)
    plan = replace(first.plan, labels=(*new, *first.plan.labels), variants=variants, heavy=any(s.plan.heavy for _, s in parts),
                   schema=T.StructType([*[_field(k, parts[0][0][k]) for k in new], *first.plan.schema.fields]))
    return planned(Signal(first.df, tuple(first.keys) + tuple(new), first.order, first.features, meta), plan)


def constant(value, n: int) -> pa.Array:
    """value n times, in the type that Spark's ``lit`` gives it."""
    kinds = {bool: pa.bool_(), int: pa.int32(), float: pa.float64(), str: pa.string()}
    return pa.repeat(pa.scalar(value, kinds[type(value)]), n)


def _field(name: str, value) -> T.StructField:
    kinds = {bool: T.BooleanType(), int: T.IntegerType(), float: T.DoubleType(), str: T.StringType()}
    return T.StructField(name, kinds[type(value)], False)


def where_label(sig: Signal, name: str, value) -> Signal:
    """The variants of a labelled union that have this label."""
    at = sig.plan.labels.index(name)
    return planned(sig, replace(sig.plan, variants=tuple(v for v in sig.plan.variants if v[0][at] == value)))


def joined(parts: Sequence[Signal]) -> Signal:
    """Parts of one labelled union put together again."""
    return planned(parts[0], replace(parts[0].plan, variants=tuple(v for p in parts for v in p.plan.variants), heavy=any(p.plan.heavy for p in parts)))


def renamed(sig: Signal, names: dict[str, str]) -> Signal:
    """sig, on which no step waits, with columns renamed."""
    plan = sig.plan
    assert not any(steps for _, steps in plan.variants)
    old = dict(plan.names)
    fields = [T.StructField(names.get(f.name, f.name), f.dataType, f.nullable) for f in plan.schema.fields]
    plan = replace(plan, schema=T.StructType(fields), names=tuple((new, old.get(was, was)) for was, new in names.items()))
    return planned(replace(sig, features=tuple(names.get(f, f) for f in sig.features)), plan)


def attached(sig: Signal, stats: DataFrame) -> Signal | None:
    """sig with the columns of ``stats`` (a row per series) in its blocks, for its steps; None where stats are too many to be
    broadcast, as another join parts the rows of a series."""
    if sig.n_series + 1 > BROADCAST_ROW_LIMIT or len(sig.plan.variants) > 1:
        return None
    rows = sig.df.join(F.broadcast(stats), on=list(sig.keys), how="left").select(*sig.df.columns, *[c for c in stats.columns if c not in sig.keys])
    rows = rows.withColumn(SERIES_HASH, F.xxhash64(F.lit(HASH_SEED), *sig.keys))
    return planned(sig, Plan(_packed(rows), sig.plan.schema, heavy=sig.plan.heavy))


def over_plan(sig: Signal, fn: Callable[["Cells", list], Iterable[pa.Table]], schema) -> DataFrame:
    """fn(cells, [(labels, channels), ...]) over all blocks."""
    variants, names = sig.plan.variants, sig.plan.names

    def run(batches):
        with np.errstate(all="ignore"):
            for t in tables(batches):
                cells = Cells(t, names)
                for out in fn(cells, list(cells.variants(variants))):
                    yield from out.to_batches()

    return sig.plan.blocks.mapInArrow(run, schema)


def of_series(cells: Cells, column: str) -> list:
    """A column's value in every series, where it is the same in all its rows."""
    return cells.t[column].take(pa.array(cells.first)).to_pylist()


def sides(sig: Signal, others: dict[str, Signal]) -> list:
    """(name, steps) of signals over the same blocks: variants that ``over_plan`` reads together."""
    return [((name,), s.plan.variants[0][1]) for name, s in {"": sig, **others}.items()]


def paired(left: Signal, right: Signal, on: Sequence[str], columns: dict[str, tuple[str, str]], outer: bool = False,
           backward: bool = False) -> DataFrame:
    """The equality join of two signals over the same blocks on the columns ``on`` (the order and keys, so that equal rows
    follow each other), row by row of the blocks.  ``columns``: name -> (side, column), side "l" or "r"; with ``outer`` every
    left row is kept, and a column of the right is the left one's value where there is no right row; ``backward``: the last row
    of a block comes first."""
    kinds = {f.name: f for f in left.plan.schema.fields}
    sig = planned(left, replace(left.plan, labels=("_side",), variants=tuple(sides(left, {"r": right}))))
    schema = T.StructType([T.StructField(n, kinds[c].dataType if c in kinds else T.DoubleType()) for n, (_, c) in columns.items()])

    def join(cells, variants):
        at, to = (v[::-1] if backward else v for v in tuples(cells, on, 2, outer))
        x = {"l": variants[0][1], "r": variants[1][1]}
        out, whole = [], None
        for f, (side, c) in zip(schema.fields, columns.values()):
            if isinstance(f.dataType, T.DoubleType):
                v = x[side][c][at if side == "l" else np.maximum(to, 0)]
                out.append(pa.array(v if side == "l" or not outer else np.where(to >= 0, v, x["l"][c][at]), from_pandas=True))
            else:
                whole = pa.array(at) if whole is None else whole
                out.append(cells.t[cells.names.get(c, c)].take(whole))
        yield pa.table(out, names=list(columns))

    return over_plan(sig, join, schema)


def with_keys(cells: Cells, sig_keys: Sequence[str], labels: dict) -> pa.Table:
    """A row per series: the signal's keys, labels among them."""
    base = cells.keys([k for k in sig_keys if k not in labels])
    columns = [constant(labels[k], cells.n) if k in labels else base[k] for k in sig_keys]
    return pa.table(columns, names=list(sig_keys))


# ---------------------------------------------------------------------------
# Steps
# ---------------------------------------------------------------------------
def neighbours(cells: Cells, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the gaps of x: (rows, the valid row before and the one after in the series or -1)."""
    def make():
        there = ~np.isnan(x)
        at = np.arange(len(x))
        gaps = np.flatnonzero(~there)
        before = np.maximum.accumulate(np.where(there, at, -1))[gaps]
        after = np.minimum.accumulate(np.where(there, at, len(x))[::-1])[::-1][gaps]
        start = cells.first[cells.g[gaps]]
        end = start + cells.size[cells.g[gaps]]
        return gaps, np.where(before >= start, before, -1), np.where(after < end, after, -1)
    return cells.once("neighbours", x, make)


def fill(cells: Cells, x: Channels, feats, method: str, variant: str) -> dict:
    """``transform.fill_expr`` over whole series."""
    out = {}
    for f in feats:
        v = x[f]
        gaps, before, after = neighbours(cells, v)
        if not len(gaps):
            continue
        v0, v1 = np.where(before >= 0, v[before], np.nan), np.where(after >= 0, v[after], np.nan)
        mean = cells.moments(v)["_mean"][cells.g[gaps]] if method == "Mean Imputation" or variant == "ev" else None
        if method == "Mean Imputation":
            new = mean
        elif method == "LOCF":
            new = v0 if variant == "v1" else np.where(np.isnan(v0), v1, v0)
        elif method == "Linear Interpolation":
            p0, p1 = cells.pos[before], cells.pos[after]
            new = np.where((before >= 0) & (after >= 0), v0 + (v1 - v0) * (cells.pos[gaps] - p0) / np.where(p1 == p0, 1, p1 - p0), v0)
            if variant != "v1":  # there a leading gap stays empty
                new = np.where(np.isnan(new), v1, new)
        else:
            raise ValueError(method)
        if variant == "ev" and method != "Mean Imputation":
            new = np.where(np.isnan(new), mean, new)
        if variant == "v2" and method == "Linear Interpolation":
            new = np.where(np.isnan(new), 0.0, new)
        y = v.copy()
        y[gaps] = new
        out[f] = y
    return out


def close(cells: Cells, x: Channels, feats) -> dict:
    """``smooth.close_gaps``: as a linear fill, but a channel without any value stays empty."""
    return fill(cells, x, feats, "Linear Interpolation", "close")


def odd(cells: Cells, v: np.ndarray, method: str, z_thresh, iqr_factor, mad_thresh, variant: str) -> np.ndarray:
    """``transform.outlier_expr`` over whole series; a threshold is a number or one per series."""
    g, per = cells.g, lambda a: a[cells.g] if isinstance(a, np.ndarray) else a
    m = cells.moments(v)["_m"]
    enough = m >= {"ev": 5, "v1": 1}.get(variant, 4 if method in ("IQR", "MAD") else 0)
    if method == "Z-Score":
        st = cells.moments(v)
        sd = st["_sdp"] * np.sqrt(m / cells.size) if variant == "v1" else st["_sd"]
        return (enough & (sd > 0))[g] & (np.abs((v - st["_mean"][g]) / sd[g]) > per(z_thresh))
    if method == "IQR":
        q1, q3 = cells.quantile(v, 0.25), cells.quantile(v, 0.75)
        iqr = q3 - q1
        guard = enough if variant == "v1" else enough & (iqr > 0)
        k = iqr_factor
        return guard[g] & ((v < (q1 - k * iqr)[g]) | (v > (q3 + k * iqr)[g]))
    if method != "MAD":
        raise ValueError(method)
    med, mad = cells.quantile(v, 0.5), cells.mad(v)
    if variant in ("v1", "ev"):
        guard = enough if variant == "v1" else enough & (mad > 0)
        return guard[g] & (np.abs(v - med[g]) > (3 * mad)[g])
    return (enough & (mad > 0))[g] & (np.abs(0.6745 * (v - med[g]) / mad[g]) > per(mad_thresh))


def mask(cells: Cells, x: Channels, feats, method: str, z_thresh: float, iqr_factor: float, mad_thresh: float, variant: str) -> dict:
    out = {}
    with np.errstate(all="ignore"):
        for f in feats:
            bad = odd(cells, x[f], method, z_thresh, iqr_factor, mad_thresh, variant)
            if bad.any():
                out[f] = np.where(bad, np.nan, x[f])
    return out


def winsor(cells: Cells, x: Channels, feats, q: float) -> dict:
    out = {}
    for f in feats:
        lo, hi = cells.quantile(x[f], q)[cells.g], cells.quantile(x[f], 1 - q)[cells.g]
        y = np.where(x[f] < lo, lo, x[f])
        out[f] = np.where(y > hi, hi, y)
    return out


def clip(cells: Cells, x: Channels, feats, lo: float | None, hi: float | None) -> dict:
    out = {}
    for f in feats:
        y = x[f] if lo is None else np.where(x[f] < lo, lo, x[f])
        out[f] = y if hi is None else np.where(y > hi, hi, y)
    return out


def fill_middle(cells: Cells, x: Channels, feats, variant: str) -> dict:
    """Gaps set as before scaling: the median (ev: the mean), 0 without any value."""
    out = {}
    for f in feats:
        gaps = np.isnan(x[f])
        if gaps.any():
            mid = cells.moments(x[f])["_mean"] if variant == "ev" else cells.quantile(x[f], 0.5)
            out[f] = np.where(gaps, np.where(np.isnan(mid), 0.0, mid)[cells.g], x[f])
    return out


def scaled(cells: Cells, v: np.ndarray, method: str) -> np.ndarray:
    """``transform.scale_expr`` over whole series."""
    if method == "StandardScaler":
        st = cells.moments(v)
        mid, unit = st["_mean"], st["_sdp"]
    elif method == "RobustScaler":
        mid, unit = cells.quantile(v, 0.5), cells.quantile(v, 0.75) - cells.quantile(v, 0.25)
    elif method == "MinMaxScaler":
        st = cells.moments(v)
        mid, unit = st["_min"], st["_max"] - st["_min"]
    else:
        raise ValueError(method)
    return (v - mid[cells.g]) / np.where(unit > 0, unit, 1.0)[cells.g]


def scale(cells: Cells, x: Channels, feats, method: str) -> dict:
    with np.errstate(all="ignore"):
        return {f: scaled(cells, x[f], method) for f in feats}


def knn(cells: Cells, x: Channels, feats, k: int) -> dict:
    if not any(np.isnan(x[f]).any() for f in feats):
        return {}
    with np.errstate(all="ignore"):
        y = np.column_stack([x[f] for f in feats])
        y = np.concatenate([short._nearest(part, k) for part in np.split(y, cells.first[1:])])
    return {f: np.ascontiguousarray(y[:, i]) for i, f in enumerate(feats)}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    return h ^ (h >> np.uint64(32))


def _turned(h: np.ndarray, bits: int) -> np.ndarray:
    return (h << np.uint64(bits)) | (h >> np.uint64(64 - bits))


def row_hashes(cells: Cells, i: int) -> np.ndarray:
    """Spark's ``xxhash64(HASH_SEED, *keys, i, pos)`` of every row."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = cells.t[SERIES_HASH].to_numpy()[cells.first].view(np.uint64) + p5 + np.uint64(4)
    h = _mixed(_turned(h ^ (np.uint64(i) * p1), 23) * p2 + p3)
    h = h[cells.g] + p5 + np.uint64(8)
    h = h ^ (_turned(cells.pos.astype(np.uint64) * p2, 31) * p1)
    return _mixed(_turned(h, 27) * p1 + p4).view(np.int64)


def keep(cells: Cells, x: Channels, feats, prefix: str) -> dict:
    """A copy of every channel, which later steps leave alone."""
    return {f"{prefix}{i}": x[f] for i, f in enumerate(feats)}


def reset(cells: Cells, x: Channels, feats, prefix: str) -> dict:
    """Every channel from the columns beside the rows."""
    return {f: x[f"{prefix}{i}"] for i, f in enumerate(feats)}


def tuples(cells: Cells, on: Sequence[str], width: int, outer: bool = False) -> tuple[np.ndarray, ...]:
    """Row numbers as an equality join of ``width`` copies of the block on the columns ``on`` pairs them: all tuples of rows
    with equal keys; none for a row with a NULL key, or, ``outer``, the row alone with -1 for the others.  Rows with equal keys
    must follow each other, as where ``on`` is the keys and the order."""
    n = len(cells.pos)
    same, null = np.ones(max(n - 1, 0), dtype=bool), np.zeros(n, dtype=bool)
    for c in on:
        v = cells.t[c].combine_chunks()
        if v.null_count:
            null |= v.is_null().to_numpy(zero_copy_only=False)
        same &= pc.fill_null(pc.equal(v[1:], v[:-1]), False).to_numpy(zero_copy_only=False)
    head = np.concatenate([[True], ~same]) if n else np.zeros(0, dtype=bool)
    start = np.flatnonzero(head)
    size = np.diff(np.append(start, n))
    parts = []
    for m in np.unique(size):
        at = start[size == m]
        at = at[~null[at]]
        grid = np.indices((m,) * width).reshape(width, -1)
        parts.append((at[None, :, None] + grid[:, None, :]).reshape(width, -1))
    if outer:
        alone = np.flatnonzero(null)
        parts.append(np.stack([alone, *[np.full(len(alone), -1)] * (width - 1)]))
    return tuple(np.concatenate(parts, axis=1)) if parts else tuple(np.zeros((width, 0), dtype=np.int64))
