"""Hard negatives by inner product: cover trees over norm-augmented candidates, best-first descent inside score windows.

Augmented by sqrt(M**2 - |x|**2), M the largest norm of a shard, all candidates have norm M, and an anchor q, augmented by
zero, has 2 q.x = |q|**2 + M**2 - d**2.  So a node's centre c and covering radius r bound every inner product below it:
d lies within r of |q - c|.  Candidates are dealt into shards by hash; each shard's cover tree is built once, written, and
read by both searches, past which all anchors stream in blocks:

1. positives: the best same-label candidates; nodes whose bound is below the k-th best found so far are skipped;
2. negatives: for each positive a window of scores; nodes whose bounds meet no window still open are skipped.

Nodes are taken best bound first, in batches that double, and leaves are verified by exact integer products.  A shard
reports its best `positives` or `negatives` only; the best of these over all shards are the result, so nothing is lost.
Nodes also carry which labels lie below them (the smallest, the largest, 64 bits by hash), so subtrees without a wanted
label are skipped.

Scores are exact: 64-bit products where sizes allow, Python integers beyond.  No shard or block grows with the table;
only their number does, and every anchor is held against every shard, as the task's query set demands.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, cut, out

#: Levels of a tree shrink the covering radius by this factor.
_SHRINK = 1.3


@dataclass
class CoverTree:
    """Points are permuted so that each node holds points[low:high]; points[low] is its centre.  Children of node v are
    the nodes child[v]:child[v + 1]; a node without children is a leaf."""

    low: np.ndarray
    high: np.ndarray
    child: np.ndarray
    radius: np.ndarray
    order: np.ndarray


def augmented(x: np.ndarray) -> np.ndarray:
    squares = (x**2).sum(axis=1)
    return np.column_stack([x, np.sqrt(np.maximum(squares.max(initial=0) - squares, 0))])


def _cover(x: np.ndarray, squares: np.ndarray, points: np.ndarray, radius: float) -> tuple[list[np.ndarray], list[float]]:
    """Groups of points, each within `radius` of its first one, which no earlier group holds; and their measured radii."""
    owner = np.full(len(points), -1)
    away = np.zeros(len(points))
    heads: list[int] = []
    while True:
        free = np.flatnonzero(owner < 0)[:256]
        if not len(free):
            break
        c = points[free]
        d = np.sqrt(np.maximum(squares[c][:, None] + squares[points][None] - 2 * x[c] @ x[points].T, 0))
        for row, head in zip(d, free.tolist(), strict=True):
            if owner[head] >= 0:
                continue
            mine = (owner < 0) & (row <= radius)
            mine[head] = True
            owner[mine] = len(heads)
            away[mine] = row[mine]
            away[head] = 0
            heads.append(head)
    order = np.argsort(owner, kind="stable")  # a head is the first free point, so it leads its group
    cuts = np.searchsorted(owner[order], np.arange(len(heads) + 1))
    return [points[order[a:b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], [float(away[order[a:b]].max()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def build(x: np.ndarray, leaf: int = 24) -> CoverTree:
    """x: augmented points.  A node at level k covers its points within R / 1.3**k; levels that would leave a node whole
    are skipped.  Points that rounding can't tell apart stay in one leaf."""
    squares = (x**2).sum(axis=1)
    slack = 1e-6 * (1 + float(np.sqrt(squares.max(initial=0))))  # far above rounding
    reach = float(np.sqrt(((x - x[:1]) ** 2).sum(axis=1)).max(initial=0))
    groups, radius, child = [np.arange(len(x))], [reach], []
    at = 0
    while at < len(groups):
        points, measured = groups[at], radius[at]
        child.append(len(groups))
        at += 1
        if len(points) <= leaf or measured <= slack:
            continue
        level = reach / _SHRINK ** (np.floor(np.log(reach / measured) / np.log(_SHRINK)) + 1)  # the largest below measured
        parts, radii = _cover(x, squares, points, level)
        if len(parts) > 1:
            groups += parts
            radius += radii
    child.append(len(groups))
    low, high, order = np.zeros(len(groups), np.int64), np.zeros(len(groups), np.int64), np.empty(len(x), np.int64)
    stack, placed = [0], 0
    while stack:  # depth first; a node's first child is led by the node's own centre
        v = stack.pop()
        low[v], high[v] = placed, placed + len(groups[v])
        if child[v] == child[v + 1]:
            order[placed : high[v]] = groups[v]
            placed = high[v]
        else:
            stack.extend(range(child[v + 1] - 1, child[v] - 1, -1))
    return CoverTree(low, high, np.array(child), np.array(radius) + slack, order)


def exact(x: np.ndarray, y: np.ndarray, top: float) -> np.ndarray:
    """Inner products of integer rows of x with the integer vector y; top: a bound of their sums' absolute values."""
    if top < 2.0**52:
        return (x @ y).astype(np.int64)  # every partial sum is an integer that a double holds
    if top < 2.0**62:
        return x.astype(np.int64) @ y.astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(r, y, strict=True)) for r in x]
    if any(abs(s) >= 1 << 63 for s in whole):
        raise OverflowError("a score does not fit in a long")
    return np.array(whole, np.int64)


class Shard:
    """Candidates of one shard in the order of their tree: integer components, ids and whether they are known, labels, row keys."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, known: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.tree = t = build(augmented(x))
        self.x, self.ids, self.known, self.labels, self.rows = (a[t.order] for a in (x, ids, known, labels, rows))
        bit = label_bit(self.labels)
        spans = list(zip(t.low.tolist(), t.high.tolist(), strict=True))
        self.bits = np.array([np.bitwise_or.reduce(bit[a:b]) for a, b in spans], np.uint64)
        self.least = np.array([self.labels[a:b].min() for a, b in spans])
        self.most = np.array([self.labels[a:b].max() for a, b in spans])
        self._prepare()

    def _prepare(self) -> None:
        self.points = augmented(self.x)
        self.norm2 = float((self.points**2).sum(axis=1).max(initial=0))
        self.top = float(np.abs(self.x).max(initial=0)) * self.x.shape[1]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("points", "norm2", "top")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._prepare()

    def bounds(self, q: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest inner product that a point below each node may have with q."""
        q2 = float(q @ q)
        away = np.append(q, 0.0)
        d = np.sqrt(((self.points[self.tree.low[nodes]] - away) ** 2).sum(axis=1))
        r = self.tree.radius[nodes] + 1e-9 * (np.sqrt(q2) + np.sqrt(self.norm2))
        slack = 1 + 1e-9 * (q2 + self.norm2)
        return (q2 + self.norm2 - (d + r) ** 2) / 2 - slack, (q2 + self.norm2 - np.maximum(d - r, 0) ** 2) / 2 + slack

    def descend(self, q: np.ndarray, wanted, floor, take) -> None:
        """Best bound first.  wanted(nodes, lowest, highest) keeps nodes; floor() is the bound below which nothing is of
        use any more; take(places, scores) gets the leaves' points."""
        t = self.tree
        front, best = np.array([0]), np.array([np.inf])
        batch = 4
        while len(front):
            if len(front) > batch:
                pick = np.argpartition(-best, batch - 1)
                front, best = front[pick], best[pick]
            now, front, top, best = front[:batch], front[batch:], best[:batch], best[batch:]
            now = now[top >= floor()]
            batch *= 2
            inner = t.child[now] < t.child[now + 1]
            leaves = now[~inner]
            if len(leaves):
                size = t.high[leaves] - t.low[leaves]
                places = np.arange(size.sum()) + np.repeat(t.low[leaves] - np.cumsum(size) + size, size)
                take(places, exact(self.x[places], q, self.top * float(np.abs(q).max())))
            now = now[inner]
            if len(now):
                size = t.child[now + 1] - t.child[now]
                nodes = np.arange(size.sum()) + np.repeat(t.child[now] - np.cumsum(size) + size, size)
                low, high = self.bounds(q, nodes)
                use = wanted(nodes, low, high)
                front, best = np.append(front, nodes[use]), np.append(best, high[use])
            alive = best >= floor()
            front, best = front[alive], best[alive]

    def first(self, places: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first k by score, then vec_id (unknown ids last), then row key."""
        if len(places) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            near = scores >= least
            places, scores = places[near], scores[near]
        order = np.lexsort((self.rows[places], self.ids[places], ~self.known[places], -scores))[:k]
        return places[order], scores[order]

    def positives(self, q: np.ndarray, vec_id: int, label: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        bit = label_bit(np.array([label]))[0]
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

        def take(places, scores):
            use = (self.labels[places] == label) & ~((self.ids[places] == vec_id) & self.known[places])
            held[:] = self.first(np.append(held[0], places[use]), np.append(held[1], scores[use]), k)

        def wanted(nodes, low, high):
            return ((self.bits[nodes] & bit) != 0) & (self.least[nodes] <= label) & (self.most[nodes] >= label)

        self.descend(q, wanted, lambda: held[1][-1] if len(held[0]) == k else -np.inf, take)
        return held[0], held[1]

    def negatives(self, q: np.ndarray, label: int, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        none = np.zeros(0, np.int64)
        held = [(none, none) for _ in windows]

        def floors() -> np.ndarray:
            return np.array([held[w][1][-1] if len(held[w][0]) == k else lo for w, (lo, _) in enumerate(windows)], float)

        def wanted(nodes, low, high):
            meets = (high[:, None] >= floors()) & (low[:, None] <= np.array([hi for _, hi in windows], float))
            return meets.any(axis=1) & ((self.least[nodes] != label) | (self.most[nodes] != label))

        def take(places, scores):
            use = self.labels[places] != label
            places, scores = places[use], scores[use]
            for w, (lo, hi) in enumerate(windows):
                fits = (scores >= lo) & (scores <= hi)
                if fits.any():
                    held[w] = self.first(np.append(held[w][0], places[fits]), np.append(held[w][1], scores[fits]), k)

        self.descend(q, wanted, lambda: floors().min(), take)
        return held


def label_bit(labels: np.ndarray) -> np.ndarray:
    mixed = (labels.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)
    return np.left_shift(np.uint64(1), mixed)


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist()), np.float64).reshape(-1, dim)


def _packed(rows: DataFrame) -> DataFrame:
    """vector as binary, so that it travels and sorts as one value."""
    schema = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("vector", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [np.asarray(x.values, np.float64).tobytes() for x in column(b, "e")]
            if not np.isfinite(np.frombuffer(b"".join(v))).all():
                raise OverflowError("a scaled component is beyond a double")
            yield out(schema, [column(b, "row"), column(b, "vec_id"), column(b, "label"), [len(x) // 8 for x in v], v])

    return rows.mapInArrow(pack, "row bigint, vec_id bigint, label bigint, dim int, vector binary")


def _trees(rows: DataFrame, tasks: int) -> DataFrame:
    """(dim, shard, tree): one pickled Shard per shard."""
    schema = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("tree", pa.binary())])

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ids = t["vec_id"].combine_chunks()
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            shard = Shard(_matrix(t["vector"].combine_chunks(), now[0]), ids.fill_null(0).to_numpy(), known, t["label"].to_numpy(), t["row"].to_numpy())
            return out(schema, [[now[0]], [now[1]], [pickle.dumps(shard, protocol=5)]])

        for b in batches:
            dim, shard = column(b, "dim").to_numpy(), column(b, "shard").to_numpy()
            cuts = np.flatnonzero(np.append(True, (dim[1:] != dim[:-1]) | (shard[1:] != shard[:-1]))) if b.num_rows else []
            for a, z in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
                if now != (key := (int(dim[a]), int(shard[a]))) and held:
                    yield done()
                    held = []
                now = key
                held.append(b.slice(a, z - a))
        if held:
            yield done()

    return rows.repartition(tasks, "dim", "shard").sortWithinPartitions("dim", "shard", "row").mapInArrow(plant, "dim int, shard int, tree binary")


def _searched(trees: DataFrame, blocks: DataFrame, tasks: int, search, schema: pa.Schema, spec: str) -> DataFrame:
    """Every block of anchors past every tree of its dimension: search(shard, block's rows as dicts) yields rows."""
    dims = trees.groupBy("dim").agg(F.array_sort(F.collect_list("shard")).alias("_shards"))  # few rows: one per length of vectors
    asked = blocks.join(dims, "dim").select("dim", F.explode("_shards").alias("shard"), F.lit(None).cast("binary").alias("tree"), "anchors")
    kind = asked.schema["anchors"].dataType.simpleString()
    both = trees.select("dim", "shard", "tree", F.lit(None).cast(kind).alias("anchors")).unionAll(asked).withColumn("_side", F.col("tree").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for b in batches:
            for i in range(b.num_rows):
                tree = column(b, "tree")[i]
                if tree.is_valid:
                    shard = pickle.loads(tree.as_buffer())
                    continue
                found = [r for a in column(b, "anchors")[i].as_py() for r in search(shard, a)]
                if found:
                    yield out(schema, [list(c) for c in zip(*found, strict=True)])

    return both.repartition(tasks, "dim", "shard").sortWithinPartitions("dim", "shard", "_side").mapInArrow(run, spec)


def hard_negatives(vectors: DataFrame, is_anchor: str, positives: int = 5, negatives: int = 10, least_pct: int = 30, most_pct: int = 90, scale: float = 256.0,
                   shard_rows: int = 8192, block_rows: int = 512) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, embedding, label).

    Components become floor(scale * x); a score is the integer inner product of two rows, higher ones come first, ties by
    vec_id.  An anchor is a row for which the SQL predicate `is_anchor` holds.  Its positives are its first `positives`
    rows of the same label; for each, the first `negatives` rows of other labels with
    least_pct * positive_score <= 100 * negative_score <= most_pct * positive_score are ranked from 1.

    Rows with a null label, a null vector or any null or non-finite component take no part, nor does an empty vector.
    Repeated rows (same id, label and vector) count once; rows of the anchor's own vec_id are never its positives.  A null
    vec_id is no anchor and comes last among ties.  Vectors of different lengths aren't compared.  A score beyond a long
    is an error.  An empty table gives an empty result.  Only vec_id, embedding and label are read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), F.col("label").cast("bigint").alias("label"))
    good = "label is not null and size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    # floor() would make longs; a double keeps every integer it can hold, whatever its size; + 0 turns -0 into 0
    whole = F.expr(f"transform(e, x -> case when abs(x * {scale}D) < 4503599627370496D then cast(floor(x * {scale}D) as double) else x * {scale}D end + 0.0D)")
    rows = rows.where(f"coalesce({good}, false)").withColumn("e", whole)
    rows = rows.distinct().withColumn("row", F.xxhash64("vec_id", "label", "e"))
    rows = cut(_packed(rows))
    counts = {r.dim: r["count"] for r in rows.groupBy("dim").count().collect()}  # one row per length of vectors
    spec = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not counts:
        return spark.createDataFrame([], spec)
    # shards and blocks hold about as many bytes whatever the length of vectors
    per = {d: max(64, shard_rows * 64 // max(64, d)) for d in counts}
    shards = F.create_map(*[F.lit(x) for d, n in counts.items() for x in (d, -(-n // per[d]))])
    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(1)), shards[F.col("dim")]).cast("int"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(-(-n // per[d]) for d, n in counts.items()))
    trees = cut(_trees(sharded, tasks))
    anchors = rows.where(f"vec_id is not null and ({is_anchor})")
    n_anchors = anchors.count()
    block = F.pmod(F.xxhash64("row", F.lit(2)), F.lit(max(1, -(-n_anchors // block_rows)))).cast("int")
    hit = pa.schema([("anchor", pa.int64()), ("score", pa.int64()), ("id", pa.int64()), ("row", pa.int64())])
    hit_spec = "anchor bigint, score bigint, id bigint, row bigint"

    def blocked(df: DataFrame, *columns: str) -> DataFrame:
        return df.groupBy("dim", block.alias("_block")).agg(F.collect_list(F.struct("row", "vec_id", "label", "vector", *columns)).alias("anchors")).drop("_block")

    def same(shard: Shard, a: dict):
        places, scores = shard.positives(np.frombuffer(a["vector"]), a["vec_id"], a["label"], positives)
        return [(a["row"], int(s), int(shard.ids[p]) if shard.known[p] else None, int(shard.rows[p])) for p, s in zip(places, scores, strict=True)]

    ranked = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    best = _searched(trees, blocked(anchors), tasks, same, hit, hit_spec).withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") <= positives)
    best = cut(best)

    # windows of integers: ceil(least * p / 100) to floor(most * p / 100); a negative score's window is empty
    asked = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("_n", "score"))).alias("asked"))
    asking = anchors.join(asked.withColumnRenamed("anchor", "row"), "row")
    far = pa.schema([("anchor", pa.int64()), ("_n", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("row", pa.int64())])

    def other(shard: Shard, a: dict):
        windows = [(x["_n"], -(-least_pct * x["score"] // 100), most_pct * x["score"] // 100) for x in a["asked"]]
        windows = [w for w in windows if w[1] <= w[2]]
        if not windows:
            return []
        found = shard.negatives(np.frombuffer(a["vector"]), a["label"], [w[1:] for w in windows], negatives)
        return [(a["row"], w[0], int(s), int(shard.ids[p]) if shard.known[p] else None, int(shard.rows[p])) for w, (places, scores) in zip(windows, found, strict=True) for p, s in zip(places, scores, strict=True)]

    ranked = Window.partitionBy("anchor", "_n").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    worst = _searched(trees, blocked(asking, "asked"), tasks, other, far, "anchor bigint, _n int, score bigint, id bigint, row bigint")
    worst = worst.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives)
    worst = worst.select("anchor", "_n", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    first = best.select("anchor", "_n", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return worst.join(first, ["anchor", "_n"]).join(named, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
