"""Embedding near-duplicates by product quantisation.

Coarse inverted lists (k-means on the unit sphere), residuals coded in subspaces, asymmetric table-lookup distances over
the probed lists, exact cosine rerank.  Both codebooks are fitted on the driver on a sample of at most `sample_rows`
vectors; every vector is indexed and is a query.

* Probes.  Two vectors in different lists lie on both sides of the bisector between the centroids, so their distances to
  it sum to at most their own distance, and one of them is within half of that.  A query probes each list whose bisector
  is at most `reach`, half the threshold's distance, away.  A link is found if either of its vectors probes the other's
  list, so none is lost, however the vectors are spread.
* Table lookup.  A vector's distance to its code is stored, so "lookup distance <= threshold distance + that" drops no
  link that was probed.  Survivors are compared by cosine in double precision: no link below the threshold is reported.
* Hot lists.  A list is dealt into blocks of at most `block_rows`; queries stream past each block.  A task reports, for
  each vector, how many it links with, and a spanning forest of the links, never the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, out, release
from .components import components


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray  # (lists, dim)
    books: np.ndarray  # (parts, codes, dim / parts)
    apart: np.ndarray  # (lists, lists): distances between centroids
    reach: float

    def pad(self, x: np.ndarray) -> np.ndarray:
        short = self.books.shape[0] * self.books.shape[2] - x.shape[1]
        return np.pad(x, ((0, 0), (0, short))) if short else x


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def _apart(centres: np.ndarray) -> np.ndarray:
    squares = (centres**2).sum(axis=1)
    return np.sqrt(np.maximum(squares[:, None] + squares[None] - 2 * centres @ centres.T, 0)) + 1e-7  # above rounding: never too short


def _bisectors(x: np.ndarray, index: Index, mine: np.ndarray) -> np.ndarray:
    """Distance of each unit vector to the bisector between its own centroid and every centroid (0 for its own)."""
    d = (index.centroids**2).sum(axis=1) - 2 * x @ index.centroids.T
    t = (d - d[np.arange(len(x)), mine][:, None]) / (2 * index.apart[mine])
    t[np.arange(len(x)), mine] = 0
    return t


def fit(sample: np.ndarray, n_rows: int, least: float, list_rows: int = 512, parts: int = 8, codes: int = 256, seed: int = 42) -> Index:
    """sample: unit vectors."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(n_rows // list_rows, len(sample) // 32))
    centroids = _kmeans(sample, lists, 10, rng)
    mine = _nearest(sample, centroids)
    dim = sample.shape[1]
    width = -(-dim // parts)
    residual = np.pad(sample - centroids[mine], ((0, 0), (0, parts * width - dim)))
    books = np.stack([_kmeans(residual[:, p * width : (p + 1) * width], max(1, min(codes, len(sample) // 8)), 6, rng) for p in range(parts)])
    far = np.sqrt(2 - 2 * least)
    return Index(centroids, books, _apart(centroids), float(far / 2 + 1e-6))  # more than rounding


def _code(index: Index, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(list, codes, distance to the code, probed lists as a bool matrix) of unit vectors."""
    mine = _nearest(unit, index.centroids)
    residual = index.pad(unit - index.centroids[mine])
    parts, _, width = index.books.shape
    codes = np.empty((len(unit), parts), np.uint8)
    left = np.zeros(len(unit))
    for p in range(parts):
        piece = residual[:, p * width : (p + 1) * width]
        codes[:, p] = _nearest(piece, index.books[p])
        left += ((piece - index.books[p][codes[:, p]]) ** 2).sum(axis=1)
    return mine, codes, np.sqrt(left), _bisectors(unit, index, mine) <= index.reach


def _components(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        if (low == label[i]).all() and (low == label[j]).all():
            return label
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]


def _unit(raw: np.ndarray) -> np.ndarray:
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return raw / np.sqrt((raw**2).sum(axis=1, keepdims=True))


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist()), np.float64).reshape(-1, dim) if len(vectors) else np.zeros((0, dim))


def _near(distinct: DataFrame, dim: int, least: float, sample_rows: int, block_rows: int, list_rows: int) -> tuple[DataFrame, DataFrame]:
    """(node, n) link counts and (u, v) spanning links of the distinct vectors (node, copies, vector) of one dimension."""
    spark = distinct.sparkSession
    n_rows = distinct.count()
    rows = distinct.orderBy("node").limit(sample_rows).select("vector").toArrow()  # node is a hash: a random sample
    index = fit(_unit(_matrix(rows.column("vector").combine_chunks(), dim)), n_rows, least, list_rows)
    sent = spark.sparkContext.broadcast(index)
    far = float(np.sqrt(2 - 2 * least))
    lists = len(index.centroids)

    coded_schema = pa.schema([("node", pa.int64()), ("copies", pa.int64()), ("vector", pa.binary()), ("list", pa.int32()), ("codes", pa.binary()),
                              ("off", pa.float64()), ("probes", pa.list_(pa.int32()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                s = b.slice(at, 4096)
                mine, codes, off, probes = _code(sent.value, _unit(_matrix(column(s, "vector"), dim)))
                yield out(coded_schema, [column(s, "node"), column(s, "copies"), column(s, "vector"), mine.astype(np.int32), [c.tobytes() for c in codes], off,
                                         [np.flatnonzero(p).astype(np.int32) for p in probes]])

    coded = cut(distinct.mapInArrow(encode, "node bigint, copies bigint, vector binary, list int, codes binary, off double, probes array<int>"))
    blocks = np.zeros(lists, np.int64)
    for r in coded.groupBy("list").count().collect():
        blocks[r["list"]] = -(-r["count"] // block_rows)
    of = F.lit([int(x) for x in blocks])
    base = coded.withColumn("block", F.pmod(F.hash("node"), F.greatest(F.lit(1), of[F.col("list")])).cast("int"))
    last = (F.greatest(F.lit(1), of[F.col("list")]) - 1).cast("int")
    query = coded.withColumn("own", F.col("list")).withColumn("list", F.explode("probes")).withColumn("block", F.explode(F.sequence(F.lit(0), last)))
    columns = ["list", "block", "side", "node", "copies", "vector", "codes", "off", "probes", "own"]
    both = base.withColumn("side", F.lit(0)).withColumn("own", F.col("list")).select(*columns).unionAll(
        query.withColumn("side", F.lit(1)).withColumn("codes", F.lit(None).cast("binary")).withColumn("probes", F.lit(None).cast("array<int>")).select(*columns))
    found_schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit_of, held = None, None
        parts, _, width = sent.value.books.shape
        # a row times (piece, 1, |piece|^2) is the squared distance of the piece to that code
        books = [np.column_stack([-2 * b, (b**2).sum(axis=1), np.ones(len(b))]).astype(np.float32) for b in sent.value.books]

        def settle(rows: pa.RecordBatch) -> pa.RecordBatch:
            x, own, q = held["unit"], column(rows, "own").to_numpy(), _unit(_matrix(column(rows, "vector"), dim))
            node, copies = column(rows, "node").to_numpy(), column(rows, "copies").to_numpy()
            residual = sent.value.pad(q - sent.value.centroids[held["list"]]).astype(np.float32)
            lookup = np.zeros((len(x), len(q)), np.float32)
            for p in range(parts):
                piece = residual[:, p * width : (p + 1) * width]
                table = books[p] @ np.vstack([piece.T, np.ones((1, len(q)), np.float32), (piece**2).sum(axis=1)[None]])
                lookup += table[held["codes"][:, p]]
            # the slack of 1e-4 is far above what single precision loses
            j, i = np.nonzero(lookup <= ((held["off"] + far + 1e-4) ** 2).astype(np.float32)[:, None])
            cosine = np.concatenate([np.einsum("ij,ij->i", q[i[a : a + 65536]], x[j[a : a + 65536]]) for a in range(0, len(i), 65536)] or [np.zeros(0)])
            keep = (cosine >= least) & (node[i] != held["node"][j])
            i, j = i[keep], j[keep]
            counts = np.bincount(i, held["copies"][j], len(q)).astype(np.int64)
            one_way = ~held["probes"][j, own[i]]  # the other vector doesn't probe this one's list: this task counts for both
            back = np.bincount(j[one_way], copies[i[one_way]], len(x)).astype(np.int64)
            nodes = np.concatenate([node, held["node"]])
            label = _components(i, j + len(q), len(nodes))
            joined = np.flatnonzero(nodes[label] != nodes)
            return out(found_schema, [np.concatenate([nodes[joined], nodes]), np.concatenate([nodes[label][joined], nodes]),
                                      np.concatenate([np.zeros(len(joined), np.int64), counts, back])])

        for b in batches:
            keys = np.column_stack([column(b, c).to_numpy() for c in ("list", "block", "side")])
            at = 0
            while at < b.num_rows:
                same = (keys[at:] == keys[at]).all(axis=1)
                to = at + (int(same.argmin()) if not same.all() else len(same))
                rows, (lst, block, side) = b.slice(at, to - at), keys[at]
                at = to
                if (lst, block) != unit_of:
                    unit_of, held = (lst, block), None
                if side == 0:
                    seen = np.zeros((rows.num_rows, lists), bool)
                    for k, probes in enumerate(column(rows, "probes").to_pylist()):
                        seen[k, probes] = True
                    new = {"unit": _unit(_matrix(column(rows, "vector"), dim)), "node": column(rows, "node").to_numpy(), "copies": column(rows, "copies").to_numpy(),
                           "codes": np.frombuffer(b"".join(column(rows, "codes").to_pylist()), np.uint8).reshape(-1, parts).astype(np.intp), "off": column(rows, "off").to_numpy(), "probes": seen}
                    held = {k: np.concatenate([held[k], v]) for k, v in new.items()} | {"list": lst} if held else new | {"list": lst}
                elif held:
                    for x in range(0, rows.num_rows, 512):
                        found = settle(rows.slice(x, 512))
                        useful = np.flatnonzero((column(found, "n").to_numpy() > 0) | (column(found, "u").to_numpy() != column(found, "v").to_numpy()))
                        if len(useful):
                            yield found.take(pa.array(useful))

    key = ["list", "block"]
    found = both.repartition(*key).sortWithinPartitions(*key, "side").mapInArrow(search, "u bigint, v bigint, n bigint")
    found = cut(found)
    return found.where("n > 0").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n")), found.where("u <> v").select("u", "v")


def near_duplicates(vectors: DataFrame, least: float = 0.9, sample_rows: int = 32_768, block_rows: int = 2048, list_rows: int = 512) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding).

    Null and zero vectors and those with a null, NaN or infinite component link with nothing; vectors of different
    lengths don't link.  Rows with equal vectors are linked copies, compared once.  component_id is the smallest vec_id
    reachable; a null vec_id is never the smallest, and a component of null ids has a null component_id and isn't kept.
    An empty table gives an empty result.  Only vec_id and embedding are read.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    good = "e is not null and size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(e, x -> x <> 0)"
    rows = rows.select("vec_id", F.expr(f"case when coalesce({good}, false) then transform(e, x -> x + 0.0D) end").alias("e")).withColumn("node", F.when(F.col("e").isNotNull(), F.xxhash64("e")))
    rows = cut(rows)
    lone = rows.where("e is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    distinct = rows.where("e is not null").groupBy("node", "e").agg(F.count("*").alias("copies"), F.min("vec_id").alias("rep"))
    schema = pa.schema([("node", pa.int64()), ("copies", pa.int64()), ("rep", pa.int64()), ("dim", pa.int32()), ("vector", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = [np.asarray(v.values, np.float64) for v in column(b, "e")]
            yield out(schema, [column(b, "node"), column(b, "copies"), column(b, "rep"), [len(v) for v in vectors], [v.tobytes() for v in vectors]])

    distinct = cut(distinct.mapInArrow(pack, "node bigint, copies bigint, rep bigint, dim int, vector binary"))
    release(vectors.sparkSession)
    counts = vectors.sparkSession.createDataFrame([], "node bigint, n bigint")
    links = vectors.sparkSession.createDataFrame([], "u bigint, v bigint")
    for r in distinct.select("dim").distinct().collect():
        n, uv = _near(distinct.where(F.col("dim") == r.dim).select("node", "copies", "vector"), r.dim, least, sample_rows, block_rows, list_rows)
        counts, links = counts.unionAll(n), links.unionAll(uv)
    roots = cut(components(links))
    labelled = distinct.select("node", "copies", "rep").join(roots.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    labelled = cut(labelled.join(counts, "node", "left").select("node", "rep", "root", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least_id = cut(labelled.groupBy("root").agg(F.min("rep").alias("component_id")))
    named = cut(labelled.join(least_id, "root").select("node", "n_links", "component_id"))
    linked = rows.where("e is not null").select("vec_id", "node").join(named, "node").select("vec_id", "n_links", "component_id")
    return linked.unionAll(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
