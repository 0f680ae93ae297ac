"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Fingerprints are dealt into tiles by the set bits of four 16-bit quarters.  Two fingerprints that differ in r bits
differ by at most r in the sum over the quarters of the count differences, so only tiles that near each other are
compared, with numpy's exclusive-or and bit counts; every other tile pair is skipped, which loses nothing.  A tile
above `tile_rows` is dealt into parts, and each pair of parts is a task's unit of work, so no hot tile meets in one
place.  Equal fingerprints are one row before any comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE_BYTES, column, cut, numbered, out, pieces, place
from .components import components

QUARTERS = 4
SIDE = 17  # a 16-bit quarter has 0 to 16 set bits
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _fingerprints(texts: list[bytes | None], shingle: int, seed: int) -> np.ndarray:
    digest, hashes, counts = xxhash.xxh64_intdigest, [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.lower().split() if text else []  # bytes: A-Z and the six ASCII separators only
        if not words:
            continue
        line = b" ".join(words)
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        if len(words) <= shingle:
            spans = [line]
        else:
            starts = [0, *(stops[: len(words) - shingle] + 1).tolist()]
            spans = [line[a:b] for a, b in zip(starts, stops[shingle - 1 :].tolist(), strict=True)]
        counts[i] = len(spans)
        hashes.append(np.fromiter(map(digest, spans, repeat(seed)), np.uint64, len(spans)))
    if not hashes:
        return np.zeros(len(texts), np.uint64)
    octets = np.concatenate(hashes).view(np.uint8).reshape(-1, 8)
    owner = np.repeat(np.arange(len(texts)) * 256, counts)
    result = np.zeros((len(texts), 8), np.uint8)
    for k in range(8):
        ones = np.bincount(owner + octets[:, k], minlength=256 * len(texts)).reshape(-1, 256) @ _BITS
        result[:, k] = np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little")[:, 0]
    return result.view(np.uint64)[:, 0]


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fp): 64-bit SimHash over word shingles, lower-cased A-Z, XXH64 with `seed`.

    Null or wordless text: fingerprint zero.  Fewer words than `shingle`: one shingle of all of them.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", PIECE_BYTES):
            fp = _fingerprints(column(b, "text").to_pylist(), shingle, seed)
            yield out(schema, [column(b, "doc_id"), column(b, "text_hash"), fp.view(np.int64)])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id bigint, text_hash bigint, fp bigint")


def _tile(fp: np.ndarray) -> np.ndarray:
    counts = np.bitwise_count(fp.view(np.uint16).reshape(-1, QUARTERS)).astype(np.int64)
    return counts @ (SIDE ** np.arange(QUARTERS))


def _steps(radius: int) -> np.ndarray:
    """Tile steps within the radius."""
    return np.array([s for s in product(range(-radius, radius + 1), repeat=QUARTERS) if sum(map(abs, s)) <= radius], np.int64)


def _forest(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> list[tuple[int, int]]:
    """Links that connect what the fingerprints of two tile parts connect: at most one less than there are rows."""
    nodes = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    label = np.arange(len(nodes))
    links: list[tuple[int, int]] = []
    rows = max(1, (1 << 21) // max(1, len(b)))
    for at in range(0, len(a), rows):
        near = np.bitwise_count(a[at : at + rows, None] ^ b[None, :]) <= radius
        if same:
            near[np.arange(len(near)), np.arange(at, at + len(near))] = False
        for i in np.flatnonzero(near.any(axis=1)):
            partners = np.flatnonzero(near[i]) + shift
            i = i + at
            groups, where = np.unique(label[partners], return_index=True)
            for group, w in zip(groups, where, strict=True):
                if group != label[i]:
                    links.append((nodes[i], nodes[partners[w]]))
                    label[label == group] = label[i]
    return links


def links(distinct: DataFrame, radius: int = 2, tile_rows: int = 4096) -> DataFrame:
    """(u, v) fingerprints whose links connect exactly the classes that all links within `radius` bits connect.

    distinct: one column fp, no repeats.  The tile sizes sent to all tasks are at most 17**4 numbers.
    """
    spark = distinct.sparkSession
    tiles_schema = pa.schema([("fp", pa.int64()), ("tile", pa.int64())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = column(b, "fp").to_numpy()
            yield out(tiles_schema, [fp, _tile(fp.copy().view(np.uint64))])

    dealt = distinct.mapInArrow(deal, "fp bigint, tile bigint")
    parts = np.zeros(SIDE**QUARTERS, np.int64)
    for tile, n in dealt.groupBy("tile").count().collect():
        parts[tile] = -(-n // tile_rows)
    parts_sent = spark.sparkContext.broadcast(parts)
    steps = _steps(radius)
    pair_schema = pa.schema([("lo", pa.int64()), ("hi", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("fp", pa.int64())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, scale = parts_sent.value, SIDE ** np.arange(QUARTERS)
        for b in batches:
            fp, tile = column(b, "fp").to_numpy(), column(b, "tile").to_numpy()
            own = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % parts[tile]
            digits = tile[:, None] // scale % SIDE
            for step in steps:
                moved = digits + step
                other = moved @ scale
                ok = ((moved >= 0) & (moved < SIDE)).all(axis=1)
                ok[ok] = parts[other[ok]] > 0
                r = np.flatnonzero(ok)
                copies = parts[other[r]]
                r = np.repeat(r, copies)
                if not len(r):
                    continue
                theirs = np.arange(len(r)) - np.repeat(np.cumsum(copies) - copies, copies)
                t, o, mine = tile[r], other[r], own[r]
                alone = t == o
                first = np.where(alone, mine <= theirs, t < o)
                yield out(pair_schema, [np.minimum(t, o), np.maximum(t, o), np.where(first, mine, theirs).astype(np.int32),
                                        np.where(first, theirs, mine).astype(np.int32), (~first).astype(np.int32), fp[r]])

    link_schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def settle(rows: np.ndarray) -> list[tuple[int, int]]:
            side, fp = rows[:, 4], rows[:, 5].copy().view(np.uint64)
            same = rows[0, 0] == rows[0, 1] and rows[0, 2] == rows[0, 3]
            a = fp[side == 0]
            b = a if same else fp[side == 1]
            return _forest(a, b, bool(same), radius) if len(a) and len(b) else []

        def flush(found: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return out(link_schema, [pairs[:, 0], pairs[:, 1]])

        for b in batches:
            rows = np.column_stack([column(b, n).to_numpy().astype(np.int64) for n in pair_schema.names])
            if not len(rows):
                continue
            if held and (held[0][0, :4] != rows[0, :4]).any():
                yield flush(settle(np.concatenate(held)))
                held = []
            new = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            bounds = [0, *new.tolist(), len(rows)]
            found: list[tuple[int, int]] = []
            for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                if y == len(rows):
                    held.append(rows[x:y])
                elif held:
                    found += settle(np.concatenate([*held, rows[x:y]]))
                    held = []
                else:
                    found += settle(rows[x:y])
            if found:
                yield flush(found)
        if held:
            yield flush(settle(np.concatenate(held)))

    key = ["lo", "hi", "i", "j"]
    pairs = dealt.mapInArrow(send, "lo bigint, hi bigint, i int, j int, side int, fp bigint")
    return pairs.repartition(*key).sortWithinPartitions(*key).mapInArrow(compare, "u bigint, v bigint")


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 2, seed: int = 42, tile_rows: int = 4096) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) per row; component_id is the smallest doc_id reachable over links.

    Rows with equal text are rows of one class.  A null doc_id is never the smallest; a class of null ids only has a
    null component_id.  An empty table gives an empty result.  Other columns, whatever their names, are not read.
    """
    rows = cut(fingerprints(docs, shingle, seed))
    reps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = cut(components(links(reps.select("fp"), radius, tile_rows)))
    labelled = cut(reps.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    least = cut(labelled.groupBy("root").agg(F.min("rep").alias("component_id")))
    named = cut(labelled.join(least, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents table without near copies: of each class the rows of its smallest doc_id stay, repeats of a row once.

    Rows without doc_id stay unless their class has a document with one.
    """
    kept = simhash_components(docs, **options).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = cut(kept.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    rows = numbered(docs)
    own, text = F.col(place(docs, "doc_id")), F.xxhash64(place(docs, "text"))
    rows = rows.withColumn("_own", own).withColumn("_own_hash", text)
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_own_hash") == F.col("_hash"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["_own", "_own_hash"]).drop("_own", "_own_hash").toDF(*docs.columns)
