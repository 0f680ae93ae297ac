"""Exact repeated byte strings by a sparse suffix array.

A window is `size` consecutive bytes of one document; a byte goes if a window over it also starts anywhere else.

1. Anchors.  The leftmost minimum of the 32-byte gram hashes inside a window is its anchor; equal windows have equal
   anchors at equal offsets, and one byte in about 185 is one.  Anchors whose gram occurs once are done with.
2. Suffixes.  Every other anchor gives the suffix that starts at it, as far as its windows reach, with the bytes to its
   left that they cover.  Equal ones are one row with a count; a count above one settles all its windows.
3. Buckets.  Spark samples splitters and range-partitions the suffixes by their leading 32 bytes, so suffixes that may
   share a window share a bucket.  A bucket sorts its suffixes by multikey quicksort (three ways by 8-byte symbols, in
   numpy, equal ranges only going on to the next symbol) and takes the common prefix of neighbours.  The windows that
   start o bytes before the anchor are equal where the suffixes share size - o bytes and the o bytes to the left agree.
4. Across boundaries.  A gram with more than `hot` suffixes would outgrow its bucket; it is cut out, and its windows
   are compared over all tasks by an aggregation of their digests.
5. Documents take their spans back and drop the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textgrid as tg
from .common import column, cut, out, pieces, release, utf8

GRAM = 32
PIECE = 1 << 20


def _anchors(docs: DataFrame, size: int, places: bool) -> DataFrame:
    """(g) of every anchor; with places also k1, k2, low, place, high: windows that start at low..high are anchored at place."""
    names = ["g", "k1", "k2", "low", "place", "high"][: 6 if places else 1]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", PIECE):
            data, ends = utf8(column(b, "text"))
            if len(data) < size:
                continue
            prefix = tg.prefix(data)
            starts = np.arange(len(data) - GRAM + 1)
            g = tg.span_hash(prefix, starts, starts + GRAM)
            first = np.minimum(ends[:-1], len(g))
            last = np.minimum(np.maximum(ends[:-1], ends[1:] - GRAM + 1), len(g))
            place, low, high = tg.minimizers(g, first, last, size - GRAM + 1)
            columns = [g[place].view(np.int64)]
            if places:
                doc = np.searchsorted(ends, place, side="right") - 1
                base = ends[doc]
                columns += [column(b, "k1").to_numpy()[doc], column(b, "k2").to_numpy()[doc], low - base, place - base, high - base]
            yield out(schema, columns)

    return docs.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _contexts(docs: DataFrame, runs: DataFrame, size: int) -> DataFrame:
    """(g, n, k1, k2, low, at, body): body holds the bytes of all windows of an anchor, `at` the anchor's place in it."""
    schema = pa.schema([("g", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("low", pa.int64()), ("at", pa.int32()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", PIECE):
            rows = []
            for k1, k2, text, held in zip(*(column(b, c).to_pylist() for c in ("k1", "k2", "text", "runs")), strict=True):
                rows += [(r["g"], r["n"], k1, k2, r["low"], r["place"] - r["low"], text[r["low"] : r["high"] + size]) for r in held]
            for x in range(0, len(rows), 4096):
                yield out(schema, list(map(list, zip(*rows[x : x + 4096], strict=True))))

    mine = runs.groupBy("k1", "k2").agg(F.collect_set(F.struct("g", "n", "low", "place", "high")).alias("runs"))
    return docs.join(mine, ["k1", "k2"]).mapInArrow(run, "g bigint, n bigint, k1 bigint, k2 bigint, low bigint, at int, body binary")


def multikey_order(keys: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of symbols.  Each round sorts the rows that are still equal by the next symbol."""
    order = np.arange(len(keys))
    group = np.zeros(len(keys), np.int64)
    active = np.arange(len(keys))
    for j in range(keys.shape[1]):
        if not len(active):
            break
        symbol = keys[order[active], j]
        moved = np.lexsort((symbol, group[active]))
        order[active], symbol = order[active][moved], symbol[moved]
        mine = group[active]
        new = np.ones(len(active), bool)
        new[1:] = (mine[1:] != mine[:-1]) | (symbol[1:] != symbol[:-1])
        group[active] = active[np.flatnonzero(new)[np.cumsum(new) - 1]]
        alone = new & np.append(new[1:], True)
        active = active[~alone]
    return order


def repeated_windows(bodies: list[bytes], at: np.ndarray, copies: np.ndarray, size: int) -> np.ndarray:
    """For suffixes with a context each: which of the windows that start o bytes before the anchor occur twice, as a
    matrix by row and o."""
    n, reach = len(bodies), size - GRAM + 1
    right = np.zeros((n, size + 8 - size % 8), np.uint8)
    left = np.zeros((n, reach), np.uint8)
    long = np.empty(n, np.int64)
    for i, (body, a) in enumerate(zip(bodies, at.tolist(), strict=True)):
        whole = np.frombuffer(body, np.uint8)
        right[i, : len(body) - a] = whole[a:]
        left[i, :a] = whole[:a][::-1]
        long[i] = len(body) - a
    order = multikey_order(right.view(">u8"))
    right, left, at, copies, long = right[order], left[order], at[order], copies[order], long[order]
    differ = right[1:] != right[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), size) if n > 1 else np.zeros(0, np.int64)
    found = np.zeros((n, reach), bool)
    agree = np.zeros(n, np.uint64)
    step = np.uint64(tg.BASE)
    for o in range(reach):
        if o:
            agree = agree * step + left[:, o - 1] + np.uint64(1)
        rows = np.flatnonzero((at >= o) & (long >= size - o))
        if not len(rows):
            continue
        run = np.cumsum(np.concatenate([[0], common < size - o]))[rows]
        by = np.lexsort((agree[rows], run))
        r, h = run[by], agree[rows][by]
        new = np.ones(len(by), bool)
        new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
        begin = np.flatnonzero(new)
        total = np.add.reduceat(copies[rows][by], begin)
        found[rows[by], o] = (total >= 2)[np.cumsum(new) - 1]
    result = np.empty_like(found)
    result[order] = found
    return result


def _bucket_spans(distinct: DataFrame, size: int, batch_rows: int = 8192) -> DataFrame:
    """(k1, k2, start, stop) of repeated windows of the suffixes that occur once, bucket by bucket."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])

    def settle(rows: list[dict]) -> pa.RecordBatch:
        at, copies = np.array([r["at"] for r in rows]), np.array([r["copies"] for r in rows])
        found = repeated_windows([r["body"] for r in rows], at, copies, size)
        spans = []
        for i in np.flatnonzero(found.any(axis=1) & (copies == 1)):
            r, hit = rows[i], np.concatenate([[False], found[i], [False]])
            turns = np.flatnonzero(hit[1:] != hit[:-1])
            place = r["low"] + r["at"]
            spans += [(r["k1"], r["k2"], place - (y - 1), place - x + size) for x, y in turns.reshape(-1, 2).tolist()]
        return out(schema, list(map(list, zip(*spans, strict=True))) if spans else [[], [], [], []])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[dict] = []
        same: list[dict] = []  # the suffixes of the current gram
        for b in batches:
            for r in b.to_pylist():
                if same and same[0]["lead"] != r["lead"]:
                    if len(same) > 1 and any(x["copies"] == 1 for x in same):
                        ready += same
                    same = []
                    if len(ready) >= batch_rows:
                        yield settle(ready)
                        ready = []
                same.append(r)
        if len(same) > 1 and any(x["copies"] == 1 for x in same):
            ready += same
        if ready:
            yield settle(ready)

    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = distinct.repartitionByRange(parts, "lead").sortWithinPartitions("lead")
    return placed.mapInArrow(run, "k1 bigint, k2 bigint, start bigint, stop bigint")


def _hot_spans(distinct: DataFrame, size: int) -> DataFrame:
    """The same for grams too frequent for a bucket: digests of all windows, counted by all tasks."""
    each = distinct.select("g", "at", "copies", "k1", "k2", "low", "body", F.explode(F.expr(f"sequence(0, length(body) - {size})")).alias("i"))
    each = each.select("g", (F.col("at") - F.col("i")).alias("o"), "copies", "k1", "k2", (F.col("low") + F.col("i")).alias("start"),
                       F.md5(F.expr(f"substring(body, i + 1, {size})")).alias("digest"))
    again = cut(each.groupBy("g", "o", "digest").agg(F.sum("copies").alias("n")).where("n >= 2").select("g", "o", "digest"))
    hit = each.where("copies = 1").join(again, ["g", "o", "digest"])
    return hit.select("k1", "k2", "start", (F.col("start") + size).alias("stop"))


def repeated_spans(docs: DataFrame, size: int = 400, hot: int = 50_000) -> DataFrame:
    """(k1, k2, spans): byte spans [start, stop) of each document that repeated windows cover.

    docs: k1, k2 (keys of a row), text (binary, not null).  Spans may touch or overlap.
    """
    spark = docs.sparkSession
    shared = cut(_anchors(docs, size, places=False).groupBy("g").agg(F.count("*").alias("n")).where("n > 1"))
    runs = cut(_anchors(docs, size, places=True).join(shared, "g"))
    release(spark)
    contexts = cut(_contexts(docs, runs, size).withColumn("key", F.md5("body")))
    release(spark)
    lead = F.expr(f"substring(body, at + 1, {GRAM})")
    distinct = contexts.groupBy("g", "at", "body", "key").agg(
        F.count("*").alias("copies"), F.min("k1").alias("k1"), F.min("k2").alias("k2"), F.min("low").alias("low"), F.max("n").alias("n"))
    distinct = cut(distinct.withColumn("lead", lead))
    release(spark)
    several = distinct.where("copies > 1").select("g", "at", "key")
    whole = contexts.select("g", "at", "key", "k1", "k2", "low", F.length("body").alias("long")).join(several, ["g", "at", "key"])
    spans = whole.select("k1", "k2", F.col("low").alias("start"), (F.col("low") + F.col("long")).alias("stop"))
    spans = spans.unionByName(_bucket_spans(distinct.where(F.col("n") <= hot).select("lead", "at", "body", "copies", "k1", "k2", "low"), size))
    spans = cut(spans.unionByName(_hot_spans(distinct.where(F.col("n") > hot), size)))
    release(spark)
    return spans.groupBy("k1", "k2").agg(F.collect_set(F.array("start", "stop")).alias("spans"))


def _merged(spans: list[list[int]] | None) -> list[list[int]]:
    """Maximal runs; spans that touch are one run."""
    found: list[list[int]] = []
    for a, b in sorted(spans or []):
        if found and a <= found[-1][1]:
            found[-1][1] = max(found[-1][1], b)
        else:
            found.append([a, b])
    return found


def _keep(text: bytes, spans: list[list[int]]) -> bytes:
    if not spans:
        return text
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def dedup(docs: DataFrame, size: int = 400, hot: int = 50_000) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): every row's removed byte runs, maximal, and remaining bytes (binary, as a cut may
    fall inside a character).

    Null text: no bytes.  Every row is a document of its own, so repeated rows, of one doc_id or of none, remove each
    other's bytes.  Only doc_id and text are read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())])
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = keyed.select("doc_id", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text").alias("k2"), F.col("text").cast("binary").alias("text"))
    spans = repeated_spans(keyed.where("text is not null").select("k1", "k2", "text"), size, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            texts = [t or b"" for t in column(b, "text").to_pylist()]
            runs = [_merged(s) for s in column(b, "spans").to_pylist()]
            yield out(schema, [column(b, "doc_id"), [len(t) for t in texts], pa.array(runs, schema.field("spans").type),
                               [_keep(t, s) for t, s in zip(texts, runs, strict=True)]])

    return keyed.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id bigint, n_bytes bigint, spans array<array<bigint>>, kept binary")


def digests(docs: DataFrame, size: int = 400, hot: int = 50_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of dedup's rows."""
    rows = dedup(docs, size, hot)
    return rows.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("bigint").alias("n_removed"),
                       F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
