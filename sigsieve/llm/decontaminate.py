"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Items fall into classes by their number of distinct shingles, n in [2**c, 2**(c+1)).  For each class that occurs, a
document is cut into overlapping windows of 4 * 2**c shingles, a stride of half of that, so every passage as long as an
item of the class lies inside one window.  Size against size, a contained item has a Jaccard similarity of at least
0.19 with that window; a window and an item become a candidate when any of `perms` minima agree (one row to a band),
which misses such a pair with probability 0.81**64 < 2e-6.  Candidates are checked by exact shingle containment in the
whole document.  An item of fewer than k words is one shingle, its whole sequence of words, and found by exact lookup of
the document's runs of as many words.  Nothing is shuffled: the items travel to the documents in blocks of at most
`block_items` items and `block_bytes` bytes (one longer item is a block of its own), each block one broadcast of bounded
size and one pass, so a large benchmark only means more passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textgrid as tg
from .common import column, out, pieces, utf8

_TO_SPACE = bytes(0x20 if tg.PUNCT[i] else i for i in range(256))


def normal_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and any non-ASCII characters."""
    return (text or "").lower().encode("utf-8", "replace").translate(_TO_SPACE).split()


def _shingles(text: str | None, k: int) -> set[bytes]:
    words = normal_words(text)
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


def _hashes(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, first, last) with text d's shingles at [first[d], last[d])."""
    data, ends = utf8(pa.array([(t or "").lower() for t in texts], pa.large_string()))
    starts, stops, first = tg.words(data, ends, tg.PUNCT)
    h = tg.grams(tg.span_hash(tg.prefix(data), starts, stops), k)
    return h, first[:-1], np.maximum(first[:-1], first[1:] - k + 1)


def _odd(perms: int) -> np.ndarray:
    return tg.mixed(np.arange(1, perms + 1, dtype=np.uint64) * tg.MIX) | np.uint64(1)


class _Index:
    """Signatures of one block of items, by size class."""

    def __init__(self, items: list[tuple[int, str]], k: int, perms: int):
        self.k, self.odd, self.items = k, _odd(perms), {}
        classes: dict[int, list[tuple[int, np.ndarray]]] = {}
        short: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in items:
            size = min(k, len(normal_words(text)))
            if not size:
                continue
            grams = _shingles(text, size)
            h, first, last = _hashes([text], size)
            at = len(self.items)
            self.items[at] = (item_id, grams, size)
            if size < k:
                short.setdefault(size, []).append((int(h[first[0]]), at))
                continue
            minima = (h[first[0] : last[0], None] * self.odd).min(axis=0)
            classes.setdefault(len(grams).bit_length() - 1, []).append((at, minima))
        self.short = {}
        for size, rows in sorted(short.items()):
            rows.sort()
            self.short[size] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]))
        self.classes = {}
        for c, rows in sorted(classes.items()):
            values = np.concatenate([m for _, m in rows])
            owner = np.repeat([a for a, _ in rows], perms)
            order = np.argsort(values, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[(values & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.classes[c] = (values[order], owner[order], seen)

    def candidates(self, texts: list[str | None]) -> set[tuple[int, int]]:
        found: set[tuple[int, int]] = set()
        for size, (values, owner) in self.short.items():
            h, first, last = _hashes(texts, size)
            hit = np.flatnonzero(np.isin(h, values))
            d = np.searchsorted(first, hit, side="right") - 1
            hit, d = hit[hit < last[d]], d[hit < last[d]]  # runs that lie inside one text
            a, b = np.searchsorted(values, h[hit], "left"), np.searchsorted(values, h[hit], "right")
            for i in range(len(hit)):
                found.update((int(d[i]), int(o)) for o in owner[a[i] : b[i]])
        h, first, last = _hashes(texts, self.k)
        count = last - first
        keep = np.flatnonzero(count > 0)
        if not len(keep) or not self.classes:
            return found
        first, count = first[keep], count[keep]
        low = min(self.classes)
        layout = []  # per level: start of each block, blocks per text, text of each block, whether the next is of the same text
        blocks, base, size = count, first, 2 << low
        for c in range(low, max(self.classes) + 1):
            n = -(-blocks // size)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            text = np.repeat(np.arange(len(keep)), n)
            layout.append((c, base[text] + size * within, text, np.append(text[1:] == text[:-1], False)))
            blocks, base, size = n, np.cumsum(n) - n, 2
        mask = np.ones(len(h), bool)
        mask[np.concatenate([np.arange(a, b) for a, b in zip(np.append(0, first + count), np.append(first, len(h)), strict=True)])] = False
        for odd in self.odd:
            value = np.where(mask, h * odd, np.uint64(0xFFFFFFFFFFFFFFFF))
            for c, starts, text, joined in layout:
                value = np.minimum.reduceat(value, starts)
                if c not in self.classes:
                    continue
                window = value.copy()
                window[:-1] = np.where(joined[:-1], np.minimum(value[:-1], value[1:]), value[:-1])
                values, owner, seen = self.classes[c]
                maybe = np.flatnonzero(seen[(window & np.uint64((1 << 20) - 1)).astype(np.int64)])
                if not len(maybe):
                    continue
                a, b = np.searchsorted(values, window[maybe], "left"), np.searchsorted(values, window[maybe], "right")
                for i in np.flatnonzero(a < b):
                    found.update((int(keep[text[maybe[i]]]), int(o)) for o in owner[a[i] : b[i]])
        return found

    def matches(self, texts: list[str | None], least: float) -> list[tuple[int, int, int, int]]:
        """(text, item_id, shared, size) with shared / size >= least, exact."""
        by_text: dict[int, list[int]] = {}
        for d, o in self.candidates(texts):
            by_text.setdefault(d, []).append(o)
        rows = []
        for d, owners in sorted(by_text.items()):
            grams: dict[int, set[bytes]] = {}
            for o in sorted(owners):
                item_id, own, size = self.items[o]
                if size not in grams:
                    grams[size] = _shingles(texts[d], size)
                if (shared := len(own & grams[size])) >= least * len(own):
                    rows.append((d, item_id, shared, len(own)))
        return rows


def _blocks(benchmark: DataFrame, k: int, perms: int, block_items: int, block_bytes: int) -> list[Broadcast]:
    """One broadcast per block of items.  Rows are fetched block by block, never all at once."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    sent, held, size = [], [], 0
    for row in rows.toLocalIterator():
        if held and (len(held) == block_items or size + len(row.text) > block_bytes):
            sent.append(spark.sparkContext.broadcast(_Index(held, k, perms)))
            held, size = [], 0
        held.append((row.item_id, row.text))
        size += len(row.text)
    if held:
        sent.append(spark.sparkContext.broadcast(_Index(held, k, perms)))
    return sent


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8, perms: int = 64, block_items: int = 20_000, block_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for every item of which a document holds the share `least`.

    Texts are compared as lower-cased words without ASCII punctuation.  An item of fewer than k words is one shingle (n_item
    1), held where its words stand in a row.  Items without words or null ones match nothing; null or empty documents
    match nothing; an empty benchmark or table gives an empty result.  Repeated rows of one id give one row, that of the
    largest containment.  Only doc_id, text and item_id, text are read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_item", pa.int64())])
    spec = "doc_id bigint, item_id bigint, n_shared bigint, n_item bigint"
    thin = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def against(block: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, "text"):
                rows = block.value.matches(column(b, "text").to_pylist(), least)
                if rows:
                    ids = column(b, "doc_id")
                    d, item, shared, size = zip(*rows, strict=True)
                    yield out(schema, [ids.take(pa.array(d)), item, shared, size])

        return thin.mapInArrow(run, spec)

    found = docs.sparkSession.createDataFrame([], spec)
    for block in _blocks(benchmark, k, perms, block_items, block_bytes):
        found = found.unionAll(against(block))
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("n_shared"))
    return found.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r").withColumn("containment", F.col("n_shared") / F.col("n_item"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8, perms: int = 64, block_items: int = 20_000, block_bytes: int = 16 << 20) -> DataFrame:
    """docs, whole rows, without those that hold the share `least` of an item (see contaminated)."""
    kept = docs
    for block in _blocks(benchmark, k, perms, block_items, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, "text"):
                hit = {r[0] for r in block.value.matches(column(b, "text").to_pylist(), least)}
                yield b.filter(pa.array([i not in hit for i in range(b.num_rows)])) if hit else b

        kept = kept.mapInArrow(run, docs.schema)
    return kept
