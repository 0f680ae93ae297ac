"""Substring dedup with suffix automata of reference shards.

A window is `window` consecutive words of one document; a word goes if a window over it also starts in a document with a
smaller doc_id.

1. Anchors.  The leftmost minimum of the 5-gram hashes inside a window is its anchor: equal windows have equal anchors,
   and one anchor in about five words serves all windows.  An anchor of one document only can't be in a shared window.
2. Shards.  A shared anchor's owner is its smallest doc_id.  Maximal runs of windows whose anchors have the same owner
   are passages, and a passage goes to its owner's shard: equal windows always meet there.  Equal passages are one row.
3. Automata.  A shard's distinct passages stream, in the order of their smallest doc_id, through the suffix automaton of
   what came before; where the matching statistic reaches the window length, the window was there.  What wasn't there
   joins the automaton.  A shard holds about what one document holds; one with more than `hot` distinct passages has
   its windows counted by an aggregation over all tasks instead, with the same result.
4. Documents take their spans back and drop the words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textgrid as tg
from .common import column, cut, numbered, out, pieces, place, release, utf8

GRAM = 5


def _words_of(texts: list[bytes | None]) -> list[list[bytes]]:
    return [t.split() if t else [] for t in texts]  # bytes split at exactly \x20 \x09-\x0D


def _anchors(docs: DataFrame, window: int, runs: bool) -> DataFrame:
    """(g, doc_id), with runs also text_hash and at: first window << 8 | windows of the run that g anchors."""
    names = ["g", "doc_id", "text_hash", "at"][: 4 if runs else 2]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 1 << 20):
            data, ends = utf8(column(b, "text"))
            starts, stops, first = tg.words(data, ends)
            g = tg.grams(tg.span_hash(tg.prefix(data), starts, stops), GRAM)
            place, low, high = tg.minimizers(g, first[:-1], np.maximum(first[:-1], first[1:] - GRAM + 1), window - GRAM + 1)
            doc = np.searchsorted(first, place, side="right") - 1
            columns = [g[place].view(np.int64), column(b, "doc_id").to_numpy()[doc]]
            if runs:
                columns += [column(b, "text_hash").to_numpy()[doc], (low - first[doc]) << 8 | (high - low + 1)]
            yield out(schema, columns)

    return docs.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _passages(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """(owner, doc_id, text_hash, start, n_windows, words): each document's maximal runs of windows of one owner."""
    schema = pa.schema([("owner", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("n_windows", pa.int32()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 1 << 20):
            rows = []
            for doc, text_hash, text, held in zip(*(column(b, c) for c in ("doc_id", "text_hash", "text", "runs")), strict=True):
                words = text.as_py().split()
                at, owner = held.values.field("at").to_numpy(), held.values.field("owner").to_numpy()
                order = np.argsort(at, kind="stable")
                at, owner = at[order], owner[order]
                low, n = at >> 8, at & 255
                new = np.ones(len(at), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (low[1:] != low[:-1] + n[:-1])
                begin = np.flatnonzero(new)
                last = np.append(begin[1:], len(at)) - 1
                for x, y in zip(begin, last, strict=True):
                    a, z = int(low[x]), int(low[y] + n[y])
                    rows.append((int(owner[x]), doc.as_py(), text_hash.as_py(), a, z - a, b" ".join(words[a : z + window - 1])))
            if rows:
                yield out(schema, list(map(list, zip(*rows, strict=True))))

    mine = runs.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("at", "owner")).alias("runs"))
    return docs.join(mine, ["doc_id", "text_hash"]).mapInArrow(
        run, "owner bigint, doc_id bigint, text_hash bigint, start int, n_windows int, words binary")


class SuffixAutomaton:
    """Suffix automaton over word sequences; transitions of each state by word."""

    def __init__(self) -> None:
        self.to: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[bytes]) -> None:
        to, link, length = self.to, self.link, self.length
        last = 0
        for w in words:
            at = to[last].get(w)
            if at is not None:
                if length[at] == length[last] + 1:
                    last = at
                else:
                    last = self._split(last, w, at)
                continue
            new = len(to)
            to.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and w not in to[p]:
                to[p][w] = new
                p = link[p]
            if p >= 0:
                q = to[p][w]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
            last = new

    def _split(self, p: int, w: bytes, q: int) -> int:
        clone = len(self.to)
        self.to.append(dict(self.to[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.to[p].get(w) == q:
            self.to[p][w] = clone
            p = self.link[p]
        return clone

    def windows(self, words: list[bytes], size: int) -> list[int]:
        """Starts of the windows of `size` words that occur in what was added: matching statistics of size or more."""
        to, link, length = self.to, self.link, self.length
        state = matched = 0
        found = []
        for i, w in enumerate(words):
            at = to[state].get(w)
            while at is None and state:
                state = link[state]
                matched = length[state]
                at = to[state].get(w)
            if at is None:
                matched = 0
                continue
            state = at
            matched += 1
            if matched >= size:
                found.append(i - size + 1)
                while length[link[state]] >= size:  # a longer match says no more
                    state = link[state]
                matched = min(matched, length[state])
        return found


def _spans(at: list[int]) -> list[list[int]]:
    """Maximal [start, stop) runs of ascending numbers."""
    found: list[list[int]] = []
    for i in at:
        if found and found[-1][1] == i:
            found[-1][1] = i + 1
        else:
            found.append([i, i + 1])
    return found


def _seen_before(distinct: DataFrame, window: int) -> DataFrame:
    """(owner, key, first, seen): windows [start, stop) of each distinct passage that an earlier document of the shard has."""
    names = ("owner", "key", "first", "seen")
    spans = pa.list_(pa.list_(pa.int32()))
    schema = pa.schema([("owner", pa.int64()), ("key", pa.string()), ("first", pa.int64()), ("seen", spans)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton, doc = None, None, None
        waiting: list[list[bytes]] = []  # what the current document adds once all its passages have streamed by
        for b in batches:
            rows = []
            for owner, key, first, text in zip(*(column(b, c).to_pylist() for c in ("owner", "key", "first", "words")), strict=True):
                if owner != shard:
                    shard, automaton, doc, waiting = owner, None, first, []
                words = text.split()
                if first != doc:
                    if waiting:
                        automaton = automaton or SuffixAutomaton()
                        for stretch in waiting:
                            automaton.add(stretch)
                    doc, waiting = first, []
                seen = _spans(automaton.windows(words, window)) if automaton else []
                at = 0
                for x, y in [*seen, [len(words) - window + 1] * 2]:
                    if x > at:
                        waiting.append(words[at : x + window - 1])
                    at = y
                rows.append((owner, key, first, seen))
            if rows:
                yield out(schema, list(map(list, zip(*rows, strict=True))))

    placed = distinct.repartition("owner").sortWithinPartitions("owner", "first", "key")
    return placed.select("owner", "key", "first", "words").mapInArrow(run, "owner bigint, key string, first bigint, seen array<array<int>>").select(*names)


def _seen_hot(distinct: DataFrame, window: int) -> DataFrame:
    """_seen_before for shards too large for one task: smallest document of each window by aggregation."""
    words = distinct.withColumn("w", F.split(F.col("words").cast("string"), " "))
    each = words.select("owner", "key", "first", "w", F.explode(F.expr(f"sequence(1, size(w) - {window - 1})")).alias("i"))
    each = each.select("owner", "key", "first", (F.col("i") - 1).alias("i"), F.expr(f"array_join(slice(w, i, {window}), ' ')").alias("text"))
    least = cut(each.groupBy("owner", "text").agg(F.min("first").alias("least")))
    later = each.join(least, ["owner", "text"]).where("least < first").groupBy("owner", "key", "first").agg(F.collect_list("i").alias("at"))
    spans = later.withColumn("seen", F.expr("transform(at, x -> array(x, x + 1))"))
    return distinct.select("owner", "key", "first").join(spans.select("owner", "key", "first", "seen"), ["owner", "key", "first"], "left").withColumn(
        "seen", F.coalesce("seen", F.expr("cast(array() as array<array<int>>)")))


def repeated_spans(docs: DataFrame, window: int = 13, hot: int = 200_000) -> DataFrame:
    """(doc_id, text_hash, spans): word spans [start, stop) of each document that windows of smaller doc_ids cover.

    docs: doc_id, text_hash, text (binary, not null).  Spans may touch or overlap.
    """
    spark = docs.sparkSession
    shared = _anchors(docs, window, runs=False).groupBy("g").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
    shared = cut(shared.where("owner < last").select("g", "owner"))
    release(spark)
    runs = cut(_anchors(docs, window, runs=True).join(shared, "g").select("doc_id", "text_hash", "at", "owner"))
    release(spark)
    passages = cut(_passages(docs, runs, window).withColumn("key", F.md5("words")))
    release(spark)
    distinct = cut(passages.groupBy("owner", "key", "words").agg(F.min("doc_id").alias("first")))
    release(spark)
    heat = cut(distinct.groupBy("owner").count().where(F.col("count") > hot).select("owner"))
    cold, hottest = distinct.join(heat, "owner", "left_anti"), distinct.join(heat, "owner", "left_semi")
    seen = cut(_seen_before(cold, window).unionByName(_seen_hot(hottest, window)))
    release(spark)
    mine = passages.select("owner", "key", "doc_id", "text_hash", "start", "n_windows").join(seen, ["owner", "key"])
    covered = F.when(F.col("doc_id") > F.col("first"), F.array(F.array(F.lit(0), F.col("n_windows")))).otherwise(F.col("seen"))
    mine = mine.withColumn("seen", covered).where("size(seen) > 0")
    spans = F.expr(f"transform(seen, x -> array(start + x[0], start + x[1] + {window - 1}))")
    return mine.select("doc_id", "text_hash", spans.alias("spans")).groupBy("doc_id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))


def _kept(words: list[bytes], spans) -> tuple[list[bytes], np.ndarray]:
    if not spans:
        return words, np.zeros(len(words), bool)
    step = np.zeros(len(words) + 1, np.int64)
    for a, b in spans:
        step[a] += 1
        step[b] -= 1
    gone = np.cumsum(step[:-1]) > 0
    return [w for w, g in zip(words, gone, strict=True) if not g], gone


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").cast("binary").alias("text"))


def digests(docs: DataFrame, window: int = 13, hot: int = 200_000) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row; a null text has no words, a null doc_id is neither
    smaller nor larger than another, so nothing of it goes and nothing goes because of it.  Rows of one doc_id don't
    remove from each other.  Only doc_id and text are read."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    keyed = _keyed(docs)
    spans = repeated_spans(keyed.where("doc_id is not null and text is not null"), window, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            rows = []
            for words, spans in zip(_words_of(column(b, "text").to_pylist()), column(b, "spans").to_pylist(), strict=True):
                kept, gone = _kept(words, spans)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            if rows:
                yield out(schema, [column(b, "doc_id"), *map(list, zip(*rows, strict=True))])

    return keyed.join(spans, ["doc_id", "text_hash"], "left").select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = 13, hot: int = 200_000) -> DataFrame:
    """docs with covered words gone: rows that lose words have the rest joined by one space (the untouched keep their
    text as it is), n_chars, where there is such a column, follows, and rows that lose all their words go."""
    spans = repeated_spans(_keyed(docs).where("doc_id is not null and text is not null"), window, hot)
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text_hash"), F.col("spans").alias("_spans"))
    own, text = place(docs, "doc_id"), place(docs, "text")
    joined = numbered(docs).withColumn("_hash", F.xxhash64(text))
    joined = joined.join(spans, (F.col(own) == F.col("_id")) & (F.col("_hash") == F.col("_text_hash")), "left").drop("_id", "_text_hash", "_hash")
    names, counted = docs.columns, None
    if "n_chars" in names and docs.schema["n_chars"].dataType.typeName() in ("long", "integer"):
        counted = place(docs, "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text):
            texts, empty = column(b, text).to_pylist(), []
            for i, spans in enumerate(column(b, "_spans").to_pylist()):
                if spans:
                    kept, _ = _kept(texts[i].encode().split(), spans)
                    texts[i] = b" ".join(kept).decode()
                    if not kept:
                        empty.append(i)
            columns = {f"c{i}": column(b, f"c{i}") for i in range(len(names))}
            columns[text] = pa.array(texts, columns[text].type)
            if counted:
                before = columns[counted].to_pylist()
                changed = column(b, "_spans").is_valid().to_pylist()
                columns[counted] = pa.array([len(t) if c else n for t, c, n in zip(texts, changed, before, strict=True)], columns[counted].type)
            batch = pa.RecordBatch.from_arrays(list(columns.values()), names)
            if empty:
                stay = np.ones(b.num_rows, bool)
                stay[empty] = False
                batch = batch.filter(pa.array(stay))
            yield batch

    return joined.mapInArrow(run, docs.schema)
