"""Runs of periodically repeated words: suffix trees, constant-time LCE, Lyndon roots.

A run of period q is a maximal stretch of words in which words q apart are identical.  Of each stretch of text that can
hold one, two suffix trees are built by Ukkonen's algorithm, of the words and of their reversal.  The longest common
extension (LCE) of two places is the string depth of their leaves' lowest common ancestor: the minimum of an interval of
the Euler tour, answered in constant time.  Every run has a Lyndon root that is the longest Lyndon word at its first word,
in the words' order or the reversed one; so each place gives two candidate periods, the distances to the next smaller
suffix, and each candidate is extended to both sides by LCE.

* Which stretches.  A run of at least `min_words` words and `min_exponent` periods holds, at every place but the last
  ones, `gram` words that stand again within one period.  Places whose grams recur that near are found by sorting gram
  hashes; text without any holds no run and needs no tree.  The rule drops no run (see _stretches), and equal words
  have equal hashes, so a collision can only add a stretch.
* Memory.  A document is worked on by one task in space linear in its words; documents are taken in pieces of about
  `PIECE_BYTES`, so only one document longer than that is held alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textgrid as tg
from .common import column, out, pieces, utf8

_BLOCK = 16


def suffix_tree(s: list[int]) -> tuple[list[int], list[int], list[dict[int, int] | None]]:
    """Ukkonen's tree of s, whose last symbol occurs once: (first, last, children) by node; node v's edge reads
    s[first[v]:last[v]], node 0 is the root, leaves have no children."""
    n = len(s)
    first, last, link, kids = [0], [0], [0], [{}]
    node = edge = length = open_ = 0
    for i, c in enumerate(s):
        open_ += 1
        fresh = 0
        while open_:
            if not length:
                edge = i
            below = kids[node].get(s[edge])
            if below is None:
                kids[node][s[edge]] = len(first)
                first.append(i)
                last.append(n)
                link.append(0)
                kids.append(None)
                if fresh:
                    link[fresh] = node
                    fresh = 0
            else:
                start = first[below]
                reach = last[below] - start
                if length >= reach:
                    edge += reach
                    length -= reach
                    node = below
                    continue
                if s[start + length] == c:
                    length += 1
                    if fresh:
                        link[fresh] = node
                    break
                middle = len(first)
                first += [start, i]
                last += [start + length, n]
                link += [0, 0]
                kids += [{s[start + length]: below, c: middle + 1}, None]
                kids[node][s[edge]] = middle
                first[below] = start + length
                if fresh:
                    link[fresh] = middle
                fresh = middle
            open_ -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - open_ + 1
    return first, last, kids


def _tour(first: list[int], last: list[int], kids: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(string depths along the Euler tour, place of each suffix's leaf in it), children in the order of their symbols."""
    tour, at = [], [0] * n
    stack = [(0, 0)]
    while stack:
        v, depth = stack.pop()
        if v < 0:  # back at an inner node
            tour.append(depth)
            continue
        depth += last[v] - first[v]
        below = kids[v]
        if below is None:
            at[n - depth] = len(tour)
            tour.append(depth)
            continue
        tour.append(depth)
        order = sorted(below.items(), reverse=True)
        for k, (_, u) in enumerate(order):
            if k:
                stack.append((-1, depth))
            stack.append((u, depth))
    return np.array(tour, np.int64), np.array(at, np.int64)


def _falling(kids: list, first: list[int], last: list[int], n: int) -> np.ndarray:
    """Rank of each suffix where symbols order the other way round, the end of text still being the smallest."""
    rank, seen = np.zeros(n, np.int64), 0
    stack = [(0, 0)]
    while stack:
        v, depth = stack.pop()
        depth += last[v] - first[v]
        below = kids[v]
        if below is None:
            rank[n - depth] = seen
            seen += 1
            continue
        order = sorted(below.items())
        if order[0][0] < 0:
            order.append(order.pop(0))
        stack.extend((u, depth) for _, u in order)
    return rank


class Lce:
    """Longest common extensions of s by lowest common ancestors: minima of the Euler tour, by blocks, in linear space."""

    def __init__(self, s: list[int]):
        self.n = len(s)
        self.tree = suffix_tree([*s, -1])
        tour, self.at = _tour(*self.tree, self.n + 1)
        width = -(-len(tour) // _BLOCK)
        self.tour = np.pad(tour, (0, width * _BLOCK - len(tour)), constant_values=self.n + 1).reshape(width, _BLOCK)
        self.head = np.minimum.accumulate(self.tour, axis=1)
        self.tail = np.minimum.accumulate(self.tour[:, ::-1], axis=1)[:, ::-1]
        self.sparse = [self.tour.min(axis=1)]
        while 2 << (len(self.sparse) - 1) <= width:
            top, half = self.sparse[-1], 1 << (len(self.sparse) - 1)
            self.sparse.append(np.minimum(top[:-half], top[half:]))

    def ranks(self) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each suffix in the order of symbols, and in the reversed order of symbols."""
        first, last, kids = self.tree
        return self.at[: self.n], _falling(kids, first, last, self.n + 1)[: self.n]

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of s[i:] and s[j:], for arrays of unequal places in 0..n."""
        a, b = np.minimum(self.at[i], self.at[j]), np.maximum(self.at[i], self.at[j])
        x, y = a // _BLOCK, b // _BLOCK
        low = np.minimum(self.tail[x, a % _BLOCK], self.head[y, b % _BLOCK])
        gap = y - x - 1
        for level in np.unique(np.frexp(gap[gap > 0])[1] - 1):
            q = np.flatnonzero((gap > 0) & (np.frexp(gap)[1] - 1 == level))
            t = self.sparse[level]
            low[q] = np.minimum(low[q], np.minimum(t[x[q] + 1], t[y[q] - (1 << level)]))
        q = np.flatnonzero(x == y)
        lane = np.arange(_BLOCK)
        inside = (lane >= (a[q] % _BLOCK)[:, None]) & (lane <= (b[q] % _BLOCK)[:, None])
        low[q] = np.where(inside, self.tour[x[q]], self.n + 1).min(axis=1)
        return low


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """The next place with a smaller rank, or the end: the longest Lyndon word at i ends there."""
    rank = rank.tolist()
    n = len(rank)
    after = [n] * n
    for i in range(n - 2, -1, -1):
        j, r = i + 1, rank[i]
        while j < n and rank[j] > r:
            j = after[j]
        after[i] = j
    return np.array(after, np.int64)


def runs_of(s: list[int], min_words: int = 24, min_exponent: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of s of at least min_words symbols and min_exponent (2 or more) periods,
    ordered by start, then period.  Symbols are integers from 0."""
    n = len(s)
    if n < 2:
        return []
    ahead, back = Lce(s), Lce(s[::-1])
    i = np.arange(n)
    found = []
    for rank in ahead.ranks():
        j = _next_smaller(rank)
        end = j + ahead(i, j)
        inner = np.flatnonzero(i > 0)
        start = i.copy()
        start[inner] -= back(n - i[inner], n - j[inner])
        length, period = end - start, j - i
        keep = (length >= min_words) & (length >= min_exponent * period)
        found.append(np.column_stack([start, length, period])[keep])
    every = np.unique(np.concatenate(found), axis=0)
    return [tuple(map(int, r)) for r in every[np.lexsort((every[:, 2], every[:, 0]))]]


def _stretches(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, min_words: int, min_exponent: int) -> list[tuple[int, int]]:
    """Bounds of stretches of words outside which no run lies; text d's words are hashes[first[d]:last[d]].

    A run of length L >= max(min_words, e*q) has L - q - gram + 1 places whose gram stands again q words on, hence next
    within q; gram = ceil(min_words * (e - 1) / e) <= L - q, so there is one place at least.  They are neighbours, so
    where m neighbouring places have a recurring gram, q <= (m + gram - 1) / (e - 1), and a place whose next copy is
    farther off belongs to no run.  From copy to copy, [place, next copy + gram) covers the whole run.
    """
    gram = -(-min_words * (min_exponent - 1) // min_exponent)
    text = np.repeat(np.arange(len(first)), last - first)
    g = tg.grams(hashes, gram)
    place = np.flatnonzero(np.arange(len(hashes)) + gram <= last[text]) if len(hashes) else np.zeros(0, np.int64)
    key = tg.mixed(g[place] + text[place].astype(np.uint64) * tg.MIX)
    order = place[np.argsort(key, kind="stable")]
    key = np.sort(key)
    same = (key[1:] == key[:-1]) & (text[order[1:]] == text[order[:-1]])
    here, there = order[:-1][same], order[1:][same]
    by_place = np.argsort(here)
    here, there = here[by_place], there[by_place]
    if not len(here):
        return []
    new = np.append(True, (here[1:] != here[:-1] + 1) | (text[here[1:]] != text[here[:-1]]))
    group = np.cumsum(new) - 1
    near = (there - here) * (min_exponent - 1) <= np.bincount(group)[group] + gram - 1
    here, there = here[near], there[near]
    depth = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(depth, here, 1)
    np.add.at(depth, there + gram, -1)
    inside = np.cumsum(depth)[:-1] > 0
    edge = np.zeros(len(hashes), bool)
    edge[first[first < len(hashes)]] = True
    starts = np.flatnonzero(inside & (edge | ~np.append(False, inside[:-1])))
    stops = np.flatnonzero(inside & np.append(edge[1:] | ~inside[1:], True)) + 1
    return [(int(a), int(b)) for a, b in zip(starts, stops, strict=True) if b - a >= min_words]


def periodic_runs(docs: DataFrame, min_words: int = 24, min_exponent: int = 3) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): every run of a text's words, and the text with each run cut to one period.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0.  runs is an array of (start, length, period), ordered by start, then
    period: all maximal stretches of smallest period q that hold at least min_words words and min_exponent (at least 2)
    periods.  collapsed joins by one space the words that no run holds behind its first period.

    A null or empty text, or one of separators only, has no words, no runs and an empty collapsed text.  Rows are
    judged one by one: repeated rows and ids stay as they are, a null doc_id too.  An empty table gives an empty result.
    Only doc_id and text are read, so other columns, whatever their names, play no part.
    """
    if min_exponent < 2 or min_words < 2:
        raise ValueError("runs have at least two words and two periods")
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())])
    thin = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            data, ends = utf8(column(b, "text"))
            starts, stops, first = tg.words(data, ends)
            raw = data.tobytes()
            held: dict[int, list[tuple[int, int, int]]] = {}
            for a, z in _stretches(tg.span_hash(tg.prefix(data), starts, stops), first[:-1], first[1:], min_words, min_exponent):
                number: dict[bytes, int] = {}
                s = [number.setdefault(raw[x:y], len(number)) for x, y in zip(starts[a:z].tolist(), stops[a:z].tolist(), strict=True)]
                d = int(np.searchsorted(first, a, side="right")) - 1
                held.setdefault(d, []).extend((a - int(first[d]) + x, length, p) for x, length, p in runs_of(s, min_words, min_exponent))
            texts = []
            for d in range(b.num_rows):
                words = raw[ends[d] : ends[d + 1]].split()
                if found := held.get(d):
                    found.sort(key=lambda r: (r[0], r[2]))
                    gone = np.zeros(len(words) + 1, np.int64)
                    for x, length, p in found:
                        gone[x + p] += 1
                        gone[x + length] -= 1
                    words = [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]
                texts.append(b" ".join(words))
            runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in held.get(d, [])] for d in range(b.num_rows)]
            yield out(schema, [column(b, "doc_id"), np.diff(first), pa.array(runs, schema.field("runs").type), pa.array(texts, pa.binary()).cast(pa.string())])

    return thin.mapInArrow(find, "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def digests(runs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of periodic_runs.

    start to exponent_milli tell of the run with the greatest length / period, compared exactly; the earliest start, then
    the shortest period, wins a tie; without a run they are null."""
    best = "aggregate(runs, runs[0], (a, x) -> if(x.length * a.period > a.length * x.period, x, a))"
    lines = "array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\\n')), '')"
    rows = runs.withColumn("_best", F.expr(f"if(size(runs) > 0, {best}, null)"))
    return rows.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"),
        F.sha2(F.expr(lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
