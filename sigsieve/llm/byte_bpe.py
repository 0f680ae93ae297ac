"""Byte-level BPE: overlapping chunks pre-tokenised in parallel, stitched where boundaries meet again, encoded, decoded.

A pre-token depends on where it starts and on what follows, never on what stands before.  So two scans of a text that
share one boundary share all later ones.  A long text is cut into chunks that overlap; each is scanned from its own
start, in parallel.  Where a chunk's boundaries and the next one's meet in their overlap is the stitch: from there on the
next chunk's pre-tokens are those of the whole text.  Chunks whose overlap holds no common boundary (one pre-token longer
than it, say) become one chunk and are scanned again, until every seam has a stitch.  Shorter texts are one chunk and
need no seam; nothing of theirs is shuffled.

* Pre-tokens.  The splitting pattern's rules are stated over four classes of characters (letter, number, white space,
  other), whose table is taken from the tokenizer library once, on the driver: both know the same version of Unicode.
* Merges.  Per pre-token, the pair of lowest rank first, leftmost on ties.  Pre-tokens that a task has not met yet are
  merged together, those of one length as the rows of a matrix; long ones singly, by a heap over a linked list.
* Broadcast: the vocabulary, refused above `MAX_RANKS` entries, and the class table, one byte per code point.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, out, pieces

#: Entries of a vocabulary that may be sent to every task.
MAX_RANKS = 2_000_000
#: Pre-tokens whose ids a task remembers before it forgets all.
REMEMBERED = 500_000
#: Characters after a boundary that decide it: a contraction has at most three.
_AHEAD = 3
#: Bytes up to which pre-tokens are merged as rows of a matrix.
_SHORT = 48
_NO_RANK = np.iinfo(np.int64).max
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


def character_classes() -> np.ndarray:
    """Class of every code point, as the tokenizer library's patterns see it."""
    import tiktoken

    alone = {bytes([i]): i for i in range(256)}
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    table = np.zeros(0x110000, np.uint8)
    for number, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
        matched = bytes(tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=alone, special_tokens={}).encode_ordinary(every))
        table[np.frombuffer(matched.decode().encode("utf-32-le"), np.uint32)] = number
    return table


def load_ranks(path: str) -> dict[bytes, int]:
    """Lines of a base64 token and its rank, as rank files hold them."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    if len(ranks) > MAX_RANKS:
        raise ValueError(f"vocabulary of more than {MAX_RANKS} entries")
    if missing := [i for i in range(256) if bytes([i]) not in ranks]:
        raise ValueError(f"vocabulary without the bytes {missing}")
    return ranks


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    after, before, stop = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i] if stop[i] else n
        if j >= n or stop[j] != end:  # one of the two has grown or is gone
            continue
        stop[i], stop[j] = end, 0
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(piece[i : stop[k]])) is not None:
                heapq.heappush(heap, (r, i, stop[k]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:end])) is not None:
            heapq.heappush(heap, (r, h, end))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : stop[i]]])
        i = after[i]
    return ids


def boundaries(codes: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Starts of all pre-tokens of the texts codes[ends[d]:ends[d+1]], scanned from each text's start.

    The rules: 's 't 're 've 'm 'll 'd where a scan stands at the apostrophe; else runs of letters, of numbers, of other
    characters, each with one space (U+0020) before it; white space before such a run without its last character; that
    character alone, unless it is the run's space."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes[codes]
    head = np.zeros(n + 1, bool)
    head[ends] = True
    start = head[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    fresh = start.copy()  # first character of each run of one class
    seam = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~head[1:n])  # last white space before another run
    start[seam] = True
    joined = seam[codes[seam] == 0x20] + 1
    start[joined] = False
    mark = np.flatnonzero((codes == 0x27) & fresh)
    mark = mark[start[mark]]  # not behind its own space
    left = np.minimum(ends[np.searchsorted(ends, mark, side="right")] - mark, 3)  # characters that the text has from here
    wide = np.append(codes, [0, 0])
    one, two = wide[mark + 1], wide[mark + 2]
    is_one = (left > 1) & np.isin(one, [ord(c) for c in "stmd"])
    pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    is_two = (left > 2) & pair
    for hit, length in ((is_one, 2), (is_two, 3)):
        at = mark[hit]
        start[at + 1] = False
        nxt = at + length
        start[nxt[nxt < n]] = True
    return np.flatnonzero(start)


class Pairs:
    """Rank of every pair of entries whose bytes together are an entry."""

    def __init__(self, ranks: dict[bytes, int]):
        self.span = max(ranks.values()) + 1
        found = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    found[a * self.span + b] = rank
        self.keys = np.array(sorted(found), np.int64)
        self.rank = np.array([found[k] for k in self.keys.tolist()], np.int64)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.span + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NO_RANK) if len(self.keys) else np.full(key.shape, _NO_RANK)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens of one length, as int32 bytes."""
        ids = self.byte[np.frombuffer(b"".join(pieces), np.uint8)].reshape(len(pieces), -1)
        pairs = self.ranks(ids[:, :-1], ids[:, 1:])
        row, done = np.arange(len(pieces)), [b""] * len(pieces)
        while len(row):
            width = ids.shape[1]
            at = pairs.argmin(axis=1) if width > 1 else np.zeros(len(row), np.int64)
            best = pairs[np.arange(len(row)), at] if width > 1 else np.full(len(row), _NO_RANK)
            stop = best == _NO_RANK
            if stop.any():
                for r, x in zip(row[stop].tolist(), ids[stop].astype(np.int32), strict=True):
                    done[r] = x.tobytes()
                go = ~stop
                ids, pairs, row, at, best = ids[go], pairs[go], row[go], at[go], best[go]
                if not len(row):
                    break
            here = np.arange(len(row))
            ids[here, at] = best  # an entry's id is its rank
            keep = np.arange(width)[None] != (at + 1)[:, None]
            ids = ids[keep].reshape(len(row), width - 1)
            pairs = pairs[np.arange(width - 1)[None] != at[:, None]].reshape(len(row), width - 2)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            pairs[left, at[left] - 1] = self.ranks(ids[left, at[left] - 1], ids[left, at[left]])
            pairs[right, at[right]] = self.ranks(ids[right, at[right]], ids[right, at[right] + 1])
        return done


class Coder:
    def __init__(self, ranks: dict[bytes, int], classes: np.ndarray, pairs: Pairs | None = None):
        self.ranks, self.classes, self.pairs, self.known = ranks, classes, pairs or Pairs(ranks), {}

    def __reduce__(self):
        return Coder, (self.ranks, self.classes, self.pairs)

    def scan(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code points, text ends, starts of pre-tokens) of all texts."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        ends = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=ends[1:])
        return codes, ends, boundaries(codes, ends, self.classes)

    def ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens, how many ids precede each one and the end)."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        found = list(map(known.get, pieces))
        new = [i for i, ids in enumerate(found) if ids is None]
        if new:
            self._learn({pieces[i] for i in new})
            for i in new:
                found[i] = known[pieces[i]]
        before = np.zeros(len(found) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, found), np.int64, len(found)), out=before[1:])
        return np.frombuffer(b"".join(found), np.int32), before // 4

    def _learn(self, pieces: set[bytes]) -> None:
        by_length: dict[int, list[bytes]] = {}
        for p in pieces:
            if (rank := self.ranks.get(p)) is not None:
                self.known[p] = np.int32(rank).tobytes()
            elif len(p) > _SHORT:
                self.known[p] = np.array(merge(p, self.ranks), np.int32).tobytes()
            else:
                by_length.setdefault(len(p), []).append(p)
        for same in by_length.values():
            self.known.update(zip(same, self.pairs.merge(same), strict=True))


def _byte_places(codes: np.ndarray) -> np.ndarray:
    """Offset of each code point in the UTF-8 text, and its length at the end."""
    width = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
    return np.append(0, np.cumsum(width))


def _encode_texts(coder: Coder, texts: list[str], low: list[int] | None = None, high: list[int] | None = None) -> list[np.ndarray]:
    """Ids of each text, or of its pre-tokens that start in [low, high)."""
    codes, ends, starts = coder.scan(texts)
    raw = "".join(texts).encode()
    cuts = np.append(starts, len(codes))
    first = np.searchsorted(cuts, ends[:-1] + (0 if low is None else np.asarray(low)))
    last = np.searchsorted(cuts, ends[1:] if high is None else ends[:-1] + np.asarray(high))
    at = _byte_places(codes)[cuts].tolist()
    ids, before = coder.ids([raw[x:y] for x, y in zip(at[:-1], at[1:], strict=True)])
    return [ids[a:b] for a, b in zip(before[first].tolist(), before[last].tolist(), strict=True)]


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.append(0, np.cumsum([len(a) for a in arrays])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)]), kind))


def _strings(texts: pa.Array) -> list[str]:
    return [t.decode("utf-8", "replace") for t in texts.cast(pa.large_binary()).fill_null(b"").to_pylist()]


def _chunked(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(key, part, at, core, last, text): chunk `part` starts at character `at`; `core` characters precede the next chunk."""
    schema = pa.schema([("key", pa.string()), ("part", pa.int64()), ("at", pa.int64()), ("core", pa.int64()), ("last", pa.bool_()), ("text", pa.string())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            for key, text in zip(column(b, "key").to_pylist(), _strings(column(b, "text")), strict=True):
                for part, at in enumerate(range(0, max(len(text), 1), chunk)):
                    last = at + chunk >= len(text)
                    yield out(schema, [[key], [part], [at], [min(chunk, len(text) - at)], [last], [text[at : at + chunk + overlap]]])

    return long.mapInArrow(split, "key string, part bigint, at bigint, core bigint, last boolean, text string")


def _edges(chunks: DataFrame, coder, overlap: int) -> DataFrame:
    """chunks and their boundaries, in characters of the whole text: `head` in the overlap with the chunk before, `tail`
    in that with the chunk behind, as far as what follows decides them."""
    schema = pa.schema([("key", pa.string()), ("part", pa.int64()), ("at", pa.int64()), ("core", pa.int64()), ("last", pa.bool_()), ("text", pa.string()),
                        ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            texts = _strings(column(b, "text"))
            _, ends, starts = coder.value.scan(texts)
            heads, tails = [], []
            for d, (at, core, last) in enumerate(zip(column(b, "at").to_pylist(), column(b, "core").to_pylist(), column(b, "last").to_pylist(), strict=True)):
                own = starts[np.searchsorted(starts, ends[d]) : np.searchsorted(starts, ends[d + 1])] - ends[d]
                sure = own if last else own[own <= len(texts[d]) - _AHEAD]
                heads.append(at + sure[sure < overlap])
                tails.append(at + sure[sure >= core])
            yield out(schema, [*(column(b, c) for c in ("key", "part", "at", "core", "last", "text")), _lists(heads, pa.int64()), _lists(tails, pa.int64())])

    return chunks.mapInArrow(scan, "key string, part bigint, at bigint, core bigint, last boolean, text string, head array<bigint>, tail array<bigint>")


def _stitched(chunks: DataFrame, coder, overlap: int) -> DataFrame:
    """(key, part, text, low, high): the pre-tokens of `text` that start in [low, high) are the whole text's."""
    while True:
        chunks = cut(_edges(chunks, coder, overlap))
        behind = chunks.select("key", (F.col("part") - 1).alias("part"), F.col("head").alias("_head"))
        seams = chunks.where("not last").select("key", "part", "tail").join(behind, ["key", "part"])
        seams = cut(seams.select("key", "part", F.array_min(F.array_intersect("tail", "_head")).alias("stitch")))
        if not seams.where("stitch is null").head(1):
            break
        # a run of chunks without stitches becomes one; seams are few small rows a text, texts stay out of the window
        open_ = seams.select("key", (F.col("part") + 1).alias("part"), F.col("stitch").isNull().alias("_on"))
        marks = chunks.select("key", "part").join(open_, ["key", "part"], "left")
        marks = marks.selectExpr("key", "part", "sum(if(coalesce(_on, false), 0, 1)) over (partition by key order by part) - 1 as group")
        grouped = chunks.join(marks, ["key", "part"]).groupBy("key", "group")
        whole = grouped.agg(F.min("at").alias("at"), F.sum("core").alias("core"), F.bool_or("last").alias("last"),
                            F.expr("array_sort(collect_list(struct(part, core, text)))").alias("_all"))
        text = "array_join(transform(_all, (x, i) -> if(i = size(_all) - 1, x.text, substring(x.text, 1, cast(x.core as int)))), '')"
        chunks = whole.select("key", F.col("group").alias("part"), "at", "core", "last", F.expr(text).alias("text"))
    low = seams.select("key", (F.col("part") + 1).alias("part"), F.col("stitch").alias("low"))
    rows = chunks.select("key", "part", "at", "text").join(low, ["key", "part"], "left").join(seams.withColumnRenamed("stitch", "high"), ["key", "part"], "left")
    return rows.select("key", "part", "text", F.coalesce(F.col("low") - F.col("at"), F.lit(0)).alias("low"), F.coalesce(F.col("high") - F.col("at"), F.length("text").cast("bigint")).alias("high"))


def encode(docs: DataFrame, ranks_path: str, chunk: int = 65_536, overlap: int = 512) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text under the rank file at `ranks_path`, without special tokens.

    Null and empty texts have no ids.  Rows are encoded one by one: repeated rows and ids stay as they are, a null doc_id
    too (equal long texts are encoded once).  Texts of more than `chunk` characters are cut into chunks of that many,
    each `overlap` characters longer than its share.  An empty table gives an empty result.  Only doc_id and text are read.
    """
    if not _AHEAD < overlap <= chunk:
        raise ValueError(f"an overlap lies between {_AHEAD} characters and a chunk")
    spark = docs.sparkSession
    coder = spark.sparkContext.broadcast(Coder(load_ranks(ranks_path), character_classes()))
    thin = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            yield out(schema, [column(b, "doc_id"), _lists(_encode_texts(coder.value, _strings(column(b, "text"))), pa.int32())])

    done = thin.where(F.length("text") <= chunk).mapInArrow(short, "doc_id bigint, ids array<int>")
    long = thin.where(F.length("text") > chunk).select("doc_id", F.sha2("text", 256).alias("key"), "text")
    if not long.head(1):
        return done
    chunks = _chunked(long.select("key", "text"), chunk, overlap).dropDuplicates(["key", "part"])
    part_schema = pa.schema([("key", pa.string()), ("part", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            ids = _encode_texts(coder.value, _strings(column(b, "text")), column(b, "low").to_pylist(), column(b, "high").to_pylist())
            yield out(part_schema, [column(b, "key"), column(b, "part"), _lists(ids, pa.int32())])

    encoded = _stitched(chunks, coder, overlap).mapInArrow(parts, "key string, part bigint, ids array<int>")
    whole = encoded.groupBy("key").agg(F.expr("flatten(transform(array_sort(collect_list(struct(part, ids))), x -> x.ids))").alias("ids"))
    return done.unionAll(long.select("doc_id", "key").join(whole, "key").select("doc_id", "ids"))


def decode(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """tokens (doc_id, ids) and `data`, the concatenated bytes of the ids.  A null list decodes to no bytes; an id outside
    the vocabulary, or a null one, is an error."""
    ranks = load_ranks(ranks_path)
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    by_rank = sorted((r, t) for t, r in ranks.items())
    size[[r for r, _ in by_rank]] = [len(t) for _, t in by_rank]
    sent = tokens.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(t for _, t in by_rank), np.uint8), size, np.cumsum(size) - size))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob, size, at = sent.value
        for b in batches:
            lists = column(b, "ids").fill_null([])
            ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
            low = 0
            while low < b.num_rows:  # a million ids at a time, or one row's
                high = max(low + 1, int(np.searchsorted(ends, ends[low] + (1 << 20), side="right")) - 1)
                part = lists.slice(low, high - low).flatten()
                ids = part.fill_null(-1).to_numpy()
                if len(ids) and (ids.min() < 0 or ids.max() >= len(size) or not size[ids].all()):
                    raise KeyError("an id outside the vocabulary")
                long = size[ids]
                stop = np.append(0, np.cumsum(long))
                data = blob[np.arange(stop[-1]) + np.repeat(at[ids] - stop[:-1], long)]
                places = stop[ends[low : high + 1] - ends[low]].astype(np.int32)
                joined = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(places), pa.py_buffer(data)])
                rows = b.slice(low, high - low)
                yield out(schema, [column(rows, "doc_id"), column(rows, "ids"), joined])
                low = high

    rows = tokens.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>, data binary")


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of decode()."""
    ids = F.coalesce("ids", F.expr("cast(array() as array<int>)"))
    return decoded.select("doc_id", F.size(ids).cast("bigint").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"),
                          F.sha2("data", 256).alias("decoded_sha256"))
