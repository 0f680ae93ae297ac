"""Chat formatting by columnar byte assembly.

Rows, sorted by conversation and turn, are laid out a batch at a time: segment lengths (header, content, footer of each
turn), cumulative offsets, and scatter indices in numpy, which copy all segments into one preallocated buffer that
becomes the Arrow output column without another copy.  A conversation may span several output parts; parts end between
turns, and readers go through them in order, so no conversation is held whole.

A turn reads <|turn|>role\\n content <|end|>\\n.  Control strings inside contents and roles get a backslash after their
first character, and one more if they have some already, which unescape() takes away again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, out, pieces, utf8

TURN, END = "<|turn|>", "<|end|>"
#: What the template and the formats that it often meets use as control strings: <| ..., <s>, </s>, [INST], [/INST].
_CONTROL = re.compile(r"(<|\[)(\\*)(\||/?s>|/?INST\])")
_ESCAPED = re.compile(r"(<|\[)\\(\\*)(\||/?s>|/?INST\])")
_SUSPECT = r"<\\*(\||/?s>)|\[\\*(\||/?s>|/?INST\])|<\\*/?INST\]"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _role_line(role: str | None) -> str:
    return escape((role or "").replace("\\", "\\\\").replace("\n", "\\n"))


def _role(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(line))


def _gather(sources: list[tuple[np.ndarray, np.ndarray]], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave string columns row by row into one buffer: (bytes, end of each row).  A source is (bytes, offsets)."""
    k = len(sources)
    lengths = np.empty((rows, k), np.int64)
    for j, (_, ends) in enumerate(sources):
        lengths[:, j] = np.diff(ends)
    stops = np.cumsum(lengths.ravel())
    starts = (stops - lengths.ravel()).reshape(rows, k)
    buffer = np.empty(int(stops[-1]) if rows else 0, np.uint8)
    for j, (data, ends) in enumerate(sources):
        if len(data):
            shift = np.repeat(starts[:, j] - ends[:-1], lengths[:, j])
            buffer[np.arange(len(data)) + shift] = data
    return buffer, stops.reshape(rows, k)[:, -1] if rows else stops


def format_conversations(turns: DataFrame, part_bytes: int = 1 << 22) -> DataFrame:
    """(conv_id, part, n_turns, text, loss): formatted conversations in parts of whole turns.

    loss lists [start, stop) code points of part.text that a loss is taken on: the contents of assistant turns.  Turns
    are in the order of turn (null first), role and text.  Null text or role reads as empty; rows of a null conv_id are
    one conversation; repeated rows are turns of their own.  Parts of a conversation stay in one task, in order, as
    a digest over it needs them; their memory is that of one batch.  Only conv_id, turn, role and text are read.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("n_turns", pa.int64()), ("text", pa.large_string()),
                        ("loss", pa.list_(pa.list_(pa.int64())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = object(), 0
        for b in pieces(batches, "text", part_bytes):
            n = b.num_rows
            texts = pc.fill_null(column(b, "text").cast(pa.large_string()), "")
            suspect = pc.match_substring_regex(texts, _SUSPECT).to_numpy(zero_copy_only=False)
            if suspect.any():
                texts = pa.array([escape(t) if s else t for t, s in zip(texts.to_pylist(), suspect, strict=True)], pa.large_string())
            roles = column(b, "role").to_pylist()
            heads = {r: f"{TURN}{_role_line(r)}\n" for r in set(roles)}
            head = pa.array([heads[r] for r in roles], pa.large_string())
            foot = pa.array([f"{END}\n"] * n, pa.large_string())
            buffer, ends = _gather([utf8(head), utf8(texts), utf8(foot)], n)
            chars = np.column_stack([pc.utf8_length(head).to_numpy(), pc.utf8_length(texts).to_numpy(), np.full(n, len(END) + 1)])
            chars = np.cumsum(chars, axis=1)
            convs = column(b, "conv_id").to_pylist()
            first = [0] + [i for i in range(1, n) if convs[i] != convs[i - 1]]
            stops = [*first[1:], n]
            offsets = np.concatenate([[0], ends[np.array(stops) - 1]]).astype(np.int64)
            joined = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(buffer)])
            parts, losses = [], []
            for x, y in zip(first, stops, strict=True):
                part = part + 1 if convs[x] == last else 0
                last = convs[x]
                parts.append(part)
                at = np.cumsum(chars[x:y, 2]) - chars[x:y, 2]
                losses.append([[int(at[i] + chars[x + i, 0]), int(at[i] + chars[x + i, 1])] for i in range(y - x) if roles[x + i] == "assistant"])
            yield out(schema, [[convs[x] for x in first], parts, [y - x for x, y in zip(first, stops, strict=True)], joined, losses])

    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return placed.mapInArrow(run, "conv_id bigint, part bigint, n_turns bigint, text string, loss array<array<bigint>>")


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted part."""
    found = []
    for turn in text.split(TURN)[1:]:
        line, _, rest = turn.partition("\n")
        found.append((_role(line), unescape(rest.removesuffix(f"{END}\n"))))
    return found


def digests(parts: DataFrame) -> DataFrame:
    """One row per conversation, read back from format_conversations' output as it streams by in its order:
    conv_id, n_turns, turns_sha256 (role, \\n, text, \\n of each turn), loss_chars and loss_sha256 (all text under the
    loss spans, unescaped), formatted_chars."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None  # [conv_id, turns, hash of turns, loss chars, hash of loss, chars]
        row = lambda s: (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])
        for b in batches:
            done = []
            for conv, part, text, loss in zip(*(column(b, c).to_pylist() for c in ("conv_id", "part", "text", "loss")), strict=True):
                if part == 0:
                    if now:
                        done.append(row(now))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                for x, y in loss:
                    said = unescape(text[x:y])
                    now[3] += len(said)
                    now[4].update(said.encode())
                now[5] += len(text)
            if done:
                yield out(schema, list(map(list, zip(*done, strict=True))))
        if now:
            yield out(schema, [[x] for x in row(now)])

    return parts.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
